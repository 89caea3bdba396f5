"""Streaming views of detections for monitoring. These follow the roadmap of such a system, not
operators that exist in code elsewhere.

A detection stream has camera, ts, frame_num, model, class_id and score. All functions take and give
streaming DataFrames (or batch ones, with the same result over the same rows); late rows are dropped
by the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "10 minutes"


def sample_frames(stream: DataFrame, every: str = "10 seconds", late: str = LATE) -> DataFrame:
    """(camera, window, frame_num): the first frame of each camera in each span of time."""
    return stream.withWatermark("ts", late).groupBy("camera", F.window("ts", every)).agg(F.min_by("frame_num", F.struct("ts", "frame_num")).alias("frame_num")).select("camera", F.col("window.start").alias("start"), "frame_num")


def confidence_windows(stream: DataFrame, size: str = "5 minutes", slide: str = "1 minute", bins: int = 10, late: str = LATE) -> DataFrame:
    """(camera, start, bin, n): histograms of scores over sliding windows."""
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    return stream.withWatermark("ts", late).groupBy("camera", F.window("ts", size, slide), b.alias("bin")).agg(F.count("*").alias("n")).select("camera", F.col("window.start").alias("start"), "bin", "n")


def drift(windows: DataFrame, reference: DataFrame) -> DataFrame:
    """(camera, start, distance): total variation between a window's histogram and the reference
    (bin, share), for finished windows."""
    total = windows.groupBy("camera", "start").agg(F.sum("n").alias("total"))
    grid = total.join(F.broadcast(reference), F.lit(True))
    both = grid.join(windows, ["camera", "start", "bin"], "left")
    return both.groupBy("camera", "start").agg((F.sum(F.abs(F.coalesce("n", F.lit(0)) / F.col("total") - F.col("share"))) / 2).alias("distance"))


def class_mix(stream: DataFrame, size: str = "5 minutes", late: str = LATE) -> DataFrame:
    """(camera, start, class_id, n) over tumbling windows."""
    return stream.withWatermark("ts", late).groupBy("camera", F.window("ts", size), "class_id").agg(F.count("*").alias("n")).select("camera", F.col("window.start").alias("start"), "class_id", "n")


def flicker(counts: DataFrame) -> DataFrame:
    """(camera, frame_num, change): how much the number of detections of a frame differs from that of
    the camera's frame before. `counts` has camera, frame_num and n; the last frame is kept as state."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("frame_num")
        last = state.get[0] if state.exists else None
        out = []
        for frame, n in zip(rows["frame_num"], rows["n"]):
            if last is not None:
                out.append((key[0], int(frame), int(abs(n - last))))
            last = int(n)
        state.update((last,))
        yield pd.DataFrame(out, columns=["camera", "frame_num", "change"])

    return counts.groupBy("camera").applyInPandasWithState(step, "camera string, frame_num long, change long", "last long", "append", GroupStateTimeout.NoTimeout)


def shadow_agreement(live: DataFrame, shadow: DataFrame, late: str = "1 minute") -> DataFrame:
    """(camera, frame_num, live_n, shadow_n, agree): two models' detections of a frame, joined within
    the watermark. Both have camera, frame_num, ts and n."""
    a = live.withWatermark("ts", late).select("camera", "frame_num", "ts", F.col("n").alias("live_n"))
    b = shadow.withWatermark("ts", late).select(F.col("camera").alias("c2"), F.col("frame_num").alias("f2"), F.col("ts").alias("ts2"), F.col("n").alias("shadow_n"))
    same = (F.col("camera") == F.col("c2")) & (F.col("frame_num") == F.col("f2")) & (F.col("ts2") >= F.col("ts") - F.expr(f"interval {late}")) & (F.col("ts2") <= F.col("ts") + F.expr(f"interval {late}"))
    return a.join(b, same).select("camera", "frame_num", "live_n", "shadow_n", (F.col("live_n") == F.col("shadow_n")).alias("agree"))


def mined(stream: DataFrame, low: float = 0.3, high: float = 0.6) -> DataFrame:
    """Detections worth labelling: of middling confidence."""
    return stream.where((F.col("score") >= low) & (F.col("score") < high))

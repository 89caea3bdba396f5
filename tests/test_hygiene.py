import numpy as np
import pytest

from sightline.operators import hygiene as hy
from sightline.sources import annotations as an

KEYS = ["sequence", "frame_num"]


def box(left, top, width, height):
    return f'<box left="{left}" top="{top}" width="{width}" height="{height}"/>'


def target(k, kind, *place):
    inner = (box(*place) if place else "") + ("<attribute/>" if kind is None else f'<attribute vehicle_type="{kind}"/>')
    return f'<target id="{k}">{inner}</target>'


def sequence(name, weather, frames, ignored=()):
    regions = f"<ignored_region>{''.join(box(*b) for b in ignored)}</ignored_region>" if ignored else ""
    body = "".join(f'<frame num="{n}"><target_list>{"".join(t)}</target_list></frame>' for n, t in frames)
    return f'<sequence name="{name}"><sequence_attribute camera_state="unstable" sence_weather="{weather}"/>{regions}{body}</sequence>'


# Three frames on a 400 x 250 picture. In frame 4 the second van covers 38 of the first one's 40 columns,
# so it goes; the truck on the bus's place stays, as a conflict. Frame 9 is empty. Two regions of 50 x 40
# that share 10 x 40 cover 3,600 of 100,000 pixels.
CROSSING = sequence(
    "SEQ_crossing", "foggy",
    [
        (4, [target(11, "van", 60, 30, 40, 25), target(12, "van", 62, 30, 40, 25), target(13, "bus", 200, 80, 90, 60), target(14, "truck", 200, 80, 90, 60)]),
        (6, [target(15, "van", 64, 31, 40, 25)]),
        (9, []),
    ],
    [(300, 200, 50, 40), (340, 200, 50, 40)],
)
#: A frame number that stands twice, a target without a box, one without a kind, and no region.
SPARSE = sequence("SEQ_sparse", "dusk", [(7, []), (7, [target(3, None, 8, 9, 12, 6), target(5, "bus")])])


@pytest.fixture
def sequences(spark, tmp_path):
    for name, text in (("one", CROSSING), ("two", SPARSE)):
        (tmp_path / f"{name}.xml").write_text(text)
    return an.read_sequences(spark, str(tmp_path / "*.xml")).cache()


def test_audit_of_a_sequence(sequences):
    rows = {r.sequence: r for r in hy.audit_sequences(an.sequence_frames(sequences), an.sequence_targets(sequences), an.sequence_regions(sequences), 400.0, 250.0).collect()}
    r = rows["SEQ_crossing"]
    assert (r.frames, r.boxes_before, r.boxes_after, r.removed, r.conflicts, r.ignore_regions) == (3, 5, 4, 1, 1, 2)
    assert abs(r.fraction - 0.036) < 1e-12 and r.histogram == {"van": 2, "bus": 1, "truck": 1}
    assert (rows["SEQ_sparse"].frames, rows["SEQ_sparse"].boxes_before, rows["SEQ_sparse"].ignore_regions) == (2, 1, 0)


def test_missing_parts_of_a_file(sequences):
    targets = an.sequence_targets(sequences).where("sequence = 'SEQ_sparse'").collect()
    assert [(t.native_class, t.frame_pos) for t in targets] == [("?", 1)]
    assert an.sequence_regions(sequences).where("sequence = 'SEQ_sparse'").count() == 0
    last = an.last_frames(an.sequence_frames(sequences)).where("sequence = 'SEQ_sparse'").collect()
    assert [(f.frame_num, f.frame_pos) for f in last] == [(7, 1)]


def frame(spark, rows):
    return spark.createDataFrame([("s", 3, i, *map(float, r[1:]), r[0]) for i, r in enumerate(rows)], "sequence string, frame_num int, ordinal int, left double, top double, width double, height double, native_class string")


def test_dedup_compares_with_kept_boxes_only(spark):
    # Shifted by s of 48 columns, the overlap is (48 - s) / (48 + s): 2 of 48 is a copy, 4 is not.
    apart = frame(spark, [("van", 10, 20, 48, 16), ("van", 34, 20, 48, 16), ("truck", 10, 20, 48, 16)])
    assert hy.dedup_targets(apart, KEYS).count() == 3 and hy.cross_class_conflicts(apart, KEYS).count() == 1
    # The second is a copy of the first; the third of the second alone, which is gone by then.
    chain = frame(spark, [("van", 10, 20, 200, 16), ("van", 18, 20, 200, 16), ("van", 26, 20, 200, 16), ("van", 34, 20, 200, 16)])
    left, kept = [10, 18, 26, 34], []
    for i, x in enumerate(left):
        if all((200 - abs(x - left[k])) / (200 + abs(x - left[k])) < 0.9 for k in kept):
            kept.append(i)
    assert sorted(r.ordinal for r in hy.dedup_targets(chain, KEYS).collect()) == kept == [0, 2]


def test_union_of_regions_counts_pixels_once(spark):
    boxes = [(2.0, 3.0, 40.5, 20.0), (30.2, 10.0, 30.0, 30.9), (50.0, 0.0, 5.0, 60.0), (50.0, 0.0, 5.0, 60.0)]
    mask = np.zeros((50, 60), bool)
    for x, y, w, h in boxes:
        mask[int(np.floor(y)) : int(np.ceil(y + h)), int(np.floor(x)) : int(np.ceil(x + w))] = True
    regions = spark.createDataFrame([("s", *b) for b in boxes], "sequence string, left double, top double, width double, height double")
    assert hy.covered_fraction(regions, ["sequence"], 60.0, 50.0).first().covered_px == mask.sum()


def test_every_nth_is_by_place(spark):
    def taken(numbers, n):
        rows = spark.createDataFrame([("s", x) for x in numbers], "sequence string, frame_num int")
        return sorted(r.frame_num for r in hy.every_nth(rows, n).collect())

    assert taken(range(40, 62), 7) == [40, 47, 54, 61]
    assert taken([90, 20, 50, 70], 2) == [20, 70] and taken([8, 8, 8, 2, 2], 3) == [2]
    with pytest.raises(ValueError):
        taken([1], 0)

"""Where intermediate tables go: the folder that every executor can read."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Only where that is unset, as in
    tests, a folder of this process is made and removed at its end."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = getattr(scratch_folder, "own", None)
        if not folder:
            folder = scratch_folder.own = "file://" + tempfile.mkdtemp(prefix="sightline-")
            atexit.register(shutil.rmtree, folder[len("file://"):], ignore_errors=True)
    return folder


def application_folder(spark: SparkSession) -> str:
    """Where this application's tables go."""
    return f"{scratch_folder(spark)}/sightline/{spark.sparkContext.applicationId}"


def drop_scratch(spark: SparkSession) -> bool:
    """Remove every table that this application has written to the shared folder; False if there was none.
    Call it when all results are written: DataFrames that read these tables fail from then on. Other
    applications' tables stay."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(application_folder(spark))
    return path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once and read it back: cuts the lineage, and what is written outlives lost
    executors. The table takes its plan's partitioning; nothing is pulled to the driver. It stays until
    drop_scratch."""
    path = f"{application_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def extended(schema: StructType, ddl: str) -> StructType:
    """The schema with more fields."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of `df` has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"__{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out

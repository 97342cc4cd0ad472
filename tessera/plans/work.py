"""Work tables in the folder that driver and executors share, and row numbers without a single task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder serves a session on one machine, and a cluster is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _local:
            _local.append(f"file://{tempfile.mkdtemp(prefix='tessera-work-')}")
        folder = _local[0]
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def number_rows(df: DataFrame, by: str, column: str = "__n") -> DataFrame:
    """Adds 1, 2, ... in the order of ``by``: rows are dealt by range, numbered in each part, and parts are offset by their sizes."""
    parts = df.repartitionByRange(by).sortWithinPartitions(by)
    marked = stored(parts.withColumn("__part", F.spark_partition_id()).withColumn("__seq", F.monotonically_increasing_id()), "numbered")
    sizes = marked.groupBy("__part").count()  # a row for each part
    a, b = sizes.alias("a"), sizes.alias("b")
    before = a.join(b, F.col("b.__part") < F.col("a.__part"), "left").groupBy("a.__part").agg(F.coalesce(F.sum("b.count"), F.lit(0)).alias("__before"))
    within = F.col("__seq").bitwiseAND(F.lit((1 << 33) - 1))
    return marked.join(F.broadcast(before), "__part").withColumn(column, F.col("__before") + within + 1).drop("__part", "__seq", "__before")

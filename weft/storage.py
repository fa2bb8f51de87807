"""Tables in the shared folder that end a lineage, so that a lost executor costs nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: folders made by this process, for clear()
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; where none is set, one under /tmp if all of Spark is in
    one process, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "/tmp/checkpoints"
    _MADE.append(f"{base.rstrip('/')}/weft-{uuid.uuid4().hex}")
    return _MADE[-1]


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """df as a table in the shared folder, read again."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes the folders that this process has made; for the end of a job, when no result of it is read any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _MADE:
        path = jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(conf).delete(path, True)

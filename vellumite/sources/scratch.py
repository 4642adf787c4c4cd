"""Tables written once to the folder that all executors share, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of our own only where it is unset on a single local JVM."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="spark-vellumite-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _made.append((spark, path))
    return path


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def made() -> list[tuple[SparkSession, str]]:
    """Scratch tables written so far."""
    return list(_made)


def release(tables: list[tuple[SparkSession, str]]) -> None:
    """Delete scratch tables that nothing reads any more."""
    for entry in tables:
        if entry in _made:
            spark, path = entry
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
            _made.remove(entry)

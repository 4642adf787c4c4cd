"""Folders in which files arrive one by one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str) -> DataFrame:
    """New PDF files of ``folder`` as a stream: doc_id, path, length, content."""
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "length", "content")


def each_batch(spark: SparkSession, folder: str, checkpoint: str, handle: Callable[[DataFrame, int], None]):
    """Run ``handle(files, batch)`` once over what has arrived since the last call."""
    return arriving(spark, folder).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_choice(choices: DataFrame) -> DataFrame:
    """(session, level): the newest choice of each session; ``generation`` counts its choices, older ones are dropped."""
    return choices.groupBy("session").agg(F.max_by("level", "generation").alias("level"))


#: Phases in which a program takes a new file.
OPEN_PHASES = ("idle", "review", "done", "failed")


def to_review(offered: DataFrame) -> DataFrame:
    """(session, offer, url): of the urls of each offer the first that is a local file, where the session's ``phase`` takes files.

    ``offered`` has session, offer, place, url and phase. What is offered while a file is read or written is dropped.
    """
    local = offered.where(F.lower("url").startswith("file:") & F.col("phase").isin(*OPEN_PHASES))
    return local.groupBy("session", "offer").agg(F.min_by("url", "place").alias("url"))

"""A whole folder at once: clean every file, count how each ended, and write the copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Options
from ..functions.sizes import output_name, probed
from ..sources.sink import relative_column, write_files
from ..sources.tables import read_files
from .lengths import exact_sizes
from .sanitize import Cleaned, inspect, outcomes, sanitize


def corpus_check(spark: SparkSession, folder: str) -> DataFrame:
    """(outcome, n) of all PDF files under ``folder``; nothing is written."""
    return outcomes(sanitize(read_files(spark, folder)).status)


def clean_folder(spark: SparkSession, folder: str, target: str, options: Options = DEFAULT, level: int = 0) -> tuple[Cleaned, DataFrame]:
    """Clean all files under ``folder`` into ``target``; what was done, and (doc_id, written, error_code) of each file written."""
    files = read_files(spark, folder)
    done = sanitize(files, options, level)
    inside = F.regexp_extract(relative_column(F.col("path"), folder), "^(.*/)?[^/]*$", 1)  # folders under the input folder
    named = done.files.join(files.select("doc_id", "path"), "doc_id").withColumn("name", F.concat(inside, output_name(F.col("path"), F.lit(level))))
    return done, write_files(named, target, folder)


def probe(files: DataFrame, levels: tuple[int, ...] = (0, 1, 2, 3, 4)) -> DataFrame:
    """Exact size estimates of ``files`` at ``levels``, from one inspection and lengths alone; files above the limit, and refused ones, have none."""
    sizes = exact_sizes(inspect(files), levels=levels).join(files.select("doc_id", F.col("length").alias("input_bytes")), "doc_id")
    return probed(sizes)

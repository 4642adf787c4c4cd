"""Operator 10 - sharding along a Hilbert curve over several metadata dimensions.

Each dimension is quantised to ``BITS`` bits by rank: a value's place among all
rows, in row counts, so each step of the scale holds about as many rows as the
next. The Hilbert index of the quantised point keeps documents that are near in
all dimensions near on the curve. Rows are sorted by it (range partitioning, no
global window) and the curve is cut into runs of equal row counts: law ``rows``,
counts at most one apart. A run spans a narrow box in every dimension, which the
zone map of :func:`write_runs` records, so a filter on any dimension skips files.

Null values of a dimension are its lowest. Null texts have size 1 and the crc of
the empty text. Ties on the curve go by id, then by text hash; repeated rows are
spread by those and take neighbouring slots. An empty table gives no rows.
Extra columns are kept by :func:`hilbert_runs`; those named hilbert, run, slot or
position are replaced, as are names that begin with ``_dim_`` or ``_step_``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BITS = 8


def hilbert_index(columns: list[np.ndarray], bits: int) -> np.ndarray:
    """Index on the Hilbert curve of points given by their coordinates (Skilling 2004, transposed form)."""
    x = [c.astype(np.int64).copy() for c in columns]
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(hit, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x = [c ^ t for c in x]
    out = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for c in x:
            out = (out << 1) | ((c >> bit) & 1)
    return out


def curve_column(columns: list[str], bits: int) -> Column:
    @F.pandas_udf("long")
    def index(points: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_index([points.iloc[:, i].to_numpy() for i in range(points.shape[1])], bits))

    return index(F.struct(*columns))


def rank_scale(rows: DataFrame, column: str, bits: int, name: str) -> DataFrame:
    """(value, step): each distinct value's equal-count step, 0 .. 2**bits - 1, in the values' order, null first.

    Values are summed up before they are ranked, and the ranks of very many
    values come from range partitions, so no task sees them all.
    """
    counts = rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    ordered = counts.repartitionByRange(F.asc_nulls_first("value")).sortWithinPartitions(F.asc_nulls_first("value"))
    ordered = common.stored(ordered.withColumn("pid", F.spark_partition_id()), f"values_{name}")
    parts = ordered.groupBy("pid").agg(F.sum("n").alias("rows"))
    parts = parts.selectExpr("pid", "sum(rows) over (order by pid) - rows as ahead", "sum(rows) over () as total")
    placed = ordered.join(parts, "pid").selectExpr("value", "ahead + sum(n) over (partition by pid order by value nulls first) - n as before", "total")
    return common.stored(placed.selectExpr("value", f"cast(floor(before * {1 << bits}D / total) as int) as step"), f"scale_{name}")


def on_curve(rows: DataFrame, dims: dict[str, str], bits: int = BITS) -> DataFrame:
    """``rows`` with a column ``hilbert``; ``dims`` maps a dimension's name to its SQL expression."""
    out, steps = rows.selectExpr("*", *(f"{e} as _dim_{d}" for d, e in dims.items())), []
    for d in dims:
        scale = rank_scale(out, f"_dim_{d}", bits, d).selectExpr(f"value as _step_v_{d}", f"step as _step_{d}")
        out = out.join(scale, F.expr(f"_dim_{d} <=> _step_v_{d}"), "left").drop(f"_step_v_{d}")
        steps.append(f"_step_{d}")
    return out.withColumn("hilbert", curve_column(steps, bits)).drop(*steps, *(f"_dim_{d}" for d in dims))


def hilbert_runs(rows: DataFrame, dims: dict[str, str], runs: int, ties: list[str], bits: int = BITS) -> DataFrame:
    """``rows`` with hilbert, run (0 .. runs - 1) and slot (place in the run): runs of the curve, counts at most one apart."""
    placed = on_curve(rows, dims, bits)
    by = ["hilbert", *(F.asc_nulls_first(t) for t in ties)]
    placed = common.with_position(placed.repartitionByRange(*by).sortWithinPartitions(*by), "curve")
    total = placed.agg(F.count(F.lit(1))).first()[0]
    # run r holds positions from ceil(r * total / runs) on
    run = F.expr(f"cast(position * {runs} div {max(total, 1)} as int)")
    start = F.expr(f"(cast(run as long) * {total} + {runs - 1}) div {runs}")
    return placed.withColumn("run", run).withColumn("slot", F.col("position") - start).drop("position")


def write_runs(placed: DataFrame, dims: dict[str, str], folder: str) -> DataFrame:
    """Write the rows of :func:`hilbert_runs` by run under ``folder`` and return the zone map: run, rows, least and largest value of each dimension.

    Every row is written once, repeated ids and null ids too: rows carry their run, nothing is joined back.
    """
    placed.repartitionByRange("run", "slot").sortWithinPartitions("run", "slot").write.partitionBy("run").parquet(f"{folder}/runs")
    written = placed.sparkSession.read.parquet(f"{folder}/runs").selectExpr("run", *(f"{e} as {d}" for d, e in dims.items()))
    ends = [f(d).alias(f"{n}_{d}") for d in dims for n, f in (("min", F.min), ("max", F.max))]
    zones = written.groupBy("run").agg(F.count(F.lit(1)).alias("rows"), *ends)
    zones.write.parquet(f"{folder}/zones")
    return placed.sparkSession.read.parquet(f"{folder}/zones")


#: The dimensions by which documents are looked up.
DIMS = {"lang": "lang", "source": "source", "size": "size"}


def op10_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    placed = hilbert_runs(common.stored(rows, "metadata"), DIMS, 8, ["doc_id", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("run").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


QUERIES = {"op10_hilbert_shards": op10_hilbert_shards}
ORACLES: dict[str, str] = {}

"""What the operators of this subpackage share: scratch tables, byte words, ranks.

Scratch tables are written to the folder that the cluster names in
``spark.checkpoint.dir``, which the driver and all executors see, so a lost
executor costs the tasks it ran and nothing that was written before.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x20\x09-\x0D]+"

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, ``spark.checkpoint.dir``; one of our own only on a single local JVM, where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local-") or not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="spark-vellumite-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _made.append((spark, path))
    return path


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and read it back: cuts lineage."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folders_made() -> list[tuple[SparkSession, str]]:
    """Scratch folders made so far, in order."""
    return list(_made)


def release(folders: list[tuple[SparkSession, str]]) -> None:
    """Delete scratch folders whose readers are done."""
    for entry in folders:
        delete_path(*entry)
        _made.remove(entry)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def hand_back() -> None:
    """Give memory that is free again back to the system: Arrow's, and glibc's, which else keeps up to twice its largest block."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, TypeError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(columns: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores in front as it takes to clash with none of ``columns``."""
    held, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in held:
            name = f"_{name}"
        out.append(name)
    return out


def ascii_lower(column: Column | str) -> Column:
    """Lower-case A-Z and nothing else."""
    column = F.col(column) if isinstance(column, str) else column
    return F.translate(column, ASCII_UPPER, ASCII_UPPER.lower())


def byte_texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """A string column of an Arrow batch as UTF-8 bytes; null becomes empty.

    ``bytes.lower`` changes A-Z only and ``bytes.split`` splits at 0x20 and
    0x09-0x0D only, which is just how the contracts define words.
    """
    values = batch.column(batch.schema.get_field_index(column))
    return pc.fill_null(pc.cast(values, pa.binary()), b"").to_pylist()


def with_position(ordered: DataFrame, name: str) -> DataFrame:
    """Global 0-based ``position`` of every row.

    ``ordered`` must come out of ``repartitionByRange(...).sortWithinPartitions(...)``.
    Positions inside a partition need no shuffle: the low 33 bits of
    ``monotonically_increasing_id`` count its rows. Partition totals, one row
    a partition, are then summed up and joined back.
    """
    mid, pid, row, base, n = unused(ordered.columns, "_mid", "_pid", "_row", "_base", "_n")
    numbered = ordered.withColumn(mid, F.monotonically_increasing_id())
    numbered = numbered.withColumn(pid, F.shiftright(mid, 33)).withColumn(row, F.col(mid).bitwiseAND((1 << 33) - 1)).drop(mid)
    table = stored(numbered, name)
    totals = table.groupBy(pid).agg(F.count(F.lit(1)).alias(n))
    bases = totals.selectExpr(pid, f"coalesce(sum({n}) over (order by {pid} rows between unbounded preceding and 1 preceding), 0) as {base}")
    return table.join(bases, pid).withColumn("position", F.col(base) + F.col(row)).drop(base, row, pid)


def with_sums_ahead(rows: DataFrame, order: list[Column], sums: dict[str, str], name: str) -> DataFrame:
    """``rows`` with a column for each of ``sums``: an expression's sum over the rows that come before in ``order``.

    Sums inside range partitions, and of the partitions ahead: no task sees all rows.
    """
    mid, pid = unused(rows.columns, "_mid", "_pid")
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(mid, F.monotonically_increasing_id())
    table = stored(dealt.withColumn(pid, F.shiftright(mid, 33)), name)
    inner = f"over (partition by {pid} order by {mid} rows between unbounded preceding and 1 preceding)"
    local = table.selectExpr("*", *(f"coalesce(sum({e}) {inner}, 0) as {k}" for k, e in sums.items()))
    parts = table.groupBy(pid).agg(*(F.sum(F.expr(e)).alias(f"_of_{k}") for k, e in sums.items()))
    ahead = f"over (order by {pid} rows between unbounded preceding and 1 preceding)"  # a row a partition
    bases = parts.selectExpr(pid, *(f"coalesce(sum(_of_{k}) {ahead}, 0) as _to_{k}" for k in sums))
    return local.join(bases, pid).select(*rows.columns, *(F.expr(f"{k} + _to_{k}").alias(k) for k in sums))


def new_pipeline_folder(spark: SparkSession) -> str:
    """A folder for the results of stages, not a scratch folder."""
    return f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex[:12]}"

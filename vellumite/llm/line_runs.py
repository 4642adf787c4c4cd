"""Operator 12 - line dedup over levelled, sorted runs of line hashes.

A line's key is the line without whitespace at both ends, A-Z lower-cased. Keys
of at least ``LEAST_POINTS`` code points that at least ``LEAST_DOCS`` documents
hold lose all their lines, except in the document with the largest id among them.

The documents come in batches, those with the largest ids first. Each batch is
summed up by key hash (128 bits) and merged with the runs written so far. Keys
that are settled there - in enough documents, with a larger id - are left out
(the anti-join); the others go into a new sorted run. ``FANOUT`` runs of a level
are compacted to one of the next. Runs are bucketed and sorted by hash in files,
so a batch moves its own lines only and merges with all runs in one stage.
:class:`Runs` takes batches in any order; largest ids first settles keys soonest.

A key held by many documents is summed up before it is moved. What the documents
lose is found by joining their keys with the decisions: of keys that hold more
than 1 / ``HOT`` of all pairs in some batch there are at most ``HOT`` a batch,
these are broadcast; the rest have small groups. Texts move once, to their list.

Defined results: each row is a document, also when ids repeat; all rows with the
largest id keep the line. A null id is smaller than any other. A null or empty
text is one empty line. Repeated lines in a document count once and go together.
An empty table gives no rows. Extra columns are kept; columns named n_lines,
n_dropped or kept_text are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

LEAST_POINTS, LEAST_DOCS = 20, 3
BATCHES, FANOUT = 5, 3
HOT = 1000
BLANK = b" \t\n\x0b\x0c\r"
NO_ID = -(1 << 63)


def line_hashes(text: bytes, least: int = LEAST_POINTS) -> list[bytes | None]:
    """For each line of ``text`` its key's hash, or None where the key is too short."""
    out = []
    for line in text.split(b"\n"):
        key = line.strip(BLANK)
        # a code point has one to four bytes
        long = len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)
        out.append(xxhash.xxh3_128_digest(key.lower()) if long else None)
    return out


class Runs:
    """Levelled sorted runs of (h, n, last): how many documents hold a key, and the largest id of them."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, least: int = LEAST_DOCS):
        self.spark, self.fanout, self.least = spark, fanout, least
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.paths: dict[str, str] = {}

    def write(self, rows: DataFrame) -> str:
        """A run: ``rows`` (h, n, last), one a key, bucketed and sorted by h."""
        name = f"line_run_{uuid.uuid4().hex[:12]}"
        self.paths[name] = common.new_folder(self.spark, name)
        rows.write.bucketBy(self.buckets, "h").sortBy("h").option("path", self.paths[name]).saveAsTable(name)
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def merged(self, names: list[str]) -> DataFrame:
        # read as plain files: a union of bucketed tables is grouped wrongly by Spark 4.1, which takes it for dealt by h and reads it otherwise
        rows = self.spark.read.schema("h binary, n long, last long").parquet(*(self.paths[name] for name in names))
        return rows.groupBy("h").agg(F.sum("n").alias("n"), F.max("last").alias("last"))

    def add(self, pairs: DataFrame, heavy: int) -> None:
        """Take a batch of (id, h), each pair once a document. Settled keys are left out unless more than ``heavy`` documents of the batch hold them."""
        batch = pairs.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))
        seen, newest = F.lit(0), F.lit(NO_ID)
        for i, run in enumerate(self.runs()):
            batch = batch.join(run.toDF("h", f"n_{i}", f"last_{i}"), "h", "left")
            seen, newest = seen + F.coalesce(f"n_{i}", F.lit(0)), F.greatest(newest, f"last_{i}")
        settled = (seen >= self.least) & (newest >= F.col("last")) & (F.col("n") <= heavy)
        self.levels[0].append(self.write(batch.where(~settled).select("h", "n", "last")))
        self.compact()

    def compact(self) -> None:
        """Merge the runs of a level that is full into one of the next."""
        for i in range(len(self.levels)):
            if len(self.levels[i]) >= self.fanout:
                if i + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[i + 1].append(self.write(self.merged(self.levels[i])))
                self.drop(self.levels[i])
                self.levels[i] = []

    def drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"drop table {name}")

    def decisions(self) -> DataFrame:
        """(h, n, last) of the keys in enough documents, as a table; the runs go. ``n`` may be less than all, never below the least."""
        names = [name for level in self.levels for name in level]
        out = common.stored(self.merged(names).where(F.col("n") >= self.least), "repeated_lines")
        self.drop(names)
        return out


def line_pairs(docs: DataFrame, batch: str, id_col: str, text_col: str, least: int) -> DataFrame:
    """(batch, id, h): the hash of each long key of each document, once a document. ``batch`` is an SQL expression over ``id``."""
    kept = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text")).selectExpr(f"{batch} as batch", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = [list({h for h in line_hashes(text, least) if h}) for text in common.byte_texts(rows, "text")]
            counts = pa.array([len(f) for f in found], pa.int32())
            at = pa.array([i for i, n in enumerate(counts.to_pylist()) for _ in range(n)], pa.int32())
            yield pa.record_batch({"batch": rows.column(0).take(at), "id": rows.column(1).take(at), "h": pa.array([h for f in found for h in f], pa.binary())})

    return kept.mapInArrow(run, "batch int, id long, h binary")


def lost_lines(docs: DataFrame, id_col: str, text_col: str, least_points: int, least_docs: int, batches: int) -> DataFrame:
    """(id, gone): the hashes of the lines that the rows with that id lose."""
    spark = docs.sparkSession
    ids = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"))
    cuts = ids.agg(F.percentile_approx("id", [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    batch = " + ".join(["0", *(f"cast(id <= {c} as int)" for c in sorted(set(cuts)) if c > NO_ID)])
    path = common.new_folder(spark, "line_pairs")
    line_pairs(docs, batch, id_col, text_col, least_points).write.partitionBy("batch").parquet(path)
    pairs = spark.read.schema("id long, h binary, batch int").parquet(path)
    heavy = max(LEAST_DOCS, pairs.count() // (HOT * batches))
    runs = Runs(spark, least=least_docs)
    for b in range(len(set(cuts)) + 1):  # batch 0 holds the largest ids
        runs.add(pairs.where(F.col("batch") == b).select("id", "h"), heavy)
    repeated = runs.decisions()
    # a key above heavy in a batch is recorded in full there, so all such keys are found; there are at most HOT * batches of them a batch
    hot = F.broadcast(repeated.where(F.col("n") > heavy).select("h", "last"))
    cold = repeated.where(F.col("n") <= heavy).select("h", "last")
    lost = pairs.join(hot, "h").unionByName(pairs.join(hot, "h", "left_anti").join(cold, "h")).where("id < last")
    return lost.groupBy("id").agg(F.collect_set("h").alias("gone"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_points: int = LEAST_POINTS, least_docs: int = LEAST_DOCS, batches: int = BATCHES) -> DataFrame:
    """``docs`` with n_lines (before), n_dropped, and kept_text (bytes, the lines that stay joined by a line feed)."""
    docs = docs.drop("n_lines", "n_dropped", "kept_text")
    key, gone = common.unused(docs.columns, "_id", "_gone")
    lost = lost_lines(docs, id_col, text_col, least_points, least_docs, batches).toDF(key, gone)
    rows = docs.withColumn(key, F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))).join(lost, key, "left").drop(key)
    schema = T.StructType([*rows.drop(gone).schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_text", T.BinaryType())])

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            lines, dropped, kept = [], [], []
            at = batch.schema.get_field_index(gone)
            for text, drops in zip(common.byte_texts(batch, text_col), batch.column(at).to_pylist(), strict=True):
                own = text.split(b"\n")
                if drops:
                    drops = set(drops)
                    stay = [line for line, h in zip(own, line_hashes(text, least_points), strict=True) if h not in drops]
                else:
                    stay = own
                lines.append(len(own))
                dropped.append(len(own) - len(stay))
                kept.append(b"\n".join(stay) if drops else text)
            columns = [batch.column(i) for i in range(batch.num_columns) if i != at]
            names = [n for n in batch.schema.names if n != gone]
            added = [pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, *added], [*names, "n_lines", "n_dropped", "kept_text"])

    return rows.mapInArrow(run, schema)


def op12_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return drop_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
with lines as (
  select d.doc_id, l.line, l.place, translate(trim(l.line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from documents d, unnest(string_split(coalesce(d.text, ''), chr(10))) with ordinality as l(line, place)
), repeated as (
  select key, max(doc_id) as last from lines where length(key) >= 20 group by key having count(distinct doc_id) >= 3
), judged as (
  select l.*, coalesce(l.doc_id < r.last, false) as gone from lines l left join repeated r using (key)
)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by place) filter (where not gone), '')) as kept_sha256
from judged group by doc_id
"""

QUERIES = {"op12_line_runs": op12_line_runs}
ORACLES = {"op12_line_runs": SQL}

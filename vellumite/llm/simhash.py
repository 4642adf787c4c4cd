"""Operator 7 - SimHash near-duplicates found through Golay-code fuzzy keys.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each padded to
23 and read as a word of the perfect binary Golay code, in which every 23-bit
word is within 3 errors of exactly one of 4,096 codewords. The *fuzzy keys* of
a word are the codewords that it and its 23 neighbours decode to: one key when
the word is within 2 errors of its codeword, six otherwise. Two words at
distance 2 or less share a word at distance 1 or less from both, hence a fuzzy
key. Two fingerprints at distance 2 or less have, by pigeonhole, a segment
without errors, and the next segment has at most 2; so (exact segment, fuzzy
key of the next one) is a key which finds every such pair.

Buckets of up to ``BUCKET`` fingerprints are compared pairwise. The members of
larger ones are linked without pairs and just as exactly: each names its 65
midpoints (itself and each one-bit change); those that share a midpoint are
within 2 bits of each other, and each is linked to the midpoint's smallest.

Rows with null texts count as empty; an empty text has fingerprint zero and is
linked like any other. Repeated rows and repeated ids stay separate rows, with
the same fingerprint and component; a component whose ids are all null has a
null id. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import connected_components

BUCKET = 24
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # (first bit, bits)
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, of the (23, 12) Golay code
N = 23


def fingerprint(words: list[bytes], shingle: int) -> int:
    """SimHash over the XXH64 (seed 42) of word shingles, repeats included."""
    import xxhash

    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    ones, total, hashes = np.zeros(64, np.int64), 0, []
    for gram in grams:
        hashes.append(digest(gram, 42))
        if len(hashes) == 1 << 16:
            ones += count_bits(hashes)
            total += len(hashes)
            hashes.clear()
    ones += count_bits(hashes) if hashes else 0
    total += len(hashes)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def count_bits(hashes: list[int]) -> np.ndarray:
    return np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def fingerprints(docs: DataFrame, *, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long, of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                fps = np.array([fingerprint(t.lower().split(), shingle) for t in common.byte_texts(part, "text")], np.uint64)
                yield pa.record_batch({"doc_id": part.column(0), "fp": pa.array(fps.view(np.int64))})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


class Golay:
    """The perfect binary (23, 12) Golay code: nearest codeword of every 23-bit word, by syndrome."""

    def __init__(self) -> None:
        patterns = [0] + [1 << i for i in range(N)]
        patterns += [1 << i | 1 << j for i in range(N) for j in range(i)]
        patterns += [1 << i | 1 << j | 1 << k for i in range(N) for j in range(i) for k in range(j)]
        errors = np.array(patterns, np.int64)
        self.error = np.zeros(1 << 11, np.int64)
        self.error[self.syndrome(errors)] = errors  # each of the 2,048 syndromes has one pattern

    @staticmethod
    def syndrome(words: np.ndarray) -> np.ndarray:
        words = words.copy()
        for bit in range(N - 1, 10, -1):
            words ^= ((words >> bit) & 1) * (GENERATOR << (bit - 11))
        return words

    def index(self, words: np.ndarray) -> np.ndarray:
        """12-bit index of the codeword nearest to each word."""
        return (words ^ self.error[self.syndrome(words)]) >> 11

    def fuzzy(self, words: np.ndarray) -> np.ndarray:
        """(n, 24) codeword indices of each word and its neighbours; repeats included."""
        near = words[:, None] ^ np.array([0] + [1 << i for i in range(N)], np.int64)[None, :]
        return self.index(near)


def fuzzy_keys(fps: DataFrame, bits: int) -> DataFrame:
    """(key, fp): the keys of each distinct fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            parts = [((fp >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
            keys, owners = [], []
            for i, part in enumerate(parts):
                near = np.sort(golay.fuzzy(parts[(i + 1) % 3]), axis=1)
                fresh = np.concatenate([np.ones((len(near), 1), bool), near[:, 1:] != near[:, :-1]], axis=1)
                row, col = np.nonzero(fresh)
                keys.append((np.int64(i) << 40) | (part[row] << 12) | near[row, col])
                owners.append(fp[row])
            yield pa.record_batch({"key": pa.array(np.concatenate(keys)), "fp": pa.array(np.concatenate(owners).view(np.int64))})

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def links(fps: DataFrame, *, bits: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b), a < b, that connect just those fingerprints which chains of ``bits`` or fewer differing bits do.

    ``fps`` holds distinct fingerprints in a column ``fp``. Every pair within
    ``bits`` is linked, directly or over the smallest one at a shared midpoint.
    """
    if bits != 2:
        raise ValueError("the keys are made for 2 bits")
    keys = common.stored(fuzzy_keys(fps, bits), "golay_keys")
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = common.stored(sizes, "golay_buckets")
    few = keys.join(sizes.where(F.col("n") <= bucket).select("key"), "key")
    few = common.stored(few, "golay_small")
    pairs = few.selectExpr("key", "fp as a").join(few.selectExpr("key", "fp as b"), "key").where("a < b and bit_count(a ^ b) <= 2").select("a", "b").distinct()
    many = keys.join(sizes.where(F.col("n") > bucket).select("key"), "key", "left_semi").select("fp").distinct()
    points = many.select("fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")).alias("point"))
    points = common.stored(points, "midpoints")
    least = points.groupBy("point").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("point", "a")
    starred = points.join(least, "point").where("a < fp").select("a", F.col("fp").alias("b")).distinct()
    return pairs.unionByName(starred).distinct()


def near_duplicates(docs: DataFrame, *, shingle: int = 3, bits: int = 2, bucket: int = BUCKET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable), n_rows of the component."""
    marked = common.stored(fingerprints(docs, shingle=shingle, id_col=id_col, text_col=text_col), "fingerprints")
    distinct = common.stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")), "distinct_fps")
    edges = links(distinct, bits=bits, bucket=bucket)
    roots = connected_components(edges)  # node, root
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    classes = named.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("rows").alias("component_rows"))
    labels = common.stored(named.select("fp", "root").join(classes, "root").select("fp", "component_id", "component_rows"), "fp_components")
    return marked.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_rows")


def op7_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read_table(spark, sf_dir, "documents"), shingle=3, bits=2)


QUERIES = {"op7_simhash_golay": op7_simhash_golay}
ORACLES: dict[str, str] = {}

"""Operator 11 - importance resampling towards a target: a byte automaton over Arrow buffers.

Words and their hashes are found without a Python string: a lookup table gives
the class of every byte of a column's UTF-8 buffer, differences of the classes
are the words' borders, and one table-driven CRC-32 step advances all words that
are still long enough at once, longest first. A run of words goes on from the
state of the run one word shorter. Buffers are worked through in pieces of
``PIECE`` bytes, so a text of any length takes little memory.

The CRC modulo ``BUCKETS`` is a feature's bucket. Every task sums its buckets up,
so ``BUCKETS`` numbers a table reach the driver. A bucket's gain is the log ratio
of its share among the target's features and among all documents', in
thousandths; a document's weight is the sum of its features' gains; Gumbel noise
from a hash of its id turns the top weights into a draw without replacement.
Scores above a quantile that is sure to lie below the draw are ranked by range
partitions; the rest are never sorted.

Defined results: null texts have no words. Each row is drawn or not, also when
ids repeat; ties go to the smaller id, null last, then to the text with the
smaller hash. A null id's noise is that of an empty one. With no target the gains follow from the
documents alone. An empty table gives no rows. Extra columns are kept by
:func:`resampled`; those named n_features, n_words, weight, score, rank are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BUCKETS = 10_000
PERCENT, LEAST_WORDS, SEED = 10, 20, 2024
PIECE = 4 << 20
LONG = 64  # words of more bytes are hashed one by one

#: Bytes of words once A-Z is lower-cased: digits, letters, and all of a character beyond ASCII.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
IN_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in LOWER], bool)


def crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC = crc_table()
FRESH = np.uint32(0xFFFFFFFF)


def borders(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of ``data``; no word goes across one of ``offsets``, where rows begin."""
    inside = IN_WORD[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    before[cuts], after[cuts - 1] = False, False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def advance(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC states after the bytes from ``starts`` to ``ends``, one a word; ``data`` is lower-cased."""
    lengths = ends - starts
    state = state.copy()
    for i in np.flatnonzero(lengths > LONG):
        state[i] = FRESH ^ np.uint32(crc32(data[starts[i] : ends[i]], int(state[i] ^ FRESH)))
    order = np.argsort(-lengths, kind="stable")
    order = order[np.searchsorted(-lengths[order], -LONG) :]
    ordered, at, now = lengths[order], starts[order], state[order]
    for step in range(ordered[0] if len(ordered) else 0):
        n = np.searchsorted(-ordered, -step)  # words longer than step
        head = now[:n]
        now[:n] = CRC[(head ^ data[at[:n] + step]) & 0xFF] ^ (head >> np.uint32(8))
    state[order] = now
    return state


def pieces(data: np.ndarray, offsets: np.ndarray, piece: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of ``data`` of about ``piece`` bytes that cut no word."""
    at, total = 0, len(data)
    while at < total:
        end = min(at + piece, total)
        row = int(offsets[np.searchsorted(offsets, end)]) if end < total else total
        while end < row and IN_WORD[data[end]]:
            stop = min(end + 65536, row)
            gaps = np.flatnonzero(~IN_WORD[data[end:stop]])
            end = end + int(gaps[0]) if len(gaps) else stop
            if len(gaps):
                break
        yield at, end
        at = end


def feature_hashes(column: pa.Array, longest: int = 1, piece: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of features, their CRCs, rows of words) of a text column, piece by piece: all runs of 1 to ``longest`` words of a row, joined by one space."""
    texts = pc.cast(column, pa.large_binary())
    texts = pc.fill_null(texts, b"") if texts.null_count else texts
    if not len(texts):
        return
    _, ends, buffer = texts.buffers()
    offsets = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    tail: list[tuple[bytes, int]] = []  # the last words, for runs that go on in the next piece
    for start, end in pieces(data, offsets, piece):
        own = LOWER[data[start:end]]
        inner = offsets[np.searchsorted(offsets, start) : np.searchsorted(offsets, end)] - start
        begin, stop = borders(own, inner)
        rows = np.searchsorted(offsets, begin + start, "right") - 1
        if longest == 1:
            yield rows, advance(np.full(len(begin), FRESH), own, begin, stop) ^ FRESH, rows
            continue
        # the words carried over stand in front, each behind a gap
        front = b"".join(w + b" " for w, _ in tail)
        sizes = np.array([len(w) for w, _ in tail], np.int64)
        heads = np.cumsum(sizes + 1) - sizes - 1
        own = np.concatenate([np.frombuffer(front, np.uint8), own])
        begin = np.concatenate([heads, begin + len(front)]).astype(np.int64)
        stop = np.concatenate([heads + sizes, stop + len(front)]).astype(np.int64)
        rows = np.concatenate([np.array([r for _, r in tail], np.int64), rows]).astype(np.int64)
        new, found = len(tail), []
        state = advance(np.full(len(begin), FRESH), own, begin, stop)
        for k in range(1, longest + 1):
            if k > 1:  # the run that ends at the word before, a space, this word
                state = np.concatenate([state[:1], state[:-1]])
                state = advance(CRC[(state ^ np.uint32(32)) & 0xFF] ^ (state >> np.uint32(8)), own, begin, stop)
            ok = np.arange(len(rows)) >= max(new, k - 1)
            ok[k - 1 :] &= rows[k - 1 :] == rows[: len(rows) - k + 1]
            found.append((rows[ok], state[ok] ^ FRESH))
        yield np.concatenate([r for r, _ in found]), np.concatenate([c for _, c in found]), rows[new:]
        tail = [(own[b:e].tobytes(), int(r)) for b, e, r in zip(begin[-longest + 1 :], stop[-longest + 1 :], rows[-longest + 1 :], strict=True)]


def bucket_counts(texts: DataFrame, text_col: str, buckets: int = BUCKETS, longest: int = 1) -> DataFrame:
    """(bucket, n): features in each bucket, summed up in the tasks first. At most ``buckets`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, crcs, _ in feature_hashes(batch.column(0), longest):
                sums += np.bincount(crcs % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(sums)
        yield pa.record_batch({"bucket": pa.array(at, pa.int32()), "n": pa.array(sums[at], pa.int64())})

    return texts.select(F.col(text_col).cast("string")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the target's and the documents' smoothed shares of each bucket, rounded down."""
    n = len(docs)
    to, of = float(target.sum()) + n, float(docs.sum()) + n
    return np.array([np.floor(1000 * log((t + 1) * of / ((s + 1) * to))) for s, t in zip(docs.astype(float).tolist(), target.astype(float).tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, text_col: str, gain: np.ndarray, longest: int = 1) -> DataFrame:
    """``docs`` with n_words, n_features and weight, the sum of its features' gains."""
    docs = docs.drop("n_words", "n_features", "weight")
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight"))])
    buckets = np.uint32(len(gain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.zeros((3, batch.num_rows), np.int64)
            for rows, crcs, words in feature_hashes(batch.column(batch.schema.get_field_index(text_col)), longest):
                for i, (at, value) in enumerate(((words, None), (rows, None), (rows, gain[crcs % buckets]))):
                    if len(at):  # of one piece; its sums are exact in doubles
                        low = int(at.min())
                        part = np.bincount(at - low, weights=value)
                        sums[i, low : low + len(part)] += part.astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(s) for s in sums)], schema=pa.schema([*batch.schema, *((n, pa.int64()) for n in ("n_words", "n_features", "weight"))]))

    return docs.mapInArrow(run, schema)


def noise(id_col: str, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from the first 32 bits of a hash of the id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(scored: DataFrame, eligible: str, ties: list[str], percent: int) -> DataFrame:
    """``scored`` with ``rank`` (1, 2, ...) of the ``percent`` of the eligible rows with the highest scores; null for others."""
    most, = common.unused(scored.columns, "_most")
    # sketches of percentiles are off by 1 / 1000 of the rows at most, so the cut lies below the draw
    found = scored.where(eligible).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("score", max(0.0, 1 - percent / 100 - 0.01), 1000).alias("cut")).first()
    drawn = percent * found["n"] // 100
    high = F.coalesce(F.expr(eligible) & (F.col("score") >= F.lit(found["cut"]).cast("long")), F.lit(False))
    if scored.where(high).count() < drawn:
        high = F.coalesce(F.expr(eligible), F.lit(False))
    by = [F.desc("score"), *(F.asc_nulls_last(t) for t in ties)]
    above = common.with_position(scored.where(high).repartitionByRange(*by).sortWithinPartitions(*by), "drawn").withColumn(most, F.col("position") + 1)
    above = above.withColumn("rank", F.when(F.col(most) <= drawn, F.col(most))).drop(most, "position")
    return above.unionByName(scored.where(~high).withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", longest: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """``docs`` with n_words, n_features, weight, score and rank; rank is null for those that are not drawn.

    Draws ``percent`` of the documents with at least ``least_words`` words.
    """
    docs = docs.drop("score", "rank", "position")
    counts = []
    for table, column in ((docs, text_col), (target, target_col)):
        sums = np.zeros(buckets, np.int64)
        for r in bucket_counts(table, column, buckets, longest).collect():  # at most ``buckets`` rows
            sums[r["bucket"]] = r["n"]
        counts.append(sums)
    tie, = common.unused(docs.columns, "_tie")
    scored = weighed(docs, text_col, gains(*counts), longest).withColumn("score", F.col("weight") + noise(id_col, seed)).withColumn(tie, F.xxhash64(text_col))
    scored = common.stored(scored, "scored")
    return ranked(scored, f"n_words >= {least_words}", [id_col, tie], percent).drop(tie)


def op11_byte_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return resampled(docs, common.read_table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


SQL = r"""
with steps as (
  select list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, 3988292384 * (c & 1)))) as crc
), own as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents
), wanted as (
  select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark
), words as (
  select doc_id, unnest(ws) as w from own
), targets as (
  select unnest(ws) as w from wanted
), digits as (
  select w, hex(encode(w)) as h from (select w from words union select w from targets)
), hashed as (
  select w, list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: ((instr('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 1)::bigint)),
    lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])) as c from digits, steps
), buckets as (
  select w, xor(c, 4294967295) % 10000 as bucket from hashed
), s as (
  select bucket, count(*)::double as n from words join buckets using (w) group by bucket
), t as (
  select bucket, count(*)::double as n from targets join buckets using (w) group by bucket
), gains as (
  select b.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1) * ((select coalesce(sum(n), 0) from s) + 10000) / ((coalesce(s.n, 0) + 1) * ((select coalesce(sum(n), 0) from t) + 10000))))::bigint as gain
  from (select distinct bucket from buckets) b left join s using (bucket) left join t using (bucket)
), sums as (
  select doc_id, sum(gain)::bigint as weight from words join buckets using (w) join gains using (bucket) group by doc_id
), scored as (
  select doc_id, len(ws)::bigint as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::bigint + 0.5::double) / 4294967296)))::bigint as score
  from own left join sums using (doc_id)
), placed as (
  select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () as n from scored where n_features >= 20
)
select doc_id, n_features, weight, score, case when rank <= 10 * n // 100 then rank end as rank from scored left join placed using (doc_id)
"""

QUERIES = {"op11_byte_automaton": op11_byte_automaton}
ORACLES = {"op11_byte_automaton": SQL}

"""Operator 4 - benchmark decontamination by latent semantic retrieval.

1. Benchmark items are cut into segments of up to ``SEGMENT`` words. Their words
   are the terms. Texts are read once: each is stored as the numbers of its terms.
   Document frequencies of the terms come from all documents.
2. Passages are windows of ``WINDOW`` words, ``STEP`` apart, over whole texts, so
   each segment's copy lies in one of them.
3. A randomised SVD of the TF-IDF matrix of passages and segments (Halko,
   Martinsson and Tropp 2011, with power iterations) gives the latent space, of
   a sixth as many dimensions as there are segments, between ``RANK``'s two. Each
   multiplication with the matrix is a Spark job; only term-by-rank matrices
   reach the driver. The space is fitted on all passages, and all are searched.
4. Every passage is a candidate for each segment with which its cosine in the
   latent space reaches ``COSINE``. A passage that holds ``COVER`` of a segment's
   words is one whatever its cosine, so no copy is lost by the rank of the space.
   A candidate is a leak if the longest common subsequence covers ``COVER`` of the
   segment's words, or ``PARAPHRASE`` of them and the answer (what follows the last
   question mark or "answer:", else the last sentence) is there as well.

The items are the query set and are handled in blocks of ``ITEM_BLOCK`` words at
most, ``BLOCKS`` of them with each reading of the texts, so what is sent to the
tasks has a fixed bound whatever the benchmark's size; an item above it is cut
into blocks at its segments. Null texts are empty and have no passages; empty
items match nothing. Repeated rows are reported each, repeated items by their own
id, null ids as null. An empty table, either one, gives no rows. Extra columns are
not read.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SEGMENT, STEP, WINDOW = 32, 32, 64
RANK, EXTRA, POWER = (48, 128), 16, 1
COSINE, COVER, PARAPHRASE, ANSWER = 0.2, 0.7, 0.5, 0.8
ITEM_BLOCK, BLOCKS = 16_000, 8  # words of a block of items, and blocks for one reading of the texts
CHUNK = 1 << 16  # words of a long text that a task handles together
NEAR = 1 << 13  # words of short texts, so few that their tables stay in the processor's cache
GRAM = 1 << 12  # and in a step of the fit
SLAB = 512
OUTER = b".,;:!?\"'()[]"


class Terms(dict):
    """Term number of a raw token (-1: none), kept for up to ``LIMIT`` tokens."""

    LIMIT = 400_000

    def __init__(self, terms: dict[bytes, int]):
        super().__init__()
        self.terms = terms

    def __missing__(self, token: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[token] = found = self.terms.get(token.strip(OUTER), -1)
        return found

    def numbers(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.int32, len(tokens))


def cut_words(text: str | None) -> list[bytes]:
    return [w for t in (text or "").encode().lower().split() if (w := t.strip(OUTER))]


def answer_words(text: str | None) -> list[bytes]:
    """What follows the last question mark or "answer:"; else the last sentence."""
    text = (text or "").rstrip()
    asked = re.split(r"\?|(?i:answer\s*:)", text)
    tail = asked[-1] if len(asked) > 1 and cut_words(asked[-1]) else re.split(r"[.!?\n]+\s*", text.rstrip(".!?\n "))[-1]
    return cut_words(tail)


def places_of(words: list) -> dict:
    """For each word the set of its places, a bit each."""
    places: dict = {}
    for i, w in enumerate(words):
        places[w] = places.get(w, 0) | 1 << i
    return places


def common_length(words: list, places: dict, size: int) -> int:
    """Length of the longest common subsequence of ``words`` and ``size`` words in their ``places``: a few operations for each word that both have (Hyyro 2004)."""
    full = row = (1 << size) - 1
    get = places.get
    for w in words:
        if (hit := get(w)) and (hit := hit & row):
            row = ((row + hit) | (row - hit)) & full
    return size - row.bit_count()


def lcs(a: list, b: list) -> int:
    return common_length(a, places_of(b), len(b))


def segments_of(item: int, text: str | None) -> list[tuple[int, list[bytes], list[bytes]]]:
    """An item's segments: its id, the segment's words, the answer's words."""
    words, answer = cut_words(text), answer_words(text)
    n = max(1, round(len(words) / SEGMENT + 0.49)) if words else 0
    parts = (words[k * len(words) // n : (k + 1) * len(words) // n] for k in range(n))
    return [(item, part, answer) for part in parts if part]


class Block:
    """A block of items: segments, answers, and their terms by number, which are their places in ``words``."""

    def __init__(self, segments: list[tuple[int, list[bytes], list[bytes]]]):
        self.words = sorted({w for _, part, answer in segments for w in (*part, *answer)})
        self.terms = {w: i for i, w in enumerate(self.words)}
        of = lambda words: [self.terms[w] for w in words]
        self.segments = [(item, of(part), of(answer)) for item, part, answer in segments]
        self.places = [(places_of(part), len(part), places_of(answer), len(answer)) for _, part, answer in self.segments]
        sizes = np.array([len(part) for _, part, _ in self.segments])
        self.need_cover, self.need_part = (np.ceil(share * sizes - 1e-9).astype(np.uint8) for share in (COVER, PARAPHRASE))
        # how often each term is in each segment, eight segments to a number: no sum exceeds a segment's words, so none runs over
        times = np.zeros((len(self.words), -(-len(self.segments) // 8) * 8), np.uint8)
        for j, (_, part, _) in enumerate(self.segments):
            np.add.at(times[:, j], part, 1)
        self.times = times.view(np.uint64)

    def weigh(self, df: np.ndarray, total: int) -> None:
        self.idf = np.log((1 + total) / (1 + df)).astype(np.float32) + np.float32(0.1)

    def rank(self) -> int:
        return min(max(len(self.segments) // 6, RANK[0]), RANK[1], len(self.words))


def code(docs: DataFrame, terms) -> DataFrame:
    """(doc_id, ids): each text as the numbers of its terms (-1: none), of :func:`number_kind`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, kind = Terms(terms.value), number_kind(len(terms.value))
        for batch in batches:
            out = [known.numbers(text.lower().split()).astype(kind).tobytes() for text in common.byte_texts(batch, "text")]
            yield pa.record_batch({"doc_id": batch.column(0), "ids": pa.array(out, pa.binary())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def number_kind(terms: int) -> type:
    """The shortest integers that number so many terms."""
    return np.int16 if terms < 1 << 15 else np.int32


def windows_of(words: int) -> int:
    return max(1, -(-(words - STEP) // STEP)) if words else 0


def frequencies(coded: DataFrame, terms: int) -> DataFrame:
    """(term, n): texts that hold each term; -1 counts the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, kind = 0, number_kind(terms)
        df = np.zeros(terms, np.int64)
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                ids = np.frombuffer(packed, kind)
                used = np.unique(ids)
                df[used[used >= 0]] += 1
                total += 1
        used = np.nonzero(df)[0]
        yield pa.record_batch({"term": pa.array([-1, *used.tolist()], pa.int64()), "n": pa.array([total, *df[used].tolist()], pa.int64())})

    return coded.select("ids").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def pieces(ids: np.ndarray, words: int = CHUNK) -> Iterator[tuple[int, np.ndarray]]:
    """(first word, part): a very long text goes in parts that share a step, so no window is cut."""
    for lo in range(0, max(len(ids) - STEP, 1), words):
        yield lo, ids[lo : lo + words + STEP]


def cells_of(texts: list[np.ndarray], terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(window, term, times), by window and term, of all windows of ``texts`` (term numbers, -1: none); and how many windows each text has."""
    windows = np.array([windows_of(len(t)) for t in texts], np.int64)
    first = np.cumsum([0, *windows])
    sizes = np.array([len(t) for t in texts], np.int64)
    ids = np.concatenate([*texts, np.zeros(0, np.int64)])
    at = np.nonzero(ids >= 0)[0]
    text = np.repeat(np.arange(len(texts)), sizes)[at]
    step = (at - (np.cumsum(sizes) - sizes)[text]) // STEP
    term = ids[at].astype(np.int64)
    # each place lies in the window of its step and in the one before
    one, two = step < windows[text], step > 0
    cells = np.concatenate([(first[text] + step)[one] * terms + term[one], (first[text] + step - 1)[two] * terms + term[two]])
    cells, tf = np.unique(cells, return_counts=True)
    return cells // terms, cells % terms, tf, windows


def gram_times(coded: DataFrame, block, columns, basis: np.ndarray) -> np.ndarray:
    """(A^T A) basis for the TF-IDF matrix A of all passages and the block's segments: one job, summed by slabs of terms."""
    shared = coded.sparkSession.sparkContext.broadcast(basis)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        b, own, basis = block.value, columns.value, shared.value
        total, kind = np.zeros(basis.shape, np.float64), number_kind(len(own) - 1)
        texts, size = [], 0
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                for _, part in pieces(own[np.frombuffer(packed, kind)], GRAM):
                    texts.append(part)
                    size += len(part)
                    if size > GRAM:
                        add_gram(total, texts, b.idf, basis)
                        texts, size = [], 0
        add_gram(total, texts, b.idf, basis)
        pid = TaskContext.get().partitionId()
        slabs = range(0, len(total), SLAB)
        yield pa.record_batch({"part": pa.array([pid % 32] * len(slabs), pa.int32()), "slab": pa.array(slabs, pa.int32()), "sums": pa.array([total[i : i + SLAB].tobytes() for i in slabs], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, np.float64) for b in table.column("sums").to_pylist())
        return pa.table({"part": table.column("part")[:1], "slab": table.column("slab")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    schema = "part int, slab int, sums binary"
    sums = coded.select("ids").mapInArrow(run, schema).groupBy("part", "slab").applyInArrow(add, schema).groupBy("slab").applyInArrow(add, schema)
    out = np.zeros(basis.shape, np.float64)
    for r in sums.collect():  # terms x rank numbers
        part = np.frombuffer(r.sums, np.float64).reshape(-1, basis.shape[1])
        out[r.slab : r.slab + len(part)] = part
    parts = [np.array(part, np.int32) for _, part, _ in block.value.segments]
    for i in range(0, len(parts), 128):
        add_gram(out, parts[i : i + 128], block.value.idf, basis)
    return out


def run_starts(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers begins."""
    return np.nonzero(np.diff(ordered, prepend=ordered[:1] - 1))[0]


def add_gram(total: np.ndarray, texts: list[np.ndarray], idf: np.ndarray, basis: np.ndarray) -> None:
    """Add (A^T A) ``basis`` to ``total`` for the windows of ``texts``."""
    window, term, tf, _ = cells_of(texts, len(idf))
    if not len(window):
        return
    weight = tf.astype(np.float32) * idf[term]
    starts = run_starts(window)
    sizes = np.diff(starts, append=len(window))
    weight /= np.repeat(np.sqrt(np.add.reduceat(weight * weight, starts)), sizes)
    # a matrix of the terms at hand: some hundred windows at most
    at = np.zeros(len(idf), np.int64)
    at[term] = 1
    used = np.nonzero(at)[0]
    at[used] = np.arange(len(used))
    matrix = np.zeros((len(starts), len(used)), np.float32)
    matrix[np.repeat(np.arange(len(starts)), sizes), at[term]] = weight
    total[used] += matrix.T @ (matrix @ basis[used])


def latent_basis(coded: DataFrame, block, columns) -> np.ndarray:
    """Right singular vectors (terms x rank) of the TF-IDF matrix by randomised SVD."""
    terms, rank = len(block.value.words), block.value.rank()
    width = min(rank + EXTRA, terms)
    q = np.linalg.qr(np.random.default_rng(11).standard_normal((terms, width)))[0]
    for _ in range(POWER):
        q = np.linalg.qr(gram_times(coded, block, columns, q.astype(np.float32)))[0]
    core = gram_times(coded, block, columns, q.astype(np.float32))
    values, vectors = np.linalg.eigh(q.T @ core)
    return (q @ vectors[:, ::-1][:, :rank]).astype(np.float32)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def search(texts: list[np.ndarray], block: Block, weighted: np.ndarray, goal: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
    """(text, window, segment, cosine) of the candidates among all windows of ``texts`` (numbers of the block's terms).

    ``weighted`` is the basis by term weight.
    """
    window, term, tf, windows = cells_of(texts, len(block.words))
    first = np.cumsum([0, *windows])
    if not len(window):
        return
    starts = run_starts(window)
    # words of a segment that a window holds: no common subsequence is longer
    most = np.add.reduceat(block.times[term], starts, axis=0).view(np.uint8)[:, : len(block.segments)]
    enough = most >= block.need_part
    # only windows with enough of some segment's words can be candidates: the others need no place in the latent space
    hit = enough.any(axis=1)
    if not hit.any():
        return
    sizes = np.diff(starts, append=len(window))
    cells, rows, most, enough = np.repeat(hit, sizes), window[starts[hit]], most[hit], enough[hit]
    latent_rows = np.add.reduceat(weighted[term[cells]] * tf[cells][:, None].astype(np.float32), np.cumsum(sizes[hit]) - sizes[hit], axis=0)
    cosines = unit(latent_rows) @ goal.T
    chosen = enough & ((cosines >= COSINE) | (most >= block.need_cover))
    owner = np.repeat(np.arange(len(texts)), windows)
    for i, j in zip(*(a.tolist() for a in np.nonzero(chosen)), strict=True):
        w = int(rows[i])
        yield int(owner[w]), w - int(first[owner[w]]), j, float(cosines[i, j])


LEAK = "doc_id long, item_id long, first long, segment_words int, cosine double, cover double, answer boolean"


def matches(coded: DataFrame, block, columns, basis: np.ndarray) -> DataFrame:
    shared = coded.sparkSession.sparkContext.broadcast(basis)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.bool_()]

    def leaky(docs: list, texts: list[np.ndarray], b: Block, weighted: np.ndarray, goal: np.ndarray) -> pa.RecordBatch:
        out, last = [], None
        for i, w, j, cosine in search(texts, b, weighted, goal):
            segment, size, answer, answer_size = b.places[j]
            if (i, w) != last:
                last, words = (i, w), texts[i][w * STEP : w * STEP + WINDOW]
                words = words[words >= 0].tolist()
            cover = common_length(words, segment, size) / size
            if cover < PARAPHRASE:
                continue
            told = bool(answer) and common_length(words, answer, answer_size) >= ANSWER * answer_size
            if cover >= COVER or told:
                out.append((docs[i], b.segments[j][0], w * STEP, size, cosine, cover, told))
        held = list(zip(*out, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(held, kinds, strict=True)], names=[c.split()[0] for c in LEAK.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, own, basis = block.value, columns.value, shared.value
        weighted = basis * b.idf[:, None]
        goal = unit(np.stack([weighted[part].sum(0) for _, part, _ in b.segments]))
        docs, texts, size, kind = [], [], 0, number_kind(len(own) - 1)
        for batch in batches:
            for doc, packed in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                ids = own[np.frombuffer(packed, kind)]
                for lo, part in pieces(ids):
                    if lo or len(ids) > CHUNK + STEP:
                        if docs:
                            yield leaky(docs, texts, b, weighted, goal)
                            docs, texts, size = [], [], 0
                        yield shifted(leaky([doc], [part], b, weighted, goal), lo)
                    else:
                        docs.append(doc)
                        texts.append(part)
                        size += len(part)
                if size > NEAR:
                    yield leaky(docs, texts, b, weighted, goal)
                    docs, texts, size = [], [], 0
        if docs:
            yield leaky(docs, texts, b, weighted, goal)

    return coded.select("doc_id", "ids").mapInArrow(run, LEAK)


def shifted(found: pa.RecordBatch, by: int) -> pa.RecordBatch:
    """``found`` in a part of a text that begins at word ``by``."""
    at = found.schema.get_field_index("first")
    return found.set_column(at, "first", pa.array(found.column(at).to_numpy() + by, pa.int64()))


def item_blocks(benchmark: DataFrame) -> Iterator[Block]:
    """Segments of all items in blocks of at most ``ITEM_BLOCK`` words, answers included."""
    held, used = [], 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator():
        for segment in segments_of(row.item_id, row.text):
            size = len(segment[1]) + len(segment[2])
            if held and used + size > ITEM_BLOCK:
                yield Block(held)
                held, used = [], 0
            held.append(segment)
            used += size
    if held:
        yield Block(held)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row a leaked passage and segment: doc_id, item_id, first (word), segment_words, cosine, cover, answer."""
    spark, out, blocks = docs.sparkSession, [], item_blocks(benchmark)
    while group := list(itertools.islice(blocks, BLOCKS)):
        terms = {w: i for i, w in enumerate(sorted({w for b in group for w in b.words}))}
        coded = common.stored(code(docs, spark.sparkContext.broadcast(terms)), "coded")
        counts = {r.term: r.n for r in frequencies(coded, len(terms)).collect()}  # a row a term
        df = np.array([counts.get(i, 0) for i in range(len(terms))], np.int64)
        for block in group:
            block.weigh(df[[terms[w] for w in block.words]], counts.get(-1, 0))
            # from the group's numbers to the block's; the last place is that of no term
            columns = np.array([block.terms.get(w, -1) for w in terms] + [-1], np.int32)
            columns, shared = (spark.sparkContext.broadcast(v) for v in (columns, block))
            out.append(matches(coded, shared, columns, latent_basis(coded, shared, columns)))
    return functools.reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], LEAK)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row a document and item: doc_id, item_id, cosine, cover, answer, passages."""
    found = leaks(docs, benchmark)
    return found.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("cover").alias("cover"), F.max("answer").alias("answer"), F.countDistinct("first").alias("passages"))


def op4_latent_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "benchmark"))


QUERIES = {"op4_latent_leaks": op4_latent_leaks}
ORACLES: dict[str, str] = {}

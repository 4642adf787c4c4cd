"""Operator 3 - language-model scoring: the marginal probability of a text over all its subword segmentations.

A text is a sequence of words and one end. Each word is spelled: as pieces of an
existing subword vocabulary up to an end-of-word mark, each piece by its unigram
score. The probability of the spelling is summed over all segmentations by a
forward recursion in log space; single bytes are pieces too, so every word has
one. As no piece crosses a word's end, the forward recursion over the whole text
factors by word exactly, and each distinct word is summed once.

Two more arcs span a whole word in the lattice, and are summed with the others:
one for training words, by their counts, and one for words that the text has
used before, by their share in it so far (``REPEAT``). The share of words that
are left to spelling is the Good-Turing estimate, the share of training tokens
seen once. Counts are kept by class (language, say), as many as there are; a text
is scored by the counts of its own class with a share ``COMMON`` of all classes'.
``spelled_score`` is the sum over spellings alone. All are proper distributions,
so ``score`` is a probability of the text (of that class); the base score is not
one, as it gives each of endless unseen words the same share.

The vocabulary's stored scores are merge ranks, not probabilities, so the
unigram scores are learned from the training words seen once, all of them, as
these are what spelling stands for: first from the pieces into which the
vocabulary cuts them, then by ``EXPECTATIONS`` expectation-maximisation steps over
all segmentations. Counts cover every training text; nothing is capped.

Texts are read twice, once to count and once to score, and never shuffled. The
``HEAD`` commonest words, a fixed number, go to every task, which scores them as it
reads; each text's other words leave as rows, are joined with the counts and the
spellings of all such words, each spelled once, and come back as sums by text.
The commonest word of these rows is rare, so no key is hot.

Null texts are empty (the end alone). Null ids count as training rows; null and
empty classes are one. Repeated rows are scored each. With no training rows all
words are spelled by uniform pieces. Very long texts are scored like others. An
empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FLUSH = 200_000  # distinct words a task holds before it passes on its counts
HEAD = 100_000  # words of a class, the commonest of all, that every task holds
REPEAT = 0.1  # share of words drawn from the text's own words so far
COMMON = 0.02
EXPECTATIONS = 2
END_OF_WORD = b"\n"  # no word holds it
LOW = -1e300
LOG10 = math.log(10)


def byte_pieces(model_path: str) -> dict[bytes, int]:
    """Pieces of a sentencepiece vocabulary as bytes, with their numbers; a leading space marks a word's start."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    found: dict[bytes, int] = {}
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i):
            continue
        piece = bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
        if b" " not in piece[1:]:  # words hold no space but the one in front
            found.setdefault(piece, i)
    found[END_OF_WORD] = found.get(END_OF_WORD, sp.get_piece_size())
    return found


class Lattice:
    """Log scores of pieces, and sums over all segmentations."""

    def __init__(self, scores: dict[bytes, float]):
        self.scores, self.longest = scores, max(map(len, scores))
        self.end = scores[END_OF_WORD]

    def forward(self, text: bytes, alpha: list[float], start: int = 1) -> list[float]:
        """Extend ``alpha`` (log sums over segmentations of each prefix) from ``start`` to the end of ``text``."""
        get, longest, exp, log = self.scores.get, self.longest, math.exp, math.log
        for j in range(start, len(text) + 1):
            arcs = [alpha[i] + s for i in range(j - longest if j > longest else 0, j) if (s := get(text[i:j])) is not None]
            top = max(arcs)
            alpha.append(top if len(arcs) == 1 else top + log(sum([exp(a - top) for a in arcs])))
        return alpha

    def words(self, words: Iterable[bytes]) -> Iterator[float]:
        """Log probability of each word's spelling. Sorted words share the sums of their common prefixes."""
        last, alpha = b"", [0.0]
        for word in words:
            text, same = b" " + word, 0
            for x, y in zip(text, last, strict=False):
                if x != y:
                    break
                same += 1
            alpha = self.forward(text, alpha[: same + 1], same + 1)
            last = text
            yield alpha[-1] + self.end

    def expect(self, words: Iterable[bytes], into: dict[bytes, float]) -> None:
        """Add the expected number of each piece over the segmentations of each word. Sorted words share their prefixes."""
        longest, get, exp, log = self.longest, self.scores.get, math.exp, math.log
        last, alpha, arcs, upto, n_words = b"", [0.0], [], [0], 0  # arcs: (from, to, score, piece), by their ends; upto: arcs to each end
        for word in words:
            text, same = b" " + word, 0
            for x, y in zip(text, last, strict=False):
                if x != y:
                    break
                same += 1
            last, n = text, len(text)
            del alpha[same + 1 :], upto[same + 1 :], arcs[upto[same] :]
            for j in range(same + 1, n + 1):
                sums = []
                for i in range(j - longest if j > longest else 0, j):
                    if (s := get(piece := text[i:j])) is not None:
                        arcs.append((i, j, s, piece))
                        sums.append(alpha[i] + s)
                top = max(sums)
                alpha.append(top if len(sums) < 2 else top + log(sum([exp(a - top) for a in sums])))
                upto.append(len(arcs))
            # backward: the share of all segmentations that pass each place
            share = [0.0] * n + [1.0]
            for i, j, s, piece in reversed(arcs):
                if (passed := share[j]) > 1e-7:
                    part = passed * exp(alpha[i] + s - alpha[j])
                    share[i] += part
                    into[piece] = into.get(piece, 0.0) + part
            n_words += 1
        into[END_OF_WORD] = into.get(END_OF_WORD, 0.0) + n_words


def log_scores(counts: dict[bytes, float], pieces: Iterable[bytes], least: float = 0.01) -> dict[bytes, float]:
    """Log unigram probabilities from counts; every single byte stays possible, other pieces must have occurred."""
    kept = {p: counts.get(p, 0.0) + least for p in pieces if len(p) == 1 or counts.get(p, 0.0) > least}
    total = sum(kept.values())
    return {p: math.log(c / total) for p, c in kept.items()}


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c, by): counts over all texts, and ``by`` class (``cls``); the empty word is the end."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter[bytes]] = defaultdict(Counter)

        def rows():
            for cls, counts in found.items():
                yield pa.record_batch({"word": pa.array(list(counts.keys()), pa.binary()), "cls": pa.array([cls] * len(counts), pa.string()), "c": pa.array(list(counts.values()), pa.int64())})
            found.clear()

        for batch in batches:
            for cls, text in zip(batch.column(0).to_pylist(), common.byte_texts(batch, "text"), strict=True):
                found[cls].update(text.lower().split())
                found[cls][b""] += 1
                if sum(map(len, found.values())) > FLUSH:
                    yield from rows()
        yield from rows()

    # summed up by task; one shuffle serves both groupings
    counts = docs.select("cls", "text").mapInArrow(count, "word binary, cls string, c long").repartition("word")
    counts = counts.groupBy("word", "cls").agg(F.sum("c").alias("c"))
    return counts.groupBy("word").agg(F.sum("c").alias("c"), F.map_from_entries(F.collect_list(F.struct("cls", "c"))).alias("by"))


def piece_scores(words: DataFrame, model_path: str) -> dict[bytes, float]:
    """Unigram scores of the vocabulary's pieces, learned from all ``words`` (word, c) seen once."""
    pieces = byte_pieces(model_path)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        totals: Counter[int] = Counter()
        for batch in batches:
            texts = [w.decode("utf-8", "replace") for w in batch.column(0).to_pylist()]
            for lo in range(0, len(texts), 4096):
                for ids in sp.encode(texts[lo : lo + 4096], num_threads=1):
                    totals.update(ids)
        yield pa.record_batch({"piece": pa.array(list(totals), pa.int32()), "n": pa.array([float(n) for n in totals.values()], pa.float64())})

    words = words.where("octet_length(word) > 0 and c = 1").select("word")
    # at most one row for each piece of the vocabulary
    found = {r.piece: r.n for r in words.mapInArrow(cut, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()}
    counts = {p: found.get(i, 0.0) for p, i in pieces.items()}
    counts[END_OF_WORD] = max(sum(found.values()) / 3, 1.0)
    for _ in range(EXPECTATIONS):
        start = docs_broadcast(words, Lattice(log_scores(counts, pieces)))

        def expect(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            into: dict[bytes, float] = {}
            for batch in batches:
                start.value.expect(batch.column(0).to_pylist(), into)
            yield pa.record_batch({"piece": pa.array(list(into), pa.binary()), "n": pa.array(list(into.values()), pa.float64())})

        sums = words.sortWithinPartitions("word").mapInArrow(expect, "piece binary, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        counts = {bytes(r.piece): r.n for r in sums}
    return log_scores(counts, pieces)


def docs_broadcast(df: DataFrame, value):
    """Send a value of bounded size, no more rows than the vocabulary has pieces, to the executors."""
    return df.sparkSession.sparkContext.broadcast(value)


def spelled(words: DataFrame, lattice) -> DataFrame:
    """``words`` with ``lp``, the log10 probability of the spelling."""
    schema = words.withColumn("lp", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lp = np.fromiter(lattice.value.words(batch.column(0).to_pylist()), float, batch.num_rows) / LOG10
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lp)], names=[*batch.schema.names, "lp"])

    return words.sortWithinPartitions("word").mapInArrow(run, schema)


class Model(NamedTuple):
    """What all words share: training tokens, distinct ones, the Good-Turing share of unseen words, and the sizes of classes."""

    tokens: int
    distinct: int
    fresh: float
    classes: DataFrame  # cls, size

    def scored(self, rows: DataFrame) -> DataFrame:
        """``rows`` (word, cls, c, ck, lp, ...) with base, drawn (probability of the word in its class, not repeated) and lp; log10 but for drawn."""
        sized = rows.join(self.classes.withColumnRenamed("cls", "_cls"), F.expr("cls = _cls"), "left").drop("_cls")
        ratio = f"(1 - {COMMON}D) * ck / greatest(coalesce(size, 0), 1) + {COMMON}D * c / {max(self.tokens, 1)}D"
        word = f"{1 - self.fresh!r}D * ({ratio}) + {self.fresh!r}D * pow(10D, lp)"
        end = "octet_length(word) = 0"  # never spelled
        return sized.selectExpr(
            *(c for c in rows.columns if c != "lp"),
            f"log10((c + 0.1D) / {self.tokens + 0.1 * (self.distinct + 1)!r}D) as base",
            # a word too long for a probability keeps its logarithm
            f"case when {end} then {1 - self.fresh!r}D * (ck + 0.5D) / (coalesce(size, 0) + 1) else {word} end as drawn",
            f"case when {end} then log10({1 - self.fresh!r}D * (c + 0.5D) / {self.tokens + 1}D) else lp end as lp",
        )


class Head:
    """The commonest words of each class and what they score."""

    def __init__(self, rows: list):
        self.at: dict[str, dict[bytes, int]] = defaultdict(dict)
        for i, r in enumerate(rows):
            self.at[r.cls][bytes(r.word)] = i
        self.base = np.array([r.base for r in rows] + [0.0])
        self.drawn = np.array([r.drawn for r in rows] + [1.0])
        self.lp = np.array([r.lp for r in rows] + [0.0])


def repeats(ids: np.ndarray) -> np.ndarray:
    """For each place of a text the share, times ``REPEAT``, that its word has of the places before; the end is last."""
    n = len(ids)
    order, ranks = np.argsort(ids, kind="stable"), np.arange(n)
    first = np.r_[True, ids[order][1:] != ids[order][:-1]]
    before = np.empty(n)
    before[order] = ranks - np.maximum.accumulate(np.where(first, ranks, 0))
    return REPEAT * before / np.maximum(ranks, 1)


READ = "key long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, spelled double, cls string, word binary, n long, lead boolean, again array<double>"


def read_texts(rows: DataFrame, head) -> DataFrame:
    """``READ``: a row a text, summed over its words of the ``head``, and a row a text and other word, with its shares in the text so far (``again``)."""
    kinds = [pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 2, *[pa.float64()] * 3, pa.string(), pa.binary(), pa.int64(), pa.bool_(), pa.list_(pa.float64())]
    schema = pa.schema([pa.field(part.split()[0], kind) for part, kind in zip(READ.split(", "), kinds, strict=True)])

    def batch_of(**columns: pa.Array | list) -> pa.RecordBatch:
        """The columns given, nulls in the others."""
        n = len(columns["key"])
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, key = head.value, TaskContext.get().partitionId() << 33
        for batch in batches:
            texts: dict[str, list] = {f.name: [] for f in list(schema)[:8]}
            words: dict[str, list] = {name: [] for name in ("key", "cls", "word", "n", "lead", "again")}
            for doc, held, cls, text in zip(*(batch.column(i).to_pylist() for i in range(3)), common.byte_texts(batch, "text"), strict=True):
                key += 1
                body, local = text.lower().split(), {}
                number = local.setdefault
                ids = np.fromiter([number(w, len(local)) for w in body], np.int64, len(body))
                ids = np.append(ids, number(b"", len(local)))
                get = known.at.get(cls, {}).get
                place = np.fromiter([get(w, -1) for w in local], np.int64, len(local))
                again, at = repeats(ids), place[ids]
                listed = at >= 0
                fresh = np.full(len(ids), 1 - REPEAT)
                fresh[0] = 1.0
                score = np.log10(fresh[listed] * known.drawn[at[listed]] + again[listed]).sum()
                for name, value in zip(texts, (key, doc, held, len(ids), int(listed.sum()), known.base[at].sum(), score, known.lp[at].sum()), strict=True):
                    texts[name].append(value)
                if (others := np.nonzero(place < 0)[0]).size:
                    mine = list(local)
                    shares: list = [None] * len(others)
                    if (more := np.nonzero((again > 0) & ~listed)[0]).size:
                        for i, share in zip(np.searchsorted(others, ids[more]).tolist(), again[more].tolist(), strict=True):
                            if shares[i] is None:
                                shares[i] = []
                            shares[i].append(share)
                    words["key"] += [key] * len(others)
                    words["cls"] += [cls] * len(others)
                    words["word"] += [mine[i] for i in others.tolist()]
                    words["n"] += np.bincount(ids, minlength=len(local))[others].tolist()
                    words["lead"] += (others == ids[0]).tolist()
                    words["again"] += shares
                if len(words["key"]) > FLUSH // 8:
                    yield batch_of(**words)
                    words = {name: [] for name in words}
            if words["key"]:
                yield batch_of(**words)
            if texts["key"]:
                yield batch_of(**texts)

    return rows.select("doc_id", "held_out", "cls", "text").mapInArrow(run, READ)


def lattice_scores(docs: DataFrame, held_out: Column, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", class_col: str | None = None) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), spelled_score."""
    cls = F.coalesce(F.col(class_col).cast("string"), F.lit("")) if class_col else F.lit("")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), cls.alias("cls"), F.col(text_col).alias("text"))
    counts = common.stored(word_counts(rows.where("not held_out")), "word_counts")
    n, v, once = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.expr("cast(c = 1 as long)")), F.lit(0))).first()
    sizes = counts.select(F.explode("by").alias("cls", "ck")).groupBy("cls").agg(F.sum("ck").alias("size"))
    model = Model(n, v, (once + 1) / (n + 2), common.stored(sizes, "class_sizes"))  # Good-Turing share of words not seen
    lattice = docs_broadcast(rows, Lattice(piece_scores(counts, model_path)))

    pairs = counts.select("word", "c", F.explode("by").alias("cls", "ck")).orderBy(F.desc("ck"), "cls", "word").limit(HEAD)
    listed = model.scored(spelled(common.stored(pairs, "head"), lattice)).select("word", "cls", "base", "drawn", "lp").collect()  # HEAD rows
    read = common.stored(read_texts(rows, docs_broadcast(rows, Head(listed))), "read_texts")

    others = read.where("word is not null").select("key", "cls", "word", "n", "lead", "again")
    words = others.select("word").distinct().join(counts, "word", "left")
    words = common.stored(spelled(words, lattice), "other_words")
    met = model.scored(others.join(words, "word").withColumns({"c": F.expr("coalesce(c, 0)"), "ck": F.expr("coalesce(element_at(by, cls), 0)")}).drop("by"))
    # the least a probability can be stands for spellings too long for one
    d = "greatest(drawn, 1e-300D)"
    score = f"greatest(log10({d}), lp + {math.log10(max(model.fresh, 1e-300))!r}D) + if(lead, 0D, {math.log10(1 - REPEAT)!r}D) + coalesce(aggregate(again, 0D, (s, a) -> s + log10({1 - REPEAT!r}D * {d} + a)), 0D)"
    sums = met.selectExpr("key", "if(c > 0, n, 0L) as known", "n * base as base2", f"{score} as score2", "n * lp as spelled2")
    sums = sums.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("known", "base2", "score2", "spelled2")))
    out = read.where("word is null").join(sums, "key", "left")
    total = lambda a, b: f"{a} + coalesce({b}, 0)"
    return out.selectExpr("doc_id", "held_out", "n_tokens", f"{total('n_known', 'known')} as n_known", f"{n}L as train_tokens", f"{total('base', 'base2')} as base_score", f"{total('score', 'score2')} as score", f"{total('spelled', 'spelled2')} as spelled_score")


def op3_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    return lattice_scores(docs, held_out, public_tokenizers.path("piece_bpe_32k.model"), class_col="lang")


QUERIES = {"op3_lattice_scores": op3_lattice_scores}
ORACLES: dict[str, str] = {}

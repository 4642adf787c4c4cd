"""Operator 6 - license scans: winnowed fingerprints pick candidates, banded alignment measures them.

Templates are cut into words and word ``GRAM``-grams; winnowing (Schleimer,
Wilkerson and Aiken 2003) keeps the smallest hash of each ``WINNOW`` in a row. The
kept hashes of all templates form an inverted index, as large as the templates.
Texts are winnowed in the same way, so a run of GRAM + WINNOW - 1 equal words
shares a kept hash. Shorter templates, which a text's winnowing may miss, are in
an index of their own, with the hashes of all their runs of GRAM words (or of
all their words, where they have fewer), and are looked up among all runs of a
text. So a whole wording of any length is found wherever it stands. A template is a candidate where a text holds ``HITS`` of its
kept hashes; hits on nearby diagonals are one line, and the template is aligned
along each line inside a band of ``BAND`` words to either side. Aligned pieces
that follow one another in the template and in the text, no more words apart
than the template has (``CHAIN`` at least), are one match, so a wording with a
passage put into its middle is found whole. The coverage, the share of the template's words that match, is
reported with the span if it reaches ``COVER``. Of overlapping matches of one
license the best is kept; where a match lies inside one of another license that
matches more words, it goes too (a notice is part of longer ones). A license
found in several places has a row each.

Templates are :mod:`license_texts`, or rows (license, wording) of a table. They
are the query set, broadcast up to ``TEMPLATE_BYTES``; more are scanned in
blocks of that size, and overlaps are settled inside a block.

Null texts are empty; texts without a license have no rows. Null or empty
wordings match nothing. Repeated rows are reported each. An empty table gives no
rows. Extra columns are not read. Texts are scanned whole.
"""

from __future__ import annotations

import functools
import re
from collections import defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .license_texts import TEMPLATES

GRAM, WINNOW, BAND, COVER = 3, 3, 8, 0.75
HITS, CHAIN = 0.2, 48
MISS, GAP = 0.5, 0.4  # what an alignment loses, in matches, for a word replaced, and for one put in or left out
TEMPLATE_BYTES = 16 << 20
OUTER = b".,;:!?\"'()[]*#/<>-"


def clean(token: bytes) -> bytes:
    return token.strip(OUTER) or token


def gram_hashes(words: list[int], size: int = GRAM) -> np.ndarray:
    """Hash of each run of ``size`` words, from word hashes."""
    w = np.array(words, np.uint64)
    n = len(w) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = (out ^ w[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def winnow(hashes: np.ndarray) -> np.ndarray:
    """Places of the hashes that are the smallest (the last of equals) in some window of ``WINNOW``."""
    if len(hashes) <= WINNOW:
        return np.array([len(hashes) - 1 - int(np.argmin(hashes[::-1]))] if len(hashes) else [], np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(hashes, WINNOW)[:, ::-1]
    return np.unique(np.arange(len(windows)) + WINNOW - 1 - np.argmin(windows, axis=1))


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...]):
        cut = [(name, [clean(t) for t in (text or "").encode().lower().split()]) for name, text in templates]
        self.templates = [(name, words) for name, words in cut if words]
        self.index: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.need = []
        short: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for k, (_, words) in enumerate(self.templates):
            numbers = [crc32(w) for w in words]
            if len(words) < GRAM + WINNOW - 1:  # no window of a text need keep a hash of it
                size = min(GRAM, len(words))
                for at, h in enumerate(gram_hashes(numbers, size).tolist()):
                    short[size][h].append((k, at))
                self.need.append(1)
                continue
            hashes = gram_hashes(numbers)
            kept = winnow(hashes).tolist()
            self.need.append(max(1, int(HITS * len(kept))))
            for at in kept:
                self.index[int(hashes[at])].append((k, at))
        self.keys = np.array(sorted(self.index), np.uint64)
        self.short = {size: (np.array(sorted(index), np.uint64), dict(index)) for size, index in short.items()}
        self.seen: dict[bytes, int] = {}

    def numbers(self, tokens: list[bytes]) -> list[int]:
        seen = self.seen
        if len(seen) > 400_000:
            seen.clear()
        out = []
        for t in tokens:
            h = seen.get(t)
            if h is None:
                h = seen[t] = crc32(clean(t))
            out.append(h)
        return out

    def scan(self, text: bytes) -> list[tuple[str, int, int, int, float]]:
        """(license, first word, last word, matching words, coverage) of every match."""
        tokens = text.lower().split()
        numbers = self.numbers(tokens)
        hashes = gram_hashes(numbers)
        kept = winnow(hashes)
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for at in kept[np.isin(hashes[kept], self.keys)].tolist():
            for k, place in self.index[int(hashes[at])]:
                hits[k].append((at, place))
        for size, (keys, index) in self.short.items():
            runs = gram_hashes(numbers, size)
            for at in np.flatnonzero(np.isin(runs, keys)).tolist():
                for k, place in index[int(runs[at])]:
                    hits[k].append((at, place))
        found = []
        for k, places in hits.items():
            if len({place for _, place in places}) >= self.need[k]:
                name, words = self.templates[k]
                found += [(name, *m, m[2] / len(words)) for m in chained(pieces(words, tokens, places), len(words)) if m[2] >= COVER * len(words)]
        return best_of(found)


#: Words a cell; matches are compared with those that share a cell with them only.
CELL = 64


def best_of(found: list[tuple[str, int, int, int, float]]) -> list[tuple[str, int, int, int, float]]:
    """``found`` without those that overlap a better match of their license, or lie inside a larger one of any."""
    out: list[tuple[str, int, int, int, float]] = []
    cells: dict[int, list[tuple[str, int, int, int, float]]] = defaultdict(list)
    for match in sorted(set(found), key=lambda m: (-m[3], -m[4], m[1], m[0])):
        spans = range(match[1] // CELL, match[2] // CELL + 1)
        same = any(b[0] == match[0] and b[1] <= match[2] and match[1] <= b[2] for c in spans for b in cells[c])
        if not same and not any(b[1] <= match[1] and match[2] <= b[2] and b[3] > match[3] for b in cells[spans[0]]):
            out.append(match)
            for c in spans:
                cells[c].append(match)
    return sorted(out, key=lambda m: (m[1], m[0]))


def pieces(words: list[bytes], tokens: list[bytes], hits: list[tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Alignments of ``words`` along the lines of ``hits`` (token, word): (matches, first and last word, first and last token)."""
    out, lines = set(), []  # a line: its diagonal and the first and last token hit
    for line, at in sorted((at - place, at) for at, place in hits):
        if lines and line - lines[-1][0] <= BAND // 2:
            lines[-1][1], lines[-1][2] = min(lines[-1][1], at), max(lines[-1][2], at)
        else:
            lines.append([line, at, at])
    for line, _, _ in lines:
        found = banded(words, tokens, line)
        if found[0]:
            out.add(found)
    return sorted(out, key=lambda p: (p[3], p[1]))


def chained(found: list[tuple[int, int, int, int, int]], size: int) -> list[tuple[int, int, int]]:
    """(first token, last token, matches) of each piece with the best run of pieces before it; what two pieces share counts once.

    ``found`` are in the order of their first tokens, of a template of ``size`` words; no piece is longer than that and its band.
    """
    gap = max(CHAIN, size)
    reach = gap + size + 2 * BAND
    best: list[tuple[int, int, int]] = []  # first token, last token, matches of the chain that ends with each piece
    for i, (n, w0, w1, t0, t1) in enumerate(found):
        chain = (t0, t1, n)
        for j in range(i - 1, -1, -1):
            _, start_w, end_w, start_t, end_t = found[j]
            if t0 - start_t > reach:
                break
            if start_w < w0 and start_t < t0 and end_w < w1 and end_t < t1 and t0 - end_t <= gap:
                total = best[j][2] + n - max(0, end_w - w0 + 1, end_t - t0 + 1)
                if total > chain[2]:
                    chain = (best[j][0], t1, total)
        best.append(chain)
    return best


def banded(words: list[bytes], tokens: list[bytes], line: int) -> tuple[int, int, int, int, int]:
    """Align ``words`` with ``tokens`` near the diagonal ``line``: most matches less a little for each gap.

    Returns the matches, the first and last word and the first and last token matched.
    """
    lo = max(0, line - BAND)
    part = [clean(t) for t in tokens[lo : line + len(words) + BAND]]
    width = 2 * BAND + 1
    # a row a template word, a column an offset from the diagonal; (score, matches, first word, last word, first token, last token)
    none = (0.0, 0, -1, -1, -1, -1)
    above = [none] * (width + 1)
    best = none
    for i, word in enumerate(words):
        row, left = [], none
        for c in range(width):
            j = line + i + c - BAND - lo
            step = above[c]
            if 0 <= j < len(part) and part[j] == word:
                first = step[2], step[4]
                if not step[1]:
                    first = i, j + lo
                step = (step[0] + 1, step[1] + 1, first[0], i, first[1], j + lo)
            else:
                step = (step[0] - MISS, *step[1:]) if step[0] > MISS else none
            for other in (above[c + 1], left):
                if other[0] - GAP > step[0]:
                    step = (other[0] - GAP, *other[1:])
            row.append(step)
            left = step
            if step[0] > best[0]:
                best = step
        above = [*row, none]
    return best[1:]


def template_blocks(templates: DataFrame | tuple[tuple[str, str], ...]) -> Iterator[tuple[tuple[str, str], ...]]:
    """Templates in blocks of up to ``TEMPLATE_BYTES``."""
    rows = ((r[0], r[1]) for r in templates.toLocalIterator()) if isinstance(templates, DataFrame) else iter(templates)
    held, used = [], 0
    for name, wording in rows:
        if held and used + len(wording or "") > TEMPLATE_BYTES:
            yield tuple(held)
            held, used = [], 0
        held.append((name, wording))
        used += len(wording or "")
    yield tuple(held)


def license_matches(docs: DataFrame, templates: DataFrame | tuple[tuple[str, str], ...] = TEMPLATES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a match: doc_id, license, coverage, matched_words, first_word, last_word, start, stop (characters of the text).

    ``templates`` are pairs or a table (license, wording).
    """
    blocks = [block_matches(docs, block, id_col, text_col) for block in template_blocks(templates)]
    return functools.reduce(DataFrame.unionByName, blocks)


def block_matches(docs: DataFrame, templates: tuple[tuple[str, str], ...], id_col: str, text_col: str) -> DataFrame:
    schema = "doc_id long, license string, coverage double, matched_words int, first_word long, last_word long, start long, stop long"
    word = re.compile(common.WORD)
    shared = docs.sparkSession.sparkContext.broadcast(templates)  # TEMPLATE_BYTES at most, but for a single longer wording

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value)
        for batch in batches:
            rows: list[tuple] = []
            for i, text in enumerate(common.byte_texts(batch, "text")):
                found = scanner.scan(text)
                if found:
                    spans = [m.span() for m in word.finditer(text.decode())]
                    doc = batch.column(0)[i].as_py()
                    rows += [(doc, name, cover, matched, first, last, spans[first][0], spans[last][1]) for name, first, last, matched, cover in found]
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "license", "coverage", "matched_words", "first_word", "last_word", "start", "stop"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def op6_license_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_matches(common.read_table(spark, sf_dir, "documents"))


QUERIES = {"op6_license_matches": op6_license_matches}
ORACLES: dict[str, str] = {}

"""Operator 11 against a plain version, on odd rows, with longer runs, in small pieces."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from vellumite.llm import common, importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(common.ASCII_UPPER, common.ASCII_UPPER.lower())


def runs(text, longest):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def made_texts():
    rng = random.Random(11)
    signs = ["a", "B", "z9", "é", "日本", "ÀB", "word", " ", "  ", "-", "\x00", "\n", "_", "'", "[", "`", "{", "\x7f", "😀", "x" * 70, "Ÿ" * 40]
    return ["", None, " ", "a", "x" * 500, "é" * 300 + " b", *("".join(rng.choice(signs) for _ in range(rng.randrange(80))) for _ in range(120)), "", "tail"]


@pytest.mark.parametrize("longest", [1, 2, 3])
@pytest.mark.parametrize("piece", [1, 7, 64, 1 << 20])
def test_hashes_of_runs(longest, piece):
    texts = made_texts()
    for column in (pa.array(texts, pa.string()), pa.array([*texts, "more"], pa.large_string()).slice(0, len(texts)), pa.array(["before", *texts]).slice(1)):
        got, words = defaultdict(Counter), Counter()
        for rows, crcs, of_words in importance.feature_hashes(column, longest, piece):
            for r, c in zip(rows.tolist(), crcs.tolist(), strict=True):
                got[r][c] += 1
            words.update(of_words.tolist())
        for i, text in enumerate(texts):
            own, want = runs(text, longest)
            assert got[i] == Counter(crc32(f.encode()) for f in want) and words[i] == len(own), (i, text)


def brute(docs, target, longest=1, buckets=50, percent=30, least=3, seed=7):
    bucket = lambda f: crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, x in docs for f in runs(x, longest)[1])
    t = Counter(bucket(f) for x in target for f in runs(x, longest)[1])
    big_s, big_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * big_s / ((s[b] + 1) * big_t))) for b in range(buckets)]
    out = []
    for i, text in docs:
        words, own = runs(text, longest)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in own)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words) >= least])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize("longest", [1, 2])
def test_draw_against_brute_force(spark, longest):
    docs = [(i, t) for i, t in enumerate(made_texts())]
    target = ["a word b", "日本 z9", None, "word word é"]
    out = importance.resampled(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame([(t,) for t in target], "text string"), longest=longest, buckets=50, percent=30, least_words=3, seed=7)
    assert sorted((tuple(r) for r in out.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr) == brute(docs, target, longest)


def test_odd_rows(spark, odd_docs, no_docs):
    target = spark.createDataFrame([("the of and",)], "text string")
    out = importance.resampled(odd_docs, target, percent=50)
    assert out.count() == odd_docs.count() and {"lang", "fp", "digest", "h"} <= set(out.columns) and "position" not in out.columns
    rows = out.collect()
    able = [r for r in rows if r.n_words >= 20]
    drawn = sorted((r for r in rows if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, len(able) // 2 + 1))
    assert [r.score for r in drawn] == sorted((r.score for r in able), reverse=True)[: len(drawn)]
    assert importance.resampled(no_docs, target).collect() == []
    assert importance.resampled(odd_docs, target.where("false")).count() == odd_docs.count()


def test_many_equal_scores(spark):
    """One score and one id on all rows: still exactly as many as are to be drawn."""
    docs = spark.createDataFrame([(5, "a b c")] * 400, "doc_id long, text string")
    out = importance.resampled(docs, docs, least_words=1, percent=25)
    assert sorted(r["rank"] for r in out.where("rank is not null").collect()) == list(range(1, 101))


def test_gains_in_doubles():
    docs, target = np.array([0, 3, 10]), np.array([2, 0, 0])
    assert importance.gains(docs, target).tolist() == [math.floor(1000 * math.log((t + 1) * 16.0 / ((s + 1) * 5.0))) for s, t in zip(docs.tolist(), target.tolist(), strict=True)]

"""Operator 8 - quality classifier: ordinal cumulative-link regression on graded ratings.

Ratings are made of the labels: grade 0 toxic, 1 of low quality, 2 good. One
weight vector over hashed text features is shared by all grades; ordered
thresholds cut its score into grades: P(grade <= k) = sigmoid(threshold_k - score).
A document's expected grade is the sum of its tail probabilities P(grade >= k);
it is selected when P(grade >= 2) reaches ``KEEP``.

Features, from the whole text: each distinct word (lower-cased A-Z, outer
punctuation removed), each distinct start of 4 and 5 bytes, the share of each
pair of first and last character class among all words, and the tenth in which
the shares of distinct words and of the commonest word fall, hashed to ``DIMS``
numbers. Those in fewer than ``MIN_DF`` documents of the sample get no weight.

The fit reads a bounded sample, ``SAMPLE`` labelled documents at most, those of
the smallest id hash, one row an id (of an id's texts that of the smallest hash);
the features of that sample go to the driver. Labels without a document don't count. Scoring
reads every document in full. Null or conflicting labels: a null grade part
drops the label, of several labels of one id the lowest grade counts. Null texts
are empty. Without labels every document is kept, with probability 1. Repeated
rows are scored each. An empty table gives no rows. Extra columns are kept; those
named like a result (expected_grade, p_grade_1, p_grade_2, selected) are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SAMPLE = 10_000
DIMS = 1 << 22
MIN_DF = 4
PRESENT, SHARE = 0.2, 4.0  # value of a word or start that occurs; factor of shares
GRADES = 3
KEEP = 0.6
STEPS, RATE, BATCH, DECAY = 1500, 0.2, 256, 5e-5
PUNCTUATION = b".,;:!?()[]{}<>\"'|*#-_/\\%&$@+=~"

#: Classes of a word's first and last byte.
CLASSES = bytes(ord("a") if 97 <= b <= 122 else ord("A") if 65 <= b <= 90 else ord("0") if 48 <= b <= 57 else ord("x") if b > 127 else b for b in range(256))


def features(text: bytes) -> tuple[list[int], list[float]]:
    """Feature numbers and values of one text."""
    tokens = text.split()
    words = {t.strip(PUNCTUATION).lower() for t in set(tokens)}
    parts = words | {b"\x04" + w[:4] for w in words if len(w) > 4} | {b"\x05" + w[:5] for w in words if len(w) > 5}
    shapes = Counter([t[:1] + t[-1:] for t in tokens])
    pairs: Counter[bytes] = Counter()
    for ends, n in shapes.items():
        pairs[ends.translate(CLASSES)] += n
    total = len(tokens) or 1
    repeats = [b"\x01%d" % (10 * len(set(tokens)) // total), b"\x02%d" % (10 * max(Counter(tokens).values(), default=0) // total)]
    index = [crc32(w) % DIMS for w in parts] + [crc32(b"\x00" + s) % DIMS for s in pairs] + [crc32(r) % DIMS for r in repeats]
    return index, [PRESENT] * len(parts) + [SHARE * n / total for n in pairs.values()] + [1.0] * len(repeats)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def grade_bounds(scores: np.ndarray, grades: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(grade <= y) and P(grade < y) of each row's own grade y; their difference is its likelihood."""
    edges = np.concatenate([[-np.inf], theta, [np.inf]])
    upper, lower = sigmoid(edges[grades + 1] - scores), sigmoid(edges[grades] - scores)
    upper[grades == len(theta)], lower[grades == 0] = 1, 0
    return upper, lower


def slopes(scores: np.ndarray, grades: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of the log likelihood: of each row by its score, and of the rows' mean by each threshold."""
    upper, lower = grade_bounds(scores, grades, theta)
    p = np.maximum(upper - lower, 1e-9)
    up, down = upper * (1 - upper) / p, lower * (1 - lower) / p
    by_theta = [(np.where(grades == k, up, 0) - np.where(grades == k + 1, down, 0)).mean() for k in range(len(theta))]
    return upper + lower - 1, np.array(by_theta)


class OrdinalModel:
    """Shared weights, by feature number, and ordered thresholds."""

    def __init__(self, weights: dict[int, float], thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def score(self, text: bytes) -> float:
        weight = self.weights.get
        return sum(v * w for i, v in zip(*features(text), strict=True) if (w := weight(i)))

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """(n, grades - 1): P(grade >= k) for k = 1, 2, ..."""
        return sigmoid(scores[:, None] - self.thresholds[None, :])

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, *, steps: int = STEPS, min_df: int = MIN_DF) -> OrdinalModel:
        """Maximum likelihood with L2 decay, by Adagrad over batches in a fixed order."""
        df = np.zeros(DIMS, np.int32)
        for i, _ in rows:
            df[i] += 1
        used = np.nonzero(df >= min_df)[0]
        place = np.full(DIMS, -1, np.int32)
        place[used] = np.arange(len(used))
        starts = np.cumsum([0, *(int((place[i] >= 0).sum()) for i, _ in rows)])
        # filled row by row: no second copy of all rows in small pieces
        index, value = np.empty(starts[-1], np.int32), np.empty(starts[-1], rows[0][1].dtype)
        for (i, v), lo, hi in zip(rows, starts[:-1], starts[1:], strict=True):
            own = place[i]
            index[lo:hi], value[lo:hi] = own[own >= 0], v[own >= 0]
        dims = max(len(used), 1)
        w, squares = np.zeros(dims), np.full(dims, 1e-6)
        below = np.cumsum(np.bincount(grades, minlength=GRADES) + 0.5)[:-1] / (len(rows) + 0.5 * GRADES)
        theta, theta_squares = np.log(below / (1 - below)), np.full(GRADES - 1, 1e-6)
        order = np.random.default_rng(7)
        for _ in range(-(-steps // max(1, -(-len(rows) // BATCH)))):
            turn = order.permutation(len(rows))
            for lo in range(0, len(turn), BATCH):
                pick = turn[lo : lo + BATCH]
                at = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in pick])
                i, v, who, y = index[at], value[at], np.repeat(np.arange(len(pick)), starts[pick + 1] - starts[pick]), grades[pick]
                by_score, by_theta = slopes(np.bincount(who, v * w[i], len(pick)), y, theta)
                step = np.bincount(i, v * by_score[who], dims) / len(pick) - DECAY * w
                squares += step * step
                w += RATE * step / np.sqrt(squares)
                theta_squares += by_theta * by_theta
                theta += 0.1 * by_theta / np.sqrt(theta_squares)
                theta = np.maximum.accumulate(theta + np.arange(GRADES - 1) * 1e-9)
        return cls(dict(zip(used.tolist(), w.tolist(), strict=False)), theta)


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade), one row an id."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.select("doc_id", grade.alias("grade")).where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> OrdinalModel | None:
    """Fit on at most ``sample`` labelled documents; None where there are none."""
    chosen = graded(labels).join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # `sample` rows of two numbers at most
    rated = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rated = rated.groupBy("doc_id", "grade").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least")).select("doc_id", "grade", "least.text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                pairs = [features(t) for t in common.byte_texts(part, "text")]
                yield pa.record_batch({"doc_id": part.column(0), "grade": part.column(2), "index": pa.array([np.array(i, np.int32).tobytes() for i, _ in pairs], pa.binary()), "value": pa.array([np.array(v, np.float32).tobytes() for _, v in pairs], pa.binary())})

    found = rated.select("doc_id", "text", F.col("grade").cast("int")).mapInArrow(extract, "doc_id long, grade int, index binary, value binary")
    table = found.toArrow()
    if not table.num_rows:
        return None
    # in the order of ids, without a copy
    order = np.argsort(table.column("doc_id").to_numpy(), kind="stable")
    rows = [(np.frombuffer(i.as_buffer(), np.int32), np.frombuffer(v.as_buffer(), np.float32)) for i, v in zip(table.column("index"), table.column("value"), strict=True)]
    model = OrdinalModel.fit([rows[i] for i in order], table.column("grade").to_numpy()[order])
    del rows, table, found
    common.hand_back()  # the driver keeps the model alone
    return model


def score(docs: DataFrame, model: OrdinalModel | None, *, keep: float = KEEP) -> DataFrame:
    """``docs`` with expected_grade, p_grade_1, p_grade_2 (tail probabilities) and selected."""
    if model is None:
        return docs.withColumns({"expected_grade": F.lit(2.0), "p_grade_1": F.lit(1.0), "p_grade_2": F.lit(1.0), "selected": F.lit(True)})
    shared = docs.sparkSession.sparkContext.broadcast(model)  # numbers of the features of the sample

    @F.pandas_udf("struct<p1: double, p2: double>")
    def tails(texts):
        import pandas as pd

        model = shared.value
        p = model.tails(np.array([model.score((text or "").encode()) for text in texts], float))
        return pd.DataFrame({"p1": p[:, 0], "p2": p[:, 1]})

    (p,) = common.unused(docs.columns, "_p")
    scored = docs.withColumn(p, tails("text"))
    scored = scored.withColumns({"expected_grade": F.col(f"{p}.p1") + F.col(f"{p}.p2"), "p_grade_1": F.col(f"{p}.p1"), "p_grade_2": F.col(f"{p}.p2")})
    return scored.withColumn("selected", F.col("p_grade_2") >= keep).drop(p)


def op8_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    model = train(docs, common.read_table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), model).drop("text")


QUERIES = {"op8_ordinal_quality": op8_ordinal_quality}
ORACLES: dict[str, str] = {}

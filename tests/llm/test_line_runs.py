"""Operator 12 against a brute-force version, on odd rows, in any order of batches."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from vellumite.llm import common, line_runs

BLANK = " \t\n\x0b\x0c\r"
UPPER = str.maketrans(common.ASCII_UPPER, common.ASCII_UPPER.lower())


def brute(rows, least_points=20, least_docs=3):
    """(doc_id, n_lines, n_dropped, kept) of (doc_id, text) rows."""
    number = lambda i: line_runs.NO_ID if i is None else i
    key = lambda line: line.strip(BLANK).translate(UPPER)
    held = defaultdict(list)
    for i, text in rows:
        for k in {key(line) for line in (text or "").split("\n")}:
            if len(k) >= least_points:
                held[k].append(number(i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if not (len(held[key(x)]) >= least_docs and number(i) < max(held[key(x)]))]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def got(df):
    rows = df.select("doc_id", "n_lines", "n_dropped", F.col("kept_text").cast("string")).collect()
    return sorted((tuple(r) for r in rows), key=repr)


def made_texts(n):
    rng = random.Random(12)
    pool = [f"a line that is held by several texts, number {i}" for i in range(30)] + ["short", "", "é" * 19, "é" * 20, "x" * 20, "x" * 19, "Ünïcode LINE that stays what it is"]
    rows = []
    for i in range(n):
        lines = [rng.choice(pool) for _ in range(rng.randrange(6))] + ["the line that every text holds"] * (i % 3 > 0) + [f"line of text {i} alone, not repeated"]
        lines = [rng.choice(["", "  ", "\t"]) + (x.upper() if rng.random() < 0.2 else x) + rng.choice(["", " ", "\r"]) for x in lines]
        rows.append((i, "\n".join(lines)))
    return rows


def test_lines_against_brute_force(spark):
    rows = made_texts(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert got(line_runs.drop_repeated_lines(docs)) == brute(rows)


def test_odd_rows(spark, odd_docs):
    line = "one line in several odd rows"
    more = [(None, line), (None, line), (7, line), (7, line + "\n" + line), (200, "\n"), (201, line.upper() + " ")]
    extra = spark.createDataFrame(more, "doc_id long, text string")
    docs = odd_docs.unionByName(extra, allowMissingColumns=True).withColumn("n_lines", F.lit("x")).withColumn("gone", F.lit(1))
    out = line_runs.drop_repeated_lines(docs)
    assert got(out) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert {"gone", "score", "lang"} <= set(out.columns) and dict(out.dtypes)["n_lines"] == "bigint"


def test_no_rows(no_docs):
    assert line_runs.drop_repeated_lines(no_docs).collect() == []


def test_batches_in_any_order(spark):
    """The runs give the same decisions whatever order batches come in, and compaction loses nothing."""
    pairs = [(i, bytes([i * i % 23, 0])) for i in range(400)]
    want = defaultdict(list)
    for i, h in pairs:
        want[h].append(i)
    for order in (reversed(range(8)), (3, 7, 0, 5, 1, 6, 2, 4)):
        runs = line_runs.Runs(spark, fanout=2)
        for b in order:
            batch = [p for p in pairs if p[0] // 50 == b]
            runs.add(spark.createDataFrame(batch, "id long, h binary"), 1000)
        assert len(runs.levels) == 4 and all(len(level) < 2 for level in runs.levels)
        found = {bytes(r.h): (r.n, r.last) for r in runs.decisions().collect()}
        assert found.keys() == {h for h, ids in want.items() if len(ids) >= 3}
        assert all(3 <= n <= len(want[h]) and last == max(want[h]) for h, (n, last) in found.items())


def test_batches_merge_without_moving_runs(spark):
    runs = line_runs.Runs(spark, fanout=9)
    for b in range(2):
        runs.add(spark.createDataFrame([(b, b"k"), (b, bytes([b]))], "id long, h binary"), 1000)
    written = []
    runs.write = lambda rows: written.append(rows) or "none"
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        runs.add(spark.createDataFrame([(9, b"k")], "id long, h binary"), 1000)
        plan = written[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("SortMergeJoin") == 2

"""Operator 13 against a search over all edits, whole and in segments of any size, on odd rows."""

import hashlib
import heapq
import random
import re

import pytest
from pyspark.sql import functions as F

from vellumite.llm import turn_repair

BLANK = " \t\n\x0b\x0c\r"
EMPTY = hashlib.sha256(b"").hexdigest()


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(BLANK)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def searched(rows):
    """(cost, audit) by cheapest-first search over edits; the roles kept so far are the state."""
    found, done, todo = faults(rows), set(), [(0, "", 0, "")]
    while todo:
        cost, audit, at, last = heapq.heappop(todo)
        if (at, last) in done:
            continue
        done.add((at, last))
        if at == len(rows) and last in ("", "a"):
            return cost, audit
        allowed = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        for x in allowed:
            if x != "s":
                heapq.heappush(todo, (cost + 2, audit + "I", at, x))
        if at < len(rows):
            heapq.heappush(todo, (cost + 3, audit + "D", at + 1, last))
            if found[at] not in ("blank", "duplicate"):
                more, initial = int(found[at] == "truncated"), rows[at][1][:1]
                for x in allowed:
                    if x == initial:
                        heapq.heappush(todo, (cost + more, audit + "K", at + 1, x))
                    elif x != "s":
                        heapq.heappush(todo, (cost + 2 + more, audit + "R", at + 1, x))


def brute(conv, rows):
    """The result of one conversation; ``rows`` are (turn, role, text) with nulls as they are."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    found, initials, turns = faults(rows), [r[1][:1] for r in rows], [r[0] for r in rows if r[0] is not None]
    cost, audit = searched(rows)
    lines, at, last = [], iter(rows), ""
    for e in audit:
        _, role, text = next(at) if e != "I" else (0, "", "")
        if e != "D":
            role = role if e == "K" else "assistant" if last == "u" else "user"
            last = role[:1]
            lines.append(f"{role}:{text}")
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    wrong = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return conv, gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), wrong, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def made(rng, n):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "uncle", None, ""]
    texts = ["Yes.", "No!", "cut", "", " \t", "Why? ", "more.\n", None, *(f"text {i}." for i in range(20))]
    return [(rng.choice([None, *range(2 * n)]) if rng.random() < 0.1 else i, rng.choice(roles), rng.choice(texts)) for i in range(n)]


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_against_search(spark, most):
    rng = random.Random(13)
    talks = {i: made(rng, rng.randrange(1, 9)) for i in range(60)} | {100: made(rng, 150), 101: made(rng, 90), None: made(rng, 20)}
    rows = [(c, *r) for c, own in talks.items() for r in own]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = sorted((brute(c, own) for c, own in talks.items()), key=repr)
    assert got(turn_repair.repair(df, segment_rows=most)) == want


def test_audits_of_equal_cost(spark):
    """Runs of one role have many cheapest repairs; the least audit counts, across segments too."""
    talks = {i: [(t, r, f"{t}.") for t, r in enumerate(x)] for i, x in enumerate([["user"] * 9, ["assistant"] * 8, ["system"] * 7, ["user", "user", "assistant", "assistant"] * 5, ["tool"] * 6, ["assistant", "user"] * 6])}
    df = spark.createDataFrame([(c, *r) for c, own in talks.items() for r in own], "conv_id long, turn long, role string, text string")
    want = sorted((brute(c, own) for c, own in talks.items()), key=repr)
    for most in (1, 2, 5, 100):
        assert got(turn_repair.repair(df, segment_rows=most)) == want


def test_one_conversation_over_many_tasks(spark):
    rows = [(7, t, ("user", "assistant")[t % 2], "Fine." if t % 50 == 0 else f"text {t}.") for t in range(6000)]
    out = turn_repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(9), segment_rows=300).collect()
    assert len(out) == 1 and out[0].duplicate == 119 and out[0].cost == brute(7, [r[1:] for r in rows])[6]
    assert tuple(out[0]) == brute(7, [r[1:] for r in rows])


def test_copies_and_no_rows(spark):
    df = spark.createDataFrame([(1, 1, "user", "a.", 0), (2, 1, "user", "a.", 3), (2, 2, "assistant", "b.", 1), (3, None, None, None, 1)], "conv_id string, turn int, role string, text string, n int")
    out = {r.conv_id: tuple(r)[1:] for r in turn_repair.repair(df, copies="n").collect()}
    assert out["1"] == (0, 0, 0, 0, 0, 0, "", EMPTY)
    assert out["2"] == (0, 0, 2, 0, 2, 6, "KDDK", hashlib.sha256(b"user:a.\nassistant:b.").hexdigest())
    assert out["3"] == (0, 1, 0, 0, 0, 3, "D", EMPTY)
    assert turn_repair.repair(df.where("false"), copies="n").collect() == []


def test_damage(spark):
    from zlib import crc32

    rows = [(c, t, "assistant", "One. Two! Three? ok") for c in range(40) for t in range(8)] + [(None, None, None, None), (None, 3, None, "x.")]
    df = turn_repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    want = []
    for c, t, r, x in rows:
        kind = crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x, r = " " if x is None else x, " " if r is None else r
        want.append((c, t, "user" if kind == 4 else r, "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x, {0: 0, 3: 2}.get(kind, 1)))
    assert got(df) == sorted(want, key=repr)


def test_extra_columns_are_no_hindrance(spark):
    df = spark.createDataFrame([(1, 1, "user", "a.", 5, "x"), (1, 2, "assistant", "b.", 5, "x")], "conv_id long, turn long, role string, text string, id int, seg string")
    out = turn_repair.repair(df.withColumn("cost", F.lit(1)))
    assert [tuple(r)[:8] for r in out.collect()] == [(1, 0, 0, 0, 0, 0, 0, "KK")]

"""Closures of graphs with chains, rings, trees and loops against a plain walk."""

import random

from vellumite.operators import reach


def walked(edges, start):
    ways, out = {}, set()
    for a, b in edges:
        ways.setdefault(a, set()).add(b)
    for origin, node in start:
        todo, seen = [node], {node}
        while todo:
            for n in ways.get(todo.pop(), ()):
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        out |= {(origin, n) for n in seen}
    return out


def test_graphs_of_all_kinds(spark, monkeypatch):
    rng, edges, start = random.Random(8), set(), set()
    for base, kind in enumerate(["chain", "ring", "tree", "random", "random", "loops", "lasso"]):
        at = base * 1000
        if kind == "chain":
            edges |= {(at + i, at + i + 1) for i in range(200)} | {(at + 500, at + 100)}
        elif kind == "ring":
            edges |= {(at + i, at + (i + 1) % 37) for i in range(37)}
        elif kind == "tree":
            edges |= {(at + i // 2, at + i) for i in range(1, 60)}
        elif kind == "random":
            edges |= {(at + rng.randrange(40), at + rng.randrange(40)) for _ in range(50)}
        elif kind == "loops":
            edges |= {(at, at), (at, at + 1), (at + 1, at + 1), (at + 2, at + 3), (at + 3, at + 2)}
        else:
            edges |= {(at + i, at + i + 1) for i in range(60)} | {(at + 60, at + 20)}
        start |= {(base, at + rng.randrange(30)) for _ in range(3)} | {(100 + base, at)}
    start |= {(7, 5000), (7, 99999)}
    written = []
    stored = reach.stored
    monkeypatch.setattr(reach, "stored", lambda df, name: written.append(name) or stored(df, name))
    frame = lambda rows, ddl: spark.createDataFrame(sorted(rows), ddl)
    got = reach.closure(frame(edges, "src long, dst long"), frame(start, "origin int, node long"))
    assert sorted((r.origin, r.node) for r in got.collect()) == sorted(walked(edges, start))
    assert written.count("jumps") <= 20


def test_dead_ends_along_a_chain_take_no_rounds(spark, monkeypatch):
    edges = {(i, i + 1) for i in range(400)} | {(i, -i) for i in range(5, 400, 10)} | {(-15, -15), (-25, -1000), (-1000, -1001)}
    start, written = {(0, 0), (1, 200), (2, -25), (3, -35), (4, 9999)}, []
    stored = reach.stored
    monkeypatch.setattr(reach, "stored", lambda df, name: written.append(name) or stored(df, name))
    frame = lambda rows, ddl: spark.createDataFrame(sorted(rows), ddl)
    got = reach.closure(frame(edges, "src long, dst long"), frame(start, "origin int, node long"))
    assert sorted((r.origin, r.node) for r in got.collect()) == sorted(walked(edges, start))
    assert written.count("reach") <= 6

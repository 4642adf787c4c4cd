"""The latent space of operator 4 is fitted on every passage, those of very long texts too."""

import numpy as np

from vellumite.llm import decontaminate as D


def test_gram_over_all_passages(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(90)]
    texts = [" ".join(rng.choice(words, n)) for n in (0, 1, 31, 33, 64, 65, 97, *rng.integers(5, 400, 60), D.CHUNK + 150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    block = D.Block([(i, [w.encode() for w in rng.choice(words[:70], 20)], []) for i in range(12)])
    block.weigh(np.arange(len(block.words)), 200)
    held = [[w.encode() for w in t.split()] for t in texts] + [[block.words[i] for i in p] for _, p, _ in block.segments]
    rows = []
    for t in held:
        for a in range(0, max(1, len(t) - D.STEP) if t else 0, D.STEP):
            row = np.zeros(len(block.words))
            for w in t[a : a + D.WINDOW]:
                if w in block.terms:
                    row[block.terms[w]] += block.idf[block.terms[w]]
            rows.append(row / max(np.linalg.norm(row), 1e-9))
    matrix, basis = np.array(rows), rng.standard_normal((len(block.words), 7)).astype(np.float32)
    share = spark.sparkContext.broadcast
    coded = D.code(docs, share(block.terms))
    columns = share(np.array([*range(len(block.words)), -1], np.int32))
    got = D.gram_times(coded, share(block), columns, basis)
    assert np.allclose(got, matrix.T @ matrix @ basis, rtol=1e-3, atol=1e-2)


def test_no_texts_have_no_cells():
    for texts in ([], [np.zeros(0, np.int32)], [np.full(5, -1, np.int32)]):
        assert [len(x) for x in D.cells_of(texts, 5)[:3]] == [0, 0, 0]
        total = np.zeros((5, 2))
        D.add_gram(total, texts, np.ones(5, np.float32), np.ones((5, 2), np.float32))
        assert not total.any()


def test_windows_that_share_too_little_are_not_placed(monkeypatch):
    """Candidates are those of all windows compared in full; the latent space is worked out for windows that can be candidates only."""
    rng = np.random.default_rng(5)
    block = D.Block([(i, [b"w%d" % w for w in rng.choice(90, 24)], []) for i in range(20)])
    block.weigh(np.arange(len(block.words)), 300)
    texts = [rng.choice([*range(len(block.words)), *[-1] * 900], n).astype(np.int32) for n in rng.integers(0, 400, 40)]
    texts += [np.array(part, np.int32) for _, part, _ in block.segments[:6]]
    weighted = rng.standard_normal((len(block.words), 9)).astype(np.float32)
    goal, want, windows = D.unit(np.stack([weighted[part].sum(0) for _, part, _ in block.segments])), [], 0
    for i, t in enumerate(texts):
        for w in range(D.windows_of(len(t))):
            own = [x for x in t[w * D.STEP : w * D.STEP + D.WINDOW].tolist() if x >= 0]
            if not own:
                continue
            windows += 1
            cosines = goal @ D.unit(weighted[own].sum(0)[None, :])[0]
            for j, (_, part, _) in enumerate(block.segments):
                most = sum(part.count(x) for x in set(own))
                if most >= block.need_part[j] and (cosines[j] >= D.COSINE or most >= block.need_cover[j]):
                    want.append((i, w, j))
    placed, unit = [], D.unit
    monkeypatch.setattr(D, "unit", lambda rows: placed.append(len(rows)) or unit(rows))
    assert [c[:3] for c in D.search(texts, block, weighted, goal)] == want and len(want) >= 6
    assert sum(placed) < windows / 4


def test_short_and_long_numbers(spark):
    """Numbers of many terms take more bytes, and both are read as they were written."""
    docs = spark.createDataFrame([(1, "a Zz! b"), (2, None)], "doc_id long, text string")
    for terms, size in ((100, 2), ((1 << 15) + 7, 4)):
        known = {b"a": 0, b"zz": terms - 1} | {b"x%d" % i: i for i in range(1, terms - 1)}
        coded = D.code(docs, spark.sparkContext.broadcast(known))
        assert {r.doc_id: len(r.ids) for r in coded.collect()} == {1: 3 * size, 2: 0}
        assert {r.term: r.n for r in D.frequencies(coded, terms).collect()} == {-1: 2, 0: 1, terms - 1: 1}

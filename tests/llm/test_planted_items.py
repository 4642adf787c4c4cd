"""Verbatim copies of more than 1,000 benchmark items, and what the search for passages asks for."""

import math
import random

import numpy as np

from vellumite.llm import decontaminate


def test_verbatim_copies_of_many_items(spark):
    sf = "/root/testdata/sf0.01"
    rng, texts = random.Random(8), [t.split() for t in spark.read.parquet(f"{sf}/documents.parquet").where("n_chars > 600").orderBy("doc_id").toArrow()["text"].to_pylist()]
    items = [r.text.split() for r in spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").collect()]
    for _ in range(1000):
        own, n = rng.choice(texts), rng.randint(15, 60)
        at = rng.randrange(max(1, len(own) - n))
        items.append(own[at : at + n])
    docs = []
    for item in items:
        own = rng.choice(texts)
        at = rng.randrange(len(own))
        docs.append(" ".join(own[:at] + item + own[at:]))
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    planted = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(8)
    got = {r.doc_id for r in decontaminate.contaminated(planted, bench).where("doc_id = item_id").collect()}
    assert len(items) > 1000 and got == set(range(len(items)))


def plain_leaks(words, segments):
    """Items that a text leaks, from every window and segment."""
    found, D = set(), decontaminate
    for a in range(0, max(1, len(words) - D.STEP), D.STEP):
        window = words[a : a + D.WINDOW]
        for item, part, answer in segments:
            cover = D.lcs(window, part) / len(part)
            if cover >= D.COVER or cover >= D.PARAPHRASE and answer and D.lcs(window, answer) >= D.ANSWER * len(answer):
                found.add(item)
    return found


def test_paraphrases_against_brute_force(spark):
    """Items of common and rare words, told again with the answer and with rare or any words changed: the latent search against all windows."""
    rng = random.Random(21)
    common_words, items, docs = [f"c{i}" for i in range(60)], [], []
    for i in range(120):
        asked = [rng.choice(common_words) if k % 2 else f"r{rng.randrange(4000)}" for k in range(26)]
        items.append((i, asked, [f"a{rng.randrange(4000)}" for _ in range(4)]))
    for i, asked, answer in items:
        for k in range(4):
            if k < 2:  # all rare words changed
                said = [w if w[0] == "c" or rng.random() < 0.1 else f"r{rng.randrange(4000)}" for w in asked]
            else:
                said = [w if rng.random() > 0.42 else f"x{rng.randrange(4000)}" for w in asked]
            filler = lambda n: [rng.choice(common_words) if rng.random() < 0.5 else f"r{rng.randrange(4000)}" for _ in range(n)]
            docs.append((len(docs), " ".join([*filler(rng.randrange(80)), *said, *answer, *filler(100)])))
    docs += [(len(docs) + i, " ".join(rng.choice(common_words) if rng.random() < 0.5 else f"r{rng.randrange(4000)}" for _ in range(150))) for i in range(300)]
    bench = spark.createDataFrame([(i, " ".join(q) + "? " + " ".join(a)) for i, q, a in items], "item_id long, text string")
    got = {}
    for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), bench).collect():
        got.setdefault(r.doc_id, set()).add(r.item_id)
    segments = [s for i, q, a in items for s in decontaminate.segments_of(i, " ".join(q) + "? " + " ".join(a))]
    want = {d: f for d, t in docs if (f := plain_leaks(t.encode().split(), segments))}
    told = sum(len(f) for f in want.values())
    assert told > 150
    found = sum(len(f & got.get(d, set())) for d, f in want.items())
    assert found >= 0.95 * told, (found, told)
    assert all(f <= want.get(d, set()) for d, f in got.items())


def test_a_cover_is_always_a_candidate():
    rng = random.Random(2)
    for words in (["a", "b"], ["x"] * 20 + ["a", "b", "c", "d"], [f"w{i}" for i in range(32)], ["a"]):
        block = decontaminate.Block(decontaminate.segments_of(1, " ".join(words)))
        block.weigh(np.arange(1, len(block.terms) + 1), 100)
        part = block.segments[0][1]
        for _ in range(50):
            drop = rng.sample(range(len(part)), len(part) - math.ceil(0.7 * len(part) - 1e-9))
            ids = np.array([-1] * rng.randrange(5) + [t for i, t in enumerate(part) if i not in drop], np.int32)
            blind = np.zeros((len(block.terms), 2), np.float32)
            assert any(j == 0 for _, _, j, _ in decontaminate.search([ids], block, blind, np.zeros((len(block.segments), 2), np.float32)))


def test_windows_of_very_long_texts(spark, monkeypatch):
    """A text above the size of a chunk: copies at any place, at the seams too."""
    monkeypatch.setattr(decontaminate, "CHUNK", 256)
    rng = random.Random(5)
    item = [f"q{i}" for i in range(30)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    docs = []
    for at in range(0, 1300, 23):
        words = [f"f{rng.randrange(900)}" for _ in range(1300)]
        docs.append((at, " ".join(words[:at] + item + words[at:])))
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), bench).collect()
    assert {r.doc_id for r in got} == {d for d, _ in docs}
    for r in got:
        assert r["first"] - decontaminate.WINDOW < r.doc_id < r["first"] + decontaminate.WINDOW

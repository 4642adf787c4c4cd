"""The pipeline's stages, each held against brute force on its own input."""

from collections import Counter

import corpus_pipeline as P

from vellumite.llm import decontaminate as D
from vellumite.llm import mixing, similar


def shingles(text):
    return similar.shingle_set((text or "").encode().lower().split(), 5)


def grouped(texts):
    """Groups of ids linked by equal texts or a similarity of 0.8."""
    ids, sets, root = sorted(texts), {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by_shingle = {}
    for i in ids:
        for g in sets[i]:
            by_shingle.setdefault(g, []).append(i)
    for i in ids:
        near = Counter(j for g in sets[i] for j in by_shingle[g] if j < i)
        for j, n in near.items():
            if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n) and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in ids}


def leaky(text, segments):
    words = [w.strip(D.OUTER) for w in (text or "").encode().lower().split()]
    windows = [words[a : a + D.WINDOW] for a in range(0, max(1, len(words) - D.STEP), D.STEP)]
    return max((D.lcs(w, part) / len(part) for w in windows for _, part, _ in segments), default=0)


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, work in P.STAGES:
        work(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        kept.append(docs)
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    first, good, unique, clean, mixed = kept
    assert all(df.columns == first.columns for df in kept)
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    before, after = texts(good), texts(unique)
    assert 0 < len(before) < first.count()
    assert sorted(after) == sorted(set(grouped(before).values()))
    segments = [s for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() for s in D.segments_of(r.item_id, r.text)]
    held = texts(clean)
    for i, text in after.items():
        share = leaky(text, segments)
        assert (i not in held) if share >= D.COVER else (i in held or share >= D.PARAPHRASE)
    copies = Counter(r.doc_id for r in mixed.collect())
    assert copies == Counter({r.doc_id: r.copies for r in mixing.mix(clean).collect() if r.copies})
    assert Counter(r.doc_id for r in docs.collect()) == copies
    assert [r.start for r in docs.orderBy("start").collect()][0] == 0


def test_stages_on_odd_rows(spark, odd_docs, no_docs):
    sf = "/root/testdata/sf0.001"
    for docs in (odd_docs, no_docs):
        rows = docs.count()
        for _, work in P.STAGES[:-1]:
            out = work(spark, docs, sf)
            assert out.columns == docs.columns and out.count() <= 2 * rows
        assert P.STAGES[-1][1](spark, docs, sf).count() == rows

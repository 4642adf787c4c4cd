import hashlib
import random

import numpy as np
import xxhash
from helpers import duck, rows
from pyspark.sql import functions as F

from vellumite.llm import block_names, components, simhash, similar


def lower(text):
    return (text or "").encode().lower()


def exact_by_brute_force(docs):
    groups = {}
    for r in docs.collect():
        groups.setdefault(lower(r.text), []).append(r.doc_id)
    return sorted((repr(max((d for d in g if d is not None), default=None)), len(g), hashlib.sha256(t).hexdigest(), repr(d)) for t, g in groups.items() for d in g)


def exact_rows(df):
    return sorted((repr(r.keep_id), r.group_size, r.text_sha256, repr(r.doc_id)) for r in df.collect())


def test_block_names_against_brute_force(odd_docs):
    for how in ({}, {"block": 16}, {"block": 16, "hash_bits": 3}):  # many levels; many blocks behind each hash
        got = block_names.exact_groups(odd_docs, **how)
        assert exact_rows(got) == exact_by_brute_force(odd_docs)
        assert {tuple(r) for r in got.where("kept").groupBy("text_sha256").count().select("count").distinct().collect()} == {(1,)}


def test_block_names_sql(spark, sf):
    assert rows(block_names.op5_block_names(spark, sf)) == duck(block_names.ORACLES["op5_block_names"], sf)


def test_block_names_empty(no_docs):
    assert block_names.exact_groups(no_docs).count() == 0


def brute_fingerprint(text):
    words = lower(text).split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


def test_golay_code_is_perfect_and_keys_meet():
    golay, rng = simhash.Golay(), np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 300)
    for w in words:
        keys = set(golay.fuzzy(np.array([w]))[0].tolist())
        for i in range(23):
            for j in range(i):
                assert keys & set(golay.fuzzy(np.array([w ^ (1 << i) ^ (1 << j)]))[0].tolist()) if w % 40 == 0 else True
    assert len(set(golay.syndrome(np.array([0, *(1 << i for i in range(23))], np.int64)).tolist())) == 24
    assert (golay.error != 0).sum() == 2047


def test_links_against_brute_force(spark):
    rng = random.Random(2)
    values = {rng.getrandbits(64) for _ in range(40)}
    for v in list(values)[:12]:  # families: chains and clouds
        for _ in range(25):
            v ^= 1 << rng.randrange(64)
            v ^= (1 << rng.randrange(64)) if rng.random() < 0.5 else 0
            values.add(v)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    want = {}
    for v, r in zip(signed, brute_components(values), strict=True):
        want.setdefault(r, set()).add(v)
    want = {frozenset(g) for g in want.values() if len(g) > 1}
    for bucket in (1000, 24, 2):  # pairs only, both ways, midpoints mostly
        got = {}
        for r in components.connected_components(simhash.links(fps, bucket=bucket)).collect():
            got.setdefault(r.root, {r.root}).add(r.node)
        assert {frozenset(g) for g in got.values()} == want


def test_simhash_against_brute_force(odd_docs):
    docs = odd_docs.collect()
    values = [brute_fingerprint(r.text) for r in docs]
    roots = brute_components(values)
    least = {}
    for r, root in zip(docs, roots, strict=True):
        if r.doc_id is not None:
            least[root] = min(least.get(root, r.doc_id), r.doc_id)
    want = sorted((repr(r.doc_id), f"{v:016x}", repr(least.get(root))) for r, v, root in zip(docs, values, roots, strict=True))
    got = simhash.near_duplicates(odd_docs)
    assert sorted((repr(r.doc_id), r.fingerprint, repr(r.component_id)) for r in got.collect()) == want


def test_simhash_empty(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0


def jaccard(a, b):
    x, y = (similar.shingle_set(lower(t).split(), 5) for t in (a, b))
    return len(x & y) / len(x | y)


def near_copies(spark, families=6, copies=12):
    rng, rows = random.Random(9), []
    for f in range(families):
        words = [f"u{rng.randrange(3000)}" for _ in range(200)]
        for _ in range(copies):
            own = list(words)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(200)] = "edit"
            rows.append((len(rows), " ".join(own), f"f{f}"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_similar_documents(spark):
    docs = near_copies(spark)
    kept = similar.without_near_duplicates(docs).collect()
    assert sorted(r.lang for r in kept) == [f"f{i}" for i in range(6)]
    assert [r.doc_id for r in sorted(kept, key=lambda r: r.doc_id)] == [0, 12, 24, 36, 48, 60]


def test_similar_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(similar.candidates, "__defaults__", (2, similar.FAR))
    docs = near_copies(spark, 3, 30)
    assert similar.without_near_duplicates(docs).count() == 3


def test_similar_leaves_others_alone(odd_docs):
    kept = similar.without_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    texts = [(r.text or "") for r in odd_docs.collect()]
    got = [(r.text or "") for r in kept.collect()]
    assert len(set(got)) == len(got)
    for t in texts:  # each text is there, or one like it
        assert any(t == g or jaccard(t, g) >= 0.8 for g in got)
    for i, a in enumerate(got):
        assert not any(jaccard(a, b) >= 0.8 for b in got[:i])


def test_similar_empty(no_docs):
    assert similar.without_near_duplicates(no_docs).count() == 0


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)]
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long")).groupBy("root").agg(F.count("node").alias("n")).collect()
    assert {(r.root, r.n) for r in got} == {(0, 300), (1000, 199)}

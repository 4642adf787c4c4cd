import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vellumite.llm import common, token_files as T

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def test_chunks_give_what_the_library_gives(plain):
    rng, encoder = random.Random(3), T.encoder(PATH, 2)
    assert encoder.byte_level
    bits = ["a", "B", "é", " ", " ", "  ", "\n", "\t", ".", ",", "'s", "'", "1", "23", "%%%", "don't", "　", "\x1c", "中", "🙂", "!?", "́", "ª", "Ⅷ", "<|endoftext|>"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    for lo in range(0, len(texts), 100):
        part = texts[lo : lo + 100]
        assert encoder.encode(part) == [np.array(e.ids, "<u2").tobytes() for e in plain.encode_batch(part, add_special_tokens=False)]


def test_special_tokens_by_default_and_as_text(plain):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y z", "<|endoftext|"]
    assert [np.frombuffer(b, "<u2").tolist() for b in T.encoder(PATH, 2).encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert 50256 in plain.encode(texts[0], add_special_tokens=False).ids
    other = Tokenizer.from_file(PATH)
    other.encode_special_tokens = True
    assert [np.frombuffer(b, "<u2").tolist() for b in T.encoder(PATH, 2, True).encode(texts)] == [other.encode(t, add_special_tokens=False).ids for t in texts]


def test_runs_by_rows_and_bytes(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(T, "RUN_ROWS", 3)
    monkeypatch.setattr(T, "RUN_BYTES", 10)
    assert list(T.runs(pa.array(["a"] * 7))) == [(0, 3), (3, 6), (6, 7)]
    assert list(T.runs(pa.array(["x" * 30, "a", None, "b" * 10, "c"]))) == [(0, 1), (1, 3), (3, 4), (4, 5)]
    assert list(T.runs(pa.array([], pa.string()))) == []


def test_equal_rows_are_dealt_over_shards(spark):
    docs = spark.range(0, 4000, 1, 4).selectExpr("if(id % 3 > 0, 7L, id) as doc_id", "'same text' as text")
    folder = common.new_folder(spark, "t")
    sizes = [r.n_docs for r in T.write_token_files(docs, folder, PATH).collect()]
    assert len(sizes) > 2 and max(sizes) < 2600 and sum(sizes) == 4000


def test_files_against_brute_force(spark, odd_docs, plain):
    folder = common.new_folder(spark, "t")
    manifest = T.write_token_files(odd_docs, folder, PATH)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in T.read_token_files(spark, folder).collect())
    rows = [(r.doc_id, r.text or "") for r in odd_docs.collect()]
    coded = {t: plain.encode(t, add_special_tokens=False).ids + [2] for _, t in rows}
    assert [g[1] for g in got] == sorted([d for d, _ in rows], key=lambda d: (d is not None, d))
    assert [g[0] for g in got] == np.cumsum([0] + [g[2] for g in got])[:-1].tolist()
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted((g[1] is not None, g[1] or 0, g[2], g[3]) for g in got) == sorted((d is not None, d or 0, len(coded[t]), crc(coded[t])) for d, t in rows)
    assert manifest.agg({"n_tokens": "sum"}).first()[0] == sum(g[2] for g in got)


def test_bytes_are_read_where_no_path_can_be_mapped(spark, odd_docs):
    folder = common.new_folder(spark, "t")
    T.write_token_files(odd_docs, folder, PATH)
    key = lambda df: sorted(map(repr, df.collect()))
    mapped = key(T.read_token_files(spark, folder))
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.t.link./in", folder)
    assert key(T.read_token_files(spark, "viewfs://t/in")) == mapped


def test_empty(spark, no_docs):
    folder = common.new_folder(spark, "t")
    T.write_token_files(no_docs, folder, PATH)
    assert T.read_token_files(spark, folder).count() == 0

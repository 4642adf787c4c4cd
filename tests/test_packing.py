"""Streams packed in parts unpack to what they were, whatever the parts."""

import random
import zlib

import pytest

from vellumite.operators import compress


def test_sums_of_parts():
    rng = random.Random(6)
    for _ in range(50):
        parts = [rng.randbytes(rng.randrange(0, 3000)) for _ in range(rng.randrange(1, 6))]
        assert compress.adler_of([(zlib.adler32(p), len(p)) for p in parts]) == zlib.adler32(b"".join(parts))


@pytest.mark.parametrize("part", [1, 100, 4096, 1 << 20])
def test_parts_are_one_stream(part):
    data = bytes(random.Random(part).choices(b"abcd ", k=9000))[: 9000 if part > 1 else 50]
    cut = [data[i : i + part] for i in range(0, len(data), part)]
    body = b"".join(compress.deflated(c, i == len(cut) - 1) for i, c in enumerate(cut))
    assert zlib.decompress(compress.ZLIB_HEAD + body + zlib.adler32(data).to_bytes(4, "big")) == data


def test_long_payloads_over_many_tasks(spark):
    rng = random.Random(7)
    data = {1: b"text of a page " * 20_000, 2: rng.randbytes(50_000), 3: b"a" * 10_001, 4: bytes(rng.choices(b"0123456789\n", k=70_000))}
    rows = spark.createDataFrame([(i, 1, bytearray(d)) for i, d in data.items()], "doc_id long, obj long, payload binary")
    got = {r.doc_id: bytes(r.payload) for r in compress.pack_large(rows, 10_000).collect()}
    assert got.keys() == {1, 3, 4} and all(zlib.decompress(v) == data[i] and len(v) < len(data[i]) for i, v in got.items())

"""Row filters and fields of structural streams against the formulas, byte by byte."""

import random

import pytest

from vellumite.config import LIMITS
from vellumite.sources import syntax as S
from vellumite.sources import tables


def plain(data, columns, colors):
    """The filters as the PNG specification has them."""
    width, above, out = columns * colors, [0] * (columns * colors), []
    for at in range(0, len(data), width + 1):
        kind, row = data[at], []
        for i, v in enumerate(data[at + 1 : at + 1 + width]):
            a, b, c = (row[i - colors] if i >= colors else 0), above[i], (above[i - colors] if i >= colors else 0)
            p = a + b - c
            pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
            paeth = a if pa <= pb and pa <= pc else b if pb <= pc else c
            row.append((v + [0, a, b, (a + b) // 2, paeth][kind]) % 256)
        above = row
        out += row
    return bytes(out)


@pytest.mark.parametrize(("columns", "colors"), [(1, 1), (7, 1), (3, 4), (23, 1), (24, 1), (40, 3), (200, 2)])
@pytest.mark.parametrize("kinds", [(0,), (1,), (2,), (3,), (4,), (3, 4), (0, 1, 2, 3, 4)])
def test_filters(columns, colors, kinds):
    rng = random.Random(columns * 10 + colors)
    data = b"".join(bytes([rng.choice(kinds)]) + rng.randbytes(columns * colors) for _ in range(rng.randrange(1, 60)))
    assert S.unpredict(data, columns, colors) == plain(data, columns, colors)


def test_no_rows_and_bad_rows():
    assert S.unpredict(b"", 5) == b""
    for data in (b"\x00123", b"\x0512345"):
        with pytest.raises(S.Bad):
            S.unpredict(data, 5)


@pytest.mark.parametrize("widths", [[1, 4, 2], [0, 2, 0], [1, 8, 8], [2, 1, 3], [1, 3, 1]])
def test_fields(widths):
    rng = random.Random(sum(widths))
    rows = [(rng.randrange(3), rng.randrange(min(1 << 8 * widths[1], 1 << 62)), rng.randrange(min(1 << 8 * widths[2], 60000))) for _ in range(50)]
    rows = [(k if widths[0] else 1, b, c if widths[2] else 0) for k, b, c in rows]
    data = b"".join(v.to_bytes(w, "big") for r in rows for v, w in zip(r, widths, strict=True) if w)
    stream = S.Stream({S.Name("W"): widths, S.Name("Size"): 50}, data)
    entries, _ = tables.from_stream(stream, [1 << 20], 0, LIMITS)
    want = [(i, 0, i, c if k == 1 else 0, {1: "used", 2: "packed", 0: "free"}[k], b if k == 1 else None, b if k == 2 else None, c if k == 2 else None) for i, (k, b, c) in enumerate(rows)]
    assert entries == want


def test_fields_out_of_range():
    for row in (b"\x01" + b"\xff" * 8 + b"\x00", b"\x01" + bytes(8) + b"\xff"):
        stream = S.Stream({S.Name("W"): [1, 8, len(row) - 9], S.Name("Size"): 1}, row)
        if row[1] == 255:
            with pytest.raises(S.Bad):
                tables.from_stream(stream, [1 << 20], 0, LIMITS)
        else:
            assert tables.from_stream(stream, [1 << 20], 0, LIMITS)[0][0][3] == 255

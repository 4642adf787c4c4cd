"""The codec against itself and against plain arithmetic; files of other kinds."""

import numpy as np
import pytest

from vellumite.functions import jpeg_codec as J


def picture(height, width, colours, seed=0):
    y, x = np.mgrid[:height, :width]
    rng = np.random.default_rng(seed)
    planes = [128 + 90 * np.sin(x / (7 + 3 * c)) * np.cos(y / (5 + c)) + rng.normal(0, 4, (height, width)) for c in range(colours)]
    return np.clip(np.stack(planes, -1), 0, 255).astype(np.uint8)


@pytest.mark.parametrize("shape", [(64, 64), (1, 1), (17, 33), (8, 120), (90, 5)])
@pytest.mark.parametrize("colours", [1, 3])
def test_round_trip(shape, colours):
    image = picture(*shape, colours)
    back = J.decode(J.encode(image, 0.95))
    assert back.shape == image.shape
    smooth = J.scaled(image, max(1, shape[1] // 4), max(1, shape[0] // 4)).astype(int)
    assert np.abs(J.scaled(back, max(1, shape[1] // 4), max(1, shape[0] // 4)).astype(int) - smooth).mean() < (3 if colours == 1 else 12)
    if colours == 1:
        assert np.abs(back.astype(int) - image).mean() < 3


def test_quality_and_flat_images():
    image = picture(96, 128, 3)
    sizes = [len(J.encode(image, q)) for q in (0.9, 0.8, 0.6, 0.42, 0.05)]
    assert sizes == sorted(sizes, reverse=True)
    flat = np.full((40, 40, 3), 77, np.uint8)
    assert np.abs(J.decode(J.encode(flat, 0.8)).astype(int) - 77).max() <= 2


def test_transform_against_the_definition():
    block = np.random.default_rng(3).integers(0, 255, (1, 1, 8, 8))
    got = J.coefficients(block, np.ones(64))[0, 0]
    x = np.arange(8)
    for place, (v, u) in zip(got, [divmod(z, 8) for z in J.ZIGZAG.tolist()], strict=True):
        scale = (np.sqrt(0.5) if u == 0 else 1) * (np.sqrt(0.5) if v == 0 else 1) / 4
        want = scale * sum((block[0, 0, y, x] - 128) @ (np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16)) for y in range(8))
        assert abs(want - place) <= 0.51
    assert J.ZIGZAG[:6].tolist() == [0, 1, 8, 16, 9, 2] and J.ZIGZAG[-1] == 63


def test_codes_are_prefix_free_and_short():
    rng = np.random.default_rng(1)
    for counts in (np.r_[5, np.zeros(255, int)], (2.0 ** np.arange(40)).astype(int), rng.integers(0, 1000, 256)):
        counts = np.resize(np.r_[counts, np.zeros(256, int)], 256)
        sizes, symbols = J.code_lengths(counts)
        assert len(sizes) == 16 and sum(sizes) == len(symbols) == (counts > 0).sum()
        value, length = J.codes(sizes, symbols)
        words = [format(value[s], f"0{length[s]}b") for s in symbols]
        assert not any(a != b and b.startswith(a) for a in words for b in words) and "1" * 16 not in words
        table = J.lookup(bytes(sizes), bytes(symbols))
        assert all(table[int(w.ljust(16, "0"), 2)] == (len(w), s) for w, s in zip(words, symbols, strict=True))


def test_restart_intervals_and_whole_colours():
    image = picture(32, 48, 1)
    data = J.encode(image, 0.9)
    assert J.decode(data) is not None
    cut = data.index(b"\xff\xda")
    stale = data[:cut] + J.marked(0xDD, (6).to_bytes(2, "big")) + data[cut:]
    assert J.decode(stale) is None or J.decode(stale).shape == image.shape


def test_other_kinds_are_left():
    good = J.encode(picture(32, 32, 3), 0.9)
    assert J.decode(b"") is None and J.decode(good[:30]) is None and J.decode(b"\xff\xd8 no marker") is None
    assert J.decode(good.replace(b"\xff\xc0", b"\xff\xc2")) is None
    assert J.decode(b"\xff\xd8" + b"\xff\xda\x00\x08" + bytes(6) + b"s" * 73 + b"\xff\xd9") is None


def test_chroma():
    gray = np.repeat(picture(40, 40, 1), 3, -1)
    assert J.average_chroma(gray) == 0 and J.average_chroma(picture(40, 40, 3)) > 12

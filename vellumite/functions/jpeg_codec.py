"""A small JPEG codec on numpy arrays: sequential Huffman images of 8 bits, gray or three components.

Decoding walks the bits of one scan in Python; transforms, scaling, colours and
encoding are array operations. What is not understood (progressive, arithmetic,
CMYK, damaged) decodes to None, and the caller leaves such an image as it is.
"""

from __future__ import annotations

import heapq

import numpy as np

#: Quantisation tables of the standard's annex K, for quality 50.
LUMA = "16 11 10 16 24 40 51 61 12 12 14 19 26 58 60 55 14 13 16 24 40 57 69 56 14 17 22 29 51 87 80 62 18 22 37 56 68 109 103 77 24 35 55 64 81 104 113 92 49 64 78 87 103 121 120 101 72 92 95 98 112 100 103 99"
CHROMA = "17 18 24 47 99 99 99 99 18 21 26 66 99 99 99 99 24 26 56 99 99 99 99 99 47 66 99 99 99 99 99 99" + " 99" * 32

MAX_PIXELS = 1 << 26
#: Place in a block of each coefficient as files have them: along the diagonals, up and down in turn.
ZIGZAG = np.array([8 * y + x for y, x in sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))])
COSINES = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)], np.float32)


class Scan:
    """The bits of an entropy-coded segment."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.bits = data + b"\x00" * 8, 0, 0, 0

    def peek16(self) -> int:
        while self.bits < 16:
            self.held = (self.held << 32 | int.from_bytes(self.data[self.at : self.at + 4].ljust(4, b"\x00"), "big")) & (1 << 80) - 1
            self.at += 4
            self.bits += 32
        return self.held >> (self.bits - 16) & 0xFFFF

    def take(self, n: int) -> int:
        self.peek16()
        self.bits -= n
        return self.held >> self.bits & (1 << n) - 1


def lookup(counts: bytes, symbols: bytes) -> list[tuple[int, int]]:
    """(code length, symbol) for each 16 bits that may follow; length 0: no code."""
    table, code, at = [(0, 0)] * 65536, 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            span = 1 << 16 - length
            table[code << 16 - length : (code << 16 - length) + span] = [(length, symbols[at])] * span
            code, at = code + 1, at + 1
        code <<= 1
    return table


def extended(value: int, size: int) -> int:
    return value if value >= 1 << size - 1 else value - (1 << size) + 1


def read_block(scan: Scan, dc: list, ac: list, before: int, out: np.ndarray) -> int:
    """Fill ``out`` (64, in file order); returns the block's DC value."""
    length, size = dc[scan.peek16()]
    if not length:
        raise ValueError("no code")
    scan.bits -= length
    out[0] = before = before + (extended(scan.take(size), size) if size else 0)
    k = 1
    while k < 64:
        length, symbol = ac[scan.peek16()]
        if not length:
            raise ValueError("no code")
        scan.bits -= length
        run, size = symbol >> 4, symbol & 15
        if size:
            k += run
            out[k] = extended(scan.take(size), size)
            k += 1
        elif run == 15:
            k += 16
        else:
            break
    return before


def segments(data: bytes) -> tuple[list[tuple[int, bytes]], bytes]:
    """(marker, body) of the segments up to the scan, and the bytes from there."""
    at, out = 2, []
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("no marker")
        if data[at + 1] == 0xFF:
            at += 1
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        out.append((data[at + 1], data[at + 4 : at + 2 + size]))
        at += 2 + size
        if out[-1][0] == 0xDA:
            return out, data[at:]
    raise ValueError("no scan")


def restarts(coded: bytes) -> list[bytes]:
    """The scan cut at its restart marks, without stuffed bytes."""
    out, at, start = [], 0, 0
    while (at := coded.find(b"\xff", at)) >= 0 and at + 1 < len(coded):
        mark = coded[at + 1]
        if 0xD0 <= mark <= 0xD7:
            out.append(coded[start:at])
            start = at + 2
        elif mark not in (0, 0xFF):
            break
        at += 2 if mark != 0xFF else 1
    else:
        at = len(coded)
    out.append(coded[start:at])
    return [p.replace(b"\xff\x00", b"\xff") for p in out]


def decode(data: bytes) -> np.ndarray | None:
    """(height, width, 1 or 3) samples, gray or RGB; None where the image is of another kind or damaged."""
    try:
        return decoded(bytes(data))
    except (ValueError, IndexError, KeyError):
        return None


def decoded(data: bytes) -> np.ndarray | None:
    if data[:2] != b"\xff\xd8":
        return None
    parts, coded = segments(data)
    quant, tables, frame, interval, transform = {}, {}, None, 0, None
    for marker, body in parts:
        if marker == 0xDB:
            at = 0
            while at < len(body):
                wide, name = body[at] >> 4, body[at] & 15
                n = 128 if wide else 64
                quant[name] = np.frombuffer(body[at + 1 : at + 1 + n], ">u2" if wide else "u1").astype(np.float32)
                at += 1 + n
        elif marker == 0xC4:
            at = 0
            while at < len(body):
                counts = body[at + 1 : at + 17]
                n = sum(counts)
                tables[body[at]] = lookup(counts, body[at + 17 : at + 17 + n])
                at += 17 + n
        elif marker in (0xC0, 0xC1):
            frame = body
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8:
            return None
        elif marker == 0xDD:
            interval = int.from_bytes(body[:2], "big")
        elif marker == 0xEE and body[:5] == b"Adobe":
            transform = body[11]
    if frame is None or frame[0] != 8 or frame[5] not in (1, 3) or parts[-1][1][0] != frame[5]:
        return None
    height, width, n = int.from_bytes(frame[1:3], "big"), int.from_bytes(frame[3:5], "big"), frame[5]
    if not 0 < height * width <= MAX_PIXELS:
        return None
    comps = [(frame[6 + 3 * i], frame[7 + 3 * i] >> 4, frame[7 + 3 * i] & 15, frame[8 + 3 * i]) for i in range(n)]
    used = {parts[-1][1][1 + 2 * i]: parts[-1][1][2 + 2 * i] for i in range(n)}
    if n == 1:
        comps = [(comps[0][0], 1, 1, comps[0][3])]
    most_h, most_v = max(c[1] for c in comps), max(c[2] for c in comps)
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    blocks = [np.zeros((down * v, across * h, 64), np.int32) for _, h, v, _ in comps]
    coders = [(tables[used[c] >> 4], tables[0x10 | used[c] & 15]) for c, *_ in comps]
    runs, scan, before = iter(restarts(coded)), None, []
    for mcu in range(across * down):
        if scan is None or interval and mcu % interval == 0:
            scan, before = Scan(next(runs, b"")), [0] * n
        row, column = divmod(mcu, across)
        for i, (_, h, v, _) in enumerate(comps):
            dc, ac = coders[i]
            for y in range(v):
                for x in range(h):
                    before[i] = read_block(scan, dc, ac, before[i], blocks[i][row * v + y, column * h + x])
        if scan.at - 16 > len(scan.data):
            return None
    planes = []
    for (_, h, v, q), held in zip(comps, blocks, strict=True):
        flat = np.zeros(held.shape, np.float32)
        flat[..., ZIGZAG] = held * quant[q]
        square = COSINES.T @ flat.reshape(*held.shape[:2], 8, 8) @ COSINES + 128
        plane = square.transpose(0, 2, 1, 3).reshape(held.shape[0] * 8, held.shape[1] * 8)
        plane = np.repeat(np.repeat(plane, most_v // v, 0), most_h // h, 1)
        planes.append(plane[:height, :width])
    if n == 3 and transform != 0:
        y, b, r = planes[0], planes[1] - 128, planes[2] - 128
        planes = [y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b]
    return np.clip(np.rint(np.stack(planes, -1)), 0, 255).astype(np.uint8)


def scaled(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """``image`` at another size: each sample the mean of the area it covers, or between its neighbours where the image grows."""

    def weights(old: int, new: int) -> np.ndarray:
        edges = np.linspace(0, old, new + 1)
        low, high = edges[:-1, None], edges[1:, None]
        cells = np.arange(old)[None, :]
        share = np.clip(np.minimum(high, cells + 1) - np.maximum(low, cells), 0, None)
        return (share / share.sum(1, keepdims=True)).astype(np.float32)

    if image.shape[:2] == (height, width):
        return image
    rows, columns = weights(image.shape[0], height), weights(image.shape[1], width)
    out = np.stack([rows @ image[..., c].astype(np.float32) @ columns.T for c in range(image.shape[2])], -1)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def average_chroma(image: np.ndarray) -> float:
    """Mean of the differences between the colours, on a thumbnail of 16 by 16."""
    r, g, b = np.moveaxis(scaled(image, 16, 16).astype(int), -1, 0)
    return float((abs(r - g) + abs(g - b) + abs(r - b)).mean())


def code_lengths(counts: np.ndarray) -> tuple[list[int], list[int]]:
    """Numbers of codes of 1 .. 16 bits, and symbols in order of their codes, for symbols that occur ``counts`` times."""
    used = np.nonzero(counts)[0].tolist()
    heap = [(int(counts[s]), i, [s]) for i, s in enumerate(used)] + [(0, len(used), [-1])]  # -1: no symbol has a code of ones alone
    depth, n = dict.fromkeys([*used, -1], 0), len(heap)
    heapq.heapify(heap)
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        for s in (*x, *y):
            depth[s] += 1
        heapq.heappush(heap, (a + b, n, x + y))
        n += 1
    sizes = np.bincount(list(depth.values()), minlength=64).tolist()
    for length in range(len(sizes) - 1, 16, -1):  # shorten codes above 16 bits in pairs
        while sizes[length]:
            shorter = next(i for i in range(length - 2, 0, -1) if sizes[i])
            sizes[length] -= 2
            sizes[length - 1] += 1
            sizes[shorter + 1] += 2
            sizes[shorter] -= 1
    longest = max(i for i, c in enumerate(sizes) if c)
    sizes[longest] -= 1
    return sizes[1:17], sorted(used, key=lambda s: (depth[s], -counts[s], s))


def codes(sizes: list[int], symbols: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Code and its length by symbol."""
    code, at, value, length = 0, 0, np.zeros(256, np.int64), np.zeros(256, np.int64)
    for bits, n in enumerate(sizes, 1):
        for s in symbols[at : at + n]:
            value[s], length[s] = code, bits
            code += 1
        at, code = at + n, code << 1
    return value, length


def bit_sizes(values: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(np.abs(values) + 1)).astype(np.int64)


def events(blocks: np.ndarray, kinds: np.ndarray, comps: np.ndarray) -> tuple[np.ndarray, ...]:
    """(table, symbol, value) of all codes of ``blocks`` (n, 64) in the order of the scan. Tables: 0, 1 DC and 2, 3 AC of luma, chroma."""
    n = len(blocks)
    diffs = np.zeros(n, np.int64)
    for c in np.unique(comps):
        own = blocks[comps == c, 0].astype(np.int64)
        diffs[comps == c] = np.diff(own, prepend=0)
    b, k = np.nonzero(blocks[:, 1:])
    k = k + 1
    value = blocks[b, k].astype(np.int64)
    same = np.r_[False, b[1:] == b[:-1]]
    run = k - np.where(same, np.r_[0, k[:-1]], 0) - 1
    zeros = run >> 4
    last = np.zeros(n, np.int64)
    np.maximum.at(last, b, k)
    ends = np.nonzero(last < 63)[0]
    order = np.concatenate([np.arange(n) * 256, np.repeat(b * 256 + k * 2, zeros), b * 256 + k * 2 + 1, ends * 256 + 255])
    symbol = np.concatenate([bit_sizes(diffs), np.full(zeros.sum(), 0xF0), (run & 15) << 4 | bit_sizes(value), np.zeros(len(ends), np.int64)])
    values = np.concatenate([diffs, np.zeros(zeros.sum(), np.int64), value, np.zeros(len(ends), np.int64)])
    table = np.concatenate([kinds, 2 + kinds[np.repeat(b, zeros)], 2 + kinds[b], 2 + kinds[ends]])
    turn = np.argsort(order, kind="stable")
    return table[turn], symbol[turn], values[turn]


def packed_bits(value: np.ndarray, length: np.ndarray) -> bytes:
    """Codes of up to 32 bits put end to end, filled up with ones."""
    out = []
    for lo in range(0, len(value), 1 << 18):
        v, n = value[lo : lo + (1 << 18), None], length[lo : lo + (1 << 18), None]
        place = n - 1 - np.arange(32)[None, :]
        out.append(((v >> np.maximum(place, 0)) & 1)[place >= 0].astype(np.uint8))
    bits = np.concatenate(out)
    return np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes()


def tiles(plane: np.ndarray, high: int, wide: int) -> np.ndarray:
    """Blocks of 8 by 8 of a plane that is filled up by its edge to whole units of ``high`` by ``wide`` samples."""
    plane = np.pad(plane, ((0, -plane.shape[0] % high), (0, -plane.shape[1] % wide)), mode="edge")
    return plane.reshape(plane.shape[0] // 8, 8, plane.shape[1] // 8, 8).transpose(0, 2, 1, 3)


def coefficients(blocks: np.ndarray, quant: np.ndarray) -> np.ndarray:
    flat = (COSINES @ (blocks.astype(np.float32) - 128) @ COSINES.T).reshape(*blocks.shape[:2], 64)
    return np.rint(flat[..., ZIGZAG] / quant).astype(np.int32)


def encode(image: np.ndarray, quality: float) -> bytes:
    """A sequential JPEG of (height, width, 1 or 3) samples; colours at half the size, codes made for the image."""
    q = min(max(quality, 0.05), 1.0) * 100
    factor = 5000 / q if q < 50 else 200 - 2 * q
    quant = [np.clip(np.floor((np.array(t.split(), float) * factor + 50) / 100), 1, 255)[ZIGZAG] for t in (LUMA, CHROMA)]
    height, width, n = image.shape
    if n == 1:
        blocks = coefficients(tiles(image[..., 0], 8, 8), quant[0]).reshape(-1, 64)
        kinds = comps = np.zeros(len(blocks), np.int64)
    else:
        r, g, b = np.moveaxis(image.astype(np.float32), -1, 0)
        y = 0.299 * r + 0.587 * g + 0.114 * b
        half = lambda p: np.pad(p, ((0, height % 2), (0, width % 2)), mode="edge").reshape(-(-height // 2), 2, -(-width // 2), 2).mean((1, 3))
        luma = coefficients(tiles(y, 16, 16), quant[0])
        luma = luma.reshape(luma.shape[0] // 2, 2, luma.shape[1] // 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 4, 64)
        small = [coefficients(tiles(half(p), 8, 8), quant[1]).reshape(-1, 1, 64) for p in (128 + 0.564 * (b - y), 128 + 0.713 * (r - y))]
        blocks = np.concatenate([luma, *small], 1).reshape(-1, 64)
        comps = np.tile([0, 0, 0, 0, 1, 2], len(luma))
        kinds = (comps > 0).astype(np.int64)
    table, symbol, value = events(blocks, kinds, comps)
    code, length, heads = np.zeros(len(table), np.int64), np.zeros(len(table), np.int64), []
    for t in range(4) if n == 3 else (0, 2):
        at = table == t
        sizes, symbols = code_lengths(np.bincount(symbol[at], minlength=256))
        by_symbol = codes(sizes, symbols)
        code[at], length[at] = by_symbol[0][symbol[at]], by_symbol[1][symbol[at]]
        heads.append(marked(0xC4, bytes([(t >> 1) << 4 | t & 1, *sizes, *symbols])))
    extra = np.where(table < 2, symbol, symbol & 15)
    low = np.where(value < 0, value + (1 << extra) - 1, value)
    coded = packed_bits(code << extra | low, length + extra).replace(b"\xff", b"\xff\x00")
    frame = bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + (bytes([1, 1, 0x11, 0]) if n == 1 else bytes([3, 1, 0x22, 0, 2, 0x11, 1, 3, 0x11, 1]))
    start = bytes([1, 1, 0x00, 0, 63, 0]) if n == 1 else bytes([3, 1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0])
    tables = b"".join(marked(0xDB, bytes([i]) + quant[i].astype(np.uint8).tobytes()) for i in range(1 if n == 1 else 2))
    return b"\xff\xd8" + tables + marked(0xC0, frame) + b"".join(heads) + marked(0xDA, start) + coded + b"\xff\xd9"


def marked(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body

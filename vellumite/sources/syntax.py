"""The syntax of PDF values: a lexer, a reader and a writer of single values.

Small helpers for the tasks of :mod:`tables` and :mod:`write`; the work on whole
documents is done there, in DataFrames. Values are None, bool, int, float, bytes
(literal strings), :class:`Hex`, :class:`Name`, :class:`Ref`, list, dict and
:class:`Stream`.
"""

from __future__ import annotations

import re
import zlib
from decimal import Decimal
from functools import lru_cache
from typing import NamedTuple

import numpy as np


class Bad(Exception):
    """Damaged or unsupported input; the message says what."""

    def __init__(self, reason: str, code: str = "corrupt"):
        super().__init__(reason)
        self.code = code


class Name(str):
    """A name, one character (U+0000 - U+00FF) a byte."""


class Hex(bytes):
    """A string written in hexadecimal."""


class Ref(NamedTuple):
    obj: int
    gen: int


class Stream(NamedTuple):
    dict: dict
    data: bytes


SPACE = rb"\x00\t\n\x0c\r "
SKIP = re.compile(rb"(?:[" + SPACE + rb"]|%[^\r\n]*)*")
#: What is skipped belongs to a token's match; it is not tried again shorter, so the text of a comment is never a token.
TOKEN = re.compile(rb"[" + SPACE + rb"]*+(?:%[^\r\n]*+[" + SPACE + rb"]*+)*+(?:(?P<ref>\d+[" + SPACE + rb"]+\d+[" + SPACE + rb"]+R(?![^\x00\t\n\x0c\r ()<>\[\]{}/%]))|(?P<num>[+-]?(?:\d+\.?\d*|\.\d+))|/(?P<name>[^\x00\t\n\x0c\r ()<>\[\]{}/%]*)|(?P<open><<|\[)|(?P<close>>>|\])|<(?P<hex>[^<>]*)>|(?P<str>\()|(?P<word>[A-Za-z*'\"]+))")
STRING = re.compile(rb"[()\\]|\r\n?")
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
WORDS = {b"true": True, b"false": False, b"null": None}


def skip(data: bytes, at: int) -> int:
    return SKIP.match(data, at).end()


def literal(data: bytes, at: int) -> tuple[bytes, int]:
    """A string in parentheses; ``at`` is after the first."""
    out, depth = [], 1
    while True:
        m = STRING.search(data, at)
        if not m:
            raise Bad("string without end")
        out.append(data[at : m.start()])
        at, mark = m.end(), m[0]
        if mark in (b"(", b")"):
            depth += 1 if mark == b"(" else -1
            if not depth:
                return b"".join(out), at
            out.append(mark)
        elif mark != b"\\":
            out.append(b"\n")
        else:
            octal = re.compile(rb"[0-7]{1,3}").match(data, at)
            line = re.compile(rb"\r\n?|\n").match(data, at)
            if octal:
                out.append(bytes([int(octal[0], 8) % 256]))
                at = octal.end()
            elif line:
                at = line.end()
            else:
                out.append(ESCAPES.get(data[at : at + 1], data[at : at + 1]))
                at += 1


def number(text: bytes) -> int | float:
    """An integer of 64 bits, or else a real."""
    if b"." in text or len(text) > 20:
        return float(text)
    value = int(text)
    return value if -(1 << 63) <= value < 1 << 63 else float(text)


#: Names met last that a task keeps, and their longest; a file has few, over and over.
NAMES, SHORT = 4096, 127


@lru_cache(NAMES)
def decoded(text: bytes) -> Name:
    return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes([int(h[1], 16)]), text).decode("latin-1"))


def read(data: bytes, at: int, depth: int = 256) -> tuple[object, int]:
    """The value at ``at`` and where it ends."""
    stack: list[list] = []  # open arrays and dictionaries, each a list of items
    kinds: list[bytes] = []
    match = TOKEN.match
    while True:
        m = match(data, at)
        if not m:
            raise Bad("no value")
        at, kind = m.end(), m.lastgroup
        text = m[kind]
        if kind == "name":
            value = decoded(text) if len(text) <= SHORT else decoded.__wrapped__(text)
        elif kind == "open":
            if len(stack) >= depth:
                raise Bad("nested too deep")
            stack.append([])
            kinds.append(text)
            continue
        elif kind == "close":
            if not kinds or (text == b">>") != (kinds[-1] == b"<<"):
                raise Bad("brackets do not match")
            items, value = stack.pop(), None
            if kinds.pop() == b"[":
                value = items
            else:
                if len(items) % 2 or not all(isinstance(k, Name) for k in items[::2]):
                    raise Bad("bad dictionary")
                value = dict(zip(items[::2], items[1::2], strict=True))  # the last of equal keys counts
        elif kind == "num":
            value = int(text) if len(text) < 19 and text.isdigit() else number(text)
        elif kind == "ref":
            obj, gen = (number(n) for n in text.split()[:2])
            if isinstance(obj, float) or isinstance(gen, float):
                raise Bad("reference out of range")
            value = Ref(obj, gen)
        elif kind == "hex":
            digits = re.sub(rb"[" + SPACE + rb"]+", b"", text)
            if not re.fullmatch(rb"[0-9A-Fa-f]*", digits):
                raise Bad("bad hexadecimal string")
            value = Hex(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()))
        elif kind == "str":
            value, at = literal(data, at)
        elif text in WORDS:
            value = WORDS[text]
        else:
            raise Bad("unknown word")
        if not stack:
            return value, at
        stack[-1].append(value)


HEADER = re.compile(rb"(\d+)[" + SPACE + rb"]+(\d+)[" + SPACE + rb"]+obj")
EOL = re.compile(rb"\r\n|\r|\n|")
ENDSTREAM = re.compile(rb"[" + SPACE + rb"]*endstream")


def indirect(data: bytes, at: int, length=None, depth: int = 256) -> tuple[int, int, object]:
    """(number, generation, value) of the object at ``at``; ``length(ref)`` finds a stream's length given by reference."""
    m = HEADER.match(data, skip(data, at)) if 0 <= at < len(data) else None
    if not m:
        raise Bad("no object at offset")
    value, at = read(data, m.end(), depth)
    at = skip(data, at)
    if isinstance(value, dict) and data.startswith(b"stream", at):
        size = value.get("Length")
        if isinstance(size, Ref):
            size = length(size) if length else None
        at = EOL.match(data, at + 6).end()
        if not isinstance(size, int) or isinstance(size, bool) or not 0 <= size <= len(data) - at or not ENDSTREAM.match(data, at + size):
            raise Bad("bad stream length")
        value = Stream(value | {Name("Length"): size}, data[at : at + size])
    return int(m[1]), int(m[2]), value


def inflate(data: bytes, budget: list[int]) -> bytes:
    """Inflate at most ``budget[0]`` bytes, and take them off it."""
    z = zlib.decompressobj()
    try:
        out = z.decompress(data, budget[0] + 1)
    except zlib.error as e:
        raise Bad("bad compressed stream") from e
    if len(out) > budget[0] or not z.eof:
        raise Bad("compressed stream too large or cut off")
    budget[0] -= len(out)
    return out


#: Pixels a row from which a wavefront is faster than a loop.
WIDE = 24


def averaged(rows: np.ndarray, kinds: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Undo Average and Paeth filters of consecutive rows (row, pixel, component), below ``above``.

    A byte needs those to its left, above, and above left, so all bytes on one
    diagonal are done at once.
    """
    n, width, _ = rows.shape
    out = np.zeros((n + 1, width + 1, rows.shape[2]), np.int16)
    out[0, 1:] = above
    raw, paeth = rows.astype(np.int16), (kinds == 4)[:, None]
    for t in range(n + width - 1):
        r = np.arange(max(0, t - width + 1), min(n, t + 1))
        c = t - r
        left, up, corner = out[r + 1, c], out[r, c + 1], out[r, c]
        guess = left + up - corner
        of_left, of_up, of_corner = abs(guess - left), abs(guess - up), abs(guess - corner)
        best = np.where((of_left <= of_up) & (of_left <= of_corner), left, np.where(of_up <= of_corner, up, corner))
        out[r + 1, c + 1] = (raw[r, c] + np.where(paeth[r], best, (left + up) >> 1)) & 255
    return out[1:, 1:].astype(np.uint8)


def averaged_narrow(rows: np.ndarray, kinds: np.ndarray, above: np.ndarray) -> np.ndarray:
    """The same for rows of few pixels, byte by byte."""
    n, width, colors = rows.shape
    up, out = above.reshape(-1).tolist(), []
    for raw, kind in zip(rows.reshape(n, -1).tolist(), kinds.tolist(), strict=True):
        row = [0] * colors  # left of the first pixel
        padded = [0] * colors + up
        for i, v in enumerate(raw):
            left, over, corner = row[i], up[i], padded[i]
            guess = (left + over) // 2 if kind == 3 else min((left, over, corner), key=lambda x: abs(left + over - corner - x))
            row.append((v + guess) & 255)
        up = row[colors:]
        out.append(up)
    return np.array(out, np.uint8).reshape(n, width, colors)


def unpredict(data: bytes, columns: int, colors: int = 1) -> bytes:
    """Undo PNG row filters (8 bits a component), a run of rows of like filters at a time."""
    size = columns * colors
    if len(data) % (size + 1):
        raise Bad("bad predictor rows")
    table = np.frombuffer(data, np.uint8).reshape(-1, size + 1)
    if not len(table):
        return b""
    kinds, rows = table[:, 0], table[:, 1:].reshape(-1, columns, colors)
    if kinds.max() > 4:
        raise Bad("unknown predictor")
    groups = np.array([0, 1, 2, 3, 3])[kinds]
    starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    out, above = np.empty_like(rows), np.zeros((columns, colors), np.uint8)
    for a, b in zip(starts, [*starts[1:], len(rows)], strict=True):
        if groups[a] == 0:
            out[a:b] = rows[a:b]
        elif groups[a] == 1:  # sums along the rows
            out[a:b] = np.cumsum(rows[a:b], axis=1, dtype=np.uint8)
        elif groups[a] == 2:  # sums down the columns
            out[a:b] = np.cumsum(rows[a:b], axis=0, dtype=np.uint8) + above
        else:
            out[a:b] = (averaged if columns >= WIDE else averaged_narrow)(rows[a:b], kinds[a:b], above)
        above = out[b - 1]
    return out.tobytes()


def structural(stream: Stream, budget: list[int]) -> bytes:
    """Decode a cross-reference or object stream: stored, or Flate with an optional PNG predictor."""
    how, parms = stream.dict.get("Filter"), stream.dict.get("DecodeParms")
    if how is None:
        return stream.data
    if how not in (Name("FlateDecode"), [Name("FlateDecode")]) or isinstance(how, bytes):
        raise Bad("filter of a structural stream", "unsupported")
    if isinstance(parms, list):
        parms = parms[0] if parms else None
    data, parms = inflate(stream.data, budget), parms if isinstance(parms, dict) else {}
    predictor = parms.get("Predictor", 1)
    if predictor == 1:
        return data
    columns, colors = parms.get("Columns", 1), parms.get("Colors", 1)
    if not (isinstance(predictor, int) and 10 <= predictor <= 15 and parms.get("BitsPerComponent", 8) == 8 and 1 <= colors <= 4 and 1 <= columns <= 4096):
        raise Bad("predictor of a structural stream", "unsupported")
    return unpredict(data, columns, colors)


def real(value: float) -> bytes:
    """A number in plain decimals, never with an exponent."""
    if value != value or value in (float("inf"), float("-inf")):
        return b"0"
    if value == int(value) and abs(value) < 1e15:
        return str(int(value)).encode()
    text = format(Decimal(repr(value)), "f")
    return (text.rstrip("0").rstrip(".") if "." in text else text).encode()


@lru_cache(NAMES)
def encoded(value: str) -> bytes:
    return b"/" + b"".join(bytes([b]) if 33 <= b <= 126 and b not in b"()<>[]{}/%#" else b"#%02X" % b for b in value.encode("latin-1"))


def name(value: str) -> bytes:
    return (encoded if len(value) <= SHORT else encoded.__wrapped__)(value)


MARKS = re.compile(rb"[\\()\r\n\t]")
WRITTEN = {b"\r": b"\\r", b"\n": b"\\n", b"\t": b"\\t"}


def scalar(value: object) -> bytes:
    if isinstance(value, Name):
        return name(value)
    if isinstance(value, Ref):
        return b"%d %d R" % value
    if value is None:
        return b"null"
    if isinstance(value, bool):
        return b"true" if value else b"false"
    if isinstance(value, int):
        return b"%d" % value
    if isinstance(value, float):
        return real(value)
    if isinstance(value, Hex):
        return b"<" + value.hex().upper().encode() + b">"
    return b"(" + MARKS.sub(lambda m: WRITTEN.get(m[0], b"\\" + m[0]), value) + b")"


def written(value: object) -> bytes:
    """A value as it stands in a file, keys sorted."""
    if isinstance(value, Stream):
        return written(value.dict | {Name("Length"): len(value.data)}) + b"\nstream\n" + value.data + b"\nendstream"
    if isinstance(value, dict):
        return b"<< " + b"".join([name(k) + b" " + written(value[k]) + b" " for k in sorted(value)]) + b">>"
    if isinstance(value, list):
        return b"[" + b" ".join(map(written, value)) + b"]"
    return scalar(value)

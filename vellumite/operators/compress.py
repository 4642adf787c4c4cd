"""Packing of streams that were stored as they are, and images encoded again."""

from __future__ import annotations

import zlib
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Profile
from ..functions import jpeg_codec as codec
from ..functions.jpeg import scrub
from ..functions.sizes import target_pixels
from . import objects as O

#: A packed stream must save more than this.
LEAST_SAVED = 48


#: Streams above this are packed in parts of this many bytes, each by a task of its own.
PART = 8 << 20
#: Fixed value: the first two bytes of what zlib packs as usual.
ZLIB_HEAD = b"\x78\x9c"
ADLER = 65521


@F.pandas_udf(T.BinaryType())
def packed(payloads: pd.Series) -> pd.Series:
    """Deflated bytes where they are enough smaller and unpack to the same; else null."""

    def one(raw: bytes) -> bytes | None:
        small = zlib.compress(raw)
        return small if len(small) + LEAST_SAVED < len(raw) and zlib.decompress(small) == raw else None

    return payloads.map(one)


def deflated(raw: bytes, last: bool) -> bytes:
    """A part of a deflate stream that ends at a whole byte, so that parts made apart can stand one after the other."""
    z = zlib.compressobj(wbits=-15)
    return z.compress(raw) + z.flush(zlib.Z_FINISH if last else zlib.Z_SYNC_FLUSH)


def adler_of(parts: list[tuple[int, int]]) -> int:
    """The Adler-32 sum of bytes from those of their parts, (sum, length) each."""
    low, high = 1, 0
    for adler, n in parts:
        a, b = adler & 0xFFFF, adler >> 16
        high = (high + b + n * (low - 1)) % ADLER
        low = (low + a - 1) % ADLER
    return high << 16 | low


PACKED_PART = T.StructType([T.StructField("packed", T.BinaryType()), T.StructField("adler", T.LongType()), T.StructField("n", T.LongType())])


@F.pandas_udf(PACKED_PART)
def packed_part(raw: pd.Series, last: pd.Series) -> pd.DataFrame:
    rows = []
    for data, end in zip(raw, last, strict=True):
        small = deflated(data, bool(end))
        same = zlib.decompressobj(wbits=-15).decompress(small) == data
        rows.append((small if same else None, zlib.adler32(data), len(data)))
    return pd.DataFrame(rows, columns=["packed", "adler", "n"], index=raw.index)


@F.pandas_udf(T.BinaryType())
def joined_parts(parts: pd.Series) -> pd.Series:
    """One zlib stream from its packed parts in order, where it is enough smaller; else null."""

    def one(rows: list) -> bytes | None:
        if any(r["packed"] is None for r in rows):
            return None
        adler = adler_of([(r["adler"], r["n"]) for r in rows])
        small = b"".join([ZLIB_HEAD, *(r["packed"] for r in rows), adler.to_bytes(4, "big")])
        return small if len(small) + LEAST_SAVED < sum(r["n"] for r in rows) else None

    return parts.map(one)


def pack_large(payloads: DataFrame, part: int = PART) -> DataFrame:
    """:func:`packed` of long payloads: cut into parts, which are dealt over the tasks, packed, checked, and put together."""
    ends = f"int((octet_length(payload) - 1) div {part})"
    cut = payloads.selectExpr("doc_id", "obj", "payload", f"explode(sequence(0, {ends})) as at")
    cut = cut.selectExpr("doc_id", "obj", "at", f"substring(payload, at * {part} + 1, {part}) as raw", f"at = {ends} as last")
    made = cut.repartition("doc_id", "obj", "at").select("doc_id", "obj", "at", packed_part("raw", "last").alias("made"))
    whole = made.groupBy("doc_id", "obj").agg(F.sort_array(F.collect_list(F.struct("at", "made"))).alias("parts"))
    return whole.select("doc_id", "obj", joined_parts(F.transform("parts", lambda p: p["made"])).alias("payload")).where("payload is not null")


def pack(payloads: DataFrame, part: int = PART) -> DataFrame:
    """(doc_id, obj, payload, shrunk): all streams worth packing, in use or not, packed where that shrinks them, else as they are.

    Which ones these are is told by their ``role``, so short ones, most of all, are packed where they lie.
    """
    wanted = payloads.where("role = 'pack'")
    short = wanted.where(f"n <= {part}").select("doc_id", "obj", "payload", packed("payload").alias("small"))
    long = wanted.where(f"n > {part}")
    if not long.isEmpty():
        made = pack_large(long, part).withColumnRenamed("payload", "small")
        short = short.unionByName(long.select("doc_id", "obj", "payload").join(made, ["doc_id", "obj"], "left"))
    return short.selectExpr("doc_id", "obj", "coalesce(small, payload) as payload", "small is not null as shrunk")


def with_filter(nodes: DataFrame, done: DataFrame) -> DataFrame:
    """``nodes`` in which the streams of ``done`` (doc_id, obj) say that they are packed."""
    done = done.select("doc_id", "obj")
    changed = nodes.where("coalesce(top_key, '') not in ('DecodeParms', 'DP')").unionByName(nodes.where("top_key in ('DecodeParms', 'DP')").join(done, ["doc_id", "obj"], "left_anti"))
    values = {"node_id": "1073741824", "parent_id": "0", "depth": "1", "ord": "0", "gen": "0", "key": "'Filter'", "top_key": "'Filter'", "kind": "'name'", "bytes_val": "X'466C6174654465636F6465'"}
    return changed.unionByName(done.selectExpr("doc_id", "obj", *(f"cast({values.get(f.name, 'null')} as {f.dataType.simpleString()}) as {f.name}" for f in nodes.schema if f.name not in ("doc_id", "obj"))))


#: A picture whose colours differ by less than this on average is gray to the level that looks.
NEARLY_GRAY = 12
#: Fixed value: quality where a profile names none.
USUAL_QUALITY = 0.75


def again(data: bytes, width: int, height: int, gray: bool, to: tuple[int, int], profile: Profile) -> tuple[bytes, bool] | None:
    """A JPEG encoded again at another size, and whether it is gray now; None unless it is what its dictionary says and becomes smaller."""
    try:
        image = codec.decode(data)
    except Exception:  # a damaged image stays as it is
        return None
    if image is None or image.shape != (height, width, 1 if gray else 3):
        return None
    if not gray and profile.gray and codec.average_chroma(image) < NEARLY_GRAY:
        image, gray = image.astype(float) @ [[0.299], [0.587], [0.114]], True
    out = scrub(codec.encode(codec.scaled(image, *to), USUAL_QUALITY if profile.quality is None else profile.quality))
    return (out, gray) if len(out) < len(data) else None


#: Images up to so many bytes that a task keeps encoded: a logo or a letterhead stands in many files.
SAME, SAME_BYTES = 64, 1 << 18


@lru_cache(SAME)
def again_once(*what) -> tuple[bytes, bool] | None:
    return again(*what)


def recompress(nodes: DataFrame, objects: DataFrame, payloads: DataFrame, masks: DataFrame, profile: Profile) -> DataFrame:
    """(doc_id, obj, payload, width, height, gray) of the images of ``nodes`` that become smaller when encoded again; ``masks`` (doc_id, obj) are left."""
    kept = nodes.where("node_id = 0 and kind = 'stream'").select("doc_id", "obj")
    images = objects.where(O.eligible()).where("width > 0 and height > 0").selectExpr("doc_id", "obj", "cast(width as int) as width", "cast(height as int) as height", "color_space = 'DeviceGray' as gray")
    images = images.join(kept, ["doc_id", "obj"], "left_semi").join(masks, ["doc_id", "obj"], "left_anti")
    edge = profile.edge or (1 << 30)
    to_width, to_height = target_pixels(F.col("width"), F.col("height"), edge)
    found = payloads.join(images.withColumns({"to_width": to_width, "to_height": to_height}), ["doc_id", "obj"])

    @F.pandas_udf("struct<payload: binary, gray: boolean>")
    def encoded(payload: pd.Series, width: pd.Series, height: pd.Series, gray: pd.Series, to_width: pd.Series, to_height: pd.Series) -> pd.DataFrame:
        rows = zip(payload, width, height, gray, to_width, to_height, strict=True)
        made = [(again_once if len(p) <= SAME_BYTES else again)(bytes(p), w, h, bool(g), (tw, th), profile) or (None, None) for p, w, h, g, tw, th in rows]
        return pd.DataFrame(made, columns=["payload", "gray"], index=payload.index)

    done = found.withColumn("made", encoded("payload", "width", "height", "gray", "to_width", "to_height")).where("made.payload is not null")
    return done.selectExpr("doc_id", "obj", "made.payload", "to_width as width", "to_height as height", "made.gray")


#: Keys that an image encoded again has anew; /DecodeParms goes.
IMAGE_KEYS = ("Width", "Height", "BitsPerComponent", "Filter", "ColorSpace", "DecodeParms")


def with_image_keys(nodes: DataFrame, done: DataFrame) -> DataFrame:
    """``nodes`` in which the images of ``done`` (:func:`recompress`) say what they are now."""
    done = done.select("doc_id", "obj", "width", "height", "gray")
    old = F.col("top_key").isin(*IMAGE_KEYS) & (F.col("depth") > 0)
    rest = nodes.where(~F.coalesce(old, F.lit(False))).unionByName(nodes.where(old).join(done.select("doc_id", "obj"), ["doc_id", "obj"], "left_anti"))
    name = lambda text: f"cast('{text}' as binary)"
    values = [("Width", "int", "cast(width as long)", "null"), ("Height", "int", "cast(height as long)", "null"), ("BitsPerComponent", "int", "8L", "null")]
    values += [("Filter", "name", "null", name("DCTDecode")), ("ColorSpace", "name", "null", f"if(gray, {name('DeviceGray')}, {name('DeviceRGB')})")]
    made = ", ".join(f"struct('{k}' as key, '{kind}' as kind, cast({number} as long) as int_val, cast({raw} as binary) as bytes_val, {1073741825 + i} as node_id)" for i, (k, kind, number, raw) in enumerate(values))
    rows = done.select("doc_id", "obj", F.explode(F.expr(f"array({made})")).alias("v"))
    fixed = {"key": "v.key", "top_key": "v.key", "kind": "v.kind", "int_val": "v.int_val", "bytes_val": "v.bytes_val", "node_id": "v.node_id", "parent_id": "0", "depth": "1", "ord": "0", "gen": "0"}
    return rest.unionByName(rows.selectExpr("doc_id", "obj", *(f"cast({fixed.get(f.name, 'null')} as {f.dataType.simpleString()}) as {f.name}" for f in nodes.schema if f.name not in ("doc_id", "obj"))))

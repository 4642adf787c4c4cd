"""Serialise documents: objects in the tasks, offsets by a running sum, one classic cross-reference table."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import syntax as S
from ..sources.scratch import stored

#: Columns that hold an object's values.
VALUES = ("node_id", "parent_id", "key", "kind", "bool_val", "int_val", "real_val", "bytes_val", "ref_obj", "ref_gen")


def value_of(rows: Iterable[tuple]) -> object:
    """An object's value, or a stream's dictionary, from its rows (``VALUES``), which come in the order of ``node_id``."""
    made: dict[int, object] = {}
    for node, parent, key, kind, flag, number, real, raw, obj, gen in rows:
        if kind == "name":
            value = S.Name(raw.decode("latin-1"))
        elif kind == "ref":
            value = S.Ref(obj, gen)
        elif kind == "int":
            value = number
        elif kind == "array":
            value = []
        elif kind in ("dict", "stream"):
            value = {}
        elif kind == "string":
            value = raw
        else:
            value = {"null": None, "bool": flag, "real": real}[kind] if kind != "hex" else S.Hex(raw)
        made[node] = value
        if parent is not None and (around := made.get(parent)) is not None:
            if isinstance(around, list):
                around.append(value)
            else:
                around[S.Name(key)] = value
    return made[0]


def stream_parts(value: dict) -> tuple[bytes, bytes]:
    """A stream's dictionary as it stands in a file, before and after the place of its /Length."""
    sides = [{k: v for k, v in value.items() if (k < "Length") == first and k != "Length"} for first in (True, False)]
    return S.written(sides[0])[:-2], S.written(sides[1])[3:]


def parts(nodes: DataFrame) -> DataFrame:
    """(doc_id, obj, gen, head, tail, packed_head, packed_tail): each object as it stands in the file, a stream's up to and after its /Length (others have no tail),
    and as it stands there once it is packed; the trailer's dictionary under -1, without keys of the old layout."""
    nodes = nodes.where("not (obj = -1 and coalesce(top_key, '') in ('Prev', 'XRefStm', 'Encrypt', 'Size'))")
    grouped = nodes.groupBy("doc_id", "obj", F.when(F.col("obj") >= 0, F.col("gen")).alias("gen")).agg(F.sort_array(F.collect_list(F.struct(*VALUES))).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, held = [], batch.column(3)
            values = list(zip(*(c.to_pylist() for c in held.flatten().flatten()), strict=True))  # all objects' rows, a column at a time
            ends = pc.list_value_length(held).to_numpy().cumsum().tolist()
            for obj, gen, begin, end in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), [0, *ends], ends):
                rows = values[begin:end]
                value, start = value_of(rows), b"" if obj < 0 else b"%d %d obj\n" % (obj, gen or 0)
                if rows[0][3] != "stream":
                    made.append((start + S.written(value) + (b"" if obj < 0 else END), None, None, None))
                    continue
                head, tail = stream_parts(value)
                if "Filter" in value:
                    made.append((start + head, tail, None, None))
                    continue
                other, end = stream_parts({k: v for k, v in value.items() if k not in ("DecodeParms", "DP")} | {S.Name("Filter"): S.Name("FlateDecode")})
                made.append((start + head, tail, start + other, end))
            columns = list(zip(*made, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, pa.binary()) for c in columns)], names=["doc_id", "obj", "gen", *PART_BYTES])

    return grouped.select("doc_id", "obj", "gen", "rows").mapInArrow(run, "doc_id long, obj long, gen int, " + ", ".join(f"{c} binary" for c in PART_BYTES))


PART_BYTES = ("head", "tail", "packed_head", "packed_tail")
END, STREAM, ENDSTREAM = b"\nendobj\n", b"\nstream\n", b"\nendstream"


#: Bytes of an object of :func:`parts` in a file, from the lengths of its ``head`` and ``tail`` and its payload's length ``n``.
SIZE = f"head + if(tail is null, 0, tail + n + length(concat('/Length ', n, ' ')) + {len(STREAM + ENDSTREAM + END)})"


def offsets(parts: DataFrame, head: int, size: str = "octet_length(body)") -> DataFrame:
    """``parts`` (doc_id, obj, ...) with the offset of each object: the bytes of the head and of the objects before it."""
    before = f"coalesce(sum({size}) over (partition by doc_id order by obj rows between unbounded preceding and 1 preceding), 0)"
    return parts.selectExpr("*", f"{head} + {before} as offset")


def gaps(placed: DataFrame) -> DataFrame:
    """(doc_id, obj, offset, gen): a slot for every number up to the largest; free ones have no offset."""
    slots = placed.groupBy("doc_id").agg(F.max("obj").alias("most")).select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("most"))).alias("obj"))
    return slots.join(placed.select("doc_id", "obj", "offset", "gen"), ["doc_id", "obj"], "left")


HEAD = b"%%PDF-%d.%d\n%%\xe2\xe3\xcf\xd3\n"


def layered(layers: list[DataFrame]) -> DataFrame:
    """One table of ``layers``, ``rank`` telling which; the last one that has an object counts."""
    ranked = [t.withColumn("rank", F.lit(i)) for i, t in enumerate(layers)]
    out = ranked[0]
    for t in ranked[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def write(made: list[DataFrame], payloads: list[DataFrame], docs: DataFrame) -> DataFrame:
    """(doc_id, length, content): the files. ``made`` are layers of :func:`parts`, ``payloads`` of streams' bytes (doc_id, obj, payload, and ``shrunk`` of
    those that may be packed); of an object the last layer that has it counts.

    Offsets come from lengths alone. The bytes move once: parts and payloads are dealt by file and put together there in the order of their numbers,
    so neither is joined with the other, and payloads of objects that have no part are left out.
    """
    parts_, payloads_ = layered(made), layered([t if "shrunk" in t.columns else t.withColumn("shrunk", F.lit(False)) for t in payloads])
    # of each object numbers alone, those of the last layer: they fit a hash, and are grouped once for both uses
    lengths = {c: F.octet_length(c).cast("long") for c in PART_BYTES}
    told = parts_.where("obj >= 0").select("doc_id", "obj", F.col("rank").alias("at"), "gen", *(v.alias(c) for c, v in lengths.items()))
    told = told.unionByName(payloads_.select("doc_id", "obj", F.col("rank").alias("own"), F.octet_length("payload").cast("long").alias("n"), "shrunk"), allowMissingColumns=True)
    last = told.groupBy("doc_id", "obj").agg(F.max("at").alias("at"), *(F.max_by(c, "at").alias(c) for c in ("gen", *PART_BYTES)), *(F.max_by(c, "own").alias(c) for c in ("n", "shrunk")))
    last = last.where("obj >= 0 and at is not null").withColumn("small", F.expr("coalesce(shrunk and packed_tail is not null, false)"))
    sized = last.selectExpr("doc_id", "obj", "gen", "if(small, packed_head, head) as head", "if(small, packed_tail, tail) as tail", "n")
    placed = stored(offsets(sized, len(HEAD % (1, 4)), SIZE).select("doc_id", "obj", "gen", "offset"), "placed")
    free = F.when(F.col("obj") == 0, F.lit("0000000000 65535 f \n")).otherwise(F.lit("0000000000 00000 f \n"))
    line = F.when(F.col("offset").isNull(), free).otherwise(F.concat(F.lpad(F.col("offset").cast("string"), 10, "0"), F.lit(" "), F.lpad(F.col("gen").cast("string"), 5, "0"), F.lit(" n \n")))
    table = gaps(placed).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("obj", line.alias("line")))), lambda e: e["line"]), "").alias("xref"), (F.max("obj") + 1).alias("size"))
    heads = docs.select("doc_id", "major", "minor").join(table, "doc_id").withColumn("obj", F.lit(-1).cast("long")).withColumn("rank", F.lit(0))
    # of one object first its parts, then its payloads, the last layer first
    rows = parts_.withColumn("what", F.lit(0)).unionByName(payloads_.select("doc_id", "obj", "rank", "payload", "shrunk").withColumn("what", F.lit(1)), allowMissingColumns=True)
    rows = rows.unionByName(heads.withColumn("what", F.lit(2)), allowMissingColumns=True)
    rows = rows.repartition("doc_id").sortWithinPartitions("doc_id", "obj", "what", F.desc("rank"))
    columns = ["doc_id", "obj", "what", *PART_BYTES, "payload", "shrunk", "major", "minor", "xref", "size"]

    def file_of(rows: Iterator[dict]) -> bytes | None:
        """A file from its rows; None where its objects, its trailer or its table are missing."""
        trailer, about, bodies = None, None, []
        for obj, own in itertools.groupby(rows, lambda r: r["obj"]):
            first, payload = None, None
            for r in own:
                if r["what"] == 0:
                    first = first or r
                elif r["what"] == 1:
                    payload = payload or r
                else:
                    about = r
            if obj < 0:
                trailer = first
            elif first and first["tail"] is None:
                bodies.append(first["head"])
            elif first:
                data, way = payload["payload"], "packed_" if payload["shrunk"] and first["packed_tail"] is not None else ""
                bodies += [first[way + "head"], b"/Length %d " % len(data), first[way + "tail"], STREAM, data, ENDSTREAM, END]
        if trailer is None or about is None or not bodies:
            return None
        version = (2, 0) if about["major"] >= 2 else (1, min(7, max(0, about["minor"])))
        data = b"".join([HEAD % version, *bodies])
        return data + b"xref\n0 %d\n" % about["size"] + about["xref"].encode() + b"trailer\n" + trailer["head"][:-2] + b"/Size %d >>" % about["size"] + b"\nstartxref\n%d\n%%%%EOF\n" % len(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (dict(zip(columns, r, strict=True)) for b in batches for at in range(0, b.num_rows, 256) for r in zip(*(c.to_pylist() for c in b.slice(at, 256).columns), strict=True))
        for doc, own in itertools.groupby(rows, lambda r: r["doc_id"]):
            data = file_of(own)
            if data is not None:  # a file at a time
                yield pa.record_batch({"doc_id": pa.array([doc], pa.int64()), "length": pa.array([len(data)], pa.int64()), "content": pa.array([data], pa.binary())})

    return rows.select(*columns).mapInArrow(run, "doc_id long, length long, content binary")

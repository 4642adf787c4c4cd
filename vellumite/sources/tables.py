"""From files to tables: status, cross-reference entries, and the values of all objects as rows.

A file's bytes are read once, where they lie, and never shuffled: its task finds
the cross-reference sections, keeps the newest entry of each object (:func:`won`,
of at most as many as a file may have), and reads the objects at the places that
won. ``xref`` has the same entries by Spark's windows (:func:`newest`), for who
asks for them. Nothing a file does can fail the job: it gets a row in ``status``.

``nodes`` holds one row a value, in the order of the file: ``node_id`` 0 is the
object itself, ``parent_id`` the value around it, ``top_key`` the key of the
object's own dictionary that it is under. Object -1 is the trailer. The bytes of
streams are in ``payloads``, a column of their own that only the steps that
change or write them read; a stream's node has their number and the first two.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LIMITS, Limits
from . import ranges as R
from . import syntax as S
from .scratch import stored

ENTRY = "section_seq int, place int, priority int, obj long, gen int, kind string, offset long, stream long, idx int"
NODE = "obj long, gen int, node_id int, parent_id int, depth int, ord int, key string, top_key string, kind string, bool_val boolean, int_val long, real_val double, bytes_val binary, ref_obj long, ref_gen long"
OUT_BYTES = 8 << 20  # of files whose values leave a task together
STREAM_ONLY = ("Length", "Filter", "DecodeParms", "W", "Index", "Type", "F")


@dataclass
class Tables:
    """``status`` (doc_id, error_code, reason) of all files, ``docs``, ``xref``, ``nodes``, and ``payloads`` (doc_id, obj, n, role, payload).

    ``role`` tells without a join what may be done to a stream: 'pack' where :func:`objects.packable` holds, 'dct' where a filter is DCTDecode.
    """

    status: DataFrame
    docs: DataFrame
    xref: DataFrame
    nodes: DataFrame
    payloads: DataFrame
    taken: DataFrame | None = None


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """All PDF files under ``folder``: doc_id (a hash of the path), path, length, content."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]")
    # what cannot be read is left out of a pass over the content, not of the listing, and so becomes a row in the status
    found = found.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(folder)
    return found.select(F.xxhash64("path").alias("doc_id"), "path", "length", "content")


def gate(files: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """(doc_id, length, error_code, reason): files that are not read at all have a code. No content is looked at."""
    listed = files.groupBy("doc_id").agg(F.max("length").alias("length"), F.count(F.lit(1)).alias("n"))
    code = F.when(F.col("n") > 1, "cannotRead").when(F.col("length") == 0, "emptyInput").when(F.col("length") > limits.input_bytes, "oversize")
    return listed.select("doc_id", "length", code.alias("error_code"), F.when(F.col("n") > 1, "files with one id").alias("reason"))


#: Numbers of a header above this say no more than this does.
MOST_VERSION = 99
#: Generations of objects in use; the format has no larger ones.
MOST_GEN = 65535
MOST = (1 << 63) - 1


def version(data: bytes) -> tuple[int, int]:
    m = re.match(rb"%PDF-(\d+)(?:\.(\d+))?", data[:16])
    return (min(int(m[1]), MOST_VERSION) or 1, min(int(m[2]), MOST_VERSION) if m[2] else 4) if m else (1, 4)


SUBSECTION, LINE = re.compile(rb"(\d+)\s+(\d+)\s*"), re.compile(rb"(\d+)\s+(\d+)\s+([nf])\s*")


def classic(data: bytes, at: int, limits: Limits) -> tuple[list[tuple], dict]:
    """Entries and trailer of a cross-reference table; ``at`` is after its keyword."""
    entries = []
    while True:
        at = S.skip(data, at)
        if data.startswith(b"trailer", at):
            trailer = S.read(data, at + 7, limits.depth)[0]
            if not isinstance(trailer, dict):
                raise S.Bad("trailer is no dictionary")
            return entries, trailer
        m = SUBSECTION.match(data, at)
        if not m or int(m[2]) > limits.objects:
            raise S.Bad("damaged cross-reference table")
        if int(m[1]) + int(m[2]) > MOST:
            raise S.Bad("object number out of range")
        at = m.end()
        for obj in range(int(m[1]), int(m[1]) + int(m[2])):
            e = LINE.match(data, at)
            if not e:
                raise S.Bad("damaged cross-reference table")
            at, used = e.end(), e[3] == b"n" and int(e[1]) > 0
            if used and (int(e[2]) > MOST_GEN or int(e[1]) > MOST):
                raise S.Bad("cross-reference entry out of range")
            # a free entry's generation is of no use to a reader
            entries.append((len(entries), 0 if used else 2, obj, int(e[2]) if used else 0, "used" if used else "free", int(e[1]) if used else None, None, None))


def from_stream(stream: S.Stream, budget: list[int], priority: int, limits: Limits) -> tuple[list[tuple], dict]:
    """Entries and trailer of a cross-reference stream."""
    d = stream.dict
    widths = d.get("W")
    if not (isinstance(widths, list) and len(widths) == 3 and all(isinstance(w, int) and 0 <= w <= 8 for w in widths) and widths[1]):
        raise S.Bad("bad /W")
    data, width = S.structural(stream, budget), sum(widths)
    index = d.get("Index", [0, d.get("Size", 0)])
    if len(index) % 2 or not all(isinstance(i, int) and i >= 0 for i in index) or sum(index[1::2]) * width > len(data):
        raise S.Bad("bad /Index")
    table = np.frombuffer(data[: sum(index[1::2]) * width], np.uint8).reshape(-1, width)
    fields, at = [], 0
    for w in widths:
        if w == 8 and (table[:, at] > 127).any():
            raise S.Bad("field out of range")
        # big-endian: a weighted sum of the bytes
        weights = np.array([1 << 8 * (w - 1 - i) for i in range(w)], np.int64)
        fields.append((table[:, at : at + w].astype(np.int64) @ weights if w else np.full(len(table), 0 if at else 1)).tolist())
        at += w
    if any(a + c > MOST for a, c in zip(index[::2], index[1::2], strict=True)):
        raise S.Bad("field out of range")
    numbers = [n for a, c in zip(index[::2], index[1::2], strict=True) for n in range(a, a + c)]
    entries = []
    for obj, kind, b, c in zip(numbers, *fields, strict=True):
        if kind in (1, 2) and c > MOST_GEN:  # a generation, or a place among the members of a stream
            if kind == 1 or c > limits.objects:
                raise S.Bad("field out of range")
        if kind == 1:
            entries.append((len(entries), priority, obj, c, "used", b, None, None))
        elif kind == 2:
            entries.append((len(entries), priority, obj, 0, "packed", None, b, c))
        else:
            entries.append((len(entries), priority, obj, 0, "free", None, None, None))
    return entries, {k: v for k, v in d.items() if k not in STREAM_ONLY}


def sections(data: bytes, limits: Limits) -> tuple[list[tuple], dict]:
    """Entries of all sections, (section_seq, priority, ...), newest section first; and the newest trailer."""
    found = list(re.finditer(rb"startxref\s+(\d+)", bytes(data[-65536:])))
    at = int(found[-1][1]) if found else -1
    if not 0 <= at < len(data):
        raise S.Bad("no cross-reference")
    entries, newest, seen, budget, seq = [], None, set(), [limits.inflated_bytes], 0
    while at is not None:
        if at in seen or not 0 <= at < len(data):
            raise S.Bad("cross-reference sections do not end")
        if len(seen) >= limits.sections:
            raise S.Bad("too many cross-reference sections", "unsupported")
        seen.add(at)
        own, trailer, table = section(data, at, limits, budget)
        if table and "XRefStm" in trailer:
            hybrid = trailer["XRefStm"]
            if type(hybrid) is not int or not 0 <= hybrid < len(data) or hybrid in seen:
                raise S.Bad("bad /XRefStm")
            seen.add(hybrid)
            own += from_stream(xref_stream(data, hybrid), budget, 1, limits)[0]
        entries += [(seq, *e) for e in own]
        newest = trailer if newest is None else newest
        at, seq = trailer.get("Prev"), seq + 1
        if at is not None and not isinstance(at, int):
            raise S.Bad("bad /Prev")
    return entries, newest


def section(data: bytes | R.Ranges, at: int, limits: Limits, budget: list[int]) -> tuple[list[tuple], dict, bool]:
    """Entries and trailer of the section at ``at``, and whether it is a table."""

    def read(part: bytes, whole: bool = True):
        start = S.skip(part, 0 if part is not data else at)
        return (*classic(part, start + 4, limits), True) if part.startswith(b"xref", start) else None

    if isinstance(data, R.Ranges):
        start = data[at : at + R.OBJECT]
        is_table = start.startswith(b"xref", S.skip(start, 0))
        found = R.grown(data, at, R.SECTION, read) if is_table else None
    else:
        found = read(data)
    return found or (*from_stream(xref_stream(data, at), budget, 0, limits), False)


def xref_stream(data: bytes | R.Ranges, at: int) -> S.Stream:
    value = (R.indirect if isinstance(data, R.Ranges) else S.indirect)(data, at)[2]
    if not isinstance(value, S.Stream):
        raise S.Bad("no cross-reference stream")
    return R.near(value)


#: Kinds of values by their type; others are strings.
KINDS = {type(None): "null", bool: "bool", int: "int", float: "real", S.Name: "name", S.Hex: "hex", S.Ref: "ref", S.Stream: "stream", dict: "dict", list: "array"}


def flatten(obj: int, gen: int, value: object, lead: tuple = (), tail: tuple = ()) -> list[tuple]:
    """The rows of one object, each between ``lead`` and ``tail``."""
    rows: list[tuple] = []
    stack = [(value, None, 0, 0, None, None)]  # value, parent, depth, ord, key, top key
    lead = (*lead, obj, gen)
    no_value = (*NO_VALUE, *tail)
    while stack:
        v, parent, depth, place, key, top = stack.pop()
        kind, me = KINDS.get(type(v), "string"), len(rows)
        if kind == "ref":
            rows.append((*lead, me, parent, depth, place, key, top, kind, None, None, None, None, v.obj, v.gen, *tail))
            continue
        if kind == "name":
            rows.append((*lead, me, parent, depth, place, key, top, kind, None, None, None, v.encode("latin-1"), None, None, *tail))
            continue
        if kind == "int":
            rows.append((*lead, me, parent, depth, place, key, top, kind, None, v, None, None, None, None, *tail))
            continue
        if kind == "dict" or kind == "array":
            rows.append((*lead, me, parent, depth, place, key, top, kind, *no_value))
        elif kind == "stream":
            rows.append((*lead, me, parent, depth, place, key, top, kind, None, len(v.data), None, v.data[:2], None, None, *tail))
            v = v.dict
        else:
            rows.append((*lead, me, parent, depth, place, key, top, kind, v if kind == "bool" else None, None, v if kind == "real" else None, bytes(v) if kind in ("hex", "string") else None, None, None, *tail))
            continue
        depth += 1
        if kind == "array":
            stack += [(v[i], me, depth, i, None, top) for i in range(len(v) - 1, -1, -1)]
        else:
            i = len(v)
            for k in reversed(v):
                i -= 1
                name = str(k)
                stack.append((v[k], me, depth, i, name, name if depth == 1 else top))
    return rows


NO_VALUE = (None,) * 6


class Objects:
    """Objects of one file by number, read when asked for."""

    def __init__(self, data: bytes | R.Ranges, entries: list[dict], limits: Limits):
        self.data, self.limits, self.budget = data, limits, [limits.inflated_bytes]
        self.entries, self.done, self.open, self.members = {e["obj"]: e for e in entries}, {}, set(), {}

    def get(self, obj: int) -> tuple[int, object]:
        """(generation, value)"""
        if obj not in self.done:
            e = self.entries[obj]
            if obj in self.open:
                raise S.Bad("objects need each other")
            self.open.add(obj)
            if e["kind"] == "packed":
                members = self.container(e["stream"])
                if e["idx"] >= len(members) or members[e["idx"]][0] != obj:
                    raise S.Bad("object is not where it should be")
                self.done[obj] = 0, members[e["idx"]][1]
            else:
                number, gen, value = (R.indirect if isinstance(self.data, R.Ranges) else S.indirect)(self.data, e["offset"], self.length, self.limits.depth)
                if (number, gen) != (obj, e["gen"]):
                    raise S.Bad("another object at offset")
                self.done[obj] = gen, value
            self.open.discard(obj)
        return self.done[obj]

    def length(self, ref: S.Ref) -> int | None:
        value = self.get(ref.obj)[1] if ref.obj in self.entries else None
        return value if isinstance(value, int) else None

    def container(self, obj: int) -> list[tuple[int, object]]:
        if obj not in self.members:
            e = self.entries.get(obj)
            value = self.get(obj)[1] if e and e["kind"] == "used" else None
            if not isinstance(value, S.Stream) or value.dict.get("Type") != "ObjStm":
                raise S.Bad("no object stream")
            n, first = value.dict.get("N"), value.dict.get("First")
            if not (isinstance(n, int) and isinstance(first, int) and n >= 0):
                raise S.Bad("bad object stream")
            body = S.structural(R.near(value), self.budget)
            head = body[:first].split()
            if len(head) < 2 * n or not all(h.isdigit() for h in head[: 2 * n]):
                raise S.Bad("bad object stream")
            self.members[obj] = [(int(a), self.member(body, first + int(b))) for a, b in zip(head[: 2 * n : 2], head[1 : 2 * n : 2], strict=True)]
        return self.members[obj]


    def member(self, body: bytes, at: int) -> object:
        value, at = S.read(body, at, self.limits.depth)
        if isinstance(value, dict) and body.startswith(b"stream", S.skip(body, at)):
            raise S.Bad("a stream inside an object stream")
        return value


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def guarded(files: Iterator[tuple[int, bytes, list[tuple]]], failed: Callable[[int, Exception], tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of the rows of whole files, (id, content, rows), about ``OUT_BYTES`` of content each. A file whose rows don't fit their columns has the row ``failed`` makes."""

    def made(held: list[tuple[int, list[tuple]]]) -> pa.RecordBatch:
        try:
            return to_batch([r for _, rows in held for r in rows], schema)
        except Exception as e:  # nothing a file says may end the job
            if len(held) == 1:
                return to_batch([failed(held[0][0], e)], schema)
            return pa.concat_batches([made([one]) for one in held])

    held, size = [], 0
    for doc, data, rows in files:
        held.append((doc, rows))
        size += len(data or b"") + 64 * len(rows)
        if size > OUT_BYTES:
            yield made(held)
            held, size = [], 0
    if held:
        yield made(held)


def arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ddl.split(", "))])


#: The number under which the bytes read of a file are told.
READ = -3
#: Where a file's bytes come from: a column, or ranges of the file itself.
SOURCE = lambda files: ["content"] if "content" in files.columns else ["path", "length"]


def contents(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes | R.Ranges | None]]:
    """(doc_id, bytes) of a batch with doc_id and content, or path and length; None for what cannot be read."""
    names = batch.schema.names
    for i in range(batch.num_rows):
        doc = batch.column(0)[i].as_py()
        if "content" in names:
            yield doc, batch.column(names.index("content"))[i].as_py()
            continue
        try:
            data = R.Ranges(batch.column(names.index("path"))[i].as_py(), batch.column(names.index("length"))[i].as_py())
        except OSError:
            yield doc, None
            continue
        try:
            yield doc, data
        finally:
            data.close()


def opened(data: bytes | R.Ranges | None, limits: Limits) -> tuple[int, int, list[tuple], dict]:
    """Version, entries of all sections and newest trailer of a file that can be read."""
    if data is None:
        raise S.Bad("no content", "cannotRead")
    head = data[:16]
    if not head.startswith(b"%PDF-"):
        raise S.Bad("no header", "notPDF")
    entries, trailer = sections(data, limits)
    if "Encrypt" in trailer:
        raise S.Bad("encrypted", "encrypted")
    if not isinstance(trailer.get("Root"), S.Ref):
        raise S.Bad("no document catalog")
    most = max((e[3] for e in entries if e[5] != "free"), default=0)
    if max(len({e[3] for e in entries}), most + 1, trailer["Size"] if isinstance(trailer.get("Size"), (int, float)) else 0) > limits.objects:
        raise S.Bad("too many objects", "unsupported")
    return *version(head), entries, trailer


def scan(files: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """A row an entry of each file's sections; none of files that cannot be read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes, list[tuple]]]:
        for batch in batches:
            for doc, data in contents(batch):
                try:
                    yield doc, b"", [(doc, *e) for e in opened(data, limits)[2]]  # the content does not leave the task
                except Exception:  # told by the status
                    continue

    shape = arrow("doc_id long, " + ENTRY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from guarded(read(batches), lambda doc, e: (doc, *(None,) * 9), shape)

    return files.select("doc_id", *SOURCE(files)).mapInArrow(run, "doc_id long, " + ENTRY).where("obj is not null")


def won(entries: list[tuple]) -> list[dict]:
    """The entries of one file that count, but for free ones, as :func:`newest` has them: the last of a section's own and of its hybrid stream's, then the newest section, then by priority."""
    last, best = {}, {}
    for e in entries:  # in the order of their places
        last[e[3], e[0], e[2] == 1] = e
    for e in last.values():
        held = best.get(e[3])
        if held is None or (e[0], e[2]) < (held[0], held[2]):
            best[e[3]] = e
    return [{"obj": e[3], "gen": e[4], "kind": e[5], "offset": e[6], "stream": e[7], "idx": e[8]} for e in best.values() if e[5] != "free"]


def role(stream: S.Stream) -> str | None:
    """What may be done to a stream, as :func:`objects.packable` and ``dct`` of :func:`objects.objects` say of its rows."""
    d, how = stream.dict, stream.dict.get("Filter")
    if holds_dct(how):
        return "dct"
    named = {k: v if isinstance(v := d.get(k), S.Name) else None for k in ("Type", "Subtype")}
    left = named["Type"] == "Metadata" or (named["Type"] == "XObject" and named["Subtype"] == "Image")
    return None if left or "Filter" in d or "F" in d or len(stream.data) < LEAST_PACKED else "pack"


def holds_dct(how: object) -> bool:
    """Whether a /Filter names DCTDecode, however deep."""
    items = how if isinstance(how, list) else how.values() if isinstance(how, dict) else None
    return isinstance(how, S.Name) and how == "DCTDecode" if items is None else any(map(holds_dct, items))


#: Bytes that a stream has at least to be worth packing.
LEAST_PACKED = 64


def newest(entries: DataFrame) -> DataFrame:
    """The entry of each object that counts, of (doc_id, obj, section_seq, priority, place, ...).

    Of entries in one table or stream the last; then newer sections first, and within one a table's used entry, the hybrid stream's, then free.
    """
    last = "row_number() over (partition by doc_id, obj, section_seq, priority = 1 order by place desc) as last"
    rank = "row_number() over (partition by doc_id, obj order by section_seq, priority) as rank"
    return entries.selectExpr("*", last).where("last = 1").selectExpr("*", rank).where("rank = 1").drop("last", "rank")


def parse(files: DataFrame, limits: Limits = LIMITS) -> Tables:
    """All tables of ``files`` (doc_id, length, content). Content is read only of files that pass the gate.

    Files without content, (doc_id, path, length) of :func:`ranges.list_files`, are
    read by ranges; ``payloads`` then has the JPEG streams only, which an inspection
    needs, and ``taken`` the bytes read of each file.
    """
    gated = stored(gate(files.select("doc_id", "length"), limits), "gate")
    ready = files.where((F.col("length") > 0) & (F.col("length") <= limits.input_bytes)).select("doc_id", *SOURCE(files))
    twice = gated.where("reason is not null").select("doc_id")
    if not twice.isEmpty():
        ready = ready.join(twice, "doc_id", "left_anti")
    schema = f"doc_id long, {NODE}, role string, major int, minor int, payload binary"
    shape = arrow(schema)
    none = (None,) * 4

    def wanted(stream: S.Stream) -> bytes | None:
        how = stream.dict.get("Filter")
        return bytes(stream.data[:]) if isinstance(stream.data, bytes) or "DCTDecode" in (how if isinstance(how, list) else [how]) else None

    def one(doc: int, data: bytes | R.Ranges | None) -> list[tuple]:
        """The rows of all objects, and of the trailer under -1, the first with the version; one row under -2 where the file cannot be read."""
        try:
            major, minor, entries, trailer = opened(data, limits)
        except Exception as e:  # whatever a damaged file provokes
            return [failed(doc, e if isinstance(e, S.Bad) else S.Bad(type(e).__name__))]
        try:
            objects, rows = Objects(data, won(entries), limits), []
            for obj in sorted(objects.entries):
                gen, value = objects.get(obj)
                if not isinstance(value, S.Stream):
                    rows += flatten(obj, gen, value, (doc,), none)
                elif value.dict.get("Type") not in ("ObjStm", "XRef"):
                    own = flatten(obj, gen, value, (doc,), none)
                    own[0] = (*own[0][: -len(none)], role(value), None, None, wanted(value))
                    rows += own
            own = flatten(-1, 0, trailer, (doc,), none)
            own[0] = (*own[0][: -len(none)], None, major, minor, None)
            return rows + own
        except Exception as e:
            return [failed(doc, e)]

    def failed(doc: int, e: Exception) -> tuple:
        code = e.code if isinstance(e, S.Bad) else "corrupt"
        return doc, -2, None, 0, None, 0, 0, code, None, "error", None, None, None, str(e).encode(), None, None, *none

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes, list[tuple]]]:
        for batch in batches:
            for doc, data in contents(batch):
                rows = one(doc, data)
                if isinstance(data, R.Ranges):
                    rows.append((doc, READ, None, 0, None, 0, 0, None, None, "read", None, data.taken, None, None, None, None, *none))
                yield doc, data if isinstance(data, bytes) else b"", rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from guarded(parsed(batches), failed, shape)

    read = stored(ready.mapInArrow(run, schema), "objects", "zstd")
    # a file that was read has one of these rows
    told = read.where("obj = -2 or obj = -1 and node_id = 0").select("doc_id")
    unread = gated.where("error_code is null").join(told, "doc_id", "left_anti").selectExpr("doc_id", "'cannotRead' as error_code", "'no content' as reason")
    errors = gated.where("error_code is not null").select("doc_id", "error_code", "reason").unionByName(unread)
    errors = errors.unionByName(read.where("obj = -2").selectExpr("doc_id", "key as error_code", "cast(bytes_val as string) as reason"))
    status = stored(gated.select("doc_id").join(errors, "doc_id", "left"), "status")
    nodes = read.where("obj >= -1").drop("role", "major", "minor", "payload")
    docs = read.where("obj = -1 and node_id = 0").select("doc_id", "major", "minor").join(gated.select("doc_id", F.col("length").alias("file_bytes")), "doc_id")
    payloads = read.where("payload is not null").select("doc_id", "obj", F.col("int_val").alias("n"), "role", "payload")
    taken = read.where(f"obj = {READ}").selectExpr("doc_id", "int_val as bytes_read")
    xref = newest(scan(ready, limits))
    return Tables(status, stored(docs, "docs"), xref, nodes, payloads, taken)

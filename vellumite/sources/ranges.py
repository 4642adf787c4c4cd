"""Files read by ranges: a listing packed into partitions by bytes, and objects without the bytes of their streams.

:func:`list_files` lists by tasks, a folder each, and keeps what it finds in a table, so the driver holds
no file's name. It looks at no content, and
gives tasks whole files, about ``PACK`` bytes each, so a partition's work is
bounded whether files are many or large: each file counts ``OPEN`` bytes more than
it has, and less than ``PACK`` is given where all cores would not have work. A file's cross-reference is then found
from its last 64 KB and from where its sections are; objects are read where the
newest entries say. What a stream holds is read only where it is asked for.
"""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import syntax as S
from .scratch import stored

PACK = 256 << 20
#: What opening and parsing a file counts, in bytes; partitions aimed at for each core, and the least to give one.
OPEN, TURNS, LEAST = 1 << 16, 4, 1 << 20
#: First reads of an object and of a section; each further one is ``MORE`` times as long.
OBJECT, SECTION, MORE = 2048, 65536, 8


@dataclass
class Packed(InputPartition):
    """(path, length) of the files of one partition."""

    files: list[tuple[str, int]]


class Listing(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.pack = options["folder"], int(options.get("pack", PACK))
        self.open, self.tasks = int(options.get("open", 0)), int(options.get("tasks", 1))

    def partitions(self) -> list[Packed]:
        from .sink import is_local, opened

        store, root = opened(self.folder)
        prefix = "file:" if is_local(self.folder) else self.folder[: len(self.folder) - len(root)] if self.folder.endswith(root) else ""
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((prefix + f.path, f.size or 0) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(".pdf"))
        out, held, size = [], [], 0
        share = -(-sum(length + self.open for _, length in files) // self.tasks)
        pack = min(self.pack, max(share, LEAST))
        for path, length in files:
            if held and size + length + self.open > pack:
                out.append(Packed(held))
                held, size = [], 0
            held.append((path, length))
            size += length + self.open
        return [*out, Packed(held)]

    def read(self, partition: Packed) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch({"path": pa.array([p for p, _ in partition.files], pa.string()), "length": pa.array([n for _, n in partition.files], pa.int64())})


class PdfListing(DataSource):
    """(path, length) of the PDF files under ``folder``; ``pack`` is the most bytes of files in a partition, each counted ``open`` bytes longer, ``tasks`` the partitions aimed at.

    The driver holds the whole listing, sorted: for folders of some 100,000 files. The library uses :func:`list_files`.
    """

    @classmethod
    def name(cls) -> str:
        return "vellumite_pdfs"

    def schema(self) -> str:
        return "path string, length long"

    def reader(self, schema: T.StructType) -> Listing:
        return Listing(self.options)


FOUND = "path string, length long, inner boolean"
#: Names that leave a task together.
NAMES = 10_000


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of all PDF files under ``folder``: a round for each depth of folders, in which a task lists one folder at a time. A link to a folder is not followed."""
    from .sink import entries, is_local, opened

    shape = pa.schema([("path", pa.string()), ("length", pa.int64()), ("inner", pa.bool_())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for batch in batches for p in batch.column(0).to_pylist()):
            store, at = opened(path)
            prefix = "file:" if is_local(path) else path[: len(path) - len(at)] if path.endswith(at) else ""
            local = prefix == "file:"
            rows = ((prefix + p, n, inner) for p, inner, n in entries(store, at) if (not (local and os.path.islink(p)) if inner else p.lower().endswith(".pdf")))
            while some := list(itertools.islice(rows, NAMES)):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), shape, strict=True)], schema=shape)

    folders, found = spark.createDataFrame([(folder,)], "path string"), []
    while True:
        # folders are dealt one by one, as each is listed in one go
        round_ = stored(folders.repartition(min(FOLDERS, TURNS * spark.sparkContext.defaultParallelism), "path").mapInArrow(read, FOUND), "listed")
        found.append(round_.where("not inner").select("path", "length"))
        folders = round_.where("inner").select("path")
        if folders.isEmpty():
            return reduce(DataFrame.unionByName, found)


#: Tasks that list folders, at most.
FOLDERS = 200


def list_files(spark: SparkSession, folder: str, pack: int = PACK) -> DataFrame:
    """doc_id (a hash of the path), path and length of all PDF files under ``folder``, found now, dealt by number and bytes. :func:`tables.parse` reads such files by ranges."""
    found = listed(spark, folder)
    size, n = found.agg(F.sum(F.col("length") + OPEN), F.count(F.lit(1))).first()
    tasks = TURNS * spark.sparkContext.defaultParallelism
    share = min(pack, max(-(-(size or 0) // tasks), LEAST))
    parts = max(1, min(n, -(-(size or 0) // share)))
    return found.repartition(parts).select(F.xxhash64("path").alias("doc_id"), "path", "length")


class Ranges:
    """The bytes of a file, read when a slice is asked for; ``taken`` counts them."""

    def __init__(self, path: str, length: int):
        from .sink import opened

        store, inside = opened(path)
        self.file, self.length, self.taken = store.open_input_file(inside), length, 0

    def __len__(self) -> int:
        return self.length

    def __getitem__(self, part: slice) -> bytes:
        start, stop, _ = part.indices(self.length)
        if stop <= start:
            return b""
        data = self.file.read_at(stop - start, start)
        self.taken += len(data)
        return data

    def close(self) -> None:
        self.file.close()


@dataclass
class Far:
    """A stream's bytes that have not been read."""

    source: Ranges
    start: int
    size: int

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, part: slice) -> bytes:
        start, stop, _ = part.indices(self.size)
        return self.source[self.start + start : self.start + stop]


def grown(source: Ranges, at: int, first: int, read):
    """``read(buffer, whole)`` of ever longer buffers from ``at``, until it finds what it looks for or the file ends."""
    size = first
    while True:
        whole = at + size >= len(source)
        try:
            found = read(source[at : at + size], whole)
            if found is not None:
                return found
        except S.Bad:
            if whole:
                raise
        size *= MORE


def indirect(source: Ranges, at: int, length=None, depth: int = 256) -> tuple[int, int, object]:
    """:func:`syntax.indirect` of a file read by ranges; a stream's bytes are :class:`Far`."""
    if not 0 <= at < len(source):
        raise S.Bad("no object at offset")

    def read(data: bytes, whole: bool):
        m = S.HEADER.match(data, S.skip(data, 0))
        if not m:
            raise S.Bad("no object at offset")
        value, end = S.read(data, m.end(), depth)
        end = S.skip(data, end)
        # a value that the buffer may have cut is read again
        if not whole and not (data.startswith(b"endobj", end) or data.startswith(b"stream", end) and len(data) > end + 8):
            return None
        return int(m[1]), int(m[2]), value, end, data.startswith(b"stream", end) and S.EOL.match(data, end + 6).end()

    number, gen, value, end, start = grown(source, at, OBJECT, read)
    if isinstance(value, dict) and start:
        size = value.get("Length")
        if isinstance(size, S.Ref):
            size = length(size) if length else None
        start += at
        if not isinstance(size, int) or isinstance(size, bool) or not 0 <= size <= len(source) - start or not S.ENDSTREAM.match(source[start + size : start + size + OBJECT]):
            raise S.Bad("bad stream length")
        value = S.Stream(value | {S.Name("Length"): size}, Far(source, start, size))
    return number, gen, value


def near(stream: S.Stream) -> S.Stream:
    """``stream`` with its bytes at hand."""
    return stream._replace(data=stream.data[:]) if isinstance(stream.data, Far) else stream

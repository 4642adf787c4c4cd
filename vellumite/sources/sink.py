"""Cleaned files to a folder on any file system that Arrow can write to, all of them or none.

The folder is a sink of Spark's data source API. Tasks put their files into a
hidden folder beside the target, each under another name first, so a task that
runs twice leaves the same. When all tasks are done the driver commits: where the
target is not there yet, by one rename; else file by file behind a mark that says
so, and :func:`finish` goes on with what a commit left when its driver died. A
job that fails leaves nothing.
"""

from __future__ import annotations

import itertools
import json
import os
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .scratch import shared_dir, stored


class SameFolder(ValueError):
    """The output folder holds the inputs."""


def is_local(path: str) -> bool:
    return urlparse(path).scheme in ("", "file")


def local(path: str) -> str:
    return os.path.realpath(unquote(urlparse(path).path) if path.startswith("file:") else path)


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of ``folder``, and the folder's path in it."""
    return (fs.LocalFileSystem(), local(folder)) if is_local(folder) else fs.FileSystem.from_uri(folder)


def relative(path: str, source: str) -> str:
    """``path`` as it stands under ``source``."""
    inside, root = (unquote(urlparse(p).path) for p in (path, source))
    root = posixpath.normpath(root)
    inside = posixpath.normpath(inside)
    return inside[len(root) :].lstrip("/") if inside.startswith(root.rstrip("/") + "/") else posixpath.basename(inside)


def relative_column(path, source: str):
    @F.pandas_udf(T.StringType())
    def run(paths):
        return paths.map(lambda p: relative(p, source))

    return run(path)


#: Marks a folder of files whose commit has begun.
MARK = ".commit"
#: A task with more files that cannot be written ends the job.
MOST_FAILED = 1000


def plain_name(name: str) -> str:
    """A name under the folder; of a whole path or URI the last part only."""
    return posixpath.basename(name) if name.startswith("/") or urlparse(name).scheme else posixpath.normpath("/" + name).lstrip("/")


@F.pandas_udf(T.StringType())
def plain_names(names):
    return names.map(plain_name)


def staging(root: str, job: str) -> str:
    return posixpath.join(posixpath.dirname(root), f".{posixpath.basename(root)}.{job}")


def entries(store: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool, int]]:
    """(path, whether it is a folder, length) of what a folder holds, not of folders inside; one at a time where the system is local."""
    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(folder) as found:
            for e in found:
                try:
                    inner = e.is_dir()
                    yield posixpath.join(folder, e.name), inner, 0 if inner else e.stat().st_size
                except OSError:  # gone, or a link to nowhere
                    continue
    else:
        for f in store.get_file_info(fs.FileSelector(folder)):
            yield f.path, f.type == fs.FileType.Directory, f.size or 0


def walked(store: fs.FileSystem, root: str) -> Iterator[str]:
    """``root`` and the folders under it, the outer ones first; a link is not followed."""
    pending = [root]
    while pending:
        at = pending.pop()
        yield at
        pending += [path for path, inner, _ in entries(store, at) if inner and not (isinstance(store, fs.LocalFileSystem) and os.path.islink(path))]


#: Files of a folder that are listed before they are moved.
MOVED_TOGETHER = 10_000


def move_all(store: fs.FileSystem, source: str, root: str) -> None:
    """Move the files under ``source`` to the same places under ``root``, over those that are there, and drop ``source``. Few names are held at a time."""
    mark = posixpath.join(source, MARK)
    for folder in walked(store, source):
        to = posixpath.normpath(posixpath.join(root, folder[len(source) :].lstrip("/")))
        store.create_dir(to, recursive=True)
        while files := [p for p, _, _ in itertools.islice((e for e in entries(store, folder) if not e[1] and e[0] != mark), MOVED_TOGETHER)]:
            for path in files:
                out = posixpath.join(to, posixpath.basename(path))
                if not isinstance(store, fs.LocalFileSystem) and store.get_file_info(out).type == fs.FileType.File:
                    store.delete_file(out)
                store.move(path, out)
    store.delete_dir(source)


def finish(folder: str) -> int:
    """Go on with commits into ``folder`` that were cut off; how many there were."""
    store, root = opened(folder)
    around = posixpath.dirname(root)
    begun = [f.path for f in store.get_file_info(fs.FileSelector(around, allow_not_found=True)) if f.base_name.startswith(f".{posixpath.basename(root)}.") and f.type == fs.FileType.Directory]
    begun = [p for p in begun if store.get_file_info(posixpath.join(p, MARK)).type == fs.FileType.File]
    for path in begun:
        move_all(store, path, root)
    return len(begun)


@dataclass
class Staged(WriterCommitMessage):
    """Ids of a task's files that could not be written."""

    failed: list[int]


class FolderWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.folder, self.job, self.receipt = options["folder"], options["job"], options["receipt"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        store, root = opened(self.folder)
        around, failed = staging(root, self.job), []
        for batch in iterator:
            for i in range(batch.num_rows):
                doc, name, content, path = (c[i] for c in batch.columns)
                if not self.put(store, root, around, name.as_py(), content, path.as_py()):
                    failed.append(doc.as_py())
                    if len(failed) > MOST_FAILED:
                        raise OSError(f"more than {MOST_FAILED} files of one task cannot be written")
        return Staged(failed)

    def put(self, store: fs.FileSystem, root: str, around: str, name: str, content: pa.Scalar, path: str | None) -> bool:
        out = posixpath.join(root, name)
        if path is not None and is_local(self.folder) and is_local(path) and os.path.exists(out) and os.path.exists(local(path)) and os.path.samefile(out, local(path)):
            return False
        staged = posixpath.join(around, name)
        partial = f"{staged}.{uuid.uuid4().hex[:12]}.part"
        try:
            store.create_dir(posixpath.dirname(staged), recursive=True)
            with store.open_output_stream(partial) as f:
                f.write(content.as_buffer())
            if not isinstance(store, fs.LocalFileSystem) and store.get_file_info(staged).type == fs.FileType.File:
                store.delete_file(staged)
            store.move(partial, staged)
        except (OSError, pa.ArrowException):
            return False
        return True

    def commit(self, messages: list[Staged | None]) -> None:
        store, root = opened(self.folder)
        around = staging(root, self.job)
        there = store.get_file_info(around).type == fs.FileType.Directory
        for folder in walked(store, around) if there else ():
            for path, inner, _ in entries(store, folder):
                if not inner and path.endswith(".part"):  # of a task that was killed
                    store.delete_file(path)
        if there and store.get_file_info(root).type == fs.FileType.NotFound:
            store.move(around, root)
        elif there:
            store.open_output_stream(posixpath.join(around, MARK)).close()
            move_all(store, around, root)
        store, receipt = opened(self.receipt)
        with store.open_output_stream(receipt) as f:
            f.write("".join(json.dumps({"doc_id": d}) + "\n" for m in messages if m for d in m.failed).encode())

    def abort(self, messages: list[Staged | None]) -> None:
        store, root = opened(self.folder)
        around = staging(root, self.job)
        if store.get_file_info(around).type == fs.FileType.Directory:
            store.delete_dir(around)


class CommittedFolder(DataSource):
    """Rows (doc_id, name, content, path) as files of a folder; options ``folder``, ``job`` (a name no other job has) and ``receipt`` (a file for the ids that failed)."""

    @classmethod
    def name(cls) -> str:
        return "vellumite_files"

    def schema(self) -> str:
        return "doc_id long, name string, content binary, path string"

    def writer(self, schema: T.StructType, overwrite: bool) -> FolderWriter:
        return FolderWriter(self.options)


def write_files(files: DataFrame, folder: str, source: str | None = None) -> DataFrame:
    """Write ``files`` (doc_id, name, content, and path where the input is a file) under ``folder``, now, all or nothing.

    Names may hold folders, which are made; of files with one name the first (by
    path, then id) is written, the others are refused. Returns doc_id, written (path) and
    error_code; what it returns may be read any number of times, nothing is written again.
    Originals are never written over: the folder must not be the one the inputs
    came from, and a file that is its own input by another name is refused.
    """
    spark = files.sparkSession
    if is_local(folder):
        if source is not None and is_local(source) and local(source) == local(folder):
            raise SameFolder("the output folder is the input folder")
    elif source is not None and source.rstrip("/") == folder.rstrip("/"):
        raise SameFolder("the output folder is the input folder")
    finish(folder)
    path = F.col("path") if "path" in files.columns else F.lit(None).cast("string")
    files = files.select("doc_id", plain_names("name").alias("name"), "content", path.alias("path"))
    # names alone are compared, and contents are moved for it only where some are taken
    order = "row_number() over (partition by name order by path, doc_id) > 1 as taken"
    names = stored(files.select("doc_id", "name", "path").selectExpr("doc_id", "name", order), "names")
    taken = names.where("taken").select("doc_id")
    if not taken.isEmpty():
        files = files.join(taken, "doc_id", "left_anti")
    job = uuid.uuid4().hex[:12]
    receipt = f"{shared_dir(spark)}/receipt-{job}.json"
    spark.dataSource.register(CommittedFolder)
    files.write.format(CommittedFolder.name()).mode("append").options(folder=folder, job=job, receipt=receipt).save()
    failed = spark.read.schema("doc_id long").json(receipt).withColumn("failed", F.lit(True))
    told = names.join(failed, "doc_id", "left").withColumn("lost", F.expr("taken or coalesce(failed, false)"))
    out = F.concat(F.lit(opened(folder)[1].rstrip("/") + "/"), F.col("name"))
    return told.select("doc_id", F.when(~F.col("lost"), out).alias("written"), F.when(F.col("lost"), "cannotWrite").alias("error_code"))

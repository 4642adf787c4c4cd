"""Folders of many files: the driver holds no names of them, neither to list nor to commit them."""

import os
import tracemalloc

import pytest
from pyarrow import fs

from vellumite.sources import ranges, sink


def tree(root, n):
    for i in range(n):
        (root / f"d{i % 3}" / "deep").mkdir(parents=True, exist_ok=True)
        (root / f"d{i % 3}" / ("deep" if i % 2 else ".") / f"{i}.PDF").write_bytes(b"x" * i)
    (root / "d0" / "no.txt").write_bytes(b"no")
    (root / "top.pdf").write_bytes(b"top")


def test_tasks_list_folders(spark, tmp_path, monkeypatch):
    tree(tmp_path, 60)
    os.symlink(tmp_path / "d0", tmp_path / "d1" / "link")
    os.symlink(tmp_path / "nowhere.pdf", tmp_path / "d1" / "dead.pdf")
    for name in ("partitions", "read"):
        monkeypatch.setattr(ranges.Listing, name, lambda *_: pytest.fail("listed by the driver"))
    found = ranges.list_files(spark, f"file://{tmp_path}")
    want = {f"file:{tmp_path}/d{i % 3}/{'deep/' if i % 2 else ''}{i}.PDF": i for i in range(60)} | {f"file:{tmp_path}/top.pdf": 3}
    assert {r.path: r.length for r in found.collect()} == want and found.select("doc_id").distinct().count() == 61
    assert ranges.list_files(spark, f"file://{tmp_path}/d0/deep").count() == 10 and ranges.list_files(spark, str(tmp_path)).count() == 61


def test_nothing_to_list(spark, tmp_path):
    assert ranges.list_files(spark, f"file://{tmp_path}").collect() == []


def test_commit_holds_few_names(tmp_path, monkeypatch):
    around = tmp_path / ".out.j" / "d"
    around.mkdir(parents=True)
    for i in range(20_000):
        (around / f"{'n' * 100}{i}.pdf").touch()
    (around / "a.part").touch()
    writer = sink.FolderWriter({"folder": f"file://{tmp_path}/out", "job": "j", "receipt": f"file://{tmp_path}/receipt"})
    tracemalloc.start()
    writer.commit([])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(os.listdir(tmp_path / "out" / "d")) == 20_000 and most < 1_000_000


def test_files_are_moved_a_few_at_a_time(tmp_path, monkeypatch):
    source, root = tmp_path / "new", tmp_path / "old"
    tree(source, 40)
    (source / sink.MARK).touch()
    (root / "d0").mkdir(parents=True)
    (root / "d0" / "0.PDF").write_bytes(b"before")
    (root / "kept.pdf").write_bytes(b"kept")
    want = {str(p.relative_to(source)): p.read_bytes() for p in source.rglob("*") if p.is_file() and p.name != sink.MARK} | {"kept.pdf": b"kept"}
    monkeypatch.setattr(sink, "MOVED_TOGETHER", 3)
    sink.move_all(fs.LocalFileSystem(), str(source), str(root))
    assert {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*") if p.is_file()} == want and not source.exists()

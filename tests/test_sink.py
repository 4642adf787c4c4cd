"""The committed folder: all files or none, tasks that run twice, commits that are cut off."""

import pytest
from pyspark.sql import functions as F

from vellumite.sources import sink


def frame(spark, n=40, text="file"):
    return spark.range(n).selectExpr("id as doc_id", "concat('d', id % 3, '/', id, '.pdf') as name", f"cast(concat('{text} ', id) as binary) as content").repartition(5)


def held(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in folder.rglob("*") if p.is_file()}


def test_first_write_and_again(spark, tmp_path):
    out = tmp_path / "out"
    for text in ("file", "other"):
        done = sink.write_files(frame(spark, text=text), f"file://{out}")
        assert done.where("error_code is null").count() == 40 and done.where("error_code is null").count() == 40
        assert held(out) == {f"d{i % 3}/{i}.pdf": f"{text} {i}".encode() for i in range(40)}
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


def test_failed_job_leaves_nothing(spark, tmp_path):
    out = tmp_path / "out"
    bad = frame(spark).withColumn("content", F.when(F.col("doc_id") == 33, F.raise_error(F.lit("broken")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="broken"):
        sink.write_files(bad, f"file://{out}")
    assert not list(tmp_path.iterdir())
    out.mkdir()
    (out / "old.pdf").write_bytes(b"old")
    with pytest.raises(Exception, match="broken"):
        sink.write_files(bad, f"file://{out}")
    assert held(tmp_path) == {"out/old.pdf": b"old"}


def test_task_that_ran_before(spark, tmp_path):
    """What an attempt that was killed has left is written again, and its unfinished files go."""
    writer = sink.FolderWriter({"folder": f"file://{tmp_path}/out", "job": "j", "receipt": f"file://{tmp_path}/receipt"})
    batches = frame(spark, 6).withColumn("path", F.lit(None).cast("string")).toArrow().to_batches()
    assert writer.write(iter(batches)).failed == []
    around = tmp_path / ".out.j"
    (around / "d0" / "3.pdf.abc.part").write_bytes(b"half")
    messages = [writer.write(iter(batches)), None]
    assert not (tmp_path / "out").exists()
    writer.commit(messages)
    assert held(tmp_path / "out") == {f"d{i % 3}/{i}.pdf": f"file {i}".encode() for i in range(6)} and not around.exists()
    writer.abort(messages)


def test_cut_off_commit_is_finished(spark, tmp_path):
    out, around = tmp_path / "out", tmp_path / ".out.dead"
    (out / "d0").mkdir(parents=True)
    (out / "d0" / "0.pdf").write_bytes(b"moved")
    (around / "d0").mkdir(parents=True)
    (around / "d0" / "3.pdf").write_bytes(b"left")
    (tmp_path / ".out.running").mkdir()
    assert sink.finish(f"file://{out}") == 0  # no mark: another job may be at work
    (around / sink.MARK).write_bytes(b"")
    sink.write_files(frame(spark, 1), f"file://{out}")
    assert held(out) == {"d0/0.pdf": b"file 0", "d0/3.pdf": b"left"} and not around.exists() and (tmp_path / ".out.running").exists()


def test_names_that_cannot_be_written(spark, tmp_path):
    files = spark.createDataFrame([(1, "a.pdf", bytearray(b"1")), (2, "n" * 300, bytearray(b"2")), (3, "x/../a.pdf", bytearray(b"3")), (4, "../../up.pdf", bytearray(b"4")), (5, "hdfs://host/b.pdf", bytearray(b"5"))], "doc_id long, name string, content binary")
    done = {r.doc_id: (r.written, r.error_code) for r in sink.write_files(files, f"file://{tmp_path}/out").collect()}
    assert {d for d, (_, e) in done.items() if e} == {2, 3} and done[1][0] == f"{tmp_path}/out/a.pdf"
    assert held(tmp_path / "out") == {"a.pdf": b"1", "up.pdf": b"4", "b.pdf": b"5"}

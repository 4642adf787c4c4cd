"""Files read by ranges give what whole files give, from fewer bytes; listings are packed by bytes."""

from fixtures import planted as planter
from pyspark.sql import functions as F

from vellumite.operators.sanitize import inspect
from vellumite.sources import ranges, tables
from vellumite.sources import syntax as S
from vellumite.sources.tables import parse, read_files

N = S.Name


def big_file(layout: int) -> bytes:
    """Two megabytes of a page's text, an object longer than a first read, and values that end where one does."""
    objects = {1: {N("Type"): N("Catalog"), N("Pages"): S.Ref(2, 0), N("Long"): S.Ref(5, 0), N("Edge"): S.Ref(6, 0), N("Plain"): S.Ref(7, 0)}, 2: {N("Type"): N("Pages"), N("Count"): 1, N("Kids"): [S.Ref(3, 0)]}, 3: {N("Type"): N("Page"), N("Parent"): S.Ref(2, 0), N("Contents"): S.Ref(4, 0)}}
    objects |= {4: S.Stream({}, b"0123456789abcdef" * (1 << 17)), 5: [b"x" * 50_000, 7], 6: [b"y" * (ranges.OBJECT - 22), 123456789], 7: b"z" * (ranges.OBJECT - 16)}
    file = planter.File(b"%PDF-1.5")
    for n, v in objects.items():
        file.put(n, v)
    if layout:
        file.stream_section([0, *objects, 8], {}, {N("Root"): S.Ref(1, 0)}, 8, True)
    else:
        file.table([0, *objects], {N("Root"): S.Ref(1, 0)}, 8)
    return bytes(file.data)


def test_same_tables_from_fewer_bytes(spark, tmp_path):
    docs = [*range(1, 26), 60, 72, 101, 105, 110, 164]
    (tmp_path / "sub").mkdir()
    for i in docs:
        (tmp_path / ("sub" if i % 2 else ".") / f"{i}.pdf").write_bytes(planter.pdf(i, b"page text " * 40, "en", "s", 1))
    for i in (0, 1):
        (tmp_path / f"big{i}.PDF").write_bytes(big_file(i))
    (tmp_path / "cut.pdf").write_bytes(planter.pdf(2, b"x", "en", "s", 1)[:-200])
    (tmp_path / "other.txt").write_bytes(b"no")
    (tmp_path / "empty.pdf").write_bytes(b"")
    whole, near = parse(read_files(spark, f"file://{tmp_path}")), parse(ranges.list_files(spark, f"file://{tmp_path}"))
    assert near.status.count() == len(docs) + 4
    for name in ("status", "docs", "nodes"):
        a, b = (getattr(t, name).drop("reason") for t in (whole, near))
        # Spark's own reader of files leaves out empty ones
        assert a.exceptAll(b).collect() == [] and {r.error_code for r in b.exceptAll(a).collect()} == {"emptyInput"} if name == "status" else a.exceptAll(b).collect() == [] == b.exceptAll(a).collect(), name
    big = near.docs.where("file_bytes > 2000000").join(near.taken, "doc_id").collect()
    assert len(big) == 2 and all(r.bytes_read < r.file_bytes / 4 for r in big)
    assert near.payloads.where(F.substring("payload", 1, 2) != F.expr("X'FFD8'")).isEmpty() and near.payloads.count() == whole.payloads.where(F.substring("payload", 1, 2) == F.expr("X'FFD8'")).count()


def test_files_that_are_gone_are_rows(spark, tmp_path):
    for i in (1, 3):
        (tmp_path / f"{i}.pdf").write_bytes(planter.pdf(i, b"x", "en", "s", 1))
    listed = spark.createDataFrame(ranges.list_files(spark, f"file://{tmp_path}").collect(), "doc_id long, path string, length long")
    (tmp_path / "3.pdf").unlink()
    seen = inspect(listed)
    assert sorted(r.error_code or "" for r in seen.status.collect()) == ["", "cannotRead"] and seen.findings.count() > 0


def test_partitions_hold_so_many_bytes(tmp_path):
    sizes = [10] * 50 + [3000, 5, 5, 2000]
    for i, n in enumerate(sizes):
        (tmp_path / f"{i:03d}.pdf").write_bytes(b"x" * n)
    parts = ranges.Listing({"folder": str(tmp_path), "pack": "1000"}).partitions()
    assert sorted(n for p in parts for _, n in p.files) == sorted(sizes)
    assert all(sum(n for _, n in p.files) <= 1000 or len(p.files) == 1 for p in parts) and len(parts) == 4


def test_objects_by_ranges(tmp_path):
    data = big_file(0)
    (tmp_path / "a.pdf").write_bytes(data)
    source = ranges.Ranges(f"file://{tmp_path}/a.pdf", len(data))
    entries, _ = tables.sections(source, tables.LIMITS)
    for e in entries:
        if e[5] == "used":
            n, gen, value = ranges.indirect(source, e[6])
            assert (n, gen, ranges.near(value) if isinstance(value, S.Stream) else value) == S.indirect(data, e[6])


def test_small_files_are_dealt_to_all_cores(spark, tmp_path):
    """Small files cost by number: few bytes of them are work for many tasks, and a partition has no more than PACK / OPEN files."""
    for i in range(300):
        (tmp_path / f"{i}.pdf").write_bytes(b"x" * (i % 90))
    found = ranges.list_files(spark, f"file://{tmp_path}").withColumn("part", F.spark_partition_id())
    counts = [r["count"] for r in found.groupBy("part").count().collect()]
    assert sum(counts) == 300 and len(counts) >= 2 * spark.sparkContext.defaultParallelism and max(counts) <= 40
    parts = ranges.Listing({"folder": str(tmp_path), "open": str(ranges.PACK // 7)}).partitions()
    assert sum(len(p.files) for p in parts) == 300 and max(len(p.files) for p in parts) <= 7

"""Folders in, folders out."""

import pytest

from vellumite.operators.corpus import clean_folder, corpus_check, probe
from fixtures import planted as planter
from vellumite.sources.sink import SameFolder, write_files
from vellumite.sources.tables import read_files


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    for i in (1, 2, 17, 19, 23, 24):
        (tmp_path / "in" / f"{i}.pdf").write_bytes(planter.pdf(i, b"page text", "en", "someone", 1))
    return tmp_path


def test_clean_folder(spark, folder):
    source = f"file://{folder}/in"
    before = {p.name: p.read_bytes() for p in (folder / "in").iterdir()}
    done, written = clean_folder(spark, source, f"file://{folder}/out")
    assert {r.error_code for r in written.collect()} == {None}
    out = {p.name: p.read_bytes() for p in (folder / "out").iterdir()}
    assert sorted(out) == ["1-clean.pdf", "2-clean.pdf", "24-clean.pdf"]
    assert all(b"page text" in b and b"someone" not in b for b in out.values())
    assert {p.name: p.read_bytes() for p in (folder / "in").iterdir()} == before
    assert {r.outcome: r.n for r in corpus_check(spark, f"file://{folder}/out").collect()} == {"cleaned": 3}
    assert sorted((r.error_code or "") for r in done.status.collect()) == ["", "", "", "corrupt", "encrypted", "signed"]


def test_equal_names_in_other_folders(spark, tmp_path):
    for i, name in ((2, "a/x.pdf"), (4, "b/x.pdf"), (6, "b/c d/x.pdf"), (8, "y.pdf"), (9, "y.PDF")):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(planter.pdf(i, b"text %d" % i, "en", "s", 1))
    _, written = clean_folder(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out")
    assert sorted(r.error_code or "" for r in written.collect()) == ["", "", "", "", "cannotWrite"]
    out = {str(p.relative_to(tmp_path / "out")): p.read_bytes() for p in (tmp_path / "out").rglob("*.pdf")}
    assert sorted(out) == ["a/x-clean.pdf", "b/c d/x-clean.pdf", "b/x-clean.pdf", "y-clean.pdf"]
    assert b"text 2" in out["a/x-clean.pdf"] and b"text 4" in out["b/x-clean.pdf"] and b"text 6" in out["b/c d/x-clean.pdf"]
    assert not list((tmp_path / "out").rglob("*.part"))


def test_originals_are_safe(spark, folder):
    files = read_files(spark, f"file://{folder}/in")
    with pytest.raises(SameFolder):
        write_files(files.withColumnRenamed("path", "name"), f"file://{folder}/in", f"file://{folder}/in/../in")
    (folder / "alias").symlink_to(folder / "in")
    with pytest.raises(SameFolder):
        write_files(files.withColumnRenamed("path", "name"), f"file://{folder}/alias", f"file://{folder}/in")
    same = write_files(files.selectExpr("doc_id", "path as name", "content", "path"), f"file://{folder}/alias").collect()
    assert {r.error_code for r in same} == {"cannotWrite"}


def test_probe_holds_the_size(spark, folder):
    files = read_files(spark, f"file://{folder}/in").where("path like '%/1.pdf'")
    got = probe(files, (1,)).collect()
    assert len(got) == 1 and got[0].bytes_high - got[0].bytes_low == 64 and got[0].method == "exact"


def test_scratch_is_released(spark, folder):
    from vellumite.operators.sanitize import sanitize
    from vellumite.sources import scratch

    before = scratch.made()
    done = sanitize(read_files(spark, f"file://{folder}/in"))
    assert done.files.count() == 3 and len(scratch.made()) > len(before)
    done.release()
    assert scratch.made() == before

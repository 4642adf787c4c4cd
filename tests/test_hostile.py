"""Nothing that a file says ends a job: hostile numbers, limits, and random damage to files and images."""

import random

import pyarrow as pa
import pytest
from fixtures import planted as planter
from pyspark.sql import functions as F

from vellumite.config import ERRORS, LIMITS, profile
from vellumite.operators.compress import again
from vellumite.operators.sanitize import inspect, sanitize
from vellumite.sources import syntax as S
from vellumite.sources.scratch import made as made_tables
from vellumite.sources.tables import guarded, parse, version


def frame(spark, files):
    return spark.createDataFrame([(i, len(f), bytearray(f)) for i, f in files.items()], "doc_id long, length long, content binary")


def made(i, text=b"Some text. " * 9):
    return planter.pdf(i, text, "en", "s1", 7)


def sound(left: int, layout: int) -> int:
    """An id with nothing but the rule of ``left``."""
    return next(i for i in range(1, 9000) if i % 59 == left and i % 5 == layout and i % 19 and i % 47 != 3 and i % 17 and i % 23 and i % 31 != 5 and i % 37 != 5 and i % 41 != 7)


def test_hostile_numbers_beside_a_good_file(spark):
    files = {1: made(71)} | {100 + k: planter.hostile(v) for k, v in planter.HOSTILE.items()}
    files[200] = b"%PDF-99999999999" + files[1][8:]
    files[201] = made(sound(planter.FREE, 0))
    assert b" 9999999999 f" in files[201]
    files[202] = b"%PDF-1.4\nxref\n0 1\n0000000000 65535 f \ntrailer\n<< /Root 1 0 R /Size " + b"9" * 5000 + b" >>\nstartxref\n9\n%%EOF"
    files[203] = b"%PDF-1.4\nxref\n0 1\n0000000009 99999 n \ntrailer\n<< /Root 1 0 R >>\nstartxref\n9\n%%EOF"
    got = {r.doc_id: r.error_code for r in parse(frame(spark, files)).status.collect()}
    want = {1: None, 142: "corrupt", 145: "corrupt", 146: "unsupported", 147: "unsupported", 149: "corrupt", 150: "corrupt", 201: None, 202: "unsupported", 203: "corrupt"}
    assert got.pop(200) in (None, "corrupt") and got == want  # the longer header moves all offsets


def test_far_generation_is_kept(spark):
    doc = sound(planter.REFERENCE, 1)
    done = sanitize(frame(spark, {doc: made(doc)}))
    assert b"/Font 3 3000000000 R" in bytes(done.files.first().content)


def test_lost_page_is_refused(spark):
    """A page that a clean takes for metadata would be gone from the copy: the file is refused, the good one beside it is not; the inspection of what a clean wrote needs no second clean."""
    N, file = S.Name, planter.File(b"%PDF-1.4")
    page = {N("Type"): N("Metadata"), N("Parent"): S.Ref(2, 0)}
    for n, v in {1: {N("Type"): N("Catalog"), N("Pages"): S.Ref(2, 0)}, 2: {N("Type"): N("Pages"), N("Count"): 2, N("Kids"): [S.Ref(3, 0), S.Ref(4, 0)]}, 3: {N("Type"): N("Page"), N("Parent"): S.Ref(2, 0)}, 4: page}.items():
        file.put(n, v)
    file.table([*range(5)], {N("Root"): S.Ref(1, 0)}, 5)
    held = len(made_tables())
    done = sanitize(frame(spark, {1: bytes(file.data), 72: made(72)}))
    assert len(made_tables()) - held <= 33
    got = {r.doc_id: (r.error_code, r.reason) for r in done.status.collect()}
    assert got == {1: ("corrupt", "pages changed"), 72: (None, None)} and [r.doc_id for r in done.files.select("doc_id").collect()] == [72]
    whole = inspect(done.files)
    for name in ("residuals", "images", "inventory", "findings"):
        a, b = getattr(done.after, name).where("doc_id = 72"), getattr(whole, name)
        assert a.exceptAll(b).collect() == [] == b.exceptAll(a).collect(), name
    assert done.after.kept.where("doc_id = 72").count() == whole.kept.count()


def test_versions():
    assert version(b"%PDF-99999999999") == (99, 4) and version(b"%PDF-1.7") == (1, 7) and version(b"%PDF-2.0 ") == (2, 0) and version(b"%PDF-") == (1, 4)


@pytest.mark.parametrize("text", [b"5 99999999999999999999 R", b"99999999999999999999 0 R"])
def test_numbers_out_of_range(text):
    with pytest.raises(S.Bad):
        S.read(b"[ " + text + b" ]", 0)


def test_large_integers_are_reals():
    assert S.read(b"[ 9223372036854775807 9223372036854775808 -9223372036854775809 " + b"9" * 6000 + b" ]", 0)[0] == [2**63 - 1, 2.0**63, -(2.0**63), float("inf")]


def test_rows_that_fit_no_column_cost_their_file_only():
    schema = pa.schema([("doc", pa.int64()), ("n", pa.int32())])
    files = [(i, b"x" * 10, [(i, 1 << 40 if i % 3 == 0 else i)]) for i in range(10)]
    rows = [r for b in guarded(iter(files), lambda doc, e: (doc, -1), schema) for r in b.to_pylist()]
    assert [r["n"] for r in rows] == [-1 if i % 3 == 0 else i for i in range(10)]


def test_oversize_is_not_read(spark):
    files = spark.createDataFrame([(1, LIMITS.input_bytes + 1, bytearray(b"")), (2, 0, bytearray(b""))], "doc_id long, length long, content binary")
    assert {r.doc_id: r.error_code for r in parse(files).status.collect()} == {1: "oversize", 2: "emptyInput"}


def test_random_damage_to_files(spark):
    """2,000 files with up to eight bytes changed, cut or doubled: each comes back with a status, and what is cleaned can be read again."""
    rng = random.Random(3)
    docs = [i for i in range(1, 400) if i % 59 not in planter.HOSTILE and i % 31 != 5 and i % 37 != 5 and i % 23][:40]
    whole = [made(i) for i in docs]
    files = {}
    for i in range(2000):
        data = bytearray(whole[i % len(whole)])
        for _ in range(rng.randrange(1, 9)):
            at, what = rng.randrange(len(data)), rng.random()
            if what < 0.6:
                data[at] = rng.choice([rng.randrange(256), *b"0123456789<>[]()/R "])
            elif what < 0.8:
                del data[at : at + rng.randrange(1, 20)]
            else:
                data[at:at] = rng.choice([b"9" * 12, b"99999999999999999999", b" 0 R", b"<<", b"65535", b"-"])
        files[i] = bytes(data)
    done = sanitize(frame(spark, files))
    status = {r.doc_id: r.error_code for r in done.status.collect()}
    assert status.keys() == files.keys() and set(status.values()) <= {None, *ERRORS}
    good = {i for i, c in status.items() if c is None}
    assert len(good) > 50 and {r.doc_id for r in done.files.select("doc_id").collect()} == good
    assert done.after.status.where(F.col("error_code").isNotNull()).join(done.files.select("doc_id"), "doc_id").count() == 0


def test_random_damage_to_images():
    rng = random.Random(4)
    photo, told = planter.PHOTO, 0
    frame_at = photo.index(b"\xff\xc0")
    zero = bytearray(photo)
    zero[frame_at + 11] = 0  # sampling factors of the first component
    assert again(bytes(zero), 160, 120, False, (80, 60), profile(2)) is None
    for _ in range(150):
        data = bytearray(photo)
        for _ in range(rng.randrange(1, 5)):
            data[rng.randrange(2, 700)] = rng.randrange(256)
        told += again(bytes(data), 160, 120, False, (80, 60), profile(2)) is None
    assert told > 10

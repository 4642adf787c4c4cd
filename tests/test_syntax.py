"""Values, sections and refusals on bytes made by hand."""

import zlib

import pytest

from vellumite.config import LIMITS, Limits
from vellumite.functions import jpeg
from fixtures import planted as planter
from vellumite.sources import tables
from vellumite.sources import syntax as S


@pytest.mark.parametrize(
    "text, value",
    [
        (b"null", None), (b"true", True), (b"-17", -17), (b"+4.50", 4.5), (b".5", 0.5), (b"/A#42c", S.Name("ABc")), (b"(a\\(b\\)\\101(c)\\\nd)", b"a(b)A(c)d"),
        (b"<4 1 4>", S.Hex(b"A@")), (b"[1 2 0 R (x)]", [1, S.Ref(2, 0), b"x"]), (b"<< /A 1 /A 2 % note\n /B << >> >>", {"A": 2, "B": {}}),
    ],
)
def test_values(text, value):
    got, _ = S.read(text, 0)
    assert got == value and type(got) is type(value)


@pytest.mark.parametrize("text", [b"", b"[1", b"(open", b"<4x>", b"<< /A >>", b"<< 1 2 >>", b"99999999999999999999 0 R", b"[" * 300 + b"]" * 300])
def test_damaged_values(text):
    with pytest.raises(S.Bad):
        S.read(text, 0)


@pytest.mark.parametrize("number, text", [(1.0, b"1"), (0.1, b"0.1"), (1e-7, b"0.0000001"), (-2.5, b"-2.5"), (1e20, b"100000000000000000000"), (float("nan"), b"0"), (float("inf"), b"0")])
def test_reals_have_no_exponent(number, text):
    assert S.real(number) == text


def test_written_values_read_back():
    value = {S.Name("a b"): [S.Name("x#y"), b"(\\)\r\n\t", S.Hex(b"\x00\xff"), S.Ref(3, 1), None, False, 1.25]}
    assert S.read(S.written(value), 0)[0] == value


def test_predictors():
    data = bytes([0, 10, 20, 30, 1, 5, 5, 5, 2, 1, 1, 1, 3, 2, 2, 2, 4, 1, 1, 1])
    assert list(S.unpredict(data, 3)) == [10, 20, 30, 5, 10, 15, 6, 11, 16, 5, 10, 15, 6, 11, 16]


def test_inflate_keeps_its_budget():
    data = zlib.compress(b"x" * 1000)
    budget = [1000]
    assert S.inflate(data, budget) == b"x" * 1000 and budget == [0]
    for cut, room in ((data, 999), (data[:-3], 5000)):
        with pytest.raises(S.Bad):
            S.inflate(cut, [room])


def test_jpeg_scrub():
    assert len(planter.JPEG) == 200
    clean = jpeg.scrub(planter.JPEG)
    assert len(clean) == 156 and b"Exif" not in clean and b"Photoshop" not in clean
    assert clean[:2] == b"\xff\xd8" and clean[-2:] == b"\xff\xd9" and jpeg.scrub(clean) == clean
    assert jpeg.scrub(b"GIF89a") == b"GIF89a"


@pytest.mark.parametrize("doc", [i for i in range(1, 60) if i not in planter.HOSTILE])
def test_all_layouts_give_the_same_objects(doc):
    data = planter.pdf(doc, b"text \xc3\xa9 (", "en", "src", 7)
    wanted, _ = planter.objects_of(doc, b"text \xc3\xa9 (", "en", "src", 7)
    if doc % 31 == 5 or doc % 37 == 5:
        assert not data.startswith(b"%PDF-")
        return
    if doc % 23 == 0:
        with pytest.raises(S.Bad):
            tables.sections(data, LIMITS)
        return
    entries, trailer = tables.sections(data, LIMITS)
    last, best = {(e[3], e[0], e[2] == 1): e for e in sorted(entries, key=lambda e: (e[0], e[1]))}, {}
    for e in sorted(last.values(), key=lambda e: (e[3], e[0], e[2])):
        best.setdefault(e[3], e)
    names = ("section_seq", "place", "priority", "obj", "gen", "kind", "offset", "stream", "idx")
    objects = tables.Objects(data, [dict(zip(names, e, strict=True)) for e in best.values() if e[5] != "free"], LIMITS)
    got = {n: objects.get(n)[1] for n in sorted(objects.entries)}
    got = {n: v for n, v in got.items() if not (isinstance(v, S.Stream) and v.dict.get("Type") in ("ObjStm", "XRef"))}
    lengths = {n for n, v in got.items() if n not in wanted and isinstance(v, int)}  # streams' lengths, by reference
    assert {n: S.written(v) for n, v in got.items() if n not in lengths} == {n: S.written(v) for n, v in wanted.items()}


def test_sections_that_point_at_each_other():
    data = b"%PDF-1.4\n"
    first = len(data)
    data += b"xref\n0 1\n0000000000 65535 f \ntrailer << /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF" % (first, first)
    with pytest.raises(S.Bad):
        tables.sections(data, Limits())

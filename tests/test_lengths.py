"""Sizes from lengths alone against the files that a clean writes, at all levels, with values of every kind."""

from fixtures import planted as planter

from vellumite.config import REWRITE_ONLY
from vellumite.functions import sizes
from vellumite.operators.lengths import exact_sizes
from vellumite.operators.sanitize import inspect, sanitize
from vellumite.sources.syntax import Hex, Name, Ref, Stream

N = Name


def odd_file() -> bytes:
    """All kinds of values: escapes, odd names, reals, nested arrays, lengths that are no stream's, parameters of a filter that is not there."""
    values = [None, True, False, 0, -12, 10**15, 0.5, -1e-7, 1e20, 3.0, b"", b"(a)\\\r\n\t", bytes(range(256)), Hex(b""), Hex(b"\x00\xff"), N(""), N("a b#/é\x00"), [], [[]], [1, [2, [3, b")"]]], {}, {N("Length"): 7, N("K y"): {N("\xff"): [Ref(3, 0)]}}, Ref(3, 70000)]
    objects = {
        1: {N("Type"): N("Catalog"), N("Pages"): Ref(2, 0), N("Odd"): values, N("More"): Ref(12, 0), N("Streams"): [Ref(5, 0), Ref(6, 0), Ref(7, 0), Ref(8, 0), Ref(9, 0)]},
        2: {N("Type"): N("Pages"), N("Count"): 1, N("Kids"): [Ref(3, 0)]},
        3: {N("Type"): N("Page"), N("Parent"): Ref(2, 0), N("Length"): 99},
        5: Stream({N("DecodeParms"): [{N("Predictor"): 1}], N("DP"): None}, b"pack me " * 400),
        6: Stream({}, b""),
        7: Stream({N("Type"): N("XObject"), N("Subtype"): N("Image"), N("Width"): 160, N("Height"): 120, N("BitsPerComponent"): 8, N("ColorSpace"): N("DeviceRGB"), N("Filter"): [N("DCTDecode")], N("DecodeParms"): [None]}, planter.PHOTO),
        8: Stream({N("Filter"): N("DCTDecode"), N("Width"): 8}, planter.JPEG),
        9: Stream({N("Extra"): [b"\\"]}, bytes(range(256)) * 3),
        12: values,
    }
    file = planter.File(b"%PDF-1.6")
    for n, v in objects.items():
        file.put(n, v)
    file.table([0, *objects], {N("Root"): Ref(1, 0), N("Kept"): [b"(", 0.25]}, 13)
    return bytes(file.data)


def frame(spark, files):
    return spark.createDataFrame([(i, len(f), bytearray(f)) for i, f in files.items()], "doc_id long, length long, content binary")


def test_all_levels_equal_what_is_written(spark):
    files = frame(spark, {1: odd_file(), 72: planter.pdf(72, b"text " * 90, "en", "s", 5), 56: planter.pdf(56, b"x", "en", "s", 5), 19: planter.pdf(19, b"signed", "en", "s", 5), 23: b"%PDF-1.4"})
    seen = inspect(files)
    told = {(r.doc_id, r.level): r.length for r in exact_sizes(seen, levels=(0, 1, 4)).collect()}
    for level in (0, 1, 4):
        made = {r.doc_id: r.length for r in sanitize(files, level=level, before=seen).files.collect()}
        assert {d: n for (d, at), n in told.items() if at == level} == made and made.keys() == {1, 56, 72}
    assert told[1, 1] < told[1, 0] and told[72, 4] < told[72, 1] < told[72, 0]
    rewritten = {r.doc_id: r.length for r in sanitize(files, REWRITE_ONLY, before=seen).files.collect()}
    assert {r.doc_id: r.length for r in exact_sizes(seen, REWRITE_ONLY, (0,)).collect()} == rewritten and rewritten[72] > told[72, 0]


def test_probe_skips_large_files(spark):
    large = spark.createDataFrame([(1, 0, 500, 16 << 20), (2, 0, 500, 15 << 20)], "doc_id long, level int, length long, input_bytes long")
    assert [r.doc_id for r in sizes.probed(large).collect()] == [2]

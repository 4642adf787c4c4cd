"""Operators on small tables of values made by hand, and the gate, the sink and the stream."""

import pytest
from pyspark.sql import functions as F

from vellumite.config import Limits, profile
from vellumite.operators import inspect as I
from vellumite.operators import objects as O
from vellumite.operators import reach
from fixtures import planted as planter
from vellumite.sources import tables
from vellumite.sources import syntax as S


def one_file(objects, trailer, head=b"%PDF-1.4"):
    file = planter.File(head)
    for n, v in objects.items():
        file.put(n, v)
    file.table([*range(max(objects) + 1)], trailer, max(objects) + 1)
    return bytes(file.data)


def parsed(spark, *contents):
    files = spark.createDataFrame([(i, len(c) if c is not None else 0, c) for i, c in enumerate(contents)], "doc_id long, length long, content binary")
    return tables.parse(files)


def base(**extra):
    N = S.Name
    catalog = {N("Type"): N("Catalog"), N("Pages"): S.Ref(2, 0)} | {N(k): v for k, v in extra.items()}
    return {1: catalog, 2: {N("Type"): N("Pages"), N("Kids"): [S.Ref(3, 0)], N("Count"): 1}, 3: {N("Type"): N("Page"), N("Parent"): S.Ref(2, 0)}}


TRAILER = {S.Name("Root"): S.Ref(1, 0)}


def test_gate(spark):
    files = spark.createDataFrame([(0, 0, b""), (1, 9, b"%PDF-1.4x"), (3, 999, b"%PDF-" + b"x" * 994), (4, 9, b"%PDF-1.4x"), (4, 9, b"%PDF-1.4y")], "doc_id long, length long, content binary")
    got = {r.doc_id: r.error_code for r in tables.gate(files, Limits(input_bytes=500)).collect()}
    assert got == {0: "emptyInput", 1: None, 3: "oversize", 4: "cannotRead"}
    status = {r.doc_id: r.error_code for r in tables.parse(files.unionByName(files.selectExpr("doc_id + 10 as doc_id", "5L as length", "cast(null as binary) as content")), Limits(input_bytes=500)).status.collect()}
    assert status == {0: "emptyInput", 1: "corrupt", 3: "oversize", 4: "cannotRead", 10: "cannotRead", 11: "cannotRead", 13: "cannotRead", 14: "cannotRead"}


def test_content_of_large_files_is_not_read(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(one_file(base(), TRAILER))
    (tmp_path / "in" / "b.pdf").write_bytes(b"%PDF-1.4" + bytes(5000))
    files = tables.read_files(spark, f"file://{tmp_path}/in")
    got = sorted(r.error_code or "" for r in tables.parse(files, Limits(input_bytes=2000)).status.collect())
    assert got == ["", "oversize"]


def test_damage_is_a_row_not_a_failure(spark):
    good = one_file(base(), TRAILER)
    wrong_number = good.replace(b"3 0 obj", b"4 0 obj")
    t = parsed(spark, good, good[:60], wrong_number, b"", b"junk", one_file(base(), TRAILER | {S.Name("Encrypt"): {}}))
    got = {r.doc_id: r.error_code for r in t.status.collect()}
    assert got == {0: None, 1: "corrupt", 2: "corrupt", 3: "emptyInput", 4: "notPDF", 5: "encrypted"}
    assert {r.doc_id for r in t.nodes.select("doc_id").distinct().collect()} == {0}


def test_page_trees(spark):
    N = S.Name
    cyclic, missing, bare = base(), base(), base()
    cyclic[3] = {N("Kids"): [S.Ref(2, 0)]}
    missing[2][N("Kids")] = [S.Ref(9, 0)]
    bare[2] = {N("Type"): N("Pages")}
    nested = base() | {4: {N("Type"): N("Page")}, 5: {N("Kids"): [S.Ref(3, 0), S.Ref(4, 0)]}}
    nested[2][N("Kids")] = [S.Ref(5, 0)]
    apart = base() | {4: {N("Type"): N("Page")}, 5: [S.Ref(3, 0), S.Ref(4, 0)]}
    apart[2][N("Kids")] = S.Ref(5, 0)
    number, dangling, doubled, empty = base(), base(), base(), base()
    number[2][N("Kids")], dangling[2][N("Kids")], doubled[2][N("Kids")], empty[2][N("Kids")] = 7, S.Ref(99, 0), [S.Ref(2, 0), S.Ref(2, 0)], []
    deep = base() | {3 + i: {N("Kids"): [S.Ref(4 + i, 0)]} for i in range(2000)} | {2003: {N("Type"): N("Page")}}
    t = parsed(spark, *(one_file(o, TRAILER) for o in (base(), cyclic, missing, bare, nested, apart, number, dangling, doubled, empty, deep)))
    assert {r.doc_id: r.pages for r in reach.page_counts(t.nodes).collect()} == {0: 1, 1: None, 2: None, 3: 1, 4: 2, 5: 2, 6: None, 7: None, 8: None, 9: 0, 10: 1}


@pytest.mark.parametrize(
    "extra, signed",
    [
        ({"ByteRange": [1]}, False), ({"ByteRange": [1], "Contents": b"x"}, True), ({"FT": S.Name("Sig")}, False), ({"FT": S.Name("Sig"), "V": None}, False),
        ({"FT": S.Name("Sig"), "V": S.Ref(9, 0)}, True), ({"X": [{S.Name("Type"): S.Name("Sig")}]}, True), ({"Filter": b"x ADBE.pkcs7 y"}, True), ({"Perms": {}}, False), ({"X": {S.Name("Y"): [{S.Name("Perms"): {S.Name("UR3"): 1}}]}}, True), ({"X": {S.Name("Perms"): {S.Name("A"): 1}}}, False), ({"Perms": {S.Name("A"): 1}}, True),
    ],
)
def test_signatures(spark, extra, signed):
    t = parsed(spark, one_file(base(**extra), TRAILER))
    assert (O.signed(t.nodes).count() == 1) is signed


def test_reachability_ignores_dangling_cycles_and_orphans(spark):
    objects = base(Extra=S.Ref(77, 0)) | {4: {S.Name("Self"): S.Ref(4, 0)}}
    t = parsed(spark, one_file(objects, TRAILER))
    assert {r.obj for r in reach.reachable(t.nodes).collect()} == {1, 2, 3, 77}
    assert {r.obj for r in reach.sweep(t.nodes).select("obj").distinct().collect()} == {-1, 1, 2, 3}


def test_chains_of_any_depth(spark):
    N = S.Name
    chain = base(Outlines=S.Ref(10, 0)) | {10 + i: {N("Next"): S.Ref(11 + i, 0)} for i in range(2000)} | {2010: {N("Last"): True}, 3000: {N("Orphan"): True}}
    t = parsed(spark, one_file(chain, TRAILER), one_file(base(), TRAILER))
    assert {r.doc_id: r.n for r in reach.reachable(t.nodes).groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {0: 2004, 1: 3}


def test_the_last_of_entries_listed_twice_counts(spark):
    good = one_file(base(), TRAILER)
    at = good.index(b"xref\n") + 5
    place = lambda n: b"%010d 00000 n \n" % good.index(b"%d 0 obj" % n)
    twice = good[:at] + b"3 1\n" + place(1) + good[at:]
    used_then_free = good.replace(b"trailer", b"3 1\n0000000000 00000 f \ntrailer")
    t = parsed(spark, twice, used_then_free)
    assert {r.doc_id: r.error_code for r in t.status.collect()} == {0: None, 1: None}
    assert {(r.doc_id, r.obj) for r in t.nodes.where("node_id = 0 and obj >= 0").select("doc_id", "obj").collect()} == {(0, 1), (0, 2), (0, 3), (1, 1), (1, 2)}


def test_bad_hybrids_and_streams_inside_object_streams(spark):
    N = S.Name
    bad = [one_file(base(), TRAILER | {N("XRefStm"): v}) for v in (b"x", 10**9, -1)]
    file = planter.File(b"%PDF-1.5")
    file.put(4, S.Stream({N("Type"): N("ObjStm"), N("N"): 1, N("First"): 4}, b"5 0 << /Length 1 >> stream\nx\nendstream"))
    for n, v in base().items():
        file.put(n, v)
    file.stream_section([*range(7)], {5: (4, 0)}, TRAILER, 6, False)
    t = parsed(spark, *bad, bytes(file.data))
    assert {r.doc_id: r.error_code for r in t.status.collect()} == dict.fromkeys(range(4), "corrupt")


def test_packable_streams(spark):
    N = S.Name
    cases = [({}, True), ({N("Subtype"): N("Image")}, True), ({N("Type"): N("XObject"), N("Subtype"): N("Image")}, False), ({N("Type"): N("Metadata")}, False), ({N("F"): b"x"}, False), ({N("Filter"): N("LZWDecode")}, False)]
    objects = base() | {4 + i: S.Stream(c, b"a" * 100) for i, (c, _) in enumerate(cases)}
    got = {r.obj: r.ok for r in O.objects(parsed(spark, one_file(objects, TRAILER)).nodes).where("kind = 'stream'").select("obj", O.packable().alias("ok")).collect()}
    assert got == {4 + i: ok for i, (_, ok) in enumerate(cases)}


def test_many_custom_keys_keep_their_order(spark):
    N = S.Name
    info = {N(f"K{i:04d}"): b"v" for i in range(1200)} | {N("Real"): 12345678901.5, N("Tiny"): 1e-7}
    t = parsed(spark, one_file(base() | {4: info}, TRAILER | {N("Info"): S.Ref(4, 0), N("ID"): [S.Hex(b"A" * 16)] * 2}))
    rows = I.findings(t.nodes, I.flags(t.nodes, O.objects(t.nodes))).orderBy("ord").collect()
    assert [r.label for r in rows] == sorted(info) + [I.FILE_ID] and len({r.ord for r in rows}) == len(rows)
    assert {r.label: r.value for r in rows if r.label in ("Real", "Tiny")} == {"Real": "12345678901.5", "Tiny": "0.0000001"}


def test_info_quirks(spark):
    N = S.Name
    objects = base() | {4: {N("Title"): S.Ref(5, 0), N("Custom"): S.Ref(5, 0), N("Blank"): b"  ", N("Empty"): b"", N("Author"): b"\xff\xe9 \n", N("Trapped"): N("True")}, 5: {N("a"): 1}}
    t = parsed(spark, one_file(objects, TRAILER | {N("Info"): S.Ref(4, 0)}))
    facts = I.flags(t.nodes, O.objects(t.nodes))
    got = {(r.label, r.value) for r in I.findings(t.nodes, facts).collect()}
    assert got == {("Author", "\xff\xe9"), ("Custom", "(non-text value)"), ("Empty", "(non-text value)")}


def test_image_eligibility(spark):
    N = S.Name
    image = {N("Type"): N("XObject"), N("Subtype"): N("Image"), N("Filter"): N("DCTDecode"), N("ColorSpace"): N("DeviceRGB")}
    cases = [({}, True), ({N("BitsPerComponent"): 8}, True), ({N("BitsPerComponent"): 4}, False), ({N("ColorSpace"): N("DeviceCMYK")}, False), ({N("SMask"): S.Ref(9, 0)}, False), ({N("ImageMask"): False}, True), ({N("ImageMask"): True}, False), ({N("Filter"): [N("DCTDecode")]}, True), ({N("Filter"): [N("DCTDecode"), N("DCTDecode")]}, False), ({N("Filter"): [N("FlateDecode"), N("DCTDecode")]}, False), ({N("Filter"): [[N("DCTDecode")]]}, False)]
    objects = base() | {4 + i: S.Stream(image | c, planter.JPEG) for i, (c, _) in enumerate(cases)}
    t = parsed(spark, one_file(objects, TRAILER))
    got = {r.obj: r.ok for r in O.objects(t.nodes).where("kind = 'stream'").select("obj", O.eligible().alias("ok")).collect()}
    assert got == {4 + i: ok for i, (_, ok) in enumerate(cases)}


def test_profiles_are_clamped():
    assert profile(-3).level == 0 and profile(9).level == 4


def test_folder_and_stream_read_the_same(spark, sf, tmp_path):
    from vellumite.streaming.ingest import each_batch

    for i in (1, 2, 3):
        (tmp_path / "in" / "sub").mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / "sub" / f"{i}.{'PDF' if i == 2 else 'pdf'}").write_bytes(planter.pdf(i, b"x", "en", "s", 1))
    (tmp_path / "in" / "note.txt").write_text("no")
    batch = {(r.path, r.length) for r in tables.read_files(spark, f"file://{tmp_path}/in").select("path", "length").collect()}
    met = []
    each_batch(spark, f"file://{tmp_path}/in", str(tmp_path / "check"), lambda df, n: met.extend(df.select("path", "length").collect())).awaitTermination()
    assert len(batch) == 3 and {(r.path, r.length) for r in met} == batch


def test_offsets_and_gaps(spark):
    from vellumite.operators import write

    parts = spark.createDataFrame([(1, 1, b"abc"), (1, 4, b"de"), (2, 2, b"f")], "doc_id long, obj long, body binary").withColumn("gen", F.lit(0))
    placed = write.offsets(parts, 10)
    assert {(r.doc_id, r.obj): r.offset for r in placed.collect()} == {(1, 1): 10, (1, 4): 13, (2, 2): 10}
    assert {(r.doc_id, r.obj) for r in write.gaps(placed).where("offset is null").collect()} == {(1, 0), (1, 2), (1, 3), (2, 0), (2, 1)}


def test_images_encoded_again(spark):
    """Levels 2 to 4: never larger, as large as the level allows, gray where nearly gray, masks and odd images left, no metadata."""
    import numpy as np

    from vellumite.functions import jpeg_codec as J
    from vellumite.operators.sanitize import report, sanitize

    N = S.Name
    y, x = np.mgrid[:700, :1000]
    waves = lambda *shift: np.clip(np.stack([100 + 15 * s + 60 * np.sin(x / (5 + s)) * np.cos(y / 9) + 30 * ((x * 7 + y * 3) % 5 / 5 - 0.5) for s in shift], -1), 0, 255).astype(np.uint8)
    exif = b"\xff\xe1\x00\x16Exif\x00\x00" + b"E" * 14
    colour, nearly, gray = (J.encode(i, 1.0) for i in (waves(0, 2, 4), waves(1, 1, 1), waves(3)))
    colour = colour[:2] + exif + colour[2:]
    image = lambda space, **more: {N("Type"): N("XObject"), N("Subtype"): N("Image"), N("Width"): 1000, N("Height"): 700, N("ColorSpace"): N(space), N("Filter"): N("DCTDecode")} | {N(k): v for k, v in more.items()}
    streams = {4: S.Stream(image("DeviceRGB", DecodeParms={N("ColorTransform"): 1}), colour), 5: S.Stream(image("DeviceRGB"), nearly), 6: S.Stream(image("DeviceGray"), gray), 7: S.Stream(image("DeviceGray"), colour), 8: S.Stream(image("DeviceGray"), gray), 9: S.Stream(image("DeviceRGB", SMask=S.Ref(8, 0)), nearly)}
    streams[10] = S.Stream(image("DeviceRGB"), planter.JPEG)
    objects = base(Held=[S.Ref(n, 0) for n in streams]) | streams
    files = spark.createDataFrame([(1, len(c), c) for c in [one_file(objects, TRAILER)]], "doc_id long, length long, content binary")
    from vellumite.operators.sanitize import inspect

    seen, last = inspect(files), None
    for level, edge in ((2, 1600), (4, 900)):
        done = sanitize(files, level=level, before=seen)
        told = report(done, level).first()
        after = {r.obj: r for r in done.after.objects.where("kind = 'stream'").collect()}
        payloads = {r.obj: r.payload for r in done.after.tables.payloads.collect()}
        assert told.images_recompressed == 3 and told.image_count == 7 and "re-encoded 3 of 7 images" in told.message
        for n in (4, 5, 6):
            assert after[n].width == min(1000, edge) and len(payloads[n]) < len(streams[n].data) and b"Exif" not in payloads[n]
            assert after[n].color_space == ("DeviceGray" if n == 6 or level == 4 and n == 5 else "DeviceRGB") and after[n]["bits"] == 8
            assert J.decode(payloads[n]).shape == (after[n].height, after[n].width, 1 if after[n].color_space == "DeviceGray" else 3)
        assert "DecodeParms" not in after[4]["keys"]
        assert all(payloads[n] == J_scrubbed(streams[n].data) for n in (7, 8, 9, 10))
        assert last is None or told.bytes_after < last
        last = told.bytes_after


def J_scrubbed(data):
    from vellumite.functions.jpeg import scrub

    return scrub(data)

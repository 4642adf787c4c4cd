"""PDF files made from the rows of ``documents``, by arithmetic on their ids. Test data of the queries, not a feature.

The rules stand in the README; what each file must yield follows from its row
alone, so SQL over ``documents`` can say what every query must return.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vellumite.config import LIMITS
from vellumite.functions.jpeg_codec import encode
from vellumite.sources.syntax import Hex, Name, Ref, Stream, written

XMP, ATTACHMENT, PROFILE = b"x" * 64, b"a" * 32, b"p" * 16
#: SOI, APP1 (Exif), APP13, a quantisation table, filler after SOS, EOI: 200 bytes.
JPEG = b"\xff\xd8" + b"\xff\xe1\x00\x16Exif\x00\x00" + b"E" * 14 + b"\xff\xed\x00\x12Photoshop" + b"P" * 7 + b"\xff\xdb\x00\x43" + bytes(65) + b"\xff\xda\x00\x08" + bytes(6) + b"s" * 73 + b"\xff\xd9"


def photo() -> bytes:
    """A picture of 160 by 120, all waves, at a quality that any level undercuts."""
    y, x = np.mgrid[:120, :160]
    planes = [128 + 60 * np.sin(x / (3 + c)) * np.cos(y / (2 + c)) + 60 * ((x * 7 + y * 13 + 5 * c) % 11 / 11 - 0.5) for c in range(3)]
    return encode(np.clip(np.stack(planes, -1), 0, 255).astype(np.uint8), 1.0)


PHOTO = photo()


def objects_of(doc: int, text: bytes, lang: str, source: str, n_chars: int) -> tuple[dict[int, object], dict]:
    """Objects by number and the trailer."""
    N, pages, objects = Name, 1 + doc % 3, {}

    def add(value: object) -> Ref:
        objects[len(objects) + 1] = value
        return Ref(len(objects), 0)

    catalog = {N("Type"): N("Catalog")}
    root, tree = add(catalog), {N("Type"): N("Pages"), N("Count"): pages}
    top = add(tree)
    catalog[N("Pages")] = top
    font = add({N("Type"): N("Font"), N("Subtype"): N("Type1"), N("BaseFont"): N("Helvetica")})
    annotations = [add({N("Type"): N("Annot"), N("Subtype"): N("Text"), N("Rect"): [0, 0, 9, 9], N("T"): source.encode(), N("M"): b"D:20240101"}) for _ in range(doc % 4)]
    annotations.append(add({N("Type"): N("Annot"), N("Subtype"): N("Widget"), N("Rect"): [0, 0, 9, 9], N("T"): b"field"}))
    kids, resources = [], {N("Font"): {N("F1"): font}}
    if doc % 12 == 0:
        image = {N("Type"): N("XObject"), N("Subtype"): N("Image"), N("Width"): 8, N("Height"): 8, N("BitsPerComponent"): 8, N("ColorSpace"): N("DeviceRGB"), N("Filter"): N("DCTDecode")}
        held = resources[N("XObject")] = {N("Im1"): add(Stream(image | ({N("Filter"): [N("DCTDecode")]} if doc % 24 else {}), JPEG))}
        if doc % 24 == 0:  # an image and its mask: neither is encoded again
            held[N("Im2")] = add(Stream(image | {N("SMask"): add(Stream(image, JPEG))}, JPEG))
    if doc % 36 == 0:
        image = {N("Type"): N("XObject"), N("Subtype"): N("Image"), N("Width"): 160, N("Height"): 120, N("BitsPerComponent"): 8, N("ColorSpace"): N("DeviceRGB"), N("Filter"): N("DCTDecode")}
        resources[N("XObject")][N("Photo")] = add(Stream(image, PHOTO))
    for i in range(pages):
        page = {N("Type"): N("Page"), N("Parent"): top, N("MediaBox"): [0, 0, 612, 792], N("Resources"): resources, N("Contents"): add(Stream({}, text))}
        if i == 0:
            page[N("Annots")] = annotations
            if doc % 6 == 0:
                page[N("Metadata")] = add(Stream({N("Type"): N("Metadata"), N("Subtype"): N("XML")}, XMP))
        kids.append(add(page))
    if doc % 41 == 7:  # the tree holds itself
        kids.append(top)
    tree[N("Kids")] = add(kids) if doc % 6 == 1 else kids
    if doc % 6 == 1:
        tree[N("Count")] = add(pages)
    if doc % 97 == 3:  # a chain far deeper than any nesting
        link = add({N("Last"): True})
        for _ in range(599):
            link = add({N("Next"): link})
        catalog[N("Outlines")] = link
    if doc % 4 == 0:
        catalog[N("Metadata")] = add(Stream({N("Type"): N("Metadata"), N("Subtype"): N("XML")}, XMP))
    if doc % 7 == 0:
        catalog[N("PieceInfo")] = add({N("App"): {N("LastModified"): b"D:20240101"}})
    if doc % 11 == 0:
        catalog[N("OpenAction")] = add({N("S"): N("JavaScript"), N("JS"): b"app.beep()"})
    if doc % 13 == 0:
        file = add(Stream({N("Type"): N("EmbeddedFile")}, ATTACHMENT))
        catalog[N("AF")] = [add({N("Type"): N("Filespec"), N("F"): b"a.txt", N("EF"): {N("F"): file}})]
    if doc % 10 == 0:
        profile = add(Stream({N("N"): 3}, PROFILE))
        catalog[N("OutputIntents")] = [add({N("Type"): N("OutputIntent"), N("DestOutputProfile"): profile})]
    if doc % 9 == 0:
        catalog[N("AcroForm")] = {N("Fields"): [add({N("FT"): N("Sig"), N("T"): b"sign here"})]}
    if doc % 19 == 0:
        catalog[N("Perms")] = {N("DocMDP"): add({N("Type"): N("Sig"), N("Filter"): N("Adobe.PPKLite")})}
    if doc % 59 == REFERENCE:
        catalog[N("Font")] = Ref(font.obj, 3_000_000_000)
    if doc % 47 == 3:  # usage rights, not where the catalog has them
        catalog[N("Extra")] = {N("Deep"): [{N("Perms"): {N("UR"): True}}]}
    info = {N("Title"): b"doc-%d" % doc, N("Author"): source.encode()}
    if doc % 2 == 0:
        info[N("Subject")] = lang.encode()
    if doc % 3 == 0:
        info[N("XChars")] = n_chars
    if doc % 43 == 3:
        info = {}
    trailer = {N("Root"): root, N("Info"): add(info)}
    if doc % 8 == 0:
        add({N("Orphan"): True})
    if doc // 5 % 2 == 0:
        trailer[N("ID")] = [Hex(b"A" * 16), Hex(b"A" * 16)]
    if doc % 17 == 0:
        trailer[N("Encrypt")] = {N("Filter"): N("Standard")}
    return objects, trailer


class File:
    """Bytes under construction, and where their objects are."""

    def __init__(self, head: bytes):
        self.data, self.places, self.free = bytearray(head + b"\n%\xe2\xe3\xcf\xd3\n"), {}, b"65535"

    def put(self, obj: int, value: object, length: int | None = None) -> None:
        """``length``: the object that holds a stream's length, written before it."""
        if length is not None:
            self.put(length, len(value.data))
        self.places[obj] = len(self.data)
        if length is None:
            body = written(value)
        else:
            body = written(value.dict | {Name("Length"): Ref(length, 0)}) + b"\nstream\n" + value.data + b"\nendstream"
        self.data += b"%d 0 obj\n" % obj + body + b"\nendobj\n"

    def table(self, numbers: list[int], trailer: dict, size: int, wrong_first: bool = False) -> int:
        """A classic section for ``numbers``; absent ones are free. ``wrong_first``: object 1 is listed twice, first at a wrong place."""
        at = len(self.data)
        self.data += b"xref\n" + (b"1 1\n%010d 00000 n \n" % self.places[2] if wrong_first else b"")
        for n in numbers:
            place = self.places.get(n)
            self.data += b"%d 1\n" % n + (b"%010d 00000 n \n" % place if place else b"0000000000 " + self.free + b" f \n")
        self.data += b"trailer\n" + written(trailer | {Name("Size"): size}) + b"\nstartxref\n%d\n%%%%EOF\n" % at
        return at

    def stream_section(self, numbers: list[int], packed: dict[int, tuple[int, int]], trailer: dict, own: int, predict: bool) -> int:
        """A cross-reference stream (object ``own``)."""
        at = self.places[own] = len(self.data)
        rows = [(2, *packed[n]) if n in packed else (1, self.places[n], 0) if n in self.places else (0, 0, 0) for n in numbers]
        body = [bytes([k]) + a.to_bytes(4, "big") + b.to_bytes(2, "big") for k, a, b in rows]
        how = {Name("Filter"): Name("FlateDecode")}
        if predict:  # PNG "up" rows
            body = [b"\x02" + bytes((x - y) % 256 for x, y in zip(r, p, strict=True)) for r, p in zip(body, [bytes(7), *body], strict=False)]
            how[Name("DecodeParms")] = {Name("Predictor"): 12, Name("Columns"): 7}
        spans = [i for n in numbers for i in (n, 1)]
        d = trailer | how | {Name("Type"): Name("XRef"), Name("W"): [1, 4, 2], Name("Index"): spans, Name("Size"): max(numbers) + 1}
        self.put(own, Stream(d, zlib.compress(b"".join(body))))
        self.data += b"startxref\n%d\n%%%%EOF\n" % at
        return at

    def pack(self, own: int, members: dict[int, object]) -> dict[int, tuple[int, int]]:
        """An object stream (object ``own``) of ``members``."""
        bodies = [written(v) for v in members.values()]
        offsets, at = [], 0
        for b in bodies:
            offsets.append(at)
            at += len(b) + 1
        head = b" ".join(b"%d %d" % x for x in zip(members, offsets, strict=True)) + b" "
        d = {Name("Type"): Name("ObjStm"), Name("N"): len(bodies), Name("First"): len(head), Name("Filter"): Name("FlateDecode")}
        self.put(own, Stream(d, zlib.compress(head + b" ".join(bodies))))
        return {n: (own, i) for i, n in enumerate(members)}


#: What some ids leave over when divided by 59, and the damage that file has.
HOSTILE = {42: "section far out", 45: "reference far out", 46: "object far out", 47: "size far out", 49: "previous section is itself", 50: "streams hold each other"}
VERSION, FREE, REFERENCE, OVERSIZE = 41, 43, 44, 51
TOO_LONG = LIMITS.input_bytes + 1


def hostile(damage: str) -> bytes:
    """A one-page file that would be sound but for one number."""
    head, far = b"%PDF-1.4\n", b"99999999999999999999"
    catalog = b"<< /Type /Catalog /Pages 2 0 R " + (b"/X " + far + b" 0 R " if damage == "reference far out" else b"") + b">>"
    places, data = [], head
    for n, body in enumerate((catalog, b"<< /Type /Pages /Count 1 /Kids [3 0 R] >>", b"<< /Type /Page /Parent 2 0 R >>"), 1):
        places.append(len(data))
        data += b"%d 0 obj\n" % n + body + b"\nendobj\n"
    at = len(data)
    if damage == "streams hold each other":
        rows = b"".join(bytes([k]) + a.to_bytes(4, "big") + b"\0\0" for k, a in ((0, 0), *((1, p) for p in places), (2, 5), (2, 4), (1, at)))
        return data + b"6 0 obj\n" + written(Stream({Name("Type"): Name("XRef"), Name("W"): [1, 4, 2], Name("Size"): 7, Name("Root"): Ref(1, 0)}, rows)) + b"\nendobj\nstartxref\n%d\n%%%%EOF\n" % at
    data += b"xref\n0 4\n0000000000 65535 f \n" + b"".join(b"%010d 00000 n \n" % p for p in places)
    if damage in ("section far out", "object far out"):
        data += (far if damage == "section far out" else b"3000000000") + b" 1\n%010d 00000 n \n" % places[2]
    size = 600_000 if damage == "size far out" else 4
    prev = b"/Prev %d " % at if damage == "previous section is itself" else b""
    return data + b"trailer\n<< /Root 1 0 R /Size %d " % size + prev + b">>\nstartxref\n%d\n%%%%EOF\n" % at


def pdf(doc: int, text: bytes, lang: str, source: str, n_chars: int) -> bytes:
    if doc % 59 in HOSTILE and doc % 31 != 5 and doc % 37 != 5:
        return hostile(HOSTILE[doc % 59])
    objects, trailer = objects_of(doc, text, lang, source, n_chars)
    size, layout = len(objects) + 1, doc % 5
    plain = {n for n, v in objects.items() if isinstance(v, Stream)}
    file = File(b"%PDF-99999999999" if doc % 59 == VERSION else b"%PDF-1.4" if layout < 2 else b"%PDF-1.5")
    file.free = b"9999999999" if doc % 59 == FREE else b"65535"
    if layout == 0:
        lengths = {n: size + i for i, n in enumerate(sorted(plain))} if doc % 4 == 0 else {}
        for n, v in objects.items():
            file.put(n, v, lengths.get(n))
        file.table(list(range(size + len(lengths))), trailer, size + len(lengths), wrong_first=doc % 3 == 0)
    elif layout == 1:  # the Info dictionary is written twice; the second one counts
        info = trailer["Info"].obj
        for n, v in objects.items():
            file.put(n, v if n != info else {Name("Title"): b"old"})
        first = file.table(list(range(size)), trailer, size)
        file.put(info, objects[info])
        file.table([info], trailer | {Name("Prev"): first}, size)
    elif layout in (2, 4):
        for n in plain:
            file.put(n, objects[n])
        packed = file.pack(size, {n: v for n, v in objects.items() if n not in plain})
        first = file.stream_section([*range(size + 2)], packed, trailer, size + 1, layout == 4)
        if layout == 4:  # an update that says the same
            file.put(3, objects[3])
            file.stream_section([3, size + 2], {}, trailer | {Name("Prev"): first}, size + 2, True)
    else:  # hybrid: packed objects are free in the table, and told by the stream
        for n in plain:
            file.put(n, objects[n])
        hidden = {n: v for n, v in objects.items() if n not in plain}
        packed = file.pack(size, hidden)
        at = file.stream_section([*hidden, size + 1], packed, {}, size + 1, False)
        file.table([*range(size + 1)], trailer | {Name("XRefStm"): at}, size + 2)
    if doc % 31 == 5:
        return b""
    if doc % 37 == 5:
        return b"no header " + text
    return bytes(file.data[:40]) if doc % 23 == 0 else bytes(file.data)


def plant(documents: DataFrame) -> DataFrame:
    """(doc_id, length, content): one PDF a row of ``documents``; files above the limit have their length only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            made = [pdf(r["doc_id"], (r["text"] or "").encode(), r["lang"] or "", r["source"] or "", r["n_chars"] or 0) for r in rows]
            lengths = [TOO_LONG if r["doc_id"] % 59 == OVERSIZE else len(m) for r, m in zip(rows, made, strict=True)]
            made = [b"" if n == TOO_LONG else m for n, m in zip(lengths, made, strict=True)]
            yield pa.record_batch({"doc_id": batch.column(0), "length": pa.array(lengths, pa.int64()), "content": pa.array(made, pa.binary())})

    return documents.select("doc_id", "text", "lang", "source", "n_chars").mapInArrow(run, "doc_id long, length long, content binary")

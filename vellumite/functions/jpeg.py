"""Metadata segments of JPEG streams."""

from __future__ import annotations


def scrub(data: bytes) -> bytes:
    """``data`` without APP1 (Exif, XMP) and APP13 (IPTC) segments before the first scan; anything odd is copied as it is."""
    if data[:2] != b"\xff\xd8":
        return data
    out, at = [data[:2]], 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        while at + 1 < len(data) and data[at + 1] == 0xFF:  # fill bytes
            at += 1
        if at + 1 >= len(data):
            break
        marker = data[at + 1]
        if marker == 0xD9:  # the end, before any scan
            return b"".join(out) + data[at : at + 2]
        if marker == 0x01 or 0xD0 <= marker <= 0xD7:
            out.append(data[at : at + 2])
            at += 2
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if marker == 0xDA or size < 2 or at + 2 + size > len(data):
            break
        if marker not in (0xE1, 0xED):
            out.append(data[at : at + 2 + size])
        at += 2 + size
    return b"".join(out) + data[at:]

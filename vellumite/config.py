"""Options, limits and the five compression profiles."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Options:
    """What a clean removes. The presets below are the three in use."""

    document_info: bool = True
    catalog_xmp: bool = True
    new_file_id: bool = True
    piece_info: bool = True
    annotations: bool = True
    images: bool = True
    object_metadata: bool = True
    fail_if_signed: bool = True
    rewrite_only: bool = False


DEFAULT = Options()
DOCUMENT_ONLY = replace(DEFAULT, annotations=False, images=False, object_metadata=False)
REWRITE_ONLY = Options(False, False, False, False, False, False, False, rewrite_only=True)


@dataclass(frozen=True)
class Limits:
    input_bytes: int = 100 * 1024 * 1024
    objects: int = 500_000
    inflated_bytes: int = 256 * 1024 * 1024
    sections: int = 4096
    depth: int = 256
    probe_bytes: int = 15 * 1024 * 1024


LIMITS = Limits()


@dataclass(frozen=True)
class Profile:
    level: int
    name: str
    suffix: str
    edge: int | None
    quality: float | None
    pack: bool
    gray: bool


#: Level, name, file suffix, longest image edge, JPEG quality, pack streams, near-gray to gray.
PROFILES = (
    Profile(0, "None", "clean", None, None, False, False),
    Profile(1, "Light", "clean-light", None, None, True, False),
    Profile(2, "Balanced", "clean-balanced", 1600, 0.80, True, False),
    Profile(3, "Strong", "clean-strong", 1200, 0.60, True, False),
    Profile(4, "Maximum", "clean-max", 900, 0.42, True, True),
)


def profile(level: int) -> Profile:
    return PROFILES[max(0, min(4, level))]


#: Sentences of reviews and reports, by what they tell. Braces are filled in.
SENTENCES = {
    "nothing removed": "No metadata was found to remove; this is a rewritten copy.",
    "removed": "Removed {n} metadata item{s} from this copy.",
    "one left": "{n} item is still present: {labels}.",
    "left": "{n} items are still present: {labels}.",
    "not compressed": "Compression found nothing it could shrink in this file.",
    "compressed": "Compression {what}.",
    "re-encoded": "re-encoded {n} of {all} image{s}",
    "packed": "packed {n} uncompressed stream{s}",
    "smaller": "The file went from {before} to {after}.",
    "not smaller": "The saved copy is not smaller than the original.",
    "stays": "Still in the file: {labels}.",
    "original": "Your original file was not changed.",
    "no images": "This PDF has no images, so this level does nothing more than Light.",
    "no eligible images": "None of the {all} image{s} in this PDF can be re-encoded, so this level does nothing more than Light.",
    "eligible images": "{n} of {all} image{s} in this PDF can be re-encoded.",
    "mostly text": "This PDF is mostly text/vectors — compression won’t shrink much.",
}

#: Titles of the action, by level (0, 1, higher) and whether there is metadata to remove.
ACTIONS = (("Remove metadata and save…", "Save a rewritten copy…"), ("Remove metadata, pack and save…", "Pack and save…"), ("Remove metadata, compress and save…", "Compress and save…"))

#: Error codes and what they say.
ERRORS = {
    "emptyInput": "Not a PDF.",
    "oversize": "PDF is too large.",
    "notPDF": "Not a PDF.",
    "cannotRead": "Could not read that PDF.",
    "encrypted": "PDF is password-protected.",
    "signed": "Signed PDFs are not modified.",
    "corrupt": "This PDF is damaged or incomplete.",
    "unsupported": "This PDF uses a structure that cannot be read.",
    "cannotWrite": "Could not save the cleaned PDF.",
}

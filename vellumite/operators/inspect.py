"""What a file holds: flags, counts, findings, what would stay, and the bytes of each kind of stream."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, Options
from ..sources import syntax as S
from ..sources.scratch import stored
from ..sources.tables import Tables
from . import objects as O
from .reach import only, page_counts, sweep, used
from .strip import annotations, anonymous, detached, metadata_streams, strip, telling

#: Standard keys of the Info dictionary and their labels, in order of display.
INFO_LABELS = (("Title", "Title"), ("Author", "Author"), ("Subject", "Subject"), ("Keywords", "Keywords"), ("Creator", "Creator"), ("Producer", "Producer"), ("CreationDate", "Creation date"), ("ModDate", "Modification date"))
FILE_ID = "Trailer file ID"
REPLACED = "Links copies of this file; replaced with a random one"
STAYS = "Stays in the file"
#: Places of findings in the order of display: standard keys from 0, custom ones from 100, then these.
EMPTY_INFO, FLAGS = 1_000_000, 2_000_000

#: What stays, and why.
RESIDUALS = {"JavaScript": "Scripts are not removed", "Attached files": "Attachments and their contents are not removed", "Color profiles": "ICC profiles and output intents are not removed"}

TRIM = r"^\s+|\s+$"


@F.pandas_udf(T.StringType())
def plain_real(values: pd.Series) -> pd.Series:
    """Reals as they stand in a file: plain decimals, no exponent."""
    return values.map(lambda v: None if v is None or v != v else S.real(v).decode())


def display(kind: str = "kind"):
    """The text of a scalar; null for arrays, dictionaries, references and null."""
    number = F.when(F.col("kind") == "int", F.col("int_val").cast("string")).when(F.col("kind") == "real", plain_real("real_val")).when(F.col("kind") == "bool", F.col("bool_val").cast("string"))
    return F.when(F.col("kind") == "name", O.latin()).when(F.col("kind").isin("string", "hex"), O.text()).otherwise(number)


def info_entries(nodes: DataFrame) -> DataFrame:
    """(doc_id, key, text): the Info dictionary, direct or by reference."""
    by_ref = nodes.where("obj = -1 and depth = 1 and key = 'Info' and kind = 'ref'").selectExpr("doc_id", "ref_obj as obj")
    far = nodes.where("depth = 1 and key is not null").join(by_ref, ["doc_id", "obj"], "left_semi")
    near = nodes.where("obj = -1 and depth = 2 and top_key = 'Info' and key is not null")
    return far.unionByName(near).select("doc_id", "key", display().alias("text"))


def info_dictionaries(nodes: DataFrame) -> DataFrame:
    return nodes.where("obj = -1 and depth = 1 and key = 'Info'").select("doc_id").distinct()


def flags(nodes: DataFrame, objects: DataFrame) -> DataFrame:
    """One row a document with its boolean facts."""
    # objects that no flag is about stay where they are; the trailer keeps every document
    telling = (F.col("obj") == -1) | O.has("Metadata") | O.has("PieceInfo") | O.script() | O.profiled() | O.embedded() | F.col("names_files") | O.annotation() | F.col("field_type").eqNullSafe("Sig")
    rooted = objects.where(telling).join(O.roots(nodes), "doc_id", "left")
    is_root = F.col("obj").eqNullSafe(F.col("root"))
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    trailer = F.col("obj") == -1
    facts = rooted.groupBy("doc_id").agg(
        any_(trailer & O.has("Info")).alias("has_info"), any_(trailer & O.has("ID")).alias("has_id"), any_(trailer & O.has("Encrypt")).alias("encrypted"),
        any_(is_root & O.has("Metadata")).alias("catalog_xmp"), any_(~trailer & ~is_root & O.has("Metadata")).alias("other_xmp"),
        any_(~trailer & O.has("PieceInfo")).alias("piece_info"), any_(~trailer & O.script()).alias("script"), any_(~trailer & O.profiled()).alias("profiles"),
        any_(~trailer & (O.embedded() | (is_root & F.col("names_files")))).alias("attachments"),
        F.count_if(~trailer & O.annotation() & ~F.col("subtype").eqNullSafe("Widget") & (O.has("T") | O.has("M") | O.has("CreationDate"))).alias("annotations"),
        F.count_if(~trailer & F.col("field_type").eqNullSafe("Sig") & ~F.col("has_value")).alias("empty_signature_fields"),
    )
    return facts.join(O.signed(nodes).withColumn("signed", F.lit(True)), "doc_id", "left").fillna(False, ["signed"])


def counted(n: str, noun: str):
    return F.concat(F.col(n).cast("string"), F.lit(f" {noun}"), F.when(F.col(n) == 1, "").otherwise("s"))


def findings(nodes: DataFrame, facts: DataFrame, shortened: DataFrame | None = None) -> DataFrame:
    """(doc_id, ord, category, label, value), one row a finding, in the order of display. ``shortened`` (doc_id, obj) are images that hold metadata."""
    # a small table, found once for all that is told of it
    info = stored(info_entries(nodes), "info").withColumn("value", F.regexp_replace("text", TRIM, ""))
    places = {k: i for i, (k, _) in enumerate(INFO_LABELS)}
    labels = F.create_map(*(F.lit(x) for pair in INFO_LABELS for x in pair))
    standard = info.where(F.col("key").isin(*places) & (F.col("value") != "")).select("doc_id", F.create_map(*(F.lit(x) for pair in places.items() for x in pair))[F.col("key")].alias("ord"), labels[F.col("key")].alias("label"), "value")
    custom = info.where(~F.col("key").isin(*places, "Trapped"))
    custom = custom.where("text is null or text = '' or value <> ''").selectExpr("doc_id", "100 + cast(row_number() over (partition by doc_id order by key) as int) as ord", "key as label", "case when text is null or text = '' then '(non-text value)' else value end as value")
    told = standard.unionByName(custom).withColumn("category", F.lit("Document info"))
    empty = info_dictionaries(nodes).join(told.select("doc_id").distinct(), "doc_id", "left_anti")
    empty = empty.selectExpr("doc_id", f"{EMPTY_INFO} as ord", "'Document info' as category", "'Info dictionary' as label", "'Present (empty fields)' as value")
    if shortened is None:
        facts = facts.withColumn("images", F.lit(0))
    else:
        facts = facts.join(shortened.groupBy("doc_id").agg(F.count(F.lit(1)).alias("images")), "doc_id", "left").fillna(0, ["images"])
    rows = [
        ("catalog_xmp", FLAGS + 0, "XMP / streams", "Catalog XMP metadata", F.lit("Present")), ("other_xmp", FLAGS + 1, "XMP / streams", "Page or object XMP metadata", F.lit("Present")),
        ("piece_info", FLAGS + 2, "XMP / streams", "Application private data (PieceInfo)", F.lit("Present")), ("has_id", FLAGS + 3, "File identity", FILE_ID, F.lit(REPLACED)),
        ("annotations > 0", FLAGS + 4, "Annotations", "Annotation authors / dates", counted("annotations", "annotation")), ("images > 0", FLAGS + 5, "Images", "JPEG EXIF / XMP / IPTC", counted("images", "image stream")),
        ("signed", FLAGS + 6, "Security", "Digital signature", F.lit("Detected: this file is not modified")),
    ]
    made = F.array(*(F.when(F.expr(c), F.struct(F.lit(o).alias("ord"), F.lit(k).alias("category"), F.lit(n).alias("label"), v.alias("value"))) for c, o, k, n, v in rows))
    flagged = facts.select("doc_id", F.explode(F.array_compact(made)).alias("f")).select("doc_id", "f.*")
    return told.select("doc_id", "ord", "category", "label", "value").unionByName(empty).unionByName(flagged)


def kept_after_clean(nodes: DataFrame, objects: DataFrame | None = None, options: Options = DEFAULT) -> DataFrame:
    """The document as it would be saved: metadata detached, objects out of use dropped. Image bytes and the file ID are changed on writing."""
    if not (options.object_metadata and options.annotations):
        return sweep(strip(nodes, options, objects))
    objects = O.objects(nodes) if objects is None else objects
    left, notes = detached(nodes, options), annotations(objects)
    # of each object that stays, whether it is an annotation: whole rows are joined once
    kept = used(anonymous(left, notes), metadata_streams(objects))
    return only(left, kept.join(notes, ["doc_id", "obj"], "left")).where(~telling()).drop("widget")


def residuals(kept_facts: DataFrame, signed: DataFrame) -> DataFrame:
    """(doc_id, label, value): what is found and stays."""
    rows = [
        *((flag, label, F.lit(RESIDUALS[label])) for flag, label in (("script", "JavaScript"), ("attachments", "Attached files"), ("profiles", "Color profiles"))),
        ("empty_signature_fields > 0 and not coalesce(was_signed, false)", "Empty signature field", F.concat(counted("empty_signature_fields", "unsigned field"), F.lit(", kept as is"))),
    ]
    facts = kept_facts.join(signed.withColumn("was_signed", F.lit(True)), "doc_id", "left")
    made = F.array(*(F.when(F.expr(c), F.struct(F.lit(n).alias("label"), v.alias("value"))) for c, n, v in rows))
    return facts.select("doc_id", F.explode(F.array_compact(made)).alias("f")).select("doc_id", "f.*")


def inventory(objects: DataFrame, docs: DataFrame) -> DataFrame:
    """Bytes of image, metadata and other streams, and of those that can be encoded again."""
    kind = F.when(F.col("type_name").eqNullSafe("Metadata"), "metadata").when((F.col("type_name").eqNullSafe("XObject") & F.col("subtype").eqNullSafe("Image")) | F.col("dct"), "image").otherwise("other")
    streams = objects.where("kind = 'stream'").withColumn("class", kind).withColumn("eligible", O.eligible())
    size = lambda c: F.coalesce(F.sum(F.when(c, F.col("payload_bytes"))), F.lit(0)).cast("long")
    sums = streams.groupBy("doc_id").agg(*(size(F.col("class") == k).alias(f"{k}_bytes") for k in ("image", "metadata", "other")), size(F.col("eligible")).alias("recompressible_bytes"))
    names = ["image_bytes", "metadata_bytes", "other_bytes", "recompressible_bytes"]
    return docs.select("doc_id", "file_bytes").join(sums, "doc_id", "left").fillna(0, names).select("doc_id", *names, "file_bytes")


def mask_targets(nodes: DataFrame) -> DataFrame:
    """(doc_id, obj): objects that serve as another one's mask."""
    return nodes.where("depth = 1 and key in ('SMask', 'Mask') and kind = 'ref'").selectExpr("doc_id", "ref_obj as obj").distinct()


def image_counts(kept: DataFrame, kept_objects: DataFrame) -> DataFrame:
    """(doc_id, images, eligible) among the objects that stay."""
    images = kept_objects.where("kind = 'stream' and subtype = 'Image'").withColumn("ok", O.eligible())
    marked = images.join(mask_targets(kept).withColumn("mask", F.lit(True)), ["doc_id", "obj"], "left")
    return marked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("images"), F.count_if(F.expr("ok and mask is null")).alias("eligible"))


#: Reasons of a file whose objects could be read but not its pages.
LOST_PAGES = ("page tree cannot be followed", "no pages")


def with_pages(tables: Tables) -> DataFrame:
    """``status`` in which a page tree that cannot be followed, or is empty, is an error."""
    pages = stored(page_counts(tables.nodes), "pages")
    joined = tables.status.join(pages, "doc_id", "left").withColumn("pages", F.expr("case when error_code is null then pages end"))
    bad = F.expr("error_code is null and coalesce(pages, 0) < 1")
    return joined.select("doc_id", F.when(bad, "corrupt").otherwise(F.col("error_code")).alias("error_code"), F.when(bad & F.col("pages").isNull(), LOST_PAGES[0]).when(bad, LOST_PAGES[1]).otherwise(F.col("reason")).alias("reason"), "pages")

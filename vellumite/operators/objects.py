"""One row an object: what the predicates need of its own dictionary, and of the dictionaries inside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored
from ..sources.tables import LEAST_PACKED


def text() -> Column:
    """A string's bytes as UTF-8 where that is valid, else as Latin-1."""
    return F.coalesce(F.try_validate_utf8(F.col("bytes_val").cast("string")), latin())


def latin(column: str = "bytes_val") -> Column:
    return F.decode(column, "ISO-8859-1")


def own(nodes: DataFrame, key: str, value: Column) -> Column:
    """Aggregate: ``value`` of the row under ``key`` in the object's own dictionary."""
    return F.max(F.when((F.col("depth") == 1) & (F.col("key") == key), value))


def named(nodes: DataFrame, key: str) -> Column:
    return own(nodes, key, F.when(F.col("kind") == "name", latin()))


#: Keys of an object's own dictionary that are asked for, and those whose values are.
KEYS = ("Info", "ID", "Encrypt", "Metadata", "PieceInfo", "T", "M", "CreationDate", "BitsPerComponent", "SMask", "Mask", "Decode", "SMaskInData", "ImageMask", "Filter", "F", "Subtype", "Rect", "EF", "Type", "EmbeddedFiles", "JS", "DecodeParms")
OWN = ("S", "FT", "V", "ColorSpace", "Width", "Height")


def objects(nodes: DataFrame) -> DataFrame:
    """doc_id, obj, kind, type_name, subtype, marks (the ``KEYS`` it has, a bit each), payload and the facts that the filters below test."""
    # most values say nothing here, and are left out before they are grouped
    told = f"depth = 0 or depth = 1 and key in {KEYS + OWN} or top_key = 'Filter' or depth = 2 and top_key in ('ColorSpace', 'Names')"
    nodes = nodes.where(told).withColumn("mark", F.expr("case when depth = 1 then case key " + " ".join(f"when '{k}' then {1 << i}" for i, k in enumerate(KEYS)) + " end end"))
    under = lambda key: (F.col("depth") == 1) & (F.col("key") == key)
    filters = (F.col("top_key") == "Filter") & (F.col("kind") == "name")
    return nodes.groupBy("doc_id", "obj").agg(
        F.max("gen").alias("gen"),
        F.max(F.when(F.col("node_id") == 0, F.col("kind"))).alias("kind"),
        named(nodes, "Type").alias("type_name"), named(nodes, "Subtype").alias("subtype"), named(nodes, "S").alias("action"), named(nodes, "FT").alias("field_type"),
        F.coalesce(F.bit_or("mark"), F.lit(0)).alias("marks"),
        F.max(F.when((F.col("node_id") == 0) & (F.col("kind") == "stream"), F.col("int_val"))).alias("payload_bytes"),
        F.max(F.when((F.col("node_id") == 0) & (F.col("kind") == "stream"), F.col("bytes_val"))).alias("payload_start"),
        F.coalesce(F.bool_or(under("V") & (F.col("kind") != "null")), F.lit(False)).alias("has_value"),
        F.coalesce(F.bool_or(filters & (latin() == "DCTDecode")), F.lit(False)).alias("dct"),
        named(nodes, "Filter").alias("single_filter"), own(nodes, "Filter", F.col("kind")).alias("filter_kind"),
        F.count_if((F.col("depth") == 2) & (F.col("top_key") == "Filter")).alias("n_filters"), F.coalesce(F.bool_or((F.col("depth") == 2) & filters & (latin() == "DCTDecode")), F.lit(False)).alias("dct_listed"), named(nodes, "ColorSpace").alias("color_space"),
        own(nodes, "BitsPerComponent", F.col("int_val")).alias("bits"), own(nodes, "Width", F.col("int_val")).alias("width"), own(nodes, "Height", F.col("int_val")).alias("height"),
        own(nodes, "ImageMask", F.col("bool_val")).alias("image_mask"),
        F.max(F.when((F.col("depth") == 2) & (F.col("top_key") == "ColorSpace") & (F.col("ord") == 0) & (F.col("kind") == "name"), latin())).alias("color_family"),
        F.coalesce(F.bool_or((F.col("depth") == 2) & (F.col("top_key") == "Names") & (F.col("key") == "EmbeddedFiles")), F.lit(False)).alias("names_files"),
    )


def has(key: str) -> Column:
    return F.col("marks").bitwiseAND(1 << KEYS.index(key)) != 0


def with_keys(objects: DataFrame) -> DataFrame:
    """``objects`` with the array ``keys``, those of ``KEYS`` that each has."""
    return objects.withColumn("keys", F.array_compact(F.array(*(F.when(has(k), F.lit(k)) for k in KEYS))))


def eligible() -> Column:
    """Image streams that can be encoded again."""
    sole = F.coalesce(F.col("single_filter") == "DCTDecode", F.lit(False)) | ((F.col("filter_kind") == "array") & (F.col("n_filters") == 1) & F.col("dct_listed"))
    plain = (F.col("subtype") == "Image") & (F.col("payload_bytes") >= 128) & sole & (F.col("payload_start") == F.expr("X'FFD8'"))
    colors = F.col("color_space").isin("DeviceRGB", "DeviceGray") & ((F.col("bits") == 8) | ~has("BitsPerComponent"))
    unmasked = ~has("SMask") & ~has("Mask") & ~has("Decode") & ~has("SMaskInData") & ~F.coalesce("image_mask", has("ImageMask"))
    return F.coalesce(plain & colors & unmasked, F.lit(False))


def packable() -> Column:
    """Streams worth packing."""
    raw = (F.col("kind") == "stream") & (F.col("payload_bytes") >= LEAST_PACKED) & ~F.col("dct") & ~has("Filter") & ~has("F")
    image = F.col("type_name").eqNullSafe("XObject") & F.col("subtype").eqNullSafe("Image")
    return F.coalesce(raw & ~F.col("type_name").eqNullSafe("Metadata") & ~image, F.lit(False))


def annotation() -> Column:
    return F.coalesce((F.col("type_name") == "Annot") | (has("Subtype") & has("Rect")), F.lit(False))


def embedded() -> Column:
    spec = (has("EF") | (has("F") & has("Type"))) & F.col("type_name").isin("Filespec", "FileSpec")
    return F.coalesce(spec | (F.col("type_name") == "EmbeddedFile"), F.lit(False)) | has("EmbeddedFiles")


def script() -> Column:
    return F.coalesce(F.col("action") == "JavaScript", F.lit(False)) | has("JS")


def profiled() -> Column:
    return F.coalesce(F.col("type_name") == "OutputIntent", F.lit(False)) | F.coalesce(F.col("color_family") == "ICCBased", F.lit(False))


def integers(nodes: DataFrame, key: str) -> DataFrame:
    """(doc_id, obj, value): the integer under ``key`` of each object's own dictionary, given there or by reference to an object of that generation."""
    own = nodes.where("depth = 1").where(F.col("key") == key)
    near = own.where("kind = 'int'").selectExpr("doc_id", "obj", "int_val as value")
    whole = nodes.where("obj >= 0 and node_id = 0 and kind = 'int'").selectExpr("doc_id", "obj as ref_obj", "gen as ref_gen", "int_val as value")
    far = own.where("kind = 'ref'").select("doc_id", "obj", "ref_obj", "ref_gen").join(whole, ["doc_id", "ref_obj", "ref_gen"]).select("doc_id", "obj", "value")
    return near.unionByName(far)


def roots(nodes: DataFrame) -> DataFrame:
    """(doc_id, root): the catalog's object number."""
    return nodes.where("obj = -1 and depth = 1 and key = 'Root' and kind = 'ref'").selectExpr("doc_id", "ref_obj as root")


def signed(nodes: DataFrame) -> DataFrame:
    """doc_ids that look signed: some dictionary, however deep, is a signature, or the catalog's /Perms is not empty."""
    inner = "parent_id is not null and key in ('Type', 'FT', 'V', 'ByteRange', 'Contents', 'Filter', 'DocMDP', 'Perms', 'UR', 'UR3')"
    top = "top_key = 'Perms' and (depth = 2 and key is not null or depth = 1 and kind = 'ref')"
    # the few values that can tell, found in one pass
    told = stored(nodes.where(f"{inner} or {top} or obj = -1 and depth = 1 and key = 'Root'").select("doc_id", "obj", "node_id", "parent_id", "depth", "key", "top_key", "kind", "bytes_val", "ref_obj"), "signs")
    inner = told.where(inner)
    # flags alone are grouped, and of types only the one that counts
    text = "lower(decode(bytes_val, 'ISO-8859-1'))"
    marks = {
        "sig": "key = 'Type' and kind = 'name' and bytes_val = X'536967'", "ft": "key = 'FT' and kind = 'name' and bytes_val = X'536967'", "v": "key = 'V' and kind <> 'null'", "br": "key = 'ByteRange'",
        "cf": "key in ('Contents', 'Filter')", "adobe": rf"key = 'Filter' and kind in ('name', 'string', 'hex') and {text} rlike 'adbe[.]pkcs7|adobe[.]ppklite|adobe[.]ppkms'", "mdp": "key = 'DocMDP'",
    }
    rows = inner.selectExpr("doc_id", "obj", "parent_id", *(f"coalesce({test}, false) as {name}" for name, test in marks.items())).where(" or ".join(marks))
    facts = rows.groupBy("doc_id", "obj", "parent_id").agg(*(F.bool_or(name).alias(name) for name in marks))
    by_dict = facts.where("sig or ft and v or br and cf or mdp or adobe").select("doc_id")
    # usage rights in a dictionary under /Perms, however deep
    perms = inner.where("key = 'Perms' and kind = 'dict'").selectExpr("doc_id", "obj", "node_id as parent_id")
    rights = inner.where("key in ('DocMDP', 'UR', 'UR3')").join(perms, ["doc_id", "obj", "parent_id"], "left_semi").select("doc_id")
    catalog = told.where(top).join(roots(told).withColumnRenamed("root", "obj"), ["doc_id", "obj"])
    found = by_dict.union(rights).union(catalog.where("depth = 2").select("doc_id"))
    by_ref = stored(catalog.where("depth = 1").selectExpr("doc_id", "ref_obj as obj"), "perms")
    if not by_ref.isEmpty():
        found = found.union(nodes.where("depth = 1 and key is not null").select("doc_id", "obj").join(by_ref, ["doc_id", "obj"], "left_semi").select("doc_id"))
    return found.distinct()

"""What a clean removes, as filters on the rows of values."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, Options
from ..functions import jpeg
from . import objects as O

#: Keys that tell who wrote or changed an annotation; the first two for any, the rest but for form fields.
ANNOTATION_DATES, ANNOTATION_AUTHORS = ("M", "CreationDate"), ("T", "NM", "RC", "DS", "Subj")


def strip(nodes: DataFrame, options: Options = DEFAULT, objects: DataFrame | None = None) -> DataFrame:
    """``nodes`` without what ``options`` removes; the /ID and image bytes are :func:`new_ids` and :func:`images_with_metadata`.

    ``objects`` is the table of :func:`objects.objects` for ``nodes``, where it is there already.
    """
    if (options.annotations or options.object_metadata) and objects is None:
        objects = O.objects(nodes)
    nodes = detached(nodes, options)
    if options.annotations:
        nodes = anonymous(nodes, annotations(objects))
    if options.object_metadata:
        nodes = nodes.join(metadata_streams(objects), ["doc_id", "obj"], "left_anti")
    return nodes


def detached(nodes: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """``nodes`` without the Info dictionary and the keys of metadata."""
    if options.document_info:
        nodes = nodes.where("not (obj = -1 and top_key <=> 'Info')")
    if options.object_metadata:  # the catalog's too
        keys = ["Metadata", *(["PieceInfo", "LastModified"] if options.piece_info else [])]
        nodes = nodes.where(~((F.col("obj") >= 0) & under(keys)))
    elif options.catalog_xmp or options.piece_info:
        keys = ["Metadata"] * options.catalog_xmp + ["PieceInfo"] * options.piece_info
        nodes = without(nodes, O.roots(nodes).withColumnRenamed("root", "obj"), keys)
    return nodes


def annotations(objects: DataFrame) -> DataFrame:
    """(doc_id, obj, widget)"""
    return objects.where("obj >= 0").where(O.annotation()).select("doc_id", "obj", F.col("subtype").eqNullSafe("Widget").alias("widget"))


def telling():
    """Rows that say who wrote or changed an annotation; ``widget`` is null for other objects."""
    return F.coalesce(F.col("widget").isNotNull() & (under(list(ANNOTATION_DATES)) | ~F.col("widget") & under(list(ANNOTATION_AUTHORS))), F.lit(False))


def anonymous(nodes: DataFrame, notes: DataFrame) -> DataFrame:
    """``nodes`` without who wrote or changed the annotations ``notes``. Only the rows under these keys are joined."""
    some = under([*ANNOTATION_DATES, *ANNOTATION_AUTHORS])
    return nodes.where(~some).unionByName(nodes.where(some).join(notes, ["doc_id", "obj"], "left").where(~telling()).drop("widget"))


def metadata_streams(objects: DataFrame) -> DataFrame:
    """(doc_id, obj): objects that are nothing but metadata."""
    return objects.where("obj >= 0 and type_name = 'Metadata'").select("doc_id", "obj")


def under(keys: list[str]):
    return F.coalesce(F.col("top_key").isin(keys), F.lit(False))


def without(nodes: DataFrame, *pairs) -> DataFrame:
    """``nodes`` without some keys in the own dictionaries of some objects, given in turn: objects, keys, and so on. Only the rows under these keys are joined."""
    keys = [k for names in pairs[1::2] for k in names]
    out = nodes.where(~under(keys))
    for objects, names in zip(pairs[::2], pairs[1::2], strict=True):
        out = out.unionByName(nodes.where(under(names)).join(objects.distinct(), ["doc_id", "obj"], "left_anti"))
    return out


@F.pandas_udf(T.BinaryType())
def scrubbed(payloads):
    return payloads.map(lambda p: jpeg.scrub(bytes(p)) if p is not None else None)


def images_with_metadata(objects: DataFrame, payloads: DataFrame) -> DataFrame:
    """(doc_id, obj, payload): DCT streams that a scrub shortens, scrubbed."""
    dct = objects.where("kind = 'stream' and dct").select("doc_id", "obj")
    before = payloads.where("role = 'dct'").join(dct, ["doc_id", "obj"], "left_semi").withColumnRenamed("payload", "before")
    return before.withColumn("payload", scrubbed("before")).where("octet_length(payload) <> octet_length(before)").select("doc_id", "obj", "payload")


def new_ids(nodes: DataFrame) -> DataFrame:
    """A trailer /ID of two random strings in place of the old one, new ones each time it is computed."""
    docs = nodes.where("obj = -1").select("doc_id").distinct()
    columns = nodes.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"doc_id": batch.column(0), "id": pa.array([os.urandom(32) for _ in range(batch.num_rows)], pa.binary())})

    ids = docs.mapInArrow(run, "doc_id long, id binary")
    parts = ids.selectExpr("doc_id", "id", "explode(array(0, 1, 2)) as part")
    values = {"obj": "-1L", "gen": "0", "node_id": "1073741824 + part", "parent_id": "case when part = 0 then 0 else 1073741824 end", "depth": "case when part = 0 then 1 else 2 end", "ord": "greatest(part - 1, 0)", "key": "case when part = 0 then 'ID' end", "top_key": "'ID'", "kind": "case when part = 0 then 'array' else 'hex' end", "bytes_val": "case when part > 0 then substring(id, 16 * part - 15, 16) end"}
    rows = parts.selectExpr("doc_id", *(f"cast({values.get(f.name, 'null')} as {f.dataType.simpleString()}) as {f.name}" for f in columns if f.name != "doc_id"))
    return nodes.where("not (obj = -1 and top_key <=> 'ID')").unionByName(rows)

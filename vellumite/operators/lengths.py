"""Exact sizes of cleaned files at every level from lengths alone: nothing is serialised, written or read again.

What an object takes up in a file is a sum over its values: each adds the bytes
of its own text, of its key, and of the space in front of it. A stream adds its
payload's length; a file its head, a line of 20 bytes for every number, and the
trailer. So the sizes at all levels are one grouped sum over rows, plus the few
objects that a level changes: packed streams and images encoded again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Options, profile
from ..sources.scratch import stored
from . import inspect as I
from . import objects as O
from .compress import pack, recompress, with_filter, with_image_keys
from .strip import new_ids
from .write import END, ENDSTREAM, HEAD, STREAM

#: Keys of a trailer that are not written again.
LAYOUT_KEYS = ("Prev", "XRefStm", "Encrypt", "Size")


def name_length(text: Column) -> Column:
    """Of a name with its slash; characters outside the plain ones take three bytes."""
    odd = F.length(F.regexp_replace(text, r"[!-~&&[^()<>\[\]{}/%#]]", ""))
    return 1 + F.length(text) + 2 * odd


def value_length() -> Column:
    """Of a value's own text, without what it holds; reals come as ``plain``."""
    raw, digits = F.octet_length("bytes_val"), lambda c: F.length(F.col(c).cast("string"))
    escapes = F.length(O.latin()) - F.length(F.translate(O.latin(), "\\()\r\n\t", ""))
    kind = F.col("kind")
    return (
        F.when(kind == "null", 4).when(kind == "bool", F.when(F.col("bool_val"), 4).otherwise(5)).when(kind == "int", digits("int_val")).when(kind == "real", F.length("plain"))
        .when(kind == "name", name_length(O.latin())).when(kind == "string", 2 + raw + escapes).when(kind == "hex", 2 + 2 * raw)
        .when(kind == "ref", digits("ref_obj") + digits("ref_gen") + 3).when(kind == "array", 2).otherwise(5)
    )


def object_lengths(nodes: DataFrame) -> DataFrame:
    """(doc_id, obj, gen, stream, own): bytes of each object's value, a stream's dictionary without its /Length; the trailer's under -1."""
    nodes = nodes.where(f"not (obj = -1 and coalesce(top_key, '') in {LAYOUT_KEYS})")
    # reals alone need Python
    reals = nodes.where("kind = 'real'").withColumn("plain", I.plain_real("real_val"))
    rows = nodes.where("kind <> 'real'").withColumn("plain", F.lit(None).cast("string")).unionByName(reals)
    around = F.when(F.col("key").isNotNull(), name_length(F.col("key")) + 2).when(F.col("parent_id").isNotNull() & (F.col("ord") > 0), 1).otherwise(0)
    rows = rows.select("doc_id", "obj", "gen", "node_id", "kind", F.coalesce(F.col("top_key") == "Length", F.lit(False)).alias("told"), (value_length() + around).cast("long").alias("n"))
    sums = rows.groupBy("doc_id", "obj").agg(
        F.max("gen").alias("gen"), F.bool_or((F.col("node_id") == 0) & (F.col("kind") == "stream")).alias("stream"),
        F.sum("n").alias("all"), F.coalesce(F.sum(F.when(F.col("told"), F.col("n"))), F.lit(0)).alias("told"),
    )
    return sums.selectExpr("doc_id", "obj", "gen", "stream", "if(stream, all - told, all) as own")


#: Bytes of an object in a file: ``own`` of :func:`object_lengths`, ``n`` a stream's payload.
IN_FILE = f"length(concat(obj, ' ', coalesce(gen, 0), ' obj\n')) + own + {len(END)} + if(stream, n + length(concat('/Length ', n, ' ')) + {len(STREAM + ENDSTREAM)}, 0)"


def exact_sizes(seen, options: Options = DEFAULT, levels: tuple[int, ...] = (0, 1, 2, 3, 4)) -> DataFrame:
    """(doc_id, level, length): what each readable, unsigned file of an inspection will take up, cleaned at each level.

    As a clean would write it; that a page tree changes, which a clean refuses, is not looked for.
    """
    refused = seen.facts.where("signed" if options.fail_if_signed else "false").select("doc_id")
    if options.rewrite_only:
        nodes = seen.tables.nodes
    else:
        nodes = seen.kept if options == DEFAULT else stored(I.kept_after_clean(seen.tables.nodes, seen.objects, options), "kept")
    nodes = nodes.join(refused, "doc_id", "left_anti")
    written = new_ids(nodes) if options.new_file_id else nodes
    scrubbed = seen.scrubbed if options.images else seen.scrubbed.where("false")
    lengths = seen.objects.where("kind = 'stream'").select("doc_id", "obj", "payload_bytes")
    lengths = lengths.join(scrubbed.selectExpr("doc_id", "obj", "cast(octet_length(payload) as long) as shorter"), ["doc_id", "obj"], "left")
    lengths = lengths.selectExpr("doc_id", "obj", "coalesce(shorter, payload_bytes) as n")
    base = object_lengths(written).join(lengths, ["doc_id", "obj"], "left")
    base = base.where("obj >= 0").select("doc_id", "obj", F.expr(IN_FILE).alias("bytes")).unionByName(base.where("obj = -1").selectExpr("doc_id", "obj", "own as bytes"))
    changed = changes(seen, nodes, scrubbed, levels, options)
    # one row an object for all levels; those that a level changes have its bytes beside
    if changed is not None:
        wide = changed.groupBy("doc_id", "obj").agg(*(F.max(F.when(F.col("level") == i, F.col("other"))).alias(f"other_{i}") for i in levels))
        base = base.join(wide, ["doc_id", "obj"], "left")
    own = lambda i: F.col("bytes") if changed is None else F.coalesce(f"other_{i}", "bytes")
    whole = base.groupBy("doc_id").agg(*(F.sum(F.when(F.col("obj") >= 0, own(i))).alias(f"body_{i}") for i in levels), F.sum(F.when(F.col("obj") == -1, F.col("bytes"))).alias("trailer"), (F.max("obj") + 1).alias("size"))
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("level"), F.col(f"body_{i}").alias("body")) for i in levels)))
    sums = whole.select("doc_id", "trailer", "size", each.alias("of")).select("doc_id", "of.*", "trailer", "size")
    head = len(HEAD % (1, 4))
    table = f"length(concat('xref\n0 ', size, '\n')) + 20 * size"
    end = f"length('trailer\n') + trailer - 2 + length(concat('/Size ', size, ' >>')) + length(concat('\nstartxref\n', {head} + body, '\n%%EOF\n'))"
    return sums.selectExpr("doc_id", "level", f"{head} + body + {table} + {end} as length")


def changes(seen, nodes: DataFrame, scrubbed: DataFrame, levels: tuple[int, ...], options: Options = DEFAULT) -> DataFrame | None:
    """(doc_id, obj, level, other): bytes in the file of the objects that a level changes. Payloads are packed and encoded, and only their lengths kept."""
    parts = []
    sized = lambda changed, n, level: object_lengths(changed).where("obj >= 0").join(n.selectExpr("doc_id", "obj", "n"), ["doc_id", "obj"]).select("doc_id", "obj", F.lit(level).alias("level"), F.expr(IN_FILE).alias("other"))
    packs = [i for i in levels if profile(i).pack]
    if packs:
        # a clean has them packed; else their lengths alone are kept
        small = seen.made("packed") or pack(seen.tables.payloads)
        small = stored(small.where("shrunk").selectExpr("doc_id", "obj", "cast(octet_length(payload) as long) as n"), "packed_lengths")
        own = nodes.join(small.select("doc_id", "obj"), ["doc_id", "obj"], "left_semi")
        once = sized(with_filter(own, small), small, packs[0]).drop("level")
        parts.append(once.select("*", F.explode(F.array(*(F.lit(i) for i in packs))).alias("level")))
    masks = None
    for i in levels:
        if profile(i).edge:
            coded = seen.images_coded.get(profile(i)) if options == DEFAULT else None
            if coded is None and masks is None:
                masks, wanted = I.mask_targets(nodes), seen.objects.where(O.eligible()).select("doc_id", "obj")
                images = seen.tables.payloads.where("role = 'dct'").join(wanted, ["doc_id", "obj"], "left_semi").join(scrubbed.withColumnRenamed("payload", "_new"), ["doc_id", "obj"], "left")
                images = images.select("doc_id", "obj", F.coalesce("_new", "payload").alias("payload"))
            # a clean has them encoded; else their lengths alone are kept
            coded = recompress(nodes, seen.objects, images, masks, profile(i)) if coded is None else coded
            coded = stored(coded.selectExpr("doc_id", "obj", "cast(octet_length(payload) as long) as n", "width", "height", "gray"), "image_lengths")
            own = nodes.join(coded.select("doc_id", "obj"), ["doc_id", "obj"], "left_semi")
            parts.append(sized(with_image_keys(own, coded), coded, i))
    return reduce(DataFrame.unionByName, parts) if parts else None

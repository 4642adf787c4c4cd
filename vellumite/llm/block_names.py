"""Operator 5 - exact dedup by deterministic block naming. DataFrame functions only.

A text is lower-cased (A-Z only) and cut into blocks of ``BLOCK`` bytes. Sorted,
the distinct blocks get integer names; then the names of adjacent pairs are
named in the same way, level after level, until one name stands for each
document. Equal texts get equal names, and different texts never do.

Blocks are sorted by (64-bit hash, block). The hash travels in place of the
block: a first pass over the texts shuffles each map task's distinct (hash,
block) rows once and counts the blocks behind each hash, so a hash is trusted
as a name only after it is known to stand for one block. Where it stands for
more, those blocks are ranked by their bytes, and each gets its own name.

Names of a level start above all names of the level before, so a name says its
level too. A hot block, pair or text is combined before each shuffle, and the
joins that hand names back are plain equi-joins that AQE splits.

Null texts count as empty, and empty texts are one group. Repeated rows are
members of their group; repeated ids stay apart, as separate rows, and of two
rows with the largest id one stays. A null id loses to any other. An empty
table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BLOCK = 4096


def blocks(docs: DataFrame, size: int, hash_bits: int, *carry: Column) -> DataFrame:
    """One row a block: ``carry``, pos, h, block. An empty text is one empty block."""
    body = common.ascii_lower(F.coalesce("text", F.lit(""))).cast("binary")
    cut = docs.select(*carry, body.alias("body"))
    count = F.expr(f"greatest(1, cast(ceil(octet_length(body) / {size}) as int))")
    cut = cut.select("*", F.explode(F.sequence(F.lit(0), count - 1)).alias("pos"))
    cut = cut.withColumn("block", F.expr(f"substring(body, pos * {size} + 1, {size})")).drop("body")
    return cut.withColumn("h", F.shiftright(F.xxhash64("block"), 64 - hash_bits) if hash_bits < 64 else F.xxhash64("block"))


def integer_names(keys: DataFrame, by: list[str], first: int, width: Column, name: str) -> tuple[DataFrame, int]:
    """Sort distinct ``keys`` and name them by integers from ``first`` on, ``width`` names each; also the next free name."""
    ordered = keys.withColumn("_width", width).repartitionByRange(*by).sortWithinPartitions(*by)
    numbered = common.stored(ordered.withColumn("_mid", F.monotonically_increasing_id()), name)
    # (partition << 33) + row keeps the sort order; ranks of one key's blocks go below it
    top = numbered.agg(F.max("_mid"), F.max("_width")).first()
    most = int(top[1] or 1)
    named = numbered.withColumn("name", F.lit(first) + F.col("_mid") * most).drop("_mid", "_width")
    return named, first + (int(top[0] or 0) + 1) * most


def identities(docs: DataFrame, *, block: int = BLOCK, hash_bits: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, doc_id, text_sha256, identity): one collision-free integer for each distinct text."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    variants = blocks(docs, block, hash_bits).groupBy("h", "block").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count("one").alias("variants"))
    variants = common.stored(variants, "block_hashes")
    names, free = integer_names(variants, ["h"], 0, F.col("variants"), "block_names")

    sha = F.sha2(common.ascii_lower(F.coalesce("text", F.lit(""))), 256)
    marked = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", sha.alias("text_sha256"), "text")
    level = blocks(marked, block, hash_bits, F.col("rid"), F.col("doc_id"), F.col("text_sha256"))
    shared = variants.where("variants > 1")
    if shared.isEmpty():
        level = level.drop("block").withColumn("rank", F.lit(0))
    else:
        ranks = blocks(docs, block, hash_bits).join(shared, "h").select("h", "block").distinct()
        ranks = ranks.selectExpr("h", "block", "row_number() over (partition by h order by block) - 1 as rank")
        level = level.join(common.stored(ranks, "block_ranks"), ["h", "block"], "left").drop("block").fillna(0, ["rank"])
    level = common.stored(level, "document_blocks")
    rows = level.where("pos = 0").select("rid", "doc_id", "text_sha256")

    level = level.join(names.select("h", "name"), "h").select("rid", "pos", (F.col("name") + F.col("rank")).alias("name"))
    done = None
    while True:
        level = common.stored(level.withColumn("last", F.lit(None).cast("long")) if done is None else level, "names")
        long = level.where("pos > 0").select("rid").distinct()
        single = level.join(long, "rid", "left_anti").select("rid", F.col("name").alias("identity"))
        done = single if done is None else done.unionByName(single)
        if long.isEmpty():
            return rows.join(done, "rid")
        pairs = level.join(long, "rid", "left_semi").groupBy("rid", F.expr("pos div 2").alias("pos"))
        pairs = pairs.agg(F.max(F.expr("case when pos % 2 = 0 then name end")).alias("a"), F.max(F.expr("case when pos % 2 = 1 then name end")).alias("b"))
        pairs = common.stored(pairs.fillna(-1, ["b"]), "pairs")
        named, free = integer_names(pairs.select("a", "b").distinct(), ["a", "b"], free, F.lit(1), "pair_names")
        level = pairs.join(named, ["a", "b"]).select("rid", "pos", "name")


def exact_groups(docs: DataFrame, **how) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256."""
    named = common.stored(identities(docs, **how), "identities")
    best = F.max(F.struct("doc_id", "rid")).alias("best")
    groups = named.groupBy("identity").agg(best, F.count(F.lit(1)).alias("group_size"))
    groups = groups.select("identity", F.col("best.doc_id").alias("keep_id"), F.col("best.rid").alias("keep_rid"), "group_size")
    kept = (F.col("rid") == F.col("keep_rid")).alias("kept")
    return named.join(common.stored(groups, "groups"), "identity").select("doc_id", "keep_id", "group_size", kept, "text_sha256")


def op5_block_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(common.read_table(spark, sf_dir, "documents"))


QUERIES = {"op5_block_names": op5_block_names}
ORACLES = {
    "op5_block_names": """
        with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as body from documents)
        select doc_id, max(doc_id) over (partition by body) as keep_id, count(*) over (partition by body) as group_size,
               doc_id = max(doc_id) over (partition by body) as kept, sha256(body) as text_sha256
        from t"""
}

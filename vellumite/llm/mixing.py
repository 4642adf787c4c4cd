"""Operator 9 - mixing sources to target weights by hash-threshold histograms. No sort, no sample.

Each source gets a target number of words. A document's position is a 62-bit
hash of its id; its source takes the documents below a threshold. The threshold
comes from a histogram of words by (source, hash bucket): the bucket that holds
the target is found from running sums, and only that bucket is cut into finer
buckets, until a bucket is a single hash value. A bucket that holds the target
and cannot be cut is taken if that comes nearer. Thresholds are nested: a larger
target takes a superset. A target above a source's size takes every document
once and, by the same threshold, some a second time.

Null texts have size zero and null sources are one source, last in order. Equal
ids are told apart by their text's hash; rows equal in both are taken or left
together. Sources without words take nothing. An empty table gives no rows.
Extra columns are kept by :func:`mix` and not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

HASH_BITS, STEP_BITS = 62, 10


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, weight, source_size, target): shares of ``share`` times all words by weight, none above ``cap`` times its source.

    A source is at its cap when the water level L has L * weight >= cap * size,
    so in ascending order of cap * size / weight the capped sources come first,
    and L follows from running sums.
    """
    per = common.stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "source_sizes")
    by_source = F.asc_nulls_last("source")
    weight = "element_at(array({}), cast(place % {} as int) + 1) as weight".format(",".join(map(str, weights)), len(weights))
    per = common.with_sums_ahead(per, [by_source], {"place": "1L"}, "source_places").selectExpr("source", "source_size", weight)
    per = per.selectExpr("*", f"{cap}D * source_size as most", f"{cap}D * source_size / weight as level")
    per = common.with_sums_ahead(per, [F.asc("level"), by_source], {"full": "source_size", "taken": "weight"}, "source_levels")
    words, weighs = per.agg(F.sum("source_size"), F.sum("weight")).first()
    # the first source in that order whose level is above what is left for each weight sets the water level
    per = per.withColumn("water", F.expr(f"({share * (words or 0)!r}D - {cap}D * full) / ({weighs or 1} - taken)"))
    mark = per.where("water < level").agg(F.min(F.struct("level", "water")).alias("mark")).first().mark
    target = "most" if mark is None else f"case when level <= {mark.water!r}D then most else {mark.water!r}D * weight end"
    return per.selectExpr("source", "weight", "source_size", f"{target} as target")


def hashed_sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, size, h): one row a document."""
    size = F.coalesce(F.regexp_count(text_col, F.lit(common.WORD)), F.lit(0)).cast("long")
    h = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))), 64 - HASH_BITS)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), h.alias("h"))


def thresholds(sizes: DataFrame, wanted: DataFrame, name: str = "thresholds") -> DataFrame:
    """(source, threshold): hashes below it have sizes that sum up near ``want``, by source.

    Each round reads ``sizes`` narrowed to one bucket a source, and its histogram
    has at most 2 ** STEP_BITS rows a source.
    """
    # lo: start of the open bucket; rest: words wanted from it on
    edges = wanted.selectExpr("source as _source", "0L as lo", "cast(want as double) as rest")
    top = HASH_BITS
    while top > 0:
        low = max(top - STEP_BITS, 0)
        inside = sizes.join(edges, F.expr(f"_source <=> source and shiftright(h, {top}) = shiftright(lo, {top})"))
        counts = inside.groupBy("source", "rest", F.expr(f"shiftleft(shiftright(h, {low}), {low})").alias("bucket")).agg(F.sum("size").alias("words"))
        sums = counts.selectExpr("*", "sum(words) over (partition by source order by bucket) - words as ahead")
        # the boundary: the first bucket with which the target is reached
        edge = sums.where("ahead + words >= rest").groupBy("source").agg(F.min_by(F.struct("bucket", "words", "ahead"), "bucket").alias("e"))
        found = edges.join(edge, F.expr("_source <=> source"), "left").selectExpr("_source", "lo", "rest", "e.*")
        # no bucket reaches it (rounding): all of this one is wanted
        lo = f"case when bucket is null then (shiftright(lo, {top}) + 1) * {1 << top}L else bucket end"
        rest = "case when bucket is null then 0D else rest - ahead end"
        if low == 0:  # one hash value: take it if that comes nearer
            lo = f"{lo} + case when (rest - ahead) * 2 >= words and rest > ahead then 1L else 0L end"
        edges = common.stored(found.selectExpr("_source", f"{lo} as lo", f"{rest} as rest"), f"{name}_{low}")
        top = low
    return edges.selectExpr("_source as source", "lo as threshold")


def mix(docs: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, copies, taken."""
    sizes = common.stored(hashed_sizes(docs, id_col, text_col, source_col), "sizes")
    targets = common.stored(source_targets(sizes, weights, share, cap), "targets")
    cuts = thresholds(sizes, targets.selectExpr("source", "target - source_size * floor(target / greatest(source_size, 1)) as want"))
    plan = targets.join(cuts.withColumnRenamed("source", "_s"), F.expr("source <=> _s")).selectExpr("source as _source", "source_size", "target", "threshold", "floor(target / greatest(source_size, 1)) as whole")
    plan = common.stored(plan, "mix_plan")
    mixed = sizes.join(plan, F.expr("_source <=> source"))
    copies = "case when size = 0 then 0L else whole + cast(h < threshold as long) end"
    return mixed.selectExpr("doc_id", "source", "size", "source_size", "target", "h", f"{copies} as copies").selectExpr("*", "size * copies as taken")


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it takes them."""
    names = [how.get(k, d) for k, d in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))]
    copies = mix(docs, **how).groupBy("doc_id", "h", "source").agg(F.max("copies").alias("copies")).where("copies > 0")
    copies = common.stored(copies, "copies").selectExpr("doc_id as _id", "h as _h", "source as _source", "copies as _copies")
    h = F.shiftrightunsigned(F.xxhash64(F.col(names[0]), F.crc32(F.coalesce(F.col(names[1]), F.lit("")).cast("binary"))), 64 - HASH_BITS)
    hashed = docs.select(F.struct("*").alias("_row"), h.alias("_own"), F.col(names[0]).alias("_doc"), F.col(names[2]).alias("_from"))
    taken = hashed.join(copies, F.expr("_own = _h and _doc <=> _id and _from <=> _source"))
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("_row.*")


def op9_hash_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op9_hash_mix": op9_hash_mix}
ORACLES: dict[str, str] = {}

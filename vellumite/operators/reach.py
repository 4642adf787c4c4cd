"""Graph operators: what can be reached from the trailer, and the page tree.

A document's graph has 500,000 objects at most (the limit of the parser) and no
payloads, so it is walked in one task, to any depth, with many others. A graph that is not
cut into documents is walked by frontier joins, a round a level.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored


def references(nodes: DataFrame) -> DataFrame:
    """(doc_id, src, dst): references from object to object; the trailer (-1) without /Prev and /XRefStm."""
    refs = nodes.where("kind = 'ref' and not (obj = -1 and top_key in ('Prev', 'XRefStm'))")
    return refs.selectExpr("doc_id", "obj as src", "ref_obj as dst")


#: Rows of documents that are walked together, at least.
TOGETHER = 1 << 17


def whole_documents(batches: Iterator[pa.RecordBatch], least: int = TOGETHER) -> Iterator[pa.Table]:
    """Rows sorted by ``doc_id`` as tables of whole documents, of about ``least`` rows or one document each."""
    held, size, wait = [], 0, least
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < wait:
            continue
        table = pa.Table.from_batches(held)
        docs = table.column("doc_id")
        cut = int(np.searchsorted(docs.to_numpy(), docs[-1].as_py()))
        if cut:
            yield table.slice(0, cut)
        held, size = table.slice(cut).to_batches(), size - cut
        wait = max(least, 2 * size)
    if size:
        yield pa.Table.from_batches(held)


def by_document(rows: DataFrame, one: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``one`` of many documents' rows at a time; a group each would cost far more than its walk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_documents(batches):
            yield from one(table).to_batches()

    return rows.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(run, schema)


def walk(doc: np.ndarray, src: np.ndarray, dst: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, node) that can be reached from each document's ``start``, itself included; ``doc`` is sorted."""
    docs, place = np.unique(doc, return_inverse=True)
    names, number = np.unique(np.concatenate([[start], src, dst]), return_inverse=True)
    base = np.arange(len(docs)) * len(names)  # a node is a document and a number
    keys, node = np.unique(np.concatenate([base + number[0], base[place] + number[1 : len(src) + 1], base[place] + number[len(src) + 1 :]]), return_inverse=True)
    begin, src, dst = node[: len(docs)], node[len(docs) : len(docs) + len(src)], node[len(docs) + len(src) :]
    order = np.argsort(src, kind="stable")
    near, starts = dst[order].tolist(), np.searchsorted(src[order], np.arange(len(keys) + 1)).tolist()
    seen, pending = bytearray(len(keys)), begin.tolist()
    for at in pending:
        seen[at] = 1
    while pending:
        at = pending.pop()
        for to in near[starts[at] : starts[at + 1]]:
            if not seen[to]:
                seen[to] = 1
                pending.append(to)
    found = keys[np.frombuffer(seen, np.uint8).astype(bool)]
    return docs[found // len(names)], names[found % len(names)]


def reachable(nodes: DataFrame) -> DataFrame:
    """(doc_id, obj): objects in use, dangling numbers included."""
    return reached(references(nodes))


def reached(refs: DataFrame) -> DataFrame:
    """(doc_id, obj) that can be reached from the trailer over ``refs`` (doc_id, src, dst)."""

    def one(refs: pa.Table) -> pa.Table:
        docs, found = walk(*(refs.column(c).to_numpy() for c in ("doc_id", "src", "dst")), -1)
        used = found >= 0
        return pa.table({"doc_id": pa.array(docs[used], pa.int64()), "obj": pa.array(found[used], pa.int64())})

    return by_document(refs, one, "doc_id long, obj long")


def used(nodes: DataFrame, without: DataFrame | None = None) -> DataFrame:
    """(doc_id, obj), once each: the trailer and what can be reached from it; ``without`` (doc_id, obj) are taken out first."""
    refs = references(nodes)
    if without is not None:
        refs = refs.join(without.withColumnRenamed("obj", "src"), ["doc_id", "src"], "left_anti")
    kept = reached(refs)
    if without is not None:
        kept = kept.join(without, ["doc_id", "obj"], "left_anti")
    return kept.unionByName(nodes.where("obj = -1").selectExpr("doc_id", "cast(obj as long) as obj").distinct())


def only(nodes: DataFrame, objects: DataFrame) -> DataFrame:
    """``nodes`` of ``objects`` (doc_id, obj, and more columns), which stand there once: an inner join, as one for membership would be made of each part of a union."""
    more = [c for c in objects.columns if c not in ("doc_id", "obj")]
    # the rows are many and the objects few: a hash of these, no sort of those
    return nodes.join(objects.hint("shuffle_hash"), ["doc_id", "obj"]).select(*nodes.columns, *more)


def sweep(nodes: DataFrame) -> DataFrame:
    """``nodes`` of the trailer and of reachable objects."""
    return only(nodes, used(nodes))


def closure(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(origin, node): all nodes that can be reached from ``start`` (origin, node) over one graph's ``edges`` (src, dst), itself included.

    Dead ends - nodes with no way out but to themselves - beside a way that leads on
    are left out of the walk and met at its end, by one join each time they were
    taken off. Chains - nodes
    with one way in and one way out - are not walked link by link: their links are
    numbered by pointer doubling, in rounds as many as the logarithm of the longest,
    and a walk crosses a chain in one step. So rounds follow the branchings on the
    way that lead on, not the depth.
    """
    edges = stored(edges.distinct(), "edges")
    start = stored(start.select("origin", "node").distinct(), "starts")
    tails = []
    for _ in range(DEAD_ENDS):
        edges, dead = without_dead_ends(edges)
        if dead is None:
            break
        tails.append(dead)
    seen = walk_chains(edges, start)
    for dead in reversed(tails):
        ends = seen.withColumnRenamed("node", "src").join(dead, "src").selectExpr("origin", "dst as node")
        seen = seen.unionByName(ends).distinct()
    return seen


#: Times that dead ends are taken off at most.
DEAD_ENDS = 4


def without_dead_ends(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``edges`` apart from those into nodes that have no way out, where their source has another way that leads on; and those, None where there are none."""
    led = edges.where("src <> dst")
    on = led.select(F.col("src").alias("dst")).distinct().withColumn("on", F.lit(True))
    marked = led.join(on, "dst", "left").selectExpr("src", "dst", "on is not null as on")
    marked = stored(marked.selectExpr("src", "dst", "not on and max(on) over (partition by src) as dead"), "led")
    dead = marked.where("dead").select("src", "dst")
    return (edges, None) if dead.isEmpty() else (marked.where("not dead").select("src", "dst"), dead)


def walk_chains(edges: DataFrame, start: DataFrame) -> DataFrame:
    """:func:`closure` of distinct ``edges``, chains crossed in one step."""
    links, ends = chains(edges)
    # an edge into a chain leads to its end; the chain's own first edges are kept by number
    heads = stored(links.select("node", "chain", "place"), "chain_places")
    seen = frontier = start
    entries = None
    rounds = 0
    while not frontier.isEmpty():
        # of what is new: nodes of chains enter them, others follow their edges
        placed = frontier.join(heads, "node", "left")
        entered = placed.where("chain is not null").groupBy("origin", "chain").agg(F.min("place").alias("place"))
        if entries is not None:
            entered = entered.join(entries.select("origin", "chain", F.col("place").alias("had")), ["origin", "chain"], "left").where("had is null or place < had").drop("had")
        entered = stored(entered, "entered")
        entries = entered if entries is None else stored(entries.unionByName(entered).groupBy("origin", "chain").agg(F.min("place").alias("place")), "entries")
        step = placed.where("chain is null").withColumnRenamed("node", "src").join(edges, "src").selectExpr("origin", "dst as node")
        step = step.unionByName(entered.join(ends, "chain").selectExpr("origin", "leaves_to as node")).distinct()
        frontier = stored(step.join(seen, ["origin", "node"], "left_anti"), "reach")
        seen, rounds = seen.unionByName(frontier), rounds + 1
        if rounds % 16 == 0:
            seen = stored(seen, "reached")
    if entries is None:
        return seen
    inside = entries.withColumnRenamed("place", "first").join(heads, "chain").where("place >= first").select("origin", "node")
    return seen.unionByName(inside).distinct()


def chains(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, chain, place) of the nodes with one edge in and one out, and (chain, leaves_to) of the chains they form.

    ``edges`` are distinct. A ring of such nodes is cut at its smallest.
    """
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("ways"), F.min("dst").alias("to"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("in"), F.min("src").alias("of"))
    inner = stored(out.where("ways = 1").join(into.where("in = 1"), "node").where("to <> node").select("node", "of", "to"), "inner")
    # up: the node ``far`` links nearer the head, null where the head is nearer; least: the smallest node passed
    first = inner.join(inner.select(F.col("node").alias("of"), F.lit(True).alias("chained")), "of", "left")
    jumps = stored(first.selectExpr("node", "if(chained, of, null) as up", "if(chained, 1L, 0L) as far", "if(chained, least(node, of), node) as least", "if(chained, null, node) as head"), "jumps")
    most, rounds = inner.count(), 0
    while (1 << rounds) <= 2 * most and not jumps.where("head is null").isEmpty():
        ahead = jumps.selectExpr("node as up", "up as up2", "far as far2", "least as least2", "head as head2")
        jumps = stored(jumps.join(ahead, "up", "left").selectExpr("node", "if(up is null, null, up2) as up", "far + coalesce(far2, 0) as far", "least(least, least2) as least", "coalesce(head, head2) as head"), "jumps")
        rounds += 1
    ringed = jumps.where("head is null")
    if not ringed.isEmpty():  # what has no head after so many doublings goes round
        cut = ringed.where("node = least").select(F.col("node").alias("cut"))
        return chains(edges.join(cut, F.col("src") == F.col("cut"), "left_anti"))
    links = stored(jumps.selectExpr("node", "head as chain", "far as place"), "links")
    last = links.groupBy("chain").agg(F.max("place").alias("place"))
    ends = links.join(last, ["chain", "place"]).join(inner, "node").selectExpr("chain", "to as leaves_to")
    return links, stored(ends, "chain_ends")


#: What a row of a page tree says of its object.
ROOT, DICT, ARRAY, ITEM, PAGES, KIDS, KIDS_REF, KIDS_ODD, PAGE = range(9)


def pages_of(rows: Iterable[tuple[int, int, int | None]]) -> int | None:
    """Pages of the tree that ``rows`` (object, what, reference) of one document make up; None where it cannot be followed (a node met twice, missing, or no dictionary)."""
    root, dicts, arrays, pages, kids, items, page_type = None, set(), set(), {}, {}, {}, set()
    for obj, what, ref in rows:
        if what == DICT:
            dicts.add(obj)
        elif what == ITEM:  # of /Kids, or of an object that is an array
            items.setdefault(obj, []).append(ref)
        elif what == PAGE:
            page_type.add(obj)
        elif what == ARRAY:
            arrays.add(obj)
        elif what == PAGES:
            pages[obj] = ref
        elif what == ROOT:
            root = ref
        else:
            kids[obj] = what, ref
    pending, seen, count = [pages.get(root)], set(), 0
    if root not in dicts:
        return None
    while pending:
        at = pending.pop()
        if at is None or at in seen or at not in dicts:
            return None
        seen.add(at)
        kind, ref = kids.get(at, (None, None))
        if at in page_type or kind is None:
            count += 1
        elif kind == KIDS or kind == KIDS_REF and ref in arrays:
            pending += items.get(at if kind == KIDS else ref, [])
        else:
            return None
    return count


def page_counts(nodes: DataFrame) -> DataFrame:
    """(doc_id, pages): pages of each document's tree; null where it cannot be followed."""
    told = [
        ("obj = -1", f"if(depth = 1 and key = 'Root' and kind = 'ref', {ROOT}, null)"),
        ("depth = 0", f"case when kind in ('dict', 'stream') then {DICT} when kind = 'array' then {ARRAY} end"),
        ("depth = 1 and key is null or depth = 2 and top_key = 'Kids' and key is null", f"{ITEM}"),
        ("depth = 1 and key = 'Pages'", f"{PAGES}"),
        ("depth = 1 and key = 'Kids'", f"case kind when 'array' then {KIDS} when 'ref' then {KIDS_REF} else {KIDS_ODD} end"),
        ("depth = 1 and key = 'Type' and kind = 'name' and bytes_val = X'50616765'", f"{PAGE}"),
    ]
    what = " ".join(f"when {where} then {value}" for where, value in told)
    rows = nodes.selectExpr("doc_id", "obj", f"case {what} end as what", "if(kind = 'ref', ref_obj, null) as ref").where("what is not null")

    def one(table: pa.Table) -> pa.Table:
        docs, found = [], []
        columns = (table.column(c).to_pylist() for c in ("doc_id", "obj", "what", "ref"))
        for doc, own in itertools.groupby(zip(*columns, strict=True), lambda r: r[0]):
            docs.append(doc)
            found.append(pages_of(r[1:] for r in own))
        return pa.table({"doc_id": pa.array(docs, pa.int64()), "pages": pa.array(found, pa.int32())})

    return by_document(rows, one, "doc_id long, pages int")

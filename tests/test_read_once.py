"""Files are read once and not shuffled: what a task decides by itself is what Spark's windows and filters say; an inspection makes only what is asked for."""

from fixtures import planted as planter
from pyspark.sql import functions as F
from test_lengths import frame, odd_file

from vellumite.operators import objects as O
from vellumite.operators.sanitize import inspect, sanitize
from vellumite.sources import scratch
from vellumite.sources.tables import ENTRY, newest, won


def files(spark):
    return frame(spark, {1: odd_file()} | {i: planter.pdf(i, b"page text " * 40, "en", "s", 1) for i in (*range(2, 26), 36, 72, 108, 164)})


def test_entries_that_count(spark):
    """All orders of three sections' entries of two objects, hybrid and free ones among them."""
    rows, doc = [], 0
    kinds = [(0, "used"), (1, "packed"), (2, "free")]
    for a in kinds:
        for b in kinds:
            for c in kinds:
                doc += 1
                for place, (seq, (priority, kind)) in enumerate(((0, a), (0, b), (1, c), (1, a))):
                    rows.append((doc, seq, place, priority, 7, 0, kind, place, 1, place))
    want = newest(spark.createDataFrame(rows, "doc_id long, " + ENTRY)).where("kind <> 'free'").collect()
    got = {i: e["offset"] for i in range(1, doc + 1) for e in won([r[1:] for r in rows if r[0] == i])}
    assert got == {r.doc_id: r.offset for r in want} and 0 < len(got) < doc


def test_roles_are_what_the_filters_say(spark):
    seen = inspect(files(spark))
    told = {(r.doc_id, r.obj): r.role for r in seen.tables.payloads.collect()}
    want = {(r.doc_id, r.obj): "dct" if r.dct else "pack" if r.pack else None for r in seen.objects.where("kind = 'stream'").select("doc_id", "obj", "dct", O.packable().alias("pack")).collect()}
    assert {k: told[k] for k in want} == want and set(want.values()) == {"dct", "pack", None}


def test_tables_are_made_when_asked_for(spark):
    held = len(scratch.made())
    seen = inspect(files(spark))
    assert seen.objects.where(O.packable()).count() > 20
    names = {path.rpartition("/")[2].rpartition("-")[0] for _, path in scratch.made()[held:]}
    assert not names & {"nodes", "stripped", "kept", "facts", "findings", "scan"}


def test_levels_share_what_does_not_change(spark):
    seen = inspect(files(spark))
    done, names = {}, []
    for level in (0, 1, 2):
        held = len(scratch.made())
        done[level] = sanitize(files(spark), level=level, before=seen)
        names += [path.rpartition("/")[2].rpartition("-")[0] for _, path in scratch.made()[held:]]
    assert names.count("parts") == names.count("packed") == names.count("kept") == 1
    sizes = [{r.doc_id: r.length for r in done[i].files.select("doc_id", "length").collect()} for i in (0, 1, 2)]
    assert sizes[0].keys() == sizes[1].keys() == sizes[2].keys() and sizes[2][72] < sizes[1][72] < sizes[0][72]
    done[1].release()
    assert {r.doc_id for r in done[2].files.where(F.length("content") > 0).select("doc_id").collect()} == sizes[2].keys() and seen.parts.count() > 0

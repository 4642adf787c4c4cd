"""Many documents are walked, and their objects written, together: a group, a join or a scan each would cost far more than the work."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_lengths import frame
from test_read_once import files

from vellumite.operators import inspect as I
from vellumite.operators import lengths, reach, write
from vellumite.operators import objects as O
from vellumite.operators.sanitize import inspect
from vellumite.operators.strip import strip
from vellumite.sources import scratch, tables
from vellumite.sources import syntax as S


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_group_for_each_document(spark):
    nodes = inspect(files(spark)).tables.nodes
    for df in (reach.reachable(nodes), reach.page_counts(nodes)):
        assert "FlatMapGroups" not in plan(df) and "MapInArrow" in plan(df)


def test_documents_stay_whole():
    docs = [1] * 3 + [2] * 7 + [5] + [9] * 12 + [10]
    batches = [pa.record_batch({"doc_id": pa.array(docs[i : i + 4], pa.int64()), "n": pa.array(range(i, min(i + 4, len(docs))), pa.int64())}) for i in range(0, len(docs), 4)]
    for least in (1, 3, 5, 100):
        tables = list(reach.whole_documents(iter(batches), least))
        assert [n for t in tables for n in t.column("n").to_pylist()] == list(range(len(docs)))
        held = [set(t.column("doc_id").to_pylist()) for t in tables]
        assert sum(map(len, held)) == len(set(docs)) and (least < 100 or len(held) == 1)
    assert list(reach.whole_documents(iter([]))) == []


def test_walks_do_not_meet():
    """Two documents with the same numbers; one goes round, one has a far number and a chain of 5,000."""
    one, two = [(-1, 1), (1, 2), (2, 1), (3, 4)], [(-1, 4), (4, 1 << 60), *((i, i + 1) for i in range(4, 5000))]
    doc = np.array([7] * len(one) + [8] * len(two))
    docs, found = reach.walk(doc, np.array([s for s, _ in one + two]), np.array([d for _, d in one + two]), -1)
    assert found[docs == 7].tolist() == [-1, 1, 2] and found[docs == 8].tolist() == [-1, *range(4, 5001), 1 << 60]


def test_a_sweep_joins_all_rows_once(spark):
    seen = inspect(files(spark))
    kept = I.kept_after_clean(seen.tables.nodes, seen.objects)
    # one join of whole rows, without a sort of them; the others are of references and of values under a few keys
    joins = [line for line in plan(kept).splitlines() if "Join" in line]
    assert "ShuffledHashJoin" in joins[0] and "Inner" in joins[0] and sum("ShuffledHashJoin" in j for j in joins) == 1 and not any("LeftSemi" in j for j in joins)
    want = reach.sweep(strip(seen.tables.nodes))
    same = lambda df: sorted(map(repr, df.select(sorted(df.columns)).collect()))
    assert same(kept) == same(want) and 0 < kept.count() < seen.tables.nodes.count()


def test_only_telling_values_are_grouped(spark):
    """Usage rights by reference, a signature deep inside, and a type that is no signature, all found from one small table."""
    held = len(scratch.made())
    catalog = b"<< /Type /Catalog /Pages 2 0 R"
    bodies = {1: catalog + b" /Perms 4 0 R >>", 2: catalog + b" /X [ << /Type /Sig >> ] >>", 3: catalog + b" /X << /Type /Signed >> >>", 4: catalog + b" /X << /ByteRange [0 1] /Filter /A >> >>", 5: catalog + b" /X << /FT /Sig >> /Y << /V 1 >> >>"}
    made = {}
    for doc, body in bodies.items():
        data, places = b"%PDF-1.4\n", []
        for n, text in enumerate((body, b"<< /Type /Pages /Count 1 /Kids [3 0 R] >>", b"<< /Type /Page /Parent 2 0 R >>", b"<< /Other 1 >>"), 1):
            places.append(len(data))
            data += b"%d 0 obj\n" % n + text + b"\nendobj\n"
        made[doc] = data + b"xref\n0 5\n0000000000 65535 f \n" + b"".join(b"%010d 00000 n \n" % p for p in places) + b"trailer\n<< /Root 1 0 R /Size 5 >>\nstartxref\n%d\n%%%%EOF\n" % len(data)
    nodes = inspect(frame(spark, made)).tables.nodes
    assert {r.doc_id for r in O.signed(nodes).collect()} == {1, 2, 4}
    signs = next(p for _, p in scratch.made()[held:] if "/signs-" in p)
    assert spark.read.parquet(signs).count() < nodes.count() / 2


def test_objects_keep_the_marks_they_had(spark):
    seen = inspect(files(spark))
    own = seen.tables.nodes.where("depth = 1").where(F.col("key").isin(*O.KEYS)).groupBy("doc_id", "obj").agg(F.sort_array(F.collect_set("key")).alias("want"))
    both = seen.objects.select("doc_id", "obj", F.sort_array("keys").alias("got")).join(own, ["doc_id", "obj"], "left")
    assert both.where("not got <=> coalesce(want, array())").isEmpty() and "n_nodes" not in seen.objects.columns


def test_values_by_columns():
    rows = [(0, None, None, "dict"), (1, 0, "A", "array"), (2, 1, None, "int"), (3, 1, None, "ref"), (4, 0, "B", "name"), (5, 0, "C", "hex"), (6, 0, "D", "string"), (7, 0, "E", "null"), (8, 0, "F", "bool"), (9, 0, "G", "real"), (11, 10, "gone", "int")]
    rest = {"int": (None, 7, None, None, None, None), "ref": (None, None, None, None, 3, 1), "name": (None, None, None, b"N", None, None), "hex": (None, None, None, b"\x01", None, None), "string": (None, None, None, b"s", None, None), "bool": (True, None, None, None, None, None), "real": (None, None, 0.5, None, None, None)}
    got = write.value_of([(*r, *rest.get(r[3], (None,) * 6)) for r in rows])
    assert got == {"A": [7, S.Ref(3, 1)], "B": "N", "C": b"\x01", "D": b"s", "E": None, "F": True, "G": 0.5} and isinstance(got["C"], S.Hex)


def test_comments_and_long_names():
    assert S.read(b"%a word\n % true\r\n[%]\n1 /A#42 %>\n]", 0) == ([1, S.Name("AB")], 33)
    with pytest.raises(S.Bad):
        S.read(b"% true", 0)
    long = b"/" + b"x" * 5000
    held = S.decoded.cache_info().currsize
    assert S.read(long, 0)[0] == "x" * 5000 and S.written(S.Name("x" * 5000)) == long and S.decoded.cache_info().currsize == held


def test_offsets_are_found_once_and_levels_share_a_row(spark):
    seen = inspect(files(spark))
    held = len(scratch.made())
    out = write.write([seen.parts.where("obj >= 0"), seen.parts.where("obj = -1")], [seen.tables.payloads.select("doc_id", "obj", "payload")], seen.tables.docs)
    assert any("/placed-" in p for _, p in scratch.made()[held:]) and plan(out).count("Window") == 0
    sizes = lengths.exact_sizes(seen, levels=(0, 1, 2))
    assert plan(sizes).count("Generate explode(array(0, 1, 2))") == 0
    assert sizes.groupBy("level").count().orderBy("level").collect() == [(i, seen.facts.where("not signed").count()) for i in (0, 1, 2)]


def test_rows_are_made_whole():
    value = {S.Name("A"): [1, None, S.Ref(3, 0), {S.Name("B"): S.Name("x")}], S.Name("C"): S.Hex(b"h"), S.Name("D"): True, S.Name("E"): 0.5, S.Name("F"): b"s"}
    plain = tables.flatten(7, 1, S.Stream(value, b"data"))
    assert tables.flatten(7, 1, S.Stream(value, b"data"), (9,), (None, "t")) == [(9, *r, None, "t") for r in plain]
    assert [(r[2], r[3], r[4], r[5], r[6], r[7], r[8]) for r in plain[:6]] == [(0, None, 0, 0, None, None, "stream"), (1, 0, 1, 0, "A", "A", "array"), (2, 1, 2, 0, None, "A", "int"), (3, 1, 2, 1, None, "A", "null"), (4, 1, 2, 2, None, "A", "ref"), (5, 1, 2, 3, None, "A", "dict")]

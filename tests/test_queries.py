"""Every query with SQL gives what the SQL gives."""

import pytest
from helpers import duck, rows

from vellumite.plans import queries as Q


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_matches_sql(spark, sf, name):
    assert rows(Q.QUERIES[name](spark, sf)) == duck(Q.ORACLES[name], sf)


def test_packing_shrinks_and_reads_back(spark, sf):
    done = Q.cleaned(spark, sf, 1)
    assert done.status.where("error_code = 'corrupt' and reason = 'pages changed'").count() == 0
    assert done.packed.count() > 0


def test_cleaning_twice_finds_nothing_more(spark, sf):
    from vellumite.operators.sanitize import report, sanitize

    once = Q.cleaned(spark, sf)
    again = report(sanitize(once.files.select("doc_id", "length", "content")))
    assert again.where("coalesce(size(removed), 0) > 0").count() == 0
    assert again.count() == once.files.count()


def test_planted_tokens_are_gone(spark, sf):
    from pyspark.sql import functions as F

    text = F.decode("content", "ISO-8859-1")
    left = Q.cleaned(spark, sf).files.where(text.contains("/Author") | text.contains("Exif") | text.contains("/PieceInfo") | text.contains("D:20240101"))
    assert left.count() == 0

"""The classifier's sample: labels without documents, and an id on many rows."""

import numpy as np

from vellumite.llm import quality


def test_sample_of_the_fit(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality.OrdinalModel, "fit", classmethod(lambda cls, rows, grades: seen.append((len(rows), grades.tolist())) or cls({}, np.zeros(2))))
    docs = spark.createDataFrame([(0, f"hot {i}") for i in range(300)] + [(i, f"text {i}") for i in range(1, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 0, 1)] + [(i, 1, 0) for i in range(1, 40)] + [(i, 1, 0) for i in range(1000, 3000)], "doc_id long, quality int, toxic int")
    assert quality.train(docs, labels, sample=25) is not None
    assert quality.train(docs, labels, sample=40) is not None
    assert [n for n, _ in seen] == [25, 40] and seen[0][1].count(0) <= 1 and sorted(seen[1][1]) == [0] + [2] * 39

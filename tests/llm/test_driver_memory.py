"""What the driver holds after the classifier's fit is the model, not the memory of the sample."""

import re
from pathlib import Path

import numpy as np

from vellumite.llm import quality


def held_mb():
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


def test_fit_gives_its_memory_back(spark):
    """9,000 documents of 400 words each, 3.6 million features."""
    words = spark.range(9000).selectExpr("id as doc_id", "array_join(transform(sequence(1, 400), i -> concat('w', cast(pmod(xxhash64(id, i), 40000) as string))), ' ') as text")
    docs = spark.createDataFrame(words.toPandas())
    labels = spark.range(9000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality", "0 as toxic")
    quality.train(docs.limit(50), labels)  # what is loaded and kept by any fit
    before = held_mb()
    model = quality.train(docs, labels)
    assert len(model.weights) > 30_000 and np.isfinite(model.thresholds).all()
    assert held_mb() - before < 40

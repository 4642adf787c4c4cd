"""Files of a table that is one row group are planted and parsed by many tasks."""

import random

import pyarrow as pa
import pyarrow.parquet as pq

from vellumite.plans import queries


def test_one_row_group_is_dealt(spark, tmp_path):
    rng = random.Random(5)
    texts = [rng.randbytes(1500).hex() for _ in range(3000)]
    table = pa.table({"doc_id": range(3000), "text": texts, "lang": ["en"] * 3000, "source": ["web"] * 3000, "n_chars": [len(t) for t in texts]})
    pq.write_table(table, tmp_path / "documents.parquet", row_group_size=3000)
    found = queries.files(spark, str(tmp_path))
    assert found.count() == 3000 and found.selectExpr("input_file_name() as f").distinct().count() >= 4

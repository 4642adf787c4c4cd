"""An image is encoded once for all who ask for it."""

import pytest
from fixtures import planted as planter
from test_read_once import files

from vellumite.config import profile
from vellumite.operators import lengths
from vellumite.operators.compress import again_once
from vellumite.operators.sanitize import inspect, sanitize


def test_images_are_encoded_once_for_clean_and_sizes(spark, monkeypatch):
    seen = inspect(files(spark))
    made = {r.doc_id: r.length for r in sanitize(files(spark), level=2, before=seen).files.select("doc_id", "length").collect()}

    def never(*_):
        raise AssertionError("encoded again")

    monkeypatch.setattr(lengths, "recompress", never)
    told = lengths.exact_sizes(seen, levels=(2,)).select("doc_id", "length").collect()
    assert {r.doc_id: r.length for r in told} == made and 72 in made
    with pytest.raises(AssertionError):  # a level that was not cleaned
        lengths.exact_sizes(seen, levels=(3,))


def test_equal_images_are_encoded_once():
    again_once.cache_clear()
    out = {again_once(planter.PHOTO, 160, 120, False, (160, 120), profile(2)) for _ in range(3)}
    assert len(out) == 1 and again_once.cache_info().misses == 1

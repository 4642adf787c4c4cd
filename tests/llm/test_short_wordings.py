"""Operator 6 on wordings of few words and passages put into long ones: nothing is lost, and time grows with the text."""

import random
import time

import pytest

from vellumite.llm.license_scan import Scanner


@pytest.mark.parametrize("size", range(1, 13))
def test_whole_wordings_of_any_length(size):
    rng = random.Random(size)
    templates = tuple((f"L{i}", " ".join(f"t{size}q{i}w{j}" for j in range(size))) for i in range(3))
    scanner = Scanner(templates)
    for _ in range(300):
        words = [f"x{rng.randrange(50)}" for _ in range(rng.randrange(0, 40))]
        at, which = rng.randrange(len(words) + 1), rng.randrange(3)
        text = " ".join(words[:at] + templates[which][1].upper().split() + words[at:])
        assert scanner.scan(text.encode()) == [(f"L{which}", at, at + size - 1, size, 1.0)]
        assert scanner.scan(" ".join(words).encode()) == []


@pytest.mark.parametrize("put_in", [1, 10, 60, 150])
def test_passage_put_into_the_middle(put_in):
    words = [f"w{i}" for i in range(200)]
    found = Scanner((("L", " ".join(words)),)).scan(" ".join(["a"] * 30 + words[:100] + [f"p{i}" for i in range(put_in)] + words[100:] + ["b"] * 30).encode())
    assert [(m[0], m[1], m[2]) for m in found] == [("L", 30, 30 + 199 + put_in)] and found[0][4] > 0.98


def test_many_notices_in_one_text():
    wording = "under the terms of the sample license"
    scanner = Scanner((("S", wording), ("one", "sample")))
    took = []
    for n in (500, 4000):
        text = " ".join(f"{wording} k{i} k{i + 1} k{i + 2}" for i in range(n)).encode()
        began = time.process_time()
        found = scanner.scan(text)
        took.append(time.process_time() - began)
        assert len(found) == n and {m[0] for m in found} == {"S"}
    assert took[1] < 24 * took[0] + 0.5

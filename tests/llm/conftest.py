import random

import pytest

#: Invented words; a few are common.
COMMON = "the of and to in is was for on that".split()


def sentence(rng, n, words=400):
    return " ".join(rng.choice(COMMON) if rng.random() < 0.4 else f"w{rng.randrange(words)}x" for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty, very long and repeated rows, equal texts in other case, and columns with clashing names."""
    rng = random.Random(5)
    base = [sentence(rng, 60) for _ in range(12)]
    long = sentence(rng, 30_000)
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    rows += [(100, None, "en", "s0", 0), (101, "", None, "s1", 0), (102, "   \t\n", "en", None, 5), (103, long, "en", "s2", len(long)), (104, base[0].upper(), "en", "s0", None)]
    rows += [(105, base[1], "de", "s1", 3), (105, base[1], "de", "s1", 3), (105, base[2] + " more", "de", "s1", 3), (None, base[3], "de", "s1", 3), (None, None, None, None, None)]
    rows += [(106, "one", "en", "s0", 3), (107, "one two", "en", "s0", 7), (108, "ÀÉ à Straße\x0bx  y", "de", "s2", 9)]
    full = [(*r, 1, 2, "x", True, 5, "d", 0.5) for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, h long, position int, fp string, selected boolean, name int, digest string, score double")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")

"""Awkward documents shared by the tests of this folder."""

import pytest

LONG = "lorem ipsum dolor sit amet " * 20_000
CASES = [
    (1, "The Cat sat on the mat near the door today.", "en", "s1"),
    (2, "the cat sat on the mat near the door today.", "en", None),
    (3, None, "fr", "s1"),
    (4, "", None, "s2"),
    (5, " \t\n", "en", "s2"),
    (6, "12 3 !?", "de", "s3"),
    (7, "héé ßtraße　ÀB cd", "fr", "s1"),
    (8, LONG, "en", "s1"),
    (9, "one two", "en", "s1"),
    (9, "one two", "en", "s1"),
    (None, "one two", "en", "s1"),
    (10, "The Cat sat on the mat near the door today.", "fr", "s9"),
]
# Extra columns whose names the operators use inside or return.
EXTRA = "kept boolean, fingerprint string, component_id long, keep string, score double, sha long, run string, rate double, rank int"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA


def frame(spark, rows=CASES):
    width = 5 + EXTRA.count(",") + 1
    return spark.createDataFrame([(*r, len(r[1] or "")) + (None,) * (width - 5) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def cases(spark):
    return frame(spark).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])

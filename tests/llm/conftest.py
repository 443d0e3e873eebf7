import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, kept string, labels string, _k string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeats, ties, and columns whose names the operators use themselves."""
    long = " ".join(f"word{i % 997} mit license 10.0.0.{i % 300}" for i in range(3000))
    rows = [
        (1, "Alpha beta gamma delta epsilon zeta", "en", "s1"), (2, "ALPHA beta gamma delta epsilon zeta", "en", "s1"),
        (3, None, None, None), (4, "", "en", "s2"), (5, long, "en", "s2"), (6, long, "de", None), (7, "été à paris: le cœur <|endoftext|> x", "fr", "s3"),
        (8, "mail a.b@c.org, call +1 (555) 123-4567 or 4539 1488 0343 6467 from 192.168.1.1", "en", "s3"),
        (9, "x" * 5000, "en", "s1"), (10, "Licensed under the MIT License. See Apache License, Version 2.0", None, "s1"), (None, "no id here at all", "en", "s1"),
        (11, "Alpha beta gamma delta epsilon zeta", "en", "s9"), (11, "Alpha beta gamma delta epsilon zeta", "en", "s9"), (12, "12 ... 99", "en", "s9"),
    ]
    return spark.createDataFrame([(*r, 7, "a", "b", "c", "d") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)

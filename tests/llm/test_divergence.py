"""The source divergence audit against plain counting."""

import random

import pytest

from tests.llm import brute
from wiretide.llm import divergence

COLUMNS = "text string, lang string, source string, term string, n bigint, block int, size string, id string"


def rows():
    rng = random.Random(4)
    weights = [1 / (k + 1) for k in range(150)]
    out = []
    for i in range(260):
        words = rng.choices([f"{'tÉ' if k % 7 == 0 else 'Wo'}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(150)], weights, k=rng.randint(0, 60))
        lang = rng.choice(["en", "en", "de", None, ""])
        out.append((" ".join(words), lang, rng.choice(["a", "b", "é", "Z", None]), "t", 1, 2, "s", "i"))
    out += [(None, "en", "none", *out[0][3:]), ("", "fr", "a", *out[0][3:]), (" 12 _ ", "fr", "b", *out[0][3:]), ("lonely word", "it", "x", *out[0][3:])]
    return out + [out[0], out[0], ("the " * 40_000, "en", "a", None, None, None, None, None)]


@pytest.mark.parametrize(("block", "stripe"), [(8192, 64), (16, 2)])
def test_equal_to_plain_counting(spark, monkeypatch, block, stripe):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "STRIPE", stripe)
    docs = spark.createDataFrame(rows(), COLUMNS).repartition(3)
    assert sorted(map(tuple, divergence.source_divergence(docs).collect())) == brute.divergence([r[:3] for r in rows()])


def test_bitmaps_where_many_terms_share_a_count(spark):
    """Sets long enough to be bitmaps, beside short ones, and the complement for count zero."""
    many = [chr(97 + i // 676) + chr(97 + i // 26 % 26) + chr(97 + i % 26) for i in range(2000)]
    texts = [(" ".join(many[:1500]), "en", "a"), (" ".join(many[900:]), "en", "b"), (" ".join(many[400:600] * 2 + many[:3] * 5), "en", "c")]
    docs = spark.createDataFrame([t for t in texts for _ in range(10)], "text string, lang string, source string")
    assert sorted(map(tuple, divergence.source_divergence(docs).collect())) == brute.divergence([t for t in texts for _ in range(10)])


def test_empty_and_merges(spark, monkeypatch):
    assert divergence.source_divergence(spark.createDataFrame([], COLUMNS)).count() == 0
    monkeypatch.setattr(divergence, "MERGE_ROWS", 50)
    monkeypatch.setattr(divergence, "KEEP_ROWS", 20)
    docs = spark.createDataFrame([("Aa bb " * 3, "x", "s")] * 12 + [("bb cc", "x", "t")] * 12, "text string, lang string, source string")
    wanted = brute.divergence([("Aa bb " * 3, "x", "s")] * 12 + [("bb cc", "x", "t")] * 12)
    assert sorted(map(tuple, divergence.source_divergence(docs).collect())) == wanted

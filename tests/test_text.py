"""Stems, words, scripts, fragments, freshness: golden values."""

import pytest
from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.functions.stem import stem
from foliant.operators import words


@pytest.mark.parametrize(
    "word,want",
    [
        ("договоров", "договор"), ("гарантийного", "гарантийн"), ("обслуживания", "обслуживан"), ("ремонтировать", "ремонтирова"), ("added", "add"),
        ("evenings", "evening"), ("organic", "organic"), ("organizations", "organiz"), ("warranties", "warranti"), ("running", "run"), ("hoping", "hope"), ("été", "été"), ("2025", "2025"),
    ],
)
def test_stems(word, want):
    assert stem(word) == want


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_words(spark):
    assert one(spark, X.words(F.lit("INV-2025-0114 Kettle's " + "я" * 24 + " " + "a" * 47))) == ["inv", "2025", "0114", "kettle", "s", "a" * 47]
    assert words.terms_of("INV-2025-0114") == ["inv", "2025", "0114"]


@pytest.mark.parametrize("text,want", [("tea чай", "cyrillic"), ("tea tea чай", "latin"), ("12 34", "other"), ("", "other")])
def test_script(spark, text, want):
    assert one(spark, X.script_of_text(F.lit(text))) == want


@pytest.mark.parametrize("age,want", [(0, 1.1), (30 * 86400, 1.05), (-5, 1.1)])
def test_freshness(spark, age, want):
    assert one(spark, X.freshness(F.lit(10**9 - age), F.lit(10**9))) == pytest.approx(want)


def test_links_and_names(spark):
    assert one(spark, X.link_key(F.lit("Notes/Big Kettle.md"))) == "big kettle"
    assert one(spark, X.link_target(F.lit("./A\\B.md"))) == "a/b"
    assert one(spark, X.wikilinks(F.lit("[[A|b]] [[A#x]] [[ ]] [[c/D]]"))) == ["A", "c/D"]
    for title, want in (("scan001.pdf", False), ("Handbook", True), ("FILE", False), ("12", False)):
        assert one(spark, X.names_a_document(F.lit(title), F.lit("file"))) is want


def test_fragment(spark):
    assert one(spark, X.opening_fragment(F.lit("a" * 240))) == "a" * 240
    assert one(spark, X.opening_fragment(F.lit("a" * 239 + " b"))) == "a" * 239 + "…"


def test_query_language():
    clauses, either = words.parse('kettle "two words" -tea title:guide +x a-b OR c', stemmed=False)
    assert either
    assert [(c.terms, c.field, c.sign) for c in clauses] == [(("kettle",), None, ""), (("two", "words"), None, ""), (("tea",), None, "-"), (("guide",), "title", ""), (("x",), None, "+"), (("a", "b"), None, ""), (("c",), None, "")]

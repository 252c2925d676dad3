"""Extraction and text views."""

import pytest
from pyspark.sql import functions as F

from parley.functions import text as X

c = F.col


def one(spark, expression, **values):
    columns = [F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).cast("array<string>").alias(k) for k, v in values.items()]
    return spark.range(1).select(*columns).select(expression.alias("x")).first().x


def test_budget_and_color(spark):
    t = "under $89.99 in navy"
    assert one(spark, X.budget(c("t")), t=t) == 89.99
    assert one(spark, X.all_in_order(c("t"), ("black", "navy")), t=t) == ["navy"]


@pytest.mark.parametrize(("text", "size"), [("I'm looking for X", "m"), ("Women's", "s"), ("a size 10.5 shoe", "size 10.5"), ("XX-Large", "xx-large"), ("8 us", "8 us"), ("none", None)])
def test_size_takes_single_letters_after_apostrophes(spark, text, size):
    assert one(spark, X.size(c("t")), t=text) == size


def test_strict_size(spark):
    assert one(spark, X.size(c("t"), strict=True), t="I'm looking for xl") == "xl"


def test_colors_inside_words_and_by_place(spark):
    assert one(spark, X.color(c("t")), t="tailored standard") == "red"
    assert one(spark, X.color(c("t")), t="standard") == "tan"
    assert one(spark, X.first_by_place(c("t"), ("black", "white")), t="White and black") == "white"
    assert one(spark, X.first_by_place(c("t"), ("red",)), t="tailored") is None


@pytest.mark.parametrize(("values", "out"), [(["Clothing, Shoes & Jewelry", "Women", "Dresses"], "Women Dresses"), (["Clothing, Shoes & Jewelry"], "Shoes & Jewelry"), ([], "clothing item"), (["Clothing", "Boots"], "Boots")])
def test_coarse_category(spark, values, out):
    assert one(spark, X.coarse_category(c("v")), v=values) == out


@pytest.mark.parametrize(("text", "name"), [("budget around $5", "budget"), ("<= 4", "budget"), ("nylon red", "material"), ("color: red", "color"), ("wide", "size"), ("V-neck", "style"), ("gym", "use_case"), ("nice", "feature")])
def test_classes(spark, text, name):
    assert one(spark, X.classify_constraint(c("t")), t=text) == name


def test_clean_constraint(spark):
    assert one(spark, X.clean_constraint(c("t")), t=" - a \n\t b;, ") == "a b"
    assert one(spark, X.clean_constraint(c("t")), t="x" * 179 + " yz") == "x" * 179


@pytest.mark.parametrize(("raw", "out"), [("49", "49"), ("49.0", "49.0"), ("89.90", "89.9"), ("1e3", "1000.0")])
def test_number_text(spark, raw, out):
    assert one(spark, X.number_text(c("t")), t=raw) == out


def test_terms(spark):
    assert one(spark, X.unique_terms(c("t")), t="The red RED shoe, a shoe for me") == ["red", "shoe"]
    assert one(spark, X.words(c("t")), t="café au lait, no x") == ["café", "au", "lait"]


def test_views(spark):
    assert one(spark, X.lexical_text(c("t"), c("d"), c("g")), t="A", d=["b", None], g=[]) == "A b None"
    assert len(one(spark, X.dense_text(c("t"), c("d"), c("d"), c("d")), t="x" * 600, d=["b"])) == 500
    assert one(spark, X.feature_text(F.lit(None).cast("string"), c("d")), d=["b"]) == "None b"

"""The customer simulator as column expressions: hidden cards, opening messages, replies, overrides."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions import vocabulary as V
from ..sources.staging import spread, written


def intent_card(title: Column, features: Column, details: Column, description: Column, categories: Column, store: Column, price_text: Column) -> Column:
    """target_category, hard_constraints (two at most), soft_preferences (two at most, or the first again)."""
    none = F.array().cast("array<string>")
    told = F.filter(F.coalesce(features, none), lambda x: x.isNotNull() & (x != ""))
    pairs = F.filter(F.coalesce(F.map_entries(details), F.array()), lambda e: e.value.isNotNull() & (e.value != "") & (e.value != "[]"))
    listed = F.concat(told, F.transform(pairs, lambda e: F.concat(e.key, F.lit(": "), e.value)))
    corpus = X.searchable_text(title, features, details, description, categories, store)
    material, color = X.first_by_place(corpus, V.CARD_MATERIALS), X.first_by_place(corpus, V.CARD_COLORS)
    listed = F.concat(F.array_compact(F.array(material)), listed)
    listed = F.when(color.isNotNull(), F.concat(F.slice(listed, 1, 1), F.array(X.filled(V.CARD_COLOR, color)), F.slice(listed, 2, F.greatest(F.size(listed), F.lit(1))))).otherwise(listed)
    priced = F.when(price_text.isNotNull() & (price_text != ""), X.filled(V.CARD_PRICE, X.number_text(price_text)))
    listed = F.concat(listed, F.array_compact(F.array(priced)))
    clean = F.array_distinct(F.filter(F.transform(listed, lambda x: X.clean_constraint(x)), lambda x: x != ""))
    name = X.clean_constraint(F.coalesce(F.nullif(title, F.lit("")), F.lit("product")))
    clean = F.when(F.size(clean) > 0, clean).otherwise(F.array(name))
    soft = F.slice(clean, 3, 2)
    return F.struct(name.alias("target_category"), F.slice(clean, 1, 2).alias("hard_constraints"), F.when(F.size(soft) > 0, soft).otherwise(F.slice(clean, 1, 1)).alias("soft_preferences"))


@F.pandas_udf(T.IntegerType())
def override_turn(sample_id: pd.Series, scenario: pd.Series) -> pd.Series:
    """3 or 4, as the Mersenne Twister seeded by the sample draws it; no expression has that generator."""
    return pd.Series([random.Random(f"{a or ''}\0{b or ''}").choice([3, 4]) for a, b in zip(sample_id, scenario, strict=True)])


def override_of(card: Column, turn: Column) -> Column:
    old = F.coalesce(F.try_element_at(card.soft_preferences, F.lit(-1)), F.lit(V.OVERRIDE_OLD))
    new = F.coalesce(F.get(card.hard_constraints, 0), F.lit(V.OVERRIDE_NEW))
    message = X.filled(V.OVERRIDE, new)
    return F.struct(turn.alias("turn"), old.alias("old_value"), new.alias("new_value"), message.alias("message"))


def hidden_fields(samples: DataFrame, catalog: DataFrame) -> DataFrame:
    """samples with card, override (null but for intent_override) and category. A sample's own card and behavior win.

    Cards are made of targets alone, not of the whole catalog.
    """
    c = F.col
    targets = samples.select(c("ground_truth.parent_asin").alias("parent_asin")).distinct()
    wanted = spread(written(catalog.join(targets, "parent_asin", "left_semi"), "targets"))
    cards = wanted.select(c("parent_asin").alias("target"), intent_card(*(c(x) for x in ("title", "features", "details", "description", "categories", "store", "price_text"))).alias("derived"), X.coarse_category(F.coalesce("categories", F.array().cast("array<string>"))).alias("category"))
    joined = samples.withColumn("target", c("ground_truth.parent_asin")).join(cards, "target")
    given = c("intent_card").isNotNull() & c("behavior").isNotNull()
    card = F.when(given, c("intent_card")).otherwise(c("derived"))
    own = F.when(given, c("behavior.override")).otherwise(F.when(c("scenario_type") == "intent_override", override_of(c("derived"), override_turn("sample_id", "scenario_type"))))
    return joined.select("sample_id", "scenario_type", "target", "category", F.coalesce("user_profile.preference_tags", F.array().cast("array<string>")).alias("tags"), c("user_profile").alias("profile"), card.alias("card"), own.alias("override"))


def initial_message(scenario: Column, category: Column, card: Column, old_value: Column) -> Column:
    """message and disclosed (what the opening gives away)."""
    start, hard = X.filled(V.OPENING, category), F.get(card.hard_constraints, 0)
    none = F.array().cast("array<string>")
    told = F.struct(F.concat(start, X.filled(V.OPENING_BUYING, hard)).alias("message"), F.array(hard).alias("disclosed"))
    switched = F.struct(F.concat(start, X.filled(V.OPENING_OVERRIDE, old_value)).alias("message"), none.alias("disclosed"))
    vague = F.struct(F.concat(start, F.lit(V.OPENING_VAGUE)).alias("message"), none.alias("disclosed"))
    return F.when((scenario == "buying") & hard.isNotNull(), told).when((scenario == "intent_override") & old_value.isNotNull(), switched).otherwise(vague)


def customer_reply(scenario: Column, card: Column, attribute: Column, disclosed: Column, boundary_used: Column) -> Column:
    """message, disclosed and boundary_used after the customer is asked for attribute (null: for none)."""

    def said(message: Column, seen: Column = disclosed, used: Column = boundary_used) -> Column:
        return F.struct(message.alias("message"), seen.alias("disclosed"), used.alias("boundary_used"))

    asked = F.nullif(attribute, F.lit(""))
    known = F.when(asked.isin(*V.ATTRIBUTES), asked).otherwise("other")
    every = F.concat(card.hard_constraints, card.soft_preferences)
    fits = F.slice(F.filter(every, lambda c: ~F.array_contains(disclosed, c) & ((known == "other") | (X.classify_constraint(c) == known))), 1, 2)
    no_choice = X.filled(V.NO_CHOICE, asked)
    nothing = X.filled(V.NOTHING_MORE, known)
    answer = X.filled(V.ANSWER, F.array_join(fits, "; "))
    nudge = F.lit(V.NUDGE)
    return (
        F.when((scenario == "boundary") & ~boundary_used & asked.isNotNull(), said(no_choice, used=F.lit(True)))
        .when(asked.isNull(), said(nudge))
        .when(F.size(fits) == 0, said(nothing))
        .otherwise(said(answer, F.array_union(disclosed, fits)))
    )

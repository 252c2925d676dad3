"""Text views of products and what is extracted from texts, as column expressions that stay in generated code."""

from __future__ import annotations

import unicodedata

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V


def _filled(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def joined(values: Column) -> Column:
    """Elements by spaces; a null element reads None, a null array is empty."""
    return F.coalesce(F.array_join(F.transform(values, lambda x: F.coalesce(x, F.lit("None"))), " "), F.lit(""))


def lexical_text(title: Column, description: Column, categories: Column) -> Column:
    return F.concat_ws(" ", *map(_filled, (title, joined(description), joined(categories))))


def dense_text(title: Column, description: Column, features: Column, categories: Column, chars: int = V.DENSE_CHARS) -> Column:
    return F.left(F.concat_ws(" ", *map(_filled, (title, joined(description), joined(features), joined(categories)))), F.lit(chars))


def searchable_text(title: Column, features: Column, details: Column, description: Column, categories: Column, store: Column) -> Column:
    pairs = F.transform(F.map_entries(details), lambda e: F.concat(e.key, F.lit(" "), F.coalesce(e.value, F.lit("None"))))
    parts = F.concat(F.array_compact(F.array(title)), *(F.coalesce(x, F.array().cast("array<string>")) for x in (features, pairs, description, categories)), F.array_compact(F.array(store)))
    return F.trim(joined(parts))


def feature_text(title: Column, features: Column) -> Column:
    """The text that slots of a product are read from; a null title reads None."""
    return F.concat(F.coalesce(title, F.lit("None")), F.lit(" "), F.coalesce(F.array_join(features, " "), F.lit("")))


def price_bucket(price: Column) -> Column:
    return F.when(price < 25, "budget").when(price < 75, "mid").when(price.isNotNull(), "premium")


def _found(text: Column, words: Sequence[str]) -> list[Column]:
    low = F.lower(text)
    return [F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in words]


def first_in_order(text: Column, words: Sequence[str]) -> Column:
    """The first of words, in their order, that the text holds anywhere, even inside other words."""
    return F.coalesce(*_found(text, words))


def all_in_order(text: Column, words: Sequence[str]) -> Column:
    return F.array_compact(F.array(*_found(text, words)))


def first_by_place(text: Column, words: Sequence[str]) -> Column:
    """The word of words that stands first in the text as a word of its own, in lower case."""
    return F.lower(_filled(F.regexp_extract(text, rf"(?iU)\b({'|'.join(words)})\b", 1)))


def material(text: Column) -> Column:
    return first_in_order(text, V.MATERIALS)


def color(text: Column) -> Column:
    return first_in_order(text, V.COLORS)


def size(text: Column, strict: bool = False) -> Column:
    """The first size. As found in the field a bare s, m or l counts, even after an apostrophe; strict leaves those out."""
    pattern = V.SIZE.replace("|s|m|l|", "|") if strict else V.SIZE
    return F.lower(_filled(F.regexp_extract(text, "(?iU)" + pattern, 1)))


def budget(text: Column) -> Column:
    return _filled(F.regexp_extract(text, V.BUDGET_AMOUNT, 1)).cast("double")


def feature_values(title: Column, features: Column, price: Column) -> Column:
    text = feature_text(title, features)
    return F.array_compact(F.array(material(text), color(text), price_bucket(price)))


def query_terms(text: Column) -> Column:
    """Terms of a fielded search: runs of ASCII letters and digits of two or more, without stop words."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0), lambda t: (F.length(t) > 1) & ~t.isin(*V.FIELDED_STOP_WORDS))


def unique_terms(text: Column, most: int = V.QUERY_TERMS) -> Column:
    return F.slice(F.array_distinct(query_terms(text)), 1, most)


def match_expression(text: Column) -> Column:
    return F.array_join(F.transform(unique_terms(text), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def words(text: Column) -> Column:
    """Tokens of the lexical route: two or more word characters, in lower case, without English stop words."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b(\w\w+)\b"), 1), lambda t: ~t.isin(*V.ENGLISH_STOP_WORDS))


def clean_constraint(text: Column, limit: int = V.CONSTRAINT_CHARS) -> Column:
    one_line = F.regexp_replace(text, r"(?U)\s+", " ")
    return F.rtrim(F.left(F.regexp_replace(one_line, r"^[ \-;,.]+|[ \-;,.]+$", ""), F.lit(limit)))


def classify_constraint(text: Column) -> Column:
    low = F.lower(text)
    out = F.when(F.contains(low, F.lit("budget")) | low.rlike(V.BUDGET_MENTION), "budget")
    for name, marks in V.CONSTRAINT_CLASSES.items():
        hit = F.lit(False)
        for m in marks:
            hit = hit | F.contains(low, F.lit(m))
        out = out.when(hit, name)
    return out.when(text.isNotNull(), "feature")


def coarse_category(categories: Column) -> Column:
    parts = F.transform(F.flatten(F.transform(categories, lambda c: F.split(c, ","))), lambda x: F.trim(x))
    told = F.filter(parts, lambda p: (p != "") & ~F.lower(p).isin(*V.EXCLUDED_CATEGORIES))
    last = F.when(F.size(told) > 2, F.slice(told, -2, 2)).otherwise(told)
    return F.when(F.size(told) > 0, F.array_join(last, " ")).otherwise(V.NO_CATEGORY)


def number_text(raw: Column) -> Column:
    """A price as read from JSON, the way it reads in a message: integers as they are, others in shortest form."""
    return F.when(raw.rlike(r"^-?[0-9]+$"), raw).otherwise(raw.cast("double").cast("string"))


def filled(template: str, *values: Column) -> Column:
    """template with the values in place of its {}."""
    parts = template.split("{}")
    return F.concat(F.lit(parts[0]), *(x for v, p in zip(values, parts[1:], strict=True) for x in (v, F.lit(p))))


def _folding() -> tuple[str, str]:
    """Letters with marks and the letters without, by the decompositions of the Unicode tables, then marks alone, which go."""
    marked = {chr(i): unicodedata.normalize("NFD", chr(i)) for i in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))}
    told = {k: v[0] for k, v in marked.items() if len(v) > 1 and all(unicodedata.combining(x) for x in v[1:])}
    return "".join(told) + "".join(map(chr, range(0x300, 0x370))), "".join(told.values())


def folded(text: Column) -> Column:
    """text without diacritics on Latin letters."""
    return F.translate(text, *_folding())


def cache_key(model: Column, query: Column, ids: Column) -> Column:
    """A key of the re-ranking memo: the hash of its sorted-key JSON."""
    return F.sha2(F.to_json(F.struct(ids.alias("candidates"), model.alias("model"), query.alias("query"))), 256)


def prompt(query: Column, candidates: Column) -> Column:
    """What a re-ranker is asked; candidates is an array of (id, title)."""
    lines = F.array_join(F.transform(candidates, lambda c: F.concat(F.lit("- "), c.id, F.lit(": "), F.coalesce(c.title, F.lit("")))), "\n")
    return F.concat(F.lit("A shopper is looking for: "), query, F.lit("\n\nCandidate products:\n"), lines, F.lit("\n\nCall rank_candidates with every parent_asin above, ordered best match first."))

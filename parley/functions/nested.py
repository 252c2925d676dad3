"""Nested JSON values as text: objects and arrays flattened to lines, values shown as the reading program's str() shows them.

A JSON text is read twice by the same parser, as strings, which keep the order and the spelling, and as variants, which
keep the types; entry by entry both go together. Objects and arrays inside are shown to the depth DEPTH, deeper ones as
JSON.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEPTH = 2


def _entries(text: Column) -> Column:
    """(key, text, kind) of an object's entries, in order."""
    strings, typed = (F.map_entries(F.from_json(text, f"map<string,{kind}>")) for kind in ("string", "variant"))
    return F.zip_with(strings, typed, lambda s, t: F.struct(s.key.alias("key"), s.value.alias("text"), F.schema_of_variant(t.value).alias("kind")))


def _elements(text: Column) -> Column:
    """(key: null, text, kind) of an array's elements."""
    strings, typed = (F.from_json(text, f"array<{kind}>") for kind in ("string", "variant"))
    return F.zip_with(strings, typed, lambda s, t: F.struct(F.lit(None).cast("string").alias("key"), s.alias("text"), F.schema_of_variant(t).alias("kind")))


def quoted(text: Column) -> Column:
    """A string in quotes: single ones, or double ones if it has single ones alone."""
    escaped = F.replace(F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t")), F.lit("\r"), F.lit("\\r"))
    single, double = F.contains(text, F.lit("'")), F.contains(text, F.lit('"'))
    return F.when(single & ~double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'")))


def shown(text: Column, kind: Column, in_quotes: bool = False, depth: int = DEPTH) -> Column:
    """The str() of a value: None, True, numbers in shortest form, strings as they are, or in quotes inside others."""
    value = F.when(text.isNull() | (kind == "VOID"), F.lit("None"))
    value = value.when(kind == "STRING", quoted(text) if in_quotes else text)
    value = value.when(kind == "BOOLEAN", F.initcap(text))
    value = value.when(text.rlike(r"^-?[0-9]+\.[0-9]+$"), F.regexp_replace(text, r"(\.[0-9]+?)0+$", "$1"))
    if depth:
        pair = lambda e: F.concat(quoted(e.key), F.lit(": "), shown(e.text, e.kind, True, depth - 1))
        value = value.when(kind.startswith("OBJECT"), F.concat(F.lit("{"), F.array_join(F.transform(_entries(text), pair), ", "), F.lit("}")))
        value = value.when(kind.startswith("ARRAY"), F.concat(F.lit("["), F.array_join(F.transform(_elements(text), lambda e: shown(e.text, e.kind, True, depth - 1)), ", "), F.lit("]")))
    return value.otherwise(text)


def _kind(text: Column) -> Column:
    return F.schema_of_variant(F.try_parse_json(text))


def items(text: Column) -> Column:
    """The entries of a JSON object with their values shown: map<string,string>; null if the text holds no object."""
    return F.when(_kind(text).startswith("OBJECT"), F.map_from_entries(F.transform(_entries(text), lambda e: F.struct(e.key, shown(e.text, e.kind)))))


def flattened(text: Column) -> Column:
    """Lines of a JSON value: "key: value" of an object's entries, an array's elements, or the value itself.

    Nulls and empty strings are left out, and in objects empty arrays; a text that is no JSON has no lines.
    """
    kind = _kind(text)
    empty = lambda e: e.text.isNull() | (e.kind == "VOID") | (e.text == "")
    of_object = F.transform(F.filter(_entries(text), lambda e: ~(empty(e) | (e.kind.startswith("ARRAY") & (F.regexp_replace(e.text, r"\s", "") == "[]")))), lambda e: F.concat(e.key, F.lit(": "), shown(e.text, e.kind)))
    of_array = F.transform(F.filter(_elements(text), lambda e: ~empty(e)), lambda e: shown(e.text, e.kind))
    alone = F.try_variant_get(F.try_parse_json(text), "$", "string")
    none = F.array().cast("array<string>")
    return F.when(kind.startswith("OBJECT"), of_object).when(kind.startswith("ARRAY"), of_array).when(kind.isNull() | (kind == "VOID") | (alone == ""), none).otherwise(F.array(shown(alone, kind)))

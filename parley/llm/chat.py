"""Chat formatting with DataFrame functions only: schema fingerprints select declarative mappings to canonical turns.

A layout is known by its fingerprint: the hash of the sorted nested field paths of a DataFrame's schema (or, for
records kept as JSON strings, of each record's own paths). Each known fingerprint has a Mapping that says which
expressions give the conversation, the order, the role and the text of its turns. Layouts whose fields are those of a
mapping plus others are matched by the largest mapping that they contain.

The template writes `<|im_start|>role\\ntext<|im_end|>\\n` for each turn. Control strings inside texts and roles (of
this template and of other common ones) are written as `&name;`, and `&` as `&amp;`, so that no text can open or close
a turn and reading gives back every text exactly.

Defined cases: null roles and texts are empty; a null conversation id is a conversation of its own; turns are ordered
by turn (nulls first), then role, then text; repeated rows are turns each; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings of common chat templates, each with the name that stands for it inside a text.
CONTROL = {
    "<|im_start|>": "&im_start;",
    "<|im_end|>": "&im_end;",
    "<|endoftext|>": "&endoftext;",
    "[INST]": "&inst;",
    "[/INST]": "&inst_end;",
    "<<SYS>>": "&sys;",
    "<</SYS>>": "&sys_end;",
    "<s>": "&bos;",
    "</s>": "&eos;",
}


@dataclass(frozen=True)
class Mapping:
    """How one layout gives turns: paths it needs, and SQL expressions for the conversation and its array of turns.

    turns is an SQL expression of an array of (turn, role, text) structs; rows of one conversation are put together.
    """

    name: str
    paths: tuple[str, ...]
    conv_id: str
    turns: str

    @property
    def fingerprint(self) -> str:
        return fingerprint_of(self.paths)


def _said(*parts: tuple[int, str, str]) -> str:
    structs = ", ".join(f"named_struct('turn', {i}L, 'role', '{role}', 'text', cast({text} as string))" for i, role, text in parts)
    return f"array({structs})"


#: The layouts known. Paths of arrays are written with [].
MAPPINGS = (
    Mapping("turn rows", ("conv_id", "role", "text", "turn"), "conv_id", "array(named_struct('turn', cast(turn as bigint), 'role', cast(role as string), 'text', cast(text as string)))"),
    Mapping("messages", ("conv_id", "messages[].content", "messages[].role"), "conv_id", "transform(messages, (m, i) -> named_struct('turn', cast(i as bigint), 'role', cast(m.role as string), 'text', cast(m.content as string)))"),
    Mapping("from and value", ("conversations[].from", "conversations[].value", "id"), "id", "transform(conversations, (m, i) -> named_struct('turn', cast(i as bigint), 'role', case m.from when 'human' then 'user' when 'gpt' then 'assistant' else cast(m.from as string) end, 'text', cast(m.value as string)))"),
    Mapping("instruction with input", ("id", "input", "instruction", "output"), "id", _said((0, "user", "concat_ws('\\n\\n', nullif(instruction, ''), nullif(input, ''))"), (1, "assistant", "output"))),
    Mapping("instruction", ("id", "instruction", "output"), "id", _said((0, "user", "instruction"), (1, "assistant", "output"))),
    Mapping("prompt and completion", ("completion", "id", "prompt"), "id", _said((0, "user", "prompt"), (1, "assistant", "completion"))),
    Mapping("prompt and response with system", ("id", "prompt", "response", "system"), "id", _said((0, "system", "system"), (1, "user", "prompt"), (2, "assistant", "response"))),
)


def fingerprint_of(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Leaf paths of a schema, a step into an array written [] and a step into a map {}."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, at + "[]")
    if isinstance(kind, T.MapType):
        return field_paths(kind.valueType, at + "{}")
    return [at]


def mapping_for(schema: T.StructType, known: tuple[Mapping, ...] = MAPPINGS) -> Mapping:
    """By fingerprint; for a layout with further fields, the mapping with most of the layout's paths."""
    paths = field_paths(schema)
    exact = {m.fingerprint: m for m in known}.get(fingerprint_of(paths))
    fits = [m for m in known if set(m.paths) <= set(paths)]
    if exact or fits:
        return exact or max(fits, key=lambda m: len(m.paths))
    raise ValueError(f"no mapping for the layout with paths {sorted(paths)}")


def canonical_turns(df: DataFrame, known: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Rows (conv_id, turn, role, text) of a table of any known layout."""
    m = mapping_for(df.schema, known)
    turns = df.select(F.expr(m.conv_id).cast("long").alias("conv_id"), F.explode(F.expr(m.turns)).alias("t"))
    return turns.select("conv_id", F.col("t.turn").alias("turn"), F.coalesce("t.role", F.lit("")).alias("role"), F.coalesce("t.text", F.lit("")).alias("text"))


def record_paths(text: Column) -> Column:
    """The field paths of a JSON record down to its second level, as field_paths writes them; null if it is no object."""
    inner = lambda k, step: F.json_object_keys(F.call_function("get_json_object", text, F.concat(F.lit("$['"), k, F.lit("']" + step))))
    below = lambda k, mark, keys: F.transform(keys, lambda x: F.concat(k, F.lit(mark), x))
    each = F.transform(F.json_object_keys(text), lambda k: F.coalesce(below(k, ".", inner(k, "")), below(k, "[].", inner(k, "[0]")), F.array(k)))
    return F.array_sort(F.array_distinct(F.flatten(each)))


def _shallow(paths) -> list[str]:
    return sorted({".".join(p.split(".")[:2]).removesuffix("[]") for p in paths})


def _layout_of(paths: Column, layouts: dict[str, T.StructType], known: tuple[Mapping, ...]) -> Column:
    """The name of a record's layout: by the fingerprint of its paths, or else that of the largest mapping they contain."""
    fingerprint = F.left(F.sha2(F.array_join(paths, "\n"), 256), F.lit(16))
    exact = [F.when(fingerprint == fingerprint_of(_shallow(field_paths(s))), name) for name, s in layouts.items()]
    sized = sorted(layouts.items(), key=lambda x: -len(mapping_for(x[1], known).paths))
    contained = [F.when(F.size(F.array_except(F.array(*map(F.lit, _shallow(mapping_for(s, known).paths))), paths)) == 0, name) for name, s in sized]
    return F.coalesce(*exact, *contained)


def canonical_json(df: DataFrame, column: str, layouts: dict[str, T.StructType], known: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Turns of records kept as JSON strings of mixed layouts: each record's own nested paths choose its mapping.

    layouts: a schema for each layout awaited. Records with further fields go to the layout whose mapping has most of
    their paths; records of no layout are given by `unmatched_json`.
    """
    told = df.select(F.col(f"`{column}`").alias("record"), _layout_of(record_paths(F.col(f"`{column}`")), layouts, known).alias("layout"))
    parts = [canonical_turns(told.where(F.col("layout") == name).select(F.from_json("record", s).alias("r")).select("r.*"), known) for name, s in layouts.items()]
    return reduce(DataFrame.unionByName, parts)


def unmatched_json(df: DataFrame, column: str, layouts: dict[str, T.StructType], known: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    return df.where(_layout_of(record_paths(F.col(f"`{column}`")), layouts, known).isNull())


def escape(text: Column) -> Column:
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), CONTROL.items(), F.replace(text, F.lit("&"), F.lit("&amp;")))


def unescape(text: Column) -> Column:
    return F.replace(reduce(lambda c, kv: F.replace(c, F.lit(kv[1]), F.lit(kv[0])), CONTROL.items(), text), F.lit("&amp;"), F.lit("&"))


def format_chats(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans: (start, length) in code points of each text of trained_role, in order.

    Each turn is written on its own; running lengths give its place; one shuffle by conversation serves both.
    """
    body, role = escape(F.col("text")), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("&nl;"))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    each = turns.select("conv_id", "turn", "role", "text", head.alias("head"), body.alias("body"))
    each = each.withColumn("written", F.concat("head", "body", F.lit(END + "\n")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = each.withColumn("end", F.sum(F.length("written").cast("long")).over(order)).withColumn("place", F.count("*").over(order))
    start = F.col("end") - F.length("written") + F.length("head")
    span = F.when(F.col("role") == trained_role, F.struct(start.alias("start"), F.length("body").cast("long").alias("length")))
    kept = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "written", span.alias("span")))).alias("t"))
    return kept.select("conv_id", F.array_join(F.transform("t", lambda x: x.written), "").alias("formatted"), F.filter(F.transform("t", lambda x: x.span), lambda s: s.isNotNull()).alias("loss_spans"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text) read back from the formatted text, and loss_text, unescaped, from the loss mask."""
    parts = F.split("formatted", F.lit(r"\Q" + END + "\n" + r"\E"))
    inner = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.substring(p, len(START) + 1, F.length(p)))
    cut = F.transform(inner, lambda p: F.struct(F.replace(unescape(F.substring_index(p, "\n", 1)), F.lit("&nl;"), F.lit("\n")).alias("role"), unescape(F.substring(p, F.instr(p, "\n") + 1, F.length(p))).alias("text")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring("formatted", (s.start + 1).cast("int"), s.length.cast("int")))), "")
    return formatted.select("*", cut.alias("turns"), loss.alias("loss_text"))

r"""Chat formatting with DataFrame functions only.

A schema fingerprint is the SHA-256 of the nested field paths of a table that any known layout uses, sorted.
It selects a declarative mapping, which turns prompt, instruction or message columns into canonical turns:
an id, and an array of (role, text). Columns that no layout uses don't change the fingerprint; a table that has fields
of more than one layout gets the first one, in the order of LAYOUTS, that is there in full.

Template. A turn is `<|start|>role<|sep|>text<|end|>`. Inside roles and texts a backslash is doubled, and one is
put after the first character of every control string (of this template and of other common ones), so that none
of them appears; `unescaped` takes one backslash off again, which gives the same text back.

Loss mask: the texts of assistant turns.

Defined results: null roles and texts are empty; turns come in the order of (turn, role, text), so ties and
repeated rows keep their rows in a fixed order; a null id is an id of its own; a conversation without turns in
an array layout has no turns; an empty table gives an empty result. One conversation is one output row, and its texts of
any length are formatted whole in one task's memory. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

START, SEP, END = "<|start|>", "<|sep|>", "<|end|>"
#: Control strings of chat templates; none has a backslash, and each is escaped after its first character.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


@dataclass(frozen=True)
class Layout:
    """paths: fields it needs. rows: (order, role, text), one turn a row. array: (array, role, text). fields: (role, columns joined by a blank line)."""

    name: str
    paths: tuple[str, ...]
    rows: tuple[str, str, str] | None = None
    array: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()


LAYOUTS = (
    Layout("turn rows", ("turn", "role", "text"), rows=("turn", "role", "text")),
    Layout("messages", ("messages[].role", "messages[].content"), array=("messages", "role", "content")),
    Layout("from and value", ("conversations[].from", "conversations[].value"), array=("conversations", "from", "value")),
    Layout("instruction", ("instruction", "input", "output"), fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("instruction without input", ("instruction", "output"), fields=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("system, prompt and response", ("system", "prompt", "response"), fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("prompt and response", ("prompt", "response"), fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("prompt and completion", ("prompt", "completion"), fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
)
#: Role names of the layouts, by their canonical names.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
KNOWN = frozenset(p for x in LAYOUTS for p in x.paths)


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


def paths_fingerprint(paths: list[str] | tuple[str, ...]) -> str:
    return hashlib.sha256("\n".join(sorted(KNOWN.intersection(paths))).encode()).hexdigest()


BY_FINGERPRINT = {paths_fingerprint(x.paths): x for x in LAYOUTS}


def layout_of(schema: T.StructType) -> Layout:
    """The layout of a table's fingerprint; of one with fields of several layouts, the first layout that is there in full."""
    paths = field_paths(schema)
    found = BY_FINGERPRINT.get(paths_fingerprint(paths)) or next((x for x in LAYOUTS if set(x.paths) <= set(paths)), None)
    if not found:
        raise ValueError(f"no mapping for the fields {paths}")
    return found


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _role(c: Column) -> Column:
    low, out = _text(c), _text(c)
    for name, canonical in ROLES.items():
        out = F.when(low == name, canonical).otherwise(out)
    return out


def canonical_turns(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, turns array of (role, text)) from any known layout."""
    layout = layout_of(df.schema)
    if layout.rows:
        order, role, text = layout.rows
        turn = F.struct(F.col(order).alias("turn"), _text(F.col(role)).alias("role"), _text(F.col(text)).alias("text"))
        turns = df.groupBy(F.col(id_col).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
        return turns.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    if layout.array:
        array, role, text = layout.array
        turns = F.transform(F.coalesce(F.col(array), F.array().cast(df.schema[array].dataType)), lambda t: F.struct(_role(t[role]).alias("role"), _text(t[text]).alias("text")))
    else:
        full = [(role, F.array_join(F.filter(F.array(*(_text(F.col(c)) for c in cols)), lambda x: x != ""), "\n\n")) for role, cols in layout.fields]
        turns = F.array(*(F.struct(F.lit(role).alias("role"), text.alias("text")) for role, text in full))
        turns = F.filter(turns, lambda t: (t["role"] != "system") | (t["text"] != ""))
    return df.select(F.col(id_col).alias("conv_id"), turns.alias("turns"))


def escaped(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for x in CONTROLS:
        c = F.replace(c, F.lit(x), F.lit(f"{x[0]}\\{x[1:]}"))
    return c


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def formatted(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), escaped(t["role"]), F.lit(SEP), escaped(t["text"]), F.lit(END))), "")


def read_back(text: Column) -> Column:
    """The turns of a formatted conversation."""
    pieces = F.split(text, "<\\|end\\|>", -1)
    whole = F.filter(pieces, lambda p: p != "")

    def turn(p: Column) -> Column:
        at = F.split(p, "<\\|sep\\|>", 2)
        return F.struct(unescaped(F.substring(at[0], len(START) + 1, 1 << 30)).alias("role"), unescaped(at[1]).alias("text"))

    return F.transform(whole, turn)


def format_conversations(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, turns, formatted): canonical turns and their text under the template."""
    return canonical_turns(df, id_col).select("conv_id", "turns", formatted(F.col("turns")).alias("formatted"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    out = format_conversations(rows.unionByName(extra)).select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"))
    all_text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(all_text, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


_ESCAPED = r"replace({0}, '\', '\\')"
for _x in CONTROLS:
    _ESCAPED = f"replace({_ESCAPED}, '{_x}', '{_x[0]}\\{_x[1:]}')"

OP2_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(START + SEP + END)} + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")})) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""

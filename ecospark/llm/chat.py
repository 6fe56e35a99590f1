"""Chat formatting: heterogeneous conversation layouts to one marked-up text with a loss mask.

A row's layout is recognised by a fingerprint: the sorted nested paths of its known, filled
fields, hashed. The fingerprint selects a declarative mapping, and every mapping yields the
same canonical turns (conversation, position, role, text). Only DataFrame functions are used.

Defined cases. Null roles and texts are empty. A conversation without turns gives one row with
an empty text. Turns with equal numbers are ordered by role and text; repeated rows are
repeated turns. A row of no known layout has no turns. Rows with a null id form one
conversation. Columns that no mapping names are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """A layout: the paths that must be filled, those that may be, and its turns.

    ``turns`` lists (role, path) pairs of single-turn layouts; ``items`` names an array
    and its role and text fields; ``row`` names the number, role and text columns of a
    layout whose rows are turns, and needs all three columns.
    """

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    turns: tuple[tuple[str, str], ...] = ()
    items: tuple[str, str, str] | None = None
    row: tuple[str, str, str] | None = None

    @property
    def fingerprints(self) -> list[str]:
        return [
            fingerprint([*self.required, *extra])
            for n in range(len(self.optional) + 1)
            for extra in itertools.combinations(self.optional, n)
        ]


#: In order of preference, should a row fill the fields of several layouts.
MAPPINGS = (
    Mapping("messages", ("messages[].content", "messages[].role"), ("system",), (("system", "system"),),
            ("messages", "role", "content")),
    Mapping("exchanges", ("conversations[].from", "conversations[].value"), ("system",), (("system", "system"),),
            ("conversations", "from", "value")),
    Mapping("instruction", ("instruction", "output"), ("input", "system"),
            (("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("prompt_response", ("prompt", "response"), ("system",),
            (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt_completion", ("prompt", "completion"), ("system",),
            (("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Mapping("question", ("answer", "question"), ("system",),
            (("system", "system"), ("user", "question"), ("assistant", "answer"))),
    Mapping("turn_row", (), ("role", "text", "turn"), row=("turn", "role", "text")),
)

#: Other spellings of the three roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def schema_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """Nested paths of the leaves of a type; an array adds ``[]``."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{prefix}[]")
    return [prefix]


def usable(there: set[str], mappings: tuple[Mapping, ...]) -> list[Mapping]:
    """The mappings whose columns a table has."""
    return [m for m in mappings if {*m.required, *(m.row or ())} <= there]


def layout_of(df: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> Column:
    """Name of each row's layout, null if none fits.

    An exact fingerprint is looked up first; a row with fields of several layouts takes the
    first mapping whose required fields it fills. A row that fills nothing is an empty turn only in
    a table of turn rows.
    """
    there = set(schema_paths(df.schema))
    fit = usable(there, mappings)
    known = sorted(there & {p for m in mappings for p in (*m.required, *m.optional)})
    if not fit:
        return F.lit(None).cast("string")

    def is_filled(path: str) -> Column:
        return F.col(f"`{path.split('[')[0]}`").isNotNull()

    print_ = F.sha2(F.concat_ws("\n", *[F.when(is_filled(p), F.lit(p)) for p in known]), 256)
    by_print = {f: m.name for m in fit for f in m.fingerprints if f != fingerprint([]) or len(fit) == 1}
    table = F.create_map(*[F.lit(x) for kv in by_print.items() for x in kv])

    def takes(m: Mapping) -> Column:
        if m.required:
            return F.forall(F.array(*[is_filled(p) for p in m.required]), lambda x: x)
        return F.exists(F.array(*[is_filled(p) for p in m.optional if p in there]), lambda x: x)

    first = F.coalesce(*[F.when(takes(m), F.lit(m.name)) for m in fit])
    return F.coalesce(F.element_at(table, print_), first)


def canonical_turns(df: DataFrame, key: str = "conv_id", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Rows (key, position, role, text); a conversation without turns has one row of nulls."""
    there = set(schema_paths(df.schema))
    fit = usable(there, mappings)

    def one(role: str, path: str) -> Column:
        if path not in there:
            return F.array().cast(TURN)
        text = F.col(f"`{path}`").cast("string")
        return F.when(F.coalesce(text, F.lit("")) != "", F.array(F.struct(F.lit(role).alias("role"), text.alias("text")))
                      ).otherwise(F.array().cast(TURN))

    def of(m: Mapping) -> Column:
        parts = [one(role, path) for role, path in m.turns]
        if m.items:
            name, role, text = m.items
            parts.append(F.transform(F.col(f"`{name}`"), lambda x: F.struct(
                F.coalesce(x[role].cast("string"), F.lit("")).alias("role"),
                F.coalesce(x[text].cast("string"), F.lit("")).alias("text"))))
        if m.row:
            parts.append(F.array(F.struct(*[
                F.coalesce(F.col(f"`{path}`").cast("string"), F.lit("")).alias(name)
                for name, path in zip(("role", "text"), m.row[1:], strict=True)])))
        return F.concat(*parts)

    def if_row(then: Callable[[Mapping], Column], other: Column) -> Column:
        """Turn rows carry their own number, and their roles stand as they are."""
        for m in fit:
            if m.row:
                other = F.when(F.col("_layout").eqNullSafe(F.lit(m.name)), then(m)).otherwise(other)
        return other

    turns = F.coalesce(*[F.when(F.col("_layout") == m.name, of(m)) for m in fit], F.array().cast(TURN))
    names = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    number = if_row(lambda m: F.col(f"`{m.row[0]}`").cast("long"), F.lit(None).cast("long"))
    placed = df.withColumn("_layout", layout_of(df, mappings)).select(
        F.col(f"`{key}`").alias("_key"), "_layout", number.alias("_number"), F.posexplode_outer(turns).alias("_pos", "_turn"))
    role = F.col("_turn.role")
    return placed.select("_key", if_row(lambda m: F.col("_number"), F.col("_pos").cast("long")).alias("_pos"),
                         if_row(lambda m: role, F.coalesce(F.element_at(names, F.lower(role)), role)).alias("_role"),
                         F.col("_turn.text").alias("_text"))


OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    """No control string survives: a backslash parts ``<`` from a following bar or backslash."""
    return F.regexp_replace(text, r"<(?=[|\\])", r"<\\")


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit("<\\"), F.lit("<"))


def escape_role(role: Column) -> Column:
    """As escape(), and a role stays on one line: ``<n`` stands for a line break."""
    return F.replace(F.regexp_replace(role, r"<(?=[|\\n])", r"<\\"), F.lit("\n"), F.lit("<n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<n"), F.lit("\n")))


def format_chats(df: DataFrame, key: str = "conv_id", loss_role: str = "assistant",
                 mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(key, formatted, loss_spans): one row per conversation.

    ``loss_spans`` are (start, end) in code points of ``formatted``, end exclusive, one per
    turn of ``loss_role``. The running offsets and the grouping share one exchange by key; a
    conversation is one output text, so its turns meet in one task by definition.
    """
    turns = canonical_turns(df, key, mappings)
    head = F.concat(F.lit(OPEN), escape_role(F.col("_role")), F.lit("\n"))
    body = escape(F.col("_text"))
    cut = turns.select("_key", "_pos", "_role", "_text", head.alias("_head"), body.alias("_body"))
    size = F.char_length("_head") + F.char_length("_body") + len(CLOSE)
    order = "partition by _key order by _pos, _role, _text rows between unbounded preceding and current row"
    cut = cut.withColumn("_size", size).select(
        "*", F.expr(f"sum(_size) over ({order})").alias("_end"), F.expr(f"count(1) over ({order})").alias("_nr"))
    end = (F.col("_end") - len(CLOSE)).cast("long")
    cut = cut.select(
        "_key", F.struct(
            "_nr", F.concat("_head", "_body", F.lit(CLOSE)).alias("piece"),
            F.when(F.col("_role") == loss_role, F.struct(
                (end - F.char_length("_body")).alias("start"), end.alias("end"))).alias("span"),
        ).alias("_turn"))
    grouped = cut.groupBy("_key").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))
    return grouped.select(
        F.col("_key").alias(key),
        F.array_join(F.transform("_turns", lambda t: t["piece"]), "").alias("formatted"),
        F.filter(F.transform("_turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""
    segments = F.split(formatted, r"<\|im_start\|>")
    return F.transform(
        F.slice(segments, F.lit(2), F.size(segments)),
        lambda s: F.struct(
            unescape_role(F.substring_index(s, "\n", 1)).alias("role"),
            unescape(F.regexp_replace(F.substr(s, F.instr(s, "\n") + 1), r"<\|im_end\|>\n\z", "")).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """Unescaped text under the loss mask, span after span."""
    return F.array_join(F.transform(
        spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")

"""Chat formatting by schema fingerprints, in DataFrame functions only.

Chat data comes as prompt and response, as instruction, input and output, as a list of
messages under one name or another, or as one row per turn. A layout says declaratively
where its turns lie. For each record the nested paths of the fields that it fills
(``messages[].content``) are hashed; that fingerprint is looked up among those of all
layouts and selects the mapping. A table may mix layouts, which is what reading JSON
lines of several origins into one schema gives. Fields that no layout names do not
count. A record whose fingerprint no layout has stays, as a row without a turn and
without a layout, so that ``unmapped`` can name it.

Turns are rendered with a template that marks where each begins and ends. Its control
strings and the escape character are escaped inside roles and texts, so that no text can
forge a mark and ``parse`` gives back exactly what went in. The loss mask is a list of
code-point spans of the rendered string: the texts of the trained role.

Turns are joined to conversations by one shuffle on the conversation's id. A rendered
conversation is one value, so one conversation must fit a row.

Defined for awkward rows: a null text or role is the empty string; a record without an
id is a conversation of its own, so a table with many null ids has no hot key; turns of
one conversation with the same or no position are ordered by role and text (no position:
last); equal rows are equal turns; an empty table has no conversation; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN = "array<struct<position:bigint,role:string,text:string>>"


@dataclass(frozen=True)
class Fixed:
    """A turn of a known role; its text is the fields, as far as they are filled, with a blank line between."""

    role: str
    texts: tuple[str, ...]


@dataclass(frozen=True)
class Each:
    """A turn for each element of an array of structs."""

    container: str
    role: str
    text: str

    def paths(self) -> tuple[str, ...]:
        return (f"{self.container}[]", f"{self.container}[].{self.role}", f"{self.container}[].{self.text}")


@dataclass(frozen=True)
class Row:
    """The record is one turn of a conversation."""

    role: str
    text: str
    position: str


@dataclass(frozen=True)
class Layout:
    """``needs``: paths of which a record fills one at least; all others may be null."""

    name: str
    needs: tuple[str, ...]
    turns: tuple[Fixed | Each | Row, ...]
    roles: tuple[tuple[str, str], ...] = ()  # other names of roles

    def paths(self) -> tuple[str, ...]:
        found: list[str] = []
        for turn in self.turns:
            found += turn.texts if isinstance(turn, Fixed) else turn.paths() if isinstance(turn, Each) else (turn.role, turn.text, turn.position)
        return tuple(dict.fromkeys(found))

    def fingerprints(self) -> set[str]:
        """One for each set of filled fields that this layout accepts."""
        paths = self.paths()
        subsets = [s for k in range(1, len(paths) + 1) for s in combinations(paths, k)]
        nested = [p for p in paths if "[]." in p]
        # An element's field cannot be filled where its array is null.
        whole = [s for s in subsets if all(p.partition("[]")[0] + "[]" in s for p in nested if p in s)]
        return {fingerprint_of(s) for s in whole if set(s) & set(self.needs)}


ALIASES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
LAYOUTS = (
    Layout("turn_row", ("role", "turn"), (Row("role", "text", "turn"),)),
    Layout("prompt_response", ("prompt", "response"), (Fixed("system", ("system",)), Fixed("user", ("prompt",)), Fixed("assistant", ("response",)))),
    Layout("prompt_completion", ("completion",), (Fixed("user", ("prompt",)), Fixed("assistant", ("completion",)))),
    Layout("instruction", ("instruction",), (Fixed("system", ("system",)), Fixed("user", ("instruction", "input")), Fixed("assistant", ("output",)))),
    Layout("question_answer", ("question",), (Fixed("user", ("context", "question")), Fixed("assistant", ("answer",)))),
    Layout("messages", ("messages[]",), (Fixed("system", ("system",)), Each("messages", "role", "content")), ALIASES),
    Layout("from_value", ("conversations[]",), (Fixed("system", ("system",)), Each("conversations", "from", "value")), ALIASES),
    Layout("nested_messages", ("conversation.messages[]",), (Each("conversation.messages", "role", "content"),), ALIASES),
)


def fingerprint_of(paths: Sequence[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def _kind(schema: T.StructType, path: str) -> T.DataType | None:
    """The type at a dotted path of structs, None where there is no such field."""
    at: T.DataType = schema
    for name in path.split("."):
        if not isinstance(at, T.StructType) or name not in at.names:
            return None
        at = at[name].dataType
    return at


def _column(path: str) -> Column:
    return F.col(".".join(f"`{name}`" for name in path.split(".")))


def _filled(schema: T.StructType, path: str) -> Column | None:
    """Whether a record fills ``path``; None where the table has no such field."""
    container, inside, inner = path.partition("[]")
    kind = _kind(schema, container)
    if not inside:
        return None if kind is None or isinstance(kind, (T.ArrayType, T.StructType, T.MapType)) else _column(path).isNotNull()
    if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, T.StructType):
        return None
    if not inner:
        return _column(container).isNotNull()
    name = inner.lstrip(".")
    return F.coalesce(F.exists(_column(container), lambda e: e[name].isNotNull()), F.lit(False)) if name in kind.elementType.names else None


def fingerprint(schema: T.StructType, layouts: Sequence[Layout] = LAYOUTS) -> Column:
    """The hash of the sorted paths that a record fills, among those that any layout names."""
    known = sorted({p for layout in layouts for p in layout.paths()})
    found = [(p, _filled(schema, p)) for p in known]
    present = F.array(*[F.when(filled, p) for p, filled in found if filled is not None]).cast("array<string>")
    return F.substring(F.sha2(F.array_join(present, "\n"), 256), 1, 16)


def _text(schema: T.StructType, path: str) -> Column:
    return _column(path).cast("string") if _kind(schema, path) is not None else F.lit(None).cast("string")


def _renamed(role: Column, layout: Layout) -> Column:
    cases = F.when(role.isNull(), "")
    for other, name in layout.roles:
        cases = cases.when(role == other, name)
    return cases.otherwise(role)


def _elements(turn: Each, names: Sequence[str]) -> Column:
    """The turns of an array of structs with the fields ``names``."""

    def field(element: Column, name: str) -> Column:
        return element[name].cast("string") if name in names else F.lit(None).cast("string")

    return F.transform(_column(turn.container), lambda e: F.struct(F.lit(None).cast("long").alias("position"), field(e, turn.role).alias("role"), field(e, turn.text).alias("text")))


def _turns(schema: T.StructType, layout: Layout) -> Column:
    """The turns of a record of ``layout``; positions are set by the record's order, but for ``Row``."""
    parts = []
    for turn in layout.turns:
        if isinstance(turn, Row):
            position = _column(turn.position).cast("long") if _kind(schema, turn.position) is not None else F.lit(None).cast("long")
            parts.append(F.array(F.struct(position.alias("position"), _text(schema, turn.role).alias("role"), _text(schema, turn.text).alias("text"))))
        elif isinstance(turn, Fixed):
            texts = [_text(schema, p) for p in turn.texts]
            one = F.struct(F.lit(None).cast("long").alias("position"), F.lit(turn.role).alias("role"), F.array_join(F.filter(F.array(*texts), lambda t: t != ""), "\n\n").alias("text"))
            # A turn that no field fills is none; an empty string is an empty turn.
            parts.append(F.when(reduce(Column.__or__, [t.isNotNull() for t in texts]), F.array(one)).otherwise(F.array().cast(TURN)))
        elif isinstance(kind := _kind(schema, turn.container), T.ArrayType) and isinstance(kind.elementType, T.StructType):
            parts.append(F.coalesce(_elements(turn, kind.elementType.names), F.array().cast(TURN)))
    turns = F.concat(*[p.cast(TURN) for p in parts])
    if layout.roles:
        turns = F.transform(turns, lambda t: F.struct(t["position"].alias("position"), _renamed(t["role"], layout).alias("role"), t["text"].alias("text")))
    if not any(isinstance(t, Row) for t in layout.turns):
        turns = F.transform(turns, lambda t, i: F.struct(i.cast("long").alias("position"), t["role"].alias("role"), t["text"].alias("text")))
    return turns


def to_turns(records: DataFrame, id_col: str = "conv_id", layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """(id, record, position, role, text, layout, fingerprint), a row per turn.

    ``record`` tells records without an id apart and is null for all others. A record
    of no layout, or without a turn, is one row with a null role.
    """
    schema = records.schema
    table: dict[str, str] = {}
    for layout in layouts:
        for mark in layout.fingerprints():
            if table.setdefault(mark, layout.name) != layout.name:
                raise ValueError(f"layouts {table[mark]} and {layout.name} accept the same fields")
    names = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    marked = records.select("*", fingerprint(schema, layouts).alias("_fingerprint")).withColumn("_layout", F.try_element_at(names, F.col("_fingerprint")))
    # Drawn once per record, before its turns are rows.
    marked = marked.withColumn("_record", F.when(F.col(id_col).isNull(), F.monotonically_increasing_id()))
    usable = [(x, [p for p in x.paths() if _filled(schema, p) is not None]) for x in layouts]
    cases = [(x.name, _turns(schema, x)) for x, paths in usable if paths]
    turns = reduce(lambda c, case: c.when(F.col("_layout") == case[0], case[1]), cases[1:], F.when(F.col("_layout") == cases[0][0], cases[0][1])) if cases else F.lit(None).cast(TURN)
    flat = marked.select(
        F.col(id_col).alias("_id"),
        "_record",
        "_layout",
        "_fingerprint",
        F.explode_outer(turns).alias("_turn"),
    )
    some = F.col("_turn").isNotNull()
    return flat.select(
        F.col("_id").alias(id_col),
        F.col("_record").alias("record"),
        F.col("_turn.position").alias("position"),
        F.when(some, F.coalesce("_turn.role", F.lit(""))).alias("role"),
        F.when(some, F.coalesce("_turn.text", F.lit(""))).alias("text"),
        F.col("_layout").alias("layout"),
        F.col("_fingerprint").alias("fingerprint"),
    )


def unmapped(turns: DataFrame) -> DataFrame:
    """How many records no layout accepts, by fingerprint."""
    return turns.where("layout IS NULL").groupBy("fingerprint").agg(F.count("*").alias("records"))


# --- template: control strings, and what stands for them inside roles and texts ---
BEGIN, HEAD_END, END = "### ", ":\n", "</turn>\n"
ESCAPES = (("\\", "\\\\"), ("### ", "\\h## "), ("</turn>", "\\l/turn>"))
CODES = (("\\h", "#"), ("\\l", "<"), ("\\e", "\n"))
# ---------------------------------------------------------------------------------


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    """A doubled backslash always starts where a code ends, so cutting there leaves the other codes whole."""
    decode = lambda p: reduce(lambda c, code: F.replace(c, F.lit(code[0]), F.lit(code[1])), CODES, p)
    return F.array_join(F.transform(F.split(text, r"\\\\"), decode), "\\")


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\e"))


def render(turns: DataFrame, id_col: str = "conv_id", trained_role: str = "assistant") -> DataFrame:
    """(id, formatted, loss_spans) per conversation; spans are code points [start, stop) of ``formatted``."""
    head = F.concat(F.lit(BEGIN), _escape_role(F.col("role")), F.lit(HEAD_END))
    pieces = turns.select(F.col(id_col).alias("_id"), "record", "position", "role", "text", F.coalesce(F.length(head), F.lit(0)).alias("_head"), F.coalesce(F.concat(head, escape(F.col("text")), F.lit(END)), F.lit("")).alias("_piece"))
    inside = Window.partitionBy("_id", "record").orderBy(F.col("position").asc_nulls_last(), "role", "text")
    before = F.coalesce(F.sum(F.length("_piece")).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = pieces.select("_id", "record", "role", "_head", "_piece", F.row_number().over(inside).alias("_k"), before.alias("_at"))
    span = F.when(F.col("role") == trained_role, F.struct((F.col("_at") + F.col("_head")).alias("start"), (F.col("_at") + F.length("_piece") - len(END)).alias("stop")))
    rows = placed.groupBy("_id", "record").agg(F.sort_array(F.collect_list(F.struct("_k", "_piece", span.alias("span")))).alias("_rows"))
    return rows.select(F.col("_id").alias(id_col), F.array_join("_rows._piece", "").alias("formatted"), F.filter("_rows.span", lambda s: s.isNotNull()).alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns of a rendered conversation, unescaped."""
    pieces = F.filter(F.split(formatted, END), lambda p: p != "")
    cut = lambda p: F.instr(p, F.lit("\n"))
    role = lambda p: F.substring(p, F.lit(len(BEGIN) + 1), cut(p) - len(BEGIN) - len(HEAD_END))
    return F.transform(pieces, lambda p: F.struct(unescape(role(p)).alias("role"), unescape(F.substring(p, cut(p) + 1, F.length(p))).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between the spans."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, (s["stop"] - s["start"]).cast("int")))), "")


def format_chats(records: DataFrame, id_col: str = "conv_id", trained_role: str = "assistant", layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """Records of any known layout as (id, formatted, loss_spans) per conversation."""
    return render(to_turns(records, id_col, layouts), id_col, trained_role)

"""Chat formatting by schema fingerprints.

The nested field paths of a record are hashed; the hash selects a declared mapping that turns the record, whatever
its layout, into canonical turns.  A template with reversible escapes then makes one string of a conversation.
All of it is DataFrame functions over VARIANT records.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of the template by role: opening, closing.  Other roles are named inside ROLE marks.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
ROLE, TEXT, END = "[ROLE]", "[TEXT]", "[/ROLE]"
LOSS = "assistant"
#: First character of any control string inside a text; a backslash is put behind it.
_CONTROL = r"<(?=/?s>|</?SYS>>)|\[(?=/?INST\]|/?ROLE\]|TEXT\])"
_TURN = r"(?s)(<s>|<<SYS>>|\[INST\]|\[ROLE\]) (.*?) (?:</s>|<</SYS>>|\[/INST\]|\[/ROLE\])"
_LEAF = r": (?:(?!OBJECT<|ARRAY<)[A-Z][A-Z_ ]*(?:\([^)]*\))?)(?=[,>])"


def fingerprint(record: Column) -> Column:
    """Hash of the sorted nested field paths of a VARIANT; leaf types do not count, null records have none."""
    return F.xxhash64(F.when(record.isNotNull(), F.regexp_replace(F.schema_of_variant(record), _LEAF, "")))


def shape(paths: tuple[str, ...]) -> str:
    """The text that ``fingerprint`` hashes, from paths such as ``messages[].role``."""
    tree: dict = {}
    for path in paths:
        at = tree
        for part in path.split("."):
            at = at.setdefault(part, {})

    def text(at: dict) -> str:
        fields = []
        for name in sorted(at, key=lambda n: n.removesuffix("[]")):
            inner = text(at[name]) if at[name] else ""
            fields.append(f"{name[:-2]}: ARRAY<{inner}>" if name.endswith("[]") else f"{name}: {inner}" if inner else name)
        return f"OBJECT<{', '.join(fields)}>"

    return text(tree)


def _string(record: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(record, f"$.{path}", "string"), F.lit(""))


def _turn(order: Column, at: Column, role: Column, text: Column) -> Column:
    return F.struct(order.cast("long").alias("turn"), at.cast("int").alias("at"), role.alias("role"), text.alias("text"))


@dataclass(frozen=True)
class Layout:
    """A record layout: its field paths and how turns are read from it."""

    name: str
    paths: tuple[str, ...]
    turns: Callable[[Column], Column]


def row_layout(role: str, text: str, turn: str) -> Layout:
    """One record per turn; ``turn`` orders them."""
    return Layout("row", (role, text, turn), lambda r: F.array(_turn(F.try_variant_get(r, f"$.{turn}", "long"), F.lit(0), _string(r, role), _string(r, text))))


def list_layout(items: str, role: str, text: str, names: dict[str, str] | None = None) -> Layout:
    """A list of messages; ``names`` maps role names to canonical ones."""
    def turns(r: Column) -> Column:
        cells = F.try_variant_get(r, f"$.{items}", f"array<struct<`{role}`: string, `{text}`: string>>")

        def one(c: Column, i: Column) -> Column:
            who = F.coalesce(c[role], F.lit(""))
            for k, v in (names or {}).items():
                who = F.when(c[role] == k, v).otherwise(who)
            return _turn(F.lit(None), i, who, F.coalesce(c[text], F.lit("")))

        return F.transform(cells, one)

    return Layout(f"{items}/{role}", (f"{items}[].{role}", f"{items}[].{text}"), turns)


def flat_layout(*parts: tuple[str, tuple[str, ...]]) -> Layout:
    """Fixed fields: each part is a role and the fields whose non-empty texts make its turn, joined by a blank line."""
    def turns(r: Column) -> Column:
        def text(fields: tuple[str, ...]) -> Column:
            return F.array_join(F.filter(F.array(*[_string(r, f) for f in fields]), lambda x: x != ""), "\n\n")

        return F.array(*[_turn(F.lit(None), F.lit(i), F.lit(role), text(fields)) for i, (role, fields) in enumerate(parts)])

    names = tuple(f for _, fields in parts for f in fields)
    return Layout("/".join(names), names, turns)


LAYOUTS = (
    row_layout("role", "text", "turn"),
    list_layout("messages", "role", "content"),
    list_layout("conversations", "from", "value", {"human": "user", "gpt": "assistant"}),
    flat_layout(("user", ("prompt",)), ("assistant", ("response",))),
    flat_layout(("user", ("prompt",)), ("assistant", ("completion",))),
    flat_layout(("user", ("instruction",)), ("assistant", ("output",))),
    flat_layout(("user", ("instruction", "input")), ("assistant", ("output",))),
    flat_layout(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))),
)


def canonical_turns(records: DataFrame, id_col: str, record_col: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Records of any layout -> one row per id: id, turns (array of role and text, in order), n_unmapped.

    Turns of one id are ordered by turn number (null first), place in the record, role and text; so ties have one
    order, and repeated rows are repeated turns.  Records of an undeclared layout, and null records, give no turns
    and are counted in ``n_unmapped``.  Ids may be null.  One conversation is one value and so one task's work.
    """
    r = F.col("_r")
    fp = records.select(F.col(id_col).alias(id_col), F.col(record_col).alias("_r"), fingerprint(F.col(record_col)).alias("_f"))
    turns = F.lit(None)
    for layout in layouts:
        turns = F.when(F.col("_f") == F.xxhash64(F.lit(shape(layout.paths))), layout.turns(r)).otherwise(turns)
    mapped = fp.select(id_col, turns.alias("_turns"))
    folded = mapped.groupBy(id_col).agg(F.array_sort(F.flatten(F.collect_list("_turns"))).alias("_turns"), F.count(F.when(F.col("_turns").isNull(), 1)).alias("n_unmapped"))
    return folded.select(id_col, F.transform("_turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"), "n_unmapped")


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(turns: Column) -> Column:
    """Turns -> segments (piece, loss): the pieces joined are the formatted string, ``loss`` masks what is trained on."""
    def piece(text: Column, loss: bool = False) -> Column:
        return F.struct(text.alias("piece"), F.lit(loss).alias("loss"))

    def turn(t: Column) -> Column:
        body = escape(t["text"])
        other = F.array(piece(F.concat(F.lit(f"{ROLE} "), escape(t["role"]), F.lit(f" {TEXT} "), body, F.lit(f" {END}"))))
        for role, (start, end) in MARKS.items():
            other = F.when(t["role"] == role, F.array(piece(F.lit(f"{start} ")), piece(body, role == LOSS), piece(F.lit(f" {end}")))).otherwise(other)
        return other

    return F.flatten(F.transform(turns, turn))


def read_turns(formatted: Column) -> Column:
    """The formatted string back to turns."""
    marks, bodies = (F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(g)) for g in (1, 2))

    def turn(mark: Column, body: Column) -> Column:
        role, text = unescape(F.substring_index(body, f" {TEXT} ", 1)), F.substring_index(body, f" {TEXT} ", -1)
        named = mark == ROLE
        for who, (start, _) in MARKS.items():
            role = F.when(mark == start, who).otherwise(role)
        return F.struct(role.alias("role"), unescape(F.when(named, text).otherwise(body)).alias("text"))

    return F.zip_with(marks, bodies, turn)


def format_chats(records: DataFrame, id_col: str, record_col: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Records -> one row per id: id, formatted, segments (piece, loss), n_unmapped.  Null or empty texts are empty turns."""
    done = canonical_turns(records, id_col, record_col, layouts).select(id_col, format_turns(F.col("turns")).alias("segments"), "n_unmapped")
    return done.select(id_col, F.array_join(F.transform("segments", lambda s: s["piece"]), "").alias("formatted"), "segments", "n_unmapped")

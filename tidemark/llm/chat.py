"""Chat formatting: layouts are told apart by a fingerprint of their field paths, and mapped declaratively to turns.

A record's schema fingerprint is the hash of its sorted nested field paths
(array elements as []).  It selects a mapping, which says where the turns are;
the turns are written with a template whose control strings can't occur inside
texts, and everything reported is read back from that output.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: The template's control strings.  All begin with <|.
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"


def escape(text: str) -> str:
    """Puts a backslash into every <|, and one more into those that have some: no <| is left, and unescape takes it back."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def format_turns(turns: list[tuple[str, str]]) -> str:
    return "".join(f"{TURN}{escape(role)}{BODY}{escape(text)}{END}" for role, text in turns)


@dataclass(frozen=True)
class Read:
    """What is read back from formatted text: turns, and the loss mask as (start, end) in code points of that text."""

    turns: list[tuple[str, str]]
    mask: list[tuple[int, int]]


def read_back(formatted: str, learn: tuple[str, ...] = ("assistant",)) -> Read:
    turns, mask, at = [], [], 0
    while at < len(formatted):
        if not formatted.startswith(TURN, at):
            raise ValueError(f"no turn begins at {at}")
        body = formatted.index(BODY, at + len(TURN))
        end = formatted.index(END, body + len(BODY))
        role = unescape(formatted[at + len(TURN) : body])
        turns.append((role, unescape(formatted[body + len(BODY) : end])))
        if role in learn:
            mask.append((body + len(BODY), end))
        at = end + len(END)
    return Read(turns, mask)


# ---- layouts ----


def whole(text: str) -> str:
    """The text with U+FFFD for halves of surrogate pairs, which JSON can hold and no column can."""
    try:
        text.encode()
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return text


def as_text(value) -> str:
    """What a field says: a string as it is, null nothing, a list its parts' texts joined by empty lines, an object its text or content, anything else its JSON."""
    if value is None or isinstance(value, str):
        return whole(value or "")
    if isinstance(value, list):
        return "\n\n".join(filter(None, map(as_text, value)))
    if isinstance(value, dict):
        inner = next((value[k] for k in ("text", "content") if k in value), None)
        return as_text(inner) if inner is not None else json.dumps(value, ensure_ascii=False, sort_keys=True)
    return json.dumps(value)


def place(value) -> tuple:
    """A total order of whatever stands for a turn's number: nothing, then numbers, then strings, then the rest by its JSON."""
    if value is None:
        return (0, 0, "")
    if isinstance(value, (int, float)) and value == value:  # NaN is with the rest
        return (1, value, "")
    return (2, 0, value) if isinstance(value, str) else (3, 0, json.dumps(value, sort_keys=True))


def field_paths(value, prefix: str = "") -> set[str]:
    if isinstance(value, dict):
        return {p for k, x in value.items() for p in field_paths(x, f"{prefix}.{k}" if prefix else k)} or {prefix}
    if isinstance(value, list):
        return {p for x in value for p in field_paths(x, f"{prefix}[]")} or {f"{prefix}[]"}
    return {prefix}


def schema_fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Layout:
    """Either a list of turns with a role and a text field, or fields that are turns themselves.

    order: a field that sorts the list.  parts: role to the fields whose texts,
    joined by an empty line, are that turn; empty ones are left out.
    optional: paths that a record may lack.  roles: other names of roles.
    """

    name: str
    turns: str = ""
    role: str = ""
    text: str = ""
    order: str = ""
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    optional: tuple[str, ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    def paths(self) -> set[str]:
        if self.turns:
            return {f"{self.turns}[].{x}" for x in (self.role, self.text, self.order) if x}
        return {x for _, fields in self.parts for x in fields}

    def read(self, record: dict) -> list[tuple[str, str]]:
        named = dict(self.roles)
        if self.turns:
            items = [x for x in record[self.turns] if isinstance(x, dict)]
            turns = [(place(x.get(self.order)) if self.order else (), as_text(x.get(self.role)), as_text(x.get(self.text))) for x in items]
            return [(named.get(role, role), text) for _, role, text in (sorted(turns) if self.order else turns)]
        out = [(role, "\n\n".join(filter(None, (as_text(record.get(x)) for x in fields)))) for role, fields in self.parts]
        return [(role, text) for role, text in out if text or role == "assistant"]


#: Declarative mappings; another layout is another line here, or in the argument of format_records.
LAYOUTS = [
    Layout("rows", turns="turns", role="role", text="text", order="turn"),
    Layout("messages", turns="messages", role="role", text="content"),
    Layout("conversations", turns="conversations", role="from", text="value", roles=(("human", "user"), ("gpt", "assistant"))),
    Layout("instruction", parts=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), optional=("system", "input")),
    Layout("prompt", parts=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))), optional=("system",)),
    Layout("response", parts=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), optional=("system",)),
    Layout("question", parts=(("user", ("context", "question")), ("assistant", ("answer",))), optional=("context",)),
]


def registry(layouts: list[Layout]) -> tuple[dict[str, Layout], set[str]]:
    """Fingerprint to layout, for every choice of optional fields; and all paths that count."""
    out, known = {}, set()
    for layout in layouts:
        paths = layout.paths()
        known |= paths
        for bits in range(1 << len(layout.optional)):
            out[schema_fingerprint(paths - {x for k, x in enumerate(layout.optional) if bits >> k & 1})] = layout
    return out, known


def layout_of(record: dict, by: dict[str, Layout], known: set[str]) -> Layout | None:
    """By the fingerprint of the record's known paths; fields that no layout names don't matter, nor does what is nested within one that a layout names."""
    found = set()
    for path in field_paths(record):
        ends = [m.start() for m in re.finditer(r"\.|\[\]", path)]
        found |= known & {path, *(path[:end] for end in ends)}
    return by.get(schema_fingerprint(found))


def record_of(raw: str | None) -> dict | None:
    """The JSON object of a text; None if it is none."""
    try:
        record = json.loads(raw) if raw else None
    except (ValueError, RecursionError):
        return None
    return record if isinstance(record, dict) else None


def format_records(df: DataFrame, id_col: str, record_col: str, layouts: list[Layout] | None = None) -> DataFrame:
    """id, layout, formatted and what is read back from formatted, for each row of df; record_col holds a JSON object.

    Columns: conv_id, layout (null: no layout fits), formatted, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars.  Null texts and roles
    are empty; other values than strings are read as as_text() says, turns that
    aren't objects left out.  A record that is null, no JSON or nested too deeply
    to read, isn't an object or fits no layout has no turns and an empty formatted
    text.  Turns of a layout with an order are sorted by place(), then role, then
    text.  Repeated rows give a row each.
    """
    by, known = registry(layouts or LAYOUTS)
    digest = lambda parts: hashlib.sha256("".join(parts).encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for raw in batch.column(1).to_pylist():
                record = record_of(raw)
                layout = layout_of(record, by, known) if record else None
                formatted = format_turns(layout.read(record)) if layout else ""
                back = read_back(formatted)
                loss = [unescape(formatted[a:b]) for a, b in back.mask]
                row = (layout.name if layout else None, formatted, len(back.turns), digest(f"{r}\n{t}\n" for r, t in back.turns), sum(map(len, loss)), digest(loss), len(formatted))
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], names=["conv_id", "layout", "formatted", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = dict(df.dtypes)[id_col]
    return map_arrow(df.select(id_col, record_col), run, f"conv_id {kind}, layout string, formatted string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def records_of_rows(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One JSON record for each conversation from one row for each turn.

    The digest of a conversation needs all its turns in order, so they meet in
    one task; conversations, not their number, bound that.  Turns are sorted by
    number (null first), then role, then text; repeated rows stay.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = df.select(F.col(id_col).alias("conv_id"), turn.alias("t"))
    return rows.groupBy("conv_id").agg(F.collect_list("t").alias("turns")).select("conv_id", F.to_json(F.struct("turns"), {"ignoreNullFields": "false"}).alias("record"))

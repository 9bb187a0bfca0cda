"""Chat formatting with a grammar round trip.

Grammar of a formatted conversation (no separators between turns)::

    conversation := turn*
    turn := "[INST] " text " [/INST]"                        role user
          | "<s> " text " </s>"                              role assistant
          | "<<SYS>>\\n" text "\\n<</SYS>>"                  role system
          | "[ROLE] " role "\\n" text " [/ROLE]"             any other role

Inside text, a backslash makes the next character ordinary. ``parse`` is the deterministic reader of
this grammar. ``render`` writes every turn as it is, reads the result back and compares the
recovered turn with its source; a turn that comes back different is written again with its
backslashes and control strings escaped, and the whole conversation is compared once more.

The loss mask is a list of [start, end) spans over the formatted text: the assistant texts without
their markers.

Edge cases: a null text is empty, a null role is the empty role (an "other" role), null turns come
first, equal turn numbers are ordered by role and text, a row with a null conversation id is a
conversation of its own (however many there are, they meet nowhere), repeated rows are repeated turns, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>"), "system": ("<<SYS>>\n", "\n<</SYS>>")}
OTHER = ("[ROLE] ", " [/ROLE]")
CONTROLS = [m.strip() for pair in (*MARKS.values(), OTHER) for m in pair]

_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_CONFLICT = re.compile(r"\\|" + _CONTROL.pattern)
_STOP = re.compile(r"\\.|" + _CONTROL.pattern, re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return _CONFLICT.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _render_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn and the span of its text. Both strings are already escaped where they need it."""
    start, end = MARKS.get(role, OTHER)
    if role not in MARKS:
        start += role.replace("\n", "\\\n") + "\n"
    return start + text + end, len(start), len(start) + len(text)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end span the escaped text. ValueError if it breaks the grammar."""
    turns, at = [], 0
    openings = [(a, b, role) for role, (a, b) in MARKS.items()] + [(*OTHER, None)]
    while at < len(formatted):
        opening = next((o for o in openings if formatted.startswith(o[0], at)), None)
        if opening is None:
            raise ValueError(f"no turn starts at {at}")
        start, end, role = opening
        at += len(start)
        if role is None:
            m = re.compile(r"(?:[^\\\n]|\\.)*", re.DOTALL).match(formatted, at)
            role, at = unescape(m[0]), m.end() + 1
        stop = next((m for m in _STOP.finditer(formatted, at) if m[0][0] != "\\"), None)
        last = -1 if stop is None else stop.end() - len(end)
        if last < at or formatted[last : stop.end()] != end:
            raise ValueError(f"the turn at {at} does not end with its own mark")
        turns.append((role, unescape(formatted[at:last]), at, last))
        at = stop.end()
    return turns


def _reads_back(formatted: str, turns: list[tuple[str, str]]) -> bool:
    try:
        return [t[:2] for t in parse(formatted)] == turns
    except ValueError:
        return False


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and its loss spans, proved to read back as ``turns``."""

    def put(escaped: list[bool]) -> tuple[str, list[tuple[int, int]]]:
        parts, spans, at = [], [], 0
        for (role, text), e in zip(turns, escaped, strict=True):
            turn, a, b = _render_turn(escape(role) if e and role not in MARKS else role, escape(text) if e else text)
            if role == "assistant":
                spans.append((at + a, at + b))
            parts.append(turn)
            at += len(turn)
        return "".join(parts), spans

    escaped = [not _reads_back(_render_turn(role, text)[0], [(role, text)]) for role, text in turns]
    for attempt in (escaped, [True] * len(turns)):
        formatted, spans = put(attempt)
        if _reads_back(formatted, turns):
            return formatted, spans
    raise ValueError("a conversation does not read back as its source")


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_spans``."""
    rows = turns.select(
        F.col(f"`{conv_col}`").cast("long").alias("conv_id"),
        F.struct(
            F.col(f"`{turn_col}`").cast("long").alias("turn"),
            F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    whole = rows.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    whole = whole.union(rows.where("conv_id IS NULL").select("conv_id", F.array("t"))).select("conv_id", F.col("t.role").alias("roles"), F.col("t.text").alias("texts"))
    schema = "conv_id long, formatted string, loss_spans array<struct<start: int, end: int>>"
    return whole.mapInArrow(_format_batches, schema)


def _format_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        ids, roles, texts = batch.columns
        done = [render(list(zip(r, t, strict=True))) for r, t in zip(roles.to_pylist(), texts.to_pylist(), strict=True)]
        spans = pa.array([[{"start": a, "end": b} for a, b in s] for _, s in done], spans_type)
        yield pa.RecordBatch.from_arrays([ids, pa.array([f for f, _ in done], pa.string()), spans], names=["conv_id", "formatted", "loss_spans"])


DIGEST_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted conversations hold, from their text and loss mask alone."""
    return formatted.select("conv_id", "formatted", F.col("loss_spans.start").alias("starts"), F.col("loss_spans.end").alias("ends")).mapInArrow(_digest_batches, DIGEST_SCHEMA)


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def sha(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    names = [f.split()[0] for f in DIGEST_SCHEMA.split(", ")]
    for batch in batches:
        ids, texts, starts, ends = batch.columns
        out = []
        for text, a, b in zip(texts.to_pylist(), starts.to_pylist(), ends.to_pylist(), strict=True):
            turns = parse(text)
            loss = "".join(unescape(text[i:j]) for i, j in zip(a, b, strict=True))
            out.append((len(turns), sha("".join(f"{role}\n{said}\n" for role, said, _, _ in turns)), len(loss), sha(loss), len(text)))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        cols = [pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([ids, *cols], names=names)

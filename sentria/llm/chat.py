"""Chat formatting that is proved by reading it back.

A turn is ``<s>``, the mark of its role, its text, ``</s>``. Each rendered turn is
parsed again; if what comes back is not the turn that went in, or a control string
stands in the text, the text is escaped and rendered once more. Control strings
are escaped by a backslash after their first character; one that already has
backslashes there gets one more, so escaping can always be undone.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentria.llm.common import slices

OPEN, CLOSE = "<s>", "</s>"
MARKS = {"user": "[INST]", "assistant": "[/INST]"}
OTHER = "[ROLE={}]"
LOSS_ROLE = "assistant"

_REST = r"(?=/?s>|/?INST\]|ROLE=)"
_CONTROL = re.compile(rf"[<\[]{_REST}")
_ESCAPABLE = re.compile(rf"([<\[])(\\*){_REST}")
_ESCAPED = re.compile(rf"([<\[])\\(\\*){_REST}")
_ROLE = re.compile(r"\[INST\]|\[/INST\]|\[ROLE=([^\]]*)\]")


class FormatError(ValueError):
    """The text is not in the grammar."""


def escape(text: str) -> str:
    return _ESCAPABLE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def _role_code(role: str) -> str:
    return re.sub(r"[%\]\[<>\\]", lambda m: f"%{ord(m[0]):02X}", role)


def _role_name(code: str) -> str:
    return re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), code)


def parse(rendered: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a rendered conversation, or FormatError.

    Deterministic: what stands at a place decides alone how to go on, and a turn
    ends at the first ``</s>``. No other control string may stand in a text.
    """
    turns, at = [], 0
    while at < len(rendered):
        if not rendered.startswith(OPEN, at):
            raise FormatError(f"no turn begins at {at}")
        mark = _ROLE.match(rendered, at + len(OPEN))
        if not mark:
            raise FormatError(f"no role at {at + len(OPEN)}")
        end = rendered.find(CLOSE, mark.end())
        if end < 0:
            raise FormatError(f"the turn at {at} does not end")
        body = rendered[mark.end() : end]
        if _CONTROL.search(body):
            raise FormatError(f"a control string stands in the turn at {at}")
        role = next((r for r, m in MARKS.items() if m == mark[0]), None)
        turns.append((_role_name(mark[1]) if role is None else role, unescape(body)))
        at = end + len(CLOSE)
    return turns


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """(rendered turn, start of its text, end of its text)."""
    head = OPEN + MARKS.get(role, OTHER.format(_role_code(role)))
    for body in (text, escape(text)):
        out = head + body + CLOSE
        try:
            if parse(out) == [(role, text)]:
                return out, len(head), len(head) + len(body)
        except FormatError:
            pass
    raise FormatError("escaping does not bring the turn back")


def format_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, segment, loss_start, loss_end): each turn rendered and proved
    where it lies.

    A conversation's formatted text is its segments in order of turn. The loss mask
    covers the texts of assistant turns: code points ``loss_start`` to ``loss_end``
    of the segment, null for other turns. Null roles and texts count as empty.
    """
    types = [conversations.schema[c].dataType.simpleString() for c in (conv_col, turn_col)]

    def run(batches):
        for batch in slices(batches):
            rows = []
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                out, start, end = render_turn(role or "", text or "")
                rows.append((out, start, end) if role == LOSS_ROLE else (out, None, None))
            cols = list(zip(*rows)) if rows else [(), (), ()]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())],
                names=["conv_id", "turn", "segment", "loss_start", "loss_end"],
            )

    picked = conversations.select(conv_col, turn_col, role_col, text_col)
    return picked.mapInArrow(run, f"conv_id {types[0]}, turn {types[1]}, segment string, loss_start long, loss_end long")


class _Reading:
    """One conversation while its segments go by; holds hashes, not texts."""

    def __init__(self, conv):
        self.conv, self.turns, self.loss_chars, self.chars = conv, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, segment: str, start: int | None, end: int | None) -> None:
        self.chars += len(segment)
        for role, text in parse(segment):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
        if start is not None:
            text = unescape(segment[start:end])
            self.loss_chars += len(text)
            self.loss.update(text.encode())

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(segments: DataFrame) -> DataFrame:
    """One row per conversation, from what ``format_turns`` put out: (conv_id,
    n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars).

    Segments are dealt by conversation and sorted by turn on disk if need be, then
    stream by: a conversation is never held, however long. Turns of equal number
    come in order of their segments, so repeated rows have one order; a null turn
    comes first; rows without a conversation make up one conversation of their own.
    An empty table gives an empty result.
    """

    def run(batches):
        now = None
        done: list[tuple] = []
        for batch in slices(batches):
            for conv, segment, start, end in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4))):
                if now is None or conv != now.conv:
                    if now is not None:
                        done.append(now.row())
                    now = _Reading(conv)
                now.add(segment, start, end)
            if len(done) >= 1000:
                yield rows(done)
                done = []
        if now is not None:
            done.append(now.row())
        yield rows(done)

    conv_type = segments.schema["conv_id"].dataType
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def rows(done: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*done)) if done else [()] * 6
        kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(conv_type)
    dealt = segments.select("conv_id", "turn", "segment", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions(F.col("conv_id"), F.col("turn"), F.col("segment"))
    return dealt.mapInArrow(run, f"conv_id {conv_type.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

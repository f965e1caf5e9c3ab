"""Operator 8: chat formatting, verified by a grammar round trip.

A turn is rendered as

    <|im_start|>ROLE\\n TEXT <|im_end|>\\n        (without the blanks)

and the rendering is parsed again by a deterministic parser. If the parser fails
or recovers another turn, the content is escaped and rendered again, until the
recovered turn is identical. The escape puts a backslash into every `<|`,
`<\\|`, `<\\\\|`, ...: after it no `<|` is left, and taking one backslash out of each
`<\\...|` restores the content, so two attempts always suffice. A newline in a role
becomes the control string `<|nl|>`.

Turns are rendered one by one in a stream sorted by conversation and turn; only
digests and spans are kept of a conversation, so a conversation of any length
needs bounded memory.

Defined results: null text and role are empty; turns that tie are taken in the
order of role, then text; a null turn comes first; a null conversation id is a
conversation of its own; repeated rows are repeated turns; other columns are not
read.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
#: Its text is under the loss mask.
LOSS_ROLE = "assistant"
_ESCAPABLE = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<(\\*)\\\|")


class ChatError(ValueError):
    """A rendering that the grammar doesn't allow."""


def escape(text: str) -> str:
    return _ESCAPABLE.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


@dataclass
class Turn:
    role: str
    text: str
    start: int  # span of the rendered text in the formatted string
    end: int


def parse(formatted: str) -> list[Turn]:
    """The turns of a formatted conversation, unescaped."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ChatError(f"no turn begins at {at}")
        head = formatted.find("\n", at)
        if head < 0:
            raise ChatError("a role has no end")
        role = formatted[at + len(START) : head]
        if "<|" in role.replace(NEWLINE, "\n"):
            raise ChatError("a control string in a role")
        end = formatted.find("<|", head + 1)
        if end < 0 or not formatted.startswith(END + "\n", end):
            raise ChatError("a control string in a text, or no end")
        turns.append(Turn(unescape(role.replace(NEWLINE, "\n")), unescape(formatted[head + 1 : end]), head + 1, end))
        at = end + len(END) + 1
    return turns


def render(role: str, text: str) -> str:
    """One turn, escaped only where the round trip needs it."""
    for r, t in ((role, text), (role, escape(text)), (escape(role).replace("\n", NEWLINE), text), (escape(role).replace("\n", NEWLINE), escape(text))):
        formatted = f"{START}{r}\n{t}{END}\n"
        try:
            got = parse(formatted)
        except ChatError:
            continue
        if len(got) == 1 and got[0].role == role and got[0].text == text:
            return formatted
    raise ChatError("a turn that no escape makes safe")


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, seq, formatted, loss_start, loss_end) for each turn, in order.

    A conversation's string is its `formatted` by `seq`; the span holds the text
    under the loss mask within the turn, null where there is none.
    """
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def each(batches):
        now, seq = object(), 0
        for b in batches:
            out = []
            for conv, _, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                seq = seq + 1 if conv == now else 0
                now = conv
                formatted = render(role, text)
                turn = parse(formatted)[0]
                span = (turn.start, turn.end) if role == LOSS_ROLE else (None, None)
                out.append((conv, seq, formatted, *span))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["conv_id", "seq", "formatted", "loss_start", "loss_end"])

    return ordered.mapInArrow(each, "conv_id long, seq long, formatted string, loss_start long, loss_end long")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted conversations say, one row for each.

    formatted holds the rows of format_conversations(), in its order within
    partitions.
    """

    def each(batches):
        now, held = None, None

        def row():
            return (now, held["n"], held["turns"].hexdigest(), held["loss_chars"], held["loss"].hexdigest(), held["chars"])

        for b in batches:
            out = []
            for conv, _, text, a, z in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held is None or conv != now:
                    if held is not None:
                        out.append(row())
                    now, held = conv, {"n": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0}
                for t in parse(text):
                    held["n"] += 1
                    held["turns"].update(f"{t.role}\n{t.text}\n".encode())
                if a is not None:
                    said = unescape(text[a:z])
                    held["loss_chars"] += len(said)
                    held["loss"].update(said.encode())
                held["chars"] += len(text)
            if out:
                yield _rows(out)
        if held is not None:
            yield _rows([row()])

    return formatted.mapInArrow(each, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _rows(out):
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

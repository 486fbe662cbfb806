"""Chat formatting with a grammar round trip.

Template of a turn: `### Role:`, newline, text, newline, `</turn>`, newline. The roles system, user and assistant are written with a
capital; any other role is written as @ and its percent-encoded letters. Control strings are `###` and `</turn>`. A text is first
rendered as it is and parsed by the grammar; if what comes back differs from the source, each control string in it gets one more
backslash before it and the turn is parsed again, until both are identical. The parser takes a control string with backslashes as
text, less one backslash, and one without as the border of a turn. So `###` becomes `\\###`, and `\\###` becomes `\\\\###`.

Turns are rendered row by row before any shuffle. The parts of a conversation are then read in order as a stream, with digests kept
as running states, so a conversation of any length takes the memory of one turn.

Null text and null role count as empty; rows are ordered by turn (null first), then by rendered text; a null conv_id is a
conversation of its own. Repeated rows are turns like others. Other columns are not read.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import rows_pass

ROLES = {"system": "System", "user": "User", "assistant": "Assistant"}
NAMES = {v: k for k, v in ROLES.items()}
CONTROL = re.compile(r"(\\*)(###|</turn>)")
ESCAPED = re.compile(r"\\(\\*(?:###|</turn>))")
HEAD = re.compile(r"### ([^\n:]*):\n")
TAIL = "\n</turn>\n"


def head(role: str) -> str:
    return f"### {ROLES.get(role) or '@' + quote(role, safe='')}:\n"


def parse(text: str) -> list[tuple[str, str, int, int]] | None:
    """(role, text, start and end of the escaped text) of each turn, or None if the text is not of the grammar."""
    turns, pos = [], 0
    while pos < len(text):
        if not (h := HEAD.match(text, pos)):
            return None
        name, begin = h[1], h.end()
        border = next((m for m in CONTROL.finditer(text, begin) if not m[1]), None)
        if border is None or border[2] != "</turn>" or border.start() - 1 < begin or text[border.start() - 1:border.end() + 1] != TAIL:
            return None
        role = NAMES.get(name) if name in NAMES else unquote(name[1:]) if name[:1] == "@" else None
        if role is None:
            return None
        end = border.start() - 1
        turns.append((role, ESCAPED.sub(r"\1", text[begin:end]), begin, end))
        pos = border.end() + 1
    return turns


def render(role: str | None, text: str | None) -> tuple[str, int, int]:
    """The turn and the span of its text, escaped as far as the round trip needs it."""
    role, text = role or "", text or ""
    for body in (text, CONTROL.sub(r"\\\1\2", text)):
        out = head(role) + body + TAIL
        back = parse(out)
        if back is not None and [x[:2] for x in back] == [(role, text)]:
            return out, back[0][2], back[0][3]
    raise ValueError("no rendering parses back to the turn")


def render_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per row: conversation, turn, part (the rendered turn), loss_from and loss_to (span of the assistant's text in code points of
    the part, else null)."""
    def make():
        def row(conv, turn, role, text):
            out, a, b = render(role, text)
            return (conv, turn, out, a, b) if role == "assistant" else (conv, turn, out, None, None)
        return row
    kinds = dict(df.dtypes)
    return rows_pass(df, [conv_col, turn_col, role_col, text_col], f"{conv_col} {kinds[conv_col]}, {turn_col} {kinds[turn_col]}, part string, loss_from int, loss_to int", make)


def join_turns(parts: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """conv_id and formatted text, for conversations that fit a row."""
    return parts.groupBy(conv_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(turn_col, "part"))), lambda x: x["part"]), "").alias("formatted"))


def read_back(parts: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Parse the rendered turns of each conversation in order and digest what comes back."""
    kind = dict(parts.dtypes)[conv_col]
    schema = parts.sparkSession.createDataFrame([], f"{conv_col} {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(schema)
        now, state, done = None, None, []

        def close():
            done.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
        for batch in batches:
            for conv, part, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or conv != now:
                    if state is not None:
                        close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns = parse(part)
                if turns is None:
                    raise ValueError("a rendered turn does not parse")
                for role, text, _, _ in turns:
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                state[4] += len(part)
                if a is not None:
                    said = ESCAPED.sub(r"\1", part[a:b])
                    state[2] += len(said)
                    state[3].update(said.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*done), arrow)], schema=arrow)
                done.clear()
        if state is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*done), arrow)], schema=arrow)

    ordered = parts.repartition(F.col(conv_col)).sortWithinPartitions(F.col(conv_col), F.col(turn_col).asc_nulls_first(), F.col("part"))
    return ordered.select(conv_col, "part", "loss_from", "loss_to").mapInArrow(run, schema)

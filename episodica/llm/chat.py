"""Chat formatting with a grammar that is read back: what the parser doesn't return unchanged is escaped until it does.

    turn := "<|im_start|>" role "\\n" text "<|im_end|>\\n"

A control string begins with "<|". Escaping puts one more backslash between "<" and "|" ("<|" becomes "<\\|", "<\\|" becomes
"<\\\\|"), the parser takes one away. In a role, a line end is written as backslash n and a backslash as two.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import tasks

START, END = "<|im_start|>", "<|im_end|>\n"
_HIDE, _SHOW = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _HIDE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _SHOW.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def parse(rendered: str) -> list[tuple[str, str, int, int]] | None:
    """The turns of rendered text: role, text and the span of the written text; None where the grammar doesn't hold."""
    turns, at = [], 0
    while at < len(rendered):
        if not rendered.startswith(START, at):
            return None
        line = rendered.find("\n", at)
        end = rendered.find("<|", line) if line >= 0 else -1
        if end < 0 or not rendered.startswith(END, end) or "<|" in rendered[at + len(START) : line]:
            return None
        turns.append((unescape_role(rendered[at + len(START) : line]), unescape(rendered[line + 1 : end]), line + 1, end))
        at = end + len(END)
    return turns


def render(role: str, text: str) -> str:
    """One turn, whose parse is just this turn. Text that has no conflict is written as it is."""
    said, name = text, role
    while True:
        out = f"{START}{name}\n{said}{END}"
        turns = parse(out)
        if turns is not None and [t[:2] for t in turns] == [(role, text)]:
            return out
        if (said, name) == (escape(text), escape_role(role)):
            raise ValueError("an escaped turn does not parse")  # the grammar rules this out
        if turns is not None and len(turns) == 1 and turns[0][0] != role:
            name = escape_role(role)
        elif said != escape(text):
            said = escape(text)
        else:
            name = escape_role(role)


def format_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Renders each row as one piece of its conversation: conv, turn, role, text, piece, loss boolean.

    A conversation is its pieces, joined in the order of turn (null last), role, text. As each piece parses to its own turn and
    ends where the next may begin, the joined pieces parse to the joined turns. Null roles and texts are empty, a null conv is a
    conversation of its own, repeated rows are repeated turns, an empty table has no pieces, other columns are ignored.
    """
    pick = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = f"conv {pick.schema['conv'].dataType.simpleString()}, turn {pick.schema['turn'].dataType.simpleString()}, role string, text string, piece string, loss boolean"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            roles, texts = b.column("role").to_pylist(), b.column("text").to_pylist()
            pieces = pa.array([render(r, t) for r, t in zip(roles, texts, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, pieces, pa.array([r == "assistant" for r in roles])], [*b.schema.names, "piece", "loss"])

    return pick.mapInArrow(work, schema)


def read_back(pieces: DataFrame) -> DataFrame:
    """Parses formatted conversations: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Pieces are dealt by conversation and sorted; a task streams them through the parser and running digests, so that it holds one
    batch, however long a conversation is. (A digest of a conversation needs its text in order, in one place.)
    """
    kind = pieces.schema["conv"].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    order = [F.asc_nulls_last(c) for c in ("conv", "turn", "role", "text")]
    dealt = pieces.repartition(tasks(pieces.sparkSession), "conv").sortWithinPartitions(*order).select("conv", "piece", "loss")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

        def row(s: list) -> dict:
            return dict(zip(names, [s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]], strict=True))

        for b in batches:
            out = []
            for conv, piece, loss in zip(*(b.column(c).to_pylist() for c in ("conv", "piece", "loss")), strict=True):
                if state is None or conv != now:
                    out += [row(state)] if state else []
                    now, state = conv, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns = parse(piece)
                if turns is None:
                    raise ValueError(f"conversation {conv}: a piece does not parse")
                for role, text, _, _ in turns:
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                    if loss:
                        state[3] += len(text)
                        state[4].update(text.encode())
                state[5] += len(piece)
            if out:
                yield pa.RecordBatch.from_pylist(out, b_schema)
        if state:
            yield pa.RecordBatch.from_pylist([row(state)], b_schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    b_schema = to_arrow_schema(StructType.fromDDL(schema))
    return dealt.mapInArrow(work, schema)

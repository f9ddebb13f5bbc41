"""Chat formatting with a grammar round trip.

A conversation's turns are rendered in order of turn: ``<s>`` and then, by role,
``[INST] text [/INST]`` (user), `` text </s>`` (assistant), ``[SYS] text [/SYS]`` (system), and
``[TURN role] text [/TURN]`` for any other role. Control strings inside texts get a backslash in front; control
strings that already have some get one more. ``parse`` is a deterministic parser of this grammar. What it reads
from the rendered text is compared with the source turns; if they differ, backslashes are escaped too and the
comparison is made again, and a conversation that still differs is an error, never output.

The loss mask is a list of [start, end) code points of the rendered text: the assistant texts.

Null text or role: empty. Turns that share a number are ordered by role, then text; repeated rows are turns of
their own; a null turn comes first. A null conv_id is a conversation of its own. Extra columns are ignored; an
empty table gives only what is added to it. One conversation is one row, so its turns must fit a task.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Role -> what opens and closes its turns. Any other role: OTHER.
TURNS = {"user": ("[INST] ", " [/INST]"), "assistant": (" ", " </s>"), "system": ("[SYS] ", " [/SYS]")}
OTHER = ("[TURN ", "] ", " [/TURN]")
BEGIN = "<s>"
CONTROL = re.compile(r"(\\*)(</?s>|\[/?INST\]|\[/?SYS\]|\[TURN |\[/TURN\])")
ESCAPED = re.compile(r"\\(\\*(?:</?s>|\[/?INST\]|\[/?SYS\]|\[TURN |\[/TURN\]))")


def escape(text: str, full: bool) -> str:
    """Control strings get one more backslash. full: every backslash and bracket is escaped, not only those."""
    return re.sub(r"([\\\[\]<>])", r"\\\1", text) if full else CONTROL.sub(r"\1\\\2", text)


def unescape(text: str, full: bool) -> str:
    return re.sub(r"\\([\\\[\]<>])", r"\1", text) if full else ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]], full: bool = False) -> tuple[str, list[tuple[int, int]]]:
    """Text and loss mask of (role, text) turns. A text rendered in full begins with a backslash after BEGIN."""
    out, mask = [BEGIN + ("\\" if full else "")], []
    at = len(out[0])
    for role, text in turns:
        if role in TURNS:
            opened, closed = TURNS[role]
        else:
            opened, closed = OTHER[0] + escape(role, True) + OTHER[1], OTHER[2]
        body = escape(text, full)
        if role == "assistant":
            mask.append((at + len(opened), at + len(opened) + len(body)))
        out.append(opened + body + closed)
        at += len(out[-1])
    return "".join(out), mask


def parse(text: str) -> tuple[list[tuple[str, str]], list[tuple[int, int]], bool]:
    """Turns, loss mask and whether the text was rendered in full. Raises ValueError outside the grammar."""
    if not text.startswith(BEGIN):
        raise ValueError(f"no {BEGIN!r}")
    at = len(BEGIN)
    full = text.startswith("\\", at)
    at += full
    turns, mask = [], []
    openers = [(o, c, r) for r, (o, c) in TURNS.items()]
    while at < len(text):
        for opened, closed, role in openers:
            if text.startswith(opened, at):
                begin = at + len(opened)
                break
        else:
            if not text.startswith(OTHER[0], at):
                raise ValueError(f"no turn at {at}")
            named = re.compile(r"((?:\\.|[^\\\]])*)\] ", re.S).match(text, at + len(OTHER[0]))
            if not named:
                raise ValueError(f"no role at {at}")
            begin, closed, role = named.end(), OTHER[2], unescape(named[1], True)
        end = text.find(closed, begin)  # an escaped one has a backslash after the blank
        if end < 0:
            raise ValueError(f"no {closed!r} after {begin}")
        if role == "assistant":
            mask.append((begin, end))
        turns.append((role, unescape(text[begin:end], full)))
        at = end + len(closed)
    return turns, mask, full


def formatted(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """Rendered text and loss mask whose parse gives the turns back."""
    for full in (False, True):
        text, mask = render(turns, full)
        try:
            if parse(text) == (turns, mask, full):
                return text, mask
        except ValueError:
            pass
    raise ValueError("the conversation can't be rendered reversibly")


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, text, mask) of each conversation; mask: array of (start, end) under the loss."""
    whole = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    whole = whole.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def fn(batches):
        for b in batches:
            done = [formatted([(t["role"], t["text"]) for t in turns]) for turns in b.column("turns").to_pylist()]
            masks = [[{"start": s, "end": e} for s, e in mask] for _, mask in done]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array([t for t, _ in done], pa.string()), pa.array(masks, pa.list_(span))], ["conv_id", "text", "mask"])

    return whole.mapInArrow(fn, "conv_id long, text string, mask array<struct<start:long,end:long>>")


def digests(chats: DataFrame) -> DataFrame:
    """What the rendered texts and masks hold, read back: turns, and the unescaped text under the mask."""
    sha = lambda t: hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def fn(batches):
        for b in batches:
            out = []
            for conv_id, text, mask in zip(*(b.column(c).to_pylist() for c in ("conv_id", "text", "mask"))):
                turns, _, full = parse(text)
                loss = "".join(unescape(text[m["start"] : m["end"]], full) for m in mask)
                out.append((conv_id, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return chats.mapInArrow(fn, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

"""Operator 6: chat formatting in budgeted windows.

A turn is written ``### role: text</turn>`` and a line feed. Within texts and roles ``\\``, ``#``, ``<`` and ``:`` (roles only) get a
backslash before them, so control strings never come from a text, and it can be read back.

Running sums of turn tokens choose windows of whole turns: the system turn opens each, then as many of
the last turns before as fit a share of the budget are repeated as history, then new turns follow while they fit
(one at least). The loss mask covers the texts of new assistant turns; repeated ones are masked.
Conversations are streamed in order of their turns, so one of any length needs the memory of one window.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches

BUDGET, HISTORY = 1024, 256
_TEXT, _ROLE = re.compile(r"[\\#<]"), re.compile(r"[\\#<:]")
_BACK = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.)*)</turn>\n", re.S)
_WORDS = re.compile(r"\w+|[^\w\s]")


def write_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn, and where its text begins and ends in it."""
    role = _ROLE.sub(lambda m: "\\" + m[0], role)
    text = _TEXT.sub(lambda m: "\\" + m[0], text)
    head = f"### {role}: "
    return f"{head}{text}</turn>\n", len(head), len(head) + len(text)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def turn_tokens(text: str) -> int:
    """Words and marks, and four for the template."""
    return 4 + sum(1 for _ in _WORDS.finditer(text))


@dataclass
class _Windows:
    """Windows of one conversation, as its turns come in."""

    conv_id: int | None
    number: int = 0
    system: tuple[str, str, int] | None = None
    shown: list[tuple[str, str, int]] = field(default_factory=list)
    new: list[tuple[str, str, int]] = field(default_factory=list)
    used: int = 0
    begun: bool = False

    def add(self, role: str, text: str):
        turn = (role, text, turn_tokens(text))
        if not self.begun:
            self.begun = True
            if role == "system":
                self.system = turn
        if self.new and self.used + turn[2] > BUDGET:
            yield self.close()
            # The suffix of what was shown whose sum of tokens is within the share for history.
            keep, total = len(self.shown), 0
            while keep and total + self.shown[keep - 1][2] <= HISTORY:
                keep -= 1
                total += self.shown[keep][2]
            self.shown = self.shown[keep:]
            self.used = total + (self.system[2] if self.system else 0)
        self.new.append(turn)
        self.used += turn[2]

    def close(self):
        repeated = ([self.system] if self.system and self.number else []) + self.shown
        at, parts, starts, ends = 0, [], [], []
        for i, (role, text, _) in enumerate(repeated + self.new):
            turn, a, b = write_turn(role, text)
            if i >= len(repeated) and role == "assistant":
                starts.append(at + a)
                ends.append(at + b)
            parts.append(turn)
            at += len(turn)
        out = (self.conv_id, self.number, len(repeated), "".join(parts), starts, ends)
        self.number += 1
        self.shown = [t for t in self.shown + self.new if t is not self.system]
        self.new, self.used = [], 0
        return out


_WINDOW = pa.schema([("conv_id", pa.int64()), ("window", pa.int32()), ("repeated", pa.int32()), ("text", pa.string()), ("loss_start", pa.list_(pa.int64())), ("loss_end", pa.list_(pa.int64()))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, role, text) sorted by conversation and turn."""
    now, rows = None, []
    for batch in slices(batches):
        for conv_id, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    rows.append(now.close())
                now = _Windows(conv_id)
            rows.extend(now.add(role, text))
        if rows:
            yield _batch(rows, _WINDOW)
            rows = []
    if now is not None:
        yield _batch([now.close()], _WINDOW)


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation from its windows, in order: only from what is written in them."""
    now, rows = None, []

    def done():
        return (now["id"], now["turns"], now["all"].hexdigest(), now["loss"], now["target"].hexdigest(), now["chars"], now["windows"])

    for batch in batches:
        for conv_id, number, repeated, text, starts, ends in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if number == 0:
                if now:
                    rows.append(done())
                now = {"id": conv_id, "turns": 0, "all": hashlib.sha256(), "loss": 0, "target": hashlib.sha256(), "chars": 0, "windows": 0}
            for role, said in read_turns(text)[repeated:]:
                now["turns"] += 1
                now["all"].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
            for a, b in zip(starts, ends, strict=True):
                said = unescape(text[a:b])
                now["loss"] += len(said)
                now["target"].update(said.encode("utf-8", "surrogatepass"))
            now["chars"] += len(text)
            now["windows"] += 1
        if rows:
            yield _batch(rows, _DIGEST)
            rows = []
    if now:
        yield _batch([done()], _DIGEST)


def format_windows(turns: DataFrame) -> DataFrame:
    """Windows (conv_id, window, repeated, text, loss_start, loss_end) of rows (conv_id, turn, role, text).

    Rows go by turn (null first), then role and text; repeated rows are turns each. A null role or text is empty; rows
    with a null conv_id are one conversation. Windows of a conversation are in one partition, in order. Offsets of the loss
    mask are code points of the window's text.
    """
    small_batches(turns.sparkSession, 2000)
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), empty("role"), empty("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return rows.mapInArrow(_format, "conv_id bigint, window int, repeated int, text string, loss_start array<bigint>, loss_end array<bigint>")


def digests(windows: DataFrame) -> DataFrame:
    """What the windows say, read back, a row for each conversation. Takes windows as ``format_windows`` leaves them."""
    return windows.mapInArrow(_read_back, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_windows bigint")

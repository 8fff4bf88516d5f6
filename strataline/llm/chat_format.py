"""Chat formatting in budgeted windows with a loss mask.

Turns are marked by a template; control strings inside texts and roles are escaped reversibly.
Prefix sums of the tokens of turns as they are written (marker, role, escaped text) choose windows: a
window starts with the conversation's system turn (its first turn, if that is one), repeats up to
``history_turns`` turns before its span within ``history_budget`` tokens, and takes new turns while
their sum with the window's own markers stays within ``budget``. A turn is never cut: one that is over
the budget with the system turn gets a window of its own. n_tokens is the sum; tokenising the whole
window gives at most as many, as turns meet only in ``][``. The loss mask covers assistant texts that are new in the
window; repeated ones are masked, so each assistant text is learnt once.

Rows are dealt out by conversation and sorted by turn; a task streams over them and holds one
window (and its history), never a conversation. Rows of a null conversation id are one
conversation. Null texts and roles count as empty. Equal turn numbers are ordered by role and
text; repeated rows are turns of their own. Empty tables give no windows; extra columns are ignored,
whatever their names. A very long text is in memory as often as its window is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm.packing import byte_bpe, byte_bpe_path

BOS, EOS, OPEN, CLOSE = "<s>", "</s>", "[INST]", "[/INST]"
CONTROLS = (BOS, EOS, OPEN, CLOSE)
_CONTROL = re.compile(r"\\|" + "|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\([\\;])")
_TURN = re.compile(re.escape(OPEN) + r"(.*?)\n(.*?)" + re.escape(CLOSE), re.S)

BUDGET, HISTORY_TURNS, HISTORY_BUDGET = 1024, 2, 256

WINDOW = "conv_id long, window_no long, formatted string, loss_spans array<struct<start:int,end:int>>, new_turns array<boolean>, n_tokens long"


def escape(text: str) -> str:
    r"""Doubles backslashes and breaks control strings after their first character by \; ."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\;" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" if m[1] == "\\" else "", text)


def _escaped_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def _unescaped_role(role: str) -> str:
    return re.sub(r"\\([\\;n])", lambda m: {"\\": "\\", ";": "", "n": "\n"}[m[1]], role)


def written_turn(role: str, text: str) -> tuple[str, str]:
    """A turn's head and body as they stand in a window, before CLOSE."""
    return f"{OPEN}{_escaped_role(role)}\n", escape(text)


class _Windows:
    """Windows of one conversation, from its turns in order.

    sums holds the prefix sums of the turns' tokens that still matter: sums[i] is the total before
    the turn recent[i], and the last one the total of all turns so far.
    """

    def __init__(self, conv_id: int | None, budget: int, history_turns: int, history_budget: int, frame: int):
        self.conv_id, self.budget, self.history_turns, self.history_budget, self.frame = conv_id, budget, history_turns, history_budget, frame
        self.system: tuple | None = None
        self.recent: list[tuple] = []  # the last turns, as (head, body, assistant, tokens)
        self.sums = [0]
        self.now: list[tuple[tuple, bool]] = []
        self.fixed = self.begin = self.number = self.turns = 0

    def _start(self, turn: tuple) -> None:
        """A window's repeated turns, leaving room for the new one where possible; begin is the sum before its first one but the system turn."""
        self.now = [(self.system, False)] if self.system else []
        self.fixed = self.frame + (self.system[3] if self.system else 0)
        end = self.sums[-1]
        room, first = min(self.history_budget, self.budget - self.fixed - turn[3]), len(self.recent)
        while first and self.recent[first - 1] is not self.system and end - self.sums[first - 1] <= room:
            first -= 1
        self.now += [(old, False) for old in self.recent[first:]]
        self.begin = self.sums[first]

    def add(self, head: str, body: str, role: str, tokens: int) -> Iterator[tuple]:
        turn = (head, body, role == "assistant", tokens)
        if not any(new for _, new in self.now):
            self._start(turn)
        elif self.fixed + self.sums[-1] + tokens - self.begin > self.budget:
            yield self.window()
            self._start(turn)
        self.now.append((turn, True))
        if role == "system" and not self.turns:
            self.system = turn
        self.turns += 1
        self.recent.append(turn)
        self.sums.append(self.sums[-1] + tokens)
        if len(self.recent) > self.history_turns:
            del self.recent[0], self.sums[0]

    def window(self) -> tuple:
        parts, at, spans = [BOS], len(BOS), []
        for (head, body, assistant, _), new in self.now:
            if new and assistant:
                spans.append({"start": at + len(head), "end": at + len(head) + len(body)})
            parts += [head, body, CLOSE]
            at += len(head) + len(body) + len(CLOSE)
        out = (self.conv_id, self.number, "".join([*parts, EOS]), spans, [new for _, new in self.now], self.fixed + self.sums[-1] - self.begin)
        self.number += 1
        self.now = []
        return out


def format_chats(
    conversations: DataFrame,
    *,
    budget: int = BUDGET,
    history_turns: int = HISTORY_TURNS,
    history_budget: int = HISTORY_BUDGET,
    path: str | None = None,
) -> DataFrame:
    """A row for each window, in WINDOW; a conversation's windows follow each other in one partition. Tokens are counted with the byte-level BPE at path."""
    path = path or byte_bpe_path()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(path)
        frame = sum(map(len, encode([BOS, EOS])))
        names = ["conv_id", "window_no", "formatted", "loss_spans", "new_turns", "n_tokens"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.bool_()), pa.int64()]
        table = lambda found: pa.RecordBatch.from_arrays([pa.array([w[i] for w in found], t) for i, t in enumerate(types)], names)
        current: _Windows | None = None
        for batch in batches:
            ids, roles, texts = (batch.column(i).to_pylist() for i in range(3))
            # a few turns at once: windows of a batch may be long
            for at in range(0, batch.num_rows, 500):
                found: list[tuple] = []
                parts = [written_turn(role, text) for role, text in zip(roles[at : at + 500], texts[at : at + 500], strict=True)]
                sizes = map(len, encode([head + body + CLOSE for head, body in parts]))
                for conv_id, role, (head, body), tokens in zip(ids[at : at + 500], roles[at : at + 500], parts, sizes, strict=True):
                    if current is None or current.conv_id != conv_id:
                        if current:
                            found.append(current.window())
                        current = _Windows(conv_id, budget, history_turns, history_budget, frame)
                    found.extend(current.add(head, body, role, tokens))
                yield table(found)
        if current:
            yield table([current.window()])

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role").alias("role"), text("text").alias("text"))
    # One exchange by conversation; the sort spills, so a long conversation needs no more memory than a short one.
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return dealt.mapInArrow(rows, WINDOW)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn in a window's formatted text."""
    return [(_unescaped_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive windows of conversations to one row for each, read back from the formatted text."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    class Sums:
        def __init__(self, conv_id):
            self.conv_id, self.turns, self.loss = conv_id, hashlib.sha256(), hashlib.sha256()
            self.n_turns = self.loss_chars = self.chars = self.windows = 0

        def add(self, formatted, spans, new_turns):
            self.windows += 1
            self.chars += len(formatted)
            for (role, text), new in zip(parse(formatted), new_turns, strict=True):
                if new:
                    self.n_turns += 1
                    self.turns.update(f"{role}\n{text}\n".encode())
            for s in spans:
                text = unescape(formatted[s["start"] : s["end"]])
                self.loss_chars += len(text)
                self.loss.update(text.encode())

        def row(self):
            return self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.windows

    current = None
    for batch in batches:
        done = []
        for conv_id, formatted, spans, new_turns in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
            if current is None or current.conv_id != conv_id:
                if current:
                    done.append(current.row())
                current = Sums(conv_id)
            current.add(formatted, spans, new_turns)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(types)], names)
    if current:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(current.row(), types, strict=True)], names)


def chat_digests(windows: DataFrame) -> DataFrame:
    """One row for each conversation of format_chats' output."""
    return windows.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")


PROBE = "</s>[INST] ok [/INST]"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(0, 2, 1, 1).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return chat_digests(format_chats(table.unionByName(probe)))

"""Chat formatting into turn-aligned windows under a token budget, with a loss mask; and its inverse."""

from __future__ import annotations

import hashlib
import re
from collections import deque
from itertools import groupby

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import record_batch, small_batches
from .tokens import Encoder

#: Marks of a turn: `### role: text</turn>` and a line end. Inside texts and roles none of them can occur.
HEAD, STOP = "### ", "</turn>\n"
WINDOW_SCHEMA = "conv_id long, window long, formatted string, loss array<struct<start: long, end: long>>, n_context long, n_tokens long, over_budget boolean"


def escape(text: str) -> str:
    """Double each backslash, part each run of # and each stop mark; unescape gives text again."""
    return re.sub(r"(?<=#)#", r"\\#", text.replace("\\", "\\\\")).replace("</turn>", "<\\/turn>")


def escape_role(role: str) -> str:
    return escape(role).replace(":", "\\:")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def parse(formatted: str) -> list[tuple[str, str, int]]:
    """(role, text, place of the escaped text) of each turn."""
    out, at = [], 0
    while at < len(formatted):
        m = re.compile(r"### ((?:\\.|[^\\:])*): ", re.S).match(formatted, at)
        end = formatted.index(STOP, m.end())
        out.append((unescape(m[1]), unescape(formatted[m.end() : end]), m.end()))
        at = end + len(STOP)
    return out


def formatted_turn(role: str, text: str) -> tuple[str, str]:
    """What a turn is in a window: its head, and its text up to the stop mark."""
    return f"{HEAD}{escape_role(role)}: ", escape(text)


class Windows:
    """Streams the turns of one conversation into windows; holds one window and the history to repeat.

    Sums are kept as turns come and go, so a turn costs the same however many there are. Each formatted turn
    has tokens, its marks at least, so a window always closes. Token ids never cross the marks between two
    turns: a window has the sum of its turns' tokens.
    """

    def __init__(self, conv, budget: int, history: int):
        self.conv, self.budget, self.history, self.n = conv, budget, history, 0
        self.system, self.context, self.new, self.past = None, [], [], deque()
        self.used = self.behind = 0  # tokens of the window at hand, and of past

    def add(self, role: str, head: str, own: str, tokens: int):
        """Yields a window once this turn does not fit in it."""
        turn = (role, head, own, tokens)
        if self.system is None and not self.n and not self.new and role == "system":
            self.system = turn
        if self.new and self.used + tokens > self.budget:
            yield self.window()
            # sums of what came before, newest first, choose how many whole turns are repeated
            self.context = [self.system] if self.system else []
            self.used = sum(t[3] for t in self.context)
            room, at, again = min(self.history, self.budget - tokens - self.used), 0, []
            for t in reversed(self.past):
                at += t[3]
                if at > room:
                    break
                again.append(t)
            self.context += reversed(again)
            self.used += sum(t[3] for t in again)
        self.new.append(turn)
        self.used += tokens
        if turn is not self.system:
            self.past.append(turn)
            self.behind += tokens
            while len(self.past) > 1 and self.behind - self.past[0][3] >= self.history:
                self.behind -= self.past.popleft()[3]

    def window(self):
        text, loss, at = [], [], 0
        for k, (role, head, own, _) in enumerate(self.context + self.new):
            if role == "assistant" and k >= len(self.context):  # repeated targets stay masked
                loss.append({"start": at + len(head), "end": at + len(head) + len(own)})
            text.append(head + own + STOP)
            at += len(text[-1])
        row = (self.conv, self.n, "".join(text), loss, len(self.context), self.used, self.used > self.budget)
        self.n, self.new = self.n + 1, []
        return row

    def end(self):
        if self.new:
            yield self.window()


def format_conversations(df: DataFrame, vocabulary: str | None = None, budget: int = 1024, history: int = 256) -> DataFrame:
    """One row per window: conv_id, window, formatted, loss spans, n_context, n_tokens, over_budget.

    A window holds the conversation's leading system turn, up to `history` tokens of whole earlier turns
    (both masked: the first n_context turns), then new turns while the budget lasts. n_tokens counts the ids of
    formatted, marks and roles included. A turn longer than the budget, alone or with the system turn, stands
    alone with it in an over_budget window, whole. Turns are ordered by turn, role and text (nulls
    first); ties and repeated rows are all kept. Null texts and roles count as empty; a null conv_id is a
    conversation of its own; no rows give no windows; other columns are ignored.
    Rows are dealt by conv_id and sorted, then streamed: memory is a window and an Arrow batch, however long a
    conversation, and time is in proportion to its turns.
    """
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    out = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("n_context", pa.int64()), ("n_tokens", pa.int64()), ("over_budget", pa.bool_())])
    small_batches(df.sparkSession)

    def run(batches):
        enc, now = Encoder(path), None
        for b in batches:
            conv, role, text = (b.column(i).to_pylist() for i in range(3))
            rows = []
            for c, r, t in zip(conv, role, text):
                if now is None or now.conv != c:
                    rows.extend(now.end() if now else ())
                    now = Windows(c, budget, history)
                head, own = formatted_turn(r, t)
                rows.extend(now.add(r, head, own, len(enc.one(head + own + STOP))))
            if rows:
                yield record_batch(out, dict(zip(out.names, zip(*rows))))
        if now and (rows := list(now.end())):
            yield record_batch(out, dict(zip(out.names, zip(*rows))))

    rows = df.select(F.col("conv_id").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.col("turn").cast("long").alias("turn"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(run, WINDOW_SCHEMA)


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation what its windows say: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Turns that a window repeats (its first n_context) are read once, where they were new. Streams windows in
    order, holding two digests.
    """
    out = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])

    def run(batches):
        rows = ((c, f, s, k) for b in batches for c, f, s, k in zip(*(b.column(i).to_pylist() for i in range(4))))
        done = []
        for conv, own in groupby(rows, key=lambda x: x[0]):
            n = chars = size = windows = 0
            turns, loss = hashlib.sha256(), hashlib.sha256()
            for _, formatted, spans, skip in own:
                windows, size = windows + 1, size + len(formatted)
                for role, text, _ in parse(formatted)[skip:]:
                    n += 1
                    turns.update(f"{role}\n{text}\n".encode())
                for s in spans:
                    text = unescape(formatted[s["start"] : s["end"]])
                    chars += len(text)
                    loss.update(text.encode())
            done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, windows))
            if len(done) == 1000:
                yield record_batch(out, dict(zip(out.names, zip(*done))))
                done = []
        if done:
            yield record_batch(out, dict(zip(out.names, zip(*done))))

    return windows.repartition("conv_id").sortWithinPartitions("conv_id", "window").select("conv_id", "formatted", "loss", "n_context").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")

"""Budgeted windows over chat conversations.

Template. A turn is `<|turn|>` + role + `<|body|>` + text + `<|end|>` and a newline. Inside roles and texts every
`<|` is written `<\\|`, and every `<\\` of the text gets one more backslash, so that no text can form a control
string and reading back is exact.

Windows. Turns of a conversation come in order of (turn, role, text). Prefix sums of their tokens choose spans of
whole turns: a window takes turns while the sum of the system turn, the history and the new turns keeps within
the budget. The system turn (a first turn of that role) heads every window. After it, up to `history` tokens of
the turns before the span are repeated. Each window marks the spans of text that are targets: the assistant
texts of its new turns. Repeated turns are masked, so every assistant text is a target exactly once.
A turn that alone exceeds the budget is a window of its own, uncut.

Scale. Tokens are counted row by row where rows are read, before any conversation is gathered. Then rows are dealt by
conversation and sorted inside partitions; conversations are read as a stream of rows, so one that holds a third of
all rows needs no more memory than its system turn, the window that is open and the history, and what its one task
has left to do is to join strings. Its windows leave as they close.

Defined results: null texts and roles are empty; a null id or turn is a value of its own (sorted first); repeated
rows are repeated turns; an empty table gives an empty result; a conversation without assistant turns has windows
without targets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import partitions, table

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>\n"


@dataclass(frozen=True)
class Params:
    budget: int = 1024
    history: int = 256
    tokenizer: str = "byte_bpe_50k.tiktoken"
    #: windows leave in batches of about so many characters
    batch_chars: int = 1 << 20


def escaped(text: str) -> str:
    return text.replace("<\\", "<\\\\").replace("<|", "<\\|") if "<" in text else text


def unescaped(text: str) -> str:
    return text.replace("<\\|", "<|").replace("<\\\\", "<\\") if "<\\" in text else text


@cache
def _counter(path: str, pattern: str):
    from cellweave.llm.bpe import encoder

    enc = encoder(path, pattern)
    return lambda text: len(enc.encode_ordinary(text))


def turn_text(role: str, text: str) -> tuple[str, int]:
    """The formatted turn and where its text begins in it."""
    head = f"{TURN}{escaped(role)}{BODY}"
    return f"{head}{escaped(text)}{END}", len(head)


class Windows:
    """The windows of one conversation, fed turn by turn."""

    def __init__(self, conv_id, params: Params):
        self.conv_id, self.params = conv_id, params
        self.system, self.system_size = "", 0
        self.past: list[tuple[str, int]] = []  # formatted turns that may be repeated, with tokens
        self.fresh: list[tuple[str, int, int, bool]] = []  # formatted, tokens, start of text, is target
        self.sum = self.n = self.turns = 0

    def add(self, role: str, text: str, size: int) -> Iterator[dict]:
        """size: tokens of the formatted turn."""
        formatted, start = turn_text(role, text)
        if self.turns == 0 and role == "system":
            self.system, self.system_size = formatted, size
        elif self.fresh and (self.system_size if self.n else 0) + sum(s for _, s in self.past) + self.sum + size > self.params.budget:
            yield self.close()
        if not self.fresh and self.past:
            # repeat no more than what leaves room for the new turn
            room = min(self.params.history, self.params.budget - self.system_size - size)
            while self.past and sum(s for _, s in self.past) > max(room, 0):
                self.past.pop(0)
        self.turns += 1
        self.fresh.append((formatted, size, start, role == "assistant"))
        self.sum += size

    def close(self) -> dict:
        parts, spans, at = [], [], 0
        first = self.n == 0
        if not first and self.system:
            parts.append(self.system)
            at += len(self.system)
        for text, _ in self.past:
            parts.append(text)
            at += len(text)
        repeated = at
        for text, _, start, target in self.fresh:
            if target:
                spans.append((at + start, at + len(text) - len(END)))
            parts.append(text)
            at += len(text)
        window = {"conv_id": self.conv_id, "window": self.n, "text": "".join(parts), "fresh_start": repeated, "loss": spans}
        kept, total = [], 0
        seen = self.past + [(t, s) for t, s, *_ in self.fresh[1 if first and self.system else 0 :]]
        for text, size in reversed(seen):
            if total + size > self.params.history:
                break
            kept.insert(0, (text, size))
            total += size
        self.past, self.fresh, self.sum = kept, [], 0
        self.n += 1
        return window


WINDOW_SCHEMA = "window long, text string, fresh_start long, loss array<struct<start:long,stop:long>>"
_LOSS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _sized(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path, pattern)
        for batch in batches:
            turns = zip(*(batch.column(c).to_pylist() for c in ("role", "text")))
            tokens = pa.array([count(turn_text(role, text)[0]) for role, text in turns], pa.int64())
            yield pa.record_batch([*batch.columns, tokens], names=[*batch.schema.names, "tokens"])

    return run


def _windows(params: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, held = None, [], 0

        def flush() -> pa.RecordBatch:
            return pa.record_batch(
                [
                    pa.array([w["conv_id"] for w in out], kind),
                    pa.array([w["window"] for w in out], pa.int64()),
                    pa.array([w["text"] for w in out], pa.string()),
                    pa.array([w["fresh_start"] for w in out], pa.int64()),
                    pa.array([[{"start": a, "stop": b} for a, b in w["loss"]] for w in out], _LOSS),
                ],
                names=["conv_id", "window", "text", "fresh_start", "loss"],
            )

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv_id, role, text, tokens in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "tokens"))):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        out.append(now.close())
                        held += len(out[-1]["text"])
                    now = Windows(conv_id, params)
                for w in now.add(role, text, tokens):
                    out.append(w)
                    held += len(w["text"])
                if held >= params.batch_chars:
                    yield flush()
                    out, held = [], 0
        if now is not None:
            out.append(now.close())
        if out:
            yield flush()

    return run


def windows(conversations: DataFrame, path: str, pattern: str, params: Params = Params()) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> (conv_id, window, text, fresh_start, loss).

    Windows of a conversation stay together and in order inside their partition.
    """
    rows = conversations.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    kinds = dict(rows.dtypes)
    sized = rows.mapInArrow(_sized(path, pattern), f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string, tokens long")
    dealt = sized.repartition(partitions(conversations.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text", "tokens").mapInArrow(_windows(params), f"conv_id {kinds['conv_id']}, {WINDOW_SCHEMA}")


def turns_in(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, stop) of the turns of a formatted window, unescaped; start and stop as written."""
    at = 0
    while at < len(text):
        body = text.index(BODY, at)
        start = body + len(BODY)
        stop = text.index(END, start)
        yield unescaped(text[at + len(TURN) : body]), unescaped(text[start:stop]), start, stop
        at = stop + len(END)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what windows hold: turns once each, and the text under the loss mask. Expects windows in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []

        def finish():
            conv_id, n, turns, chars, loss, total = now
            done.append((conv_id, n, turns.hexdigest(), chars, loss.hexdigest(), total))

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv_id, window, text, fresh, spans in zip(*(c.to_pylist() for c in batch.columns)):
                if window == 0:
                    if now is not None:
                        finish()
                    now = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                now[5] += len(text)
                for role, body, start, _ in turns_in(text):
                    if start >= fresh:
                        now[1] += 1
                        now[2].update(f"{role}\n{body}\n".encode())
                for span in spans:
                    target = unescaped(text[span["start"] : span["stop"]])
                    now[3] += len(target)
                    now[4].update(target.encode())
            if done:
                yield _digests(done, kind)
                done.clear()
        if now is not None:
            finish()
            yield _digests(done, kind)

    kind = dict(formatted.dtypes)["conv_id"]
    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digests(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    params = Params()
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = "</s>[INST] ok [/INST]"
    kinds = dict(rows.dtypes)
    extra = spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)], f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string")
    return read_back(windows(rows.unionByName(extra), public_tokenizers.path(params.tokenizer), public_tokenizers.PATTERN, params))

"""Chat formatting as a grammar with a round trip.

    conversation = turn*
    turn         = "[INST] " text " [/INST]"             of the user
                 | " " text " </s>"                      of the assistant (loss on text)
                 | "<<SYS>> " text " <</SYS>>"           of the system
                 | "<<ROLE>> " role "<<SAYS>> " text " <</ROLE>>"

A deterministic parser reads the turns back. Every turn is first rendered as it is; if the
parser does not give back role and text, more of it is escaped until it does: first the control
strings within the text, then, should escapes themselves be in the way, every escape character
too. An escape puts U+241B after the first character of a control string; an escape character
of the text is doubled as U+241B U+241B in a turn that is marked by U+241B behind its opening.

Turns stream through sorted partitions, one conversation after the other, so memory does not
grow with a conversation; one conversation (and all rows without conv_id) is one task, as its running digest demands.

Results: null text and null role count as empty; a null turn comes first; turns of equal number come in the order of role
and text, repeated rows stay. A null conv_id is a conversation of its own name. Texts of any length are rendered whole. An
empty table gives an empty result. Other columns are left behind, so none can clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "␛"
OPENINGS = {"user": "[INST] ", "assistant": " ", "system": "<<SYS>> "}
CLOSINGS = {"user": " [/INST]", "assistant": " </s>", "system": " <</SYS>>"}
OTHER, SAYS, END = "<<ROLE>> ", "<<SAYS>> ", " <</ROLE>>"
#: Strings that texts must not hold unescaped.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>", "<<SAYS>>"]
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile("|".join(re.escape(c[0]) + MARK + re.escape(c[1:]) for c in CONTROL))


def escape(text: str, level: int) -> str:
    """Level 0 changes nothing; 1 breaks control strings; 2 doubles escape characters as well, and says so."""
    if level == 0:
        return text
    if level == 2:
        text = text.replace(MARK, MARK + MARK)
    text = _CONTROL.sub(lambda m: m[0][0] + MARK + m[0][1:], text)
    return MARK + text if level == 2 else text


def unescape(text: str) -> str:
    if not text.startswith(MARK):
        return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)
    out, at = [], 1
    while at < len(text):
        if text.startswith(MARK, at):
            if text.startswith(MARK, at + 1):
                out.append(MARK)
                at += 1
            at += 1
            continue
        stop = text.find(MARK, at)
        stop = len(text) if stop < 0 else stop
        out.append(text[at:stop])
        at = stop
    return "".join(out)


def _written(role: str, text: str, level: int) -> str:
    if role in OPENINGS:
        return OPENINGS[role] + escape(text, level) + CLOSINGS[role]
    return OTHER + escape(role, level) + SAYS + escape(text, level) + END


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """The turns of rendered text: role, text, and the span of the written text. ValueError if it isn't one."""
    turns, at = [], 0
    while at < len(rendered):
        role = next((r for r in ("user", "system") if rendered.startswith(OPENINGS[r], at)), None)
        if role:
            start, closing = at + len(OPENINGS[role]), CLOSINGS[role]
        elif rendered.startswith(OTHER, at):
            says = rendered.find(SAYS, at + len(OTHER))
            if says < 0:
                raise ValueError("a role without text")
            role, start, closing = unescape(rendered[at + len(OTHER) : says]), says + len(SAYS), END
        elif rendered.startswith(" ", at):
            role, start, closing = "assistant", at + 1, CLOSINGS["assistant"]
        else:
            raise ValueError("no turn begins here")
        end = rendered.find(closing, start)
        if end < 0 or _CONTROL.search(rendered, start, end):
            raise ValueError("a turn does not end, or holds a control string")
        turns.append((role, unescape(rendered[start:end]), start, end))
        at = end + len(closing)
    return turns


def render(role: str | None, text: str | None) -> str:
    """One turn, escaped only as far as the parser needs to give it back."""
    role, text = role or "", text or ""
    for level in range(3):
        out = _written(role, text, level)
        try:
            turns = parse(out)
        except ValueError:
            continue
        if len(turns) == 1 and turns[0][:2] == (role, text):
            return out
    raise AssertionError("the last level always comes back")


def rendered(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, rendered: each turn formatted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [render(r, t) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=["conv_id", "turn", "role", "text", "rendered"])

    kinds = {c: turns.schema[c].dataType.simpleString() for c in ("conv_id", "turn", "role", "text")}
    return turns.select(*kinds).mapInArrow(run, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", rendered string")


class _Reader:
    """Reads a conversation's rendered turns back, keeping digests and lengths only."""

    def __init__(self) -> None:
        self.n = self.loss = self.chars = 0
        self.turns, self.assistant = hashlib.sha256(), hashlib.sha256()

    def read(self, out: str) -> None:
        self.chars += len(out)
        for role, text, _, _ in parse(out):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if role == "assistant":
                self.loss += len(text)
                self.assistant.update(text.encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.loss, self.assistant.hexdigest(), self.chars


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the rendered text alone: n_turns, digests of turns and of the text under the loss."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    n = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = formatted.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "rendered")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reader, done, like = None, None, [], None

        def flush() -> pa.RecordBatch:
            cols = list(zip(*done))
            kinds = (like, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

        for batch in batches:
            like = batch.column("conv_id").type
            for conv, out in zip(batch.column("conv_id").to_pylist(), batch.column("rendered").to_pylist()):
                if reader is None or conv != now:
                    if reader is not None:
                        done.append((now, *reader.row()))
                    now, reader = conv, _Reader()
                reader.read(out)
            if len(done) > 1000:
                yield flush()
                done = []
        if reader is not None:
            done.append((now, *reader.row()))
            yield flush()

    return rows.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def conversations(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted (whole text), loss: spans (start, end) of written assistant text, for conversations that fit a row."""
    piece = F.struct("turn", "role", "text", "rendered")
    whole = formatted.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["rendered"]), "").alias("formatted"))

    @F.pandas_udf("array<array<bigint>>")
    def loss(texts):
        return texts.map(lambda t: [[a, b] for role, _, a, b in parse(t) if role == "assistant"])

    return whole.withColumn("loss", loss("formatted"))


def report(turns: DataFrame) -> DataFrame:
    return read_back(rendered(turns))

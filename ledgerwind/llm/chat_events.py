"""Chat formatting by event-sourced reconstruction.

A log has rows (conv_id, seq, tie, part, message, kind, role, text). Within a conversation, events apply in the order of
(seq, tie, part, message):

    start       opens a message with a role and a first text
    delta       appends text to a message
    edit        replaces a message's text
    regenerate  empties a message and drops all messages opened after it

Events for a message that is not open are ignored, as those that come after it was dropped. The log is partitioned by
conversation and sorted; each task folds its sorted stream, holding one conversation's messages at a time, and renders
them. One conversation is one output row, so it is the unit that a task must hold.

The template is <s>, then each turn: `<<SYS>>\\ntext\\n<</SYS>>\\n\\n` for system, `[INST] text [/INST]` for user,
`text</s>` for assistant and `[ROLE] role [/ROLE]text[/MSG]` for any other role. Inside texts and roles a backslash is
doubled and one is put behind the first character of each control string, so none of these is ever found there.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points of one delta when rows by turn become a log, unless the text has more than DELTAS of them.
DELTA, DELTAS = 256, 64
#: What happens to a message before its final text: nothing; a draft and an edit to the whole text; a draft and an edit
#: to nothing; a draft, a message after it, and a regeneration that drops both.
WAYS = 4

CONTROL = re.compile(r"\\|</?s>|\[/?INST\]|<</?SYS>>|\[/?ROLE\]|\[/MSG\]")
ORDER = ["conv_id", "seq", "tie", "part", "message"]
Turn = tuple[str, str]


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0][0] + "\\" + (m[0][1:]), text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def render(turns: list[Turn]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans (code points, end exclusive) of the loss mask."""
    out, at, spans = ["<s>"], 3, []
    for role, text in turns:
        body = escape(text)
        head, tail = {"system": ("<<SYS>>\n", "\n<</SYS>>\n\n"), "user": ("[INST] ", " [/INST]"), "assistant": ("", "</s>")}.get(role) or (f"[ROLE] {escape(role)} [/ROLE]", "[/MSG]")
        if role == "assistant":
            spans.append((at, at + len(body)))
        out += [head, body, tail]
        at += len(head) + len(body) + len(tail)
    return "".join(out), spans


def parse(formatted: str) -> list[Turn]:
    """The turns of a formatted conversation."""
    at, turns = 3, []
    if not formatted.startswith("<s>"):
        raise ValueError("no conversation")

    def upto(tail: str) -> str:
        nonlocal at
        end = formatted.index(tail, at)
        body, at = formatted[at:end], end + len(tail)
        return unescape(body)

    while at < len(formatted):
        for role, head, tail in (("system", "<<SYS>>\n", "\n<</SYS>>\n\n"), ("user", "[INST] ", " [/INST]"), ("", "[ROLE] ", "[/MSG]"), ("assistant", "", "</s>")):
            if formatted.startswith(head, at):
                at += len(head)
                turns.append((role or upto(" [/ROLE]"), upto(tail)))
                break
    return turns


def from_turns(rows: DataFrame) -> DataFrame:
    """The log of a table of rows by turn (conv_id, turn, role, text) as a chat service would have left it.

    Each row is a message that is opened and streamed in deltas. By a hash of the row, three of four were first a draft (the
    text's first code points backwards), which was edited into the final text, or emptied by an edit and streamed again, or
    answered and then regenerated; all fold back to the rows. A null text or role counts as empty. Rows that repeat a turn
    are messages of their own, ordered by role and a hash of the text, those that agree in both by their place in the table.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = rows.select("conv_id", F.col("turn").cast("long").alias("seq"), F.coalesce(F.col("role"), F.lit("")).alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("message"))
    base = base.withColumn("tie", F.concat("role", F.lit("\x00"), F.hex(F.xxhash64("text")), F.lpad(F.hex("message"), 16, "0")))
    step = F.greatest(F.lit(DELTA), F.ceil(F.length("text") / DELTAS).cast("int"))
    starts = F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)), step)
    answer = -1 - F.col("message")  # no row's message

    def event(kind: str, text: Column, role: Column | str = "role", message: Column | str = "message") -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"), (F.col(role) if isinstance(role, str) else role).alias("role"), (F.col(message) if isinstance(message, str) else message).alias("message"))

    deltas = F.transform(starts, lambda s: event("delta", F.col("text").substr(s, step)))
    none, draft = F.lit(""), event("delta", F.reverse(F.left("text", F.lit(DELTA))))
    opened, answered = event("start", none), event("start", F.lit("draft"), F.lit("user"), answer)
    ways = [
        F.concat(F.array(opened), deltas),
        F.array(opened, draft, event("edit", F.col("text"))),
        F.concat(F.array(opened, draft, event("edit", none)), deltas),
        F.concat(F.array(opened, draft, answered, event("regenerate", none)), deltas),
    ]
    way = F.pmod(F.xxhash64("seq", "role", "text"), F.lit(WAYS))
    events = F.when(way == 0, ways[0]).when(way == 1, ways[1]).when(way == 2, ways[2]).otherwise(ways[3])
    return base.select("conv_id", "seq", "tie", F.posexplode(events).alias("part", "e")).select("conv_id", "seq", "tie", "part", "e.message", "e.kind", "e.role", "e.text")


class _Fold:
    def __init__(self) -> None:
        self.messages: dict[int, tuple[str, list[str]]] = {}  # in the order opened

    def apply(self, message: int, kind: str, role: str | None, text: str | None) -> None:
        text = text or ""
        if kind == "start":
            self.messages.setdefault(message, (role or "", [text]))
        elif message in self.messages:
            if kind == "delta":
                self.messages[message][1].append(text)
            elif kind == "edit":
                self.messages[message][1][:] = [text]
            elif kind == "regenerate":
                while next(reversed(self.messages)) != message:
                    self.messages.popitem()
                self.messages[message][1][:] = [text]

    def turns(self) -> list[Turn]:
        return [(role, "".join(parts)) for role, parts in self.messages.values()]


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(rows: list[tuple]) -> pa.RecordBatch:
        ids, texts, spans = zip(*rows, strict=True)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], span)], ["conv_id", "formatted", "loss"])

    now, fold = None, None
    for batch in batches:
        rows = []
        for conv, *event in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "message", "kind", "role", "text")), strict=True):
            if fold is None or conv != now:
                if fold is not None:
                    rows.append((now, *render(fold.turns())))
                now, fold = conv, _Fold()
            fold.apply(*event)
        if rows:
            yield out(rows)
    if fold is not None:
        yield out([(now, *render(fold.turns()))])


def format_log(log: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): one row for each conversation of a log; loss holds the spans of assistant texts.

    Rows with a null conv_id are one conversation; an empty log gives an empty result; other columns are ignored.
    """
    rows = log.select(F.col("conv_id").cast("long"), *ORDER[1:], "kind", "role", "text")
    ordered = rows.repartition("conv_id").sortWithinPartitions(*ORDER)
    return ordered.select("conv_id", "message", "kind", "role", "text").mapInArrow(_folded, "conv_id long, formatted string, loss array<struct<start:long,end:long>>")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for conv, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss")), strict=True):
            turns = parse(text)
            learnt = "".join([unescape(text[s["start"] : s["end"]]) for s in loss])
            digest = hashlib.sha256("".join([f"{r}\n{t}\n" for r, t in turns]).encode()).hexdigest()
            rows.append((conv, len(turns), digest, len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) if i else pa.array(c, pa.int64()) for i, c in enumerate(zip(*rows, strict=True))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of formatted conversations, from their text and loss mask alone."""
    return formatted.mapInArrow(_read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

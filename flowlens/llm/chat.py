"""Chat formatting from event logs.

A conversation's log holds streamed deltas, edits and regenerations. Logs are partitioned by
conversation, sorted by sequence number and folded into final messages, which are rendered
with turn marks. Control strings inside texts are escaped so that they can be read back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from flowlens.llm.shared import scratch_path

# Turn marks by role. Any other role uses OTHER, with its name on the first line.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[TURN]", "[/TURN]")

#: Kinds of events. ``start`` opens a message with a role; ``delta`` adds text to the open message;
#: ``regenerate`` throws away what was streamed so far; ``edit`` replaces the text of message ``target``
#: (counted from 0 in the conversation; null: the last one).
KINDS = ("start", "delta", "regenerate", "edit")

_CONTROLS = sorted({m for pair in [*MARKS.values(), OTHER] for m in pair}, key=len, reverse=True)
# A control string with any number of backslashes after its first character.
_ESCAPABLE = re.compile("|".join(f"{re.escape(c[0])}\\\\*{re.escape(c[1:])}" for c in _CONTROLS))
_ESCAPED = re.compile("|".join(f"{re.escape(c[0])}\\\\+{re.escape(c[1:])}" for c in _CONTROLS))


def escape(text: str) -> str:
    """One backslash more after the first character of every control string, escaped or not."""
    return _ESCAPABLE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


def render(messages: list[tuple[str, str]]) -> tuple[str, list[list[int]]]:
    """The formatted conversation and the code point spans (begin, end) of assistant texts."""
    parts, at, spans = [], 0, []
    for role, text in messages:
        begin, end = MARKS.get(role, OTHER)
        head = begin if role in MARKS else f"{begin}{escape(role).replace('%', '%25').replace(chr(10), '%0A')}\n"
        body = escape(text)
        if role == "assistant":
            spans.append([at + len(head), at + len(head) + len(body)])
        parts += [head, body, end, "\n"]
        at += len(head) + len(body) + len(end) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The messages that ``render`` was given."""
    opens = {begin: (role, end) for role, (begin, end) in [*MARKS.items(), (None, OTHER)]}
    at, found = 0, []
    while at < len(formatted):
        begin = next(b for b in opens if formatted.startswith(b, at))
        role, end = opens[begin]
        at += len(begin)
        stop = formatted.index(end, at)
        body = formatted[at:stop]
        if role is None:
            name, _, body = body.partition("\n")
            role = unescape(name.replace("%0A", "\n").replace("%25", "%"))
        found.append((role, unescape(body)))
        at = stop + len(end) + 1
    return found


def fold(events: Iterator[tuple[str, str | None, str | None, int | None]]) -> list[tuple[str, str]]:
    """Final messages from (kind, role, text, target) in sequence. Events before any message start one."""
    messages: list[list] = []
    for kind, role, text, target in events:
        if kind == "start" or not messages:
            messages.append([role or "", []])
        if kind == "regenerate":
            messages[-1][1].clear()
        elif kind == "edit":
            n = len(messages) - 1 if target is None else target
            if 0 <= n < len(messages):
                messages[n][1][:] = [text or ""]
        elif text:
            messages[-1][1].append(text)
    return [(role, "".join(parts)) for role, parts in messages]


def _fold_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows are sorted by conversation; holds one conversation at a time and a small batch of results."""
    schema = pa.schema([("conv_id", pa.int64()), ("text", pa.string()),
                        ("loss_spans", pa.list_(pa.list_(pa.int64()))), ("n_turns", pa.int64())])
    done, size, conv, events = [], 0, None, []

    def close():
        messages = fold(events)
        text, spans = render(messages)
        done.append({"conv_id": conv, "text": text, "loss_spans": spans, "n_turns": len(messages)})
        return len(text)

    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("conv_id", "kind", "role", "text", "target")]
        for next_conv, *event in zip(*columns):
            if events and next_conv != conv:
                size += close()
                events = []
                if len(done) >= 2_000 or size > 1 << 23:
                    yield pa.RecordBatch.from_pylist(done, schema)
                    done, size = [], 0
            conv = next_conv
            events.append(event)
    if events:
        close()
    yield pa.RecordBatch.from_pylist(done, schema)


def format_conversations(events: DataFrame) -> DataFrame:
    """(conv_id, text, loss_spans, n_turns), one row per conversation of ``events``.

    ``events`` has conv_id, seq (any orderable type), kind, role, text and target. Null texts are empty,
    null roles are the empty role; an event of unknown kind is a delta. Events of equal ``seq`` are taken
    in the order of kind, target, role and text. A null ``conv_id`` is a conversation of its own. An
    empty log gives no rows. Other columns are left out. ``loss_spans`` are code points of ``text`` that
    assistant texts take.
    """
    log = events.select("conv_id", "seq", "kind", "role", "text", "target")
    order = ["conv_id", "seq", "kind", "target", "role", "text"]
    return log.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(
        _fold_sorted, "conv_id long, text string, loss_spans array<array<long>>, n_turns long")


def log_of(conversations: DataFrame) -> DataFrame:
    """The event log that leads to finished ``conversations`` (conv_id, turn, role, text).

    Assistant messages are streamed line by line after a draft that is regenerated; the others are
    entered and then edited to their final text. Rows are taken by turn (null first); rows of one turn
    in the order of role and text.
    """
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = conversations.select("conv_id", place.alias("n"), "role", F.coalesce("text", F.lit("")).alias("text"))
    pieces = F.split("text", "(?<=\n)")

    def event(kind, role=None, text=None, target=None):
        return F.struct(F.lit(kind).alias("kind"), (role if role is not None else F.lit(None).cast("string")).alias("role"),
                        (text if text is not None else F.lit(None).cast("string")).alias("text"),
                        (target if target is not None else F.lit(None).cast("long")).alias("target"))

    start = F.array(event("start", role=F.col("role")))
    streamed = F.concat(start, F.array(event("delta", text=F.get(pieces, F.lit(0)))), F.array(event("regenerate")),
                        F.transform(pieces, lambda p: event("delta", text=p)))
    typed = F.concat(start, F.array(event("edit", text=F.col("text"), target=(F.col("n") - 1).cast("long"))))
    return rows.select("conv_id", "n", F.posexplode(F.when(F.col("role") == "assistant", streamed).otherwise(typed))
                       .alias("step", "e")).select("conv_id", F.struct("n", "step").alias("seq"), "e.*")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    for batch in batches:
        rows = []
        for n in range(batch.num_rows):
            conv, text, spans = (batch.column(c)[n].as_py() for c in ("conv_id", "text", "loss_spans"))
            turns = parse(text)
            loss = [unescape(text[a:b]) for a, b in spans]
            rows.append({
                "conv_id": conv, "n_turns": len(turns), "formatted_chars": len(text),
                "turns_sha256": hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                "loss_chars": sum(map(len, loss)), "loss_sha256": hashlib.sha256("".join(loss).encode()).hexdigest()})
        yield pa.RecordBatch.from_pylist(rows, schema)


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and hashes of each conversation, from its formatted text and loss spans."""
    return formatted.select("conv_id", "text", "loss_spans").mapInArrow(
        _digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                 "formatted_chars long")


def formatted_files(events: DataFrame) -> DataFrame:
    """``format_conversations`` written to the shared folder, as read back."""
    out = format_conversations(events)
    path = scratch_path(events.sparkSession, "chat")
    out.write.parquet(path)
    return events.sparkSession.read.schema(out.schema).parquet(path)

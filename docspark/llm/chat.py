"""Chat formatting by event sourcing: logs of deltas, edits and regenerations to rendered text.

A log row is an event of a message in a conversation. Events are folded per message (so a
conversation that holds a third of all rows is many groups), messages are then sorted within
their conversation and rendered one after the other by a streaming pass that holds one
conversation at a time.

Template: a conversation starts with `<s>`. An assistant turn is its text and `</s>`; any
other turn is `[INST]`, its role, a line feed, its text and `[/INST]`. Inside texts a
backslash goes before every backslash and after the first character of every control string,
so that no control string is left whole; in roles also before line feeds. A reader drops each
such backslash, which gives back the original exactly.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import record

ASSISTANT = "assistant"
_CONTROL = re.compile(r"\\|<(?=/?s>)|\[(?=/?INST\])")
_TURN = re.compile(r"\[INST\]((?:[^\\\n]|\\.)*)\n(.*?)\[/INST\]|(.*?)</s>", re.S)
_PLAIN = re.compile(r"\\(.)", re.S)


def escape(text: str, role: bool = False) -> str:
    out = _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)
    return out.replace("\n", "\\\n") if role else out


def unescape(text: str) -> str:
    return _PLAIN.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the [start, end) of assistant texts in it, in code points."""
    parts, spans, at = ["<s>"], [], 3
    for role, text in turns:
        body = escape(text)
        if role == ASSISTANT:
            spans.append((at, at + len(body)))
            parts.append(body + "</s>")
        else:
            parts.append(f"[INST]{escape(role, True)}\n{body}[/INST]")
        at += len(parts[-1])
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(ASSISTANT, unescape(m[3])) if m[3] is not None else (unescape(m[1]), unescape(m[2]))
            for m in _TURN.finditer(formatted, 3)]


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages of a log with columns conv_id, message, seq, event, role, text.

    `message` is any orderable value that names and places a message in its conversation.
    Events, by seq: `message` (starts it, or starts it anew), `edit` (its text is replaced),
    `regenerate` (its text is dropped, deltas follow), `delta` (text is appended), `delete`.
    Gives conv_id, message, role, text. The role is that of the last event that has one, and
    empty if none has; a null text counts as empty; events of equal seq go by event, role and
    text, and repeated delta rows append repeatedly. Null ids, messages and seqs are values
    like any other, nulls first. Only events from the last one that sets the text on are
    gathered, so what is gathered is the final text.
    """
    order = F.struct("seq", "event", "role", "text")
    log = events.select("conv_id", "message", "seq", F.lower("event").alias("event"), "role", "text")
    sets = F.col("event").isin("message", "edit", "regenerate", "delete")
    last = log.groupBy("conv_id", "message").agg(
        F.max(F.when(sets, order)).alias("last"),
        F.max(F.when(F.col("role").isNotNull(), F.struct("seq", "event", "role"))).alias("named"))
    last = last.select(F.col("conv_id").alias("c"), F.col("message").alias("m"), "last", F.coalesce("named.role", F.lit("")).alias("name"))
    live = log.join(last, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("message").eqNullSafe(F.col("m"))).where(
        F.col("last").isNull() | (order >= F.col("last")))
    texts = F.sort_array(F.collect_list(F.struct("seq", "event", "role", F.coalesce("text", F.lit("")).alias("text"))))
    return live.groupBy("conv_id", "message", "name").agg(
        texts.alias("parts"), F.max(F.col("last.event")).alias("kind")).where(
        ~F.coalesce(F.col("kind") == "delete", F.lit(False))).select(
        "conv_id", "message", F.col("name").alias("role"), F.array_join(F.col("parts.text"), "").alias("text"))


_CHAT = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()),
         ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]


def format_conversations(events: DataFrame) -> DataFrame:
    """Renders every conversation of an event log (see fold_events for its columns and rules).

    Gives conv_id, n_turns, formatted and loss_spans, the parts under the loss mask: assistant
    texts, in order, as [start, end) in code points. A conversation whose messages are all
    deleted has no row; an empty log gives no rows; other columns are ignored.
    """
    messages = fold_events(events.withColumn("conv_id", F.col("conv_id").cast("long")))
    rows = messages.repartition("conv_id").sortWithinPartitions("conv_id", "message").select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(conv, turns):
            formatted, spans = render(turns)
            return conv, len(turns), formatted, [{"start": a, "end": b} for a, b in spans]

        now, turns, done, size = None, [], [], 0
        for batch in batches:
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if turns and conv != now:
                    done.append(out(now, turns))
                    turns = []
                    size += len(done[-1][2])
                    if size > 8 << 20:
                        yield record(_CHAT, list(zip(*done)))
                        done, size = [], 0
                now = conv
                turns.append((role, text))
        if turns:
            done.append(out(now, turns))
        if done:
            yield record(_CHAT, list(zip(*done)))

    return rows.mapInArrow(run, "conv_id long, n_turns long, formatted string, loss_spans array<struct<start:long,end:long>>")


_READ = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
         ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]


def read_back(chats: DataFrame) -> DataFrame:
    """Digests of formatted conversations, taken from the formatted text and the loss spans alone.

    Lone surrogates, which Spark strings cannot hold, do not occur.
    """
    def run(batches):
        from hashlib import sha256

        for batch in batches:
            rows = []
            for conv, formatted, spans in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist()
                                                for c in ("conv_id", "formatted", "loss_spans"))):
                turns, h = parse(formatted), sha256()
                for role, text in turns:
                    h.update(f"{role}\n{text}\n".encode())
                loss = "".join(unescape(formatted[s["start"]:s["end"]]) for s in spans)
                rows.append((conv, len(turns), h.hexdigest(), len(loss), sha256(loss.encode()).hexdigest(), len(formatted)))
            if rows:
                yield record(_READ, list(zip(*rows)))

    return chats.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

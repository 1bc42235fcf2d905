"""Chat formatting from an event log.

Events of a conversation, in the order of their sequence numbers, build its messages: `append` starts
one, `delta` adds text to one, `edit` replaces its text, `regenerate` drops it and all after it and
starts anew. The fold keeps one open conversation at a time while it streams over rows sorted by
(conversation, sequence), so that memory is bounded by one conversation's final messages, and hands
on each as soon as it ends. A table of finished turns is read as the log of a chat that drafted, withdrew, regenerated
and streamed each of them.

Template: `<|turn:ROLE|>TEXT<|end|>` and a line feed per turn. Control strings inside a text or a role
cannot be taken for marks: every `<` becomes `<;`, which no mark begins with; the way back
turns `<;` to `<`. The loss mask is a list of [start, end) in code points of the formatted text, the
texts of assistant turns without their marks.

Defined results: null text or role is empty; a null operation is an append; deltas, edits and
regenerations of an unknown message start it; ties of sequence numbers are folded in the order of role,
then text; repeated rows are turns of their own; a very long text is held once, with its conversation;
an empty table gives an empty table; conv_id may be of any type; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

APPEND, DELTA, EDIT, REGENERATE = "append", "delta", "edit", "regenerate"
EVENTS = "conv_id bigint, seq bigint, op string, message bigint, role string, text string"
FORMATTED = "formatted string, mask array<struct<start:bigint,end:bigint>>, n_messages bigint"


def escape(text: str) -> str:
    return text.replace("<", "<;")


def unescape(text: str) -> str:
    return text.replace("<;", "<")


def escape_role(role: str) -> str:
    """Roles stand before `|>`, so a bar is written `<!`, which no mark begins with either."""
    return escape(role).replace("|", "<!")


def unescape_role(role: str) -> str:
    return role.replace("<!", "|").replace("<;", "<")


ROLE = re.compile(r"<\|turn:((?:[^<|]|<;|<!)*)\|>")


class Fold:
    """Messages of one conversation, from its events in order."""

    def __init__(self):
        self.at: dict[int, int] = {}
        self.messages: list[tuple[str, list[str]] | None] = []
        self.ids: list[int] = []

    def take(self, op: str | None, message: int, role: str | None, text: str | None) -> None:
        text, where = text or "", self.at.get(message)
        if where is None or op in (None, APPEND):
            self.at[message] = len(self.messages)
            self.messages.append((role or "", [text]))
            self.ids.append(message)
        elif op == DELTA:
            self.messages[where][1].append(text)
        elif op == EDIT:
            self.messages[where] = (self.messages[where][0] if role is None else role, [text])
        else:
            old = self.messages[where][0]
            for m in self.ids[where:]:
                self.at.pop(m, None)
            del self.messages[where:], self.ids[where:]
            self.take(APPEND, message, old if role is None else role, text)

    def turns(self) -> list[tuple[str, str]]:
        return [(role, "".join(parts)) for role, parts in self.messages]


def render(turns: Iterable[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    parts, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"<|turn:{escape_role(role)}|>", escape(text)
        if role == "assistant" and body:
            mask.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, "<|end|>\n"]
        at += len(head) + len(body) + len("<|end|>\n")
    return "".join(parts), mask


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    out, at = [], 0
    while at < len(formatted):
        head = ROLE.match(formatted, at)
        end = formatted.index("<|end|>\n", head.end())
        out.append((unescape_role(head[1]), unescape(formatted[head.end() : end])))
        at = end + len("<|end|>\n")
    return out


def events_of_turns(turns: DataFrame) -> DataFrame:
    """A log that ends in the finished turns (conv_id, turn, role, text), in the order of turn, role, text: each is appended as
    a draft, emptied by an edit, regenerated with the first half of its text, and given the rest by a delta."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    event = lambda k, op, role, said: F.struct((F.col("message") * 4 + k).alias("seq"), F.lit(op).alias("op"), "message", role.cast("string").alias("role"), said.alias("text"))
    log = F.array(
        event(0, APPEND, F.col("role"), F.substring(text, 1, 8)), event(1, EDIT, F.lit(None), F.lit("")), event(2, REGENERATE, F.lit(None), F.substring(text, F.lit(1), half)),
        event(3, DELTA, F.lit(None), F.substring(text, half + 1, F.length(text))),
    )
    return turns.select("conv_id", "role", "text", place.alias("message")).select("conv_id", F.explode(log).alias("e")).select("conv_id", "e.*")


def format_events(events: DataFrame, together: bool = False) -> DataFrame:
    """One row a conversation: conv_id, formatted, mask, n_messages.

    The rows of a conversation meet in one partition, spread by a hash, unless they are `together` already; the sort
    spills where it must.
    """
    kind = events.schema["conv_id"].dataType.simpleString()
    cols = ["conv_id", "seq", "op", "message", "role", "text"]
    dealt = events.select(*cols)
    dealt = (dealt if together else dealt.repartition("conv_id")).sortWithinPartitions("conv_id", "seq", "message", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, open_id, started, id_type = Fold(), None, False, pa.int64()
        ready: list[tuple] = []

        def close() -> None:
            text, mask = render(fold.turns())
            ready.append((open_id, text, [{"start": a, "end": b} for a, b in mask], len(fold.messages)))

        def out() -> pa.RecordBatch:
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            cols = [pa.array([r[k] for r in ready], t) for k, t in enumerate((id_type, pa.string(), kind, pa.int64()))]
            ready.clear()
            return pa.RecordBatch.from_arrays(cols, ["conv_id", "formatted", "mask", "n_messages"])

        for b in batches:
            id_type = b.schema.field("conv_id").type
            for conv, op, message, role, text in zip(*(b.column(k).to_pylist() for k in ("conv_id", "op", "message", "role", "text")), strict=True):
                if not started or conv != open_id:
                    if started:
                        close()
                    fold, open_id, started = Fold(), conv, True
                fold.take(op, message, role, text)
            if ready:
                yield out()
        if started:
            close()
        if ready:
            yield out()

    return dealt.mapInArrow(run, f"conv_id {kind}, {FORMATTED}")


DIGESTS = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted texts and masks say, parsed from them alone."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, mask in zip(*(b.column(k).to_pylist() for k in ("formatted", "mask")), strict=True):
                turns, digest = parse(text), hashlib.sha256()
                for role, said in turns:
                    digest.update(f"{role}\n{said}\n".encode())
                loss = [unescape(text[m["start"] : m["end"]]) for m in mask]
                rows.append((len(turns), digest.hexdigest(), sum(map(len, loss)), hashlib.sha256("".join(loss).encode()).hexdigest(), len(text)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], ["conv_id", *(x.split()[0] for x in DIGESTS.split(", "))])

    return formatted.mapInArrow(run, f"conv_id {kind}, {DIGESTS}")


def op5_chat_format(spark, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(format_events(events_of_turns(turns), together=True))


ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
whole AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         sum(length(text) + length(role) + 17 + length(text) - length(replace(text, '<', ''))
             + length(role) - length(replace(replace(role, '|', ''), '<', ''))) AS formatted_chars
  FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
       formatted_chars::BIGINT AS formatted_chars
FROM whole
"""

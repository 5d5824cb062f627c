"""Chat formatting with a black-box template: turns are located by rendering successive prefixes of a conversation.

``locate`` knows nothing of the template but its output. A turn's span is what its prefix's rendering adds to the one before; a
rendering that does not begin with the one before rewrites history, which is reported.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import batch, tidy

Message = tuple[str, str]

# The control strings of the template.
TAGS = {"user": "INST", "assistant": "ASST", "system": "SYS"}
OPEN, CLOSE = "<s>", "</s>"
_CONTROL = re.compile(r"<(?=/?s>)|\[(?=/?(?:INST|ASST|SYS|ROLE))")
_ROLES = {v: k for k, v in TAGS.items()}
_TURN = re.compile(r"<s>\[(INST|ASST|SYS|ROLE)(?:=([^\]]*))?\] (.*) \[/\1\]</s>\n", re.S)


def escape(text: str) -> str:
    """Backslashes are doubled, and one goes behind the first character of a control string."""
    return _CONTROL.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


@functools.lru_cache(maxsize=1024)
def _turn(role: str, text: str) -> str:
    tag = TAGS.get(role, "ROLE")
    return f"{OPEN}[{tag}{'' if role in TAGS else '=' + quote(role, safe='')}] {escape(text)} [/{tag}]{CLOSE}\n"


def template(messages: list[Message]) -> str:
    """The default template: each turn between markers of its role; roles other than user, assistant and system are named."""
    return "".join([_turn(*m) for m in messages])


def locate(messages: list[Message], render: Callable[[list[Message]], str]) -> tuple[str, list[tuple[int, int]], bool]:
    """The rendering, the span of each turn, and whether the template rewrote history (spans then begin where outputs part).

    Every prefix of the conversation is rendered, whatever the template and the number of turns.
    """
    last, spans, rewrites = "", [], False
    for k in range(1, len(messages) + 1):
        now = render(messages[:k])
        start = len(last)
        if not now.startswith(last):
            rewrites = True
            start = next((i for i, (x, y) in enumerate(zip(last, now, strict=False)) if x != y), min(len(last), len(now)))
        spans.append((start, len(now)))
        last = now
    return last, spans, rewrites


def read_back(text: str, spans: list[tuple[int, int]]) -> tuple[list[Message], list[tuple[int, int]]]:
    """Roles and texts from the formatted text alone, and the loss mask: the spans of the assistants' (escaped) texts."""
    turns, mask = [], []
    for a, z in spans:
        m = _TURN.fullmatch(text, a, z)
        if m is None:
            raise ValueError("a span is no turn of the template")
        role = _ROLES[m[1]] if m[1] in _ROLES else unquote(m[2] or "")
        turns.append((role, unescape(m[3])))
        if role == "assistant":
            mask.append(m.span(3))
    return turns, mask


def _conversations(batches):
    """(conv_id, messages) of rows (conv_id, role, text) that come sorted."""
    key, messages, any_ = None, [], False
    for b in batches:
        for conv, role, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            if any_ and conv != key:
                yield key, messages
                messages = []
            key, any_ = conv, True
            messages.append((role, text))
    if any_:
        yield key, messages


def _dealt(conversations: DataFrame) -> DataFrame:
    rows = conversations.select("conv_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "turn")
    return rows.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text").select("conv_id", "role", "text")


def format_conversations(conversations: DataFrame, render: Callable[[list[Message]], str] = template) -> DataFrame:
    """conv_id, formatted text, turn spans, loss mask (spans) and rewrites of each conversation (conv_id, turn, role, text).

    Turns come in order of turn, role and text, null turns first; null roles and texts are empty; rows of a null conv_id are one
    conversation; repeated rows are turns of their own; an empty table gives no rows. The mask needs the default template's
    markers and is null for a template that rewrites history.
    """
    spans_type = pa.list_(pa.list_(pa.int64()))

    def run(batches):
        for conv, messages in _conversations(batches):
            text, spans, rewrites = locate(messages, render)
            mask = None if rewrites or render is not template else [list(x) for x in read_back(text, spans)[1]]
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([text]), pa.array([[list(x) for x in spans]], spans_type), pa.array([mask], spans_type), pa.array([rewrites])], ["conv_id", "formatted", "spans", "loss_mask", "rewrites"])

    return _dealt(conversations.withColumn("conv_id", F.col("conv_id").cast("long"))).mapInArrow(tidy(run), "conv_id long, formatted string, spans array<array<long>>, loss_mask array<array<long>>, rewrites boolean")


def digest(conversations: DataFrame) -> DataFrame:
    """What can be read back from the formatted text of each conversation."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("rewrites_history", pa.bool_())])

    def row(conv, messages):
        text, spans, rewrites = locate(messages, template)
        turns, mask = read_back(text, spans)
        loss = "".join(unescape(text[a:z]) for a, z in mask)
        said = hashlib.sha256()
        for role, x in turns:
            said.update(f"{role}\n{x}\n".encode())
        return conv, len(turns), said.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text), rewrites

    def run(batches):
        rows = []
        for conv, messages in _conversations(batches):
            rows.append(row(conv, messages))
            if len(rows) == 4096:
                yield batch(dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True)), schema)
                rows = []
        if rows:
            yield batch(dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True)), schema)

    return _dealt(conversations.withColumn("conv_id", F.col("conv_id").cast("long"))).mapInArrow(tidy(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean")


def with_control_strings(conversations: DataFrame) -> DataFrame:
    """The conversations plus number -1, whose texts look like markers; rows that have this number already are turns of it too."""
    spark = conversations.sparkSession
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").cast("int").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("int").alias("turn"), "role", "text").unionByName(extra)

"""Chat formatting with a grammar round trip.

Turns are rendered by a template, and the rendered text is read again by a deterministic parser of the template's grammar. Where
the turns so recovered are not those that went in, the text's control strings are escaped and it is rendered again,
until both agree. Only texts that need it are escaped.

    conversation = turn*
    turn         = "<s>[INST] " text " [/INST]"          user
                 | " " text " </s>"                      assistant, the text (alone) is under the loss mask
                 | "<s>[ROLE " text "] " text " [/ROLE]"   any other role
    text         = (ESC any | other)*                    without a control string that is not escaped

Conversations are sorted by turn and streamed: a task holds one turn at a time, so a conversation of any length fits. All
digests are of what the parser gives back.

Defined results: null texts and roles are empty; rows of one turn number go by role, then text; a null conv_id is a conversation of
its own; an empty table leaves the conversations that the caller adds. Further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmill.llm.common import load

ESC = "\\"
_CONTROL = re.compile(r"</?s>|\[/?INST\]|\[/?ROLE|\\")
_PIECE = re.compile(r"\\(?s:.)|</?s>|\[INST\]|\[/INST\]|\[ROLE|\[/ROLE\]?|\]|\\\Z")
HEAD, FOOT = {"user": "<s>[INST] ", "assistant": " "}, {"user": " [/INST]", "assistant": " </s>"}


class Conflict(ValueError):
    """Rendered text that the grammar does not produce."""


def escape(text: str, also: str = "") -> str:
    """text with ESC before each control string, each ESC and each character of also."""
    out = _CONTROL.sub(lambda m: ESC + m.group(), text)
    for c in also:
        out = out.replace(c, ESC + c)
    return out


def unescape(text: str) -> str:
    return re.sub(r"\\((?s:.))", r"\1", text)


def render(role: str, text: str, escaped: bool) -> str:
    body = escape(text) if escaped else text
    if role in HEAD:
        return HEAD[role] + body + FOOT[role]
    return f"<s>[ROLE {escape(role, ']') if escaped else role}] {body} [/ROLE]"


def _until(s: str, at: int, stop: str) -> int:
    """Where the first control string that is not escaped begins; it must be stop. "]" counts inside a role's name alone."""
    while m := _PIECE.search(s, at):
        piece = m.group()
        if piece[0] == ESC:
            if len(piece) < 2:
                raise Conflict("an escape at the end")
        elif piece == stop:
            return m.start()
        elif piece != "]":
            raise Conflict(f"{piece} where {stop} belongs")
        at = m.end()
    raise Conflict(f"no {stop}")


def parse(s: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end are the place of its escaped text."""
    out, at = [], 0
    while at < len(s):
        if s.startswith("<s>[INST] ", at):
            role, start, stop, lead = "user", at + 10, "[/INST]", 1
        elif s.startswith("<s>[ROLE ", at):
            end = _until(s, at + 9, "]")
            role, start, stop, lead = unescape(s[at + 9 : end]), end + 2, "[/ROLE]", 1
            if s[end : end + 2] != "] ":
                raise Conflict("a role without its end")
        elif s.startswith(" ", at):
            role, start, stop, lead = "assistant", at + 1, "</s>", 1
        else:
            raise Conflict(f"no turn begins at {at}")
        end = _until(s, start, stop)
        if end - lead < start or s[end - lead : end] != " ":
            raise Conflict("a text without its end")
        out.append((role, unescape(s[start : end - lead]), start, end - lead))
        at = end + len(stop)
    return out


def settle(role: str, text: str) -> tuple[str, tuple[str, str, int, int]]:
    """A turn's rendering whose parse is the turn, and that parse."""
    for escaped in (False, True):
        s = render(role, text, escaped)
        try:
            got = parse(s)
        except Conflict:
            continue
        if len(got) == 1 and got[0][:2] == (role, text):
            return s, got[0]
    raise Conflict(f"a turn of {len(text)} characters that no escaping settles")


def turns_in_order(turns: DataFrame) -> DataFrame:
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    return turns.select("conv_id", "turn", *text).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def rendered(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, formatted, loss_start, loss_end (within formatted; null for all but assistants), in conversation order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [settle(r, t) for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            mask = [(x[2], x[3]) if x[0] == "assistant" else (None, None) for _, x in done]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([s for s, _ in done], pa.string()), *(pa.array([m[k] for m in mask], pa.int64()) for k in (0, 1))], names=["conv_id", "turn", "role", "formatted", "loss_start", "loss_end"])

    ordered = turns_in_order(turns)
    kinds = {f.name: f.dataType.simpleString() for f in ordered.schema}
    return ordered.mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, formatted string, loss_start long, loss_end long")


def digests(formatted: DataFrame) -> DataFrame:
    """A row for each conversation, read back from rows of rendered(), which must come in its order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        conv, n, chars, loss, every, masked = none, 0, 0, 0, None, None
        done: list[tuple] = []

        def batch() -> pa.RecordBatch:
            cols = [[r[k] for r in done] for k in range(6)]
            kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for b in batches:
            kind = b.schema.field(0).type
            for c, s, start, end in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if c != conv or conv is none:
                    if conv is not none:
                        done.append((conv, n, every.hexdigest(), loss, masked.hexdigest(), chars))
                    conv, n, chars, loss, every, masked = c, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                for role, text, _, _ in parse(s):
                    n += 1
                    every.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if start is not None:
                    under = unescape(s[start:end])
                    loss += len(under)
                    masked.update(under.encode("utf-8", "surrogatepass"))
                chars += len(s)
            if len(done) >= 1000:
                yield batch()
        if conv is not none:
            done.append((conv, n, every.hexdigest(), loss, masked.hexdigest(), chars))
            yield batch()

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    hard = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return digests(rendered(turns.unionByName(hard)))


#: formatted_chars as SQL: the template's own characters, and an escape for each control string in texts that have one.
CONTROL_SQL = r"</?s>|\[/?INST\]|\[/?ROLE|\\"
OP7_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(text) + len(regexp_extract_all(text, '{CONTROL_SQL}')) + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 6 ELSE 19 + length(role) END) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""

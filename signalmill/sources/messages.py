"""Requests as messages: decoding with quarantine, envelopes for results, model answers that are almost JSON."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from signalmill.functions import fixed as X

REQUEST = "event_type string, job_id string, group_id string, sender_id string, payload struct<sprint: struct<name: string, goal: string, start_date: string, end_date: string>, files: array<struct<object_key: string, size: long>>, additional_context: string>"
WORK = "user_id string, prompts string, local_date string, additional_context string, constraints string, user_personality string"


def decode(df: DataFrame, body: str, schema: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with the decoded struct `msg`, quarantined rows): bodies that are no JSON or miss a required field are kept, not lost."""
    parsed = df.withColumn("msg", F.from_json(body, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    ok = F.col("msg").isNotNull() & F.col("msg._bad").isNull()
    for c in required:
        ok = ok & F.col(f"msg.{c}").isNotNull()
    ok = F.coalesce(ok, F.lit(False))
    return parsed.where(ok), parsed.where(~ok).drop("msg")


def envelope(kind: str, status: str, error: Column | None = None) -> Column:
    """Result message of a job (columns job_id, group_id, sender_id, sprint, tasks) as JSON without null fields."""
    payload = F.struct(F.lit(status).alias("status"), "sprint", "tasks", (F.lit(None).cast("string") if error is None else error).alias("error"))
    return F.to_json(F.struct(F.lit(kind).alias("event_type"), "job_id", "group_id", "sender_id", payload.alias("payload")), {"ignoreNullFields": "true"})


def failure_notice() -> Column:
    """Notice to the sender of a job that failed (columns sender_id, group_id), without null fields; it asks for a mail."""
    t = X.PLAN_FAILED
    payload = F.struct(F.lit(t["title"]).alias("title"), F.lit(t["message"]).alias("message"), F.col("group_id").alias("correlation_id"), F.lit(t["correlation_type"]).alias("correlation_type"), F.lit(t["link"]).alias("link"))
    return F.to_json(F.struct(F.lit(t["event_type"]).alias("event_type"), F.lit(t["sender_id"]).alias("sender_id"), F.array("sender_id").alias("receiver_ids"), payload.alias("payload"), F.struct(F.lit(True).alias("is_send_mail")).alias("metadata")), {"ignoreNullFields": "true"})


def work_notice(link: Column) -> Column:
    """Notice to a user whose work items could not be made (columns user_id, message_id), with a link to their day; null fields stay."""
    t = X.WORK_FAILED
    one = F.struct(
        F.lit(None).cast("string").alias("id"), F.lit(t["title"]).alias("title"), F.lit(t["message"]).alias("message"), link.alias("link"), F.lit(t["sender_id"]).alias("sender_id"),
        F.array("user_id").alias("receiver_ids"), F.lit("").alias("img_url"), F.col("message_id").alias("correlation_id"), F.lit(t["correlation_type"]).alias("correlation_type"),
    )
    return F.to_json(one, {"ignoreNullFields": "false"})


def work_messages(works: DataFrame, by: list[str] | None = None) -> DataFrame:
    """headers (user_id, message_id) and body for each request: its work items as one JSON array, in order of place. works: of work_items()."""
    by = by or ["user_id", "message_id"]
    one = F.struct("place", F.struct(*WORK_FIELDS).alias("w"))
    body = F.to_json(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["w"]), {"ignoreNullFields": "false"})  # the items of one answer
    return works.groupBy(*by).agg(body.alias("body")).select(F.struct(*by).alias("headers"), "body")


def fenced(c: Column) -> Column:
    """The first fenced block of a model's answer, else the answer."""
    block = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return F.when(block != "", block).otherwise(F.trim(c))


_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|["\[\]{}]', re.DOTALL)
_BRACKET = re.compile(r"[{\[]")
_DECODER = json.JSONDecoder(strict=False)
#: Lists and objects nested deeper than that are no value.
DEPTH = 1000


def _decoded(text: str, at: int) -> tuple[bool, object, int]:
    """(whether a JSON value starts at a place, the value, where it is broken if not)."""
    try:
        return True, _DECODER.raw_decode(text, at)[0], at
    except json.JSONDecodeError as e:
        return False, None, e.pos
    except RecursionError:
        return False, None, at + 1


def first_value(text: str) -> tuple[bool, object]:
    """(whether there is one, the first JSON list or object that starts at a bracket of a text).

    A scan with a stack of open brackets finds what each closes with, so one that nothing closes is never tried. Where a value breaks off at
    some place, all that are open there break off at it too and are passed over; brackets inside strings are tried by themselves.
    """
    m = _BRACKET.search(text)
    while m:
        start, stack, closed, inside, loose, last = m.start(), [], {}, [], None, 0
        for token in _TOKEN.finditer(text, start):
            t, at = token.group(), token.start()
            if t in ("[", "{"):
                stack.append([at, 1])
            elif t in ("]", "}"):
                opened, depth = stack.pop()
                closed[opened] = at if depth <= DEPTH else -1
                if not stack:
                    last = at
                    break
                stack[-1][1] = max(stack[-1][1], depth + 1)
            elif t == '"':
                loose = at
                break
            else:
                inside += [at + k.start() for k in _BRACKET.finditer(t)]
        broken = start
        for at in sorted([*closed, *inside]):
            if at < broken < closed.get(at, -1) or closed.get(at) == -1:
                continue  # open where another broke off, or too deep
            found, value, end = _decoded(text, at)
            if found:
                return True, value
            if at in closed:
                broken = max(broken, end)
        if loose is not None:
            m = _BRACKET.search(text, loose)
        elif stack:
            return False, None
        else:
            m = _BRACKET.search(text, last + 1)
    return False, None


def repaired(text: str | None) -> str | None:
    """First JSON value in a text as JSON: fenced blocks first; curly quotes, trailing commas and raw line ends in strings are mended."""
    if not text:
        return None
    for part in [*re.findall(r"(?s)```(?:json)?\s*(.*?)\s*```", text), text]:
        for mended in (part, re.sub(r",\s*([}\]])", r"\1", part.translate({0x201C: '"', 0x201D: '"', 0x2018: "'", 0x2019: "'"}))):
            found, value = first_value(mended)
            if found:
                return json.dumps(value, ensure_ascii=False)
    return None


def repaired_json(c: Column | str) -> Column:
    """repaired() over a column, in Arrow batches."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(repaired)

    return F.pandas_udf(run, StringType(), F.PandasUDFType.SCALAR)(c)


def listed(c: Column, element: str) -> Column:
    """Array of element structs from JSON that is a list or holds one as tasks, items, merged_items or clusters."""
    whole = F.from_json(c, f"array<{element}>")
    inner = [F.from_json(F.get_json_object(c, f"$.{k}"), f"array<{element}>") for k in ("tasks", "items", "merged_items", "clusters")]
    return F.when(F.ltrim(c).startswith("["), whole).otherwise(F.coalesce(*inner))


WORK_FIELDS = ("name", "short_descriptions", "detailed_description", "start_date", "end_date", "difficulty_key", "priority_key", "category_key", "sub_tasks")


def work_items(df: DataFrame, answer: str = "answer") -> DataFrame:
    """A row for each work item of an answer, with its place; start and end are the local date and a time. The columns of df stay but for the answer."""
    one = "struct<name: string, short_descriptions: string, detailed_description: string, start_date: string, end_date: string, difficulty: string, priority: string, category: string, sub_tasks: array<string>>"
    each = df.select("*", F.posexplode(F.from_json(fenced(F.col(answer)), f"array<{one}>")).alias("place", "w"))
    at = lambda c: F.concat_ws(" ", "local_date", F.col(f"w.{c}")).alias(c)
    return each.select(
        *(c for c in df.columns if c not in (answer, "local_date")), "place", "w.name", "w.short_descriptions", F.coalesce("w.detailed_description", F.lit("")).alias("detailed_description"), at("start_date"), at("end_date"),
        F.col("w.difficulty").alias("difficulty_key"), F.col("w.priority").alias("priority_key"), F.col("w.category").alias("category_key"), F.coalesce("w.sub_tasks", F.array().cast("array<string>")).alias("sub_tasks"),
    )

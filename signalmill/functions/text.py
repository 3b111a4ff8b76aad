"""Title, endpoint and token algebra as Column expressions. Everything runs in the JVM inside code generation."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from signalmill.functions import fixed as X


def sub(c: Column, *rules: tuple[str, str]) -> Column:
    return reduce(lambda x, r: F.regexp_replace(x, *r), rules, c)


def let(c: Column, body) -> Column:
    """body(c) with c worked out once, however often the body uses it."""
    return F.element_at(F.transform(F.array(c), body), 1)


def strip(c: Column, characters: str = " \t\n\r\x0b\x0c") -> Column:
    return F.btrim(c, F.lit(characters))


def squash(c: Column) -> Column:
    """White space as single blanks, none at the ends."""
    return F.trim(sub(c, (r"\s+", " ")))


def key(c: Column) -> Column:
    return F.lower(squash(F.coalesce(c, F.lit(""))))


#: From so many values on, a list is one pattern: a plan then holds one literal for it, not one for each value.
LISTED = 12


def among(c: Column, values: tuple[str, ...]) -> Column:
    if len(values) < LISTED:
        return c.isin(*values)
    return c.rlike("^(?:" + "|".join(map(re.escape, values)) + r")\z")


def contains_any(c: Column, values: tuple[str, ...]) -> Column:
    return c.rlike("|".join(map(re.escape, values)))


def starts_with_any(c: Column, values: tuple[str, ...]) -> Column:
    return c.rlike("^(?:" + "|".join(map(re.escape, values)) + ")")


def letters(c: Column) -> Column:
    """Runs of letters of any script, lower-cased."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"(\p{L}+)"), 1), F.lower)


def split_identifier(c: Column) -> Column:
    return sub(c, ("_", " "), (r"([a-z0-9])([A-Z])", "$1 $2"), (r"([A-Z]+)([A-Z][a-z])", "$1 $2"))


def numbering(c: Column) -> Column:
    return sub(c, (r"^\d+(?:\.\d+)*\s*", ""))


def phrased(c: Column) -> Column:
    """Known phrases made canonical, one rule after another. Nearly no title holds any, which one look without word boundaries tells."""
    rules = [(rf"(?U)\b{re.escape(a)}\b", b) for a, b in X.PHRASES if a != b]
    return let(c, lambda v: F.when(contains_any(v, tuple(a for a, b in X.PHRASES if a != b)), sub(v, *rules)).otherwise(v))


def title(c: Column) -> Column:
    """Extraction's title: marks and numbering gone, identifiers split, phrases made canonical, noise dropped, known words upper-cased."""
    v = sub(strip(F.coalesce(c, F.lit(""))), (r"\\([_-])", "$1"), (r"[`*_~]+", ""))
    v = F.lower(strip(sub(split_identifier(numbering(v)), (r"\s+", " ")), " .:-"))
    words = F.filter(F.split(squash(phrased(v)), " "), lambda w: (w != "") & ~among(w, X.NOISE_TOKENS))
    return F.array_join(F.transform(words, lambda w: F.when(among(w, X.VOCABULARY), F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))), " ")


def _token_ok(w: Column) -> Column:
    return among(w, X.VOCABULARY) | (~among(w, X.NOISE_TOKENS) & (F.length(w) >= 3))


def valid_title(c: Column) -> Column:
    """Whether extraction keeps a title: letters only count, one word must mean something, nothing ends in "for" and a fragment."""

    def judged(words: Column) -> Column:
        last = F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit(""))
        orphan = (F.size(words) > 1) & (F.coalesce(F.try_element_at(words, F.lit(-2)), F.lit("")) == "for") & ((F.length(last) <= 2) | ~_token_ok(last))
        good = F.forall(words, lambda w: among(w, X.SMALL_WORDS) | _token_ok(w) | (F.length(w) <= 2))
        meaning = F.exists(words, lambda w: ~among(w, X.SMALL_WORDS) & _token_ok(w) & (among(w, X.VOCABULARY) | (F.length(w) >= 4)))
        return ~orphan & good & meaning

    return let(letters(title(c)), judged)


def merge_title(c: Column) -> Column:
    """Reconciliation's title; its case stays."""
    v = sub(strip(F.coalesce(c, F.lit(""))), (r"[`*_~]+", ""), (r"\\([.-])", "$1"), (r"(?U)^[^\w]+", ""))
    return strip(sub(numbering(v), (r"\s+", " ")), " .:-")


def merge_valid(c: Column) -> Column:
    """Reconciliation's stricter test of a title."""

    def worded(words: Column) -> Column:
        last = F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit(""))
        orphan = (F.size(words) > 1) & (F.coalesce(F.try_element_at(words, F.lit(-2)), F.lit("")) == "for") & ((F.length(last) <= 2) | ~among(last, X.MERGE_VOCABULARY))
        good = F.forall(words, lambda w: among(w, X.SMALL_WORDS) | among(w, X.MERGE_VOCABULARY) | (F.length(w) >= 3))
        meaning = F.exists(words, lambda w: ~among(w, X.SMALL_WORDS) & (among(w, X.MERGE_VOCABULARY) | (F.length(w) >= 4)))
        return ~orphan & good & meaning

    def judged(v: Column) -> Column:
        clean = let(F.lower(v), lambda k: ~among(k, X.MERGE_NOISE_EXACT) & ~contains_any(k, X.MERGE_NOISE))
        return (v != "") & clean & let(letters(v), worded)

    return let(merge_title(c), judged)


def item_title_valid(kind: Column, c: Column) -> Column:
    shaped = let(merge_title(c), lambda v: v.rlike("(?i)" + X.API_TITLE_STRICT) | v.rlike(X.ENDPOINT_TITLE))
    return F.when(kind == "api", shaped).otherwise(merge_valid(c))


def endpoint(c: Column) -> Column:
    """Extraction's endpoint: one pass of each rule, so it is not idempotent."""
    return sub(strip(F.coalesce(c, F.lit(""))), (r"\\", "_"), (r"\{([^{}]+)id\}", "{$1_id}"), (r"/{2,}", "/"))


def _path(c: Column, parameter) -> Column:
    v = sub(F.lower(F.trim(F.coalesce(c, F.lit("")))), (r"/{2,}", "/"), (r"^([^/])", "/$1"), *((p + "(.)", "/$1") for p in (r"^/api(?:/v\d+)?/ts/", r"^/api(?:/v\d+)?/", r"^/v\d+/")))
    parts = F.transform(F.filter(F.split(v, "/"), lambda s: s != ""), lambda s: F.when(s.rlike(X.PARAMETER_SEGMENT), parameter(s)).otherwise(s))
    return F.when(F.trim(F.coalesce(c, F.lit(""))) == "", "").otherwise(F.concat(F.lit("/"), F.array_join(parts, "/")))


def endpoint_identity(c: Column) -> Column:
    """Path without transport prefixes, every parameter {}."""
    return _path(c, lambda s: F.lit("{}"))


def endpoint_display(c: Column) -> Column:
    """The same with parameters {name}."""

    def named(s: Column) -> Column:
        name = strip(sub(s, (r"^[{:<*]+|[}>]+$", ""), (r"[^a-z0-9_]+", "_"), ("_+", "_")), "_")
        return F.concat(F.lit("{"), F.when(name == "", "id").otherwise(name), F.lit("}"))

    return _path(c, named)


def method_of(name: Column, description: Column) -> Column:
    """Method of an API item: from its title, else its signature line, else none."""
    flags = "(?i)"
    from_title = F.regexp_extract(F.trim(name), flags + X.API_TITLE, 1)
    return F.upper(F.when(from_title != "", from_title).otherwise(F.regexp_extract(F.coalesce(description, F.lit("")), flags + X.API_SIGNATURE_LINE, 1)))


def endpoint_of(name: Column, description: Column) -> Column:
    flags, name = "(?i)", F.trim(name)
    from_title = F.regexp_extract(name, flags + X.API_TITLE, 2)
    from_text = F.regexp_extract(F.coalesce(description, F.lit("")), flags + X.API_SIGNATURE_LINE, 2)
    tail = F.regexp_extract(name, r"(/\S+)$", 1)
    return F.when(from_title != "", from_title).when(from_text != "", from_text).when(tail != "", tail).otherwise(name)


def signature(name: Column, description: Column) -> Column:
    return F.trim(F.concat(method_of(name, description), F.lit(" "), endpoint_identity(endpoint_of(name, description))))


def api_title(c: Column) -> Column:
    """An API's display title: METHOD and path, or a path alone; other titles are merge titles."""
    v = F.trim(c)
    plain = merge_title(c)
    parsed = F.concat(F.upper(F.regexp_extract(v, "(?i)" + X.API_TITLE, 1)), F.lit(" "), endpoint_display(F.regexp_extract(v, "(?i)" + X.API_TITLE, 2)))
    return F.when(v.rlike("(?i)" + X.API_TITLE), parsed).when(plain.rlike(X.ENDPOINT_TITLE), endpoint_display(plain)).otherwise(plain)


def api_identity(c: Column) -> Column:
    v = F.trim(c)
    method, path = (F.regexp_extract(v, "(?i)" + X.API_TITLE, k) for k in (1, 2))
    return F.lower(F.when(v.rlike("(?i)" + X.API_TITLE), F.concat(F.upper(method), F.lit(" "), endpoint_identity(path))).otherwise(endpoint_identity(c)))


def phrase(c: Column) -> Column:
    """Linking's phrase: lower-cased, white space as single blanks."""
    return F.lower(squash(F.coalesce(c, F.lit(""))))


def tokens(c: Column, pattern: str = r"(?U)\w+") -> Column:
    """Distinct tokens of two characters or more, in order."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"({pattern})"), 1), lambda t: F.length(t) > 1))


def task_text(c: Column) -> Column:
    return squash(sub(F.lower(F.coalesce(c, F.lit(""))), (r"(?U)[^\w/{}\s-]+", " ")))


def inferred_method(c: Column) -> Column:
    """Method of the first hint, in their order, that a text holds; null without one."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.coalesce(*(F.when(contains_any(low, words), method) for method, words in X.METHOD_HINTS))


def source_type(name: Column) -> Column:
    """Design, Planning or Requirement by the file's name; null for others."""
    stem = F.lower(sub(name, (r"^.*/", ""), (r"\.[^.]+$", "")))
    return F.coalesce(*(F.when(stem.startswith(t.lower()), t) for t in ("Design", "Planning", "Requirement")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def rank_of(c: Column, order: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.when(c == v, k) for k, v in enumerate(order)), F.lit(len(order)))

"""Pieces of DuckDB SQL that the catalog's comparisons are put together from."""

from __future__ import annotations

from signalmill.functions import fixed as X


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def array(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(map(q, values)) + "]"


def any_of(c: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({c}, {q(w)})" for w in words) + ")"


def starts_of(c: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"starts_with({c}, {q(w)})" for w in words) + ")"


def sub(c: str, *rules: tuple[str, str]) -> str:
    for a, b in rules:
        c = f"regexp_replace({c}, {q(a)}, {q(b)}, 'g')"
    return c


def squash(c: str) -> str:
    return f"trim({sub(c, (r'\s+', ' '))})"


def distinct_in_order(lst: str) -> str:
    return f"list_filter({lst}, lambda x, i: list_position({lst}, x) = i)"


def split_identifier(c: str) -> str:
    return sub(c, ("_", " "), (r"([a-z0-9])([A-Z])", r"\1 \2"), (r"([A-Z]+)([A-Z][a-z])", r"\1 \2"))


def title(c: str) -> str:
    v = sub(f"trim({c})", (r"\\([_-])", r"\1"), (r"[`*_~]+", ""), (r"^\d+(?:\.\d+)*\s*", ""))
    v = f"lower(trim({sub(split_identifier(v), (r'\s+', ' '))}, ' .:-'))"
    v = sub(v, *((rf"\b{a}\b", b) for a, b in X.PHRASES))
    words = f"list_filter(string_split({squash(v)}, ' '), lambda w: w <> '' AND NOT list_contains({array(X.NOISE_TOKENS)}, w))"
    return f"array_to_string(list_transform({words}, lambda w: CASE WHEN list_contains({array(X.VOCABULARY)}, w) THEN upper(w) ELSE concat(upper(left(w, 1)), substr(w, 2)) END), ' ')"


def _letters(c: str) -> str:
    return f"list_transform(regexp_extract_all({c}, '\\p{{L}}+'), lambda w: lower(w))"


def valid_title(c: str) -> str:
    w = _letters(title(c))
    ok = lambda x: f"(list_contains({array(X.VOCABULARY)}, {x}) OR (NOT list_contains({array(X.NOISE_TOKENS)}, {x}) AND length({x}) >= 3))"
    some = f"list_filter({w}, lambda x: NOT list_contains({array(X.SMALL_WORDS)}, x))"
    orphan = f"(len({w}) > 1 AND {w}[-2] = 'for' AND (length({w}[-1]) <= 2 OR NOT {ok(f'{w}[-1]')}))"
    bad = f"len(list_filter({some}, lambda x: NOT {ok('x')} AND length(x) > 2)) > 0"
    means = f"len(list_filter({some}, lambda x: {ok('x')} AND (list_contains({array(X.VOCABULARY)}, x) OR length(x) >= 4))) > 0"
    return f"(NOT coalesce({orphan}, false) AND NOT {bad} AND {means})"


def merge_title(c: str) -> str:
    v = sub(f"trim({c})", (r"[`*_~]+", ""), (r"\\([.-])", r"\1"), (r"^[^\w]+", ""), (r"^\d+(?:\.\d+)*\s*", ""), (r"\s+", " "))
    return f"trim({v}, ' .:-')"


def merge_valid(m: str) -> str:
    w, k = _letters(m), f"lower({m})"
    some = f"list_filter({w}, lambda x: NOT list_contains({array(X.SMALL_WORDS)}, x))"
    vocab = lambda x: f"list_contains({array(X.MERGE_VOCABULARY)}, {x})"
    orphan = f"(len({w}) > 1 AND {w}[-2] = 'for' AND (length({w}[-1]) <= 2 OR NOT {vocab(f'{w}[-1]')}))"
    bad = f"len(list_filter({some}, lambda x: NOT {vocab('x')} AND length(x) < 3)) > 0"
    means = f"len(list_filter({some}, lambda x: {vocab('x')} OR length(x) >= 4)) > 0"
    return f"({m} <> '' AND NOT list_contains({array(X.MERGE_NOISE_EXACT)}, {k}) AND NOT {any_of(k, X.MERGE_NOISE)} AND NOT coalesce({orphan}, false) AND NOT {bad} AND {means})"


def endpoint(c: str) -> str:
    return sub(f"trim({c})", (r"\\", "_"), (r"\{([^{}]+)id\}", r"{\1_id}"), (r"/{2,}", "/"))


IDENTITY = "'{}'"
DISPLAY = "concat('{', coalesce(nullif(NAME, ''), 'id'), '}')".replace("NAME", "trim(regexp_replace(regexp_replace(regexp_replace(s, '^[{:<*]+|[}>]+$', '', 'g'), '[^a-z0-9_]+', '_', 'g'), '_+', '_', 'g'), '_')")


def path(c: str, parameter: str) -> str:
    v = sub(f"lower(trim({c}))", ("/{2,}", "/"), ("^([^/])", r"/\1"), *((p + "(.)", r"/\1") for p in (r"^/api(?:/v\d+)?/ts/", r"^/api(?:/v\d+)?/", r"^/v\d+/")))
    return f"concat('/', array_to_string(list_transform(list_filter(string_split({v}, '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_matches(s, {q(X.PARAMETER_SEGMENT)}) THEN {parameter} ELSE s END), '/'))"


def signature(c: str) -> str:
    m, e = (f"regexp_extract(trim({c}), {q('(?i)' + X.API_TITLE)}, {k})" for k in (1, 2))
    return f"concat(upper({m}), ' ', {path(e, IDENTITY)})"


def phrase(c: str) -> str:
    return f"lower({squash(c)})"


def tokens(c: str) -> str:
    lst = f"regexp_extract_all(lower({c}), '\\w+')"
    return f"list_filter({distinct_in_order(lst)}, lambda t: length(t) > 1)"


def task_text(c: str) -> str:
    return squash(sub(f"lower({c})", (r"[^\w/{}\s-]+", " ")))


def noisy(c: str) -> str:
    plain = "(regexp_matches(s, '(?i)^(api|v\\d+)$') OR (starts_with(s, '{') AND ends_with(s, '}')))"
    mixed = "(length(s) >= 24 AND regexp_matches(s, '[a-z]') AND regexp_matches(s, '[A-Z]'))"
    coded = "(length(s) >= 18 AND regexp_matches(s, '[0-9]') AND regexp_matches(s, '[A-Za-z]') AND NOT regexp_matches(s, '[-_]'))"
    return f"len(list_filter(string_split(trim({c}), '/'), lambda s: NOT {plain} AND ({mixed} OR {coded}))) > 0"


def junk(c: str) -> str:
    return f"(length(trim({c})) < {X.SHORTEST_TEXT} OR regexp_matches(trim({c}), {q('(?i)' + X.JUNK)}))"


def black(c: str) -> str:
    return f"regexp_matches({c}, {q('(?i)' + X.BLACKLIST)})"


def signal_text(*parts: str) -> str:
    return f"concat_ws(' ', {', '.join(f"nullif(trim({p}), '')" for p in parts)})"


def keep_api(name: str, method: str, path: str) -> str:
    n, m, p = (f"trim(coalesce({c}, ''))" for c in (name, method, path))
    text = signal_text(n, p)
    full = f"CASE WHEN {m} <> '' AND {p} <> '' THEN concat(upper({m}), ' ', {p}) ELSE {n} END"
    shaped = f"(regexp_matches({full}, {q('(?i)' + X.KEEP_API_STRICT)}) OR regexp_matches(CASE WHEN {p} <> '' THEN {p} ELSE {n} END, {q('(?i)' + X.KEEP_API_LOOSE)}))"
    return f"(NOT {junk(text)} AND NOT {black(text)} AND NOT regexp_matches({p}, '\\s') AND NOT {noisy(p)} AND {shaped})"


def high_entropy(c: str) -> str:
    """Words by unnesting, so the text may be long."""
    words = f"list_filter(regexp_extract_all(lower({c}), '[a-z0-9_]+'), lambda t: length(t) > 1)"
    hits = f"len(list_filter({words}, lambda t: list_contains({array(X.VOCABULARY)}, t))) / len({words})"
    return f"(len({words}) >= {X.ENTROPY_TOKENS} AND round(list_entropy({words}), 9) > {X.ENTROPY_ABOVE} AND {hits} < {X.VOCABULARY_SHARE})"


def _without_placeholders(t: str) -> str:
    return f"trim({sub(t, (X.PLACEHOLDER_BLOCK, ''), ('(?i)' + X.ID_TOKEN, ''), (r'\s+', ' '))}, ' /:-')"


def aliases(kind: str, t: str) -> str:
    """Aliases, joined by |, of an item whose plain title is t."""
    bare = _without_placeholders(t)
    spoken = lambda c: squash(sub(c, ("[_-]", " ")))
    path = sub(f"regexp_extract({bare}, {q(X.ENDPOINT_IN_TITLE)}, 1)", ("(?i)" + X.VERSION_SEGMENT, ""), (r"[{}]", ""))
    parts = f"list_filter(string_split({path}, '/'), lambda p: p <> '' AND lower(p) NOT IN ('api', 'id') AND NOT regexp_matches(p, '^[0-9]+$'))"
    name, verb = spoken(bare), q(r"^(\S+)\s+(\S.*)$")
    raw = f"""CASE {kind} WHEN 'api' THEN [CASE WHEN {bare} <> {t} THEN {bare} END, {spoken(f"array_to_string({parts}, ' ')")}]
 WHEN 'task' THEN [CASE WHEN list_contains({array(X.ALIAS_VERBS)}, lower(regexp_extract({t}, {verb}, 1))) THEN regexp_extract({t}, {verb}, 2) END]
 WHEN 'db_schema' THEN [{name}, CASE WHEN {name} <> '' AND NOT ends_with(lower({name}), 'table') THEN concat({name}, ' table') END] ELSE [{t}] END"""
    plain = f"list_transform(list_filter({raw}, lambda z: z IS NOT NULL), lambda z: {merge_title('z')})"
    word = sub("z", (r"[^\w]+", " "))
    key = lambda c: f"lower({squash(c)})"
    sound = f"list_filter({plain}, lambda z: {merge_valid('z')} AND length({sub('z', (r'[^\w]+', ''))}) >= 4 AND len(list_filter(string_split({word}, ' '), lambda v: length(v) = 1)) = 0 AND {key('z')} <> {key(t)})"
    return f"array_to_string(list_filter({sound}, lambda z, i: list_position(list_transform({sound}, lambda y: {key('y')}), {key('z')}) = i), '|')"

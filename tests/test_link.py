"""Links against all pairs: names, words, vectors, the best task; one tile and many."""

import random
import re

import numpy as np
import pytest

from signalmill.operators import link as L

ITEM, FEATURE = "job_id int, ord int, item_type string, title string, description string, embedding array<double>", "job_id int, f_ord int, title string, aliases array<string>, description string, embedding array<double>"


def phrase(t):
    return re.sub(r"\s+", " ", t or "").strip().lower()


def tokens(*parts):
    return {w for w in re.findall(r"\w+", " ".join(p or "" for p in parts).lower()) if len(w) > 1}


def share(a, b):
    return len(a & b) / max(len(a), len(b)) if a and b else 0.0


def cosine(a, b):
    if a is None or b is None or len(a) != len(b):
        return None
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return float(np.dot(a, b) / n) if n else 0.0


def best(scored, least):
    scored = [(s, k) for k, s in scored if s is not None and s >= least]
    return min(scored, key=lambda x: (-x[0], x[1])) if scored else None


def brute(items, features):
    """ord: (f_ord, how) of every item, all features of its job in turn."""
    out = {}
    for job, o, kind, title, description, v in items:
        own = [f for f in features if f[0] == job]
        p, t, found = phrase(title), tokens(title, description), None
        names = {f[1]: {n for n in (phrase(f[2]), *map(phrase, f[3] or ())) if n} for f in own}
        words = {f[1]: share(t, tokens(f[2], *(f[3] or ()), f[4])) for f in own}
        exact = [k for k, ns in names.items() if p and any(n in p or p in n for n in ns)]
        if exact:
            found = min(exact, key=lambda k: (-words[k], k)), "exact"
        elif x := best(words.items(), 0.2):
            found = x[1], "words"
        elif x := best([(f[1], cosine(v, f[5])) for f in own], 0.5):
            found = x[1], "vector"
        out[job, o] = found
    links = dict(out)
    for job, o, kind, title, description, v in items:
        if kind in ("api", "db_schema") and out[job, o] is None:
            t, scored = tokens(title, description), []
            for j2, o2, k2, t2, d2, v2 in items:
                if j2 == job and k2 == "task":
                    s = share(t, tokens(t2, d2))
                    scored.append((o2, s if s >= 0.25 else cosine(v, v2)))
            x = best(scored, 0.5)
            if x and out[job, x[1]]:
                links[job, o] = (out[job, x[1]][0], "task")
    return links


def tables(seed, jobs=4, n=24):
    rnd = random.Random(seed)
    words = ["log", "in", "user page", "Page", "the", "Export", "ü-bersicht", "a", "list of", "pay", "payment", "PAY  ment", "x", "admin", "report", ""]
    prose = lambda k: " ".join(rnd.choice(words) for _ in range(rnd.randint(0, k)))
    vector = lambda: rnd.choice((None, [0.0] * 3, [1.0, 2.0], *([[float(rnd.randint(-3, 3)) for _ in range(3)]] * 6)))
    items, features = [], []
    for job in range(jobs):
        for k in range(n if job else 2 * n):
            items.append((job, k, rnd.choice(("api", "task", "db_schema")), f"{prose(2)} q{k}" if rnd.random() < 0.5 else prose(3), rnd.choice((None, prose(6), f"z{rnd.randint(0, 9)} y{rnd.randint(0, 9)}")), vector()))
        for k in range(n if job else 3):
            features.append((job, k, f"{prose(3)} f{k}" if rnd.random() < 0.6 else prose(3), rnd.choice((None, [], [prose(2), f"q{rnd.randint(0, n)}"])), rnd.choice((None, prose(6), f"z{rnd.randint(0, 9)} y{rnd.randint(0, 9)}")), vector()))
    features = [f if f[0] != 3 else (9, *f[1:]) for f in features]  # a job without features, features without items
    return items, features


@pytest.mark.parametrize(("seed", "tile"), [(0, 4096), (1, 4096), (0, 5), (1, 2)])
def test_links_are_those_of_all_pairs(spark, monkeypatch, seed, tile):
    monkeypatch.setattr(L, "TILE", tile)
    items, features = tables(seed)
    got = L.link(spark.createDataFrame(items, ITEM).repartition(3), spark.createDataFrame(features, FEATURE), ["job_id"]).collect()
    want = brute(items, features)
    assert {(r["job_id"], r["ord"]): (r["f_ord"], r["how"]) if r["f_ord"] is not None else None for r in got} == want
    assert len(got) == len(items) and {h for _, h in filter(None, want.values())} >= {"exact", "words", "vector"}


def test_an_api_goes_where_its_best_task_goes(spark):
    """Neither names, words nor vectors lead the API to the feature; half of its words are the task's, which is the feature's own."""
    items = [(1, 0, "task", "build invoice export wizard", None, [0.0, 1.0]), (1, 1, "api", "send ledger wizard export", None, [1.0, 0.0]), (1, 2, "db_schema", "nothing alike", None, [1.0, 0.0])]
    features = [(1, 7, "build invoice", None, None, [0.0, -1.0])]
    got = L.link(spark.createDataFrame(items, ITEM), spark.createDataFrame(features, FEATURE), ["job_id"]).collect()
    assert {r["ord"]: (r["f_ord"], r["how"]) for r in got} == {0: (7, "exact"), 1: (7, "task"), 2: (None, None)}


def test_common_words_open_no_list():
    """A word that every feature has is not followed once a rarer one has led to a better score."""
    features = [frozenset({"the", f"f{k}"}) for k in range(500)]
    lists = L.Postings(features)
    met = list(lists.scored(frozenset({"the", "f7"}), 0.2, True))
    assert met == [(7, 1.0)]
    rnd = random.Random(1)
    sets = [frozenset(f"w{rnd.randint(0, 30)}" for _ in range(rnd.randint(1, 8))) for _ in range(80)]
    lists = L.Postings(sets)
    for words in sets:
        for least in (0.2, 0.25, 0.5):
            every = {(f, share(words, s)) for f, s in enumerate(sets) if share(words, s) >= least}
            assert set(lists.scored(words, least, False)) == every
            assert lists.best(words, least) == max((s, -f) for f, s in every)


def test_a_row_an_item(spark, monkeypatch):
    """A word in every title of a job: the tiles give one row for each item, not one for each pair."""
    items = [(1, k, "task", f"common thing {k}", None, None) for k in range(300)]
    features = [(1, k, f"common word {k % 7} x{k}", None, None, None) for k in range(300)]
    seen, tiles = [], L.tiles
    monkeypatch.setattr(L, "tiles", lambda *a: seen.append(tiles(*a)) or seen[-1])
    got = L.link_words(spark.createDataFrame(items, ITEM), spark.createDataFrame(features, FEATURE), ["job_id"])
    assert got.count() == 300 and [x.count() for x in seen[0]] == [300, 300]


def test_empty_and_null(spark):
    items, features = spark.createDataFrame([], ITEM), spark.createDataFrame([(1, 1, None, None, None, None)], FEATURE)
    assert L.link(items, features, ["job_id"]).count() == 0
    some = spark.createDataFrame([(1, 1, "api", None, None, None), (None, 2, "task", "x", None, None)], ITEM)
    assert {r["f_ord"] for r in L.link(some, features, ["job_id"]).collect()} == {None}

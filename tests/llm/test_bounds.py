"""Fits, plans and recall against brute force: noisy-or weights, packing plans, vector links at the registered setting."""

import itertools
import math
import random

import numpy as np
import pytest

from signalmill.llm import packing, toxicity, vectors


def bags(seed, n=120, features=6):
    """Documents of labelled sentences: feature 0 makes a sentence toxic nearly always, feature 1 half as often, others never."""
    rnd, out = random.Random(seed), []
    for _ in range(n):
        some = [[f for f in range(features) if rnd.random() < 0.15] for _ in range(rnd.randint(1, 6))]
        bad = any((0 in s and rnd.random() < 0.95) or (1 in s and rnd.random() < 0.5) for s in some)
        some = [s for s in some if s]
        out.append((int(bad), rnd.randint(0, 3), some))
    return out


def objective(docs, w, bias, ridge):
    """The penalised noisy-or likelihood, document by document and sentence by sentence."""
    total = 0.0
    for y, idle, some in docs:
        keep = 1.0
        for s in [*some, *([[]] * idle)]:
            keep *= 1 - 1 / (1 + math.exp(-(bias + sum(w[f] for f in s))))
        p = min(max(1 - keep, 1e-9), 1 - 1e-9)
        total -= math.log(p if y else 1 - p)
    return total / len(docs) + ridge / 2 * sum(x * x for x in w)


@pytest.mark.parametrize("seed", [1, 2])
def test_noisy_or_weights_are_a_minimum(seed):
    docs, ridge = bags(seed), 1e-2
    w, bias = toxicity.fit(docs, 6, steps=3000, rate=0.05, ridge=ridge)
    best = objective(docs, w, bias, ridge)
    assert w[0] > w[1] > max(w[2:])
    rng = np.random.default_rng(seed)
    for _ in range(60):  # no step in any direction does better
        d, b = rng.normal(0, 0.05, 6), rng.normal(0, 0.05)
        assert objective(docs, w + d, bias + b, ridge) >= best - 1e-6


def test_score_is_the_noisy_or_of_sentences():
    model = toxicity.Model({"scum": 3.0, "idi*": 2.0, "nice": -1.0}, -4.0)
    text = "You idiot! Nice day. Scum, scum.\nplain"
    z = [-4 + 2, -4 - 1, -4 + 6, -4]
    p = [1 / (1 + math.exp(-x)) for x in z]
    score, where = model.score(text)
    assert math.isclose(score, 1 - math.prod(1 - x for x in p), rel_tol=1e-9)
    assert [(text[s:e].strip(), round(q, 6)) for s, e, q in where] == [("Scum, scum", round(p[2], 6))]


def fewest(pieces, window):
    """Fewest windows that hold the pieces, by trying all ways (few pieces)."""
    pieces = sorted(pieces, reverse=True)
    best = [len(pieces)]

    def put(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(pieces):
            best[0] = len(rooms)
            return
        for j in sorted({r: j for j, r in enumerate(rooms) if r >= pieces[k]}.values()):
            put(k + 1, [*rooms[:j], rooms[j] - pieces[k], *rooms[j + 1 :]])
        put(k + 1, [*rooms, window - pieces[k]])

    put(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_exact_and_near_the_fewest(seed):
    rnd = random.Random(seed)
    pieces = [rnd.choice((1, 3, 7, 11, 13, 18, 24, 31)) for _ in range(11)]
    counts = np.bincount(pieces, minlength=33)
    planned = packing.plan(counts, 32)
    held = np.bincount([n for p, times in planned for n in p for _ in range(times)], minlength=33)
    assert (held == counts).all() and all(sum(p) <= 32 and times > 0 for p, times in planned)
    assert sum(times for _, times in planned) <= fewest(pieces, 32) + 1


def test_plan_of_many_pieces_wastes_little():
    rng = np.random.default_rng(3)
    counts = np.bincount(np.minimum(2048, rng.lognormal(6, 1, 200_000).astype(int) + 1), minlength=2049)
    planned = packing.plan(counts)
    held = np.zeros(2049, np.int64)
    for p, times in planned:
        for n in p:
            held[n] += times
    assert (held == counts).all()
    assert sum(t for _, t in planned) <= 1.01 * math.ceil((counts * np.arange(2049)).sum() / 2048)


def test_nnls_is_a_minimum():
    rng = np.random.default_rng(1)
    counts = np.bincount(rng.integers(1, 20, 500), minlength=33)
    patterns = packing.combinations(np.flatnonzero(counts), 32)
    x = packing.nnls(patterns, counts, 4000)
    a = np.zeros((33, len(patterns)))
    for j, p in enumerate(patterns):
        for n in p:
            a[n, j] += 1
    slope = a.T @ (a @ x - counts)
    assert (x >= 0).all() and (slope >= -2.0).all() and (np.abs(slope * (x > 0)) <= 2.0).all()  # it stops when no count moves by a quarter


def test_default_setting_finds_the_links(spark):
    """The registered query's own probing against all pairs: at least nine tenths of the links, and none below the bound."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(300, 64))
    near = [b + rng.normal(scale=s, size=64) for b, s in itertools.product(base[:60], (0.05, 0.15, 0.25, 0.3))]
    x = np.vstack([base, near, [base[0] * 3, base[0]]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    got = {r["vec_id"]: r["n_links"] for r in vectors.linked(df).collect()}
    found = sum(got.values())
    assert all(got[i] <= links[i].sum() for i in range(len(x)))
    assert found >= 0.9 * links.sum() and links.sum() > 200

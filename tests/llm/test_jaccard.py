"""The n-gram Jaccard join against brute force: near copies of many degrees, shared passages, null and repeated ids, small tiles and packs."""

import random

import pytest

from signalmill.llm import jaccard, sieve


def corpus(seed):
    rnd = random.Random(seed)
    prose = lambda n: [f"w{rnd.randint(0, 5000)}" for _ in range(n)]
    passage, out = prose(40), []
    for _ in range(12):
        base = prose(rnd.randint(6, 120))
        for _ in range(rnd.randint(1, 9)):
            copy = list(base)
            for _ in range(rnd.choice((0, 0, 1, 2, 3, len(base) // 20))):
                copy[rnd.randrange(len(copy))] = f"x{rnd.randint(0, 9999)}"
            out.append(" ".join(copy + (passage if rnd.random() < 0.2 else [])))
    out += [" ".join(passage + prose(rnd.randint(1, 60))) for _ in range(30)] + [None, "", "a b", "A b", "one"]
    rnd.shuffle(out)
    ids = [k for k in range(len(out))]
    for k in rnd.sample(range(len(out)), 12):
        ids[k] = None
    for k in rnd.sample(range(len(out)), 6):
        ids[k] = 7  # one id, several texts
    return list(zip(ids, out, strict=True))


def sets_of(docs):
    out = []
    for _, t in docs:
        w = (t or "").lower().split()
        out.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def roots(docs, sets, by_id):
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            near = sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
            if near or (by_id and sets[a] and sets[b] and docs[a][0] is not None and docs[a][0] == docs[b][0]):
                root[find(a)] = find(b)
    return [find(k) for k in range(len(docs))]


@pytest.mark.parametrize(("seed", "tile", "pack"), [(1, 4096, 1 << 20), (2, 2, 300), (3, 3, 50)])
def test_groups(spark, monkeypatch, seed, tile, pack):
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(sieve, "PACK", pack)
    docs = corpus(seed)
    sets = sets_of(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    root = roots(docs, sets, True)
    want = []
    for k, (i, _) in enumerate(docs):
        ids = [docs[j][0] for j in range(len(docs)) if root[j] == root[k] and docs[j][0] is not None]
        want.append((i, len(sets[k]), min(ids, default=None) if sets[k] else i))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in jaccard.grouped(df).collect())


@pytest.mark.parametrize("seed", [4, 5])
def test_stage(spark, seed):
    """One row of each group stays: of its smallest id, or some row of a group without ids; rows without words all stay."""
    docs = corpus(seed) + corpus(seed)[:5]
    sets = sets_of(docs)
    root = roots(docs, sets, False)
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, g string, rows int").repartition(3)
    got = jaccard.dedup_stage(spark, df, "")
    assert got.columns == df.columns
    got = [tuple(r)[:2] for r in got.collect()]
    full = [x for x in got if (x[1] or "").split()]
    assert sorted(map(str, (x for x in got if not (x[1] or "").split()))) == sorted(map(str, (d for d in docs if not (d[1] or "").split())))
    groups = {root[k] for k in range(len(docs)) if sets[k]}
    assert len(full) == len(groups)
    where = {}
    for k, d in enumerate(docs):
        where.setdefault(d, []).append(root[k])
    for d in full:
        ids = [docs[j][0] for j in range(len(docs)) if root[j] in where[d] and docs[j][0] is not None]
        assert d[0] == min(ids, default=None)
    assert {g for d in full for g in where[d]} == groups

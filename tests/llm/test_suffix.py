"""Groups of maximal repeats against brute force, and the sieve on packs of any size."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from signalmill.llm import sieve, suffix


def corpus():
    rnd = random.Random(5)
    prose = lambda n: " ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(n))
    a, b, c = prose(70), prose(40), prose(90)
    return [prose(30) + a + prose(20), a + prose(5), prose(9) + a[:260] + prose(30) + b, b + prose(50) + b, c + prose(3) + a[100:], "ab" * 400, prose(40) + "ab" * 200, None, "", "x", c, c + " end"]


def found_by_force(texts):
    seen = Counter(b[s : s + 200] for b in texts for s in range(len(b) - 199))
    out = {}
    for b in texts:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 199):
            if seen[b[s : s + 200]] > 1:
                gone[s : s + 200] = True
        out[hashlib.md5(b).hexdigest()] = gone
    return out


@pytest.mark.parametrize(("tile", "pack"), [(suffix.TILE, sieve.PACK), (2, 20)])
def test_groups_cover_what_repeats(spark, monkeypatch, tile, pack):
    monkeypatch.setattr(suffix, "TILE", tile)
    monkeypatch.setattr(sieve, "PACK", pack)
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    by_key = {hashlib.md5((t or "").encode()).hexdigest(): (t or "").encode() for t in texts}
    groups = {}
    for r in suffix.repeat_groups(df).collect():
        groups.setdefault((r["group"], r["length"]), []).append((r["key"], r["pos"]))
    shown = {k: np.zeros(len(b), bool) for k, b in by_key.items()}
    for (_, length), places in groups.items():
        own = [by_key[k][p : p + length] for k, p in places]
        assert length >= 200 and len(places) > 1 and len(set(own)) == 1 and len(own[0]) == length
        for k, p in places:
            shown[k][p : p + length] = True
    want = found_by_force([(t or "").encode() for t in texts])
    assert all((shown[k] <= want[k]).all() for k in want)  # no byte that does not repeat
    across = Counter(x for b in by_key.values() for x in {b[s : s + 200] for s in range(len(b) - 199)})
    held = {by_key[k][s : s + 200] for (_, length), places in groups.items() for k, p in places for s in range(p, p + length - 199)}
    assert {x for x, n in across.items() if n > 1} <= held  # every string that two texts share
    got = {r["doc_id"]: r for r in suffix.removed(df).collect()}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = want[hashlib.md5(b).hexdigest()]
        assert (got[i]["n_removed"], got[i]["kept_sha256"]) == (gone.sum(), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())


def test_null_and_repeated_ids(spark):
    """Texts go by their hash, so ids may be null or repeat."""
    texts = corpus()
    df = spark.createDataFrame([(None if k % 2 else 7, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    want = found_by_force([(t or "").encode() for t in texts])
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffix.removed(df).collect())
    assert got == Counter((None if k % 2 else 7, len((t or "").encode()), int(want[hashlib.md5((t or "").encode()).hexdigest()].sum())) for k, t in enumerate(texts))


def test_maximal():
    before = [b"ba"[::-1], b"ca"[::-1], b"a", b"xa"[::-1]]
    after = [b"G" * 200 + b"12", b"G" * 200 + b"13", b"G" * 200 + b"13", b"G" * 200 + b"2"]
    got = {(left, right, tuple(m)) for left, right, m in suffix.maximal(before, after)}
    assert got == {(1, 200, (0, 1, 2, 3)), (1, 201, (0, 1, 2)), (1, 202, (1, 2))}

"""Periodic runs against brute force over all periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from signalmill.llm import runs


def brute(words):
    """(start, length, period) by comparing each word with the one a period on, for every period."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        s = 0
        while s < n - q:
            e = s
            while e + q < n and words[e] == words[e + q]:
                e += 1
            length = e - s + q
            part = words[s : s + length]
            if length >= max(6, 4 * q) and not any(all(a == b for a, b in zip(part, part[d:])) for d in range(1, q)):
                out.append((s, length, q))
            s = e + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def cases():
    rnd = random.Random(4)
    yield from ([], [b"a"] * 5, [b"a"] * 6, [b"a"] * 7, [b"a"] * 200, [b"a", b"b"] * 3, [b"a", b"b"] * 4, [b"a", b"b"] * 4 + [b"a"], [b"a", b"b", b"c"] * 4, ([b"a"] * 9 + [b"b"]) * 12)
    for k in range(400):
        letters = [b"%d" % x for x in range(rnd.choice((1, 2, 3, 8, 60)))]
        prose = lambda m: [rnd.choice(letters) for _ in range(m)]
        out = prose(rnd.randint(0, 60))
        for _ in range(rnd.randint(0, 3)):
            block = prose(rnd.randint(1, 25))
            if rnd.random() < 0.4:
                block = block * rnd.randint(1, 5) + prose(2)
            tail = block * rnd.randint(2, 9)
            out += tail[: rnd.randint(1, len(tail))] + prose(rnd.randint(0, 30))
        yield out
    base = [b"w%d" % x for x in range(700)]
    yield base + base[:500] * 6 + base[::-1]


def test_runs_by_brute_force():
    met = 0
    for words in cases():
        want = brute(words)
        met += bool(want)
        assert runs.runs(words) == want
    assert met > 150


def test_factors_with_one_hash(monkeypatch):
    """Unequal factors whose hashes agree stay apart."""
    monkeypatch.setattr(runs, "_MIX", 0)
    for words in ([b"w%d" % x for x in range(60)] + [b"a", b"b", b"c"] * 5, [b"a", b"b"] * 9 + [b"c"] * 7):
        assert runs.runs(words) == brute(words) != []


def test_long_periods():
    """A long text and a long period: every place moves a few times only."""
    block = [b"w%d" % x for x in range(20_000)]
    assert runs.runs([b"start", *block * 5, b"end"]) == [(1, 100_000, 20_000)]
    assert runs.runs([b"a"] * 100_000) == [(0, 100_000, 1)]


def plain(doc_id, text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *best, None if best[0] is None else 1000 * best[1] // best[2], sha(b"".join(b"%d,%d,%d\n" % r for r in found)), sha(kept))


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rnd = random.Random(9)
    prose = lambda m: " ".join(f"{rnd.choice('abcdefghij')}{rnd.randint(0, 40)}" for _ in range(m))
    docs = [(i, prose(rnd.randint(0, 90)) + rnd.choice(("", " ", "\n\t")) + " ü é" * rnd.randint(0, 9)) for i in range(300)]
    docs += [(1000, None), (1001, ""), (1002, " \n "), (None, "go " * 40), (None, None), (1003, "x" * 9000), (1004, "so it " * 400), (1004, "so it " * 400), (1005, (prose(90) + " ") * 40)]
    at = str(tmp_path_factory.mktemp("runs"))
    spark.createDataFrame([(*d, 1, "k") for d in docs], "doc_id long, text string, runs int, collapsed string").repartition(3).write.parquet(f"{at}/documents.parquet")
    return at, docs


def test_op11(spark, table):
    at, docs = table
    got = runs.op11_periodic_runs(spark, at).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == sorted((plain(*d) for d in docs), key=repr)
    assert sum(r["n_runs"] > 0 for r in got) > 20


def test_op11_empty(spark, table, tmp_path):
    spark.read.parquet(f"{table[0]}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert runs.op11_periodic_runs(spark, str(tmp_path)).count() == 0

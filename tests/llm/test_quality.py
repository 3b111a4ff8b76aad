"""Certified cutoffs against brute force: exact binomial tails, one trial a text, the rules' joint risk."""

import math
import random
from fractions import Fraction

import pytest

from signalmill.llm import quality


def below(k, n, p):
    """P(X <= k), exactly."""
    p = Fraction(p).limit_denominator(10**6)
    return float(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


@pytest.mark.parametrize(("n", "risk"), [(200, 0.05), (900, 0.01), (50, 0.2)])
def test_certified_is_the_exact_bound(n, risk):
    for k in range(0, int(2 * n * risk) + 2):
        for error in (0.2, 0.01, 0.0005):
            want = below(k, n, risk) <= error
            assert quality.certified(k, n, risk, error) == want, (k, n, risk, error)
            assert (quality.upper_bound(k, n, error) <= risk + 1e-12) == want


def word(rnd):
    return "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(3, 8)))


def text(rnd, symbols=0, lines=0):
    body = " ".join(word(rnd) for _ in range(80)) + " " + "#" * symbols
    return body + "".join("\nthe same line" for _ in range(lines))


def corpus():
    rnd = random.Random(3)
    docs, labels = [], []
    for i in range(1500):
        good = i % 3 != 0
        t = text(rnd, 0 if good else rnd.randint(50, 400), 0 if good else rnd.randint(0, 9))
        docs.append((i, t, "en" if i % 5 else None))
        labels.append((i, int(good)))
    copy = text(rnd, 300)
    docs += [(5000 + k, copy, "en") for k in range(40)]  # one text under many ids: one trial, though it would be rejected
    labels += [(5000 + k, 1) for k in range(40)]
    docs += [(1, docs[1][1], "en")] * 30 + [(None, "x " * 60, "en"), (7000, None, "en"), (7001, "", "de")]
    labels += [(2, 0), (None, 1), (9999, 1), (7000, None), (7001, 1)]
    rnd.shuffle(docs)
    return docs, labels


def brute(docs, labels, risk, delta):
    known = {}
    for i, q in labels:
        if i is not None and q is not None:
            known[i] = min(q, known.get(i, 1))
    texts = {}
    for i, t, lang in docs:
        if i in known:
            key = (lang or "", t)
            texts[key] = min(known[i], texts.get(key, 1))
    strata, least = {}, None
    for (lang, t), q in texts.items():
        f = dict(zip(quality.COUNTS, quality.features(t), strict=True))
        if q == 1 and f["n_words"] >= 50 and 100 * f["n_repeat_words"] <= 50 * f["n_words"]:
            strata.setdefault(lang, []).append(f)
    tests = len(strata) + 1
    least = next(n for n in range(1, 10**6) if (1 - risk) ** n <= delta / tests)
    pool = [r for rows in strata.values() if len(rows) < least for r in rows]

    def level(rows):
        out = -1
        for k in range(quality.LEVELS):
            hits = sum(rejects(r, k) for r in rows)
            if below(hits, len(rows), risk) > delta / tests:
                break
            out = k
        return out

    return {s: level(rows) for s, rows in strata.items() if len(rows) >= least}, level(pool) if pool else -1


def rejects(f, level):
    """Whether any rule rejects features at a level."""
    return level >= 0 and any(f[above] * 1000 > f[under] * cutoffs[level] for above, under, cutoffs in quality.RULES.values())


def verdicts(docs, found):
    own, pool = found
    for i, t, lang in docs:
        f = dict(zip(quality.COUNTS, quality.features(t), strict=True))
        failed = f["n_words"] < 50 or 100 * f["n_repeat_words"] > 50 * f["n_words"]
        yield i, t, lang, not failed and not rejects(f, own.get(lang or "", pool))


def test_levels_and_verdict(spark):
    """One large stratum, one that is pooled with another, one that labels do not know."""
    docs, labels = corpus()
    rnd = random.Random(8)
    docs += [(8000 + k, text(rnd, 90 * (k % 2)), ("it", "pt", "xx")[k % 3]) for k in range(96)]
    labels += [(8000 + k, 1 - k % 2) for k in range(96) if k % 3 < 2]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    risk, delta = 0.2, 0.05
    counted = quality.with_features(df.withColumn("th", quality.text_hash()), ("doc_id", "lang", "th"))
    found = quality.levels(counted, lab, risk, delta)
    assert found == brute(docs, labels, risk, delta)
    assert found[0]["en"] >= 0 and found[1] >= 0 and not {"it", "pt", "xx"} & set(found[0])
    got = sorted((r["doc_id"] is not None, r["doc_id"], r["n_symbols"], r["kept"]) for r in quality.judged(counted, found).collect())
    want = list(verdicts(docs, found))
    assert got == sorted((i is not None, i, sum((t or "").count(x) for x in "#*$%&|<>"), kept) for i, t, _, kept in want)
    for stratum, members in {"en": {"en"}, "pool": {"it", "pt"}}.items():
        good = {t: kept for i, t, lang, kept in want if lang in members and dict(labels).get(i) == 1}
        assert sum(not k for k in good.values()) <= risk * len(good), stratum
        bad = [kept for i, t, lang, kept in want if lang in members and dict(labels).get(i) == 0]
        assert not all(bad), stratum  # rules reject some


def test_a_path_only_gets_stricter():
    for _, _, cutoffs in quality.RULES.values():
        assert len(cutoffs) == quality.LEVELS and list(cutoffs) == sorted(cutoffs, reverse=True)
    assert quality.strictest(1000, [0, 5, 400, 0], 0.02, 0.01) == 1 and quality.strictest(100, [0], 0.02, 0.01) == -1


def test_stage_with_rules_that_reject(spark, tmp_path):
    """At the registered risk: enough labels for a certificate, and rows go that the base rule would keep."""
    rnd = random.Random(2)
    docs = [(k, text(rnd, 0 if k % 4 else 200), "en") for k in range(900)]
    labels = [(k, int(k % 4 > 0)) for k in range(900)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    found = brute(docs, labels, quality.RISK, quality.DELTA)
    got = quality.quality_stage(spark, spark.createDataFrame(docs, "doc_id long, text string, lang string"), str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in got) == [i for i, _, _, kept in verdicts(docs, found) if kept] == [k for k in range(900) if k % 4]


def test_stage_on_an_empty_table(spark, tmp_path):
    docs, labels = corpus()
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    assert quality.quality_stage(spark, df.where("false"), str(tmp_path)).count() == 0

"""Each stage of the pipeline against a brute-force version, on what the stage before left; empty tables; ties and repeated rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from signalmill.llm import pii, quality, tokens
from tests.llm.test_jaccard import roots, sets_of
from tests.llm.test_queries import brute_pii, words

corpus_pipeline = pytest.importorskip("corpus_pipeline")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, rows int, g string, size long"


def corpus():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    texts = [prose(rnd.randint(55, 200)) for _ in range(60)]
    texts += [t.replace(t.split()[7], "changed", 1) for t in texts[:20]] + texts[:10] + [texts[0]] * 5
    texts += [f"{prose(60)} write to {word()}.{word()}@mail{k}.example.com or call +1 (900) 555-20{k:02d}, from 10.0.{k}.7 {prose(5)}" for k in range(12)]
    texts += [None, "", " \n", "short text", "again and again " * 60, "x" * 5000 + " " + prose(70), prose(4000)]
    docs = [(None if k % 17 == 3 else k, t, [None, "en", "fr"][k % 3], [None, "s1", "s2"][k % 3], len(t or ""), 1, "x", 2) for k, t in enumerate(texts)]
    return docs + docs[5:8] + [(7, docs[40][1] + " and more", "en", "s1", 1, 1, "x", 2)]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows that each stage was given, and gave."""
    at = str(tmp_path_factory.mktemp("in"))
    spark.createDataFrame([(k, 1, 0) for k in range(0, 60, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    docs, out = spark.createDataFrame(corpus(), COLUMNS).repartition(3), []
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, at)
        if name != "packing":
            assert got.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema], name
        rows = got.collect()
        out.append(([tuple(r) for r in docs.collect()], [tuple(r) for r in rows]))
        docs = spark.createDataFrame(rows, got.schema)
    return out


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "personal data", "mixing", "packing"]


def test_quality(stages):
    """Too few labels to certify a cutoff: the base rule decides, and nothing else goes."""
    given, got = stages[0]

    def fails(t):
        f = dict(zip(quality.COUNTS, quality.features(t), strict=True))
        return f["n_words"] < 50 or 100 * f["n_repeat_words"] > 50 * f["n_words"]

    assert Counter(got) == Counter(r for r in given if not fails(r[1])) and len(got) < len(given)


def test_near_duplicates(stages):
    given, got = stages[1]
    sets = sets_of([r[:2] for r in given])
    root = roots([r[:2] for r in given], sets, False)
    assert len(got) == len(set(root)) < len(given)
    where = {}
    for k, r in enumerate(given):
        where.setdefault(r, set()).add(root[k])
    assert {g for r in got for g in where[r]} == set(root)  # one row of each group
    for r in got:
        ids = [x[0] for k, x in enumerate(given) if root[k] in where[r] and x[0] is not None]
        assert r[0] == min(ids, default=None)


def test_personal_data(stages):
    given, got = stages[2]
    model, want = pii.field(), []
    for r in given:
        spans = pii.find([r[1]], model)[0][1]
        new = list(r[1])
        for kind, s, e in sorted(set(spans), key=lambda x: (x[1], -x[2]), reverse=True):
            if not any(a <= s and e <= b and (a, b) != (s, e) for _, a, b in spans):
                new[s:e] = f"<{kind}>"
        want.append((r[0], "".join(new), *r[2:4], len(new), *r[5:]))
        for kind, s, e in brute_pii(r[1]):
            assert r[1][s:e] not in want[-1][1], kind
        if not spans:
            assert want[-1][1] == r[1]
    assert Counter(got) == Counter(want)
    assert sum("<email>" in r[1] for r in got) == 12


def test_mixing(stages):
    given, got = stages[3]
    size = Counter()
    for r in given:
        size[r[3]] += len(words(r[1]))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(size.values()), set(names)
    while True:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * size[s] + 1e-9}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
        open_ -= over
    target |= {s: weight[s] * level for s in open_}
    taken, times, there = Counter(), Counter(got), Counter(given)
    for r in got:
        taken[r[3]] += len(words(r[1]))
    assert set(times) <= set(there) and all(n <= 2 * there[r] for r, n in times.items())
    largest = max(len(words(r[1])) for r in given)
    assert all(abs(taken[s] - target[s]) <= largest for s in names)


def test_packing(stages):
    from tokenizers import Tokenizer

    given, got = stages[4]
    tok = Tokenizer.from_file(tokens.tokenizer_path())
    tok.encode_special_tokens = True
    want = Counter()
    for r in given:
        ids = np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 1], np.uint32)
        for s in range(0, len(ids), 2048):
            part = ids[s : s + 2048]
            want[r[0], s, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert Counter(r[:5] for r in got) == want
    windows = {}
    for r in got:
        windows.setdefault(r[5], []).append((r[6], r[2]))
    for w in windows.values():
        ends = np.cumsum([0] + [n for _, n in sorted(w)])
        assert [o for o, _ in sorted(w)] == ends[:-1].tolist() and ends[-1] <= 2048
    total = sum(r[2] for r in got)
    assert len(windows) <= math.ceil(1.1 * total / 2048) + 1


def test_empty(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(corpus()[:3], COLUMNS).where("false")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path))
        assert got.count() == 0, name
        docs = got

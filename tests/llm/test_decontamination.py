"""Decontamination against brute force: every occurrence, the longest matches, one block and many."""

import hashlib
import random

import pytest

from signalmill.llm import decontamination as D


def windows(words):
    w = min(len(words), D.WINDOW)
    return {(i, tuple(words[i : i + w])) for i in range(len(words) - w + 1)} if words else set()


def brute(text, items):
    """(n_words, hit words, items) of a text."""
    words, hit, named = D.words_of(text), set(), set()
    for name, t in items:
        for _, w in windows(D.words_of(t)):
            for i in range(len(words) - len(w) + 1):
                if tuple(words[i : i + len(w)]) == w:
                    hit |= set(range(i, i + len(w)))
                    named.add("" if name is None else str(name))
    return len(words), hit, named


def longest(texts, items):
    """item, start: (length, places) of the longest match of every suffix, and the places to which a match one word earlier leads."""
    out = {}
    for name, words in items:
        least = min(len(words), D.WINDOW)
        for i in range(len(words) - least + 1) if words else ():
            best, places = least, []
            for d, own in enumerate(texts):
                for p in range(len(own)):
                    n = 0
                    while i + n < len(words) and p + n < len(own) and words[i + n] == own[p + n]:
                        n += 1
                    if n > best:
                        best, places = n, []
                    if n == best:
                        places.append((d, p))
            kept = [(d, p) for d, p in places if not (i and p and words[i - 1] == texts[d][p - 1])]
            if kept:
                out[name, i] = (best, kept)
    return out


def corpus(seed):
    rnd = random.Random(seed)
    kinds = rnd.choice((2, 5, 40))
    prose = lambda n: [b"w%d" % rnd.randint(0, kinds) for _ in range(n)]
    items = [(f"i{k}", prose(rnd.choice((0, 1, 3, 9, 10, 11, 30)))) for k in range(8)]
    texts = []
    for _ in range(12):
        out = prose(rnd.randint(0, 30)) + [b"other"] * rnd.randint(0, 2)
        for _ in range(rnd.randint(0, 3)):
            own = rnd.choice(items)[1]
            s = rnd.randint(0, len(own))
            out += own[s : s + rnd.randint(0, 40)] + prose(rnd.randint(0, 4))
        texts.append(out)
    return texts, items


@pytest.mark.parametrize("seed", range(40))
def test_shard(seed):
    texts, items = corpus(seed)
    block = D.Block.of([(name, 0, words) for name, words in items])
    shard = D.Shard(block, texts)
    spans, named = shard.hits()
    text_items = [(name, b" ".join(words).decode()) for name, words in items]
    for own, s, n in zip(texts, spans, named, strict=True):
        _, hit, want = brute(b" ".join(own).decode(), text_items)
        assert {i for a, b in s for i in range(a, b)} == hit and set(n) == want and len(n) == len(want)
    got = {}
    for suffix, n, d, place in shard.longest():
        at = got.setdefault((block.names[block.item[suffix]], int(block.start[suffix])), (n, []))
        assert at[0] == n
        at[1].append((d, place))
    assert {k: (n, sorted(x)) for k, (n, x) in got.items()} == longest(texts, items)


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rnd = random.Random(3)
    prose = lambda n: " ".join(f"{rnd.choice(('ta', 'Ré', 'x', 'io'))}{rnd.randint(0, 30)}" for _ in range(n))
    items = [(k, prose(rnd.choice((4, 9, 10, 25, 60)))) for k in range(12)]
    items += [(20, None), (21, " .,; "), (None, prose(30)), (3, prose(30)), (22, items[4][1]), (23, prose(400)), (110, "One")]
    leak = lambda: (rnd.choice(items)[1] or "").upper().replace("É", "é").replace(" ", ", ")
    docs = [(k, prose(rnd.randint(0, 40)) + rnd.choice((" ", "-\n", "")) + leak() + " " + prose(9)) for k in range(60)]
    docs += [(k + 100, prose(80)) for k in range(40)] + [(200, None), (201, ""), (202, " -- "), (None, items[3][1] + " end"), (None, prose(12)), (None, None), (203, "one"), (203, "one"), (204, prose(6000) + " " + items[15 + 2][1])]
    at = str(tmp_path_factory.mktemp("leaks"))
    spark.createDataFrame([(*d, 1, "k") for d in docs], "doc_id long, text string, h int, items string").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, start int").write.parquet(f"{at}/benchmark.parquet")
    return at, docs, items


def wanted(docs, items):
    out = []
    for i, t in docs:
        n, hit, named = brute(t, items)
        out.append((i, n, len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def asked(spark, at):
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    return sorted((tuple(r) for r in D.op12_decontamination(spark, at).select(*cols).collect()), key=repr)


def test_op12(spark, table):
    at, docs, items = table
    want = wanted(docs, [i for i in items if i[1]])
    assert asked(spark, at) == want
    assert sum(r[-1] for r in want) > 40 and sum(not r[-1] for r in want) > 20


def test_op12_is_the_same_in_many_blocks(spark, table, monkeypatch):
    """Small shards, items cut into pieces, and a benchmark of several blocks give the same rows."""
    at, _, _ = table
    want = asked(spark, at)
    for name, value in (("SHARD", 50), ("PIECE", 30), ("BLOCK", 500)):
        monkeypatch.setattr(D, name, value)
    assert asked(spark, at) == want


def test_decontaminated(spark, table):
    at, docs, items = table
    table_, bench = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/benchmark.parquet")
    got = D.decontaminated(table_, bench)
    assert got.columns == table_.columns
    want = [(i, t) for i, t in docs if not brute(t, [x for x in items if x[1]])[1]]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_longest_matches(spark, table, monkeypatch):
    """Over all shards, only the longest match of a suffix is listed, at all its places."""
    at, docs, items = table
    monkeypatch.setattr(D, "SHARD", 100)
    some = [d for d in docs if d[0] is not None and d[0] < 90]
    own = {}
    for name, t in items:
        own.setdefault(name, []).append(t)
    single = [(str(n), D.words_of(t[0])) for n, t in own.items() if n is not None and len(t) == 1 and t[0]]
    rows = [(int(n), " ".join(w.decode() for w in words)) for n, words in single]
    got = D.longest_matches(spark.createDataFrame(some, "doc_id long, text string").repartition(4), spark.createDataFrame(rows, "item_id long, text string")).collect()
    want = longest([D.words_of(t) for _, t in some], single)
    # Places to which a match one word earlier leads are left out in each shard, so the two agree place by place.
    seen = {}
    for r in got:
        seen.setdefault((r["item"], r["item_start"]), []).append((r["length"], r["doc_id"], r["doc_start"]))
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted((n, some[d][0], p) for d, p in x) for k, (n, x) in want.items()}


def test_op12_empty(spark, table, tmp_path):
    at, docs, _ = table
    spark.read.parquet(f"{at}/documents.parquet").where("false").write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.read.parquet(f"{at}/benchmark.parquet").write.parquet(f"{tmp_path}/a/benchmark.parquet")
    assert D.op12_decontamination(spark, f"{tmp_path}/a").count() == 0
    spark.read.parquet(f"{at}/documents.parquet").write.parquet(f"{tmp_path}/b/documents.parquet")
    spark.read.parquet(f"{at}/benchmark.parquet").where("false").write.parquet(f"{tmp_path}/b/benchmark.parquet")
    got = D.op12_decontamination(spark, f"{tmp_path}/b").collect()
    assert len(got) == len(docs) and not any(r["contaminated"] for r in got)

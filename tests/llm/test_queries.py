"""Each query against a brute-force version on a small table with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalmill.llm import chat, jaccard, mixing, packing, pii, quality, scoring, suffix, tokens, toxicity, vectors


def texts():
    rnd = random.Random(1)
    syl = ["ta", "re", "ion", "be", "er", "lo", "ch", "ng", "ü", "é"]
    word = lambda: "".join(rnd.choice(syl) for _ in range(rnd.randint(1, 3)))
    prose = lambda n: " ".join(word() + ("." if rnd.random() < 0.1 else "") for _ in range(n))
    shared = prose(60)
    out = [None, "", "  \n", "One", "a b", prose(200), prose(200)]
    out += [out[5]] * 3  # exact copies
    out += [" ".join(w if k % 90 else "changed" for k, w in enumerate(out[6].split()))]  # a near copy
    out += [prose(60) + "\n" + shared + "\n" + prose(30 + 7 * k) for k in range(4)]  # a passage
    out += ["For " * 300, "x" * 3000, prose(3000), "call +1 (900) 555-2077 or a@b.com, 10.0.0.1 4111 1111 1111 1111 now", "idiot " + prose(80) + " idiot moron."]
    out += [prose(80) + (" idiot scum. " if k % 3 == 0 else " fine day. ") + prose(40) for k in range(60)]
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    docs = [(i, t, [None, "en", "fr"][i % 3], [None, "s1", "s2", "s3"][min(i % 7, 3)], 0) for i, t in enumerate(texts())]
    docs += [docs[5], (None, "no id here " * 30, "en", "s1", 0)]
    extra = "key string, h long, n int, k int, size int, text_ string, rep long, row string, bits binary"
    cols = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(*d, "k", 1, 1, 1, 1, "t", 1, "r", b"b") for d in docs], f"{cols}, {extra}").repartition(3).write.parquet(f"{at}/documents.parquet")
    labels = [(i, int(t is not None and len(t) > 100), int("idiot" in (t or ""))) for i, t in enumerate(texts())] + [(3, None, None), (10**6, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 16))
    vecs = [b.tolist() for b in base] + [(b + rng.normal(scale=0.02, size=16)).tolist() for b in base[:10]] + [base[0].tolist()] * 3 + [(base[1] * 7).tolist()]
    vecs += [None, [0.0] * 16, [float("nan")] * 16, [None] * 16, [1.0]]
    spark.createDataFrame([(i, v, "x") for i, v in enumerate(vecs)] + [(None, vecs[0], "x")], "vec_id long, embedding array<double>, rep string").write.parquet(f"{at}/embeddings.parquet")
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "a\\b [INST] </s>"), (1, 2, "tool]", None), (2, 0, None, "x" * 5000), (2, 0, "assistant", " "), (None, 0, "user", "?"), (3, 0, "assistant", "\\")]
    spark.createDataFrame([(*t, "z") for t in turns], "conv_id long, turn long, role string, text string, formatted string").write.parquet(f"{at}/conversations.parquet")
    return at, [(d[0], d[1], d[3]) for d in docs]


@pytest.fixture(scope="module")
def empty(spark, tables, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "embeddings", "conversations"):
        spark.read.parquet(f"{tables[0]}/{t}.parquet").where("false").write.parquet(f"{at}/{t}.parquet")
    return at


def words(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())


def low(t):
    return [w.lower() for w in words(t)]


def rows(df, *by):
    return sorted(df.collect(), key=lambda r: tuple((r[b] is not None, r[b]) for b in by))


def test_op1(spark, tables):
    at, docs = tables
    c = Counter(w for i, t, _ in docs for w in [*low(t), None] if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2)
    n, v = sum(c.values()), len(c)
    got = rows(scoring.op1_lm_scoring(spark, at), "doc_id", "n_tokens")
    assert len(got) == len(docs)
    want = {i: [*low(t), None] for i, t, _ in docs}
    for r in got:
        own = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(c[w] > 0 for w in own), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
        assert -1e9 < r["score"] < 0


def test_op1_keeps_every_count(spark, tables, monkeypatch):
    """Scores are the same whether counts are broadcast or asked for by hash: none is dropped for being rare."""
    at, _ = tables
    want = rows(scoring.op1_lm_scoring(spark, at), "doc_id", "n_tokens", "score")
    monkeypatch.setattr(scoring, "HEAVY", 20)
    got = rows(scoring.op1_lm_scoring(spark, at), "doc_id", "n_tokens", "score")
    for a, b in zip(want, got, strict=True):
        assert (a["doc_id"], a["n_known"]) == (b["doc_id"], b["n_known"])
        assert math.isclose(a["base_score"], b["base_score"], rel_tol=1e-9) and math.isclose(a["score"], b["score"], rel_tol=1e-3)


def test_op1_trains_on_every_token(spark, tables, monkeypatch):
    """What a document gives to the gradient grows with its length: every token of every training text, the end too."""
    at, docs = tables
    seen, averaged = [], scoring._averaged
    monkeypatch.setattr(scoring, "_averaged", lambda rows: seen.append(int(rows["n"].sum())) or averaged(rows))
    scoring.op1_lm_scoring(spark, at)
    assert seen == [sum(len(low(t)) + 1 for i, t, _ in docs if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2)]


def test_op1_tasks_follow_tokens(spark, monkeypatch):
    """Each training task leaves a copy of the parameters: over 24 partitions of few tokens there were 24 of them, which filled the disk."""
    docs = spark.createDataFrame([(i, f"a b c{i % 7}", "en") for i in range(96)], "doc_id long, text string, lang string").repartition(24)
    copies, averaged = [], scoring._averaged
    monkeypatch.setattr(scoring, "_averaged", lambda rows: copies.append(len(rows)) or averaged(rows))
    monkeypatch.setattr(scoring, "joined", lambda docs, light: docs.join(F.broadcast(light.withColumnRenamed("row", "r")), F.col("r") == scoring.row_hash(), "left").select("doc_id", "text", "light"))
    assert scoring.scored(docs).count() == 96 and copies == [1]


def test_op1_texts_are_split_once(spark):
    """Rows of texts give back each document's words in order; what follows reads numbers only."""
    docs = [(i, " ".join(f"W{(i * k) % 11}" for k in range(i % 9)), "en") for i in range(50)] + [(50, None, None)]
    got = scoring.texts(spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)).toArrow()
    back = {}
    for ids, text in zip(got["doc_id"], got["text"]):
        words, sizes, places = scoring.unpacked(text)
        kinds = words.split()
        assert len(set(kinds)) == len(kinds)
        back |= {i: [kinds[k] for k in part] for i, part in zip(ids.as_py(), np.split(places, np.cumsum(sizes)[:-1]))}
    assert back == {i: low(t) for i, t, _ in docs}


def test_op1_words():
    """Arrow's words are those of the contract: split on ASCII white space alone, A-Z lowered, none empty."""
    import pyarrow as pa

    texts = [" a \x0b\x1c b\tC\xa0d\r\n", "", None, "\x85x İÀ\u2028Z", "  ", "B a", "a" * 99]
    t = scoring.Tokens(pa.array(texts))
    got = np.split([t.kinds[k] for k in t.places], np.cumsum(t.sizes)[:-1])
    assert [list(x) for x in got] == [low(x) for x in texts] and len(set(t.kinds)) == len(t.kinds)
    text, kind = t.pairs(np.array([k != b"a" for k in t.kinds]))
    assert sorted((i, t.kinds[k]) for i, k in zip(text, kind)) == sorted({(i, w) for i, x in enumerate(texts) for w in low(x) if w != b"a"})


def test_op1_learns(spark):
    """Held-out texts of two languages: the model tells which it is in and repeats what it met, so it beats the unigrams of both."""
    rnd = random.Random(2)
    tongues = {x: [f"{x}{rnd.randint(0, 999)}" for _ in range(300)] for x in ("aka", "ubu")}
    docs = []
    for i in range(400):
        own = tongues[("aka", "ubu")[i % 2]]
        some = rnd.sample(own, 12)
        docs.append((i, " ".join(rnd.choice(some) for _ in range(60)), ("aka", "ubu")[i % 2]))
    got = scoring.scored(spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(2)).where("held_out").collect()
    assert got and all(r["score"] > r["base_score"] + 15 for r in got)


def _model(k=2, seed=0):
    """Experts and words for the model's own tests."""
    from signalmill.llm import attention as A

    rng = np.random.default_rng(seed)
    names = {"".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(90)}
    names = sorted(names)[:60]
    symbols, n = A.pieces([w.encode() for w in names])
    counts = rng.integers(0, 9, (60, k)).astype(float)
    spelt = rng.random((2, A.SYMBOLS, k)).astype(np.float32)
    ends = np.full(k, 5.0)
    experts = A.Experts(counts.sum(0) + ends, (counts > 0).sum(0).astype(float), ends, np.log(spelt[0] / spelt[0].sum(0)), np.log(spelt[1] / spelt[1].sum(0)))
    words = A.Words(experts, (" ".join(names).encode(), counts.sum(1), n, symbols, experts.logs(counts, symbols, n)))
    return A, words, counts, rng


def test_op1_sees_32_places_back():
    """A token met 32 places earlier, and not since, raises its own probability."""
    A, words, _, _ = _model()
    net = A.Network(A.initial(np.ones((A.IDS, 2)) / A.IDS))
    doc = np.concatenate([np.arange(2, 42), np.arange(10, 42), np.arange(42, 62)])  # words 10.. come again 32 places on
    for place in range(41, 64):
        p = []
        for far in (doc[place], 61):
            own = doc.copy()
            own[place - 32] = far
            b = A.Batch(words, [own])
            first, at, end = A.blocks(b.sizes)
            f, _ = net.windows(net.tables(words, b.kinds), b, first, at, end)
            p.append(f["log"].ravel()[place])
        assert p[0] > p[1] + 0.05


def test_op1_probabilities_add_up():
    """Over all words that are known, the end, and a share for spelt ones, the model gives one."""
    A, words, counts, rng = _model()
    net = A.Network(A.initial(rng.random((A.IDS, 2))))
    context = rng.integers(2, 62, 40)
    total, novel = 0.0, 0.0
    for s in [A.END, *range(2, 62)]:
        b = A.Batch(words, [context if s == A.END else np.append(context, s)])
        first, at, end = A.blocks(b.sizes)
        f, _ = net.windows(net.tables(words, b.kinds), b, first, at, end)
        total += float(np.exp(f["log"].ravel()[40]))
    e = words.experts
    novel = np.exp(e.kinds - e.bottom)  # what an expert leaves to spelling
    assert 1 - novel.max() - 1e-4 < total < 1 + 1e-4


def test_op1_spelling_adds_up():
    """First symbols, then further ones until one ends the word: over two places all is known by hand."""
    from signalmill.llm import attention as A

    first, inner = np.full((A.SYMBOLS, 1), -np.inf), np.full((A.SYMBOLS, 1), -np.inf)
    first[[4, 5], 0], inner[[5], 0] = np.log([0.25, 0.75]), 0.0  # id 2 goes on or ends; then it ends
    e = A.Experts(np.array([6.0]), np.array([2.0]), np.array([1.0]), first, inner)
    one, two = e.logs(np.array([[3.0], [0.0]]), np.array([5, 4, 5]), np.array([1, 2])).ravel()
    assert math.isclose(np.exp(one), (3 + 2 * 0.75) / 8, rel_tol=1e-6) and math.isclose(np.exp(two), 2 * 0.25 / 8, rel_tol=1e-6)


def test_op1_gradient():
    A, words, _, rng = _model(seed=1)
    params = {n: x.astype(np.float64) for n, x in A.initial(rng.random((A.IDS, 2))).items()}
    net = A.Network(params)
    b = A.Batch(words, [rng.integers(2, 20, 50), rng.integers(2, 20, 9)])
    b.p = b.p.astype(np.float64)
    first, at, end = A.blocks(b.sizes)

    def run():
        net.fuse()
        t = net.tables(words, b.kinds, True)
        return t, net.windows(t, b, first, at, end)[0]

    loss = lambda: -(lambda f: f["log"][f["real"]].mean())(run()[1])
    t, f = run()
    g = net.gradient(t, f)
    row = 4
    kind = b.kinds[row]
    ids = words.ids[words.start[kind] : words.start[kind] + words.n[kind]]
    # A row's slope is shared out to its ids; moving all ids of a token alone moves its mean by as much, and other tokens that share them.
    shares = lambda name, c: sum(g[name][k].reshape(-1)[c] * np.isin(words.ids[words.start[x] : words.start[x] + words.n[x]], ids).mean() for k, x in enumerate(b.kinds))
    for name, place, want in (("gain", (0, 1), g["gain"][0, 1]), ("query", (2, 3), g["query"][2, 3]), ("key", (1, 0), g["key"][1, 0]), ("copy", (0,), g["copy"][0]), ("near", (40,), g["near"][40]), ("value", (np.unique(ids), 1), shares("value", 1)), ("embed", (np.unique(ids), 2), shares("embed", 2)), ("loud", (np.unique(ids),), shares("loud", 0))):
        keep, step, out = params[name][place].copy(), 1e-4, []
        for d in (step, -step):
            params[name][place] = keep + d
            out.append(loss())
        params[name][place] = keep
        assert math.isclose((out[0] - out[1]) / (2 * step), want, rel_tol=0.02, abs_tol=2e-6), name


def test_op2(spark, tables):
    at, docs = tables
    got = {r["doc_id"]: r for r in toxicity.op2_toxicity(spark, at).collect()}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    held = [i for i, t, _ in docs if i is not None and got[i]["held_out"] and len(t or "") > 300]
    right = [got[i]["predicted"] == int("idiot" in dict((d[0], d[1]) for d in docs)[i]) for i in held]
    assert sum(right) >= 0.85 * len(right)
    assert got[0]["score"] == got[1]["score"] == 0


def brute_pii(text):
    t, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        if 13 <= len(re.sub("[^0-9]", "", m.group())) <= 19 and pii.luhn(re.sub("[^0-9]", "", m.group())):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_op3_patterns():
    rnd = random.Random(3)
    for _ in range(3000):
        t = "".join(rnd.choice("a1.@+- ()2%3") for _ in range(rnd.randint(0, 40)))
        assert pii.base_spans(t) == brute_pii(t), t


def test_op3(spark, tables):
    at, docs = tables
    got = {r["doc_id"]: r for r in pii.op3_pii(spark, at).collect()}
    for i, t, _ in docs:
        base = brute_pii(t)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert set(f"{k}:{s}:{e}" for k, s, e in base) <= set(got[i]["spans"].split(","))
    t = "mail john at example dot com or 555-123-4567 please"
    (_, every), = pii.find([t], pii.field())
    assert {(k, t[s:e]) for k, s, e in every} == {("email", "john at example dot com"), ("phone", "555-123-4567")}


def test_op4(spark, tables):
    from tokenizers import Tokenizer

    at, docs = tables
    tok = Tokenizer.from_file(tokens.tokenizer_path())
    tok.encode_special_tokens = True
    ids = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], np.uint32) for i, t, _ in docs}
    got = packing.op4_packing(spark, at).collect()
    assert sum(r["length"] for r in got) == sum(len(ids[i]) for i, _, _ in docs)
    windows = {}
    for r in got:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for w in windows.values():
        at_ = 0
        for o, n in sorted(w):
            assert o == at_
            at_ += n
        assert at_ <= 2048


def test_op4_subwords():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.tokenizer_path())
    tok.encode_special_tokens = True
    rnd = random.Random(5)
    enc = tokens.Subwords()
    for _ in range(400):
        t = "".join(rnd.choice("ab '1!é漢\n\t 　<|endoftext|>") for _ in range(rnd.randint(0, 30)))
        assert np.frombuffer(enc.encode(t), np.uint32).tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def groups(n, links):
    root = list(range(n))
    for a, b in links:
        ra, rb = root[a], root[b]
        root = [min(ra, rb) if x in (ra, rb) else x for x in root]
    return root


def test_op5(spark, tables):
    at, _ = tables
    table = spark.read.parquet(f"{at}/embeddings.parquet").collect()
    ok = {r["vec_id"]: np.array(r["embedding"], float) for r in table if r["vec_id"] is not None and vectors.usable(r["embedding"], 16) is not None}
    cos = lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b))
    links = [(a, b) for a in ok for b in ok if a != b and cos(ok[a], ok[b]) >= 0.95]
    root = groups(len(table), links)
    n = Counter(a for a, _ in links)
    for r in vectors.linked(spark.read.parquet(f"{at}/embeddings.parquet"), slack=None).collect():
        if r["vec_id"] is None:
            assert r["n_links"] == 0 and not r["kept"]
        else:
            assert (r["n_links"], r["component_id"], r["kept"]) == (n[r["vec_id"]], root[r["vec_id"]], root[r["vec_id"]] == r["vec_id"])


@pytest.mark.parametrize("tile", [suffix.TILE, 2])
def test_op6(spark, tables, monkeypatch, tile):
    monkeypatch.setattr(suffix, "TILE", tile)
    at, docs = tables
    seen = Counter(b[s : s + 200] for _, t, _ in docs for b in [(t or "").encode()] for s in range(len(b) - 199))
    got = {r["doc_id"]: r for r in suffix.op6_suffix_dedup(spark, at).collect()}
    for i, t, _ in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 199):
            if seen[b[s : s + 200]] > 1:
                gone[s : s + 200] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), gone.sum(), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest()), i


def test_op7(spark, tables):
    at, _ = tables
    turns = spark.read.parquet(f"{at}/conversations.parquet").collect()
    every = [(r["conv_id"], r["turn"], r["role"] or "", r["text"] or "") for r in turns] + [(-1, k, r, "</s>[INST] ok [/INST]") for k, r in enumerate(("user", "assistant"))]
    got = {r["conv_id"]: r for r in chat.op7_chat_formatting(spark, at).collect()}
    assert set(got) == {e[0] for e in every}
    for c, r in got.items():
        own = sorted(e[1:] for e in every if e[0] == c)
        loss = "".join(t for _, role, t in own if role == "assistant")
        assert r["n_turns"] == len(own) and r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in own).encode()).hexdigest()


def test_op7_round_trip():
    rnd = random.Random(2)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "[ROLE ", "[/ROLE]", "]", "\\", " ", "a", "<", "/", "s>", "[", "\n"]
    for _ in range(3000):
        role, text = rnd.choice(["user", "assistant", "system", "a]b", ""]), "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 8)))
        s, got = chat.settle(role, text)
        assert got[:2] == (role, text) and chat.parse(s + s)[1][:2] == (role, text)


def test_op8(spark, tables):
    at, docs = tables
    got = {r["doc_id"]: r for r in quality.op8_quality_rules(spark, at).collect()}
    for i, t, _ in docs:
        w, lines = words(t), [x for x in (t or "").encode().split(b"\n") if words(x.decode())]
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {k + d for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for d in range(3)}
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(len(x.decode()) for x in w), len(lines) - len(set(lines)), len(hit))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])


def test_op8_bound():
    assert abs(quality.upper_bound(0, 100, 0.05) - (1 - 0.05**0.01)) < 1e-9
    assert quality.upper_bound(3, 3, 0.05) == 1 and quality.upper_bound(1, 1000, 0.01) < 0.01


def test_op9(spark, tables):
    at, docs = tables
    sets = []
    for _, t, _ in docs:
        w = low(t)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    links = [(a, b) for a in range(len(docs)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    links += [(a, b) for a in range(len(docs)) for b in range(a) if docs[a][0] is not None and docs[a][0] == docs[b][0]]
    root = groups(len(docs), links)
    got = {r["doc_id"]: r for r in jaccard.op9_jaccard(spark, at).collect()}
    for k, (i, _, _) in enumerate(docs):
        want = min((docs[j][0] for j in range(len(docs)) if root[j] == root[k] and docs[j][0] is not None), default=None)
        assert (got[i]["n_shingles"], got[i]["component_id"]) == (len(sets[k]), want)


def test_op9_bitmaps_lose_nothing():
    rnd = np.random.default_rng(4)
    for _ in range(300):
        n = int(rnd.integers(1, 300))
        a = np.unique(rnd.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.append(a[: int(n * rnd.uniform(0.6, 1))], rnd.integers(0, 2**63, int(rnd.integers(0, 60))).astype(np.uint64)))
        x = jaccard.folded([jaccard.bitmap(a), jaccard.bitmap(b)])
        ok = jaccard.possible(len(a), len(b), int(np.bitwise_count(x[0] & ~x[1]).sum()), int(np.bitwise_count(x[1] & ~x[0]).sum()))
        assert ok or not jaccard.linked(a, b)


def test_op10(spark, tables):
    at, docs = tables
    got = mixing.op10_mixing(spark, at).collect()
    assert len(got) == len(docs)
    size = Counter()
    for _, t, s in docs:
        size[s] += len(words(t))
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
    where = {(i, len(words(t))): s for i, t, s in docs}
    taken = Counter()
    for r in got:
        s = where[r["doc_id"], r["size"]]
        assert math.isclose(r["target"], target[s]) and r["source_size"] == size[s] and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    largest = max(len(words(t)) for _, t, _ in docs)
    assert all(abs(taken[s] - target[s]) <= 2 * largest for s in names)
    assert sorted(map(str, got)) == sorted(map(str, mixing.op10_mixing(spark, at).collect()))


def test_op10_shards(spark, tables):
    """Shards are what a brute-force splitting tree deals, block by block; the stage's rows are in order of shard and place."""
    at, docs = tables
    num = lambda *p: int(hashlib.md5("/".join("~" if x is None else str(x) for x in p).encode()).hexdigest()[:15], 16)
    got = mixing.op10_mixing(spark, at).collect()
    source = {(i, len(words(t))): s for i, t, s in docs}
    draws = Counter()
    for r in got:
        key = (source[r["doc_id"], r["size"]], num(r["doc_id"], "mix", "block") % mixing.BLOCKS)
        if r["taken"]:
            draws[key] = max(draws[key], r["taken"] // r["size"])
    nodes = {0: [(s, b, c) for (s, b), n in draws.items() for c in range(1, n + 1)]}
    for level in range(mixing.LEVELS):
        down = {}
        for node, own in nodes.items():
            own = sorted(own, key=lambda x: num(*x, "mix", level))
            half = (len(own) + num(node, "mix", level, "odd") % 2) // 2
            down |= {2 * node: own[:half], 2 * node + 1: own[half:]}
        nodes = down
    shard = {x: node for node, own in nodes.items() for x in own}
    assert max(map(len, nodes.values())) - min(map(len, nodes.values())) <= mixing.LEVELS
    for r in got:
        s = source[r["doc_id"], r["size"]]
        b = num(r["doc_id"], "mix", "block") % mixing.BLOCKS
        assert r["shards"] == [shard[s, b, c] for c in range(1, len(r["shards"]) + 1)] and r["taken"] == r["size"] * len(r["shards"])
    table = spark.read.parquet(f"{at}/documents.parquet")
    want = []
    for r in got:
        want += [(k, num(r["doc_id"], c, "mix", "place"), r["doc_id"]) for c, k in enumerate(r["shards"], 1)]
    ordered = [x[2] for x in sorted(want, key=lambda x: x[:2])]
    assert [r["doc_id"] for r in mixing.mixing_stage(spark, table, at).collect()] == ordered


QUERIES = (scoring.op1_lm_scoring, toxicity.op2_toxicity, pii.op3_pii, packing.op4_packing, vectors.op5_vectors, suffix.op6_suffix_dedup, quality.op8_quality_rules, jaccard.op9_jaccard, mixing.op10_mixing)


@pytest.mark.parametrize("query", QUERIES, ids=lambda q: q.__name__)
def test_empty(spark, empty, query):
    assert query(spark, empty).count() == 0


def test_pipeline(spark, tables):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    at, _ = tables
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, at)
        if k < 4:
            assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert docs.count() > 0

"""Language-model scores of documents: a unigram base and a causal self-attention model, both learnt from the corpus.

1.  Texts are split once: a row of the table of texts holds some documents of a partition, their distinct words and which word stands at each place.
    From it the words are counted, with a bounded dictionary for each task before the shuffle. Held-out documents count towards how heavy
    a word is, never towards what is learnt.
2.  Every word keeps its counts by expert (a language); what spells words by subword symbols is counted over the vocabulary. Nothing is dropped
    for being rare: words above a share of the corpus (1 in HEAVY) are broadcast, the counts of the others come to each row of texts by a join on
    the word's hash. Where a count comes from does not change the result.
3.  The attention model (`attention`) is trained by local gradient steps: each task trains on all blocks of every training document of its
    partition, and the tasks' parameters are averaged as a tree. ROUNDS of it.
4.  Every whole text is scored in place.

What is broadcast: parameters and spelling by id of the public vocabulary, and the heavy words, HEAVY at most.

Defined results: a null or empty text is its end token alone; a null id is hashed as empty text; repeated rows score alike;
an empty table gives no rows. Further columns are not read. The 64-bit hashes of a row of texts (ids and words) and of a word stand for them.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmill.llm import attention as A
from signalmill.llm.common import dropped, load, raw, remainder, remainder_col, stored

HEAVY, EXPERTS, ROUNDS, FOLD, HELD = 1 << 21, 4, 1, 7, 2
#: Counts that an expert's spelling takes from the spelling of all of them.
BACKOFF = 1000.0
#: A word longer than that is not broadcast, so that broadcast bytes are bounded too.
LONGEST = 64
FLUSH, DOCS, WINDOWS = 800_000, 200, 512
#: Bytes of texts that are split into words at once.
PIECE = 2 << 20
#: Tokens that a task trains on, about: each task leaves a copy of the parameters, so their number must not follow that of the input's partitions.
TRAINED = 1 << 21


class Tokens:
    """Words of texts, all in Arrow: the distinct ones, which of them stands at each place, and how many each text has."""

    def __init__(self, texts: pa.Array):
        # Arrow lowers A-Z and splits on exactly SPACE, but leaves an empty word where a text begins or ends with it.
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        words, ends = lists.flatten(), lists.value_lengths().to_numpy().cumsum()
        there = pc.not_equal(words, "")
        n = np.append(0, np.cumsum(there.to_numpy(zero_copy_only=False)))
        self.sizes = np.diff(n[np.append(0, ends)])
        known = words.filter(there).dictionary_encode()
        kinds = known.dictionary.cast(pa.binary())
        #: Joined by blanks, as no word has one.
        self.joined: bytes = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(kinds)], pa.int32()), kinds), b" ")[0].as_py()
        self.places = known.indices.to_numpy()

    @property
    def kinds(self) -> list[bytes]:
        return self.joined.split()

    def pairs(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, kind) of each kind in each text, once, of the kinds that are marked."""
        texts, n = np.repeat(np.arange(len(self.sizes)), self.sizes), max(1, len(which))
        own = which[self.places]
        at = np.unique(texts[own] * n + self.places[own])
        return at // n, at % n


def slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about PIECE bytes."""
    n = max(1, b.num_rows * PIECE // max(1, b.nbytes))
    for s in range(0, b.num_rows, n):
        yield b.slice(s, n)


TEXTS = "struct<words: binary, sizes: binary, places: binary>"


def texts(docs: DataFrame) -> DataFrame:
    """doc_id, lang (arrays), text: rows of some documents, their texts as distinct words, words of each text and the word at each place. docs: doc_id, lang, text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chain.from_iterable(map(slices, batches)):
            t = Tokens(b.column(2))
            data = t.joined, t.sizes.astype(np.int32).tobytes(), t.places.astype(np.uint16 if t.places.max(initial=0) < 1 << 16 else np.int32).tobytes()
            lists = [pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(c)) for c in (0, 1)]
            text = pa.StructArray.from_arrays([pa.array([x], pa.binary()) for x in data], ["words", "sizes", "places"])
            yield pa.RecordBatch.from_arrays([*lists, text], names=["doc_id", "lang", "text"])

    return docs.select("doc_id", "lang", "text").mapInArrow(run, f"doc_id array<{kind}>, lang array<string>, text {TEXTS}")


def unpacked(text: pa.StructScalar) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Words (joined by blanks), sizes and places of a row of texts()."""
    words, sizes, places = (text[x].as_buffer() for x in ("words", "sizes", "places"))
    n = np.frombuffer(sizes, np.int32).astype(np.int64)
    total = int(n.sum())
    return words.to_pybytes(), n, np.frombuffer(places, np.uint16 if len(places) == 2 * total else np.int32)


def row_hash() -> Column:
    return F.xxhash64("doc_id", "text")


def word_hashes(words: Iterable[bytes], n: int = -1) -> np.ndarray:
    """The same as Spark's xxhash64 of each word."""
    return np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, n).view(np.int64)


def word_counts(rows: DataFrame) -> DataFrame:
    """word, lang, seen (in training documents), every (in all), added up as far as a task's dictionary goes. rows: of texts()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[A.Index, list[np.ndarray]]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, (index, (n,)) in known.items():
                n = n[: len(index)]
                yield pa.RecordBatch.from_arrays([pa.array(list(index), pa.binary()).cast(pa.string()), pa.array([lang] * len(n), pa.string()), pa.array(n[:, 0]), pa.array(n.sum(1))], names=["word", "lang", "seen", "every"])
            known.clear()

        for b in batches:
            for ids, langs, text in zip(*b.columns, strict=True):
                words, sizes, places = unpacked(text)
                kinds, own = words.split(), {}
                group = np.fromiter((2 * own.setdefault(x or "", len(own)) for x in langs.as_py()), np.int64, len(sizes))
                group += [remainder(i, FOLD) == HELD for i in ids.as_py()]
                group = group.repeat(sizes)
                order = np.argsort(group >> 1, kind="stable") if len(own) > 1 else np.arange(len(group))
                ends = np.cumsum(np.bincount(group >> 1, minlength=len(own)))
                for lang, part in zip(own, np.split(order, ends[:-1]), strict=True):
                    # Kinds in learnt and in held-out texts side by side; a language of few words does not go through all of them.
                    code = 2 * places[part].astype(np.int64) + (group[part] & 1)
                    if len(part) < len(kinds):
                        code, times = np.unique(code, return_counts=True)
                        at = np.unique(code >> 1)
                        n = np.zeros((len(at), 2), np.int64)
                        n[np.searchsorted(at, code >> 1), code & 1] = times
                    else:
                        n = np.bincount(code, minlength=2 * len(kinds)).reshape(-1, 2)
                        at = np.flatnonzero(n.any(1))
                        n = n[at]
                    index, sums = known.setdefault(lang, (A.Index(), [np.zeros((0, 2), np.int64)]))
                    to = np.fromiter((index[kinds[k]] for k in at.tolist()), np.int64, len(at))
                    index.new.clear()
                    if len(index) > len(sums[0]):
                        sums[0] = np.concatenate([sums[0], np.zeros((max(len(index) - len(sums[0]), len(sums[0])), 2), np.int64)])
                    sums[0][to] += n
                if sum(len(index) for index, _ in known.values()) > FLUSH:
                    yield from flush()
        yield from flush()

    return rows.select("doc_id", "lang", "text").mapInArrow(run, "word string, lang string, seen long, every long")


def symbol_counts(words: DataFrame, experts: int) -> np.ndarray:
    """Kinds of words by first and by further symbol: (2, SYMBOLS, experts). words: word, c0, c1, ..; SYMBOLS rows for each expert and place at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((2, A.SYMBOLS, experts), np.int64)
        for b in batches:
            if b.num_rows:
                symbols, n = A.pieces([raw(w) for w in b.column(0).to_pylist()])
                first = np.zeros(len(symbols), bool)
                first[np.cumsum(n) - n] = True
                for e in range(experts):
                    known = np.repeat(b.column(e + 1).to_numpy() > 0, n)
                    for place, here in enumerate((first & known, ~first & known)):
                        out[place, :, e] += np.bincount(symbols[here], minlength=A.SYMBOLS)
        at = np.nonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at[0].astype(np.int32)), pa.array(at[1].astype(np.int32)), pa.array(at[2].astype(np.int32)), pa.array(out[at])], names=["place", "sym", "expert", "n"])

    # Dealt anew by word, as the stored vocabulary is few files for the work that it takes.
    rows = words.select("word", *(f"c{e}" for e in range(experts))).repartition("word").mapInArrow(run, "place int, sym int, expert int, n long")
    got = rows.groupBy("place", "sym", "expert").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((2, A.SYMBOLS, experts))
    out[tuple(got[c].to_numpy() for c in ("place", "sym", "expert"))] = got["n"].to_numpy()
    return out


def large_languages(docs: DataFrame) -> list[str]:
    """Languages of a sixteenth of the training documents and more, the EXPERTS largest of them. docs: lang, n."""
    total = docs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    large = {r["lang"]: r["n"] for r in docs.where(F.col("n") * 16 >= total).where("n > 0").collect()}  # 16 rows at most
    return sorted(large, key=lambda x: (-large[x], x))[:EXPERTS]


def vocabulary(counts: DataFrame, experts: list[str]) -> DataFrame:
    """word, hash, seen, every and c0, c1, ..: times seen by each expert; the last is every language that has none of its own."""
    expert = F.coalesce(*(F.when(F.col("lang") == x, e) for e, x in enumerate(experts)), F.lit(len(experts)))
    by = [F.sum(F.when(F.col("e") == e, F.col("seen")).otherwise(0)).alias(f"c{e}") for e in range(len(experts) + 1)]
    return counts.withColumn("e", expert).groupBy("word").agg(F.sum("seen").alias("seen"), F.sum("every").alias("every"), *by).withColumn("hash", F.xxhash64("word"))


def fit_experts(words: DataFrame, ends: np.ndarray) -> tuple[A.Experts, np.ndarray]:
    """Experts from the vocabulary and their numbers of documents, and the weight of each subword id under each of them."""
    k = len(ends)
    sums = words.agg(*(F.coalesce(F.sum(f"c{e}"), F.lit(0)).alias(f"n{e}") for e in range(k)), *(F.count_if(F.col(f"c{e}") > 0).alias(f"v{e}") for e in range(k))).first()
    tokens, kinds = (np.array([float(sums[f"{x}{e}"]) for e in range(k)]) for x in "nv")
    spelt = symbol_counts(words, k)
    every = spelt.sum(2) + 0.1
    spelt += BACKOFF * (every / every.sum(1, keepdims=True))[..., None]  # what one expert has not met, others may have
    share = spelt / spelt.sum(1, keepdims=True)
    logs = np.log(share)
    mass = share.sum(0).reshape(A.IDS, 2, k).sum(1)
    return A.Experts(tokens + ends, np.maximum(kinds, 1), ends, logs[0], logs[1]), mass


def packed(words: DataFrame, experts: A.Experts) -> A.Heavy:
    """Heavy words on the driver, in order, with their symbols and log probabilities."""
    k = len(experts.ends)
    t = words.select("word", *(f"c{e}" for e in range(k))).toArrow().sort_by("word")
    ws = [raw(w) for w in t["word"].to_pylist()]
    counts = np.stack([t[f"c{e}"].to_numpy() for e in range(k)], axis=1).astype(np.float64)
    symbols, n = A.pieces(ws)
    return b" ".join(ws), counts.sum(1), n.astype(np.int32), symbols.astype(np.int32), experts.logs(counts, symbols, n).astype(np.float32)


def numbered(rows: DataFrame, heavy: A.Heavy) -> DataFrame:
    """Rows of texts with numbers (of heavy words, -1: another one) instead of words, and the other words in words, joined by blanks."""
    shared = rows.sparkSession.sparkContext.broadcast(heavy[0])
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value.split()
        own = dict(zip(words, range(2, 2 + len(words)), strict=True))
        for b in batches:
            for ids, text in zip(*b.columns, strict=True):
                kinds = text["words"].as_buffer().to_pybytes().split()
                numbers = np.fromiter((own.get(w, -1) for w in kinds), np.int32, len(kinds))
                others = b" ".join([kinds[i] for i in np.flatnonzero(numbers < 0).tolist()])
                parts = [pa.array([others.decode()]), *(pa.array([x], pa.binary()) for x in (text["sizes"].as_py(), text["places"].as_py(), numbers.tobytes()))]
                own_ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.values)
                yield pa.RecordBatch.from_arrays([own_ids, pa.StructArray.from_arrays(parts, ["words", "sizes", "places", "numbers"])], names=["doc_id", "text"])

    out = rows.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text struct<words: string, sizes: binary, places: binary, numbers: binary>")
    return stored(out, "numbered", codec="zstd")


def with_light(rows: DataFrame, light: DataFrame, k: int) -> DataFrame:
    """row and light, for each row of numbered() by row_hash(): counts by expert (joined by commas) of its words that are not heavy, each with its
    place among them. light: rows of vocabulary()."""
    counts = light.select("hash", F.concat_ws(",", *(F.col(f"c{e}").cast("string") for e in range(k))).alias("c"))
    words = rows.where("text.words != ''").select(row_hash().alias("row"), F.split("text.words", " ").alias("words"))  # once a row, before they are exploded
    got = words.select("row", F.posexplode("words").alias("at", "word")).select("row", "at", F.xxhash64("word").alias("hash")).join(counts, "hash")
    return stored(got.groupBy("row").agg(F.collect_set(F.struct("at", "c")).alias("light")), "light", codec="zstd")  # equal rows have one


def joined(docs: DataFrame, light: DataFrame) -> DataFrame:
    """doc_id, text and light of each row of numbered(); light: of with_light(). Each reader joins for itself, so that no copy of the texts is stored."""
    return docs.select("doc_id", "text", row_hash().alias("row")).join(light, "row", "left").select("doc_id", "text", "light")


class Scorer:
    """Words, their numbers, and the network, as a Python process holds them."""

    def __init__(self, experts: A.Experts, heavy: A.Heavy, params: dict[str, np.ndarray]):
        self.words, self.net = A.Words(experts, heavy), A.Network(params)

    def docs(self, text: pa.StructScalar, light: pa.ListScalar) -> list[np.ndarray]:
        """Numbers of the words of each document of a row."""
        _, sizes, places = unpacked(text)
        numbers = np.frombuffer(text["numbers"].as_buffer(), np.int32).astype(np.int64)
        if light.is_valid:
            counts = light.values
            order = np.argsort(counts.field("at").to_numpy())
            numbers[numbers < 0] = self.words.numbers(text["words"].as_buffer().to_pybytes().split(), counts.field("c").take(pa.array(order)))
        return np.split(numbers[places], np.cumsum(sizes)[:-1])


def train(docs: DataFrame, experts: A.Experts, mass: np.ndarray, heavy: A.Heavy, tasks: int, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Parameters of the network, by so many tasks at most. docs: of joined(). Each round every block of every training document takes part in its task's gradient steps."""
    spark = docs.sparkSession
    params = A.initial(mass)
    heavy = (b"", *heavy[1:])  # rows have the numbers of heavy words
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast((experts, heavy, params))

        def run(batches: Iterator[pa.RecordBatch], turn: int = turn) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(*shared.value)
            trainer = A.Trainer(scorer.net.p)
            mixer = np.random.default_rng(turn)
            for b in batches:
                for ids, text, light in zip(*b.columns, strict=True):
                    learnt = [d for i, d in zip(ids.as_py(), scorer.docs(text, light), strict=True) if remainder(i, FOLD) != HELD]
                    order = mixer.permutation(len(learnt))  # a row's documents are neighbours in the table
                    for s in range(0, len(order), DOCS):
                        batch = A.Batch(scorer.words, [learnt[i] for i in order[s : s + DOCS]])
                        first, at, stop = A.blocks(batch.sizes)
                        turns = mixer.permutation(len(at))  # all blocks of all texts, in an order that mixes the documents
                        for k in range(0, len(at), WINDOWS):
                            pick = turns[k : k + WINDOWS]
                            trainer.step(batch, first[pick], at[pick], stop[pick])
            if trainer.seen:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([trainer.seen], pa.int64()), pa.array([trainer.loss]), pa.array([A.flat(trainer.net.p)], pa.binary())], names=["id", "n", "loss", "params"])

        got = stored(docs.coalesce(tasks).mapInArrow(run, "id long, n long, loss double, params binary"), "trained")
        while got.count() > 16:  # averages of 16 at a time, until few are left
            got = stored(got.groupBy(F.floor(F.col("id") / 16).alias("id")).applyInPandas(_averaged, "id long, n long, loss double, params binary"), "trained")
        rows = got.toPandas()
        if len(rows):
            params = A.unflat(_averaged(rows.assign(id=0))["params"].iloc[0], params)
        shared.unpersist()
    return params


def _averaged(rows: pd.DataFrame) -> pd.DataFrame:
    total, n = None, rows["n"].sum()
    for data, w in zip(rows["params"], rows["n"], strict=True):
        x = np.frombuffer(data, np.float32).astype(np.float64) * (w / n)
        total = x if total is None else total + x
    return pd.DataFrame({"id": [rows["id"].iloc[0] // 16], "n": [n], "loss": [rows["loss"].sum()], "params": [total.astype(np.float32).tobytes()]})


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, lang, text)."""
    spark = docs.sparkSession
    learnt = F.count_if(remainder_col(F.col("doc_id"), FOLD) != HELD)
    by_lang = stored(docs.groupBy(F.coalesce("lang", F.lit("")).alias("lang")).agg(learnt.alias("n")), "languages")
    large = large_languages(by_lang)
    known = by_lang.where(F.col("lang").isin(*large)) if large else by_lang.where("false")
    own = {r["lang"]: r["n"] for r in known.collect()}
    n_docs = by_lang.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    ends = np.array([own[x] for x in large] + [n_docs - sum(own.values())], float)
    rows = stored(texts(docs), "texts", codec="zstd")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 4 * PIECE)  # few of its rows at once
    words = stored(vocabulary(word_counts(rows), large), "vocabulary")
    sums = words.agg(F.coalesce(F.sum("seen"), F.lit(0)).alias("n"), F.coalesce(F.sum("every"), F.lit(0)).alias("m"), F.count_if(F.col("seen") > 0).alias("v")).first()
    tokens, kinds = sums["n"] + n_docs, sums["v"] + (n_docs > 0)
    least = max(1, math.ceil(sums["m"] / HEAVY))
    experts, mass = fit_experts(words, ends)
    often = (F.col("every") >= least) & (F.length("word") <= LONGEST)
    heavy = packed(words.where(often), experts)  # HEAVY words at most
    numbers = numbered(rows, heavy)
    dropped(rows)
    light = with_light(numbers, words.where(~often), len(ends))
    dropped(words, by_lang)
    laid = joined(numbers, light)
    params = train(laid, experts, mass, heavy, max(1, math.ceil(tokens / TRAINED)))
    shared = spark.sparkContext.broadcast((experts, (b"", *heavy[1:]), params))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        w = scorer.words
        for b in batches:
            for ids, text, light in zip(*b.columns, strict=True):
                docs_ = scorer.docs(text, light)
                got = [len(d) + 1 for d in docs_], [int(w.known[d].sum()) for d in docs_], [float(w.log[d].sum()) for d in docs_], scorer.net.log10(A.Batch(w, docs_))
                held = pa.array([remainder(i, FOLD) == HELD for i in ids.as_py()], pa.bool_())
                yield pa.RecordBatch.from_arrays([ids.values, held, *(pa.array(c, t) for c, t in zip(got, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True))], names=["doc_id", "held_out", "n_tokens", "known", "log", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = laid.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, known long, log double, score double")
    base = F.col("log") + math.log10(n_docs + 1) - F.col("n_tokens") * math.log10(tokens + kinds + 1)
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + int(n_docs > 0)).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(load(spark, sf_dir, "documents", "doc_id", "lang", "text"))

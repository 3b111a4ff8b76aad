"""Near duplicates among vectors by cosine: product quantisation over coarse inverted lists, then exact rerank.

Equal vectors are one class, met once. Classes are assigned to the nearest of K coarse centroids (inverted lists) and the residual is coded
by SUBSPACES codebooks. A query probes each list whose boundary it is near: where x is nearest to c and y to c', and |x - y| <= d, y is within d
of the bisector of c and c' on the other side; noise in n dimensions moves a vector along that one direction by d / sqrt(n), and SLACK of these
deviations are allowed (SLACK = None: all of d, which loses nothing). In a list, asymmetric distances come from a table of the query's
distances to all codewords; with the stored coding error e, |y - x| >= |y - code(x)| - e, so what is dropped here cannot link.
What is left is compared exactly in double precision.

Centroids and codebooks are fitted on a sample of at most SAMPLE classes; every row is indexed and queried. Long lists are cut into blocks, and a
task holds one block of a list and one of its queries. A task emits counts and, for its links, one edge for each vector to the least of
its component there, not the pairs. A pair that either side finds counts for both.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components link with nothing, and so do
rows without an id. Rows that repeat an id are vectors of their own. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmill.llm.common import components, load, stored

LEAST, SAMPLE, SUBSPACES, CODES, LISTS, SLACK, BLOCK = 0.95, 20_000, 8, 256, 4096, 3.0, 2048
ROWS = 2048


def usable(vector: list | None, size: int | None = None) -> np.ndarray | None:
    """The vector in double precision, or None where it links with nothing."""
    if not vector or any(x is None for x in vector) or size not in (None, len(vector)):
        return None
    x = np.array(vector, np.float64)
    return x if np.isfinite(x).all() and x.any() else None


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def homes(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Nearest row of c for each of x, some rows at a time."""
    return np.concatenate([np.zeros(0, np.int64), *(nearest(x[k : k + ROWS], c)[0] for k in range(0, len(x), ROWS))])


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)
    a = d.argmin(1)
    return a, np.maximum(d, 0)


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        a = homes(x, c)
        n = np.bincount(a, minlength=len(c))
        s = np.zeros_like(c)
        np.add.at(s, a, x)
        c[n > 0] = s[n > 0] / n[n > 0, None]
    return c


class Index:
    """Coarse centroids and residual codebooks."""

    def __init__(self, coarse: np.ndarray, books: list[np.ndarray], slack: float | None):
        self.coarse, self.books, self.slack = coarse, books, slack
        gaps = (coarse * coarse).sum(1)[:, None] - 2 * coarse @ coarse.T + (coarse * coarse).sum(1)
        self.gaps = np.sqrt(np.maximum(gaps, 1e-12))
        self.parts = np.array_split(np.arange(coarse.shape[1]), len(books))
        self.reach = np.sqrt(2 - 2 * LEAST)

    def probes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list of each row, and which lists it probes."""
        home, d = nearest(x, self.coarse)
        allowed = self.reach if self.slack is None else self.slack * self.reach / np.sqrt(x.shape[1])
        return home, (d - d[np.arange(len(x)), home][:, None]) / (2 * self.gaps[home]) <= min(allowed, self.reach)

    def code(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the rows' residuals, and the coding errors."""
        r = x - self.coarse[home]
        codes = np.zeros((len(x), len(self.books)), np.uint8)
        for s, (part, book) in enumerate(zip(self.parts, self.books, strict=True)):
            codes[:, s], _ = nearest(r[:, part], book)
            r[:, part] -= book[codes[:, s]]
        return codes, np.sqrt((r * r).sum(1))

    def distances(self, y: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of queries y to the coded members of list at, by table lookup."""
        r = (y - self.coarse[at]).astype(np.float32)
        out = np.zeros((len(y), len(codes)), np.float32)
        for s, (part, book) in enumerate(zip(self.parts, self.books, strict=True)):
            table = nearest(r[:, part], book.astype(np.float32))[1]
            out += np.take(table, codes[:, s], axis=1)
        return np.sqrt(out)


def fit(sample: np.ndarray, total: int, slack: float | None = SLACK) -> Index:
    """An index for about total classes from a sample of unit rows."""
    coarse = kmeans(sample, int(min(LISTS, max(1, np.sqrt(total) / 2), len(sample))))
    home = homes(sample, coarse)
    r = sample - coarse[home]
    parts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
    return Index(coarse, [kmeans(r[:, p], min(CODES, max(1, len(sample) // 4)), 6) for p in parts], slack)


def _least_label(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of the edges (a, b) and the least vertex of the component of each."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = label.copy()
        np.minimum.at(low, u, label[v])
        np.minimum.at(low, v, label[u])
        low = low[low]
        if (low == label).all():
            return ids, ids[label]
        label = low


def _tile(members: pd.DataFrame, queries: pd.DataFrame, index: Index) -> pd.DataFrame:
    """(rep, links, edge): what the queries link with in a block of one list."""
    out: list[tuple[int, int, int]] = []
    if len(members) and len(queries):
        at = int(members["list"].iloc[0])
        x, y = (unit(np.frombuffer(b"".join(d["vec"]), np.float64).reshape(len(d), -1)) for d in (members, queries))
        codes, err = np.array([np.frombuffer(c, np.uint8) for c in members["codes"]]), members["err"].to_numpy()
        m_id, q_id, m_n, q_n, home = (d.to_numpy() for d in (members["rep"], queries["rep"], members["copies"], queries["copies"], queries["list"]))
        reach = index.reach * (1 + 1e-6) + 1e-5
        m_probes = np.zeros((len(x), len(index.coarse)), bool)
        for k, p in enumerate(members["probes"]):
            m_probes[k, np.frombuffer(p, np.int32)] = True
        pairs = [(np.zeros(0, int), np.zeros(0, int))]
        for s in range(0, len(y), 512):
            near = index.distances(y[s : s + 512], at, codes) - err.astype(np.float32) <= reach
            q, m = np.nonzero(near)
            q += s
            keep = q_id[q] != m_id[m]
            q, m = q[keep], m[keep]
            for t in range(0, len(q), 1 << 17):
                cos = (y[q[t : t + (1 << 17)]] * x[m[t : t + (1 << 17)]]).sum(1)
                hit = np.flatnonzero(cos >= LEAST) + t
                pairs.append((q[hit], m[hit]))
        q, m = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
        if len(q):
            links = np.bincount(q, m_n[m], len(y)).astype(int)
            # A member that does not probe the query's list would not find it there: the query counts for both.
            alone = ~m_probes[m, home[q]]
            back = np.bincount(m[alone], q_n[q[alone]], len(x)).astype(int)
            label = dict(zip(*(v.tolist() for v in _least_label(q_id[q], m_id[m])), strict=True))
            seen = set()
            for ids, n in ((q_id, links), (m_id, back)):
                for i in np.flatnonzero(n):
                    out.append((int(ids[i]), int(n[i]), label[int(ids[i])]))
                    seen.add(int(ids[i]))
            out += [(i, 0, to) for i, to in label.items() if i not in seen]
    return pd.DataFrame(out, columns=["rep", "links", "edge"])


def linked(table: DataFrame, slack: float | None = SLACK) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of table (vec_id, embedding)."""
    spark = table.sparkSession
    id_type = table.schema["vec_id"].dataType.simpleString()
    sizes = table.where("embedding is not null").groupBy(F.size("embedding").alias("s")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "s").limit(1).collect()
    size = sizes[0]["s"] if sizes else 0

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vecs = [usable(v, size) for v in b.column(1).to_pylist()]
            data = [None if v is None else (v + 0.0).tobytes() for v in vecs]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if d is None else xxhash.xxh3_128_hexdigest(d) for d in data], pa.string()), pa.array(data, pa.binary())], names=["vec_id", "key", "vec"])

    rows = stored(table.select("vec_id", "embedding").mapInArrow(keyed, f"vec_id {id_type}, key string, vec binary"), "vectors")
    usable_rows = rows.where("key is not null and vec_id is not null")
    cls = stored(usable_rows.groupBy("key").agg(F.min("vec_id").cast("long").alias("rep"), F.count("*").alias("copies"), F.any_value("vec").alias("vec")), "vector-classes")
    total = cls.count()
    if total == 0:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    share = F.abs(F.xxhash64("key") % 1_000_000) < 1_000_000 * min(1.0, SAMPLE / total)
    sample = [r["vec"] for r in cls.where(share).select("vec").limit(2 * SAMPLE).collect()]
    index = fit(unit(np.frombuffer(b"".join(sample), np.float64).reshape(len(sample), -1)), total, slack)
    shared = spark.sparkContext.broadcast(index)  # LISTS centroids and SUBSPACES * CODES codewords at most

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            if b.num_rows:
                x = unit(np.frombuffer(b"".join(b.column(2).to_pylist()), np.float64).reshape(b.num_rows, -1))
                home, probes = own.probes(x)
                codes, err = own.code(x, home)
                lists = [np.flatnonzero(p).astype(np.int32) for p in probes]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(err), pa.array([p.tobytes() for p in lists], pa.binary()), pa.array(lists, pa.list_(pa.int32()))], names=["rep", "copies", "vec", "list", "codes", "err", "probes", "to"])

    indexed = stored(cls.select("rep", "copies", "vec").mapInArrow(coded, "rep long, copies long, vec binary, list int, codes binary, err double, probes binary, to array<int>"), "vector-index")
    asked = indexed.select("rep", "copies", "vec", "list", F.explode("to").alias("to"))
    cuts = indexed.groupBy("list").agg(F.count("*").alias("n")).join(asked.groupBy(F.col("to").alias("list")).agg(F.count("*").alias("q")), "list")
    cuts = F.broadcast(cuts.select(F.col("list").alias("l"), F.ceil(F.col("n") / BLOCK).cast("int").alias("mb"), F.ceil(F.col("q") / BLOCK).cast("int").alias("qb")))  # LISTS rows at most
    turn = lambda salt, n: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(n)).cast("int")
    members = indexed.drop("to").join(cuts, F.col("list") == F.col("l")).withColumn("i", turn("m", "mb")).withColumn("j", F.explode(F.expr("sequence(0, qb - 1)"))).drop("mb", "qb")
    queries = asked.join(cuts, F.col("to") == F.col("l")).withColumn("j", turn("q", "qb")).withColumn("i", F.explode(F.expr("sequence(0, mb - 1)"))).drop("mb", "qb", "to")
    members, queries = (d.select(*(F.col(c).alias(c) for c in d.columns)) for d in (members, queries))  # columns of their own, not of the shared tables

    def compare(m: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        return _tile(m, q, shared.value)

    found = stored(members.groupBy("l", "i", "j").cogroup(queries.groupBy("l", "i", "j")).applyInPandas(compare, "rep long, links long, edge long"), "vector-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = components(cls.select(F.col("rep").alias("id")), found.select(F.col("rep").alias("a"), F.col("edge").alias("b")))
    known = cls.select("key", "rep", "copies").join(links, "rep", "left").join(comp.select(F.col("id").alias("rep"), "component"), "rep")
    known = known.select("key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), "component")
    out = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("key")).alias("key")).join(known, "key", "left")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", F.col("vec_id").cast("long")).alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(load(spark, sf_dir, "embeddings", "vec_id", "embedding"))


#: All pairs by brute force; for small tables.
OP5_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
r AS (SELECT vec_id AS id, vec_id AS to_id FROM v UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.to_id),
m AS (SELECT id, min(to_id) AS component_id FROM r GROUP BY id)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, m.component_id, v.vec_id = m.component_id AS kept
FROM v JOIN m ON m.id = v.vec_id LEFT JOIN n ON n.a = v.vec_id"""

"""N-gram Jaccard join: all links between texts whose word-shingle sets agree by three quarters or more.

1.  Each text becomes a set of 64-bit shingle hashes; rows with equal sets are one class, known by a 128-bit key of the set, whatever their ids.
2.  Sieve (sieve.py): a set can only link if three quarters of its elements are in other rows' sets too. Rows that pass are few; the rest
    has no link and is done with.
3.  Keys: elements of the classes that passed are counted, and put in order from rare to frequent. Two sets that link share an element of
    the first quarter of each, the prefix. Keys whose classes are the same are one list, kept under the key first in that order.
4.  Tiles: a list's classes are banded by size (a band spans 4/3, so links stay within a band or reach into the next), a large band is cut
    into blocks, and each pair of blocks is a tile of bounded size. In a tile, bitmaps of the sets (up to 16 bits for each element, the
    wider folded to the narrower) bound the overlap from above: |A| - popcount(A and not B). Pairs that pass go to the exact test.
5.  The exact test intersects the sorted arrays of both sets. It is made first for neighbours by size in each block, then for each class' best
    partner of another group, which join most of any large group; then for all pairs of a tile that are not joined yet, each in the
    first list that has both. Components of the links give the groups.

No pair is lost: the sieve errs to one side only (a hash of 32 bits in a bucket may be met twice by chance), and the prefix, size, place and
bitmap bounds are never below the true overlap. Nothing but counts reaches the driver. Pairs inside a group that are joined already are not
enumerated, as the result is each document's group. What stays quadratic is one list's blocks, for a list with several groups in it.

Defined results: a null, empty or blank text has no shingles and links with nothing; with fewer words than a shingle the whole sequence is
the one shingle. Every row links by its own text; rows that repeat an id are also one document to the query's links, whatever their texts. Rows
whose id is null take the smallest id of their group, null if there is none. An empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalmill.llm import sieve
from signalmill.llm.common import components, dropped, load, raw, stored
from signalmill.llm.sieve import text_hash

#: Classes of a list's block; pairs whose bitmaps are met together; bits from which a bitmap takes fewer for each element, and its widest. A narrower
#: one only bounds less sharply.
WORDS, TILE, CHUNK, WIDE, WIDEST = 5, 4096, 1 << 15, 1 << 13, 1 << 16
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's runs of width words, lower-cased in A-Z."""
    words = raw(text).lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out = np.zeros(max(1, len(h) - width + 1), np.uint64)
    if len(h) < width:
        for x in h:
            out = _mixed(out + x + _MIX[0])
        return out
    for k in range(width):
        out = _mixed(out * _MIX[0] + h[k : k + len(out)])
    return np.unique(out)


def prefix_size(n: int) -> int:
    return n - (3 * n + 3) // 4 + 1 if n else 0


def bitmap(hashes: np.ndarray) -> bytes:
    """A bit for each hash; as many bits as the next power of two from 16 times the set's size up to WIDE, from then on 4 times; 64 at least, WIDEST at most."""
    above = lambda x: 1 << (x * len(hashes) - 1).bit_length()
    width = min(WIDEST, max(64, above(4), min(WIDE, above(16))))
    bits = np.zeros(width, bool)
    bits[(hashes & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def folded(maps: list[bytes]) -> np.ndarray:
    """Bitmaps as words, each folded by halves to the narrowest of them."""
    least = min(map(len, maps))
    return np.stack([np.bitwise_or.reduce(np.frombuffer(m, np.uint64).reshape(-1, least // 8), axis=0) for m in maps])


def possible(size_a, size_b, only_a, only_b) -> np.ndarray:
    """Whether 7 * overlap >= 3 * (a + b) can hold when at least so many elements are in one set alone."""
    most = np.minimum(size_a - only_a, size_b - only_b)
    return 7 * most >= 3 * (size_a + size_b)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 7 * common >= 3 * (len(a) + len(b))


def set_key(s: np.ndarray) -> str | None:
    return xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None


def sieved(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key, th (a hash of the text) and hits (elements that other rows have too) for each row of docs (doc_id, text)."""

    def elements(text: str | None) -> tuple[np.ndarray, tuple]:
        s = shingles(text)
        return s, (len(s), set_key(s))

    return sieve.sieved(docs, elements, {"n_shingles": "long", "set_key": "string"})


# Keys, tiles and links


def _sets(texts: DataFrame) -> DataFrame:
    """cid, n, set (sorted hashes) and bits of each row of texts (cid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t) for t in b.column(1).to_pylist()]
            cols = ([len(s) for s in sets], [s.tobytes() for s in sets], [bitmap(s) for s in sets])
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.binary()), strict=True))], names=["cid", "n", "set", "bits"])

    return texts.select("cid", "text").mapInArrow(run, "cid long, n long, set binary, bits binary")


def _elements(classes: DataFrame) -> DataFrame:
    """k, cid, n for each element k of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cid, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            keys = np.frombuffer(b"".join(b.column(2).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(cid, n)), pa.array(np.repeat(n, n))], names=["k", "cid", "n"])

    return classes.select("cid", "n", "set").mapInArrow(run, "k long, cid long, n long")


def _lists(classes: DataFrame) -> DataFrame:
    """k, cid, n, pos (the key's place in the class' order from rare to frequent), earlier (the class' lists before, in that order)."""
    elements = _elements(classes)
    counted = elements.groupBy("k").agg(F.count("*").alias("df")).where("df > 1")
    own = elements.join(counted, "k").groupBy("cid", "n").agg(F.array_sort(F.collect_list(F.struct("df", "k"))).alias("keys"))  # of one text
    prefix = F.expr("n - (3 * n + 3) div 4 + 1")
    own = own.withColumn("alone", F.col("n") - F.size("keys")).withColumn("left", (prefix - F.col("alone")).cast("int")).where("left > 0")
    rows = own.select("cid", "n", "alone", F.posexplode(F.slice("keys", F.lit(1), F.col("left"))).alias("i", "x"))
    rows = stored(rows.select("cid", "n", (F.col("alone") + F.col("i")).alias("pos"), F.col("x.df").alias("df"), F.col("x.k").alias("k")), "keys")
    # Lists are told apart by their number of classes and two 64-bit sums over them.
    signed = rows.groupBy("k", "df").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("cid")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "cid")).alias("y")).where("m > 1")
    kept = signed.groupBy("m", "x", "y").agg(F.min(F.struct("df", "k")).alias("first")).select(F.col("first.k").alias("k"))
    before = F.collect_list("k").over(Window.partitionBy("cid").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))  # of one text
    out = stored(rows.join(kept, "k").select("k", "cid", "n", "pos", before.alias("earlier")), "lists")
    dropped(rows)
    return out


def _tiles(lists: DataFrame, bits: DataFrame, comps: DataFrame | None, best: bool = False) -> DataFrame:
    """a, b, score: possible pairs of a list's classes, in the first list that both are in.

    Without comps (cid, comp) neighbours by size in each block; with them all pairs of different groups, or for each class its best one of a
    tile. score bounds the share of what both have, from above.
    """
    chain = comps is None
    rows = lists.withColumn("comp", F.col("cid")) if chain else lists.join(comps, "cid")
    own = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(4 / 3)) + F.lit(1e-9)).cast("int")
    rows = rows.withColumn("own", own).withColumn("band", F.explode(F.array("own", F.col("own") + 1)))
    tile = rows.groupBy("k", "band").agg(F.count("*").alias("c"), F.max(F.col("own") == F.col("band")).alias("owned"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    tile = tile.where("c > 1 and owned and lo <> hi").select("k", "band", F.ceil(F.col("c") / TILE).cast("int").alias("blocks"))
    rows = rows.join(tile, ["k", "band"]).withColumn("i", F.pmod(F.xxhash64("k", "cid"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("j", F.col("i") if chain else F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("t", F.xxhash64("k", "band", F.least("i", "j"), F.greatest("i", "j")))

    def one(ids, sizes, places, maps, comps, own, block, earlier) -> Iterator[pa.RecordBatch]:
        if len(ids) < 2 or len(set(comps)) < 2:
            return
        n, at, c, o, blk, i = np.array(sizes), np.array(places), np.array(comps), np.array(own), np.array(block), np.array(ids)
        width = np.array([len(m) for m in maps])
        rows, row = {}, np.zeros(len(i), np.int64)
        for w in np.unique(width):
            mine = np.flatnonzero(width == w)
            rows[w], row[mine] = np.frombuffer(b"".join(maps[k] for k in mine), np.uint64).reshape(len(mine), -1), np.arange(len(mine))
        # A bit for each earlier list that two classes of the tile are in.
        member = np.repeat(np.arange(len(i)), [len(x) for x in earlier])
        _, inverse, count = np.unique(np.array([k for x in earlier for k in x], np.int64), return_inverse=True, return_counts=True)
        number = np.cumsum(count > 1) - 1
        met = np.zeros((len(i), -(-max(1, int((count > 1).sum())) // 64) * 64), bool)
        if len(member):
            twice = count[inverse] > 1
            met[member[twice], number[inverse[twice]]] = True
        met = np.packbits(met, axis=1).view(np.uint64)
        found: list[tuple[np.ndarray, ...]] = []

        def bounded(u: np.ndarray, v: np.ndarray) -> None:
            for k in range(0, len(u), CHUNK):
                p, q = u[k : k + CHUNK], v[k : k + CHUNK]
                new = ~(met[p] & met[q]).any(1)
                p, q = p[new], q[new]
                for wp, wq in set(zip(width[p].tolist(), width[q].tolist(), strict=True)):
                    here = np.flatnonzero((width[p] == wp) & (width[q] == wq))
                    w = min(wp, wq) // 8
                    for s in range(0, len(here), step := max(1, (1 << 22) // max(wp, wq))):
                        a, b = p[here[s : s + step]], q[here[s : s + step]]
                        x, y = (np.bitwise_or.reduce(z.reshape(len(z), -1, w), axis=1) for z in (rows[wp][row[a]], rows[wq][row[b]]))
                        only, back = np.bitwise_count(x & ~y).sum(1, dtype=np.int64), np.bitwise_count(y & ~x).sum(1, dtype=np.int64)
                        good = possible(n[a], n[b], only, back)
                        if good.any():
                            score = np.minimum(n[a] - only, n[b] - back) / (n[a] + n[b])
                            found.append((a[good], b[good], score[good]))

        left = n - at
        if chain:
            order = np.lexsort((i, n))
            p, q = order[:-1], order[1:]
            ok = 7 * np.minimum(left[p], left[q]) >= 3 * (n[p] + n[q])
            bounded(p[ok], q[ok])
        else:
            split = blk.min() != blk.max()
            for s in range(0, len(i), 256):
                e = min(len(i), s + 256)
                # If this key is the first that both hold, the overlap is at most what is left from it on; else an earlier key's list has the pair.
                ok = (7 * np.minimum(left[s:e, None], left[None]) >= 3 * (n[s:e, None] + n[None])) & (c[s:e, None] != c[None]) & (i[s:e, None] < i[None]) & (o[s:e, None] | o[None])
                if split:
                    ok &= blk[s:e, None] != blk[None]
                u, v = np.nonzero(ok)
                bounded(u + s, v)
        if not found:
            return
        a, b, score = (np.concatenate(x) for x in zip(*found, strict=True))
        if best:
            a, b, score = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([score, score])
            order = np.lexsort((-score, a))
            a, b, score = a[order], b[order], score[order]
            first = np.append(True, a[1:] != a[:-1])
            a, b, score = a[first], b[first], score[first]
        for k in range(0, len(a), CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array(i[a[k : k + CHUNK]]), pa.array(i[b[k : k + CHUNK]]), pa.array(score[k : k + CHUNK])], names=["a", "b", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, tuple([] for _ in range(8))
        for b in batches:
            for t, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if t != last:
                    yield from one(*held)
                    last, held = t, tuple([] for _ in range(8))
                for to, v in zip(held, row, strict=True):
                    to.append(v)
        yield from one(*held)

    slim = rows.select("cid", "t", "n", "pos", "comp", (F.col("own") == F.col("band")).alias("o"), "i", "earlier").join(bits, "cid")
    found = slim.select("t", "cid", "n", "pos", "bits", "comp", "o", "i", "earlier").repartition("t").sortWithinPartitions("t").mapInArrow(run, "a long, b long, score double")
    if best:
        found = found.groupBy("a").agg(F.max_by("b", F.struct("score", -F.col("b"))).alias("b"))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) that link, by the exact intersection of their sorted arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    one, two = (sets.select(F.col("cid").alias(x), F.col("set").alias(f"s{x}")) for x in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _same_id(rows: DataFrame, by_key: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes that rows of one id have; every other class of an id is paired with its first."""
    several = rows.where("doc_id is not null and n_shingles > 0").groupBy("doc_id").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).where("lo <> hi")
    pairs = rows.join(several.select("doc_id", "lo"), "doc_id").where("set_key <> lo").select("lo", "set_key").distinct()
    return pairs.join(by_key.select("set_key", F.col("cid").alias("b")), "set_key").join(by_key.select(F.col("set_key").alias("lo"), F.col("cid").alias("a")), "lo").select("a", "b")


def _joined(ids: DataFrame, links: DataFrame) -> DataFrame:
    return stored(components(ids, links).select(F.col("id").alias("cid"), F.col("component").alias("comp")), "comps")


def groups(rows: DataFrame, docs: DataFrame, by_id: bool) -> DataFrame:
    """set_key, g (number of the group) and component (its smallest id) of each set. rows: of sieved(docs); docs: doc_id, text; by_id: rows of one id link."""
    by_key = rows.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.max("hits").alias("hits"), F.first("n_shingles").alias("n"), F.min("th").alias("th"))
    by_key = stored(by_key.withColumn("cid", F.monotonically_increasing_id()), "classes")
    texts = docs.select("text", text_hash().alias("th")).join(by_key.where("4 * hits >= 3 * n").select("th", "cid"), "th")
    classes = stored(_sets(texts).groupBy("cid").agg(F.first("n").alias("n"), F.first("set").alias("set"), F.first("bits").alias("bits")), "sets")
    lists, bits = _lists(classes), classes.select("cid", "bits")
    near = stored(_verified(_tiles(lists, bits, None), classes), "links")
    comps = _joined(lists.select(F.col("cid").alias("id")).distinct(), near)
    nearest = stored(_verified(_tiles(lists, bits, comps, True), classes), "links")
    wider = _joined(comps.select(F.col("cid").alias("id")), near.unionByName(nearest))
    dropped(near, nearest, comps)
    comps = wider
    more = stored(_verified(_tiles(lists, bits, comps), classes), "links")
    if by_id:
        more = more.unionByName(stored(_same_id(rows, by_key), "same-id"))
    # Groups so far are the nodes of what is left to join; a class that met no other is its own.
    a, b = (comps.select(F.col("cid").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab")
    links = more.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    named = by_key.join(comps, "cid", "left").select("set_key", "rep", F.coalesce("comp", "cid").alias("comp"))
    over = components(named.select(F.col("comp").alias("id")).distinct(), links)
    named = stored(named.join(over.select(F.col("id").alias("comp"), F.col("component").alias("g")), "comp").select("set_key", "rep", "g"), "named")
    out = stored(named.join(named.groupBy("g").agg(F.min("rep").alias("component")), "g").select("set_key", "g", "component"), "groups")
    dropped(by_key, classes, lists, comps, named)
    return out


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text)."""
    rows = sieved(docs)
    out = rows.join(groups(rows, docs, True), "set_key", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(load(spark, sf_dir, "documents", "doc_id", "text"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that another one of their group stands for: the row with the group's smallest id stays.

    Rows without shingles stay. Rows of one id are told apart by their texts here. Of several rows with a group's smallest id, or of a group
    without ids, the first by set and then by the row as JSON stays. Every column of docs stays.
    """
    names = docs.columns
    rows = sieved(docs.select("doc_id", "text"))
    found = groups(rows, docs.select("doc_id", "text"), False)
    first = rows.join(found, "set_key").where("doc_id <=> component")
    # The set that stands for a group, and how many rows of it have the group's id.
    sets = first.groupBy("g", "set_key").agg(F.count("*").alias("rows")).groupBy("g").agg(F.min(F.struct("set_key", "rows")).alias("x")).select("g", "x.*")
    stays = first.drop("g").join(sets, "set_key").select("th", F.col("doc_id").alias("id_"), "g", "rows").distinct()
    marked = docs.select(F.struct(*names).alias("row"), F.col("doc_id").cast("long").alias("own_"), text_hash().alias("th"), F.col("text").alias("text_"))
    bare = marked.where(F.coalesce(~F.col("text_").rlike("[^\\x20\\x09-\\x0D]"), F.lit(True))).select("row")
    own = marked.join(stays, "th").where("own_ <=> id_")
    tied = own.where("rows > 1").groupBy("g").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
    return own.where("rows = 1").select("row").unionByName(tied).unionByName(bare).select("row.*")


#: All pairs by brute force on the shingles themselves; for small tables.
OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, hash(unnest(sh)) AS k FROM s), c AS (SELECT doc_id, len(sh) AS n FROM s),
f AS (SELECT e.* FROM e WHERE k IN (SELECT k FROM e GROUP BY k HAVING count(*) > 1)),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM f x JOIN f y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b WHERE 100 * i >= 75 * (ca.n + cb.n - i)),
r AS (SELECT doc_id AS id, doc_id AS to_id FROM c UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.to_id)
SELECT c.doc_id, CAST(c.n AS BIGINT) AS n_shingles, m.component_id FROM c JOIN (SELECT id, min(to_id) AS component_id FROM r GROUP BY id) m ON m.id = c.doc_id"""

"""A causal self-attention model over subword ids, in numpy: trained by gradient steps, scored over overlapping windows.

A text is tokens: words (lower-cased in A-Z) and one end. What the network sees of a token are its subword ids: a row of the embedding table for each
id of the public vocabulary, their mean for a token. The probability of a token mixes, with weights from attention,

* a copy head: queries from the token before, keys from the tokens before earlier places, so attention finds what followed in like
  context; its weight lands on those places' tokens (a sink takes the weight when nothing fits);
* experts, one a language: counts of all words of all its training documents, Witten-Bell smoothed with a spelling of the word by its
  subword symbols; a second head reads, from values of all places before, which expert the text fits.

All parts are normalised, so the score is a probability. Windows hold BACK + STEP places and move by STEP: each token is scored once, with
at least BACK places before it (or its document's start), all windows of a batch in one masked array.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa

from signalmill.llm.tokens import subwords

STEP, BACK, DIM = 32, 32, 16
SPAN = STEP + BACK
#: Fixed value: ids of the byte-level vocabulary. A symbol is 2 * id + (1 on a word's last). Two more rows stand for the end and for what is before a text.
IDS = 50_257
SYMBOLS, ROWS = 2 * IDS, IDS + 2
#: Numbers of the end and of what is before a text; words are numbered from 2 on.
END, BEFORE = 0, 1
CACHE = 300_000
#: Windows that are computed at once, so that their weights stay in a core's cache. Slopes are added up over them, so it changes no result.
CHUNK = 128
BAGS = ("embed", "value", "loud")


def pieces(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the words one after another, and how many each has."""
    encode = subwords().known.encoder.encode_ordinary  # each word comes once, so nothing is kept
    lists = [encode(" " + w.decode("utf-8", "replace")) for w in words]
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    ids = np.fromiter(chain.from_iterable(lists), np.int64, int(n.sum())) * 2
    ids[np.cumsum(n) - 1] += 1
    return ids, n


class Experts:
    """What is known of each expert: tokens and kinds of its documents, and log probabilities of a word's first and further symbols."""

    def __init__(self, tokens: np.ndarray, kinds: np.ndarray, ends: np.ndarray, first: np.ndarray, inner: np.ndarray):
        self.kinds, self.bottom, self.ends = np.log(kinds), np.log(tokens + kinds), np.log(np.maximum(ends, 0.5))
        self.first, self.inner = first.astype(np.float32), inner.astype(np.float32)

    def logs(self, counts: np.ndarray, symbols: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Log probability of each word under each expert, from its counts and its symbols."""
        out = np.zeros((len(n), counts.shape[1]))
        if len(n):
            start = np.cumsum(n) - n
            spelt = self.inner[symbols].astype(np.float64)
            spelt[start] = self.first[symbols[start]]
            with np.errstate(divide="ignore"):
                out = np.logaddexp(np.log(counts), self.kinds + np.add.reduceat(spelt, start)) - self.bottom
        return out


#: Heavy words: joined by blanks, times seen, symbols of each and all symbols, log probabilities.
Heavy = tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


class Index(dict):
    """Number of each word, from a first one on; one that is not there gets the next number and is noted as new."""

    def __init__(self, first: int = 0):
        super().__init__()
        self.first, self.new = first, []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + self.first
        self.new.append(word)
        return n


class Words:
    """What is known of words by number: subword ids, log probabilities, and what the base needs.

    Heavy words are always there; the others come with the documents that hold them.
    """

    def __init__(self, experts: Experts, heavy: Heavy):
        _, seen, n, symbols, logs = heavy
        self.experts = experts
        self.index = Index(2 + len(n))
        self.n, self.ids = np.concatenate([[1, 1], n]), np.concatenate([[IDS, IDS + 1], symbols >> 1])
        self.start = np.cumsum(self.n) - self.n
        self.logs = np.concatenate([[experts.ends - experts.bottom, np.zeros(logs.shape[1])], logs])
        self.log, self.known = np.log10(np.append([0, 0], seen) + 1.0), (np.append([0, 0], seen) > 0).astype(np.int64)
        self.used = self.base = (len(self.n), len(self.ids))

    def _put(self, name: str, at: int, x: np.ndarray) -> None:
        a = getattr(self, name)
        if at + len(x) > len(a):
            more = np.empty((max(2 * len(a), at + len(x)), *a.shape[1:]), a.dtype)
            more[:at] = a[:at]
            setattr(self, name, a := more)
        a[at : at + len(x)] = x

    def numbers(self, kinds: list[bytes], counts: pa.Array) -> np.ndarray:
        """Numbers of words that are not heavy, each of which comes once. counts: times seen by each expert, joined by commas."""
        index = self.index
        if len(index) > CACHE:
            index.clear()
            self.used = self.base
        out = np.fromiter(map(index.__getitem__, kinds), np.int64, len(kinds))
        if new := index.new:
            words, at = self.used
            symbols, n = pieces(new)
            met = counts.take(pa.array(np.flatnonzero(out >= words))).to_pylist()
            times = np.array(",".join(met).split(","), np.float64).reshape(len(new), -1)
            seen = times.sum(1)
            for name, x in (("start", at + np.cumsum(n) - n), ("n", n), ("log", np.log10(seen + 1.0)), ("known", (seen > 0).astype(np.int64)), ("logs", self.experts.logs(times, symbols, n))):
                self._put(name, words, x)
            self._put("ids", at, symbols >> 1)
            self.used = words + len(new), at + len(symbols)
            index.new = []
        return out

    def bags(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Subword ids of the words one after another, and how many each has."""
        n = self.n[numbers]
        ends = np.cumsum(n)
        return self.ids[np.arange(ends[-1]) + np.repeat(self.start[numbers] - (ends - n), n)], n


class Batch:
    """Tokens of some documents one after another, each with its end; kinds of tokens are numbered anew."""

    def __init__(self, words: Words, docs: list[np.ndarray]):
        tokens = np.concatenate([np.append(d, END) for d in docs])
        self.sizes = np.array([len(d) + 1 for d in docs])
        there = np.zeros(words.used[0], bool)
        there[tokens], there[BEFORE] = True, True
        self.kinds, number = np.flatnonzero(there), np.cumsum(there, dtype=np.int32) - 1
        self.token, before = number[tokens], number[BEFORE]
        self.prior = np.append(before, self.token[:-1]).astype(np.int32)
        self.prior[np.cumsum(self.sizes)[:-1]] = before
        logs = words.logs[self.kinds]
        self.scale = logs.max(1)
        self.p = np.exp(logs - self.scale[:, None]).T.astype(np.float32)  # a row for each expert
        self.words = words


def mean_rows(table: np.ndarray, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Means of runs of rows, n long each: the first rows of all runs, the second ones, and so on, long runs first."""
    order = np.argsort(-n, kind="stable")
    start, size = (np.cumsum(n) - n)[order], n[order]
    out = table.take(ids[start], 0)
    longer = np.searchsorted(-size, -np.arange(1, int(n.max(initial=1))), side="left")  # runs of more than d rows, for d = 1, 2, ..
    for d, m in enumerate(longer.tolist(), 1):
        if m < 64:  # few long runs are left
            for k in range(m):
                out[k] += table[ids[start[k] + d : start[k] + size[k]]].sum(0)
            break
        out[:m] += table.take(ids[start[:m] + d], 0)
    out /= size[:, None].astype(out.dtype)
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return out.take(back, 0)


def initial(mass: np.ndarray, seed: int = 3) -> dict[str, np.ndarray]:
    """Parameters at the start: like tokens attract each other; values say which expert a subword speaks for. mass: of each id under each expert."""
    rng = np.random.default_rng(seed)
    k = mass.shape[1]
    share = np.vstack([mass, np.ones((2, k))]) + 1e-7
    values = np.log(share / share.mean(1, keepdims=True))
    values[IDS:] = 0
    out = {"embed": rng.normal(0, 0.6, (ROWS, DIM)), "query": np.eye(DIM) * 1.2, "key": np.eye(DIM) * 1.2, "near": np.linspace(0, 0.5, SPAN)[::-1].copy(), "value": values, "loud": np.zeros(ROWS), "gain": np.eye(k) * 3, "prior": np.zeros(k), "copy": np.array([-2.5]), "copy_c": np.zeros(k)}
    return {n: x.astype(np.float32) for n, x in out.items()}


def flat(params: dict[str, np.ndarray]) -> bytes:
    return b"".join(params[n].astype(np.float32).tobytes() for n in sorted(params))


def unflat(data: bytes, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    x, out, at = np.frombuffer(data, np.float32), {}, 0
    for n in sorted(like):
        out[n] = x[at : at + like[n].size].reshape(like[n].shape).copy()
        at += like[n].size
    return out


_CAUSAL = np.arange(SPAN)[None] < (BACK + np.arange(STEP))[:, None]
_GAP = np.clip(BACK + np.arange(STEP)[:, None] - np.arange(SPAN)[None] - 1, 0, SPAN - 1)


def blocks(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place of its document, its own first place, end of its document) for each window's block of STEP places."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    n = -(-sizes // STEP)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(starts, n), np.repeat(starts, n) + STEP * at, np.repeat(ends, n)


def _add(out: np.ndarray, rows: np.ndarray, x: np.ndarray) -> None:
    """Adds the rows of x to those rows of out. Two columns are added at once, as one complex number."""
    even, pair = x.shape[1] // 2 * 2, np.result_type(x.dtype, np.complex64)
    x = np.ascontiguousarray(x)
    for c in range(0, even, 2):
        np.add.at(out[:, c : c + 2].view(pair)[:, 0], rows, x[:, c : c + 2].view(pair)[:, 0])
    if even < x.shape[1]:
        np.add.at(out[:, even], rows, x[:, even])


def _pairs(seen: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a place of a block has a token that an earlier place of its window has: the block's place, and its place among all cosines."""
    kind = np.uint16 if max(seen.max(initial=0), own.max(initial=0)) < 1 << 16 else np.int32
    like = own.astype(kind)[:, :, None] == seen.astype(kind)[:, None, :]
    like &= _CAUSAL
    eights = np.flatnonzero(like.reshape(-1).view(np.uint64))  # most hold none
    at = np.flatnonzero(like.reshape(-1, 8).take(eights, 0))
    same = eights[at >> 3] * 8 + (at & 7)
    return same // SPAN, same


class Network:
    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params
        self.fuse()

    def fuse(self) -> None:
        self.static = np.where(_CAUSAL, self.p["near"][_GAP], -1e9).astype(self.p["near"].dtype)
        self.bag: np.ndarray | None = None

    def tables(self, words: Words, kinds: np.ndarray, fresh: bool = False) -> dict[str, np.ndarray]:
        """Queries, keys and weighted values of kinds of tokens (fresh: parameters were changed from outside).

        Keys have one more column and, as weighted values, one more row, which stands for places that are not there.
        """
        ids, n = words.bags(kinds)
        p, size = self.p, len(kinds)
        if self.bag is None or fresh:
            self.bag = np.hstack([p["embed"], p["value"], p["loud"][:, None]])
        mean = mean_rows(self.bag, ids, n)
        x, value, loud = mean[:, :DIM], mean[:, DIM:-1], np.exp(np.clip(mean[:, -1:], -5, 5))
        query, key = np.ones((size, DIM + 1), x.dtype), np.zeros((size + 1, DIM + 1), x.dtype)
        query[:, :DIM], key[:size, :DIM], key[size, DIM] = x @ p["query"], x @ p["key"], -1e9
        most = np.sqrt((query[:, :DIM] ** 2).sum(1).max(initial=0) * (key[:size] ** 2).sum(1).max(initial=0)) + p["near"].max()
        weighed = np.zeros((value.shape[1] + 1, size + 1), x.dtype)
        weighed[:-1, :size], weighed[-1, :size] = (loud * value).T, loud[:, 0]
        return {"ids": ids, "n": n, "x": x, "query": query, "key": key, "most": most, "value": value, "loud": loud, "weighed": weighed}

    def forward(self, t: dict[str, np.ndarray], prior: np.ndarray, token: np.ndarray, real: np.ndarray, px: np.ndarray, scale: np.ndarray) -> dict[str, np.ndarray]:
        """Log probability of each place of the blocks. prior, token: kinds (rows of t) of the windows' places; px (a row for each expert), scale: experts' probabilities of the blocks' tokens."""
        p, none = self.p, len(t["n"])
        asked, prior, seen = prior[:, BACK:], np.where(real, prior, none), np.where(real, token, none)
        k, q = t["key"].take(prior, 0), t["query"].take(asked, 0)
        e = np.matmul(q, k.transpose(0, 2, 1))
        e += self.static
        if t["most"] > 20:
            np.minimum(e, 20, out=e)
        np.exp(e, out=e)
        z = 1 + e @ np.ones(SPAN, e.dtype)
        row, same = _pairs(seen, np.where(real[:, BACK:], token[:, BACK:], none + 1))
        met = e.reshape(-1)[same]
        hit = np.bincount(row, met, z.size).reshape(z.shape).astype(z.dtype) / z
        # Experts come first, places last, so that each step runs along the places.
        total = t["weighed"].take(seen, 1)
        total[..., BACK - 1] = total[..., :BACK].sum(2)
        total = np.cumsum(total[..., BACK - 1 : SPAN - 1], axis=2)
        weight = total[-1] + z.dtype.type(1e-3)
        c = total[:-1] / weight
        flat = c.reshape(len(c), -1)
        u = (p["gain"].T @ flat).reshape(c.shape)
        u += p["prior"][:, None, None]
        u -= u.max(0)
        pi = np.exp(u, out=u)
        pi /= pi.sum(0)
        mix = (pi * px).sum(0)
        g = 1 / (1 + np.exp(-np.clip(p["copy"][0] + (p["copy_c"] @ flat).reshape(z.shape), -30, 30)))
        a0 = 1 / z
        logs = np.log((1 - g * (1 - a0)) * mix) + scale
        some = np.flatnonzero(hit)
        logs.reshape(-1)[some] = np.logaddexp(np.log((g.reshape(-1)[some] * hit.reshape(-1)[some]).astype(np.float64)), logs.reshape(-1)[some])
        return {"log": logs, "real": real[:, BACK:], "asked": asked, "prior": prior, "seen": seen, "q": q, "k": k, "e": e, "a0": a0, "same": same, "row": row, "met": met, "hit": hit, "weight": weight, "c": c, "pi": pi, "px": px, "mix": mix, "scale": scale, "g": g}

    def gradient(self, t: dict[str, np.ndarray], *parts: dict[str, np.ndarray], total: int | None = None) -> dict[str, np.ndarray]:
        """Slopes of the mean loss over parts of forward(), by hand; those of the embeddings, values and loudness are for the rows of t."""
        sums = self.sums(t)
        for f in parts:
            self.add(sums, f, total or int(sum(x["real"].sum() for x in parts)))
        return self.slopes(t, sums)

    def sums(self, t: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Zeros for add()."""
        kind, size, k = t["x"].dtype, len(t["n"]) + 1, len(self.p["prior"])
        shapes = {"q": (size, DIM), "k": (size, DIM), "w": (size, k + 1), "near": (STEP, SPAN), "copy": (1,), "copy_c": (k,), "prior": (k,), "gain": (k, k)}
        return {n: np.zeros(shape, kind) for n, shape in shapes.items()}

    def add(self, sums: dict[str, np.ndarray], f: dict[str, np.ndarray], total: int) -> None:
        """Adds what f, which is used up, gives to the slopes of the mean over a total of places."""
        p, kind = self.p, f["e"].dtype
        floor = np.exp(np.maximum(f["scale"], -60).astype(kind))
        mix, px, c, a0, g, hit = f["mix"] * floor, f["px"] * floor, f["c"], f["a0"], f["g"], f["hit"]
        left = 1 - g * (1 - a0)
        d = f["real"] * kind.type(-1 / max(1, total)) / np.maximum(g * hit + left * mix, 1e-30)
        dg_z = d * g * a0
        ds = f["e"]
        ds *= (-dg_z * (hit + mix * a0))[..., None]
        ds.reshape(-1)[f["same"]] += f["met"] * dg_z.reshape(-1)[f["row"]]
        dq, dk = np.matmul(ds, f["k"][..., :DIM]), np.matmul(ds.transpose(0, 2, 1), f["q"][..., :DIM])
        _add(sums["q"], f["asked"].ravel(), dq.reshape(-1, DIM))
        _add(sums["k"], f["prior"].ravel(), dk.reshape(-1, DIM))
        sums["near"] += ds.sum(0)
        dg = d * (hit - (1 - a0) * mix) * g * (1 - g)
        flat = c.reshape(len(c), -1)
        sums["copy"] += dg.sum()
        sums["copy_c"] += flat @ dg.ravel()
        dpi = (d * left) * px
        du = f["pi"] * (dpi - (f["pi"] * dpi).sum(0))
        sums["prior"] += du.sum((1, 2))
        sums["gain"] += flat @ du.reshape(len(c), -1).T
        dc = (p["gain"] @ du.reshape(len(c), -1)).reshape(c.shape) + dg * p["copy_c"][:, None, None]
        part = np.concatenate([dc, -(dc * c).sum(0)[None]]) / f["weight"]
        # A place weighs on all places of the block behind it.
        back = np.cumsum(part[..., ::-1], axis=2)[..., ::-1]
        dw = np.concatenate([np.repeat(back[..., :1], BACK, 2), back[..., 1:], np.zeros_like(back[..., :1])], axis=2)
        _add(sums["w"], f["seen"].ravel(), dw.reshape(len(dw), -1).T)

    def slopes(self, t: dict[str, np.ndarray], sums: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        p = self.p
        gq, gk, dw = (sums[n][:-1] for n in "qkw")  # the last is for places that are not there
        out = {n: sums[n] for n in ("copy", "copy_c", "prior", "gain")}
        out |= {"query": t["x"].T @ gq, "key": t["x"].T @ gk, "embed": gq @ p["query"].T + gk @ p["key"].T}
        out["near"] = np.bincount(_GAP[_CAUSAL], sums["near"][_CAUSAL], SPAN).astype(dw.dtype)
        out["value"] = dw[:, :-1] * t["loud"]
        out["loud"] = ((dw[:, :-1] * t["value"]).sum(1) + dw[:, -1]) * t["loud"][:, 0]
        return out

    def log10(self, b: Batch) -> np.ndarray:
        """log10 probability of each document of the batch."""
        t = self.tables(b.words, b.kinds)
        first, at, end = blocks(b.sizes)
        out = np.zeros(len(b.token))
        for s in range(0, len(at), CHUNK):
            f, place = self.windows(t, b, first[s : s + CHUNK], at[s : s + CHUNK], end[s : s + CHUNK])
            out[place[:, BACK:][f["real"]]] = f["log"][f["real"]]
        return np.add.reduceat(out, np.cumsum(b.sizes) - b.sizes) / np.log(10)

    def view(self, b: Batch, first: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
        """The windows' places of blocks of a batch, the kinds before and at them, and which are there."""
        place = at[:, None] - BACK + np.arange(SPAN)[None]
        real = (place >= first[:, None]) & (place < end[:, None])
        safe = np.clip(place, 0, len(b.token) - 1)
        return place, b.prior.take(safe), b.token.take(safe), real

    def windows(self, t: dict[str, np.ndarray], b: Batch, first: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """forward() of blocks of a batch, and the windows' places."""
        place, prior, token, real = self.view(b, first, at, end)
        own = token[:, BACK:]
        return self.forward(t, prior, token, real, b.p.take(own, 1), b.scale.take(own)), place


class Trainer:
    """AdaGrad on batches of windows; of the tables by subword id, only the rows that a batch holds are touched."""

    def __init__(self, params: dict[str, np.ndarray], rate: float = 0.05):
        self.net, self.rate = Network(params), rate
        # The tables by subword id are columns of one.
        self.bag = np.hstack([params["embed"], params["value"], params["loud"][:, None]])
        params["embed"], params["value"], params["loud"] = self.bag[:, :DIM], self.bag[:, DIM:-1], self.bag[:, -1]
        self.square = {n: np.full(x.shape, 1e-6, np.float32) for n, x in params.items() if n not in BAGS} | {"bag": np.full(self.bag.shape, 1e-6, np.float32)}
        self.net.bag = self.bag
        self.seen, self.loss = 0, 0.0

    def step(self, b: Batch, first: np.ndarray, at: np.ndarray, end: np.ndarray) -> None:
        net = self.net
        _, prior, token, real = net.view(b, first, at, end)
        there = np.zeros(len(b.kinds), bool)
        there[prior], there[token] = True, True
        number = np.cumsum(there) - 1
        t = net.tables(b.words, b.kinds[there])
        sums, total = net.sums(t), int(real[:, BACK:].sum())
        for s in range(0, len(at), CHUNK):
            some = slice(s, s + CHUNK)
            own = token[some, BACK:]
            f = net.forward(t, number.take(prior[some]), number.take(token[some]), real[some], b.p.take(own, 1), b.scale.take(own))
            self.loss -= float(f["log"][f["real"]].sum())
            net.add(sums, f, total)
        self.seen += total
        there = np.zeros(ROWS, bool)
        there[t["ids"]] = True
        rows, number = np.flatnonzero(there), np.cumsum(there) - 1
        slopes = net.slopes(t, sums)
        g = np.hstack([slopes.pop("embed"), slopes.pop("value"), slopes.pop("loud")[:, None]]) / t["n"][:, None].astype(np.float32)
        shares = np.zeros((len(rows), g.shape[1]), g.dtype)
        _add(shares, number[t["ids"]], g.repeat(t["n"], 0))  # a token is the mean of its ids
        g = shares
        square = self.square["bag"].take(rows, 0) + g * g
        self.square["bag"][rows] = square
        self.bag[rows] -= (self.rate * g / np.sqrt(square)).astype(np.float32)
        for n, g in slopes.items():
            self.square[n] += g * g
            net.p[n] -= (self.rate * g / np.sqrt(self.square[n])).astype(np.float32)
        net.fuse()
        net.bag = self.bag

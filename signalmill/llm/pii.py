"""Personal data: exact patterns, and a linear-chain conditional random field for what the patterns miss.

The field labels words B-/I- for each kind, or O. Features are word shapes of a word and its neighbours. It is trained from a
small labelled table (`labelled()`, written out from templates), by gradient steps on the exact likelihood (forward-backward),
and decoded by Viterbi in numpy over batches of windows. A span must hold a trigger (a digit, `@`, or a spelled-out
at/dot), so windows of CONTEXT words about the triggers of a text are decoded and the rest of its words are O; the whole
text is searched for triggers. Spans of the patterns stay; a span of the field is added if it overlaps none of them and
passes the kind's check (digits for a card or phone, and so on), which keeps clean texts alone.

Defined results: null and empty texts have no spans. Offsets are code points, ends exclusive. Repeated rows give repeated results.
All scans are linear in the length of the text. Further columns are not read.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmill.llm.common import load

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
CONTEXT, PAD = 6, 1 << 9

# The patterns, rewritten so that no text takes more than linear time: possessive runs, and a local part searched backwards from its @.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]|[(\[{]\s?(?:at|dot)\s?[)\]}]|\b(?i:dot|punkt|point|punto|arroba)\b")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the exact patterns by kind as listed, then by start."""
    out = []
    if "@" in text:
        last = 0
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append(("email", start, m.end()))
                last = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def labelled(rows: int = 400, seed: int = 7) -> list[list[tuple[str, str]]]:
    """The training table: sentences of (word, label), written out from templates with a fixed seed."""
    rnd = random.Random(seed)
    plain = "the of and report order call on in is was it das der und la que de les with from version page year table item total".split()

    def num(n: int) -> str:
        return "".join(rnd.choice("0123456789") for _ in range(n))

    def name() -> str:
        return "".join(rnd.choice("aeioulnrstmdk") for _ in range(rnd.randint(3, 9)))

    def spell(kind: str) -> list[str]:
        top = rnd.choice(["com", "org", "net", "de", "fr"])
        if kind == "email":
            at, dot = rnd.choice([("at", "dot"), ("(at)", "(dot)"), ("[at]", "[dot]"), ("@", "."), ("arroba", "punto"), ("(at)", ".")])
            return rnd.choice([[name(), at, name(), dot, top], [f"{name()}.{name()}", at, name(), dot, top], [f"{name()}@{name()}", dot, top]])
        if kind == "ip":
            parts = [str(rnd.randint(1, 255)) for _ in range(4)]
            return rnd.choice([[parts[0], "dot", parts[1], "dot", parts[2], "dot", parts[3]], ["[.]".join(parts)], ["(dot)".join(parts)]])
        if kind == "card":
            sep = rnd.choice([".", "_", "/"])
            return rnd.choice([[sep.join(num(4) for _ in range(4))], [f"{num(4)}{sep}", f"{num(4)}{sep}", f"{num(4)}{sep}", num(4)]])
        return rnd.choice([[f"{num(3)}-{num(3)}-{num(4)}"], [f"({num(3)})", f"{num(3)}-{num(4)}"], [f"00{num(2)}", num(3), num(7)], [f"{num(3)}.{num(3)}.{num(4)}"], ["+", num(2), num(3), num(6)]])

    def harmless() -> list[str]:
        y = str(rnd.randint(1000, 2999))
        return rnd.choice([[y], [f"{num(2)}/{num(2)}/{y}"], [f"{y}-{num(2)}-{num(2)}"], [num(rnd.randint(1, 8))], [f"{num(1)}.{num(1)}"], [f"v{num(1)}.{num(1)}.{num(1)}"], [f"{num(3)},{num(3)}"], [f"{num(2)}:{num(2)}"], ["dot"], ["the", "dot", "at", "the"], [f"{num(2)}%"], [f"#{num(4)}"], [f"x{num(5)}"]])

    table = []
    for i in range(rows):
        words: list[tuple[str, str]] = []
        for _ in range(rnd.randint(1, 3)):
            words += [(rnd.choice(plain) if rnd.random() < 0.5 else name(), "O") for _ in range(rnd.randint(2, 6))]
            if rnd.random() < 0.55:
                kind = KINDS[rnd.randrange(4)]
                words += [(w, f"{'B' if k == 0 else 'I'}-{kind}") for k, w in enumerate(spell(kind))]
            else:
                words += [(w, "O") for w in harmless()]
        words += [(rnd.choice(plain), "O") for _ in range(rnd.randint(1, 5))]
        table.append(words)
    return table


def shape(word: str) -> tuple[str, ...]:
    """Feature names of a word: its collapsed shape, how many digits, its separators, and the spelled-out signs."""
    core = word.strip(",;:!?\"'") or word
    s = re.sub(r"[0-9]+", lambda m: "9" * min(len(m.group()), 5), core)
    s = re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", re.sub(r"[^\x00-\x7f]+", "a", s)))
    n = len(_digits(core))
    low = core.lower()
    sign = low if low in ("at", "dot", "(at)", "(dot)", "[at]", "[dot]", "@", ".", "arroba", "punto", "punkt", "+", "com", "org", "net") else ""
    return (f"s:{s}", f"n:{min(n, 20)}", f"p:{''.join(sorted(set(re.sub('[0-9A-Za-z]', '', s))))}", f"w:{sign}", f"a:{int(core.isalpha())}")


class Field:
    """Weights of the chain: emissions by (offset, feature, label) and transitions."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.index, self.emit, self.move = index, emit, move
        self._row: dict[str, np.ndarray] = {}

    def row(self, word: str) -> np.ndarray:
        """(3, labels): what a word adds to the labels of the word before it, of itself, and of the word after it."""
        got = self._row.get(word)
        if got is None:
            if len(self._row) > 50_000:
                self._row.clear()
            got = np.zeros((3, len(LABELS)))
            for f in shape(word):
                if (k := self.index.get(f)) is not None:
                    got += self.emit[:, k]
            self._row[word] = got
        return got

    def scores(self, words: list[str]) -> np.ndarray:
        rows = np.array([self.row(w) for w in words])
        out = rows[:, 1].copy()
        out[:-1] += rows[1:, 0]
        out[1:] += rows[:-1, 2]
        return out

    def decode(self, windows: list[list[str]]) -> list[np.ndarray]:
        """Best labels of each window: Viterbi over batches of windows of like length."""
        out: list[np.ndarray] = [np.zeros(0, int)] * len(windows)
        order = sorted(range(len(windows)), key=lambda i: len(windows[i]))
        for at in range(0, len(order), PAD):
            part = order[at : at + PAD]
            lengths = np.array([len(windows[i]) for i in part])
            e = np.zeros((len(part), lengths.max(), len(LABELS)))
            for k, i in enumerate(part):
                e[k, : lengths[k]] = self.scores(windows[i])
            back = np.zeros(e.shape, np.int8)
            best = e[:, 0].copy()
            best[:, 2::2] = -1e9  # an I- label opens no span
            ends = [None] * len(part)
            for t in range(e.shape[1]):
                if t:
                    step = best[:, :, None] + self.move
                    back[:, t] = step.argmax(1)
                    best = step.max(1) + e[:, t]
                for k in np.flatnonzero(lengths == t + 1):
                    ends[k] = int(best[k].argmax())
            for k, i in enumerate(part):
                path = np.zeros(lengths[k], int)
                path[-1] = ends[k]
                for t in range(lengths[k] - 1, 0, -1):
                    path[t - 1] = back[k, t, path[t]]
                out[i] = path
        return out


def train(table: list[list[tuple[str, str]]], epochs: int = 40, rate: float = 0.5, ridge: float = 1e-3) -> Field:
    """Gradient ascent (AdaGrad) on the exact conditional likelihood of the table, all sentences of a batch at once."""
    index: dict[str, int] = {}
    for s in table:
        for w, _ in s:
            for f in shape(w):
                index.setdefault(f, len(index))
    n_l, n_f, longest = len(LABELS), len(index), max(map(len, table))
    lengths = np.array([len(s) for s in table])
    ids = np.full((len(table), longest, 5), n_f)
    gold = np.zeros((len(table), longest), int)
    for i, s in enumerate(table):
        for t, (w, y) in enumerate(s):
            ids[i, t] = [index[f] for f in shape(w)]
            gold[i, t] = LABELS.index(y)
    real = np.arange(longest) < lengths[:, None]
    emit, move = np.zeros((3, n_f + 1, n_l)), np.zeros((n_l, n_l))
    banned = np.zeros((n_l, n_l), bool)
    for b, y in enumerate(LABELS):
        if y[0] == "I":
            banned[[a for a, x in enumerate(LABELS) if x[1:] != y[1:] or x == "O"], b] = True
    g2e, g2m = np.full(emit.shape, 1e-8), np.full(move.shape, 1e-8)
    one = np.eye(n_l)[gold] * real[..., None]

    def shifted(x: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros_like(x)
        if by > 0:
            out[:, by:] = x[:, :-by]
        elif by < 0:
            out[:, :by] = x[:, -by:]
        else:
            out[:] = x
        return out

    for _ in range(epochs):
        m = np.where(banned, -1e4, move)
        parts = emit[:, ids].sum(3)
        e = (parts[1] + shifted(parts[0] * real[..., None], -1) + shifted(parts[2] * real[..., None], 1)) * real[..., None]
        a, b = np.zeros(e.shape), np.zeros(e.shape)
        a[:, 0] = e[:, 0]
        a[:, 0, 2::2] = -1e4
        for t in range(1, longest):
            x = a[:, t - 1, :, None] + m
            top = x.max(1)
            new = top + np.log(np.exp(x - top[:, None]).sum(1)) + e[:, t]
            a[:, t] = np.where(real[:, t, None], new, a[:, t - 1])
        top = a[:, -1].max(1)
        z = top + np.log(np.exp(a[:, -1] - top[:, None]).sum(1))
        for t in range(longest - 2, -1, -1):
            x = m + (e[:, t + 1] + b[:, t + 1])[:, None]
            top = x.max(2)
            b[:, t] = np.where(real[:, t + 1, None], top + np.log(np.exp(x - top[..., None]).sum(2)), 0)
        marginal = np.exp(a + b - z[:, None, None]) * real[..., None]
        pair = np.zeros((n_l, n_l))
        for t in range(1, longest):
            x = np.exp(a[:, t - 1, :, None] + m + (e[:, t] + b[:, t])[:, None] - z[:, None, None]) * real[:, t, None, None]
            pair += x.sum(0)
        seen = np.einsum("bti,btj->ij", one[:, :-1], one[:, 1:])
        diff = one - marginal
        ge = np.zeros(emit.shape)
        for k, by in enumerate((1, 0, -1)):  # what a word says of the one before it: that one's residual, brought to the word
            d = shifted(diff, by) * real[..., None]
            for f in range(5):
                np.add.at(ge[k], ids[:, :, f], d)
        ge, gm = ge / len(table) - ridge * emit, (seen - pair) / len(table) - ridge * move
        g2e, g2m = g2e + ge**2, g2m + gm**2
        emit, move = emit + rate * ge / np.sqrt(g2e), move + rate * gm / np.sqrt(g2m)
    return Field(index, emit[:, :n_f], np.where(banned, -1e9, move))


@lru_cache(1)
def field() -> Field:
    return train(labelled())


def _valid(kind: str, s: str) -> bool:
    n = len(_digits(s))
    if kind == "email":
        return bool(re.search(r"@|[(\[{]\s?at|arroba|\bat\b.*\bdot\b", s, re.I)) and bool(re.search(r"dot|punto|punkt|\.", s, re.I))
    if kind == "ip":
        parts = re.findall("[0-9]+", s)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and not re.fullmatch(r"[0-9.]+", s)
    if kind == "card":
        return 13 <= n <= 19 and luhn(_digits(s))
    return 9 <= n <= 15 and not re.search("[A-Za-z]", s) and bool(re.search(r"[ ().-]", s))


def windows(text: str) -> list[list[tuple[str, int]]]:
    """Runs of (word, start) within CONTEXT words of a trigger."""
    at = [m.start() for m in _TRIGGER.finditer(text)]
    if not at:
        return []
    words = [(m.group(), m.start()) for m in _WORD.finditer(text)]
    starts = np.array([s for _, s in words])
    near = np.zeros(len(words) + 1, int)
    hit = np.unique(np.searchsorted(starts, at, "right") - 1)
    np.add.at(near, np.maximum(hit - CONTEXT, 0), 1)
    np.add.at(near, np.minimum(hit + CONTEXT + 1, len(words)), -1)
    inside = np.flatnonzero(np.cumsum(near)[:-1] > 0)
    runs = np.split(inside, np.flatnonzero(np.diff(inside) > 1) + 1)
    return [[words[i] for i in run] for run in runs]


def added_spans(texts: list[str], base: list[list[tuple[str, int, int]]], model: Field) -> list[list[tuple[str, int, int]]]:
    """For each text the spans of the field that overlap none of base and pass their kind's check."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    runs = [(i, run) for i, t in enumerate(texts) for run in windows(t)]
    for (i, run), path in zip(runs, model.decode([[w for w, _ in run] for _, run in runs]), strict=True):
        k = 0
        while k < len(path):
            label = LABELS[path[k]]
            end = k + 1
            if label[0] == "B":
                while end < len(path) and LABELS[path[end]] == f"I-{label[2:]}":
                    end += 1
                first, last = run[k][1], run[end - 1][1] + len(run[end - 1][0])
                while last > first and texts[i][last - 1] in ",;:.!?\"'":
                    last -= 1
                if _valid(label[2:], texts[i][first:last]) and all(last <= s or first >= e for _, s, e in base[i]):
                    out[i].append((label[2:], first, last))
            k = end
    return out


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])))


def find(texts: list[str | None], model: Field) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """(base spans, all spans) of each text."""
    whole = [t or "" for t in texts]
    base = [base_spans(t) for t in whole]
    return [(b, b + a) for b, a in zip(base, added_spans(whole, base, model), strict=True)]


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = field()
    shared = spark.sparkContext.broadcast((model.index, model.emit, model.move))  # a few hundred features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*shared.value)
        for b in batches:
            found = find(b.column(1).to_pylist(), own)
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            digest = pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, digest, pa.array([_joined(every) for _, every in found], pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each span (of overlapping ones their union) replaced by its kind in angle brackets."""
    out, last = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= last:
            out += [text[last:start], f"<{kind}>"]
        last = max(last, end)
    return "".join(out) + text[last:]


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows the new text where it is there."""
    model = field()
    shared = spark.sparkContext.broadcast((model.index, model.emit, model.move))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*shared.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            new = [None if t is None else redact(t, every) for t, (_, every) in zip(texts, find(texts, own), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(new, pa.string())], names=["row", "new"])

    rows = docs.select(F.struct(*(F.lit(None).cast("string").alias(n) if n == "text" else F.col(n) for n in names)).alias("row"), "text")
    out = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, new string")
    chars = lambda n: F.length("new").cast(docs.schema[n].dataType)
    return out.select(*(F.col("new").alias(n) if n == "text" else chars(n).alias(n) if n == "n_chars" else F.col(f"row.{n}").alias(n) for n in names))

"""Language-model scores: a gated recurrent network over words with a class-factored softmax, in numpy.

Words are [^\\x20\\x09-\\x0D]+ with A-Z lowered, then one end token per text. All training texts are counted, so N, V and every
count c cover the whole corpus. The `SYMBOLS` most frequent words are symbols of the network, in classes of `CLASS`
by frequency; all others share the last class, within which a word has its share of the add-one unigram
distribution, so every word, unseen ones too, has a probability and they sum to one:

    P(w | h) = P(class | h) * P(w | class, h)            for a symbol
    P(w | h) = P(rest | h) * base(w) / base(rest)        for all other words

Training: truncated backpropagation through `SPAN` words with Adagrad, `LANES` texts side by side. A first task learns from whole
texts whose hash is below a threshold (about `WARM_TOKENS` words); then every task goes on from its weights over all training
texts it reads, whatever their length or id (at most LANES - 1 words at the end of a slice are left over), and the results are
averaged by words in a tree of fixed fan-in. Scoring carries the state through a whole text in windows of `WINDOW` words,
longer ones where few texts are left, many texts side by side.

The counts of the most frequent words, `TABLE` at most (those over a threshold that a histogram of counts gives), are broadcast; rarer
words meet their counts in a shuffle of packed arrays, at most one entry per document and word, and only sums per document come back.

Defined results: null text is empty and has one token, the end; with no training text N = V = 0 and every word has
probability 1 by the base; repeated rows score alike; ids may be null; an empty table gives no rows; extra columns are kept
by `score` (n_tokens, n_known, train_tokens, base_score and score are replaced).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import stored, table_parts
from ._text import BLANKS, mix, slices, split_words

SYMBOLS = 2048  # with the end token
CLASS = 64
HIDDEN = 24
TABLE = 1 << 18
WARM_TOKENS = 1_000_000
LANES = 256
SPAN = 32
FAN_IN, LEVELS = 8, 4
RATE = 0.08
WINDOW = 32
BLOCK = 2048  # states whose softmax is taken at a time
SEED = 17
SLICE = 1 << 20  # of text whose words are hashed at a time
GROUP = 1 << 20  # words of texts that run side by side
END = np.uint64(0x5EED_E4D0_70CE_4E4D)
_U = np.uint64


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, each followed by END, and their bounds."""
    w = split_words(col, BLANKS, lower=True)
    first = w.first + np.arange(w.n_docs + 1)
    out = np.full(len(w.start) + w.n_docs, END, _U)
    out[np.arange(len(w.start)) + w.doc] = w.hash
    return out, first


class Network:
    """Weights x (symbol -> gates), u (state -> gates), c (state -> class), o (state -> symbol) and biases."""

    def __init__(self, n: int, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.n, self.classes = n, -(-n // CLASS) + 1  # symbol n is any other word: the last class
        size = {"x": (n + 1, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "c": (HIDDEN, self.classes), "cb": (self.classes,), "o": ((self.classes - 1) * CLASS, HIDDEN), "ob": ((self.classes - 1) * CLASS,)}
        self.w = {k: (rng.standard_normal(s) * (0.3 if k in "xu" else 0.05)).astype(np.float32) for k, s in size.items()}
        self.w["ob"][n:] = -30.0  # places of the last class that no symbol has

    def start(self, counts: np.ndarray, rest: float) -> None:
        """Biases from the counts: an untrained network is a unigram model."""
        place = np.zeros((self.classes - 1) * CLASS)
        place[: self.n] = counts + 1
        mass = np.append(place.reshape(-1, CLASS).sum(1), rest + 1)
        self.w["cb"][:] = np.log(mass / mass.sum())
        self.w["ob"][: self.n] = np.log(place[: self.n])

    def gates(self) -> tuple[np.ndarray, np.ndarray]:
        """x and u with each gate's weights in one piece: (gate, symbol, to) and (gate, from, to)."""
        x, u = (np.ascontiguousarray(self.w[k].reshape(-1, 3, HIDDEN).transpose(1, 0, 2)) for k in "xu")
        return x, u

    @staticmethod
    def step(gates: tuple[np.ndarray, np.ndarray], h: np.ndarray, s: np.ndarray):
        """States after symbols s; what backpropagation needs of the step: z, r, m and the candidate's share of h."""
        a, g = np.matmul(h, gates[1]), gates[0].take(s, 1)
        g[:2] += a[:2]
        zr = g[:2]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.divide(1, zr, out=zr)
        z, r, m = g
        m += r * a[2]
        np.tanh(m, out=m)
        out = h - m
        out *= z
        out += m
        return out, (z, r, m, a[2])

    def log_probs(self, h: np.ndarray, s: np.ndarray, grad: dict | None = None):
        """Natural log probability of symbols s after states h; with grad, also the gradient of their negative sum by h."""
        w, n = self.w, len(s)
        cls = np.where(s < self.n, s // CLASS, self.classes - 1)
        lp, dh = np.empty(n, np.float32), None if grad is None else np.empty_like(h)
        for lo in range(0, n, BLOCK):
            row = slice(lo, lo + BLOCK)
            lp[row], d = _said(w["c"].T, w["cb"], h[row], cls[row], None if grad is None else (grad["c"].T, grad["cb"]))
            if grad is not None:
                dh[row] = d
        order = np.argsort(cls.astype(np.int16), kind="stable")
        cut = np.searchsorted(cls[order], np.arange(self.classes))
        some = order[: cut[-1]]  # sorted by class, so each class is a slice
        x, j = h[some], s[some] % CLASS
        own_lp, own_dh = np.empty(len(some), np.float32), None if grad is None else np.empty_like(x)
        for k in range(self.classes - 1):
            own = slice(k * CLASS, (k + 1) * CLASS)
            for lo in range(cut[k], cut[k + 1], BLOCK):
                row = slice(lo, min(lo + BLOCK, cut[k + 1]))
                own_lp[row], d = _said(w["o"][own], w["ob"][own], x[row], j[row], None if grad is None else (grad["o"][own], grad["ob"][own]))
                if grad is not None:
                    own_dh[row] = d
        lp[some] += own_lp
        if grad is not None:
            dh[some] += own_dh
        return lp, dh

    def train(self, s: np.ndarray, first: np.ndarray, rate: float = RATE) -> None:
        """One pass over symbols s of texts that start at `first`, dealt to LANES side by side."""
        lanes = min(LANES, max(1, len(s) // SPAN))
        steps = len(s) // lanes
        fresh = np.zeros(len(s), bool)
        fresh[first[first < len(s)]] = True
        s = np.ascontiguousarray(s[: lanes * steps].reshape(lanes, steps).T)
        fresh = np.ascontiguousarray(fresh[: lanes * steps].reshape(lanes, steps).T)
        h = np.zeros((lanes, HIDDEN), np.float32)
        seen = {k: np.full(v.shape, 1e-2, np.float32) for k, v in self.w.items()}
        for t0 in range(0, steps, SPAN):
            own, new = s[t0 : t0 + SPAN], [np.flatnonzero(f) for f in fresh[t0 : t0 + SPAN]]
            gates, caches, grad = self.gates(), [], {k: np.zeros_like(v) for k, v in self.w.items() if k != "x"}
            before = np.empty((len(own), lanes, HIDDEN), np.float32)
            for i in range(len(own)):
                before[i] = h
                before[i, new[i]] = 0
                h, cache = self.step(gates, before[i], own[i])
                caches.append(cache)
            own = own.ravel()
            _, dout = self.log_probs(before.reshape(-1, HIDDEN), own, grad)
            dout = dout.reshape(before.shape)
            back = np.ascontiguousarray(gates[1].transpose(0, 2, 1))
            dh, d = np.zeros_like(h), np.empty((4, *before.shape), np.float32)  # by z, r, the candidate's share of h, the candidate
            for i in range(len(before) - 1, -1, -1):
                z, r, m, a = caches[i]
                dz, dr, da, dm = d[:, i]
                rest = 1 - z
                np.multiply(m, m, out=dm)
                np.subtract(1, dm, out=dm)
                dm *= rest
                dm *= dh
                np.multiply(dm, r, out=da)
                np.subtract(1, r, out=dr)
                dr *= da
                dr *= a
                dh *= z
                np.subtract(before[i], m, out=dz)
                dz *= rest
                dz *= dh
                by = np.matmul(d[:3, i], back)
                dh += by[0]
                dh += by[1]
                dh += by[2]
                dh += dout[i]
                dh[new[i]] = 0  # a text's first state is fixed
            d = d.reshape(4, -1, HIDDEN)
            grad["u"] = np.concatenate(np.matmul(before.reshape(-1, HIDDEN).T, d[:3]), 1)
            g, there = self._by_symbol(d, own)
            g /= np.float32(lanes)
            np.clip(g, -1, 1, out=g)
            x = seen["x"][there] + g * g
            seen["x"][there] = x
            self.w["x"][there] -= rate * g / np.sqrt(x)  # rows of absent symbols have no gradient
            for k, g in grad.items():
                g /= lanes
                np.clip(g, -1, 1, out=g)
                seen[k] += g * g
                self.w[k] -= rate * g / np.sqrt(seen[k])

    def _by_symbol(self, d: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the gates' gradients d over the places of each symbol, and those symbols; the rest, about half of all places, as a product."""
        other = s == self.n
        at = np.flatnonzero(~other)
        at = at[np.argsort(s[at], kind="stable")]
        there = s[at]
        lo = np.flatnonzero(np.concatenate([np.ones(min(1, len(at)), bool), there[1:] != there[:-1]]))
        rows = np.empty((len(at), 3 * HIDDEN), np.float32)
        for k, own in enumerate((d[0], d[1], d[3])):
            rows[:, k * HIDDEN : (k + 1) * HIDDEN] = own.take(at, 0)
        sums, there = (np.add.reduceat(rows, lo) if len(lo) else rows), there[lo]
        if len(at) < len(s):
            sums = np.concatenate([sums, np.matmul(other.astype(np.float32), d)[[0, 1, 3]].reshape(1, -1)])
            there = np.append(there, there.dtype.type(self.n))
        return sums, there

    def text_scores(self, s: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Natural log probability of each whole text."""
        size = np.diff(first)
        order = np.argsort(-size, kind="stable")
        lo, size = first[:-1][order], size[order]
        out, gates = np.zeros(len(order)), self.gates()
        h = np.zeros((len(order), HIDDEN), np.float32)
        longest = int(size[0]) if len(size) else 0
        alive = np.searchsorted(-size, -np.arange(longest), side="left").tolist()  # texts longer than t
        states, rows, said, held = [], [], [], 0
        for t, m in enumerate(alive):
            own = s[lo[:m] + t]
            states.append(h[:m])
            rows.append(np.arange(m))
            said.append(own)
            held += m
            h, _ = self.step(gates, h[:m], own)
            if t + 1 == longest or len(said) >= WINDOW and held >= 4 * BLOCK:
                lp, _ = self.log_probs(np.concatenate(states), np.concatenate(said))
                out[: len(states[0])] += np.bincount(np.concatenate(rows), lp, len(states[0]))
                states, rows, said, held = [], [], [], 0
                del lp
        back = np.empty(len(order))
        back[order] = out
        return back


def _said(w: np.ndarray, b: np.ndarray, h: np.ndarray, s: np.ndarray, grad: tuple | None):
    """Log of the softmax of w h + b at s, a column for each state; with grad (sums by w and by b), also the gradient by h."""
    at = np.arange(len(s))
    e = w @ h.T
    e += b[:, None]
    e -= e.max(0)
    lp = e[s, at]
    np.exp(e, out=e)
    total = e.sum(0)
    lp -= np.log(total)
    if grad is None:
        return lp, None
    e /= total
    e[s, at] -= 1
    own, bias = grad
    own += e @ h
    bias += e.sum(1)
    return lp, e.T @ w


@dataclass
class Model:
    keys: np.ndarray  # the most frequent words' hashes, sorted
    counts: np.ndarray
    symbol: np.ndarray  # symbol of each, or n_symbols for none
    n_symbols: int
    n: int
    v: int
    parts: int
    weights: dict | None = None
    trained: int = 0  # words of the last training pass
    begin: np.ndarray | None = None  # the first key of each value of the leading bits; made where it is used

    def lookup(self, h: np.ndarray):
        """(place in the table or -1, symbol) of each word hash."""
        if not len(self.keys):
            return np.full(len(h), -1), np.full(len(h), self.n_symbols)
        bits = min(24, len(self.keys).bit_length() + 1)
        shift = _U(64 - bits)
        if self.begin is None:  # keys are spread evenly, so those of equal leading bits are few
            self.begin = np.searchsorted(self.keys, np.arange(1 << bits, dtype=_U) << shift)
        pos = self.begin[h >> shift]
        last = len(self.keys) - 1
        np.minimum(pos, last, out=pos)
        at = np.flatnonzero(self.keys[pos] < h)
        while len(at):
            at = at[pos[at] < last]
            pos[at] += 1
            at = at[self.keys[pos[at]] < h[at]]
        ok = self.keys[pos] == h
        return np.where(ok, pos, -1), np.where(ok, self.symbol[pos], self.n_symbols)

    def network(self) -> Network:
        net = Network(self.n_symbols)
        net.w = {k: v.copy() for k, v in self.weights.items()}
        return net


def _deal(keys: np.ndarray, parts: int):
    part = (mix(keys) % _U(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    at = np.searchsorted(part[order], np.arange(parts + 1))
    return [(p, order[at[p] : at[p + 1]]) for p in np.flatnonzero(np.diff(at))]


def _counted(docs: DataFrame, parts: int) -> DataFrame:
    """part, keys, counts (packed, sorted by key) over all texts."""

    def deal(batches):
        for batch in batches:
            for t in slices(batch, "text", SLICE * 4):
                k, n = np.unique(tokens(t.column("text"))[0], return_counts=True)
                some = _deal(k, parts)
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in some], pa.int32()), pa.array([k[i].tobytes() for _, i in some], pa.binary()), pa.array([n[i].astype(np.int64).tobytes() for _, i in some], pa.binary())], names=["part", "keys", "counts"])

    def add(t: pa.Table) -> pa.Table:
        k = np.concatenate([np.frombuffer(x, _U) for x in t.column("keys").to_pylist()])
        n = np.concatenate([np.frombuffer(x, np.int64) for x in t.column("counts").to_pylist()])
        order = np.argsort(k, kind="stable")
        k, n = k[order], n[order]
        lo = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        k, n = k[lo], np.add.reduceat(n, lo)
        return pa.table({"part": t.column("part").slice(0, 1), "keys": pa.array([k.tobytes()], pa.binary()), "counts": pa.array([n.tobytes()], pa.binary())})

    return docs.mapInArrow(deal, "part int, keys binary, counts binary").groupBy("part").applyInArrow(add, "part int, keys binary, counts binary")


def fit(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> tuple[Model, DataFrame]:
    """The model and the packed counts of all training words."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).alias("text"), F.xxhash64(F.lit(SEED), F.col(id_col)).alias("h"))
    parts = table_parts(texts, "text", 32 << 20)
    counted = stored(_counted(texts.select("text"), parts), "counts")

    def histogram(batches):
        for b in batches:
            for raw in b.column("counts").to_pylist():
                n = np.frombuffer(raw, np.int64)
                step, words = np.unique(np.floor(8 * np.log2(n)).astype(np.int32), return_counts=True)
                total = np.zeros(len(step), np.int64)
                total[:1] = n.sum()
                yield pa.RecordBatch.from_arrays([pa.array(step, pa.int32()), pa.array(words, pa.int64()), pa.array(total)], names=["step", "words", "tokens"])

    steps = counted.mapInArrow(histogram, "step int, words long, tokens long").groupBy("step").agg(F.sum("words").alias("words"), F.sum("tokens").alias("tokens")).collect()
    total, distinct = sum(r.tokens for r in steps), sum(r.words for r in steps)
    least, held = 10_000, 0
    for r in sorted(steps, key=lambda r: -r.step):  # the words of whole steps, as long as the table holds them
        held += r.words
        if held > TABLE:
            break
        least = r.step

    def top(batches):
        for b in batches:
            for k, n in zip(b.column("keys").to_pylist(), b.column("counts").to_pylist(), strict=True):
                k, n = np.frombuffer(k, _U), np.frombuffer(n, np.int64)
                i = (np.floor(8 * np.log2(n)) >= least) | (k == END)
                yield pa.RecordBatch.from_arrays([pa.array([k[i].tobytes()], pa.binary()), pa.array([n[i].tobytes()], pa.binary())], names=["keys", "counts"])

    rows = counted.mapInArrow(top, "keys binary, counts binary").toArrow()
    unpack = lambda c, t: np.frombuffer(b"".join(rows.column(c).to_pylist()), t)
    k, n = unpack("keys", _U), unpack("counts", np.int64)
    del rows
    order = np.lexsort((k, -n))
    k, n = k[order], n[order]
    ends = np.flatnonzero(k == END)
    if len(ends):  # the end is always a symbol: symbol 0
        order = np.concatenate([ends, np.delete(np.arange(len(k)), ends)])
        k, n = k[order], n[order]
    symbols = min(SYMBOLS, len(k))
    symbol = np.minimum(np.arange(len(k)), symbols)
    by_key = np.argsort(k)
    model = Model(k[by_key], n[by_key], symbol[by_key], symbols, total, distinct, parts)
    net = Network(symbols)
    net.start(n[:symbols], float(total - n[:symbols].sum()))
    model.weights = net.w
    if not total:
        return model, counted
    bar = int(min(2**63 - 1, -(2**63) + min(1.0, WARM_TOKENS / total) * 2**64))
    some = texts.withColumn("h", F.xxhash64(F.lit(SEED), "h", F.xxhash64("text"))).filter(F.col("h") <= F.lit(bar))
    model.weights, _ = _trained(some.select("text").repartition(1), model, RATE)
    model.weights, model.trained = _trained(texts.select("text"), model, RATE / 4)
    return model, counted


def _trained(texts: DataFrame, model: Model, rate: float) -> tuple[dict, int]:
    """Weights after each task has gone on from the model's over its texts, averaged by words; the number of words."""
    bag = texts.sparkSession.sparkContext.broadcast(model)

    def go_on(batches):
        own, seen = None, 0
        for s, first in grouped(batches, "text", lambda h: bag.value.lookup(h)[1]):
            own = own or bag.value.network()
            own.train(s, first, rate)
            seen += len(s)
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([seen], pa.int64()), pa.array([b"".join((own.w[k].astype(np.float64) * seen).tobytes() for k in sorted(own.w))], pa.binary())], names=["g", "n", "w"])

    def add(t: pa.Table) -> pa.Table:
        w = sum(np.frombuffer(x, np.float64) for x in t.column("w").to_pylist())
        return pa.table({"g": t.column("g").slice(0, 1), "n": pa.array([int(np.sum(t.column("n").to_numpy()))], pa.int64()), "w": pa.array([w.tobytes()], pa.binary())})

    learned = texts.mapInArrow(go_on, "g int, n long, w binary")
    for _ in range(LEVELS):
        learned = learned.withColumn("g", F.floor(F.col("g") / FAN_IN).cast("int")).groupBy("g").applyInArrow(add, "g int, n long, w binary")
    seen, flat = 0, 0.0
    for r in learned.toLocalIterator():
        seen += r.n
        flat = flat + np.frombuffer(r.w, np.float64)
    if not seen:
        return model.weights, 0
    out, at = {}, 0
    for name in sorted(model.weights):
        shape = model.weights[name].shape
        size = int(np.prod(shape))
        out[name] = (flat[at : at + size] / seen).reshape(shape).astype(np.float32)
        at += size
    return out, seen


def grouped(batches, text_col: str, look):
    """Symbols of many texts, look(word hashes), and the places of their beginnings, for about GROUP words at a time."""
    held, begun, n = [], [], 0
    for batch in batches:
        for t in slices(batch, text_col, SLICE):
            h, first = tokens(t.column(text_col))
            held.append(look(h).astype(np.int16))
            begun.append(first[:-1] + n)
            n += len(h)
            if n >= GROUP:
                yield np.concatenate(held), np.concatenate(begun)
                held, begun, n = [], [], 0
    if n:
        yield np.concatenate(held), np.concatenate(begun)


@lru_cache(maxsize=1)
def _ready(bag) -> tuple[Model, Network]:
    return bag.value, bag.value.network()


def score(docs: DataFrame, fitted: tuple[Model, DataFrame], text_col: str = "text") -> DataFrame:
    """Columns of docs but the text, plus n_tokens, n_known, train_tokens, base_score and score."""
    model, counted = fitted
    own = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    keep = [c for c in docs.columns if c not in own and c != text_col]
    bag = docs.sparkSession.sparkContext.broadcast(model)
    fields = [*(docs.schema[c] for c in keep), T.StructField("__n", T.LongType()), T.StructField("__k", T.LongType()), T.StructField("__b", T.DoubleType()), T.StructField("__s", T.DoubleType())]
    schema = T.StructType([T.StructField("__part", T.IntegerType()), T.StructField("__row", T.LongType()), T.StructField("__pack", T.BinaryType()), *(T.StructField(f.name, f.dataType) for f in fields)])
    rest_mass = (model.n + model.v + 1) - sum(int(c) + 1 for c, s in zip(model.counts, model.symbol, strict=True) if s < model.n_symbols)
    share = float(np.log10(max(rest_mass, 1)))
    whole = float(np.log10(model.n + model.v + 1))

    def run(batches):
        m, net = _ready(bag)
        row, held, words = TaskContext.get().partitionId() << 36, [], 0
        log = np.log10(m.counts + 1.0)

        def scored():
            symbols, sizes = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            lp, at = net.text_scores(symbols, np.concatenate([[0], np.cumsum(sizes)])) / np.log(10), 0
            for _, n, ids, known, base, other, cols in held:
                own = lp[at : at + len(n)] + other
                at += len(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), -1), pa.int32()), pa.array(ids), pa.nulls(len(n), pa.binary()), *cols, pa.array(n), pa.array(known), pa.array(base), pa.array(own)], names=schema.names)

        for batch in batches:
            for t in slices(batch, text_col, SLICE):
                h, first = tokens(t.column(text_col))
                n = np.diff(first)
                doc = np.repeat(np.arange(len(n)), n)
                pos, s = m.lookup(h)
                known, rest = pos >= 0, s == m.n_symbols
                value = np.where(known, log[pos] if len(log) else 0.0, 0.0)
                base = np.bincount(doc, value, len(n)) - n * whole
                ids = np.arange(row, row + len(n))
                row += len(n)
                held.append((s.astype(np.int16), n, ids, np.bincount(doc[known], minlength=len(n)), base, np.bincount(doc[rest], value[rest] - share, len(n)), [t.column(c) for c in keep]))
                words += len(h)
                if words >= GROUP:
                    yield from scored()
                    held, words = [], 0
                if len(m.keys) < m.v:  # words of no place in the table can be known: look them up in their parts
                    h, doc = h[~known], doc[~known]
                    order = np.lexsort((h, doc))
                    h, doc = h[order], doc[order]
                    lo = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]))
                    times = np.diff(np.append(lo, len(h))).astype(np.int32)
                    h, doc = h[lo], doc[lo]
                    some = _deal(h, m.parts)
                    pack = [np.array([len(i)], np.int64).tobytes() + h[i].tobytes() + ids[doc[i]].tobytes() + times[i].tobytes() for _, i in some]
                    void = [pa.nulls(len(some), t.schema.field(c).type) for c in keep]
                    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in some], pa.int32()), pa.array(np.zeros(len(some), np.int64)), pa.array(pack, pa.binary()), *void, *(pa.nulls(len(some), x) for x in (pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names=schema.names)
        if held:
            yield from scored()

    rows = stored(docs.select(*keep, text_col).mapInArrow(run, schema), "scores")

    def meet(t: pa.Table) -> pa.Table:
        keys, counts, h, ids, times = (np.zeros(0, x) for x in (_U, np.int64, _U, np.int64, np.int32))
        hs, rs, ts = [h], [ids], [times]
        for k, c, raw in zip(t.column("keys").to_pylist(), t.column("counts").to_pylist(), t.column("pack").to_pylist(), strict=True):
            if raw is None:
                keys, counts = np.frombuffer(k, _U), np.frombuffer(c, np.int64)
            else:
                n = int(np.frombuffer(raw, np.int64, 1)[0])
                hs.append(np.frombuffer(raw, _U, n, 8))
                rs.append(np.frombuffer(raw, np.int64, n, 8 + 8 * n))
                ts.append(np.frombuffer(raw, np.int32, n, 8 + 16 * n))
        h, ids, times = np.concatenate(hs), np.concatenate(rs), np.concatenate(ts).astype(np.int64)
        if len(keys):
            pos = np.searchsorted(keys, h)
            pos[pos == len(keys)] = 0
            ok = keys[pos] == h
        else:
            pos, ok = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        ids, times, value = ids[ok], times[ok], np.log10(counts[pos[ok]] + 1.0)
        u, inv = np.unique(ids, return_inverse=True)
        return pa.table({"__row": pa.array(u, pa.int64()), "__ka": pa.array(np.bincount(inv, times, len(u)).astype(np.int64)), "__ba": pa.array(np.bincount(inv, times * value, len(u)).astype(np.float64))})

    packs = rows.filter("__part >= 0").select(F.col("__part").alias("part"), F.lit(None).cast("binary").alias("keys"), F.lit(None).cast("binary").alias("counts"), F.col("__pack").alias("pack"))
    met = counted.select("part", "keys", "counts", F.lit(None).cast("binary").alias("pack")).unionByName(packs).groupBy("part").applyInArrow(meet, "__row long, __ka long, __ba double")
    more = met.groupBy("__row").agg(F.sum("__ka").alias("__ka"), F.sum("__ba").alias("__ba"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    done = rows.filter("__part < 0").join(more, "__row", "left")
    return done.select(*keep, F.col("__n").alias("n_tokens"), (F.col("__k") + zero("__ka")).alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"), (F.col("__b") + zero("__ba")).alias("base_score"), (F.col("__s") + zero("__ba")).alias("score"))

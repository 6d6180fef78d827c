"""Toxicity after noisy-channel deobfuscation.

Tokens that look disguised (letters mixed with look-alike signs or digits, a letter three times or more in a row, runs of
single letters and look-alike signs with spaces between) become character lattices: each sign can be one of the letters it looks
like, noise to drop, or itself; each run of one letter can be that letter once, twice or as it stands; words can break at noise,
and anywhere in a run of single letters. A Viterbi search over states of three characters and the known word
begun finds the restored string with the best sum of channel cost and character four-gram model, in time linear in the token, so tokens
and runs of any length are decoded. All other tokens have a lattice of one path, themselves, so they
aren't decoded. Each distinct disguise of `STORED` characters at most is decoded once per worker while it is in the store.

The score is a log-linear model of the restored text: a logistic regression over words, pairs of neighbouring words and runs
of `GRAMS` bytes (which see word ends), each present or not, with weights that are not negative and L1 and L2 penalties. Only
features that are significantly more frequent in toxic texts are candidates, the `MAX_FEATURES` best at most. The
intercept is moved from the share of toxic rows to that of all labelled ids, so 0.5 is even odds.

Fitted on all labelled rows, whole: the words of the character model, the counts of the features, the model and its intercept. Rows
stay distributed; the driver gets POOL counts at a time and the compact matrix only while it has IN_DRIVER bytes at most.

Defined results: null and empty texts score the intercept; ids may repeat; rows without label aren't learned; with no
positive label every score is 0; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter, OrderedDict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import forget, stored
from ._text import BLANKS, NOT_ALNUM, member, mix, sieve, slices, split_words

TRAIN_SLICE = 1 << 16
SCORE_SLICE = 1 << 20
GRAMS = (3, 4, 5, 6)
MIN_TEXTS = 3
MIN_G2 = 10.0
MAX_FEATURES = 4000
LASSO, RIDGE = 0.02, 0.3
STEPS = 500
VOCABULARY = 15_000
PART = 1 << 21
POOL = 1 << 20
BLOCK = 1 << 14
WORDS = 1 << 18
TASK_BYTES = 64 << 20
IN_DRIVER = 32 << 20
STORE = 200_000
STORED = 64
_BLANK = pa.scalar(" ", pa.large_string())
_HASHED = np.uint64(1 << 63)
_RUN = np.uint64((1 << 48) - 1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)  # odd: keys are spread over the sieve without collisions
#: fixed values: the letters that signs and digits stand for in leetspeak
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i"}
NOISE = ".-_*~^'`\"#,:;/\\="
COST = {"look": 0.7, "drop": 1.6, "lose": 6.0, "keep": 4.0, "once": 0.4, "twice": 0.7, "same": 3.0, "word": 4.0, "break": 1.6}

_KIND = np.zeros(256, np.int8)  # 1 letter, 2 look-alike or noise
_KIND[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_KIND[[ord(c) for c in [*LOOKALIKES, *NOISE] if ord(c) < 0x80]] = 2

_LOOK = np.zeros(256, bool)
_LOOK[[ord(c) for c in LOOKALIKES if ord(c) < 0x80]] = True

_TAIL = np.zeros(256, bool)
_TAIL[[ord(c) for c in LOOKALIKES if ord(c) < 0x80 and c not in "!|+(<"]] = True


class CharModel:
    """Four-grams of characters within words, backed off to shorter ones; whole words seen in training get a bonus."""

    def __init__(self, words: Counter) -> None:
        self.words = words
        self.heads = {w[:i] for w in words for i in range(1, len(w) + 1)}
        self.cost = lru_cache(maxsize=1 << 18)(self._cost)
        self.grams: list[Counter] = [Counter() for _ in range(5)]
        for w, n in words.items():
            s = f"^^^{w}$"
            for i in range(3, len(s)):
                for k in range(5):
                    self.grams[k][s[i + 1 - k : i + 1]] += n
                for k in range(1, 4):  # contexts, apart from grams by a mark
                    self.grams[k]["\0" + s[i - k : i]] += n

    def _cost(self, before: str, c: str) -> float:
        p = 1.0 / 200
        for k in range(4):
            seen = self.grams[k]["\0" + before[3 - k :]] if k else self.grams[0][""]
            p = (self.grams[k + 1][before[3 - k :] + c] + 2 * p) / (seen + 2)
        return -math.log(p)

    def _end(self, state: str, word: str | None) -> float:
        return self.cost(state, "$") - COST["word"] * (word in self.words)

    def arcs(self, ch: str, n: int, spaced: bool) -> list[tuple[str, float]]:
        """What n times ch can have been, and the channel's cost of each."""
        if ch.isalpha():
            out = [(ch * n, 0.0 if n < 3 else COST["same"] + n)]
            out += [(ch * k, COST["once" if k == 1 else "twice"]) for k in (1, 2) if k < n]
            if spaced:
                out += [(f"{ch * i} {ch * j}", COST["break"] + COST["once"] * (i + j < n)) for i in (1, 2) for j in (1, 2) if i + j <= n]
            return out
        out = [(x * k, COST["look"] * k) for x in LOOKALIKES.get(ch, "") for k in sorted({1, min(n, 2)})]
        out.append(("", COST["drop" if ch in NOISE else "lose"]))
        out.append((" ", COST["break"]) if ch in NOISE else (ch * n, COST["keep"] * min(n, 4)))
        return out

    def decode(self, token: str, spaced: bool = False) -> tuple[str, float]:
        """The best restored string of a token and its cost (Viterbi; a state is the last three characters and the word so
        far while it begins a known one). spaced: the letters of a spaced run, where words may break anywhere."""
        beams: dict[tuple[str, str | None], tuple[float, tuple | None]] = {("^^^", ""): (0.0, None)}
        for run in re.finditer(r"(.)\1*", token, re.S):
            arcs = self.arcs(run[1], len(run[0]), spaced)
            fresh: dict[tuple[str, str | None], tuple[float, tuple | None]] = {}
            for (before, begun), (cost, back) in beams.items():
                for out, price in arcs:
                    state, word, c = before, begun, cost + price
                    for x in out:
                        if x == " ":
                            c += self._end(state, word)
                            state, word = "^^^", ""
                        else:
                            c += self.cost(state, x)
                            state = state[1:] + x
                            word = word + x if word is not None and word + x in self.heads else None
                    if (state, word) not in fresh or c < fresh[state, word][0]:
                        fresh[state, word] = (c, (back, out) if out else back)
            if spaced:
                for (state, word), (c, back) in list(fresh.items()):
                    c += self._end(state, word) + COST["break"]
                    if state != "^^^" and (("^^^", "") not in fresh or c < fresh["^^^", ""][0]):
                        fresh["^^^", ""] = (c, (back, " "))
            beams = fresh
        # a word that has just been ended has no end of its own
        c, back = min(((c + (self._end(*s) if s[0] != "^^^" else 0.0), b) for s, (c, b) in beams.items()), key=lambda x: x[0])
        out = []
        while back:
            back, x = back
            out.append(x)
        return "".join(reversed(out)).strip(), c


def _disguised(raw) -> list[tuple[int, int]]:
    """Word ranges (first, last + 1) of blank-split words that look disguised; more than one word: spaced letters."""
    n = len(raw.start)
    if not n:
        return []
    kind = _KIND[raw.buf]
    up = lambda x: np.concatenate([[0], np.cumsum(x)])
    letters, signs = up(kind == 1), up((kind == 2) | ((raw.buf >= 0x30) & (raw.buf < 0x3A)))
    same = np.zeros(len(raw.buf), bool)
    same[2:] = (raw.buf[2:] == raw.buf[1:-1]) & (raw.buf[1:-1] == raw.buf[:-2]) & (kind[2:] == 1)
    same = up(same)
    # a sign with a letter next, or one look-alike at the end after a letter: punctuation and its runs are no disguise
    inner = np.zeros(len(raw.buf), bool)
    inner[:-1] = (kind[:-1] == 2) & (kind[1:] == 1)
    ends = raw.end - 1
    inner[ends[(ends > raw.start) & _TAIL[raw.buf[ends]] & (kind[ends - 1] == 1)]] = True
    inner = up(inner)
    a, b = raw.start, raw.end
    size, own = b - a, letters[b] - letters[a]
    odd = ((own > 0) & (signs[b] > signs[a]) & (inner[b] > inner[a])) | ((own >= 3) & (same[b] > same[a]))
    # words of one letter or look-alike sign, three or more in a row within a document, with a letter among them
    chars = up((raw.buf & 0xC0) != 0x80)
    one = (chars[b] - chars[a] == 1) & ((own > 0) | _LOOK[raw.buf[a]])
    odd &= ~one
    lettered = up(one & (own > 0))
    out = [(int(i), int(i) + 1) for i in np.flatnonzero(odd)]
    lone = np.concatenate([[0], (one).view(np.int8), [0]])
    step = np.diff(lone)
    for i, j in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True):
        i, j = int(i), int(j)
        while i < j:
            cut = min(j, int(raw.first[raw.doc[i] + 1]))
            if cut - i >= 3 and lettered[cut] > lettered[i]:
                out.append((i, cut))
            i = cut
    return out


class Restorer:
    def __init__(self, chars: CharModel) -> None:
        self.chars, self.store = chars, OrderedDict()

    def __call__(self, token: str, spaced: bool = False) -> str:
        if len(token) > STORED:
            return self.chars.decode(token, spaced)[0]
        hit = self.store.get((token, spaced))
        if hit is None:
            hit = self.store[token, spaced] = self.chars.decode(token, spaced)[0]
            if len(self.store) > STORE:
                self.store.popitem(last=False)
        return hit


def restored(part: pa.RecordBatch, text_col: str, restore: Restorer) -> pa.Array:
    """For each row the restored forms of its disguised tokens, blank-joined (empty if it has none)."""
    raw = split_words(part.column(text_col), BLANKS, lower=True)
    more: dict[int, list[str]] = {}
    for i, j in _disguised(raw):
        token = "".join(raw.bytes_of(k).decode() for k in range(i, j))
        more.setdefault(int(raw.doc[i]), []).append(restore(token, j - i > 1))
    return pa.array([" ".join(more.get(i, ())) for i in range(part.num_rows)], pa.large_string())


def features(col: pa.Array, own: np.ndarray | None = None, bits: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of every feature that a row of texts holds, each pair once; own, bits: only keys of this sorted table.

    Features are words, pairs of neighbouring words and runs of GRAMS bytes of the words joined by single blanks, so
    runs see where words begin and end. A run's key is its bytes and its length, a word's or pair's key a 63-bit hash.
    """
    w = split_words(col, NOT_ALNUM, lower=True)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if not len(w.start):
        return none
    found = []

    def keep(key: np.ndarray, doc: np.ndarray) -> None:
        at = np.arange(len(key)) if own is None else np.flatnonzero(member(key * _SPREAD, own, bits))
        found.append((key[at], doc[at].astype(np.int64)))

    keep(w.hash | _HASHED, w.doc)
    pair = np.flatnonzero(w.doc[1:] == w.doc[:-1])
    keep(mix(w.hash[pair] * np.uint64(3) + w.hash[pair + 1]) | _HASHED, w.doc[pair])
    # the words of all rows with a blank before each and two after a row's last one
    size = w.end - w.start
    gap = np.ones(len(size), np.int64)
    gap[1:] += w.doc[1:] != w.doc[:-1]
    to = np.cumsum(gap + size) - size
    text = np.full(int(to[-1] + size[-1]) + 8, 0x20, np.uint8)
    text[np.repeat(to - np.cumsum(size) + size, size) + np.arange(int(size.sum()))] = w.buf[np.repeat(w.start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]
    doc = np.repeat(w.doc, np.diff(np.concatenate([[0], to[1:] - 1, [len(text)]])))
    doc[-7:] = -1  # the last row ends with one blank, as the others do
    packed = text.astype(np.uint64)
    for k in (1, 2, 4):  # eight bytes from each place on, the first one lowest
        ahead = np.zeros_like(packed)
        ahead[:-k] = packed[k:]
        packed = packed | (ahead << np.uint64(8 * k))
    wide = (packed & np.uint64(0xFFFF)) == np.uint64(0x2020)
    for n in GRAMS:
        m = len(text) - n + 1
        inside = doc[:m] == doc[n - 1 :]
        key = (packed[:m] & np.uint64((1 << 8 * n) - 1)) | np.uint64(n << 56)
        ok = inside & ~wide[:m]
        keep(key[ok], doc[:m][ok])
    key, doc = (np.concatenate(z) for z in zip(*found, strict=True))
    return _distinct(key, doc, len(col))


def _distinct(key: np.ndarray, doc: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Each (key, row) pair once. Runs of bytes leave room for the row's number in one word, which sorts far faster than two."""
    if rows > 1 << 14:
        order = np.lexsort((key, doc))
        key, doc = key[order], doc[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        return key[new], doc[new]
    run = key < _HASHED
    k = key[run]
    both = np.sort((doc[run].astype(np.uint64) << np.uint64(50)) | (((k >> np.uint64(56)) - np.uint64(GRAMS[0])) << np.uint64(48)) | (k & _RUN))
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    both = both[new]
    size = ((both >> np.uint64(48)) & np.uint64(3)) + np.uint64(GRAMS[0])
    word = _distinct(key[~run], doc[~run], 1 << 15)
    return np.concatenate([(both & _RUN) | (size << np.uint64(56)), word[0]]), np.concatenate([(both >> np.uint64(50)).astype(np.int64), word[1]])


def _tally(batches, most: int):
    """Sorted keys and the number of texts that hold each, in parts of about `most` keys."""
    keys, counts, held, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def merged():
        k, n = np.unique(np.concatenate(held), return_counts=True)
        both, inv = np.unique(np.concatenate([keys, k]), return_inverse=True)
        return both, np.bincount(inv, np.concatenate([counts, n]), len(both)).astype(np.int64)

    for batch in batches:
        for part in slices(batch, "text", TRAIN_SLICE):
            held.append(features(part.column("text"))[0])
            size += len(held[-1])
            if size > most:  # sorted many at a time
                keys, counts = merged()
                held, size = [], 0
                if len(keys) > most:
                    yield keys, counts
                    keys, counts = keys[:0], counts[:0]
    keys, counts = merged() if held else (keys, counts)
    if len(keys):
        yield keys, counts


def _g2(hit, other, n1: int, n0: int) -> np.ndarray:
    """Log-likelihood ratio of features in hit of n1 toxic and other of n0 clean texts; zero if not more frequent in toxic ones."""
    hit, other = np.asarray(hit, float), np.asarray(other, float)
    xlogy = lambda x, y: np.where(x > 0, x * np.log(np.maximum(x, 1e-12) / np.maximum(y, 1e-12)), 0.0)
    have, n, p = hit + other, n1 + n0, n1 / (n1 + n0)
    g2 = 2 * (xlogy(hit, have * p) + xlogy(other, have * (1 - p)) + xlogy(n1 - hit, (n - have) * p) + xlogy(n0 - other, (n - have) * (1 - p)))
    return np.where(hit * n0 > other * n1, np.round(g2, 6), 0.0)  # equal counts tie wherever they stand in an array


def candidates(rows: DataFrame, n1: int, n0: int, tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of the MAX_FEATURES features with the best G2 over all rows (toxic, text), and the numbers of texts that hold them.

    Features in fewer than MIN_TEXTS toxic texts, not more frequent there or with a G2 below MIN_G2 aren't taken. Toxic texts are
    counted in full. Clean texts are counted for POOL features at a time, those in most toxic texts first, until the G2 that
    the next ones would have without any clean text is below that of the MAX_FEATURES best found: no other can be among them.
    """
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if not n1 or not n0:
        return none
    most, (toxic, clean) = PART, (rows.filter(F.col("toxic") == y).select("text").coalesce(n) for y, n in ((1, tasks), (0, 4 * tasks)))

    def count(batches):
        for keys, n in _tally(batches, most):
            for at in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + (1 << 16)].view(np.int64)), pa.array(n[at : at + (1 << 16)])], names=["key", "n"])

    least = MIN_TEXTS
    while least <= n1 and _g2(least, 0, n1, n0) < MIN_G2:
        least += 1
    hits = stored(toxic.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least), "toxicity-hits")
    batches, room = [], 0  # of (least n, greatest n, part, parts)
    for n, c in sorted(((r["n"], r["count"]) for r in hits.groupBy("n").count().collect()), reverse=True):
        parts = -(-c // POOL)
        if parts > 1:
            batches += [(n, n, i, parts) for i in range(parts)]
            room = 0
        elif c <= room:
            batches[-1] = (n, *batches[-1][1:])
            room -= c
        else:
            batches.append((n, n, 0, 1))
            room = POOL - c
    best, held, of, bar = none[0], none[1], np.zeros(0), MIN_G2
    for lo, hi, part, parts in batches:
        if _g2(hi, 0, n1, n0) < bar:
            break
        got = hits.filter(F.col("n").between(lo, hi) & (F.pmod(F.xxhash64("key"), F.lit(parts)) == part)).toArrow()
        keys, hit = got.column("key").to_numpy().view(np.uint64), got.column("n").to_numpy()
        order = np.argsort(keys)
        keys, hit = keys[order], hit[order]
        other = _held_by(clean, keys)
        g2 = _g2(hit, other, n1, n0)
        fine = g2 >= bar
        best, held, of = (np.concatenate(z) for z in ((best, keys[fine]), (held, (hit + other)[fine]), (of, g2[fine])))
        top = np.lexsort((best, -of))[:MAX_FEATURES]
        best, held, of = best[top], held[top], of[top]
        if len(best) == MAX_FEATURES:
            bar = of[-1]
    forget(hits)
    order = np.argsort(best)
    return best[order], held[order]


def _held_by(texts: DataFrame, keys: np.ndarray) -> np.ndarray:
    """For each of the sorted keys the number of texts that hold it. Tasks send blocks of counts, which are summed block by block."""
    bag, most, block = texts.sparkSession.sparkContext.broadcast(keys), PART, BLOCK

    def count(batches):
        own = bag.value
        n = np.zeros(len(own), np.int64)
        for k, c in _tally(batches, most):
            at = np.minimum(np.searchsorted(own, k), len(own) - 1)
            ok = own[at] == k
            n[at[ok]] += c[ok]
        at = list(range(0, len(n), block))
        yield pa.RecordBatch.from_arrays([pa.array([a // block for a in at], pa.int32()), pa.array([n[a : a + block].tobytes() for a in at], pa.binary())], names=["block", "n"])

    def total(t: pa.Table) -> pa.Table:
        n = sum(np.frombuffer(x, np.int64) for x in t.column("n").to_pylist())
        return pa.table([t.column("block").slice(0, 1), pa.array([n.tobytes()], pa.binary())], names=["block", "n"])

    out = np.zeros(len(keys), np.int64)
    for r in texts.mapInArrow(count, "block int, n binary").groupBy("block").applyInArrow(lambda t: total(t), "block int, n binary").collect():
        n = np.frombuffer(r["n"], np.int64)
        out[r["block"] * block : r["block"] * block + len(n)] = n
    bag.unpersist()
    return out


def _matrix(rows: DataFrame, keys: np.ndarray) -> DataFrame:
    """(y, key, doc) blocks of rows: labels, places of the features that the texts hold, and the texts' numbers in the block."""
    def run(batches):
        spread = np.sort(keys * _SPREAD)
        bits = sieve(spread)
        for batch in batches:
            for part in slices(batch, "text", SCORE_SLICE):
                k, d = features(part.column("text"), spread, bits)
                cols = part.column("toxic").to_numpy().astype(np.uint8), np.searchsorted(keys, k).astype(np.uint16), d.astype(np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cols], names=["y", "key", "doc"])

    return rows.select("toxic", "text").mapInArrow(run, "y binary, key binary, doc binary")


def _loss(blocks, x: np.ndarray) -> np.ndarray:
    """Logistic loss of blocks under weights and intercept x, followed by its gradient."""
    w, out = x[:-1], np.zeros(len(x) + 1)
    for y, key, doc in blocks:
        y, key, doc = np.frombuffer(y, np.uint8), np.frombuffer(key, np.uint16), np.frombuffer(doc, np.uint32)
        z = np.bincount(doc, w[key], len(y)) + x[-1]
        r = 1 / (1 + np.exp(-z)) - y
        out[0] += (np.logaddexp(0, z) - y * z).sum()
        out[1:-1] += np.bincount(key, r[doc], len(w))
        out[-1] += r.sum()
    return out


def learn(matrix: DataFrame, held: np.ndarray, n1: int, n0: int, tasks: int) -> tuple[np.ndarray, float]:
    """Weights (none negative) and intercept of a logistic model of binary features under L1 and L2 penalties, over all rows of a matrix.

    L2 shares the evidence of features that come together, so each of them counts alone as well. Limited-memory quasi-Newton steps
    over the weights that can move, projected onto the allowed ones; scaled by the numbers `held` of texts that hold the features. A
    step sums the gradient over all blocks: where they are, or on the driver if they have IN_DRIVER bytes at most.
    """
    size = matrix.agg(F.sum(F.octet_length("y") + F.octet_length("key") + F.octet_length("doc"))).first()[0] or 0
    local = [tuple(r) for r in matrix.collect()] if size <= IN_DRIVER else None
    blocks = matrix.coalesce(tasks)

    def value(x: np.ndarray) -> tuple[float, np.ndarray]:
        def run(batches):
            out = sum((_loss(zip(*(b.column(c).to_pylist() for c in ("y", "key", "doc")), strict=True), x) for b in batches), np.zeros(len(x) + 1))
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["g"])

        out = _loss(local, x) if local is not None else sum((np.frombuffer(r["g"], float) for r in blocks.mapInArrow(run, "g binary").collect()), np.zeros(len(x) + 1))
        w, g = x[:-1], out[1:].copy()
        g[:-1] += LASSO + RIDGE * w
        return out[0] + LASSO * w.sum() + RIDGE / 2 * (w @ w), g

    p = (n1 + 0.5) / (n1 + n0 + 1)
    x = np.append(np.zeros(len(held)), math.log(p / (1 - p)))
    if not len(held):
        return x[:-1], float(x[-1])
    scale = 1 / (p * (1 - p) * np.append(held, n1 + n0) + RIDGE)
    low = np.append(np.zeros(len(held)), -np.inf)
    f, g = value(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS):
        free = (x > low) | (g < 0)
        q, back = np.where(free, g, 0.0), []
        for s, y in reversed(past):
            s, y = s * free, y * free
            if (sy := s @ y) > 1e-12 * np.sqrt((s @ s) * (y @ y)):
                a = s @ q / sy
                q = q - a * y
                back.append((a, s, y, sy))
        q = q * scale * (back[0][3] / (back[0][2] @ (scale * back[0][2])) if back else 1.0)
        for a, s, y, sy in reversed(back):
            q = q + (a - y @ q / sy) * s
        d, t = -np.where(free, q, 0.0), 1.0
        if d @ g >= 0:
            past, d = [], -np.where(free, scale * g, 0.0)
        while True:
            x2 = np.maximum(x + t * d, low)
            f2, g2 = value(x2)
            if f2 <= f + 1e-4 * (g @ (x2 - x)) or t < 1e-9:
                break
            t /= 2
        if f2 > f:
            break
        past = [*past[-19:], (x2 - x, g2 - g)]
        done = f - f2 <= 1e-9 * abs(f2)
        x, f, g = x2, f2, g2
        if done:
            break
    return x[:-1], float(x[-1])


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", share: float | None = None):
    """labelled: rows (text, label), all of which are learned from. share: of label 1 among all labelled ids (default: the rows').

    Returns (keys, weights, intercept, word counts of the character model).
    """
    spark = labelled.sparkSession
    raw = stored(labelled.select(F.coalesce((F.col(label_col) > 0).cast("int"), F.lit(0)).alias("toxic"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "toxicity-rows")
    of = raw.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("n1"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    n1, n0, tasks = int(of["n1"]), int(of["n"] - of["n1"]), max(spark.sparkContext.defaultParallelism, int(of["b"]) // TASK_BYTES)
    common = _vocabulary(raw)
    if not n1:
        forget(raw)
        return np.zeros(0, np.uint64), np.zeros(0), -np.inf, common
    bag = spark.sparkContext.broadcast(common)

    def restore(batches):
        own = _restorer(bag.value)
        for batch in batches:
            for part in slices(batch, "text", SCORE_SLICE):
                both = pc.binary_join_element_wise(part.column("text").cast(pa.large_string()), restored(part, "text", own), _BLANK)
                yield pa.RecordBatch.from_arrays([part.column("toxic"), both.cast(pa.string())], names=["toxic", "text"])

    rows = stored(raw.mapInArrow(restore, "toxic int, text string"), "toxicity-restored")
    forget(raw)
    keys, held = candidates(rows, n1, n0, tasks)
    matrix = stored(_matrix(rows, keys), "toxicity-matrix")
    forget(rows)
    w, b = learn(matrix, held, n1, n0, tasks)
    forget(matrix)
    if share is not None and n0:  # from the rows' share of label 1 to that of all labelled ids
        b += math.log(share / (1 - share)) - math.log(n1 / n0) if 0 < share < 1 else 0.0
    some = w > 0
    return keys[some], w[some], b, common


def _vocabulary(rows: DataFrame) -> tuple[tuple[str, int], ...]:
    """Words of letters that occur twice or more: the VOCABULARY most frequent ones, and as many again by their surplus in toxic texts."""
    def count(batches):
        held: dict[bytes, list[int]] = {}

        def out():
            return pa.RecordBatch.from_arrays([pa.array([x.decode() for x in held], pa.string()), *(pa.array([v[i] for v in held.values()], pa.int64()) for i in (0, 1))], names=["word", "n", "bad"])

        for batch in batches:
            labels = batch.column("toxic").to_numpy()
            at = 0
            for part in slices(batch, "text", SCORE_SLICE):
                w = split_words(part.column("text"), NOT_ALNUM, lower=True)
                _, first, inv, n = np.unique(w.hash, return_index=True, return_inverse=True, return_counts=True)
                bad = np.bincount(inv, labels[at + w.doc], len(n)).astype(np.int64)
                for i, k, b in zip(first.tolist(), n.tolist(), bad.tolist(), strict=True):
                    x = held.setdefault(w.bytes_of(i), [0, 0])
                    x[0] += k
                    x[1] += b
                at += part.num_rows
                if len(held) > WORDS:
                    yield out()
                    held = {}
        yield out()

    often = stored(rows.mapInArrow(count, "word string, n long, bad long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).filter("n >= 2"), "toxicity-words")
    total = often.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    usual = F.col("n") * F.lit((total["bad"] or 0) / max(1, total["n"] or 0))
    out = {}
    for rank in (F.col("n").cast("double"), (F.col("bad") - usual) / F.sqrt(usual + 1)):
        for r in often.orderBy(rank.desc(), "word").limit(VOCABULARY).collect():
            if r["word"].isalpha():
                out[r["word"]] = r["n"]
    forget(often)
    return tuple(sorted(out.items()))


@lru_cache(maxsize=2)
def _restorer(common) -> Restorer:
    return Restorer(CharModel(Counter(dict(common))))


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", text_col: str = "text") -> tuple[DataFrame, float]:
    """All labelled rows (id, label, text) and the share of label 1 among all labelled ids.

    An id with several labels has the greatest, an id with several texts the least.
    """
    own = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg((F.max(label_col) > 0).alias("__y"))
    counts = {bool(r["__y"]): r["count"] for r in own.groupBy("__y").count().collect()}
    n1, n0 = counts.get(True, 0), counts.get(False, 0)
    texts = docs.select(id_col, text_col).join(own, id_col).groupBy(id_col, "__y").agg(F.min(text_col).alias(text_col))
    return texts.select(id_col, F.col("__y").cast("int").alias(label_col), text_col), n1 / max(1, n1 + n0)


#: the name under which callers know it
sample_labelled = labelled_rows


def score(docs: DataFrame, model, text_col: str = "text", score_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """keep (default: all columns) plus score_col."""
    bag = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in (docs.columns if keep is None else keep) if c != score_col]
    read = [*keep, *([] if text_col in keep else [text_col])]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(score_col, T.DoubleType())])

    def run(batches):
        keys, weights, intercept, common = bag.value
        restore = _restorer(common)
        spread = np.sort(keys * _SPREAD)
        bits = sieve(spread)
        for batch in batches:
            for part in slices(batch, text_col, SCORE_SLICE):
                own, said = part.column(text_col).cast(pa.large_string()).fill_null(""), restored(part, text_col, restore)
                h, d = features(pc.binary_join_element_wise(own, said, _BLANK), spread, bits)
                total = np.bincount(d, weights[np.searchsorted(keys, h)], part.num_rows) + intercept
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(1 / (1 + np.exp(-total)))], names=schema.names)

    return docs.select(*read).mapInArrow(run, schema)

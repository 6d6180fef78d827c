"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z. A window is `window` consecutive words of an item; an
item with fewer words (but at least one) is one window. A document word is hit if it lies in an occurrence
of a window. The automaton holds every item; documents are streamed and the longest match that ends at each
word is tracked. Only runs of words whose short n-grams all occur in some item can hold a window, so a sorted
table of those n-grams (numpy, no Python per word) finds the runs that are streamed; the rest of the text
resets the automaton to its root and needs no steps.

Items are broadcast: their text is measured first, and items beyond `shard_bytes` (about a hundred times as much memory as an
automaton) are dealt into several automata. Each has its own pass, written before the next one begins, which adds to the hits
so far; the driver holds the items of one pass.

Defined results: null or word-less text has n_words 0 and no hits; items with null text, no words or a null id
never match; repeated item ids count once; repeated documents are judged alike; extra columns are kept by
`decontaminate` and ignored by `contamination`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._automaton import SuffixAutomaton
from ._spark import stored
from ._text import NOT_ALNUM, member, run_hash, sieve, slices, split_words
from ._worker import resident

WINDOW = 10
SHARD_BYTES = 2 << 20
MAX_COVERAGE = 0.5


class ItemIndex:
    """Automaton of items, the n-grams that can start a match, and the items of each window."""

    def __init__(self, items: tuple[tuple[str, str], ...], window: int) -> None:
        self.window = window
        words = split_words(pa.array([t for _, t in items], pa.large_string()), NOT_ALNUM, lower=True)
        sam, self.ids = SuffixAutomaton(), [i for i, _ in items]
        self.sam = sam
        self.vocab: dict[bytes, int] = {}
        sizes = np.diff(words.first)
        self.shortest = int(min([window, *sizes[sizes > 0].tolist()]))
        self.gram = min(3, self.shortest)
        keys = self.grams(words.hash, words.first)
        self.table = np.unique(keys[keys != 0])
        self.bits = sieve(self.table)
        for i in range(len(items)):
            lo, hi = words.first[i], words.first[i + 1]
            sam.add([self.vocab.setdefault(words.bytes_of(k), len(self.vocab)) for k in range(lo, hi)])
        # items of each state, for windows only: walk up from each end of a window to the state that holds it
        self.full: dict[int, set[int]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        for i in range(len(items)):
            lo, n = words.first[i], int(sizes[i])
            symbols = [self.vocab[words.bytes_of(k)] for k in range(lo, lo + n)]
            states, _ = sam.match(symbols)
            for k in range(window - 1, n):
                self.full.setdefault(self.holder(states[k], window), set()).add(i)
            if 0 < n < window:
                self.short.setdefault(self.holder(states[-1], n), []).append((n, i))

    def holder(self, state: int, n: int) -> int:
        """The state that holds the suffix of n words of a match that ends in `state`."""
        link, length = self.sam.link, self.sam.length
        while state and length[link[state]] >= n:
            state = link[state]
        return state

    def grams(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Hash of the n-gram that starts at each word, 0 where its text ends before."""
        n = self.gram
        out = np.zeros(len(h), np.uint64)
        if len(h) >= n:
            at = np.arange(len(h) - n + 1)
            out[: len(at)] = run_hash(h, at, at + n) | np.uint64(1)
            for k in range(1, n):
                cut = first[1:] - k
                out[cut[(cut >= 0) & (cut < len(h)) & (cut >= first[:-1])]] = 0
        return out

    def search(self, words) -> tuple[np.ndarray, list[set[int]]]:
        """(hit flag of each word, items of each document)."""
        hit, found = np.zeros(len(words.start), bool), [set() for _ in range(words.n_docs)]
        ok = member(self.grams(words.hash, words.first), self.table, self.bits)
        step = np.diff(np.concatenate([[0], ok.view(np.int8), [0]]))
        lo, hi = np.flatnonzero(step == 1), np.flatnonzero(step == -1) + self.gram - 1
        at = np.flatnonzero(hi - lo >= self.shortest)
        # grams of different documents can touch: cut runs where documents end
        for a, b in zip(lo[at].tolist(), hi[at].tolist(), strict=True):
            while a < b:
                cut = min(b, int(words.first[words.doc[a] + 1]))
                self.stream(words, a, cut, hit, found)
                a = cut
        return hit, found

    def stream(self, words, a: int, b: int, hit: np.ndarray, found: list[set[int]]) -> None:
        get, w = self.vocab.get, self.window
        states, sizes = self.sam.match([get(words.bytes_of(k), -1) for k in range(a, b)])
        items = found[words.doc[a]]
        for k, (s, n) in enumerate(zip(states, sizes, strict=True)):
            if n >= w:
                items |= self.full[self.holder(s, w)]
                hit[a + k - w + 1 : a + k + 1] = True
            if self.short and n:
                while s:
                    for m, i in self.short.get(s, ()):
                        if m <= n:
                            items.add(i)
                            hit[a + k - m + 1 : a + k + 1] = True
                    s = self.sam.link[s]


def _index(items: tuple[tuple[str, str], ...], window: int) -> ItemIndex:
    return resident(ItemIndex, items, window)


def _shards(items: DataFrame, id_col: str, text_col: str, shard_bytes: int):
    """The number of shards, and a function that fetches one."""
    own = items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).dropna()
    size = own.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-int(size) // shard_bytes))
    shard = F.pmod(F.xxhash64("i"), F.lit(n))
    return n, lambda k: tuple(sorted((r.i, r.t) for r in own.filter(shard == k).collect()))


def _passes(docs: DataFrame, items: DataFrame, window: int, text_col: str, shard_bytes: int, item_id: str, item_text: str, finish, schema: T.StructType, keep: list[str]) -> DataFrame:
    """Streams documents through each shard's automaton; finish(table, words, hit, found) makes the result rows."""
    n, shard = _shards(items, item_id, item_text, shard_bytes)
    many = T.StructType([*docs.select(*keep).schema.fields, T.StructField("__hit", T.BinaryType()), T.StructField("__items", T.ArrayType(T.StringType()))])

    def run(bag, k: int, last: bool):
        def f(batches):
            index = _index(bag.value, window)
            for batch in batches:
                for part in slices(batch, text_col):
                    words = split_words(part.column(text_col), NOT_ALNUM, lower=True)
                    hit, found = index.search(words)
                    found = [{index.ids[i] for i in x} for x in found]
                    if k:
                        before = [np.unpackbits(np.frombuffer(x, np.uint8), count=int(n)).astype(bool) for x, n in zip(part.column("__hit").to_pylist(), np.diff(words.first), strict=True)]
                        hit |= np.concatenate([np.zeros(0, bool), *before])
                        found = [x | set(y) for x, y in zip(found, part.column("__items").to_pylist(), strict=True)]
                    if last:
                        yield finish(part, words, hit, found)
                    else:
                        bits = [np.packbits(hit[a:b]).tobytes() for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
                        rows = [part.column(c) for c in keep]
                        yield pa.RecordBatch.from_arrays([*rows, pa.array(bits, pa.binary()), pa.array([sorted(x) for x in found], pa.list_(pa.string()))], names=[*keep, "__hit", "__items"])

        return f

    out = docs.select(*keep)
    for k in range(n):
        last = k == n - 1
        bag = docs.sparkSession.sparkContext.broadcast(shard(k))
        out = out.mapInArrow(run(bag, k, last), schema if last else many)
        if not last:
            out = stored(out, "hits")
            bag.destroy()
    return out


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    schema = T.StructType([docs.schema[id_col], T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType())])

    def finish(part, words, hit, found):
        n = np.diff(words.first)
        hits = np.bincount(words.doc[hit], minlength=words.n_docs).astype(np.int64)
        none = hashlib.sha256(b"").hexdigest()
        sha = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() if x else none for x in found]
        return pa.RecordBatch.from_arrays([part.column(id_col), pa.array(n), pa.array(hits), pa.array([len(x) for x in found], pa.int64()), pa.array(sha), pa.array(hits > 0)], names=schema.names)

    return _passes(docs, items, window, text_col, shard_bytes, item_id, item_text, finish, schema, [id_col, text_col])


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Documents with hit spans cut out of their text; a document whose hit words exceed `max_coverage` of its words goes.

    Spans are cut from their first to their last word; text without hits is returned byte for byte, null text stays
    null. All columns are kept.
    """
    keep = docs.columns

    def finish(part, words, hit, found):
        texts, n = part.column(text_col).to_pylist(), np.diff(words.first)
        hits = np.bincount(words.doc[hit], minlength=words.n_docs)
        base = np.zeros(words.n_docs + 1, np.int64)
        base[1:] = np.cumsum([len(t.encode()) + 1 if t is not None else 1 for t in texts])
        for i in np.flatnonzero(hits):
            raw, lo, out, done = texts[i].encode(), words.first[i], [], 0
            step = np.diff(np.concatenate([[0], hit[lo : words.first[i + 1]].view(np.int8), [0]]))
            for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True):
                out.append(raw[done : words.start[lo + a] - base[i]])
                done = int(words.end[lo + b - 1] - base[i])
            texts[i] = b"".join([*out, raw[done:]]).decode()
        cols = [pa.array(texts, part.schema.field(c).type) if c == text_col else part.column(c) for c in keep]
        return pa.RecordBatch.from_arrays(cols, names=keep).filter(pa.array(hits <= max_coverage * n))

    return _passes(docs, items, window, text_col, shard_bytes, item_id, item_text, finish, docs.schema, keep)

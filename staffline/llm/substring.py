"""Substring dedup: every word covered by a window of `window` words whose sequence also starts earlier goes.

The reference is the corpus itself. It has no bound, so it is cut into shards by content, and instead of broadcasting each
shard's suffix automaton to all documents, the passages of documents that can match in a shard are sent to it. A window's
anchor is the least hash among its `GRAM`-word shingles; equal windows have equal anchors and meet in one shard.

1. Documents are dealt to buckets of some MB once; this one exchange is read again by the steps below that need texts.
2. Each bucket sends its anchors, packed, to parts by their hash. A part answers with two bits per anchor: whether it
   occurs at two places or more, and whether at more than `HOT`.
3. Each bucket sends its pieces, maximal runs of windows with one such anchor, as text to the anchor's part. Equal
   pieces of a bucket are sent once. Windows of a hot anchor are pieces of their own and are dealt by their whole text, so
   a shingle that a third of all documents hold doesn't meet in one task.
4. A part takes its pieces in the order of the corpus. Of equal pieces only the first is reference text; the pieces of some
   anchors at a time (`SHARD_WORDS`) make a generalised suffix automaton, whose states know the first place of their words.
   Every piece streams through it for matching statistics: a window whose state was first met elsewhere is marked.
5. Marks, packed by bucket, meet their documents, which are cut.

Hashes only route: words are compared as they are, so results are exact.

Defined results: null text has no words and its kept text is empty; texts of fewer words than a window lose none; rows with
equal id and equal text are one document and judged alike; an id with several texts orders them by their hash; rows with a
null id come last of all; extra columns are kept by `dedup` and ignored by `repeats`; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._automaton import SuffixAutomaton
from ._spark import table_parts
from ._text import BLANKS, Runs, mix, slices, split_words

WINDOW = 20
GRAM = 8
BUCKET_BYTES = 4 << 20
SLICE = 2 << 20
HOT = 1000
SHARD_WORDS = 20_000
REFERENCE_BYTES = 4 << 20
_U = np.uint64
_LAST = 2**63 - 1


def _sliding(x: np.ndarray, n: int, op) -> np.ndarray:
    """op over each n consecutive values (len(x) - n + 1 results)."""
    done, out = 1, x
    while done < n:
        step = min(done, n - done)
        out = op(out[:-step], out[step:])
        done += step
    return out


def _anchors(words, window: int):
    """(window starts, their anchors, shingle hashes, whether a shingle is some window's anchor)."""
    gram = min(GRAM, window)
    h, n = words.hash, len(words.start)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, _U), np.zeros(0, bool)
    at = np.arange(n - gram + 1)
    g = Runs(h)(at, at + gram)
    span = window - gram + 1
    least = _sliding(g, span, np.minimum)
    start = np.arange(n - window + 1)
    inside = words.doc[start] == words.doc[start + window - 1]
    # a shingle is an anchor if it equals the least of some window of its document
    top = np.where(inside, least, _U(0))
    pad = np.concatenate([np.zeros(span - 1, _U), top, np.zeros(span - 1, _U)])
    return start[inside], least[inside], g, _sliding(pad, span, np.maximum) == g


def _parts_of(part: np.ndarray, parts: int):
    """(part, places of it) of each part that occurs."""
    order = np.argsort(part, kind="stable")
    at = np.searchsorted(part[order], np.arange(parts + 1))
    return [(int(p), order[at[p] : at[p + 1]]) for p in np.flatnonzero(np.diff(at))]


def _own(t: pa.Table, text_col: str) -> pa.Table:
    """id, th and text of a bucket's documents in their order, each (id, th) once."""
    ids, th = (t.column(c).to_numpy() for c in ("__id", "__th"))
    order = np.lexsort((th, ids))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(ids[order]) != 0) | (np.diff(th[order]) != 0)
    return t.select(["__id", "__th", text_col]).take(pa.array(order[new]))


def _bucket_anchors(t: pa.Table, text_col: str, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted anchors of a bucket and the number of their places in it."""
    keys, counts = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
    for s in slices(t, text_col, SLICE):
        _, _, g, is_anchor = _anchors(split_words(s.column(text_col), BLANKS, lower=False), window)
        k, n = np.unique(g[is_anchor], return_counts=True)
        keys.append(k)
        counts.append(n)
    keys, inv = np.unique(np.concatenate(keys), return_inverse=True)
    return keys, np.bincount(inv, np.concatenate(counts), len(keys)).astype(np.int64)


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    return (mix(keys) % _U(parts)).astype(np.int64)


def _asked(table: pa.Table, text_col: str, window: int, parts: int) -> pa.Table:
    """A bucket's anchors by part: part, bucket, keys (8 bytes an anchor, sorted, then a byte: number of places up to 255)."""
    keys, n = _bucket_anchors(_own(table, text_col), text_col, window)
    some = _parts_of(_part(keys, parts), parts)
    pack = [keys[i].tobytes() + np.minimum(n[i], 255).astype(np.uint8).tobytes() for _, i in some]
    bucket = table.column("__bucket")[0].as_py()
    return pa.table({"part": pa.array([p for p, _ in some], pa.int32()), "bucket": pa.array([bucket] * len(some), pa.int32()), "pack": pa.array(pack, pa.binary())})


def _answered(table: pa.Table) -> pa.Table:
    """Two bits for each anchor of each bucket, in the order asked: it occurs again; it is hot."""
    raw = table.column("pack").to_pylist()
    size = np.array([len(x) // 9 for x in raw])
    keys = np.concatenate([np.frombuffer(x, _U, k) for x, k in zip(raw, size, strict=True)])
    n = np.concatenate([np.frombuffer(x, np.uint8, k, 8 * k) for x, k in zip(raw, size, strict=True)])
    _, inv = np.unique(keys, return_inverse=True)
    total = np.bincount(inv, n)[inv]
    bits = np.stack([total > 1, total > HOT], 1)
    ends = np.cumsum(size)
    pack = [np.packbits(bits[e - k : e].ravel()).tobytes() for e, k in zip(ends, size, strict=True)]
    return pa.table({"bucket": table.column("bucket"), "from": table.column("part"), "bits": pa.array(pack, pa.binary())})


def _pieces(words, window: int, keys: np.ndarray, again: np.ndarray, hot: np.ndarray):
    """(first word, words, route) of each maximal run of windows with one repeated anchor."""
    start, anchor, _, _ = _anchors(words, window)
    at = np.searchsorted(keys, anchor)
    ok = again[at] if len(keys) else np.zeros(len(at), bool)
    start, anchor, at = start[ok], anchor[ok], at[ok]
    alone = hot[at] if len(keys) else ok[ok]
    new = np.ones(len(start), bool)
    new[1:] = alone[1:] | (np.diff(start) != 1) | (anchor[1:] != anchor[:-1])
    lo = np.flatnonzero(new)
    n = np.diff(np.append(lo, len(start))) + window - 1
    route = anchor[lo]
    single = np.flatnonzero(alone[lo])
    if len(single):
        route[single] = Runs(words.hash)(start[lo[single]], start[lo[single]] + window)
    return start[lo], n, route


def _joined(words):
    """The words with a single blank after each, as bytes, and the place of each word in them."""
    size = words.end - words.start
    at = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(int(at[-1]), 0x20, np.uint8)
    shift = np.repeat(at[:-1] - words.start, size)
    src = np.repeat(words.start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum())) if len(size) else np.zeros(0, np.int64)
    out[src + shift] = words.buf[src]
    return out.tobytes(), at


def _sent(docs: pa.Table, answers: pa.Table, text_col: str, window: int, parts: int) -> pa.Table:
    """A bucket's pieces by part, the first of equal ones; marks of the others, for the bucket itself (part of its number)."""
    none = pa.table({"part": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "marks": pa.array([], pa.bool_()), "pack": pa.array([], pa.binary())})
    if not docs.num_rows:
        return none
    bucket, own = docs.column("__bucket")[0].as_py(), _own(docs, text_col)
    keys, _ = _bucket_anchors(own, text_col, window)
    again, hot = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    bits = dict(zip(answers.column("from").to_pylist(), answers.column("bits").to_pylist(), strict=True))
    for p, i in _parts_of(_part(keys, parts), parts):
        said = np.unpackbits(np.frombuffer(bits[p], np.uint8), count=2 * len(i)).reshape(-1, 2).astype(bool)
        again[i], hot[i] = said[:, 0], said[:, 1]
    ids, th = own.column("__id").to_numpy(), own.column("__th").to_numpy()
    seen: set[bytes] = set()
    texts, kept, gone, row = [], [], [], 0
    for s in slices(own, text_col, SLICE):
        w = split_words(s.column(text_col), BLANKS, lower=False)
        first, n, route = _pieces(w, window, keys, again, hot)
        data, at = _joined(w)
        doc = w.doc[first].astype(np.int64)
        place = np.stack([doc + row, first - w.first[doc], n, route.view(np.int64)], 1) if len(first) else np.zeros((0, 4), np.int64)
        is_new = np.zeros(len(first), bool)
        for k, (a, b) in enumerate(zip(at[first].tolist(), (at[first + n] - 1).tolist(), strict=True)):
            x = data[a:b]  # slices come in the order of the corpus, so the first of equal pieces is the earliest
            if x not in seen:
                seen.add(x)
                texts.append(x)
                is_new[k] = True
        kept.append(place[is_new])
        gone.append(place[~is_new])
        row += s.num_rows
    kept, gone = np.concatenate(kept), np.concatenate(gone)
    some = _parts_of(_part(kept[:, 3].view(_U), parts), parts)
    pack = []
    for _, i in some:
        x = kept[i]
        blob = b"\n".join([texts[k] for k in i.tolist()])
        pack.append(np.array([len(i)], np.int64).tobytes() + ids[x[:, 0]].tobytes() + th[x[:, 0]].tobytes() + x[:, 3].tobytes() + x[:, 1].astype(np.int32).tobytes() + blob)
    rows = [(p, bucket, False, x) for (p, _), x in zip(some, pack, strict=True)]
    if len(gone):
        rows.append((bucket % parts, bucket, True, _marks(ids[gone[:, 0]], th[gone[:, 0]], gone[:, 1], gone[:, 1] + gone[:, 2] - window)))
    cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.table([pa.array(c, t) for c, t in zip(cols, none.schema.types, strict=True)], names=none.schema.names)


def _marks(ids, th, first, last) -> bytes:
    """Runs of marked windows: ids, hashes, and their first and last starts."""
    return np.stack([ids, th, np.asarray(first, np.int64), np.asarray(last, np.int64)]).tobytes()


def _met(table: pa.Table, window: int) -> pa.Table:
    """Marks, by bucket, of a part's windows whose sequence was met at an earlier place."""
    ids, th, route, start, texts, origin = [], [], [], [], [], []
    out: dict[int, list[bytes]] = {}
    for bucket, marks, raw in zip(table.column("bucket").to_pylist(), table.column("marks").to_pylist(), table.column("pack").to_pylist(), strict=True):
        if marks:
            out.setdefault(bucket, []).append(raw)
            continue
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        ids.append(np.frombuffer(raw, np.int64, n, 8))
        th.append(np.frombuffer(raw, np.int64, n, 8 + 8 * n))
        route.append(np.frombuffer(raw, np.int64, n, 8 + 16 * n))
        start.append(np.frombuffer(raw, np.int32, n, 8 + 24 * n).astype(np.int64))
        texts += raw[8 + 28 * n :].split(b"\n")
        origin.append(np.full(n, bucket))
    if ids:
        ids, th, route, start, origin = (np.concatenate(x) for x in (ids, th, route, start, origin))
        order = np.lexsort((start, th, ids, route))
        repeated: list[tuple[int, int, int]] = []  # piece, first and last window
        lo = 0
        while lo < len(order):
            hi, size = lo, 0
            first: dict[bytes, int] = {}
            # whole routes until the shard is full; the pieces of one route may be more
            while hi < len(order) and (size < SHARD_WORDS or route[order[hi]] == route[order[hi - 1]]):
                k = int(order[hi])
                x = texts[k]
                if x in first:
                    repeated.append((k, 0, -1))
                else:
                    first[x] = k
                    size += x.count(b" ") + 1
                hi += 1
            _stream(first, window, repeated)
            lo = hi
        if repeated:
            k, a, b = np.array(repeated, np.int64).T
            whole = b < 0
            b[whole] = [texts[i].count(b" ") + 1 - window for i in k[whole].tolist()]
            for bucket in np.unique(origin[k]).tolist():
                i = np.flatnonzero(origin[k] == bucket)
                out.setdefault(bucket, []).append(_marks(ids[k[i]], th[k[i]], start[k[i]] + a[i], start[k[i]] + b[i]))
    return pa.table({"bucket": pa.array(list(out), pa.int32()), "pack": pa.array([_together(x) for x in out.values()], pa.binary())})


def _together(packs: list[bytes]) -> bytes:
    return packs[0] if len(packs) == 1 else np.concatenate([np.frombuffer(x, np.int64).reshape(4, -1) for x in packs], 1).tobytes()


def _stream(pieces: dict[bytes, int], window: int, repeated: list[tuple[int, int, int]]) -> None:
    """Builds the automaton of a shard's pieces (in order) and streams each of them through it; adds runs of repeated windows."""
    sam, vocab = SuffixAutomaton(), {}
    spelled, place = [], 0
    for x in pieces:
        s = [vocab.setdefault(w, len(vocab)) for w in x.split(b" ")]
        sam.add(s, range(place, place + len(s)))
        spelled.append((place, s))
        place += len(s)
    first = sam.first
    for k, (at, s) in zip(pieces.values(), spelled, strict=True):
        open_at = -1
        for i, state in enumerate(sam.windows(s, window)):
            if first[state] != at + i + window - 1:  # its words have ended at an earlier place
                if open_at < 0:
                    open_at = i
            elif open_at >= 0:
                repeated.append((k, open_at, i - 1))
                open_at = -1
        if open_at >= 0:
            repeated.append((k, open_at, len(s) - window))


def _covered(n: int, runs: np.ndarray, window: int) -> np.ndarray:
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, runs[0], 1)
    np.add.at(step, runs[1] + window, -1)
    return np.cumsum(step[:-1]) > 0


def _per_bucket(docs: DataFrame, window: int, id_col: str, text_col: str, keep: list[str], finish, schema: T.StructType) -> DataFrame:
    """finish(table, runs of each row or None) makes the result rows of a slice of documents."""
    buckets = table_parts(docs, text_col, BUCKET_BYTES)
    parts = buckets
    th = F.xxhash64(F.col(text_col))
    own = docs.select(*keep, F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("__id"), th.alias("__th"))
    dealt = own.withColumn("__bucket", F.pmod(F.xxhash64("__id", "__th"), F.lit(buckets)).cast("int")).repartition(max(1, -(-buckets // 4)), "__bucket")
    asked = dealt.groupBy("__bucket").applyInArrow(lambda t: _asked(t, text_col, window, parts), "part int, bucket int, pack binary")
    answers = asked.groupBy("part").applyInArrow(_answered, "bucket int, from int, bits binary")
    sent = dealt.groupBy("__bucket").cogroup(answers.groupBy("bucket")).applyInArrow(lambda d, a: _sent(d, a, text_col, window, parts), "part int, bucket int, marks boolean, pack binary")
    marks = sent.groupBy("part").applyInArrow(lambda t: _met(t, window), "bucket int, pack binary")

    def last(d: pa.Table, m: pa.Table) -> pa.Table:
        found = np.frombuffer(_together([b"", *m.column("pack").to_pylist()]), np.int64).reshape(4, -1)
        order = np.lexsort((found[2], found[1], found[0]))
        found = found[:, order]
        new = np.flatnonzero(np.concatenate([np.ones(min(1, len(order)), bool), (np.diff(found[0]) != 0) | (np.diff(found[1]) != 0)]))
        ends = np.append(new[1:], len(order))[: len(new)]  # none without marks
        at = {(a, b): found[2:, i:j] for a, b, i, j in zip(found[0, new].tolist(), found[1, new].tolist(), new.tolist(), ends.tolist(), strict=True)}
        out = [finish(s, [at.get(k) for k in zip(s.column("__id").to_pylist(), s.column("__th").to_pylist(), strict=True)]) for s in slices(d, text_col, SLICE)]
        return pa.Table.from_batches(out) if out else pa.table([pa.array([], x.type) for x in _arrow(schema)], names=schema.names)

    return dealt.groupBy("__bucket").cogroup(marks.groupBy("bucket")).applyInArrow(last, schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_sha256 (kept words joined by one space)."""
    schema = T.StructType([docs.schema[id_col], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])

    def finish(t, found):
        w = split_words(t.column(text_col), BLANKS, lower=False)
        total, gone, sha = [], [], []
        data, at = _joined(w)
        for i, runs in enumerate(found):
            a, b = int(w.first[i]), int(w.first[i + 1])
            kept, n = data[at[a] : max(at[a], at[b] - 1)], 0
            if runs is not None:
                cut = _covered(b - a, runs, window)
                n = int(cut.sum())
                kept = b" ".join([x for x, c in zip(kept.split(b" "), cut.tolist(), strict=True) if not c])
            total.append(b - a)
            gone.append(n)
            sha.append(hashlib.sha256(kept).hexdigest())
        return pa.RecordBatch.from_arrays([_whole(t.column(id_col)), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=schema.names)

    return _per_bucket(docs, window, id_col, text_col, [id_col, *([text_col] if text_col != id_col else [])], finish, schema)


def _whole(c: pa.ChunkedArray) -> pa.Array:
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    return pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c


def _cut_text(raw: bytes, words, i: int, base: int, cut: np.ndarray) -> bytes:
    """Text i without its cut runs of words, from their first to their last word."""
    lo, out, done = int(words.first[i]), [], 0
    step = np.diff(np.concatenate([[0], cut.view(np.int8), [0]]))
    for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True):
        out.append(raw[done : int(words.start[lo + a]) - base])
        done = int(words.end[lo + b - 1]) - base
    return b"".join([*out, raw[done:]])


def dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with repeated spans cut out; text without them is returned byte for byte. All columns are kept."""
    keep = docs.columns

    def finish(t, found):
        w = split_words(t.column(text_col), BLANKS, lower=False)
        texts, base = t.column(text_col).to_pylist(), 0
        for i, runs in enumerate(found):
            raw = (texts[i] or "").encode()
            if runs is not None:
                texts[i] = _cut_text(raw, w, i, base, _covered(int(w.first[i + 1] - w.first[i]), runs, window)).decode()
            base += len(raw) + 1
        cols = [pa.array(texts, t.schema.field(c).type) if c == text_col else _whole(t.column(c)) for c in keep]
        return pa.RecordBatch.from_arrays(cols, names=keep)

    return _per_bucket(docs, window, id_col, text_col, keep, finish, docs.schema)


def cut_reference(docs: DataFrame, reference: list[str], window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """Cuts spans of `window` words or more that occur in a reference; at most REFERENCE_BYTES of text a shard.

    Suffix automata of the reference's shards are broadcast and every document streams through each of them.
    """
    shards: list[list[str]] = [[]]
    held = 0
    for t in reference:
        if held and held + len(t.encode()) > REFERENCE_BYTES:
            shards.append([])
            held = 0
        shards[-1].append(t)
        held += len(t.encode())
    keep = docs.columns
    bag = docs.sparkSession.sparkContext.broadcast(shards)

    def run(batches):
        built = []
        for texts in bag.value:
            sam, vocab = SuffixAutomaton(), {}
            w = split_words(pa.array(texts, pa.large_string()), BLANKS, lower=False)
            for i in range(len(texts)):
                sam.add([vocab.setdefault(w.bytes_of(k), len(vocab)) for k in range(w.first[i], w.first[i + 1])])
            built.append((sam, vocab))
        for batch in batches:
            for t in slices(batch, text_col):
                w = split_words(t.column(text_col), BLANKS, lower=False)
                texts, base = t.column(text_col).to_pylist(), 0
                for i in range(t.num_rows):
                    raw = (texts[i] or "").encode()
                    a, b = int(w.first[i]), int(w.first[i + 1])
                    step = np.zeros(b - a + 1, np.int64)
                    for sam, vocab in built:
                        _, n = sam.match([vocab.get(w.bytes_of(k), -1) for k in range(a, b)])
                        for k, size in enumerate(n):
                            if size >= window:
                                step[k - size + 1] += 1
                                step[k + 1] -= 1
                    cut = np.cumsum(step[:-1]) > 0
                    if cut.any():
                        texts[i] = _cut_text(raw, w, i, base, cut).decode()
                    base += len(raw) + 1
                yield pa.RecordBatch.from_arrays([pa.array(texts, t.schema.field(c).type) if c == text_col else t.column(c) for c in keep], names=keep)

    return docs.mapInArrow(run, docs.schema)

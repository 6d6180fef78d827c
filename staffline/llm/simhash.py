"""SimHash near-duplicates with pigeonring filtering.

Fingerprints: texts lower-cased (A-Z), words [^\\x20\\x09-\\x0D]+, shingles of `words` words with repeats (fewer words: the
whole sequence), h = XXH64 of the space-joined shingle with seed 42; a bit is set if it is set in over half of the h.

Linking, for fingerprints that differ in `max_bits` = 4 bits at most. Equal fingerprints become one before anything
else. The 64 bits are a ring of 5 segments. With 4 differences over 5 segments the pigeonring principle gives a start
i whose chain keeps every prefix within its share of the budget: 0 differences in segment i, 1 at most in
segments i and i + 1 together, 2 in three, 3 in four. Chains of three are searched by keys: segment i as it is, and either
(no difference in segment i + 1) that segment and one of three parts of segment i + 2, or (one difference) one of two parts of segment i + 1 and
two of three parts of segment i + 2. So 45 keys of 28 to 30 bits find every linked pair. Pairs that share a key are
put to the chain test, then to the full Hamming test.

Keys are dealt out as packed arrays, 8 bytes a key, and grouped by their range; a task holds the keys of its range
only. A large group of one key is split again by parts of its other bits, so no group is ever compared pair by pair beyond
`BRUTE` members, and it emits a spanning forest of its links, not all pairs: components lose nothing.
Components are found by alternating large-star and small-star rounds over links of distinct fingerprints, each round
written to the shared folder.

Defined results: null and word-less texts have fingerprint zero and link as any other; repeated doc_ids are rows of their
own in one component (equal texts); null ids stay null and are never representatives unless all ids are null; extra columns
are kept by `keep_one`, which judges rows, not ids; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import forget, stored
from ._text import BLANKS, mix, slices, split_words

WORDS = 4
MAX_BITS = 4
BRUTE = 1500
SMALL = 12
LARGE, MAX_LARGE = 1000, 100_000  # fingerprints of a component; such components that are broadcast
PART_BYTES = 24 << 20
_SEG = (13, 13, 13, 13, 12)
_AT = (0, 13, 26, 39, 52)
_U = np.uint64


def _bits(lo: int, n: int) -> int:
    return ((1 << n) - 1) << lo


def _masks() -> list[int]:
    """The bits of each key: 9 for each of the 5 starts of the ring."""
    out = []
    for i in range(5):
        j, k = (i + 1) % 5, (i + 2) % 5
        own, second = _bits(_AT[i], _SEG[i]), _bits(_AT[j], _SEG[j])
        half = _SEG[j] // 2
        halves = [_bits(_AT[j], half), _bits(_AT[j] + half, _SEG[j] - half)]
        third = _SEG[k] // 3
        thirds = [_bits(_AT[k], third), _bits(_AT[k] + third, third), _bits(_AT[k] + 2 * third, _SEG[k] - 2 * third)]
        out += [own | second | x for x in thirds]
        out += [own | h | x | y for h in halves for x, y in combinations(thirds, 2)]
    return out


MASKS = np.array(_masks(), _U)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def chained(diff: np.ndarray) -> np.ndarray:
    """Pigeonring test: some start whose prefixes of one to five segments hold 0, 1, 2, 3, 4 differences at most."""
    per = np.stack([popcount(diff & _U(_bits(_AT[i], _SEG[i]))) for i in range(5)]).astype(np.int8)
    out = np.zeros(diff.shape, bool)
    for i in range(5):
        ok, total = np.ones(diff.shape, bool), np.zeros(diff.shape, np.int8)
        for n in range(5):
            total = total + per[(i + n) % 5]
            ok &= total <= (n + 1) * MAX_BITS // 5
        out |= ok
    return out


def fingerprints(col: pa.Array, size: int = WORDS) -> np.ndarray:
    w = split_words(col, BLANKS, lower=True)
    # the words of the whole slice, joined by single spaces: a shingle is a run of this buffer
    n = w.end - w.start
    at = np.concatenate([[0], np.cumsum(n + 1)])
    joined = np.full(int(at[-1]), 0x20, np.uint8)
    src = np.repeat(w.start - at[:-1], n) + (keep := np.flatnonzero(np.repeat(np.ones(len(n), bool), n + 1) & _not_last(n)))
    joined[keep] = w.buf[src]
    words = np.diff(w.first)
    shingles = np.where(words > 0, np.maximum(words - size + 1, 1), 0)
    doc = np.repeat(np.arange(w.n_docs), shingles)
    begin = np.repeat(w.first[:-1], shingles) + np.arange(len(doc)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    last = np.minimum(begin + size, w.first[1:][doc]) - 1
    raw, f = joined.tobytes(), xxhash.xxh64_intdigest
    h = np.fromiter((f(raw[a:b], 42) for a, b in zip(at[begin].tolist(), (at[last] + n[last]).tolist(), strict=True)), _U, len(doc))
    fp = np.zeros(w.n_docs, _U)
    lo = np.cumsum(shingles) - shingles
    some = np.flatnonzero(shingles)
    if len(some):
        for bit in range(64):  # one bit of all shingles at a time: no shingle ever becomes 64 numbers
            up = np.add.reduceat(((h >> _U(bit)) & _U(1)).astype(np.int32), lo[some])
            fp[some] |= (2 * up > shingles[some]).astype(_U) << _U(bit)
    return fp


def _not_last(n: np.ndarray) -> np.ndarray:
    """For runs of n + 1 places: all but the last of each."""
    out = np.ones(int((n + 1).sum()), bool)
    out[np.cumsum(n + 1) - 1] = False
    return out


def _union(parent: dict, a: int, b: int) -> bool:
    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    a, b = root(a), root(b)
    if a == b:
        return False
    parent[max(a, b)] = min(a, b)
    return True


def links(fps: np.ndarray, used: int, parent: dict) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints that agree on the bits of `used`."""
    if len(fps) <= BRUTE:
        out = []
        for k in range(len(fps) - 1):
            diff = fps[k] ^ fps[k + 1 :]
            near = np.flatnonzero(chained(diff))
            near = near[popcount(diff[near]) <= MAX_BITS]
            a = int(fps[k])
            out += [(a, b) for b in fps[k + 1 + near].tolist() if _union(parent, a, b)]
        return out
    free = [b for b in range(64) if not used >> b & 1]
    if len(free) <= MAX_BITS:  # all of them lie within the distance of one another
        a = int(fps[0])
        return [(a, b) for b in fps[1:].tolist() if _union(parent, a, b)]
    out = []
    for part in np.array_split(np.array(free), MAX_BITS + 1):  # two that link agree on one of five parts of the rest
        mask = int(sum(1 << int(b) for b in part))
        key = fps & _U(mask)
        order = np.argsort(key, kind="stable")
        edge = np.flatnonzero(np.diff(key[order])) + 1
        for g in np.split(fps[order], edge):
            if len(g) > 1:
                out += links(g, used | mask, parent)
    return out


def near_links(distinct: DataFrame, n: int) -> DataFrame:
    """distinct: one column fp (long) of different fingerprints, about n. Links (a, b) that connect all that are near."""
    parts = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * len(MASKS) * 8 // PART_BYTES))

    def deal(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(_U)
            everywhere: list[list[bytes]] = [[] for _ in range(parts)]
            for k, mask in enumerate(MASKS):
                part = (mix((fp & mask) + _U(k)) % _U(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                at = np.searchsorted(part[order], np.arange(parts + 1))
                own = fp[order]
                for p in np.flatnonzero(np.diff(at)):
                    everywhere[p].append(np.array([k, at[p + 1] - at[p]], _U).tobytes() + own[at[p] : at[p + 1]].tobytes())
            some = [p for p in range(parts) if everywhere[p]]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([b"".join(everywhere[p]) for p in some], pa.binary())], names=["part", "keys"])

    def meet(t: pa.Table) -> pa.Table:
        by: dict[int, list[np.ndarray]] = {}
        for raw in t.column("keys").to_pylist():
            x, i = np.frombuffer(raw, _U), 0
            while i < len(x):
                k, m = int(x[i]), int(x[i + 1])
                by.setdefault(k, []).append(x[i + 2 : i + 2 + m])
                i += 2 + m
        parent, out = {}, []
        for k, arrays in sorted(by.items()):
            fp = np.concatenate(arrays)
            key = fp & MASKS[k]
            order = np.argsort(key, kind="stable")
            key, fp = key[order], fp[order]
            lo = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            hi = np.append(lo[1:], len(key))
            size = hi - lo
            for m in np.unique(size[(size > 1) & (size <= SMALL)]).tolist():  # all groups of one size at once
                group = fp[lo[size == m][:, None] + np.arange(m)]
                for i, j in combinations(range(m), 2):
                    near = np.flatnonzero(chained(group[:, i] ^ group[:, j]))
                    near = near[popcount(group[near, i] ^ group[near, j]) <= MAX_BITS]
                    out += [(a, b) for a, b in zip(group[near, i].tolist(), group[near, j].tolist(), strict=True) if _union(parent, a, b)]
            for i in np.flatnonzero(size > SMALL):
                out += links(np.sort(fp[lo[i] : hi[i]]), int(MASKS[k]), parent)
        ab = np.array(out, _U).reshape(-1, 2).view(np.int64)
        return pa.table({"a": np.ascontiguousarray(ab[:, 0]), "b": np.ascontiguousarray(ab[:, 1])})

    dealt = distinct.mapInArrow(deal, "part int, keys binary")
    return dealt.groupBy("part").applyInArrow(meet, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of nodes with links; root is one node of the component. Large-star and small-star rounds."""
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        old, now = now, stored(small, "edges")
        forget(old)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")


def _grouped(docs: DataFrame, words: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, th, fp of each row), (fp, root, least of each fingerprint): root names its component, least its first row.

    Rows are ordered by (id, hash of the text), null ids last.
    """
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("th", T.LongType()), T.StructField("fp", T.LongType())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                yield pa.RecordBatch.from_arrays([part.column(id_col), part.column("__th"), pa.array(fingerprints(part.column(text_col), words).view(np.int64))], names=schema.names)

    prints = stored(docs.select(id_col, text_col, F.xxhash64(text_col).alias("__th")).mapInArrow(run, schema), "prints")
    distinct = prints.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("least"))
    n = distinct.count()
    linked = components(near_links(distinct.select("fp"), n))
    return prints, stored(distinct.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "placed")


def near_duplicates(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (the smallest id reachable)."""
    prints, placed = _grouped(docs, words, id_col, text_col)
    owner = placed.groupBy("root").agg(F.min("least").alias("own"), F.count(F.lit(1)).alias("n"))
    # roots of many fingerprints would meet all of them in one task: these few are sent to all tasks, up to a bound
    large = owner.filter(F.col("n") > LARGE).select("root", "own")
    if 0 < large.limit(MAX_LARGE + 1).count() <= MAX_LARGE:
        both = placed.join(F.broadcast(large), "root", "left")
        small = both.filter("own is null").drop("own").join(owner.filter(F.col("n") <= LARGE).select("root", "own"), "root")
        final = both.filter("own is not null").unionByName(small)
    else:
        final = placed.join(owner, "root")
    final = final.select("fp", F.col("own.id").alias("component_id"))
    return prints.join(final, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, the first by (id, hash of the text), null ids last; all columns.

    An id that occurs with texts of several components keeps a row in each. Of rows with equal id and text one stays.
    """
    prints, placed = _grouped(docs, words, id_col, text_col)
    own = placed.groupBy("root").agg(F.min("least").alias("own")).select(F.col("own.id").alias("__id"), F.col("own.th").alias("__th"))
    tagged = docs.withColumn("__h", F.xxhash64(text_col))
    kept = tagged.join(own, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__th")), "left_semi")
    if not prints.groupBy("id", "th").count().filter("count > 1").isEmpty():
        kept = kept.dropDuplicates([id_col, "__h"])
    return kept.select(*docs.columns)

"""Approximate nearest neighbours with a permutation index.

Equal vectors are one class, which keeps its `k` + 1 smallest ids: no answer needs more of them. Pivots are classes drawn in
seeded hash order (a bounded number, by the square root of the number of classes). Each class is represented by its
`PREFIX` nearest pivots in order and posted in the inverted files of its `POSTED` nearest ones. A query visits
the files of its own nearest pivots, ranks their postings by the footrule distance of the ordered prefixes (a pivot
outside a prefix stands at place `PREFIX`), and reranks by Euclidean distance in double precision all postings within a
footrule bound and the best `RERANK` of each block at least. The best of all files are merged and expanded to ids.

The number of files and the footrule bound are measured, so they grow with pivots and files: `SAMPLE` queries in seeded hash
order are answered exactly by a scan of all classes, and both are set such that the index finds the share `RECALL` of
those answers (each may lose half of the rest). At least `VISITED` files are visited.

A file is cut into blocks of about `BLOCK` postings, so a crowded pivot is many tasks; queries are copied to each block.
Only pivots and the length of each file (both bounded by MAX_PIVOTS) reach the driver. Queries that end with fewer
candidates than exist (tiny or odd files) are answered against all classes, in blocks.

Defined results: vectors that are null, empty, all zero, or hold null or non-finite components take no part, nor do those whose
length differs from that of most vectors (ties: the longer); rows without id take no part; repeated ids are candidates
of their own once per distinct vector; a query never finds rows of its own id; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import stored

K = 10
PREFIX = 12
POSTED = 2
VISITED = 24
SAMPLE = 200
RECALL = 0.99
RERANK = 400
BLOCK = 4096
MIN_PIVOTS, MAX_PIVOTS = 8, 4096
SEED = 5
_HIT = "query_id long, cls long, score double"


def usable(vec: Column) -> Column:
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(vec.isNotNull() & fine & F.exists(vec, lambda x: x != 0), F.lit(False))


def _matrix(col, dim: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.list_(pa.float64()))
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def orders(x: np.ndarray, pivots: np.ndarray, n: int) -> np.ndarray:
    """The n nearest pivots of each row, nearest first; ties to the smaller pivot."""
    d = (x**2).sum(1)[:, None] - 2 * (x @ pivots.T) + (pivots**2).sum(1)[None, :]
    return np.argsort(d, 1, kind="stable")[:, :n].astype(np.int16)


def footrule(query: np.ndarray, rows: np.ndarray, n_pivots: int) -> np.ndarray:
    """Footrule distance of one ordered prefix to those of many rows."""
    size = len(query)
    place = np.full(n_pivots, size, np.int16)
    place[query] = np.arange(size)
    at = place[rows]
    shared = at < size
    own = np.abs(at - np.arange(rows.shape[1], dtype=np.int16)[None, :]).sum(1, dtype=np.int32)
    # pivots of the query that a row lacks stand at place `size` in it
    lacking = size * (size - 1) // 2 - np.where(shared, at, 0).sum(1, dtype=np.int32)
    return own + (size - shared.sum(1)) * size - lacking


def distances(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.sqrt(((rows - x[None, :]) ** 2).sum(1))


def _best(ids: np.ndarray, cls: np.ndarray, d: np.ndarray, k: int):
    order = np.lexsort((cls, d))[:k]
    return np.full(len(order), ids), cls[order], d[order]


def needed(query: np.ndarray, near: np.ndarray, pivots: np.ndarray, prefix: int, posted: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of near: how many files its query must visit to meet it, and the footrule distance of the two."""
    m = len(pivots)
    q, o = orders(query[None, :], pivots, m)[0], orders(near, pivots, max(prefix, posted))
    place = np.empty(m, np.int64)
    place[q] = np.arange(m)
    return place[o[:, :posted]].min(1) + 1, footrule(q[:prefix], o[:, :prefix], m)


def _hits(parts) -> pa.Table:
    cat = lambda i, t: np.concatenate([np.zeros(0, t), *(p[i] for p in parts)]).astype(t)
    return pa.table({"query_id": cat(0, np.int64), "cls": cat(1, np.int64), "score": cat(2, np.float64)})


def search(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance) of the k nearest rows found for each query row."""
    spark = vectors.sparkSession
    rows = vectors.filter(F.col(id_col).isNotNull() & usable(F.col(vec_col))).select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"), is_query.alias("q"))
    out = lambda df: df.select(F.col("query_id"), F.col("rank").cast("int").alias("rank"), F.col("vec_id"), "score")
    common = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = int(common.dim)
    # -0.0 and 0.0 are one vector
    rows = rows.filter(F.size("v") == dim).withColumn("v", F.transform("v", lambda x: x + F.lit(0).cast(vectors.schema[vec_col].dataType.elementType)))
    # salted: one hot vector is pre-aggregated in many tasks. A query stays a row of its own.
    salted = rows.groupBy("v", F.pmod(F.xxhash64("id"), F.lit(64))).agg(F.slice(F.array_sort(F.collect_set("id")), 1, k + 1).alias("ids"))
    classes = stored(salted.groupBy("v").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids")).select(F.col("ids")[0].alias("cls"), "v", "ids"), "classes")
    if not classes.groupBy("cls").count().filter("count > 1").isEmpty():  # repeated ids with different vectors
        classes = stored(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    n = classes.count()
    m = int(min(max(MIN_PIVOTS, np.sqrt(n)), MAX_PIVOTS, n))
    h = F.xxhash64(F.lit(SEED), "v")
    near = min(1.0, (m + 8 * np.sqrt(m)) / max(1, n))  # a threshold first: no task sorts more than a little over m vectors
    picked = classes.filter(h <= F.lit(int(min(2**63 - 1, -(2**63) + near * 2**64)))).orderBy(h, "cls").limit(m).select("v").toArrow()
    pivots = _matrix(picked.column("v"), dim)
    bag = spark.sparkContext.broadcast(pivots)
    prefix, posted = min(PREFIX, m), min(POSTED, m)
    asked = rows.filter("q").select(F.col("id").alias("key"), "v")
    visited, bound = _measured(asked, classes, pivots, dim, k, prefix, posted)

    def perm(n_files: int):
        def f(batches):
            for b in batches:
                o = orders(_matrix(b.column("v"), dim), bag.value, max(prefix, n_files))
                rep = np.repeat(np.arange(b.num_rows), n_files)
                raw = [r.tobytes() for r in np.ascontiguousarray(o[:, :prefix])]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rep)), b.column("v").take(pa.array(rep)), pa.array(raw, pa.binary()).take(pa.array(rep)), pa.array(o[:, :n_files].ravel().astype(np.int32))], names=["key", "v", "perm", "pivot"])

        return f

    vtype = vectors.schema[vec_col].dataType.simpleString()
    shape = f"key long, v {vtype}, perm binary, pivot int"
    posts = classes.select(F.col("cls").alias("key"), "v").mapInArrow(perm(posted), shape)
    sizes = {r.pivot: r["count"] for r in posts.select("pivot").groupBy("pivot").count().collect()}
    blocks = F.lit([max(1, -(-sizes.get(p, 0) // BLOCK)) for p in range(m)])
    of = blocks[F.col("pivot")]
    filed = posts.select("pivot", F.pmod(F.xxhash64("key"), of).cast("int").alias("block"), F.lit(False).alias("q"), "key", "v", "perm")
    calls = asked.mapInArrow(perm(visited), shape).select("pivot", F.explode(F.sequence(F.lit(0), of - 1)).alias("block"), F.lit(True).alias("q"), "key", "v", "perm")

    def look(t: pa.Table) -> pa.Table:
        q = np.asarray(t.column("q").to_numpy(zero_copy_only=False), bool)
        key, v = t.column("key").to_numpy(), _matrix(t.column("v"), dim)
        o = np.frombuffer(b"".join(t.column("perm").to_pylist()), np.int16).reshape(len(q), prefix)
        at = np.flatnonzero(~q)
        at = at[np.argsort(key[at])]
        ids, x, p = key[at], v[at], o[at]
        found = []
        for i in np.flatnonzero(q) if len(at) else ():
            f = footrule(o[i], p, m)
            best = np.flatnonzero(f <= max(bound, np.partition(f, RERANK)[RERANK])) if len(f) > RERANK else np.arange(len(f))
            found.append(_best(key[i], ids[best], distances(v[i], x[best]), k + 1))
        return _hits(found)

    hits = stored(filed.unionByName(calls).groupBy("pivot", "block").applyInArrow(look, _HIT), "hits")
    pairs = _expand(hits, classes, k)
    # queries that found fewer than there are: against all classes, in blocks
    total = rows.select("id").distinct().limit(k + 1).count() - 1
    short = asked.select("key").distinct().join(pairs.groupBy("query_id").count().filter(F.col("count") >= min(k, total)), F.col("key") == F.col("query_id"), "left_anti")
    short = stored(asked.join(short, "key", "left_semi"), "short")
    if total > 0 and not short.isEmpty():
        more = short
        parts = [pairs]
        blocks = -(-more.count() // 1024)
        for b in range(blocks):
            own = more.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).select("key", "v").toArrow()
            parts.append(_expand(_scan(classes, own.column("key").to_numpy(), _matrix(own.column("v"), dim), k), classes, k))
        pairs = pairs.join(short.select(F.col("key").alias("query_id")).distinct(), "query_id", "left_anti")
        for p in parts[1:]:
            pairs = pairs.unionByName(p)
    return out(pairs)


def _scan(classes: DataFrame, keys: np.ndarray, x: np.ndarray, k: int) -> DataFrame:
    """Hits that hold the k + 1 nearest of all classes for each of a bounded number of queries."""
    qs = classes.sparkSession.sparkContext.broadcast((keys, x))

    def scan(batches):
        for t in batches:
            rows, cls = _matrix(t.column("v"), x.shape[1]), t.column("cls").to_numpy()
            yield from _hits([_best(i, cls, distances(v, rows), k + 1) for i, v in zip(*qs.value, strict=True)]).to_batches()

    return stored(classes.select("cls", "v").mapInArrow(scan, _HIT), "scan")


def _measured(asked: DataFrame, classes: DataFrame, pivots: np.ndarray, dim: int, k: int, prefix: int, posted: int) -> tuple[int, int]:
    """The number of files to visit and the footrule bound that find RECALL of the sample's exact answers."""
    m = len(pivots)
    if m <= VISITED and classes.count() <= RERANK:
        return m, 0
    some = asked.orderBy(F.xxhash64(F.lit(SEED), "key", "v"), "key").limit(SAMPLE).toArrow()
    if not some.num_rows:
        return min(VISITED, m), 0
    x = _matrix(some.column("v"), dim)
    order = Window.partitionBy("query_id").orderBy("score", "cls")
    near = _scan(classes, np.arange(len(x)), x, k).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    near = near.filter("score > 0").join(classes.select("cls", "v"), "cls").select("query_id", "v").toArrow()
    of, y = near.column("query_id").to_numpy(), _matrix(near.column("v"), dim)
    both = [needed(x[i], y[of == i], pivots, prefix, posted) for i in np.unique(of)]
    if not both:
        return min(VISITED, m), 0
    share = (1 + RECALL) / 2
    files, bound = (int(np.quantile(np.concatenate(z), share, method="higher")) for z in zip(*both, strict=True))
    return min(max(VISITED, files), m), bound


def _expand(hits: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """The k nearest ids of each query from its hits on classes; ties to the smaller id."""
    near = Window.partitionBy("query_id").orderBy("score", "cls")
    best = hits.groupBy("query_id", "cls").agg(F.min("score").alias("score")).withColumn("n", F.row_number().over(near)).filter(F.col("n") <= k + 1)
    ids = best.join(classes.select("cls", "ids"), "cls").select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id")
    ids = ids.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return ids.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).filter(F.col("rank") <= k)

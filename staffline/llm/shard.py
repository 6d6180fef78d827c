"""Sharding by a two-pass external shuffle, in DataFrame functions only; the law is `rows`.

Pass 1 scatters records into buckets by a seeded hash of the document id and of the record's place in the input, so
repeated ids and rows spread as well, and writes the tagged records to the shared folder; buckets are made small enough for a task's memory from the measured bytes. Pass 2
sends bucket b to partition b, sorts its records by their place in the input and Fisher-Yates shuffles them with Spark's shuffle(),
whose generator has the seed plus the partition's number: a seed of its own for each bucket. Buckets in order, each in its shuffled
order, give every record a global position p; with n records and s shards it goes to shard floor(p * s / n), whose
slots count from 0 without gaps, and the sizes of two shards differ by one at most. A shard is a run of buckets, so it
can be written as they come.

Only per-bucket counts, never records, are gathered: one row per bucket. They are broadcast up to `MAX_BROADCAST`
buckets and joined by a shuffle beyond.

Defined results: null texts have size 16 and no checksum; empty tables give no rows; repeated rows are records of
their own; ids may be null; extra columns of any type are kept. The same input files, layout and seed give the same shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import stored

SHARDS = 40
SEED = 20240229
BUCKET_BYTES = 16 << 20
MIN_BUCKETS = 8  # for each shard
MAX_BROADCAST = 1_000_000


def shard(df: DataFrame, n_shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All columns plus shard int and slot long (columns of these names are replaced)."""
    keep = [c for c in df.columns if c not in ("shard", "slot")]
    n, size = df.agg(F.count(F.lit(1)), F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + F.lit(16))).first()
    buckets = max(MIN_BUCKETS * n_shards, -(-int(size or 0) // bucket_bytes))
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.col("__at")), F.lit(buckets)).cast("int")
    # scattered once and written: both passes below see the same buckets whatever is lost or planned anew
    tagged = stored(df.select(*keep, F.monotonically_increasing_id().alias("__at")).withColumn("__bucket", bucket), "scattered")
    counts = tagged.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("__bucket").alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    packed = tagged.repartitionById(buckets, F.col("__bucket")).groupBy("__bucket").agg(F.collect_list(F.struct("__at", F.struct(*keep).alias("row"))).alias("__rows"))
    # sorted first: the order in which a bucket's blocks were fetched has no say. Only the place is compared: rows may hold maps
    in_order = F.array_sort("__rows", lambda a, b: F.when(a["__at"] < b["__at"], -1).when(a["__at"] > b["__at"], 1).otherwise(0))
    mixed = packed.select("__bucket", F.shuffle(F.transform(in_order, lambda x: x["row"]), F.lit(seed)).alias("__rows"))
    offsets = F.broadcast(offsets) if buckets <= MAX_BROADCAST else offsets
    placed = mixed.join(offsets, F.col("__bucket") == F.col("__b")).select("__offset", F.posexplode("__rows").alias("__pos", "__row"))
    at = placed.select((F.col("__offset") + F.col("__pos")).alias("__p"), "__row").withColumn("shard", F.expr(f"cast(__p * {n_shards}L div {max(1, n)}L as int)"))
    first = F.expr(f"(shard * {n}L + {n_shards - 1}L) div {n_shards}L")  # the position of the shard's slot 0
    return at.select(*(F.col("__row")[c].alias(c) for c in keep), "shard", (F.col("__p") - first).alias("slot"))


def write_shards(sharded: DataFrame, path: str, file_bytes: int = 256 << 20, text_col: str = "text") -> None:
    """One folder per shard; a shard is as many files as its size needs, each a run of slots in order."""
    size = int(sharded.agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + F.lit(16))).first()[0] or 0)
    runs = sharded.repartitionByRange(max(1, -(-size // file_bytes)), "shard", "slot").sortWithinPartitions("shard", "slot")
    runs.write.partitionBy("shard").parquet(path)

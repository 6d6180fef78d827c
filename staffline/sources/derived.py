"""Leveling tables derived from the star schema: setups, lines, benchmarks and a network."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def point(n) -> F.Column:
    return F.concat(F.lit("N"), F.lpad(n.cast("string"), 2, "0"), F.lit("B"))


def setups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_id, setup_number, backsight, foresight, dist_back, dist_fore, height_diff; one row per station setup."""
    li = read(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity")
    bs = F.col("l_discount") * 5 + F.lit(1.2)
    return li.select(
        F.col("l_orderkey").alias("line_id"),
        F.row_number().over(order).alias("setup_number"),
        bs.cast("decimal(12,5)").alias("backsight"),
        (bs - (F.col("l_discount") - F.col("l_tax") - F.lit(0.01)) * 0.1).cast("decimal(12,5)").alias("foresight"),
        (F.col("l_quantity") + 5).cast("decimal(12,3)").alias("dist_back"),
        (F.col("l_quantity") + 5 + (F.col("l_partkey") % 7 - 3) * 0.5).cast("decimal(12,3)").alias("dist_fore"),
    ).withColumn("height_diff", F.col("backsight") - F.col("foresight"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_id, start_point, end_point, method, is_used, line_date."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    end = (F.col("o_orderkey") * 7 + 3) % 25
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("line_id"),
        point(F.col("c_nationkey")).alias("start_point"),
        F.when(F.col("o_orderkey") % 11 == 0, end.cast("string")).otherwise(point(end)).alias("end_point"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "BFFB").when(F.col("o_orderpriority") == "5-LOW", "FB").otherwise("BF").alias("method"),
        (F.col("o_orderstatus") != "P").alias("is_used"),
        F.col("o_orderdate").alias("line_date"),
    )


def benchmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    return n.select(point(F.col("n_nationkey")).alias("point_id"), (F.lit(100) + F.col("n_nationkey") * F.lit(0.002)).cast("decimal(12,3)").alias("height"))


def network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obs_seq, region, from_pt, to_pt, height_diff, distance: six orders in a row make a ring of five points with a chord.

    Point p of ring r is 5 r + p; the chord joins points 0 and 2. Rings grow in number with the orders.
    """
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    ring, seq = F.floor(F.col("k") / 6), F.col("k") % 6
    a, b = F.when(seq == 5, 0).otherwise(seq), F.when(seq == 5, 2).otherwise((seq + 1) % 5)
    error = ((F.col("k") * 13 + F.col("c") * 7) % 11 - 5) * F.lit("0.001").cast("decimal(4,3)")
    return o.select(
        F.col("k").alias("obs_seq"), ring.alias("region"), (ring * 5 + a).alias("from_pt"), (ring * 5 + b).alias("to_pt"),
        ((b - a) * F.lit("0.25").cast("decimal(3,2)") + error).cast("decimal(12,5)").alias("height_diff"),
        (F.lit(500) + (F.col("k") * 31 + F.col("c") * 17) % 40 * 50).cast("decimal(12,3)").alias("distance"),
    )


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """setups with path, method, from_point and to_point: the line's ends, in between the setup's number."""
    s = setups(spark, sf_dir).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("line_id")))
    j = s.join(lines(spark, sf_dir).select("line_id", "start_point", "end_point", "method"), "line_id")
    k = F.col("setup_number")
    return j.select(
        "line_id", F.concat(F.lit("/field/L"), F.col("line_id").cast("string"), F.lit(".DAT")).alias("path"), "method", "setup_number", "backsight", "foresight", "dist_back", "dist_fore", "height_diff",
        F.when(k == 1, F.col("start_point")).otherwise((k - 1).cast("string")).alias("from_point"), F.when(k == F.col("n"), F.col("end_point")).otherwise(k.cast("string")).alias("to_point"),
    )

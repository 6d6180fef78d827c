"""Use of points by lines: search, exclusion, choice of benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import regulations as R


def point_usage(lines: DataFrame, stations: DataFrame) -> DataFrame:
    """point, n_lines: distinct lines that have the point as an end or at a setup."""
    ends = lines.select("line_id", F.explode(F.array("start_point", "end_point")).alias("point"))
    at = stations.select("line_id", F.explode(F.array("from_point", "to_point")).alias("point"))
    return ends.unionByName(at).filter("point is not null").distinct().groupBy("point").agg(F.count(F.lit(1)).alias("n_lines"))


def search(points: DataFrame, part: str) -> DataFrame:
    return points.filter(F.lower("point").contains(part.lower()))


def set_used(lines: DataFrame, chosen: DataFrame, used: bool) -> DataFrame:
    """lines with is_used set for those with an end among chosen (point)."""
    hit = lines.select("line_id", F.explode(F.array("start_point", "end_point")).alias("point")).join(chosen.select("point").distinct(), "point", "left_semi").select("line_id").distinct().withColumn("__hit", F.lit(True))
    return lines.join(hit, "line_id", "left").withColumn("is_used", F.when(F.col("__hit"), F.lit(used)).otherwise(F.col("is_used"))).drop("__hit")


def auto_benchmarks(points: DataFrame, names: tuple[str, ...] = ()) -> DataFrame:
    """Points with a letter, or with one of the given name parts."""
    if not names:
        return points.filter(R.is_benchmark(F.col("point")))
    ok = F.lit(False)
    for n in names:
        ok = ok | F.upper("point").contains(n.upper())
    return points.filter(ok)

"""Chains of lines that share ends, and the lines merged from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.checkpoints import cut


def merge_candidates(lines: DataFrame, max_lines: int | None = None) -> DataFrame:
    """Chains of two or more used lines: chain_id, line_ids, reversed, common_nodes.

    A walk starts at each line and goes on from its end with the first line (least line_id) there that it hasn't used,
    turned round if need be. All walks take a step at a time by one equi-join and one aggregation, checkpointed; of walks over
    the same set of lines the one from the least line stays. max_lines: stop (None: only at the walks' ends).
    """
    ln = lines.filter("is_used and start_point is not null and end_point is not null").select("line_id", "start_point", "end_point")
    there = ln.select(F.col("start_point").alias("point"), F.col("line_id").alias("next_id"), F.col("end_point").alias("other"), F.lit(False).alias("turned"))
    back = ln.filter("start_point <> end_point").select(F.col("end_point").alias("point"), F.col("line_id").alias("next_id"), F.col("start_point").alias("other"), F.lit(True).alias("turned"))
    ends = cut(there.unionByName(back))
    walk = ln.select(F.col("line_id").alias("chain_id"), F.col("end_point").alias("at"), F.array("line_id").alias("line_ids"), F.array(F.lit(False)).alias("reversed"), F.array().cast("array<string>").alias("common_nodes"))
    done, steps = [], 1
    while max_lines is None or steps < max_lines:
        ahead = walk.select("chain_id", "at", "line_ids").join(ends, F.col("at") == F.col("point")).filter(~F.array_contains("line_ids", F.col("next_id")))
        ahead = ahead.groupBy("chain_id").agg(F.min(F.struct("next_id", "other", "turned")).alias("n"))
        step = cut(walk.join(ahead, "chain_id", "left"))
        done.append(step.filter("n is null").drop("n"))
        walk = step.filter("n is not null").select(
            "chain_id", F.col("n.other").alias("at"), F.array_append("line_ids", F.col("n.next_id")).alias("line_ids"), F.array_append("reversed", F.col("n.turned")).alias("reversed"),
            F.array_append("common_nodes", F.col("at").cast("string")).alias("common_nodes"),
        )
        steps += 1
        if walk.isEmpty():
            break
    else:
        done.append(walk)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    first = F.min_by(F.struct("chain_id", "line_ids", "reversed", "common_nodes"), "chain_id").alias("c")
    return out.filter(F.size("line_ids") > 1).groupBy(F.array_sort("line_ids").alias("set")).agg(first).select("c.*")


def merge_lines(chains: DataFrame, lines: DataFrame, setups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, setups) merged per chain. Setups of turned lines run in the other order with sights swapped and differences negated."""
    parts = chains.select("chain_id", F.posexplode(F.arrays_zip("line_ids", "reversed")).alias("pos", "x")).select("chain_id", "pos", F.col("x.line_ids").alias("line_id"), F.col("x.reversed").alias("turned"))
    s = parts.join(setups, "line_id")
    swap = lambda a, b: F.when(F.col("turned"), F.col(b)).otherwise(F.col(a)).alias(a)
    order = Window.partitionBy("chain_id").orderBy("pos", F.when(F.col("turned"), -F.col("setup_number")).otherwise(F.col("setup_number")))
    dh = F.when(F.col("turned"), -F.col("height_diff")).otherwise(F.col("height_diff"))
    merged = s.select(
        "chain_id", F.row_number().over(order).alias("setup_number"), swap("backsight", "foresight"), swap("foresight", "backsight"), swap("dist_back", "dist_fore"), swap("dist_fore", "dist_back"), dh.alias("height_diff"),
        F.sum(dh).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative_height"),
    )
    end = lambda c, at: parts.filter(at).join(lines.select("line_id", "start_point", "end_point"), "line_id").select("chain_id", F.when(F.col("turned"), F.col("end_point")).otherwise(F.col("start_point")).alias(f"{c}_point"))
    last = parts.groupBy("chain_id").agg(F.max_by(F.struct("line_id", "turned"), "pos").alias("x"), F.count(F.lit(1)).alias("n_lines")).select("chain_id", "n_lines", "x.*")
    tail = last.join(lines.select("line_id", "start_point", "end_point"), "line_id").select("chain_id", "n_lines", F.when(F.col("turned"), F.col("start_point")).otherwise(F.col("end_point")).alias("end_point"))
    totals = merged.groupBy("chain_id").agg(F.count(F.lit(1)).alias("n_setups"), (F.sum(F.col("dist_back") + F.col("dist_fore")).cast("double") / 2).alias("distance"), F.sum("height_diff").cast("double").alias("height_diff"))
    head = end("start", F.col("pos") == 0)
    out = head.join(tail, "chain_id").join(totals, "chain_id", "left")
    return out.withColumn("filename", F.concat(F.lit("MERGED_"), F.col("start_point").cast("string"), F.lit("-"), F.col("end_point").cast("string"))).withColumn("status", F.lit("valid")), merged


def apply_merge(lines: DataFrame, chains: DataFrame) -> DataFrame:
    """lines with the chains' members out of use and under status `excluded_from_merge`."""
    used = chains.select(F.explode("line_ids").alias("line_id")).distinct().withColumn("__merged", F.lit(True))
    j = lines.join(used, "line_id", "left")
    old = F.col("status") if "status" in lines.columns else F.lit("valid")
    return j.withColumn("status", F.when(F.col("__merged"), "excluded_from_merge").otherwise(old)).withColumn("is_used", F.col("is_used") & F.col("__merged").isNull()).drop("__merged")


def merge_summary(chains: DataFrame, lines: DataFrame, totals: DataFrame) -> DataFrame:
    """Per chain: num_segments, start_point, end_point, total_distance, total_setups, segments (array in order), common_nodes."""
    parts = chains.select("chain_id", F.posexplode(F.arrays_zip("line_ids", "reversed")).alias("pos", "x")).select("chain_id", "pos", F.col("x.line_ids").alias("line_id"), F.col("x.reversed").alias("needs_reversal"))
    name = F.col("filename") if "filename" in lines.columns else F.concat(F.lit("L"), F.col("line_id").cast("string"))
    j = parts.join(lines.withColumn("__name", name).select("line_id", "__name", "start_point", "end_point"), "line_id").join(totals, "line_id", "left")
    seg = F.struct("pos", F.col("__name").alias("filename"), F.concat("start_point", F.lit("→"), "end_point").alias("direction"), "needs_reversal", F.coalesce("distance", F.lit(0.0)).alias("distance"), F.coalesce("n_setups", F.lit(0)).alias("setups"))
    first = F.when(F.col("needs_reversal"), F.col("end_point")).otherwise(F.col("start_point"))
    last = F.when(F.col("needs_reversal"), F.col("start_point")).otherwise(F.col("end_point"))
    g = j.groupBy("chain_id").agg(
        F.count(F.lit(1)).alias("num_segments"), F.min_by(first, "pos").alias("start_point"), F.max_by(last, "pos").alias("end_point"), F.sum(F.coalesce("distance", F.lit(0.0))).alias("total_distance"),
        F.sum(F.coalesce("n_setups", F.lit(0))).alias("total_setups"), F.array_sort(F.collect_list(seg)).alias("segments"),
    )
    return g.join(chains.select("chain_id", "common_nodes"), "chain_id")


def find_mergeable_lines(lines: DataFrame, totals: DataFrame) -> DataFrame:
    """merge_summary of all candidates."""
    return merge_summary(merge_candidates(lines), lines, totals)


def merge_selected_lines(lines: DataFrame, setups: DataFrame, chosen: list[int]) -> tuple[DataFrame, DataFrame]:
    """(lines, setups) merged from the longest chain of the chosen line ids (a bounded choice); raises if they make none."""
    own = lines.filter(F.col("line_id").isin(*chosen)).withColumn("is_used", F.lit(True))
    best = cut(merge_candidates(own).orderBy(F.desc(F.size("line_ids")), "chain_id").limit(1))
    if best.isEmpty():
        raise ValueError("the chosen lines don't make a chain")
    return merge_lines(best, lines, setups)

"""Line-level operators: totals, misclosure, corrections, runs, double runs. DataFrame in, DataFrame out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import regulations as R
from ..functions.settings import EngineConfig

def _line():
    return Window.partitionBy("line_id")


def _along():
    return _line().orderBy("setup_number").rowsBetween(Window.unboundedPreceding, 0)


def line_totals(setups: DataFrame) -> DataFrame:
    """line_id, n_setups, distance (m), height_diff (m): one partial aggregation, one shuffle on line_id."""
    return setups.groupBy("line_id").agg(
        F.count(F.lit(1)).alias("n_setups"),
        (F.sum(F.col("dist_back") + F.col("dist_fore")).cast("double") / 2).alias("distance"),
        F.sum("height_diff").cast("double").alias("height_diff"),
    )


def with_heights(lines: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Lines with start_height and end_height. The join's strategy is left to measured sizes (auto-broadcast threshold)."""
    h = lambda end: benchmarks.select(F.col("point_id").alias(f"{end}_point"), F.col("height").cast("double").alias(f"{end}_height"))
    return lines.join(h("start"), "start_point", "left").join(h("end"), "end_point", "left")


def misclosure(lines: DataFrame, totals: DataFrame, benchmarks: DataFrame, cls: int = 3) -> DataFrame:
    """Per line with both heights known: misclosure_mm, tolerance_mm, within, achieved_class."""
    known = with_heights(lines, benchmarks).filter("start_height is not null and end_height is not null").join(totals, "line_id")
    mm = F.round((F.col("height_diff") - (F.col("end_height") - F.col("start_height"))) * 1000, 6)
    out = known.withColumn("misclosure_mm", mm).withColumn("tolerance_mm", R.tolerance_new(F.col("distance"), F.lit(cls)))
    return out.withColumn("within", F.abs("misclosure_mm") <= F.col("tolerance_mm")).withColumn("achieved_class", R.achieved_class(F.col("misclosure_mm"), F.col("distance")))


def distribute(setups: DataFrame, closures: DataFrame, method: str = "proportional") -> DataFrame:
    """setups with a correction (m) each; closures: line_id, misclosure (m). Shares by distance, or equal ones."""
    if method not in ("proportional", "equal"):
        raise ValueError(f"unknown distribution {method!r}")
    d = ((F.col("dist_back") + F.col("dist_fore")) / 2).cast("double")
    rows = setups.join(closures.select("line_id", "misclosure"), "line_id")
    total = F.sum(d).over(_line())
    share = F.lit(1.0) / F.count(F.lit(1)).over(_line()) if method == "equal" else F.when(total == 0, F.lit(0.0)).otherwise(d / total)
    return rows.withColumn("correction", -F.col("misclosure") * share).drop("misclosure")


def apply_corrections(corrected: DataFrame) -> DataFrame:
    """adjusted_dh and the running cumulative_height of each setup."""
    adj = corrected.withColumn("adjusted_dh", F.col("height_diff").cast("double") + F.col("correction"))
    return adj.withColumn("cumulative_height", F.sum("adjusted_dh").over(_along()))


def line_adjust(setups: DataFrame, lines: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Heights after each setup of lines between known benchmarks; the last one meets the end's height."""
    known = misclosure(lines, line_totals(setups), benchmarks).select("line_id", "start_height", (F.col("misclosure_mm") / 1000).alias("misclosure"))
    out = apply_corrections(distribute(setups, known))
    return out.join(known.select("line_id", "start_height"), "line_id").withColumn("height", F.col("start_height") + F.col("cumulative_height"))


def adjust_single_line(setups: DataFrame, line: DataFrame, start_height: float, end_height: float) -> DataFrame:
    """line_adjust of lines whose two ends have the given heights."""
    ends = line.select(F.explode(F.array(F.struct(F.col("start_point").alias("point_id"), F.lit(float(start_height)).alias("height")), F.struct(F.col("end_point").alias("point_id"), F.lit(float(end_height)).alias("height")))).alias("x")).select("x.*").distinct()
    return line_adjust(setups, line, ends)


def line_info(lines: DataFrame, totals: DataFrame, benchmarks: DataFrame, cls: int = 3) -> DataFrame:
    """What an adjustment of each line between known benchmarks reports: computed, known and adjusted difference, misclosure,
    tolerance (legacy) and whether it's within; ends that aren't benchmarks of the table have status `endpoint_mismatch`."""
    j = with_heights(lines, benchmarks).join(totals, "line_id")
    known = F.col("end_height") - F.col("start_height")
    mm = F.round((F.col("height_diff") - known) * 1000, 6)
    tol = R.tolerance_legacy(F.col("distance"), F.lit(cls))
    return j.select("line_id", "start_point", "end_point", F.col("height_diff").alias("computed_dh"), known.alias("known_dh"), known.alias("adjusted_dh"), mm.alias("misclosure_mm"), tol.alias("tolerance_mm"), (F.abs(mm) <= tol).alias("within"), F.when(known.isNull(), "endpoint_mismatch").otherwise("ok").alias("status"))


def toggle_direction(lines: DataFrame, setups: DataFrame, compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """Lines run the other way: ends, sights and order swapped, height differences negated. compat: order and sights stay."""
    turned = lines.select(*(c for c in lines.columns if c not in ("start_point", "end_point", "method")), F.col("end_point").alias("start_point"), F.col("start_point").alias("end_point"), F.when(F.col("method") == "BF", "FB").when(F.col("method") == "FB", "BF").otherwise(F.col("method")).alias("method"))
    if compat:
        return turned, setups.withColumn("height_diff", -F.col("height_diff"))
    n = F.count(F.lit(1)).over(_line())
    back = setups.select("line_id", (n - F.col("setup_number") + 1).cast("int").alias("setup_number"), F.col("foresight").alias("backsight"), F.col("backsight").alias("foresight"), F.col("dist_fore").alias("dist_back"), F.col("dist_back").alias("dist_fore"), (-F.col("height_diff")).alias("height_diff"))
    return turned, back


def multiple_runs(lines: DataFrame, totals: DataFrame) -> DataFrame:
    """Per unordered pair of points: number of runs, mean height difference in the forward sense, spread in mm."""
    t = lines.join(totals, "line_id").filter("start_point <> end_point")
    fwd = F.col("start_point") < F.col("end_point")
    dh = F.when(fwd, F.col("height_diff")).otherwise(-F.col("height_diff"))
    return t.groupBy(F.least("start_point", "end_point").alias("from_point"), F.greatest("start_point", "end_point").alias("to_point")).agg(
        F.count(F.lit(1)).alias("num_runs"), F.avg(dh).alias("mean_dh"), ((F.max(dh) - F.min(dh)) * 1000).alias("spread_mm")
    )


def double_runs(lines: DataFrame, totals: DataFrame, cls: int = 3) -> DataFrame:
    """The k-th run of a pair of points one way with the k-th run the other way; misclosure, mean, tolerance, class.

    Equal to a greedy first match in line order, without comparing all pairs: one window and one equi-join.
    """
    ends = [F.least("start_point", "end_point").alias("a"), F.greatest("start_point", "end_point").alias("b")]
    t = lines.join(totals, "line_id").select("line_id", "distance", "height_diff", *ends, (F.col("start_point") < F.col("end_point")).alias("up"), (F.col("start_point") == F.col("end_point")).alias("own"))
    rn = t.withColumn("k", F.row_number().over(Window.partitionBy("a", "b", "up").orderBy("line_id")))
    # runs that start where they end pair the odd with the next even one
    rn = rn.withColumn("side", F.when(F.col("own"), F.col("k") % 2 == 1).otherwise(F.col("up"))).withColumn("k", F.when(F.col("own"), F.floor((F.col("k") + 1) / 2)).otherwise(F.col("k")))
    x = rn.filter("side").select("a", "b", "k", F.col("line_id").alias("l1"), F.col("distance").alias("d1"), F.col("height_diff").alias("h1"))
    y = rn.filter("not side").select("a", "b", "k", F.col("line_id").alias("l2"), F.col("distance").alias("d2"), F.col("height_diff").alias("h2"))
    p = x.join(y, ["a", "b", "k"])
    first = F.col("l1") < F.col("l2")
    mm, dist = F.round((F.col("h1") + F.col("h2")) * 1000, 6), F.col("d1") + F.col("d2")
    return p.select(
        F.least("l1", "l2").alias("forward_id"), F.greatest("l1", "l2").alias("return_id"), mm.alias("misclosure_mm"),
        (F.when(first, F.col("h1") - F.col("h2")).otherwise(F.col("h2") - F.col("h1")) / 2).alias("mean_dh"), dist.alias("distance"),
        R.tolerance_new(dist, F.lit(cls)).alias("tolerance_mm"), R.achieved_class(mm, dist).alias("achieved_class"),
    ).withColumn("within", F.abs("misclosure_mm") <= F.col("tolerance_mm"))


def _naming_ok(filename: Column, start: Column, end: Column) -> Column:
    """False if the file's name gives the ends the other way round: for a separator, its first part holds the end and its last the start.

    Lower case; the last part ends at its first dot. Empty ends never match.
    """
    name, a, b = F.lower(filename), F.lower(start), F.lower(end)
    bad = F.lit(False)
    for sep in ("-", "_", " to "):
        parts = F.split(name, sep)
        first, last = F.trim(parts[0]), F.substring_index(F.trim(F.element_at(parts, -1)), ".", 1)
        bad = bad | ((F.size(parts) > 1) & (a != "") & (b != "") & last.contains(a) & first.contains(b))
    return ~F.coalesce(bad, F.lit(False))


def validate(lines: DataFrame, setups: DataFrame, cls: int | None = None, config: EngineConfig | None = None, benchmarks: DataFrame | None = None, compat: bool = False) -> DataFrame:
    """Rule outcomes per line: endpoint, naming, completeness, length, sights, method, balance, tolerance; `valid` if no rule fails;
    errors and warnings (arrays of texts, in that order).

    A line under a class that needs BFFB but run as BF is judged for balance and tolerance under class 4. Naming is judged where
    lines have a filename, tolerance where benchmarks (point_id, height) know both ends. config: the session's classes. compat: sights of the first five setups only.
    """
    config = config or EngineConfig()
    cls = config.default_class if cls is None else cls
    back, fore = F.col("dist_back").cast("double"), F.col("dist_fore").cast("double")
    of = lambda name, c=cls: config.value(c, name)
    sight, single, total = of("max_sight_distance_geometric_m"), "max_single_distance_imbalance_m", "max_cumulative_distance_imbalance_m"
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    said = lambda c, *x: F.collect_list(F.when(c, F.struct("setup_number", *(y.alias(f"v{k}") for k, y in enumerate(x)))))
    off = F.abs(back - fore)
    seen = F.col("setup_number") <= 5 if compat else F.lit(True)
    per = setups.groupBy("line_id").agg(
        F.count(F.lit(1)).alias("n_setups"), count(F.col("height_diff").isNull()).alias("n_missing"), (F.sum(back + fore) / 2).alias("distance"), F.sum("height_diff").cast("double").alias("dh"),
        (count(seen & (back > sight)) + count(seen & (fore > sight))).alias("n_long_sights"), count(off > of(single)).alias("n_unbalanced"), count(off > of(single, 4)).alias("n_unbalanced_4"), F.abs(F.sum(back - fore)).alias("imbalance"),
        said(seen & ((back > sight) | (fore > sight)), back, fore).alias("long"), said(off > min(of(single), of(single, 4)), off).alias("uneven"),
    )
    t = lines.join(per, "line_id", "left").fillna(0, ["n_setups", "n_missing", "distance", "n_long_sights", "n_unbalanced", "n_unbalanced_4", "imbalance"])
    needs = F.lit(of("required_method") == "BFFB")
    effective = F.when(needs & (F.col("method") == "BF"), F.lit(4)).otherwise(F.lit(cls))
    t = t.withColumn("endpoint", R.endpoint_status(F.col("end_point"))).withColumn("effective_class", effective)
    if benchmarks is not None:
        t = with_heights(t, benchmarks)
        t = t.withColumn("misclosure_mm", F.round((F.col("dh") - (F.col("end_height") - F.col("start_height"))) * 1000, 6)).drop("start_height", "end_height")
    else:
        t = t.withColumn("misclosure_mm", F.lit(None).cast("double"))
    t = t.withColumn("tolerance_mm", config.tolerance(F.col("distance"), F.col("effective_class")))
    most = of("max_line_length_km")
    lowered = F.col("effective_class") != cls
    allowed = F.when(lowered, F.lit(of(total, 4))).otherwise(F.lit(of(total)))
    one = F.when(lowered, F.lit(of(single, 4))).otherwise(F.lit(of(single)))
    rules: dict[str, Column] = {
        "endpoint_ok": F.col("endpoint").isin("benchmark", "unclear"),
        "naming_ok": _naming_ok(F.col("filename"), F.col("start_point"), F.col("end_point")) if "filename" in lines.columns else F.lit(True),
        "complete": F.col("n_setups") > 0,
        "length_ok": F.lit(True) if most is None else F.col("distance") / 1000 <= most,
        "sights_ok": F.col("n_long_sights") == 0,
        "method_ok": ~needs | (F.col("method") != "FB"),
        "balance_ok": (F.when(lowered, F.col("n_unbalanced_4")).otherwise(F.col("n_unbalanced")) == 0) & (F.col("imbalance") <= allowed),
        "tolerance_ok": F.coalesce(F.abs("misclosure_mm") <= F.col("tolerance_mm"), F.lit(True)),
    }
    t = t.withColumns(rules)
    ok = F.lit(True)
    for c in rules:
        ok = ok & F.col(c)
    text = F.format_string
    num = lambda x, d=2: text(f"%.{d}f", x)
    along = lambda c, f: F.transform(F.array_sort(F.coalesce(F.col(c), F.array())), f)
    sights = F.flatten(along("long", lambda x: F.array_compact(F.array(*(F.when(x[f"v{k}"] > sight, text(f"Setup %d {name}: %.2f m exceeds limit {sight} m", x["setup_number"], x[f"v{k}"])) for k, name in enumerate(("backsight", "foresight")))))))
    uneven = F.filter(F.transform(F.array_sort(F.coalesce(F.col("uneven"), F.array())), lambda x: F.when(x["v0"] > one, text("Setup %d: distance imbalance %.2f m exceeds limit %.1f m", x["setup_number"], x["v0"], one))), lambda x: x.isNotNull())
    msg = lambda bad, x: F.when(bad, x)
    errors = F.concat(
        F.array_compact(F.array(
            msg(F.col("endpoint") == "empty", F.lit("End point is empty")), msg(F.col("endpoint") == "turning_point", F.concat(F.lit("End point "), "end_point", F.lit(" is a turning point"))),
            msg(~F.col("naming_ok"), F.concat(F.lit("File name "), F.col("filename") if "filename" in lines.columns else F.lit(""), F.lit(" has the ends the other way round"))),
            msg(~F.col("complete"), F.lit("No setups")), msg(~F.col("length_ok"), F.concat(F.lit("Length "), num(F.col("distance") / 1000), F.lit(f" km exceeds limit {most} km"))),
        )),
        F.when(F.col("sights_ok"), F.array().cast("array<string>")).otherwise(sights),
        F.array_compact(F.array(msg(~F.col("method_ok"), F.concat(F.lit(f"Class H{cls} requires {of('required_method')}, not "), "method")))),
        uneven,
        F.array_compact(F.array(
            msg(F.col("imbalance") > allowed, text("Cumulative distance imbalance %.2f m exceeds limit %.1f m", F.col("imbalance"), allowed)),
            msg(~F.col("tolerance_ok"), text("Misclosure %.2f mm exceeds tolerance %.2f mm (class H%d)", F.abs("misclosure_mm"), F.col("tolerance_mm"), F.col("effective_class"))),
        )),
    )
    warnings = F.array_compact(F.array(
        msg(F.col("endpoint") == "unclear", F.concat(F.lit("End point "), "end_point", F.lit(" is neither benchmark nor turning point"))),
        msg(~R.is_benchmark(F.col("start_point")), F.lit("Start point is no benchmark")),
        msg(F.col("complete") & (F.col("n_setups") < of("min_setups")), text(f"Only %d setups, {of('min_setups')} expected", F.col("n_setups"))),
        msg(F.col("n_missing") > 0, text("%d setups without height difference", F.col("n_missing"))), msg(lowered, F.lit("Method BF: judged as class H4")),
    ))
    return t.select(
        "line_id", "endpoint", "effective_class", "n_setups", "n_missing", "n_long_sights", *rules, ok.alias("valid"), "misclosure_mm", "tolerance_mm", errors.alias("errors"), warnings.alias("warnings")
    )


def validate_line(lines: DataFrame, setups: DataFrame, line_id: int, cls: int | None = None, config: EngineConfig | None = None) -> DataFrame:
    """validate of one line."""
    return validate(lines.filter(F.col("line_id") == line_id), setups.filter(F.col("line_id") == line_id), cls, config)


def line_status(validated: DataFrame) -> DataFrame:
    """line_id and the status that validation leaves a line in: the last rule that fails decides."""
    s = F.lit("valid")
    for name, c in (("invalid_endpoint", ~F.col("endpoint_ok")), ("naming_error", ~F.col("naming_ok")), ("incomplete", ~F.col("complete")), ("exceeded_tolerance", ~F.col("tolerance_ok"))):
        s = F.when(c, name).otherwise(s)
    return validated.select("line_id", s.alias("status"))


def batch_summary(validated: DataFrame) -> DataFrame:
    bad = lambda c: F.count_if(~F.col(c))
    return validated.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("valid").alias("valid"), bad("endpoint_ok").alias("endpoint_errors"), bad("complete").alias("incomplete"),
        bad("naming_ok").alias("naming_errors"), bad("tolerance_ok").alias("tolerance_errors"), bad("length_ok").alias("too_long"), bad("sights_ok").alias("long_sights"), bad("method_ok").alias("method_errors"), bad("balance_ok").alias("balance_errors"),
        F.coalesce(F.try_divide(F.count_if("valid").cast("double"), F.count(F.lit(1)).cast("double")), F.lit(0.0)).alias("pass_rate"),
    )


def intermediate_heights(adjusted: DataFrame) -> DataFrame:
    """line_id, point, height of adjusted setups (to_point, height); a repeated point keeps its last height."""
    return adjusted.groupBy("line_id", F.col("to_point").alias("point")).agg(F.max_by("height", "setup_number").alias("height"))


def bf_pairs(pairs: DataFrame, tolerance_mm: float | None = None) -> DataFrame:
    """Forward and backward differences (fwd, bwd in m): mean, signed difference in mm and its consistency."""
    diff = F.round((F.col("fwd") + F.col("bwd")) * 1000, 6)
    ok = F.lit(True) if tolerance_mm is None else F.abs(diff) <= tolerance_mm
    return pairs.withColumns({"mean_dh": (F.col("fwd") - F.col("bwd")) / 2, "bf_diff": diff, "consistent": ok})


def validation_table(validated: DataFrame, totals: DataFrame) -> DataFrame:
    """Per line the first failure by priority, the first two messages and the distance in the table's unit: km if lines are over 1000 m on average."""
    unit = totals.agg(F.when(F.avg("distance") > 1000, "km").otherwise("m").alias("unit"))
    fails = [("endpoint", "endpoint_ok"), ("naming", "naming_ok"), ("tolerance", "tolerance_ok"), ("method", "method_ok"), ("incomplete", "complete"), ("length", "length_ok"), ("sights", "sights_ok"), ("balance", "balance_ok")]
    first = F.lit("")
    for name, c in reversed(fails):
        first = F.when(~F.col(c), name).otherwise(first)
    j = validated.join(totals.select("line_id", "distance", "height_diff"), "line_id", "left").crossJoin(F.broadcast(unit))  # one row
    return j.select("line_id", "valid", first.alias("primary_failure"), F.when(F.col("unit") == "km", F.col("distance") / 1000).otherwise(F.col("distance")).alias("distance"), "unit", "height_diff", F.array_join(F.slice(F.concat("errors", "warnings"), 1, 2), "; ").alias("messages"))

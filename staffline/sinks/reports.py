"""Tables under the names that reports use, and reports as text rows (section, seq, line)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import leveling as L
from .exports import layout, ranked


def setups_table(setups: DataFrame) -> DataFrame:
    """Setups under their report names; missing temperature and cumulative height are null."""
    of = lambda c, t="double": (F.col(c) if c in setups.columns else F.lit(None)).cast(t)
    return setups.select(
        "line_id", F.col("setup_number").alias("SetupNum"), F.col("from_point").alias("FromPoint"), F.col("to_point").alias("ToPoint"), of("backsight").alias("BacksightReading"), of("foresight").alias("ForesightReading"),
        of("dist_back").alias("DistanceBack"), of("dist_fore").alias("DistanceFore"), of("height_diff").alias("HeightDiff"), of("cumulative_height").alias("CumulativeHeight"), of("temperature").alias("Temperature"),
    )


def lines_table(lines: DataFrame, totals: DataFrame) -> DataFrame:
    """One row per line: Filename, ends, NumSetups, TotalDistance, HeightDiff, Method, Status, IsUsed."""
    j = lines.join(totals, "line_id", "left")
    return j.select(
        F.col("filename").alias("Filename"), F.col("start_point").alias("StartPoint"), F.col("end_point").alias("EndPoint"), F.coalesce("n_setups", F.lit(0)).alias("NumSetups"), F.coalesce("distance", F.lit(0.0)).alias("TotalDistance"),
        F.coalesce("height_diff", F.lit(0.0)).alias("HeightDiff"), F.col("method").alias("Method"), F.col("status").alias("Status"), F.col("is_used").alias("IsUsed"),
    )


def heights_table(heights: DataFrame) -> DataFrame:
    return heights.select(F.col("point").alias("PointID"), F.col("height").alias("AdjustedHeight"), F.col("mse").alias("MSE"))


def used(rows: DataFrame) -> DataFrame:
    """Setups or lines that are in use."""
    return rows.filter(F.coalesce("is_used", F.lit(True)))


def _rows(df: DataFrame, section: int, seq: Column, line: Column) -> DataFrame:
    return df.select(F.lit(section).alias("section"), seq.cast("string").alias("seq"), line.alias("line"))


def _seq(c: str = "rank") -> Column:
    return F.lpad(F.col(c).cast("string"), 20, "0")


def _fixed(df: DataFrame, section: int, *lines: str) -> DataFrame:
    """Constant lines of a section, numbered before its rows."""
    one = df.sparkSession.createDataFrame([(section, f"{k:03}", x) for k, x in enumerate(lines)], "section int, seq string, line string")
    return one


def summary(lines: DataFrame, totals: DataFrame) -> DataFrame:
    """The overview of lines (with status and filename): heading, a row per line, counts."""
    j = lines.join(totals, "line_id", "left")
    d = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    ok = F.col("status") == "valid"
    body = layout("{:<25}{:<12}{:<12}{:>8}{:>12.2f}{:>12.5f}  {} {}", F.col("filename"), F.col("start_point"), F.col("end_point"), F.coalesce("n_setups", F.lit(0)), d("distance"), d("height_diff"), F.when(ok, "✓").otherwise("✗"), F.col("status"))
    counts = lines.agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("good"))
    tail = _rows(counts, 2, F.lit("1"), F.format_string("Total files: %d", "n")).unionByName(_rows(counts, 2, F.lit("2"), F.format_string("Valid: %d, Invalid: %d", F.col("good"), F.col("n") - F.col("good"))))
    head = _fixed(lines, 0, f"{'Filename':<25}{'Start':<12}{'End':<12}{'Setups':>8}{'Distance':>12}{'dH':>12}{'Status':<15}", "-" * 90)
    return head.unionByName(_rows(j, 1, _seq("line_id"), body)).unionByName(_fixed(lines, 2, "-" * 90)).unionByName(tail)


def overview(lines: DataFrame, totals: DataFrame) -> DataFrame:
    """One row: number of files and their total distance in m."""
    return lines.join(totals, "line_id", "left").agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("distance"), F.lit(0.0)).alias("total_distance"))


def line_details(stations: DataFrame, lines: DataFrame) -> DataFrame:
    """Rows of a line's detail view: from, to, readings, difference and mean distance as text, `-` where missing or zero.

    The last setup ends at the line's end; a setup without a point ends at `TP` and its number.
    """
    j = stations.drop("start_point", "end_point", "method", "n").join(lines.select("line_id", "start_point", "end_point"), "line_id").withColumn("__n", F.max("setup_number").over(L._line()))
    to = F.when(F.col("setup_number") == F.col("__n"), F.col("end_point")).otherwise(F.coalesce(F.nullif(F.col("to_point"), F.lit("")), F.concat(F.lit("TP"), F.col("setup_number").cast("string"))))
    j = j.withColumn("__to", to)
    start = F.coalesce(F.lag("__to").over(L._line().orderBy("setup_number")), F.col("start_point"))
    num = lambda c: F.when(F.coalesce(c, F.lit(0)) == 0, "-").otherwise(c.cast("decimal(12,5)").cast("string"))
    dist = F.when((F.coalesce("dist_back", F.lit(0)) == 0) | (F.coalesce("dist_fore", F.lit(0)) == 0), "-").otherwise(F.format_string("%.2f", ((F.col("dist_back") + F.col("dist_fore")) / 2).cast("double")))
    return j.select("line_id", "setup_number", start.alias("from_point"), F.col("__to").alias("to_point"), num(F.col("backsight")).alias("rb"), num(F.col("foresight")).alias("rf"), num(F.col("height_diff")).alias("dh"), dist.alias("distance"))


def detail_status(validated: DataFrame) -> DataFrame:
    """line_id and the status text of the detail view."""
    n = F.size("warnings")
    ok = F.when(n > 0, F.format_string("valid - all checks passed (%d warnings)", n)).otherwise("valid - all checks passed")
    return validated.select("line_id", F.when(F.col("valid"), ok).otherwise(F.concat(F.lit("invalid - "), F.coalesce(F.try_element_at("errors", F.lit(1)), F.lit("")))).alias("status"))


def _results(obs: DataFrame, heights: DataFrame) -> DataFrame:
    h = lambda end: heights.select(F.col("point").alias(f"{end}_pt"), F.col("height").alias(f"{end}_h"))
    j = obs.join(h("from"), "from_pt").join(h("to"), "to_pt").withColumn("adj", F.round(F.col("to_h") - F.col("from_h"), 8))
    return j.select("obs_seq", F.col("from_pt").cast("string").alias("a"), F.col("to_pt").cast("string").alias("b"), F.col("height_diff").cast("double").alias("dh"), "adj", (F.round((F.col("height_diff").cast("double") - F.col("adj")) * 1000, 6) + 0.0).alias("r"))


def adjustment_text(obs: DataFrame, heights: DataFrame, statistics: DataFrame, method: str = "Parametric (Ax+L)") -> DataFrame:
    """The text report of an adjustment: quality, network, heights by point, residuals (observed less adjusted)."""
    bar = "-" * 80
    h = ranked(heights.withColumn("p", F.col("point").cast("string")), "p")
    n = heights.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_fixed").alias("f"), F.max("sigma0").alias("s")).crossJoin(obs.agg(F.count(F.lit(1)).alias("o"))).crossJoin(statistics.select("k"))  # one row each
    out = _fixed(obs, 0, "=" * 80, "NETWORK ADJUSTMENT RESULTS", "=" * 80, "", f"Adjustment Method: {method}", "", "QUALITY METRICS:", bar)
    facts = (("Standard error of unit weight", "%.6f", F.col("s")), ("K coefficient", "%.2f", F.col("k")), ("Total points", "%d", F.col("n")), ("Fixed points", "%d", F.col("f")), ("Unknown points", "%d", F.col("n") - F.col("f")), ("Observations", "%d", F.col("o")), ("Degrees of freedom", "%d", F.col("o") - F.col("n") + F.col("f")))
    for k, (name, form, c) in enumerate(facts):
        out = out.unionByName(_rows(n, 1, F.lit(str(k)), F.format_string(f"  {name}: {form}", c)))
    out = out.unionByName(_fixed(obs, 2, "", "ADJUSTED HEIGHTS:", bar, f"{'No.':<6} {'Point':<15} {'Height (m)':<15} {'Std Error (m)':<15} {'Status':<10}", bar))
    body = layout("{:<6} {:<15} {:<15.4f} {:<15.5f} {:<10}", F.col("rank"), F.col("p"), F.col("height"), F.coalesce("mse", F.lit(0.0)), F.when(F.col("is_fixed"), "Fixed").otherwise("Adjusted"))
    out = out.unionByName(_rows(h, 3, _seq(), body))
    out = out.unionByName(_fixed(obs, 4, "", "RESIDUALS:", bar, f"{'From':<10} {'To':<10} {'Obs dH (m)':<15} {'Adj dH (m)':<15} {'Residual (mm)':<15}", bar))
    r = _results(obs, heights)
    out = out.unionByName(_rows(r, 5, _seq("obs_seq"), layout("{:<10} {:<10} {:<15.4f} {:<15.4f} {:<15.2f}", F.col("a"), F.col("b"), F.col("dh"), F.col("adj"), F.col("r"))))
    return out.unionByName(_fixed(obs, 6, "", "=" * 80, "End of Report"))


def _cell(c: Column) -> Column:
    """A CSV field: quoted where it has to be."""
    return F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def adjustment_csv(obs: DataFrame, heights: DataFrame, method: str = "Parametric") -> DataFrame:
    """The same as comma-separated sections."""
    h = ranked(heights.withColumn("p", F.col("point").cast("string")), "p")
    sigma = heights.agg(F.max("sigma0").alias("s"))
    out = _fixed(obs, 0, "Network Adjustment Results", f"Method,{method}").unionByName(_rows(sigma, 1, F.lit(""), layout("Sigma_0,{:.6f}", F.col("s"))))
    out = out.unionByName(_fixed(obs, 2, "", "ADJUSTED HEIGHTS", "No.,Point,Height (m),Std Error (m),Status"))
    out = out.unionByName(_rows(h, 3, _seq(), layout("{},{},{:.4f},{:.5f},{}", F.col("rank"), _cell(F.col("p")), F.col("height"), F.coalesce("mse", F.lit(0.0)), F.when(F.col("is_fixed"), "Fixed").otherwise("Adjusted"))))
    out = out.unionByName(_fixed(obs, 4, "", "RESIDUALS", "From,To,Observed dH (m),Adjusted dH (m),Residual (mm)"))
    r = _results(obs, heights)
    return out.unionByName(_rows(r, 5, _seq("obs_seq"), layout("{},{},{:.4f},{:.4f},{:.2f}", _cell(F.col("a")), _cell(F.col("b")), F.col("dh"), F.col("adj"), F.col("r"))))

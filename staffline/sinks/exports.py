"""Text exports as rows (section, seq, line), GeoJSON features and map layers; write_text makes one file of rows.

Numbers are laid out by Python's formatting in Arrow batches, as the JVM rounds halves differently. Row sets stay
distributed up to write_text, which streams them in order to the file, one partition at a time.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.checkpoints import cut


def layout(pattern: str, *cols: Column) -> Column:
    """pattern.format of the columns, row by row of an Arrow batch; a null among them is laid out as empty text."""

    @F.pandas_udf("string")
    def lay(*xs: pd.Series) -> pd.Series:
        return pd.Series([pattern.format(*row) for row in zip(*xs, strict=True)], index=xs[0].index)

    return lay(*cols)


def observations(lines: DataFrame, totals: DataFrame) -> DataFrame:
    """The observation of each line: its totals under its end points, MMYY of its date, file name as source."""
    j = lines.join(totals, "line_id")
    return j.select(
        F.col("line_id").alias("obs_seq"), F.col("start_point").alias("from_point"), F.col("end_point").alias("to_point"), "height_diff", "distance", F.col("n_setups").alias("num_setups"),
        F.lit(0.0).alias("bf_diff"), F.coalesce(F.date_format("line_date", "MMyy"), F.lit("")).alias("year_month"), F.concat(F.lit("L"), F.col("line_id").cast("string")).alias("source_file"), "is_used",
    )


def benchmarks_from_lines(lines: DataFrame) -> DataFrame:
    """Ends with letters, at height zero, numbered in order of first appearance."""
    ends = lines.select("line_id", F.posexplode(F.array("start_point", "end_point")).alias("side", "point_id")).filter(F.trim("point_id").rlike("[A-Za-z]"))
    return ends.groupBy("point_id").agg(F.min(F.struct("line_id", "side")).alias("first")).select("point_id", F.lit(0.0).alias("height"), "first.line_id", "first.side")


def _points(obs: DataFrame) -> DataFrame:
    return obs.select(F.explode(F.array("from_point", "to_point")).alias("point_id")).filter("point_id is not null").distinct()


def unknown_points(obs: DataFrame, benchmarks: DataFrame) -> DataFrame:
    return _points(obs).join(benchmarks.select("point_id"), "point_id", "left_anti")


def _rows(df: DataFrame, section: int, seq: Column, line: Column) -> DataFrame:
    return df.select(F.lit(section).alias("section"), seq.cast("string").alias("seq"), line.alias("line"))


def _key(c: str) -> Column:
    return F.lpad(F.col(c).cast("string"), 20, "0")


def _measured(obs: DataFrame, tail: str, *more: Column) -> Column:
    d = lambda c: F.col(c).cast("double")
    return layout("{:8}{:8}{:12.5f}{:7.0f}.{:4}{:7.2f}" + tail, F.col("from_point"), F.col("to_point"), d("height_diff"), d("distance"), F.col("num_setups"), d("bf_diff"), F.col("year_month"), F.col("source_file"), *more)


def fteg(obs: DataFrame, only_used: bool = False) -> DataFrame:
    """Observation rows that end in 0, the last one in 9."""
    o = obs.filter("is_used") if only_used else obs
    most = o.agg(F.max("obs_seq").alias("last_seq"))
    o = o.crossJoin(F.broadcast(most)).withColumn("mark", F.when(F.col("obs_seq") == F.col("last_seq"), "9").otherwise("0"))  # one row
    return _rows(o, 0, _key("obs_seq"), _measured(o, "   {:3}           {} {}", F.col("mark")))


def fa0(obs: DataFrame, benchmarks: DataFrame, project: str = "project.rez", only_used: bool = True) -> DataFrame:
    """Header, benchmarks, unknown points, observations, terminator."""
    o = obs.filter("is_used") if only_used else obs
    free = unknown_points(o, benchmarks)
    n = benchmarks.select("point_id").unionByName(free).agg(F.count(F.lit(1)).alias("n"))
    head = _rows(n, 0, F.lit(""), layout("  {}   2            " + f"{project:40}9", F.col("n")))
    marks = _rows(benchmarks, 1, F.col("point_id"), layout("    {:8}{:12.3f}", F.col("point_id"), F.col("height").cast("double")))
    open_ = _rows(free, 2, F.col("point_id"), layout("    {:8}           .", F.col("point_id")))
    body = _rows(o, 3, _key("obs_seq"), _measured(o, "  {:4}           {}"))
    end = _rows(n, 4, F.lit(""), F.lit(" 9"))
    return head.unionByName(marks).unionByName(open_).unionByName(body).unionByName(end)


def ranked(rows: DataFrame, key: str) -> DataFrame:
    """rows with a rank from 1 in order of a unique key, by range-sorted partitions and their sizes: no single-task window."""
    s = cut(rows.orderBy(key)).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id() - F.shiftleft(F.col("__part").cast("long"), 33))
    sizes = s.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).withColumn("__base", F.sum("__n").over(Window.partitionBy().orderBy("__part")) - F.col("__n"))  # a row a partition
    return s.join(F.broadcast(sizes), "__part").withColumn("rank", F.col("__base") + F.col("__at") + 1).drop("__part", "__at", "__n", "__base")


def _texts(df: DataFrame, section: int, *lines: str) -> DataFrame:
    return df.sparkSession.createDataFrame([(section, f"{k:03}", x) for k, x in enumerate(lines)], "section int, seq string, line string")


def fa1(obs: DataFrame, residuals: DataFrame, heights: DataFrame, statistics: DataFrame, project: str = "project.rez", iteration: int = 1) -> DataFrame:
    """Adjustment report: residuals (obs_seq, v_mm), statistics (total_km, total_mm, k), heights (point, height, mse, is_fixed, sigma0).

    Data, residuals, statistics, heights. The allowance is 3 mm per root km; delta is signed; `**` marks residuals beyond it.
    A residual or a section's rows may be followed by blank lines, which are part of the row's text.
    """
    pad, star = " " * 43, " " * 42 + "******"
    h = ranked(heights.withColumn("p", F.col("point").cast("string")), "p")
    n = heights.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("sigma0"), F.lit(0.0)).alias("s"))
    rank = F.lpad(F.col("rank").cast("string"), 20, "0")
    out = _texts(obs, 0, "", "", pad + "DATA", star, "").unionByName(_rows(n, 1, F.lit(""), layout(pad + "{}   2            " + f"{project:40}9\n\n\n", F.col("n"))))
    out = out.unionByName(_texts(obs, 2, pad + "DATA", star)).unionByName(_rows(h, 3, rank, layout(" " * 42 + "{:3}  {:8}{:12.3f}", F.col("rank"), F.col("p"), F.when(F.col("is_fixed"), F.col("height")).otherwise(0.0))))
    out = out.unionByName(_texts(obs, 4, "0", "", "1", "", "", "         FROM   TO        DH        DISTANCE   DH-(H2-H1)     ALWD      DELTA    G/B   KOD  YEARS  DURATION   NO.SH", "        " + "-" * 107, ""))
    o = obs.join(residuals.select("obs_seq", (F.col("v_mm") / 1000).alias("v")), "obs_seq", "left").fillna(0.0, ["v"])
    o = o.withColumn("allowed", F.when(F.col("distance") > 0, 0.003 * F.sqrt(F.col("distance").cast("double") / 1000)).otherwise(0.0))
    o = o.withColumn("mark", F.when(F.abs("v") <= F.col("allowed"), "  ").otherwise("**"))
    table = layout("      {:8}{:8}{:12.5f}{:8.0f}.{:12.5f}    {:.6f}{:12.6f}  {}    0    0- 0      0\n", F.col("from_point"), F.col("to_point"), F.col("height_diff").cast("double"), F.col("distance").cast("double"), F.col("v"), F.col("allowed"), F.col("v") - F.col("allowed"), F.col("mark"))
    sums = layout("                   SDIST(KM)={:9.3f}   SDIF(MM)={:12.1f}   COEFF_CLASS K={:10.1f}\n", F.col("total_km"), F.col("total_mm"), F.col("k"))
    out = out.unionByName(_rows(o, 5, _key("obs_seq"), table)).unionByName(_texts(obs, 6, ",                 " + "=" * 75)).unionByName(_rows(statistics, 7, F.lit(""), sums))
    out = out.unionByName(_texts(obs, 8, f"1{' ' * 45}ITERATION  NO. {iteration}", "", " " * 39 + project, "")).unionByName(_rows(n, 9, F.lit(""), layout(" " * 37 + "M.S.E. OF UNIT WEIGHT = {:10.6f}\n", F.col("s"))))
    out = out.unionByName(_texts(obs, 10, " " * 34 + "NO.      ADJUSTED     APPROX          DIF         M.S.E.", ""))
    fixed, free = h.filter("is_fixed"), h.filter("not is_fixed")
    out = out.unionByName(_rows(fixed, 11, rank, layout(" " * 30 + "{:3} {:8}{:12.5f}", F.col("rank"), F.col("p"), F.col("height"))))
    return out.unionByName(_rows(free, 11, rank, layout(" " * 30 + "{:3} {:8}{:12.5f}{:12.5f}{:12.5f}{:12.6f}", F.col("rank"), F.col("p"), F.col("height"), F.lit(0.0), F.col("height"), F.coalesce("mse", F.lit(0.0)))))


def rez_header(project: str, at: str, source: bool = True) -> str:
    """Comment lines and column titles of a REZ file; at: the time that the file states."""
    title = f"{'From':<12}{'To':<12}{'Height Diff':>14}{'Distance':>12}{'Setups':>8}{'Status':>12}"
    rule = "-" * (110 if source else 70)
    return f"# REZ Summary File - {project}\n# Generated: {at}\n#{'=' * 78}\n\n{title}" + (f"  {'Source File':<30}" if source else "") + f"\n{rule}\n"


def rez(lines: DataFrame, only_used: bool = True, source: bool = True) -> DataFrame:
    """Summary rows of lines: line_id, ends, height_diff, distance, n_setups, status, and filename with source."""
    ln = lines.filter("is_used") if only_used else lines
    status = F.when(F.col("status") == "valid", "OK").otherwise(F.col("status"))
    d = lambda c: F.col(c).cast("double")
    return _rows(ln, 0, _key("line_id"), layout("{:<12}{:<12}{:>14.5f}{:>12.2f}{:>8}{:>12}" + "  {:<30}" * source, F.col("start_point"), F.col("end_point"), d("height_diff"), d("distance"), F.col("n_setups"), status, *([F.coalesce("filename", F.lit("Unknown"))] if source else [])))


def write_text(rows: DataFrame, path: str, encoding: str = "cp1255", header: str = "") -> None:
    """One file on the driver: a text export is one document. Rows come partition by partition, in order."""
    with open(path, "w", encoding=encoding) as f:
        f.write(header)
        for r in rows.orderBy("section", "seq").toLocalIterator(prefetchPartitions=True):
            f.write(r.line + "\n")


def schematic_coordinates(points: DataFrame) -> DataFrame:
    """point_id, lon, lat, height on a circle, in order of the id.

    The rank over all points comes from a range-sorted count per partition, not from one window in one task.
    """
    s = ranked(points.select("point_id").distinct(), "point_id").crossJoin(F.broadcast(points.agg(F.countDistinct("point_id").alias("total"))))  # one row
    angle = 2 * math.pi * (F.col("rank") - 1) / F.col("total")
    return s.select("point_id", (34.8 + 0.01 * F.cos(angle)).alias("lon"), (31.5 + 0.01 * F.sin(angle)).alias("lat"), F.lit(0.0).alias("height"))


def _place(c: str) -> Column:
    return F.array(F.col(f"{c}.lon"), F.col(f"{c}.lat"), F.coalesce(F.col(f"{c}.height"), F.lit(0.0)))


def geojson_lines(lines: DataFrame, coordinates: DataFrame, only_used: bool = True) -> DataFrame:
    """(line_id, feature): a LineString of each line whose two ends have coordinates."""
    ln = lines.filter("is_used") if only_used else lines
    at = lambda end: coordinates.select(F.col("point_id").alias(f"{end}_point"), F.struct("lon", "lat", "height").alias(end[0]))
    j = ln.join(at("start"), "start_point").join(at("end"), "end_point")
    geometry = F.struct(F.lit("LineString").alias("type"), F.array(_place("s"), _place("e")).alias("coordinates"))
    props = F.struct("filename", "start_point", "end_point", F.col("distance").alias("distance_m"), F.col("height_diff").alias("height_diff_m"), F.col("n_setups").alias("num_setups"), "status", "method")
    return j.select("line_id", F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), props.alias("properties")), {"ignoreNullFields": "false"}).alias("feature"))


def geojson_points(points: DataFrame, coordinates: DataFrame) -> DataFrame:
    """(point_id, feature): a Point of each of the points that has coordinates."""
    j = points.select("point_id").distinct().join(coordinates.select("point_id", F.struct("lon", "lat", "height").alias("c")), "point_id")
    props = F.struct("point_id", F.col("c.height").alias("height"), (~F.col("point_id").rlike("^[0-9]+$")).alias("is_benchmark"))
    return j.select("point_id", F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), _place("c").alias("coordinates")).alias("geometry"), props.alias("properties"))).alias("feature"))


def write_geojson(features: DataFrame, path: str, name: str = "Leveling Network") -> None:
    """A FeatureCollection (EPSG:4326) of a `feature` column, streamed to one file."""
    with open(path, "w", encoding="utf-8") as f:
        f.write('{"type":"FeatureCollection","name":"%s","crs":{"type":"name","properties":{"name":"urn:ogc:def:crs:EPSG::4326"}},"features":[' % name)
        for i, r in enumerate(features.select("feature").toLocalIterator(prefetchPartitions=True)):
            f.write(("," if i else "") + r.feature)
        f.write("]}\n")


def _quoted(c: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(F.coalesce(c, F.lit("")), F.lit("'"), F.lit("''")), F.lit("'"))


def layer_selects(lines: DataFrame) -> DataFrame:
    """(line_id, part): the SELECT of each used line of a virtual map layer; every text is escaped."""
    q, num = _quoted, lambda c, d: F.format_string(f"%.{d}f", F.col(c).cast("double"))
    part = F.concat(
        F.lit("SELECT "), F.col("line_id").cast("string"), F.lit(" as id, "), q(F.col("filename")), F.lit(" as filename, "), q(F.col("start_point")), F.lit(" as start_point, "), q(F.col("end_point")), F.lit(" as end_point, "),
        q(F.col("method")), F.lit(" as method, "), num("distance", 4), F.lit(" as distance_m, "), num("height_diff", 5), F.lit(" as height_diff_m, "), F.col("n_setups").cast("string"), F.lit(" as num_setups"),
    )
    return lines.filter("is_used").select("line_id", part.alias("part"))


def point_selects(points: DataFrame, coordinates: DataFrame) -> DataFrame:
    """(point_id, part): the SELECT of each point with coordinates of a virtual map layer."""
    j = points.select("point_id").distinct().join(coordinates, "point_id")
    num = lambda c: F.format_string("%.9f", F.col(c).cast("double"))
    kind = F.when(F.col("point_id").rlike("^[0-9]+$"), "turning_point").otherwise("benchmark")
    part = F.concat(F.lit("SELECT "), _quoted(F.col("point_id")), F.lit(" as point_id, '"), kind, F.lit("' as kind, "), num("height"), F.lit(" as height, make_point("), num("lon"), F.lit(", "), num("lat"), F.lit(") as geometry"))
    return j.select("point_id", part.alias("part"))


def layer_query(selects: DataFrame, key: str) -> str:
    """One virtual layer's query; without rows, a query of none. A layer is one text, so it is put together on the driver."""
    parts = [r.part for r in selects.orderBy(key).toLocalIterator()]
    return " UNION ALL ".join(parts) or "SELECT NULL as id WHERE 1 = 0"

"""Registered queries of reports, map layers, merge summaries and project documents, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import leveling as L
from ..operators import merging as M
from ..operators import network as N
from ..sinks import exports as X
from ..sinks import reports as P
from ..sources import derived as D
from ..sources import projects as J
from .field import _ends, _network_lines, _rez_lines, _STATIONS
from .queries import _STATS, RINGS, _adjusted, _round, query

_NAMED = "concat('L', line_id)"


@query(_STATIONS + """SELECT line_id, setup_number::INT AS "SetupNum", from_point AS "FromPoint", to_point AS "ToPoint", backsight::DOUBLE AS "BacksightReading", foresight::DOUBLE AS "ForesightReading", dist_back::DOUBLE AS "DistanceBack",
  dist_fore::DOUBLE AS "DistanceFore", height_diff::DOUBLE AS "HeightDiff", NULL::DOUBLE AS "CumulativeHeight", NULL::DOUBLE AS "Temperature" FROM stations""")
def setups_table(spark, sf):
    return P.setups_table(D.stations(spark, sf))


def _statused(spark, sf):
    return D.lines(spark, sf).withColumns({"status": F.lit("valid"), "filename": F.concat(F.lit("L"), F.col("line_id").cast("string"))})


@query(f"""SELECT {_NAMED} AS "Filename", start_point AS "StartPoint", end_point AS "EndPoint", coalesce(n_setups, 0) AS "NumSetups", round(coalesce(distance, 0), 9) AS "TotalDistance", round(coalesce(height_diff, 0), 9) + 0.0 AS "HeightDiff",
  method AS "Method", 'valid' AS "Status", is_used AS "IsUsed" FROM lines LEFT JOIN totals USING (line_id)""")
def lines_table(spark, sf):
    return _round(P.lines_table(_statused(spark, sf), L.line_totals(D.setups(spark, sf))), "TotalDistance", "HeightDiff")


@query(RINGS + """SELECT point AS "PointID", round(height + 1.3e-10, 8) AS "AdjustedHeight", round(mse, 8) + 0.0 AS "MSE" FROM hts""")
def heights_table(spark, sf):
    h = P.heights_table(_adjusted(spark, sf)[1])
    return _round(h.withColumn("AdjustedHeight", F.col("AdjustedHeight") + F.lit(1.3e-10)), "AdjustedHeight", "MSE", digits=8)


@query(f"""SELECT 1 AS section, format('{{:<25}}{{:<12}}{{:<12}}{{:>8}}{{:>12.2f}}{{:>12.5f}}  ✓ valid', {_NAMED}, start_point, end_point, coalesce(n_setups, 0), coalesce(distance, 0), coalesce(height_diff, 0)) AS line FROM lines LEFT JOIN totals USING (line_id)
  UNION ALL SELECT 2, format('Total files: {{}}', count(*)) FROM lines UNION ALL SELECT 2, format('Valid: {{}}, Invalid: 0', count(*)) FROM lines""")
def print_summary(spark, sf):
    r = P.summary(_statused(spark, sf), L.line_totals(D.setups(spark, sf)))
    return r.filter("section > 0 and seq <> '000'").drop("seq")


@query("SELECT count(*) AS n_files, round(sum(distance), 6) AS total_distance FROM lines LEFT JOIN totals USING (line_id)")
def gui_summary(spark, sf):
    return _round(P.overview(D.lines(spark, sf), L.line_totals(D.setups(spark, sf))), "total_distance", digits=6)


@query(_STATIONS + """, t AS (SELECT *, lag(to_point) OVER (PARTITION BY line_id ORDER BY setup_number) AS p FROM stations)
  SELECT line_id, setup_number::INT AS setup_number, coalesce(p, start_point) AS from_point, to_point, CASE WHEN backsight = 0 THEN '-' ELSE backsight::VARCHAR END AS rb, CASE WHEN foresight = 0 THEN '-' ELSE foresight::VARCHAR END AS rf,
  CASE WHEN height_diff = 0 THEN '-' ELSE height_diff::DECIMAL(12,5)::VARCHAR END AS dh, format('{:.2f}', ((dist_back + dist_fore)::DOUBLE) / 2 + 1e-9) AS distance FROM t""")
def line_detail_view(spark, sf):
    s = D.stations(spark, sf).withColumns({c: F.col(c) for c in ("dist_back", "dist_fore")})
    return P.line_details(s, D.lines(spark, sf))


@query("SELECT count(*) AS n FROM setups JOIN lines USING (line_id) WHERE is_used")
def used_lines(spark, sf):
    return D.setups(spark, sf).join(P.used(D.lines(spark, sf)), "line_id").agg(F.count(F.lit(1)).alias("n"))


_RANKED = RINGS + _STATS + """, r AS (SELECT *, point::VARCHAR AS p, row_number() OVER (ORDER BY point::VARCHAR) AS rank FROM hts),
  q AS (SELECT v.*, round(round(b.height, 8) - round(a.height, 8), 8) AS adj, round((v.dh - round(round(b.height, 8) - round(a.height, 8), 8)) * 1000, 6) + 0.0 AS r FROM v JOIN hts a ON a.point = from_pt JOIN hts b ON b.point = to_pt)
"""


@query(_RANKED + """SELECT 3 AS section, format('{:<6} {:<15} {:<15.4f} {:<15.5f} {:<10}', rank, p, round(height, 8), round(mse, 8), CASE WHEN is_fixed THEN 'Fixed' ELSE 'Adjusted' END) AS line FROM r
  UNION ALL SELECT 5, format('{:<10} {:<10} {:<15.4f} {:<15.4f} {:<15.2f}', from_pt::VARCHAR, to_pt::VARCHAR, dh, adj, r) FROM q""")
def adjustment_txt(spark, sf):
    obs, h = _adjusted(spark, sf)
    h, _, stats = _eased(obs, h)
    return _tidy(P.adjustment_text(obs, h, stats))


@query(_RANKED + """SELECT 3 AS section, format('{},{},{:.4f},{:.5f},{}', rank, p, round(height, 8), round(mse, 8), CASE WHEN is_fixed THEN 'Fixed' ELSE 'Adjusted' END) AS line FROM r
  UNION ALL SELECT 5, format('{},{},{:.4f},{:.4f},{:.2f}', from_pt, to_pt, dh, adj, r) FROM q""")
def adjustment_csv(spark, sf):
    obs, h = _adjusted(spark, sf)
    return _tidy(P.adjustment_csv(obs, _eased(obs, h)[0]))


def _eased(obs, h):
    """Heights to 1e-8 m and residuals and their statistics by the heights as they are; heights are computed once.

    Heights are rounded by their multiple of 1e-8, as the SQL does; F.round rounds the shortest decimal text of a double, which
    turns one just below a tie the other way.
    """
    from ..sources.checkpoints import cut

    h = cut(h)
    res = N.residuals(obs, h)
    return h.withColumns({c: F.round(F.col(c) * 1e8) / 1e8 for c in ("height", "mse")}), res, N.statistics(res)


def _tidy(rows):
    """The rows of the two tables."""
    return rows.filter("section in (3, 5)").select("section", "line")


_SEGS = """, c AS (SELECT region, min(obs_seq) AS chain_id, obs_seq, seq, seq AS pos FROM network GROUP BY ALL UNION ALL SELECT region, region * 6 + 1, obs_seq, seq, (seq + 4) % 5 FROM network WHERE seq < 5),
  k AS (SELECT CASE WHEN pos = seq THEN region * 6 ELSE region * 6 + 1 END AS chain_id, region, seq, pos, obs_seq FROM c),
  s AS (SELECT k.*, from_pt, to_pt, n.distance::DOUBLE AS distance FROM k JOIN network n USING (obs_seq))
"""


@query(_SEGS + """SELECT chain_id, count(*) AS num_segments, arg_min(from_pt, pos)::VARCHAR AS start_point, arg_max(to_pt, pos)::VARCHAR AS end_point, sum(distance) AS total_distance, count(*) AS total_setups,
  string_agg(concat(from_pt, '→', to_pt), ' ' ORDER BY pos) AS segments FROM s GROUP BY 1""")
def merge_summary(spark, sf):
    t = D.network(spark, sf).select(F.col("obs_seq").alias("line_id"), F.lit(1).alias("n_setups"), F.col("distance").cast("double").alias("distance"))
    m = M.find_mergeable_lines(_network_lines(spark, sf), t)
    return m.withColumn("segments", F.array_join(F.transform("segments", lambda x: x["direction"]), " ")).drop("common_nodes")


@query(_STATIONS + "SELECT line_id, start_point, end_point, method, is_used FROM lines")
def project_json(spark, sf):
    return J.from_documents(_documents(spark, sf))[0].select("line_id", "start_point", "end_point", "method", "is_used")


def _documents(spark, sf):
    s = D.stations(spark, sf).select("line_id", "setup_number", "from_point", "to_point", F.col("backsight").cast("double").alias("backsight_reading"), F.col("foresight").cast("double").alias("foresight_reading"), F.col("dist_back").cast("double").alias("distance_back"),
        F.col("dist_fore").cast("double").alias("distance_fore"), F.lit(None).cast("double").alias("temperature"), F.col("height_diff").cast("double").alias("height_diff"), F.lit(True).alias("is_used"))
    return J.to_documents(_statused(spark, sf), s)


@query(_STATIONS + "SELECT line_id, setup_number::INT AS setup_number, from_point, to_point, backsight::DOUBLE AS backsight_reading, dist_fore::DOUBLE AS distance_fore, height_diff::DOUBLE AS height_diff FROM stations")
def project_json_setups(spark, sf):
    return J.from_documents(_documents(spark, sf))[1].select("line_id", "setup_number", "from_point", "to_point", "backsight_reading", "distance_fore", "height_diff")


@query(_STATIONS + """SELECT 'Single Project' AS type, count(*) AS n_lines, count_if(is_used)::BIGINT AS n_used, (SELECT count(*) FROM benchmarks) AS n_benchmarks,
  (SELECT count(*) FROM (SELECT start_point FROM lines UNION SELECT end_point FROM lines UNION SELECT from_point FROM stations UNION SELECT to_point FROM stations)) AS total_points FROM lines""")
def project_properties(spark, sf):
    return J.project_properties(D.lines(spark, sf), D.stations(spark, sf), D.benchmarks(spark, sf))


_PLACES = """, pl AS (SELECT p, 34.8 + 0.01 * cos(2 * pi() * (row_number() OVER (ORDER BY p) - 1) / count(*) OVER ()) AS lon, 31.5 + 0.01 * sin(2 * pi() * (row_number() OVER (ORDER BY p) - 1) / count(*) OVER ()) AS lat
  FROM (SELECT start_point AS p FROM lines UNION SELECT end_point FROM lines))
"""


def _field(path, kind="string"):
    return F.get_json_object("feature", "$." + path).cast(kind)


@query(_PLACES + """SELECT line_id, 'LineString' AS kind, round(a.lon, 9) AS lon1, round(a.lat, 9) AS lat1, round(b.lon, 9) AS lon2, round(b.lat, 9) AS lat2, concat('L', line_id) AS filename, start_point, end_point, round(distance, 6) AS distance_m,
  round(height_diff, 6) + 0.0 AS height_diff_m, n_setups::INT AS num_setups, method FROM lines JOIN totals USING (line_id) JOIN pl a ON a.p = start_point JOIN pl b ON b.p = end_point WHERE is_used""")
def geojson_lines(spark, sf):
    g = X.geojson_lines(_rez_lines(spark, sf), X.schematic_coordinates(_ends(spark, sf)))
    at = {f"{n}{k + 1}": _field(f"geometry.coordinates[{k}][{i}]", "double") for k in (0, 1) for i, n in enumerate(("lon", "lat"))}
    p = lambda c, t="string": _field(f"properties.{c}", t).alias(c)
    out = g.select("line_id", _field("geometry.type").alias("kind"), *(c.alias(n) for n, c in at.items()), p("filename"), p("start_point"), p("end_point"), p("distance_m", "double"), p("height_diff_m", "double"), p("num_setups", "int"), p("method"))
    return _round(_round(out, *at), "distance_m", "height_diff_m", digits=6)


@query(_PLACES + "SELECT p AS point_id, 'Point' AS kind, round(lon, 9) AS lon, round(lat, 9) AS lat, NOT p SIMILAR TO '[0-9]+' AS is_benchmark FROM pl")
def geojson_points(spark, sf):
    g = X.geojson_points(_ends(spark, sf), X.schematic_coordinates(_ends(spark, sf)))
    return _round(g.select("point_id", _field("geometry.type").alias("kind"), _field("geometry.coordinates[0]", "double").alias("lon"), _field("geometry.coordinates[1]", "double").alias("lat"), _field("properties.is_benchmark", "boolean").alias("is_benchmark")), "lon", "lat")


@query("""SELECT line_id, format('SELECT {0} as id, ''L{0}'' as filename, ''{1}'' as start_point, ''{2}'' as end_point, ''{3}'' as method, {4:.4f} as distance_m, {5:.5f} as height_diff_m, {6} as num_setups', line_id, start_point, end_point, method, distance, height_diff, n_setups) AS part
  FROM lines JOIN totals USING (line_id) WHERE is_used""")
def qgis_lines(spark, sf):
    return X.layer_selects(_rez_lines(spark, sf))


@query(_PLACES + """SELECT p AS point_id, format('SELECT ''{}'' as point_id, ''{}'' as kind, 0.000000000 as height, make_point({:.9f}, {:.9f}) as geometry', p, CASE WHEN p SIMILAR TO '[0-9]+' THEN 'turning_point' ELSE 'benchmark' END, lon, lat) AS part FROM pl""")
def qgis_points(spark, sf):
    return X.point_selects(_ends(spark, sf), X.schematic_coordinates(_ends(spark, sf)))


@query(_RANKED + """, o AS (SELECT *, 0.003 * sqrt(km) AS allowed FROM v)
  SELECT 3 AS section, format('{}{:3}  {:8}{:12.3f}', repeat(' ', 42), rank, p, CASE WHEN is_fixed THEN height ELSE 0.0::DOUBLE END) AS line FROM r
  UNION ALL SELECT 5, format('      {:8}{:8}{:12.5f}{:8.0f}.', from_pt::VARCHAR, to_pt::VARCHAR, dh, km * 1000) || CASE WHEN abs(round(v, 9)) <= allowed THEN '  ' ELSE '**' END FROM o
  UNION ALL SELECT 7, format('                   SDIST(KM)={:9.3f}   SDIF(MM)={:12.1f}   COEFF_CLASS K={:10.1f}', total_km, total_mm, total_mm / sqrt(total_km)) FROM st
  UNION ALL SELECT 11, CASE WHEN is_fixed THEN format('{}{:3} {:8}{:12.5f}', repeat(' ', 30), rank, p, height) ELSE format('{}{:3} {:8}{:12.5f}{:12.5f}{:12.5f}', repeat(' ', 30), rank, p, round(height, 8), 0.0::DOUBLE, round(height, 8)) END FROM r""")
def export_fa1(spark, sf):
    obs, h = _adjusted(spark, sf)
    h, res, stats = _eased(obs, h)
    res = res.withColumn("v_mm", F.round("v_mm", 6))
    own = obs.select("obs_seq", F.col("from_pt").cast("string").alias("from_point"), F.col("to_pt").cast("string").alias("to_point"), "height_diff", "distance")
    rows = X.fa1(own, res, h, stats)
    # of a residual's row the columns up to the distance and the mark; of a free height's row all but the mean error
    line = F.when(F.col("section") == 5, F.concat(F.substring("line", 1, 43), F.substring("line", 82, 2))).when((F.col("section") == 11) & (F.length("line") > 60), F.substr("line", F.lit(1), F.length("line") - 12)).otherwise(F.rtrim(F.replace("line", F.lit("\n"), F.lit(""))))
    return rows.filter("section in (3, 5, 7, 11)").select("section", line.alias("line"))

"""Registered queries of files, exports, merging, points, projects and conditions, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.settings import EngineConfig
from ..operators import leveling as L
from ..operators import merging as M
from ..operators import network as N
from ..operators import points as P
from ..sinks import exports as X
from ..sources import derived as D
from ..sources import instruments as I
from ..sources import projects as J
from .queries import _RES, _STATS, _VALID, RINGS, _adjusted, _fixed, _round, query

_STATIONS = """, stations AS (SELECT s.*, concat('L', s.line_id) AS filename, start_point, end_point, method, n_setups, distance, t.height_diff AS total_dh,
    CASE WHEN setup_number = 1 THEN start_point ELSE CAST(setup_number - 1 AS VARCHAR) END AS from_point,
    CASE WHEN setup_number = n_setups THEN end_point ELSE CAST(setup_number AS VARCHAR) END AS to_point
    FROM setups s JOIN lines USING (line_id) JOIN totals t USING (line_id))
"""
_SETUPS = _STATIONS + """SELECT filename, setup_number::INT AS setup_number, from_point, to_point, backsight::DOUBLE AS backsight, foresight::DOUBLE AS foresight,
  dist_back::DOUBLE AS dist_back, dist_fore::DOUBLE AS dist_fore, height_diff::DOUBLE AS height_diff FROM stations"""


def _parsed(setups):
    num = ("backsight", "foresight", "dist_back", "dist_fore", "height_diff")
    return setups.select(I.stem(F.col("path")).alias("filename"), "setup_number", "from_point", "to_point", *(F.col(c).cast("double").alias(c) for c in num))


@query(_SETUPS)
def parse_trimble(spark, sf):
    return _parsed(I.parse_trimble(I.render_trimble(D.stations(spark, sf)))[0])


@query(_SETUPS)
def parse_leica(spark, sf):
    return _parsed(I.parse_leica(I.render_gsi(D.stations(spark, sf)))[0])


@query(_STATIONS + """SELECT DISTINCT filename, start_point, end_point, method, n_setups, round(distance, 9) AS total_distance, round(total_dh, 9) + 0.0 AS total_height_diff,
  CASE WHEN end_point SIMILAR TO '[0-9]+' THEN 'invalid_endpoint' ELSE 'valid' END AS status FROM stations""")
def parse_trimble_lines(spark, sf):
    return _round(I.parse_trimble(I.render_trimble(D.stations(spark, sf)))[1].drop("path"), "total_distance", "total_height_diff")


@query(_STATIONS + """, fe AS (SELECT DISTINCT filename, start_point, CASE WHEN end_point <> '0' THEN end_point WHEN n_setups > 1 THEN CAST(n_setups - 1 AS VARCHAR) ELSE start_point END AS end_point,
    n_setups, distance, total_dh FROM stations)
  SELECT filename, start_point, end_point, 'BF' AS method, n_setups, round(distance, 9) AS total_distance, round(total_dh, 9) + 0.0 AS total_height_diff,
    CASE WHEN end_point SIMILAR TO '[0-9]+' THEN 'invalid_endpoint' ELSE 'valid' END AS status FROM fe""")
def parse_leica_lines(spark, sf):
    return _round(I.parse_leica(I.render_gsi(D.stations(spark, sf)))[1].drop("path"), "total_distance", "total_height_diff")


@query(_STATIONS + "SELECT f AS format, count(DISTINCT line_id) AS n FROM stations, (VALUES ('trimble_dat'), ('leica_gsi')) v(f) GROUP BY 1")
def detect_format(spark, sf):
    s = D.stations(spark, sf)
    files = I.render_trimble(s).unionByName(I.render_gsi(s))
    return files.groupBy(I.detect_format(F.col("path"), F.col("text")).alias("format")).agg(F.count(F.lit(1)).alias("n"))


def _observations(spark, sf):
    return X.observations(D.lines(spark, sf), L.line_totals(D.setups(spark, sf)))


_OBS = """, obs AS (SELECT line_id, start_point AS from_point, end_point AS to_point, height_diff, distance, n_setups, strftime(o_orderdate, '%m%y') AS ym, concat('L', line_id) AS src, is_used, method
    FROM lines JOIN totals USING (line_id) JOIN orders ON o_orderkey = line_id)
"""


@query(_OBS + "SELECT line_id AS obs_seq, from_point, to_point, round(height_diff, 9) + 0.0 AS height_diff, round(distance, 9) AS distance, n_setups AS num_setups, ym AS year_month, src AS source_file FROM obs")
def measurement_summary(spark, sf):
    return _round(_observations(spark, sf), "height_diff", "distance").drop("bf_diff", "is_used")


@query(_OBS + """SELECT line_id, format('{:<8}{:<8}{:12.5f}{:7.0f}.{:4}{:7.2f}   {:<3}           {} {}', from_point, to_point, height_diff, distance, n_setups, 0.0::DOUBLE, ym, src,
  CASE WHEN line_id = max(line_id) OVER () THEN '9' ELSE '0' END) AS line FROM obs""")
def export_fteg(spark, sf):
    return X.fteg(_observations(spark, sf)).select(F.col("seq").cast("long").alias("line_id"), "line")


@query(_OBS + """, free AS (SELECT from_point AS p FROM obs WHERE is_used UNION SELECT to_point FROM obs WHERE is_used), f AS (SELECT p FROM free WHERE p NOT IN (SELECT point_id FROM benchmarks))
  SELECT 0 AS section, format('  {}   2            {:<40}9', (SELECT count(*) FROM benchmarks) + (SELECT count(*) FROM f), 'project.rez') AS line
  UNION ALL SELECT 1, format('    {:<8}{:12.3f}', point_id, height) FROM benchmarks UNION ALL SELECT 2, format('    {:<8}           .', p) FROM f
  UNION ALL SELECT 3, format('{:<8}{:<8}{:12.5f}{:7.0f}.{:4}{:7.2f}  {:<4}           {}', from_point, to_point, height_diff, distance, n_setups, 0.0::DOUBLE, ym, src) FROM obs WHERE is_used
  UNION ALL SELECT 4, ' 9'""")
def export_fa0(spark, sf):
    return X.fa0(_observations(spark, sf), D.benchmarks(spark, sf)).drop("seq")


def _rez_lines(spark, sf):
    return D.lines(spark, sf).join(L.line_totals(D.setups(spark, sf)), "line_id").withColumns({"status": F.lit("valid"), "filename": F.concat(F.lit("L"), F.col("line_id").cast("string"))})


@query(_OBS + "SELECT line_id, format('{:<12}{:<12}{:>14.5f}{:>12.2f}{:>8}{:>12}  {:<30}', from_point, to_point, height_diff, distance, n_setups, 'OK', src) AS line FROM obs WHERE is_used")
def export_rez(spark, sf):
    return X.rez(_rez_lines(spark, sf)).select(F.col("seq").cast("long").alias("line_id"), "line")


@query("SELECT point_id, 0.0::DOUBLE AS height FROM (SELECT start_point AS point_id FROM lines UNION SELECT end_point FROM lines) WHERE point_id SIMILAR TO '.*[A-Za-z].*'")
def benchmarks_from_lines(spark, sf):
    return X.benchmarks_from_lines(D.lines(spark, sf)).select("point_id", "height")


def _ends(spark, sf):
    return D.lines(spark, sf).select(F.explode(F.array("start_point", "end_point")).alias("point_id"))


@query("""SELECT p AS point_id, round(34.8 + 0.01 * cos(2 * pi() * (row_number() OVER (ORDER BY p) - 1) / count(*) OVER ()), 9) AS lon,
  round(31.5 + 0.01 * sin(2 * pi() * (row_number() OVER (ORDER BY p) - 1) / count(*) OVER ()), 9) AS lat FROM (SELECT start_point AS p FROM lines UNION SELECT end_point FROM lines)""")
def schematic_coords(spark, sf):
    return _round(X.schematic_coordinates(_ends(spark, sf)), "lon", "lat").drop("height")


@query(_STATIONS + """, h AS (SELECT line_id, to_point AS point, setup_number, start_height + sum(CAST(s.height_diff AS DOUBLE) - misclosure_mm / 1000 * (CAST(dist_back + dist_fore AS DOUBLE) / 2 / s.distance))
    OVER (PARTITION BY line_id ORDER BY setup_number) AS height FROM stations s JOIN (SELECT line_id, misclosure_mm, start_height FROM mis) USING (line_id))
  SELECT line_id, point, round(arg_max(height, setup_number) + 1.3e-9, 8) AS height FROM h GROUP BY 1, 2""")
def intermediate_heights(spark, sf):
    out = L.intermediate_heights(L.line_adjust(D.stations(spark, sf), D.lines(spark, sf), D.benchmarks(spark, sf)))
    return _round(out.withColumn("height", F.col("height") + F.lit(1.3e-9)), "height", digits=8)  # off the ties, which sums in another order break


@query("SELECT line_id, round((height_diff - height_diff * -0.9) / 2, 9) + 0.0 AS mean_dh, round((height_diff + height_diff * -0.9) * 1000, 6) + 0.0 AS bf_diff, abs(round((height_diff + height_diff * -0.9) * 1000, 6)) <= 2 AS consistent FROM totals")
def merge_bf(spark, sf):
    t = L.line_totals(D.setups(spark, sf)).select("line_id", F.col("height_diff").alias("fwd"), (F.col("height_diff") * F.lit(-0.9)).alias("bwd"))
    return _round(L.bf_pairs(t, 2.0).drop("fwd", "bwd"), "mean_dh", "bf_diff")


@query(_VALID + """, u AS (SELECT avg(distance) > 1000 AS km FROM totals)
  SELECT line_id, valid, CASE WHEN NOT endpoint_ok THEN 'endpoint' WHEN NOT method_ok THEN 'method' WHEN NOT complete THEN 'incomplete' WHEN NOT length_ok THEN 'length' WHEN NOT sights_ok THEN 'sights'
    WHEN NOT balance_ok THEN 'balance' ELSE '' END AS primary_failure, round(CASE WHEN km THEN distance / 1000 ELSE distance END, 9) AS distance, CASE WHEN km THEN 'km' ELSE 'm' END AS unit, round(height_diff, 9) + 0.0 AS height_diff
  FROM w LEFT JOIN totals USING (line_id) CROSS JOIN u""")
def validation_table(spark, sf):
    s = D.setups(spark, sf)
    return _round(L.validation_table(L.validate(D.lines(spark, sf), s), L.line_totals(s)), "distance", "height_diff").drop("messages")


_FILES = """CASE WHEN line_id % 7 = 0 THEN concat(end_point, '-', start_point, '.DAT') WHEN line_id % 7 = 1 THEN concat(start_point, '_', end_point, '.x.dat') ELSE concat('L', line_id) END"""
_JUDGED = _VALID + f""", f AS (SELECT *, {_FILES} AS filename FROM lines LEFT JOIN per USING (line_id)),
  m AS (SELECT f.*, effective_class, w.endpoint, w.n_setups, endpoint_ok, complete, length_ok, sights_ok, method_ok, balance_ok, misclosure_mm, CASE WHEN effective_class = 4 THEN 20 ELSE 10 END * sqrt(coalesce(d, 0) / 1000) AS tol,
    NOT (line_id % 7 = 0) OR start_point = '' AS named FROM f JOIN w USING (line_id) LEFT JOIN (SELECT line_id, misclosure_mm FROM mis) USING (line_id)),
  j AS (SELECT *, named OR start_point = end_point AND false AS naming_ok, coalesce(abs(misclosure_mm) <= tol, true) AS tolerance_ok FROM m)
"""


def _judged(spark, sf):
    ln, i = D.lines(spark, sf), F.col("line_id") % 7
    name = F.when(i == 0, F.concat("end_point", F.lit("-"), "start_point", F.lit(".DAT"))).when(i == 1, F.concat("start_point", F.lit("_"), "end_point", F.lit(".x.dat"))).otherwise(F.concat(F.lit("L"), F.col("line_id").cast("string")))
    return L.validate(ln.withColumn("filename", name), D.setups(spark, sf), benchmarks=D.benchmarks(spark, sf))


@query(_JUDGED + "SELECT line_id, naming_ok AND NOT (line_id % 7 = 1 AND start_point = end_point) AS naming_ok FROM j")
def v_naming(spark, sf):
    return _judged(spark, sf).select("line_id", "naming_ok")


@query(_JUDGED + "SELECT line_id, misclosure_mm + 0.0 AS misclosure_mm, round(tol, 9) AS tolerance_mm, tolerance_ok FROM j")
def v_tolerance(spark, sf):
    return _round(_judged(spark, sf).select("line_id", "misclosure_mm", "tolerance_mm", "tolerance_ok"), "misclosure_mm", "tolerance_mm")


@query(_JUDGED + """, k AS (SELECT line_id, string_agg(format('Setup {}: distance imbalance {:.2f} m exceeds limit {:.1f} m', setup_number, abs(dist_back - dist_fore)::DOUBLE, lim), '; ' ORDER BY setup_number) AS uneven
    FROM setups JOIN (SELECT line_id, CASE WHEN effective_class = 4 THEN 5.0::DOUBLE ELSE 2.0::DOUBLE END AS lim FROM j) USING (line_id) WHERE abs(dist_back - dist_fore) > lim GROUP BY 1),
  sg AS (SELECT line_id, string_agg(concat_ws('; ', CASE WHEN dist_back > 50 THEN format('Setup {} backsight: {:.2f} m exceeds limit 50.0 m', setup_number, dist_back::DOUBLE) END,
    CASE WHEN dist_fore > 50 THEN format('Setup {} foresight: {:.2f} m exceeds limit 50.0 m', setup_number, dist_fore::DOUBLE) END), '; ' ORDER BY setup_number) AS sights FROM setups WHERE dist_back > 50 OR dist_fore > 50 GROUP BY 1)
  SELECT line_id, concat_ws('; ', CASE WHEN endpoint = 'turning_point' THEN concat('End point ', end_point, ' is a turning point') END,
    CASE WHEN NOT (naming_ok AND NOT (line_id % 7 = 1 AND start_point = end_point)) THEN concat('File name ', filename, ' has the ends the other way round') END,
    CASE WHEN NOT complete THEN 'No setups' END, CASE WHEN NOT length_ok THEN format('Length {:.2f} km exceeds limit 24.0 km', d / 1000) END, sights,
    CASE WHEN NOT method_ok THEN concat('Class H3 requires BFFB, not ', method) END, uneven,
    CASE WHEN imb > 10 THEN format('Cumulative distance imbalance {:.2f} m exceeds limit 10.0 m', imb::DOUBLE) END,
    CASE WHEN NOT tolerance_ok THEN format('Misclosure {:.2f} mm exceeds tolerance {:.2f} mm (class H{})', abs(misclosure_mm), tol, effective_class) END) AS errors,
  concat_ws('; ', CASE WHEN complete AND n_setups < 2 THEN format('Only {} setups, 2 expected', n_setups) END, CASE WHEN effective_class = 4 THEN 'Method BF: judged as class H4' END) AS warnings
  FROM j LEFT JOIN k USING (line_id) LEFT JOIN sg USING (line_id)""")
def validation_messages(spark, sf):
    return _judged(spark, sf).select("line_id", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"))


@query(_JUDGED + """SELECT CASE WHEN NOT tolerance_ok THEN 'exceeded_tolerance' WHEN NOT complete THEN 'incomplete' WHEN NOT (naming_ok AND NOT (line_id % 7 = 1 AND start_point = end_point)) THEN 'naming_error'
  WHEN NOT endpoint_ok THEN 'invalid_endpoint' ELSE 'valid' END AS status, count(*) AS n FROM j GROUP BY 1""")
def line_status(spark, sf):
    return L.line_status(_judged(spark, sf)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l.line_id, l.start_point, l.end_point, round(t.height_diff, 9) + 0.0 AS computed_dh, round(e.height - s.height, 9) + 0.0 AS known_dh, round((t.height_diff - (e.height - s.height)) * 1000, 6) + 0.0 AS misclosure_mm,
  round(3 * sqrt(distance / 1000), 9) AS tolerance_mm, abs(round((t.height_diff - (e.height - s.height)) * 1000, 6)) <= 3 * sqrt(distance / 1000) AS within, CASE WHEN e.height IS NULL OR s.height IS NULL THEN 'endpoint_mismatch' ELSE 'ok' END AS status
  FROM lines l JOIN totals t USING (line_id) LEFT JOIN benchmarks s ON s.point_id = start_point LEFT JOIN benchmarks e ON e.point_id = end_point""")
def line_info(spark, sf):
    i = L.line_info(D.lines(spark, sf), L.line_totals(D.setups(spark, sf)), D.benchmarks(spark, sf)).drop("adjusted_dh")
    return _round(i, "computed_dh", "known_dh", "misclosure_mm", "tolerance_mm")


@query(_STATIONS + """SELECT point, count(DISTINCT line_id) AS n_lines FROM (SELECT line_id, start_point AS point FROM lines UNION ALL SELECT line_id, end_point FROM lines
  UNION ALL SELECT line_id, from_point FROM stations UNION ALL SELECT line_id, to_point FROM stations) GROUP BY 1""")
def point_usage(spark, sf):
    return P.point_usage(D.lines(spark, sf), D.stations(spark, sf))


@query("SELECT line_id, is_used AND NOT (start_point IN ('N03B', 'N07B') OR end_point IN ('N03B', 'N07B')) AS is_used FROM lines")
def point_exclude(spark, sf):
    chosen = spark.createDataFrame([("N03B",), ("N07B",)], "point string")
    return P.set_used(D.lines(spark, sf), chosen, False).select("line_id", "is_used")


@query("SELECT p AS point FROM (SELECT start_point AS p FROM lines UNION SELECT end_point FROM lines) WHERE p LIKE '%1%B%'")
def point_search(spark, sf):
    return P.auto_benchmarks(P.search(_ends(spark, sf).distinct().select(F.col("point_id").alias("point")), "1"))


@query("SELECT start_point AS project, count(*) AS n_lines, count_if(is_used)::BIGINT AS n_used, round(sum(distance), 6) AS total_distance FROM lines JOIN totals USING (line_id) GROUP BY 1")
def list_projects(spark, sf):
    t = D.lines(spark, sf).join(L.line_totals(D.setups(spark, sf)), "line_id").withColumns({"project": F.col("start_point"), "total_distance": F.col("distance")})
    return _round(J.list_projects(t), "total_distance", digits=6)


@query("SELECT point_id, CASE WHEN point_id < 'N12B' THEN 0 ELSE 1 END AS project_seq, round(CASE WHEN point_id < 'N12B' THEN height ELSE height + 1 END, 6) AS height FROM benchmarks")
def joint_project(spark, sf):
    b = D.benchmarks(spark, sf).select("point_id", F.col("height").cast("double").alias("height"))
    one = b.filter("point_id < 'N12B'").withColumn("project_seq", F.lit(0))
    return _round(J.joint_benchmarks(one.unionByName(b.withColumns({"height": F.col("height") + 1, "project_seq": F.lit(1)}))), "height", digits=6)


@query("""SELECT * FROM (VALUES (1, 'H1', 3.0::DOUBLE, NULL::DOUBLE, 'BFFB'), (2, 'H2', 5, 60, 'BFFB'), (3, 'H3', 10, 24, 'BFFB'), (4, 'H4', 20, 10, 'BF'), (5, 'H5', 30, 5, 'BF'), (6, 'H6', 60, 4, 'BF'))
  t(class_level, class_name, tolerance_coefficient, max_line_length_km, required_method)""")
def class_params(spark, sf):
    return EngineConfig().table(spark).select("class_level", "class_name", "tolerance_coefficient", "max_line_length_km", "required_method")


def _network_lines(spark, sf):
    return D.network(spark, sf).select(F.col("obs_seq").alias("line_id"), F.col("from_pt").cast("string").alias("start_point"), F.col("to_pt").cast("string").alias("end_point"), F.lit(True).alias("is_used"))


@query("""SELECT min(obs_seq) AS chain_id, string_agg(obs_seq, ',' ORDER BY obs_seq) AS line_ids, 'false,false,false,false,false,false' AS reversed,
  concat_ws(',', region * 5 + 1, region * 5 + 2, region * 5 + 3, region * 5 + 4, region * 5) AS common_nodes FROM network GROUP BY region
  UNION ALL SELECT region * 6 + 1, concat_ws(',', region * 6 + 1, region * 6 + 2, region * 6 + 3, region * 6 + 4, region * 6), 'false,false,false,false,false',
  concat_ws(',', region * 5 + 2, region * 5 + 3, region * 5 + 4, region * 5) FROM network GROUP BY region""")
def merge_candidates(spark, sf):
    return M.merge_candidates(_network_lines(spark, sf)).withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("line_ids", "reversed", "common_nodes")})


@query("""SELECT count(*) AS n_edges, count(DISTINCT from_pt) AS n_points, count(DISTINCT region) AS n_components, count(*) - count(DISTINCT from_pt) + count(DISTINCT region) AS loop_rank,
  sum(distance)::DOUBLE AS total_distance FROM network""")
def network_summary(spark, sf):
    return N.network_summary(D.network(spark, sf))


_BASIS = """, basis AS (SELECT region * 5 AS component, region * 6 + 1 AS loop_id, obs_seq, CASE WHEN seq = 5 THEN -1 ELSE 1 END AS sign FROM network WHERE seq IN (0, 1, 5)
  UNION ALL SELECT region * 5, region * 6 + 3, obs_seq, 1 FROM network WHERE seq IN (2, 3, 4, 5))
"""


@query(_BASIS + "SELECT component, loop_id, obs_seq, sign::INT AS sign FROM basis")
def basis_loops(spark, sf):
    return N.basis_loops(D.network(spark, sf))


@query(_BASIS + """, g AS (SELECT loop_id, count(*) AS n_edges, round(sum(sign * height_diff)::DOUBLE * 1000, 6) + 0.0 AS misclosure_mm, sum(distance)::DOUBLE AS distance FROM basis JOIN network USING (obs_seq) GROUP BY 1)
  SELECT loop_id, n_edges, misclosure_mm, distance, round(10 * sqrt(distance / 1000), 9) AS tolerance_mm, abs(misclosure_mm) <= 10 * sqrt(distance / 1000) AS within,
  CASE WHEN abs(misclosure_mm) <= 3 * sqrt(distance / 1000) THEN 1 WHEN abs(misclosure_mm) <= 5 * sqrt(distance / 1000) THEN 2 WHEN abs(misclosure_mm) <= 10 * sqrt(distance / 1000) THEN 3
    WHEN abs(misclosure_mm) <= 20 * sqrt(distance / 1000) THEN 4 WHEN abs(misclosure_mm) <= 30 * sqrt(distance / 1000) THEN 5 ELSE 6 END AS achieved_class FROM g""")
def loop_misclosure(spark, sf):
    obs = D.network(spark, sf)
    return _round(N.loop_misclosure(obs, N.basis_loops(obs)), "misclosure_mm", "tolerance_mm")


@query(RINGS + "SELECT obs_seq, region * 5 AS component, round(v * 1000 + 1.3e-8, 6) + 0.0 AS v_mm, round(dh + v, 8) + 0.0 AS adjusted_dh, round(sigma0, 8) + 0.0 AS sigma0 FROM v")
def lsa_conditional(spark, sf):
    obs = D.network(spark, sf)
    c = N.conditional(obs, N.basis_loops(obs)).withColumn("v_mm", F.col("v_mm") + F.lit(1.3e-8))
    return _round(_round(c, "v_mm", digits=6), "adjusted_dh", "sigma0", digits=8)


@query(RINGS + "SELECT point, round(height + 1.3e-10, 8) AS height, is_fixed FROM hts")
def heights_from_conditions(spark, sf):
    obs = D.network(spark, sf)
    h = N.heights_from_adjusted(obs, N.conditional(obs, N.basis_loops(obs)), _fixed(spark, sf))
    return _round(h.withColumn("height", F.col("height") + F.lit(1.3e-10)), "height", digits=8).select("point", "height", "is_fixed")


@query(RINGS + """, e AS (SELECT min(v) * 1000 AS lo, max(v) * 1000 AS hi FROM v)
  SELECT least(20, floor((v * 1000 - lo) / (hi - lo) * 20) + 1)::INT AS bin, count(*) AS n FROM v CROSS JOIN e GROUP BY 1""")
def residual_histogram(spark, sf):
    return N.residual_histogram(N.residuals(*_adjusted(spark, sf)))


@query(RINGS + "SELECT concat(from_pt, '-', to_pt) AS key, round(v * 1000 + 1.3e-8, 6) + 0.0 AS v_mm FROM v")
def residual_map(spark, sf):
    obs, h = _adjusted(spark, sf)
    return _round(N.residual_map(obs, N.residuals(obs, h).withColumn("v_mm", F.col("v_mm") + F.lit(1.3e-8))), "v_mm", digits=6)

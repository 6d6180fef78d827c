"""Registered queries of the leveling operators and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import regulations as R
from ..operators import leveling as L
from ..operators import network as N
from ..sources import derived as D

Query = Callable[[SparkSession, str], DataFrame]
OUT: dict[str, Query] = {}
SQL: dict[str, str] = {}

VIEWS = """
WITH setups AS (
  SELECT l_orderkey AS line_id, row_number() OVER (PARTITION BY l_orderkey
      ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) AS setup_number,
    CAST(1.2 + l_discount * 5 AS DECIMAL(12,5)) AS backsight,
    CAST(1.2 + l_discount * 5 - (l_discount - l_tax - 0.01) * 0.1 AS DECIMAL(12,5)) AS foresight,
    CAST(l_quantity + 5 AS DECIMAL(12,3)) AS dist_back,
    CAST(l_quantity + 5 + (l_partkey % 7 - 3) * 0.5 AS DECIMAL(12,3)) AS dist_fore,
    backsight - foresight AS height_diff
  FROM lineitem),
lines AS (
  SELECT o_orderkey AS line_id, concat('N', lpad(CAST(c_nationkey AS VARCHAR), 2, '0'), 'B') AS start_point,
    CASE WHEN o_orderkey % 11 = 0 THEN CAST((o_orderkey * 7 + 3) % 25 AS VARCHAR)
      ELSE concat('N', lpad(CAST((o_orderkey * 7 + 3) % 25 AS VARCHAR), 2, '0'), 'B') END AS end_point,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'BFFB' WHEN o_orderpriority = '5-LOW' THEN 'FB' ELSE 'BF' END AS method,
    o_orderstatus <> 'P' AS is_used
  FROM orders JOIN customer ON o_custkey = c_custkey),
benchmarks AS (
  SELECT concat('N', lpad(CAST(n_nationkey AS VARCHAR), 2, '0'), 'B') AS point_id,
    CAST(CAST(100 + n_nationkey * 0.002 AS DECIMAL(12,3)) AS DOUBLE) AS height FROM nation),
totals AS (
  SELECT line_id, count(*) AS n_setups, CAST(sum(dist_back + dist_fore) AS DOUBLE) / 2 AS distance,
    CAST(sum(height_diff) AS DOUBLE) AS height_diff FROM setups GROUP BY line_id),
mis AS (
  SELECT l.*, t.n_setups, t.distance, t.height_diff, s.height AS start_height, e.height AS end_height,
    round((t.height_diff - (e.height - s.height)) * 1000, 6) AS misclosure_mm
  FROM lines l JOIN totals t USING (line_id) JOIN benchmarks s ON s.point_id = start_point JOIN benchmarks e ON e.point_id = end_point),
ends AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey // 6 AS region, o_orderkey % 6 AS seq,
    CASE WHEN o_orderkey % 6 = 5 THEN 0 ELSE o_orderkey % 6 END AS a, CASE WHEN o_orderkey % 6 = 5 THEN 2 ELSE (o_orderkey % 6 + 1) % 5 END AS b FROM orders),
network AS (SELECT k AS obs_seq, region, seq, region * 5 + a AS from_pt, region * 5 + b AS to_pt,
    CAST((b - a) * 0.25 + ((k * 13 + c * 7) % 11 - 5) * 0.001 AS DECIMAL(12,5)) AS height_diff, CAST(500 + (k * 31 + c * 17) % 40 * 50 AS DECIMAL(12,3)) AS distance FROM ends)
"""
#: a ring with its chord has two loops, so its conditions are two equations, solved here in closed form
RINGS = """, d AS (SELECT region, seq, CAST(height_diff AS DOUBLE) AS h, CAST(distance AS DOUBLE) / 1000 AS km FROM network),
w AS (SELECT region, max(h) FILTER (seq = 0) h0, max(h) FILTER (seq = 1) h1, max(h) FILTER (seq = 2) h2, max(h) FILTER (seq = 3) h3, max(h) FILTER (seq = 4) h4, max(h) FILTER (seq = 5) h5,
    max(km) FILTER (seq = 0) k0, max(km) FILTER (seq = 1) k1, max(km) FILTER (seq = 2) k2, max(km) FILTER (seq = 3) k3, max(km) FILTER (seq = 4) k4, max(km) FILTER (seq = 5) k5 FROM d GROUP BY 1),
n AS (SELECT *, h0 + h1 - h5 AS wa, h5 + h2 + h3 + h4 AS wb, k0 + k1 + k5 AS naa, -k5 AS nab, k2 + k3 + k4 + k5 AS nbb FROM w),
x AS (SELECT *, naa * nbb - nab * nab AS det, -(nbb * wa - nab * wb) / det AS x, -(naa * wb - nab * wa) / det AS y, sqrt(greatest(-(x * wa + y * wb), 0) / 2) AS sigma0 FROM n),
v AS (SELECT e.obs_seq, e.from_pt, e.to_pt, x.region, seq, CAST(height_diff AS DOUBLE) AS dh, sigma0,
    CAST(distance AS DOUBLE) / 1000 AS km, km * CASE WHEN seq < 2 THEN x WHEN seq = 5 THEN y - x ELSE y END AS v FROM network e JOIN x USING (region)),
p AS (SELECT region, sigma0, unnest([0, 1, 2, 3, 4]) AS p, unnest([0, h0 + k0 * x, h5 + k5 * (y - x), h5 + k5 * (y - x) + h2 + k2 * y, -h4 - k4 * y]) AS h,
    unnest([0, k0, -k5, -k5, 0]) AS fa, unnest([0, 0, k5, k5 + k2, -k4]) AS fb, unnest([0, k0, k5, k5 + k2, k4]) AS q, naa, nab, nbb, det FROM x),
hts AS (SELECT region * 5 + p AS point, region * 5 AS component, 100 + h AS height, p = 0 AS is_fixed, sigma0,
    sigma0 * sqrt(greatest(q - (nbb * fa * fa - 2 * nab * fa * fb + naa * fb * fb) / det, 0)) AS mse FROM p)
"""
_TOL = "3 5 10 20 30 60".split()


def _achieved(mm: str, d: str) -> str:
    return "CASE " + " ".join(f"WHEN abs({mm}) <= {k} * sqrt({d} / 1000) THEN {i}" for i, k in enumerate(_TOL, 1)) + " ELSE 6 END"


def _round(df: DataFrame, *cols: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in cols})


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        OUT[f.__name__] = f
        if sql:
            SQL[f.__name__] = VIEWS + sql
        return f

    return add


@query("SELECT line_id, n_setups, round(distance, 9) AS distance, round(height_diff, 9) AS height_diff FROM totals")
def line_totals(spark, sf):
    return _round(L.line_totals(D.setups(spark, sf)), "distance", "height_diff")


def _misclosure(spark, sf):
    return L.misclosure(D.lines(spark, sf), L.line_totals(D.setups(spark, sf)), D.benchmarks(spark, sf))


@query(f"SELECT line_id, start_point, end_point, misclosure_mm + 0.0 AS misclosure_mm, round(10 * sqrt(distance / 1000), 9) AS tolerance_mm, abs(misclosure_mm) <= 10 * sqrt(distance / 1000) AS within, {_achieved('misclosure_mm', 'distance')} AS achieved_class FROM mis")
def line_misclosure(spark, sf):
    return _round(_misclosure(spark, sf), "tolerance_mm", "misclosure_mm").select("line_id", "start_point", "end_point", "misclosure_mm", "tolerance_mm", "within", "achieved_class")


@query("SELECT line_id, round(3 * sqrt(distance / 1000), 9) AS legacy_3, round(6 * sqrt(distance / 1000), 9) AS legacy_4, round(3 * sqrt(distance / 1000), 9) AS new_1, round(60 * sqrt(distance / 1000), 9) AS new_6 FROM totals")
def tolerances(spark, sf):
    t, d = L.line_totals(D.setups(spark, sf)), F.col("distance")
    return _round(t.select("line_id", R.tolerance_legacy(d, F.lit(3)).alias("legacy_3"), R.tolerance_legacy(d, F.lit(4)).alias("legacy_4"), R.tolerance_new(d, F.lit(1)).alias("new_1"), R.tolerance_new(d, F.lit(6)).alias("new_6")), "legacy_3", "legacy_4", "new_1", "new_6")


def _distributed(spark, sf, method):
    closures = _misclosure(spark, sf).select("line_id", (F.col("misclosure_mm") / 1000).alias("misclosure"))
    return _round(L.distribute(D.setups(spark, sf), closures, method), "correction", digits=12).select("line_id", "setup_number", "correction")


@query("SELECT line_id, setup_number, round(-misclosure_mm / 1000 / n_setups, 12) + 0.0 AS correction FROM setups JOIN mis USING (line_id)")
def distribute_equal(spark, sf):
    return _distributed(spark, sf, "equal")


@query("SELECT line_id, setup_number, round(-misclosure_mm / 1000 * (CAST(dist_back + dist_fore AS DOUBLE) / 2 / distance), 12) + 0.0 AS correction FROM setups JOIN mis USING (line_id)")
def distribute_proportional(spark, sf):
    return _distributed(spark, sf, "proportional")


@query("""SELECT line_id, setup_number, round(start_height + sum(CAST(s.height_diff AS DOUBLE) - misclosure_mm / 1000 * (CAST(dist_back + dist_fore AS DOUBLE) / 2 / distance))
  OVER (PARTITION BY line_id ORDER BY setup_number), 10) AS height FROM setups s JOIN mis USING (line_id)""")
def line_adjust(spark, sf):
    return _round(L.line_adjust(D.setups(spark, sf), D.lines(spark, sf), D.benchmarks(spark, sf)), "height", digits=10).select("line_id", "setup_number", "height")


@query("""SELECT line_id, n_setups - setup_number + 1 AS setup_number, CAST(foresight AS DOUBLE) AS backsight, CAST(-s.height_diff AS DOUBLE) AS height_diff, end_point AS start_point,
  CASE method WHEN 'BF' THEN 'FB' WHEN 'FB' THEN 'BF' ELSE method END AS method FROM setups s JOIN lines USING (line_id) JOIN totals USING (line_id)""")
def toggle_direction(spark, sf):
    lines, setups = L.toggle_direction(D.lines(spark, sf), D.setups(spark, sf))
    return setups.join(lines, "line_id").select("line_id", F.col("setup_number").cast("long").alias("setup_number"), F.col("backsight").cast("double").alias("backsight"), F.col("height_diff").cast("double").alias("height_diff"), "start_point", "method")


@query("""SELECT least(start_point, end_point) AS from_point, greatest(start_point, end_point) AS to_point, count(*) AS num_runs,
  round(avg(CASE WHEN start_point < end_point THEN height_diff ELSE -height_diff END), 9) + 0.0 AS mean_dh,
  round((max(CASE WHEN start_point < end_point THEN height_diff ELSE -height_diff END) - min(CASE WHEN start_point < end_point THEN height_diff ELSE -height_diff END)) * 1000, 6) + 0.0 AS spread_mm
  FROM lines JOIN totals USING (line_id) WHERE start_point <> end_point GROUP BY 1, 2""")
def adjust_multiple_runs(spark, sf):
    return _round(_round(L.multiple_runs(D.lines(spark, sf), L.line_totals(D.setups(spark, sf))), "mean_dh"), "spread_mm", digits=6)


@query(f""", t AS (SELECT line_id, distance AS d, height_diff AS h, least(start_point, end_point) AS a, greatest(start_point, end_point) AS b,
    start_point = end_point AS own, start_point < end_point AS up FROM lines JOIN totals USING (line_id)),
  r AS (SELECT *, row_number() OVER (PARTITION BY a, b, up ORDER BY line_id) AS k FROM t),
  s AS (SELECT * REPLACE (CASE WHEN own THEN (k + 1) // 2 ELSE k END AS k), CASE WHEN own THEN k % 2 = 1 ELSE up END AS side FROM r),
  p AS (SELECT x.line_id AS l1, y.line_id AS l2, x.h AS h1, y.h AS h2, x.d + y.d AS dist, round((x.h + y.h) * 1000, 6) AS mm
    FROM s x JOIN s y ON x.a = y.a AND x.b = y.b AND x.k = y.k AND x.side AND NOT y.side)
  SELECT least(l1, l2) AS forward_id, greatest(l1, l2) AS return_id, mm + 0.0 AS misclosure_mm, round(CASE WHEN l1 < l2 THEN h1 - h2 ELSE h2 - h1 END / 2, 9) + 0.0 AS mean_dh,
    round(dist, 9) AS distance, {_achieved('mm', 'dist')} AS achieved_class, abs(mm) <= 10 * sqrt(dist / 1000) AS within FROM p""")
def double_runs(spark, sf):
    return _round(L.double_runs(D.lines(spark, sf), L.line_totals(D.setups(spark, sf))), "mean_dh", "distance", "misclosure_mm").drop("tolerance_mm")


_VALID = """, per AS (SELECT line_id, count(*) AS n, count_if(dist_back > 50) + count_if(dist_fore > 50) AS long_sights, count_if(abs(dist_back - dist_fore) > 2) AS u3,
    count_if(abs(dist_back - dist_fore) > 5) AS u4, abs(sum(dist_back - dist_fore)) AS imb, CAST(sum(dist_back + dist_fore) AS DOUBLE) / 2 AS d FROM setups GROUP BY 1),
  v AS (SELECT line_id, CASE WHEN end_point SIMILAR TO '[0-9]+' THEN 'turning_point' ELSE 'benchmark' END AS endpoint, CASE WHEN method = 'BF' THEN 4 ELSE 3 END AS effective_class,
    coalesce(n, 0) AS n_setups, CAST(coalesce(long_sights, 0) AS BIGINT) AS n_long_sights, n IS NOT NULL AS complete, coalesce(d, 0) / 1000 <= 24 AS length_ok, coalesce(long_sights, 0) = 0 AS sights_ok,
    method <> 'FB' AS method_ok, CASE WHEN n IS NULL THEN true WHEN method = 'BF' THEN u4 = 0 AND imb <= 10 ELSE u3 = 0 AND imb <= 10 END AS balance_ok
    FROM lines LEFT JOIN per USING (line_id)),
  w AS (SELECT *, endpoint <> 'turning_point' AS endpoint_ok, endpoint <> 'turning_point' AND complete AND length_ok AND sights_ok AND method_ok AND balance_ok AS valid FROM v)
"""


@query(_VALID + "SELECT line_id, endpoint, effective_class, n_setups, n_long_sights, endpoint_ok, complete, length_ok, sights_ok, method_ok, balance_ok, valid FROM w")
def validate_lines(spark, sf):
    v = L.validate(D.lines(spark, sf), D.setups(spark, sf))
    return v.select("line_id", "endpoint", "effective_class", "n_setups", "n_long_sights", "endpoint_ok", "complete", "length_ok", "sights_ok", "method_ok", "balance_ok", "valid")


@query(_VALID + """SELECT count(*) AS total, count_if(valid)::BIGINT AS valid, count_if(NOT endpoint_ok)::BIGINT AS endpoint_errors, count_if(NOT complete)::BIGINT AS incomplete, 0::BIGINT AS naming_errors, 0::BIGINT AS tolerance_errors, count_if(NOT length_ok)::BIGINT AS too_long,
  count_if(NOT sights_ok)::BIGINT AS long_sights, count_if(NOT method_ok)::BIGINT AS method_errors, count_if(NOT balance_ok)::BIGINT AS balance_errors, round(count_if(valid) / count(*), 9) AS pass_rate FROM w""")
def batch_summary(spark, sf):
    return _round(L.batch_summary(L.validate(D.lines(spark, sf), D.setups(spark, sf))), "pass_rate")


@query("""SELECT p AS point, CASE WHEN p SIMILAR TO '.*[A-Za-z].*' THEN true ELSE false END AS is_benchmark, p SIMILAR TO '[0-9]+' AS is_turning_point
  FROM (SELECT start_point AS p FROM lines UNION SELECT end_point FROM lines)""")
def all_points(spark, sf):
    ln = D.lines(spark, sf)
    p = ln.select(F.explode(F.array("start_point", "end_point")).alias("point")).distinct()
    return p.select("point", R.is_benchmark(F.col("point")).alias("is_benchmark"), R.is_turning_point(F.col("point")).alias("is_turning_point"))


@query("SELECT p AS point FROM (SELECT start_point AS p FROM lines UNION SELECT end_point FROM lines) WHERE p NOT IN (SELECT point_id FROM benchmarks)")
def unknown_points(spark, sf):
    ln = D.lines(spark, sf)
    p = ln.select(F.explode(F.array("start_point", "end_point")).alias("point")).distinct()
    return p.join(D.benchmarks(spark, sf), F.col("point") == F.col("point_id"), "left_anti")


@query("SELECT DISTINCT from_pt AS point, region * 5 AS component FROM network WHERE seq < 5")
def network_components(spark, sf):
    return N.components(D.network(spark, sf))


@query("SELECT count(*) AS n_edges, count(DISTINCT from_pt) AS n_points, count(DISTINCT region) AS n_components, count(*) - count(DISTINCT from_pt) + count(DISTINCT region) AS loop_rank FROM network")
def loop_rank(spark, sf):
    return N.loop_rank(D.network(spark, sf))


_LOOPS = VIEWS.replace("WITH setups", "WITH RECURSIVE setups") + """, d AS (SELECT obs_seq, from_pt AS a, to_pt AS b, CAST(height_diff AS DOUBLE) AS dh, CAST(distance AS DOUBLE) AS km FROM network
    UNION ALL SELECT obs_seq, to_pt, from_pt, -CAST(height_diff AS DOUBLE), CAST(distance AS DOUBLE) FROM network),
  w AS (SELECT a AS start, b AS "at", [b] AS pts, [obs_seq] AS seqs, dh, km FROM d WHERE b > a
    UNION ALL SELECT start, d.b, list_append(pts, d.b), list_append(seqs, obs_seq), w.dh + d.dh, w.km + d.km FROM w JOIN d ON w."at" = d.a
    WHERE w."at" <> start AND d.b >= start AND NOT list_contains(seqs, obs_seq) AND NOT list_contains(pts, d.b)),
  o AS (SELECT list_sort(seqs) AS s, max(dh) AS dh, max(km) AS distance FROM w WHERE w."at" = start AND len(seqs) >= 3 GROUP BY 1)
  SELECT array_to_string(s, ',') AS loop, CAST(len(s) AS INT) AS n_edges, round(dh * 1000, 6) + 0.0 AS misclosure_mm, distance, round(10 * sqrt(distance / 1000), 9) AS tolerance_mm,
    abs(round(dh * 1000, 6)) <= 10 * sqrt(distance / 1000) AS within FROM o"""


@query()
def find_all_loops(spark, sf):
    return _round(N.loops(D.network(spark, sf)), "misclosure_mm", "tolerance_mm", "distance")


SQL["find_all_loops"] = _LOOPS


def _fixed(spark, sf):
    n = D.network(spark, sf)
    return n.groupBy("region").agg(F.min("from_pt").alias("point")).select("point", F.lit(100.0).alias("height"))


def _adjusted(spark, sf):
    obs = D.network(spark, sf)
    return obs, N.least_squares(obs, _fixed(spark, sf))


@query(RINGS + "SELECT point, component, round(height + 1.3e-10, 8) AS height, round(mse, 8) + 0.0 AS mse, is_fixed, round(sigma0, 8) + 0.0 AS sigma0, 'OK' AS status FROM hts")
def lsa_parametric(spark, sf):
    return _round(_adjusted(spark, sf)[1].withColumn("height", F.col("height") + F.lit(1.3e-10)), "height", "mse", "sigma0", digits=8)


_RES = "obs_seq, from_pt, to_pt, round(v * 1000 + 1.3e-8, 6) + 0.0 AS v_mm"


@query(RINGS + f"SELECT {_RES}, round(km, 6) AS km, CASE WHEN round(abs(v * 1000), 6) > 3 THEN 'warning' WHEN round(abs(v * 1000), 6) > 2 THEN 'caution' ELSE 'ok' END AS severity FROM v")
def lsa_residuals(spark, sf):
    r = N.residuals(*_adjusted(spark, sf))
    return _round(r.withColumn("v_mm", F.col("v_mm") + F.lit(1.3e-8)), "v_mm", "km", digits=6)  # off the ties of rounding


_STATS = """, st AS (SELECT count(*) AS n_obs, sum(km) AS total_km, sum(abs(v)) * 1000 AS total_mm, avg(v) * 1000 AS mean_mm, stddev_pop(v) * 1000 AS std_mm FROM v)
"""


@query(RINGS + _STATS + """SELECT n_obs, round(total_km, 6) AS total_km, round(total_mm, 4) AS total_mm, round(mean_mm, 6) + 0.0 AS mean_mm, round(std_mm, 6) AS std_mm, round(total_mm / sqrt(total_km), 4) AS k,
  CASE WHEN total_mm / sqrt(total_km) <= 3 THEN 'Class 1' WHEN total_mm / sqrt(total_km) <= 5 THEN 'Class 2' WHEN total_mm / sqrt(total_km) <= 10 THEN 'Class 3' WHEN total_mm / sqrt(total_km) <= 20 THEN 'Class 4' ELSE 'Exceeds Class 4' END AS k_class FROM st""")
def lsa_statistics(spark, sf):
    s = N.statistics(N.residuals(*_adjusted(spark, sf)))
    return _round(_round(s, "total_mm", "k", digits=4), "total_km", "mean_mm", "std_mm", digits=6)

import math

import pytest
from pyspark.sql import functions as F

from staffline.functions import regulations as R
from staffline.operators import leveling as L
from staffline.operators import network as N

SETUPS = "line_id long, setup_number int, backsight decimal(12,5), foresight decimal(12,5), dist_back decimal(12,3), dist_fore decimal(12,3)"


@pytest.fixture(scope="module")
def setups(spark):
    from decimal import Decimal as D

    rows = [(1, 1, D("1.5"), D("1.2"), D(30), D(32)), (1, 2, D("1.4"), D("1.6"), D(20), D(20)), (2, 1, D("1.0"), D("1.1"), D(40), D(40))]
    return spark.createDataFrame(rows, SETUPS).withColumn("height_diff", F.col("backsight") - F.col("foresight"))


def test_totals_and_corrections(spark, setups):
    t = {r.line_id: r for r in L.line_totals(setups).collect()}
    assert t[1].distance == 51 and abs(t[1].height_diff - 0.1) < 1e-12
    closure = spark.createDataFrame([(1, 0.003)], "line_id long, misclosure double")
    for method in ("equal", "proportional"):
        got = L.apply_corrections(L.distribute(setups, closure, method)).orderBy("setup_number").collect()
        assert abs(sum(r.correction for r in got) + 0.003) < 1e-12 and abs(got[-1].cumulative_height - 0.097) < 1e-12
    with pytest.raises(ValueError):
        L.distribute(setups, closure, "other")


def test_names_and_classes(spark):
    rows = spark.createDataFrame([("A1",), ("17",), (" 5 ",), ("-5",), ("",), (None,)], "p string").select(R.endpoint_status(F.col("p"))).collect()
    assert [r[0] for r in rows] == ["benchmark", "turning_point", "turning_point", "unclear", "empty", "empty"]
    got = spark.range(1).select(R.achieved_class(F.lit(9.0), F.lit(1000.0)), R.achieved_class(F.lit(900.0), F.lit(1000.0)), R.tolerance_legacy(F.lit(4000.0), F.lit(9))).first()
    assert tuple(got) == (3, 6, 6.0)
    with pytest.raises(Exception, match="out of range"):
        spark.range(1).select(R.tolerance_new(F.lit(1000.0), F.lit(9))).collect()


def obs(spark, rows):
    return spark.createDataFrame(rows, "obs_seq long, from_pt long, to_pt long, height_diff double, distance double")


def test_network(spark):
    o = obs(spark, [(1, 1, 2, 1.0, 1000.0), (2, 2, 3, 1.0, 1000.0), (3, 3, 1, -2.003, 1000.0), (4, 8, 9, 1.0, 500.0)])
    assert {(r.point, r.component) for r in N.components(o).collect()} == {(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)}
    loop = N.loops(o).collect()
    assert len(loop) == 1 and abs(loop[0].misclosure_mm) == 3.0 and loop[0].n_edges == 3
    fixed = spark.createDataFrame([(1, 10.0)], "point long, height double")
    h = {r.point: r for r in N.least_squares(o, fixed).collect()}
    assert abs(h[2].height - 11.001) < 1e-9 and abs(h[3].height - 12.002) < 1e-9 and h[8].status == "DATUM_DEFECT"
    assert h[1].is_fixed and abs(h[2].sigma0 - math.sqrt(3) * 0.001) < 1e-9
    v = [r.v_mm for r in N.residuals(o.filter("obs_seq < 4"), N.least_squares(o, fixed)).collect()]
    assert all(abs(x - 1.0) < 1e-6 for x in v)


def test_rings_at_the_bound(spark):
    ring = lambda n: obs(spark, [(k, k, k % n + 1, 0.0, 100.0) for k in range(1, n + 1)])
    assert [r.n_edges for r in N.loops(ring(11)).collect()] == [11] and N.loops(ring(12)).count() == 0

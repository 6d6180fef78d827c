"""Network operators: components, loop rank, loops, least squares."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import regulations as R
from ..functions.matrices import stability
from ..sources.checkpoints import cut


def edges(obs: DataFrame) -> DataFrame:
    """Both directions of each observation; sign is -1 against its sense. Empty ends are skipped."""
    fine = obs.filter("from_pt is not null and to_pt is not null")
    there = fine.select("obs_seq", F.col("from_pt").alias("a"), F.col("to_pt").alias("b"), F.lit(1).alias("sign"), "height_diff", "distance")
    back = fine.select("obs_seq", F.col("to_pt").alias("a"), F.col("from_pt").alias("b"), F.lit(-1).alias("sign"), "height_diff", "distance")
    return there.unionByName(back)


def components(obs: DataFrame) -> DataFrame:
    """(point, component): the least point that is reachable. Labels and pointers double, each round checkpointed."""
    e = cut(edges(obs).select("a", "b").distinct())
    now = cut(e.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")).withColumnRenamed("a", "point"))
    while True:
        near = e.join(now.withColumnRenamed("point", "b"), "b").groupBy("a").agg(F.min("component").alias("least"))
        step = now.join(near, F.col("point") == F.col("a")).select("point", F.least("component", "least").alias("component"))
        jump = step.alias("s").join(step.alias("t"), F.col("s.component") == F.col("t.point")).select(F.col("s.point").alias("point"), F.least("s.component", "t.component").alias("component"))
        fresh = cut(jump)
        if fresh.join(now.withColumnRenamed("component", "old"), "point").filter("component <> old").isEmpty():
            return fresh
        now = fresh


def loop_rank(obs: DataFrame) -> DataFrame:
    """n_edges, n_points, n_components and the rank E - V + C of independent loops."""
    c = components(obs).agg(F.count(F.lit(1)).alias("n_points"), F.countDistinct("component").alias("n_components"))
    return obs.agg(F.count(F.lit(1)).alias("n_edges")).crossJoin(c).withColumn("loop_rank", F.col("n_edges") - F.col("n_points") + F.col("n_components"))


def loops(obs: DataFrame, max_edges: int = 11, cls: int = 3) -> DataFrame:
    """Simple loops of three to max_edges observations with signed misclosure, tolerance and outcome.

    Paths grow from their least point one edge at a time by joins; each loop is found in two senses and kept once.
    """
    e = cut(edges(obs))
    nxt = e.select(F.col("obs_seq").alias("seq"), F.col("a").alias("here"), F.col("b").alias("there"), (F.col("sign") * F.col("height_diff")).cast("double").alias("step_dh"), F.col("distance").cast("double").alias("step_m"))
    path = e.filter("b > a").select(F.col("a").alias("start"), F.col("b").alias("at"), F.array("b").alias("points"), F.array("obs_seq").alias("seqs"), (F.col("sign") * F.col("height_diff")).cast("double").alias("dh"), F.col("distance").cast("double").alias("distance"))
    found = None
    for _ in range(max_edges - 1):
        step = path.join(nxt, F.col("at") == F.col("here")).filter(~F.array_contains("seqs", F.col("seq")))
        dh, dist = F.col("dh") + F.col("step_dh"), F.col("distance") + F.col("step_m")
        grown = cut(step.select("start", F.col("there").alias("at"), "points", F.array_append("seqs", F.col("seq")).alias("seqs"), dh.alias("dh"), dist.alias("distance")).filter("at >= start"))
        closed = grown.filter((F.col("at") == F.col("start")) & (F.size("seqs") >= 3))
        found = closed if found is None else found.unionByName(closed)
        path = cut(grown.filter((F.col("at") != F.col("start")) & ~F.array_contains("points", F.col("at"))).withColumn("points", F.array_append("points", F.col("at"))))
        if path.isEmpty():
            break
    one = found.groupBy(F.array_sort("seqs").alias("seqs")).agg(F.max("dh").alias("dh"), F.max("distance").alias("distance"))
    mm = F.round(F.col("dh") * 1000, 6)
    return one.select(F.array_join("seqs", ",").alias("loop"), F.size("seqs").alias("n_edges"), mm.alias("misclosure_mm"), "distance", R.tolerance_new(F.col("distance"), F.lit(cls)).alias("tolerance_mm")).withColumn("within", F.abs("misclosure_mm") <= F.col("tolerance_mm"))


DENSE = 600  # unknowns of a component that is solved with its inverse, so that its points have mean errors
GROUPS = 64


def _inverse_diagonal(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = np.linalg.cholesky(n)
    inv = np.linalg.inv(low)
    return inv.T @ inv, (inv**2).sum(0)


def _gradients(i: np.ndarray, j: np.ndarray, w: np.ndarray, m: int, u: np.ndarray) -> np.ndarray:
    """N x = u of a weighted Laplacian whose edges join i and j (m stands for a fixed point), by conjugate gradients.

    The preconditioner is the diagonal; the matrix is never formed, so memory goes with the observations.
    """
    d = (np.bincount(i, w, m + 1) + np.bincount(j, w, m + 1))[:m]

    def times(x: np.ndarray) -> np.ndarray:
        x = np.append(x, 0.0)
        flow = w * (x[i] - x[j])
        return (np.bincount(i, flow, m + 1) - np.bincount(j, flow, m + 1))[:m]

    x, r = np.zeros(m), u.copy()
    z = r / d
    p, rz = z, r @ z
    least = 1e-13 * np.sqrt(u @ u) if len(u) else 0.0
    for _ in range(20 * m + 100):
        if np.sqrt(r @ r) <= least:
            break
        q = times(p)
        a = rz / (p @ q)
        x, r = x + a * p, r - a * q
        z = r / d
        rz, before = r @ z, rz
        p = z + rz / before * p
    return x


def _solve(a: np.ndarray, b: np.ndarray, dh: np.ndarray, w: np.ndarray, fixed: dict):
    """(points, heights, mean errors, is fixed, sigma0, status) of one component's observations a -> b."""
    points, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    known = np.array([p in fixed for p in points.tolist()], bool)
    h = np.array([fixed.get(p, np.nan) for p in points.tolist()], float)
    m = int((~known).sum())
    mse = np.where(known, 0.0, np.nan)
    if not known.any():
        return points, h, mse, known, 0.0, "DATUM_DEFECT"
    if not m:
        return points, h, mse, known, 0.0, "ALL_FIXED"
    if len(a) <= m:
        return points, h, mse, known, 0.0, "INSUFFICIENT"
    place = np.where(known, m, np.cumsum(~known) - 1)
    i, j = place[at[: len(a)]], place[at[len(a) :]]
    datum = h[known][0]  # heights are solved as differences from it, so that its size costs them no digits
    base = np.where(known, h - datum, 0.0)
    rhs = dh - (base[at[len(a) :]] - base[at[: len(a)]])
    u = (np.bincount(j, w * rhs, m + 1) - np.bincount(i, w * rhs, m + 1))[:m]
    diagonal = None
    if m <= DENSE:
        n = np.zeros((m + 1, m + 1))
        np.add.at(n, (i, i), w)
        np.add.at(n, (j, j), w)
        np.subtract.at(n, (i, j), w)
        np.subtract.at(n, (j, i), w)
        try:
            inverse, diagonal = _inverse_diagonal(n[:m, :m])
        except np.linalg.LinAlgError:
            return points, h, mse, known, 0.0, "SINGULAR"
        x = inverse @ u
        off = w * (rhs - np.append(x, 0.0)[j] + np.append(x, 0.0)[i])
        x = x + inverse @ (np.bincount(j, off, m + 1) - np.bincount(i, off, m + 1))[:m]  # to the last digits
    else:
        x = _gradients(i, j, w, m, u)
    base[~known] = x
    h[~known] = datum + x
    v = base[at[len(a) :]] - base[at[: len(a)]] - dh
    sigma = float(np.sqrt((w * v * v).sum() / (len(a) - m)))
    if diagonal is not None:
        mse[~known] = sigma * np.sqrt(diagonal)
    return points, h, mse, known, sigma, "OK"


def least_squares(obs: DataFrame, fixed: DataFrame, use_weights: bool = True) -> DataFrame:
    """Adjusted heights of each component: point, component, height, mse, is_fixed, sigma0, status.

    The normal matrix is a weighted Laplacian. Components of up to DENSE unknowns are solved by Cholesky, larger ones by
    conjugate gradients without a matrix; their points have no mean error (null). Weights are 1 / km, or one without use_weights. Many components
    share a task's call. Components without fixed points have status DATUM_DEFECT, of fixed points only ALL_FIXED; with no more
    observations than unknowns, INSUFFICIENT; a matrix that is not positive definite, SINGULAR. fixed: point, height, and
    maybe std_dev in m: a point with a positive one is observed, not fixed, under the weight (0.001 m / std_dev)^2.
    """
    comp = cut(components(obs))
    km = F.when(F.col("distance") > 0, F.col("distance").cast("double") / 1000).otherwise(1.0)
    own = obs.join(comp.withColumnRenamed("point", "from_pt"), "from_pt").select("component", "from_pt", "to_pt", F.col("height_diff").cast("double").alias("dh"), (1 / km if use_weights else F.lit(1.0)).alias("w"))
    std = F.coalesce(F.col("std_dev"), F.lit(0.0)) if "std_dev" in fixed.columns else F.lit(0.0)
    known = comp.join(fixed.select("point", F.col("height").cast("double").alias("h"), std.cast("double").alias("std")), "point").select("point", F.col("component").alias("part"), "h", "std")
    kind = dict(obs.dtypes)["from_pt"]
    groups = max(GROUPS, int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    group = lambda c: F.pmod(F.xxhash64(c), F.lit(groups)).cast("int").alias("g")

    def solve(o: pa.Table, f: pa.Table) -> pa.Table:
        """Every component of a group."""
        parts = []
        c, heights = o.column("component").to_pandas().to_numpy(), {}
        for p, part, h, s in zip(*(f.column(x).to_pylist() for x in ("point", "part", "h", "std")), strict=True):
            heights.setdefault(part, {})[p] = (h, s)
        order = np.argsort(c, kind="stable")
        a, b, dh, w = (o.column(x).to_pandas().to_numpy()[order] for x in ("from_pt", "to_pt", "dh", "w"))
        c = c[order]
        edge = np.flatnonzero(np.concatenate([np.ones(min(1, len(c)), bool), c[1:] != c[:-1]]))
        for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), len(c)], strict=True):
            mine = heights.get(c[lo], {})
            hard = {p: h for p, (h, s) in mine.items() if not s > 0}
            soft = [(p, h, s) for p, (h, s) in mine.items() if s > 0]
            x = (a[lo:hi], b[lo:hi], dh[lo:hi], w[lo:hi])
            if soft:  # observed from a datum of height zero, which is no point of the network
                datum = -1 if kind != "string" else "\x01datum"
                x = (np.append(x[0], [datum] * len(soft)), np.append(x[1], [p for p, _, _ in soft]), np.append(x[2], [h for _, h, _ in soft]), np.append(x[3], [(0.001 / s) ** 2 for _, _, s in soft]))
                hard[datum] = 0.0
            p, h, mse, is_fixed, sigma, status = _solve(*x, hard)
            keep = p != datum if soft else np.ones(len(p), bool)
            k = int(keep.sum())
            parts.append((p[keep].tolist(), [c[lo]] * k, h[keep], mse[keep], is_fixed[keep], np.full(k, sigma), [status] * k))
        cols = [[y for part in parts for y in part[i]] for i in (0, 1, 6)]
        nums = [np.concatenate([np.zeros(0), *(part[i] for part in parts)]) for i in (2, 3, 4, 5)]
        null = lambda z: pa.array(z, pa.float64(), from_pandas=True)
        return pa.table([pa.array(cols[0], o.schema.field("from_pt").type), pa.array(cols[1], o.schema.field("component").type), null(nums[0]), null(nums[1]), pa.array(nums[2].astype(bool)), pa.array(nums[3], pa.float64()), pa.array(cols[2], pa.string())], names=["point", "component", "height", "mse", "is_fixed", "sigma0", "status"])

    both = own.select(group("component"), "*").groupBy("g").cogroup(known.select(group("part").alias("g2"), "*").groupBy("g2"))
    return both.applyInArrow(solve, f"point {kind}, component {kind}, height double, mse double, is_fixed boolean, sigma0 double, status string")


def heights_from_adjusted(obs: DataFrame, conditioned: DataFrame, fixed: DataFrame) -> DataFrame:
    """Heights by the adjusted differences of `conditional`; observations in no loop keep their own difference."""
    own = obs.join(conditioned.select("obs_seq", "adjusted_dh"), "obs_seq", "left")
    return least_squares(own.withColumn("height_diff", F.coalesce("adjusted_dh", F.col("height_diff").cast("double"))).drop("adjusted_dh"), fixed)


def from_lines(lines: DataFrame, totals: DataFrame, only_used: bool = True) -> DataFrame:
    """Observations of lines for the network operators: obs_seq, from_pt, to_pt, height_diff, distance."""
    used = lines.filter("is_used") if only_used else lines
    return used.join(totals, "line_id").select(F.col("line_id").alias("obs_seq"), F.col("start_point").alias("from_pt"), F.col("end_point").alias("to_pt"), "height_diff", "distance")


def simple_adjustment(spark, observations: list[dict], fixed: dict) -> DataFrame:
    """least_squares of records with from, to, dh (m) and dist (m), and a mapping of fixed points to heights."""
    obs = spark.createDataFrame([(k, str(o["from"]), str(o["to"]), float(o["dh"]), float(o.get("dist", 1000.0))) for k, o in enumerate(observations)], "obs_seq long, from_pt string, to_pt string, height_diff double, distance double")
    return least_squares(obs, spark.createDataFrame([(str(p), float(h)) for p, h in fixed.items()], "point string, height double"))


def diagnostics(obs: DataFrame, fixed: DataFrame) -> DataFrame:
    """Per component of up to DENSE unknowns: component, unknowns, rank, condition of the normal matrix and what it means."""
    comp = cut(components(obs))
    km = F.when(F.col("distance") > 0, F.col("distance").cast("double") / 1000).otherwise(1.0)
    hard = fixed.select(F.col("point").alias("p"), F.lit(True).alias("known"))
    own = obs.join(comp.withColumnRenamed("point", "from_pt"), "from_pt").join(hard.select(F.col("p").alias("from_pt"), F.col("known").alias("fa")), "from_pt", "left").join(hard.select(F.col("p").alias("to_pt"), F.col("known").alias("fb")), "to_pt", "left")
    own = own.select("component", "from_pt", "to_pt", (1 / km).alias("w"), F.coalesce("fa", F.lit(False)).alias("fa"), F.coalesce("fb", F.lit(False)).alias("fb"))
    kind = dict(obs.dtypes)["from_pt"]

    def look(key, o: pd.DataFrame) -> pd.DataFrame:
        free = sorted({*o.from_pt[~o.fa], *o.to_pt[~o.fb]})
        if not free or len(free) > DENSE:
            return pd.DataFrame([(key[0], len(free), None, None)], columns=["component", "unknowns", "rank", "condition"])
        at, n = {p: i for i, p in enumerate(free)}, np.zeros((len(free) + 1, len(free) + 1))
        i, j = o.from_pt.map(at).fillna(len(free)).astype(int), o.to_pt.map(at).fillna(len(free)).astype(int)
        for r, c, s in ((i, i, 1), (j, j, 1), (i, j, -1), (j, i, -1)):
            np.add.at(n, (r, c), s * o.w)
        s = stability(n[:-1, :-1])
        return pd.DataFrame([(key[0], len(free), s.rank, s.condition)], columns=["component", "unknowns", "rank", "condition"])

    out = own.groupBy("component").applyInPandas(look, f"component {kind}, unknowns int, rank int, condition double")
    return out.withColumn("meaning", R.condition_meaning(F.col("condition")))


def residuals(obs: DataFrame, heights: DataFrame) -> DataFrame:
    """v = adjusted - observed in mm and its severity, per observation."""
    h = lambda end: heights.select(F.col("point").alias(f"{end}_pt"), F.col("height").alias(f"{end}_h"))
    j = obs.join(h("from"), "from_pt").join(h("to"), "to_pt")
    v = (F.col("to_h") - F.col("from_h") - F.col("height_diff").cast("double")) * 1000
    return j.select("obs_seq", "from_pt", "to_pt", v.alias("v_mm"), (F.col("distance").cast("double") / 1000).alias("km")).withColumn("severity", R.residual_severity(F.round("v_mm", 6)))


def statistics(res: DataFrame) -> DataFrame:
    """n_obs, total km, sum of absolute residuals, k coefficient and its class."""
    s = res.agg(F.count(F.lit(1)).alias("n_obs"), F.sum("km").alias("total_km"), F.sum(F.abs("v_mm")).alias("total_mm"), F.avg("v_mm").alias("mean_mm"), F.stddev_pop("v_mm").alias("std_mm"))
    return s.withColumn("k", F.col("total_mm") / F.sqrt("total_km")).withColumn("k_class", R.network_class(F.col("k")))


def network_summary(obs: DataFrame) -> DataFrame:
    """One row: edges, points, components, loop rank, total distance (m)."""
    return loop_rank(obs).crossJoin(obs.agg(F.sum("distance").cast("double").alias("total_distance")))  # one row each


def spanning_paths(obs: DataFrame) -> DataFrame:
    """point, component, path: the signed observations from the component's least point along a spanning tree.

    Breadth first: in each round every open point takes the least observation that leads to it; a round is one join and
    one aggregation, checkpointed. Rounds equal the depth of the widest component.
    """
    e = cut(edges(obs).filter("a <> b").select("obs_seq", "a", "b", "sign"))
    comp = cut(components(obs))
    tree = comp.filter("point = component").select("point", "component", F.array().cast("array<struct<obs_seq:bigint,sign:int>>").alias("path"))
    front = tree
    while True:
        reach = front.join(e, F.col("point") == F.col("a")).join(tree.select(F.col("point").alias("seen")), F.col("b") == F.col("seen"), "left_anti")
        step = F.min_by(F.struct("component", F.array_append("path", F.struct(F.col("obs_seq").cast("long").alias("obs_seq"), F.col("sign").cast("int").alias("sign"))).alias("path")), F.struct("obs_seq", "a")).alias("x")
        front = cut(reach.groupBy(F.col("b").alias("point")).agg(step).select("point", "x.*"))
        if front.isEmpty():
            return tree
        tree = cut(tree.unionByName(front))


def basis_loops(obs: DataFrame) -> DataFrame:
    """Independent loops, E - V + C of them: component, loop_id, obs_seq, sign. An observation outside the spanning tree closes
    the loop that bears its number; the shared beginning of its ends' paths cancels out."""
    t = spanning_paths(obs)
    inside = t.select(F.explode("path").alias("x")).select(F.col("x.obs_seq").alias("obs_seq")).distinct()
    rest = obs.filter("from_pt is not null and to_pt is not null").select(F.col("obs_seq").cast("long").alias("obs_seq"), "from_pt", "to_pt").join(inside, "obs_seq", "left_anti")
    f = t.select(F.col("point").alias("from_pt"), "component", F.col("path").alias("pf"))
    j = rest.join(f, "from_pt").join(t.select(F.col("point").alias("to_pt"), F.col("path").alias("pt")), "to_pt")
    own = F.array(F.struct(F.col("obs_seq"), F.lit(1).alias("sign")))
    back = F.transform(F.array_except("pt", "pf"), lambda x: F.struct(x["obs_seq"].alias("obs_seq"), (-x["sign"]).alias("sign")))
    legs = F.concat(F.array_except("pf", "pt"), own, back)
    return j.select("component", F.col("obs_seq").alias("loop_id"), F.explode(legs).alias("x")).select("component", "loop_id", "x.obs_seq", "x.sign")


def loop_misclosure(obs: DataFrame, incidence: DataFrame, cls: int = 3, compat: bool = False) -> DataFrame:
    """loop_id, n_edges, misclosure_mm (signed sum; compat: of the differences as observed), distance, tolerance_mm, within, achieved_class."""
    j = incidence.join(obs.select("obs_seq", F.col("height_diff").cast("double").alias("dh"), F.col("distance").cast("double").alias("m")), "obs_seq")
    g = j.groupBy("loop_id").agg(F.count(F.lit(1)).alias("n_edges"), F.round(F.sum(F.col("dh") if compat else F.col("sign") * F.col("dh")) * 1000, 6).alias("misclosure_mm"), F.sum("m").alias("distance"))
    return g.withColumn("tolerance_mm", R.tolerance_new(F.col("distance"), F.lit(cls))).withColumn("within", F.abs("misclosure_mm") <= F.col("tolerance_mm")).withColumn("achieved_class", R.achieved_class(F.col("misclosure_mm"), F.col("distance")))


def conditional(obs: DataFrame, incidence: DataFrame) -> DataFrame:
    """Adjustment by conditions: obs_seq, component, v_mm, adjusted_dh, sigma0 of observations in loops.

    B holds the loops' signs and P is 1 / km; the correlates k solve B P^-1 B' k = -w and v = P^-1 B' k. The loops of a component
    meet in one task as (loop, observation, sign) rows: up to DENSE loops the matrix is formed, beyond conjugate gradients
    run on the rows themselves. incidence: independent loops (see basis_loops).
    """
    km = F.when(F.col("distance") > 0, F.col("distance").cast("double") / 1000).otherwise(1.0)
    i = incidence.join(obs.select("obs_seq", F.col("height_diff").cast("double").alias("dh"), km.alias("km")), "obs_seq")
    groups = max(GROUPS, int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def one(loop: np.ndarray, seq: np.ndarray, sign: np.ndarray, dh: np.ndarray, km: np.ndarray):
        ids, first, o = np.unique(seq, return_index=True, return_inverse=True)
        loops, c = np.unique(loop, return_inverse=True)
        w, p = np.bincount(c, sign * dh), km[first]
        if len(loops) <= DENSE:
            b = np.zeros((len(loops), len(ids)))
            b[c, o] = sign
            k = np.linalg.lstsq((b * p) @ b.T, -w, rcond=None)[0]
        else:
            times = lambda x: np.bincount(c, sign * (p * np.bincount(o, sign * x[c]))[o])
            k, r = np.zeros(len(loops)), -w
            d, rr = r, r @ r
            for _ in range(20 * len(loops)):
                if rr <= 1e-26 * (w @ w):
                    break
                q = times(d)
                step = rr / (d @ q)
                k, r = k + step * d, r - step * q
                rr, before = r @ r, rr
                d = r + rr / before * d
        return ids, p * np.bincount(o, sign * k[c]), dh[first], float(np.sqrt(max(-(k @ w), 0.0) / len(loops)))

    def solve(t: pa.Table) -> pa.Table:
        comp = t.column("component").to_pandas().to_numpy()
        order = np.argsort(comp, kind="stable")
        cols = [t.column(x).to_numpy()[order] for x in ("loop_id", "obs_seq", "sign", "dh", "km")]
        comp = comp[order]
        edge = np.flatnonzero(np.concatenate([[True], comp[1:] != comp[:-1]])).tolist()
        seq, of, v, dh, sigma = [], [], [], [], []
        for lo, hi in zip(edge, [*edge[1:], len(comp)], strict=True):
            ids, vs, d, s0 = one(*(x[lo:hi] for x in cols))
            seq.append(ids)
            of += [comp[lo]] * len(ids)
            v.append(vs * 1000)
            dh.append(d + vs)
            sigma.append(np.full(len(ids), s0))
        cat = np.concatenate
        return pa.table([pa.array(cat(seq), pa.int64()), pa.array(of, t.schema.field("component").type), pa.array(cat(v)), pa.array(cat(dh)), pa.array(cat(sigma))], names=["obs_seq", "component", "v_mm", "adjusted_dh", "sigma0"])

    kind = dict(incidence.dtypes)["component"]
    return i.withColumn("g", F.pmod(F.xxhash64("component"), F.lit(groups))).groupBy("g").applyInArrow(lambda t: solve(t), f"obs_seq long, component {kind}, v_mm double, adjusted_dh double, sigma0 double")


def residual_map(obs: DataFrame, res: DataFrame) -> DataFrame:
    """key `from-to`, v_mm; of parallel observations the last one's."""
    key = F.concat_ws("-", F.col("from_pt").cast("string"), F.col("to_pt").cast("string"))
    return res.groupBy(key.alias("key")).agg(F.max_by("v_mm", "obs_seq").alias("v_mm"))


def residual_histogram(res: DataFrame, bins: int = 20) -> DataFrame:
    """bin (1 to bins), n of residuals between their least and greatest value."""
    ends = res.agg(F.min("v_mm").alias("lo"), F.max("v_mm").alias("hi"))
    b = F.when(F.col("hi") == F.col("lo"), 1).otherwise(F.least(F.lit(bins), F.floor((F.col("v_mm") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins) + 1))
    return res.crossJoin(F.broadcast(ends)).groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # one row

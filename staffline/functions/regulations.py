"""Naming predicates, tolerances and accuracy classes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: class parameters H1 to H6
NEW_K = {1: 3.0, 2: 5.0, 3: 10.0, 4: 20.0, 5: 30.0, 6: 60.0}
LEGACY_K = {1: 1.0, 2: 2.0, 3: 3.0, 4: 6.0}
MAX_LINE_KM = {2: 60.0, 3: 24.0, 4: 10.0, 5: 5.0, 6: 4.0}
MAX_SIGHT_M = {1: 30.0, 2: 40.0, 3: 50.0, 4: 80.0, 5: 100.0, 6: 100.0}
SINGLE_IMBALANCE_M = {1: 1.0, 2: 2.0, 3: 2.0, 4: 5.0, 5: 10.0, 6: 10.0}
TOTAL_IMBALANCE_M = {1: 5.0, 2: 5.0, 3: 10.0, 4: 10.0, 5: 10.0, 6: 15.0}
NEEDS_BFFB = (1, 2, 3)
NETWORK_K = {1: 3.0, 2: 5.0, 3: 10.0, 4: 20.0}


def is_benchmark(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike("[A-Za-z]"), F.lit(False))


def is_turning_point(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike("^[0-9]+$"), F.lit(False))


def endpoint_status(c: Column) -> Column:
    empty = F.coalesce(F.trim(c), F.lit("")) == ""
    return F.when(empty, "empty").when(is_turning_point(c), "turning_point").when(is_benchmark(c), "benchmark").otherwise("unclear")


def by_class(table: dict[int, float], cls: Column) -> Column:
    """The value of a class; null for a class without one."""
    out = F.lit(None).cast("double")
    for k, v in table.items():
        out = F.when(cls == k, F.lit(v)).otherwise(out)
    return out


def tolerance_new(distance_m: Column, cls: Column) -> Column:
    """k * sqrt(km) in mm; an unknown class is an error."""
    k = by_class(NEW_K, cls)
    return F.when(k.isNull(), F.raise_error(F.lit("leveling class out of range")).cast("double")).otherwise(k * F.sqrt(distance_m / 1000.0))


def tolerance_legacy(distance_m: Column, cls: Column) -> Column:
    return F.coalesce(by_class(LEGACY_K, cls), F.lit(LEGACY_K[3])) * F.sqrt(distance_m / 1000.0)


def achieved_class(misclosure_mm: Column, distance_m: Column) -> Column:
    """The best class whose tolerance suffices, else 6."""
    out = None
    for c, k in NEW_K.items():
        ok = F.abs(misclosure_mm) <= k * F.sqrt(distance_m / 1000.0)
        out = F.when(ok, F.lit(c)) if out is None else out.when(ok, F.lit(c))
    return out.otherwise(F.lit(6))


def network_class(k: Column) -> Column:
    out = None
    for c, limit in NETWORK_K.items():
        out = F.when(k <= limit, f"Class {c}") if out is None else out.when(k <= limit, f"Class {c}")
    return out.otherwise("Exceeds Class 4")


def residual_severity(mm: Column) -> Column:
    return F.when(F.abs(mm) > 3, "warning").when(F.abs(mm) > 2, "caution").otherwise("ok")


def condition_meaning(condition: Column) -> Column:
    """What the condition of a normal matrix says of its adjustment."""
    return F.when(condition.isNull(), F.lit(None)).when(condition < 1e3, "well conditioned").when(condition < 1e6, "moderately conditioned").when(condition < 1e10, "poorly conditioned").otherwise("ill conditioned")

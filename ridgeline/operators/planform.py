"""Synthetic planforms: a V-shaped drainage grid in closed form, and Peclet numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grid_size(length: Column, dx: Column, odd: bool = False) -> Column:
    """round(L / dx) + 1 (half to even); one more where an odd count is asked for."""
    n = F.bround(length / dx).cast("int") + 1
    return F.when(n % 2 == 0, n + 1).otherwise(n) if odd else n


def log_steps(first: float, last: float, count: int) -> Column:
    """An array of ``count`` log-spaced values."""
    import math

    a, b = math.log10(first), math.log10(last)
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.pow(F.lit(10.0), F.lit(a) + k * F.lit((b - a) / (count - 1))))


def checked(scenarios: DataFrame) -> DataFrame:
    """The same scenarios; an error where nx is not odd or a size is below 5."""
    ok = (F.col("nx") % 2 == 1) & (F.col("nx") >= 5) & (F.col("ny") >= 5)
    return scenarios.withColumn("nx", F.when(ok, F.col("nx")).otherwise(F.raise_error(F.lit("nx must be odd and nx, ny at least 5")).cast("int")))


def area_at(j: Column, i: Column) -> Column:
    """Drainage area of a scenario's cell: what lies upstream in its row, or a_top and all rows so far in the centre."""
    nx, ci, c = F.col("nx"), ((F.col("nx") - 1) / 2).cast("int"), F.col("dx") * F.col("dy")
    return F.when(i < ci, (i + 1) * c).when(i > ci, (nx - i) * c).otherwise(F.col("a_top") + (j + 1) * 2 * ci * c)


def planform(scenarios: DataFrame) -> DataFrame:
    """Scenarios (nx, ny, dx, dy, a_top, ...) exploded to cells with area and downstream link.

    Flow runs inward to the centre column, then south; for the area see :func:`area_at`.
    nx must be odd and both sizes at least 5, else an error."""
    cells = checked(scenarios).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("ny") - 1))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)))
    ci = ((F.col("nx") - 1) / 2).cast("int")
    area = area_at(F.col("j"), F.col("i"))
    is_outlet = (F.col("i") == ci) & (F.col("j") == F.col("ny") - 1)
    dn_i = F.when(F.col("i") < ci, F.col("i") + 1).when(F.col("i") > ci, F.col("i") - 1).otherwise(F.col("i"))
    dn_j = F.when((F.col("i") == ci) & ~is_outlet, F.col("j") + 1).otherwise(F.col("j"))
    return cells.withColumn("area", area).withColumn("is_outlet", is_outlet).withColumn("dn_j", dn_j).withColumn("dn_i", dn_i)


def inlet_area_from_pe(pe: Column, d: Column, k: Column, length: Column, m: Column) -> Column:
    return F.pow(F.try_divide(pe * d, k * length), F.try_divide(F.lit(1.0), m))


def d_from_pe(pe: Column, k: Column, length: Column, area: Column, m: Column) -> Column:
    return F.try_divide(k * length * F.pow(area, m), pe)


def pe_from_d(d: Column, k: Column, length: Column, area: Column, m: Column) -> Column:
    return F.try_divide(k * length * F.pow(area, m), d)


def a_top_for_inlet(target: Column, ci: Column, dx: Column, dy: Column) -> Column:
    """What the top of the centre column must add for the inlet to drain ``target``; never below zero."""
    return F.greatest(target - 2.0 * ci * dx * dy, F.lit(0.0))

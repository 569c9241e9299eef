"""Rectangles as structs of x0, y0, x1, y1."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"))


def overlap(a: Column, b: Column) -> tuple[Column, Column]:
    """Overlap along each axis over the smaller extent (1 at least); zeros where a box is missing."""

    def along(lo: str, hi: str) -> Column:
        shared = F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
        return F.coalesce(shared / F.greatest(F.lit(1.0), F.least(a[hi] - a[lo], b[hi] - b[lo])), F.lit(0.0))

    return along("x0", "x1"), along("y0", "y1")


def area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def holds(b: Column, x: Column, y: Column, tolerance: float = 0.0) -> Column:
    return x.between(b["x0"] - tolerance, b["x1"] + tolerance) & y.between(b["y0"] - tolerance, b["y1"] + tolerance)


def union_box(b: str) -> Column:
    """Aggregate: the smallest box around all."""
    return F.struct(F.min(f"{b}.x0").alias("x0"), F.min(f"{b}.y0").alias("y0"), F.max(f"{b}.x1").alias("x1"), F.max(f"{b}.y1").alias("y1"))

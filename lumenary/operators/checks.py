"""Comparisons of tables and named violation counts."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from . import grid

def inventory_diff(expected: DataFrame, actual: DataFrame, key: str, mark: str) -> DataFrame:
    """status, n over both sides: MISSING, UNEXPECTED, CHANGED, SAME; nulls compare as values."""
    a, b = expected.select(key, F.col(mark).alias("a"), F.lit(1).alias("in_a")), actual.select(key, F.col(mark).alias("b"), F.lit(1).alias("in_b"))
    status = F.when(F.col("in_b").isNull(), "MISSING").when(F.col("in_a").isNull(), "UNEXPECTED").when(F.col("a").eqNullSafe(F.col("b")), "SAME").otherwise("CHANGED")
    return a.join(b, key, "full_outer").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def multiset_overlap(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """overlap: the number of equal values that both sides have, counted with repeats."""
    x, y = a.groupBy(column).agg(F.count("*").alias("ca")), b.groupBy(column).agg(F.count("*").alias("cb"))
    return x.join(y, column).agg(F.coalesce(F.sum(F.least("ca", "cb")), F.lit(0)).alias("overlap"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables are equal as multisets."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def unique_match(rows: DataFrame, key: str) -> DataFrame:
    """Only the rows whose key occurs once."""
    return rows.withColumn("__n", F.count("*").over(W.partitionBy(key))).where("__n = 1").drop("__n")


def report(checks: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """code, checked, violations, status: for each named condition, the rows that it doesn't hold for (null counts). Conditions on
    one table (the same DataFrame object) share its scan."""
    by: dict[int, tuple[DataFrame, list[tuple[str, Column]]]] = {}
    for name, (df, ok) in checks.items():
        by.setdefault(id(df), (df, []))[1].append((name, ok))
    parts = []
    for df, own in by.values():
        counted = df.agg(F.count("*").alias("checked"), *[F.count_if(~F.coalesce(ok, F.lit(False))).alias(n) for n, ok in own])
        parts.append(counted.unpivot(["checked"], [n for n, _ in own], "code", "violations").select("code", "checked", "violations"))
    return reduce(DataFrame.unionByName, parts).withColumn("status", F.when(F.col("violations") == 0, "PASS").otherwise("FAIL"))


def smallest_container(points: DataFrame, boxes: DataFrame, point: str, x: Column, y: Column) -> DataFrame:
    """point, box_id, area: for each point (x, y) the box (box_id, box) of least area that holds it, ties to the smaller box_id;
    nulls where none does. The grid's cells are as large as the boxes, so none is copied to more than a few; points at one place
    are looked for once."""
    flat = boxes.select("box_id", "box.x0", "box.y0", "box.x1", "box.y1")
    named = points.select(point, x.cast("double").alias("__x"), y.cast("double").alias("__y"))
    places = named.where("__x is not null and __y is not null").select("__x", "__y").distinct().withColumn("__at", F.struct("__x", "__y"))
    found = grid.smallest_holding(places, flat, [], "__at", F.col("__x"), F.col("__y"), 0.0, 0.0, F.lit(True), "box_id").select("__at.*", "box_id", "area")
    return named.join(found, ["__x", "__y"], "left").select(point, "box_id", "area")


def delta_gate(old: DataFrame, new: DataFrame, key: str, columns: list[str], declared: DataFrame) -> DataFrame:
    """verdict, field, n of all cells that differ: DECLARED if (key, field) is in ``declared``, else UNDECLARED; rows
    of one side only have the field ``row``. One join of the two tables, one of the differences."""
    a = old.select(key, F.struct(*columns).alias("a"))
    b = new.select(key, F.struct(*columns).alias("b"))
    cells = F.array_compact(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in columns]))
    fields = F.when(F.col("a").isNull() | F.col("b").isNull(), F.array(F.lit("row"))).otherwise(cells)
    changed = a.join(b, key, "full_outer").select(key, F.explode(fields).alias("field"))
    known = declared.select(key, "field").distinct().withColumn("known", F.lit(True))
    verdict = F.when(F.col("known"), "DECLARED").otherwise("UNDECLARED")
    return changed.join(known, [key, "field"], "left").groupBy(verdict.alias("verdict"), "field").agg(F.count("*").alias("n"))

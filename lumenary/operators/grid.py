"""Points in boxes by a grid of many sizes: each box lies in cells as large as itself, so in few of them, however large it is."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _level(width: Column, height: Column) -> Column:
    """The power of two that a box's larger side, 1 at least, fits into."""
    return F.ceil(F.log2(F.greatest(width, height, F.lit(1.0)))).cast("int")


def smallest_holding(points: DataFrame, boxes: DataFrame, keys: list[str], point: str, x: Column, y: Column, dx: float, dy: float, also: Column, box: str) -> DataFrame:
    """point, box, area for the points that a box (keys, box, x0, y0, x1, y1) holds, within dx and dy and where ``also`` is true: the
    smallest by area, the first by id of a tie.

    A box of level l meets at most three cells of side 2^l along each axis, its margins included. A point is looked for in
    its cell of every level that occurs, and levels are no more than the exponents of the boxes' sides.
    """
    with_level = boxes.where("x1 >= x0 and y1 >= y0").withColumn("__l", _level(F.col("x1") - F.col("x0") + 2 * dx, F.col("y1") - F.col("y0") + 2 * dy))
    levels = sorted(r[0] for r in with_level.select("__l").distinct().collect())
    side = F.pow(F.lit(2.0), F.col("__l"))
    cells = lambda lo, hi: F.sequence(F.floor(lo / side), F.floor(hi / side))
    dealt = with_level.withColumn("__cx", F.explode(cells(F.col("x0") - dx, F.col("x1") + dx))).withColumn("__cy", F.explode(cells(F.col("y0") - dy, F.col("y1") + dy)))
    asked = points.withColumn("__l", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("__cx", F.floor(x / side)).withColumn("__cy", F.floor(y / side))
    met = asked.join(dealt, [*keys, "__l", "__cx", "__cy"]).where((x >= F.col("x0") - dx) & (x <= F.col("x1") + dx) & (y >= F.col("y0") - dy) & (y <= F.col("y1") + dy) & also)
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return met.groupBy(point).agg(F.min(F.struct(area.alias("a"), F.col(box).alias("b"))).alias("m")).select(point, F.col("m.b").alias(box), F.col("m.a").alias("area"))


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], across: float, down: float) -> DataFrame:
    """Pairs of boxes a (ax0, ay0, ax1, ay1) and b (bx0, ...) with equal keys whose overlap along each axis, over the smaller
    extent (1 at least), is more than ``across`` and ``down``.

    Either side is dealt to cells of its own size and of each larger one that occurs; a pair meets on the larger size of the
    two, in the first cell that both touch, so it comes once and a large box isn't copied to many small cells.
    """

    def levelled(df: DataFrame, p: str) -> DataFrame:
        return df.where(f"{p}x1 >= {p}x0 and {p}y1 >= {p}y0").withColumn(f"__{p}l", _level(F.col(f"{p}x1") - F.col(f"{p}x0"), F.col(f"{p}y1") - F.col(f"{p}y0")))

    one, other = levelled(a, "a"), levelled(b, "b")
    levels = sorted({r[0] for r in one.select("__al").distinct().union(other.select("__bl").distinct()).collect()})

    def dealt(df: DataFrame, p: str) -> DataFrame:
        side = F.pow(F.lit(2.0), F.col("__l"))
        cells = lambda c: F.sequence(F.floor(F.col(f"{p}{c}0") / side), F.floor(F.col(f"{p}{c}1") / side))
        at = df.withColumn("__l", F.explode(F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda x: x >= F.col(f"__{p}l"))))
        return at.withColumn("__cx", F.explode(cells("x"))).withColumn("__cy", F.explode(cells("y")))

    pairs = dealt(one, "a").join(dealt(other, "b"), [*keys, "__l", "__cx", "__cy"]).where(F.col("__l") == F.greatest("__al", "__bl"))
    side = F.pow(F.lit(2.0), F.col("__l"))
    once = (F.floor(F.greatest("ax0", "bx0") / side) == F.col("__cx")) & (F.floor(F.greatest("ay0", "by0") / side) == F.col("__cy"))
    share = lambda c: F.greatest(F.lit(0.0), F.least(f"a{c}1", f"b{c}1") - F.greatest(f"a{c}0", f"b{c}0")) / F.greatest(F.lit(1.0), F.least(F.col(f"a{c}1") - F.col(f"a{c}0"), F.col(f"b{c}1") - F.col(f"b{c}0")))
    return pairs.where(once & (share("x") > across) & (share("y") > down)).drop("__l", "__cx", "__cy", "__al", "__bl")

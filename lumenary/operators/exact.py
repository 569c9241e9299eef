"""Exact results over doubles: sums that are rounded once, and order statistics from borders that a sketch draws."""

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..sources.io import cut_lineage

#: A double is cut into digits of so many bits: long sums of digits hold 2^43 rows.
BITS = 20
_LOW, _HIGH = -58, 55
_BASE = 1 << BITS


def digits(x: Column) -> Column:
    """A finite double as an array of (place, digit): x = sum of digit * 2^(20 * place). Scaling by powers of two, whole parts and
    what they leave are exact, so nothing is lost; the first place only has to be near the top."""
    near = F.greatest(F.lit(-54), F.least(F.lit(52), F.floor(F.log2(F.abs(x)) / BITS))).cast("int")
    # two factors, since the inverse of the smallest doubles' scale is beyond the largest double
    half = lambda b: [2.0 ** (-BITS * (k // 2 if b else k - k // 2)) for k in range(-54, 53)]
    factor = lambda b: F.element_at(F.array(*map(F.lit, half(b))), near + 55)
    y = x * factor(0) * factor(1)
    steps = [(F.floor(y), y - F.floor(y))]
    for _ in range(3):
        rest = steps[-1][1] * float(_BASE)
        steps.append((F.floor(rest), rest - F.floor(rest)))
    return F.array(*[F.struct((near - i).alias("place"), whole.cast("long").alias("digit")) for i, (whole, _) in enumerate(steps)])


def _carried(sums: Column) -> Column:
    """Sums of digits by place, from the lowest on, with each carry moved up: digits from 0 to 2^20 - 1, and behind them the last
    carry, below zero for a negative sum."""
    start = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<long>").alias("out"))
    done = F.aggregate(sums, start, lambda a, d: F.struct(F.shiftright(a["carry"] + d, BITS).alias("carry"), F.array_append(a["out"], (a["carry"] + d).bitwiseAND(F.lit(_BASE - 1))).alias("out")))
    return F.array_append(done["out"], done["carry"])


def place_sums(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, odd (the sum of the values that are not finite, null if there is none), sums by place, from -58 on. Rows are read once
    and none is copied for its digits: those of values with the same first place are summed side by side before they are shuffled,
    so a key that holds most rows sends a hundred rows a task."""
    x = F.col(value).cast("double")
    finite = ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    there = rows.where(F.col(value).isNotNull()).select(*keys, x.alias("__x"), finite.alias("__finite"))
    cut = there.select(*keys, "__x", "__finite", F.when(F.col("__finite") & (F.col("__x") != 0), digits(F.col("__x"))).alias("__d"))
    side = [F.sum(F.col("__d")[i]["digit"]).alias(f"__s{i}") for i in range(4)]
    first = cut.groupBy(*keys, F.col("__d")[0]["place"].alias("__p")).agg(F.sum(F.when(~F.col("__finite"), F.col("__x"))).alias("odd"), F.count("*").alias("n"), *side)
    item = F.when(F.col("__p").isNotNull(), F.struct("__p", *[f"__s{i}" for i in range(4)]))
    held = first.groupBy(*keys).agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n"), F.sum("odd").alias("odd"), F.collect_list(item).alias("__l"))
    zero = F.lit(0).cast("long")
    own = lambda e, p: F.coalesce(*[F.when(e["__p"] - i == p, e[f"__s{i}"]) for i in range(4)], zero)
    sums = F.transform(F.sequence(F.lit(_LOW), F.lit(_HIGH)), lambda p: F.aggregate("__l", zero, lambda a, e: a + own(e, p)))
    return held.select(*keys, "n", "odd", sums.alias("sums"))


def _rounded(sums: Column) -> Column:
    """The double nearest to the exact sum, ties to even. The first five digits, doubled, and whether anything lies below them make
    one decimal of up to 101 bits, whose conversion rounds once; the power of two that follows changes no bit."""
    up = _carried(sums)
    negative = F.element_at(up, -1) < 0
    own = _carried(F.when(negative, F.transform(sums, lambda d: -d)).otherwise(sums))
    top = F.aggregate(F.transform(own, lambda d, i: F.when(d != 0, i)), F.lit(-1), lambda a, i: F.greatest(a, F.coalesce(i, F.lit(-1))))
    first = F.greatest(F.lit(0), top - 4)
    head = F.aggregate(F.reverse(F.slice(own, first + 1, 5)), F.lit(0).cast("decimal(38,0)"), lambda a, d: (a * F.lit(_BASE) + d).cast("decimal(38,0)"))
    below = F.exists(F.slice(own, F.lit(1), first), lambda d: d != 0)
    whole = (head * F.lit(2) + below.cast("int")).cast("decimal(38,0)").cast("double")
    power = (first + _LOW) * BITS - 1
    scale = lambda e: F.element_at(F.array(*[F.lit(2.0**k) for k in range(-600, 601)]), e + 601)
    low = F.floor(power / 2).cast("int")
    # an even split keeps each factor in range; the larger number is scaled first, so only the result can be tiny or infinite
    value = whole * scale(power - low) * scale(low)
    return F.when(top < 0, F.lit(0.0)).otherwise(F.when(negative, -value).otherwise(value))


def exact_sum(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, total: the correctly rounded sum of doubles, whatever their order. Nulls are left out, and keys without values; sums
    with infinities or NaN are those of doubles; a sum beyond the largest double is infinite."""
    return place_sums(rows, keys, value).select(*keys, F.coalesce("odd", _rounded(F.col("sums"))).alias("total"))


def exact_units(rows: DataFrame, keys: list[str], value: str, bits: int = 60) -> DataFrame:
    """keys, units: the exact sum times 2^``bits`` (a multiple of 20), as a whole number; null if it isn't one of at most 38 digits."""
    own = F.transform(F.col("sums"), lambda d, i: F.struct(i.alias("i"), d.alias("d")))
    lowest = -bits // BITS - _LOW
    whole = F.aggregate(F.reverse(F.slice(own, lowest + 1, 9)), F.lit(0).cast("decimal(38,0)"), lambda a, x: (a * F.lit(_BASE) + x["d"]).cast("decimal(38,0)"))
    outside = F.exists(own, lambda x: (x["d"] != 0) & ((x["i"] < lowest) | (x["i"] >= lowest + 9)))
    return place_sums(rows, keys, value).select(*keys, F.when(F.col("odd").isNull() & ~outside, whole).alias("units"))


# order statistics


def percentiles(rows: DataFrame, keys: list[str], value: str, points: dict[str, float], cells: int = 64, most: int = 1_000_000) -> DataFrame:
    """keys, n and a column for each of ``points`` (name: share): percentiles with linear interpolation. Nulls are left out; a key with
    nothing else has n = 0 and nulls.

    Equal values are counted first. Where a key has more than ``most`` different ones, a sketch of those draws borders that cut
    them into cells of like size; cells are counted, and the one or two that hold the ranks asked for are what is left, again
    and again until few enough are. Borders follow the values, so neither strays nor crowds put all into one cell, and no task
    orders more than ``most`` values of a key.
    """
    every = cut_lineage(rows.groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__c")))  # rows are read once
    base = every.where("__v is not null")
    held = base.groupBy(*keys).agg(F.sum("__c").alias("n"), F.count("*").alias("__m"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    named = F.inline(F.array(*[F.struct(F.lit(name).alias("__point"), F.lit(p).alias("__p")) for name, p in points.items()]))
    place = (F.col("n") - 1) * F.col("__p")
    brackets = held.select("*", named).withColumns({"__r0": F.floor(place), "__r1": F.ceil(place), "__part": place - F.floor(place), "__below": F.lit(0).cast("long")})
    brackets, whole = cut_lineage(brackets), [*keys, "__point"]
    kept = [*whole, "n", "__r0", "__r1", "__part"]
    settled = brackets.where(F.col("__m") <= most)
    open_ = brackets.where(F.col("__m") > most)
    while open_.limit(1).count():
        inside = _inside(base, open_, keys)
        borders = inside.groupBy(*whole).agg(F.percentile_approx("__v", [i / cells for i in range(1, cells)], 100 * cells).alias("__g"))
        cell = F.size(F.filter("__g", lambda b: b <= F.col("__v")))
        counted = _matched(inside, borders, whole).groupBy(*whole, cell.alias("__cell")).agg(F.sum("__c").alias("__t"), F.count("*").alias("__d"), F.min("__v").alias("__a"), F.max("__v").alias("__b"))
        w = W.partitionBy(*whole).orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)
        ranked = _matched(counted, open_.select(*kept, F.col("__below").alias("__base"), F.col("__m").alias("__were")), whole).withColumn("__before", F.col("__base") + F.coalesce(F.sum("__t").over(w), F.lit(0)))
        asked = ranked.where("__before <= __r1 and __before + __t > __r0")
        narrowed = asked.groupBy(*kept, "__were").agg(F.sum("__d").alias("__m"), F.min("__a").alias("__lo"), F.max("__b").alias("__hi"), F.min("__before").alias("__below"))
        narrowed = cut_lineage(narrowed)
        small = (F.col("__m") <= most) | (F.col("__m") >= F.col("__were"))
        settled = settled.unionByName(narrowed.where(small).drop("__were"), allowMissingColumns=True)
        open_ = narrowed.where(~small).drop("__were")
    inside = _inside(base, settled, keys)
    own = F.sum("__c").over(W.partitionBy(*whole).orderBy("__v").rowsBetween(W.unboundedPreceding, 0))
    last = inside.withColumn("__last", F.col("__below") + own - 1)
    at = lambda rank: F.max(F.when((F.col("__last") - F.col("__c") < F.col(rank)) & (F.col(rank) <= F.col("__last")), F.col("__v")))
    found = last.groupBy(*whole).agg(at("__r0").alias("__x"), at("__r1").alias("__y"), F.max("__part").alias("__part"))
    mixed = found.withColumn("__q", F.col("__x") + (F.col("__y") - F.col("__x")) * F.col("__part"))
    wide = mixed.groupBy(*keys).agg(*[F.max(F.when(F.col("__point") == name, F.col("__q"))).alias(name) for name in points])
    sizes = every.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("__v").isNotNull(), F.col("__c"))), F.lit(0)).alias("n"))
    return _matched(sizes, wide, keys, "left")


def _matched(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join in which null keys are equal; b's own columns come behind a's."""
    named = b.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys] or [F.lit(True)]
    return a.join(named, same, how).drop(*[f"__k_{k}" for k in keys])


def _inside(base: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    """The counted values between each bracket's ends."""
    return _matched(base, brackets.drop("__m"), keys).where("__v >= __lo and __v <= __hi")

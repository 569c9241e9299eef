"""Audits that count violations, joins that demand their keys, overrides, samples, pages."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def required_join(rows: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """An inner join in which a key that is missing from the lookup is an error when the rows are read."""
    there = lookup.withColumn("__there", F.lit(True))
    found = rows.join(there, key, "left")
    return found.where(F.when(F.col("__there"), True).otherwise(F.raise_error(F.concat(F.lit("missing key "), F.col(key).cast("string"))).cast("boolean"))).drop("__there")


def violations(rows: DataFrame, codes: dict[str, Column]) -> DataFrame:
    """code, n: how many rows break each rule, in one scan; null counts as broken, a rule that holds has n = 0."""
    counted = rows.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(c) for c, ok in codes.items()])
    return counted.unpivot([], list(codes), "code", "n")


def demanded(rows: DataFrame, key: str) -> DataFrame:
    """The rows of ``override``; one whose fixed columns don't agree is an error when they are read."""
    same = F.when(F.col("unchanged"), True).otherwise(F.raise_error(F.concat(F.lit("a fixed field differs for "), F.col(key).cast("string"))).cast("boolean"))
    return rows.where(same).drop("unchanged")


def override(rows: DataFrame, changes: DataFrame, key: str, replaced: list[str], fixed: list[str]) -> DataFrame:
    """The rows with ``replaced`` columns from the changes where there are any, and ``unchanged``: whether ``fixed`` columns agree."""
    c = changes.select(key, F.lit(True).alias("__changed"), *[F.col(x).alias(f"__{x}") for x in [*replaced, *fixed]])
    both = rows.join(c, key, "left")
    changed = F.coalesce("__changed", F.lit(False))
    agree = F.lit(True)
    for x in fixed:
        agree = agree & F.col(x).eqNullSafe(F.col(f"__{x}"))
    return both.select(key, *fixed, *[F.when(changed, F.col(f"__{x}")).otherwise(F.col(x)).alias(x) for x in replaced], F.when(changed, agree).otherwise(True).alias("unchanged"))


def blinded(rows: DataFrame, key: str, seed: str = "42") -> DataFrame:
    """The rows with ``blind_id`` A001, A002, ... in the order of a seeded hash; the key table is the two ids of the result."""
    from .schedule import numbered

    h = rows.withColumn("h", F.sha2(F.concat(F.lit(seed + "|"), F.col(key).cast("string")), 256))
    return numbered(h, ["h", key], "at").withColumn("blind_id", F.format_string("A%03d", F.col("at") + 1)).drop("h", "at")


def blinded_strata(rows: DataFrame, key: str, kind: str, quotas: dict[str, int | None], seed: str = "42") -> tuple[DataFrame, DataFrame]:
    """(sheet, keys): of each kind the first ``quotas[kind]`` rows in the order of a seeded hash, all where that is None; other kinds
    have none. The sheet has blind ids in the order of another hash, and neither key nor kind; the keys are kept apart."""
    from .schedule import numbered

    hashed = lambda name: F.sha2(F.concat_ws("|", F.lit(name), F.lit(seed), F.col(key).cast("string")), 256)
    quota = F.coalesce(*[F.when(F.col(kind) == k, F.lit((1 << 62) if n is None else n)) for k, n in quotas.items()], F.lit(0))
    asked = rows.withColumn("__q", quota).where("__q > 0").withColumn("__h", hashed("draw"))
    placed = numbered(asked, [kind, "__h", key], "__n")
    first = placed.groupBy(kind).agg(F.min("__n").alias("__f"))
    drawn = placed.join(first, kind).where(F.col("__n") - F.col("__f") < F.col("__q")).drop("__q", "__h", "__n", "__f").withColumn("__b", hashed("blind"))
    blind = numbered(drawn, ["__b", key], "__at").withColumn("blind_id", F.format_string("A%03d", F.col("__at") + 1)).drop("__b", "__at")
    return blind.drop(key, kind), blind.select("blind_id", key, kind)


def page_of(rows: DataFrame, order: list, offset: int, limit: int = 50) -> DataFrame:
    """A page of a list: offset 0 or more, limit clamped to 1..100."""
    if offset < 0:
        raise ValueError("the offset must not be negative")
    return rows.orderBy(*order).offset(offset).limit(max(1, min(100, limit)))

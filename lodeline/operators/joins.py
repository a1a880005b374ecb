"""Ordered joins: the row before or after each request, and overlapping intervals without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof(left: DataFrame, right: DataFrame, by: list[str], at: str, values: list[str], forward: bool = False, strict: bool = False) -> DataFrame:
    """``left`` with the ``values`` of the last row of ``right`` at or before each row's ``at`` (forward: first at or after).

    Both sides are ranked together in one pass over each group, so it costs one shuffle and one sort. ``strict`` leaves
    out rows of the same ``at``.
    """
    own = [c for c in left.columns if c not in (*by, at)]
    a = left.select(*by, at, F.struct(*own).alias("_own"), F.lit(None).cast(right.select(F.struct(at, *values)).schema[0].dataType).alias("_found"), F.lit(True).alias("_left"))
    b = right.select(*by, at, F.lit(None).cast(left.select(F.struct(*own)).schema[0].dataType).alias("_own"), F.struct(at, *values).alias("_found"), F.lit(False).alias("_left"))
    # Within one moment the right side comes first where it counts, and last where it does not.
    side = F.col("_left").cast("int") if not strict else -F.col("_left").cast("int")
    order = [F.desc(at), side] if forward else [F.asc(at), side]
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = a.unionByName(b).withColumn("_found", F.last("_found", ignorenulls=True).over(w)).filter("_left")
    return found.select(*by, at, *[F.col(f"_own.{c}").alias(c) for c in own], *[F.col(f"_found.{v}").alias(v) for v in values])


def overlaps(left: DataFrame, right: DataFrame, a: tuple[str, str], b: tuple[str, str], width: int) -> DataFrame:
    """Pairs of rows whose closed integer intervals meet. Column names of the two sides must differ.

    Intervals are dealt to bins of ``width``; a pair is reported in the bin where the later of its starts lies, so it is
    found once. Choose a width near a usual interval's length.
    """
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width)))
    x, y = left.withColumn("_bin", bins(*a)), right.withColumn("_bin", bins(*b))
    meet = (F.col(a[0]) <= F.col(b[1])) & (F.col(b[0]) <= F.col(a[1]))
    return x.join(y, "_bin").filter(meet & (F.col("_bin") == F.floor(F.greatest(F.col(a[0]), F.col(b[0])) / width))).drop("_bin")


def salted(big: DataFrame, small: DataFrame, on: str, salts: int, how: str = "inner", salt: Column | None = None) -> DataFrame:
    """An equi-join whose hot keys spread over ``salts`` tasks: ``small`` is repeated for every salt.

    The salt is a hash of the row (or of ``salt``), never random: a task that runs again deals its rows out alike.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(how)
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns) if salt is None else salt, F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [on, "_salt"], how).drop("_salt")

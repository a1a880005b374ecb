"""Counters as folds of an operation log (key, seq, delta[, bound])."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeline.functions.numeric import I64_MAX, I64_MIN, saturating_sum


def totals(ops: DataFrame) -> DataFrame:
    """INCR and DECR: the sum of all deltas, held to a long."""
    return ops.groupBy("key").agg(saturating_sum(F.col("delta")).alias("value"))


def running(ops: DataFrame) -> DataFrame:
    """The value after each operation."""
    w = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum(F.col("delta").cast("decimal(38,0)")).over(w)
    return ops.select("key", "seq", F.greatest(F.least(total, F.lit(I64_MAX).cast("decimal(38,0)")), F.lit(I64_MIN).cast("decimal(38,0)")).cast("bigint").alias("value"))


def limited(ops: DataFrame, limit: int, down: bool = False) -> DataFrame:
    """INCRLIMIT and DECRLIMIT: an operation applies only if the result is within the limit. Order matters, so each
    key's operations are folded in sequence; a key's list lives in one row."""
    ordered = ops.filter(F.col("delta") > 0).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seq", "delta"))).alias("ops"))
    step = (lambda a, x: F.when(a - x["delta"] >= limit, a - x["delta"]).otherwise(a)) if down else (lambda a, x: F.when(a + x["delta"] <= limit, a + x["delta"]).otherwise(a))
    return ordered.select("key", F.aggregate("ops", F.lit(0).cast("bigint"), step).alias("value"))


def extremes(ops: DataFrame) -> DataFrame:
    """INCRTO and DECRTO: running maximum and minimum."""
    return ops.groupBy("key").agg(F.max("delta").alias("incrto"), F.min("delta").alias("decrto"))

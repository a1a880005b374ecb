"""One-pass numeric summaries: partial accumulators that merge, and the statistics derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PARTS = ["n", "open", "close", "low", "high", "total", "squares", "inverses", "logs"]
NAMES = ["count", "open", "close", "first", "last", "min", "max", "sum", "sumsq", "sum2", "range", "change", "avg", "harm", "geom", "vari", "sdev", "rms", "cvar"]


def _finite(value: Column) -> Column:
    return ~F.isnan(value) & value.isNotNull() & (F.abs(value) != F.lit(float("inf")))


def _parts(value: Column, order: Column) -> dict[str, Column]:
    v = value.cast("double")
    return {
        "n": F.count(F.lit(1)),
        "open": F.min_by(v, order),
        "close": F.max_by(v, order),
        "low": F.min(v),
        "high": F.max(v),
        "total": F.sum(v),
        "squares": F.sum(v * v),
        "inverses": F.sum(F.when(v != 0, F.lit(1.0) / v).otherwise(0.0)),
        "logs": F.sum(F.when(v > 0, F.log(v)).otherwise(0.0)),
    }


def collect(rows: DataFrame, value: str, order: str, by: list[str] | None = None) -> DataFrame:
    """Accumulators of each group; values that are not finite are skipped."""
    return rows.filter(_finite(F.col(value))).groupBy(*(by or [])).agg(*[c.alias(n) for n, c in _parts(F.col(value), F.col(order)).items()], F.min(order).alias("from"), F.max(order).alias("to"))


def merge(parts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accumulators of groups put together, oldest first."""
    return parts.groupBy(*(by or [])).agg(
        F.sum("n").alias("n"), F.min_by("open", "from").alias("open"), F.max_by("close", "to").alias("close"), F.min("low").alias("low"), F.max("high").alias("high"),
        *[F.sum(c).alias(c) for c in ("total", "squares", "inverses", "logs")], F.min("from").alias("from"), F.max("to").alias("to"),
    )


def statistics(parts: DataFrame, by: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """The named statistics; variance is that of the population, and an empty summary is all zeros."""
    n = F.col("n")
    avg = F.col("total") / n
    vari = F.when(n <= 1, F.lit(0.0)).otherwise(F.greatest(F.col("squares") / n - avg * avg, F.lit(0.0)))
    values = {
        "count": n.cast("double"),
        "open": F.col("open"), "close": F.col("close"), "first": F.col("open"), "last": F.col("close"),
        "min": F.col("low"), "max": F.col("high"), "sum": F.col("total"), "sumsq": F.col("squares"), "sum2": F.col("squares"),
        "range": F.col("high") - F.col("low"),
        "change": F.col("close") - F.col("open"),
        "avg": avg,
        "harm": F.when(F.col("inverses") == 0, F.lit(0.0)).otherwise(n / F.col("inverses")),
        "geom": F.exp(F.col("logs") / n),
        "vari": vari,
        "sdev": F.sqrt(vari),
        "rms": F.sqrt(F.col("squares") / n),
        "cvar": F.when(avg == 0, F.lit(0.0)).otherwise(F.sqrt(vari) / avg),
    }
    cut = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    return parts.select(*(by or []), *[F.when(n > 0, cut(c)).otherwise(F.lit(0.0)).alias(k) for k, c in values.items()])


def as_rows(stats: DataFrame, by: list[str]) -> DataFrame:
    """Name and value rows, in the fixed order of NAMES."""
    pairs = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(k).alias("name"), F.col(k).alias("value")) for i, k in enumerate(NAMES)])
    return stats.select(*by, F.inline(pairs))


def running(rows: DataFrame, value: str, order: str, by: list[str], digits: int | None = None) -> DataFrame:
    """The statistics after each row of its group, beside the row's order."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.filter(_finite(F.col(value)))
    parts = found.select(*by, order, *[c.over(w).alias(n) for n, c in _parts(F.col(value), F.col(order)).items()])
    return statistics(parts, [*by, order], digits)

"""Numbers kept as text, and saturating arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

I64_MIN, I64_MAX = -(1 << 63), (1 << 63) - 1


def parse_i64(text: Column) -> Column:
    """The longest leading ``-?[0-9]+`` as a long; 0 for anything else, and for what does not fit."""
    digits = F.regexp_extract(text, r"^(-?[0-9]+)", 1)
    return F.coalesce(F.when(digits == "", F.lit(0)).otherwise(digits.try_cast("bigint")), F.lit(0)).cast("bigint")


def saturate(value: Column) -> Column:
    """A decimal held to the range of a long."""
    wide = value.cast("decimal(38,0)")
    return F.greatest(F.least(wide, F.lit(I64_MAX).cast("decimal(38,0)")), F.lit(I64_MIN).cast("decimal(38,0)")).cast("bigint")


def saturating_sum(value: Column) -> Column:
    """Sum without overflow, held to the range of a long at the end."""
    return saturate(F.sum(value.cast("decimal(38,0)")))

"""Ordered scans by prefix, range or to the end, with keyset pages; and aggregates over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.functions.numeric import I64_MAX, I64_MIN, parse_i64


def within(start: str = "", prefix: str | None = None, end: str | None = None) -> Column:
    """Keys from ``start`` on that have the prefix, or are not beyond ``end`` (inclusive)."""
    out = F.col("key") >= start
    if prefix is not None:
        out &= F.col("key").startswith(prefix)
    if end is not None:
        out &= F.col("key") <= end
    return out


def page(rows: DataFrame, start: str, n: int, prefix: str | None = None, end: str | None = None, keys_only: bool = False) -> DataFrame:
    """The first n rows in key order, and one more whose key is where the next page starts (is_tail)."""
    found = rows.filter(within(start, prefix, end)).orderBy("key").limit(n + 1)
    found = found.select("key", F.lit("1").alias("val")) if keys_only else found.select("key", "val")
    last = F.row_number().over(_by_key()) > n  # over n + 1 rows
    return found.select("key", F.when(last, F.lit("")).otherwise(F.col("val")).alias("val"), last.alias("is_tail"))


def _by_key():
    from pyspark.sql.window import Window

    return Window.partitionBy(F.lit(1)).orderBy("key")


def next_row(rows: DataFrame, key: str, prefix: str | None = None, end: str | None = None) -> DataFrame:
    """The first row strictly after ``key``."""
    return rows.filter(within("", prefix, end) & (F.col("key") > key)).orderBy("key").limit(1).select("key", "val")


def nth(rows: DataFrame, index: int) -> DataFrame:
    """The row at a place in key order, from 0."""
    return rows.orderBy("key").offset(index).limit(1).select("key", "val")


def pages(rows: DataFrame, n: int, prefix: str = ""):
    """Client-side iteration: lists of (key, val), one page at a time, by keyset."""
    start = prefix
    while True:
        got = page(rows, start, n, prefix=prefix).orderBy("key").collect()  # n + 1 rows at most
        yield [(r.key, r.val) for r in got if not r.is_tail]
        tail = [r.key for r in got if r.is_tail]
        if not tail:
            return
        start = tail[0]


def glob(rows: DataFrame, pattern: str) -> DataFrame:
    """Keys that a shell pattern (* ? [set]) matches."""
    import re

    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif close > 0:
            inner = pattern[i + 1 : close]
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]"
            i = close
        else:
            out += re.escape(c)
        i += 1
    fixed = re.match(r"[^*?\[]*", pattern)[0]
    return rows.filter(F.col("key").startswith(fixed) & F.col("key").rlike(f"(?s)^{out}$"))


AGGREGATES = ("count", "sum", "min", "max", "first", "last", "avg")


def aggregates() -> dict[str, Column]:
    """Each aggregate of the values as longs; empty input gives 0, the type's bounds, "" and null."""
    v = parse_i64(F.col("val"))
    total, n = F.sum(v.cast("decimal(38,0)")), F.count(F.lit(1))
    return {
        "count": n,
        "sum": F.coalesce(total, F.lit(0)).cast("bigint"),
        "min": F.coalesce(F.min(v), F.lit(I64_MAX)),
        "max": F.coalesce(F.max(v), F.lit(I64_MIN)),
        "first": F.coalesce(F.min_by("val", "key"), F.lit("")),
        "last": F.coalesce(F.max_by("val", "key"), F.lit("")),
        "avg": F.when(n > 0, F.expr("cast(cast(sum(%s) as decimal(38,0)) as decimal(38,0)) div count(1)" % _PARSED)),
    }


_PARSED = "cast(coalesce(try_cast(regexp_extract(val, '^(-?[0-9]+)', 1) as bigint), 0) as decimal(38,0))"


def accumulate(rows: DataFrame, name: str, prefix: str | None = None, end: str | None = None, start: str = "", number: int | None = None) -> DataFrame:
    """One aggregate over a scan; with ``number`` only over the first rows of it."""
    found = rows.filter(within(start, prefix, end))
    if number is not None:
        found = found.orderBy("key").limit(number)
    return found.agg(aggregates()[name].alias(name))


def accumulate_by(rows: DataFrame, group: Column, *names: str) -> DataFrame:
    """The grouped form: aggregates of every group at once."""
    every = aggregates()
    return rows.groupBy(group.alias("group")).agg(*[every[n].alias(n) for n in names or AGGREGATES])

"""Versioned key-value rows as an append-only change log, and every read and write over it.

A log has columns key, val, created_us, expires_s, is_tombstone, seq. Reads see the newest live version of a key. Writes
take the log and requests and return the versions to append; nothing is changed in place. ``now`` is always a parameter
(microseconds), so that every result can be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ["key", "val", "created_us", "expires_s", "is_tombstone", "seq"]
SCHEMA = "key string, val string, created_us long, expires_s long, is_tombstone boolean, seq long"
MAX_KEY, MAX_VAL = 1023, 268_435_455
SEPARATOR = "~"


def latest(log: DataFrame) -> DataFrame:
    """The newest version of each key, dead or alive. Filters on the key reach the scan below the aggregate."""
    rest = [c for c in log.columns if c != "key"]
    newest = log.groupBy("key").agg(F.max_by(F.struct(*rest), F.struct("created_us", "seq")).alias("v"))
    return newest.select("key", *[F.col(f"v.{c}").alias(c) for c in rest])


def is_live(now: int) -> Column:
    fresh = (F.col("expires_s") == 0) | (F.col("created_us") + F.col("expires_s") * 1_000_000 >= now)
    return ~F.col("is_tombstone") & (F.length("val") > 0) & fresh


def live(log: DataFrame, now: int) -> DataFrame:
    return latest(log).filter(is_live(now))


def _hash_key(name: str | Column, field: Column) -> Column:
    return F.concat(F.lit(name) if isinstance(name, str) else name, F.lit(SEPARATOR), field)


# Point reads


def get(log: DataFrame, key: str, now: int) -> DataFrame:
    """One row: the value, or "" where there is none."""
    return live(log.filter(F.col("key") == key), now).agg(F.coalesce(F.max("val"), F.lit("")).alias("val"))


def mget(log: DataFrame, requests: DataFrame, now: int) -> DataFrame:
    """requests (pos, key) with val, "" where absent."""
    found = live(log, now).select("key", "val")
    return requests.join(found, "key", "left").select("pos", "key", F.coalesce("val", F.lit("")).alias("val"))


def exists(log: DataFrame, requests: DataFrame, now: int) -> DataFrame:
    found = live(log, now).select("key").withColumn("found", F.lit(1))
    return requests.join(found, "key", "left").select("key", F.coalesce("found", F.lit(0)).alias("exists"))


def meta(log: DataFrame, now: int) -> DataFrame:
    """Of each live key: ttl, expiretime, strlen, sizeof (header, key, value and two terminators)."""
    expires = F.floor((F.col("created_us") / 1_000_000)).cast("long") + F.col("expires_s")
    return live(log, now).select(
        "key",
        F.when(F.col("expires_s") > 0, F.greatest(F.lit(0).cast("long"), expires - F.lit(now // 1_000_000))).otherwise(F.lit(0)).cast("long").alias("ttl"),
        F.when(F.col("expires_s") > 0, expires).otherwise(F.lit(0)).cast("long").alias("expiretime"),
        F.octet_length("val").cast("long").alias("strlen"),
        (F.octet_length("key") + F.octet_length("val") + 18 + 2).cast("long").alias("sizeof"),
    )


def getrange(log: DataFrame, start: int, finish: int, now: int) -> DataFrame:
    """Bytes start to finish, both inclusive, of each live value."""
    size = F.octet_length("val")
    cut = F.when((F.lit(finish) < F.lit(start)) | (F.lit(start) >= size), F.lit("")).otherwise(F.substring(F.col("val").cast("binary"), start + 1, max(0, finish - start + 1)).cast("string"))
    return live(log, now).select("key", cut.alias("part"))


def dump(log: DataFrame) -> DataFrame:
    """The newest version of each key as JSON, dead ones included."""
    return latest(log).select("key", F.to_json(F.struct(*[c for c in COLUMNS if c in log.columns])).alias("dump"))


def fields(log: DataFrame, name: str, now: int) -> DataFrame:
    """(field, val) of the hash ``name``."""
    prefix = name + SEPARATOR
    return live(log.filter(F.col("key").startswith(prefix)), now).select(F.substring("key", len(prefix) + 1, MAX_KEY).alias("field"), "val")


# Writes


def _versions(rows: DataFrame, now: int, val: Column, expires: Column | int = 0, dead: Column | bool = False) -> DataFrame:
    as_column = lambda x, kind: (x if isinstance(x, Column) else F.lit(x)).cast(kind)
    return rows.select(
        "key",
        val.cast("string").alias("val"),
        F.lit(now).cast("long").alias("created_us"),
        as_column(expires, "long").alias("expires_s"),
        (as_column(dead, "boolean") | (F.coalesce(F.length(val), F.lit(0)) == 0)).alias("is_tombstone"),
        F.lit(now).cast("long").alias("seq"),
    )


def _seconds(requests: DataFrame) -> Column | int:
    return F.coalesce("seconds", F.lit(0)) if "seconds" in requests.columns else 0


def put(requests: DataFrame, now: int) -> DataFrame:
    """SET, MSET, SETEX, HSET, HMSET: upsert (key, val[, seconds]); an empty value deletes."""
    return _versions(requests, now, F.col("val"), _seconds(requests))


def put_absent(log: DataFrame, requests: DataFrame, now: int) -> DataFrame:
    return put(requests.join(live(log, now).select("key"), "key", "left_anti"), now)


def put_present(log: DataFrame, requests: DataFrame, now: int) -> DataFrame:
    return put(requests.join(live(log, now).select("key"), "key", "left_semi"), now)


def put_all_absent(log: DataFrame, requests: DataFrame, now: int) -> DataFrame:
    """All requests if none of their keys is live, else none."""
    taken = requests.join(live(log, now).select("key"), "key", "left_semi").agg(F.count(F.lit(1)).alias("n")).filter("n = 0")
    return put(requests.join(F.broadcast(taken), F.lit(True)).drop("n"), now)


def put_all_present(log: DataFrame, requests: DataFrame, now: int) -> DataFrame:
    """All requests if all of their keys are live, else none."""
    absent = requests.join(live(log, now).select("key"), "key", "left_anti").agg(F.count(F.lit(1)).alias("n")).filter("n = 0")
    return put(requests.join(F.broadcast(absent), F.lit(True)).drop("n"), now)


def delete(keys: DataFrame, now: int) -> DataFrame:
    return _versions(keys, now, F.lit(""), 0, True)


def append(log: DataFrame, requests: DataFrame, now: int) -> DataFrame:
    """Requests (key, more[, pos]): the value so far with more after it. Several requests of one key are added in the
    order of pos, or of what they add where there is none."""
    pos = "pos" if "pos" in requests.columns else "more"
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("at"), "more"))), lambda x: x["more"])
    added = requests.groupBy("key").agg(F.array_join(parts, "").alias("more"))
    old = live(log, now).select("key", "val")
    return _versions(added.join(old, "key", "left"), now, F.concat(F.coalesce("val", F.lit("")), F.col("more")))


def _remaining(now: int) -> Column:
    left = F.floor((F.col("created_us") + F.col("expires_s") * 1_000_000 - now) / 1_000_000).cast("long")
    return F.when(F.col("expires_s") > 0, F.greatest(left, F.lit(1))).otherwise(F.lit(0))


def expire(rows: DataFrame, now: int, seconds: int) -> DataFrame:
    """New versions of live ``rows`` that expire in ``seconds``."""
    return _versions(rows, now, F.col("val"), seconds)


def expire_at(rows: DataFrame, now: int, timestamp: int) -> DataFrame:
    """Expiry at a second; one that is past deletes."""
    left = timestamp - now // 1_000_000
    return delete(rows, now) if left <= 0 else expire(rows, now, left)


def persist(rows: DataFrame, now: int) -> DataFrame:
    return _versions(rows, now, F.col("val"), 0)


def revive(log: DataFrame, now: int) -> DataFrame:
    """The last value of keys that expired or were deleted, without expiry."""
    last = log.filter(F.length("val") > 0)
    return persist(latest(last).join(live(log, now).select("key"), "key", "left_anti"), now)


def swap(log: DataFrame, requests: DataFrame, now: int) -> DataFrame:
    """GETSET: the old value beside the new one."""
    return requests.join(live(log, now).select("key", F.col("val").alias("old")), "key", "left").select("key", F.coalesce("old", F.lit("")).alias("old"), "val")


def get_and(log: DataFrame, keys: DataFrame, now: int, write) -> tuple[DataFrame, DataFrame]:
    """GETDEL, GETEX, GETEXAT, GETPERSIST: the live values of ``keys``, and the versions that ``write`` makes of those
    rows, such as ``lambda rows: delete(rows, now)``."""
    rows = live(log, now).join(keys.select("key").distinct(), "key", "left_semi")
    values = keys.join(rows.select("key", "val"), "key", "left").select("key", F.coalesce("val", F.lit("")).alias("val"))
    return values, write(rows)


def in_prefix(prefix: str) -> Column:
    return F.col("key").startswith(prefix)


def in_range(start: str, end: str) -> Column:
    return (F.col("key") >= start) & (F.col("key") <= end)


def compare_and_set(log: DataFrame, requests: DataFrame, now: int) -> DataFrame:
    """Requests (key, old, val): versions for those whose live value equals old, which must not be empty."""
    have = live(log, now).select("key", F.col("val").alias("have"))
    return put(requests.join(have, "key").filter((F.col("have") == F.col("old")) & (F.length("old") > 0)), now)


def compare_and_delete(log: DataFrame, requests: DataFrame, now: int) -> DataFrame:
    have = live(log, now).select("key", F.col("val").alias("have"))
    return delete(requests.join(have, "key").filter(F.col("have") == F.col("old")).select("key"), now)


def copy(log: DataFrame, requests: DataFrame, now: int, move: bool = False, absent_only: bool = False) -> DataFrame:
    """Requests (old_key, new_key): value and remaining expiry under the new key; with ``move`` the old key dies."""
    have = live(log, now)
    found = requests.join(have, requests["old_key"] == have["key"]).drop("key")
    if absent_only:
        found = found.join(live(log, now).select(F.col("key").alias("taken")), F.col("new_key") == F.col("taken"), "left_anti")
    out = _versions(found.withColumn("key", F.col("new_key")), now, F.col("val"), _remaining(now))
    return out.unionByName(delete(found.filter("old_key <> new_key").select(F.col("old_key").alias("key")), now)) if move else out


# Files


def write_sorted(log: DataFrame, path: str, files: int | None = None, bloom: bool = False) -> None:
    """A table sorted by key, so that prefix and range reads skip by file and row-group statistics; with ``bloom`` a
    Bloom filter in each row group answers exact lookups of absent keys."""
    rows = log.repartitionByRange(files, "key") if files else log.repartitionByRange("key")
    out = rows.sortWithinPartitions("key", F.desc("created_us"), F.desc("seq")).write
    if bloom:
        out = out.option("parquet.bloom.filter.enabled#key", "true")
    out.parquet(path)


def compact(log: DataFrame, now: int | None = None) -> DataFrame:
    """Merged tables: the newest version of each key; with ``now`` dead rows go too."""
    return latest(log) if now is None else live(log, now)


def merge(*logs: DataFrame) -> DataFrame:
    """Any number of sorted tables as one: the newest version of each key; of equal versions the first table's."""
    every = logs[0].withColumn("_table", F.lit(0))
    for i, more in enumerate(logs[1:], 1):
        every = every.unionByName(more.withColumn("_table", F.lit(-i)))
    rest = [c for c in logs[0].columns if c != "key"]
    newest = every.groupBy("key").agg(F.max_by(F.struct(*rest), F.struct("created_us", "seq", "_table")).alias("v"))
    return newest.select("key", *[F.col(f"v.{c}").alias(c) for c in rest])


def size(log: DataFrame, now: int) -> DataFrame:
    """Rows of the log, keys, and live keys."""
    newest = latest(log)
    raw = log.agg(F.count(F.lit(1)).alias("raw"))
    return newest.agg(F.count(F.lit(1)).alias("keys"), F.count(F.when(is_live(now), 1)).alias("live")).join(raw, F.lit(True)).select("raw", "keys", "live")

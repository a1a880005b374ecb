"""Lists, ring buffers, queues, hashes, bit arrays and fixed-width records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Lists: (key, seq, item)


def lists(items: DataFrame) -> DataFrame:
    return items.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "item"))), lambda x: x["item"]).alias("items"))


def list_get(lists_: DataFrame, *index: int) -> DataFrame:
    """Items by index from 0, "" out of range, and the length."""
    return lists_.select("key", *[F.coalesce(F.get("items", F.lit(i)), F.lit("")).alias(f"item{i}") for i in index], F.size("items").cast("long").alias("length"))


# Ring buffers: the last n items of each key


def ring(items: DataFrame, n: int, popped: int = 0) -> DataFrame:
    """Each key's last ``n`` items, oldest first, after the oldest ``popped`` of them have gone.

    Rows are cut by rank before they are gathered, so no more than n of a key meet in one row.
    """
    w = Window.partitionBy("key").orderBy(F.desc("seq"))
    last = items.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n)
    kept = lists(last).select("key", F.expr(f"slice(items, {popped + 1}, {n})").alias("items"))
    return kept.select("key", "items", F.size("items").cast("long").alias("n_items"))


# Queues: (queue, seq, val[, expires_us])


def queue_pop(items: DataFrame, now: int, n: int = 1) -> DataFrame:
    """The oldest ``n`` live items of each queue, in order."""
    alive = items.filter((F.col("expires_us") == 0) | (F.col("expires_us") >= now)) if "expires_us" in items.columns else items
    w = Window.partitionBy("queue").orderBy("seq")
    return alive.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).select("queue", "place", "val")


def queue_rest(items: DataFrame, n: int = 1) -> DataFrame:
    w = Window.partitionBy("queue").orderBy("seq")
    return items.withColumn("_place", F.row_number().over(w)).filter(F.col("_place") > n).drop("_place")


# Hashes: (name, field, val)


def hashes(rows: DataFrame) -> DataFrame:
    """One map a name, in field order."""
    return rows.groupBy("name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "val")))).alias("map"))


def hash_read(maps: DataFrame, *fields: str) -> DataFrame:
    """Length, field names, values, and chosen fields ("" where absent)."""
    return maps.select(
        "name",
        F.size("map").cast("long").alias("hlen"),
        F.array_join(F.array_sort(F.map_keys("map")), ",").alias("keys"),
        *[F.coalesce(F.try_element_at("map", F.lit(f)), F.lit("")).alias(f"f_{f}") for f in fields],
        *[F.map_contains_key("map", F.lit(f)).alias(f"has_{f}") for f in fields],
    )


# Bit arrays: (key, idx, bit), in buckets of 32,768 bits


MAX_BIT = 268_435_455 * 8


def bitsets(bits: DataFrame) -> DataFrame:
    """(key, bucket, bits): the set bits of each key, after the last write to each index."""
    last = bits.groupBy("key", "idx").agg(F.max_by("bit", "seq").alias("bit")).filter("bit = 1") if "seq" in bits.columns else bits.filter("bit = 1")
    at = F.col("idx") + 1
    return last.groupBy("key", F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))


def bit_count(sets: DataFrame) -> DataFrame:
    return sets.groupBy("key").agg(F.sum(F.bitmap_count("bits")).alias("bits"))


def bit_get(sets: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (key, idx) with bit 0 or 1."""
    at = F.col("idx") + 1
    asked = requests.withColumn("bucket", F.bitmap_bucket_number(at)).withColumn("_at", F.bitmap_bit_position(at))
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(F.col("_at") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.expr("shiftright(_byte, cast(_at % 8 as int)) & 1")
    return asked.join(sets, ["key", "bucket"], "left").withColumn("_byte", byte).select("key", "idx", F.coalesce(bit, F.lit(0)).alias("bit"))


# Records: a schema "3:id,10:name" names fields of fixed width, padded with spaces


def record_schema(text: str) -> list[tuple[str, int, int]]:
    """(name, offset, size) of each field."""
    out, at = [], 0
    for part in text.split(","):
        size, name = part.split(":", 1)
        out.append((name.strip(), at, int(size)))
        at += int(size)
    return out


def record_pack(schema: str, *values: Column) -> Column:
    return F.concat(*[F.rpad(F.substring(v, 1, size), size, " ") for (_, _, size), v in zip(record_schema(schema), values, strict=True)])


def record_get(schema: str, record: Column, name: str) -> Column:
    """A field, spaces at its end trimmed; "" for one the schema does not have."""
    for field, at, size in record_schema(schema):
        if field == name:
            return F.rtrim(F.substring(record, at + 1, size))
    return F.lit("")


def record_all(schema: str, record: Column) -> list[Column]:
    return [record_get(schema, record, name).alias(name) for name, _, _ in record_schema(schema)]


def record_set(schema: str, record: Column, **values: Column) -> Column:
    out = record
    for field, at, size in record_schema(schema):
        if field in values:
            out = F.overlay(out, F.rpad(F.substring(values[field], 1, size), size, " "), F.lit(at + 1), F.lit(size))
    return out


def record_clear(schema: str, record: Column, *names: str) -> Column:
    return record_set(schema, record, **{n: F.lit("") for n in names})


def record_blank(schema: str) -> Column:
    return F.rpad(F.lit(""), sum(size for _, _, size in record_schema(schema)), " ")

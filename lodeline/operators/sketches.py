"""Mergeable sketches as plain tables: distinct counts, membership, frequencies, heavy hitters, samples, centroids.

Hash-based sketches are group-bys over (slot, value) rows, so they are built with partial aggregation and merged by the
same aggregate. Sketches that depend on order take a ``seq`` column and fold each group in its own task.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeline.functions.hashing import as_bytes, murmur64a, slots, slots_of
from lodeline.functions.session import ship
from lodeline.sources import blocks

# Distinct counts: 4,096 registers

HLL_BITS = 12
HLL_ERROR = 1.04 / (1 << HLL_BITS) ** 0.5


def hll(rows: DataFrame, value: Column, by: list[str]) -> DataFrame:
    """(by, idx, rank): for each register the longest run of zeros seen, plus one. Null counts as the empty value."""
    ship(rows.sparkSession)

    @F.pandas_udf("struct<idx:int,rank:int>")
    def register(s: pd.Series) -> pd.DataFrame:
        h = murmur64a(as_bytes(s))
        idx = (h >> np.uint64(64 - HLL_BITS)).astype(np.int32)
        rest = (h << np.uint64(HLL_BITS)) | np.uint64((1 << HLL_BITS) - 1)
        high = np.frexp((rest >> np.uint64(12)).astype(np.float64))[1] + 12  # bit length by the top 52 bits
        high = np.where(rest >> np.uint64(12) == 0, np.frexp(rest.astype(np.float64))[1], high)
        return pd.DataFrame({"idx": idx, "rank": (64 - high + 1).astype(np.int32)})

    found = rows.select(*by, register(value.cast("string")).alias("r"))
    return found.groupBy(*by, F.col("r.idx").alias("idx")).agg(F.max("r.rank").alias("rank"))


def hll_merge(registers: DataFrame, by: list[str] | None = None) -> DataFrame:
    return registers.groupBy(*(by or []), "idx").agg(F.max("rank").alias("rank"))


def hll_estimate(registers: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, estimate): harmonic mean of the registers, by linear counting while many are empty."""
    m = float(1 << HLL_BITS)
    alpha = 0.7213 / (1 + 1.079 / m)
    found = registers.groupBy(*(by or [])).agg(F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("_hll_sum"), F.count(F.lit(1)).alias("_hll_n"))
    empty = F.lit(m) - F.col("_hll_n")
    raw = alpha * m * m / (F.coalesce("_hll_sum", F.lit(0.0)) + empty)
    return found.select(*(by or []), F.when((raw <= 2.5 * m) & (empty > 0), m * F.log(F.lit(m) / empty)).otherwise(raw).alias("estimate"))


def hll_relations(registers: DataFrame, by: str, names: list) -> DataFrame:
    """Estimates of every union of the named sets (five at most), and from them intersection, Jaccard and overlap."""
    if len(names) > 5:
        raise ValueError("five sets at most")
    subsets = [c for r in range(1, len(names) + 1) for c in combinations(names, r)]
    member = F.array(*[F.when(F.col(by).isin(list(c)), F.lit(i)) for i, c in enumerate(subsets)])
    unions = hll_estimate(hll_merge(registers.filter(F.col(by).isin(list(names))).withColumn("subset", F.explode(F.filter(member, lambda x: x.isNotNull()))), ["subset"]), ["subset"])
    sign = F.create_map(*[F.lit(x) for i, c in enumerate(subsets) for x in (i, 1.0 if len(c) % 2 else -1.0)])
    size = F.create_map(*[F.lit(x) for i, c in enumerate(subsets) for x in (i, len(c))])
    whole = F.max(F.when(F.col("subset") == len(subsets) - 1, F.col("estimate")))
    singles = F.when(size[F.col("subset")] == 1, F.col("estimate"))
    parts = unions.agg(whole.alias("u"), F.sum(sign[F.col("subset")] * F.col("estimate")).alias("i"), F.sum(singles).alias("total"), F.min(singles).alias("least"))
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return parts.select(F.col("u").alias("union"), F.col("i").alias("intersection"), F.when(F.col("u") < 0.001, F.lit(0.0)).otherwise(clamp((F.col("total") - F.col("u")) / F.col("u"))).alias("jaccard"), clamp((F.col("total") - F.col("u")) / F.col("least")).alias("overlap"))


# Membership and frequencies: (slot[, row], n)


#: Slots that a task adding to a filter holds before it passes words on, words of the filter that a task asking it holds
#: at once, and items that it asks for at once where the filter has more.
BLOOM_HELD, BLOOM_BLOCK, BLOOM_ASKED = 1 << 20, 1 << 18, 1 << 16


def bloom(rows: DataFrame, value: Column, bits: int, hashes: int) -> DataFrame:
    """(word, mask): the words of 64 bits that have set bits. Tasks pass on words, not a row for each slot of an item."""
    ship(rows.sparkSession)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(np.unique(slots_of(as_bytes(pc.unique(batch.column(0)).to_pylist()), bits, hashes)))
            size += len(held[-1])
            if size >= BLOOM_HELD:
                held = [np.unique(np.concatenate(held))]
                size = len(held[0])
                if size >= BLOOM_HELD // 2:
                    yield words(held[0])
                    held, size = [], 0
        if size:
            yield words(np.unique(np.concatenate(held)))

    def words(slot: np.ndarray) -> pa.RecordBatch:
        word, first = np.unique(slot >> 6, return_index=True)
        mask = np.bitwise_or.reduceat(np.uint64(1) << (slot & 63).astype(np.uint64), first)
        return pa.RecordBatch.from_arrays([pa.array(word), pa.array(mask.view(np.int64))], ["word", "mask"])

    found = rows.select(value.cast("string").alias("item")).mapInArrow(run, "word long, mask long")
    return found.groupBy("word").agg(F.bit_or("mask").alias("mask"))


def bloom_exists(filter_: DataFrame, items: DataFrame, bits: int, hashes: int) -> DataFrame:
    """items (item and others) with found, 1 where all bits are set. Never 0 for an item that was added.

    The filter is written to the shared folder in blocks; a task asks one after the other for the items of a batch, so it
    holds a block and a batch, and items are neither shuffled nor repeated for each of their slots.
    """
    files = blocks.write(filter_.select("word", "mask"), BLOOM_BLOCK, -(-bits // 64))

    def run(batches):
        for batch in batches if len(files) <= 1 else joined(batches):
            slot = slots_of(as_bytes(batch.column("item").to_pylist()), bits, hashes)
            hit = np.zeros(slot.shape, bool)
            for file in files:
                word, mask = block(file)
                at = np.minimum(np.searchsorted(word, slot >> 6), len(word) - 1)
                hit |= (word[at] == slot >> 6) & (mask[at] >> (slot & 63).astype(np.uint64) & np.uint64(1) == 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit.all(axis=1).astype(np.int32))], [*batch.schema.names, "found"])

    def joined(batches):
        """More items at once, as each time all blocks are read."""
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= BLOOM_ASKED:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    last: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def block(file: str) -> tuple[np.ndarray, np.ndarray]:
        if file not in last:
            last.clear()
            pdf = blocks.read(file).sort_values("word")
            last[file] = pdf["word"].to_numpy(), pdf["mask"].to_numpy().view(np.uint64)
        return last[file]

    kinds = T.StructType([f for f in items.schema.fields if f.name != "found"] + [T.StructField("found", T.IntegerType())])
    return items.drop("found").mapInArrow(run, kinds)


def _top(size: int) -> int:
    return (1 << size) - 1 if size < 64 else (1 << 63) - 1


def _amount(amount: Column) -> Column:
    return F.when(amount < 0, -F.greatest(-amount, F.lit(1))).otherwise(F.greatest(amount, F.lit(1))).cast("decimal(38,0)")


def _held(total: Column, size: int) -> Column:
    return F.greatest(F.least(total, F.lit(_top(size)).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("bigint")


def _who(value: Column) -> Column:
    """64 bits that stand for an item; null is the empty item, as in its slots."""
    return F.xxhash64(F.coalesce(value.cast("string"), F.lit("")))


def counters(rows: DataFrame, value: Column, amount: Column, width: int, depth: int, size: int = 64, by_row: bool = True, owned: bool = False) -> DataFrame:
    """(row, slot, n): count-min rows (by_row) or one counting Bloom array; counters of ``size`` bits saturate.

    An amount below 1 counts as 1, with its sign: negative amounts subtract, never below 0. With ``owned``, (low, high)
    are the least and greatest item hash of a counter: where they are equal, it counts one item only.
    """
    who = [_who(value).alias("who")] if owned else []
    each = rows.select(_amount(amount).alias("n"), *who, F.posexplode(slots(value.cast("string"), width, depth)).alias("row", "slot"))
    key = ["row", "slot"] if by_row else ["slot"]
    return each.groupBy(*key).agg(_held(F.sum("n"), size).alias("n"), *([F.min("who").alias("low"), F.max("who").alias("high")] if owned else []))


def counters_merge(*tables: DataFrame, size: int = 64) -> DataFrame:
    key = [c for c in tables[0].columns if c != "n"]
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    return every.groupBy(*key).agg(F.least(F.sum(F.col("n").cast("decimal(38,0)")), F.lit(_top(size)).cast("decimal(38,0)")).cast("bigint").alias("n"))


def counters_estimate(table: DataFrame, items: DataFrame, width: int, depth: int, by_row: bool = True) -> DataFrame:
    """items (item) with the smallest of their counters."""
    asked = items.select("item", F.posexplode(slots(F.col("item"), width, depth)).alias("row", "slot"))
    key = ["row", "slot"] if by_row else ["slot"]
    return asked.join(table, key, "left").groupBy("item").agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def counters_exact(rows: DataFrame, value: Column, amount: Column, items: DataFrame, width: int, depth: int, size: int = 64, by_row: bool = True) -> DataFrame:
    """items (item) with their amounts, exactly, however many items share the counters.

    An item that meets an empty counter, or one of a single item, is told by it: by its own, the amount; else 0. Those
    whose counters are all shared are added up from the rows.
    """
    key = ["row", "slot"] if by_row else ["slot"]
    table = counters(rows, value, amount, width, depth, size, by_row, owned=True)
    asked = items.select("item", _who(F.col("item")).alias("who"), F.posexplode(slots(F.col("item"), width, depth)).alias("row", "slot"))
    sure = F.when(F.col("low").isNull(), F.lit(0)).when(F.col("low") == F.col("high"), F.when(F.col("low") == F.col("who"), F.col("n")).otherwise(F.lit(0)))
    told = asked.join(table, key, "left").groupBy("item").agg(F.min(sure).alias("sure"))
    shared = told.filter(F.col("sure").isNull()).select("item")
    rest = rows.select(F.coalesce(value.cast("string"), F.lit("")).alias("_item"), _amount(amount).alias("n")).join(shared.select(F.coalesce("item", F.lit("")).alias("_item")).distinct(), "_item").groupBy("_item").agg(_held(F.sum("n"), size).alias("n"))
    return told.join(rest, F.coalesce(told["item"], F.lit("")) == rest["_item"], "left").select("item", F.coalesce("sure", "n", F.lit(0)).alias("estimate"))


class Cuckoo:
    """A cuckoo filter: four fingerprints a bucket, two buckets an item; a failed insert is undone."""

    SLOTS, KICKS = 4, 256

    def __init__(self, width: int, bits: int):
        self.width, self.bits = max(1, width), bits
        self.table: list[list[int]] = [[] for _ in range(self.width)]

    def _places(self, item: bytes) -> tuple[int, int, int]:
        h = int(murmur64a([item])[0])
        fp = (h >> 32) % ((1 << self.bits) - 1) + 1
        first = h % self.width
        return fp, first, self._other(first, fp)

    def _other(self, place: int, fp: int) -> int:
        """An involution, for any width: the place mirrored at a point that the fingerprint sets."""
        return (int(murmur64a([fp.to_bytes(8, "little")])[0]) - place) % self.width

    def add(self, item: bytes) -> bool:
        fp, a, b = self._places(item)
        if fp in self.table[a] or fp in self.table[b]:
            return True
        moves, place = [], a if len(self.table[a]) < self.SLOTS else b
        for kick in range(self.KICKS):
            if len(self.table[place]) < self.SLOTS:
                self.table[place].append(fp)
                return True
            slot = kick % self.SLOTS
            moves.append((place, slot, self.table[place][slot]))
            self.table[place][slot], fp = fp, self.table[place][slot]
            place = self._other(place, fp)
        for place, slot, old in reversed(moves):
            self.table[place][slot] = old
        return False

    def exists(self, item: bytes) -> bool:
        fp, a, b = self._places(item)
        return fp in self.table[a] or fp in self.table[b]

    def remove(self, item: bytes) -> bool:
        fp, a, b = self._places(item)
        for place in (a, b):
            if fp in self.table[place]:
                self.table[place].remove(fp)
                return True
        return False


def cuckoo(ops: DataFrame, width: int, bits: int) -> DataFrame:
    """Fold (key, seq, op, item) with op add, rem or exists: (key, seq, ok). A filter's operations run in one task."""
    ship(ops.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        f = Cuckoo(width, bits)
        pdf = pdf.sort_values("seq")
        call = {"add": f.add, "rem": f.remove, "exists": f.exists}
        pdf["ok"] = [int(call[o](i)) for o, i in zip(pdf.op, as_bytes(pdf["item"]), strict=True)]
        return pdf[["key", "seq", "ok"]]

    return ops.groupBy("key").applyInPandas(run, "key string, seq long, ok int")


# Heavy hitters


def top_scores(rows: DataFrame, k: int, by: list[str], smallest: bool = False) -> DataFrame:
    """Rows (by, item, score): the k items of the largest (or smallest) best score of each group."""
    from pyspark.sql.window import Window

    best = rows.groupBy(*by, "item").agg((F.min if smallest else F.max)("score").alias("score"))
    w = Window.partitionBy(*by).orderBy(F.asc("score") if smallest else F.desc("score"), "item")
    return best.withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= k).drop("_place")


def _mg_add(held: dict, item, n: int, k: int) -> None:
    if item in held:
        held[item] += n
    elif len(held) < k:
        held[item] = n
    else:
        cut = min(n, min(held.values()))
        for i in list(held):
            held[i] -= cut
            if not held[i]:
                del held[i]
        if n > cut:
            held[item] = n - cut


def misra_gries(rows: DataFrame, k: int) -> DataFrame:
    """(item, n): k counters over the whole input. Each partition keeps k, and the summaries, k rows a partition, merge
    by adding and cutting back to the k largest beyond the next one: the guarantee n >= true - total / (k + 1) holds."""
    ship(rows.sparkSession)

    def run(batches):
        held: dict = {}
        for pdf in batches:
            for item, n in pdf["item"].value_counts(sort=False).items():
                _mg_add(held, item, int(n), k)
        # An empty frame has no type that Arrow can take, so a partition without rows passes on none.
        if held:
            yield pd.DataFrame({"item": list(held), "n": np.array(list(held.values()), np.int64)})

    from pyspark.sql.window import Window

    summed = rows.select(F.col("item").cast("string")).mapInPandas(run, "item string, n long").groupBy("item").agg(F.sum("n").alias("n"))
    ranked = summed.orderBy(F.desc("n"), "item").limit(k + 1)
    cut = F.max(F.when(F.col("_place") == k + 1, F.col("n")).otherwise(0)).over(Window.partitionBy(F.lit(1)))
    placed = ranked.withColumn("_place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("n"), "item")))
    return placed.withColumn("n", F.col("n") - cut).filter((F.col("_place") <= k) & (F.col("n") > 0)).select("item", "n")


# Samples


def reservoir(rows: DataFrame, k: int, by: list[str], seed: int = 42, key: str = "seq") -> DataFrame:
    """k rows of each group, uniformly and repeatably: the smallest seeded hashes; n_seen counts the group."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*by).orderBy(F.xxhash64(F.lit(seed), key), key)
    picked = rows.withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= k).drop("_place")
    return picked.join(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_seen")), by)


# Centroids


def cluster(mean: np.ndarray, weight: np.ndarray, compression: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of weighted values, by the published t-digest's arcsine scale: fine at the ends, coarse in the middle.

    Values are sorted and equal ones joined; up to ``compression`` of them stay as they are. More fall into the unit
    steps of compression / (2 pi) * asin(2 q - 1), q being the share of weight up to a value's own middle.
    """
    order = np.argsort(mean, kind="stable")
    mean, first = np.unique(mean[order], return_index=True)
    if not len(mean):
        return mean, np.zeros(0, np.int64)
    weight = np.add.reduceat(weight[order], first)
    if len(mean) <= compression:
        return mean, weight
    q = (np.cumsum(weight) - weight / 2) / weight.sum()
    step = np.floor(compression / (2 * np.pi) * (np.arcsin(2 * q - 1) + np.pi / 2)).astype(np.int64)
    first = np.flatnonzero(np.diff(step, prepend=-1))
    total = np.add.reduceat(weight, first)
    return np.add.reduceat(mean * weight, first) / total, total


#: Digests of partitions that are merged side by side before the groups' own merge.
_DIGEST_MERGES = 64


def digest(rows: DataFrame, by: list[str], capacity: int = 100) -> DataFrame:
    """(by, mean, weight, low, high): centroids of each group from rows (by, value[, weight]).

    Each partition keeps about ``capacity`` centroids a group; they are merged in two steps, so no task meets more than
    a share of the partitions' digests. Null values and weights below 1 are left out.
    """
    ship(rows.sparkSession)
    inner = "means array<double>, weights array<long>, low double, high double"
    keys = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by)

    def row(values: np.ndarray, weights: np.ndarray, low: float, high: float) -> tuple:
        m, w = cluster(values, weights, capacity)
        return m.tolist(), w.tolist(), low, high

    def part(batches):
        held: dict[tuple, tuple] = {}
        for pdf in batches:
            for key, own in pdf.groupby(by, dropna=False) if by else [((), pdf)]:
                values, weights = own["value"].to_numpy(float), own["weight"].to_numpy(np.int64)
                if key in held:
                    m, w, low, high = held[key]
                    held[key] = row(np.concatenate([m, values]), np.concatenate([np.array(w, np.int64), weights]), min(low, values.min()), max(high, values.max()))
                else:
                    held[key] = row(values, weights, values.min(), values.max())
        yield pd.DataFrame([(*k, *v) for k, v in held.items()], columns=[*by, "means", "weights", "low", "high"])

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        means, weights = (np.concatenate([np.asarray(x) for x in pdf[c]]) for c in ("means", "weights"))
        out = row(means.astype(float), weights.astype(np.int64), pdf["low"].min(), pdf["high"].max())
        return pd.DataFrame([(*[pdf[c].iloc[0] for c in by], *out)], columns=[*by, "means", "weights", "low", "high"])

    rows = rows if "weight" in rows.columns else rows.withColumn("weight", F.lit(1))
    rows = rows.select(*by, F.col("value").cast("double").alias("value"), F.col("weight").cast("long").alias("weight")).filter(F.col("value").isNotNull() & (F.col("weight") >= 1))
    schema = ", ".join(filter(None, [keys, inner]))
    parts = rows.mapInPandas(part, schema).withColumn("_side", F.spark_partition_id() % _DIGEST_MERGES)
    some = parts.groupBy(*by, "_side").applyInPandas(lambda pdf: merged(pdf), schema)
    whole = some.groupBy(*by).applyInPandas(merged, schema)
    return whole.select(*by, F.inline(F.arrays_zip(F.col("means").alias("mean"), F.col("weights").alias("weight"))), "low", "high").toDF(*by, "mean", "weight", "low", "high")


def _cumulative(centroids: DataFrame, by: list[str]) -> DataFrame:
    from pyspark.sql.window import Window

    w = Window.partitionBy(*by).orderBy("mean", "weight")
    upto = F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return centroids.withColumn("upto", upto).withColumn("total", F.sum("weight").over(Window.partitionBy(*by)))


def digest_percentiles(centroids: DataFrame, by: list[str], *p: float) -> DataFrame:
    """First centroid whose cumulative weight reaches p of the total; 0 and 1 are the least and greatest value."""
    ranked = _cumulative(centroids, by)
    out = [F.min(F.when(F.col("upto") >= F.col("total") * q, F.col("mean"))).alias(f"p{round(q * 1000)}") if 0 < q < 1 else (F.min("low") if q <= 0 else F.max("high")).alias(f"p{round(q * 1000)}") for q in p]
    return ranked.groupBy(*by).agg(*out)


def digest_info(centroids: DataFrame, by: list[str]) -> DataFrame:
    return centroids.groupBy(*by).agg(F.sum("weight").alias("size"), F.min("low").alias("min"), F.max("high").alias("max"), (F.sum(F.col("mean") * F.col("weight")) / F.sum("weight")).alias("mean"))


def digest_trimmed_mean(centroids: DataFrame, by: list[str], low: float, high: float) -> DataFrame:
    """Mean of the weight between two shares of the total."""
    ranked = _cumulative(centroids, by)
    before = F.col("upto") - F.col("weight")
    inside = F.greatest(F.lit(0.0), F.least(F.col("upto").cast("double"), F.col("total") * high) - F.greatest(before.cast("double"), F.col("total") * low))
    return ranked.groupBy(*by).agg((F.sum(F.col("mean") * inside) / F.sum(inside)).alias("trimmed_mean"))



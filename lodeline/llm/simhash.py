"""SimHash near-duplicates by multi-index hashing.

Fingerprints are cut into segments. Two fingerprints within ``k`` bits agree, in the first segments within ``k // m``
bits or in a later one within ``k // m - 1`` bits (the pigeonhole bound of multi-index hashing), so each fingerprint
looks up a small Hamming ball of every segment in that segment's table, and the match's whole distance is verified.

A segment value that more than ``bucket_cap`` fingerprints share would pair all of them. In the table one marker stands
for them; whoever meets it takes an exact second way instead: each lists the whole fingerprints within ``k // 2`` (and
the rest of k) bits of itself, and whoever meets there is joined to the smallest one. That is linear in the group.

Equal fingerprints are one class from the start, so copies never meet as pairs. Links and components are of
fingerprints; documents come back in at the end, where fingerprints of very many copies are joined by broadcast.

Defined cases: null and empty texts have no words and the fingerprint zero, linked like any other; a text of fewer
words than a shingle is hashed whole; repeated ids with different texts link through their id; rows without an id link
others but name no component, whose id is null if it has no other rows; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeline.llm.common import bitmap_of, discard, gather, join_counted, materialize, ship, spare, texts_of, with_hit

BITS = 64


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text in UTF-8, as an unsigned integer."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        parts, n = [b" ".join(words)], 1
    else:
        n = len(words) - shingle + 1
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(seed)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 14):
        bits = np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row for each row of ``docs``; fp is the fingerprint's 64 bits as a signed long."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            known: dict[bytes, int] = {}
            out = np.empty(batch.num_rows, np.uint64)
            for i, text in enumerate(texts_of(batch.column(1))):
                fp = known.get(text)
                if fp is None:
                    fp = known[text] = fingerprint(text, shingle, seed)
                out[i] = fp
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def segments(k: int, m: int) -> list[tuple[int, int, int]]:
    """(first bit, width, radius) of each segment: the first k % m + 1 take radius k // m, the others one less."""
    base, extra = divmod(BITS, m)
    out, at = [], 0
    for i in range(m):
        width = base + (i < extra)
        out.append((at, width, k // m if i <= k % m else k // m - 1))
        at += width
    return [s for s in out if s[2] >= 0]


def ball(width: int, radius: int) -> list[int]:
    """Masks of at most ``radius`` of ``width`` bits."""
    masks, last = [0], [(0, -1)]
    for _ in range(radius):
        last = [(m | 1 << b, b) for m, top in last for b in range(top + 1, width)]
        masks += [m for m, _ in last]
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _around(key: F.Column, masks: list[int]) -> F.Column:
    """``key`` with each mask applied, as an array."""
    return F.array(*[key.bitwiseXOR(F.lit(_signed(v)).cast("long")) for v in masks])


def links(prints: DataFrame, k: int = 2, m: int = 2, bucket_cap: int = 64, rows: int | None = None) -> DataFrame:
    """(u, v): links that join every pair of the different fingerprints ``prints`` (fp; ``rows``: at most so many)
    within ``k`` bits.

    Pairs from buckets of up to ``bucket_cap`` are listed one by one; larger buckets give stars with the same reach.
    """
    shift = BITS - max(1, (m - 1).bit_length())
    tables, probes = [], []
    for s, (at, width, radius) in enumerate(segments(k, m)):
        value = F.shiftrightunsigned(F.col("fp"), at).bitwiseAND(F.lit((1 << width) - 1 if width < BITS else -1).cast("long"))
        key = value.bitwiseXOR(F.lit(_signed(s << shift)).cast("long"))
        tables.append(key)
        probes.append(F.array(key) if radius == 0 else _around(key, ball(width, radius)))
    table = prints.select(F.explode(F.array(*tables)).alias("key"), "fp")
    crowded = table.groupBy("key").count().filter(F.col("count") > bucket_cap).select("key")
    table = table.join(crowded, "key", "left_anti").unionByName(crowded.withColumn("fp", F.lit(None).cast("long")))
    probe = prints.select(F.explode(F.concat(*probes)).alias("key"), F.col("fp").alias("own"))
    near = (F.col("own") < F.col("fp")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("own"))) <= k)
    # Sizes that the planner sees are those before explode, so it is told not to broadcast.
    met = probe.hint("merge").join(table, "key").filter(F.col("fp").isNull() | near).select(F.col("own").alias("u"), F.col("fp").alias("v"))
    met = materialize(met, "met", rows and rows * sum(len(ball(width, radius)) for _, width, radius in segments(k, m)))
    members = met.filter(F.col("v").isNull()).select(F.col("u").alias("fp")).distinct()
    return met.filter(F.col("v").isNotNull()).unionByName(_stars(members, k))


def _stars(members: DataFrame, k: int) -> DataFrame:
    """Exact links of any group in linear size: all within k // 2 bits of a centre are within k of one another.

    Only even k makes both halves alike; for an odd k the second half reaches one bit farther and is verified.
    """
    half, rest = k // 2, k - k // 2
    around = lambda bits: members.select(F.explode(_around(F.col("fp"), ball(BITS, bits))).alias("centre"), "fp")
    near, far = around(half), around(rest)
    least = near.groupBy("centre").agg(F.min("fp").alias("u"), F.count(F.lit(1)).alias("n"))
    if half == rest:
        least = least.filter("n > 1")
    found = far.hint("merge").join(least.drop("n"), "centre")
    return found.filter(F.col("u") != F.col("fp")).select("u", F.col("fp").alias("v"))


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, component): the smallest node reachable from each node of ``edges`` (u, v; made from about ``rows`` rows),
    by alternating stars.

    Each round writes its edges to the shared folder, so a lost executor costs one round at most. Nothing is collected
    but the count and checksum that tell the last round. Each join has one row a node on one side, so a hub's edges may
    be split over tasks, as adaptive execution does.
    """
    now = materialize(edges.filter(F.col("u") != F.col("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges", rows)
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or before == tuple(state):
            break
        before = tuple(state)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("m").alias("u"), "v").filter(F.col("u") != F.col("v")).distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        joined = large.join(least, "v")
        small = joined.select(F.inline(F.array(F.struct(F.col("m").alias("a"), F.col("u").alias("b")), F.struct(F.col("m").alias("a"), F.col("v").alias("b")))))
        step = materialize(small.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges", state[0])
        discard(now)
        now = step
    return now.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component"))


def near_duplicates(docs: DataFrame, shingle: int = 3, seed: int = 42, k: int = 2, m: int = 2, bucket_cap: int = 64) -> DataFrame:
    """(doc_id, fp, component_id): one row per row of ``docs``; component_id is the smallest doc_id reachable."""
    prints = materialize(gather(fingerprints(docs, shingle, seed)), "simhash")
    total = prints.count()
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes", total)
    joined = links(classes.select("fp"), k, m, bucket_cap, total)
    # An id with several texts links the fingerprints of its rows.
    several = prints.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("fp").alias("u"), F.max("fp").alias("most")).filter("u < most").drop("most")
    if not several.isEmpty():
        joined = joined.unionByName(prints.join(several, "doc_id").select("u", F.col("fp").alias("v")))
    found = components(joined, total * BITS)
    placed = classes.join(found, classes["fp"] == found["node"], "left").select("fp", "rep", "n", F.coalesce("component", "fp").alias("part"))
    named = placed.join(placed.groupBy("part").agg(F.min("rep").alias("component_id")), "part").select("fp", "component_id", "n")
    return join_counted(prints, materialize(named, "named", total), "fp", total).select("doc_id", "fp", "component_id")


def op6_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Whole ``documents``: doc_id, fingerprint (16 hex digits), component_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = near_duplicates(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without all but one row (that of the smallest doc_id) of each group of near-duplicates.

    Of rows that share a doc_id the one of the smallest text (then of the smallest JSON) stays. Rows without a doc_id
    stand for themselves by text: one of each text is kept, near-duplicates or not.
    """
    groups = near_duplicates(docs, **options)
    drop = materialize(groups.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "drop")
    # Only rows that a bitmap of bounded size does not clear are moved to meet the ids to drop.
    p = spare(docs, "own")
    told = with_hit(docs, bitmap_of(drop, F.xxhash64("doc_id")), F.xxhash64("doc_id"), p)
    kept = told.filter(f"not {p}hit").unionByName(told.filter(f"{p}hit").join(drop, "doc_id", "left_anti")).select(*[F.col(f"`{c}`") for c in docs.columns])
    if groups.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return kept
    every = [F.col(f"`{c}`") for c in docs.columns]
    own = F.when(F.col("doc_id").isNull(), F.col("text"))
    first = kept.groupBy(F.col("doc_id").alias(f"{p}id"), own.alias(f"{p}own")).agg(F.min_by(F.struct(*every), F.struct("text", F.to_json(F.struct(*every)))).alias(f"{p}row"))
    return first.select(f"{p}row.*")

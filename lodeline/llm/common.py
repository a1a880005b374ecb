"""What the corpus operators share: the shared folder, shipping code to executors, and vector helpers over text bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.functions import session
from lodeline.functions.session import delete_path, fresh_path, given_paths, shared_dir  # noqa: F401

#: Bytes of text that one vectorised step takes at once; bounds the worker's memory whatever the batch size.
CHUNK_BYTES = 1 << 18
#: Most bytes of an Arrow batch that goes to a Python worker: what it and the JVM hold of it at once.
BATCH_BYTES = 8 << 20


def clean_up(spark: SparkSession, before: set[str], *keep: DataFrame) -> None:
    """Delete the intermediate tables, runs and shards made since ``before = given_paths(spark)``, but those of ``keep``.

    Operators return lazy frames that read such tables, so call it once their results are written.
    """
    for path in given_paths(spark) - before - {getattr(df, "_lodeline_path", None) for df in keep}:
        delete_path(spark, path)


#: Rows that a task of ``materialize`` reads, where their number is known.
FILE_ROWS = 1 << 18


def materialize(df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, and survives the loss of any executor.

    rows: about how many rows its last stage reads, at most. That stage then has as many tasks as they need, one a core
    at least, so that a small table is not many small files.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    out = df if rows is None else df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
    out.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._lodeline_path = path
    return back


def gather(df: DataFrame) -> DataFrame:
    """Few narrow rows of each of many scan tasks, dealt to a sixteenth of the shuffle partitions before they are written."""
    return df.repartition(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 16))


def discard(*frames: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing reads it any more."""
    for df in frames:
        path = getattr(df, "_lodeline_path", None)
        if path:
            delete_path(df.sparkSession, path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, and keep the batches that their Python workers get small."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    session.ship(spark)


def file_uri(path: str) -> str:
    """A path in the shared folder as a URI that Arrow's file systems take."""
    return path if "://" in path else f"file://{path.removeprefix('file:')}"


#: Most bits of a bitmap that goes to every executor: 32 MB.
BITMAP_BITS = 1 << 28


def bitmap_of(keys: DataFrame, h: Column, most: int = BITMAP_BITS) -> tuple[DataFrame, int]:
    """(_bucket, _bits) and the number of bits: a bitmap of the hashes ``h`` of ``keys``, 16 bits a key, ``most`` at most."""
    n, bits = keys.count(), 1 << 17
    while bits < 16 * n and bits < most:
        bits <<= 1
    at = F.pmod(h, F.lit(bits)) + 1
    return keys.groupBy(F.bitmap_bucket_number(at).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bits")), bits


def with_hit(rows: DataFrame, bitmap: tuple[DataFrame, int], h: Column, prefix: str = "_") -> DataFrame:
    """``rows`` with {prefix}hit: false only for rows whose hash ``h`` no key has. It is a filter before a join, not in
    its place."""
    bucket, bits, at, byte = (f"{prefix}{c}" for c in ("bucket", "bits", "at", "byte"))
    place = F.pmod(h, F.lit(bitmap[1])) + 1
    held = F.conv(F.hex(F.substring(bits, (F.floor(F.col(at) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.expr(f"shiftright({byte}, cast({at} % 8 as int)) & 1") == 1
    maps = bitmap[0].toDF(bucket, bits)
    met = rows.withColumn(bucket, F.bitmap_bucket_number(place)).withColumn(at, F.bitmap_bit_position(place)).join(F.broadcast(maps), bucket, "left")
    return met.withColumn(byte, held).withColumn(f"{prefix}hit", F.coalesce(bit, F.lit(False))).drop(bucket, at, bits, byte)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare(df: DataFrame, *wanted: str) -> str:
    """A column-name prefix that no column of ``df`` starts with, so that added columns cannot clash with its own."""
    prefix = "_ll"
    taken = [c.lower() for c in df.columns] + [w.lower() for w in wanted]
    while any(c.startswith(prefix) for c in taken):
        prefix += "_"
    return prefix


def join_counted(big: DataFrame, small: DataFrame, key: str, total: int, share: int = 1000) -> DataFrame:
    """Inner join of ``big`` with ``small``, which has one row a key and in ``n`` how many rows of ``big`` have that key.

    Keys of more than ``total / share`` rows (total: the rows of ``big``, or more) are ``share`` at most, whatever the
    data; they go to every executor, so that no task gathers the rows of a hot key. The others meet by a shuffle.
    """
    hot = small.filter(F.col("n") > total // share)
    cold = small.filter(F.col("n") <= total // share).drop("n")
    spread = big.join(F.broadcast(hot.drop("n")), key)
    return spread.unionByName(big.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null becomes the empty text."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def slices(texts: list[bytes], limit: int = CHUNK_BYTES):
    """(start, end) runs of texts of about ``limit`` bytes together; a longer text stands alone."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def segment_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values[start:end]; empty segments give 0."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[ends] - total[starts]


def luhn_ok(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def crc_mod(column) -> "F.Column":
    """crc32 of an id written as decimal text, modulo 4."""
    return F.crc32(column.cast("string").cast("binary")) % 4

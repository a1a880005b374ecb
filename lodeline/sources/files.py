"""Tables in and out: tab-separated loads, sorted tables, replay of change logs, zone files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.operators import store


def load_tsv(spark: SparkSession, *paths: str, base64: bool = False, now: int = 0) -> DataFrame:
    """``key TAB value`` lines as a change log. Lines without a key are skipped, further columns ignored; where a key
    repeats, the later file, and within a file the later line, is the newer version."""
    return tsv_rows(spark.read.text(list(paths)).select("value", F.col("_metadata.file_path").alias("path")), base64, now)


def tsv_rows(lines: DataFrame, base64: bool = False, now: int = 0) -> DataFrame:
    """The same from a column of lines (value, path). seq orders by file name and place in it.

    Lines are dealt by ranges of both and numbered as they then lie, so neither many files nor a large one go to one task.
    """
    parts = F.split("value", "\t", -1)
    rows = lines.select("path", F.monotonically_increasing_id().alias("at"), F.get(parts, F.lit(0)).alias("key"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("val"))
    if base64:
        rows = rows.withColumn("val", F.unbase64("val").cast("string"))
    rows = rows.filter(F.length("key") > 0).repartitionByRange("path", "at").sortWithinPartitions("path", "at")
    return rows.select("key", "val", F.lit(now).cast("long").alias("created_us"), F.lit(0).cast("long").alias("expires_s"), (F.length("val") == 0).alias("is_tombstone"), F.monotonically_increasing_id().alias("seq"))


def open_tables(spark: SparkSession, *paths: str) -> DataFrame:
    """One or many sorted tables (folders or globs) as one change log."""
    return spark.read.schema(store.SCHEMA).parquet(*paths)


def replay(spark: SparkSession, path: str) -> DataFrame:
    """The change log as a stream of appended files."""
    return spark.readStream.schema(store.SCHEMA).parquet(path)


def discard(rows: DataFrame) -> None:
    """Read everything and keep nothing: what reading alone costs."""
    rows.write.format("noop").mode("overwrite").save()


def zone_rows(lines: DataFrame, column: str = "value") -> DataFrame:
    """``op:date:domain[:ns]`` lines as two keyed rows each: by domain and by date."""
    p = F.split(column, ":")
    part = lambda i: F.coalesce(F.get(p, F.lit(i)), F.lit(""))
    rows = lines.filter(F.size(p) >= 3).select(part(0).alias("op"), part(1).alias("date"), part(2).alias("domain"), part(3).alias("ns"))
    pair = F.array(
        F.struct(F.concat_ws("~", F.lit("domain"), "domain", "date").alias("key"), F.concat_ws(",", "op", "ns").alias("val")),
        F.struct(F.concat_ws("~", F.lit("date"), "date", "domain").alias("key"), F.concat_ws(",", "op", "ns").alias("val")),
    )
    return rows.select(F.inline(pair))


def table_stats(tables: DataFrame) -> DataFrame:
    """(path, created_min, created_max, key_min, key_max, n) of each folder that ``open_tables`` reads."""
    folder = F.regexp_extract(F.col("_metadata.file_path"), "^(.*)/[^/]*$", 1)
    return tables.groupBy(folder.alias("path")).agg(F.min("created_us").alias("created_min"), F.max("created_us").alias("created_max"), F.min("key").alias("key_min"), F.max("key").alias("key_max"), F.count(F.lit(1)).alias("n"))


def get_skipping(spark: SparkSession, stats: list, key: str) -> tuple[str | None, int]:
    """(newest value of ``key``, number of tables read). Tables whose keys cannot hold it are left out; the others are
    read from the newest on, until what is found is newer than all that is left. stats: rows of ``table_stats``."""
    best, read = None, 0
    for t in sorted((t for t in stats if t.key_min <= key <= t.key_max), key=lambda t: -t.created_max):
        if best is not None and best.created_us > t.created_max:
            break
        read += 1
        rows = store.latest(open_tables(spark, t.path).filter(F.col("key") == key)).collect()  # one row at most
        if rows and (best is None or (rows[0].created_us, rows[0].seq) > (best.created_us, best.seq)):
            best = rows[0]
    return (best.val if best is not None else None), read


def listing(spark: SparkSession, folder: str) -> dict[str, tuple[int, int]]:
    """The tables in a folder: path -> (bytes, time of change), through whatever file system the folder is in."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {str(f.getPath()): (fs.getContentSummary(f.getPath()).getLength(), f.getModificationTime()) for f in fs.listStatus(p) if f.isDirectory()}


def reload(spark: SparkSession, folder: str, known: dict[str, tuple[int, int]]) -> tuple[DataFrame | None, dict[str, tuple[int, int]], dict[str, str]]:
    """A folder of tables again: (their rows as one log, the listing now, what became of each table: added, removed,
    changed or kept)."""
    now = listing(spark, folder)
    said = {p: "added" if p not in known else "kept" if known[p] == now[p] else "changed" for p in now} | {p: "removed" for p in known if p not in now}
    return (open_tables(spark, *sorted(now)) if now else None), now, said


def preload(rows: DataFrame) -> DataFrame:
    """Read rows into executors' memory (and disk where that is full) before they are asked for; ``unpersist`` ends it."""
    held = rows.persist()
    held.count()
    return held


def overlapping(tables: DataFrame) -> DataFrame:
    """Of table statistics (name, created_min, created_max): the number of other tables each overlaps in time. The
    oldest table that overlaps none can drop its tombstones.

    A table overlaps all that start by its end but for those that end before its start, so sorted ends are enough: two
    rows a table pass one window, and no pairs.
    """
    from pyspark.sql.window import Window

    ends = F.array(F.struct(F.col("created_min").alias("at"), F.lit(0).alias("end")), F.struct(F.col("created_max").alias("at"), F.lit(1).alias("end")))
    points = tables.select("name", F.inline(ends))
    upto = Window.partitionBy(F.lit(1)).orderBy("at")  # two rows for each table
    started = F.sum(1 - F.col("end")).over(upto.rangeBetween(Window.unboundedPreceding, 0))
    ended = F.coalesce(F.sum("end").over(upto.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = points.withColumn("met", F.when(F.col("end") == 1, started).otherwise(-ended))
    return counted.groupBy("name").agg((F.sum("met") - 1).alias("overlaps"), F.min("at").alias("created_min"))


def pick_for_merge(sizes: list[tuple[str, int]], slack: float = 1.25) -> list[str]:
    """Size-tiered choice: smallest first, each next one while it is below what is chosen already (times ``slack`` at
    first)."""
    ordered = sorted(sizes, key=lambda x: (x[1], x[0]))
    if len(ordered) < 2:
        return []
    chosen, total = [ordered[0][0]], ordered[0][1] * slack
    for name, size in ordered[1:]:
        if size >= total:
            break
        chosen.append(name)
        total = (ordered[0][1] if len(chosen) == 2 else total) + size
    return chosen if len(chosen) > 1 else []

"""Line dedup over levelled sorted runs.

A line's key is its text stripped of ASCII white space, A-Z lower-cased; keys are known by 128 bits of hash. Batches of
documents arrive from the largest ids down. Each batch is summed to one row a key and dealt to hash ranges; the task of
a range merge-anti-joins its keys with the sorted runs of that range, which it reads from the shared folder (what is new
gets its keeper there: no later batch can hold a larger id), and adds a sorted run of level 0. No run is shuffled or
sorted again. ``fanout`` runs of one level are merged into one run of the next, so a key is rewritten once a level. After
the last batch the runs, merged, say of each key in how many documents it is and which of them keeps it.

Keys of enough documents lose all their lines but those in the keeper. Very common keys (at most ``hot_share`` times
the mean number of lines of a document, a bound that does not grow with the corpus) go to every executor; the others
meet their lines by a sort-merge join, so no task gathers the lines of a common key. Only lines and documents that a
bitmap of bounded size does not rule out take part in these joins; the text of the others never moves.

Defined cases: null or empty text is one empty line; a key counts a doc_id once, however many rows and lines hold it;
ids of any type that sorts; repeated rows lose the same lines; lines of rows without a doc_id can be dropped but do not
count; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.fs as pafs
import pyarrow.ipc  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodeline.llm.common import bitmap_of, delete_path, file_uri, fresh_path, materialize, ship, with_hit

SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), _UPPER, _LOWER)


class LineRuns:
    """Sorted runs (h1, h2, n_docs, keeper) in levels: for each run a folder with one Arrow file a hash range.

    A file is written under a name of its attempt and then renamed. As a range's rows are fixed by the batch, a task that
    runs again after an executor is lost writes the same file.
    """

    def __init__(self, spark: SparkSession, fanout: int = 4, folder: str | None = None, ranges: int = 8, id_type: pa.DataType | None = None):
        ship(spark)
        self.spark, self.fanout, self.ranges = spark, fanout, ranges
        self.folder = file_uri(folder or fresh_path(spark, "runs"))
        self.levels: list[list[str]] = [[]]
        self.made = 0
        self.schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("n_docs", pa.int64()), ("keeper", id_type or pa.int64())])

    def _new(self, level: int) -> str:
        name = f"level{level}-{self.made}"
        self.made += 1
        return name

    def _place(self, name: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def add(self, batch: DataFrame) -> int:
        """Count a batch of lines (h1, h2, doc_id), whose ids are below those of all batches before; how many keys are new."""
        keys = batch.groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("own"))
        dealt = keys.withColumn("range", F.pmod("h1", F.lit(self.ranges)).cast("int")).select("range", "h1", "h2", "n_docs", "own")
        folder, schema, old, name = self.folder, self.schema, [n for level in self.levels for n in level], self._new(0)

        def run(batches):
            fresh = 0
            for at, rows in _by_range(batches):
                h1, h2 = rows.column("h1").to_numpy(), rows.column("h2").to_numpy()
                known = np.zeros(len(h1), bool)
                for o in old:
                    had = _read(folder, o, at)
                    if had is not None:
                        known |= held(h1, h2, had.column("h1").to_numpy(), had.column("h2").to_numpy())
                fresh += int((~known).sum())
                own = rows.column("own").combine_chunks() if isinstance(rows.column("own"), pa.ChunkedArray) else rows.column("own")
                keeper = pa.compute.if_else(pa.array(known), pa.scalar(None, own.type), own).cast(schema.field("keeper").type)
                _write(folder, name, at, pa.table([rows.column("h1"), rows.column("h2"), rows.column("n_docs"), keeper], schema=schema))
            yield pa.RecordBatch.from_arrays([pa.array([fresh], pa.int64())], ["fresh"])

        sorted_ = dealt.repartition(self.ranges, "range").sortWithinPartitions("range", "h1", "h2")
        fresh = sorted_.mapInArrow(run, "fresh long").agg(F.sum("fresh")).first()[0] or 0
        self._place(name, 0)
        self.compact()
        return fresh

    def _each_range(self, run, schema: str) -> DataFrame:
        """``run`` over the numbers of the ranges, a few of them in each task."""
        tasks = max(1, min(self.ranges, int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
        return self.spark.range(0, self.ranges, 1, tasks).mapInArrow(run, schema)

    def compact(self) -> None:
        """Merge the runs of each level that has ``fanout`` of them."""
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                old, self.levels[level] = self.levels[level], []
                folder, name = self.folder, self._new(level + 1)

                def run(batches, old=old, name=name, folder=folder):
                    for batch in batches:
                        for at in batch.column(0).to_pylist():
                            rows = _merged(folder, old, at)
                            if rows is not None:
                                _write(folder, name, at, rows)
                    yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64())], ["done"])

                self._each_range(run, "done long").agg(F.count("done")).first()
                self._place(name, level + 1)
                for n in old:
                    delete_path(self.spark, f"{self.folder}/{n}")
            level += 1

    def totals(self, min_docs: int = 0, id_type: str = "long") -> DataFrame:
        """(h1, h2, n_docs, keeper) over all runs, of keys in at least ``min_docs`` documents."""
        folder, names = self.folder, [n for level in self.levels for n in level]

        def run(batches):
            for batch in batches:
                for at in batch.column(0).to_pylist():
                    rows = _merged(folder, names, at)
                    if rows is not None:
                        yield from rows.filter(pa.compute.greater_equal(rows.column("n_docs"), min_docs)).to_batches()

        return self._each_range(run, f"h1 long, h2 long, n_docs long, keeper {id_type}")


def held(h1: np.ndarray, h2: np.ndarray, run1: np.ndarray, run2: np.ndarray) -> np.ndarray:
    """Which of the keys (h1, h2) are in a run; both sorted by h1, then h2."""
    out = np.zeros(len(h1), bool)
    if not len(run1):
        return out
    low, high = np.searchsorted(run1, h1, "left"), np.searchsorted(run1, h1, "right")
    for step in range(int((high - low).max(initial=0))):  # more than one only where first halves collide
        at = np.minimum(low + step, len(run1) - 1)
        out |= (low + step < high) & (run2[at] == h2)
    return out


def _by_range(batches):
    """(range, rows) of batches that are sorted by range."""
    open_, rows = None, []
    for batch in batches:
        numbers = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if open_ is not None and numbers[a] != open_:
                yield open_, pa.Table.from_batches(rows)
                rows = []
            open_ = int(numbers[a])
            rows.append(batch.slice(a, b - a))
    if rows:
        yield open_, pa.Table.from_batches(rows)


def _write(folder: str, name: str, at: int, rows: pa.Table) -> None:
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(f"{path}/{name}", recursive=True)
    own = f"{path}/{name}/.{at}-{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out, pa.ipc.new_file(out, rows.schema) as writer:
        writer.write_table(rows)
    fs.move(own, f"{path}/{name}/{at}.arrow")


def _read(folder: str, name: str, at: int) -> pa.Table | None:
    fs, path = pafs.FileSystem.from_uri(folder)
    if fs.get_file_info(f"{path}/{name}/{at}.arrow").type != pafs.FileType.File:
        return None
    with fs.open_input_file(f"{path}/{name}/{at}.arrow") as f:
        return pa.ipc.open_file(f).read_all()


def _merged(folder: str, names: list[str], at: int) -> pa.Table | None:
    """The runs of one range as one: documents summed, and the one keeper that a key has."""
    found = [t for n in names if (t := _read(folder, n, at)) is not None]
    if not found:
        return None
    if len(found) == 1:
        return found[0]
    every = pa.concat_tables(found)
    summed = every.group_by(["h1", "h2"]).aggregate([("n_docs", "sum"), ("keeper", "max")]).select(["h1", "h2", "n_docs_sum", "keeper_max"])
    return summed.rename_columns(["h1", "h2", "n_docs", "keeper"]).cast(every.schema).sort_by([("h1", "ascending"), ("h2", "ascending")])


def lines_of(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, row, pos, h1, h2) of each line whose key has at least ``min_chars`` code points; row: hash of its text."""
    each = docs.select("doc_id", F.xxhash64("text").alias("row"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    keyed = each.filter(F.length("line") >= min_chars).select("doc_id", "row", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    return keyed.select("doc_id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def _cuts(docs: DataFrame, n_docs: int, batches: int, sample: int) -> list:
    """Ids that cut the documents into about even batches, from about ``sample`` ids chosen by their hashes."""
    some = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n_docs // sample))) == 0
    ids = docs.select("doc_id").filter(F.col("doc_id").isNotNull() & some).distinct().limit(4 * sample).collect()
    ids = sorted(r.doc_id for r in ids)
    return sorted({ids[len(ids) * i // batches] for i in range(1, batches)}) if ids else []


def dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 3, hot_share: int = 1000, sample: int = 10_000, range_lines: int = 1 << 20) -> DataFrame:
    """``docs`` rows (doc_id, text) with lines, n_lines, n_dropped and kept (the text that stays).

    sample: ids that the batches' bounds are taken from; they make batches even and change no result. range_lines: lines
    of a hash range, about, which bounds what one task merges.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType
    n_docs = docs.count()
    cuts = _cuts(docs, n_docs, batches, sample) if batches > 1 else []
    batch = F.lit(0)
    for c in cuts:
        batch = batch + F.coalesce(F.col("doc_id") >= F.lit(c), F.lit(False)).cast("int")
    path = fresh_path(spark, "lines")
    lines_of(docs, min_chars).withColumn("batch", batch).write.parquet(path)
    lines = spark.read.schema(f"doc_id {kind.simpleString()}, row long, pos int, h1 long, h2 long, batch int").parquet(path)
    n_lines = lines.count()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_lines // range_lines))
    index = LineRuns(spark, fanout, ranges=ranges, id_type=to_arrow_type(kind))
    for b in range(len(cuts), -1, -1):
        index.add(lines.filter(F.col("batch") == b))
    common = materialize(index.totals(min_docs, kind.simpleString()), "common", n_lines)
    delete_path(spark, index.folder)
    hot = F.col("n_docs") > max(min_docs, n_docs // hot_share)
    other = ~F.col("doc_id").eqNullSafe(F.col("keeper"))
    near = with_hit(lines, bitmap_of(common, F.col("h1")), F.col("h1")).filter("_hit").drop("_hit")
    gone = near.join(F.broadcast(common.filter(hot)), ["h1", "h2"]).unionByName(near.join(common.filter(~hot), ["h1", "h2"])).filter(other)
    drops = materialize(gone.groupBy(F.col("doc_id").alias("drop_id"), F.col("row").alias("drop_row")).agg(F.collect_set("pos").alias("drops")), "drops", n_lines)
    told = with_hit(docs, bitmap_of(drops, F.xxhash64("drop_id", "drop_row")), F.xxhash64("doc_id", F.xxhash64("text")))
    met = told.filter("_hit").join(drops, F.col("doc_id").eqNullSafe(F.col("drop_id")) & (F.xxhash64("text") == F.col("drop_row")), "left")
    full = met.select("doc_id", "text", "drops").unionByName(told.filter("not _hit").select("doc_id", "text", F.lit(None).cast("array<int>").alias("drops")))
    parts = full.select("doc_id", "text", split_lines(F.col("text")).alias("lines"), "drops")
    places = F.sequence(F.lit(0), F.size("lines") - 1)
    stay = F.transform(F.array_except(places, F.col("drops")), lambda p: F.get(F.col("lines"), p))
    return parts.select(
        "doc_id",
        "text",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size(F.when(F.col("drops").isNotNull(), F.col("drops"))).cast("long"), F.lit(0)).alias("n_dropped"),
        F.when(F.col("drops").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(stay, "\n")).alias("kept"),
    )


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Whole ``documents``."""
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = """
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) pos from documents),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') key from l),
c as (select key, max(doc_id) keeper from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
j as (select k.doc_id, k.line, k.pos, c.key is not null and k.doc_id <> c.keeper gone from k left join c on k.key = c.key)
select doc_id, count(*) n_lines, cast(count(*) filter (where gone) as bigint) n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) kept_sha256
from j group by doc_id
"""

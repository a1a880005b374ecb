"""Benchmark decontamination by Wu-Manber search over words.

Patterns are the windows of ``window`` consecutive words of every benchmark item; an item of fewer words is one window.
For each pattern length there is a shift table over blocks of up to three words: how far the search may jump when it
sees that block at the end of its window. Where the jump is zero, the block's suffix-hash bucket names the patterns
that end so; those whose first word fits too are compared word for word, and a match is confirmed byte for byte.
All cursors of a batch move together as vectors, so skipping costs no Python loop over positions.

The benchmark is a stated query set. Executors write it to the shared folder in blocks of about ``block_bytes``; only the
blocks' names go to the driver. A task holds up to ``hold_bytes`` of documents and takes one block after the other over
them, in one worker and without a shuffle, so what it holds is bounded however many items there are. The last block's
tables stay, so a benchmark of one block is read once a worker.

Defined cases: null and empty texts (and items) have no words and match nothing; repeated items count once by
item_id; items without an item_id are searched like others and together stand as one null, the last of the list;
repeated documents are each reported; an empty benchmark marks nothing; other columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.ipc  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeline.llm.common import file_uri, fresh_path, ship, slices, texts_of
from lodeline.llm.words import ALNUM, Words, split

_MIX = np.uint64(0xD6E8FEB86659FD93)
_BITS = 18
_RUN = 256


def _blocks(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the block of ``size`` words that ends at each position (the first size - 1 are not used)."""
    out = hashes.copy()
    for back in range(1, size):
        out[size - 1 :] = out[size - 1 :] * _MIX + hashes[size - 1 - back : len(hashes) - back]
    return out


class Searcher:
    """Wu-Manber tables for all patterns of one length."""

    def __init__(self, length: int, patterns: dict[bytes, list[int]]):
        self.length, self.block = length, min(3, (length + 1) // 2)
        texts = list(patterns)
        words = split(texts, ALNUM)
        self.hashes = words.hashes.reshape(len(texts), length)
        blocks = _blocks(words.hashes, self.block).reshape(len(texts), length)
        self.shift = np.full(1 << _BITS, length - self.block + 1, np.int64)
        for j in range(self.block - 1, length):
            np.minimum.at(self.shift, (blocks[:, j] >> np.uint64(64 - _BITS)).astype(np.int64), length - 1 - j)
        order = np.argsort(blocks[:, -1], kind="stable")
        self.suffix, self.hashes = blocks[order, -1], self.hashes[order]
        self.words = [texts[i] for i in order]
        self.items = [patterns[t] for t in self.words]

    def search(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(last word, pattern) of every occurrence."""
        h, size = words.hashes, self.length
        found: list[np.ndarray] = []
        if len(h) < size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        blocks = _blocks(h, self.block)
        jump = self.shift[(blocks >> np.uint64(64 - _BITS)).astype(np.int64)]
        first, after = words.docs[:-1] + size - 1, words.docs[1:]
        runs = np.maximum(0, -(-(after - first) // _RUN))
        begin = np.repeat(first, runs) + _RUN * (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs))
        stop = np.minimum(begin + _RUN, np.repeat(after, runs))
        while len(begin):
            step = jump[begin]
            hit = step == 0
            found.append(begin[hit])
            begin = begin + np.maximum(step, 1)
            on = begin < stop
            begin, stop = begin[on], stop[on]
        at = np.concatenate(found) if found else np.zeros(0, np.int64)
        low = np.searchsorted(self.suffix, blocks[at], "left")
        many = np.searchsorted(self.suffix, blocks[at], "right") - low
        last = np.repeat(at, many)
        pattern = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
        same = h[last - size + 1] == self.hashes[pattern, 0]
        last, pattern = last[same], pattern[same]
        for j in range(1, size):
            same = h[last - size + 1 + j] == self.hashes[pattern, j]
            last, pattern = last[same], pattern[same]
        sure = np.fromiter((self._equal(words, int(p), int(k)) for p, k in zip(last, pattern, strict=True)), bool, len(last))
        return last[sure], pattern[sure]

    def _equal(self, words: Words, last: int, pattern: int) -> bool:
        first = last - self.length + 1
        sizes = words.ends[first : last + 1] - words.starts[first : last + 1]
        want = self.words[pattern].split(b" ")
        return words.data[words.starts[first] : words.ends[last]].tobytes() == b"".join(want) and [len(w) for w in want] == sizes.tolist()


class Benchmark:
    """Windows of the items, by length."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        by: dict[int, dict[bytes, list[int]]] = {}
        self.names = [name for name, _ in items]
        words = split([t for _, t in items], ALNUM)
        for i in range(len(items)):
            own = [words.data[words.starts[k] : words.ends[k]].tobytes() for k in range(words.docs[i], words.docs[i + 1])]
            if not own:
                continue
            size = min(window, len(own))
            for k in range(len(own) - size + 1):
                holders = by.setdefault(size, {}).setdefault(b" ".join(own[k : k + size]), [])
                if not holders or holders[-1] != i:
                    holders.append(i)
        self.searchers = [Searcher(size, patterns) for size, patterns in sorted(by.items())]

    def scan(self, texts: list[bytes]):
        """For each text: a mask of its words (True: hit), and the set of item names."""
        words = split(texts, ALNUM)
        cover = np.zeros(len(words.hashes) + 1, np.int64)
        names: list[set[str | None]] = [set() for _ in texts]
        for s in self.searchers:
            last, pattern = s.search(words)
            np.add.at(cover, last - s.length + 1, 1)
            np.add.at(cover, last + 1, -1)
            doc = np.searchsorted(words.docs, last, "right") - 1
            for d, k in set(zip(doc.tolist(), pattern.tolist(), strict=True)):
                names[d].update(self.names[i] for i in s.items[k])
        mask = np.cumsum(cover)[:-1] > 0
        return [mask[a:b] for a, b in zip(words.docs[:-1], words.docs[1:], strict=True)], names


def write_blocks(items: DataFrame, block_bytes: int) -> list[str]:
    """Write items with a text to the shared folder; the names of the files, each of about ``block_bytes`` (one item at
    least). Names are new in each attempt of a task, and only those of the attempt that counts are told."""
    folder = fresh_path(items.sparkSession, "benchmark")
    folder = file_uri(folder)

    def run(batches):
        fs, path = pafs.FileSystem.from_uri(folder)
        block, size = [], 0

        def flush():
            name = f"block-{uuid.uuid4().hex}.arrow"
            fs.create_dir(path, recursive=True)
            with fs.open_output_stream(f"{path}/{name}") as out, pa.ipc.new_file(out, _ITEMS) as writer:
                writer.write_batch(pa.RecordBatch.from_arrays([pa.array([n for n, _ in block], pa.string()), pa.array([t for _, t in block], pa.binary())], schema=_ITEMS))
            block.clear()
            return pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if block and size + len(text) > block_bytes:
                    yield flush()
                    size = 0
                block.append((name, text))
                size += len(text)
        if block:
            yield flush()

    rows = items.filter(F.length("text") > 0).select(F.col("item_id").cast("string").alias("name"), F.col("text").cast("binary").alias("text"))
    # Small benchmarks in few blocks: as many tasks as there are blocks' worth of text, each item to any of them.
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = rows.coalesce(1) if size <= block_bytes else rows.repartition(int(-(-size // block_bytes)))
    return sorted(f"{folder}/{r.name}" for r in dealt.mapInArrow(run, "name string").collect())


_ITEMS = pa.schema([("name", pa.string()), ("text", pa.binary())])
#: The tables made last in this worker, by block and window.
_made: dict[tuple[str, int], Benchmark] = {}


def _tables(file: str, window: int) -> Benchmark:
    if (file, window) not in _made:
        _made.clear()
        fs, path = pafs.FileSystem.from_uri(file)
        with fs.open_input_file(path) as f:
            rows = pa.ipc.open_file(f).read_all()
        _made[file, window] = Benchmark(list(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True)), window)
    return _made[file, window]


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 2 << 20, keep: list[str] | None = None, hold_bytes: int = 16 << 20) -> DataFrame:
    """``keep`` columns of each row with n_words, n_hit (words inside any occurrence) and items (ids, sorted strings, then null for those without)."""
    ship(docs.sparkSession)
    keep = ["doc_id"] if keep is None else keep
    files = write_blocks(benchmark, block_bytes)
    fields = [docs.schema[c] for c in keep] + [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType()))]
    k = len(keep)

    def search(group: list[pa.RecordBatch]):
        """Batches of documents with their counts; the masks of all blocks are merged before they are summed."""
        texts = [t for batch in group for t in texts_of(batch.column(k))]
        masks: list[np.ndarray | None] = [None] * len(texts)
        names: list[set[str | None]] = [set() for _ in texts]
        for file in files:
            bench = _tables(file, window)
            for a, b in slices(texts):
                for i, (mask, found) in enumerate(zip(*bench.scan(texts[a:b]), strict=True), a):
                    masks[i] = mask if masks[i] is None else masks[i] | mask
                    names[i] |= found
        if not files:
            masks = [m for a, b in slices(texts) for m in Benchmark([], window).scan(texts[a:b])[0]]
        at = 0
        for batch in group:
            mine, said = masks[at : at + batch.num_rows], names[at : at + batch.num_rows]
            at += batch.num_rows
            counts = [pa.array([len(m) for m in mine], pa.int64()), pa.array([int(m.sum()) for m in mine], pa.int64())]
            listed = pa.array([sorted(n - {None}) + [None] * (None in n) for n in said], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], *counts, listed], [*batch.schema.names[:k], "n_words", "n_hit", "items"])

    def run(batches):
        group, size = [], 0
        for batch in batches:
            group.append(batch)
            size += batch.nbytes
            # With one block nothing is read again for each group, so none is held back.
            if size >= hold_bytes or len(files) < 2:
                yield from search(group)
                group, size = [], 0
        if group:
            yield from search(group)

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("_text")).mapInArrow(run, T.StructType(fields))


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Whole ``documents`` against whole ``benchmark``."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` without the rows that hold an occurrence."""
    if not docs.columns:
        return docs
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    inner = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.col("text"))
    found = scan(inner, benchmark, window, keep=list(names.values())).filter("n_hit = 0")
    return found.select(*[F.col(n).alias(c) for c, n in names.items()])


ORACLE_SQL = r"""
with item as (
  select cast(item_id as varchar) id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
  from benchmark),
pattern as (
  select distinct id, least(10, len(w)) size, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') p
  from (select id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) k from item where len(w) > 0)),
doc as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
  from documents),
size as (select distinct size from pattern),
spot as (
  select doc_id, size, k, array_to_string(w[k : k + size - 1], ' ') p
  from (select doc_id, w, size, unnest(range(1, greatest(len(w) - size + 2, 1))) k from doc, size)),
hit as (select doc_id, k, spot.size, id from spot join pattern on spot.p = pattern.p and spot.size = pattern.size),
covered as (select doc_id, count(distinct pos) n from (select doc_id, unnest(range(k, k + size)) pos from (select distinct doc_id, k, size from hit)) group by doc_id),
named as (select doc_id, count(*) n, string_agg(id, ',' order by id) ids from (select distinct doc_id, id from hit) group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(c.n, 0) as bigint) n_hit, cast(coalesce(m.n, 0) as bigint) n_items,
       sha256(coalesce(m.ids, '')) items_sha256, coalesce(c.n, 0) > 0 contaminated
from doc d left join covered c using (doc_id) left join named m using (doc_id)
"""

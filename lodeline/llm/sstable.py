"""Token ids in sorted-string-table shards.

Texts are dealt by ranges of doc_id and sorted, each range becomes one shard; an id of very many rows may take several
shards. A shard holds blocks of entries whose
keys are prefix-compressed from restart points, then a sparse index (first key and place of each block), a Bloom filter
over all keys, and a footer. A lookup asks the filter, bisects the index, and bisects one block's restart points.

File: blocks | index | filter | footer. A block is zstd data of ``entries | restart offsets (u32) | their number (u32)``
with a crc32 after it; an entry is ``shared | unshared | value length`` as varints, the key's rest, and the ids.
Keys order as ids do: null first, then integers, then strings; a repeated id repeats its key.

Shards go to the shared folder under names that no other attempt uses; the manifest, written by Spark's own commit
protocol, names those that count. A lost executor leaves at most a file that no manifest names. The manifest's rows, one
a shard, are gathered to few files, as a file a shard would cost a task and two small files each.

Defined cases: null text is the empty text, one end id; null ids sort first; repeated rows are all kept; an empty table
writes no shard; other columns are ignored; the content of an added token inside a text (such as an end-of-text mark)
becomes that token, as the library does by default, or ordinary text with ``marks_as_text``.
"""

from __future__ import annotations

import bisect
import json
import re
from array import array
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeline.llm.common import file_uri, fresh_path, ship

MAGIC = b"LLSST01\n"
BLOCK_BYTES = 64 << 10
RESTART = 16
BLOOM_BITS, BLOOM_HASHES = 10, 7
_FOOTER = struct.Struct("<QQQQQQII8s")


def key_bytes(doc_id) -> bytes:
    """Bytes that sort as ids do."""
    if doc_id is None:
        return b"\x00"
    if isinstance(doc_id, int):
        return b"\x01" + struct.pack(">Q", doc_id + (1 << 63))
    return b"\x02" + str(doc_id).encode()


def key_value(key: bytes):
    if key[:1] == b"\x00":
        return None
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[:1] == b"\x01" else key[1:].decode()


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = xxhash.xxh64_intdigest(key, 0), xxhash.xxh64_intdigest(key, 1) | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class Writer:
    """Writes one shard to an open binary stream; keys must come in order."""

    def __init__(self, out, width: int = 2, block_bytes: int = BLOCK_BYTES):
        self.out, self.width, self.limit = out, width, block_bytes
        self.at = self.docs = self.tokens = 0
        self.index: list[tuple[bytes, int, int]] = []
        self.hashes = (array("Q"), array("Q"))
        self.first = self.last = b""
        self._start()

    def _start(self):
        self.block, self.size, self.restarts, self.count, self.previous, self.head = [], 0, [], 0, b"", b""

    def add(self, key: bytes, ids: bytes) -> None:
        """ids: little-endian unsigned integers of ``width`` bytes."""
        if self.docs and key < self.last:
            raise ValueError("keys out of order")
        shared = 0
        if self.count % RESTART == 0:
            self.restarts.append(self.size)
        else:
            most = min(len(key), len(self.previous))
            while shared < most and key[shared] == self.previous[shared]:
                shared += 1
        if not self.count:
            self.head = key
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(ids)) + key[shared:] + ids
        self.block.append(entry)
        self.size += len(entry)
        self.count += 1
        self.first = self.first if self.docs else key
        self.previous = self.last = key
        self.docs += 1
        self.tokens += len(ids) // self.width
        self.hashes[0].append(xxhash.xxh64_intdigest(key, 0))
        self.hashes[1].append(xxhash.xxh64_intdigest(key, 1) | 1)
        if self.size >= self.limit:
            self._flush()

    def _flush(self):
        if self.count:
            raw = b"".join(self.block) + struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))
            data = zstandard.ZstdCompressor(level=1).compress(raw)
            data += struct.pack("<I", zlib.crc32(data))
            self.out.write(data)
            self.index.append((self.head, self.at, len(data)))
            self.at += len(data)
        self._start()

    def close(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + _varint(a) + _varint(n) for k, a, n in self.index)
        bits = max(64, self.docs * BLOOM_BITS)
        bloom = np.zeros((bits + 7) // 8, np.uint8)
        # Remainders before sums, as a reader's probes do not wrap at 64 bits.
        a, b = (np.array(h, np.uint64) % np.uint64(bits) for h in self.hashes)
        for i in range(BLOOM_HASHES):
            at = ((a + np.uint64(i) * b) % np.uint64(bits)).astype(np.int64)
            np.bitwise_or.at(bloom, at >> 3, (1 << (at & 7)).astype(np.uint8))
        index = zstandard.ZstdCompressor(level=1).compress(index)
        self.out.write(index + bloom.tobytes())
        self.out.write(_FOOTER.pack(self.at, len(index), len(bloom), bits, self.docs, self.tokens, self.width, zlib.crc32(index + bloom.tobytes()), MAGIC))


class Reader:
    """Reads one shard from a seekable binary file; holds its index, its filter and one block."""

    def __init__(self, file, size: int):
        self.file = file
        self.file.seek(size - _FOOTER.size)
        at, index, bloom, self.bits, self.docs, self.tokens, self.width, crc, magic = _FOOTER.unpack(self.file.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        self.file.seek(at)
        both = self.file.read(index + bloom)
        if zlib.crc32(both) != crc:
            raise ValueError("shard index is damaged")
        self.bloom = both[index:]
        raw, self.keys, self.places, i = zstandard.ZstdDecompressor().decompress(both[:index]), [], [], 0
        while i < len(raw):
            n, i = _read_varint(raw, i)
            self.keys.append(raw[i : i + n])
            a, i = _read_varint(raw, i + n)
            n, i = _read_varint(raw, i)
            self.places.append((a, n))

    def _block(self, i: int) -> tuple[bytes, list[int]]:
        at, n = self.places[i]
        self.file.seek(at)
        data = self.file.read(n)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("shard block is damaged")
        raw = zstandard.ZstdDecompressor().decompress(data[:-4])
        n = struct.unpack("<I", raw[-4:])[0]
        return raw[: -4 * n - 4], list(struct.unpack(f"<{n}I", raw[-4 * n - 4 : -4]))

    @staticmethod
    def _entries(raw: bytes, at: int = 0) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < len(raw):
            shared, at = _read_varint(raw, at)
            rest, at = _read_varint(raw, at)
            n, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield key, raw[at : at + n]
            at += n

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.places)):
            yield from self._entries(self._block(i)[0])

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits))

    def get(self, key: bytes) -> list[np.ndarray]:
        """The ids of every entry of ``key``, in order."""
        if not self.may_hold(key):
            return []
        out, i = [], max(0, bisect.bisect_left(self.keys, key) - 1)
        for i in range(i, len(self.keys)):
            if self.keys[i] > key:
                break
            raw, restarts = self._block(i)
            low, high = 0, len(restarts) - 1
            while low < high:  # the last restart point whose key is below the one sought
                mid = (low + high + 1) // 2
                if next(self._entries(raw, restarts[mid]))[0] < key:
                    low = mid
                else:
                    high = mid - 1
            for k, v in self._entries(raw, restarts[low]):
                if k > key:
                    break
                if k == key:
                    out.append(np.frombuffer(v, f"<u{self.width}").astype(np.uint32))
        return out


#: Bytes of texts that are cut into pieces as bytes: printable ASCII, tab and line ends, and U+00C0 to U+023F, which are
#: letters in every Unicode version but for the two signs in _SIGNS. All other texts go to the tokenizer whole.
_PLAIN = bytes([9, 10, 13, *range(32, 127), *range(0x80, 0xC0), *range(0xC3, 0xC9)])
_SIGNS = (b"\xc3\x97", b"\xc3\xb7")
#: The byte-level pre-tokenizer's public pattern, over such bytes.
_PIECES = re.compile(rb"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z\x80-\xff]+| ?[0-9]+| ?[!-/:-@\[-`{-~]+|\s+(?!\S)|\s+")


def _alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for U+0100 onwards, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_ALPHABET = _alphabet()
_CACHE_PIECES = 400_000
_LONG = 1 << 18


class Encoder:
    """A tokenizer of the tokenizers library. Byte-level ones encode each distinct piece once and remember its ids.

    marks_as_text: the content of added tokens inside a text is ordinary text, not the token.
    """

    def __init__(self, path: str | None, marks_as_text: bool = False):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        path = path or public_tokenizers.path("byte_bpe_50k.json")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = marks_as_text
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.pieces = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.marks = [] if marks_as_text else [t["content"].encode() for t in spec.get("added_tokens") or []]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.bytes_of = [i.to_bytes(self.width, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.cache: dict[bytes, bytes] = {}

    def _slow(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, f"<u{self.width}").tobytes()

    def _learn(self, pieces: set[bytes]) -> None:
        """Remember the ids of pieces. They are what the pre-tokenizer would cut, so they go to the model itself."""
        model, two = self.tokenizer.model, self.bytes_of
        for p in pieces:
            self.cache[p] = b"".join([two[t.id] for t in model.tokenize(p.decode("latin-1").translate(_ALPHABET))])

    @staticmethod
    def _parts(text: bytes) -> Iterator[bytes]:
        """Cuts a long text before a space or line end that follows another character: always an edge of pieces."""
        at = 0
        while len(text) - at > _LONG:
            cut = at + _LONG
            while cut < len(text) and not (text[cut] in b" \n" and text[cut - 1] > 32):
                cut += 1
            yield text[at:cut]
            at = cut
        yield text[at:]

    def encode(self, text: bytes) -> bytes:
        """Ids of a whole UTF-8 text, as little-endian integers of ``width`` bytes."""
        if not self.pieces or text.translate(None, _PLAIN) or any(s in text for s in _SIGNS) or any(m in text for m in self.marks):
            return self._slow(text)
        out, cache = [], self.cache
        for part in self._parts(text):
            pieces = _PIECES.findall(part)
            new = set(pieces).difference(cache)
            if new:
                if len(cache) + len(new) > _CACHE_PIECES:
                    cache.clear()
                    new = set(pieces)
                self._learn(new)
            out.append(b"".join(map(cache.__getitem__, pieces)))
        return b"".join(out)


_encoders: dict[tuple[str | None, bool], Encoder] = {}


def encoder(path: str | None, marks_as_text: bool = False) -> Encoder:
    """This worker's encoder; it serves all tasks that run here."""
    if (path, marks_as_text) not in _encoders:
        _encoders[path, marks_as_text] = Encoder(path, marks_as_text)
    return _encoders[path, marks_as_text]


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri)


#: Shards that one file of the manifest names, about.
_SHARDS_A_FILE = 100


def write(docs: DataFrame, folder: str, tokenizer_path: str | None = None, end_id: int = 0, partitions: int | None = None, marks_as_text: bool = False) -> DataFrame:
    """Write ``docs`` (doc_id, text) as shards in ``folder``, a URI all executors share; the manifest, one row a shard."""
    ship(docs.sparkSession)
    fs, path = _open(folder)
    fs.create_dir(path, recursive=True)

    def run(batches):
        out = writer = name = None
        enc = encoder(tokenizer_path, marks_as_text)
        fs, path = _open(folder)
        end = end_id.to_bytes(enc.width, "little")
        part = TaskContext.get().partitionId()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if writer is None:
                    name = f"{path}/shard-{part:06d}-{uuid.uuid4().hex}.sst"
                    out = fs.open_output_stream(name)
                    writer = Writer(out, enc.width)
                writer.add(key_bytes(doc_id), enc.encode(text or b"") + end)
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pylist([{"shard": part, "file": name.rpartition("/")[2], "n_docs": writer.docs, "n_tokens": writer.tokens, "first_key": writer.first, "last_key": writer.last}], _MANIFEST)

    # Rows of one id are told apart by their text and by where they were read, so that no id makes a shard too large.
    order = ["doc_id", "_text", "_part"]
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_text"), F.spark_partition_id().alias("_part"))
    rows = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    written = rows.sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(run, "shard int, file string, n_docs long, n_tokens long, first_key binary, last_key binary")
    # A task gives one row at most and deals it by its own number, so a task that runs again replaces its row.
    shards = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    written.repartition(max(1, -(-shards // _SHARDS_A_FILE))).write.parquet(f"{folder}/manifest")
    return manifest(docs.sparkSession, folder)


_MANIFEST = pa.schema([("shard", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("first_key", pa.binary()), ("last_key", pa.binary())])


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row a shard, with first_token: the ids in all shards before it."""
    rows = spark.read.schema("shard int, file string, n_docs long, n_tokens long, first_key binary, last_key binary").parquet(f"{folder}/manifest")
    # One row for each shard, so the running sum is over as many rows as there are files.
    before = Window.partitionBy(F.lit(1)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("first_token", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read(spark: SparkSession, folder: str, id_type: str = "long", with_ids: bool = False) -> DataFrame:
    """Read the shards back: doc_id, start, n_tokens, ids_crc32, and with ``with_ids`` the ids themselves."""
    ship(spark)
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    to = pa.int64() if id_type in ("long", "bigint", "int") else pa.string()
    types = [to, pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int64())] * with_ids
    schema = pa.schema(list(zip(names, types, strict=True)))

    def run(batches):
        fs, path = _open(folder)
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = f"{path}/{file}"
                with fs.open_input_file(name) as f:
                    shard = Reader(f, f.size())
                    rows: list[list] = [[] for _ in names]
                    held = 0
                    for key, value in shard:
                        ids = np.frombuffer(value, f"<u{shard.width}").astype("<u4")
                        row = [key_value(key), start, len(ids), zlib.crc32(ids.tobytes())] + [ids.astype(np.int64)] * with_ids
                        for column, v in zip(rows, row, strict=True):
                            column.append(v)
                        start += len(ids)
                        held += 1 + len(ids) * with_ids
                        if held >= 1 << 18:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], schema=schema)
                            rows, held = [[] for _ in names], 0
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], schema=schema)

    ddl = f"doc_id {'long' if to == pa.int64() else 'string'}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    files = manifest(spark, folder).select("file", "first_token")
    return files.repartition(max(1, spark.sparkContext.defaultParallelism * 2)).mapInArrow(run, ddl)


def lookup(spark: SparkSession, folder: str, ids: list) -> dict:
    """Ids of the documents asked for, by binary search in the shards that may hold them."""
    keys = {key_bytes(i): i for i in ids}
    out: dict = {i: [] for i in ids}
    fs, path = _open(folder)
    for row in manifest(spark, folder).orderBy("shard").toLocalIterator():
        inside = [k for k in keys if bytes(row.first_key) <= k <= bytes(row.last_key)]
        if inside:
            with fs.open_input_file(f"{path}/{row.file}") as f:
                shard = Reader(f, f.size())
                for k in inside:
                    out[keys[k]] += shard.get(k)
    return out


def round_trip(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 0, tag: str = "sst") -> DataFrame:
    """Write ``docs`` as shards in the shared folder and describe each document from the files."""
    spark = docs.sparkSession
    folder = fresh_path(spark, tag)
    folder = file_uri(folder)
    write(docs, folder, tokenizer_path, end_id)
    return read(spark, folder, "long" if docs.schema["doc_id"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint") else "string")


def op1_token_sstable(spark, sf_dir: str) -> DataFrame:
    """Whole ``documents`` through the shards and back."""
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))

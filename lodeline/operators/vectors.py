"""Vectors: normalising, quantising, projection, distances, exact and bucketed nearest-neighbour search."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.functions.hashing import mixer64
from lodeline.functions.session import ship
from lodeline.sources import blocks

SCALES = {"I16": 32767.0, "I8": 127.0}
#: Queries of one block, rows that are compared with a block at once, and queries whose distances are held at once.
QUERY_BLOCK, ROW_BLOCK, QUERY_STEP = 1000, 1 << 14, 64
#: Below this share of pairs that meet in a bucket, each query is compared with its own rows only.
_FEW_MET = 1 / 16
#: Rounding of products of matrices; what is within it of the k-th place is compared again.
_ROUNDING = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def magnitude(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v: Column) -> Column:
    """Components over the magnitude; a zero vector stays zero."""
    m = magnitude(v)
    return F.transform(v, lambda x: F.when(m > 0, x.cast("double") / m).otherwise(F.lit(0.0)))


def quantize(v: Column, kind: str) -> Column:
    """Normalised components as F32, I16, I8 or BIT (sign bits, 1 where positive)."""
    if kind == "F32":
        return F.transform(v, lambda x: x.cast("float"))
    if kind == "BIT":
        return F.transform(v, lambda x: (x > 0).cast("tinyint"))
    scale, to = SCALES[kind], "smallint" if kind == "I16" else "tinyint"
    return F.transform(v, lambda x: F.round(x * scale).cast(to))


def dequantize(v: Column, kind: str) -> Column:
    if kind == "F32":
        return F.transform(v, lambda x: x.cast("double"))
    if kind == "BIT":
        return F.transform(v, lambda x: F.when(x > 0, F.lit(1.0)).otherwise(F.lit(-1.0)))
    return F.transform(v, lambda x: x.cast("double") / SCALES[kind])


def raw_hex(v: Column, big_endian: bool = True) -> Column:
    """Components as 32-bit floats in hex."""
    kind = ">f4" if big_endian else "<f4"

    @F.pandas_udf("string")
    def pack(s: pd.Series) -> pd.Series:
        return s.map(lambda x: np.asarray(x, dtype=kind).tobytes().hex())

    return pack(v)


def project(v: Column, dims_in: int, dims_out: int) -> Column:
    """A fixed random projection: signs from the 64-bit mixer of each (row, column)."""
    at = np.arange(dims_in * dims_out, dtype=np.uint64)
    signs = np.where(mixer64(at + np.uint64(1)) >> np.uint64(63), 1.0, -1.0).reshape(dims_in, dims_out) / np.sqrt(dims_out)

    @F.pandas_udf("array<double>")
    def times(s: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(s.to_list()).astype(np.float64) @ signs)) if len(s) else pd.Series([], dtype=object)

    return times(v)


def _directions(dims: int, tables: int = 1) -> np.ndarray:
    """Eight fixed directions of signs for each table."""
    at = np.arange(dims * 8 * tables, dtype=np.uint64)
    return np.where(mixer64(at + np.uint64(1)) >> np.uint64(63), 1.0, -1.0).reshape(dims, 8 * tables)


def lsh_byte(v: Column, dims: int) -> Column:
    """Eight sign bits of a fixed projection to eight directions."""
    return F.get(lsh_bytes(v, dims, 1), F.lit(0))


def lsh_bytes(v: Column, dims: int, tables: int) -> Column:
    """array<int>: such a byte for each of several tables, each with directions of its own."""
    signs = _directions(dims, tables)

    @F.pandas_udf("array<int>")
    def each(s: pd.Series) -> pd.Series:
        return pd.Series(list(_bytes(np.stack(s.to_list()).astype(np.float64), signs).astype(np.int32))) if len(s) else pd.Series([], dtype=object)

    return each(v)


def _bytes(vectors: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """[row, table]: the bytes of a matrix of vectors."""
    return np.packbits((vectors @ signs > 0).reshape(len(vectors), -1, 8), axis=2)[:, :, 0]


#: [byte, byte]: whether two bytes are equal or at Hamming distance 1.
_CLOSE = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)) <= 1


def _met(near: list[np.ndarray], asked: np.ndarray, signs: np.ndarray, n: int) -> np.ndarray:
    """[query, row]: which of n rows share a bucket with each query; ``near`` has a table's rows close to each byte, as bits."""
    own = _bytes(asked, signs)
    met = near[0][own[:, 0]]
    for table in range(1, len(near)):
        met = met | near[table][own[:, table]]
    return np.unpackbits(met, axis=1, count=n).astype(bool)


def near_bytes(byte: int) -> list[int]:
    """The byte and the eight at Hamming distance 1."""
    return sorted({byte, *[byte ^ 1 << i for i in range(8)]})


def prepare(rows: DataFrame, dims_in: int, dims_out: int, kind: str, vector: str = "v") -> DataFrame:
    """What a vector store keeps of each row: magnitude, quantised components after projection, bucket byte."""
    inner = rows.withColumn("_p", project(F.col(vector), dims_in, dims_out)) if 1 < dims_out < dims_in else rows.withColumn("_p", F.transform(vector, lambda x: x.cast("double")))
    return inner.select(
        *[c for c in rows.columns if c != vector],
        magnitude(F.col("_p")).alias("magnitude"),
        quantize(normalized(F.col("_p")), kind).alias("q"),
        lsh_byte(F.col("_p"), dims_out).alias("lsh"),
    )


def distance(metric: str, a: Column, b: Column) -> Column:
    """Distance of two raw vectors. COSINE is (1 - cos) / 2, 0.5 for a zero vector; the others are as named."""
    ma, mb = magnitude(a), magnitude(b)
    if metric == "COSINE":
        return F.when((ma == 0) | (mb == 0), F.lit(0.5)).otherwise(F.lit(1.0) - (F.lit(1.0) + dot(a, b) / (ma * mb)) / 2)
    pair = lambda f: F.aggregate(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    if metric == "EUCLIDEAN":
        return F.sqrt(pair(lambda x, y: (x - y) * (x - y)))
    if metric == "MANHATTAN":
        return pair(lambda x, y: F.abs(x - y))
    if metric == "CANBERRA":
        return pair(lambda x, y: F.when((x == 0) & (y == 0), F.lit(0.0)).otherwise(F.abs(x - y) / (F.abs(x) + F.abs(y))))
    bits = lambda v: F.transform(v, lambda x: (x > 0).cast("double"))
    x, y = bits(a), bits(b)
    both, na, nb = dot(x, y), dot(x, x), dot(y, y)
    if metric == "BIT_HAMMING":
        return (na + nb - 2 * both) / F.size(a)
    if metric == "BIT_COSINE":
        return F.when((na == 0) | (nb == 0), F.lit(1.0)).otherwise(F.sqrt(F.greatest(F.lit(0.0), 1 - both * both / (na * nb))))
    if metric == "BIT_DOMINATING":
        return F.when(na == 0, F.lit(1.0)).otherwise(1 - both / na)
    raise ValueError(metric)


def literal(vector) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def nearest(rows: DataFrame, query, metric: str, k: int, vector: str = "v", name: str = "name") -> DataFrame:
    """The k nearest rows to one query vector, exactly: distances in the scan, then a distributed top-k."""
    return rows.select(name, distance(metric, literal(query), F.col(vector)).alias("distance")).orderBy("distance", name).limit(k)


def distances(metric: str, rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """[query, row]: the same distances for matrices of raw vectors."""
    if metric == "COSINE":
        a, b = np.linalg.norm(queries, axis=1), np.linalg.norm(rows, axis=1)
        some = np.outer(a, b)
        return np.where(some > 0, (1 - np.divide(queries @ rows.T, some, out=np.zeros_like(some), where=some > 0)) / 2, 0.5)
    if metric == "EUCLIDEAN":
        return np.stack([np.sqrt(((rows - q) ** 2).sum(axis=1)) for q in queries])
    if metric == "MANHATTAN":
        return np.stack([np.abs(rows - q).sum(axis=1) for q in queries])
    if metric == "CANBERRA":
        whole = [np.abs(rows) + np.abs(q) for q in queries]
        return np.stack([np.divide(np.abs(rows - q), w, out=np.zeros_like(w), where=w > 0).sum(axis=1) for q, w in zip(queries, whole, strict=True)])
    x, y = (queries > 0).astype(np.float64), (rows > 0).astype(np.float64)
    both, nx, ny = x @ y.T, x.sum(axis=1)[:, None], y.sum(axis=1)[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        if metric == "BIT_HAMMING":
            return (nx + ny - 2 * both) / rows.shape[1]
        if metric == "BIT_COSINE":
            return np.where(nx * ny == 0, 1.0, np.sqrt(np.maximum(0.0, 1 - both * both / (nx * ny))))
        if metric == "BIT_DOMINATING":
            return np.where(nx == 0, 1.0, 1 - both / nx)
    raise ValueError(metric)


def _cosine(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosine distances summed in the order of ``distance``, so that equal vectors tie wherever they lie in a block."""
    total = lambda x: np.cumsum(x, axis=1)[:, -1]
    some = np.sqrt(total(rows * rows)) * np.sqrt(total(query[None] * query[None]))
    return np.where(some > 0, 1.0 - (1.0 + np.divide(total(rows * query), some, out=np.zeros_like(some), where=some > 0)) / 2, 0.5)


def _step(metric: str, vectors: np.ndarray, asked: np.ndarray, met: np.ndarray | None) -> np.ndarray:
    """[query, row]: distances, infinite where ``met`` says that two share no bucket."""
    if met is None:
        return distances(metric, vectors, asked)
    if met.mean() >= _FEW_MET:
        return np.where(met, distances(metric, vectors, asked), np.inf)
    apart = np.full(met.shape, np.inf)
    for i, own in enumerate(met):
        at = np.flatnonzero(own)
        if len(at):
            apart[i, at] = distances(metric, vectors[at], asked[i : i + 1])[0]
    return apart


def nearest_each(rows: DataFrame, queries: DataFrame, metric: str, k: int, vector: str = "v", name: str = "name") -> DataFrame:
    """The k nearest of each of a stated set of queries (query, q), exactly; ties go to the smaller name.

    Queries are written to the shared folder in blocks; a task multiplies some of its rows by one block after the other
    and passes on k rows a query, so it holds two blocks whatever the numbers of queries and rows. Names are numbers.
    """
    return _nearest_each(rows, queries, metric, k, vector, name)


def _nearest_each(rows: DataFrame, queries: DataFrame, metric: str, k: int, vector: str, name: str, signs: np.ndarray | None = None) -> DataFrame:
    """The same; with the ``signs`` of several tables among the rows that a query shares a bucket with."""
    ship(rows.sparkSession)
    files = blocks.write(queries.select("query", F.col("q").cast("array<double>").alias("q")), QUERY_BLOCK)

    def best(names: np.ndarray, vectors: np.ndarray, block: pd.DataFrame, near: list[np.ndarray]):
        asked, out = np.stack(block["q"].to_list()), []
        for at in range(0, len(asked), QUERY_STEP):
            some = asked[at : at + QUERY_STEP]
            met = _met(near, some, signs, len(names)) if near else None
            for query, q, d in zip(block["query"][at : at + QUERY_STEP], some, _step(metric, vectors, some, met), strict=True):
                # All that tie with the k-th stay until names decide.
                found = np.flatnonzero((d <= np.partition(d, k - 1)[k - 1] + _ROUNDING if len(d) > k else True) & (d < np.inf))
                d = _cosine(vectors[found], q) if metric == "COSINE" else d[found]
                first = np.lexsort((names[found], d))[:k]
                out.append((query, names[found][first], d[first]))
        told = np.repeat(np.array([q for q, *_ in out]), [len(n) for _, n, _ in out])
        return pd.DataFrame({"query": told, "name": np.concatenate([n for _, n, _ in out]), "distance": np.concatenate([d for *_, d in out])})

    def run(batches):
        held, size = [], 0
        for pdf in batches:
            for at in range(0, len(pdf), ROW_BLOCK):
                held.append(pdf.iloc[at : at + ROW_BLOCK])
                size += len(held[-1])
                if size >= ROW_BLOCK:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    def flush(held):
        pdf = pd.concat(held)
        if not len(pdf):
            return
        names, vectors = pdf["name"].to_numpy(), np.stack(pdf["v"].to_list())
        near = [] if signs is None else [np.packbits(_CLOSE[:, own], axis=1) for own in _bytes(vectors, signs).T]
        for file in files:
            found = best(names, vectors, blocks.read(file), near)
            if len(found):
                yield found

    from pyspark.sql.window import Window

    kinds = f"query {queries.schema['query'].dataType.simpleString()}, {name} {rows.schema[name].dataType.simpleString()}, distance double"
    some = rows.select(F.col(name).alias("name"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("v").isNotNull())
    pairs = some.mapInPandas(run, kinds.replace(f", {name} ", ", name ")).withColumnRenamed("name", name)
    w = Window.partitionBy("query").orderBy("distance", name)
    return pairs.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def nearest_lsh(rows: DataFrame, query, metric: str, k: int, dims: int, vector: str = "v", name: str = "name") -> DataFrame:
    """The k nearest among rows whose bucket byte (column lsh) is within Hamming distance 1 of the query's."""
    bits = np.asarray(query, float) @ _directions(dims) > 0
    return nearest(rows.filter(F.col("lsh").isin(near_bytes(int(np.packbits(bits)[0])))), query, metric, k, vector, name)


def nearest_lsh_each(rows: DataFrame, queries: DataFrame, metric: str, k: int, dims: int, tables: int, vector: str = "v", name: str = "name") -> DataFrame:
    """The k nearest of each query (query, q) among rows that share a bucket, or one at Hamming distance 1, in any table.

    Bytes of a block of rows meet those of a block of queries as bits, side by side with the exact search, so pairs that
    meet are neither shuffled nor written. More tables find more: recall is measured in the tests.
    """
    return _nearest_each(rows, queries, metric, k, vector, name, _directions(dims, tables))

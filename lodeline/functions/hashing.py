"""64-bit hashes over numpy: the public-domain MurmurHash64A and its finaliser, in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_M = np.uint64(0xC6A4A7935BD1E995)
_R = np.uint64(47)
#: What the finaliser takes in place of zero.
NONZERO = 0xDEEDBEEFABBAB0BA


def murmur64a(values: list[bytes], seed: int = 0) -> np.ndarray:
    """MurmurHash64A of each value as uint64. Values of one length are hashed together."""
    out = np.zeros(len(values), np.uint64)
    by: dict[int, list[int]] = {}
    for i, v in enumerate(values):
        by.setdefault(len(v), []).append(i)
    with np.errstate(over="ignore"):
        for size, at in by.items():
            data = np.frombuffer(b"".join(values[i] for i in at), np.uint8).reshape(len(at), size)
            h = np.full(len(at), np.uint64(seed) ^ (np.uint64(size) * _M))
            whole = size // 8
            if whole:
                blocks = np.ascontiguousarray(data[:, : whole * 8]).view("<u8")
                for j in range(whole):
                    k = blocks[:, j] * _M
                    k = (k ^ (k >> _R)) * _M
                    h = (h ^ k) * _M
            if size % 8:
                tail = np.zeros(len(at), np.uint64)
                for j in range(size % 8):
                    tail |= data[:, whole * 8 + j].astype(np.uint64) << np.uint64(8 * j)
                h = (h ^ tail) * _M
            h = (h ^ (h >> _R)) * _M
            out[at] = h ^ (h >> _R)
    return out


def mixer64(x: np.ndarray) -> np.ndarray:
    """The finaliser: xor-shift and multiply, twice; zero is replaced first."""
    with np.errstate(over="ignore"):
        x = np.where(x == 0, np.uint64(NONZERO), x.astype(np.uint64))
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def as_bytes(s: pd.Series) -> list[bytes]:
    """UTF-8 of strings, binaries as they are, empty for null."""
    return [b"" if v is None else v.encode() if isinstance(v, str) else bytes(v) for v in s]


def _ready() -> None:
    """Workers import this module, so the package goes to them first."""
    from lodeline.functions.session import ship

    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship(spark)


def murmur(value: Column, seed: int = 0, modulo: int = 0) -> Column:
    """Hash of a string or binary as an unsigned decimal(20,0), or its remainder as a long."""
    _ready()
    if modulo:

        @F.pandas_udf("long")
        def rest(s: pd.Series) -> pd.Series:
            return pd.Series((murmur64a(as_bytes(s), seed) % np.uint64(modulo)).astype(np.int64))

        return rest(value)

    @F.pandas_udf("string")
    def whole(s: pd.Series) -> pd.Series:
        return pd.Series([str(x) for x in murmur64a(as_bytes(s), seed).tolist()])

    return whole(value).cast("decimal(20,0)")


def mixed(value: Column) -> Column:
    """The finaliser of a non-negative long, as an unsigned decimal(20,0); null stays null."""
    _ready()

    @F.pandas_udf("string")
    def mix(s: pd.Series) -> pd.Series:
        return pd.Series([str(x) for x in mixer64(s.to_numpy(np.uint64)).tolist()])

    known = F.coalesce(value.cast("bigint"), F.lit(0))
    return F.when(value.isNotNull(), mix(known).cast("decimal(20,0)"))


def slots_of(raw: list[bytes], width: int, count: int) -> np.ndarray:
    """[value, seed]: the values' slots, as of ``slots``."""
    if not raw:
        return np.zeros((0, count), np.int64)
    return np.stack([(murmur64a(raw, i) % np.uint64(width)).astype(np.int64) for i in range(count)], axis=1)


def slots(value: Column, width: int, count: int) -> Column:
    """array<long>: the value's hash modulo ``width`` under each of the seeds 0 to count - 1.

    A seed is mixed in where the last bytes are, so items of up to seven bytes that differ by a seed's bits share slots
    under different seeds; filters over such items have more false positives than the design says, never false negatives.
    """
    _ready()

    @F.pandas_udf("array<long>")
    def each(s: pd.Series) -> pd.Series:
        return pd.Series(list(slots_of(as_bytes(s), width, count)))

    return each(value)

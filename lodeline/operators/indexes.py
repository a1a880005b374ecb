"""Secondary indexes as columns and clustering: composite, linear, z-order, geographic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.functions import geohash, zorder


def current(versions: DataFrame, by: tuple[str, ...] = ("sub",), version: str = "version", dead: str = "is_tombstone") -> DataFrame:
    """The newest version of each entry of an index, without those deleted: what adding and removing leave behind.

    Moving an entry needs no stale rows taken out, as its dimensions are columns of the one newest row.
    """
    rest = [c for c in versions.columns if c not in by]
    newest = versions.groupBy(*by).agg(F.max_by(F.struct(*rest), version).alias("_v"))
    return newest.select(*by, *[F.col(f"_v.{c}").alias(c) for c in rest]).filter(~F.col(dead)).drop(dead)


def lookup(entries: DataFrame, requests: DataFrame, *columns: str) -> DataFrame:
    """requests (sub) with chosen columns of the entries, null where absent, and whether they exist."""
    found = entries.select("sub", *columns, F.lit(True).alias("_there"))
    return requests.join(found, "sub", "left").select("sub", *columns, F.coalesce("_there", F.lit(False)).alias("exists"))


def composite_range(rows: DataFrame, dims: list[str], equal: list, n: int, after: tuple | None = None, sort: str = "sort", sub: str = "sub") -> DataFrame:
    """Rows whose leading dims equal the given values, ordered by the other dims, sort and sub; a keyset page of n.

    Any order of the dims may be asked for: they are columns, so no permutation is stored.
    """
    found = rows
    for d, v in zip(dims, equal, strict=False):
        found = found.filter(F.col(d) == v)
    rest = [*dims[len(equal) :], sort, sub]
    if after is not None:
        beyond, tied = F.lit(False), F.lit(True)
        for c, v in zip(rest, after, strict=True):
            beyond |= tied & (F.col(c) > v)
            tied &= F.col(c) == v
        found = found.filter(beyond)
    return found.orderBy(*rest).limit(n)


def linear_range(rows: DataFrame, low, high, n: int, x: str = "x", sub: str = "sub") -> DataFrame:
    return rows.filter(F.col(x).between(low, high)).orderBy(x, sub).limit(n)


def with_z(rows: DataFrame, coords: list[str]) -> DataFrame:
    return rows.withColumn("z", zorder.encode(*[F.col(c) for c in coords]))


#: Rows that a task sorts and writes as one file along the curve, and the least number of such files.
Z_ROWS, Z_FILES = 1 << 20, 8


def write_z_ordered(rows: DataFrame, coords: list[str], path: str, files: int | None = None) -> None:
    """Files clustered along the curve: box reads skip files and row groups by the coordinates' statistics.

    Unless stated, there are as many files as the rows take, so that a task sorts no more of a larger table.
    """
    files = max(Z_FILES, -(-rows.count() // Z_ROWS)) if files is None else files
    with_z(rows, coords).repartitionByRange(files, "z").sortWithinPartitions("z").write.parquet(path)


def box(rows: DataFrame, bounds: dict[str, tuple[int, int]], n: int | None = None, sub: str = "sub") -> DataFrame:
    """Rows inside the box (bounds inclusive), in z order then sub."""
    found = rows
    for c, (low, high) in bounds.items():
        found = found.filter(F.col(c).between(low, high))
    found = with_z(found, list(bounds)) if "z" not in rows.columns else found
    return found if n is None else found.orderBy("z", sub).limit(n)


def stored_box(rows: DataFrame, bounds: dict[str, tuple[int, int]], n: int | None = None, sub: str = "sub", most: int = 32) -> DataFrame:
    """The same over rows written by ``write_z_ordered``: ranges of the curve that the box meets are skipped to by z."""
    near = F.lit(False)
    for a, b in zorder.ranges([a for a, _ in bounds.values()], [b for _, b in bounds.values()], most):
        near |= F.col("z").between(a, b)
    return box(rows.filter(near), bounds, n, sub)


def point(rows: DataFrame, at: dict[str, int], n: int, sub: str = "sub") -> DataFrame:
    return box(rows, {c: (v, v) for c, v in at.items()}).orderBy(sub).limit(n)


def geo_radius(places: DataFrame, lat: float, lon: float, radius: float) -> DataFrame:
    """Places nearer than ``radius`` metres, with whole metres. A bounding box that the scan can skip by comes first."""
    south, north, west, east = geohash.box(lat, lon, radius)
    inside = F.col("lat").between(south, north)
    if west < -180.0 or east > 180.0:
        inside &= (F.col("lon") >= (west + 540.0) % 360.0 - 180.0) | (F.col("lon") <= (east + 540.0) % 360.0 - 180.0)
    elif (west, east) != (-180.0, 180.0):
        inside &= F.col("lon").between(west, east)
    metres = geohash.distance(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))
    return places.filter(inside).withColumn("_m", metres).filter(F.col("_m") < radius).select("name", F.floor("_m").cast("long").alias("metres"))


def geo_distance(places: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (name1, name2) with whole metres, -1 where a place is missing."""
    a = places.select(F.col("name").alias("name1"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = places.select(F.col("name").alias("name2"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    metres = F.floor(geohash.distance(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))).cast("long")
    return pairs.join(a, "name1", "left").join(b, "name2", "left").select("name1", "name2", F.coalesce(metres, F.lit(-1)).alias("metres"))


def geo_format(lat: Column, lon: Column) -> Column:
    return F.concat(F.format_string("%+.10f,%+.10f,", lat, lon), geohash.encode(lat, lon))

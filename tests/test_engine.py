"""Known answers of the operators, and properties of sketches, stores and streams."""

import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeline.functions import geohash, hashing, zorder
from lodeline.functions.numeric import I64_MAX, I64_MIN, parse_i64, saturating_sum
from lodeline.operators import containers, counters, indexes, joins, scan, sketches, store, summary, text, vectors
from lodeline.plans.queries import QUERIES
from lodeline.sources import config, files
from lodeline.streaming import state

NOW = 10_000_000_000
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def log(spark, rows):
    full = [(k, v, c, e, t, i) for i, (k, v, c, e, t) in enumerate(rows)]
    return spark.createDataFrame(full, store.SCHEMA)


@pytest.fixture(scope="module")
def versions(spark):
    return log(
        spark,
        [
            ("a", "1", 1, 0, False), ("a", "2", 5, 0, False), ("b", "1", 1, 0, False), ("b", "", 2, 0, True), ("c", "x", 1_000_000, 8_999, False), ("d", "x", 1_000_000, 9_999, False),
            ("e", "first", 3, 0, False), ("e", "second", 3, 0, False), ("f", "", 9, 0, False), ("g", "old", 9, 0, False), ("g", "new", 7, 0, False), ("h~x", "hx", 1, 0, False), ("h~y", "hy", 1, 0, False),
        ],
    )


def pairs(df):
    return {r.key: r.val for r in df.collect()}


def test_newest_live_version_wins(spark, versions):
    assert pairs(store.live(versions, NOW)) == {"a": "2", "d": "x", "e": "second", "g": "old", "h~x": "hx", "h~y": "hy"}
    assert store.get(versions, "b", NOW).first().val == ""
    assert {r.field: r.val for r in store.fields(versions, "h", NOW).collect()} == {"x": "hx", "y": "hy"}
    # Expiry is strict: a row lives up to and at its last moment.
    assert "c" in pairs(store.live(versions, 1_000_000 + 8_999 * 1_000_000))
    assert "c" not in pairs(store.live(versions, 1_000_001 + 8_999 * 1_000_000))


def test_writes_append(spark, versions):
    requests = spark.createDataFrame([("a", "9"), ("z", "9")], "key string, val string")
    apply = lambda rows: pairs(store.live(versions.unionByName(rows), NOW + 1))
    assert apply(store.put_absent(versions, requests, NOW)) == pairs(store.live(versions, NOW + 1)) | {"z": "9"}
    assert apply(store.put_present(versions, requests, NOW))["a"] == "9"
    assert store.put_all_absent(versions, requests, NOW).count() == 0
    assert store.put_all_present(versions, requests, NOW).count() == 0
    assert store.put_all_present(versions, requests.filter("key = 'a'"), NOW).count() == 1
    assert "a" not in apply(store.delete(requests.select("key"), NOW))
    assert "a" not in apply(store.put(requests.withColumn("val", F.lit("")), NOW))
    assert apply(store.append(versions, requests.withColumnRenamed("val", "more"), NOW))["a"] == "29"
    assert pairs(store.revive(versions, NOW)) == {"b": "1", "c": "x"}
    moves = spark.createDataFrame([("a", "e"), ("a", "new"), ("none", "q")], "old_key string, new_key string")
    assert pairs(store.copy(versions, moves, NOW, absent_only=True)) == {"new": "2"}
    moved = apply(store.copy(versions, moves.filter("new_key = 'new'"), NOW, move=True))
    assert moved["new"] == "2" and "a" not in moved
    cas = spark.createDataFrame([("a", "2", "n"), ("d", "y", "n"), ("z", "", "n")], "key string, old string, val string")
    assert pairs(store.compare_and_set(versions, cas, NOW)) == {"a": "n"}


def test_sorted_tables_are_skipped_into(spark, versions, tmp_path):
    store.write_sorted(versions, str(tmp_path / "t"), 2)
    rows = files.open_tables(spark, str(tmp_path / "t"))
    plan = rows.filter(store.in_prefix("h~"))._jdf.queryExecution().toString()
    assert "StringStartsWith(key,h~)" in plan
    pushed = store.live(rows, NOW).filter(F.col("key") == "a")._jdf.queryExecution().toString()
    assert "EqualTo(key,a)" in pushed
    assert pairs(store.live(rows, NOW)) == pairs(store.live(versions, NOW))
    assert store.compact(rows).count() == 9
    assert store.size(rows, NOW).first().asDict() == {"raw": 13, "keys": 9, "live": 6}


def test_read_and_write(spark, versions, tmp_path):
    keys = spark.createDataFrame([("a",), ("b",), ("zz",)], "key string")
    values, writes = store.get_and(versions, keys, NOW, lambda rows: store.delete(rows, NOW))
    assert pairs(values) == {"a": "2", "b": "", "zz": ""}
    assert [(r.key, r.is_tombstone) for r in writes.collect()] == [("a", True)]
    store.write_sorted(versions, str(tmp_path / "b"), 1, bloom=True)
    assert store.get(files.open_tables(spark, str(tmp_path / "b")), "e", NOW).first().val == "second"
    entries = indexes.current(spark.createDataFrame([(1, "x", 1, False), (1, "y", 2, False), (2, "x", 1, False), (2, "x", 3, True)], "sub long, i1 string, version long, is_tombstone boolean"))
    assert [(r["sub"], r.i1) for r in entries.collect()] == [(1, "y")]
    asked = spark.createDataFrame([(1,), (2,)], "sub long")
    assert [(r["sub"], r.i1, r.exists) for r in indexes.lookup(entries, asked, "i1").orderBy("sub").collect()] == [(1, "y", True), (2, None, False)]


def gold(spark):
    return spark.createDataFrame([(f"a~{y}", str((y * 37) % 500 - 100)) for y in range(1969, 2024)], "key string, val string")


def test_scans_and_pages(spark):
    rows = gold(spark)
    got = scan.page(rows, "a~1974", 10).orderBy("key").collect()
    assert len(got) == 11 and got[-1].key == "a~1984" and got[-1].is_tail and got[-1].val == ""
    assert scan.next_row(rows, "a~1974").first().key == "a~1975"
    assert scan.page(rows, "a~2020", 10, end="a~2022").count() == 3
    every = [k for page in scan.pages(rows, 7, "a~") for k, _ in page]
    assert every == [f"a~{y}" for y in range(1969, 2024)]
    assert scan.glob(rows, "a~19[67]?").count() == 11
    values = [(y * 37) % 500 - 100 for y in range(1984, 2024)]
    one = lambda n: scan.accumulate(rows, n, prefix="a~", start="a~1984").first()[0]
    assert [one(n) for n in scan.AGGREGATES] == [40, sum(values), min(values), max(values), str(values[0]), str(values[-1]), int(sum(values) / 40)]
    none = lambda n: scan.accumulate(rows, n, prefix="zz").first()[0]
    assert [none(n) for n in scan.AGGREGATES] == [0, 0, I64_MAX, I64_MIN, "", "", None]


def test_numbers_in_text(spark):
    cases = {"12": 12, "-7x": -7, "+7": 0, " 7": 0, "": 0, "x": 0, "99999999999999999999": 0, str(I64_MIN): I64_MIN, "0012a": 12}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", parse_i64(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in got} == cases
    assert spark.createDataFrame([(I64_MAX,), (5,)], "n long").agg(saturating_sum(F.col("n"))).first()[0] == I64_MAX


def test_counters(spark):
    steps = [1, 1, 1, 1, 2, 2, 2, -2, -2, -2, -1, -1, -1, -1]
    ops = spark.createDataFrame([("k", i, d) for i, d in enumerate(steps)], "key string, seq long, delta long")
    assert [r.value for r in counters.running(ops).orderBy("seq").collect()] == [1, 2, 3, 4, 6, 8, 10, 8, 6, 4, 3, 2, 1, 0]
    up = spark.createDataFrame([("k", 1, 6), ("k", 2, 6), ("k", 3, 4), ("k", 4, -3)], "key string, seq long, delta long")
    assert counters.limited(up, 10).first().value == 10
    assert counters.limited(up, -9, down=True).first().value == -6


def test_containers(spark):
    items = spark.createDataFrame([("k", i, w) for i, w in enumerate(["Germany", "Poland", "USA", "UK", "Bulgaria"])], "key string, seq long, item string")
    assert containers.list_get(containers.lists(items), 1, 33).first().asDict() == {"key": "k", "item1": "Poland", "item33": "", "length": 5}
    pushed = spark.createDataFrame([("k", i, str(i)) for i in (1, 2, 3, 4, 6, 7, 8, 9)], "key string, seq long, item string")
    assert containers.ring(pushed, 5).first()["items"] == ["4", "6", "7", "8", "9"]
    assert containers.ring(pushed, 5, 4).first()["items"] == ["9"]
    assert containers.ring(pushed, 5, 9).first()["items"] == []
    schema = "3:id,10:name,2:country"
    rec = spark.range(1).select(containers.record_pack(schema, F.lit("1"), F.lit("Niki"), F.lit("BG")).alias("r"))
    assert rec.first().r == "1  Niki      BG"
    assert rec.select(containers.record_get(schema, F.col("r"), "name")).first()[0] == "Niki"
    assert rec.select(containers.record_get(schema, F.col("r"), "none")).first()[0] == ""
    bits = spark.createDataFrame([("k", i, 1) for i in (0, 5, 6, 32767, 32768, 100_000)], "key string, idx long, bit int")
    sets = containers.bitsets(bits)
    assert containers.bit_count(sets).first().bits == 6
    asked = spark.createDataFrame([("k", i) for i in (0, 1, 5, 6, 7, 32767, 32768, 32769, 100_000)], "key string, idx long")
    assert {r.idx for r in containers.bit_get(sets, asked).collect() if r.bit} == {0, 5, 6, 32767, 32768, 100_000}


def test_murmur_known_values():
    # Of the algorithm's public definition, one block and tail at a time.
    def plain(data: bytes, seed: int = 0) -> int:
        m, top = 0xC6A4A7935BD1E995, (1 << 64) - 1
        h = seed ^ (len(data) * m & top)
        for i in range(0, len(data) // 8 * 8, 8):
            k = int.from_bytes(data[i : i + 8], "little") * m & top
            k = (k ^ k >> 47) * m & top
            h = (h ^ k) * m & top
        tail = data[len(data) // 8 * 8 :]
        if tail:
            h = (h ^ int.from_bytes(tail, "little")) * m & top
        h = (h ^ h >> 47) * m & top
        return h ^ h >> 47

    values = [b"", b"a", b"abcdefgh", b"abcdefghi", "é".encode() * 9, bytes(range(64))]
    assert hashing.murmur64a(values, 3).tolist() == [plain(v, 3) for v in values]


@pytest.mark.parametrize("dims", [1, 2, 3, 4, 8, 16])
def test_curve_keys(spark, dims):
    rnd = random.Random(dims)
    top = 1 << min(zorder.BITS[dims], 62)
    rows = [[rnd.randrange(top) for _ in range(dims)] for _ in range(50)] + [[0] * dims, [top - 1] * dims]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"x{k} long" for k in range(dims)))
    z = zorder.encode(*[F.col(f"x{k}") for k in range(dims)])
    got = df.select("i", z.alias("z")).select("i", "z", zorder.decode(F.col("z"), dims).alias("back")).collect()
    bits = zorder.BITS[dims]
    for r in got:
        want = 0
        for b in range(bits - 1, -1, -1):
            for c in reversed(rows[r.i]):
                want = want * 2 + (c >> b & 1)
        assert int(r.z, 16) == want
        assert dims == 1 or list(r.back) == rows[r.i]
    assert len({len(r.z) for r in got}) == 1


def test_curve_keys_are_quick(spark):
    """Shifts by masks: a bit at a time, and a digit at a time back, took a task many times as long."""
    rows = spark.range(0, 300_000, 1, 1).select(*[(F.col("id") * (i + 3) % (97 + i)).alias(f"x{i}") for i in range(4)])
    z = rows.withColumn("z", zorder.encode(*[F.col(f"x{i}") for i in range(4)]))
    wrong = z.filter(zorder.decode(F.col("z"), 4) != F.array(*[F.col(f"x{i}") for i in range(4)]))
    began = time.perf_counter()
    assert wrong.count() == 0
    assert time.perf_counter() - began < 9


def test_places(spark):
    df = spark.createDataFrame([("Boho", 42.6917499713, 23.3210056126), ("near", 42.6920, 23.3211), ("far", 52.52, 13.405)], "name string, lat double, lon double")
    assert df.filter("name = 'Boho'").select(indexes.geo_format(F.col("lat"), F.col("lon"))).first()[0] == "+42.6917499713,+23.3210056126,sx8dfevc6z40"
    got = {r.name: r.metres for r in indexes.geo_radius(df, 42.69175, 23.32101, 100.0).collect()}
    assert set(got) == {"Boho", "near"} and got["Boho"] == 0
    assert indexes.geo_radius(df, 42.69175, 23.32101, 9_000_000.0).count() == 3
    back = df.select(geohash.decode(geohash.encode(F.col("lat"), F.col("lon"))).alias("p"), "lat", "lon").collect()
    assert all(abs(r.p.lat - r.lat) < 1e-6 and abs(r.p.lon - r.lon) < 1e-6 for r in back)


def test_summaries(spark):
    rows = spark.createDataFrame([("k", 1, 1.0), ("k", 2, 1.0), ("k", 3, float("nan")), ("k", 4, float("inf"))], "g string, at long, v double")
    got = summary.statistics(summary.collect(rows, "v", "at", ["g"]), ["g"]).first().asDict()
    want = {"count": 2, "sum": 2, "sumsq": 2, "range": 0, "avg": 1, "harm": 1, "geom": 1, "vari": 0, "rms": 1}
    assert {k: got[k] for k in want} == want
    assert summary.statistics(summary.collect(rows.limit(0), "v", "at")).first()["count"] == 0


def test_composite_and_text(spark):
    rows = spark.createDataFrame([("niki", "A", "2"), ("ivan", "A", "3"), ("boro", "B", "1"), ("gogo", "A", "1")], "sub string, a string, sort string")
    assert [r["sub"] for r in indexes.composite_range(rows, ["a"], ["A"], 10).collect()] == ["gogo", "niki", "ivan"]
    docs = spark.createDataFrame([(1, "s1", "red,blue,red,"), (2, "s0", "blue"), (3, "s2", "red,blue,green")], "sub long, sort string, words string")
    index = text.postings(docs, text.tokens(F.col("words"), ","), "sort", "sub")
    assert index.count() == 6
    assert [r["sub"] for r in text.search_all(index, ["red", "blue"], 9).collect()] == [1, 3]
    assert [(r["sub"], r.matches) for r in text.search_any(index, ["red", "green", "nope"], 9).collect()] == [(3, 2), (1, 1)]
    assert text.search_all(index, ["red", "nope"], 9).count() == 0
    grams = spark.createDataFrame([(["abcd", "ab", "éèê"],)], "w array<string>").select(text.grams(F.col("w")), text.hybrid(F.col("w"))).first()
    assert grams[0] == ["ab", "abc", "bcd", "éèê"] and grams[1] == ["ab", "abc", "abcd", "bcd", "éèê"]


def test_distinct_counts(spark):
    rows = spark.createDataFrame([("a", i) for i in range(20_000)] + [("b", i) for i in range(10_000, 30_000)] + [("c", 1)] * 50, "s string, v long")
    registers = sketches.hll(rows, F.col("v"), ["s"])
    got = {r.s: r.estimate for r in sketches.hll_estimate(registers, ["s"]).collect()}
    assert abs(got["a"] / 20_000 - 1) < 4 * sketches.HLL_ERROR and abs(got["c"] - 1) < 0.01
    r = sketches.hll_relations(registers, "s", ["a", "b"]).first()
    assert abs(r.union / 30_000 - 1) < 0.06 and abs(r.intersection / 10_000 - 1) < 0.2 and abs(r.jaccard - 1 / 3) < 0.06 and abs(r.overlap - 0.5) < 0.08


def test_membership_and_frequencies(spark):
    added = spark.createDataFrame([(f"k{i}", i % 5 + 1) for i in range(500)], "item string, n long")
    asked = spark.createDataFrame([(f"k{i}",) for i in range(1000)], "item string")
    found = {r["item"]: r.found for r in sketches.bloom_exists(sketches.bloom(added, F.col("item"), 1 << 14, 7), asked, 1 << 14, 7).collect()}
    assert all(found[f"k{i}"] for i in range(500)) and sum(found.values()) < 520
    for by_row in (True, False):
        table = sketches.counters(added, F.col("item"), F.col("n"), 4096, 4, by_row=by_row)
        twice = sketches.counters_merge(table, table)
        est = {r["item"]: r.estimate for r in sketches.counters_estimate(twice, asked, 4096, 4, by_row).collect()}
        assert all(est[f"k{i}"] >= 2 * (i % 5 + 1) for i in range(500))
    small = sketches.counters(spark.createDataFrame([("a", 200), ("a", 200), ("b", 9), ("b", -4)], "item string, n long"), F.col("item"), F.col("n"), 1 << 20, 3, size=8)
    est = {r["item"]: r.estimate for r in sketches.counters_estimate(small, spark.createDataFrame([("a",), ("b",), ("c",)], "item string"), 1 << 20, 3).collect()}
    assert est == {"a": 255, "b": 5, "c": 0}
    f = sketches.Cuckoo(300, 16)
    assert all(f.add(f"i{i}".encode()) for i in range(1000)) and all(f.exists(f"i{i}".encode()) for i in range(1000))
    assert sum(f.exists(f"j{i}".encode()) for i in range(1000)) < 5
    assert f.remove(b"i5") and not f.exists(b"i5")
    full = sketches.Cuckoo(1, 16)
    assert [full.add(f"x{i}".encode()) for i in range(6)] == [True] * 4 + [False] * 2 and full.exists(b"x3")


@pytest.mark.parametrize("block", [1 << 18, 8])
def test_filters_do_not_repeat_items_for_their_slots(spark, monkeypatch, block):
    """Items that ask stay in their rows, however many bits they ask for; words may pass in parts and lie in many blocks."""
    monkeypatch.setattr(sketches, "BLOOM_BLOCK", block)
    monkeypatch.setattr(sketches, "BLOOM_HELD", 200)
    monkeypatch.setattr(sketches, "BLOOM_ASKED", 50)
    rows = spark.range(0, 2000, 1, 3).select((F.col("id") % 500).alias("id")).select(F.when(F.col("id") > 0, F.concat(F.lit("item-"), "id")).alias("item"))
    words = sketches.bloom(rows, F.col("item"), 5000, 7)
    asked = spark.range(0, 1000, 1, 2).select(F.concat(F.lit("item-"), "id").alias("item"), "id").unionByName(spark.createDataFrame([(None, 0), ("item-1", 1), ("", 0)], "item string, id long"))
    found = sketches.bloom_exists(words, asked, 5000, 7)
    assert not any(x in found._jdf.queryExecution().executedPlan().toString() for x in ("Exchange", "Aggregate", "Generate"))
    want = {x for i in range(500) for x in hashing.slots_of([f"item-{i}".encode() if i else b""], 5000, 7)[0].tolist()}
    assert {64 * r.word + b for r in words.collect() for b in range(64) if r.mask >> b & 1} == want
    got = [tuple(r) for r in found.collect()]
    own = lambda item: int(set(hashing.slots_of([(item or "").encode()], 5000, 7)[0].tolist()) <= want)
    assert len(got) == 1003 and all(n == own(item) for item, _, n in got)
    assert sum(n for *_, n in got) < 550 and sketches.bloom_exists(words.filter("word < 0"), asked, 5000, 7).agg(F.max("found")).first()[0] == 0


def test_asked_customers_are_grouped_by_nothing(spark):
    """What each customer asks and is told lies in its row: customers are joined with their counts only."""
    plan = QUERIES["bf_exists"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.split("== Initial Plan ==")[0].count("Join") == 1


def test_heavy_hitters_and_samples(spark):
    rnd = random.Random(3)
    items = ["hot"] * 600 + ["warm"] * 250 + [f"c{rnd.randrange(300)}" for _ in range(400)]
    rnd.shuffle(items)
    got = {r["item"]: r.n for r in sketches.misra_gries(spark.createDataFrame([(i,) for i in items], "item string").repartition(4), 8).collect()}
    assert 600 >= got["hot"] >= 600 - len(items) / 9 and 250 >= got["warm"] >= 250 - len(items) / 9
    assert len(got) <= 8
    rows = spark.createDataFrame([("g", i) for i in range(10_000)], "g string, seq long")
    sample = [r.seq for r in sketches.reservoir(rows, 500, ["g"]).collect()]
    assert len(set(sample)) == 500 and 4000 < np.mean(sample) < 6000


def test_heavy_hitters_over_empty_partitions(spark):
    rows = spark.createDataFrame([("a",)] * 3, "item string").repartition(1)
    got = sketches.misra_gries(rows.unionByName(rows.filter("item = 'none'")), 100_000)
    assert [tuple(r) for r in got.collect()] == [("a", 3)]
    assert sketches.misra_gries(rows.filter("item = 'none'"), 3).collect() == []


def test_few_counters_over_a_file_without_rows(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    where = str(tmp_path / "events.parquet")
    events.write.parquet(where)
    events.limit(0).write.mode("append").parquet(where)
    got = QUERIES["mg_small"](spark, str(tmp_path)).collect()
    assert sum(r.n for r in got) == events.count() and all(r.bounded for r in got)


def test_digests(spark):
    rows = spark.createDataFrame([("k", 100.0, 1), ("k", 80.0, 1000), ("k", 110.0, 1000)], "k string, value double, weight long")
    c = sketches.digest(rows, ["k"])
    assert sketches.digest_percentiles(c, ["k"], 0.5, 0.9).first().asDict() == {"k": "k", "p500": 100.0, "p900": 110.0}
    info = sketches.digest_info(c, ["k"]).first()
    assert (info.size, info.min, info.max) == (2001, 80.0, 110.0)
    thrice = sketches.digest(rows.union(rows).union(rows), ["k"])
    assert sketches.digest_info(thrice, ["k"]).first().size == 6003
    rng = np.random.default_rng(1)
    many = spark.createDataFrame([("k", float(x)) for x in rng.normal(size=5000)], "k string, value double")
    p = sketches.digest_percentiles(sketches.digest(many, ["k"], 200), ["k"], 0.25, 0.5, 0.75).first()
    assert abs(p.p500) < 0.15 and abs(p.p250 + 0.674) < 0.15 and abs(p.p750 - 0.674) < 0.15


def test_vectors(spark):
    rows = spark.createDataFrame([(f"w{i}", [float(i), 1.0, -2.0]) for i in range(5)] + [("z", [0.0, 0.0, 0.0])], "name string, v array<double>")
    assert [r.name for r in vectors.nearest(rows, [4.0, 1.0, -2.0], "EUCLIDEAN", 2).collect()] == ["w4", "w3"]
    assert {r.name: r.distance for r in vectors.nearest(rows, [1.0, 0.0, 0.0], "COSINE", 9).collect()}["z"] == 0.5
    back = rows.select("name", vectors.dequantize(vectors.quantize(vectors.normalized(F.col("v")), "I16"), "I16").alias("q"), vectors.normalized(F.col("v")).alias("n"))
    assert all(abs(a - b) < 1e-4 for r in back.collect() for a, b in zip(r.q, r.n, strict=True))
    assert vectors.near_bytes(0) == [0, 1, 2, 4, 8, 16, 32, 64, 128]
    rng = np.random.default_rng(5)
    cloud = rng.normal(size=(300, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(cloud)], "name long, v array<double>").withColumn("lsh", vectors.lsh_byte(F.col("v"), 16))
    near = (cloud[0] + rng.normal(size=16) * 0.01).tolist()
    assert vectors.nearest_lsh(df, near, "COSINE", 1, 16).first().name == 0


def test_loads(spark, tmp_path):
    (tmp_path / "1.txt").write_text("Bonn\t1\nSofia\t2\n\tno key\na01\t3\textra\n")
    (tmp_path / "2.txt").write_text("Bonn\t4\na01\t5\na01\t6\nempty\t\n")
    rows = files.load_tsv(spark, str(tmp_path / "1.txt"), str(tmp_path / "2.txt"))
    assert pairs(store.live(rows, NOW)) == {"Bonn": "4", "Sofia": "2", "a01": "6"}
    (tmp_path / "3.txt").write_text("k\tU29maWE=\n")
    assert pairs(files.load_tsv(spark, str(tmp_path / "3.txt"), base64=True)) == {"k": "Sofia"}
    assert files.pick_for_merge([("a", 100), ("b", 110), ("c", 150), ("d", 9000)]) == ["a", "b", "c"]
    assert files.pick_for_merge([("a", 1), ("b", 100)]) == []


def test_folds(spark):
    ops = [("q", i, "add", str(i)) for i in range(5)] + [("q", 5 + i, "pop", "") for i in range(6)]
    df = spark.createDataFrame(ops, "key string, seq long, op string, arg string")
    assert [r.reply for r in state.fold(df, state.queue).orderBy("seq").collect()][5:] == ["0", "1", "2", "3", "4", ""]
    assert [r.reply for r in state.fold(df, state.ring(3)).orderBy("seq").collect()][5:] == ["2", "3", "4", "", "", ""]
    cas = spark.createDataFrame([("k", 1, "cas", ":x"), ("k", 2, "set", "a"), ("k", 3, "cas", "b:c"), ("k", 4, "cas", "a:c"), ("k", 5, "get", ""), ("k", 6, "cad", "c"), ("k", 7, "get", "")], "key string, seq long, op string, arg string")
    assert [r.reply for r in state.fold(cas, state.register).orderBy("seq").collect()] == ["0", "1", "0", "1", "c", "1", ""]


def test_streams(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    schema = "key string, seq long, op string, arg string"
    spark.createDataFrame([("q", 1, "add", "a"), ("q", 2, "add", "b")], schema).write.parquet(str(source))
    query = state.stream(spark.readStream.schema(schema).parquet(str(source)), state.queue).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
        spark.createDataFrame([("q", 3, "pop", ""), ("q", 4, "pop", ""), ("q", 5, "pop", "")], schema).write.mode("append").parquet(str(source))
        query.processAllAvailable()
    finally:
        query.stop()
    assert [r.reply for r in spark.read.parquet(str(out)).orderBy("seq").collect()] == ["1", "2", "a", "b", ""]


def test_change_log_stream(spark, versions, tmp_path):
    versions.write.parquet(str(tmp_path / "in"))
    query = state.keep_log(files.replay(spark, str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
        time.sleep(0.1)
    finally:
        query.stop()
    assert pairs(store.live(files.open_tables(spark, str(tmp_path / "log")), NOW)) == pairs(store.live(versions, NOW))


def test_ordered_joins(spark):
    left = spark.createDataFrame([("u", 5, 1), ("u", 1, 2), ("w", 9, 3)], "k string, at long, id long")
    right = spark.createDataFrame([("u", 2, "a"), ("u", 5, "b"), ("u", 8, "c")], "k string, at long, v string")
    got = lambda **o: {r.id: r.v for r in joins.asof(left, right, ["k"], "at", ["v"], **o).collect()}
    assert got() == {1: "b", 2: None, 3: None}
    assert got(strict=True) == {1: "a", 2: None, 3: None}
    assert got(forward=True) == {1: "b", 2: "a", 3: None}
    assert got(forward=True, strict=True) == {1: "c", 2: "a", 3: None}
    rnd = random.Random(1)
    a = [(i, s, s + rnd.randint(0, 60)) for i in range(60) for s in [rnd.randint(-100, 200)]]
    b = [(i, s, s + rnd.randint(0, 9)) for i in range(60) for s in [rnd.randint(-100, 200)]]
    pairs_ = joins.overlaps(spark.createDataFrame(a, "i long, a0 long, a1 long"), spark.createDataFrame(b, "j long, b0 long, b1 long"), ("a0", "a1"), ("b0", "b1"), 13)
    assert sorted((r.i, r.j) for r in pairs_.collect()) == sorted((i, j) for i, x, y in a for j, u, v in b if x <= v and u <= y)
    big = spark.createDataFrame([(1, i) for i in range(90)] + [(2, 0)], "k int, n int")
    for how, n in (("inner", 90), ("left", 91), ("left_semi", 90), ("left_anti", 1)):
        assert joins.salted(big, spark.createDataFrame([(1, "x")], "k int, v string"), "k", 4, how).count() == n


def test_settings(spark):
    assert config.parse("# c\n[s]\na = 1\n b=x=y\n;d=2\na=3\nnothing") == {"a": "3", "b": "x=y"}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    config.apply(spark, {"spark.sql.shuffle.partitions": "5", "spark.other": "1"})
    assert spark.conf.get("spark.sql.shuffle.partitions") == "5"
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_merge_of_tables(spark):
    one = log(spark, [("a", "1", 5, 0, False), ("b", "1", 1, 0, False)])
    two = log(spark, [("a", "2", 5, 0, False), ("b", "2", 2, 0, False), ("c", "2", 1, 0, False)])
    assert pairs(store.merge(one, two)) == {"a": "1", "b": "2", "c": "2"}
    assert pairs(store.merge(two, one))["a"] == "2"
    assert scan.nth(two.select("key", "val"), 1).first().key == "b"


def test_zorder_queries_reach_every_row(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey").toPandas().itertuples(index=False)
    for n in (2, 3, 4, 8, 16):
        bits, want, inside = zorder.BITS[n], {}, set()
        low, high = (5, 60) if n <= 4 else (1, 90)
        lines = list(lines)
        for r in lines:
            x = [(r[0] * (i + 3) + r[1] * (i * i + 1) + r[2]) % (97 + i) for i in range(n)]
            sub = "-".join(map(str, r))
            want[sub] = "".join(str(x[i] >> b & 1) for b in reversed(range(bits)) for i in reversed(range(n)))
            inside |= {sub} if all(low <= v <= high for v in x) else set()
        got = QUERIES[f"mc{n}_encode"](spark, SF).collect()
        assert len(got) == len(lines) and all(r.same for r in got)
        assert {r.sub: r.bits for r in got} == want
        assert {r.sub for r in QUERIES[f"mc{n}_range"](spark, SF).collect()} == inside


def test_whole_digests_are_near_brute_force(spark, tmp_path):
    """2,000 parts a brand, far beyond the centroids kept: sizes and ends are exact, ranks within a twentieth."""
    rng = np.random.default_rng(5)
    rows = [(i, f"Brand#{i % 2}", float(round(900 + 1100 * rng.beta(2, 4), 2)), int(rng.integers(1, 51))) for i in range(4000)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_retailprice double, p_size int").repartition(3).write.parquet(f"{tmp_path}/part.parquet")
    ask = lambda q: QUERIES[q](spark, str(tmp_path)).collect()
    info = {r.p_brand: r for r in ask("td_info")}
    assert all(r.near for r in ask("td_percentiles")) and all(r.near for r in ask("td_trimmed_mean"))
    for brand in ("Brand#0", "Brand#1"):
        own = sorted((r[2], r[3]) for r in rows if r[1] == brand)
        m, w = np.array([x for x, _ in own]), np.array([x for _, x in own])
        assert (info[brand].size, info[brand].min, info[brand].max) == (w.sum(), m[0], m[-1])
        assert abs(info[brand]["mean"] - (m * w).sum() / w.sum()) < 0.001


@pytest.mark.parametrize("shape", ["normal", "skewed", "steps"])
def test_clusters_keep_weight_and_ranks(shape):
    """Many centroids become about as many as asked for, each rank within a step of the arcsine scale."""
    rng = np.random.default_rng(3)
    x = {"normal": rng.normal(size=20_000), "skewed": rng.pareto(1.5, 20_000), "steps": rng.integers(0, 5000, 20_000) / 7}[shape]
    w = rng.integers(1, 9, 20_000)
    mean, weight = sketches.cluster(x, w, 100)
    halves = [sketches.cluster(x[i::4], w[i::4], 100) for i in range(4)]
    merged = sketches.cluster(np.concatenate([m for m, _ in halves]), np.concatenate([v for _, v in halves]), 100)
    order = np.argsort(x)
    upto = np.cumsum(w[order]) / w.sum()
    for m, v in ((mean, weight), merged):
        assert len(m) <= 101 and v.sum() == w.sum() and (np.diff(m) > 0).all()
        assert np.isclose((m * v).sum(), (x * w).sum())
        middle = (np.cumsum(v) - v / 2) / v.sum()
        true = np.interp(m, x[order], upto)
        assert np.abs(true - middle).max() < 0.04
    assert sketches.cluster(np.array([3.0, 1.0, 3.0]), np.array([1, 2, 4]), 16)[1].tolist() == [2, 5]


def test_running_statistics_reach_every_order(spark):
    assert QUERIES["ss_running"](spark, SF).count() == spark.read.parquet(f"{SF}/orders.parquet").count()


def test_every_order_meets_itself_and_its_neighbours(spark):
    spans = [(r.o_orderkey, r.o_custkey * 10, r.o_custkey * 10 + r.o_orderkey % 37) for r in spark.read.parquet(f"{SF}/orders.parquet").collect()]
    want = sorted((k, j) for k, a, b in spans for j, c, e in spans if a <= e and c <= b)
    assert sorted((r.k0, r.k1) for r in QUERIES["join_intervals"](spark, SF).collect()) == want


def test_every_customer_is_asked(spark, tmp_path):
    """2,000 customers, of whom every third has events."""
    spark.createDataFrame([(i, f"Customer#{i:09d}") for i in range(2000)], "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    events = [(j, i, "click") for j, i in enumerate(k for k in range(0, 2000, 3) for _ in range(1 + k % 4))]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    many = {f"customer-{i}": 1 + i % 4 if i % 3 == 0 else 0 for i in range(2000)}
    ask = lambda q: QUERIES[q](spark, str(tmp_path))
    assert {r.item: (r.there, r.missed) for r in ask("bf_exists").collect()} == {i: (n > 0, False) for i, n in many.items()}
    assert ask("bf_errors").first() == (1333, True)
    for q in ("cms_estimate", "cbf_estimate"):
        assert {r.item: r.estimate for r in ask(q).collect()} == many
    for q in ("cms_crowded", "cbf_crowded"):
        assert ask(q).first() == (2000, 0, True)
    for q in ("kv_set", "kv_setex", "kv_delete", "bit_get", "geo_distance"):
        assert ask(q).count() == 2000


def test_stale_words_of_every_document(spark):
    got = {r.sub for r in QUERIES["fts_stale"](spark, SF).select("sub").distinct().collect()}
    assert max(got) >= 100


def test_every_twentieth_vector_asks(spark):
    asked = spark.read.parquet(f"{SF}/embeddings.parquet").filter("vec_id % 20 = 0").count()
    got = QUERIES["vec_nearest_each"](spark, SF)
    assert asked > 1 and got.select("query").distinct().count() == asked and got.count() == 5 * asked


@pytest.mark.parametrize("metric", ["COSINE", "EUCLIDEAN", "MANHATTAN", "CANBERRA", "BIT_HAMMING", "BIT_COSINE", "BIT_DOMINATING"])
def test_blocks_give_what_single_searches_give(spark, monkeypatch, metric):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(7)
    cloud = np.round(rng.normal(size=(60, 6)), 1)
    cloud[10], cloud[20] = cloud[30], 0
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(cloud)], "name long, v array<double>").repartition(3)
    queries = rows.filter("name % 12 = 5 or name = 20").select(F.col("name").alias("query"), F.col("v").alias("q"))
    got = {}
    for r in vectors.nearest_each(rows, queries, metric, 7).collect():
        got.setdefault(r.query, []).append((r.place, r.name, r.distance))
    assert len(got) == 6
    for q, found in got.items():
        want = [(r.name, r.distance) for r in vectors.nearest(rows, cloud[q].tolist(), metric, 7).collect()]
        assert np.allclose([d for *_, d in sorted(found)], [d for _, d in want], atol=1e-9)
        if metric in ("MANHATTAN", "EUCLIDEAN"):
            assert [n for _, n, _ in sorted(found)] == [n for n, _ in want]


def test_recall_of_buckets(spark):
    """One table of eight bits finds few of the neighbours of evenly spread vectors; as many as the query takes find nine tenths."""
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("name"), F.col("embedding").alias("v"))
    asked = rows.filter("name % 20 = 0").select(F.col("name").alias("query"), F.col("v").alias("q"))
    exact = {(r.query, r.name) for r in vectors.nearest_each(rows, asked, "COSINE", 20).collect()}
    found = lambda n: {(r.query, r.name) for r in vectors.nearest_lsh_each(rows, asked, "COSINE", 20, 64, n).collect()}
    recall = lambda n: len(exact & found(n)) / len(exact)
    assert recall(1) < 0.5 and recall(32) >= 0.9


def test_bucketed_search_moves_no_pairs(spark):
    """Met pairs are compared where they meet: what is shuffled is k rows a query; few and many met give what buckets say."""
    rnd = np.random.default_rng(4)
    cloud = rnd.normal(size=(600, 16)).round(3)
    cloud[300:310] = cloud[20]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(cloud)], "name long, v array<double>").repartition(3)
    asked = rows.filter("name % 20 = 0").select(F.col("name").alias("query"), F.col("v").alias("q"))
    for tables in (1, 8):
        found = vectors.nearest_lsh_each(rows, asked, "COSINE", 5, 16, tables)
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
        own = {r.name: r.b for r in rows.select("name", vectors.lsh_bytes(F.col("v"), 16, tables).alias("b")).collect()}
        got: dict = {}
        for r in found.collect():
            got.setdefault(r.query, []).append((r.place, r.name))
        length = np.linalg.norm(cloud, axis=1)
        for q in range(0, 600, 20):
            met = [i for i in own if any((a ^ b).bit_count() <= 1 for a, b in zip(own[q], own[i], strict=True))]
            want = sorted(met, key=lambda i: (round((1 - cloud[q] @ cloud[i] / length[q] / length[i]) / 2, 9), i))[:5]
            assert [n for _, n in sorted(got[q])] == want
    assert [n for _, n in sorted(got[20])] == [20, 300, 301, 302, 303]


def test_exact_search_passes_on_a_block_at_a_time(spark, monkeypatch):
    """What a task holds does not grow with the queries: each block's rows go on before the next is read."""
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 10)
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(60)], "name long, v array<double>").repartition(1)
    found = vectors.nearest_each(rows, rows.select(F.col("name").alias("query"), F.col("v").alias("q")), "EUCLIDEAN", 1)
    assert {(r.query, r.name) for r in found.collect()} == {(i, i) for i in range(60)}
    held = np.zeros((vectors.ROW_BLOCK, 1))
    assert vectors._step("COSINE", held, np.zeros((vectors.QUERY_STEP, 1)), None).nbytes <= 1 << 23


def test_stored_postings_read_the_folders_of_their_words(spark, tmp_path):
    rows = [(f"w{i % 50}", f"s{i % 3}", i) for i in range(600)]
    text.write_postings(spark.createDataFrame(rows, "word string, sort string, sub long"), str(tmp_path / "i"))
    found = text.stored_postings(spark, str(tmp_path / "i"), ["w7", "w8"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "In(word, [w7,w8])" in plan
    assert sorted((r.word, r.sub) for r in found.collect()) == sorted((w, i) for w, _, i in rows if w in ("w7", "w8"))
    old = text.stored_postings(spark, str(tmp_path / "i"), ["w7"])
    text.write_postings(text.remove(old, spark.createDataFrame([(7,), (57,)], "sub long"), 1), str(tmp_path / "i"))
    assert 7 not in [r.sub for r in text.stored_postings(spark, str(tmp_path / "i"), ["w7"]).collect()]
    text.write_postings(spark.createDataFrame([("w7", "s1", 7, 2)], "word string, sort string, sub long, seq long"), str(tmp_path / "i"))
    assert 7 in [r.sub for r in text.stored_postings(spark, str(tmp_path / "i"), ["w7"]).collect()]


def test_postings_are_made_once(spark, tmp_path):
    """No pass over the documents only to sample bounds; a word of all documents goes to several tasks."""
    met = spark.sparkContext.accumulator(0)

    def told(batches):
        for pdf in batches:
            met.add(len(pdf))
            yield pdf

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "256")
    try:
        rows = spark.range(0, 2000, 1, 2).selectExpr("'the' as word", "'s' as sort", "id as sub").mapInPandas(told, "word string, sort string, sub long")
        text.write_postings(rows, str(tmp_path / "i"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert met.value == 2000
    assert len(spark.read.parquet(str(tmp_path / "i")).inputFiles()) == 4
    assert text.stored_postings(spark, str(tmp_path / "i"), ["the"]).count() == 2000


def test_ranges_of_the_curve_hold_the_box():
    rnd = random.Random(1)
    for n in (2, 3, 4, 8):
        for most in (1, 4, 32):
            low = [rnd.randrange(40) for _ in range(n)]
            high = [a + rnd.randrange(12) for a in low]
            found = zorder.ranges(low, high, most)
            assert 1 <= len(found) <= most and all(a <= b for a, b in found)
            for _ in range(60):
                key = zorder.as_hex(zorder.key_of([rnd.randint(a, b) for a, b in zip(low, high, strict=True)]), n)
                assert any(a <= key <= b for a, b in found)
    inside = {zorder.key_of([x, y]) for x in range(5, 61) for y in range(5, 61)}
    held = sum(int(b, 16) - int(a, 16) + 1 for a, b in zorder.ranges([5, 5], [60, 60], 64))
    assert len(inside) <= held < 1.2 * len(inside)
    assert zorder.ranges([3], [2]) == []


def test_files_along_the_curve_grow_in_number(spark, tmp_path, monkeypatch):
    """A larger table takes more files, not larger ones; each holds a range of keys of its own."""
    monkeypatch.setattr(indexes, "Z_ROWS", 100)
    rows = spark.range(3000).select(*[(F.col("id") * (i + 3) % 61).alias(f"x{i}") for i in range(3)], F.col("id").alias("sub"))
    for n, least in ((300, 1), (3000, 20)):
        path = str(tmp_path / f"z{n}")
        indexes.write_z_ordered(rows.filter(F.col("sub") < n), ["x0", "x1", "x2"], path)
        each = spark.read.parquet(path).groupBy(F.input_file_name().alias("file")).agg(F.min("z").alias("a"), F.max("z").alias("b"), F.count(F.lit(1)).alias("n")).orderBy("a").collect()
        assert sum(r.n for r in each) == n and least <= len(each) <= max(8, n // 100)
        assert all(x.b < y.a for x, y in zip(each, each[1:], strict=False))


def test_several_additions_to_one_key(spark):
    log = store.put(spark.createDataFrame([("a", "x")], "key string, val string"), 5)
    more = spark.createDataFrame([("a", "2", 2), ("a", "1", 1), ("b", "z", 1)], "key string, more string, pos int")
    assert {r.key: r.val for r in store.append(log, more, 9).collect()} == {"a": "x12", "b": "z"}


def test_null_items_of_sketches(spark):
    rows = spark.createDataFrame([("k", None), ("k", "a"), ("k", "a")], "g string, item string")
    assert round(sketches.hll_estimate(sketches.hll(rows, F.col("item"), ["g"]), ["g"]).first().estimate) == 2
    ops = spark.createDataFrame([("k", 1, "add", None), ("k", 2, "exists", None)], "key string, seq long, op string, item string")
    assert [r.ok for r in sketches.cuckoo(ops, 16, 16).orderBy("seq").collect()] == [1, 1]
    assert spark.createDataFrame([(None,), (3,)], "x long").select(hashing.mixed(F.col("x")).alias("h")).collect()[0].h is None


def test_loads_of_base64(spark, tmp_path):
    (tmp_path / "a.txt").write_text("k\tU29maWE=\nj\tQm9ubg==\n\tlost\n")
    got = {r.key: r.val for r in files.load_tsv(spark, str(tmp_path / "a.txt"), base64=True).collect()}
    assert got == {"k": "Sofia", "j": "Bonn"}


@pytest.mark.parametrize("by_row", [True, False])
def test_counters_are_exact_where_all_are_shared(spark, by_row):
    rows = spark.range(3000).select(F.concat(F.lit("item-number-"), F.col("id") % 400).alias("item"), F.when(F.col("id") % 6 == 0, -1).otherwise(1).alias("times")).unionByName(spark.createDataFrame([(None, 1), ("", 1)], "item string, times int"))
    asked = spark.range(900).select(F.concat(F.lit("item-number-"), "id").alias("item")).unionByName(spark.createDataFrame([("",)], "item string"))
    want: dict = {"": 2}
    for i in range(3000):
        want[f"item-number-{i % 400}"] = want.get(f"item-number-{i % 400}", 0) + (-1 if i % 6 == 0 else 1)
    for width in (64, 512, 1 << 14):
        got = {r["item"]: r.estimate for r in sketches.counters_exact(rows, F.col("item"), F.col("times"), asked, width, 4, by_row=by_row).collect()}
        assert len(got) == 901 and all(got[i] == max(0, want.get(i, 0)) for i in got)


def test_loads_of_very_many_files(spark):
    """More files than a shift of their rank had room for; the later file is the newer version."""
    n = 20_000
    lines = spark.range(0, n, 1, 3).select(F.concat(F.lit("k"), F.col("id") % 7, F.lit("\tv"), "id").alias("value"), F.format_string("%06d", (F.col("id") * 7919) % n).alias("path"))
    rows = files.tsv_rows(lines)
    assert rows.select("seq").distinct().count() == n
    want: dict = {}
    for i in range(n):
        want[f"k{i % 7}"] = max(want.get(f"k{i % 7}", (-1, "")), (i * 7919 % n, f"v{i}"))
    assert {r.key: r.val for r in rows.groupBy("key").agg(F.max_by("val", "seq").alias("val")).collect()} == {k: v for k, (_, v) in want.items()}


def test_long_queues_reply_in_order():
    rnd = random.Random(3)
    kept, want = None, []
    began = time.perf_counter()
    for i in range(60_000):
        op = "add" if rnd.random() < 0.6 else "pop"
        kept, reply = state.queue(kept, op, str(i))
        if op == "add":
            want.append(str(i))
            assert reply == str(len(want))
        else:
            assert reply == (want.pop(0) if want else "")
    assert time.perf_counter() - began < 20

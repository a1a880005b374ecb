"""SimHash against brute force over all pairs."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from lodeline.llm import simhash as S


def brute_fingerprint(text):
    words, word = [], ""
    for ch in text or "":
        ch = ch.lower() if "A" <= ch <= "Z" else ch
        if ch == " " or "\x09" <= ch <= "\x0d":
            words, word = words + [word] * bool(word), ""
        else:
            word += ch
    words += [word] * bool(word)
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, k=2):
    boss = list(range(len(rows)))

    def find(i):
        while boss[i] != i:
            i = boss[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if ((rows[i][1] ^ rows[j][1]) % (1 << 64)).bit_count() <= k or rows[i][0] == rows[j][0]:
                a, b = find(i), find(j)
                if a != b:
                    boss[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((doc, fp, least[find(i)]) for i, (doc, fp) in enumerate(rows))


def fixture(seed=1):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(1, 6))) for _ in range(80)]
    texts = [None, "", "  \n\t", "One", "one TWO", "é x", "  a", "x" * 5000]
    for _ in range(40):
        base = [rnd.choice(words) for _ in range(rnd.randint(20, 200))]
        texts += [" ".join(base)] * rnd.randint(1, 3)
        for _ in range(3):
            other = list(base)
            other[rnd.randrange(len(other))] = rnd.choice(words)
            texts.append("\n".join(other))
    return list(enumerate(texts, 100))


@pytest.mark.parametrize("cap", [64, 1])
def test_matches_brute_force(spark, cap):
    rows = fixture()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    got = S.near_duplicates(docs, bucket_cap=cap).collect()
    want = brute_components([(i, brute_fingerprint(t)) for i, t in rows])
    assert sorted((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want


@pytest.mark.parametrize("k,m", [(1, 1), (2, 3), (3, 2), (4, 3)])
def test_links_reach_what_all_pairs_reach(spark, k, m):
    rnd = random.Random(k)
    fps = {rnd.getrandbits(64) for _ in range(20)}
    for f in list(fps):
        for _ in range(8):
            g = f
            for b in rnd.sample(range(64), rnd.randint(1, 4)):
                g ^= 1 << b
            fps.add(g)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = {i: c for i, _, c in brute_components([(f, f) for f in signed], k)}
    for cap in (1000, 2):
        got = {r.node: r.component for r in S.components(S.links(spark.createDataFrame([(f,) for f in signed], "fp long"), k, m, cap)).collect()}
        assert {i: got.get(i, i) for i in signed} == want


def test_empty_and_repeated_rows(spark):
    schema = "doc_id long, text string, component_id string, u int"
    assert S.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b c d", "x", 1), (1, "a b c d", "x", 1), (5, "zz yy", None, None), (5, "a b c d", None, None), (9, "zz yy", "", 0)]
    got = sorted((r.doc_id, r.component_id) for r in S.near_duplicates(spark.createDataFrame(rows, schema)).collect())
    assert got == [(1, 1), (1, 1), (5, 1), (5, 1), (9, 1)]
    kept = S.keep_one(spark.createDataFrame(rows, schema))
    assert [r.doc_id for r in kept.collect()] == [1]
    assert kept.columns == ["doc_id", "text", "component_id", "u"]


def test_one_large_group_of_near_copies(spark):
    rnd = random.Random(3)
    base = rnd.getrandbits(62)
    fps = sorted({base ^ sum(1 << b for b in rnd.sample(range(14), rnd.randint(0, 5))) for _ in range(2000)})
    edges = S.links(spark.createDataFrame([(f,) for f in fps], "fp long"), bucket_cap=16)
    assert edges.count() < 65 * len(fps)
    want = {i: c for i, _, c in brute_components([(f, f) for f in fps])}
    got = {r.node: r.component for r in S.components(edges).collect()}
    assert {f: got.get(f, f) for f in fps} == want
    assert edges.filter(F.col("u") >= F.col("v")).isEmpty()


def test_rows_without_an_id_stand_for_themselves_by_text(spark):
    a, b = "one text of some words that stand here alone", "quite another thing is told in this other row"
    rows = [(None, a), (None, b), (None, b), (None, None), (None, None), (3, a), (4, a), (7, "a third text with no copy at all in the table")]
    kept = S.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r) for r in kept.collect()), key=repr) == sorted([(None, a), (None, b), (None, None), (3, a), (7, rows[-1][1])], key=repr)


def test_the_row_of_a_repeated_id_that_stays(spark):
    rows = [(1, "b c d e", "x"), (1, "a b c d", "z"), (1, "a b c d", "y"), (2, "quite another text", "x")]
    for n in (1, 4):
        kept = S.keep_one(spark.createDataFrame(rows, "doc_id long, text string, own string").repartition(n))
        assert sorted(tuple(r) for r in kept.collect()) == [(1, "a b c d", "y"), (2, "quite another text", "x")]


def test_hot_groups_are_joined_apart(spark):
    """A third of the rows are one text, a third near copies: what is joined by broadcast and by shuffle gives all rows."""
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base)) for i in range(1000)] + [(1000 + i, " ".join([*base, f"v{i}"])) for i in range(1000)] + [(2000 + i, f"text {i} stands alone {i}") for i in range(1000)]
    got = S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), bucket_cap=4).collect()
    fps = {i: brute_fingerprint(t) for i, t in rows if i in (0,) or i >= 1000}
    want = brute_components([(i, f) for i, f in fps.items()])
    part = {i: c for i, _, c in want} | {i: 0 for i in range(1000)}
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted(part.items())


def test_shared_folder_is_asked_for_on_a_cluster(spark):
    from types import SimpleNamespace

    from lodeline.llm import common

    conf = SimpleNamespace(get=lambda *a: None)
    with pytest.raises(RuntimeError):
        common.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))
    older, before = common.materialize(spark.range(2), "test"), common.given_paths(spark)
    df = common.materialize(spark.range(3), "test")
    other = common.materialize(spark.range(4), "test")
    common.clean_up(spark, before, df)
    assert df.count() == 3 and older.count() == 2
    with pytest.raises(Exception):
        spark.read.parquet(other._lodeline_path)


def test_rows_that_a_bitmap_clears_do_not_move(spark):
    """Columns named as the helper's, null ids, and a bitmap that clears most rows: the same rows as a plain anti-join."""
    from lodeline.llm import common

    rows = spark.createDataFrame([(i if i % 7 else None, f"t{i}", i) for i in range(5000)], "doc_id long, _hit string, _bits int").repartition(3)
    keys = spark.createDataFrame([(i,) for i in range(0, 5000, 50)], "doc_id long")
    h = F.xxhash64("doc_id")
    p = common.spare(rows)
    told = common.with_hit(rows, common.bitmap_of(keys, h), h, p)
    assert told.columns == ["doc_id", "_hit", "_bits", f"{p}hit"]
    hits = {r.doc_id for r in told.filter(f"{p}hit").collect()}
    assert hits >= {i for i in range(0, 5000, 50) if i % 7} and len(hits) < 300
    crowded = common.bitmap_of(spark.range(0, 200_000).select(F.col("id").alias("doc_id")), h, most=1 << 10)
    assert crowded[1] <= 1 << 17 and common.with_hit(rows, crowded, h, p).filter(f"{p}hit and doc_id is not null").count() > 3000

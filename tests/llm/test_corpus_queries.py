"""The registered queries and the pipeline on a small folder of tables, against brute force."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from test_operators import brute_base, brute_contamination, brute_lines, brute_statistics
from test_simhash import brute_components, brute_fingerprint
from test_sstable import tokenizer

import corpus_pipeline
from lodeline.llm import mixing, pii, quality
from lodeline.llm.queries import ORACLE_SQL, QUERIES
from lodeline.llm import decontaminate


def small_tables():
    rnd = random.Random(77)
    words = ["".join(rnd.choice(["ka", "lo", "mi", "té", "en", "su", "ra"]) for _ in range(rnd.randint(1, 4))) for _ in range(120)]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n)).capitalize() + "."
    items = [(i, say(rnd.choice([6, 15, 25]))) for i in range(8)]
    shared = "A line that many documents hold, of more than forty signs."
    texts = []
    for i in range(90):
        text = "\n".join(say(rnd.randint(4, 20)) for _ in range(rnd.randint(1, 8)))
        if i % 9 == 0:
            text += "\n" + items[i % 8][1]
        if i % 4 == 0:
            text = f"  {shared.upper() if i % 8 else shared}\t\n{text}"
        if i % 6 == 5:
            text = "\n".join([say(3)] + [say(12).upper().replace(" ", "!! ") + " ### $$$" for _ in range(4)])
        if i % 10 == 7:
            text += f" Mail a{i}@b.co or +49 170 12345{i} at 10.0.0.{i}. Released under the MIT License."
        texts.append(text)
    texts += [texts[0], texts[1], texts[1] + " x", texts[2].replace(" ", "  "), None, "", "One."]
    docs = [(i, t, rnd.choice(["en", "de", None]), f"src{rnd.randrange(6)}", None if t is None else len(t)) for i, t in enumerate(texts)]
    labels = [(i, int(i % 6 != 5), 0) for i in range(90) if i % 7]
    return docs, labels, items


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    docs, labels, items = small_tables()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(1, "u", "<nav><a href='/'>x</a></nav><article><p>Text one is here.</p></article>"), (2, None, None)], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    return str(d)


def by_id(spark, folder, name):
    return {r.doc_id: r for r in QUERIES[name](spark, folder).collect()}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    found = con.execute(ORACLE_SQL[name])
    at = [[x[0] for x in found.description].index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=repr)


def test_op1(spark, folder):
    got, t, start = by_id(spark, folder, "op1_token_sstable"), tokenizer(), 0
    for i, text, *_ in small_tables()[0]:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op2(spark, folder):
    got = by_id(spark, folder, "op2_quality_crf")
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for i, r in got.items())
    held = [(got[i].predicted, y) for i, y, _ in small_tables()[1] if got[i].held_out]
    assert len(held) > 5 and np.mean([p == y for p, y in held]) > 0.9


def test_op4(spark, folder):
    got = by_id(spark, folder, "op4_license_scan")
    for i, text, *_ in small_tables()[0]:
        at = (text or "").find("Released under the MIT License")
        assert got[i].matches == (f"MIT-line:{at}:{at + 30}:5:5" if at >= 0 else "")


def test_op5(spark, folder):
    docs = small_tables()[0]
    want = {i: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in brute_lines([(i, t) for i, t, *_ in docs], 40, 5)}
    got = by_id(spark, folder, "op5_line_dedup")
    assert {i: (r.n_lines, r.n_dropped, r.kept_sha256) for i, r in got.items()} == want
    assert sum(gone for _, gone, _ in want.values()) > 10


def test_op6(spark, folder):
    got = by_id(spark, folder, "op6_simhash_near_dedup")
    want = brute_components([(i, brute_fingerprint(t)) for i, t, *_ in small_tables()[0]])
    assert sorted((i, int(r.fingerprint, 16), r.component_id) for i, r in got.items()) == want
    assert all(len(r.fingerprint) == 16 for r in got.values())


def test_op7(spark, folder):
    got = by_id(spark, folder, "op7_quality_rules")
    for i, text, *_ in small_tables()[0]:
        r = got[i]
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == brute_statistics(text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_op8(spark, folder):
    assert {(r.page_id, r.url, r.text, r.n_chars) for r in QUERIES["op8_html_text"](spark, folder).collect()} == {(1, "u", "Text one is here.", 17), (2, None, "", 0)}


def test_op9(spark, folder):
    docs, _, items = small_tables()
    got = by_id(spark, folder, "op9_decontaminate")
    for i, text, *_ in docs:
        n, hit, names = brute_contamination(text, items, 10)
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated) == (n, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0)


def test_op10(spark, folder):
    got = by_id(spark, folder, "op10_pii")
    for i, text, *_ in small_tables()[0]:
        want = brute_base(text)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert got[i].spans.split(",")[: len(want)] == (want or [""])[: len(want)]
        assert [getattr(got[i], f"n_{k}") for k in pii.BASE] == [sum(w.startswith(k) for w in want) for k in pii.BASE]


def test_pipeline_against_brute_force(spark, folder):
    docs, labels, items = small_tables()
    table = {i: (i, t, lang, s, n) for i, t, lang, s, n in docs}
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    kept, now = {}, frame
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, folder)
        assert now.dtypes == frame.dtypes
        kept[name] = sorted(tuple(r) for r in now.collect())
        assert all(table[r[0]] == r for r in kept[name])
    ids = lambda name: [r[0] for r in kept[name]]
    model = quality.train(frame, spark.read.parquet(f"{folder}/labels.parquet"))
    good = sorted(i for i, t, *_ in docs if model.score([(t or "").encode()])[0] >= 0.7)
    assert ids("quality_classifier") == good
    parts = brute_components([(i, brute_fingerprint(table[i][1])) for i in good])
    alone = sorted(i for i, _, c in parts if i == c)
    assert ids("simhash_near_dedup") == alone and len(alone) < len(good)
    clean = [i for i in alone if not brute_contamination(table[i][1], items, 10)[1]]
    assert ids("benchmark_decontamination") == clean and len(clean) < len(alone)
    rest = spark.createDataFrame([table[i] for i in clean], frame.schema)
    copies = {r.doc_id: r.m_copies for r in mixing.mix(rest, prefix="m_").collect()}
    assert ids("source_mixture") == sorted(i for i in clean for _ in range(copies[i]))
    t, start, want = tokenizer(), 0, []
    for i in ids("source_mixture"):
        tokens = t.encode(table[i][1] or "", add_special_tokens=False).ids + [0]
        want.append((i, start, len(tokens), zlib.crc32(np.array(tokens, "<u4").tobytes())))
        start += len(tokens)
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want


def test_op9_searches_items_without_an_id(spark, tmp_path):
    passage, other = "ten words stand here in a row and end it", "these are nine more words of some other passage"
    docs = [(1, f"So {passage} ends."), (2, f"{other}, and {passage}"), (3, "nothing of it"), (4, other)]
    items = [(None, passage), (None, passage.upper()), (7, other), (None, "never seen anywhere"), (None, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    test_against_sql(spark, str(tmp_path), "op9_decontaminate")
    tables = [spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "benchmark")]
    for block in (8 << 20, 1):
        got = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.scan(*tables, block_bytes=block).collect()}
        assert got == {1: (10, [None]), 2: (19, ["7", None]), 3: (0, []), 4: (9, ["7"])}
    assert [r.doc_id for r in decontaminate.clean(*tables).collect()] == [3]

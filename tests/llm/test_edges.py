"""Every operator on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodeline.llm import common, decontaminate, htmltext, licenses, linededup, mixing, pii, quality, rules, simhash, sstable

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, c0 string, fp int, tokens string, domain string, items string, rule string"
LONG = "word " * 40_000 + "\n" * 2_000 + "x" * 100_000 + " 1" * 3_000 + " a@b" + ".c" * 2_000
TEXTS = [None, "", " ", "\n", "\n\n\n", "One.", "One.", LONG, "é" * 50, "\x00\x01", "𝔘𝔫𝔦 <|endoftext|> ×", "a\tb\x0bc\x0cd\re f"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 2 else "en", None if i % 3 else "src1", None, "c", 1, "t", "d", None, "r") for i, t in enumerate(TEXTS)]
    rows += [rows[5], rows[6], (None, "One.", None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(3, 0, 0), (None, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "word word word word word word word word word word word"), (2, None), (3, ""), (4, "one"), (4, "one"), (None, "a")], "item_id long, text string")


def model(docs, labels):
    return quality.train(docs, labels)


OPERATORS = {
    "sstable": lambda d, lab, b: sstable.round_trip(d),
    "quality": lambda d, lab, b: quality.score(d, model(d, lab), ["doc_id", "c0"]),
    "mixing": lambda d, lab, b: mixing.mix(d),
    "licenses": lambda d, lab, b: licenses.scan(d),
    "linededup": lambda d, lab, b: linededup.dedup(d),
    "simhash": lambda d, lab, b: simhash.near_duplicates(d),
    "rules": lambda d, lab, b: rules.judge(d),
    "decontaminate": lambda d, lab, b: decontaminate.scan(d, b),
    "pii": lambda d, lab, b: pii.find(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(docs, labels, benchmark, name):
    out = OPERATORS[name](docs, labels, benchmark)
    got = sorted((r.doc_id is not None, r.doc_id) for r in out.select("doc_id").collect())
    assert got == sorted((r.doc_id is not None, r.doc_id) for r in docs.select("doc_id").collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, docs, labels, benchmark, name):
    assert OPERATORS[name](docs.limit(0), labels.limit(0), benchmark.limit(0)).count() == 0
    assert OPERATORS[name](docs.filter("doc_id < 4"), labels.limit(0), benchmark.limit(0)).count() == 4


@pytest.mark.parametrize("name", ["quality", "simhash", "decontaminate", "mixing"])
def test_filters_keep_columns(docs, labels, benchmark, name):
    f = {"quality": lambda d: quality.keep_good(d, labels, 0.0), "simhash": simhash.keep_one, "decontaminate": lambda d: decontaminate.clean(d, benchmark), "mixing": mixing.take}[name]
    out = f(docs)
    assert out.columns == docs.columns
    assert out.dtypes == docs.dtypes
    assert out.count() > 0
    assert f(docs.limit(0)).count() == 0


def test_without_labels_all_documents_stay(docs, labels):
    for known in (labels.limit(0), labels.filter("quality = 0")):
        assert quality.keep_good(docs, known).count() == docs.count()


def test_pages(spark):
    pages = [(1, "u", None), (1, "u", None), (2, None, ""), (3, "u", "<p>"), (4, "u", "plain & simple"), (5, "u", "<" * 50_000), (6, "u", "<div>" * 3_000 + "deep"), (7, "u", "<article><h1>T</h1><p>A  b&nbsp;&lt;c&#233;<br>d<p>E</article>"), (8, "u", "<script>var a='</p>'"), (None, None, "<!-- <p>x</p> -->")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in htmltext.extract(df).collect()}
    assert got[7] == "T\nA b <cé d\nE"
    assert got[1] == got[2] == got[3] == got[8] == got[None] == ""
    assert htmltext.extract(df.limit(0)).count() == 0
    assert htmltext.extract(df).count() == len(pages)


@pytest.fixture(scope="module")
def tables(docs, labels, benchmark, tmp_path_factory):
    d = tmp_path_factory.mktemp("edges")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", benchmark)):
        df.write.parquet(f"{d}/{name}.parquet")
        df.limit(0).write.parquet(f"{d}/none/{name}.parquet")
    return str(d)


def test_pipeline_on_odd_rows(spark, docs, tables):
    """Nulls in every column, repeated rows, clashing names: each stage keeps the columns, and rows of its input only."""
    now = spark.read.parquet(f"{tables}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {tuple(r) for r in now.collect()}
        now = common.materialize(stage(spark, now, tables), name)
        assert now.dtypes == docs.dtypes
        assert {tuple(r) for r in now.collect()} <= before
    n = now.count()
    assert corpus_pipeline.STAGES[-1][1](spark, now, tables).count() == n
    before = common.given_paths(spark)
    assert corpus_pipeline.run(spark, tables).count() == n
    common.clean_up(spark, before)


def test_pipeline_on_empty_tables(spark, tables):
    assert corpus_pipeline.run(spark, f"{tables}/none").count() == 0
    now = spark.read.parquet(f"{tables}/none/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, now, f"{tables}/none").count() == 0
    assert spark.read.parquet(f"{tables}/documents.parquet").agg(F.max(F.length("text"))).first()[0] > 100_000

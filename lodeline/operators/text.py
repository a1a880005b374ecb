"""Inverted indexes of words and trigrams, AND and OR search, and autocomplete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_QUERY = 32
#: Folders of a stored index, by hash of the word.
BUCKETS = 64


def tokens(words: Column, delimiter: str) -> Column:
    """Sorted distinct non-empty tokens."""
    return F.array_sort(F.array_distinct(F.filter(F.split(words, _literal(delimiter), -1), lambda w: F.length(w) > 0)))


def _literal(text: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|" else c for c in text)


def grams(words: Column, n: int = 3) -> Column:
    """Distinct n-grams of an array of words; a word of n characters or fewer stays whole. Strings give code points,
    binaries bytes."""
    one = lambda w: F.when(F.length(w) <= n, F.array(w)).otherwise(F.transform(F.sequence(F.lit(1), F.length(w) - (n - 1)), lambda i: F.substring(w, i, F.lit(n))))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(words, one))))


def byte_grams(words: Column, n: int = 3) -> Column:
    """n-grams over bytes, as upper-case hex."""
    one = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(w) - (n - 1), F.lit(1))), lambda i: F.hex(F.substring(w.cast("binary"), i, F.lit(n))))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(words, one))))


def hybrid(words: Column, n: int = 3) -> Column:
    """Trigrams and whole words."""
    return F.array_sort(F.array_distinct(F.concat(grams(words, n), words)))


def postings(rows: DataFrame, terms: Column, sort: str, sub: str, only: list[str] | None = None) -> DataFrame:
    """(word, sort, sub), one row for each distinct term of each document; with ``only`` of those words alone, which
    spares a search over unindexed text all other rows."""
    found = F.array_distinct(terms) if only is None else F.array_intersect(terms, F.array(*[F.lit(w) for w in sorted(set(only))]))
    return rows.select(F.explode(found).alias("word"), F.col(sort).alias("sort"), F.col(sub).alias("sub"))


def _bucket(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def write_postings(changes: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Append postings (word, sort, sub) to a stored index; with columns seq and is_tombstone they are later versions.

    Folders by hash of the word, files sorted by word, sort and sub: a search reads the folders of its words and skips
    row groups by statistics. A folder is dealt to several tasks by hash of the document, so a very common word spreads
    over them; terms are made once, as no bounds are sampled, and columns that are the same in all rows are not moved.
    """
    fixed = {"seq": F.lit(0).cast("long"), "is_tombstone": F.lit(False)}
    sides = max(1, int(changes.sparkSession.conf.get("spark.sql.shuffle.partitions")) // buckets)
    moved = changes.select("word", "sort", "sub", *[c for c in fixed if c in changes.columns])
    side = F.pmod(F.xxhash64("sub"), F.lit(sides)).cast("int")
    dealt = moved.repartitionById(buckets * sides, _bucket(F.col("word"), buckets) * sides + side)
    rows = dealt.select("word", "sort", "sub", *[F.col(c) if c in changes.columns else v.alias(c) for c, v in fixed.items()], _bucket(F.col("word"), buckets).alias("bucket"))
    rows.sortWithinPartitions("bucket", "word", "sort", "sub").write.mode("append").partitionBy("bucket").parquet(path)


def stored_postings(spark: SparkSession, path: str, words: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The live postings of ``words`` in a stored index: the newest version of each, without those taken out."""
    words = sorted(set(words))
    found = spark.read.parquet(path).filter(F.col("word").isin(words) & F.col("bucket").isin([_bucket(F.lit(w), buckets) for w in words]))
    newest = found.groupBy("word", "sort", "sub").agg(F.max_by("is_tombstone", "seq").alias("_dead"))
    return newest.filter(~F.col("_dead")).drop("_dead")


def changed_postings(old: DataFrame, new: DataFrame, seq: int) -> DataFrame:
    """What to append to a stored index when documents change from postings ``old`` to ``new``: new words, and the
    stale ones as taken out. Documents that ``new`` does not hold stay as they are; ``remove`` takes them out."""
    gone = stale(old, new).select("word", "sort", "sub", F.lit(True).alias("is_tombstone"))
    come = new.join(old, ["word", "sort", "sub"], "left_anti").select("word", "sort", "sub", F.lit(False).alias("is_tombstone"))
    return gone.unionByName(come).withColumn("seq", F.lit(seq).cast("long"))


def remove(old: DataFrame, subs: DataFrame, seq: int) -> DataFrame:
    """Postings of the documents ``subs`` (sub), as taken out."""
    return old.join(subs.select("sub").distinct(), "sub", "left_semi").select("word", "sort", "sub", F.lit(True).alias("is_tombstone"), F.lit(seq).cast("long").alias("seq"))


def search_word(index: DataFrame, word: str, n: int) -> DataFrame:
    return index.filter(F.col("word") == word).select("sort", "sub").orderBy("sort", "sub").limit(n)


def search_all(index: DataFrame, words: list[str], n: int) -> DataFrame:
    """Documents that hold every word, by sort and sub."""
    words = sorted(set(words))
    hits = index.filter(F.col("word").isin(words)).groupBy("sort", "sub").agg(F.count_distinct("word").alias("n"))
    return hits.filter(F.col("n") == len(words)).select("sort", "sub").orderBy("sort", "sub").limit(n)


def search_any(index: DataFrame, words: list[str], n: int) -> DataFrame:
    """Documents by how many of the words they hold, then sort and sub."""
    hits = index.filter(F.col("word").isin(sorted(set(words)))).groupBy("sort", "sub").agg(F.count_distinct("word").alias("matches"))
    return hits.orderBy(F.desc("matches"), "sort", "sub").limit(n)


def stale(old: DataFrame, new: DataFrame) -> DataFrame:
    """Postings of ``old`` that ``new`` no longer has, of the documents it covers.

    Both are dealt by document once; a document's words are then compared side by side.
    """
    from pyspark.sql.window import Window

    each = old.select("sub", "word", "sort", F.lit(0).alias("_new")).unionByName(new.select("sub", "word", F.lit(None).cast(old.schema["sort"].dataType).alias("sort"), F.lit(1).alias("_new")))
    by_word, by_sub = Window.partitionBy("sub", "word"), Window.partitionBy("sub")
    met = each.repartition("sub").withColumn("_still", F.max("_new").over(by_word)).withColumn("_met", F.max("_new").over(by_sub))
    return met.filter((F.col("_new") == 0) & (F.col("_still") == 0) & (F.col("_met") == 1)).select("sub", "word", "sort")


def prefixes(texts: DataFrame, text: str = "text") -> DataFrame:
    """(prefix, text, score): each text under all its prefixes, the empty one too; score is how often it was added."""
    return scored(texts, text).select(F.explode(F.transform(F.sequence(F.lit(0), F.length("text")), lambda i: F.left(F.col("text"), i))).alias("prefix"), "text", "score")


def scored(texts: DataFrame, text: str = "text") -> DataFrame:
    """(text, score): what autocomplete stores at scale, sorted by text; score is how often each was added."""
    return texts.groupBy(F.col(text).alias("text")).agg(F.count(F.lit(1)).alias("score"))


def write_scored(scored_texts: DataFrame, path: str) -> None:
    """Sorted by text, so that a prefix is a range of texts that files and row groups are skipped by."""
    scored_texts.repartitionByRange("text").sortWithinPartitions("text").write.parquet(path)


def complete_stored(scored_texts: DataFrame, prefix: str, n: int) -> DataFrame:
    """The n best texts of a prefix: no row for each prefix is stored, and none is hot."""
    return scored_texts.filter(F.col("text").startswith(prefix)).orderBy(F.desc("score"), "text").limit(n)


def complete(index: DataFrame, prefix: str, n: int) -> DataFrame:
    return index.filter(F.col("prefix") == prefix).select("text", "score").orderBy(F.desc("score"), "text").limit(n)

"""Mixing sources to target weights down a domain-language-source tree, in DataFrame functions only.

A token budget flows from the root to the leaves. A node's children share its budget by weight; a child takes no more
than its capacity (its tokens times ``max_epochs``), and what it leaves goes to its siblings by weight. As a node never
gets more than its own capacity, shortages pass to siblings first and reach the ancestors' siblings only when a whole
subtree is exhausted. Each leaf then takes floor(budget / tokens) whole epochs and a prefix of the next one, in that
epoch's own seeded order: the documents that start before the budget is reached.

Budgets are shared by windows over the children of a node, so one task meets all sources of one domain and language:
as many rows as there are such sources, however many documents they hold. No task sees a leaf whole: an epoch's order is cut into buckets by hash, bucket totals are summed before the shuffle, and
only the one bucket of each leaf in which the prefix ends is ordered row by row.

Defined cases: null text has no tokens; null domain, language or source is a node of its own, named ""; nodes without a
stated weight weigh 1, those of weight 0 get nothing; documents without tokens are taken if they start before the
prefix ends; repeated rows count as often as they occur; an empty table gives an empty result; the columns added are
named by ``prefix`` and never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeline.llm.common import gather, materialize, spare

#: Hash digits of a bucket: 16 ** 3 buckets for each leaf.
DIGITS = 3
SALTS = 32
#: Leaves up to this number go to every executor; more are joined by salted keys.
BROADCAST_LEAVES = 100_000

#: Production weights by node; a name alone holds wherever that node is, "domain/lang" only there.
WEIGHTS = {"domain0": 3.0, "domain1": 2.0, "domain2": 1.0, "domain3": 1.0, "en": 4.0, "de": 2.0, "fr": 2.0, "es": 1.0, "domain3/en": 2.0}


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def domain_of(source: str) -> Column:
    """A source's domain where documents name none: its trailing number modulo 4."""
    return F.concat(F.lit("domain"), (F.coalesce(F.expr(f"try_cast(regexp_extract({source}, '([0-9]+)$', 1) as bigint)"), F.lit(0)) % 4).cast("string"))


def _weight(weights: dict[str, float], *path: Column) -> Column:
    """The weight of the node at ``path``: the longest stated ending of the path counts, else 1."""
    out = F.lit(1.0)
    stated = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else None
    if stated is None:
        return out
    for k in range(len(path)):
        name = F.concat_ws("/", *path[len(path) - 1 - k :])
        out = F.coalesce(F.try_element_at(stated, name), out)
    return out


def _fill(rows: DataFrame, parent: list[str], node: str, budget: str, capacity: str, weight: str, out: str) -> DataFrame:
    """Share ``budget`` among the nodes of each parent by weight, none above its capacity.

    In order of capacity / weight, level = (budget - capacity before) / (weight from here) rises while nodes are full and
    falls after, so its maximum is the level to which the others are filled.
    """
    ordered = Window.partitionBy(*parent).orderBy(F.col(capacity) / F.col(weight), node)
    before = F.coalesce(F.sum(capacity).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum(weight).over(ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = F.max("_level").over(Window.partitionBy(*parent))
    live = rows.filter(F.col(weight) > 0).withColumn("_level", (F.col(budget) - before) / after)
    return live.withColumn(out, F.least(F.col(capacity), level * F.col(weight))).drop("_level")


def plan(sizes: DataFrame, weights: dict[str, float], ratio: float, max_epochs: int) -> DataFrame:
    """(domain, lang, source, tokens, epochs, rest): what each leaf gives, from rows (domain, lang, source, tokens)."""
    leaf = sizes.groupBy("domain", "lang", "source").agg(F.sum("tokens").alias("tokens"))
    leaf = leaf.withColumn("cap3", F.col("tokens").cast("double") * max_epochs).withColumn("w3", _weight(weights, F.col("domain"), F.col("lang"), F.col("source")))
    usable = leaf.filter("w3 > 0")
    middle = usable.groupBy("domain", "lang").agg(F.sum("cap3").alias("cap2")).withColumn("w2", _weight(weights, F.col("domain"), F.col("lang"))).filter("w2 > 0")
    top = middle.groupBy("domain").agg(F.sum("cap2").alias("cap1")).withColumn("w1", _weight(weights, F.col("domain"))).filter("w1 > 0")
    total = leaf.agg(F.sum(F.col("tokens")).cast("double").alias("all")).select((F.col("all") * ratio).alias("asked"))
    top = top.withColumn("one", F.lit(1)).join(total.withColumn("one", F.lit(1)), "one").drop("one")
    room = F.sum("cap1").over(Window.partitionBy(F.lit(1)))
    top = _fill(top.withColumn("b0", F.least(F.col("asked"), room)), ["b0"], "domain", "b0", "cap1", "w1", "b1")
    middle = _fill(middle.join(top.select("domain", "b1"), "domain"), ["domain"], "lang", "b1", "cap2", "w2", "b2")
    last = _fill(usable.join(middle.select("domain", "lang", "b2"), ["domain", "lang"]), ["domain", "lang"], "source", "b2", "cap3", "w3", "b3")
    given = F.floor(F.col("b3") + 1e-6)
    epochs = F.when(F.col("tokens") > 0, F.floor(given / F.col("tokens"))).otherwise(0).cast("long")
    return last.withColumn("epochs", epochs).select("domain", "lang", "source", "tokens", "epochs", (given - epochs * F.col("tokens")).cast("long").alias("rest"))


def _order(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, 16)


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    ratio: float = 1.0,
    max_epochs: int = 4,
    seed: int = 42,
    domain: Column | None = None,
    tokens: Column | None = None,
    prefix: str | None = None,
) -> DataFrame:
    """``docs`` with {prefix}domain, {prefix}tokens and {prefix}copies: how often the mixture takes each row.

    ratio: the budget as a share of all tokens there are.
    """
    weights = WEIGHTS if weights is None else weights
    p = spare(docs) if prefix is None else prefix
    name = lambda c: F.coalesce(c, F.lit(""))
    keyed = docs.withColumns(
        {
            f"{p}domain": name(domain_of("source") if domain is None else domain),
            f"{p}lang": name(F.col("lang")),
            f"{p}source": name(F.col("source")),
            f"{p}tokens": n_words(F.col("text")) if tokens is None else tokens,
        }
    )
    sizes = materialize(gather(keyed.select(F.col("doc_id"), *[F.col(f"{p}{c}").alias(c) for c in ("domain", "lang", "source", "tokens")])), "sizes")
    leaf = materialize(plan(sizes, weights, ratio, max_epochs), "leaves", 0)
    few = leaf.count() <= BROADCAST_LEAVES
    key = ["domain", "lang", "source"]

    def beside(rows: DataFrame, leaves: DataFrame, names: list[str], left: list[str]) -> DataFrame:
        """rows with the columns of their leaf; hot leaves spread over salts where leaves are too many to send around."""
        right = leaves.select(*[F.col(c).alias(f"{p}_{c}") for c in key], *[F.col(c).alias(f"{p}{c}") for c in names])
        on = [rows[a] == right[f"{p}_{b}"] for a, b in zip(left, key, strict=True)]
        if few:
            return rows.join(F.broadcast(right), on, "left").drop(*[f"{p}_{c}" for c in key])
        salted = rows.withColumn(f"{p}salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        right = right.withColumn(f"{p}_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        on = [salted[a] == right[f"{p}_{b}"] for a, b in zip(left, key, strict=True)] + [salted[f"{p}salt"] == right[f"{p}_salt"]]
        return salted.join(right, on, "left").drop(*[f"{p}_{c}" for c in key], f"{p}salt", f"{p}_salt")

    order = _order(seed, F.col(f"{p}epochs"), F.col("doc_id"))
    small = beside(sizes, leaf, ["epochs", "rest"], key).filter(F.col(f"{p}rest") > 0)
    bucket = small.groupBy(*key, F.substring(order, 1, DIGITS).alias("bucket")).agg(F.sum("tokens").alias("sum"), F.first(f"{p}rest").alias("rest"))
    # Running sums in two levels, so that no task meets more than 16 heads of a leaf, or 256 buckets of a head.
    heads = bucket.groupBy(*key, F.substring("bucket", 1, 1).alias("head")).agg(F.sum("sum").alias("head_sum"))
    rising = Window.partitionBy(*key).orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("head_before", F.coalesce(F.sum("head_sum").over(rising), F.lit(0))).drop("head_sum")
    placed = bucket.withColumn("head", F.substring("bucket", 1, 1)).join(heads, [*key, "head"])
    rising = Window.partitionBy(*key, "head").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    reached = placed.withColumn("before", F.col("head_before") + F.coalesce(F.sum("sum").over(rising), F.lit(0))).filter("before < rest")
    edge = reached.groupBy(*key).agg(F.max("bucket").alias("edge"), F.max("before").alias("before"))
    leaf = materialize(leaf.join(edge, key, "left"), "leaves", 0)

    full = beside(keyed, leaf, ["epochs", "rest", "edge", "before"], [f"{p}{c}" for c in key])
    full = full.withColumn(f"{p}order", order).withColumn(f"{p}bucket", F.substring(f"{p}order", 1, DIGITS))
    at_edge = F.coalesce(F.col(f"{p}bucket") == F.col(f"{p}edge"), F.lit(False))
    whole = full.filter(~at_edge).withColumn(f"{p}more", F.coalesce(F.col(f"{p}bucket") < F.col(f"{p}edge"), F.lit(False)).cast("long"))
    inside = Window.partitionBy(*[f"{p}{c}" for c in key], f"{p}bucket").orderBy(f"{p}order", "doc_id", f"{p}tokens").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col(f"{p}before") + F.coalesce(F.sum(f"{p}tokens").over(inside), F.lit(0))
    cut = full.filter(at_edge).withColumn(f"{p}more", (start < F.col(f"{p}rest")).cast("long"))
    out = whole.unionByName(cut).withColumn(f"{p}copies", F.coalesce(F.col(f"{p}epochs"), F.lit(0)) + F.col(f"{p}more"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], f"{p}domain", f"{p}tokens", f"{p}copies")


def take(docs: DataFrame, **options) -> DataFrame:
    """The mixture: each row of ``docs`` as often as it is taken."""
    p = spare(docs)
    mixed = mix(docs, prefix=p, **options)
    once = mixed.filter(F.col(f"{p}copies") > 0)
    return once.withColumn(f"{p}copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{p}copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_mix_sources(spark, sf_dir: str) -> DataFrame:
    """Whole ``documents``: how often the mixture takes each one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "text")
    return mix(docs, prefix="mix_").select("doc_id", F.col("mix_domain").alias("domain"), "lang", "source", F.col("mix_tokens").alias("n_tokens"), F.col("mix_copies").alias("copies"))


def _sql_weight(*path: str) -> str:
    out = "1.0"
    for k in range(len(path)):
        name = " || '/' || ".join(path[len(path) - 1 - k :])
        cases = " ".join(f"when '{n}' then {w}" for n, w in WEIGHTS.items())
        out = f"coalesce(case {name} {cases} end, {out})"
    return f"cast({out} as double)"


def _sql_fill(rows: str, parent: str, node: str, budget: str, cap: str, w: str, out: str) -> str:
    return f"""select *, least({cap}, max(lvl) over (partition by {parent}) * {w}) {out} from (
      select *, ({budget} - coalesce(sum({cap}) over (partition by {parent} order by {cap} / {w}, {node} rows between unbounded preceding and 1 preceding), 0))
        / sum({w}) over (partition by {parent} order by {cap} / {w}, {node} rows between current row and unbounded following) lvl from {rows} where {w} > 0)"""


ORACLE_SQL = f"""
with d as (
  select doc_id, lang, source, 'domain' || cast(coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) as bigint), 0) % 4 as varchar) as domain_,
         coalesce(lang, '') lang_, coalesce(source, '') source_, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) n_tokens from documents),
leaf as (select domain_, lang_, source_, sum(n_tokens) t, cast(sum(n_tokens) as double) * 4 cap3, {_sql_weight("domain_", "lang_", "source_")} w3 from d group by all),
mid as (select domain_, lang_, sum(cap3) cap2, {_sql_weight("domain_", "lang_")} w2 from leaf where w3 > 0 group by all),
top as (select domain_, sum(cap2) cap1, {_sql_weight("domain_")} w1 from mid where w2 > 0 group by all),
top2 as (select *, 1 root, least(cast((select sum(t) from leaf) as double), sum(cap1) over ()) b0 from top where w1 > 0),
top3 as ({_sql_fill("top2", "root", "domain_", "b0", "cap1", "w1", "b1")}),
mid2 as (select mid.*, b1 from mid join top3 using (domain_)),
mid3 as ({_sql_fill("mid2", "domain_", "lang_", "b1", "cap2", "w2", "b2")}),
leaf2 as (select leaf.*, b2 from leaf join mid3 using (domain_, lang_)),
leaf3 as ({_sql_fill("leaf2", "domain_, lang_", "source_", "b2", "cap3", "w3", "b3")}),
leaf4 as (select *, cast(floor(b3 + 1e-6) as bigint) given, case when t > 0 then cast(floor(floor(b3 + 1e-6) / t) as bigint) else 0 end epochs from leaf3),
o as (select d.*, epochs, given - epochs * t rest, substr(md5('42:' || epochs || ':' || coalesce(cast(doc_id as varchar), '')), 1, 16) h from d left join leaf4 using (domain_, lang_, source_)),
s as (select *, coalesce(sum(n_tokens) over (partition by domain_, lang_, source_ order by h, doc_id, n_tokens rows between unbounded preceding and 1 preceding), 0) start from o)
select doc_id, domain_ as domain, lang, source, cast(n_tokens as bigint) n_tokens, cast(coalesce(epochs, 0) + case when start < rest then 1 else 0 end as bigint) copies from s
"""

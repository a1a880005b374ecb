"""Queries over keyed rows: point reads, scans, aggregates, versions and writes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from lodeline.functions import session
from lodeline.operators import scan, store
from lodeline.plans.base import Registry, table

R = Registry()
#: "Now" of all queries over events, in microseconds: 2024-02-01, after the last of them.
NOW = 1_706_745_600_000_000

# Orders as rows of an already merged table: priority~order number -> whole price


def orders(spark, d):
    return table(spark, d, "orders").select(F.concat("o_orderpriority", F.lit("~"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0")).alias("key"), F.round("o_totalprice").cast("bigint").cast("string").alias("val"))


ORDERS = "o as (select o_orderpriority || '~' || lpad(cast(o_orderkey as varchar), 10, '0') as key, cast(cast(round(o_totalprice) as bigint) as varchar) val from orders)"
LOW = "5-LOW~"
START, END = "2-HIGH~0000000500", "3-MEDIUM~0000000900"

# Events as a change log: user:type -> event id, expiring after 0 to 4 hours times 60, errors deleting


def log(spark, d):
    e = table(spark, d, "events")
    return e.select(
        F.concat(F.col("user_id").cast("string"), F.lit("~"), F.when(F.col("event_type") == "error", F.lit("view")).otherwise(F.col("event_type"))).alias("key"),
        F.col("event_id").cast("string").alias("val"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("created_us"),
        ((F.col("event_id") % 5) * 216_000).alias("expires_s"),
        (F.col("event_type") == "error").alias("is_tombstone"),
        F.col("event_id").alias("seq"),
    )


LOG = f"""e as (select cast(user_id as varchar) || '~' || case when event_type = 'error' then 'view' else event_type end as key, cast(event_id as varchar) val,
  epoch_us(ts) created_us, (event_id % 5) * 216000 expires_s, event_type = 'error' is_tombstone, event_id seq from events),
newest as (select * from e qualify row_number() over (partition by key order by created_us desc, seq desc) = 1),
live as (select * from newest where not is_tombstone and (expires_s = 0 or created_us + expires_s * 1000000 >= {NOW}))"""


def _values(spark, ddl, rows):
    return spark.createDataFrame(rows, ddl)


ASKED = ["1-URGENT~0000000004", "5-LOW~0000000000", "nothing~0", "2-HIGH~0000000002", "5-LOW~0000000000"]
_ASKED_SQL = ", ".join(f"({i}, '{k}')" for i, k in enumerate(ASKED))


def _as_log(rows):
    return rows.select("key", "val", F.lit(0).cast("long").alias("created_us"), F.lit(0).cast("long").alias("expires_s"), F.lit(False).alias("is_tombstone"), F.lit(0).cast("long").alias("seq"))


R.add("kv_get", lambda s, d: store.get(_as_log(orders(s, d)), "5-LOW~0000000000", NOW), f"with {ORDERS} select coalesce(max(val), '') val from o where key = '5-LOW~0000000000'")
R.add("kv_mget", lambda s, d: store.mget(_as_log(orders(s, d)), _values(s, "pos int, key string", list(enumerate(ASKED))), NOW), f"with {ORDERS} select pos, a.key, coalesce(val, '') val from (values {_ASKED_SQL}) a(pos, key) left join o on a.key = o.key")
R.add("kv_exists", lambda s, d: store.exists(_as_log(orders(s, d)), _values(s, "key string", [(k,) for k in dict.fromkeys(ASKED)]), NOW), f"with {ORDERS} select distinct a.key, case when o.key is null then 0 else 1 end as exists from (values {_ASKED_SQL}) a(pos, key) left join o on a.key = o.key")

# Scans

_PAGE = "select key, case when row_number() over (order by key) > {n} then '' else val end val, row_number() over (order by key) > {n} is_tail from (select * from o where {where} order by key limit {m})"


def _scan(name, start, n, prefix=None, end=None):
    where = [f"key >= '{start}'"] + ([f"starts_with(key, '{prefix}')"] if prefix else []) + ([f"key <= '{end}'"] if end else [])
    R.add(f"scan_{name}", lambda s, d: scan.page(orders(s, d), start, n, prefix, end), f"with {ORDERS} " + _PAGE.format(n=n, m=n + 1, where=" and ".join(where)))
    R.add(f"scan_{name}_keys", lambda s, d: scan.page(orders(s, d), start, n, prefix, end, keys_only=True), f"with {ORDERS} " + _PAGE.format(n=n, m=n + 1, where=" and ".join(where)).replace("else val end val", "else '1' end val"))
    after = [w for w in where[1:]] + [f"key > '{start}'"]
    R.add(f"next_{name}", lambda s, d: scan.next_row(orders(s, d), start, prefix, end), f"with {ORDERS} select key, val from o where {' and '.join(after)} order by key limit 1")


_scan("prefix", "5-LOW~0000000200", 25, prefix=LOW)
_scan("range", START, 40, end=END)
_scan("unbounded", "4-", 30)
R.add("scan_glob", lambda s, d: scan.glob(orders(s, d), "[12]-*~000000?[0-4]0*"), f"with {ORDERS} select key, val from o where regexp_matches(key, '^[12]-.*~000000.[0-4]0.*$')")
R.add("scan_next_of_each", lambda s, d: _next_of_each(s, d), f"with {ORDERS} select key, lead(key) over (partition by split_part(key, '~', 1) order by key) next_key from o")


def _next_of_each(s, d):
    from pyspark.sql.window import Window

    rows = orders(s, d)
    # One key space for each prefix, so the order never gathers in one task.
    w = Window.partitionBy(F.substring_index("key", "~", 1)).orderBy("key")
    return rows.select("key", F.lead("key").over(w).alias("next_key"))


R.add("scan_nth", lambda s, d: scan.nth(orders(s, d), 700), f"with {ORDERS} select key, val from o order by key offset 700 limit 1")

# Aggregates over scans

_SQL = {
    "count": "count(*)",
    "sum": "cast(coalesce(sum(cast(val as bigint)), 0) as bigint)",
    "min": "coalesce(min(cast(val as bigint)), 9223372036854775807)",
    "max": "coalesce(max(cast(val as bigint)), -9223372036854775808)",
    "first": "coalesce(arg_min(val, key), '')",
    "last": "coalesce(arg_max(val, key), '')",
    "avg": "cast(sum(cast(val as bigint)) // nullif(count(*), 0) as bigint)",
}
for _name, _sql in _SQL.items():
    R.add(f"acc_{_name}_prefix", lambda s, d, n=_name: scan.accumulate(orders(s, d), n, prefix=LOW), f"with {ORDERS} select {_sql} as {_name} from o where starts_with(key, '{LOW}')")
    R.add(f"acc_{_name}_range", lambda s, d, n=_name: scan.accumulate(orders(s, d), n, start=START, end=END), f"with {ORDERS} select {_sql} as {_name} from o where key between '{START}' and '{END}'")
for _name in ("count", "sum"):
    R.add(f"acc_{_name}_limited", lambda s, d, n=_name: scan.accumulate(orders(s, d), n, prefix=LOW, start="5-LOW~0000000100", number=50), f"with {ORDERS} select {_SQL[_name]} as {_name} from (select * from o where key >= '5-LOW~0000000100' and starts_with(key, '{LOW}') order by key limit 50)")
R.add("acc_by_prefix", lambda s, d: scan.accumulate_by(orders(s, d), F.substring_index("key", "~", 1)), f"with {ORDERS} select split_part(key, '~', 1) as \"group\", " + ", ".join(f"{q} as {n}" for n, q in _SQL.items()) + " from o group by 1")
R.add("acc_empty", lambda s, d: scan.accumulate(orders(s, d), "min", prefix="none~"), f"with {ORDERS} select {_SQL['min']} as min from o where starts_with(key, 'none~')")

#: Keys of the log that are asked for, some of them absent.
ASKED_LOG = ["7~view", "11~click", "none", "3~purchase", "7~view", "999999~view"]

# Versions

R.add("kv_latest", lambda s, d: store.latest(log(s, d)), f"with {LOG} select * from newest")
R.add("kv_live", lambda s, d: store.live(log(s, d), NOW), f"with {LOG} select * from live")
R.add("kv_meta", lambda s, d: store.meta(log(s, d), NOW), f"""with {LOG} select key, case when expires_s > 0 then greatest(0, created_us // 1000000 + expires_s - {NOW // 1_000_000}) else 0 end ttl,
  case when expires_s > 0 then created_us // 1000000 + expires_s else 0 end expiretime, strlen(val) strlen, strlen(key) + strlen(val) + 20 sizeof from live""")
R.add("kv_getrange", lambda s, d: store.getrange(log(s, d), 1, 2, NOW), f"with {LOG} select key, substr(val, 2, 2) part from live")
R.add("kv_dump", lambda s, d: store.dump(log(s, d)).select("key", F.get_json_object("dump", "$.val").alias("val"), F.get_json_object("dump", "$.seq").cast("long").alias("seq")), f"with {LOG} select key, val, seq from newest")
R.add("kv_size", lambda s, d: store.size(log(s, d), NOW), f"with {LOG} select (select count(*) from e) raw, (select count(*) from newest) keys, (select count(*) from live) live")
R.add("kv_compact", lambda s, d: store.compact(log(s, d), NOW).select("key", "val"), f"with {LOG} select key, val from live")

R.add("kv_merge", lambda s, d: store.merge(log(s, d).filter("seq % 3 = 0"), log(s, d).filter("seq % 3 = 1"), log(s, d).filter("seq % 3 = 2")), f"with {LOG} select * from newest")

# Writes: each returns what would be appended

_NEW = f"cast({NOW} as bigint) created_us, cast(0 as bigint) expires_s, false is_tombstone, cast({NOW} as bigint) seq"
_LEFT = f"case when expires_s > 0 then greatest((created_us + expires_s * 1000000 - {NOW}) // 1000000, 1) else 0 end expires_s"


def _requests(s, d, *more):
    """A key of each customer."""
    return table(s, d, "customer").select(F.concat(F.col("c_custkey").cast("string"), F.lit("~view")).alias("key"), F.concat(F.lit("new"), F.col("c_custkey").cast("string")).alias("val"), *more)


REQ = "r as (select cast(c_custkey as varchar) || '~view' as key, 'new' || c_custkey as val from customer)"
R.add("kv_set", lambda s, d: store.put(_requests(s, d), NOW), f"with {REQ} select key, val, {_NEW} from r")
R.add("kv_setex", lambda s, d: store.put(_requests(s, d, F.lit(60).alias("seconds")), NOW), f"with {REQ} select key, val, {_NEW.replace('cast(0 as bigint) expires_s', 'cast(60 as bigint) expires_s')} from r")
R.add("kv_setnx", lambda s, d: store.put_absent(log(s, d), _requests(s, d), NOW), f"with {LOG}, {REQ} select key, val, {_NEW} from r where key not in (select key from live)")
R.add("kv_setxx", lambda s, d: store.put_present(log(s, d), _requests(s, d), NOW), f"with {LOG}, {REQ} select key, val, {_NEW} from r where key in (select key from live)")
R.add("kv_msetnx", lambda s, d: store.put_all_absent(log(s, d), _requests(s, d), NOW), f"with {LOG}, {REQ} select key, val, {_NEW} from r where not exists (select 1 from r join live using (key))")
R.add("kv_msetxx", lambda s, d: store.put_all_present(log(s, d), _requests(s, d), NOW), f"with {LOG}, {REQ} select key, val, {_NEW} from r where not exists (select 1 from r where key not in (select key from live))")
R.add("kv_delete", lambda s, d: store.delete(_requests(s, d).select("key"), NOW), f"with {REQ} select key, '' val, {_NEW.replace('false', 'true')} from r")
R.add("kv_append", lambda s, d: store.append(log(s, d), _requests(s, d).withColumnRenamed("val", "more"), NOW), f"with {LOG}, {REQ} select r.key, coalesce(live.val, '') || r.val as val, {_NEW} from r left join live on r.key = live.key")
R.add("kv_getset", lambda s, d: store.swap(log(s, d), _requests(s, d), NOW), f"with {LOG}, {REQ} select r.key, coalesce(live.val, '') as old, r.val from r left join live on r.key = live.key")
keys = lambda s, d: _requests(s, d).select("key")
R.add("kv_getdel", lambda s, d: store.get_and(log(s, d), keys(s, d), NOW, lambda rows: store.delete(rows, NOW))[0], f"with {LOG}, {REQ} select r.key, coalesce(live.val, '') as val from r left join live on r.key = live.key")
R.add("kv_getdel_writes", lambda s, d: store.get_and(log(s, d), keys(s, d), NOW, lambda rows: store.delete(rows, NOW))[1], f"with {LOG}, {REQ} select r.key, '' val, {_NEW.replace('false', 'true')} from r join live on r.key = live.key")
R.add("kv_getex_writes", lambda s, d: store.get_and(log(s, d), keys(s, d), NOW, lambda rows: store.expire(rows, NOW, 30))[1], f"with {LOG}, {REQ} select r.key, live.val, {_NEW.replace('cast(0 as bigint) expires_s', 'cast(30 as bigint) expires_s')} from r join live on r.key = live.key")
R.add("kv_getpersist_writes", lambda s, d: store.get_and(log(s, d), keys(s, d), NOW, lambda rows: store.persist(rows, NOW))[1], f"with {LOG}, {REQ} select r.key, live.val, {_NEW} from r join live on r.key = live.key")
moves = lambda s, d: _requests(s, d).select(F.col("key").alias("old_key"), F.replace(F.col("key"), F.lit("view"), F.lit("click")).alias("new_key"))
copy_sql = f"select replace(r.key, 'view', 'click') as key, l.val, cast({NOW} as bigint) created_us, {_LEFT}, false is_tombstone, cast({NOW} as bigint) seq from r join live l on r.key = l.key"
free_sql = " where replace(r.key, 'view', 'click') not in (select key from live)"
R.add("kv_copy", lambda s, d: store.copy(log(s, d), moves(s, d), NOW), f"with {LOG}, {REQ} {copy_sql}")
R.add("kv_copynx", lambda s, d: store.copy(log(s, d), moves(s, d), NOW, absent_only=True), f"with {LOG}, {REQ} {copy_sql}{free_sql}")
R.add("kv_rename", lambda s, d: store.copy(log(s, d), moves(s, d), NOW, move=True), f"with {LOG}, {REQ} {copy_sql} union all select r.key, '', {_NEW.replace('false', 'true')} from r join live l on r.key = l.key")
R.add("kv_renamenx", lambda s, d: store.copy(log(s, d), moves(s, d), NOW, move=True, absent_only=True), f"with {LOG}, {REQ} {copy_sql}{free_sql} union all select r.key, '', {_NEW.replace('false', 'true')} from r join live l on r.key = l.key{free_sql}")

_PRE = "starts_with(key, '1')"
_BULK = lambda s, d: store.live(log(s, d), NOW).filter(store.in_prefix("1"))
R.add("kv_delete_prefix", lambda s, d: store.delete(_BULK(s, d), NOW), f"with {LOG} select key, '' val, {_NEW.replace('false', 'true')} from live where {_PRE}")
R.add("kv_expire_prefix", lambda s, d: store.expire(_BULK(s, d), NOW, 99), f"with {LOG} select key, val, {_NEW.replace('cast(0 as bigint) expires_s', 'cast(99 as bigint) expires_s')} from live where {_PRE}")
R.add("kv_expire_at_prefix", lambda s, d: store.expire_at(_BULK(s, d), NOW, NOW // 1_000_000 + 500), f"with {LOG} select key, val, {_NEW.replace('cast(0 as bigint) expires_s', 'cast(500 as bigint) expires_s')} from live where {_PRE}")
R.add("kv_expire_at_past", lambda s, d: store.expire_at(_BULK(s, d), NOW, 5), f"with {LOG} select key, '' val, {_NEW.replace('false', 'true')} from live where {_PRE}")
R.add("kv_persist_prefix", lambda s, d: store.persist(_BULK(s, d), NOW), f"with {LOG} select key, val, {_NEW} from live where {_PRE}")
R.add("kv_delete_range", lambda s, d: store.delete(store.live(log(s, d), NOW).filter(store.in_range("10", "20~view")), NOW), f"with {LOG} select key, '' val, {_NEW.replace('false', 'true')} from live where key between '10' and '20~view'")
R.add("kv_revive", lambda s, d: store.revive(log(s, d), NOW).select("key", "val"), f"with {LOG} select key, val from newest where key not in (select key from live)")
_CAS = "r as (select key, case when seq % 2 = 0 then val else 'x' end as old, 'n' || val as val from live)"
_cas = lambda s, d: store.live(log(s, d), NOW).select("key", F.when(F.col("seq") % 2 == 0, F.col("val")).otherwise("x").alias("old"), F.concat(F.lit("n"), "val").alias("val"))
R.add("kv_cas", lambda s, d: store.compare_and_set(log(s, d), _cas(s, d), NOW), f"with {LOG}, {_CAS} select r.key, r.val, {_NEW} from r join live l on r.key = l.key where l.val = r.old")
R.add("kv_cad", lambda s, d: store.compare_and_delete(log(s, d), _cas(s, d), NOW), f"with {LOG}, {_CAS} select r.key, '' val, {_NEW.replace('false', 'true')} from r join live l on r.key = l.key where l.val = r.old")
R.add("kv_apply", lambda s, d: store.live(reduce(lambda a, b: a.unionByName(b), [log(s, d), store.delete(_BULK(s, d), NOW)]), NOW).select("key", "val"), f"with {LOG} select key, val from live where not {_PRE}")
R.add("kv_hash_fields", lambda s, d: store.fields(log(s, d), "8", NOW), f"with {LOG} select split_part(key, '~', 2) field, val from live where starts_with(key, '8~')")
R.add("session_constants", lambda s, d: session.constants(s, "hello"), f"select {store.MAX_KEY} max_key, {store.MAX_VAL} max_val, '{session.VERSION}' as version, 'string' as type, 'hello' echo")

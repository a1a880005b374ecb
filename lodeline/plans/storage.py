"""Queries over tables on disk: written sorted, looked up, skipped by time, replayed, reloaded, merged."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from lodeline.functions.session import delete_path, fresh_path
from lodeline.operators import scan, store
from lodeline.plans.base import Registry, table
from lodeline.plans.keyvalue import ASKED_LOG, LOG, NOW, log
from lodeline.sources import files
from lodeline.streaming import state

R = Registry()


def _parts(s, d, n: int = 4) -> list[str]:
    """The log as ``n`` tables, each of a stretch of time."""
    at = log(s, d)
    low, high = at.agg(F.min("created_us"), F.max("created_us")).first()
    folder, step = fresh_path(s, "tables"), (high - low) // n + 1
    paths = [f"{folder}/{i}" for i in range(n)]
    for i, path in enumerate(paths):
        store.write_sorted(at.filter(F.col("created_us").between(low + i * step, low + (i + 1) * step - 1)), path, 2, bloom=True)
    return paths


def _whole(s, d):
    path = fresh_path(s, "table")
    store.write_sorted(log(s, d), path, 4, bloom=True)
    return files.open_tables(s, path)


R.add("disk_table", lambda s, d: store.live(_whole(s, d), NOW).select("key", "val"), f"with {LOG} select key, val from live")
R.add("disk_range", lambda s, d: scan.page(store.live(_whole(s, d), NOW), "10", 50, end="30~view"), f"with {LOG}, p as (select key, val, row_number() over (order by key) i from live where key >= '10' and key <= '30~view') select key, case when i > 50 then '' else val end val, i > 50 is_tail from p where i <= 51")
R.add("disk_lookup", lambda s, d: store.mget(_whole(s, d), s.createDataFrame(list(enumerate(ASKED_LOG)), "pos int, key string"), NOW), f"with {LOG} select pos, a.key, coalesce(val, '') val from (values {', '.join(f'({i}, {chr(39)}{k}{chr(39)})' for i, k in enumerate(ASKED_LOG))}) a(pos, key) left join live on a.key = live.key")
R.add("disk_tables", lambda s, d: store.live(files.open_tables(s, *_parts(s, d)), NOW).select("key", "val"), f"with {LOG} select key, val from live")


def _skipped(s, d):
    """The newest key of all, found in the newest table alone, as that is newer than all others."""
    stats = files.table_stats(files.open_tables(s, *_parts(s, d))).collect()  # one row a table
    key = store.latest(log(s, d)).orderBy(F.desc("created_us"), F.desc("seq"), "key").first().key
    val, read = files.get_skipping(s, stats, key)
    return s.createDataFrame([(key, val, read, len(stats))], "key string, val string, n_read int, n_tables int")


R.add("disk_skip", _skipped, f"with {LOG} select key, val, 1 n_read, 4 n_tables from newest order by created_us desc, seq desc, key limit 1")


def _replayed(s, d):
    """Versions that arrive as files, streamed into a log of sorted tables."""
    source, target, checkpoint = (fresh_path(s, t) for t in ("arrived", "kept", "progress"))
    for i in range(3):
        log(s, d).filter(F.col("seq") % 3 == i).write.mode("append").parquet(source)
    state.keep_log(files.replay(s, source), target, checkpoint, once=True).awaitTermination()
    return store.live(files.open_tables(s, target), NOW).select("key", "val")


R.add("disk_replay", _replayed, f"with {LOG} select key, val from live")


def _reloaded(s, d):
    """A folder of tables, one of them taken out and another added between two loads."""
    folder = fresh_path(s, "folder")
    at = log(s, d)
    for i in (0, 1):
        store.write_sorted(at.filter(F.col("seq") % 3 == i), f"{folder}/t{i}", 1)
    _, known, _ = files.reload(s, folder, {})
    delete_path(s, f"{folder}/t0")
    store.write_sorted(at.filter(F.col("seq") % 3 == 2), f"{folder}/t2", 1)
    rows, _, said = files.reload(s, folder, known)
    names = s.createDataFrame(sorted((p.rpartition("/")[2], x) for p, x in said.items()), "name string, became string")
    return names.crossJoin(rows.agg(F.count(F.lit(1)).alias("n")))


R.add("disk_reload", _reloaded, "with n as (select count(*) n from events where event_id % 3 <> 0) select name, became, n from (values ('t0', 'removed'), ('t1', 'kept'), ('t2', 'added')) v(name, became), n")
R.add("disk_preload", lambda s, d: files.preload(store.live(_whole(s, d), NOW).select("key", "val")), f"with {LOG} select key, val from live")


def _merged_by_choice(s, d):
    """Tables of growing size; those that the size-tiered rule picks are merged, and the log says the same after it."""
    folder, at = fresh_path(s, "tiers"), log(s, d)
    for i, share in enumerate((8, 8, 6, 2)):
        low = sum((8, 8, 6, 2)[:i])
        store.write_sorted(at.filter((F.col("seq") % 24 >= low) & (F.col("seq") % 24 < low + share)), f"{folder}/t{i}", 1)
    sizes = [(p, n) for p, (n, _) in files.listing(s, folder).items()]
    chosen = files.pick_for_merge(sizes)
    rest = [p for p, _ in sizes if p not in chosen]
    merged = store.merge(*[files.open_tables(s, p) for p in chosen]) if chosen else None
    every = [files.open_tables(s, p) for p in rest] + ([merged] if merged is not None else [])
    return store.live(reduce(lambda a, b: a.unionByName(b), every), NOW).select("key", "val")


R.add("disk_merge", _merged_by_choice, f"with {LOG} select key, val from live")

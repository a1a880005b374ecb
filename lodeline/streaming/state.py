"""Per-key state over streams: counters, queues, ring buffers, compare-and-set, sessions of the change log.

Each operator is a fold of ordered operations, usable on a stream through ``stream`` and on a batch through ``fold``.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.functions.numeric import I64_MAX, I64_MIN
from lodeline.operators import store

#: (state, operation, argument) -> (state, reply); state is None at first and must be JSON.
Step = Callable[[object, str, str], tuple[object, str]]


def counter(state, op: str, arg: str):
    """incr, decr (saturating), to_max, to_min, incr_limit "n:limit"."""
    now = state or 0
    if op == "incr":
        now = min(I64_MAX, now + int(arg))
    elif op == "decr":
        now = max(I64_MIN, now - int(arg))
    elif op == "to_max":
        now = max(now, int(arg))
    elif op == "to_min":
        now = min(now, int(arg))
    elif op == "incr_limit":
        n, limit = map(int, arg.split(":"))
        if n > 0 and now + n <= limit:
            now += n
    return now, str(now)


def queue(state, op: str, arg: str):
    """add appends and replies with the length, pop replies with the oldest item, "" if there is none.

    The state is where the oldest item stands and the items from there on, with some that are gone before it; it is
    changed in place, and the gone ones are cut off when they are half of it.
    """
    at, items = state or (0, [])
    if op == "add":
        items.append(arg)
        return (at, items), str(len(items) - at)
    if at == len(items):
        return (at, items), ""
    reply, at = items[at], at + 1
    if 2 * at >= len(items) + 16:
        del items[:at]
        at = 0
    return (at, items), reply


def ring(size: int) -> Step:
    def step(state, op: str, arg: str):
        items = list(state or [])
        if op == "add":
            items = [*items, arg][-size:]
            return items, str(len(items))
        return (items[1:], items[0]) if items else ([], "")

    return step


def register(state, op: str, arg: str):
    """set, cas "old:new", cad old, get: replies 1 or 0, or the value."""
    if op == "set":
        return arg, "1"
    if op == "cas":
        old, new = arg.split(":", 1)
        return (new, "1") if old and state == old else (state, "0")
    if op == "cad":
        return ("", "1") if arg and state == arg else (state, "0")
    return state, state or ""


def fold(ops: DataFrame, step: Step) -> DataFrame:
    """Batch: (key, seq, op, arg) -> (key, seq, reply), each key's operations in order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = None, []
        for row in pdf.sort_values("seq").itertuples():
            state, reply = step(state, row.op, row.arg)
            out.append((row.key, row.seq, reply))
        return pd.DataFrame(out, columns=["key", "seq", "reply"])

    return ops.groupBy("key").applyInPandas(run, "key string, seq long, reply string")


def stream(ops: DataFrame, step: Step, ttl_ms: int | None = None) -> DataFrame:
    """Stream: the same replies as operations arrive; with ``ttl_ms`` a key's state ends after that much silence."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        now = json.loads(state.get[0]) if state.exists else None
        frames = list(batches)
        out = []
        if frames:
            for row in pd.concat(frames).sort_values("seq").itertuples():
                now, reply = step(now, row.op, row.arg)
                out.append((row.key, row.seq, reply))
        state.update((json.dumps(now),))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame(out, columns=["key", "seq", "reply"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    return ops.groupBy("key").applyInPandasWithState(run, "key string, seq long, reply string", "state string", "append", timeout)


def keep_log(changes: DataFrame, path: str, checkpoint: str, once: bool = False):
    """Append a stream of versions to a change log, one sorted table a micro-batch; with ``once`` what is there now."""

    def write(batch: DataFrame, _id: int) -> None:
        store.latest(batch).select(*store.COLUMNS).sortWithinPartitions("key").write.mode("append").parquet(path)

    out = changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return out.trigger(availableNow=True).start() if once else out


def windowed_counts(events: DataFrame, delay: str = "1 hour", width: str = "1 day", slide: str | None = None) -> DataFrame:
    """Events a window and type, with a watermark for late ones; with ``slide`` windows overlap. The same plan runs on a
    batch."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", delay).groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def session_counts(events: DataFrame, delay: str = "1 hour", gap: str = "6 hours") -> DataFrame:
    """Events of each user's sessions: runs of events none of which is ``gap`` or more after the one before."""
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))

"""Stateful operators over calls: token bucket, cooldowns with a gap between all calls, counters and the latest calls; batch and stream.

The streams that keep maps and lists of state (`scrape_throttle_stream`, `recent_stream`) need a state store that has them: `with_state_store()` sets Spark's RocksDB provider."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.window import Window


def drain(times: list[float], capacity: float, refill: float, tokens: float, last: float | None) -> tuple[list[bool], float, float | None]:
    """Allowed or not, call by call; a denied call spends nothing, and a bucket never holds more than its capacity."""
    out = []
    for t in times:
        if last is not None:
            tokens = min(capacity, tokens + max(0.0, t - last) * refill)
        last = t
        out.append(tokens >= 1)
        tokens -= out[-1]
    return out, tokens, last


def _fold(calls: DataFrame, key: str, order: str, start: Callable[[], Any], step: Callable[[float, Any], tuple[bool, Any]]) -> DataFrame:
    """(key, order, allowed): step(seconds, state) over each key's calls in order of time. The rows stream past; only one state is held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = object(), None
        for pdf in batches:
            out = []
            for k, micros in zip(pdf[key].tolist(), pdf["_at"].tolist()):
                if k != at:
                    at, state = k, start()
                ok, state = step(micros / 1e6, state)
                out.append(ok)
            yield pdf[[key, order]].assign(allowed=out)

    kinds = dict(calls.dtypes)
    rows = calls.select(key, order, F.unix_micros(F.col("ts").cast("timestamp")).alias("_at"))
    return rows.repartition(key).sortWithinPartitions(key, "_at", order).mapInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, allowed boolean")


def token_bucket(calls: DataFrame, key: str, capacity: float, refill: float, order: str = "event_id") -> DataFrame:
    """(key, order, allowed) of calls (key, ts, order): a bucket of `capacity` calls for each key, refilled by `refill` a second."""

    def step(t: float, state: tuple) -> tuple[bool, tuple]:
        (ok,), tokens, last = drain([t], capacity, refill, *state)
        return ok, (tokens, last)

    return _fold(calls, key, order, lambda: (capacity, None), step)


def token_bucket_stream(calls: DataFrame, key: str, capacity: float, refill: float) -> DataFrame:
    """The same over a stream: (key, allowed, denied) of each trigger; the state is two numbers a key."""

    def run(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (float(capacity), None)
        times = sorted(t for pdf in pdfs for t in (pdf["ts"].astype("int64") / 1e6))
        allowed, tokens, last = drain(times, capacity, refill, tokens, last if last is None or last >= 0 else None)
        state.update((float(tokens), float(last if last is not None else -1)))
        yield pd.DataFrame({key: [k[0]], "allowed": [sum(allowed)], "denied": [len(allowed) - sum(allowed)]})

    kind = dict(calls.dtypes)[key]
    rows = calls.select(key, F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"))
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, allowed long, denied long", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)


def cooldown(calls: DataFrame, key: str, seconds: float, order: str = "event_id") -> DataFrame:
    """(key, order, allowed): a call passes if `seconds` have gone by since the key's last passed one."""

    def step(t: float, last: float | None) -> tuple[bool, float | None]:
        ok = last is None or t >= last + seconds
        return ok, t if ok else last

    return _fold(calls, key, order, lambda: None, step)


MICROS = 1_000_000


class Gate:
    """The decision on calls in order of time: a call of a key that has rows waits for `cooldown` after the key's last accepted call and for `gap` after any accepted one; a key without rows passes.

    Times are whole microseconds.
    """

    def __init__(self, cooldown: float, gap: float, last_any: int | None = None):
        self.cooldown, self.gap, self.last_any = round(cooldown * MICROS), round(gap * MICROS), last_any

    def passes(self, at: int, last_own: int | None, has_rows: bool) -> bool:
        waits = (last_own is not None and at - last_own < self.cooldown) or (self.last_any is not None and at - self.last_any < self.gap)
        if has_rows and waits:
            return False
        self.last_any = at
        return True


def _with_rows(key: str) -> Column:
    """Whether a call's key has rows: not if the key is null or empty."""
    return F.coalesce(F.col("has_rows"), F.lit(False)) & (F.coalesce(F.col(key).cast("string"), F.lit("")) != "")


def _gated(calls: Iterator[tuple[Any, int, bool]], gate: Gate, last: dict) -> Iterator[bool]:
    """Gate over calls (key, at, has rows) in order; `last` holds the keys accepted of late, and both go on to whatever comes next."""
    for n, (k, t, has) in enumerate(calls, 1):
        ok = gate.passes(t, last.get(k), has)
        if ok and k == k and k is not None:  # a key that is null, NaN in pandas' numbers, never waits
            last[k] = t
        if n % 10_000 == 0:
            _forget(gate, last, t)
        yield ok


def _forget(gate: Gate, last: dict, now: int) -> None:
    """What no later call waits for goes."""
    for k in [k for k, s in last.items() if now - s >= gate.cooldown]:
        del last[k]
    if gate.last_any is not None and now - gate.last_any >= gate.gap:
        gate.last_any = None


def scrape_throttle(calls: DataFrame, key: str, cooldown: float = 600, gap: float = 15, order: str = "event_id") -> DataFrame:
    """(key, order, allowed) of calls (key, ts, order, has_rows): Gate over all calls in order of time, then of `order`.

    The gap joins all keys, so the decision is one recursion over the calls. They are sorted into ranges of time, written to the shared checkpoint folder so that every reader sees the same ranges.
    What a range leaves behind, the keys accepted within a cooldown of its end, is first computed as if nothing stood before it; a range whose start turns out otherwise is run again, until none does.
    What is remembered is soon forgotten, so that two or three rounds are usual; as many as there are ranges always suffice. No task holds more than a range, and the driver what stands at their ends.
    """
    from offerloom.sources.ingest import shared_folder

    sc = calls.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(calls.sparkSession))
    kinds = dict(calls.dtypes)
    rows = calls.select(key, order, _with_rows(key).alias("_has"), F.unix_micros(F.col("ts").cast("timestamp")).alias("_at")).where("_at is not null")
    ranges = rows.repartitionByRange("_at", order).sortWithinPartitions("_at", order).withColumn("_range", F.spark_partition_id()).checkpoint(eager=True)

    def gated(pdf: pd.DataFrame, gate: Gate, last: dict) -> list[bool]:
        return list(_gated(zip(pdf[key].tolist(), pdf["_at"].tolist(), pdf["_has"].tolist()), gate, last))

    def begun(starts: dict, number: int) -> tuple[Gate, dict]:
        last_any, last = starts.get(number, (None, ()))
        return Gate(cooldown, gap, last_any), dict(last)

    def ends(starts: dict) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at, gate, last, now = None, None, {}, None
            for pdf in batches:
                if len(pdf):
                    if gate is None:
                        at = int(pdf["_range"].iloc[0])
                        gate, last = begun(starts, at)
                    gated(pdf, gate, last)
                    now = int(pdf["_at"].iloc[-1])
            if gate is not None:
                _forget(gate, last, now)
                yield pd.DataFrame({"range": [at], "state": [pickle.dumps((gate.last_any, sorted(last.items(), key=repr)))]})

        return run

    starts, ended, todo = {}, {}, None
    while todo is None or todo:
        own = ranges if todo is None else ranges.where(F.col("_range").isin(todo))
        ended |= {r["range"]: pickle.loads(r["state"]) for r in own.mapInPandas(ends(starts), "range int, state binary").collect()}
        numbers = sorted(ended)
        now = {n: ended[before] for before, n in zip(numbers, numbers[1:])}
        todo = [n for n in numbers if now.get(n, (None, [])) != starts.get(n, (None, []))]
        starts = now

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gate, last = None, {}
        for pdf in batches:
            if len(pdf):
                if gate is None:
                    gate, last = begun(starts, int(pdf["_range"].iloc[0]))
                yield pdf[[key, order]].assign(allowed=gated(pdf, gate, last))

    return ranges.mapInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, allowed boolean")


def with_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Throttle(StatefulProcessor):
    """Gate with its state in the store: the last accepted call of each key, and of all. A timer forgets keys whose cooldown is over."""

    def __init__(self, key: str, order: str, cooldown: float, gap: float):
        self.key, self.order, self.cooldown, self.gap = key, order, cooldown, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        one = StructType([StructField("at", LongType())])
        self.handle, self.any, self.own = handle, handle.getValueState("any", one), handle.getMapState("own", StructType([StructField("key", StringType())]), one)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        gate = Gate(self.cooldown, self.gap, self.any.get()[0] if self.any.exists() else None)
        for r in sorted(rows, key=lambda r: (r["_at"], r[self.order])):  # the calls of one trigger
            k = ("" if r[self.key] is None else str(r[self.key]),)
            last = self.own.getValue(k)[0] if self.own.containsKey(k) else None
            ok = gate.passes(r["_at"], last, r["_has"])
            if ok:
                self.own.updateValue(k, (r["_at"],))
            yield Row(**{self.key: r[self.key], self.order: r[self.order], "allowed": ok})
        if gate.last_any is not None:
            self.any.update((gate.last_any,))
        self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + round(self.cooldown * 1000) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        for k in [k for k, v in self.own.iterator() if now - v[0] >= round(self.cooldown * MICROS)]:
            self.own.removeKey(k)
        yield from ()

    def close(self) -> None:
        pass


def scrape_throttle_stream(calls: DataFrame, key: str, cooldown: float = 600, gap: float = 15, order: str = "event_id", late: str = "0 seconds") -> DataFrame:
    """scrape_throttle() over a stream, whose calls must come in order of time from trigger to trigger. With a gap all calls share one state; without one each key has its own, on as many tasks as there are."""
    scope = F.lit(0) if gap > 0 else F.col(key)
    rows = calls.withWatermark("ts", late).select(scope.alias("_scope"), key, order, _with_rows(key).alias("_has"), F.unix_micros(F.col("ts").cast("timestamp")).alias("_at"), "ts")
    fields = {f.name: f for f in calls.schema.fields}
    out = StructType([fields[key], fields[order], StructField("allowed", calls.sparkSession.range(1).select(F.lit(True).alias("b")).schema["b"].dataType)])
    return rows.groupBy("_scope").transformWithState(_Throttle(key, order, cooldown, gap), out, "append", "EventTime")


def counters(calls: DataFrame, *by: str) -> DataFrame:
    """Calls, failures and the last call of each group; over a stream, use it in complete or update mode."""
    return calls.groupBy(*by).agg(F.count("*").alias("calls"), F.count_if(F.col("event_type") == "error").alias("failures"), F.max("ts").alias("last_ts"))


#: Statuses that mean that a host throttles or blocks.
THROTTLED = (403, 429, 500, 502, 503, 504)


def call_counters(calls: DataFrame, source: Column) -> DataFrame:
    """(kind, name, n) of calls (host, status, chain, failed): calls by host and by source, throttled or blocked ones by host, failed runs by chain, and the totals of calls, throttles and failures (name null).

    One row feeds all the counts it belongs to, so a single grouped count serves a batch, and a stream in complete or update mode.
    """
    one = lambda kind, name, when: F.when(when, F.struct(F.lit(kind).alias("kind"), name.cast("string").alias("name")))
    host, call, none = F.col("host"), F.col("host").isNotNull(), F.lit(None)
    throttled, failed = F.coalesce(F.col("status").isin(*THROTTLED), F.lit(False)) & call, F.coalesce(F.col("failed"), F.lit(False))
    parts = F.array(one("calls", none, call), one("host", host, call), one("source", source, call), one("throttles", none, throttled), one("throttled_host", host, throttled), one("failures", none, failed), one("failed_chain", F.col("chain"), failed))
    return calls.select(F.explode(F.filter(parts, lambda p: p.isNotNull())).alias("_p")).groupBy("_p.kind", "_p.name").agg(F.count("*").alias("n"))


def recent(calls: DataFrame, n: int = 20) -> DataFrame:
    """The last n calls, newest first."""
    order = [F.desc("ts"), F.desc("event_id")]
    return calls.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


class _Ring(StatefulProcessor):
    """The n latest calls of a shard, newest first."""

    def __init__(self, n: int, kind: StructType):
        self.n, self.kind = n, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", self.kind)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        newest = lambda r: (r["ts"], r["event_id"])
        held = [Row(**dict(zip(self.kind.names, v))) for v in self.kept.get()] if self.kept.exists() else []
        for r in rows:
            held.append(Row(**{c: r[c] for c in self.kind.names}))
            if len(held) > 4 * self.n:
                held = sorted(held, key=newest, reverse=True)[: self.n]
        held = sorted(held, key=newest, reverse=True)[: self.n]
        self.kept.put([tuple(r) for r in held])
        for i, r in enumerate(held):
            yield Row(shard=key[0], place=i + 1, **r.asDict())

    def close(self) -> None:
        pass


def recent_stream(calls: DataFrame, n: int = 20, shards: int = 8) -> DataFrame:
    """(shard, place, ...): the n latest calls (event_id, ts, ...) of each shard, told anew whenever one changes; merged_recent() of the last rows told is recent()."""
    was = dict(calls.dtypes)["ts"]
    calls = calls.withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")))  # whole numbers come back from the store as they went in
    kind = calls.schema
    out = StructType([StructField("shard", LongType()), StructField("place", LongType()), *kind.fields])
    told = calls.withColumn("_shard", F.pmod(F.xxhash64("event_id"), F.lit(shards))).groupBy("_shard").transformWithState(_Ring(n, kind), out, "update", "None")
    return told.withColumn("ts", F.timestamp_micros("ts").cast(was))


def merged_recent(told: DataFrame, n: int = 20) -> DataFrame:
    """recent() from the rows of recent_stream(), at most n of each shard: what was told of a place before has been replaced, as the newest calls of a shard only get newer."""
    rows = told.drop("shard", "place").distinct()
    return recent(rows, n)


def windowed_counts(calls: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Calls of each type and event-time window; rows later than the watermark are left out of a stream."""
    return calls.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("calls"), F.sum("value").alias("value"))

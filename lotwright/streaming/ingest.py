"""Incremental ingestion: paged upserts, rates, absences, retries as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import history, upsert
from . import state


def read_files(spark: SparkSession, path: str, schema: str, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def upsert_stream(stream: DataFrame, state_path: str, checkpoint: str, key: str, order: str, columns: list[str], buckets: int = 64):
    """Keeps the latest row of each key in a BucketState at state_path, a version a batch, and counts of changes beside it.

    A batch reads and writes the buckets of its own keys, so its cost follows its size as long as buckets are more than
    its keys. One that is run again after a failure makes its version again of the same predecessor, so nothing is
    applied twice. Returns the query, which ends when the input is read.
    """
    spark = stream.sparkSession
    kept = state.BucketState(spark, state_path, stream.select(key, *columns).schema, key, buckets)

    def apply(batch: DataFrame, number: int) -> None:
        staged = f"{state_path}-batches/{number}"
        history.latest(batch.select(key, *columns), [key], F.col(order)).write.mode("overwrite").parquet(staged)
        fresh = spark.read.schema(kept.schema).parquet(staged)
        before = kept.write(number, fresh, lambda before, fresh: history.latest(before.unionByName(fresh), [key], F.col(order)))
        met = before.join(fresh.select(key), key, "left_semi")
        upsert.changes(met, fresh, key, columns).groupBy("change").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{state_path}-counts/{number}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling_rates(events: DataFrame, key: str, ts: str, late: str = "10 minutes") -> DataFrame:
    """Events of each key and minute; what comes later than the watermark is not counted."""
    at = events.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late)
    return at.groupBy(F.window("_at", "1 minute"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("minute"), key, "n")


def sliding_rates(events: DataFrame, key: str, ts: str, late: str = "10 minutes") -> DataFrame:
    at = events.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late)
    return at.groupBy(F.window("_at", "60 seconds", "10 seconds"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.end").alias("until"), key, "n")


class _Limiter(StatefulProcessor):
    """For each key the times of the requests that have passed, and the newest time seen."""

    def __init__(self, key: str, ident: str, limit: int, seconds: int, late_seconds: int, idle_seconds: int):
        self.key, self.ident, self.limit, self.us, self.late_us, self.idle_ms = key, ident, limit, seconds * 1_000_000, late_seconds * 1_000_000, idle_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.passed = handle.getListState("passed", "at long")
        self.newest = handle.getValueState("newest", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        log = [x[0] for x in self.passed.get()] if self.passed.exists() else []
        newest = self.newest.get()[0] if self.newest.exists() else None
        batch, told = pd.concat(list(rows)).sort_values(["request_us", self.ident]), []
        for us in batch["request_us"].tolist():
            if newest is not None and us < newest - self.late_us:
                told.append("late")
                continue
            newest = us if newest is None else max(us, newest)
            log = [x for x in log if us - x < self.us]
            told.append("passed" if len(log) < self.limit else "refused")
            if told[-1] == "passed":
                log.append(us)
        if log:
            self.passed.put([(x,) for x in log])
        else:
            self.passed.clear()
        if newest is not None:
            self.newest.update((newest,))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame({self.key: batch[self.key].to_numpy(), self.ident: batch[self.ident].to_numpy(), "answer": told})

    def handleExpiredTimer(self, key, timers, expired) -> Iterator[pd.DataFrame]:
        self.passed.clear()
        self.newest.clear()
        yield pd.DataFrame({self.key: [], self.ident: [], "answer": []})

    def close(self) -> None:
        pass


#: Timers and lists in state need this provider. Without data no batch is to run, or timers would keep a stream going.
LIMITER_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def limited(events: DataFrame, key: str, ident: str, ts: str, limit: int, seconds: int = 60, late_seconds: int = 600, idle_seconds: int = 3600) -> DataFrame:
    """Each request of a stream with the answer of a limiter that counts what it let pass in the seconds before it: passed,
    refused, or late.

    Requests of a key are taken in order of time within a batch. One more than late_seconds older than the key's newest
    is late: it is told so, for the caller to put aside, and counts for nothing. A key's state is limit times at most,
    and goes after idle_seconds without a request; with idle_seconds less than seconds a limit could be evaded.
    A key's requests go through one task, for each depends on those before it. Needs LIMITER_CONF (write_limited sets it).
    """
    if idle_seconds < seconds:
        raise ValueError("a key's state must outlive its window")
    kinds = dict(events.dtypes)
    timed = events.select(key, ident, F.unix_micros(F.col(ts).cast("timestamp")).alias("request_us"))
    step = _Limiter(key, ident, limit, seconds, late_seconds, idle_seconds)
    return timed.groupBy(key).transformWithStateInPandas(step, f"{key} {kinds[key]}, {ident} {kinds[ident]}, answer string", "Append", "ProcessingTime")


def write_limited(answers: DataFrame, path: str, checkpoint: str) -> None:
    """Write a limiter's answers to what its stream holds now as Parquet at path, and return when that is done."""
    conf = answers.sparkSession.conf
    before = {k: conf.get(k, None) for k in LIMITER_CONF}
    for k, v in LIMITER_CONF.items():
        conf.set(k, v)
    try:
        run = answers.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def accepted(events: DataFrame, key: str, ident: str, ts: str, limit: int, seconds: int = 60) -> DataFrame:
    """Each request with whether a limiter lets it pass that counts only what it let pass in the seconds before.

    Whether one passes depends on all before it, so a key's requests go through one stateful task, in order of time
    within a batch; a key's state is at most limit times.
    """

    def step(keys, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        log = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["_us", ident])
        passed = []
        for us in rows["_us"]:
            log = [x for x in log if us - x < seconds * 1_000_000]
            passed.append(len(log) < limit)
            if passed[-1]:
                log.append(int(us))
        state.update((log,))
        yield pd.DataFrame({key: rows[key], ident: rows[ident], "passed": passed})

    kinds = dict(events.dtypes)
    timed = events.select(key, ident, F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"))
    return timed.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {ident} {kinds[ident]}, passed boolean", "log array<long>", "append", "NoTimeout")

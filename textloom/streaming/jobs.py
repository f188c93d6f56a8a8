"""Structured Streaming jobs: usage roll-up, replay suppression, rate limits, latest snapshots.

Event times are ``timestamp`` columns; a watermark bounds every state, and rows later than it are
dropped. Sinks replace whole rows by key, so a batch that is written twice changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

DAY = "1 day"
#: Fixed value: seconds in which an identical submission is taken for a replay.
REPLAY = 30
#: Rows that a processor holds as Python objects, or gives at once.
ROWS_EACH = 50_000


def file_stream(spark: SparkSession, pattern: str, like: DataFrame, files_per_batch: int = 100) -> DataFrame:
    """The Parquet files of ``pattern`` as a stream with the schema of ``like`` (STM10)."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)


def daily_usage(picks: DataFrame, late: str = DAY) -> DataFrame:
    """usage_date, abbr, expanded_chosen, usage_count of picks (ts, abbr, expanded_chosen) (STM15, UPS1)."""
    day = F.window("ts", DAY)
    counted = picks.withWatermark("ts", late).groupBy(day.alias("d"), "abbr", "expanded_chosen").agg(F.count(F.lit(1)).alias("usage_count"))
    return counted.select(F.to_date("d.start").alias("usage_date"), "abbr", "expanded_chosen", "usage_count")


class _Replays(StatefulProcessor):
    """Remembers the time of the last submission that counted, until its term is over."""

    def __init__(self, term: int):
        self.term = term

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.kept.get()[0] if self.kept.exists() else None
        frames = [f[["at", "request_id", "ok"]] for f in rows]
        given = pd.concat(frames).sort_values(["at", "request_id", "ok"], kind="stable")
        passed = np.zeros(len(given), bool)
        for begin in range(0, len(given), ROWS_EACH):
            part = given.iloc[begin : begin + ROWS_EACH]
            for n, (at, ok) in enumerate(zip(part["at"].tolist(), part["ok"].tolist(), strict=True), begin):
                if last is not None and abs(at - last) <= self.term:
                    continue
                passed[n] = True
                if ok:
                    last = at if last is None else max(last, at)
        counted = given["request_id"].to_numpy()[passed]
        for begin in range(0, len(counted), ROWS_EACH):
            part = counted[begin : begin + ROWS_EACH]
            yield pd.DataFrame({"abbr": key[0], "domain": key[1], "request_id": part})
        if last is not None:
            self.kept.update((last,))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((last + self.term) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        return iter(())

    def close(self) -> None:
        pass


def without_replays(submissions: DataFrame, within_seconds: int = REPLAY) -> DataFrame:
    """abbr, domain, request_id of the submissions (ts, abbr, domain, request_id, ok) that count (STM1, STM4).

    An identical (abbr, domain) is a replay for ``within_seconds`` from the last one that counted and
    succeeded; replays don't prolong the term, and failures aren't remembered. A key's rows of one
    micro-batch go by time; a row from before the last one that counted is a replay within the same term.
    State is one number a key, and goes when the watermark passes its term.
    """
    use_rocksdb(submissions.sparkSession)
    rows = submissions.withWatermark("ts", f"{within_seconds} seconds").select("ts", "abbr", "domain", F.unix_micros("ts").alias("at"), "request_id", F.coalesce("ok", F.lit(False)).alias("ok"))
    processor = _Replays(within_seconds * 1_000_000)
    return rows.groupBy("abbr", "domain").transformWithStateInPandas(processor, "abbr string, domain string, request_id long", "append", "eventTime")


def use_rocksdb(spark: SparkSession) -> None:
    """State with timers needs this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def rate_limits(requests: DataFrame, most: int, key: str = "user_id", per: str = "1 minute") -> DataFrame:
    """key, minute, n, over_limit in tumbling windows (STM14)."""
    counted = requests.withWatermark("ts", per).groupBy(F.window("ts", per).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(key, F.col("w.start").alias("minute"), "n", (F.col("n") > most).alias("over_limit"))


def latest_versions(edits: DataFrame, idle: str = "700 milliseconds") -> DataFrame:
    """session_id, the text of the highest version of each burst of edits (STM12)."""
    burst = F.session_window("ts", idle)
    return edits.withWatermark("ts", "10 seconds").groupBy("session_id", burst.alias("w")).agg(F.max_by("text", "version").alias("text"), F.max("version").alias("version")).select("session_id", "version", "text")


class _Breaker(StatefulProcessor):
    """Remembers until when an account is refused."""

    def __init__(self, pause: int):
        self.pause = pause

    def init(self, handle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        until = self.until.get()[0] if self.until.exists() else 0
        columns = ["at", "call_id", "refused", "wait"]
        out = []
        for at, call, refused, wait in sorted(x for f in rows for x in f[columns].itertuples(index=False, name=None)):
            out.append((key[0], call, until > at))
            if refused:
                until = max(until, at + int(wait * 1_000_000))
        if until:
            self.until.update((until,))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(until // 1000 + 1)
        yield pd.DataFrame(out, columns=["account", "call_id", "blocked"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.until.clear()
        return iter(())

    def close(self) -> None:
        pass


def breaker(calls: DataFrame, pause_seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """account, call_id, blocked of a stream of calls (ts, account, call_id, status, retry_after): an earlier refusal is still in force (STM5).

    A call that is refused (status 429) closes its account for ``retry_after`` seconds, or for the
    pause; a shorter refusal doesn't shorten a longer one. An account's calls of one micro-batch go by
    time. State is one number an account, and goes when the watermark passes it.
    """
    use_rocksdb(calls.sparkSession)
    wait = F.coalesce(F.col("retry_after").cast("double"), F.lit(float(pause_seconds)))
    rows = calls.withWatermark("ts", late).select("ts", "account", F.unix_micros("ts").alias("at"), "call_id", (F.col("status") == 429).alias("refused"), wait.alias("wait"))
    return rows.groupBy("account").transformWithStateInPandas(_Breaker(pause_seconds), "account long, call_id long, blocked boolean", "append", "eventTime")


def fresh(rows: DataFrame, revision: int) -> DataFrame:
    """Results made with the current dictionary (STM8, STM9)."""
    return rows.filter(F.col("revision") == revision)


def snapshots(stream: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """Runs ``stream`` over what there is, in update mode, and returns the last row of each key (STM7, SNK8).

    Each micro-batch is written under its number, so a repeated batch overwrites itself; the folder
    also holds the checkpoint from which a stopped run goes on.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/rows/batch={number:09d}")

    query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    spark = stream.sparkSession
    rows = spark.read.option("basePath", f"{folder}/rows").parquet(f"{folder}/rows")
    columns = [c for c in stream.columns if c not in keys]
    return rows.groupBy(keys).agg(F.max_by(F.struct(*columns), "batch").alias("last")).select(*keys, "last.*")


def appended(stream: DataFrame, folder: str) -> DataFrame:
    """Runs ``stream`` over what there is, in append mode, and returns all its rows."""
    query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")

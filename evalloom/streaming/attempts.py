"""Extension: live views of an append-only attempt log. The log is a folder of JSON lines."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from evalloom.operators.snapshots import View, apply_batch


def attempts(spark: SparkSession, path: str, schema: str, at: str = "ts", late: str = "10 minutes", keys: tuple[str, ...] = ("execution_id", "request_key", "attempt_index"), files: int = 1_000) -> DataFrame:
    """New attempts as they are appended, each once: repeats within the watermark are dropped."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))


def live_summary(stream: DataFrame, at: str = "ts", window: str = "5 minutes") -> DataFrame:
    """Per window and execution: attempts, retries, failures and mean latency."""
    return stream.groupBy(F.window(at, window), "execution_id").agg(F.count("*").alias("attempts"), F.count_if(F.col("attempt_index") > 1).alias("retries"), F.count_if(F.col("outcome") == "terminal_error").alias("failures"), F.avg("request_wall_ms").alias("mean_ms")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "execution_id", "attempts", "retries", "failures", "mean_ms")


def to_parquet(df: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append finished windows; once: what there is, then stop."""
    w = df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def drained(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """What the stream has so far, written and read back."""
    to_parquet(stream, path, checkpoint).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def kept_up(stream: DataFrame, path: str, view: View, checkpoint: str, buckets: int = 256) -> StreamingQuery:
    """Merge what there is of a stream into the current view at path, then stop.

    Needs no watermark: late rows find their place by their order, and a batch that is retried changes nothing.
    """

    def merge(batch: DataFrame, _: int) -> None:
        apply_batch(batch, path, view, buckets)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Series(StatefulProcessor):
    """The attempts of a request until one is final, or until none has come for a while."""

    def __init__(self, final: tuple[str, ...], patience_ms: int) -> None:
        self.final, self.patience = final, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "attempts long, first_ms long, last_ms long")

    def closed(self, key: tuple, outcome: str) -> Row:
        attempts, first, last = self.open.get()
        self.open.clear()
        self.unset()
        return Row(execution_id=key[0], request_key=key[1], outcome=outcome, attempts=attempts, first_ms=first, last_ms=last)

    def unset(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        """Rows of a batch come in no order; the earliest final one names the outcome."""
        attempts, first, last = self.open.get() if self.open.exists() else (0, None, None)
        ends = []
        for r in rows:
            attempts += 1
            first, last = min(r.at_ms, first if first is not None else r.at_ms), max(r.at_ms, last if last is not None else r.at_ms)
            if r.outcome in self.final:
                ends.append((r.at_ms, r.outcome))
        self.open.update((attempts, first, last))
        if ends:
            yield self.closed(key, min(ends)[1])
        else:
            self.unset()
            self.handle.registerTimer(last + self.patience)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.open.exists():
            yield self.closed(key, "abandoned")

    def close(self) -> None:
        pass


SERIES = "execution_id long, request_key long, outcome string, attempts long, first_ms long, last_ms long"


def request_series(stream: DataFrame, at: str = "ts", final: tuple[str, ...] = ("success", "terminal_error"), patience: timedelta = timedelta(minutes=30)) -> DataFrame:
    """A row for each request once it has an outcome, or "abandoned" once the watermark is beyond its patience.

    The state of a request is three numbers, however many attempts it has, and is dropped with its row; attempts
    that come after that begin a series of their own. stream needs a watermark on `at` and columns execution_id,
    request_key and outcome; rows without `at` or a key are left out. Keeps its state in RocksDB.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = stream.select(at, F.col("execution_id").cast("long").alias("execution_id"), F.col("request_key").cast("long").alias("request_key"), "outcome", F.unix_millis(at).alias("at_ms"))
    rows = rows.dropna(subset=[at, "execution_id", "request_key"])
    return rows.groupBy("execution_id", "request_key").transformWithState(Series(final, patience // timedelta(milliseconds=1)), SERIES, "append", "EventTime")

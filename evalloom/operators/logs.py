"""Current views over append-only logs: what an upserting store would hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalloom.operators.ranks import numbered


def latest(log: DataFrame, keys: list[str], order: list[Column], ok: Column | None = None) -> DataFrame:
    """The last good row of each key. order names what is later (ascending) and must be total."""
    good = log if ok is None else log.filter(ok)
    last = F.row_number().over(W.partitionBy(*keys).orderBy(*[o.desc() for o in order]))
    return good.withColumn("_n", last).filter("_n = 1").drop("_n")


def current_view(log: DataFrame, keys: list[str], order: list[str], plain: list[str], sticky: list[str], created: str | None = None) -> DataFrame:
    """Per key: plain columns from the last row, sticky ones from the last row that has them, created from the first.

    One aggregate, so one shuffle, whatever the number of columns.
    """
    at = F.struct(*order)
    aggs = [F.max_by(F.struct(*plain), at).alias("_row")] + [F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in sticky]
    if created:
        aggs.append(F.min_by(created, at).alias(created))
    return log.groupBy(*keys).agg(*aggs).select(*keys, "_row.*", *sticky, *([created] if created else []))


def patched(attempts: DataFrame, patches: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Attempts with later measurements from a log of patches, where there are any."""
    late = patches.groupBy(*keys).agg(*[F.max(c).alias(f"_{c}") for c in columns])
    joined = attempts.join(late, keys, "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in attempts.columns])


def identity_conflicts(runs: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """Keys that were registered with more than one fingerprint."""
    return runs.groupBy(key).agg(F.countDistinct(fingerprint).alias("fingerprints")).filter("fingerprints > 1")


def lifecycle(events: DataFrame, key: str, kind: str, at: str) -> DataFrame:
    """Start and finish events of a key as one row, with its status."""
    start, end = F.min(F.when(F.col(kind) == "start", F.col(at))), F.max(F.when(F.col(kind) == "finish", F.col(at)))
    return events.groupBy(key).agg(start.alias("started_at"), end.alias("ended_at")).withColumn("status", F.when(F.col("ended_at").isNotNull(), "finished").when(F.col("started_at").isNotNull(), "running").otherwise("unknown"))


def run_status(expected: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """complete, partial or pending: successes held against what is expected."""
    done = results.groupBy(key).agg(F.count_if(F.col("status") == "ok").alias("ok"))
    ok = F.coalesce("ok", F.lit(0))
    return expected.join(done, key, "left").select(key, "expected", ok.alias("ok"), F.when(ok >= F.col("expected"), "complete").when(ok > 0, "partial").otherwise("pending").alias("status"))


def numbered_attempts(log: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """attempt: a row's place among those of its key, whatever share of the log that has."""
    return numbered(log, order, keys, "attempt")


def migrated(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Rows of an older version: lacking columns come as nulls of their type; aggregate timings are marked so."""
    old = "timing_source" not in rows.columns
    out = rows.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in rows.columns})
    if "total_duration_ms" in out.columns and "latency_ms" in out.columns:
        out = out.withColumn("total_duration_ms", F.coalesce("total_duration_ms", "latency_ms"))
    return out.withColumn("timing_source", F.lit("legacy_aggregate")) if old else out

"""Current views that are kept up by batches: a batch rewrites the buckets it touches and reads no others.

What is stored per key is a state that can be merged in any order and more than once (each part carries the order
of the row it came from), so repeated, late and retried batches give the rows of a full fold over the log.

A folder holds rows/version=N/bucket=B (states, Parquet) and versions/version=N (which version holds each bucket).
The second is one file, written last: a batch that was broken off leaves nothing that a reader sees, and of two
writers of one version the second fails. Old versions stay readable until their folders are removed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.operators.relations import CheckFailed
from evalloom.sources.files import exists


@dataclass(frozen=True)
class View:
    """Per key: plain columns from the last row, sticky ones from the last row that has them, created from the first.

    order says what is later and must be total; rows whose order is null count as the earliest. A null key is a key.
    """

    keys: tuple[str, ...]
    order: tuple[str, ...]
    plain: tuple[str, ...]
    sticky: tuple[str, ...] = ()
    created: str | None = None

    def states(self, log: DataFrame) -> DataFrame:
        at = F.struct(*self.order)
        part = lambda c: F.struct(at.alias("at"), F.col(c).alias("value"))
        row = F.struct(at.alias("at"), F.struct(*self.plain).alias("value"))
        aggs = [F.max_by(row, at).alias("_row")] + [F.max_by(F.when(F.col(c).isNotNull(), part(c)), F.when(F.col(c).isNotNull(), at)).alias(f"_sticky_{c}") for c in self.sticky]
        if self.created:
            aggs.append(F.min_by(part(self.created), at).alias("_created"))
        return log.groupBy(*self.keys).agg(*aggs)

    def merged(self, states: DataFrame) -> DataFrame:
        """States of one key as one. bucket stays, and keys lie within it, so this needs no shuffle of its own."""
        aggs = [F.max_by("_row", "_row.at").alias("_row")] + [F.max_by(f"_sticky_{c}", f"_sticky_{c}.at").alias(f"_sticky_{c}") for c in self.sticky]
        if self.created:
            aggs.append(F.min_by("_created", "_created.at").alias("_created"))
        return states.groupBy("bucket", *self.keys).agg(*aggs)

    def rows(self, states: DataFrame) -> DataFrame:
        out = [*self.keys, "_row.value.*", *[F.col(f"_sticky_{c}.value").alias(c) for c in self.sticky]]
        return states.select(*out, *([F.col("_created.value").alias(self.created)] if self.created else []))


def held(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict[int, int]]:
    """(version, bucket -> version that holds it) of the newest version or of a given one; (0, {}) where there is none.

    A list as long as there are buckets, whatever the number of rows.
    """
    if not exists(spark, f"{path}/versions"):
        return 0, {}
    seen = spark.read.schema("bucket int, held long, version long").parquet(f"{path}/versions")
    newest = seen.agg(F.max("version")).head()[0] if version is None else version
    rows = seen.filter(F.col("version") == newest).collect() if newest else []
    if version is not None and not rows:
        raise CheckFailed(f"{path} has no version {version}")
    return newest or 0, {r.bucket: r.held for r in rows}


def folders(path: str, parts: dict[int, int]) -> list[str]:
    return [f"{path}/rows/version={v}/bucket={b}" for b, v in sorted(parts.items())]


def apply_batch(batch: DataFrame, path: str, view: View, buckets: int = 256) -> int:
    """Merge a batch of the log into the view at path; the version that holds it now.

    buckets counts when the view is begun and stays: choose it so that one bucket's states fit a task well. An
    empty batch makes no version, but for the first.
    """
    spark = batch.sparkSession
    version, parts = held(spark, path)
    size = buckets if not parts else max(parts) + 1
    delta = view.states(batch).withColumn("bucket", F.pmod(F.xxhash64(*view.keys), F.lit(size)).cast("int")).persist()
    try:
        touched = [r.bucket for r in delta.select("bucket").distinct().collect()]
        if not touched and parts:
            return version
        there = {b: parts[b] for b in touched if parts.get(b)}
        states = delta
        if there:
            plain = delta.drop("bucket")
            old = spark.read.schema(plain.schema).parquet(*folders(path, there))
            states = delta.unionByName(old.withColumn("bucket", F.pmod(F.xxhash64(*view.keys), F.lit(size)).cast("int")))
        new = view.merged(states.repartition("bucket"))
        # A folder of this version without its list is left from a write that was broken off: nobody reads it.
        new.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/version={version + 1}")
    finally:
        delta.unpersist()
    now = {b: 0 for b in range(size)} | parts | dict.fromkeys(touched, version + 1)
    spark.createDataFrame(sorted(now.items()), "bucket int, held long").coalesce(1).write.mode("errorifexists").parquet(f"{path}/versions/version={version + 1}")
    return version + 1


def current(spark: SparkSession, path: str, view: View, like: DataFrame, version: int | None = None) -> DataFrame:
    """The view's rows, of the newest version or of a given one. like: any frame with the log's columns, for the types."""
    _, parts = held(spark, path, version)
    schema = view.states(like.limit(0)).schema
    full = {b: v for b, v in parts.items() if v}
    return view.rows(spark.read.schema(schema).parquet(*folders(path, full)) if full else spark.createDataFrame([], schema))

"""Joins, set operations, grids and integrity checks over tables of any schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class CheckFailed(ValueError):
    """A check found rows it must not find."""


#: Rows of a few values that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """df, of a few values a row, to be broadcast if its rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


#: Rows that one task joins by a key and groups by it, about: it sorts both sides and holds the groups twice, some 0.5 kB a row.
PART_ROWS = 500_000


def in_parts(tables: list[DataFrame], keys: list[str], rows: int) -> list[DataFrame]:
    """The tables, of so many rows together, dealt by keys to as many tasks as that takes, a core each at least.

    Left to itself Spark puts partitions together by their bytes as they are sent, which are a twentieth of what such
    a task then holds.
    """
    n = max(tables[0].sparkSession.sparkContext.defaultParallelism, -(-rows // PART_ROWS))
    return [t.repartition(n, *keys) for t in tables]


def require_columns(df: DataFrame, needed: set[str]) -> DataFrame:
    if missing := sorted(needed - set(df.columns)):
        raise CheckFailed(f"missing columns: {', '.join(missing)}")
    return df


def run_checks(checks: dict[str, DataFrame], show: int = 3) -> None:
    """Each DataFrame holds violations; any row fails, with a few shown. Nothing else leaves the cluster."""
    bad = {name: rows for name, df in checks.items() if (rows := df.limit(show).collect())}
    if bad:
        raise CheckFailed("; ".join(f"{k}: {[r.asDict() for r in v]}" for k, v in bad.items()))


def missing_from(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of left without a partner; null keys have none."""
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def present_in(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys).distinct(), keys, "left_semi")


def mandatory(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The inner join, and the rows of left that it would lose."""
    return left.join(right, keys), missing_from(left, right, keys)


def symmetric_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): keys on one side only."""
    return missing_from(a.select(key).distinct(), b, [key]).withColumn("side", F.lit("missing")).union(missing_from(b.select(key).distinct(), a, [key]).withColumn("side", F.lit("extra")))


def common(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def stale(judged: DataFrame, made: DataFrame, keys: list[str], judged_hash: str, made_hash: str) -> DataFrame:
    """Judged rows whose source is gone or has another hash; a hash missing on either side is another."""
    known = made.select(*keys, F.col(made_hash).alias("_made"))
    return judged.join(known, keys, "left").filter(F.coalesce(F.col(judged_hash) != F.col("_made"), F.lit(True))).drop("_made")


def pending(tasks: DataFrame, done: DataFrame, keys: list[str], equal: dict[str, str] | None = None, ok: Column | None = None) -> DataFrame:
    """Tasks without a finished row under the keys; equal maps a task's column to the one it must match."""
    equal = equal or {}
    fits = done.filter(F.lit(True) if ok is None else ok).select(*keys, *[F.col(v).alias(f"_{k}") for k, v in equal.items()])
    on = [tasks[k] == fits[k] for k in keys] + [tasks[k] == fits[f"_{k}"] for k in equal]
    return tasks.join(fits, reduce(lambda a, b: a & b, on), "left_anti")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().filter("count > 1")


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key, in an order that must be total."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def stacked(*parts: DataFrame) -> DataFrame:
    """All rows; columns that a part lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def crossings(df: DataFrame, family: str, split: str) -> DataFrame:
    """Families that lie in more than one split."""
    return df.groupBy(family).agg(F.countDistinct(split).alias("splits")).filter("splits > 1")


def differing(reference: DataFrame, others: DataFrame, run: str, fields: list[str]) -> DataFrame:
    """(run, field): where a run's contract isn't the reference's. reference: one row; nulls equal nulls."""
    def long(df: DataFrame, *more: str) -> DataFrame:
        return df.select(*more, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")).select(*more, "x.*")

    want = long(reference).withColumnRenamed("value", "_want")
    return long(others, run).join(F.broadcast(want), "field").filter(~F.col("value").eqNullSafe(F.col("_want"))).select(run, "field")


def task_grid(cases: DataFrame, tasks: list[str], samples: int) -> DataFrame:
    """Each case times task times sample index."""
    return cases.select("*", F.explode(F.array(*[F.lit(t) for t in tasks])).alias("task_type")).select("*", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample_idx"))


def design_grid(spark: SparkSession, labels: list[str], groups: list[str], cells: int, development: int, prefix: str, seed: int) -> DataFrame:
    """Labels times groups times cells, numbered; each label's development quota rotates over the groups."""
    n = len(groups)
    rows = spark.range(len(labels) * n * cells).select((F.col("id") + 1).alias("number"), F.floor(F.col("id") / (n * cells)).cast("int").alias("_label"), (F.floor(F.col("id") / cells) % n).cast("int").alias("_group"), (F.col("id") % cells).cast("int").alias("_cell"))
    quota = F.lit(development // n) + ((F.col("_group") - F.col("_label") + n * len(labels)) % n < development % n).cast("int")
    digits = F.col("number").cast("string")
    case = F.concat(F.lit(f"{prefix}-"), F.lpad(digits, F.greatest(F.length(digits), F.lit(3)), F.lit("0")))
    pick = lambda xs, i: F.get(F.array(*[F.lit(x) for x in xs]), F.col(i))
    return rows.select(case.alias("case_id"), case.alias("family_id"), F.when(F.col("_cell") < quota, "development").otherwise("train").alias("split"), pick(labels, "_label").alias("intended_label"), pick(groups, "_group").alias("presentation_group"), (F.col("number") + seed).alias("seed"))


def selected_cases(cases: DataFrame, datasets: list[str] | None, limit: int | None, known: set[str], ordinal: str = "ordinal") -> DataFrame:
    """Cases of the named datasets, the first limit in file order; an unknown name or no case is an error."""
    if datasets and (unknown := sorted(set(datasets) - known)):
        raise CheckFailed(f"unknown datasets: {', '.join(unknown)}")
    out = cases.filter(F.col("dataset").isin(datasets)) if datasets else cases
    out = out.orderBy(ordinal).limit(limit) if limit is not None else out
    if out.isEmpty():
        raise CheckFailed("no case is left")
    return out

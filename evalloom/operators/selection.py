"""Balanced and deterministic selection of cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalloom.operators.ranks import numbered
from evalloom.operators.relations import small


def round_robin(df: DataFrame, group: str, score: str, key: str, pools: list[str] | None = None) -> DataFrame:
    """turn: a row's place when the groups of a pool take turns, each with its best row left.

    Within a turn the groups go by the score of that row, then by name. A pool, or a group, of any size is many tasks.
    """
    pools = pools or []
    cycles = numbered(df, [F.desc(score), F.asc(key)], [*pools, group], "_cycle")
    return numbered(cycles, ["_cycle", F.desc(score), F.asc(group)], pools, "turn").drop("_cycle")


def diverse_take(df: DataFrame, n: int, group: str, score: str, key: str) -> DataFrame:
    """The first n turns over one pool, without sorting it whole: a group gives n rows at most."""
    best = W.partitionBy(group).orderBy(F.desc(score), F.asc(key))
    return df.withColumn("_cycle", F.row_number().over(best)).filter(F.col("_cycle") <= n).orderBy("_cycle", F.desc(score), F.asc(group)).limit(n).drop("_cycle")


def quota_take(df: DataFrame, quotas: DataFrame, pools: list[str], group: str, score: str, key: str) -> DataFrame:
    """Of each pool as many turns as its quota (pools..., quota) says; of a group no more rows than that are ordered."""
    first = numbered(df.join(small(quotas), pools), [F.desc(score), F.asc(key)], [*pools, group], "_cycle").filter(F.col("_cycle") <= F.col("quota"))
    return numbered(first, ["_cycle", F.desc(score), F.asc(group)], pools, "turn").drop("_cycle").filter(F.col("turn") <= F.col("quota"))


def short_pools(taken: DataFrame, quotas: DataFrame, pools: list[str]) -> DataFrame:
    """Pools that hold fewer rows than their quota."""
    have = taken.groupBy(*pools).agg(F.count("*").alias("have"))
    return quotas.join(have, pools, "left").filter(F.coalesce("have", F.lit(0)) < F.col("quota"))


def hashed_order(df: DataFrame, seed: str, key: str, prefix: str) -> DataFrame:
    """Rows numbered by the hash of seed and key: an order that looks random and never changes.

    Rows are ordered within the 65,536 ranges of the hash's first digits, and each range starts after the rows of those before it.
    """
    rows = df.withColumn("_mark", F.sha2(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")), 256)).withColumn("_at", F.substring("_mark", 1, 4))
    counts = rows.groupBy("_at").agg(F.count("*").alias("_n"))
    before = counts.select("_at", (F.sum("_n").over(W.orderBy("_at").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    within = F.row_number().over(W.partitionBy("_at").orderBy("_mark"))
    out = rows.join(F.broadcast(before), "_at").withColumn("number", F.col("_before") + within)  # 65,536 rows at most
    return out.drop("_at", "_mark", "_before").withColumn("numbered_id", number_text(prefix, F.col("number")))


def number_text(prefix: str, number: Column, width: int = 3) -> Column:
    """prefix-007: padded to `width` digits, and never cut to it."""
    digits = number.cast("string")
    return F.concat(F.lit(f"{prefix}-"), F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0")))

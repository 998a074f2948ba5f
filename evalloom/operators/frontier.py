"""Comparing runs: Pareto frontiers and the rows that stand on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalloom.operators.ranks import ranges


def pareto(df: DataFrame, x: str, y: str, key: str) -> DataFrame:
    """Rows that beat the y of every row of no greater x; of rows equal in both the one of smallest key. Null and NaN are no value.

    Each task keeps the frontier of what it reads, which holds all of the whole frontier that is in it. What is left is
    merged in sorted ranges: a row stands if it beats those before it in its range and the best of all ranges before.
    """
    local = df.withColumns({"_x": F.col(x).cast("double"), "_y": F.col(y).cast("double")}).filter("_x IS NOT NULL AND _y IS NOT NULL AND NOT isnan(_x) AND NOT isnan(_y)")
    order = [("_x", "ascending"), ("_y", "descending"), (key, "ascending")]

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        front = None
        for b in batches:
            both = pa.Table.from_batches([b] if front is None else [front, b]).combine_chunks()
            both = both.take(pc.sort_indices(both, sort_keys=order))
            y = both.column("_y").to_numpy()
            beats = np.r_[True, y[1:] > np.maximum.accumulate(y)[:-1]] if len(y) else np.zeros(0, bool)
            kept_ = both.filter(pa.array(beats)).combine_chunks().to_batches()
            front = kept_[0] if kept_ else front
        if front is not None:
            yield front

    parts = ranges(local.mapInArrow(own, local.schema), [F.asc("_x"), F.desc("_y"), F.asc(key)])
    best, rows = None, []
    for r in sorted(parts.groupBy("_range").agg(F.max("_y").alias("top")).collect(), key=lambda r: r._range):  # a row for each range
        rows.append((r._range, best))
        best = r.top if best is None else max(best, r.top)
    ahead = df.sparkSession.createDataFrame(rows, "_range int, _ahead double")
    before = W.partitionBy("_range").orderBy(F.asc("_x"), F.desc("_y"), F.asc(key)).rowsBetween(W.unboundedPreceding, -1)
    merged = parts.withColumn("_best", F.max("_y").over(before)).join(F.broadcast(ahead), "_range").withColumn("_best", F.greatest("_best", "_ahead"))
    return merged.filter(F.col("_best").isNull() | (F.col("_y") > F.col("_best"))).select(*df.columns)


def macro(rows: DataFrame, run: str, task: str, value: str, tasks: list[str], usable: Column) -> DataFrame:
    """Mean over the tasks of each one's own value, never pooled; null unless every task has a usable one."""
    have = F.count_if(usable & F.col(value).isNotNull() & F.col(task).isin(tasks))
    return rows.groupBy(run).agg(F.when(have == len(tasks), F.avg(F.when(usable & F.col(task).isin(tasks), F.col(value)))).alias(f"macro_{value}"))


def cost_per_thousand(cost: Column, calls: Column) -> Column:
    return F.try_divide(cost * 1000, calls)


def frontier_rows(accuracy: DataFrame, usage: DataFrame, latency: DataFrame, tasks: list[str]) -> DataFrame:
    """Per run: macro accuracy (all cases evaluable), cost per 1,000 calls (complete usage), macro p95 (full coverage)."""
    a = macro(accuracy, "run_id", "task_type", "exact", tasks, (F.col("n_evaluable") == F.col("n_total")) & (F.col("n_total") > 0))
    u = usage.select("run_id", F.when(F.col("cost_completeness") == "complete", cost_per_thousand(F.col("estimated_cost_usd"), F.col("calls"))).alias("cost_per_1000"))
    p = macro(latency, "run_id", "task_type", "p95_ms", tasks, F.col("coverage") == 1)
    return a.join(u, "run_id", "left").join(p, "run_id", "left")


def singleton_profiles(executions: DataFrame, run: str, fields: list[str]) -> DataFrame:
    """(run, field, n): serving settings of which a run has other than one value; such runs can't be compared."""
    n = executions.groupBy(run).agg(*[F.countDistinct(F.coalesce(F.col(f).cast("string"), F.lit("null"))).alias(f) for f in fields])
    return n.select(run, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("n")) for f in fields])).alias("x")).select(run, "x.*").filter("n <> 1")

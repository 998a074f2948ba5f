"""Places, percentiles and frontiers of groups of any size, against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.operators import frontier, logs, ranks, relations, selection


def test_numbered_groups_of_any_size(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), rng.randrange(40), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, s int, id int")
    want, count = {}, {}
    for g, s, i in sorted(rows, key=lambda r: (-r[1], r[2])):
        count[g] = count.get(g, 0) + 1
        want[i] = count[g]
    out = ranks.numbered(df, [F.desc("s"), F.asc("id")], ["g"])
    assert out.columns == ["g", "s", "id", "place"] and {r.id: r.place for r in out.collect()} == want
    flat = [r[2] for r in sorted(rows, key=lambda r: (-r[1], r[2]))]
    whole = ranks.numbered(df, [F.desc("s"), F.asc("id")])
    assert {r.id: r.place for r in whole.collect()} == {i: k for k, i in enumerate(flat, 1)}
    assert ranks.numbered(df.limit(0), ["id"], ["g"]).count() == 0


def test_hot_pool_is_many_tasks(spark):
    """One pool and one group hold all rows; no task orders more than a range of them."""
    df = spark.range(20_000).select(F.lit("pool").alias("p"), F.lit("x").alias("g"), (F.col("id") * 7919 % 20_011).alias("s"), F.col("id").alias("k"))
    parts = ranks.ranges(df, ["p", F.desc("s"), "k"])
    sizes = [r["count"] for r in parts.groupBy("_range").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 0.4 * sum(sizes)
    out = selection.round_robin(df, "g", "s", "k", ["p"])
    assert out.agg(F.countDistinct("turn"), F.max("turn")).head() == (20_000, 20_000)
    assert out.orderBy("turn").limit(3).agg(F.min("s")).head()[0] == df.orderBy(F.desc("s")).limit(3).agg(F.min("s")).head()[0]


def test_numbers_are_never_cut(spark):
    df = spark.range(5000).withColumnRenamed("id", "case_id")
    ids = [r.numbered_id for r in selection.hashed_order(df, "s", "case_id", "set").collect()]
    assert len(set(ids)) == 5000 and {"set-001", "set-999", "set-1000", "set-5000"} <= set(ids)
    grid = relations.design_grid(spark, list("ABCD"), [f"g{i}" for i in range(5)], 100, 7, "case", 0)
    cases = {r.case_id for r in grid.collect()}
    assert len(cases) == 2000 and {"case-001", "case-2000"} <= cases
    log = spark.createDataFrame([("k", i % 7, i) for i in range(50)], "key string, at int, id int")
    got = {r.id: r.attempt for r in logs.numbered_attempts(log, ["key"], [F.col("at"), F.col("id")]).collect()}
    assert got == {i: k for k, i in enumerate(sorted(range(50), key=lambda i: (i % 7, i)), 1)}


SHARES = (0.0, 0.5, 0.9, 0.95, 0.99, 1.0)


@pytest.mark.parametrize("kind", ["normal", "ties", "powers", "two values", "constant"])
def test_percentiles_by_narrowing(spark, kind):
    """Groups far over the buffer, of values of any spread, give the percentiles of the sorted values."""
    rng = np.random.default_rng(3)
    n = 6000
    values = {"normal": rng.normal(size=n), "ties": rng.integers(0, 5, n).astype(float), "powers": np.exp(rng.normal(size=n) * 60), "two values": np.where(np.arange(n) < 3000, -1e300, 5.0), "constant": np.full(n, 2.5)}[kind]
    rows = [("hot", float(v)) for v in values] + [("small", float(v)) for v in values[:7]] + [("hot", None), ("none", None)]
    got = {r.g: r.percentiles for r in ranks.percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", SHARES, one_buffer=50).collect()}
    assert set(got) == {"hot", "small"}
    np.testing.assert_allclose(got["hot"], np.quantile(values, SHARES), rtol=1e-12)
    np.testing.assert_allclose(got["small"], np.quantile(values[:7], SHARES), rtol=1e-12)


def test_frontier_is_the_sorted_scan(spark):
    rng = random.Random(5)
    rows = [(f"r{i}", rng.choice([None, float("nan"), *range(12)]) if i % 50 == 0 else float(rng.randrange(60)), float(rng.randrange(25) + i // 200)) for i in range(1500)]
    rows += [(f"s{i}", 100.0 + i, 100.0 + i) for i in range(400)]  # all on the frontier
    best, want = None, []
    for k, x, y in sorted((r for r in rows if r[1] is not None and r[1] == r[1]), key=lambda r: (r[1], -r[2], r[0])):
        if best is None or y > best:
            best = y
            want.append(k)
    df = spark.createDataFrame([(k, None if x is None else float(x), y) for k, x, y in rows], "id string, x double, y double").repartition(9)
    out = frontier.pareto(df, "x", "y", "id")
    assert sorted(r.id for r in out.collect()) == sorted(want) and out.columns == ["id", "x", "y"]
    assert frontier.pareto(df.limit(0), "x", "y", "id").count() == 0

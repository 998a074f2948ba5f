"""Views kept up by batches against a full fold."""

import random

import pytest
from pyspark.sql import functions as F

from evalloom.operators import logs, snapshots

VIEW = snapshots.View(("k",), ("t", "id"), ("label", "n"), ("late",), "id")
SCHEMA = "k string, t int, id int, label string, n int, late double, more int"


def log_rows(rng, n):
    return [(rng.choice(["hot", None, *map(str, range(30))]), rng.choice([None, *range(9)]), i, rng.choice("ABC"), rng.choice([None, i]), rng.choice([None, None, float(i)]), 1) for i in range(n)]


def as_set(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def full(df):
    return logs.current_view(df, ["k"], ["t", "id"], ["label", "n"], ["late"], "id")


def test_batches_in_any_order_and_repeated_are_the_full_fold(spark, tmp_path):
    rng, path = random.Random(3), str(tmp_path / "v")
    rows = log_rows(rng, 400)
    rng.shuffle(rows)
    parts = [rows[i::4] for i in range(4)]
    whole = spark.createDataFrame(rows, SCHEMA)
    for i, k in enumerate([2, 0, 2, 3, 1]):
        assert snapshots.apply_batch(spark.createDataFrame(parts[k], SCHEMA), path, VIEW, 8) == i + 1
    assert as_set(snapshots.current(spark, path, VIEW, whole)) == as_set(full(whole))
    two = spark.createDataFrame(parts[2] + parts[0], SCHEMA)
    assert as_set(snapshots.current(spark, path, VIEW, whole, version=2)) == as_set(full(two))


def test_a_batch_touches_its_buckets_only(spark, tmp_path):
    path = str(tmp_path / "v")
    snapshots.apply_batch(spark.createDataFrame([(str(i), 1, i, "A", i, None, 0) for i in range(200)], SCHEMA), path, VIEW, 16)
    snapshots.apply_batch(spark.createDataFrame([("7", 2, 900, "B", 1, 2.0, 0)], SCHEMA), path, VIEW, 99)
    version, parts = snapshots.held(spark, path)
    assert version == 2 and len(parts) == 16 and sorted(parts.values()) == [1] * 15 + [2]
    got = {r.k: r for r in snapshots.current(spark, path, VIEW, spark.createDataFrame([], SCHEMA)).collect()}
    assert len(got) == 200 and tuple(got["7"]) == ("7", "B", 1, 2.0, 7)


def test_empty_batches_and_unknown_versions(spark, tmp_path):
    path, none = str(tmp_path / "v"), spark.createDataFrame([], SCHEMA)
    assert snapshots.current(spark, path, VIEW, none).count() == 0
    assert snapshots.apply_batch(none, path, VIEW, 4) == 1 and snapshots.apply_batch(none, path, VIEW, 4) == 1
    assert snapshots.current(spark, path, VIEW, none).count() == 0
    one = spark.createDataFrame([("a", 1, 1, "A", 1, None, 0)], SCHEMA)
    assert snapshots.apply_batch(one, path, VIEW) == 2 and snapshots.current(spark, path, VIEW, none).count() == 1
    with pytest.raises(snapshots.CheckFailed, match="no version 9"):
        snapshots.current(spark, path, VIEW, none, version=9)


def test_what_was_broken_off_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "v")
    one, two = ([(str(i), t, i, lab, i, None, 0) for i in range(40)] for t, lab in ((1, "A"), (2, "B")))
    snapshots.apply_batch(spark.createDataFrame(one, SCHEMA), path, VIEW, 4)
    spark.createDataFrame([("bad", 1)], "k string, bucket int").write.partitionBy("bucket").parquet(f"{path}/rows/version=2")
    seen = snapshots.current(spark, path, VIEW, spark.createDataFrame([], SCHEMA))
    assert {r.label for r in seen.collect()} == {"A"}
    assert snapshots.apply_batch(spark.createDataFrame(two, SCHEMA), path, VIEW) == 2
    seen = snapshots.current(spark, path, VIEW, spark.createDataFrame([], SCHEMA))
    assert {r.label for r in seen.collect()} == {"B"} and seen.filter(F.col("k") == "bad").count() == 0

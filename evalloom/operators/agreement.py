"""Agreement of predictions with reference labels: from samples to metric tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.functions.labels import LABELS, is_label, ordinal, pairs_mean, rank, set_distance


def severe_mode(samples: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Per key, the most frequent clear label, the more severe of equals; null where no label is clear.

    Also n_present and n_valid. One shuffle: labels are counted side by side, not one group each.
    """
    n = [F.count_if(F.col(label) == x) for x in LABELS]
    most = F.greatest(*n)
    mode = F.coalesce(*[F.when((c == most) & (most > 0), F.lit(x)) for x, c in reversed(list(zip(LABELS, n, strict=True)))])
    return samples.groupBy(*keys).agg(mode.alias("mode_prediction"), F.count("*").alias("n_present"), F.count_if(is_label(F.col(label))).alias("n_valid"))


def case_predictions(modes: DataFrame, gold: str = "gold", expected: Column | int = 5) -> DataFrame:
    """Adds exact, over, under and ordinal_distance: null unless prediction and gold are clear labels."""
    p, g = rank(F.col("mode_prediction")), rank(F.col(gold))
    return modes.withColumns({"n_expected": expected if isinstance(expected, Column) else F.lit(expected), "exact": (p == g).cast("int"), "over": (p > g).cast("int"), "under": (p < g).cast("int"), "ordinal_distance": F.abs(p - g)})


def _metrics() -> list[Column]:
    scored = is_label(F.col("mode_prediction"))
    n = F.count_if(scored)
    rates = [F.try_divide(F.sum(F.when(scored, F.col(c))).cast("double"), n).alias(c) for c in ("exact", "over", "under")]
    return [F.count("*").alias("n_total"), n.alias("n_evaluable"), F.count_if(~scored).alias("n_all_invalid"), F.sum(F.col("n_expected") - F.col("n_valid")).alias("invalid_samples"), *rates, F.try_divide(F.count_if(scored & (F.col("ordinal_distance") <= 1)).cast("double"), n).alias("within_1")]


def primary_clear(cases: DataFrame, gold: str = "gold") -> DataFrame:
    return cases.filter((F.col("split") == "primary") & is_label(F.col(gold)))


def metrics_by_sets(cases: DataFrame, dataset: str = "dataset", gold: str = "gold") -> DataFrame:
    """Metrics per task: overall, by dataset and by label, in one pass over grouping sets."""
    sets = [[F.col("task_type")], [F.col("task_type"), F.col(dataset)], [F.col("task_type"), F.col(gold)]]
    grouped = primary_clear(cases, gold).groupingSets(sets, "task_type", dataset, gold).agg(*_metrics(), F.grouping(dataset).alias("_no_d"), F.grouping(gold).alias("_no_g"))
    kind = F.when(F.col("_no_d") == 0, "dataset").when(F.col("_no_g") == 0, "label").otherwise("overall")
    value = F.when(F.col("_no_d") == 0, F.col(dataset)).when(F.col("_no_g") == 0, F.col(gold)).otherwise("all")
    names = [c for c in grouped.columns if c not in ("task_type", dataset, gold, "_no_d", "_no_g")]
    return grouped.select("task_type", kind.alias("group_type"), value.alias("group_value"), *names)


def paper_row(metrics: DataFrame, model: Column) -> DataFrame:
    """One wide row per model: rates of either task, rounded to even at 4 places, then written with 3."""

    def shown(c: Column) -> Column:
        return F.when(c.isNotNull(), F.format_string("%.3f", F.bround(c, 4))).otherwise("")

    overall = metrics.filter("group_type = 'overall'")
    cols = []
    for task in ("qa", "conv"):
        mine = F.col("task_type") == task
        cols.append(F.max(F.when(mine, F.col("n_evaluable"))).alias(f"{task}_n"))
        cols += [shown(F.max(F.when(mine, F.col(m)))).alias(f"{task}_{m}") for m in ("exact", "over", "under")]
    return overall.groupBy(model.alias("model")).agg(*cols)


def confusion(cases: DataFrame, gold: str = "gold") -> DataFrame:
    """Four rows per task, a column per predicted label, zeros filled in."""
    clear = primary_clear(cases, gold).filter(is_label(F.col("mode_prediction")))
    dims = cases.select("task_type").distinct().select("task_type", F.explode(F.array(*[F.lit(x) for x in LABELS])).alias("true"))
    counted = clear.groupBy("task_type", F.col(gold).alias("true")).agg(*[F.count_if(F.col("mode_prediction") == x).alias(f"pred_{x}") for x in LABELS])
    return dims.join(counted, ["task_type", "true"], "left").select("task_type", "true", *[F.coalesce(f"pred_{x}", F.lit(0)).alias(f"pred_{x}") for x in LABELS])


def boundary_metrics(cases: DataFrame, gold: str = "gold") -> DataFrame:
    """How predictions fall around reference labels that lie between two."""
    between = cases.filter((F.col("split") == "primary") & F.col(gold).rlike(r"^[A-D]\|[A-D]$"))
    p = rank(F.col("mode_prediction"))
    ends = F.array(rank(F.substring(gold, 1, 1)), rank(F.substring(gold, 3, 1)))
    low, high = F.array_min(ends), F.array_max(ends)
    n, inside = F.count_if(p.isNotNull()), F.count_if((p == low) | (p == high))

    def rate(a: Column, b: Column) -> Column:
        return F.try_divide(a.cast("double"), b)

    return between.groupBy("task_type", F.col(gold).alias("boundary")).agg(F.count("*").alias("n_total"), n.alias("n_evaluable"), rate(inside, n).alias("constituent_rate"), rate(F.count_if(p == high), inside).alias("upper_among_constituent"), rate(F.count_if(p > high), n).alias("outside_high_rate"), rate(F.count_if(p < low), n).alias("outside_low_rate"))


def pooled_histogram(units: DataFrame, votes: str, by: list[str]) -> DataFrame:
    return units.select(*by, F.explode(votes).alias("v")).filter("v IS NOT NULL").groupBy(*by, "v").count()


def alpha(units: DataFrame, votes: str, by: list[str] | None = None) -> DataFrame:
    """1 minus the mean over units of their pairs' mean distance, over the pooled pairs' mean distance.

    The pool's pairs are counted from its histogram, never enumerated: equal values are at distance 0, so only
    pairs of different values count, each by the product of their counts. 1 where the pool has no spread;
    null without a unit of two votes.
    """
    by = by or []
    given = units.withColumn("_v", F.filter(votes, lambda v: v.isNotNull()))
    observed = given.filter(F.size("_v") >= 2).groupBy(*by).agg(F.avg(pairs_mean(F.col("_v"))).alias("observed"), F.count("*").alias("n_units"))
    hist = pooled_histogram(given, "_v", by)
    a, b = hist.alias("a"), hist.alias("b")  # at most seven values each
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in by]
    on = F.col("a.v") < F.col("b.v")
    for s in same:
        on = on & s
    apart = a.join(b, on).groupBy(*[F.col(f"a.{k}").alias(k) for k in by]).agg(F.sum(F.col("a.count") * F.col("b.count") * set_distance(F.col("a.v"), F.col("b.v"))).alias("apart"))
    size = hist.groupBy(*by).agg(F.sum("count").alias("n_votes"))
    joined = observed.crossJoin(size).crossJoin(apart) if not by else observed.join(size, by).join(apart, by, "left")
    if not by:  # one row each
        joined = observed.crossJoin(size.join(apart, F.lit(True), "left"))
    expected = F.coalesce("apart", F.lit(0.0)) / (F.col("n_votes") * (F.col("n_votes") - 1) / 2)
    value = F.when(expected == 0, F.lit(1.0)).otherwise(1 - F.col("observed") / expected)
    return joined.select(*by, "n_units", "n_votes", F.when(F.col("n_units") > 0, value).alias("alpha"))


def alpha_leave_one_out(units: DataFrame, votes: str, prediction: str, slots: int = 5) -> DataFrame:
    """alpha with one slot's votes replaced by the prediction, per slot; slot -1 is the votes as they are."""
    p = F.when(is_label(F.col(prediction)), ordinal(F.col(prediction)))
    numbered = units.select("*", F.explode(F.sequence(F.lit(-1), F.lit(slots - 1))).alias("slot"))
    put = F.transform(votes, lambda v, i: F.when((i == F.col("slot")) & v.isNotNull(), F.coalesce(p, v)).otherwise(v))
    swapped = numbered.withColumn("_swapped", put).filter(F.size(F.filter("_swapped", lambda v: v.isNotNull())) >= 2)
    return alpha(swapped, "_swapped", ["slot"])


def panel_summary(cases: DataFrame, values: list[str], by: list[str]) -> DataFrame:
    """Counts and means over a panel's cases; nulls are skipped."""
    return cases.groupBy(*by).agg(F.count("*").alias("n"), F.count(values[0]).alias("n_evaluable"), *[F.avg(v).alias(f"mean_{v}") for v in values])

"""Planning costs of a scenario, in decimals throughout: a row of assumptions in, a row per component out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXACT = "decimal(38,12)"


def dec(c: str | Column | float) -> Column:
    c = F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(str(c))
    return c.cast(EXACT)


def product(*parts: str | Column | float) -> Column:
    """Multiplied left to right, cut back to 12 places each time so that nothing overflows."""
    out = dec(parts[0])
    for p in parts[1:]:
        out = (out * dec(p)).cast(EXACT)
    return out


def million(c: Column) -> Column:
    return (c / F.lit("1000000").cast("decimal(10,0)")).cast(EXACT)


def generation(rollouts: Column, prefill: str, cached: str, sampled: str, who: str) -> Column:
    """Prefill, cached prefill and sampled tokens at a model's rates per million."""
    total = product(rollouts, prefill)
    old = product(total, cached)
    fresh = (total - old).cast(EXACT)
    return million((product(fresh, f"{who}_prefill") + product(old, f"{who}_cached_prefill") + product(product(rollouts, sampled), f"{who}_sample")).cast(EXACT))


def _hours(*parts: str) -> Column:
    return (product(*parts) / F.lit("60").cast("decimal(4,0)")).cast(EXACT)


def scenario(a: DataFrame, *keys: str) -> DataFrame:
    """(keys, component, category, cost): six places, halves up. a: one row or more, with the columns named below and keys that tell them apart."""
    rollouts = product("unique_cases", "teacher_rollouts_per_case")
    evaluation, policy = product("eval_cases", "eval_rollouts_per_case"), product("policy_cases", "policy_rollouts_per_case", "policy_rounds")
    train = million(product(rollouts, "sft_tokens", "sft_epochs", "student_train"))
    sweep = million(product(product(rollouts, "sweep_fraction"), product("sweep_rates", "sweep_ranks"), "sft_tokens", "sweep_epochs", "student_train"))
    on_policy = generation(policy, "policy_prefill", "policy_cached", "policy_sampled", "student") + million(product(policy, "policy_scored", "teacher_prefill")) + million(product(policy, "policy_train", "student_train"))
    hours = _hours("unique_cases", "review_share", "minutes_per_case") + product(rollouts, F.col("rollout_share"), "minutes_per_rollout") / F.lit("60").cast("decimal(4,0)") + _hours("eval_cases", "labels_per_case", "minutes_per_label") + _hours("eval_cases", "adjudication_share", "minutes_per_adjudication")
    parts = [
        ("teacher_generation", "compute", generation(rollouts, "teacher_prefill_tokens", "teacher_cached", "teacher_sampled", "teacher")),
        ("sft", "compute", train),
        ("sweep", "compute", sweep),
        ("evaluation", "compute", generation(evaluation, "eval_prefill", "eval_cached", "eval_sampled", "student")),
        ("on_policy", "compute", on_policy),
        ("clinician_review", "human", product(hours.cast(EXACT), "hourly_rate")),
    ]
    rows = F.array(*[F.struct(F.lit(n).alias("component"), F.lit(k).alias("category"), F.round(c.cast(EXACT), 6).cast("decimal(30,6)").alias("cost")) for n, k, c in parts])
    return a.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def totals(components: DataFrame, *keys: str) -> DataFrame:
    """Subtotals by category, and the whole under all; of each key by itself."""
    sets = [[F.col(k) for k in (*keys, "category")], [F.col(k) for k in keys]]
    return components.groupingSets(sets, *keys, "category").agg(F.sum("cost").cast("decimal(30,6)").alias("cost")).select(*keys, F.coalesce("category", F.lit("all")).alias("category"), "cost")


def seed_preparation(a: DataFrame, *keys: str) -> DataFrame:
    """What reviewing and labelling a seed set costs; columns as in scenario, with seed_cases."""
    hours = _hours("seed_cases", "minutes_per_case") + _hours("seed_cases", "labels_per_case", "minutes_per_label") + _hours("seed_cases", "adjudication_share", "minutes_per_adjudication")
    return a.select(*keys, F.round(product(hours.cast(EXACT), "hourly_rate"), 6).cast("decimal(30,6)").alias("cost"))

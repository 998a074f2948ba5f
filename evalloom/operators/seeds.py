"""Seed cases from a benchmark: what each text tells, scored, chosen by quota and made into cards."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.functions import findings
from evalloom.functions import text as T
from evalloom.functions.spans import any_case, exact_case
from evalloom.operators import selection
from evalloom.operators.relations import CheckFailed

SUMMARY, OTHER = "concern.summary", "context.additional"
COLUMNS = ("case_id", "dataset", "text", "normalized_label", "mapping_method", "split")


@dataclass(frozen=True)
class SeedPlan:
    """What is chosen, and the catalogue that texts are read by.

    questions: the patterns of each question, in the order of a card's facts; SUMMARY holds the opening, too, and
    OTHER all that no pattern takes. flags: the red flag that a question's evidence is looked through for.
    quotas: rows to choose by (label, dataset).
    """

    seed_id: str
    split: str
    questions: dict[str, list[str]]
    flags: dict[str, str]
    groups: dict[str, list[str]]
    quotas: dict[tuple[str, str], int]
    unknown: str = "I don't know."
    least: int = 40
    most: int = 6_000
    exclude: tuple[str, ...] = ()
    prefix: str = "case"

    @staticmethod
    def of(plan: dict) -> SeedPlan:
        """From a JSON object; its quotas are objects of data sets by label."""
        quotas = {(label, name): n for label, names in plan["quotas"].items() for name, n in names.items()}
        return SeedPlan(**plan | {"quotas": quotas, "exclude": tuple(plan.get("exclude", ()))})

    def __post_init__(self) -> None:
        if unknown := sorted(set(self.flags.values()) - set(findings.FLAGS)):
            raise CheckFailed(f"unknown flags: {', '.join(unknown)}")
        if strange := sorted(set(self.flags) - set(self.questions)):
            raise CheckFailed(f"flags of unknown questions: {', '.join(strange)}")
        if self.questions.get(OTHER):
            raise CheckFailed(f"{OTHER} takes what is left and has no patterns")
        if not self.quotas or min(self.quotas.values()) < 1:
            raise CheckFailed("quotas must be positive")


def matches(fragment: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, p: a | fragment.rlike(any_case(p)), patterns, F.lit(False))


def _that(fragments: Column, test: Callable, given) -> Column:
    """The fragments that test(fragment, given) holds for."""
    return F.filter(fragments, lambda f: test(f, given))


def evidence(fragments: Column, opening: Column, questions: dict[str, list[str]]) -> dict[str, Column]:
    """The fragments that answer each question, in their order.

    A question takes a fragment once. What no question takes, repeats of what one took included, is OTHER's unless
    it is part of the opening.
    """
    once = F.array_distinct(fragments)
    out = {q: _that(once, matches, ps) for q, ps in questions.items()}
    out[SUMMARY] = F.concat(opening, F.array_except(out.get(SUMMARY, F.array().cast("array<string>")), opening))
    every = [p for ps in questions.values() for p in ps]
    again = lambda f, i: F.array_contains(F.slice(fragments, F.lit(1), i), f)
    out[OTHER] = F.filter(fragments, lambda f, i: ~F.array_contains(opening, f) & (~matches(f, every) | again(f, i)))
    return out


def read(rows: DataFrame, plan: SeedPlan) -> DataFrame:
    """Rows with fragments, opening, facts, red_flags, presentation_group and information_score."""
    rows = rows.withColumn("fragments", T.segments(F.col("text"))).withColumn("opening_parts", T.opening(F.col("fragments")))
    told = evidence(F.col("fragments"), F.col("opening_parts"), plan.questions)
    rows = rows.withColumn("told", F.struct(*[c.alias(q) for q, c in told.items()]))
    held = lambda q: F.col("told").getField(q)
    facts = F.array(*[F.struct(F.lit(q).alias("question_id"), F.when(F.size(held(q)) > 0, "known").otherwise("unknown").alias("status"), F.when(F.size(held(q)) > 0, F.array_join(held(q), " ")).otherwise(plan.unknown).alias("answer"), held(q).alias("evidence_text")) for q in plan.questions])
    raised = {q: F.get(_that(held(q), lambda f, k: findings.raises(k, f), k), F.lit(0)) for q, k in plan.flags.items()}
    flags = F.array_compact(F.array(*[F.when(e.isNotNull(), F.struct(F.lit(plan.flags[q]).alias("id"), F.lit(q).alias("question_id"), e.alias("evidence_text"))) for q, e in raised.items()])) if raised else F.array().cast("array<struct<id:string,question_id:string,evidence_text:string>>")
    rows = rows.withColumns({"opening": F.array_join("opening_parts", " "), "facts": facts, "red_flags": flags, "presentation_group": T.pattern_group(F.col("text"), plan.groups)})
    known = F.size(F.filter("facts", lambda x: x["status"] == "known"))
    return rows.withColumn("information_score", T.information_score(known, F.size("fragments"), F.length("text")))


def eligible(benchmark: DataFrame, plan: SeedPlan) -> DataFrame:
    """Rows of the split and of a pool with a quota, of usable length, that no pattern excludes (case counts); null texts are none."""
    pools = [(F.col("normalized_label") == label) & (F.col("dataset") == name) for label, name in plan.quotas]
    usable = T.usable_length(F.col("text"), plan.least, plan.most, [exact_case(p) for p in plan.exclude])
    return benchmark.filter((F.col("split") == plan.split) & reduce(lambda a, b: a | b, pools) & usable)


def quota_table(spark: SparkSession, plan: SeedPlan) -> DataFrame:
    return spark.createDataFrame([(*k, n) for k, n in sorted(plan.quotas.items())], "normalized_label string, dataset string, quota int")


def cards(chosen: DataFrame, plan: SeedPlan) -> DataFrame:
    """Chosen candidates as numbered cards."""
    rows = selection.hashed_order(chosen, plan.seed_id, "case_id", plan.prefix)
    who = findings.speaker_profile(F.col("text"), F.col("opening"))
    basis = T.label_basis(F.col("mapping_method"), F.col("dataset"))
    return rows.select(F.col("numbered_id").alias("card_id"), F.col("case_id").alias("benchmark_case_id"), F.col("dataset").alias("source_dataset"), F.col("normalized_label").alias("gold_acuity"), basis.alias("label_basis"), "presentation_group", "information_score", "opening", "facts", "red_flags", who.alias("profile"), T.unsafe_labels(F.col("normalized_label")).alias("unsafe_dispositions"))

"""Jobs: the operators put together over stored tables. Each takes paths, writes its tables below out and returns them by name."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.functions.text import answer_label
from evalloom.operators import agreement, benchmark, cost, frontier, relations, replay, schema_check, screen, seeds, selection, usage
from evalloom.sources import files


@dataclass(frozen=True)
class Model:
    """An entry of the registry: what a model is called and costs per million tokens."""

    model: str
    provider: str
    input: float
    cached: float
    output: float
    reasoning: str = ""

    def __post_init__(self) -> None:
        if not self.model or not self.provider:
            raise relations.CheckFailed("a model needs a name and a provider")
        if min(self.input, self.cached, self.output) < 0:
            raise relations.CheckFailed(f"{self.model}: a price is negative")


def registry(spark: SparkSession, models: list[Model]) -> DataFrame:
    """The registry as a table; a name may come once."""
    names = [m.model for m in models]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise relations.CheckFailed(f"models that are given twice: {', '.join(twice)}")
    types = ", ".join(f"{f.name} {'double' if f.type == 'float' else 'string'}" for f in fields(Model))
    return spark.createDataFrame([tuple(getattr(m, f.name) for f in fields(Model)) for m in models], types)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The registry in a JSON-lines file."""
    rows = files.read_jsonl(spark, path, "model string, provider string, input double, cached double, output double, reasoning string", nonempty=True).collect()  # written by hand
    return registry(spark, [Model(**{k: v for k, v in r.asDict().items() if v is not None}) for r in rows])


def _written(tables: dict[str, DataFrame], out: str) -> dict[str, DataFrame]:
    for name, df in tables.items():
        files.write_table(df, f"{out}/{name}")
    return {name: df.sparkSession.read.schema(df.schema).parquet(f"{out}/{name}") for name, df in tables.items()}


def build(spark: SparkSession, direct: str, surveyed: str, raw: str, out: str) -> dict[str, DataFrame]:
    """The benchmark from its routed parts; nothing is written if a check finds something."""
    read = spark.read.parquet
    rows, checks = benchmark.assembled([read(direct)], read(surveyed), read(raw), ["dataset", "source_id"], ["dataset", "source_id", "text", "normalized_label", "mapping_method"])
    relations.run_checks(checks)
    return _written({"benchmark": rows.orderBy("position"), "counts": benchmark.card_counts(rows, {"dataset": ["dataset"], "label": ["normalized_label"], "split": ["split"]})}, out)


def seeded(spark: SparkSession, rows: str, plan: dict, out: str) -> dict[str, DataFrame]:
    """Seed cards from a benchmark by a plan of quotas; a pool too small, or a case that comes twice, stops it before anything is written but the candidates."""
    made = seeds.SeedPlan.of(plan)
    benchmark_rows = relations.require_columns(spark.read.parquet(rows), set(seeds.COLUMNS)).select(*seeds.COLUMNS)
    pools, quotas = ["normalized_label", "dataset"], seeds.quota_table(spark, made)
    read = _written({"candidates": seeds.read(seeds.eligible(benchmark_rows, made), made)}, out)["candidates"]
    taken = selection.quota_take(read, quotas, pools, "presentation_group", "information_score", "case_id")
    relations.run_checks({"pools that are too small": selection.short_pools(taken, quotas, pools), "cases that come twice": relations.duplicates(taken, ["case_id"])})
    cards = _written({"cards": seeds.cards(taken, made)}, out)["cards"]
    counted = {"label": ["gold_acuity"], "dataset": ["source_dataset"], "label and dataset": ["gold_acuity", "source_dataset"], "group": ["presentation_group"]}
    return {"candidates": read, "cards": cards} | _written({"counts": benchmark.card_counts(cards, counted), "candidate_counts": benchmark.card_counts(read, {"label and dataset": pools})}, out)


def bundled(spark: SparkSession, examples: str, held_out: str, keys: list[str], family: str, source: str, split: str, label: str, out: str) -> dict[str, DataFrame]:
    """Counts of training examples; none may be a held-out case, and no family may lie in two splits."""
    rows = spark.read.parquet(examples)
    relations.run_checks({"examples that are held out": screen.leaks(rows, spark.read.parquet(held_out), keys).select(*keys), "families in several splits": relations.crossings(rows, family, split)})
    return _written({"counts": benchmark.bundle_counts(rows, family, source, split, label)}, out)


def validate(spark: SparkSession, rows: str, ids: str, key: str, out: str) -> dict[str, DataFrame]:
    """Keys that are missing, extra or repeated against a list of ids, a line each."""
    df, want = spark.read.parquet(rows), files.read_lines(spark, ids).withColumnRenamed("value", key)
    found = relations.symmetric_difference(want, df.select(F.col(key).cast("string").alias(key)), key)
    twice = relations.duplicates(df, [key]).select(F.col(key).cast("string").alias(key), F.lit("repeated").alias("side"))
    return _written({"differences": found.unionByName(twice)}, out)


def evaluate(spark: SparkSession, samples: str, gold: str, out: str, expected: int = 5) -> dict[str, DataFrame]:
    """Metrics, confusion and boundary tables of answers (case_id, task_type, sample_idx, answer or label) against gold labels."""
    rows = spark.read.parquet(samples)
    if "label" not in rows.columns:
        rows = rows.withColumn("label", answer_label(F.col("answer")))
    known = spark.read.parquet(gold)
    joined, lost = relations.mandatory(*relations.in_parts([rows, known], ["case_id"], rows.count() + known.count()), ["case_id"])
    relations.run_checks({"samples without a case": lost})
    cases = agreement.case_predictions(agreement.severe_mode(joined, ["task_type", "case_id", "dataset", "gold", "split"], "label"), expected=expected)
    cases = _written({"cases": cases}, out)["cases"]
    metrics = agreement.metrics_by_sets(cases)
    return {"cases": cases} | _written({"metrics": metrics, "paper": agreement.paper_row(metrics, F.lit("model")), "confusion": agreement.confusion(cases), "boundary": agreement.boundary_metrics(cases)}, out)


def report(spark: SparkSession, attempts: str, executions: str, models: str, out: str) -> dict[str, DataFrame]:
    """Latency, throughput, and usage by model of the log of attempts."""
    log, known = spark.read.parquet(attempts), read_registry(spark, models)
    ok = F.col("outcome") == "success"
    priced = usage.priced(log, known, "model")
    used = usage.provider_summary(priced, "model", ok, ["input_tokens", "cached_input_tokens", "output_tokens"], "estimated_cost_usd", "request_wall_ms", "ttft_ms")
    return _written({"latency": usage.latency_percentiles(log, ["phase"], ["request_wall_ms", "ttft_ms"], ok), "executions": usage.execution_summary(spark.read.parquet(executions), log), "usage": used}, out)


def compare(spark: SparkSession, accuracy: str, used: str, latency: str, contracts: str, executions: str, profile: list[str], reference: str, fields_: list[str], tasks: list[str], out: str) -> dict[str, DataFrame]:
    """The frontier of runs whose contract is the reference run's; runs that differ are told and left out.

    Latencies of a run that was served under several settings (profile: columns of its executions) mean nothing
    together, so such a run stops the comparison.
    """
    relations.run_checks({"runs of several serving settings": frontier.singleton_profiles(spark.read.parquet(executions), "run_id", profile)})
    runs = spark.read.parquet(contracts)
    differences = relations.differing(runs.filter(F.col("run_id") == reference), runs, "run_id", fields_)
    rows = frontier.frontier_rows(*(spark.read.parquet(p) for p in (accuracy, used, latency)), tasks).join(differences.select("run_id").distinct(), "run_id", "left_anti")
    made = _written({"rows": rows, "differences": differences}, out)
    return made | _written({f"frontier_{x}": frontier.pareto(made["rows"], x, "macro_exact", "run_id") for x in ("cost_per_1000", "macro_p95_ms")}, out)


def screened(spark: SparkSession, candidates: str, held_out: str, out: str, least: int = 40, at_sequence: float = 0.82, at_contained: float = 0.65) -> dict[str, DataFrame]:
    """Why candidates (case_id, text) may not be used: near held-out texts (case_id, text), near each other, leaking, too short."""
    c, b = (screen.prepared(spark.read.parquet(p), "case_id", "text") for p in (candidates, held_out))
    best = screen.best_match(c, b.withColumn("ord", F.col("key")), at_sequence, at_contained)
    return _written({"screen": screen.reasons(best, screen.near_duplicates(c, at_sequence, at_contained), least, at_sequence, at_contained)}, out)


def replayed(spark: SparkSession, cards: str, actions: str, out: str) -> dict[str, DataFrame]:
    """Errors, outcomes, transcripts and rates of traces over their case cards."""
    card, step = spark.read.parquet(cards), replay.steps(spark.read.parquet(actions))
    relations.run_checks({"cards that contradict themselves": replay.card_errors(card)})
    done = _written({"errors": replay.trace_errors(step, card), "outcomes": replay.outcomes(step, card), "transcript": replay.transcript(step, card)}, out)
    return done | _written({"summary": replay.trace_summary(done["outcomes"])}, out)


def checked(spark: SparkSession, documents: str, schema: dict, key: str, column: str, out: str) -> dict[str, DataFrame]:
    """Documents that break a JSON Schema, with what breaks it."""
    return _written({"violations": schema_check.schema_violations(spark.read.parquet(documents), key, column, schema).filter(F.size("violations") > 0)}, out)


def costs(spark: SparkSession, assumptions: str, out: str) -> dict[str, DataFrame]:
    """Components and totals of a planning scenario."""
    parts = cost.scenario(spark.read.parquet(assumptions))
    return _written({"components": parts, "totals": cost.totals(parts)}, out)

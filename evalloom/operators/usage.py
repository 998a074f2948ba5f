"""Latency, execution, usage and cost tables over logs of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.operators.ranks import percentiles


def number(c: Column | str) -> Column:
    """A double, or null where the text is none; NaN is null, too."""
    c = F.col(c) if isinstance(c, str) else c
    v = c.try_cast("double")
    return F.when(~F.isnan(v), v)


def metadata_number(json: str, *paths: str) -> Column:
    """The first of the paths in a JSON text that holds something, as a double."""
    return number(F.coalesce(*[F.get_json_object(json, p) for p in paths]))


def latency_percentiles(rows: DataFrame, keys: list[str], metrics: list[str], ok: Column | None = None) -> DataFrame:
    """Exact linear percentiles per key (without nulls) and metric, with coverage; a metric nobody measured has a row of nulls.

    Metrics are unpivoted inside one scan. A key may hold any share of the values: see ranks.percentiles.
    """
    good = F.lit(True) if ok is None else F.coalesce(ok, F.lit(False))
    long = rows.select(*keys, good.alias("_ok"), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), number(m).alias("v")) for m in metrics])).alias("_m")).select(*keys, "_ok", "_m.*").withColumn("v", F.when(F.col("_ok"), F.col("v")))
    out = long.groupBy(*keys, "metric").agg(F.count("*").alias("n_total"), F.count_if("_ok").alias("n_success"), F.count("v").alias("n_measured"), F.avg("v").alias("mean_ms"), F.min("v").alias("min_ms"), F.max("v").alias("max_ms"))
    out = out.join(percentiles(long, [*keys, "metric"], "v", (0.5, 0.9, 0.95, 0.99)).withColumnRenamed("percentiles", "_p"), [*keys, "metric"], "left")
    return out.select(*keys, "metric", "n_total", "n_success", "n_measured", F.try_divide(F.col("n_measured").cast("double"), F.col("n_success")).alias("coverage"), "mean_ms", *[F.get("_p", F.lit(i)).alias(f"p{q}_ms") for i, q in enumerate((50, 90, 95, 99))], "min_ms", "max_ms")


def seconds_between(start: str, end: str) -> Column:
    def micros(c: str) -> Column:
        return F.unix_micros(F.col(c).try_cast("timestamp"))

    return (micros(end) - micros(start)) / 1e6


def execution_summary(executions: DataFrame, attempts: DataFrame) -> DataFrame:
    """Throughput, retries and failures of each execution; one without attempts counts zero."""
    stats = attempts.groupBy("execution_id").agg(F.countDistinct("request_key").alias("requests_observed"), F.count("*").alias("attempts_total"), F.count_if(F.col("attempt_index") > 1).alias("retry_attempts"), F.count_if(F.col("outcome") == "terminal_error").alias("terminal_error_attempts"))
    filled = {c: F.coalesce(c, F.lit(0)) for c in ("requests_observed", "attempts_total", "retry_attempts", "terminal_error_attempts")}
    out = executions.join(stats, "execution_id", "left").withColumns(filled).withColumn("elapsed_seconds", seconds_between("started_at", "ended_at"))
    done = F.coalesce("success_count", F.lit(0)) + F.coalesce("failure_count", F.lit(0))
    return out.withColumns({"persisted_requests_per_second": F.when(F.col("elapsed_seconds") > 0, done / F.col("elapsed_seconds")), "attempts_per_request": F.try_divide(F.col("attempts_total").cast("double"), F.col("requests_observed"))})


def untracked_parents(parents: DataFrame, attempts: DataFrame) -> DataFrame:
    """Parent rows whose execution has no attempt on record, those without an execution included."""
    tracked = attempts.select(F.col("execution_id").alias("latest_execution_id")).distinct()
    return parents.join(tracked, "latest_execution_id", "left_anti")


def usage_expected(kind: str) -> Column:
    """Should this record have reported its usage? kind: attempt or parent."""
    if kind == "parent":
        return F.coalesce((F.col("status") == "ok") | F.col("finish_reason").isNotNull(), F.lit(False))
    signs = [F.col("finish_reason").isNotNull(), F.col("response_id").isNotNull(), F.col("first_event_ms").isNotNull(), F.coalesce(number("http_status").between(200, 299), F.lit(False)), F.coalesce(F.col("outcome").isin("success", "retry_length"), F.lit(False))]
    out = signs[0]
    for s in signs[1:]:
        out = out | s
    return out


def call_cost(input_tokens: Column, cached: Column, output: Column, prices: tuple[float, float, float]) -> Column:
    """Dollars: prices per million of input, cached input and output tokens."""
    fresh = F.greatest(input_tokens - cached, F.lit(0))
    return (fresh * prices[0] + cached * prices[1] + output * prices[2]) / 1_000_000


def usage_summary(attempts: DataFrame, parents: DataFrame, prices: tuple[float, float, float], by: list[str]) -> DataFrame:
    """Tokens, coverages and cost per phase, over all attempts and the parents that no attempt stands for.

    Records of unknown usage add what they have; coverage counts those only that should have reported.
    """
    cols = [*by, "input_tokens", "cached_input_tokens", "output_tokens", "reasoning_tokens"]
    both = attempts.select(*cols, usage_expected("attempt").alias("want"), F.lit(1).alias("tracked")).unionByName(untracked_parents(parents, attempts).select(*cols, usage_expected("parent").alias("want"), F.lit(0).alias("tracked")))
    base = F.col("input_tokens").isNotNull() & F.col("output_tokens").isNotNull()
    cache = F.col("cached_input_tokens").isNotNull() if prices[0] != prices[1] else F.lit(True)
    want = F.col("want")

    def total(c: str) -> Column:
        return F.sum(F.coalesce(number(c), F.lit(0.0))).cast("long")

    out = both.groupBy(*by).agg(F.sum("tracked").alias("attempts_tracked"), F.sum(1 - F.col("tracked")).alias("legacy_parent_records"), F.count_if(want).alias("usage_records_expected"), F.count_if(want & base & cache).alias("usage_records_complete"), F.count_if(want & base).alias("_base"), F.count_if(want & cache).alias("_cache"), F.count_if(want & F.col("reasoning_tokens").isNotNull()).alias("_reasoning"), *[total(c).alias(c) for c in cols[len(by) : -1]], total("reasoning_tokens").alias("reasoning_tokens_observed"))

    def share(c: str) -> Column:
        return F.try_divide(F.col(c).cast("double"), F.col("usage_records_expected"))

    whole = F.when(F.col("_reasoning") == F.col("usage_records_expected"), F.when(F.col("usage_records_expected") > 0, F.col("reasoning_tokens_observed")))
    added = {"missing_usage_records": F.col("usage_records_expected") - F.col("_base"), "missing_cache_breakdown_records": F.col("usage_records_expected") - F.col("_cache"), "usage_coverage": share("_base"), "cache_breakdown_coverage": share("_cache"), "reasoning_token_coverage": share("_reasoning"), "reasoning_tokens": whole, "cost_completeness": F.when(F.col("usage_records_complete") == F.col("usage_records_expected"), "complete").otherwise("partial_missing_usage_or_cache_breakdown"), "estimated_cost_usd": call_cost(F.col("input_tokens"), F.col("cached_input_tokens"), F.col("output_tokens"), prices)}
    return out.withColumns(added).drop("_base", "_cache", "_reasoning")


def sorted_set(c: str, empty: str | None = None) -> Column:
    """An aggregate: the distinct values, sorted and joined by commas."""
    text = F.array_join(F.sort_array(F.collect_set(F.col(c).cast("string"))), ",")
    return text if empty is None else F.coalesce(F.nullif(text, F.lit("")), F.lit(empty))


def request_latency(attempts: DataFrame) -> DataFrame:
    """Per request: service time is all its attempts' wall time plus the waits between them."""
    return attempts.groupBy("execution_id", "request_key").agg(F.sum("request_wall_ms").alias("request_wall_ms"), F.sum(F.coalesce("backoff_ms", F.lit(0.0))).alias("backoff_ms"), F.sum(F.col("request_wall_ms") + F.coalesce("backoff_ms", F.lit(0.0))).alias("service_latency_ms"), F.count("*").alias("attempts"))


def first_token(events: DataFrame, keys: list[str]) -> DataFrame:
    """From a log of stream events (ms, text): first event, first visible text, and the time after it."""
    seen = F.min(F.when(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0, F.col("ms")))
    return events.groupBy(*keys).agg(F.min("ms").alias("first_event_ms"), seen.alias("ttft_ms"), (F.max("ms") - seen).alias("time_after_first_token_ms"))


#: Transient statuses and error classes.
RETRY_STATUS = (408, 409, 429)
RETRY_ERRORS = ("APIConnectionError", "APITimeoutError", "InternalServerError", "RateLimitError")


def retryable(http_status: Column, error_type: Column) -> Column:
    """Is a failure transient, by its status or its error's class? Never null."""
    return F.coalesce(http_status.isin(*RETRY_STATUS) | (http_status >= 500), F.lit(False)) | F.coalesce(error_type.isin(*RETRY_ERRORS), F.lit(False))


def backoff_seconds(attempt: Column, jitter: Column) -> Column:
    return F.least(F.lit(60.0), F.pow(F.lit(2.0), attempt - 1)) + jitter


def retry_cap(cap: Column, limit: Column) -> Column:
    """Output cap of the next try after an answer was cut for length."""
    return F.least(cap * 2, limit)


def finish_status(status: Column, reason: Column) -> Column:
    """A response's end: length where the output cap cut it, error where it failed, else as told."""
    cut = F.coalesce((status == "incomplete") & (reason == "max_output_tokens"), F.lit(False))
    return F.when(cut, "length").when(status.isin("incomplete", "failed"), "error").otherwise(F.coalesce(status, F.lit("unknown")))


def provider_summary(attempts: DataFrame, model: str, ok: Column, tokens: list[str], cost: str, duration: str, ttft: str) -> DataFrame:
    """Per model: attempts, good and failed ones, and sums and exact percentiles over the good ones."""
    pick = lambda c: F.when(ok, number(c))
    good = F.count_if(ok)
    named = attempts.withColumn("_model", F.coalesce(model, F.lit("unknown")))
    timed = named.select("_model", F.explode(F.array(F.struct(F.lit("_d").alias("m"), pick(duration).alias("v")), F.struct(F.lit("_t").alias("m"), pick(ttft).alias("v")))).alias("x")).select("_model", "x.*")
    found = percentiles(timed, ["_model", "m"], "v", (0.5, 0.95)).groupBy(F.col("_model").alias("model")).pivot("m", ["_d", "_t"]).agg(F.first("percentiles"))  # one row a model and metric
    out = named.groupBy(F.col("_model").alias("model")).agg(F.count("*").alias("attempts"), good.alias("successful_calls"), (F.count("*") - good).alias("failed_calls"), *[F.coalesce(F.sum(F.when(ok, F.col(c).try_cast("long"))), F.lit(0)).alias(c) for c in tokens], F.coalesce(F.sum(pick(cost)), F.lit(0.0)).alias(cost), F.avg(pick(duration)).alias("mean_ms"), F.count(pick(ttft)).alias("_n")).join(found, "model", "left")
    return out.select("model", "attempts", "successful_calls", "failed_calls", *tokens, cost, "mean_ms", F.get("_d", F.lit(0)).alias("p50_ms"), F.get("_d", F.lit(1)).alias("p95_ms"), (F.col("_n") > 0).alias("ttft_available"), F.get("_t", F.lit(0)).alias("ttft_p50_ms"), F.get("_t", F.lit(1)).alias("ttft_p95_ms"))


def priced(calls: DataFrame, prices: DataFrame, model: str) -> DataFrame:
    """Calls with estimated_cost_usd at their model's prices; null for a model without any. prices: model, input, cached, output."""
    known = F.broadcast(prices.select(F.col("model").alias(model), F.struct("input", "cached", "output").alias("_p")))  # a registry: rows written by hand
    fresh = F.greatest(F.coalesce("input_tokens", F.lit(0)) - F.coalesce("cached_input_tokens", F.lit(0)), F.lit(0))
    cost = (fresh * F.col("_p.input") + F.coalesce("cached_input_tokens", F.lit(0)) * F.col("_p.cached") + F.coalesce("output_tokens", F.lit(0)) * F.col("_p.output")) / 1_000_000
    return calls.join(known, model, "left").withColumn("estimated_cost_usd", cost).drop("_p")

"""Queries over logs: latency, usage, executions, current views, frontier."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.operators import frontier, logs, relations, snapshots, usage
from evalloom.plans.base import base, sql, with_base
from evalloom.session import work_path

PRICES = (0.25, 0.025, 2.0)


def r6(c):
    return F.round(c, 6)


def latency_percentiles(spark, d):
    rows = base(spark, d, "attempts").withColumn("server_ms", usage.metadata_number("props", "$.k")).withColumn("ttft_ms", F.lit(None).cast("double"))
    out = usage.latency_percentiles(rows, ["phase"], ["request_wall_ms", "server_ms", "ttft_ms"], F.col("outcome") == "success")
    return out.withColumns({c: r6(c) for c in ("coverage", "mean_ms", "p50_ms", "p90_ms", "p95_ms", "p99_ms", "min_ms", "max_ms")})


def executions(spark, d):
    a = base(spark, d, "attempts")
    return a.groupBy("execution_id").agg(F.min("ts").cast("string").alias("started_at"), F.max("ts").cast("string").alias("ended_at"), F.count_if(F.col("outcome") == "success").alias("success_count"), F.count_if(F.col("outcome") == "terminal_error").alias("failure_count"))


def execution_summary(spark, d):
    some = base(spark, d, "attempts").withColumn("execution_id", F.when(F.col("execution_id") % 7 != 0, F.col("execution_id")))  # a seventh has no execution on record
    out = usage.execution_summary(executions(spark, d), some)
    return out.select("execution_id", r6("elapsed_seconds").alias("elapsed_seconds"), r6("persisted_requests_per_second").alias("persisted_requests_per_second"), "requests_observed", "attempts_total", "retry_attempts", "terminal_error_attempts", r6("attempts_per_request").alias("attempts_per_request"))


TOKENS = "SELECT user_id AS execution_id, event_id % 400 AS request_key, CASE WHEN event_type = 'signup' THEN 'judge' ELSE 'target' END AS phase, CASE WHEN event_type = 'click' THEN 'success' ELSE event_type END AS outcome, CASE WHEN event_id % 5 <> 0 THEN event_id % 977 END AS input_tokens, CASE WHEN event_id % 6 <> 0 THEN event_id % 131 END AS cached_input_tokens, CASE WHEN event_id % 7 <> 0 THEN event_id % 613 END AS output_tokens, CASE WHEN event_type <> 'view' THEN event_id % 59 END AS reasoning_tokens, CASE WHEN event_type = 'purchase' THEN 'stop' END AS finish_reason, CASE WHEN event_id % 11 = 0 THEN 'r' END AS response_id, CAST(NULL AS DOUBLE) AS first_event_ms, CASE WHEN event_type = 'error' THEN 500 WHEN event_id % 2 = 0 THEN 200 END AS http_status FROM {events}"
PARENTS = "SELECT o_custkey AS latest_execution_id, 'target' AS phase, CASE WHEN o_orderstatus = 'F' THEN 'ok' ELSE 'failed' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'stop' END AS finish_reason, o_orderkey % 501 AS input_tokens, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 77 END AS cached_input_tokens, o_orderkey % 301 AS output_tokens, CAST(NULL AS BIGINT) AS reasoning_tokens FROM {orders}"


def usage_cost(spark, d):
    out = usage.usage_summary(sql(spark, d, TOKENS), sql(spark, d, PARENTS), PRICES, ["phase"])
    return out.withColumns({c: r6(c) for c in ("usage_coverage", "cache_breakdown_coverage", "reasoning_token_coverage", "estimated_cost_usd")})


def status_counts(spark, d):
    return base(spark, d, "attempts").groupBy("phase", "outcome").agg(F.count("*").alias("n"))


def metadata_extract(spark, d):
    rows = base(spark, d, "attempts")
    return rows.groupBy("execution_id").agg(r6(F.avg(usage.metadata_number("props", "$.missing", "$.k"))).alias("mean_ms"), usage.sorted_set("outcome").alias("outcomes"))


def profile_sets(spark, d):
    """Requests that succeeded in an execution on record: the sets of their settings."""
    a = base(spark, d, "attempts")
    known = executions(spark, d).filter("failure_count > 0")
    linked = relations.present_in(a.filter("outcome = 'success'"), known, ["execution_id"])
    return linked.groupBy("phase").agg(F.count("*").alias("n"), F.countDistinct("execution_id").alias("executions"), usage.sorted_set("attempt_index", "unknown").alias("attempt_indexes"))


def request_latency(spark, d):
    rows = base(spark, d, "attempts").withColumn("backoff_ms", usage.metadata_number("props", "$.k"))
    out = usage.request_latency(rows)
    return out.select("execution_id", "request_key", r6("service_latency_ms").alias("service_latency_ms"), r6("backoff_ms").alias("backoff_ms"), "attempts")


def retry_rules(spark, d):
    rows = sql(spark, d, "SELECT event_id, CASE WHEN event_type = 'error' THEN 400 + CAST(event_id % 130 AS INT) END AS http_status, CASE event_id % 4 WHEN 0 THEN 'RateLimitError' WHEN 1 THEN 'ValueError' END AS error_type, CASE event_type WHEN 'view' THEN 'incomplete' WHEN 'click' THEN 'failed' WHEN 'signup' THEN NULL ELSE 'completed' END AS status, CASE WHEN event_id % 3 = 0 THEN 'max_output_tokens' END AS reason, CAST(event_id % 9 + 1 AS INT) AS attempt FROM {events}")
    return rows.select("event_id", usage.retryable(F.col("http_status"), F.col("error_type")).alias("retryable"), usage.finish_status(F.col("status"), F.col("reason")).alias("finish_reason"), usage.backoff_seconds(F.col("attempt"), F.lit(0.0)).alias("backoff_s"), usage.retry_cap(F.col("attempt") * 1024, F.lit(8192)).alias("next_cap"))


def first_token(spark, d):
    rows = sql(spark, d, "SELECT user_id AS request, value AS ms, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE ' ' END AS text FROM {events}")
    return usage.first_token(rows, ["request"]).withColumns({c: r6(c) for c in ("first_event_ms", "ttft_ms", "time_after_first_token_ms")})


def latest_success(spark, d):
    return logs.latest(base(spark, d, "attempts"), ["request_key"], [F.col("ts"), F.col("event_id")], F.col("outcome") == "success").select("request_key", "event_id", "request_wall_ms")


def current_view_upsert(spark, d):
    log = base(spark, d, "attempts").withColumn("server_ms", F.when(F.col("event_id") % 3 == 0, usage.metadata_number("props", "$.k")))
    return logs.current_view(log, ["request_key"], ["ts", "event_id"], ["outcome", "execution_id"], ["server_ms"], "event_id").withColumnRenamed("event_id", "created_event")


def incremental_view(spark, d):
    """The current view, kept up by three batches that together are the log, neither in order nor each once."""
    log = base(spark, d, "attempts").withColumn("server_ms", F.when(F.col("event_id") % 3 == 0, usage.metadata_number("props", "$.k")))
    view = snapshots.View(("request_key",), ("ts", "event_id"), ("outcome", "execution_id"), ("server_ms",), "event_id")
    path = work_path(spark, "incremental-view")
    for outcome in ("success", "retry", "terminal_error", "retry"):
        snapshots.apply_batch(log.filter(F.col("outcome") == outcome), path, view, 16)
    return snapshots.current(spark, path, view, log).withColumnRenamed("event_id", "created_event")


def patched_attempts(spark, d):
    a = base(spark, d, "attempts").select("event_id", "execution_id", "request_wall_ms")
    late = a.filter("event_id % 4 = 0").select("event_id", (F.col("request_wall_ms") * 2).alias("request_wall_ms"))
    return logs.patched(a, late, ["event_id"], ["request_wall_ms"]).withColumn("request_wall_ms", r6("request_wall_ms"))


def run_identity(spark, d):
    return logs.identity_conflicts(base(spark, d, "attempts"), "execution_id", "outcome")


def run_status(spark, d):
    a = base(spark, d, "attempts").withColumn("status", F.when(F.col("outcome") == "success", "ok"))
    want = a.select("execution_id").distinct().withColumn("expected", F.lit(40))
    return logs.run_status(want, a, "execution_id")


def lifecycle(spark, d):
    rows = base(spark, d, "attempts").withColumn("kind", F.when(F.col("request_key") % 7 == 5, None).when(F.col("outcome") == "success", "start").when((F.col("outcome") == "terminal_error") & (F.col("request_key") % 3 == 0), "finish"))
    return logs.lifecycle(rows, "request_key", "kind", "event_id")


def numbered_attempts(spark, d):
    return logs.numbered_attempts(base(spark, d, "attempts").select("event_id", "request_key", "ts"), ["request_key"], [F.col("ts"), F.col("event_id")]).select("event_id", F.col("attempt").cast("long").alias("attempt"))


def pareto_frontier(spark, d):
    runs = base(spark, d, "attempts").groupBy("execution_id").agg(r6(F.avg("request_wall_ms")).alias("latency"), r6(F.avg((F.col("outcome") == "success").cast("double"))).alias("accuracy"))
    return frontier.pareto(runs, "latency", "accuracy", "execution_id")


def macro_latency(spark, d):
    p = usage.latency_percentiles(base(spark, d, "attempts").withColumn("task_type", F.when(F.col("event_id") % 2 == 0, "qa").otherwise("conv")).withColumn("ms", F.when((F.col("execution_id") % 5 != 0) | (F.col("event_id") % 50 != 0), F.col("request_wall_ms"))), ["execution_id", "task_type"], ["ms"])
    out = frontier.macro(p, "execution_id", "task_type", "p95_ms", ["qa", "conv"], F.col("coverage") == 1)
    return out.withColumn("macro_p95_ms", r6("macro_p95_ms"))


def profile_singletons(spark, d):
    rows = base(spark, d, "attempts").withColumns({"streaming": F.when(F.col("execution_id") % 3 == 0, F.col("event_id") % 2), "concurrency": F.col("execution_id") % 5})
    return frontier.singleton_profiles(rows, "execution_id", ["streaming", "concurrency", "phase"])


QUERIES = {f.__name__: f for f in (latency_percentiles, execution_summary, usage_cost, status_counts, metadata_extract, profile_sets, request_latency, retry_rules, first_token, latest_success, current_view_upsert, incremental_view, patched_attempts, run_identity, run_status, lifecycle, numbered_attempts, pareto_frontier, macro_latency, profile_singletons)}

_P = "round(quantile_cont(v, {q}), 6) AS p{n}_ms"
PCT = ", ".join(_P.format(q=q, n=n) for q, n in ((0.5, 50), (0.9, 90), (0.95, 95), (0.99, 99)))
EXEC = "x AS (SELECT execution_id, min(ts) AS s, max(ts) AS e, count(*) FILTER (outcome = 'success') AS ok, count(*) FILTER (outcome = 'terminal_error') AS bad FROM attempts GROUP BY execution_id)"
SQL = {
    "latency_percentiles": with_base(["attempts"], f", l AS (SELECT phase, 'request_wall_ms' AS metric, outcome, request_wall_ms AS x FROM attempts UNION ALL SELECT phase, 'server_ms', outcome, try_cast(json_extract_string(props, '$.k') AS DOUBLE) FROM attempts UNION ALL SELECT phase, 'ttft_ms', outcome, NULL FROM attempts), k AS (SELECT phase, metric, outcome, CASE WHEN outcome = 'success' THEN x END AS v FROM l) SELECT phase, metric, count(*) AS n_total, count(*) FILTER (outcome = 'success') AS n_success, count(v) AS n_measured, round(count(v) / nullif(count(*) FILTER (outcome = 'success'), 0), 6) AS coverage, round(avg(v), 6) AS mean_ms, {PCT}, round(min(v), 6) AS min_ms, round(max(v), 6) AS max_ms FROM k GROUP BY ALL"),
    "execution_summary": with_base(["attempts"], f", {EXEC}, t AS (SELECT execution_id, count(DISTINCT request_key) AS rq, count(*) AS n, count(*) FILTER (attempt_index > 1) AS re, count(*) FILTER (outcome = 'terminal_error') AS te FROM (SELECT * REPLACE (CASE WHEN execution_id % 7 <> 0 THEN execution_id END AS execution_id) FROM attempts) GROUP BY execution_id), u AS (SELECT x.execution_id, (epoch_us(e) - epoch_us(s)) / 1e6 AS sec, ok, bad, coalesce(rq, 0) AS rq, coalesce(n, 0) AS n, coalesce(re, 0) AS re, coalesce(te, 0) AS te FROM x LEFT JOIN t USING (execution_id)) SELECT execution_id, round(sec, 6) AS elapsed_seconds, CASE WHEN sec > 0 THEN round((ok + bad) / sec, 6) END AS persisted_requests_per_second, rq AS requests_observed, n AS attempts_total, re AS retry_attempts, te AS terminal_error_attempts, round(n / nullif(rq, 0), 6) AS attempts_per_request FROM u"),
    "usage_cost": f"WITH a AS ({TOKENS.format(events='events')}), p AS ({PARENTS.format(orders='orders')}), " + """u AS (SELECT phase, input_tokens, cached_input_tokens, output_tokens, reasoning_tokens, 1 AS t, (finish_reason IS NOT NULL OR response_id IS NOT NULL OR first_event_ms IS NOT NULL OR coalesce(http_status BETWEEN 200 AND 299, false) OR coalesce(outcome IN ('success', 'retry_length'), false)) AS w FROM a
UNION ALL SELECT phase, input_tokens, cached_input_tokens, output_tokens, reasoning_tokens, 0, (status = 'ok' OR finish_reason IS NOT NULL) FROM p WHERE latest_execution_id NOT IN (SELECT execution_id FROM a)),
g AS (SELECT phase, CAST(sum(t) AS BIGINT) AS attempts_tracked, CAST(sum(1 - t) AS BIGINT) AS legacy_parent_records, count(*) FILTER (w) AS usage_records_expected, count(*) FILTER (w AND input_tokens IS NOT NULL AND output_tokens IS NOT NULL AND cached_input_tokens IS NOT NULL) AS usage_records_complete, count(*) FILTER (w AND input_tokens IS NOT NULL AND output_tokens IS NOT NULL) AS b, count(*) FILTER (w AND cached_input_tokens IS NOT NULL) AS c, count(*) FILTER (w AND reasoning_tokens IS NOT NULL) AS r, CAST(sum(coalesce(input_tokens, 0)) AS BIGINT) AS input_tokens, CAST(sum(coalesce(cached_input_tokens, 0)) AS BIGINT) AS cached_input_tokens, CAST(sum(coalesce(output_tokens, 0)) AS BIGINT) AS output_tokens, CAST(sum(coalesce(reasoning_tokens, 0)) AS BIGINT) AS reasoning_tokens_observed FROM u GROUP BY phase)
SELECT phase, attempts_tracked, legacy_parent_records, usage_records_expected, usage_records_complete, input_tokens, cached_input_tokens, output_tokens, reasoning_tokens_observed, usage_records_expected - b AS missing_usage_records, usage_records_expected - c AS missing_cache_breakdown_records, round(b / nullif(usage_records_expected, 0), 6) AS usage_coverage, round(c / nullif(usage_records_expected, 0), 6) AS cache_breakdown_coverage, round(r / nullif(usage_records_expected, 0), 6) AS reasoning_token_coverage, CASE WHEN r = usage_records_expected AND r > 0 THEN reasoning_tokens_observed END AS reasoning_tokens, CASE WHEN usage_records_complete = usage_records_expected THEN 'complete' ELSE 'partial_missing_usage_or_cache_breakdown' END AS cost_completeness, round((greatest(input_tokens - cached_input_tokens, 0) * 0.25::DOUBLE + cached_input_tokens * 0.025::DOUBLE + output_tokens * 2.0::DOUBLE) / 1000000, 6) AS estimated_cost_usd FROM g""",
    "status_counts": with_base(["attempts"], "SELECT phase, outcome, count(*) AS n FROM attempts GROUP BY ALL"),
    "metadata_extract": with_base(["attempts"], "SELECT execution_id, round(avg(try_cast(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS mean_ms, array_to_string(list_sort(list(DISTINCT outcome)), ',') AS outcomes FROM attempts GROUP BY execution_id"),
    "profile_sets": with_base(["attempts"], f", {EXEC} SELECT phase, count(*) AS n, count(DISTINCT execution_id) AS executions, array_to_string(list_sort(list(DISTINCT CAST(attempt_index AS VARCHAR))), ',') AS attempt_indexes FROM attempts WHERE outcome = 'success' AND execution_id IN (SELECT execution_id FROM x WHERE bad > 0) GROUP BY phase"),
    "request_latency": with_base(["attempts"], ", b AS (SELECT *, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM attempts) SELECT execution_id, request_key, round(sum(request_wall_ms + coalesce(k, 0)), 6) AS service_latency_ms, round(sum(coalesce(k, 0)), 6) AS backoff_ms, count(*) AS attempts FROM b GROUP BY ALL"),
    "retry_rules": "WITH r AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 400 + CAST(event_id % 130 AS INT) END AS h, event_id % 4 AS e, CASE event_type WHEN 'view' THEN 'incomplete' WHEN 'click' THEN 'failed' WHEN 'signup' THEN NULL ELSE 'completed' END AS s, CASE WHEN event_id % 3 = 0 THEN 'max_output_tokens' END AS reason, CAST(event_id % 9 + 1 AS INT) AS attempt FROM events) SELECT event_id, coalesce(h IN (408, 409, 429) OR h >= 500, false) OR e = 0 AS retryable, CASE WHEN s = 'incomplete' AND reason IS NOT NULL THEN 'length' WHEN s IN ('incomplete', 'failed') THEN 'error' ELSE coalesce(s, 'unknown') END AS finish_reason, least(60.0::DOUBLE, power(2.0, attempt - 1)) AS backoff_s, CAST(least(attempt * 2048, 8192) AS INT) AS next_cap FROM r",
    "first_token": "SELECT user_id AS request, round(min(value), 6) AS first_event_ms, round(min(value) FILTER (event_type IN ('click', 'view')), 6) AS ttft_ms, round(max(value) - min(value) FILTER (event_type IN ('click', 'view')), 6) AS time_after_first_token_ms FROM events GROUP BY user_id",
    "latest_success": with_base(["attempts"], "SELECT request_key, event_id, request_wall_ms FROM attempts WHERE outcome = 'success' QUALIFY row_number() OVER (PARTITION BY request_key ORDER BY ts DESC, event_id DESC) = 1"),
    "current_view_upsert": with_base(["attempts"], ", b AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN try_cast(json_extract_string(props, '$.k') AS DOUBLE) END AS k FROM attempts) SELECT request_key, arg_max(outcome, (ts, event_id)) AS outcome, arg_max(execution_id, (ts, event_id)) AS execution_id, arg_max(k, (ts, event_id)) FILTER (k IS NOT NULL) AS server_ms, arg_min(event_id, (ts, event_id)) AS created_event FROM b GROUP BY request_key"),
    "patched_attempts": with_base(["attempts"], "SELECT event_id, execution_id, round(CASE WHEN event_id % 4 = 0 THEN request_wall_ms * 2 ELSE request_wall_ms END, 6) AS request_wall_ms FROM attempts"),
    "run_identity": with_base(["attempts"], "SELECT execution_id, count(DISTINCT outcome) AS fingerprints FROM attempts GROUP BY execution_id HAVING count(DISTINCT outcome) > 1"),
    "run_status": with_base(["attempts"], "SELECT execution_id, CAST(40 AS INT) AS expected, count(*) FILTER (outcome = 'success') AS ok, CASE WHEN count(*) FILTER (outcome = 'success') >= 40 THEN 'complete' WHEN count(*) FILTER (outcome = 'success') > 0 THEN 'partial' ELSE 'pending' END AS status FROM attempts GROUP BY execution_id"),
    "lifecycle": with_base(["attempts"], ", k AS (SELECT request_key, event_id, CASE WHEN request_key % 7 = 5 THEN NULL WHEN outcome = 'success' THEN 'start' WHEN outcome = 'terminal_error' AND request_key % 3 = 0 THEN 'finish' END AS kind FROM attempts) SELECT request_key, min(event_id) FILTER (kind = 'start') AS started_at, max(event_id) FILTER (kind = 'finish') AS ended_at, CASE WHEN count(*) FILTER (kind = 'finish') > 0 THEN 'finished' WHEN count(*) FILTER (kind = 'start') > 0 THEN 'running' ELSE 'unknown' END AS status FROM k GROUP BY request_key"),
    "numbered_attempts": with_base(["attempts"], "SELECT event_id, row_number() OVER (PARTITION BY request_key ORDER BY ts, event_id) AS attempt FROM attempts"),
    "pareto_frontier": with_base(["attempts"], ", r AS (SELECT execution_id, round(avg(request_wall_ms), 6) AS latency, round(avg(CASE WHEN outcome = 'success' THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM attempts GROUP BY execution_id) SELECT execution_id, latency, accuracy FROM r QUALIFY accuracy > coalesce(max(accuracy) OVER (ORDER BY latency, accuracy DESC, execution_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1)"),
    "macro_latency": with_base(["attempts"], ", b AS (SELECT execution_id, event_id % 2 AS t, CASE WHEN execution_id % 5 <> 0 OR event_id % 50 <> 0 THEN request_wall_ms END AS v FROM attempts), p AS (SELECT execution_id, t, quantile_cont(v, 0.95) AS p, count(v) = count(*) AS whole FROM b GROUP BY ALL) SELECT execution_id, CASE WHEN count(*) FILTER (whole) = 2 THEN round(avg(p), 6) END AS macro_p95_ms FROM p GROUP BY execution_id"),
    "profile_singletons": with_base(["attempts"], ", b AS (SELECT execution_id, phase, CASE WHEN execution_id % 3 = 0 THEN event_id % 2 END AS streaming FROM attempts), c AS (SELECT execution_id, count(DISTINCT coalesce(streaming, -1)) AS s, count(DISTINCT phase) AS p FROM b GROUP BY execution_id) SELECT execution_id, 'streaming' AS field, s AS n FROM c WHERE s <> 1 UNION ALL SELECT execution_id, 'phase', p FROM c WHERE p <> 1"),
}
SQL["incremental_view"] = SQL["current_view_upsert"]

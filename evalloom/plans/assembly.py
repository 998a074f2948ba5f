"""Queries of benchmark building, seed cards, screening results, costs and stores, each with its SQL."""

from __future__ import annotations

import json
import math

from pyspark.sql import functions as F

from evalloom.functions import findings, rules, spans
from evalloom.functions import text as T
from evalloom.operators import benchmark, frontier, logs, relations, replay, schema_check, screen, snapshots, usage
from evalloom.plans.base import base, plain, sql, stored, with_base
from evalloom.plans.cases import ACTIONS, STEPS, cards
from evalloom.session import work_path
from evalloom.sources import files
from evalloom.streaming import attempts as live


def r6(c):
    return F.round(c, 6)


# --- selection and routing

TAGGED = "SELECT doc_id, lang, source, CASE WHEN doc_id % 2 = 0 THEN 'theme:emergency_referrals' ELSE 'theme:other' END AS theme, CASE doc_id % 5 WHEN 0 THEN 'emergent' WHEN 1 THEN 'conditionally-emergent' WHEN 2 THEN 'non-emergent' WHEN 3 THEN 'unheard-of' END AS category FROM {documents}"


def tagged(spark, d):
    tag = F.concat(F.lit("physician_agreed_category:"), F.col("category"))
    return sql(spark, d, TAGGED).withColumn("tags", F.filter(F.array(F.concat(F.lit("lang:"), "lang"), "theme", tag, F.lit("physician_agreed_category:late")), lambda t: t.isNotNull()))


def tag_category(spark, d):
    return tagged(spark, d).select("doc_id", F.array_contains("tags", benchmark.THEME).alias("emergency"), T.first_with_prefix(F.col("tags"), benchmark.CATEGORY_PREFIX).alias("category"))


def category_router(spark, d):
    good, bad = benchmark.categorised(tagged(spark, d), "tags")
    return good.select("doc_id", "category", "mapped_label").unionByName(bad.select("doc_id", "category", F.lit("unexpected").alias("mapped_label")))


VARIANTS = "SELECT l_orderkey AS case_num, l_linenumber AS variant_num, CASE l_partkey % 8 WHEN 0 THEN 'A' WHEN 1 THEN 'A/B' WHEN 2 THEN 'B' WHEN 3 THEN 'B/C' WHEN 4 THEN 'C' WHEN 5 THEN 'C/D' WHEN 6 THEN 'D' ELSE 'E' END AS gold_triage FROM {lineitem}"


def first_variant(spark, d):
    good, bad = benchmark.first_variants(sql(spark, d, VARIANTS), "variant_num", "gold_triage")
    return good.unionByName(bad).groupBy("gold_triage", "normalized_label", "is_edge_case").agg(F.count("*").alias("n"))


EXCLUDED = [r"(?i)https?://|www\.", r"(?i)\b[\w.+-]+@[\w.-]+\.[a-z]{2,}\b", r"(?i)\breleased under\b"]


def usable_texts(spark, d):
    return stored(spark, d, "documents").select("doc_id", T.usable_length(F.col("text"), 120, 4000, EXCLUDED).alias("usable"))


def numbered_ids(spark, d):
    rows = sql(spark, d, "SELECT item_id, text FROM {benchmark}")
    return rows.select("item_id", T.numbered_id(F.concat(F.lit(" "), F.col("text"), F.lit("\n"), F.lit("x ")), F.col("item_id")).alias("source_id"))


DIRECT = "SELECT o_orderkey AS ordinal, 'orders' AS dataset, CAST(o_orderkey AS STRING) AS source_id, o_orderpriority AS text, CASE o_orderstatus WHEN 'F' THEN 'D' WHEN 'O' THEN 'A' END AS normalized_label, 'direct' AS mapping_method FROM {orders}"
SURVEYED = "SELECT l_orderkey AS ordinal, 'lines' AS dataset, CAST(l_orderkey AS STRING) AS source_id, CASE WHEN l_quantity > 10 THEN 'B' END AS normalized_label, CASE WHEN l_quantity > 30 THEN 'median' ELSE 'excluded_disagreement' END AS mapping_method FROM {lineitem} WHERE l_linenumber = 1"
RAW = "SELECT 'lines' AS dataset, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey AS STRING) END AS source_id, o_orderpriority AS text FROM {orders}"


def assembled_benchmark(spark, d):
    out, checks = benchmark.assembled([sql(spark, d, DIRECT)], sql(spark, d, SURVEYED), sql(spark, d, RAW), ["dataset", "source_id"], ["dataset", "source_id", "text", "normalized_label", "mapping_method"])
    lost = checks["survey rows without a source"].select("dataset", "source_id", F.lit("").alias("text"), "normalized_label", F.lit("lost").alias("mapping_method"), F.lit("none").alias("split"), F.lit(-1).cast("long").alias("block"), "ordinal")
    return out.select("dataset", "source_id", "text", "normalized_label", "mapping_method", "split", F.col("position._block").cast("long").alias("block"), F.col("position.ordinal").alias("ordinal")).unionByName(lost)


TEMPLATE = "Note: {{CONVERSATION_NOTE}}|{{CASE}}|end"


def prompt_pair(spark, d):
    rows = sql(spark, d, "SELECT p_partkey, p_name, p_size FROM {part}")
    return benchmark.prompts(rows, "p_name", F.col("p_size") % 2 == 0, TEMPLATE, "a chat").select("p_partkey", F.get_json_object("conversational_prompt", "$[0].role").alias("role"), F.get_json_object("conversational_prompt", "$[0].content").alias("content"), "qa_prompt")


def judge_prompt(spark, d):
    """Placeholders are replaced one after another: a value may hold a later one."""
    rows = sql(spark, d, "SELECT p_partkey, p_name, p_type FROM {part}")
    return rows.select("p_partkey", T.filled(F.lit("A {{X}} B {{Y}}"), {"{{X}}": F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit("{{Y}}"))), "{{Y}}": F.col("p_type")}).alias("prompt"))


def label_bases(spark, d):
    rows = sql(spark, d, "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'median' ELSE 'direct' END AS method, CASE c_custkey % 2 WHEN 0 THEN 'healthbench' ELSE 'other' END AS dataset, CASE c_nationkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END AS gold FROM {customer}")
    return rows.select("c_custkey", T.label_basis(F.col("method"), F.col("dataset")).alias("basis"), F.array_join(T.unsafe_labels(F.col("gold")), "").alias("unsafe"))


PANEL = "SELECT case_id, max(CASE WHEN slot = 1 THEN vote END) AS v1, max(CASE WHEN slot = 2 THEN vote END) AS v2, max(CASE WHEN slot = 3 THEN vote END) AS v3 FROM ({votes}) t GROUP BY case_id HAVING count(*) >= 3"


def panel_votes(spark, d):
    return base(spark, d, "votes").filter("slot <= 3").groupBy("case_id").agg(*[F.max(F.when(F.col("slot") == k, F.col("vote"))).alias(f"v{k}") for k in (1, 2, 3)]).filter("v1 IS NOT NULL AND v2 IS NOT NULL AND v3 IS NOT NULL").withColumn("votes", F.array("v1", "v2", "v3"))


def panel_audit(spark, d):
    """Rows released as three removals: where the votes say otherwise, the audit tells."""
    rows = panel_votes(spark, d).withColumns({"raters": F.array(F.lit("r1"), F.when(F.col("case_id") % 5 == 0, "r1").otherwise("r2"), F.when(F.col("case_id") % 7 != 0, "r3")), "remove_votes": F.when(F.col("case_id") % 3 == 0, 3).otherwise(F.size(F.filter("votes", lambda v: v == "Remove"))), "mapping_method": F.lit("excluded_review"), "normalized_label": F.lit(None).cast("string")})
    rows = rows.withColumn("avg_sd", benchmark.panel("votes")["avg_distance"] + F.when(F.col("case_id") % 4 == 0, 0.5).otherwise(0.0))
    return benchmark.audit_panel(rows, "votes", "raters", "case_id")


def rater_names(spark, d):
    rows = sql(spark, d, "SELECT s_suppkey, concat('r', CAST(s_nationkey AS STRING)) AS r1, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE concat('r', CAST(s_suppkey % 40 AS STRING)) END AS r2 FROM {supplier}")
    return benchmark.raters(rows, ["r1", "r2"])


CARDS = "SELECT o_orderkey AS case_id, o_orderpriority AS label, c_mktsegment AS source, o_orderstatus AS basis FROM {orders} JOIN {customer} ON o_custkey = c_custkey"


def card_counts(spark, d):
    return benchmark.card_counts(sql(spark, d, CARDS), {"label": ["label"], "source": ["source"], "label_source": ["label", "source"], "basis": ["basis"]})


def bundle_counts(spark, d):
    return benchmark.bundle_counts(sql(spark, d, "SELECT l_partkey AS family, l_suppkey AS source, l_returnflag AS split, l_linestatus AS label FROM {lineitem}"), "family", "source", "split", "label")


def card_drift(spark, d):
    seen = sql(spark, d, "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE o_orderstatus END AS label, o_orderpriority AS text FROM {orders}")
    rows = sql(spark, d, "SELECT CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey END AS k, o_orderstatus AS normalized_label, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS normalized_text FROM {orders}")
    return benchmark.drift(seen, rows, ["k"], {"label": "normalized_label", "text": "normalized_text"})


# --- text rules

# Parts that sentences are made of: what stands before a finding (does it leave it said?), the finding, what follows.
LEADS = [("", True), ("I have no ", False), ("It began with ", True), ("No fever, but there is ", True), ("They didn't say whether there is any ", False), ("We are worried about ", False), ("HE DENIES ", False), ("He was never ill; now ", True)]
FOUND = [("breathing", "shortness of breath"), ("chest_pain", "chest tightness"), ("consciousness", "fainting"), ("neurologic", "slurred speech"), ("bleeding", "profuse bleeding"), ("sepsis", "shaking chills"), ("dehydration", "dehydration"), ("anaphylaxis", "tongue swelling"), ("mental_health", "self-harm")]
TAILS = [(".", True), (" is absent.", False), (" since noon!", True)]
# Who opens, and how age and sex are told.
WHO = [("I have chest pain.", "patient"), ("My mother has chest pain.", "caregiver"), ("One of my patients has chest pain.", "clinician"), ("What is recommended?", "patient"), ("Thomas had a fit.", "caregiver"), ("I feel dizzy. My sister is here.", "patient")]
AGED = [("", None, "unknown"), ("34 F here.", 34, "female"), ("male, then male 61.", 61, "male"), ("Age: 70.", 70, "unknown"), ("Sex: female.", None, "female"), ("I am a man.", None, "male"), ("150 m.", None, "unknown")]


def _quoted(v) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def _picked(key: str, values: list) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {_quoted(v)}" for i, v in enumerate(values)) + " END"


def _chosen(key: str, values: list):
    return F.get(F.array(*[F.lit(v) for v in values]), F.expr(f"CAST({key} % {len(values)} AS INT)"))


def _nth(*before: list) -> str:
    """A key that runs through a list while those before it run through theirs."""
    return "doc_id" if not before else f"CAST(floor(doc_id / {math.prod(map(len, before))}) AS BIGINT)"


def _said(spark, d, findings_: list[str], *before: list):
    """Whole documents as fragments, each with a sentence more at its end."""
    parts = [_chosen(_nth(), [x for x, _ in LEADS]), _chosen(_nth(LEADS), findings_), _chosen(_nth(LEADS, findings_), [x for x, _ in TAILS])]
    return stored(spark, d, "documents").withColumn("t", F.concat(T.segments(F.coalesce("text", F.lit(""))), F.array(F.concat(*parts))))


def asserted_findings(spark, d):
    breath = ["shortness of breath", "wheezing"]
    return _said(spark, d, breath).select("doc_id", F.exists("t", lambda f: spans.asserted(findings.FLAGS["breathing"], f)).alias("found"))


def red_flags(spark, d):
    """The flag that each document's sentence is about, and all that its text raises."""
    rows = _said(spark, d, [t for _, t in FOUND]).withColumn("flag", _chosen(_nth(LEADS), [f for f, _ in FOUND]))
    rows = rows.select("doc_id", "flag", findings.flaggable(F.col("t")).alias("asked")).select("doc_id", "flag", findings.red_flags_of(F.col("asked")).alias("all"))
    return rows.select("doc_id", "flag", F.array_contains("all", F.col("flag")).alias("found"), F.array_join("all", ",").alias("raised"))


def speaker_profiles(spark, d):
    opening = F.concat(_chosen(_nth(), [x for x, _ in WHO]), F.lit(" "), _chosen(_nth(WHO), [x for x, _, _ in AGED]))
    rows = stored(spark, d, "documents").select("doc_id", opening.alias("opening"), F.concat(opening, F.lit(" "), F.coalesce("text", F.lit(""))).alias("t"))
    return rows.select("doc_id", findings.speaker_profile(F.col("t"), F.col("opening")).alias("p")).select("doc_id", F.col("p.age").cast("long").alias("age"), "p.sex", "p.speaker_role")


REASONED = "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, concat(CASE WHEN l_linenumber % 3 = 0 THEN 'no such part' ELSE concat('reasoning - because ', l_returnflag, chr(10), ' of it  ') END, chr(10), 'ACUITY: B') AS answer FROM {lineitem}"


def reasoning_extract(spark, d):
    return sql(spark, d, REASONED).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", T.answer_reasoning(F.col("answer")).alias("reasoning"))


def object_extract(spark, d):
    """JSON in fences, in prose, after a brace that begins nothing, and not at all."""
    q = F.col("p_partkey").cast("string")
    obj = F.concat(F.lit('{"b": '), q, F.lit(', "a": "x}"}'))
    fence = F.lit("```")
    texts = F.when(F.col("p_partkey") % 4 == 0, F.concat(fence, F.lit("json\n"), obj, F.lit("\n"), fence)).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("so: "), obj, F.lit(" ok"))).when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("{no "), obj)).otherwise("nothing {")
    return sql(spark, d, "SELECT p_partkey FROM {part}").select("p_partkey", rules.object_text(texts).alias("found"))


def tidied_text(spark, d):
    return stored(spark, d, "documents").select("doc_id", rules.tidy(F.concat(F.lit(" ﬁne \r\n\r\n\r"), F.col("text"), F.lit(" \t x "))).alias("t"))


def redacted_errors(spark, d):
    rows = sql(spark, d, "SELECT p_partkey, concat('key ', p_type, ' was refused: ', p_type) AS message, CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END AS secret FROM {part}")
    return rows.select("p_partkey", T.redacted(F.col("message"), F.col("secret"), 40).alias("message"))


def fingerprints(spark, d):
    rows = sql(spark, d, "SELECT o_orderkey, o_orderstatus AS model, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS judge_id FROM {orders}")
    return rows.select("o_orderkey", T.fingerprint({"model": F.col("model"), "judge_id": F.col("judge_id"), "n": F.col("o_orderkey")}).alias("request_key"))


def axis_texts(spark, d):
    v = F.col("p_size") * F.when(F.col("p_partkey") % 3 == 0, 0.01).when(F.col("p_partkey") % 3 == 1, 125.5).otherwise(1000.0)
    rows = sql(spark, d, "SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size FROM {part}").withColumn("v", v)
    return rows.select("p_partkey", r6(T.nice_step(F.col("v"))).alias("step"), T.money_text(F.floor("v").cast("double")).alias("cost"), T.duration_text(F.floor("v").cast("double") + F.when(F.col("p_partkey") % 2 == 0, 0.5).otherwise(0.0)).alias("seconds"))


# --- joins, screens and replay


def judged_samples(spark, d):
    """Samples with their judgment, those without one included."""
    judged = base(spark, d, "samples").filter("sample_idx <= 3").select("case_id", "sample_idx", F.col("label").alias("judged"))
    out = base(spark, d, "samples").join(judged, ["case_id", "sample_idx"], "left")
    return out.groupBy("task_type", "sample_idx").agg(F.count("*").alias("n"), F.count("judged").alias("n_judged"))


def accepted_candidates(spark, d):
    q = lambda text: sql(spark, d, text)
    requests = q("SELECT o_orderkey AS case_id, o_orderstatus AS intended_label, o_orderpriority AS presentation_group FROM {orders}")
    made = q("SELECT CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey END AS case_id, CASE WHEN o_orderkey % 7 = 0 THEN 'Z' ELSE o_orderstatus END AS gen_label, CASE WHEN o_orderkey % 11 = 0 THEN 'none' ELSE o_orderpriority END AS gen_group FROM {orders}")
    labels = q("SELECT l_orderkey AS case_id, l_linestatus AS label, l_linenumber = 2 AND l_orderkey % 3 = 0 AS ambiguous FROM {lineitem} WHERE l_linenumber <= 2")
    blocked = q("SELECT CASE WHEN o_orderkey % 13 = 0 THEN o_orderkey END AS case_id FROM {orders}").withColumn("reasons", F.array(F.lit("exact_benchmark_match")))
    out = screen.acceptance(requests, made, labels, blocked, 2)
    return out.select("case_id", "accepted", F.array_join("reasons", ",").alias("reasons"))


def self_near_duplicates(spark, d):
    """Held-out texts and openings, each against those of smaller key."""
    a = sql(spark, d, "SELECT item_id AS k, text FROM {benchmark} UNION ALL SELECT item_id + 1000000, concat(text, ' more') FROM {benchmark}")
    return screen.near_duplicates(screen.prepared(a, "k", "text"), 0.82, 0.65)


def trace_answers(spark, d):
    out = replay.answers(replay.steps(sql(spark, d, ACTIONS)), cards(spark, d))
    return out.select("case_id", "seq", "question_id", F.col("question_number").cast("long").alias("question_number"), "repeated", "answer", "fact_status")


def wrong_cards(spark, d):
    rows = cards(spark, d).withColumns({"facts": F.when(F.col("case_id") % 5 == 0, F.concat("facts", F.slice("facts", 1, 1))).otherwise(F.col("facts")), "required_question_ids": F.when(F.col("case_id") % 3 == 0, F.array(F.lit("q9"))).otherwise(F.col("required_question_ids")), "red_flag_question_ids": F.when(F.col("case_id") % 11 == 0, F.array(F.lit("zz"))).otherwise(F.col("red_flag_question_ids")), "unsafe_dispositions": F.when((F.col("case_id") % 7 == 0) & (F.col("gold") != "A"), F.array().cast("array<string>")).otherwise(F.col("unsafe_dispositions"))})
    return replay.card_errors(rows)


def wrong_actions(spark, d):
    """Actions as JSON, every way of being wrong among them."""
    texts = ['{"schema_version":"v1","type":"ASK","question_id":"q1","wording":"why?"}', '{"schema_version":"v1","type":"ASK","question_id":"q9","wording":" "}', '{"schema_version":"v2","type":"DISPOSE","acuity":"E","rationale":"r"}', '{"schema_version":"v1","type":"HANDOFF","reason":7,"target":"human_clinician"}', '{"schema_version":"v1","type":"HANDOFF","reason":"x","target":"nurse","more":1}', "[1]", '{"type":"GO"}', '{"schema_version":"v1","type":"DISPOSE","acuity":"B","rationale":"r"}']
    rows = sql(spark, d, "SELECT o_orderkey FROM {orders}").withColumn("a", _chosen("o_orderkey", texts))
    return replay.action_errors(rows, "o_orderkey", "a", "v1", ["q1", "q2"])


WRONG = [["ok"], ["bad_question_id", "bad_wording"], ["bad_acuity", "wrong_version"], ["bad_reason"], ["bad_target", "wrong_fields"], ["not_an_object"], ["unknown_type", "wrong_version"], ["ok"]]
SCHEMA = {"type": "object", "required": ["id", "tags"], "additionalProperties": False, "properties": {"id": {"type": "integer", "minimum": 1}, "kind": {"enum": ["F", "O"]}, "tags": {"type": "array", "minItems": 1, "uniqueItems": True, "items": {"type": "string", "pattern": "^[a-z]+$"}}}}


def schema_counts(spark, d):
    """How many ways each document breaks the schema."""
    tags = F.when(F.col("o_orderkey") % 3 == 0, '["a","a"]').when(F.col("o_orderkey") % 3 == 1, '["a","B"]').otherwise('["a"]')
    doc = F.concat(F.lit('{"id": '), F.col("o_orderkey").cast("string"), F.lit(', "kind": "'), "o_orderstatus", F.lit('", "tags": '), tags, F.when(F.col("o_orderkey") % 5 == 0, ', "x": 1').otherwise(""), F.lit("}"))
    rows = sql(spark, d, "SELECT o_orderkey, o_orderstatus FROM {orders}").withColumn("doc", doc)
    return schema_check.schema_violations(rows, "o_orderkey", "doc", SCHEMA).select("o_orderkey", F.size("violations").cast("long").alias("n"))


# --- cost, latency and stores


def frontier_table(spark, d):
    a = base(spark, d, "attempts").withColumn("task_type", F.when(F.col("event_id") % 2 == 0, "qa").otherwise("conv"))
    right = (F.col("outcome") == "success").cast("double")
    accuracy = a.groupBy(F.col("execution_id").alias("run_id"), "task_type").agg(F.avg(right).alias("exact"), F.count("*").alias("n_total"), (F.count("*") - F.max((F.col("execution_id") % 4 == 0).cast("int"))).alias("n_evaluable"))
    used = a.groupBy(F.col("execution_id").alias("run_id")).agg(F.sum("request_wall_ms").alias("estimated_cost_usd"), F.count("*").alias("calls")).withColumn("cost_completeness", F.when(F.col("run_id") % 5 == 0, "partial").otherwise("complete"))
    slow = usage.latency_percentiles(a, ["execution_id", "task_type"], ["request_wall_ms"]).withColumnRenamed("execution_id", "run_id")
    out = frontier.frontier_rows(accuracy, used, slow, ["qa", "conv"])
    return out.select("run_id", *[r6(c).alias(c) for c in ("macro_exact", "cost_per_1000", "macro_p95_ms")])


CALLS = "SELECT CASE user_id % 4 WHEN 0 THEN 'm0' WHEN 1 THEN 'm1' WHEN 2 THEN 'm2' END AS model, event_type, event_id % 900 AS input_tokens, event_id % 7 AS cached_input_tokens, event_id % 300 AS output_tokens, value, CASE WHEN event_type = 'click' AND user_id % 4 <> 1 THEN value / 2 END AS ttft_ms FROM {events}"


def provider_usage(spark, d):
    prices = spark.createDataFrame([("m0", 0.25, 0.025, 2.0), ("m1", 2.5, 0.25, 15.0), ("unknown", 1.0, 0.1, 1.0)], "model string, input double, cached double, output double")
    rows = usage.priced(sql(spark, d, CALLS), prices, "model")
    out = usage.provider_summary(rows, "model", F.col("event_type") != "error", ["input_tokens", "cached_input_tokens", "output_tokens"], "estimated_cost_usd", "value", "ttft_ms")
    return out.select(*[r6(c).alias(c) if t == "double" else c for c, t in out.dtypes])


def migrated_rows(spark, d):
    old = sql(spark, d, "SELECT event_id, value AS latency_ms FROM {events}")
    return logs.migrated(old, {"total_duration_ms": "double", "ttft_ms": "double"})


def _kept(spark, name, write):
    path = work_path(spark, name)
    write(path)
    return path


def jsonl_round_trip(spark, d):
    rows = sql(spark, d, "SELECT conv_id, turn, role, text FROM {conversations}")
    path = _kept(spark, "jsonl", lambda p: files.write_jsonl(rows, p))
    return files.read_jsonl(spark, path, rows.schema, nonempty=True)


def csv_round_trip(spark, d):
    rows = sql(spark, d, "SELECT conv_id, turn, role, concat('said \"', role, '\",', chr(10), 'twice') AS text FROM {conversations}")
    path = _kept(spark, "csv", lambda p: files.write_small_csv(rows, p))
    return files.read_csv(spark, path, rows.schema)


def table_round_trip(spark, d):
    rows = sql(spark, d, "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM {orders}")
    path = _kept(spark, "table", lambda p: files.write_table(rows, p, ["o_orderstatus"]))
    return spark.read.schema(rows.schema).parquet(path).filter("o_orderstatus <> 'P'").select("o_orderkey", "o_orderstatus", "o_orderpriority")


def line_set(spark, d):
    rows = sql(spark, d, "SELECT concat('  ', n_name, ' ') AS value FROM {nation} UNION ALL SELECT n_name FROM {nation} UNION ALL SELECT ' ' FROM {region}")
    return files.read_lines(spark, _kept(spark, "lines", lambda p: rows.write.text(p)))


def appended_log(spark, d):
    rows, path = sql(spark, d, "SELECT r_regionkey, r_name FROM {region}"), work_path(spark, "log")
    for _ in range(2):
        files.append_jsonl(rows, path)
    return files.read_jsonl(spark, path, rows.schema)


def written_once(spark, d):
    """Rows as they were written to their end; the second writing of the same rows, in another order, writes nothing."""
    rows, path = sql(spark, d, "SELECT o_orderkey, o_orderstatus FROM {orders}"), work_path(spark, "once")
    files.write_once(rows, path)
    files.write_once(rows.orderBy(F.desc("o_orderkey")), path)
    return files.read_committed(spark, path, rows.schema)


def json_records(spark, d):
    return files.sorted_json(sql(spark, d, "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS b, CASE WHEN o_orderkey % 3 = 0 THEN double('NaN') END AS a FROM {orders}"))


def markdown_table(spark, d):
    text = files.markdown(sql(spark, d, "SELECT r_regionkey, concat(r_name, '|x') AS name FROM {region} ORDER BY r_regionkey"))
    return spark.createDataFrame([(i, line) for i, line in enumerate(text.splitlines())], "line long, text string")


def manifest_counts(spark, d):
    made = json.loads(files.manifest({"policy": files.closed_contract({"seed": 7, "mode": "clear"}, {"seed", "mode"})}, {"statuses": sql(spark, d, "SELECT o_orderstatus AS status, count(*) AS n FROM {orders} GROUP BY o_orderstatus")}))
    return spark.createDataFrame([(r["status"], r["n"], made["policy"]["mode"]) for r in made["statuses"]], "status string, n long, mode string")


CACHED = "SELECT CAST(doc_id AS STRING) AS name, CASE WHEN doc_id % 5 = 0 THEN concat(coalesce(text, ''), 'x') ELSE coalesce(text, '') END AS text FROM {documents} WHERE doc_id % 3 <> 0"
LOCKED = "SELECT CAST(doc_id AS STRING) AS name, coalesce(text, '') AS text FROM {documents}"


def verified_sources(spark, d):
    """A cache that lacks some documents and holds others changed, against a lock of all: sizes and digests, and what is to be done."""
    told = lambda text: sql(spark, d, text).select("name", F.sha2("text", 256).alias("sha256"), F.octet_length("text").alias("bytes"))
    lock, found = told(LOCKED), told(CACHED)
    states = [files.source_states(lock, found, *how).withColumn("how", F.lit(k)) for k, how in (("plain", (False, False)), ("refresh", (True, False)), ("offline", (False, True)))]
    return relations.stacked(*states)


def parameterised(spark, d):
    return files.query(spark, "SELECT o_orderkey, o_orderstatus FROM o WHERE o_orderstatus = :s AND o_orderkey > :k", {"o": stored(spark, d, "orders")}, s="F", k=100)


def action_traces(spark, d):
    """The lines of each order as a trace: written as a list, as an object or by lines."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: F.concat(F.lit('{"n":'), x["l_partkey"].cast("string"), F.lit("}")))
    listed = F.concat(F.lit("["), F.array_join("lines", ","), F.lit("]"))
    how = F.col("trace") % 3
    text = F.when(how == 0, listed).when(how == 1, F.concat(F.lit('{"actions":'), listed, F.lit("}"))).otherwise(F.concat(F.array_join("lines", "\n"), F.lit("\n")))
    traces = sql(spark, d, "SELECT l_orderkey AS trace, l_linenumber, l_partkey FROM {lineitem}").groupBy("trace").agg(lines.alias("lines")).select("trace", text.alias("t"))
    return traces.select("trace", F.posexplode(files.actions_of(F.col("t"))).alias("seq", "action")).select("trace", "seq", F.get_json_object("action", "$.n").cast("long").alias("n"))


def live_attempts(spark, d):
    """The attempt log as a stream, each attempt once, run to its end."""
    log = base(spark, d, "attempts").select("execution_id", "request_key", "attempt_index", F.col("ts").cast("timestamp").alias("ts"))
    log = log.union(log)
    path = _kept(spark, "stream", lambda p: files.write_jsonl(log, p))
    seen = live.attempts(spark, path, log.schema.simpleString()[7:-1].replace(":", " "))
    return live.drained(seen, work_path(spark, "stream-out"), work_path(spark, "stream-state")).select("execution_id", "request_key", "attempt_index")


def live_view(spark, d):
    """The attempt log as a stream that keeps a current view up, run to its end."""
    log = base(spark, d, "attempts").select("request_key", F.col("ts").cast("timestamp").alias("ts"), "event_id", "outcome", "execution_id")
    path, view = _kept(spark, "view-log", lambda p: files.write_jsonl(log, p)), snapshots.View(("request_key",), ("ts", "event_id"), ("outcome", "execution_id"))
    out = work_path(spark, "view")
    seen = spark.readStream.schema(log.schema).json(path)
    live.kept_up(seen, out, view, work_path(spark, "view-state"), 16).awaitTermination()
    return snapshots.current(spark, out, view, log)


QUERIES = {f.__name__: f for f in (tag_category, category_router, first_variant, usable_texts, numbered_ids, assembled_benchmark, prompt_pair, judge_prompt, label_bases, panel_audit, rater_names, card_counts, bundle_counts, card_drift, asserted_findings, red_flags, speaker_profiles, reasoning_extract, object_extract, tidied_text, redacted_errors, fingerprints, axis_texts, judged_samples, accepted_candidates, self_near_duplicates, trace_answers, wrong_cards, wrong_actions, schema_counts, frontier_table, provider_usage, migrated_rows, jsonl_round_trip, csv_round_trip, table_round_trip, line_set, appended_log, written_once, json_records, markdown_table, manifest_counts, verified_sources, parameterised, action_traces, live_attempts, live_view)}

_TAG = plain(TAGGED)
_UNTIL = "CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE 'because ' || l_returnflag || chr(10) || ' of it' END"
_SQUEEZED = "regexp_replace(regexp_replace(regexp_replace(replace({}, chr(0), ''), '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"


def _stripped(e: str) -> str:
    return f"regexp_replace({e}, '^\\s+|\\s+$', '', 'g')"


_NUMBER = "CASE WHEN abs({v}) >= 1000 THEN CAST(CAST(floor({v} / 1000) AS BIGINT) AS VARCHAR) || ',' || lpad(CAST(CAST({v} % 1000 AS BIGINT) AS VARCHAR), 3, '0') ELSE CAST(CAST({v} AS BIGINT) AS VARCHAR) END"
SQL = {
    "tag_category": f"SELECT doc_id, theme = 'theme:emergency_referrals' AS emergency, coalesce(category, 'late') AS category FROM ({_TAG}) t",
    "category_router": f"SELECT doc_id, coalesce(category, 'late') AS category, CASE WHEN category = 'emergent' THEN 'D' WHEN category IS NULL OR category = 'unheard-of' THEN 'unexpected' END AS mapped_label FROM ({_TAG}) t WHERE theme = 'theme:emergency_referrals'",
    "first_variant": f"SELECT gold_triage, CASE WHEN gold_triage <> 'E' THEN replace(gold_triage, '/', '|') END AS normalized_label, contains(gold_triage, '/') AS is_edge_case, count(*) AS n FROM ({plain(VARIANTS)}) t WHERE variant_num = 1 GROUP BY ALL",
    "usable_texts": "SELECT doc_id, coalesce(length(text) BETWEEN 120 AND 4000 AND NOT (" + " OR ".join(f"regexp_matches(text, '{p}')" for p in EXCLUDED) + "), false) AS usable FROM documents",
    "numbered_ids": f"SELECT item_id, {_stripped("' ' || replace(text || chr(10) || 'x ', chr(10), ' ')")} || '_' || item_id AS source_id FROM benchmark",
    "assembled_benchmark": f"WITH d AS ({plain(DIRECT).replace('AS STRING', 'AS VARCHAR')}), s AS ({plain(SURVEYED).replace('AS STRING', 'AS VARCHAR')}), r AS ({plain(RAW).replace('AS STRING', 'AS VARCHAR')}), a AS (SELECT dataset, source_id, text, normalized_label, mapping_method, 0 AS block, ordinal FROM d UNION ALL SELECT dataset, source_id, text, normalized_label, mapping_method, 1, ordinal FROM s JOIN r USING (dataset, source_id)) SELECT dataset, source_id, text, normalized_label, mapping_method, CASE WHEN mapping_method IN ('direct', 'median') THEN 'primary' ELSE 'ambiguous' END AS split, CAST(block AS BIGINT) AS block, ordinal FROM a WHERE normalized_label IS NOT NULL UNION ALL SELECT dataset, source_id, '', normalized_label, 'lost', 'none', -1, ordinal FROM s WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.source_id = s.source_id)",
    "prompt_pair": "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN NULL ELSE 'user' END AS role, CASE WHEN p_size % 2 = 0 THEN NULL ELSE p_name END AS content, 'Note: ' || CASE WHEN p_size % 2 = 0 THEN 'a chat' ELSE '' END || '|' || p_name || '|end' AS qa_prompt FROM part",
    "judge_prompt": "SELECT p_partkey, 'A ' || CASE WHEN p_partkey % 2 = 0 THEN p_name || p_type ELSE '' END || ' B ' || p_type AS prompt FROM part",
    "label_bases": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'released_five_physician_panel_median' WHEN c_custkey % 2 = 0 THEN 'healthbench_physician_agreed_emergent_category' ELSE 'released_direct_source_mapping' END AS basis, CASE c_nationkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'A' WHEN 2 THEN 'AB' ELSE 'ABC' END AS unsafe FROM customer",
    "panel_audit": with_base(["votes"], ", p AS (SELECT case_id, list(vote) FILTER (slot <= 3) AS v FROM votes GROUP BY case_id HAVING count(*) FILTER (slot <= 3) = 3), q AS (SELECT case_id, len(list_filter(v, lambda x: x = 'Remove')) AS r FROM p) SELECT case_id, 'incomplete_panel' AS problem FROM q WHERE case_id % 7 = 0 UNION ALL SELECT case_id, 'repeated_rater' FROM q WHERE case_id % 5 = 0 UNION ALL SELECT case_id, 'remove_votes_differ' FROM q WHERE case_id % 3 = 0 AND r <> 3 UNION ALL SELECT case_id, 'distance_differs' FROM q WHERE case_id % 4 = 0 UNION ALL SELECT case_id, unnest(['routing_differs', 'label_differs']) FROM q WHERE r < 3"),
    "rater_names": "SELECT 'r' || s_nationkey AS rater FROM supplier UNION SELECT 'r' || (s_suppkey % 40) FROM supplier WHERE s_suppkey % 2 <> 0",
    "card_counts": f"WITH c AS ({plain(CARDS)}) SELECT 'label' AS counted, label AS value, count(*) AS n FROM c GROUP BY label UNION ALL SELECT 'source', source, count(*) FROM c GROUP BY source UNION ALL SELECT 'label_source', label || ':' || source, count(*) FROM c GROUP BY label, source UNION ALL SELECT 'basis', basis, count(*) FROM c GROUP BY basis",
    "bundle_counts": "SELECT 'examples' AS counted, '' AS value, count(*) AS n FROM lineitem UNION ALL SELECT 'families', '', count(DISTINCT l_partkey) FROM lineitem UNION ALL SELECT 'sources', '', count(DISTINCT l_suppkey) FROM lineitem UNION ALL SELECT 'split', l_returnflag, count(*) FROM lineitem GROUP BY l_returnflag UNION ALL SELECT 'label', l_linestatus, count(*) FROM lineitem GROUP BY l_linestatus",
    "card_drift": "SELECT o_orderkey AS k, 'missing_row' AS field FROM orders WHERE o_orderkey % 11 = 0 UNION ALL SELECT o_orderkey, 'label' FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey, 'text' FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 3 = 0",
    "asserted_findings": f"SELECT doc_id, {_picked(_nth(), [x for _, x in LEADS])} AND {_picked(_nth(LEADS, [0, 0]), [x for _, x in TAILS])} AS found FROM documents",
    "red_flags": f"SELECT doc_id, flag, found, CASE WHEN found THEN flag ELSE '' END AS raised FROM (SELECT doc_id, {_picked(_nth(LEADS), [f for f, _ in FOUND])} AS flag, {_picked(_nth(), [x for _, x in LEADS])} AND {_picked(_nth(LEADS, FOUND), [x for _, x in TAILS])} AS found FROM documents)",
    "speaker_profiles": f"SELECT doc_id, CASE WHEN who = 'patient' THEN CAST({_picked(_nth(WHO), [a for _, a, _ in AGED])} AS BIGINT) END AS age, CASE WHEN who = 'patient' THEN {_picked(_nth(WHO), [x for _, _, x in AGED])} ELSE 'unknown' END AS sex, who AS speaker_role FROM (SELECT doc_id, {_picked(_nth(), [x for _, x in WHO])} AS who FROM documents)",
    "reasoning_extract": f"SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, {_UNTIL} AS reasoning FROM lineitem",
    "object_extract": """SELECT p_partkey, CASE WHEN p_partkey % 4 <> 3 THEN '{"a": "x}", "b": ' || p_partkey || '}' END AS found FROM part""",
    "tidied_text": f"SELECT doc_id, {_stripped(_SQUEEZED.format("' fine ' || chr(13) || chr(10) || chr(13) || chr(10) || chr(13) || text || ' ' || chr(9) || ' x '"))} AS t FROM documents",
    "redacted_errors": "SELECT p_partkey, substr(CASE WHEN p_size % 2 = 0 THEN 'key [REDACTED] was refused: [REDACTED]' ELSE 'key ' || p_type || ' was refused: ' || p_type END, 1, 40) AS message FROM part",
    "fingerprints": """SELECT o_orderkey, sha256('{"judge_id":' || CASE WHEN o_orderkey % 2 = 0 THEN '"' || o_orderpriority || '"' ELSE 'null' END || ',"model":"' || o_orderstatus || '","n":' || o_orderkey || '}') AS request_key FROM orders""",
    "axis_texts": f"WITH v AS (SELECT p_partkey, p_size * CASE p_partkey % 3 WHEN 0 THEN 0.01::DOUBLE WHEN 1 THEN 125.5 ELSE 1000.0 END AS v FROM part), w AS (SELECT *, floor(v) AS f, v / 6 AS raw, power(10.0::DOUBLE, floor(log10(v / 6))) AS p FROM v) SELECT p_partkey, round(p * CASE WHEN raw <= p * (1 + 1e-12) THEN 1 WHEN raw <= 2 * p * (1 + 1e-12) THEN 2 WHEN raw <= 2.5 * p * (1 + 1e-12) THEN 2.5 WHEN raw <= 5 * p * (1 + 1e-12) THEN 5 ELSE 10 END, 6) AS step, '$' || {_NUMBER.format(v='f')} AS cost, {_NUMBER.format(v='f')} || CASE WHEN p_partkey % 2 = 0 THEN '.5' ELSE '' END || 's' AS seconds FROM w",
    "judged_samples": with_base(["samples"], "SELECT s.task_type, s.sample_idx, count(*) AS n, count(j.label) AS n_judged FROM samples s LEFT JOIN (SELECT * FROM samples WHERE sample_idx <= 3) j USING (case_id, sample_idx) GROUP BY ALL"),
    "accepted_candidates": "WITH v AS (SELECT l_orderkey AS k, count(*) AS n, count(DISTINCT l_linestatus) AS u, list(DISTINCT l_linestatus) AS vs, bool_or(l_linenumber = 2 AND l_orderkey % 3 = 0) AS amb FROM lineitem WHERE l_linenumber <= 2 GROUP BY l_orderkey), j AS (SELECT o_orderkey AS k, o_orderstatus AS want, o_orderkey % 5 <> 0 AS made, coalesce(n, 0) AS n, coalesce(u, 0) AS u, coalesce(vs, []) AS vs, coalesce(amb, false) AS amb FROM orders LEFT JOIN v ON k = o_orderkey), r AS (SELECT k, list_sort(list_filter([CASE WHEN NOT made THEN 'missing_successful_generation' END, CASE WHEN n <> 2 THEN 'incomplete_independent_labeling' END, CASE WHEN made AND k % 7 = 0 THEN 'generator_intended_label_mismatch' END, CASE WHEN made AND k % 11 = 0 THEN 'generator_presentation_group_mismatch' END, CASE WHEN u > 1 THEN 'teacher_label_disagreement' END, CASE WHEN len(list_filter(vs, lambda x: x <> want)) > 0 THEN 'teacher_generator_intent_disagreement' END, CASE WHEN amb THEN 'teacher_reported_ambiguity' END, CASE WHEN k % 13 = 0 THEN 'exact_benchmark_match' END], lambda x: x IS NOT NULL)) AS x FROM j) SELECT k AS case_id, len(x) = 0 AS accepted, array_to_string(x, ',') AS reasons FROM r",
    "trace_answers": STEPS + "SELECT case_id, seq, question_id, CAST(qn AS BIGINT) AS question_number, row_number() OVER (PARTITION BY case_id, question_id ORDER BY seq) > 1 AS repeated, 'answer ' || substr(question_id, 2) AS answer, CASE question_id WHEN 'q5' THEN 'unknown' ELSE 'known' END AS fact_status FROM st WHERE type = 'ASK' AND NOT after_end AND question_id IN ('q0', 'q1', 'q2', 'q3', 'q4', 'q5')",
    "wrong_cards": "WITH c AS (SELECT c_custkey AS k, c_nationkey % 4 AS g FROM customer) SELECT k AS case_id, 'duplicate_fact' AS error FROM c WHERE k % 5 = 0 UNION ALL SELECT k, 'required_question_unknown' FROM c WHERE k % 3 = 0 UNION ALL SELECT k, 'red_flag_question_unknown' FROM c WHERE k % 11 = 0 UNION ALL SELECT k, 'unsafe_dispositions_wrong' FROM c WHERE k % 7 = 0 AND g <> 0",
    "wrong_actions": " UNION ALL ".join(f"SELECT o_orderkey, '{e}' AS error FROM orders WHERE o_orderkey % {len(WRONG)} = {i}" for i, es in enumerate(WRONG) for e in es if e != "ok"),
    "schema_counts": "WITH n AS (SELECT o_orderkey, (o_orderstatus = 'P')::INT + (o_orderkey % 3 < 2)::INT + (o_orderkey % 5 = 0)::INT + (o_orderkey < 1)::INT AS n FROM orders) SELECT o_orderkey, CAST(n AS BIGINT) AS n FROM n",
    "frontier_table": with_base(["attempts"], ", a AS (SELECT execution_id AS run_id, event_id % 2 AS t, avg(CASE WHEN outcome = 'success' THEN 1.0::DOUBLE ELSE 0 END) AS exact, quantile_cont(request_wall_ms, 0.95) AS p, count(request_wall_ms) = count(*) AS whole FROM attempts GROUP BY ALL), u AS (SELECT execution_id AS run_id, sum(request_wall_ms) * 1000 / count(*) AS c FROM attempts GROUP BY ALL) SELECT run_id, CASE WHEN run_id % 4 <> 0 AND count(*) = 2 THEN round(avg(exact), 6) END AS macro_exact, round(CASE WHEN run_id % 5 <> 0 THEN any_value(c) END, 6) AS cost_per_1000, CASE WHEN count(*) FILTER (whole) = 2 THEN round(avg(p), 6) END AS macro_p95_ms FROM a JOIN u USING (run_id) GROUP BY run_id"),
    "provider_usage": f"WITH c AS ({plain(CALLS)}), k AS (SELECT *, event_type <> 'error' AS ok FROM c), p(model, i, h, o) AS (VALUES ('m0', 0.25::DOUBLE, 0.025::DOUBLE, 2.0::DOUBLE), ('m1', 2.5, 0.25, 15.0)), j AS (SELECT k.*, (greatest(input_tokens - cached_input_tokens, 0) * i + cached_input_tokens * h + output_tokens * o) / 1000000 AS usd FROM k LEFT JOIN p USING (model)) SELECT coalesce(model, 'unknown') AS model, count(*) AS attempts, count(*) FILTER (ok) AS successful_calls, count(*) FILTER (NOT ok) AS failed_calls, CAST(coalesce(sum(input_tokens) FILTER (ok), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(cached_input_tokens) FILTER (ok), 0) AS BIGINT) AS cached_input_tokens, CAST(coalesce(sum(output_tokens) FILTER (ok), 0) AS BIGINT) AS output_tokens, round(coalesce(sum(usd) FILTER (ok), 0), 6) AS estimated_cost_usd, round(avg(value) FILTER (ok), 6) AS mean_ms, round(quantile_cont(value, 0.5) FILTER (ok), 6) AS p50_ms, round(quantile_cont(value, 0.95) FILTER (ok), 6) AS p95_ms, count(ttft_ms) FILTER (ok) > 0 AS ttft_available, round(quantile_cont(ttft_ms, 0.5) FILTER (ok), 6) AS ttft_p50_ms, round(quantile_cont(ttft_ms, 0.95) FILTER (ok), 6) AS ttft_p95_ms FROM j GROUP BY 1",
    "migrated_rows": "SELECT event_id, value AS latency_ms, value AS total_duration_ms, NULL::DOUBLE AS ttft_ms, 'legacy_aggregate' AS timing_source FROM events",
    "jsonl_round_trip": "SELECT conv_id, turn, role, text FROM conversations",
    "csv_round_trip": "SELECT conv_id, turn, role, 'said \"' || role || '\",' || chr(10) || 'twice' AS text FROM conversations",
    "table_round_trip": "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus <> 'P'",
    "line_set": "SELECT DISTINCT n_name AS value FROM nation",
    "appended_log": "SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey, r_name FROM region",
    "written_once": "SELECT o_orderkey, o_orderstatus FROM orders",
    "json_records": """SELECT '{"a":null,"b":' || CASE WHEN o_orderkey % 2 = 0 THEN '"' || o_orderpriority || '"' ELSE 'null' END || ',"k":' || o_orderkey || '}' AS value FROM orders""",
    "markdown_table": "SELECT CAST(0 AS BIGINT) AS line, '| r_regionkey | name |' AS text UNION ALL SELECT 1, '| --- | --- |' UNION ALL SELECT 1 + row_number() OVER (ORDER BY r_regionkey), '| ' || r_regionkey || ' | ' || r_name || '\\|x |' FROM region",
    "manifest_counts": "SELECT o_orderstatus AS status, count(*) AS n, 'clear' AS mode FROM orders GROUP BY o_orderstatus",
    "verified_sources": "WITH f AS (SELECT doc_id, coalesce(text, '') AS t FROM documents WHERE doc_id % 3 <> 0), l AS (SELECT d.doc_id, sha256(coalesce(d.text, '')) = sha256(CASE WHEN f.doc_id % 5 = 0 THEN t || 'x' ELSE t END) AS same, f.doc_id IS NOT NULL AS there FROM documents d LEFT JOIN f USING (doc_id)) SELECT CAST(doc_id AS VARCHAR) AS name, CASE WHEN NOT there THEN missing WHEN same THEN good ELSE bad END AS state, how FROM l CROSS JOIN (VALUES ('plain', 'fetch', 'verified', 'replace'), ('refresh', 'fetch', 'replace', 'replace'), ('offline', 'missing_offline', 'verified', 'mismatch_offline')) h(how, missing, good, bad)",
    "parameterised": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_orderkey > 100",
    "action_traces": "SELECT l_orderkey AS trace, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS INT) AS seq, CAST(l_partkey AS BIGINT) AS n FROM lineitem",
    "live_view": with_base(["attempts"], "SELECT request_key, arg_max(outcome, (ts, event_id)) AS outcome, arg_max(execution_id, (ts, event_id)) AS execution_id FROM attempts GROUP BY request_key"),
    "live_attempts": with_base(["attempts"], "SELECT DISTINCT execution_id, request_key, attempt_index FROM attempts"),
}

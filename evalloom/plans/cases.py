"""Queries over cases and texts: joins, grids, text rules, selection, screening, replay, cost."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.functions import text as T
from evalloom.operators import benchmark, cost, relations, replay, screen, selection
from evalloom.plans.base import base, plain, sql, stored, with_base


def pending_antijoin(spark, d):
    tasks = relations.task_grid(base(spark, d, "gold").select("case_id"), ["qa", "conv"], 2)
    done = base(spark, d, "samples").select("case_id", "task_type", (F.col("sample_idx") % 2).alias("sample_idx"), F.lit("ok").alias("status"))
    return relations.pending(tasks, done, ["case_id", "task_type", "sample_idx"], ok=F.col("status") == "ok")


def pending_judgments(spark, d):
    """Rows whose earlier result has another configuration or text."""
    made = sql(spark, d, "SELECT o_orderkey AS k, o_orderstatus AS config, o_orderpriority AS text FROM {orders}")
    judged = sql(spark, d, "SELECT l_orderkey AS k, l_linestatus AS config, concat(CAST(l_linenumber AS STRING), '-URGENT') AS text, l_returnflag AS status FROM {lineitem}")
    return relations.pending(made, judged, ["k"], {"config": "config", "text": "text"}, F.col("status") != "R").select("k")


def semi_profile(spark, d):
    return relations.present_in(base(spark, d, "gold"), base(spark, d, "samples").filter("label = 'D'"), ["case_id"]).groupBy("dataset").agg(F.count("*").alias("n"))


def mandatory_join_violations(spark, d):
    labels = sql(spark, d, "SELECT l_orderkey AS case_id, l_suppkey AS s_suppkey FROM {lineitem} WHERE l_linenumber = 1")
    raw = sql(spark, d, "SELECT s_suppkey, s_name FROM {supplier} WHERE s_acctbal > 0")
    return relations.mandatory(labels, raw, ["s_suppkey"])[1].groupBy("s_suppkey").agg(F.count("*").alias("lost"))


def symmetric_difference(spark, d):
    a = sql(spark, d, "SELECT o_custkey AS id FROM {orders} WHERE o_orderstatus = 'P'")
    return relations.symmetric_difference(a, sql(spark, d, "SELECT c_custkey AS id FROM {customer} WHERE c_acctbal > 2000"), "id")


def intersected(spark, d):
    return relations.common(sql(spark, d, "SELECT o_custkey AS id FROM {orders}"), sql(spark, d, "SELECT c_custkey AS id FROM {customer} WHERE c_acctbal > 2000"), "id")


def stale_rows(spark, d):
    judged = sql(spark, d, "SELECT DISTINCT l_orderkey AS k, CASE WHEN l_linenumber < 6 THEN l_linestatus END AS h FROM {lineitem}")
    made = sql(spark, d, "SELECT CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey END AS k, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderstatus END AS m FROM {orders}")
    return relations.stale(judged, made, ["k"], "h", "m")


def task_grid(spark, d):
    return relations.task_grid(base(spark, d, "gold").select("case_id"), ["qa", "conv"], 3)


def design_grid(spark, d):
    """The stored priorities times the stored nations times nine cells, 30 of each priority for development."""
    listed = lambda text: [r[0] for r in sql(spark, d, text).collect()]  # noqa: E731  two closed lists
    labels, groups = listed("SELECT DISTINCT o_orderpriority FROM {orders} ORDER BY 1"), listed("SELECT DISTINCT n_name FROM {nation} ORDER BY 1")
    return relations.design_grid(spark, labels, groups, 9, 30, "case", 1000).withColumn("seed", F.col("seed").cast("long"))


def design_counts(spark, d):
    return design_grid(spark, d).groupBy("intended_label", "split").agg(F.count("*").alias("n"))


def dedupe_subset(spark, d):
    rows = sql(spark, d, "SELECT l_partkey, l_returnflag, l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM {lineitem}")
    return relations.first_of(rows, ["l_partkey", "l_returnflag"], [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")]).select("l_partkey", "l_returnflag", "l_orderkey", "l_linenumber")


def duplicate_keys(spark, d):
    return relations.duplicates(sql(spark, d, "SELECT l_orderkey, l_linenumber FROM {lineitem}"), ["l_orderkey", "l_linenumber"]).withColumnRenamed("count", "n")


def union_by_name(spark, d):
    a = sql(spark, d, "SELECT c_custkey AS id, c_acctbal AS balance FROM {customer}")
    b = sql(spark, d, "SELECT s_suppkey AS id, s_name AS name FROM {supplier}")
    return relations.stacked(a, b)


def family_split_crossings(spark, d):
    return relations.crossings(sql(spark, d, "SELECT l_partkey, l_returnflag FROM {lineitem}"), "l_partkey", "l_returnflag")


def contract_differences(spark, d):
    rows = sql(spark, d, "SELECT s_suppkey AS run_id, s_nationkey, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey % 2 END AS b FROM {supplier}")
    return relations.differing(rows.filter("run_id = 1"), rows, "run_id", ["s_nationkey", "b"])


def contamination_semijoin(spark, d):
    examples = sql(spark, d, "SELECT doc_id, source, doc_id % 3 = 0 AS training_allowed FROM {documents}")
    return screen.leaks(examples, sql(spark, d, "SELECT doc_id FROM {labels} WHERE quality = 1"), ["doc_id"]).select("doc_id", "source")


def ordered_cases(spark, d):
    cases = sql(spark, d, "SELECT o_orderkey AS ordinal, c_mktsegment AS dataset, o_totalprice FROM {orders} JOIN {customer} ON o_custkey = c_custkey")
    return relations.selected_cases(cases, ["BUILDING", "MACHINERY"], 25, {"BUILDING", "MACHINERY", "AUTOMOBILE", "FURNITURE", "HOUSEHOLD"})


def chats(spark, d):
    turns = sql(spark, d, "SELECT conv_id, turn, role, text FROM {conversations}")
    return turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda s: F.struct(s["role"].alias("role"), s["text"].alias("content"))).alias("chat"))


def chat_format(spark, d):
    return chats(spark, d).select("conv_id", T.chat_text(F.col("chat")).alias("text"), T.user_text(F.col("chat")).alias("user_text"))


def message_text(spark, d):
    return chats(spark, d).select("conv_id", T.message_text(F.to_json("chat")).alias("text"))


ANSWERS = "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, concat('REASONING: because ', l_shipdate, CASE WHEN l_linenumber % 2 = 0 THEN chr(10) ELSE ' ' END, CASE l_linenumber WHEN 1 THEN 'acuity - ' WHEN 2 THEN 'ACUITY:' WHEN 3 THEN 'Acuity  : ' WHEN 4 THEN 'label ' ELSE 'ACUITY: ' END, l_returnflag, ' ACUITY: B') AS answer FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, CAST(CAST(l_shipdate AS DATE) AS STRING) AS l_shipdate, l_returnflag FROM {lineitem}) t"


def label_extract(spark, d):
    return sql(spark, d, ANSWERS).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", T.answer_label(F.col("answer")).alias("label"))


def marker_slice(spark, d):
    rows = sql(spark, d, "SELECT item_id, concat(CASE WHEN item_id % 3 = 0 THEN 'x About me: ' ELSE ' ' END, text, CASE WHEN item_id % 2 = 0 THEN '  Please answer in exactly one word' ELSE ' ' END) AS t FROM {benchmark}")
    return rows.select("item_id", T.between_markers(F.col("t")).alias("t"))


def digests(spark, d):
    rows = stored(spark, d, "documents")
    return rows.select("doc_id", F.sha2("text", 256).alias("sha256"), T.digest12(F.col("text")).alias("short"))


def normalized_text(spark, d):
    return stored(spark, d, "documents").select("doc_id", T.normalised(F.col("text")).alias("norm"))


def exact_matches(spark, d):
    a = stored(spark, d, "documents").select("doc_id", T.normalised(F.col("text")).alias("norm")).filter("norm <> ''")
    first = a.groupBy("norm").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    return a.join(first, "norm").select("doc_id", "first_id", "n")


def trigram_containment(spark, d):
    """Shared trigrams of documents and held-out texts, from an equality join."""
    a = screen.prepared(stored(spark, d, "documents"), "doc_id", "text")
    b = screen.prepared(stored(spark, d, "benchmark"), "item_id", "text")
    out = screen.shared_trigrams(a, b).select(F.col("a_key").alias("doc_id"), F.col("b_key").alias("item_id"), F.round("containment", 6).alias("containment"))
    return out


def best_match_screen(spark, d):
    """The screen over all conversations' first messages, against all held-out texts and each other."""
    first = sql(spark, d, "SELECT conv_id, min_by(text, turn) AS text FROM {conversations} GROUP BY conv_id")
    c = screen.prepared(first, "conv_id", "text")
    b = screen.prepared(stored(spark, d, "benchmark"), "item_id", "text").withColumn("ord", F.col("key"))
    return screen.reasons(screen.best_match(c, b, 0.82, 0.65), screen.near_duplicates(c, 0.82, 0.65), 40, 0.82, 0.65)


def segment_counts(spark, d):
    parts = T.segments(F.col("text"))
    rows = stored(spark, d, "conversations").select("conv_id", "turn", parts.alias("p"))
    return rows.select("conv_id", "turn", F.size("p").cast("long").alias("fragments"), F.array_join(T.opening(F.col("p")), " ").alias("opening"))


SLOTS = {"timing": ["\\bthe\\b.{0,10}\\band\\b", "\\bwas\\b"], "place": ["\\bin\\b", "\\bon\\b"], "cause": ["\\bwith\\b"]}


def topic_router(spark, d):
    lines = sql(spark, d, "SELECT doc_id, text FROM {documents}").select(F.col("doc_id").alias("case"), F.posexplode(F.split("text", "\n")).alias("idx", "fragment")).filter("trim(fragment) <> ''")
    patterns = spark.createDataFrame([(s, p) for s, ps in SLOTS.items() for p in ps], "slot string, pattern string")
    out = screen.routed(lines, patterns, lines.filter("idx = 0").select("case", "fragment"))
    return out.groupBy("case", "slot").agg(F.sum(F.size("evidence")).cast("long").alias("n"), F.first(F.md5(F.array_join("evidence", "\n"))).alias("digest"))


GROUPS = {"timing": ["the ", "was "], "place": ["in ", "on "], "cause": ["with "]}


def presentation_group(spark, d):
    g = T.pattern_group(F.col("text"), GROUPS)
    return stored(spark, d, "documents").select("doc_id", g.alias("presentation_group"))


def scored_cases(spark, d):
    return sql(spark, d, "SELECT o_orderkey AS case_id, c_mktsegment AS pool, o_orderpriority AS grp, CAST(floor(o_totalprice / 1000) AS INT) AS score FROM {orders} JOIN {customer} ON o_custkey = c_custkey")


def round_robin_take(spark, d):
    return selection.diverse_take(scored_cases(spark, d).select("case_id", "grp", "score"), 37, "grp", "score", "case_id")


def quota_take(spark, d):
    quotas = spark.createDataFrame([("BUILDING", 12), ("MACHINERY", 7)], "pool string, quota int")
    return selection.quota_take(scored_cases(spark, d), quotas, ["pool"], "grp", "score", "case_id").select("pool", "case_id", F.col("turn").cast("long").alias("turn"))


def hashed_order(spark, d):
    cases = sql(spark, d, "SELECT c_custkey AS case_id FROM {customer}")
    return selection.hashed_order(cases, "seed-1", "case_id", "set").select("case_id", "numbered_id")


CARDS = """SELECT c_custkey AS case_id, CASE c_nationkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END AS gold, 4 AS maximum_questions FROM {customer}"""
ACTIONS = """SELECT l_suppkey * 0 + o_custkey AS case_id, l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_quantity > 47 THEN 'DISPOSE' WHEN l_quantity > 45 THEN 'HANDOFF' ELSE 'ASK' END AS type, CASE WHEN l_quantity <= 45 THEN concat('q', CAST(l_partkey % 7 AS STRING)) END AS question_id, CASE WHEN l_quantity > 47 THEN CASE l_partkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END END AS disposition, l_shipmode AS content FROM (SELECT DISTINCT l_orderkey, l_linenumber, max(l_suppkey) AS l_suppkey, max(l_quantity) AS l_quantity, max(l_partkey) AS l_partkey, max(l_linestatus) AS l_shipmode FROM {lineitem} GROUP BY l_orderkey, l_linenumber) x JOIN {orders} ON o_orderkey = l_orderkey"""


def cards(spark, d):
    facts = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.struct(F.concat(F.lit("q"), i.cast("string")).alias("question_id"), F.when(i == 5, "unknown").otherwise("known").alias("status"), F.concat(F.lit("answer "), i.cast("string")).alias("answer"), F.array(F.concat(F.lit("e"), i.cast("string"))).alias("evidence_text")))
    rows = sql(spark, d, CARDS).withColumn("facts", facts).withColumn("opening", F.concat(F.lit("I have e"), (F.col("case_id") % 6).cast("string")))
    return rows.withColumns({"required_question_ids": F.array(F.lit("q0"), F.lit("q1"), F.lit("q2")), "red_flag_question_ids": F.when(F.col("case_id") % 2 == 0, F.array(F.lit("q3"))).otherwise(F.array().cast("array<string>")), "unsafe_dispositions": T.unsafe_labels(F.col("gold"))})


def trace_replay(spark, d):
    out = replay.outcomes(replay.steps(sql(spark, d, ACTIONS)), cards(spark, d))
    return out.select("case_id", "terminal_action", "predicted", F.col("questions_asked").cast("long").alias("questions_asked"), F.col("unique_questions_asked").cast("long").alias("unique_questions_asked"), F.round("required_recall", 6).alias("required_recall"), "red_flag_recall", "exact", "undertriage", "handed_off")


def trace_summary(spark, d):
    out = replay.trace_summary(replay.outcomes(replay.steps(sql(spark, d, ACTIONS)), cards(spark, d)))
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in out.dtypes])


def trace_errors(spark, d):
    out = replay.trace_errors(replay.steps(sql(spark, d, ACTIONS)), cards(spark, d))
    return out.groupBy("error").agg(F.countDistinct("case_id").alias("cases"))


def trace_transcript(spark, d):
    t = replay.transcript(replay.steps(sql(spark, d, ACTIONS)), cards(spark, d))
    return t.groupBy("role", "kind").agg(F.count("*").alias("n"), F.sum("sequence").alias("places"))


def policy_view(spark, d):
    out = replay.public_state(replay.steps(sql(spark, d, ACTIONS)), cards(spark, d))
    return out.select("case_id", "opening_utterance", F.col("questions_asked").cast("long").alias("questions_asked"), F.col("questions_remaining").cast("long").alias("questions_remaining"), "terminal")


ASSUMED = "SELECT 500 AS unique_cases, 4 AS teacher_rollouts_per_case, 3.00 AS teacher_prefill, 0.60 AS teacher_cached_prefill, 7.50 AS teacher_sample, 0.33 AS student_prefill, 0.066 AS student_cached_prefill, 1.005 AS student_sample, 0.737 AS student_train, 5000 AS teacher_prefill_tokens, 0.0 AS teacher_cached, 400 AS teacher_sampled, 1500 AS sft_tokens, 3 AS sft_epochs, 3 AS sweep_rates, 2 AS sweep_ranks, 0.25 AS sweep_fraction, 1 AS sweep_epochs, 500 AS eval_cases, 1 AS eval_rollouts_per_case, 5000 AS eval_prefill, 0.0 AS eval_cached, 400 AS eval_sampled, 500 AS policy_cases, 4 AS policy_rollouts_per_case, 1 AS policy_rounds, 5000 AS policy_prefill, 0.0 AS policy_cached, 400 AS policy_sampled, 1500 AS policy_scored, 1500 AS policy_train, 180 AS hourly_rate, 1.0 AS review_share, 10 AS minutes_per_case, 0.25 AS rollout_share, 3 AS minutes_per_rollout, 2 AS labels_per_case, 5 AS minutes_per_label, 0.20 AS adjudication_share, 5 AS minutes_per_adjudication, 100 AS seed_cases"


def cost_scenario(spark, d):
    """A scenario for each order, of as many cases as its price has thousands begun."""
    key, counted = "o_orderkey", ("unique_cases", "eval_cases", "policy_cases", "seed_cases")
    orders = sql(spark, d, "SELECT o_orderkey, CAST(floor(o_totalprice / 1000) + 1 AS INT) AS n FROM {orders}")
    assumed = orders.crossJoin(F.broadcast(spark.sql(ASSUMED).drop(*counted))).withColumns({c: F.col("n") for c in counted})  # one row of rates
    parts = cost.scenario(assumed, key)
    whole = cost.totals(parts, key).select(key, F.concat(F.lit("total:"), "category").alias("component"), F.lit("total").alias("category"), "cost")
    seed = cost.seed_preparation(assumed, key).select(key, F.lit("seed_preparation").alias("component"), F.lit("seed").alias("category"), "cost")
    return parts.unionByName(whole).unionByName(seed).withColumn("cost", F.col("cost").cast("double"))


def edit_override(spark, d):
    texts = sql(spark, d, "SELECT p_partkey AS source_id, p_name AS text FROM {part}")
    edits = sql(spark, d, "SELECT CASE WHEN p_partkey % 2 = 0 THEN p_partkey END AS source_id, CASE WHEN p_size % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END AS is_edited, CASE WHEN p_size % 3 = 0 THEN ' ' ELSE p_type END AS edited_text FROM {part}")
    return benchmark.edited(texts, edits, "source_id", "text")


def urgency_router(spark, d):
    rows = sql(spark, d, "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'em' WHEN 'O' THEN 'sc' ELSE 'ne' END AS urgency FROM {orders}")
    good, _ = benchmark.routed_by(rows, "urgency", benchmark.URGENCY)
    return good.groupBy("urgency", "mapped_label").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (pending_antijoin, pending_judgments, semi_profile, mandatory_join_violations, symmetric_difference, intersected, stale_rows, task_grid, design_grid, design_counts, dedupe_subset, duplicate_keys, union_by_name, family_split_crossings, contract_differences, contamination_semijoin, ordered_cases, chat_format, message_text, label_extract, marker_slice, digests, normalized_text, exact_matches, trigram_containment, best_match_screen, segment_counts, topic_router, presentation_group, round_robin_take, quota_take, hashed_order, trace_replay, trace_summary, trace_errors, trace_transcript, policy_view, cost_scenario, edit_override, urgency_router)}

NORM = "array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ')"
GRAMS = "CASE WHEN len(t) >= 3 THEN list_distinct([array_to_string(t[i:i+2], ' ') for i in range(1, len(t) - 1)]) ELSE [] END"
COUNTS = {g: " + ".join(f"len(regexp_extract_all(text, '(?i){p}'))" for p in ps) for g, ps in GROUPS.items()}
STEPS = f"WITH cards AS ({plain(CARDS)}), act AS ({plain(ACTIONS).replace('AS STRING', 'AS VARCHAR')}), " + """e AS (SELECT case_id, min(seq) FILTER (type <> 'ASK') AS stop FROM act GROUP BY case_id),
st AS (SELECT act.*, stop, stop IS NOT NULL AND seq > stop AS after_end, CASE WHEN type = 'ASK' THEN sum(CASE WHEN type = 'ASK' THEN 1 ELSE 0 END) OVER (PARTITION BY case_id ORDER BY seq) END AS qn FROM act JOIN e USING (case_id)),
asked AS (SELECT case_id, count(*) FILTER (type = 'ASK') AS n, list(DISTINCT question_id) FILTER (type = 'ASK') AS qs, max(type) FILTER (type <> 'ASK') AS t, max(disposition) FILTER (type <> 'ASK') AS p FROM st WHERE NOT after_end GROUP BY case_id),
o AS (SELECT a.case_id, t AS terminal_action, p AS predicted, gold, n, coalesce(len(qs), 0) AS u, list_append(list_filter(coalesce(qs, []), lambda x: x IS NOT NULL), CASE WHEN a.case_id % 6 < 5 THEN 'q' || (a.case_id % 6) END) AS seen FROM asked a JOIN cards c USING (case_id) WHERE t IS NOT NULL),
oo AS (SELECT case_id, terminal_action, predicted, n AS questions_asked, u AS unique_questions_asked, len(list_intersect(seen, ['q0', 'q1', 'q2'])) / 3.0::DOUBLE AS required_recall, CASE WHEN case_id % 2 = 0 THEN len(list_intersect(seen, ['q3'])) / 1.0::DOUBLE ELSE 1.0::DOUBLE END AS red_flag_recall, CASE WHEN terminal_action = 'DISPOSE' THEN predicted = gold END AS exact, coalesce(terminal_action = 'DISPOSE' AND predicted < gold, false) AS undertriage, terminal_action <> 'DISPOSE' AS handed_off FROM o)
"""
_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_LINES = f"list_filter(list_transform(string_split_regex(text, '\\n+'), lambda x: {_STRIP.format('x')}), lambda x: x <> '')"
_PARTS = f"flatten(list_transform({_LINES}, lambda x: string_split(regexp_replace(x, '([.!?])\\s+([A-Z0-9\"''])', '\\1' || chr(1) || '\\2', 'g'), chr(1))))"
_CLEAN = _STRIP.format(f"regexp_replace(regexp_replace({_STRIP.format('x')}, '^#{{1,6}}\\s*', ''), '^(?:[-*•]|\\d+[.)])\\s+', '')")
_EDGE = r"[^\pL\pN\pM_]"  # this engine's \b knows ASCII alone
_WORD = {p: f"(?:^|{_EDGE}){p[2:-2]}(?:$|{_EDGE})" for ps in SLOTS.values() for p in ps} | {SLOTS["timing"][0]: f"(?:^|{_EDGE})the(?:{_EDGE}|{_EDGE}.{{0,8}}{_EDGE})and(?:$|{_EDGE})"}
_HITS = " UNION ALL ".join("SELECT *, '{}' AS slot FROM f WHERE {}".format(slot, " OR ".join(f"regexp_matches(frag, '(?i){_WORD[p]}')" for p in ps)) for slot, ps in SLOTS.items())
DESIGN = "WITH l AS (SELECT o_orderpriority AS l, row_number() OVER (ORDER BY o_orderpriority) - 1 AS li FROM orders GROUP BY o_orderpriority), g AS (SELECT n_name AS g, row_number() OVER (ORDER BY n_name) - 1 AS gi, count(*) OVER () AS k FROM nation GROUP BY n_name), x AS (SELECT *, (gi - li + 5 * k) % k AS turn FROM l, g, range(9) c(c)), d AS (SELECT li * k * 9 + gi * 9 + c + 1 AS number, CASE WHEN c < 30 // k + CASE WHEN turn < 30 % k THEN 1 ELSE 0 END THEN 'development' ELSE 'train' END AS split, l AS intended_label, g AS presentation_group FROM x)"
SQL = {
    "pending_antijoin": with_base(["samples", "gold"], "SELECT case_id, t AS task_type, CAST(s AS INT) AS sample_idx FROM gold CROSS JOIN (VALUES ('qa'), ('conv')) a(t) CROSS JOIN (VALUES (0), (1)) b(s) WHERE NOT EXISTS (SELECT 1 FROM samples x WHERE x.case_id = gold.case_id AND x.task_type = t AND x.sample_idx % 2 = s)"),
    "pending_judgments": "SELECT o_orderkey AS k FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = o_orderstatus AND l_linenumber || '-URGENT' = o_orderpriority AND l_returnflag <> 'R')",
    "semi_profile": with_base(["samples", "gold"], "SELECT dataset, count(*) AS n FROM gold WHERE case_id IN (SELECT case_id FROM samples WHERE label = 'D') GROUP BY dataset"),
    "mandatory_join_violations": "SELECT l_suppkey AS s_suppkey, count(*) AS lost FROM lineitem WHERE l_linenumber = 1 AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY l_suppkey",
    "symmetric_difference": "WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'P'), b AS (SELECT DISTINCT c_custkey AS id FROM customer WHERE c_acctbal > 2000) SELECT id, 'missing' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT id, 'extra' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)",
    "intersected": "SELECT o_custkey AS id FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 2000",
    "stale_rows": "WITH j AS (SELECT DISTINCT l_orderkey AS k, CASE WHEN l_linenumber < 6 THEN l_linestatus END AS h FROM lineitem), m AS (SELECT CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey END AS k, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderstatus END AS m FROM orders) SELECT j.k, h FROM j LEFT JOIN m ON j.k = m.k WHERE coalesce(h <> m, true)",
    "task_grid": with_base(["gold"], "SELECT case_id, t AS task_type, CAST(s AS INT) AS sample_idx FROM gold CROSS JOIN (VALUES ('qa'), ('conv')) a(t) CROSS JOIN (VALUES (0), (1), (2)) b(s)"),
    "design_grid": f"{DESIGN} SELECT printf('case-%03d', number) AS case_id, printf('case-%03d', number) AS family_id, split, intended_label, presentation_group, number + 1000 AS seed FROM d",
    "design_counts": f"{DESIGN} SELECT intended_label, split, count(*) AS n FROM d GROUP BY ALL",
    "dedupe_subset": "SELECT l_partkey, l_returnflag, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice) = 1",
    "duplicate_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "union_by_name": "SELECT c_custkey AS id, c_acctbal AS balance, NULL::VARCHAR AS name FROM customer UNION ALL SELECT s_suppkey, NULL, s_name FROM supplier",
    "family_split_crossings": "SELECT l_partkey, count(DISTINCT l_returnflag) AS splits FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_returnflag) > 1",
    "contract_differences": "WITH r AS (SELECT s_suppkey AS run_id, s_nationkey, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey % 2 END AS b FROM supplier), w AS (SELECT * FROM r WHERE run_id = 1) SELECT r.run_id, 's_nationkey' AS field FROM r, w WHERE r.s_nationkey IS DISTINCT FROM w.s_nationkey UNION ALL SELECT r.run_id, 'b' FROM r, w WHERE r.b IS DISTINCT FROM w.b",
    "contamination_semijoin": "SELECT doc_id, source FROM documents WHERE doc_id % 3 = 0 AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "ordered_cases": "SELECT o_orderkey AS ordinal, c_mktsegment AS dataset, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') ORDER BY o_orderkey LIMIT 25",
    "chat_format": "SELECT conv_id, string_agg(CASE role WHEN 'user' THEN '[USER]' WHEN 'assistant' THEN '[ASSISTANT]' ELSE '[' || upper(role) || ']' END || chr(10) || text, chr(10) || chr(10) ORDER BY turn, role, text) AS text, string_agg(text, chr(10) || chr(10) ORDER BY turn, role, text) FILTER (role = 'user' AND regexp_replace(text, '\\s', '', 'g') <> '') AS user_text FROM conversations GROUP BY conv_id",
    "message_text": "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, role, text) AS text FROM conversations GROUP BY conv_id",
    "label_extract": f"WITH a AS ({plain(ANSWERS).replace('AS STRING', 'AS VARCHAR')}) SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, upper(nullif(regexp_extract(answer, '(?i)ACUITY\\s*[:\\-]\\s*([A-D])', 1), '')) AS label FROM a",
    "marker_slice": "WITH t AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'About me: ' ELSE ' ' END || text || ' ' AS t FROM benchmark) SELECT item_id, regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS t FROM t",
    "digests": "SELECT doc_id, sha256(text) AS sha256, substr(sha256(text), 1, 12) AS short FROM documents",
    "normalized_text": f"SELECT doc_id, {NORM} AS norm FROM documents",
    "exact_matches": f"WITH n AS (SELECT doc_id, {NORM} AS norm FROM documents) SELECT doc_id, min(doc_id) OVER w AS first_id, count(*) OVER w AS n FROM n WHERE norm <> '' WINDOW w AS (PARTITION BY norm) QUALIFY count(*) OVER w > 1",
    "segment_counts": f"WITH p AS (SELECT conv_id, turn, text, list_filter(list_transform({_PARTS}, lambda x: {_CLEAN}), lambda x: x <> '') AS p FROM conversations), q AS (SELECT conv_id, turn, CASE WHEN len(p) > 0 THEN p ELSE [text] END AS p FROM p) SELECT conv_id, turn, len(p) AS fragments, p[1] || CASE WHEN len(p) > 1 AND length(p[1]) < 140 THEN ' ' || p[2] ELSE '' END || CASE WHEN len(p) > 2 AND length(p[1]) + length(p[2]) < 140 THEN ' ' || p[3] ELSE '' END AS opening FROM q",
    "topic_router": f"WITH s AS (SELECT doc_id AS c, string_split(text, chr(10)) AS l FROM documents), f AS (SELECT * FROM (SELECT c, unnest(l) AS frag, unnest(range(len(l))) AS idx FROM s) WHERE trim(frag) <> ''), h AS ({_HITS}), e AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY c, slot, frag ORDER BY idx) = 1), lo AS (SELECT c, frag, idx, 'context.additional' AS slot FROM f WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.c = f.c AND e.idx = f.idx) AND NOT EXISTS (SELECT 1 FROM f o WHERE o.idx = 0 AND o.c = f.c AND o.frag = f.frag)) SELECT c AS case, slot, count(*) AS n, md5(string_agg(frag, chr(10) ORDER BY idx)) AS digest FROM (SELECT * FROM e UNION ALL SELECT * FROM lo) GROUP BY c, slot",
    "trace_transcript": STEPS + ", k AS (SELECT case_id, count(*) FILTER (type = 'ASK') AS asks FROM st WHERE NOT after_end GROUP BY case_id), a AS (SELECT qn FROM st WHERE type = 'ASK' AND NOT after_end AND question_id IN ('q0', 'q1', 'q2', 'q3', 'q4', 'q5')) SELECT 'patient' AS role, 'OPENING' AS kind, count(*) AS n, CAST(0 AS BIGINT) AS places FROM cards UNION ALL SELECT 'clinician', 'ASK', count(*), CAST(sum(2 * qn - 1) AS BIGINT) FROM a UNION ALL SELECT 'patient', 'ANSWER', count(*), CAST(sum(2 * qn) AS BIGINT) FROM a UNION ALL SELECT 'clinician', type, count(*), CAST(sum(2 * asks + 1) AS BIGINT) FROM st JOIN k USING (case_id) WHERE NOT after_end AND type <> 'ASK' GROUP BY type",
    "trigram_containment": f"WITH a AS (SELECT doc_id, {GRAMS} AS g FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents)), b AS (SELECT item_id, {GRAMS} AS g FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM benchmark)), x AS (SELECT doc_id, item_id, len(list_intersect(a.g, b.g)) / nullif(least(len(a.g), len(b.g)), 0) AS c FROM a, b) SELECT doc_id, item_id, round(c, 6) AS containment FROM x WHERE c > 0",
    "presentation_group": "WITH s AS (SELECT doc_id, " + ", ".join(f"{c} AS {g}" for g, c in COUNTS.items()) + " FROM documents) SELECT doc_id, CASE WHEN greatest(timing, place, cause) = 0 THEN 'general_other' WHEN cause = greatest(timing, place, cause) THEN 'cause' WHEN place = greatest(timing, place, cause) THEN 'place' ELSE 'timing' END AS presentation_group FROM s",
    "round_robin_take": "WITH r AS (SELECT o_orderkey AS case_id, o_orderpriority AS grp, CAST(floor(o_totalprice / 1000) AS INT) AS score FROM orders JOIN customer ON o_custkey = c_custkey), k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, case_id) AS n FROM r) SELECT case_id, grp, score FROM k ORDER BY n, score DESC, grp LIMIT 37",
    "quota_take": "WITH r AS (SELECT o_orderkey AS case_id, c_mktsegment AS pool, o_orderpriority AS grp, CAST(floor(o_totalprice / 1000) AS INT) AS score FROM orders JOIN customer ON o_custkey = c_custkey), k AS (SELECT *, row_number() OVER (PARTITION BY pool, grp ORDER BY score DESC, case_id) AS n FROM r), t AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY n, score DESC, grp) AS turn FROM k) SELECT pool, case_id, turn FROM t WHERE (pool = 'BUILDING' AND turn <= 12) OR (pool = 'MACHINERY' AND turn <= 7)",
    "hashed_order": "WITH h AS (SELECT c_custkey AS case_id, row_number() OVER (ORDER BY sha256('seed-1|' || c_custkey)) AS n FROM customer) SELECT case_id, printf('set-%03d', n) AS numbered_id FROM h",
    "trace_replay": STEPS + "SELECT case_id, terminal_action, predicted, questions_asked, unique_questions_asked, round(required_recall, 6) AS required_recall, red_flag_recall, exact, undertriage, handed_off FROM oo",
    "trace_summary": STEPS + "SELECT count(*) AS trace_count, count(*) FILTER (NOT handed_off) AS disposed_count, count(*) FILTER (handed_off) AS handoff_count, round(count(*) FILTER (exact) / count(*), 6) AS overall_correct_disposition_rate, round(count(*) FILTER (exact) / count(*) FILTER (NOT handed_off), 6) AS autonomous_exact_accuracy, round(count(*) FILTER (handed_off) / count(*), 6) AS handoff_rate, round(count(*) FILTER (undertriage) / count(*) FILTER (NOT handed_off), 6) AS undertriage_rate, round(count(*) FILTER (undertriage) / count(*) FILTER (NOT handed_off), 6) AS unsafe_disposition_rate, round(count(*) FILTER (undertriage) / count(*), 6) AS overall_undertriage_action_rate, round(count(*) FILTER (undertriage) / count(*), 6) AS overall_unsafe_action_rate, round(avg(questions_asked), 6) AS mean_questions_asked, round(avg(required_recall), 6) AS mean_required_question_recall, round(avg(red_flag_recall), 6) AS mean_red_flag_question_recall FROM oo",
    "trace_errors": STEPS + ", er AS (SELECT case_id, 'action_after_terminal' AS error FROM st WHERE after_end UNION SELECT case_id, 'question_limit_exceeded' FROM st WHERE qn > 4 UNION SELECT case_id, 'unknown_question' FROM st WHERE type = 'ASK' AND question_id NOT IN ('q0', 'q1', 'q2', 'q3', 'q4', 'q5') UNION SELECT case_id, 'no_terminal_action' FROM e WHERE stop IS NULL) SELECT error, count(DISTINCT case_id) AS cases FROM er WHERE case_id IN (SELECT case_id FROM cards) GROUP BY error",
    "policy_view": STEPS + "SELECT c.case_id, 'I have e' || (c.case_id % 6) AS opening_utterance, coalesce(n, 0) AS questions_asked, 4 - coalesce(n, 0) AS questions_remaining, coalesce(t IS NOT NULL, false) AS terminal FROM cards c LEFT JOIN asked a USING (case_id)",
    "edit_override": "SELECT p_partkey AS source_id, CASE WHEN p_partkey % 2 = 0 AND p_size % 2 = 0 AND p_size % 3 <> 0 THEN p_type ELSE p_name END AS text FROM part",
    "urgency_router": "WITH r AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'em' WHEN 'O' THEN 'sc' ELSE 'ne' END AS urgency FROM orders) SELECT urgency, CASE urgency WHEN 'em' THEN 'D' WHEN 'sc' THEN 'A' END AS mapped_label, count(*) AS n FROM r GROUP BY ALL",
    "cost_scenario": "SELECT o_orderkey, component, category, CAST(n * unit AS DOUBLE) AS cost FROM (SELECT o_orderkey, CAST(floor(o_totalprice / 1000) + 1 AS DECIMAL(12, 0)) AS n FROM orders) o CROSS JOIN (SELECT component, category, CAST(unit AS DECIMAL(12, 6)) AS unit FROM (VALUES ('teacher_generation', 'compute', '0.072'), ('sft', 'compute', '0.013266'), ('sweep', 'compute', '0.006633'), ('evaluation', 'compute', '0.002052'), ('on_policy', 'compute', '0.03063'), ('clinician_review', 'human', '72'), ('total:compute', 'total', '0.124581'), ('total:human', 'total', '72'), ('total:all', 'total', '72.124581'), ('seed_preparation', 'seed', '63')) t(component, category, unit)) u",
}

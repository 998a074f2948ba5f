"""Operators on small frames: fixed examples, edge cases, and closed-form values."""

import json
import math
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from evalloom.functions import labels as L
from evalloom.functions import rules
from evalloom.functions import text as T
from evalloom.operators import agreement, benchmark, cost, frontier, logs, relations, replay, schema_check, screen, selection, usage
from evalloom.sources import files
from evalloom.streaming import attempts as live


def one(spark, column, **values):
    cols = [F.lit(v).alias(k) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]).alias(k) for k, v in values.items()]
    return spark.range(1).select(*cols).select(column.alias("x")).head().x


@pytest.mark.parametrize(("level", "label", "edge"), [(1.0, "D", False), (1.5, "C|D", True), (3.5, "B|C", True), (4.5, "A|B", True), (5.5, "A", False), (4.3333, "B", False), (4.6667, "A", False), (2.5, "C", False), (9.0, "D", False)])
def test_levels(spark, level, label, edge):
    assert tuple(one(spark, L.level_label(F.lit(level)), a=1)) == (label, edge)


@pytest.mark.parametrize(("votes", "median"), [([1.0], 1.0), ([1.0, 2.0], 1.5), ([1.0, 3.0], 3.0), ([2.0, 2.5], 2.5), ([1.0, 4.0], 2.5), ([4.0, 1.0, 2.0], 2.0)])
def test_ordinal_median(spark, votes, median):
    assert one(spark, L.ordinal_median(F.col("v")), v=votes) == median


def parts(v):
    return [v] if v % 1 == 0 else [v - 0.5, v + 0.5]


def gap(a, b):
    return min((x - y) ** 2 for x in parts(a) for y in parts(b))


def test_set_distance_of_all_pairs(spark):
    vs = sorted(L.ORDINAL.values())
    df = spark.createDataFrame([(a, b) for a in vs for b in vs], "a double, b double")
    for r in df.select("a", "b", L.set_distance(F.col("a"), F.col("b")).alias("d")).collect():
        assert r.d == gap(r.a, r.b)


def test_divergences(spark):
    p, q = [1.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0, 1.0]
    assert one(spark, L.jensen_shannon(F.col("p"), F.col("q")), p=p, q=q) == pytest.approx(math.log(2))
    assert one(spark, L.jensen_shannon(F.col("p"), F.col("p")), p=p) == 0
    assert one(spark, L.wasserstein(F.col("p"), F.col("q")), p=p, q=q) == 3.0
    assert one(spark, L.soft_distribution(F.col("v")), v=["A|B", "A", "Remove", " B "]) == [0.5, 0.5, 0.0, 0.0]


def test_alpha_equals_pair_enumeration(spark):
    rng = random.Random(1)
    vs = sorted(L.ORDINAL.values())
    for _ in range(3):
        units = [[rng.choice([*vs, None]) for _ in range(5)] for _ in range(20)]
        got = agreement.alpha(spark.createDataFrame([(u,) for u in units], "v array<double>"), "v").head().alpha
        good = [[x for x in u if x is not None] for u in units]
        seen = [sum(gap(a, b) for a, b in combinations(u, 2)) / math.comb(len(u), 2) for u in good if len(u) > 1]
        pool = [x for u in good for x in u]
        want = sum(gap(a, b) for a, b in combinations(pool, 2)) / math.comb(len(pool), 2)
        assert got == pytest.approx(1 - sum(seen) / len(seen) / want)
    same = spark.createDataFrame([([2.0, 2.0],), ([2.0, 2.0],)], "v array<double>")
    assert agreement.alpha(same, "v").head().alpha == 1.0


def report(spark):
    rows = []
    for task, said in (("qa", {"a": "A", "b": "C", "c": "C"}), ("conv", {"a": "A", "b": "A", "c": "D"})):
        for case, gold in (("a", "A"), ("b", "B"), ("c", "D")):
            rows += [(task, case, "d", gold, "primary", said[case])] * 2
    rows.append(("qa", "e", "d", "A|B", "primary", "A"))
    df = spark.createDataFrame(rows, "task_type string, case_id string, dataset string, gold string, split string, label string")
    return agreement.case_predictions(agreement.severe_mode(df, ["task_type", "case_id", "dataset", "gold", "split"], "label"), expected=2)


def test_report(spark):
    rows = {(r.task_type, r.group_type): r for r in agreement.metrics_by_sets(report(spark)).filter("group_type <> 'label'").collect()}
    qa, conv = rows["qa", "overall"], rows["conv", "overall"]
    assert [round(x, 3) for x in (qa.exact, qa.over, qa.under)] == [0.333, 0.333, 0.333]
    assert [round(x, 3) for x in (conv.exact, conv.over, conv.under)] == [0.667, 0.0, 0.333]
    assert qa.n_total == 3 and rows["qa", "dataset"].group_value if "group_value" in rows else True
    row = agreement.paper_row(agreement.metrics_by_sets(report(spark)), F.lit("m")).head()
    assert (row.qa_exact, row.conv_exact, row.qa_n) == ("0.333", "0.667", 3)
    b = agreement.boundary_metrics(report(spark)).head()
    assert (b.boundary, b.constituent_rate, b.upper_among_constituent) == ("A|B", 1.0, 0.0)


def test_severe_mode_ties_and_invalid(spark):
    rows = [(1, "A"), (1, "D"), (2, "E"), (2, None), (3, "B"), (3, "B"), (3, "D")]
    got = {r.k: (r.mode_prediction, r.n_valid) for r in agreement.severe_mode(spark.createDataFrame(rows, "k int, label string"), ["k"], "label").collect()}
    assert got == {1: ("D", 2), 2: (None, 0), 3: ("B", 3)}


def test_tasks_of_cases_grow_in_number_not_in_rows(spark, monkeypatch):
    from evalloom.plans import agree

    d = "/root/testdata/sf0.001"
    before = sorted(map(tuple, agree.severe_mode(spark, d).collect()), key=str)
    monkeypatch.setattr(relations, "PART_ROWS", 500)
    rows = sum(spark.read.parquet(f"{d}/{t}.parquet").count() for t in ("lineitem", "orders"))
    out = agree.severe_mode(spark, d)
    assert out.rdd.getNumPartitions() == -(-rows // 500)
    assert sorted(map(tuple, out.collect()), key=str) == before


def test_empty_inputs_keep_their_columns(spark):
    none = report(spark).filter("false")
    assert agreement.metrics_by_sets(none).count() == 0 and "within_1" in agreement.metrics_by_sets(none).columns
    assert agreement.confusion(none).count() == 0 and agreement.boundary_metrics(none).count() == 0


def test_consensus_change(spark):
    x = one(spark, L.consensus_change(F.col("v"), F.lit("D"), F.lit("A")), v=[1.0, 1.0, 4.0])
    assert x.rate == pytest.approx(2 / 3) and x.mean_delta == pytest.approx(2.0)
    assert one(spark, L.consensus_change(F.col("v"), F.lit(None).cast("string"), F.lit("A")), v=[1.0]) is None


def test_latency(spark):
    df = spark.createDataFrame([("ok", float(v)) for v in (10, 20, 30, 40, 50)] + [("failed", 999.0)], "status string, ms double")
    got = usage.latency_percentiles(df.withColumn("k", F.lit("qa")).withColumn("gone", F.lit(None)), ["k"], ["ms", "gone"], F.col("status") == "ok")
    r = {x.metric: x for x in got.collect()}
    assert (r["ms"].p50_ms, r["ms"].p95_ms, round(r["ms"].p99_ms, 3), r["ms"].n_success) == (30, 48, 49.6, 5)
    assert r["gone"].n_measured == 0 and r["gone"].coverage == 0 and r["gone"].p50_ms is None


def test_executions(spark):
    ex = spark.createDataFrame([("e", "2026-01-01T00:00:00+00:00", "2026-01-01T00:00:02+00:00", 2, 0), ("x", "bad", None, None, None)], "execution_id string, started_at string, ended_at string, success_count long, failure_count long")
    at = spark.createDataFrame([("e", "a", 1, "retry"), ("e", "a", 2, "success"), ("e", "b", 1, "terminal_error")], "execution_id string, request_key string, attempt_index long, outcome string")
    r = {x.execution_id: x for x in usage.execution_summary(ex, at).collect()}
    e = r["e"]
    assert (e.elapsed_seconds, e.persisted_requests_per_second, e.requests_observed, e.attempts_total, e.retry_attempts, e.attempts_per_request, e.terminal_error_attempts) == (2.0, 1.0, 2, 3, 1, 1.5, 1)
    assert r["x"].elapsed_seconds is None and r["x"].attempts_total == 0 and r["x"].attempts_per_request is None


def test_call_cost_from_published_sums(spark):
    got = one(spark, usage.call_cost(F.lit(3108922), F.lit(15744), F.lit(9176494), (0.25, 0.025, 2.0)), a=1)
    assert got == pytest.approx(19.1266761) and got / 9140 * 1000 == pytest.approx(2.09263, abs=1e-5)


@pytest.mark.parametrize(("text", "label"), [("REASONING: stable\nACUITY: c", "C"), ("A preface\nacuity - D\nACUITY: A", "D"), ("ACUITY: E", None), (None, None)])
def test_answer_label(spark, text, label):
    assert one(spark, T.answer_label(F.lit(text).cast("string")), a=1) == label


def test_answers_and_markers(spark):
    assert one(spark, T.answer_reasoning(F.lit("REASONING: a\nb\nACUITY: C")), a=1) == "a\nb"
    assert one(spark, T.answer_reasoning(F.lit("nothing")), a=1) == ""
    assert one(spark, T.between_markers(F.lit("x About me: y\n Please answer in exactly z")), a=1) == "About me: y"
    assert one(spark, T.between_markers(F.lit(" plain ")), a=1) == "plain"


def test_trigrams_and_segments(spark):
    assert one(spark, T.trigrams(T.words(F.lit("A b, c d a b c"))), a=1) == ["a b c", "b c d", "c d a", "d a b"]
    assert one(spark, T.trigrams(T.words(F.lit("a b"))), a=1) == []
    assert one(spark, T.containment(F.col("p"), F.col("q")), p=["a", "b"], q=["b", "c", "d"]) == 0.5
    assert one(spark, T.segments(F.lit("# One two. Three four!\n- five\n\n2) six? yes")), a=1) == ["One two.", "Three four!", "five", "six? yes"]
    assert one(spark, T.opening(F.col("p")), p=["a" * 150, "b", "c"]) == ["a" * 150]
    assert one(spark, T.opening(F.col("p")), p=["a", "b", "c", "d"]) == ["a", "b", "c"]


def test_placeholders(spark):
    assert one(spark, T.filled(F.lit("{{A}} {{B}}"), {"{{A}}": F.lit("{{B}}"), "{{B}}": F.lit("z")}), a=1) == "z z"
    with pytest.raises(Exception, match="Unresolved placeholder"):
        one(spark, T.filled(F.lit("{{C}}"), {"{{A}}": F.lit("x")}), a=1)


def test_python_rules(spark):
    assert rules.first_object('```json\n{"a": 1}\n```') == '{"a": 1}' and rules.first_object("x {bad} {\"b\": [1]} y") == '{"b": [1]}'
    assert rules.first_object("none") is None and rules.first_object(None) is None
    assert one(spark, rules.tidy(F.col("t")), t="ﬁ\r\n\n\n\n  x") == "fi\n\n x"
    assert rules.ratio("abcd", "bcde") == 0.75 and rules.ratio("abcd", "zzzzzzzzzz", 0.8) == 0.0 and rules.ratio("", "") == 1.0
    got = spark.createDataFrame([("no bleeding",), ("bleeding",), (None,)], "t string").select(rules.tidy(F.col("t")).alias("y"), rules.sequence_ratio("t", "t").alias("r"), rules.object_text("t").alias("o")).collect()
    assert [r.y for r in got] == ["no bleeding", "bleeding", None]


def test_round_robin_equals_taking_turns(spark):
    rng = random.Random(2)
    rows = [(f"c{i:03}", rng.choice("xyz"), rng.randrange(6)) for i in range(60)]
    left = {}
    for r in sorted(rows, key=lambda r: (-r[2], r[0])):
        left.setdefault(r[1], []).append(r)
    want = []
    while len(want) < 25:
        for g in sorted(left, key=lambda g: (-left[g][0][2], g)):
            want.append(left[g].pop(0)[0])
            if not left[g]:
                del left[g]
    df = spark.createDataFrame(rows, "id string, g string, s int")
    assert [r.id for r in selection.diverse_take(df, 25, "g", "s", "id").collect()] == want[:25]
    turns = {r.turn: r.id for r in selection.round_robin(df, "g", "s", "id").collect()}
    assert [turns[k + 1] for k in range(25)] == want[:25]
    quotas = spark.createDataFrame([("x", 100)], "g string, quota int")
    assert selection.short_pools(df, quotas, ["g"]).count() == 1


def test_current_view_keeps_older_timings(spark):
    log = spark.createDataFrame([("k", 1, "failed", 5.0, 100), ("k", 2, "ok", None, 200), ("j", 1, "ok", None, 300)], "key string, at int, status string, ms double, made int")
    got = {r.key: (r.status, r.ms, r.made) for r in logs.current_view(log, ["key"], ["at"], ["status"], ["ms"], "made").collect()}
    assert got == {"k": ("ok", 5.0, 100), "j": ("ok", None, 300)}
    old = logs.migrated(spark.createDataFrame([(7.0,)], "latency_ms double"), {"total_duration_ms": "double", "ttft_ms": "double"}).head()
    assert (old.total_duration_ms, old.ttft_ms, old.timing_source) == (7.0, None, "legacy_aggregate")


def test_stale_and_pending(spark):
    made = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, h string")
    judged = spark.createDataFrame([(1, "a"), (2, "x"), (3, None), (4, "d")], "k int, j string")
    assert {r.k for r in relations.stale(judged, made, ["k"], "j", "h").collect()} == {2, 3, 4}
    tasks = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    assert {r.k for r in relations.pending(tasks, made, ["k"]).collect()} == {None}
    with pytest.raises(relations.CheckFailed, match="repeated"):
        relations.run_checks({"repeated": made, "fine": made.limit(0)})
    with pytest.raises(relations.CheckFailed):
        relations.selected_cases(made, ["zz"], 1, {"a"})


def test_pareto(spark):
    df = spark.createDataFrame([("a", 1.0, 0.8), ("b", 2.0, 0.7), ("c", 2.0, 0.9), ("d", 3.0, 0.9), ("e", None, 1.0)], "id string, x double, y double")
    assert {r.id for r in frontier.pareto(df, "x", "y", "id").collect()} == {"a", "c"}


FACT = {"question_id": "q", "status": "known", "answer": "yes", "evidence_text": ["hurts"]}


def test_replay(spark):
    card = "case_id string, gold string, opening string, maximum_questions int, facts array<struct<question_id:string,status:string,answer:string,evidence_text:array<string>>>, required_question_ids array<string>, red_flag_question_ids array<string>, unsafe_dispositions array<string>"
    facts = [FACT, FACT | {"question_id": "r", "evidence_text": ["else"]}]
    cards = spark.createDataFrame([(c, "C", "It hurts", 2, facts, ["q", "r"], [], ["A", "B"]) for c in ("x", "y", "z", "w")], card)
    rows = [("x", 1, "ASK", "r", None, "?"), ("x", 2, "ASK", "r", None, "?"), ("x", 3, "DISPOSE", None, "B", "why"), ("y", 1, "HANDOFF", None, None, "help"), ("y", 2, "ASK", "q", None, "?"), ("z", 1, "ASK", "nope", None, "?"), ("w", 1, "ASK", "q", None, "?"), ("w", 2, "ASK", "q", None, "?"), ("w", 3, "ASK", "q", None, "?"), ("w", 4, "DISPOSE", None, "C", "ok")]
    acts = spark.createDataFrame(rows, "case_id string, seq int, type string, question_id string, disposition string, content string")
    st = replay.steps(acts)
    errors = {(r.case_id, r.error) for r in replay.trace_errors(st, cards).collect()}
    assert errors == {("y", "action_after_terminal"), ("z", "unknown_question"), ("z", "no_terminal_action"), ("w", "question_limit_exceeded")}
    out = {r.case_id: r for r in replay.outcomes(st, cards).collect()}
    x, y = out["x"], out["y"]
    assert (x.questions_asked, x.repeated_questions, x.required_recall, x.red_flag_recall, x.undertriage, x.exact) == (2, 1, 1.0, 1.0, True, False)
    assert (y.handed_off, y.exact, y.undertriage, y.required_recall) == (True, None, False, 0.5)
    s = replay.trace_summary(replay.outcomes(st, cards).filter("case_id in ('x', 'y')")).head()
    assert (s.trace_count, s.disposed_count, s.undertriage_rate, s.overall_undertriage_action_rate) == (2, 1, 1.0, 0.5)
    t = [(r.sequence, r.kind) for r in replay.transcript(st, cards).filter("case_id = 'x'").orderBy("sequence").collect()]
    assert t == [(0, "OPENING"), (1, "ASK"), (2, "ANSWER"), (3, "ASK"), (4, "ANSWER"), (5, "DISPOSE")]
    assert "gold" not in replay.public_state(st, cards).columns and replay.card_errors(cards).count() == 0
    assert replay.card_errors(cards.withColumn("gold", F.lit("D"))).count() == 4


def test_schema_violations(spark):
    check = lambda s, v: schema_check.violations(json.dumps(v), json.dumps(s))
    assert check({"const": False}, 0) == [] and check({"type": "boolean", "const": False}, 0) != []
    assert check({"type": "integer"}, True) != [] and check({"type": "number", "minimum": 2}, 1) != []
    assert check({"required": ["a"], "properties": {"a": {"type": "null"}}, "additionalProperties": False}, {"a": None}) == []
    assert len(check({"required": ["a"], "properties": {}, "additionalProperties": False}, {"b": 1})) == 2
    assert check({"$defs": {"s": {"type": "string", "pattern": "^x"}}, "items": {"$ref": "#/$defs/s"}, "uniqueItems": True, "minItems": 1}, ["xa", "xa", "b"]) == ["$: repeated items", "$[2]: no match"]
    assert check({"if": {"required": ["a"]}, "then": {"required": ["b"]}, "else": {"required": ["c"]}}, {"a": 1}) == ["$: missing b"]
    rows = [(1, '{"type": "ASK", "question_id": "q", "wording": "w"}'), (2, '{"type": "DISPOSE", "acuity": "E", "rationale": "r"}'), (3, "{"), (4, None)]
    got = {r.k: r.violations for r in schema_check.schema_violations(spark.createDataFrame(rows, "k int, d string"), "k", "d", schema_check.ACTION_SCHEMA).collect()}
    assert got[1] == [] and all(got[k] for k in (2, 3, 4))


def test_screen(spark):
    text = "the quick brown fox jumps over the lazy dog near the old river bank"
    rows = [(1, text), (2, text.upper() + "!"), (3, "short"), (4, "a b c d e f g h i j k l m n o p q r s t u v w x y z acuity: b")]
    c = screen.prepared(spark.createDataFrame(rows, "id int, t string"), "id", "t")
    held = screen.prepared(spark.createDataFrame([(9, text), (8, "other words entirely here")], "id int, t string"), "id", "t").withColumn("ord", -F.col("key"))
    near = screen.near_duplicates(c, 0.82, 0.65)
    assert [(r.key, r.other) for r in near.collect()] == [(2, 1)]
    got = {r.key: r for r in screen.reasons(screen.best_match(c, held, 0.82, 0.65), near, 20, 0.82, 0.65).collect()}
    assert "exact_benchmark_match" in got[1].reasons and got[1].b_key == 9
    assert "generated_near_duplicate:1" in got[2].reasons and got[3].reasons == ["too_short_for_reliable_lexical_screen"]
    assert got[4].reasons == ["acuity_label_leaked_into_vignette"]


def test_texts_of_a_screen_are_cut_into_words_once(spark):
    rows = [(1, "One two, three FOUR"), (2, "one two"), (3, ""), (4, None), (5, "two three four two three four")]
    a = screen.prepared(spark.createDataFrame(rows, "id int, t string").repartition(2), "id", "t")
    b = screen.prepared(spark.createDataFrame([(7, "two three four five"), (8, "x"), (9, None)], "id int, t string").repartition(2), "id", "t")
    out = screen.shared_trigrams(a, b)
    assert sorted(map(tuple, out.collect())) == [(1, 7, 0.5), (5, 7, 0.5)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2, plan  # once a side: neither filters nor sizes compute words or trigrams anew
    assert [tuple(r) for r in screen.contained_pairs(a, 0.5).collect()] == [(5, 1)]


def test_routing_of_fragments(spark):
    f = spark.createDataFrame([("c", 0, "it hurts"), ("c", 1, "since monday"), ("c", 2, "since monday"), ("c", 3, "thanks")], "case string, idx int, fragment string")
    p = spark.createDataFrame([("when", "since"), ("pain", "hurts")], "slot string, pattern string")
    got = {r.slot: r.evidence for r in screen.routed(f, p, f.filter("idx = 0").select("case", "fragment")).collect()}
    assert got == {"pain": ["it hurts"], "when": ["since monday"], "context.additional": ["since monday", "thanks"]}


def test_panel_audit(spark):
    rows = [("a", ["A", "A", "B", "A", "A"], list("vwxyz"), 0, 0.4, "median", "A"), ("b", ["Remove"] * 3 + ["A", "D"], list("vwxyy"), 3, 9.0, "excluded_review", ""), ("c", ["A", "A", "A", "A", None], list("vwxyz"), 1, 0.0, "median", "B")]
    df = spark.createDataFrame(rows, "id string, votes array<string>, raters array<string>, remove_votes int, avg_sd double, mapping_method string, normalized_label string")
    got = {(r.id, r.problem) for r in benchmark.audit_panel(df, "votes", "raters", "id").collect()}
    assert got == {("b", "repeated_rater"), ("c", "incomplete_panel"), ("c", "remove_votes_differ"), ("c", "label_differs")}


def test_cost_scenario(spark):
    from evalloom.plans.cases import ASSUMED

    got = {r.component: float(r.cost) for r in cost.scenario(spark.sql(ASSUMED)).collect()}
    assert got == {"teacher_generation": 36, "sft": 6.633, "sweep": 3.3165, "evaluation": 1.026, "on_policy": 15.315, "clinician_review": 36000}
    assert {r.category: float(r.cost) for r in cost.totals(cost.scenario(spark.sql(ASSUMED))).collect()}["all"] == 36062.2905


def test_writes_are_committed(spark, tmp_path):
    rows = [(i % 7, "é" * (i % 5)) for i in range(500)]
    df, out = spark.createDataFrame(rows, "a int, b string"), f"file://{tmp_path}/rows"
    assert files.write_once(df, out) and not files.write_once(spark.createDataFrame(rows[::-1], df.schema).repartition(5), out)
    assert files.read_committed(spark, out, df.schema).count() == 500
    for other in (rows[1:], [*rows, rows[0]], [*rows[1:], (0, "x")], []):
        with pytest.raises(relations.CheckFailed, match="other rows"):
            files.write_once(spark.createDataFrame(other, df.schema), out)
    files.write_jsonl(df, f"file://{tmp_path}/foreign")  # rows without a digest: the same are taken over, others never overwritten
    with pytest.raises(relations.CheckFailed, match="not written to its end"):
        files.read_committed(spark, f"file://{tmp_path}/foreign", df.schema)
    with pytest.raises(relations.CheckFailed, match="other rows"):
        files.write_once(df.limit(3), f"file://{tmp_path}/foreign")
    assert not files.write_once(df, f"file://{tmp_path}/foreign") and files.read_committed(spark, f"file://{tmp_path}/foreign", df.schema).count() == 500
    (tmp_path / "broken" / "_temporary" / "0").mkdir(parents=True)
    assert files.write_once(df, f"file://{tmp_path}/broken") and files.read_committed(spark, f"file://{tmp_path}/broken", df.schema).count() == 500
    none = spark.createDataFrame([], df.schema)
    assert files.write_once(none, f"file://{tmp_path}/none") and not files.write_once(none, f"file://{tmp_path}/none")


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(2, "x\ny", float("nan"), {"b": 1, "a": 2})], "b int, a string, n double, m map<string,int>")
    assert files.sorted_json(df).head().value == '{"a":"x\\ny","b":2,"m":{"a":2,"b":1},"n":null}'
    out = f"file://{tmp_path}/once"
    assert files.write_once(df, out) and not files.write_once(df, out)
    with pytest.raises(relations.CheckFailed):
        files.write_once(df.withColumn("b", F.lit(3)), out)
    files.append_jsonl(df, out)
    assert files.read_jsonl(spark, out, "b int, a string").count() == 2
    assert files.read_jsonl(spark, f"file://{tmp_path}/none", "b int", allow_missing=True).count() == 0
    (tmp_path / "bad.jsonl").write_text('{"b": 1}\n\n{oops\n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, f"file://{tmp_path}/bad.jsonl", "b int").collect()
    files.write_small_csv(df.select("b", "a"), f"file://{tmp_path}/csv")
    assert files.read_csv(spark, f"file://{tmp_path}/csv", "b int, a string").head().a == "x\ny"
    (tmp_path / "ids.txt").write_text(" a \n\nb\na\n")
    assert {r.value for r in files.read_lines(spark, f"file://{tmp_path}/ids.txt").collect()} == {"a", "b"}
    for name, body in (("l", '[{"type":"ASK"},{"type":"DISPOSE"}]'), ("o", '{"actions":[{"type":"ASK"},{"type":"DISPOSE"}]}'), ("j", '{"type":"ASK"}\n{"type":"DISPOSE"}\n')):
        (tmp_path / name).write_text(body)
        assert [json.loads(r.action)["type"] for r in files.read_actions(spark, f"file://{tmp_path}/{name}").orderBy("seq").collect()] == ["ASK", "DISPOSE"]
    assert files.markdown(df.select("b", "a")) == "| b | a |\n| --- | --- |\n| 2 | x y |\n"
    assert json.loads(files.manifest({"k": 1}, {"t": df.select("b")})) == {"k": 1, "t": [{"b": 2}]}
    assert files.scatter_svg([{"x": 1, "y": 2, "n": "<m>"}], "x", "y", "n", "t").count("<circle") == 1
    assert files.query(spark, "SELECT b FROM t WHERE b = :n", {"t": df}, n=2).count() == 1


def test_verified_files(spark, tmp_path):
    import hashlib

    (tmp_path / "a.bin").write_bytes(b"abc")
    lock = spark.createDataFrame([("a.bin", hashlib.sha256(b"abc").hexdigest(), 3), ("b.bin", "x", 1)], "name string, sha256 string, bytes long")
    report, bad = files.verified_files(spark, [f"file://{tmp_path}/a.bin"], lock)
    assert report.count() == 2 and [r.name for r in bad.collect()] == ["b.bin"]


def test_live_view(spark, tmp_path):
    schema = "execution_id string, request_key string, attempt_index int, outcome string, request_wall_ms double, ts timestamp"
    log = tmp_path / "log"
    log.mkdir()
    row = lambda k, m, o: json.dumps({"execution_id": "e", "request_key": k, "attempt_index": 1, "outcome": o, "request_wall_ms": 5.0, "ts": f"2026-01-01T00:{m:02}:00Z"})
    (log / "1.jsonl").write_text("\n".join([row("a", 1, "success"), row("a", 1, "success"), row("b", 2, "terminal_error")]))
    (log / "2.jsonl").write_text(row("z", 59, "success"))
    q = live.to_parquet(live.live_summary(live.attempts(spark, f"file://{log}", schema, files=1)), f"file://{tmp_path}/out", f"file://{tmp_path}/chk")
    q.awaitTermination(120)
    got = spark.read.parquet(f"file://{tmp_path}/out").collect()
    assert [(r.attempts, r.failures) for r in got] == [(2, 1)]

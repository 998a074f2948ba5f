"""Deterministic replay of multi-turn traces against case cards, by windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalloom.functions.labels import rank

ACTIONS = ("ASK", "DISPOSE", "HANDOFF")


# The fields that an action of each type has, beside its version, and how long texts may be.
FIELDS = {"ASK": {"question_id": 200, "wording": 1000}, "DISPOSE": {"acuity": 1, "rationale": 2000}, "HANDOFF": {"reason": 1000, "target": 15}}
TARGET = "human_clinician"


def action_errors(actions: DataFrame, key: str, action: str, version: str, questions: list[str]) -> DataFrame:
    """(key, error): actions, as JSON objects, that aren't exactly what their type asks for.

    Text that is no object is not_an_object; a field that is no string counts as blank.
    """
    a = F.col(action)
    keys = F.json_object_keys(a)
    kind = F.get_json_object(a, "$.type")
    value = lambda f: F.try_variant_get(F.try_parse_json(a), f"$.{f}", "string")
    is_text = lambda f: F.schema_of_variant(F.try_variant_get(F.try_parse_json(a), f"$.{f}", "variant")) == "STRING"
    rules = [(keys.isNull(), "not_an_object"), (keys.isNotNull() & ~F.coalesce(value("schema_version") == version, F.lit(False)), "wrong_version"), (keys.isNotNull() & ~F.coalesce(kind.isin(*FIELDS), F.lit(False)), "unknown_type")]
    for name, fields in FIELDS.items():
        mine = F.coalesce(kind == name, F.lit(False))
        rules.append((mine & (F.array_sort(keys) != F.array(*[F.lit(x) for x in sorted({"schema_version", "type", *fields})])), "wrong_fields"))
        for f, most in fields.items():
            rules.append((mine & ~F.coalesce(is_text(f) & (F.trim(value(f)) != "") & (F.length(value(f)) <= most), F.lit(False)), f"bad_{f}"))
    rules += [((kind == "ASK") & ~F.coalesce(value("question_id").isin(questions), F.lit(False)), "bad_question_id"), ((kind == "DISPOSE") & ~F.coalesce(value("acuity").isin("A", "B", "C", "D"), F.lit(False)), "bad_acuity"), ((kind == "HANDOFF") & ~F.coalesce(value("target") == TARGET, F.lit(False)), "bad_target")]
    found = F.array_distinct(F.filter(F.array(*[F.when(c, F.lit(e)) for c, e in rules]), lambda e: e.isNotNull()))
    return actions.select(key, F.explode(found).alias("error"))


def steps(actions: DataFrame) -> DataFrame:
    """actions (case_id, seq, type, question_id, ...) with question number, repeat and after-the-end flags."""
    order = W.partitionBy("case_id").orderBy("seq")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    same = W.partitionBy("case_id", "type", "question_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    asks = F.col("type") == "ASK"
    ended = F.coalesce(F.max(F.when(asks, 0).otherwise(1)).over(before), F.lit(0)) == 1
    return actions.withColumns({"question_number": F.when(asks, F.sum(F.when(asks, 1).otherwise(0)).over(upto)), "repeated": F.when(asks, F.count("*").over(same) > 0), "after_end": ended})


def trace_errors(stepped: DataFrame, cards: DataFrame) -> DataFrame:
    """(case_id, error): what would stop a replay. cards: case_id, facts, maximum_questions."""
    j = stepped.join(cards.select("case_id", "maximum_questions", F.transform("facts", lambda f: f["question_id"]).alias("known")), "case_id")
    rules = [
        (F.col("after_end"), "action_after_terminal"),
        (F.col("question_number") > F.col("maximum_questions"), "question_limit_exceeded"),
        ((F.col("type") == "ASK") & ~F.array_contains("known", F.coalesce("question_id", F.lit(""))), "unknown_question"),
        (~F.coalesce(F.col("type").isin(*ACTIONS), F.lit(False)), "unknown_action"),
    ]
    found = j.select("case_id", F.explode(F.filter(F.array(*[F.when(c, F.lit(e)) for c, e in rules]), lambda e: e.isNotNull())).alias("error"))
    open_ = stepped.groupBy("case_id").agg(F.max(F.col("type").isin("DISPOSE", "HANDOFF")).alias("ended")).filter("NOT ended").select("case_id", F.lit("no_terminal_action").alias("error"))
    return found.union(open_).distinct()


def card_errors(cards: DataFrame) -> DataFrame:
    """(case_id, error): cards that contradict themselves."""
    ids = F.transform("facts", lambda f: f["question_id"])
    below = F.filter(F.array(*[F.lit(x) for x in "ABCD"]), lambda x: x < F.col("gold"))
    rules = [
        (F.size(F.array_distinct(ids)) != F.size(ids), "duplicate_fact"),
        (F.size(F.array_except("required_question_ids", ids)) > 0, "required_question_unknown"),
        (F.size(F.array_except("red_flag_question_ids", ids)) > 0, "red_flag_question_unknown"),
        (F.array_sort("unsafe_dispositions") != F.array_sort(below), "unsafe_dispositions_wrong"),
    ]
    return cards.select("case_id", F.explode(F.filter(F.array(*[F.when(c, F.lit(e)) for c, e in rules]), lambda e: e.isNotNull())).alias("error"))


def visible(cards: DataFrame) -> Column:
    """Questions that the opening already answers."""
    seen = F.filter("facts", lambda f: (f["status"] == "known") & F.exists(f["evidence_text"], lambda e: F.contains(F.col("opening"), e)))
    return F.array_sort(F.array_distinct(F.transform(seen, lambda f: f["question_id"])))


def answers(stepped: DataFrame, cards: DataFrame) -> DataFrame:
    """What each question is answered."""
    facts = cards.select("case_id", F.explode("facts").alias("f")).select("case_id", F.col("f.question_id").alias("question_id"), F.col("f.answer").alias("answer"), F.col("f.status").alias("fact_status"))
    return stepped.filter("type = 'ASK' AND NOT after_end").join(facts, ["case_id", "question_id"]).select("case_id", "seq", "question_id", "question_number", "repeated", "answer", "fact_status")


def coverage(required: Column, observed: Column) -> Column:
    """Recall of the required questions; 1 where none is."""
    need = F.array_distinct(required)
    return F.when(F.size(need) > 0, F.size(F.array_intersect(need, observed)) / F.size(need)).otherwise(F.lit(1.0))


def outcomes(stepped: DataFrame, cards: DataFrame) -> DataFrame:
    """One row per trace that ended: how it ended, and what was asked until then."""
    live = stepped.filter("NOT after_end")
    asked = live.groupBy("case_id").agg(F.count_if(F.col("type") == "ASK").alias("questions_asked"), F.collect_set(F.when(F.col("type") == "ASK", F.col("question_id"))).alias("asked"), F.max_by(F.when(F.col("type") != "ASK", F.struct("type", "disposition")), F.when(F.col("type") != "ASK", F.col("seq"))).alias("end")).filter("end IS NOT NULL")
    j = asked.join(cards.withColumn("visible", visible(cards)), "case_id")
    seen = F.array_union("asked", "visible")
    disposed = F.col("end.type") == "DISPOSE"
    error = F.when(disposed, rank(F.col("end.disposition")) - rank(F.col("gold")))
    return j.select("case_id", "gold", F.col("end.type").alias("terminal_action"), F.when(disposed, F.col("end.disposition")).alias("predicted"), "questions_asked", F.size("asked").alias("unique_questions_asked"), (F.col("questions_asked") - F.size("asked")).alias("repeated_questions"), coverage(F.col("required_question_ids"), seen).alias("required_recall"), coverage(F.col("red_flag_question_ids"), seen).alias("red_flag_recall"), (error == 0).alias("exact"), error.alias("signed_error"), F.coalesce(error < 0, F.lit(False)).alias("undertriage"), F.coalesce(error > 0, F.lit(False)).alias("overtriage"), (~disposed).alias("handed_off"))


def trace_summary(o: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rates over traces. Undertriage and accuracy divide by disposed traces, the overall ones by all."""
    n, disposed = F.count("*"), F.count_if(~F.col("handed_off"))
    exact, under = F.count_if("exact"), F.count_if("undertriage")

    def rate(a: Column, b: Column) -> Column:
        return F.try_divide(a.cast("double"), b)

    return o.groupBy(*(by or [])).agg(n.alias("trace_count"), disposed.alias("disposed_count"), F.count_if("handed_off").alias("handoff_count"), rate(exact, n).alias("overall_correct_disposition_rate"), rate(exact, disposed).alias("autonomous_exact_accuracy"), rate(F.count_if("handed_off"), n).alias("handoff_rate"), rate(under, disposed).alias("undertriage_rate"), rate(under, disposed).alias("unsafe_disposition_rate"), rate(under, n).alias("overall_undertriage_action_rate"), rate(under, n).alias("overall_unsafe_action_rate"), F.avg("questions_asked").alias("mean_questions_asked"), F.avg("required_recall").alias("mean_required_question_recall"), F.avg("red_flag_recall").alias("mean_red_flag_question_recall"))


def transcript(stepped: DataFrame, cards: DataFrame) -> DataFrame:
    """(case_id, sequence, role, kind, content): opening, question and answer pairs, and the end."""
    start = cards.select("case_id", F.lit(0).cast("long").alias("sequence"), F.lit("patient").alias("role"), F.lit("OPENING").alias("kind"), F.col("opening").alias("content"))
    live = stepped.filter("NOT after_end")
    said = answers(stepped, cards).select("case_id", "seq", "answer")
    asks = live.filter("type = 'ASK'").join(said, ["case_id", "seq"])
    pair = F.array(F.struct((2 * F.col("question_number") - 1).alias("sequence"), F.lit("clinician").alias("role"), F.lit("ASK").alias("kind"), F.col("content").alias("content")), F.struct((2 * F.col("question_number")).alias("sequence"), F.lit("patient").alias("role"), F.lit("ANSWER").alias("kind"), F.col("answer").alias("content")))
    middle = asks.select("case_id", F.explode(pair).alias("p")).select("case_id", "p.*")
    count = live.groupBy("case_id").agg((2 * F.count_if(F.col("type") == "ASK") + 1).alias("sequence"))
    end = live.filter("type <> 'ASK'").join(count, "case_id").select("case_id", "sequence", F.lit("clinician").alias("role"), F.col("type").alias("kind"), "content")
    return start.unionByName(middle).unionByName(end)


def public_state(stepped: DataFrame, cards: DataFrame) -> DataFrame:
    """What a policy may see: no reference label, no facts."""
    at = stepped.filter("NOT after_end").groupBy("case_id").agg(F.count_if(F.col("type") == "ASK").alias("questions_asked"), F.max(F.col("type") != "ASK").alias("terminal"))
    return cards.join(at, "case_id", "left").select("case_id", F.col("opening").alias("opening_utterance"), F.coalesce("questions_asked", F.lit(0)).alias("questions_asked"), (F.col("maximum_questions") - F.coalesce("questions_asked", F.lit(0))).alias("questions_remaining"), F.coalesce("terminal", F.lit(False)).alias("terminal"))

"""Queries of the agreement family."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.functions.labels import consensus_change, jensen_shannon, level_label, ordinal, ordinal_median, soft_distribution, wasserstein
from evalloom.operators import agreement as A
from evalloom.operators.benchmark import panel
from evalloom.operators.relations import in_parts
from evalloom.plans.base import base, sql, stored, with_base

KEYS = ["task_type", "case_id", "dataset", "gold", "split"]


def cases(spark, d):
    rows = stored(spark, d, "lineitem").count() + stored(spark, d, "orders").count()  # of samples, and of gold at most
    samples, gold = in_parts([base(spark, d, "samples"), base(spark, d, "gold")], ["case_id"], rows)
    joined = samples.join(gold, "case_id")
    return A.case_predictions(A.severe_mode(joined, KEYS, "label"), expected=4)


CASES = """, c AS (SELECT task_type, case_id, dataset, gold, split, count(*) AS n_present, count(*) FILTER (label IN ('A', 'B', 'C', 'D')) AS n_valid,
  count(*) FILTER (label = 'A') AS a, count(*) FILTER (label = 'B') AS b, count(*) FILTER (label = 'C') AS cc, count(*) FILTER (label = 'D') AS d
  FROM samples JOIN gold USING (case_id) GROUP BY ALL),
m AS (SELECT *, CASE greatest(a, b, cc, d) WHEN 0 THEN NULL WHEN d THEN 'D' WHEN cc THEN 'C' WHEN b THEN 'B' ELSE 'A' END AS mode_prediction, 4 AS n_expected,
  CASE WHEN length(gold) = 1 THEN ascii(gold) - 65 END AS g FROM c),
p AS (SELECT *, ascii(mode_prediction) - 65 AS r FROM m),
cases AS (SELECT task_type, case_id, dataset, gold, split, mode_prediction, n_present, n_valid, n_expected, CAST(r = g AS INT) AS exact, CAST(r > g AS INT) AS "over", CAST(r < g AS INT) AS under, CAST(abs(r - g) AS INT) AS ordinal_distance FROM p)
"""
RATES = """count(*) AS n_total, count(mode_prediction) AS n_evaluable, count(*) - count(mode_prediction) AS n_all_invalid, CAST(sum(n_expected - n_valid) AS BIGINT) AS invalid_samples,
 round(sum(exact) / nullif(count(mode_prediction), 0), 6) AS exact, round(sum("over") / nullif(count(mode_prediction), 0), 6) AS "over", round(sum(under) / nullif(count(mode_prediction), 0), 6) AS under,
 round(count(*) FILTER (ordinal_distance <= 1) / nullif(count(mode_prediction), 0), 6) AS within_1"""


def rounded(df, *names, places=6):
    return df.withColumns({n: F.round(n, places) for n in names})


def metrics(spark, d):
    return A.metrics_by_sets(cases(spark, d))


def agree_grouping_sets(spark, d):
    return rounded(metrics(spark, d), "exact", "over", "under", "within_1")


def severe_mode(spark, d):
    return cases(spark, d).select("task_type", "case_id", "mode_prediction", "n_present", "n_valid", "exact", "over", "under", "ordinal_distance")


def confusion_matrix(spark, d):
    return A.confusion(cases(spark, d))


def boundary_metrics(spark, d):
    return rounded(A.boundary_metrics(cases(spark, d)), "constituent_rate", "upper_among_constituent", "outside_high_rate", "outside_low_rate")


def paper_table_pivot(spark, d):
    return A.paper_row(metrics(spark, d), F.lit("all"))


def panels(spark, d):
    """(case_id, votes): five slots in order, null where there is no vote."""
    rows = base(spark, d, "votes").groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "vote"))).alias("m"))
    return rows.select("case_id", F.transform(F.sequence(F.lit(1), F.lit(5)), lambda s: F.try_element_at("m", s)).alias("votes"))


def scores(spark, d):
    return panels(spark, d).withColumn("scores", F.transform("votes", ordinal))


def given():
    return F.filter("scores", lambda v: v.isNotNull())


def ordinal_medians(spark, d):
    return scores(spark, d).filter(F.size(given()) > 0).select("case_id", F.size(given()).cast("long").alias("n"), ordinal_median(given()).alias("median"))


ORDS = """, v AS (SELECT case_id, slot, vote, CASE vote WHEN 'A' THEN 1.0 WHEN 'A|B' THEN 1.5 WHEN 'B' THEN 2.0 WHEN 'B|C' THEN 2.5 WHEN 'C' THEN 3.0 WHEN 'C|D' THEN 3.5 WHEN 'D' THEN 4.0 END::DOUBLE AS o FROM votes),
l AS (SELECT case_id, list(o ORDER BY o) FILTER (o IS NOT NULL) AS s, count(*) FILTER (vote = 'Remove') AS removed FROM v GROUP BY case_id),
med AS (SELECT case_id, s, removed, len(s) AS n, CASE WHEN len(s) % 2 = 1 THEN s[len(s) // 2 + 1] WHEN s[len(s) // 2] = s[len(s) // 2 + 1] THEN s[len(s) // 2] WHEN (s[len(s) // 2] + s[len(s) // 2 + 1]) / 2 IN (1.5, 2.5, 3.5) THEN (s[len(s) // 2] + s[len(s) // 2 + 1]) / 2 ELSE s[len(s) // 2 + 1] END AS median FROM l)
"""
PAIRS = """, pr AS (SELECT x.case_id, avg(power(greatest(0, abs(x.o - y.o) - CASE WHEN x.o % 1 <> 0 THEN 0.5 ELSE 0 END - CASE WHEN y.o % 1 <> 0 THEN 0.5 ELSE 0 END), 2)) AS dist FROM v x JOIN v y ON x.case_id = y.case_id AND x.slot < y.slot AND x.o IS NOT NULL AND y.o IS NOT NULL GROUP BY x.case_id)
"""


def panel_routing(spark, d):
    said = panel("votes")
    return panels(spark, d).select("case_id", F.size(F.filter("votes", lambda v: v == "Remove")).cast("long").alias("remove_votes"), F.round(said["avg_distance"], 9).alias("avg_distance"), said["mapping_method"].alias("mapping_method"), said["panel_label"].alias("panel_label"))


def panel_alpha(spark, d):
    return rounded(A.alpha(scores(spark, d), "scores"), "alpha", places=9)


def predictions(spark, d):
    qa = base(spark, d, "samples").filter("task_type = 'qa'")
    return A.severe_mode(qa, ["case_id"], "label").select("case_id", "mode_prediction")


def panel_alpha_loo(spark, d):
    joined = scores(spark, d).join(predictions(spark, d), "case_id", "left")
    return rounded(A.alpha_leave_one_out(joined, "scores", "mode_prediction").select("slot", "n_units", "alpha"), "alpha", places=9)


PRED = """, pc AS (SELECT case_id, count(*) FILTER (label = 'A') AS a, count(*) FILTER (label = 'B') AS b, count(*) FILTER (label = 'C') AS cc, count(*) FILTER (label = 'D') AS d FROM samples WHERE task_type = 'qa' GROUP BY case_id),
pred AS (SELECT case_id, CASE greatest(a, b, cc, d) WHEN 0 THEN NULL WHEN d THEN 'D' WHEN cc THEN 'C' WHEN b THEN 'B' ELSE 'A' END AS mode_prediction FROM pc)
"""


def consensus_loo(spark, d):
    joined = scores(spark, d).join(predictions(spark, d), "case_id").join(base(spark, d, "gold").select("case_id", "gold"), "case_id")
    found = joined.select("case_id", consensus_change(F.col("scores"), F.col("mode_prediction"), F.col("gold")).alias("x")).filter("x IS NOT NULL")
    return found.select("case_id", F.round("x.rate", 9).alias("change_rate"), F.round("x.mean_delta", 9).alias("mean_delta"))


def distances(spark, d):
    """Per case: the votes' soft distribution against the samples'."""
    soft = panels(spark, d).select("case_id", soft_distribution(F.col("votes")).alias("p")).filter("p IS NOT NULL")
    n = [F.count_if(F.col("label") == x) for x in "ABCD"]
    valid = F.count_if(F.col("label").isin(*"ABCD"))
    model = base(spark, d, "samples").groupBy("case_id").agg(F.when(valid > 0, F.array(*[c / valid for c in n])).alias("q")).filter("q IS NOT NULL")
    return soft.join(model, "case_id").select("case_id", jensen_shannon(F.col("p"), F.col("q")).alias("jsd"), wasserstein(F.col("p"), F.col("q")).alias("w1"))


def distribution_distances(spark, d):
    return rounded(distances(spark, d), "jsd", "w1", places=9)


def panel_summary(spark, d):
    joined = distances(spark, d).join(base(spark, d, "gold").select("case_id", "dataset"), "case_id")
    return rounded(A.panel_summary(joined, ["jsd", "w1"], ["dataset"]), "mean_jsd", "mean_w1")


DIST = """, sp AS (SELECT case_id, count(*) AS n, sum(CASE vote WHEN 'A' THEN 1 WHEN 'A|B' THEN 0.5 ELSE 0 END)::DOUBLE / count(*) AS p1, sum(CASE vote WHEN 'B' THEN 1 WHEN 'A|B' THEN 0.5 WHEN 'B|C' THEN 0.5 ELSE 0 END)::DOUBLE / count(*) AS p2, sum(CASE vote WHEN 'C' THEN 1 WHEN 'B|C' THEN 0.5 WHEN 'C|D' THEN 0.5 ELSE 0 END)::DOUBLE / count(*) AS p3, sum(CASE vote WHEN 'D' THEN 1 WHEN 'C|D' THEN 0.5 ELSE 0 END)::DOUBLE / count(*) AS p4 FROM votes WHERE vote <> 'Remove' GROUP BY case_id),
sq AS (SELECT case_id, count(*) FILTER (label = 'A') / count(*) AS q1, count(*) FILTER (label = 'B') / count(*) AS q2, count(*) FILTER (label = 'C') / count(*) AS q3, count(*) FILTER (label = 'D') / count(*) AS q4 FROM samples WHERE label <> 'E' GROUP BY case_id),
dd AS (SELECT case_id, abs(p1 - q1) + abs(p1 + p2 - q1 - q2) + abs(p1 + p2 + p3 - q1 - q2 - q3) + abs(p1 + p2 + p3 + p4 - q1 - q2 - q3 - q4) AS w1,
 0.5 * (""" + " + ".join(f"CASE WHEN p{k} > 0 THEN p{k} * ln(p{k} / ((p{k} + q{k}) / 2)) ELSE 0 END + CASE WHEN q{k} > 0 THEN q{k} * ln(q{k} / ((p{k} + q{k}) / 2)) ELSE 0 END" for k in range(1, 5)) + """) AS jsd FROM sp JOIN sq USING (case_id))
"""


def level_map(spark, d):
    levels = sql(spark, d, "SELECT l_orderkey, l_linenumber, CAST(1 + (l_partkey % 11) * 0.5 AS DOUBLE) + CASE WHEN l_suppkey % 3 = 0 THEN 0.3333 ELSE 0 END AS level FROM {lineitem}")
    return levels.select("l_orderkey", "l_linenumber", level_label(F.col("level")).alias("x")).select("l_orderkey", "l_linenumber", "x.label", "x.is_edge")


QUERIES = {
    "agree_grouping_sets": agree_grouping_sets,
    "severe_mode": severe_mode,
    "confusion_matrix": confusion_matrix,
    "boundary_metrics": boundary_metrics,
    "paper_table_pivot": paper_table_pivot,
    "ordinal_median": ordinal_medians,
    "panel_routing": panel_routing,
    "panel_alpha": panel_alpha,
    "panel_alpha_loo": panel_alpha_loo,
    "consensus_loo": consensus_loo,
    "distribution_distances": distribution_distances,
    "panel_summary": panel_summary,
    "level_map": level_map,
}

ALPHA = """round(CASE WHEN coalesce(e, 0) = 0 THEN 1.0 ELSE 1 - o / (e / (n * (n - 1) / 2)) END, 9) AS alpha"""
SQL = {
    "agree_grouping_sets": with_base(["samples", "gold"], CASES + f", k AS (SELECT * FROM cases WHERE split = 'primary' AND length(gold) = 1) SELECT task_type, 'overall' AS group_type, 'all' AS group_value, {RATES} FROM k GROUP BY task_type UNION ALL SELECT task_type, 'dataset', dataset, {RATES} FROM k GROUP BY task_type, dataset UNION ALL SELECT task_type, 'label', gold, {RATES} FROM k GROUP BY task_type, gold"),
    "severe_mode": with_base(["samples", "gold"], CASES + 'SELECT task_type, case_id, mode_prediction, n_present, n_valid, exact, "over", under, ordinal_distance FROM cases'),
    "confusion_matrix": with_base(["samples", "gold"], CASES + "SELECT t.task_type, l.x AS \"true\", " + ", ".join(f"count(*) FILTER (mode_prediction = '{x}') AS pred_{x}" for x in "ABCD") + " FROM (SELECT DISTINCT task_type FROM cases) t CROSS JOIN (VALUES ('A'), ('B'), ('C'), ('D')) l(x) LEFT JOIN cases c ON c.task_type = t.task_type AND c.gold = l.x AND split = 'primary' GROUP BY ALL"),
    "boundary_metrics": with_base(["samples", "gold"], CASES + """, b AS (SELECT task_type, gold AS boundary, mode_prediction AS m, substr(gold, 1, 1) AS lo, substr(gold, 3, 1) AS hi FROM cases WHERE split = 'primary' AND length(gold) = 3)
SELECT task_type, boundary, count(*) AS n_total, count(m) AS n_evaluable, round(count(*) FILTER (m IN (lo, hi)) / nullif(count(m), 0), 6) AS constituent_rate, round(count(*) FILTER (m = hi) / nullif(count(*) FILTER (m IN (lo, hi)), 0), 6) AS upper_among_constituent, round(count(*) FILTER (m > hi) / nullif(count(m), 0), 6) AS outside_high_rate, round(count(*) FILTER (m < lo) / nullif(count(m), 0), 6) AS outside_low_rate FROM b GROUP BY ALL"""),
    "paper_table_pivot": with_base(["samples", "gold"], CASES + f", k AS (SELECT task_type, count(mode_prediction) AS n, sum(exact) / count(mode_prediction) AS e, sum(\"over\") / count(mode_prediction) AS o, sum(under) / count(mode_prediction) AS u FROM cases WHERE split = 'primary' AND length(gold) = 1 GROUP BY task_type) SELECT 'all' AS model, " + ", ".join(f"max(n) FILTER (task_type = '{t}') AS {t}_n, " + ", ".join(f"printf('%.3f', round_even(max({c}) FILTER (task_type = '{t}'), 4)) AS {t}_{m}" for c, m in (("e", "exact"), ("o", "over"), ("u", "under"))) for t in ("qa", "conv")) + " FROM k"),
    "ordinal_median": with_base(["votes"], ORDS + "SELECT case_id, n, median FROM med WHERE n > 0"),
    "panel_routing": with_base(["votes"], ORDS + PAIRS + "SELECT case_id, removed AS remove_votes, round(coalesce(dist, 0.0), 9) AS avg_distance, CASE WHEN removed >= 3 THEN 'excluded_review' WHEN coalesce(dist, 0) > 0.75 THEN 'excluded_disagreement' ELSE 'median' END AS mapping_method, CASE WHEN removed < 3 THEN (MAP {1.0: 'A', 1.5: 'A|B', 2.0: 'B', 2.5: 'B|C', 3.0: 'C', 3.5: 'C|D', 4.0: 'D'})[median::DECIMAL(2,1)] END AS panel_label FROM med LEFT JOIN pr USING (case_id)"),
    "panel_alpha": with_base(["votes"], ORDS + PAIRS + f", h AS (SELECT o, count(*) AS c FROM v WHERE o IS NOT NULL GROUP BY o), ex AS (SELECT sum(x.c * y.c * power(greatest(0, abs(x.o - y.o) - CASE WHEN x.o % 1 <> 0 THEN 0.5 ELSE 0 END - CASE WHEN y.o % 1 <> 0 THEN 0.5 ELSE 0 END), 2)) AS e FROM h x JOIN h y ON x.o < y.o), ob AS (SELECT avg(dist) AS o, count(*) AS n_units FROM pr), sz AS (SELECT CAST(sum(c) AS BIGINT) AS n FROM h) SELECT n_units, n AS n_votes, {ALPHA} FROM ex, ob, sz"),
    "panel_alpha_loo": with_base(["votes", "samples"], ORDS + PRED + f""", sl AS (SELECT k.slot AS k, v.case_id, v.slot, CASE WHEN v.slot = k.slot + 1 AND o IS NOT NULL AND mode_prediction IS NOT NULL THEN ascii(mode_prediction) - 64.0 ELSE o END AS o FROM v LEFT JOIN pred USING (case_id) CROSS JOIN (SELECT unnest(range(-1, 5)) AS slot) k),
ok AS (SELECT k, case_id FROM sl WHERE o IS NOT NULL GROUP BY ALL HAVING count(*) >= 2), u AS (SELECT sl.* FROM sl JOIN ok USING (k, case_id) WHERE o IS NOT NULL),
q AS (SELECT x.k, x.case_id, avg(power(greatest(0, abs(x.o - y.o) - CASE WHEN x.o % 1 <> 0 THEN 0.5 ELSE 0 END - CASE WHEN y.o % 1 <> 0 THEN 0.5 ELSE 0 END), 2)) AS dist FROM u x JOIN u y ON x.k = y.k AND x.case_id = y.case_id AND x.slot < y.slot GROUP BY ALL),
h AS (SELECT k, o, count(*) AS c FROM u GROUP BY ALL), ex AS (SELECT x.k, sum(x.c * y.c * power(greatest(0, abs(x.o - y.o) - CASE WHEN x.o % 1 <> 0 THEN 0.5 ELSE 0 END - CASE WHEN y.o % 1 <> 0 THEN 0.5 ELSE 0 END), 2)) AS e FROM h x JOIN h y ON x.k = y.k AND x.o < y.o GROUP BY x.k), ob AS (SELECT k, avg(dist) AS o, count(*) AS n_units FROM q GROUP BY k), sz AS (SELECT k, sum(c) AS n FROM h GROUP BY k)
SELECT CAST(k AS INT) AS slot, n_units, {ALPHA} FROM ob JOIN sz USING (k) LEFT JOIN ex USING (k)"""),
    "consensus_loo": with_base(["votes", "samples", "gold"], ORDS + PRED + """, g AS (SELECT case_id, CASE gold WHEN 'A' THEN 1.0 WHEN 'B' THEN 2.0 WHEN 'B|C' THEN 2.5 WHEN 'C' THEN 3.0 ELSE 4.0 END AS g FROM gold),
s AS (SELECT k.case_id, k.slot AS k, list(CASE WHEN v.slot = k.slot THEN ascii(mode_prediction) - 64.0 ELSE v.o END ORDER BY CASE WHEN v.slot = k.slot THEN ascii(mode_prediction) - 64.0 ELSE v.o END) AS s FROM v k JOIN v ON k.case_id = v.case_id AND v.o IS NOT NULL AND k.o IS NOT NULL JOIN pred ON pred.case_id = k.case_id AND mode_prediction IS NOT NULL GROUP BY ALL),
md AS (SELECT case_id, CASE WHEN len(s) % 2 = 1 THEN s[len(s) // 2 + 1] WHEN s[len(s) // 2] = s[len(s) // 2 + 1] THEN s[len(s) // 2] WHEN (s[len(s) // 2] + s[len(s) // 2 + 1]) / 2 IN (1.5, 2.5, 3.5) THEN (s[len(s) // 2] + s[len(s) // 2 + 1]) / 2 ELSE s[len(s) // 2 + 1] END AS m FROM s)
SELECT case_id, round(count(*) FILTER (m <> g) / count(*), 9) AS change_rate, round(avg(abs(m - g)), 9)::DOUBLE AS mean_delta FROM md JOIN g USING (case_id) GROUP BY case_id"""),
    "distribution_distances": with_base(["votes", "samples"], DIST + "SELECT case_id, round(jsd, 9) AS jsd, round(w1, 9) AS w1 FROM dd"),
    "panel_summary": with_base(["votes", "samples", "gold"], DIST + "SELECT dataset, count(*) AS n, count(jsd) AS n_evaluable, round(avg(jsd), 6) AS mean_jsd, round(avg(w1), 6) AS mean_w1 FROM dd JOIN gold USING (case_id) GROUP BY dataset"),
    "level_map": """WITH t AS (SELECT l_orderkey, l_linenumber, (1 + (l_partkey % 11) * 0.5)::DOUBLE + CASE WHEN l_suppkey % 3 = 0 THEN 0.3333 ELSE 0 END AS lv FROM lineitem),
f AS (SELECT *, round_even(lv % 1, 6) AS fr, floor(lv)::INT AS lo, ['D', 'C', 'C', 'B', 'A', 'A'] AS tab FROM t)
SELECT l_orderkey, l_linenumber, CASE WHEN fr = 0.5 AND tab[lo] <> tab[lo + 1] THEN least(tab[lo], tab[lo + 1]) || '|' || greatest(tab[lo], tab[lo + 1]) WHEN fr = 0.5 THEN coalesce(tab[lo], 'D') ELSE coalesce(tab[(CASE WHEN fr = 0 THEN floor(lv) ELSE round_even(lv, 0) END)::INT], 'D') END AS label, coalesce(fr = 0.5 AND tab[lo] <> tab[lo + 1], false) AS is_edge FROM f""",
}

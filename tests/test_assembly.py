"""Screens against difflib, and the jobs from stored inputs to stored tables."""

import json
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from evalloom import cli, jobs
from evalloom.functions import rules
from evalloom.operators import benchmark, relations, screen
from evalloom.sources import files


def test_tidy_is_the_plain_rule(spark):
    import re
    import unicodedata

    texts = ["ﬁ\r\n\n\n\n  x", "\x00a\tb  c\r\r\n\n\n", "", None, "½ ²　x", "plain"]

    def plain(t):
        t = unicodedata.normalize("NFKC", t.replace("\x00", "")).replace("\r\n", "\n").replace("\r", "\n")
        return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", t)).strip()

    got = spark.createDataFrame([(t,) for t in texts], "t string").select(rules.tidy(F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == [None if t is None else plain(t) for t in texts]


def near_copies(seed=6):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    rows = []
    for i in range(30):
        w = [word() for _ in range(rng.randint(8, 30))]
        rows.append((2 * i, " ".join(w)))
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = word()
        rows.append((2 * i + 1, " ".join(w)))
    return rows + [(100, ""), (101, "  "), (102, rows[0][1]), (103, rows[0][1].upper())]


def grams(t):
    w = t.split()
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def test_near_duplicates_are_all_pairs(spark):
    rows = near_copies()
    df = screen.prepared(spark.createDataFrame(rows, "k long, t string"), "k", "t")
    norm = {r.key: r.norm for r in df.collect()}
    for at in (0.82, 0.5):
        want = set()
        for a in norm:
            for b in norm:
                x, y = norm[a], norm[b]
                ga, gb = grams(x), grams(y)
                contained = len(ga & gb) / min(len(ga), len(gb)) if ga and gb else 0
                if b < a and ((x == y and x) or contained >= 0.65 or SequenceMatcher(None, x, y).ratio() >= at):
                    want.add((a, b))
        assert {(r.key, r.other) for r in screen.near_duplicates(df, at, 0.65).collect()} == want and len(want) > 5


def test_best_match_is_the_best_of_all(spark):
    rows = near_copies()
    c = screen.prepared(spark.createDataFrame(rows[::2], "k long, t string"), "k", "t")
    b = screen.prepared(spark.createDataFrame(rows[1::2], "k long, t string"), "k", "t").withColumn("ord", F.col("key"))
    nb = [(r.key, r.norm) for r in b.orderBy("ord").collect()]
    for r in screen.best_match(c, b, 0.82, 0.65).collect():
        scored = []
        for k, y in nb:
            ga, gb = grams(r.norm), grams(y)
            contained = len(ga & gb) / min(len(ga), len(gb)) if ga and gb else 0.0
            exact = r.norm == y and r.norm != ""
            scored.append((max(SequenceMatcher(None, r.norm, y).ratio() / 0.82, contained / 0.65, 2.0 if exact else 0.0), -k, contained, exact))
        best = max(scored)
        assert (r.b_key, round(r.containment, 9), r.exact) == (-best[1], round(best[2], 9), best[3])


def test_registry_refuses(spark):
    m = jobs.Model("m", "p", 1.0, 0.1, 2.0)
    assert jobs.registry(spark, [m]).columns == ["model", "provider", "input", "cached", "output", "reasoning"]
    with pytest.raises(relations.CheckFailed, match="twice"):
        jobs.registry(spark, [m, m])
    with pytest.raises(relations.CheckFailed, match="negative"):
        jobs.Model("m", "p", -1.0, 0.1, 2.0)


def test_contracts_are_closed():
    assert files.closed_contract({"b": 1, "a": 2}, {"a", "b"}) == {"a": 2, "b": 1}
    for bad in ({"a": 1}, {"a": 1, "b": 2, "c": 3}, {"a": None, "b": 1}):
        with pytest.raises(relations.CheckFailed):
            files.closed_contract(bad, {"a", "b"})


def test_unknown_categories_are_told(spark):
    df = spark.createDataFrame([(1, ["theme:emergency_referrals", "physician_agreed_category:emergent"]), (2, ["theme:emergency_referrals"]), (3, ["x"])], "k int, tags array<string>")
    good, bad = benchmark.categorised(df, "tags")
    assert [(r.k, r.mapped_label) for r in good.collect()] == [(1, "D")] and [r.k for r in bad.collect()] == [2]


def test_evaluate_job(spark, tmp_path):
    top = f"file://{tmp_path}"
    samples = [(c, "qa", i, f"ACUITY: {'ABCD'[(c + (i == 0)) % 4]}") for c in range(8) for i in range(3)]
    spark.createDataFrame(samples, "case_id int, task_type string, sample_idx int, answer string").write.parquet(f"{top}/s")
    spark.createDataFrame([(c, "d", "ABCD"[c % 4], "primary") for c in range(8)], "case_id int, dataset string, gold string, split string").write.parquet(f"{top}/g")
    made = jobs.evaluate(spark, f"{top}/s", f"{top}/g", f"{top}/out", expected=3)
    overall = made["metrics"].filter("group_type = 'overall'").head()
    assert (overall.n_total, overall.exact) == (8, 1.0) and made["confusion"].count() == 4
    spark.createDataFrame([(0, "d", "A", "primary")], "case_id int, dataset string, gold string, split string").write.parquet(f"{top}/few")
    with pytest.raises(relations.CheckFailed, match="without a case"):
        jobs.evaluate(spark, f"{top}/s", f"{top}/few", f"{top}/out2")


def test_cli(spark, tmp_path, capsys):
    top = f"file://{tmp_path}"
    spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "id string").write.parquet(f"{top}/rows")
    spark.createDataFrame([("a",), ("b",), ("d",)], "value string").write.text(f"{top}/ids")
    assert cli.main(["validate", "--rows", f"{top}/rows", "--ids", f"{top}/ids", "--key", "id", "--out", f"{top}/out"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == {"differences": 3}
    with pytest.raises(SystemExit):
        cli.main(["no-such-job"])


def test_screen_and_check_jobs(spark, tmp_path):
    top = f"file://{tmp_path}"
    rows = near_copies()
    for name, part in (("c", rows[:20]), ("b", rows[20:40])):
        spark.createDataFrame(part, "case_id long, text string").write.parquet(f"{top}/{name}")
    found = jobs.screened(spark, f"{top}/c", f"{top}/b", f"{top}/out")["screen"]
    assert found.count() == 20 and found.filter("exists(reasons, r -> r like 'generated_near_duplicate:%')").count() > 3
    bad = jobs.checked(spark, f"{top}/c", {"type": "object"}, "case_id", "text", f"{top}/out2")["violations"]
    assert bad.count() == 20


def test_tidy_sends_what_is_not_ascii_alone(spark, monkeypatch):
    import re
    import unicodedata

    rng = random.Random(8)
    letters = ["a", "e", "f", " ", "\n", "\u0301", "\u0327", "\u0345", "ﬁ", "½", "é", "한", "\u1100", "\u1161", "\u11a8", "Å", "🙂", "か", "\u3099", "ſ", "．"]
    texts = ["".join(rng.choices(letters, k=rng.randrange(40))) for _ in range(2000)]

    def plain(t):
        t = unicodedata.normalize("NFKC", t)
        return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", t)).strip()

    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    assert [r.x for r in rows.select("k", rules.tidy(F.col("t")).alias("x")).orderBy("k").collect()] == [plain(t) for t in texts]
    sent = []
    monkeypatch.setattr(rules, "_nfkc", lambda c: sent.append(c) or c)
    text = F.col("t")
    rules.tidy(text)
    long = spark.createDataFrame([("plain words " * 1000 + "ﬁn",)], "t string")
    assert long.select(F.length(sent[0]).alias("n")).first().n == 2


@pytest.mark.parametrize("name, table", [("cost_scenario", "orders"), ("action_traces", "lineitem"), ("verified_sources", "documents")])
def test_spark_reads_a_given_table(spark, name, table):
    from evalloom.plans import registry

    read = set()
    made = spark.read.parquet

    class Noted:
        def parquet(self, path):
            read.add(path.rsplit("/", 1)[-1])
            return made(path)

    noted = type("Session", (), {"read": Noted(), "__getattr__": lambda self, k: getattr(spark, k)})()
    assert registry.QUERIES[name](noted, "/root/testdata/sf0.001").count() > 0
    assert f"{table}.parquet" in read

"""The pipeline's stages on the smallest tables, each against a plain version of what it decides."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evalloom.llm import token_ids, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents, then what each stage leaves, written and read again."""
    out, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, "no id"), (900_001, None), (900_002, "")], "doc_id long, text string")
    docs = docs.unionByName(odd, allowMissingColumns=True).withColumns({c: F.lit(i) for i, c in enumerate(("gone_id", "Gone_ID_", "copies", "again_id", "again_copies", "again_copy"))})
    out.append(docs.cache())
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"file://{tmp_path_factory.mktemp('stage')}/{k}"
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def rows_of(df):
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_columns_stay(stages):
    assert len(corpus_pipeline.STAGES) in (4, 5)
    assert all(s.columns == stages[0].columns for s in stages[1:-1])


def test_toxic_documents_go(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bad = {r.doc_id for r in toxicity.score_toxicity(stages[0], labels).filter("predicted = 1").collect()}
    before, after = rows_of(stages[0]), rows_of(stages[1])
    assert before - after == Counter({k: c for k, c in before.items() if k[0] in bad and k[1]})


def test_one_of_equal_texts_stays(stages):
    before, after = rows_of(stages[1]), rows_of(stages[2])
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    first = {}
    for i, t in before:
        if i is not None:
            first[norm(t)] = min(i, first.get(norm(t), i))
    assert after == Counter({k: c for k, c in before.items() if k[0] is None or first[norm(k[1])] == k[0]})


def test_one_of_near_texts_stays(stages):
    before, after = rows_of(stages[2]), rows_of(stages[3])

    def grams(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {i: grams(t) for i, t in before if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert after == Counter({k: c for k, c in before.items() if k[0] is None or find(k[0]) == k[0]})


def test_mixing_only_repeats(stages):
    before, after = rows_of(stages[3]), rows_of(stages[4])
    assert set(before) == set(after) and all(after[k] >= c for k, c in before.items())
    assert sum(after.values()) > sum(before.values())


def test_packing_loses_nothing(stages):
    enc = token_ids.WordEncoder(token_ids.public_vocabulary())
    rows = [(r.doc_id, len(enc.encode([(r.text or "").encode()])[0]) // 2) for r in stages[4].collect() if r.doc_id is not None]
    got = stages[5].groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    want = Counter()
    for i, n in rows:
        want[i] += n
    assert {r.doc_id: r.n for r in got} == dict(want)
    full = stages[5].groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert full.filter("n > 2048").count() == 0 and full.filter("n <> 2048 AND bit_count(n) <> 1").count() == 0

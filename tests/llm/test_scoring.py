"""Quality, hard negatives and importance resampling against plain versions."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.llm import hard_negatives as hn
from evalloom.llm import importance, quality
from evalloom.llm.common import held_out, tables

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string"


# --- 11: quality


def hashed(values, kind):
    key = 0
    for i, v in enumerate(values):
        key |= int(v) << (8 * i)
    return (((key ^ (kind * 0x3C6EF372 & 0xFFFFFFFF)) * 2654435761) & 0xFFFFFFFF) >> (32 - quality.BITS)


def plain_features(chunk):
    """The features of one chunk, run by run."""
    out = {hashed(chunk[i : i + n], n) for n in (1, 2, 3) for i in range(len(chunk) - n + 1)}
    mark = lambda c: 97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else 32 if c in b"\t\n\v\f\r " else c
    marks = [k for k, g in itertools.groupby(map(mark, chunk)) for _ in (range(1) if k in b"aA0 " else g)]
    out |= {hashed(marks[i : i + n], 8 + n) for n in (2, 3, 4) for i in range(len(marks) - n + 1)}
    words = [w.lower() for w in re.split(rb"[ \t\n\v\f\r]+", chunk) if w]
    for n in (1, 2, 3):
        if sum(a == b for a, b in zip(words, words[n:], strict=False)) > 0.2 * max(len(words), n):
            out.add(hashed([n], 16))
    return out


@pytest.mark.parametrize("text", ["", "a", "Ab 12!! Ab 12!!", "la la la la la", "Éan é\n\nx", "word " * 900, "Ab, " * 3000, "x" * 700_000])
def test_quality_features(text):
    raw = text.encode()
    n = max(1, -(-len(raw) // quality.CHUNK))
    want = Counter()
    for i in range(n):
        found = plain_features(raw[len(raw) * i // n : len(raw) * (i + 1) // n])
        for f in found:
            want[f] += len(found) ** -0.5 / n
    at, of = quality.vector(raw)
    assert at.tolist() == sorted(want)
    np.testing.assert_allclose(of, [want[a] for a in at], rtol=1e-5)
    w = np.random.default_rng(1).normal(size=quality.SIZE)
    texts = [b"other text", raw, b"", raw + b" more"]
    one_by_one = [sum(w[a] * v for a, v in zip(*quality.vector(t), strict=True)) for t in texts]
    np.testing.assert_allclose(quality.margins(texts, w), one_by_one, atol=1e-4)


def rows_of(xs, labels):
    at, of = zip(*[(np.flatnonzero(x).astype("<u2"), x[np.flatnonzero(x)].astype("<f4")) for x in xs], strict=True)
    return quality.Rows(np.concatenate(at), np.concatenate(of), np.r_[0, np.cumsum([len(a) for a in at])], np.array(labels))


def test_dual_coordinate_descent():
    """The dual variables stay in their boxes, give the weights, and close the gap between primal and dual."""
    rng = np.random.default_rng(0)
    xs = np.zeros((60, quality.SIZE), np.float32)
    xs[:, :12] = rng.random((60, 12)) * (rng.random((60, 12)) < 0.6)
    labels = (xs[:, :12] @ rng.normal(size=12) + 0.3 * rng.normal(size=60) > 0).astype(int)
    rows, which = rows_of(xs, labels), np.arange(60)
    ratios = quality.log_ratios(rows, which)
    p, q = (quality.SMOOTH + xs[labels == y].sum(axis=0, dtype=float) for y in (1, 0))
    np.testing.assert_allclose(ratios, np.log(p / p.sum() / (q / q.sum())), rtol=1e-4, atol=1e-6)
    w, bias, dual = quality.descend(rows, which, ratios, passes=3000, tol=1e-7)
    y = np.where(labels == 1, 1.0, -1.0)
    box = np.where(labels == 1, quality.COST * 0.5 / labels.mean(), quality.COST * 0.5 / (1 - labels.mean()))
    z = xs * ratios
    assert (dual >= 0).all() and (dual <= box + 1e-12).all()
    np.testing.assert_allclose(w, (dual * y) @ z, atol=1e-6)
    primal = 0.5 * (w @ w + bias**2) + (box * np.maximum(0, 1 - y * (z @ w + bias))).sum()
    assert 0 <= primal - (dual.sum() - 0.5 * (w @ w + bias**2)) + 1e-9 < 1e-3 * primal


def test_quality_held_out(spark):
    got = quality.op11_quality(spark, SF).toPandas()
    labels = tables(spark, SF, "labels").toPandas()
    docs = tables(spark, SF, "documents").toPandas()
    assert sorted(got.doc_id) == sorted(docs.doc_id)
    assert (got.held_out == got.doc_id.map(held_out)).all() and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.7)).all()
    both = got[got.held_out].merge(labels, on="doc_id")
    good, bad = (both.score[both.quality == y] for y in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert (both.predicted == both.quality).mean() > 0.95


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "Good text of words.", "z"), (3, "BAD!! BAD!!", "z"), (None, "no id", "z"), (5, "long words " * 200_000, "z")], DOCS + ", label string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(1, 1), (3, 1), (3, None), (None, 0), (9, 0), (5, 2)], "doc_id long, quality int")
    got = quality.score_quality(docs, labels).toPandas()
    assert sorted(got.doc_id) == [1, 2, 3, 3, 5] and got.score.nunique() == 1  # one kind of label tells nothing apart
    none = quality.score_quality(docs, labels.limit(0)).toPandas()
    assert set(none.score) == {0.5} and set(none.predicted) == {0}
    assert quality.score_quality(docs.limit(0), labels).count() == 0
    both = labels.union(spark.createDataFrame([(2, 0), (4, 0)], "doc_id long, quality int"))
    got = quality.score_quality(docs, both).toPandas()
    assert len(got) == 5 and got.score.between(0, 1).all()


# --- 12: hard negatives


def plain_negatives(rows, every=100):
    """rows: (id, label, vector) that take part."""
    code = {i: (la, [math.floor(256 * x) for x in v]) for i, la, v in rows}
    out = []
    for a, (label, va) in code.items():
        if a % every:
            continue
        score = {i: sum(p * q for p, q in zip(va, v, strict=True)) for i, (_, v) in code.items() if i != a and len(v) == len(va)}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if code[i][0] == label][:5]:
            fit = [i for i in order if code[i][0] != label and 80 * score[p] <= 100 * score[i] <= 100 * score[p]][:5]
            out += [(a, p, k, i, score[p], score[i]) for k, i in enumerate(fit, 1)]
    return sorted(out)


VECS = "vec_id long, embedding array<double>, label int"


def mined(df, **kw):
    return sorted(tuple(r) for r in hn.hard_negatives(df, **kw).collect())


@pytest.mark.parametrize("dim,scale,n_labels", [(8, 0.02, 2), (5, 1.0, 3), (64, 0.2, 4), (3, 1e5, 2), (0, 1, 2)])
def test_hard_negatives_brute_force(spark, monkeypatch, dim, scale, n_labels):
    monkeypatch.setattr(hn, "BLOCK_COMPONENTS", 0)  # blocks of 256 rows
    monkeypatch.setattr(hn, "BLOCK_ANCHORS", 3)
    rng = np.random.default_rng(dim)
    rows = [(i, int(rng.integers(n_labels)), (rng.normal(size=dim) * scale).round(3).tolist()) for i in range(900)]
    rows += [(1000 + i, r[1] + i % 2, r[2]) for i, r in enumerate(rows[:100])]  # copies: ties in every list
    df = spark.createDataFrame([(i, v, la) for i, la, v in rows], VECS)
    want = plain_negatives(rows)
    assert mined(df) == want and (want or dim == 0)


def test_hard_negatives_hot_copies(spark):
    rows = [(i, int(i % 7 == 0), [0.5, -0.25, 0.125]) for i in range(600)] + [(1000 + i, i % 2, [0.5, -0.25, 0.1 + i / 100]) for i in range(30)]
    df = spark.createDataFrame([(i, v, la) for i, la, v in rows], VECS)
    assert mined(df) == plain_negatives(rows)


def test_hard_negatives_edges(spark):
    big = [float(2**40), -3.0, 1.0]
    good = [(0, 1, [0.5, 0.5, 0.5]), (1, 1, [0.4, 0.5, 0.5]), (2, 2, [0.4, 0.45, 0.5]), (3, 2, [-1.0, 0.0, 0.0]), (4, 1, big), (100, 2, [0.1, 0.2]), (200, 2, [0.2, 0.2]), (201, 2, [0.2, 0.1]), (202, 1, [0.1, 0.1]), (300, 1, [])]
    bad = [(5, None, [0.5] * 3), (6, 1, None), (7, 1, [0.5, None, 0.5]), (8, 2, [0.5, float("nan"), 0.5]), (9, 2, [0.5, float("inf"), 0.5]), (None, 1, [0.5] * 3)]
    df = spark.createDataFrame([(i, v, la) for i, la, v in [*good, *bad, good[1], (2, 9, [9.0, 9.0, 9.0])]], VECS).withColumn("rank", F.lit("clash"))
    assert mined(df) == plain_negatives(good)
    assert mined(df.limit(0)) == []
    assert mined(df.filter("vec_id % 100 <> 0")) == []


def test_planes_and_intervals():
    """Planes give back the values; after each plane every score lies in its interval, and rows are dropped before the last plane."""
    rng = np.random.default_rng(4)
    x = rng.integers(-150, 150, (500, 24))
    planes = hn.Planes([r.tobytes() for r in hn.planes_of(x, 9)], 24, 9)
    assert (planes.values() == x).all()
    a, seen = x[:6], []
    true = a @ x.T

    def able(lo, hi, alive):
        at = np.flatnonzero(np.isin(true, true).all(axis=0))  # all rows stay in this run
        assert (lo <= true[:, at]).all() and (true[:, at] <= hi).all()
        seen.append(float((hi - lo).max()))
        return alive

    rows, scores = hn.scan(a, planes, np.ones((6, 500), bool), able)
    assert (scores == true).all() and seen == sorted(seen, reverse=True) and seen[-1] == 0
    read = []
    plane = planes.plane
    planes.plane = lambda k, r=slice(None): read.append(len(r)) or plane(k, r)
    rows, scores = hn.scan(a, planes, np.ones((6, 500), bool), hn.best_able(5))
    for i in range(6):
        best = np.lexsort((np.arange(500), -true[i]))[:5]
        assert set(best) <= set(rows[~np.isnan(scores[i])])
    assert read[0] == 500 and read[-1] < 100


# --- 13: importance resampling


def plain_features_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(words), [zlib.crc32(f.encode()) % 10_000 for f in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]]


def plain_resample(docs, target):
    found = {i: plain_features_of(t) for i, t in docs}
    s, t = Counter(b for _, f in found.values() for b in f), Counter(b for x in target for b in plain_features_of(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000))))
    out = {}
    for i, (n_words, f) in found.items():
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        out[i] = [i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n_words]
    able = sorted((r for r in out.values() if r[5] >= 20), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(able[: 25 * len(able) // 100], 1):
        r[4] = k
    return sorted(map(tuple, out.values()))


def test_resample_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in tables(spark, SF, "documents").select("doc_id", "text").collect()]
    target = [r.text for r in tables(spark, SF, "benchmark").collect()]
    got = importance.op13_importance(spark, SF).collect()
    assert sorted(tuple(r) for r in got) == plain_resample(docs, target)


def test_resample_edges(spark):
    docs = [(1, None), (2, ""), (3, "!?"), (4, "Ab cD " * 30), (5, "Ab cD " * 30), (6, "É ñ_ü 12a"), (7, ("word" + "x" * 100 + " ") * 25), (8, "many words " * 300_000), (9, "İ K ſ " * 10)]
    df = spark.createDataFrame([*docs, (None, "no id " * 20)], DOCS).withColumn("rank", F.lit("clash"))
    target = spark.createDataFrame([(1, "ab cd"), (None, "many words"), (3, None)], "item_id long, text string")
    assert sorted(tuple(r) for r in importance.resample(df, target).collect()) == plain_resample(docs, ["ab cd", "many words"])
    assert importance.resample(df.limit(0), target).count() == 0
    assert sorted(tuple(r) for r in importance.resample(df, target.limit(0)).collect()) == plain_resample(docs, [])
    twice = importance.resample(df.union(df), target).filter("doc_id = 8").collect()
    assert len(twice) == 2 and len({(r.weight, r.score) for r in twice}) == 1


def test_hasher_joins_checksums(monkeypatch):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abÉ9"), int(n))) for n in rng.choice([1, 2, 5, 31, 32, 62, 63, 64, 65, 90], 300)]
    text = "  ".join(words)
    want = Counter(plain_features_of(text)[1])
    for piece in (1, 7, 1 << 20):
        monkeypatch.setattr(importance, "PIECE", piece)
        counts, n_words = importance.Hasher(10_000).counts(text.encode())
        assert n_words == 300 and {i: int(c) for i, c in enumerate(counts) if c} == want


def test_matrix_round_trip(spark):
    """The blocks hold the counts, and column sums and products are those of the dense matrix."""
    docs = tables(spark, SF, "documents").select("doc_id", "text").filter("doc_id < 60")
    blocks = importance.stored(spark, importance.matrix(docs), "test-blocks")
    dense = {}
    for b in blocks.toArrow().to_batches():
        for ids, words, starts, at, of in importance.unpacked(b):
            for k, i in enumerate(ids):
                dense[int(i)] = Counter(dict(zip(at[starts[k] : starts[k + 1]].tolist(), of[starts[k] : starts[k + 1]].tolist(), strict=True)))
    assert dense == {r.doc_id: Counter(plain_features_of(r.text)[1]) for r in docs.collect()}
    sums = importance.column_sums(blocks)
    assert {i: int(n) for i, n in enumerate(sums) if n} == sum(dense.values(), Counter())

"""Each query against its SQL in DuckDB, on the smallest tables."""

import decimal
import os
import re
from difflib import SequenceMatcher

import pytest

from evalloom.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def shown(v):
    return "" if v is None else f"{float(v):.6f}" if isinstance(v, float | decimal.Decimal) else str(v)


def norm(text):
    return " ".join(re.findall("[a-z0-9]+", text.lower()))


def contained(x, y):
    a, b = ({tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (x.split(), y.split()))
    return len(a & b) / min(len(a), len(b)) if a and b else 0.0


def near(rows):
    """All pairs, each with the smaller key second."""
    n = {k: norm(t) for k, t in rows}
    return {(a, b) for a in n for b in n if b < a and ((n[a] == n[b] != "") or contained(n[a], n[b]) >= 0.65 or SequenceMatcher(None, n[a], n[b]).ratio() >= 0.82)}


def screened(rows, held_out):
    pairs, out = near(rows), {}
    for k, text in rows:
        x, found = norm(text), set()
        scored = []
        for item, t in held_out:
            y = norm(t)
            ratio, part, same = SequenceMatcher(None, x, y).ratio(), contained(x, y), x == y != ""
            scored.append((max(ratio / 0.82, part / 0.65, 2.0 if same else 0.0), -item, ratio, part, same))
        _, item, ratio, part, same = max(scored)
        found |= {f"generated_near_duplicate:{b}" for a, b in pairs if a == k}
        rules = {"too_short_for_reliable_lexical_screen": len(x) < 40, "exact_benchmark_match": same, "benchmark_sequence_similarity": ratio >= 0.82, "benchmark_token_trigram_containment": part >= 0.65, "acuity_label_leaked_into_vignette": bool(re.search(r"(?i)\b(?:acuity|disposition)\s*(?:label|category)?\s*[:=]\s*[abcd]\b", text))}
        found |= {r for r, hit in rules.items() if hit}
        out[k] = (sorted(found), -item)
    return out


def test_screens_without_sql(spark, duck):
    items = duck.sql("SELECT item_id, text FROM benchmark").fetchall()
    texts = items + [(i + 1000000, f"{t} more") for i, t in items]
    assert {(r.key, r.other) for r in registry.QUERIES["self_near_duplicates"](spark, SF).collect()} == near(texts)
    first = duck.sql("SELECT conv_id, arg_min(text, turn) FROM conversations GROUP BY conv_id").fetchall()
    got = {r.key: (sorted(r.reasons), r.b_key) for r in registry.QUERIES["best_match_screen"](spark, SF).collect()}
    assert got == screened(first, items)
    assert set(registry.QUERIES) - set(registry.SQL) == {"self_near_duplicates", "best_match_screen"}


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    rows = df.collect()
    other = duck.sql(registry.SQL[name])
    assert sorted(df.columns) == sorted(other.columns)
    cols = sorted(df.columns)
    mine = sorted(tuple(shown(r[c]) for c in cols) for r in rows)
    theirs = sorted(tuple(shown(r[other.columns.index(c)]) for c in cols) for r in other.fetchall())
    assert mine == theirs


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0

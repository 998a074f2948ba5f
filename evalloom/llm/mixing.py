"""Mixing sources to target weights, with soft membership.

A classifier fitted on a labelled table predicts each document's posterior over the domains; nobody has to
assign a document to one. Rates r >= floor are then fitted so that the expected token totals of the domains,
sum of r tokens posterior, meet the targets: least squares by projected gradient, in the metric in which
each token counts alike (the gradient is scaled by the inverse of H = sum of tokens posterior posterior',
a matrix as small as the number of domains, so a step of 1 never makes it worse). It ends when the totals meet
the targets or a step hardly helps any more: then the targets can't be met, and the result says by how much.

An iteration is one pass over the documents that returns one small vector per task. Rates aren't stored
between passes: a document's rate follows from its own posterior and the steps so far, which are sent along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm import features
from evalloom.llm.common import bytes_of, cut, docs_of, ids_of, sample_of, sliced, tables

#: Labelled rows that the classifier is fitted on, at most.
TRAIN_ROWS = 6_000
#: The fit ends at this relative error of the totals, or when ten steps lower the sum of squares by no more than this share.
CLOSE, STILL = 1e-4, 1e-2
#: Passes after which it gives up with an error.
PASSES = 1_000


def posteriors(df: DataFrame, labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[DataFrame, list[str]]:
    """(doc_id, tokens, posterior) of each document, and the domains. labelled: doc_id, text, domain."""
    sample = features.Sample(sample_of(labelled.filter("doc_id IS NOT NULL AND domain IS NOT NULL AND text IS NOT NULL"), train_rows).limit(2 * train_rows), "domain")
    domains = sorted(set(sample.labels))
    at = np.array([domains.index(x) for x in sample.labels], int)
    w, b = features.fit(sample, np.eye(len(domains), dtype=np.float32)[at], softmax=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in sliced(batches, 256):
            texts = bytes_of(x)
            p = features.proba(features.matrix(texts) @ w + b, softmax=True).astype(float) if domains else np.zeros((len(texts), 0))
            yield pa.RecordBatch.from_arrays([pa.array(ids_of(x)), pa.array([len(t.split()) for t in texts], pa.int64()), pa.array(list(p), pa.list_(pa.float64()))], names=["doc_id", "tokens", "posterior"])

    return docs_of(df).mapInArrow(run, "doc_id long, tokens long, posterior array<double>"), domains


def _matrix(b: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    col = b.column(b.schema.get_field_index("posterior"))
    return ids_of(b, "tokens").astype(float), col.flatten().to_numpy().reshape(b.num_rows, k)


Step = tuple[np.ndarray, float]  # the scaled gradient, and the momentum of the rates that it was taken at


def rates_after(p: np.ndarray, steps: list[Step], floor: float) -> np.ndarray:
    r = before = np.ones(len(p))
    for u, momentum in steps:
        before, r = r, np.maximum(floor, r + momentum * (r - before) - p @ u)
    return r


def _summed(of: DataFrame, k: int, what) -> np.ndarray:
    """The sum over all tasks of what(tokens, posteriors), a vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for b in batches:
            if b.num_rows:
                total = total + what(*_matrix(b, k))
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["v"])

    # a pass has a task a core: with one for each stored partition, the shuffle files of hundreds of passes add up
    each = of.coalesce(max(1, of.sparkSession.sparkContext.defaultParallelism)).mapInArrow(run, "v array<double>")
    rows = each.select(F.posexplode("v")).groupBy("pos").agg(F.sum("col").alias("v")).collect()  # a number for each entry of the vector
    return np.array([r.v for r in sorted(rows, key=lambda r: r.pos)])


def fit_rates(of: DataFrame, k: int, targets: np.ndarray, floor: float = 0.0, close: float = CLOSE, still: float = STILL) -> tuple[list[Step], np.ndarray]:
    """The steps that lead from rate 1 to the fitted rates, and the totals that these have.

    Steps have Nesterov's momentum, which starts anew whenever it would make the sum of squares grow.
    """
    h = _summed(of, k, lambda n, p: (p.T @ (p * n[:, None])).ravel()).reshape(-1, k)
    if not len(h):
        return [], np.zeros(k)
    inverse = np.linalg.pinv(h + 1e-9 * max(1.0, h.trace()) * np.eye(k))
    squares = lambda totals: float((totals - targets) @ inverse @ (totals - targets))
    steps: list[Step] = []
    now = before = _summed(of, k, lambda n, p: n * rates_after(p, steps, floor) @ p)
    told, t = [squares(now)], 1.0
    for _ in range(PASSES):
        if unmet(now, targets) <= close or (len(told) > 10 and told[-1] > told[-11] * (1 - still)):
            return steps, now
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        momentum = (t - 1) / after
        step = inverse @ (now + momentum * (now - before) - targets), momentum
        tried = [*steps, step]
        new = _summed(of, k, lambda n, p, tried=tried: n * rates_after(p, tried, floor) @ p)
        if squares(new) <= told[-1]:
            steps, before, now, t = tried, now, new, after
            told.append(squares(now))
        elif momentum:
            t = 1.0
        else:  # a plain step never makes it worse but by rounding
            return steps, now
    raise RuntimeError(f"the rates did not settle in {PASSES} passes")


def unmet(totals: np.ndarray, targets: np.ndarray) -> float:
    """What the totals are off their targets by, relative to all targets."""
    return float(np.abs(totals - targets).sum() / max(1e-300, np.abs(targets).sum()))


def tempered(totals: np.ndarray, power: float) -> np.ndarray:
    """Weights proportional to the shares raised to a power."""
    w = np.maximum(totals, 0) ** power
    return w / w.sum() if w.sum() else w


def mix(df: DataFrame, labelled: DataFrame, weights: dict[str, float] | None = None, tokens: float | None = None, power: float = 0.5, floor: float = 0.0, grow: bool = False) -> DataFrame:
    """One row per row of df: doc_id, domain (the likeliest), confidence, tokens, rate, unmet, copies.

    weights: target share of each domain; by default the shares raised to power. tokens: the total to aim
    at, by default as many as there are; with grow, as many as it takes that no domain loses any.
    unmet: what the fitted totals are off their targets by, relative to the targets' sum, the same in each row; near
    0 where the targets can be met. copies: rate rounded up or down so that the expectation is the rate; it depends on doc_id alone.
    Tokens are runs of anything but ASCII white space. A null text is empty: no tokens, so its rate moves no
    total. Rows without an id are left out; rows that repeat an id are each given a rate. Without labelled
    rows every rate is 1 and domain is null.
    """
    of, domains = posteriors(df, labelled)
    of, k = cut(of), len(domains)
    names = [*domains]
    steps: list[Step] = []
    error = 0.0
    if k:
        natural = _summed(of, k, lambda n, p: n @ p)
        if len(natural):
            w = tempered(natural, power) if weights is None else np.array([weights.get(x, 0.0) for x in domains]) / sum(weights.values())
            total = natural.sum() if tokens is None else tokens
            if grow:
                total = max(total, (natural[w > 0] / w[w > 0]).max())
            steps, totals = fit_rates(of, k, w * total, floor)
            error = unmet(totals, w * total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            p = _matrix(b, k)[1] if k else np.zeros((n, 0))
            best = p.argmax(axis=1) if k and n else np.zeros(n, int)
            cols = [b.column(0), pa.array([names[i] if k else None for i in best], pa.string()), pa.array(p.max(axis=1) if k and n else np.zeros(n)), b.column(1), pa.array(rates_after(p, steps, floor))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "domain", "confidence", "tokens", "rate"])

    chance = F.pmod(F.xxhash64("doc_id", F.lit("copies")), F.lit(1 << 20)) / (1 << 20)
    return of.mapInArrow(run, "doc_id long, domain string, confidence double, tokens long, rate double").withColumns({"unmet": F.lit(error), "copies": F.floor(F.col("rate") + chance).cast("long")})


def quality_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled table of the queries: a domain is a language and a quality label."""
    found = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").filter("quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").filter("lang IS NOT NULL")
    return named.join(found, "doc_id").select("doc_id", "text", F.concat_ws("/", "lang", F.when(F.col("quality") > 0, "high").otherwise("low")).alias("domain"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents")
    return mix(docs, quality_domains(docs, tables(spark, sf_dir, "labels")))

"""Quality of texts by naive Bayes support vectors.

A text is cut into chunks of some 2,000 bytes, all of it. The features of a chunk are indicators of n-grams: runs of
1 to 3 bytes, runs of 2 to 4 marks of its outline (a word is one mark by its case, other signs stand for themselves), and
runs of 2 to 4 words whose last equals their first, where they are many. A chunk's indicators have length 1, and a text's
vector is the mean of its chunks', so that texts of any length count alike and a piece of junk in a long one still shows.

Each feature is scaled by the logarithm of the ratio of its shares among good and bad texts; on these a linear model of
least hinge loss is fitted by dual coordinate descent, one dual variable a text, with classes weighed alike. The scores
are logistic in the margin, fitted on margins of texts that their model didn't see.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm.common import bytes_of, docs_of, held_out, held_out_col, ids_of, sample_of, sliced, tables, word_hashes
from evalloom.llm.features import flat

#: Labelled rows that the model is fitted on, at most.
TRAIN_ROWS = 4_000
THRESHOLD = 0.7
#: log2 of the number of hashed features; bytes of a chunk; added to each feature's count; cost of a unit of hinge loss.
BITS, CHUNK, SMOOTH, COST = 15, 2_048, 0.5, 1.0
SIZE = 1 << BITS
#: Chunks that are worked on at once.
SLAB = 256

_SHIFT = np.uint32(32 - BITS)
#: A byte's mark: letters by case (all beyond ASCII count as small ones), digits, white space; others are their own.
_MARK = np.arange(256, dtype=np.uint32)
_MARK[97:123] = _MARK[128:] = 97
_MARK[65:91], _MARK[48:58], _MARK[9:14] = 65, 48, 32
_RUNS = np.isin(np.arange(256), [97, 65, 48, 32])


def _hashed(keys: np.ndarray, kind: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((keys ^ np.uint32(kind * 0x3C6EF372 & 0xFFFFFFFF)) * np.uint32(2654435761)) >> _SHIFT


def _runs(b: np.ndarray, chunk: np.ndarray, least: int, most: int, kind: int) -> Iterator[np.ndarray]:
    """(chunk, hash), as one number each, of all runs of `least` to `most` values under 256 that lie in one chunk."""
    key = b
    for n in range(1, most + 1):
        if n > 1:
            key = key[:-1] | (b[n - 1 :] << np.uint32(8 * n - 8))
        if n >= least:
            whole = chunk[: len(key)] == chunk[n - 1 :]
            yield (chunk[: len(key)][whole] << np.uint32(BITS)) | _hashed(key[whole], kind + n)
        if len(key) < 2:
            break


def _repeats(parts: list[bytes]) -> Iterator[np.ndarray]:
    """(chunk, hash), as one number each, of the chunks in which more than a fifth of the words equal the n-th word before them."""
    words, counts = word_hashes(parts)
    chunk = np.repeat(np.arange(len(parts), dtype=np.uint32), counts)
    for n in (1, 2, 3):
        again = np.bincount(chunk[n:][(words[n:] == words[:-n]) & (chunk[n:] == chunk[:-n])], minlength=len(parts))
        yield (np.flatnonzero(again > 0.2 * np.maximum(counts, n)).astype(np.uint32) << np.uint32(BITS)) | _hashed(np.uint32(n), 16)


def indicators(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(texts' numbers, sizes, features): of a number of chunks at a time the text of each, how many features it has, and these.

    A text is cut into chunks of like length of CHUNK bytes at most; each comes once.
    """
    n_chunks = np.array([max(1, -(-len(t) // CHUNK)) for t in texts], np.int64)
    lo = 0
    while lo < len(texts):
        hi = lo + max(1, int(np.searchsorted(np.cumsum(n_chunks[lo:]), SLAB)))
        for first in range(0, int(n_chunks[lo]) if hi == lo + 1 else 1, SLAB):
            parts, owner = [], []
            for i in range(lo, hi):
                t, n = texts[i], int(n_chunks[i])
                mine = range(first, min(n, first + SLAB))
                parts += [t[len(t) * j // n : len(t) * (j + 1) // n] for j in mine]
                owner += [i] * len(mine)
            b = np.frombuffer(b"".join(parts), np.uint8)
            chunk = np.repeat(np.arange(len(parts), dtype=np.uint32), [len(x) for x in parts])
            marks = _MARK[b]
            kept = np.r_[True, (marks[1:] != marks[:-1]) | ~_RUNS[marks[1:]] | (chunk[1:] != chunk[:-1])] if len(b) else np.zeros(0, bool)
            keys = np.sort(np.concatenate([*_runs(b.astype(np.uint32), chunk, 1, 3, 0), *_runs(marks[kept], chunk[kept], 2, 4, 8), *_repeats(parts)]))
            keys = keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys
            yield np.array(owner), np.bincount(keys >> np.uint32(BITS), minlength=len(parts)), (keys & np.uint32(SIZE - 1)).astype(np.int64)
        lo = hi


def vector(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, values) of the text's features: the mean over its chunks, each of length 1."""
    total, n = np.zeros(SIZE), 0
    for _, sizes, at in indicators([text]):
        total += np.bincount(at, np.repeat(np.maximum(sizes, 1) ** -0.5, sizes), SIZE)
        n += len(sizes)
    at = np.flatnonzero(total)
    return at, (total[at] / n).astype(np.float32)


def margins(texts: list[bytes], w: np.ndarray) -> np.ndarray:
    """Each text's product with the weights."""
    total, n = np.zeros(len(texts)), np.zeros(len(texts))
    for of, sizes, at in indicators(texts):
        upto = np.r_[0.0, np.cumsum(w[at])][np.r_[0, np.cumsum(sizes)]]
        total += np.bincount(of, np.diff(upto) * np.maximum(sizes, 1) ** -0.5, len(texts))
        n += np.bincount(of, minlength=len(texts))
    return total / np.maximum(n, 1)


class Rows:
    """Sparse vectors of a bounded sample, with labels of 0 and 1."""

    def __init__(self, at: np.ndarray, of: np.ndarray, ends: np.ndarray, labels: np.ndarray) -> None:
        self.at, self.of, self.ends, self.labels = at, of, ends, labels

    @classmethod
    def read(cls, df: DataFrame) -> Rows:
        """df: text and label; the vectors are made on the executors."""

        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in sliced(batches, 256):
                found = [vector(t) for t in bytes_of(b)]
                yield pa.RecordBatch.from_arrays([pa.array([a.astype("<u2").tobytes() for a, _ in found], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary()), b.column(1)], names=["at", "of", "label"])

        rows = df.select("text", F.col("label").cast("int").alias("label")).mapInArrow(make, "at binary, of binary, label int").toArrow()
        labels = rows.column("label").to_numpy().astype(int)
        sizes = np.array([len(x) // 2 for x in rows.column("at").to_pylist()], np.int64)
        return cls(flat(rows.column("at"), "<u2"), flat(rows.column("of"), "<f4"), np.r_[0, np.cumsum(sizes)], labels)

    def __len__(self) -> int:
        return len(self.labels)

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.ends[i], self.ends[i + 1])
        return self.at[part], self.of[part]

    def shares(self, which: np.ndarray) -> np.ndarray:
        """Sum of the vectors of these rows."""
        total = np.zeros(SIZE)
        for i in which:
            at, of = self.row(i)
            total[at] += of
        return total


def log_ratios(rows: Rows, which: np.ndarray) -> np.ndarray:
    """Of each feature, the logarithm of its smoothed share among rows of label 1 to that among rows of label 0."""
    p, q = (SMOOTH + rows.shares(which[rows.labels[which] == y]) for y in (1, 0))
    return np.log(p / p.sum()) - np.log(q / q.sum())


def descend(rows: Rows, which: np.ndarray, ratios: np.ndarray, cost: float = COST, passes: int = 60, tol: float = 1e-3, seed: int = 5) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights on scaled features, bias and dual variables of the least 1/2 |w|^2 + sum c_i max(0, 1 - y_i w x_i).

    Dual coordinate descent: each step solves one dual variable exactly within its box [0, c_i] and moves the weights along
    its row. c_i is `cost` times the inverse of its class's share. The bias is the weight of a constant feature.
    """
    y = np.where(rows.labels[which] == 1, 1.0, -1.0)
    share = {s: max(1, int((y == s).sum())) / max(1, len(y)) for s in (1.0, -1.0)}
    box = np.array([cost * 0.5 / share[s] for s in y])
    xs = [(at, of * ratios[at]) for at, of in map(rows.row, which)]
    size = np.array([x @ x + 1.0 for _, x in xs])
    w, bias, dual, rng = np.zeros(SIZE), 0.0, np.zeros(len(which)), np.random.default_rng(seed)
    for _ in range(passes):
        worst = 0.0
        for i in rng.permutation(len(which)):
            at, x = xs[i]
            slope = y[i] * (w[at] @ x + bias) - 1
            new = min(max(dual[i] - slope / size[i], 0.0), box[i])
            if new != dual[i]:
                step = (new - dual[i]) * y[i]
                w[at] += step * x
                bias += step
                worst = max(worst, abs(new - dual[i]) * size[i])
                dual[i] = new
        if worst < tol:
            break
    return w, bias, dual


def logistic(z: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept of the logistic curve of y over z, with targets a little inside of 0 and 1 as a small sample needs."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, ab = np.c_[z, np.ones(len(z))], np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + 1e-6 * np.eye(2), x.T @ (p - target))
        ab = ab - np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return float(ab[0]), float(ab[1])


class Model:
    """Weights of the features and the curve of the scores; small, and sent to the executors whole."""

    def __init__(self, rows: Rows, folds: int = 4) -> None:
        self.w, self.slope, self.shift = np.zeros(SIZE), 0.0, 0.0
        everyone = np.arange(len(rows))
        n1 = int(rows.labels.sum())
        if not 0 < n1 < len(rows):  # nothing to tell apart: the share of label 1, a half without any label
            share = (n1 + 0.5) / (len(rows) + 1)
            self.shift = float(np.log(share / (1 - share)))
            return
        self.w, self.bias = self._fitted(rows, everyone)
        fold = np.random.default_rng(9).permutation(len(rows)) % folds
        z = np.zeros(len(rows))
        for f in range(folds):
            w, bias = self._fitted(rows, everyone[fold != f])
            for i in everyone[fold == f]:
                at, of = rows.row(i)
                z[i] = w[at] @ of + bias
        self.slope, shift = logistic(z, rows.labels)
        self.shift = self.slope * self.bias + shift

    @staticmethod
    def _fitted(rows: Rows, which: np.ndarray) -> tuple[np.ndarray, float]:
        ratios = log_ratios(rows, which)
        w, bias, _ = descend(rows, which, ratios)
        return w * ratios, bias

    def score(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins(texts, self.w) + self.shift, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """docs: doc_id, text. Of a document with several labels the largest counts; only labels 0 and 1 of ids that are not held out do."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out_col())
    picked = sample_of(usable, train_rows).groupBy("doc_id").agg(F.max("label").alias("label"))
    return Model(Rows.read(docs.join(F.broadcast(picked), "doc_id").select("text", "label").limit(2 * train_rows)))  # picked: train_rows at most


def score_quality(df: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row: doc_id, held_out, score (0 to 1), predicted.

    Fitted on at most train_rows rows with a quality label that are not held out. A null text is empty and scores as
    one without features. Rows without an id are left out; rows that repeat an id are each scored. Without labels of
    both kinds all texts score the share of label 1, or a half.
    """
    docs = docs_of(df)
    model = train(docs, labels, train_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            ids, p = ids_of(b), model.score(bytes_of(b))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([held_out(i) for i in ids.tolist()]), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "labels"))

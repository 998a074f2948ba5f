"""Hashed n-gram features of whole texts, and the linear models that are fitted on them."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from evalloom.llm.common import bytes_of, sliced

#: log2 of the number of features.
BITS = 14
SIZE = 1 << BITS


def counts(text: bytes) -> np.ndarray:
    """How often each hashed run of 2 or 3 bytes of the (ASCII-lower-cased) text occurs."""
    b = np.frombuffer(b" " + text.lower() + b" ", np.uint8).astype(np.uint32)
    two = b[:-1] | (b[1:] << np.uint32(8))
    three = two[:-1] | (b[2:] << np.uint32(16))
    shift = np.uint32(32 - BITS)
    h2 = ((two + np.uint32(0x5A000000)) * np.uint32(2654435761)) >> shift
    h3 = (three * np.uint32(2246822519)) >> shift
    return np.bincount(h2, minlength=SIZE) + np.bincount(h3, minlength=SIZE)


def vector(text: bytes) -> np.ndarray:
    """Square roots of the features' shares: of length 1 whatever the text's length."""
    c = counts(text)
    return np.sqrt(c / c.sum()).astype(np.float32)


def matrix(texts: list[bytes]) -> np.ndarray:
    out = np.empty((len(texts), SIZE), np.float32)
    for k, t in enumerate(texts):
        out[k] = vector(t)
    return out


def flat(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """All bytes of a column of binaries, one after another, as an array."""
    return np.frombuffer(b"".join(x.as_buffer().to_pybytes() for c in column.chunks for x in c if x.is_valid), kind)


class Sample:
    """Sparse vectors of a bounded sample on the driver, with their labels: two flat arrays, 6 bytes for each entry."""

    def __init__(self, df: DataFrame, label: str) -> None:
        """df: text and the label; the vectors are made on the executors."""

        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in sliced(batches):
                at, of = [], []
                for t in bytes_of(b):
                    v = vector(t)
                    nz = np.flatnonzero(v)
                    at.append(nz.astype("<u2").tobytes())
                    of.append(v[nz].astype("<f4").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.binary()), pa.array(of, pa.binary()), b.column(1)], names=["at", "of", "label"])

        rows = df.select("text", df[label].cast("string").alias("label")).mapInArrow(make, "at binary, of binary, label string").toArrow().combine_chunks()
        self.labels = rows.column("label").to_pylist()
        self._at, self._of = (flat(rows.column(c), kind) for c, kind in (("at", "<u2"), ("of", "<f4")))
        self._ends = np.r_[0, np.cumsum(pc.binary_length(rows.column("at")).to_numpy().astype(np.int64) // 2)] if rows.num_rows else np.zeros(1, np.int64)

    def __len__(self) -> int:
        return len(self.labels)

    def dense(self, which: np.ndarray) -> np.ndarray:
        out = np.zeros((len(which), SIZE), np.float32)
        for k, i in enumerate(which):
            at = slice(self._ends[i], self._ends[i + 1])
            out[k, self._at[at]] = self._of[at]
        return out


def fit(sample: Sample, targets: np.ndarray, softmax: bool, epochs: int = 12, rate: float = 0.05, ridge: float = 1e-6, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights and intercepts of logistic models (one per column of targets, or a softmax over them), by Adam.

    Rows of rare targets weigh more, so that each class counts alike.
    """
    n, k = targets.shape
    w, bias = np.zeros((SIZE, k), np.float32), np.zeros(k, np.float32)
    if not n or not k:
        return w, bias
    key = [r.tobytes() for r in targets]
    of = Counter(key)
    weight = np.array([n / (len(of) * of[x]) for x in key], np.float32)
    m, v, mb, vb, step = np.zeros_like(w), np.zeros_like(w), np.zeros_like(bias), np.zeros_like(bias), 0
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        order = rng.permutation(n)
        for lo in range(0, n, 256):
            at = order[lo : lo + 256]
            x, y, q = sample.dense(at), targets[at], weight[at, None]
            p = proba(x @ w * SCALE + bias, softmax)
            d = (p - y) * q / len(at)
            g, gb = x.T @ d * SCALE + ridge * w, d.sum(axis=0)
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            lr = rate * (1 - epoch / epochs) / (1 - 0.9**step) * np.sqrt(1 - 0.999**step)
            w -= (lr * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
            bias -= (lr * mb / (np.sqrt(vb) + 1e-8)).astype(np.float32)
    return w * SCALE, bias


#: Of the vectors, whose entries are small.
SCALE = np.float32(8)


def proba(z: np.ndarray, softmax: bool) -> np.ndarray:
    if softmax:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

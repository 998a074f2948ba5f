"""Language identification with error-correcting output codes.

Each language has a codeword; binary classifiers over hashed byte n-grams predict its bits. Decoding sums,
for each language, the logistic loss of the bits' margins against its codeword, each bit weighted by how
well its classifier did on the sample; the language of least loss wins. A small gap to the second makes
the answer ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm import features
from evalloom.llm.common import bytes_of, docs_of, held_out, held_out_col, ids_of, sample_of, sliced, tables

#: Labelled rows that the classifiers are fitted on, at most.
TRAIN_ROWS = 6_000
MOST_BITS = 31
#: Difference of the best two languages' probabilities under which an answer is ambiguous.
AMBIGUOUS = 0.2


def codewords(k: int, most: int = MOST_BITS, seed: int = 11) -> np.ndarray:
    """A row of +1 and -1 for each of k languages: all splits of them if these are few, else random ones."""
    if k < 2:
        return np.zeros((k, 0), np.int8)
    if 2 ** (k - 1) - 1 <= most:
        cols = [[1] + [1 if c >> j & 1 else -1 for j in range(k - 1)] for c in range(2 ** (k - 1) - 1)]
        return np.array(cols, np.int8).T
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(200):
        m = rng.choice(np.array([-1, 1], np.int8), (k, most))
        m[0, np.abs(m.sum(axis=0)) == k] *= -1
        d = min(int((m[a] != m[b]).sum()) for a in range(k) for b in range(a))
        if d > far:
            best, far = m, d
    return best


class Codes:
    """A fitted model; small, and sent to the executors whole."""

    def __init__(self, sample: features.Sample) -> None:
        self.langs = sorted(set(sample.labels))
        self.code = codewords(len(self.langs)).astype(np.float32)
        at = np.array([self.langs.index(x) for x in sample.labels], int)
        bits = (self.code[at] + 1) / 2 if len(at) else np.zeros((0, self.code.shape[1]), np.float32)
        self.w, self.b = features.fit(sample, bits.astype(np.float32), softmax=False)
        right = np.zeros(self.code.shape[1])
        for lo in range(0, len(at), 256):
            part = np.arange(lo, min(lo + 256, len(at)))
            right += ((sample.dense(part) @ self.w + self.b > 0) == (bits[part] > 0.5)).sum(axis=0)
        share = np.clip(right / max(1, len(at)), 0.5, 0.999)
        weight = np.log(share / (1 - share)) + 1e-3
        self.weight = (weight / weight.sum()).astype(np.float32) if len(weight) else weight

    def decode(self, margins: np.ndarray) -> np.ndarray:
        """Probabilities of the languages from the bits' margins, by the codewords' weighted losses."""
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]) @ self.weight
        return features.proba(-loss * self.code.shape[1], softmax=True)

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best language's number, its probability, and the gap to the second."""
        if len(self.langs) < 2:
            return np.zeros(len(texts), int), np.ones(len(texts)), np.ones(len(texts))
        p = self.decode(features.matrix(texts) @ self.w + self.b)
        top = np.sort(p, axis=1)[:, ::-1]
        return p.argmax(axis=1), top[:, 0], top[:, 0] - top[:, 1]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def identify(df: DataFrame, lang_col: str = "lang", train_rows: int = TRAIN_ROWS, ambiguous: float = AMBIGUOUS) -> DataFrame:
    """One row per row: doc_id, held_out, lang_pred, score, ambiguous.

    Fitted on at most train_rows rows that are not held out, have a language and a letter. und (score 0, and
    ambiguous) where a text is null or has no letter, or where there was nothing to learn from. Rows
    without an id are left out; rows that repeat an id are each answered.
    """
    labelled = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(lang_col).cast("string").alias("lang")).filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out_col())
    model = Codes(features.Sample(sample_of(labelled, train_rows).limit(2 * train_rows), "lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 256):
            ids, texts = ids_of(b), bytes_of(b)
            langs = np.full(len(ids), "und", object)
            score, unsure = np.zeros(len(ids)), np.ones(len(ids), bool)
            known = np.array([bool(model.langs) and has_letter(t.decode()) for t in texts], bool)
            if known.any():
                best, p, gap = model.predict([t for t, k in zip(texts, known, strict=True) if k])
                langs[known], score[known], unsure[known] = np.array(model.langs, object)[best], p, gap < ambiguous
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([held_out(i) for i in ids.tolist()]), pa.array(langs.tolist()), pa.array(score), pa.array(unsure)], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    return docs_of(df).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(tables(spark, sf_dir, "documents"))

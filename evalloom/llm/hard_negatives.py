"""Hard negatives by bit-sliced integer products.

Vectors of integers are stored as bit-planes of their components, in two's complement, most significant first. A task
that holds a block of anchors against a block of rows multiplies one plane after another with the anchors. After each
plane, what the planes still to come can add to a product lies between fixed bounds (the sum of the anchor's negative
and that of its positive components, times the largest value that is left), so every score has an interval. A row is
dropped for an anchor once its interval shows that it can't be among the best, and for a block of anchors once it is
dropped for all of them; the planes that follow are read for what is left. Scores that are left at the end are exact.

Two rounds: the anchors' best rows of the same label are their positives; the best rows of other labels within a window
under a positive's score are its negatives. Blocks are dealt out by the hash of ids, so labels of any size are spread,
and a task returns the few best rows for each anchor of its block; the best of all are among them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalloom.llm.common import cut, sliced, tables

POSITIVES, NEGATIVES = 5, 5
#: A negative's score is at least so many hundredths of the positive's, and at most the positive's.
LEAST_PERCENT = 80
SCALE = 256
#: Anchors have ids divisible by this.
ANCHOR_EVERY = 100
#: Components in a block of rows, which bounds a task's memory; rows of one at most; anchors of a block; anchors that share a pass over the planes.
BLOCK_COMPONENTS, BLOCK_ROWS, BLOCK_ANCHORS, TOGETHER = 1 << 19, 8_192, 1_024, 8
#: Largest sum that doubles hold exactly; beyond it Python's integers are used.
EXACT = 1 << 53


def planes_of(x: np.ndarray, bits: int) -> np.ndarray:
    """x (rows by components) as packed planes: for each row `bits` planes, the sign's first."""
    u = x.astype(np.int64) & ((1 << bits) - 1) if bits < 63 else x.astype(np.int64)
    out = [np.packbits(((u >> k) & 1).astype(np.uint8), axis=1) for k in range(bits - 1, -1, -1)]
    return np.concatenate(out, axis=1) if x.size else np.zeros((len(x), 0), np.uint8)


class Planes:
    """The planes of a block of rows, unpacked one at a time."""

    def __init__(self, blobs: list[bytes], dim: int, bits: int) -> None:
        self.dim, self.bits, self.width = dim, bits, -(-dim // 8)
        self.packed = np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), bits * self.width)

    def __len__(self) -> int:
        return len(self.packed)

    def plane(self, k: int, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Bit k of the components of these rows."""
        at = (self.bits - 1 - k) * self.width
        return np.unpackbits(self.packed[rows, at : at + self.width], axis=1, count=self.dim)

    def values(self, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        """The components themselves."""
        out = -(self.plane(self.bits - 1, rows).astype(np.int64) << (self.bits - 1))
        for k in range(self.bits - 1):
            out += self.plane(k, rows).astype(np.int64) << k
        return out


def scan(anchors: np.ndarray, planes: Planes, alive: np.ndarray, able: Callable) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores): the rows that are left for some anchor, and all anchors' exact scores of them.

    anchors: some rows by components. alive: anchors by rows, False where a pair is none. able(lo, hi, alive) gives
    back the pairs of alive that can still qualify when scores lie in [lo, hi].
    """
    exact = anchors.shape[1] * (int(np.abs(anchors).max(initial=0)) + 1) << planes.bits
    kind = float if exact < EXACT else object
    a = anchors.astype(kind)
    under, over = np.minimum(a, 0).sum(axis=1)[:, None], np.maximum(a, 0).sum(axis=1)[:, None]
    rows = np.flatnonzero(alive.any(axis=0))
    alive = alive[:, rows]
    total = np.zeros(alive.shape, kind)
    for k in range(planes.bits - 1, -1, -1):
        part = a @ planes.plane(k, rows).astype(kind).T
        total = total - part * (1 << k) if k == planes.bits - 1 else total + part * (1 << k)
        left = (1 << k) - 1
        alive = able(total + under * left, total + over * left, alive)
        kept = alive.any(axis=0)
        if not kept.all():
            rows, total, alive = rows[kept], total[:, kept], alive[:, kept]
        if not len(rows):
            break
    return rows, np.where(alive, total, None) if kind is object else np.where(alive, total, np.nan)


def _least(lo: np.ndarray, inside: np.ndarray, n: int) -> np.ndarray:
    """For each anchor the n-th largest lower bound among the pairs inside, minus infinity where there are fewer."""
    if lo.shape[1] < n:
        return np.full((len(lo), 1), -np.inf)
    bounds = np.where(inside, lo, -np.inf).astype(float)
    nth = np.partition(bounds, bounds.shape[1] - n, axis=1)[:, -n][:, None]
    return np.where(np.isinf(nth), nth, nth - 1e-12 * np.abs(np.where(np.isinf(nth), 0, nth)))  # integers beyond doubles were rounded


def best_able(n: int) -> Callable:
    """A row can be among an anchor's n best unless n others are sure to score more."""

    def able(lo: np.ndarray, hi: np.ndarray, alive: np.ndarray) -> np.ndarray:
        return alive & (hi >= _least(lo, alive, n))

    return able


def window_able(n: int, least: np.ndarray, most: np.ndarray) -> Callable:
    """A row can be among the n best of one of an anchor's windows: [least, most], anchors by windows (NaN: none).

    The bounds are doubles and may be rounded: a row is out if it is clearly out, and sure if it is clearly in.
    """
    slack = 1 + np.abs(most) * 1e-12

    def able(lo: np.ndarray, hi: np.ndarray, alive: np.ndarray) -> np.ndarray:
        out = np.zeros_like(alive)
        for w in range(least.shape[1]):
            low, high, near = least[:, w][:, None], most[:, w][:, None], slack[:, w][:, None]
            can = alive & (hi >= low - near) & (lo <= high + near)  # comparisons with NaN are False
            sure = can & (lo >= low + near) & (hi <= high - near)
            out |= can & (hi >= _least(lo, sure, n))
        return out

    return able


def first_best(ids: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
    """Places of the n highest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:n]


def _kept(score: float | int) -> int:
    if abs(score) >= 1 << 63:
        raise ValueError("a score is beyond 64 bits")
    return int(score)


def _positives(dim: int, bits: int, n: int):
    """A function of a block of anchors and one of rows: each anchor's best rows of its label."""

    def run(a: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(x):
            rows, ids, labels = Planes(x["planes"].tolist(), dim, bits), x["vec_id"].to_numpy(), x["label"].to_numpy()
            values = Planes(a["planes"].tolist(), dim, bits).values()
            a_ids, a_labels = a["vec_id"].to_numpy(), a["label"].to_numpy()
            for lo in range(0, len(a), TOGETHER):
                part = slice(lo, lo + TOGETHER)
                alive = (a_labels[part, None] == labels[None]) & (a_ids[part, None] != ids[None])
                at, scores = scan(values[part], rows, alive, best_able(n))
                for i, s in enumerate(scores):
                    mine = np.flatnonzero(~pd.isna(s))
                    best = mine[first_best(ids[at[mine]], s[mine].astype(float if s.dtype != object else object), n)]
                    out += [(a_ids[lo + i], ids[at[j]], _kept(s[j])) for j in best]
        return pd.DataFrame(out, columns=["anchor_id", "positive_id", "positive_score"]).astype("int64")

    return run


def _negatives(dim: int, bits: int, n: int, least_percent: int):
    """As _positives: for each score of an anchor's positives the best rows of other labels under it."""

    def run(a: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(x):
            rows, ids, labels = Planes(x["planes"].tolist(), dim, bits), x["vec_id"].to_numpy(), x["label"].to_numpy()
            values = Planes(a["planes"].tolist(), dim, bits).values()
            a_ids, a_labels, wanted = a["vec_id"].to_numpy(), a["label"].to_numpy(), [sorted({int(v) for v in w}) for w in a["scores"]]
            width = max(map(len, wanted))
            most = np.array([[float(v) for v in w] + [np.nan] * (width - len(w)) for w in wanted])
            least = most * least_percent / 100
            for lo in range(0, len(a), TOGETHER):
                part = slice(lo, lo + TOGETHER)
                alive = a_labels[part, None] != labels[None]
                at, scores = scan(values[part], rows, alive, window_able(n, least[part], most[part]))
                for i, s in enumerate(scores):
                    mine = np.flatnonzero(~pd.isna(s))
                    exact = [int(v) for v in s[mine]]
                    for p in wanted[lo + i]:
                        fit = mine[np.array([least_percent * p <= 100 * v <= 100 * p for v in exact], bool)]
                        best = fit[first_best(ids[at[fit]], s[fit], n)]
                        out += [(a_ids[lo + i], p, ids[at[j]], _kept(s[j])) for j in best]
        return pd.DataFrame(out, columns=["anchor_id", "positive_score", "negative_id", "negative_score"]).astype("int64")

    return run


def sliced_rows(df: DataFrame, bits: int) -> DataFrame:
    """vec_id, label, dim, planes of rows (vec_id, label, codes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 2048):
            codes = [np.array(c, np.int64) for c in b.column(2).to_pylist()]
            blobs = [planes_of(c[None], bits).tobytes() for c in codes] if len({len(c) for c in codes}) > 1 else [r.tobytes() for r in planes_of(np.stack(codes), bits)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(c) for c in codes], pa.int32()), pa.array(blobs, pa.binary())], names=["vec_id", "label", "dim", "planes"])

    return df.select("vec_id", "label", "codes").mapInArrow(run, "vec_id long, label long, dim int, planes binary")


def searched(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, dim: int, run: Callable, schema: str) -> DataFrame:
    """Both sides dealt out to the grid of blocks of anchors by blocks of rows, and run(anchors, rows) for each pair of blocks.

    anchors: vec_id, label, planes, scores; rows: vec_id, label, planes.
    """
    held = max(256, min(BLOCK_ROWS, BLOCK_COMPONENTS // max(1, dim)))
    n_a, n_x = -(-n_anchors // BLOCK_ANCHORS), -(-n_rows // held)
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asks = anchors.select(F.lit(True).alias("asks"), "vec_id", "label", "planes", "scores", block(n_a).alias("a"), every(n_x).alias("x"))
    held_ = rows.select(F.lit(False).alias("asks"), "vec_id", "label", "planes", F.lit(None).cast("array<long>").alias("scores"), every(n_a).alias("a"), block(n_x).alias("x"))
    return asks.union(held_).groupBy("a", "x").applyInPandas(lambda pdf: run(pdf[pdf["asks"]], pdf[~pdf["asks"]]), schema)


def best_of(found: DataFrame, by: list[str], score: str, key: str, n: int) -> DataFrame:
    """The n first rows of each group, numbered."""
    order = W.partitionBy(*by).orderBy(F.desc(score), F.asc(key))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def codes_of(df: DataFrame, label: Column, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, label, codes (floor(scale * x), x as double) of the rows that take part; of rows that repeat an id the first by label and vector."""
    vec = F.col("vec")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("vec")).filter("vec_id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL")
    sound = rows.filter(F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    whole = sound.select("vec_id", "label", F.transform(vec, lambda v: F.floor(v * scale).cast("long")).alias("codes"))
    return whole.groupBy("vec_id").agg(F.min(F.struct("label", "codes")).alias("row")).select("vec_id", "row.*")


def hard_negatives(df: DataFrame, label: Column | None = None, anchor: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, least_percent: int = LEAST_PERCENT, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    label: a column of whole numbers over df (label_col without one). anchor: a condition on vec_id (divisible by
    ANCHOR_EVERY without one). Rows without an id or a label, without a vector, or with a null or non-finite
    component take no part; of rows that repeat an id one does. Vectors are held against those of equal length;
    vectors without components all score 0. Products that don't fit 64 bits, and components that don't once scaled,
    raise an error. An anchor without a row of its label, or a positive without a row in its window, gives no row.
    """
    anchor = F.col("vec_id") % ANCHOR_EVERY == 0 if anchor is None else anchor
    rows = cut(codes_of(df, F.col(label_col) if label is None else label, scale, id_col, vec_col))
    lengths = rows.groupBy(F.size("codes").alias("dim")).agg(F.count("*").alias("n"), F.count(F.when(anchor, 1)).alias("asked"), F.min(F.array_min("codes")).alias("low"), F.max(F.array_max("codes")).alias("high")).collect()
    out = None
    for r in lengths:
        if not r.asked:
            continue
        bits = max((-(r.low or 0) - 1).bit_length(), (r.low or 0).bit_length() if (r.low or 0) > 0 else 0, (r.high or 0).bit_length()) + 1
        part = cut(sliced_rows(rows.filter(F.size("codes") == r.dim), bits))
        asks = part.filter(anchor)
        found = searched(asks.withColumn("scores", F.lit(None).cast("array<long>")), part, r.asked, r.n, r.dim, _positives(r.dim, bits, positives), "anchor_id long, positive_id long, positive_score long")
        pairs = cut(best_of(found, ["anchor_id"], "positive_score", "positive_id", positives).drop("rank"))
        windows = pairs.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_set("positive_score").alias("scores"))  # `positives` at most
        found = searched(asks.join(windows, "vec_id"), part, r.asked, r.n, r.dim, _negatives(r.dim, bits, negatives, least_percent), "anchor_id long, positive_score long, negative_id long, negative_score long")
        best = best_of(found, ["anchor_id", "positive_score"], "negative_score", "negative_id", negatives)
        got = pairs.join(best, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        out = got if out is None else out.union(got)
    if out is None:
        out = df.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(tables(spark, sf_dir, "embeddings"), label)


OP12_SQL = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, v.vec_id AS id, a.label = v.label AS same, list_dot_product(a.c, v.c)::BIGINT AS score
    FROM v AS a JOIN v ON a.vec_id <> v.vec_id AND len(a.c) = len(v.c) WHERE a.vec_id % 100 = 0
), p AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id)::INTEGER AS rank,
    s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
QUALIFY rank <= 5
"""

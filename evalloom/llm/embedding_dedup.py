"""Near duplicates among embeddings by an inverted multi-index.

Two codebooks, fitted independently on the halves of a bounded sample of unit vectors, form a product grid;
every vector is indexed in its cell. A query visits the cells nearest to it in the order of the sum of both
halves' squared distances (the multi-sequence order), as many as a calibration says it takes for the target
recall of neighbours that lie just on the threshold (nearer ones are found more often). All of a visited
cell is then verified in double precision; a pair counts when either of the two finds the other.

Identical vectors are one class with a multiplicity. Cells and their queries are dealt out in chunks, so a
cell of any size is many small tasks, and a task returns counts and a spanning forest, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm.common import cut, sample_of, sliced, tables
from evalloom.llm.components import components, forest

#: Vectors that the codebooks are fitted on, at most (or WORD_ROWS for each codeword, if these are more), and those that the calibration takes.
TRAIN_ROWS, WORD_ROWS, CALIBRATION_ROWS = 20_000, 16, 400
#: Codewords of a half, at most; vectors that a cell is planned for. With 4,096 words a label has 16.8 million cells,
#: so cells only grow beyond 400 million different vectors of a label.
MOST_WORDS, CELL_ROWS = 4_096, 25
#: Rows of a cell, or queries to it, in one task.
CHUNK = 2_048
RECALL = 0.985


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        at = nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c = np.where(n[:, None] > 0, total / np.maximum(1, n)[:, None], x[rng.integers(len(x), size=len(c))])
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(x[i : i + 4096], c).argmin(axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x**2).sum(axis=1)[:, None] - 2 * x @ c.T + (c**2).sum(axis=1))


class MultiIndex:
    """The product grid; small, and sent to the executors whole."""

    def __init__(self, sample: np.ndarray, words: int, threshold: float, recall: float = RECALL) -> None:
        self.half = sample.shape[1] // 2
        self.books = [kmeans(part, words) for part in (sample[:, : self.half], sample[:, self.half :])]
        self.words = len(self.books[1])
        self.visits = 1
        self.visits = self._calibrated(sample[:: max(1, len(sample) // CALIBRATION_ROWS)][:CALIBRATION_ROWS], threshold, recall)

    def _parts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return distances(x[:, : self.half], self.books[0]), distances(x[:, self.half :], self.books[1])

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self._parts(x)
        return (a.argmin(axis=1) * self.words + b.argmin(axis=1)).astype(np.int32)

    def _calibrated(self, q: np.ndarray, threshold: float, recall: float) -> int:
        """Visits that reach the cells of this share of neighbours on the threshold, in random directions."""
        rng = np.random.default_rng(5)
        off = rng.normal(size=q.shape)
        off -= (off * q).sum(axis=1, keepdims=True) * q
        off /= np.maximum(1e-12, np.linalg.norm(off, axis=1, keepdims=True))
        cells = self.cells(threshold * q + np.sqrt(max(0.0, 1 - threshold**2)) * off)
        a, b = self._parts(q)
        mine = a[np.arange(len(q)), cells // self.words] + b[np.arange(len(q)), cells % self.words]
        ranks = [int(np.searchsorted(np.sort(y), m - x, "left").sum()) for x, y, m in zip(a, b, mine, strict=True)]
        return int(np.quantile(ranks, recall, method="higher")) + 1 if ranks else 1

    def visited(self, x: np.ndarray) -> np.ndarray:
        """The nearest cells of each row, in multi-sequence order.

        The cell of the halves' i-th and j-th nearest words comes after (i + 1)(j + 1) - 1 others, so only
        those under that hyperbola can be among the first.
        """
        a, b = self._parts(x)
        ra, rb = a.argsort(axis=1), b.argsort(axis=1)
        width = np.minimum(b.shape[1], self.visits // np.arange(1, min(a.shape[1], self.visits) + 1))
        i = np.repeat(np.arange(len(width)), width)
        j = np.arange(len(i)) - np.repeat(np.cumsum(width) - width, width)
        total = np.take_along_axis(a, ra, 1)[:, i] + np.take_along_axis(b, rb, 1)[:, j]
        first = total.argsort(axis=1, kind="stable")[:, : self.visits]
        cells = ra[:, i] * self.words + rb[:, j]
        return np.take_along_axis(cells, first, 1).astype(np.int32)


def unit(blobs: list[bytes], dim: int) -> np.ndarray:
    joined = b"".join(blobs)
    x = np.frombuffer(joined, "<f4" if len(joined) == 4 * dim * len(blobs) else "<f8").reshape(len(blobs), dim).astype(float)
    return normed(x)


def normed(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; first brought near 1 by powers of two, which rounds nothing, so that squares stay in range."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _placed(index: MultiIndex, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1024):
            x = unit(b.column(3).to_pylist(), dim)
            visits = index.visited(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(index.cells(x)), pa.array(list(visits), pa.list_(pa.int32()))], names=["vec_id", "label", "copies", "vec", "cell", "visits"])

    return run


def _verify(dim: int, threshold: float):
    """A function for applyInPandas: a chunk of a cell and a chunk of its queries -> counts and a forest."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, q = pdf[~pdf["asks"]], pdf[pdf["asks"]]
        none = pd.DataFrame({"a": pd.Series([], dtype="int64"), "b": pd.Series([], dtype="int64"), "n": pd.Series([], dtype="int64")})
        if x.empty or q.empty:
            return none
        hit = unit(q["vec"].tolist(), dim) @ unit(x["vec"].tolist(), dim).T >= threshold
        xi, qi = x["vec_id"].to_numpy(), q["vec_id"].to_numpy()
        hit &= qi[:, None] != xi[None]
        r, c = np.nonzero(hit)
        if not len(r):
            return none
        got = hit @ x["copies"].to_numpy()
        # the other way round counts here only where the indexed one doesn't visit the query's own cell
        cell_of, visits = q["cell"].to_numpy(), np.stack(x["visits"].to_list())
        back = np.zeros(len(xi), np.int64)
        mult = q["copies"].to_numpy()
        for k in np.unique(c):
            rows = np.flatnonzero(hit[:, k])
            miss = ~np.isin(cell_of[rows], visits[k])
            back[k] = mult[rows[miss]].sum()
        a, b = forest(qi[r], xi[c])
        ids, n = np.r_[qi, xi], np.r_[got, back]
        some = n > 0
        return pd.DataFrame({"a": np.r_[ids[some], a], "b": np.r_[np.full(int(some.sum()), -1), b], "n": np.r_[n[some], np.zeros(len(a), np.int64)]})

    return run


def near_embeddings(df: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", train_rows: int = TRAIN_ROWS, recall: float = RECALL) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Only vectors with equal, non-null labels and equal lengths are compared. A vector that is null, empty or
    zero, or holds null or non-finite components, links with nothing. Rows without an id are left out; rows
    that repeat an id are one node. Vectors of floats are kept as such, any others as doubles. An empty table
    gives an empty result.
    """
    vec, kind = F.col("vec"), "array<float>" if dict(df.dtypes)[vec_col] == "array<float>" else "array<double>"
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).cast(kind).alias("vec")).filter("vec_id IS NOT NULL")
    sound = F.exists(vec, lambda v: v != 0) & F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = rows.filter("label IS NOT NULL AND vec IS NOT NULL AND size(vec) > 0").filter(sound)
    # a class of identical vectors goes by its smallest id; of an id's several vectors each is searched
    classes = cut(good.groupBy("label", "vec").agg(F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("copies")))
    found = None
    for dim, n in classes.groupBy(F.size("vec").alias("dim")).count().collect():
        part = classes.filter(F.size("vec") == dim)
        labels = max(1, part.select("label").distinct().count())
        words = int(np.clip(round((n / labels / CELL_ROWS) ** 0.5), 2, MOST_WORDS))
        most = max(train_rows, WORD_ROWS * words)
        sample = sample_of(part, most, "rep").select("vec").limit(2 * most).toArrow().column(0).combine_chunks().flatten().to_numpy().reshape(-1, dim).astype(float)
        index = MultiIndex(normed(sample), words, threshold, recall)
        got = _searched(part, index, dim, threshold)
        found = got if found is None else found.union(got)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = cut(found)
    counts = found.filter("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    of = good.select("vec_id", "label", "vec").join(classes, ["label", "vec"]).select("vec_id", "rep", "copies")
    roots = components(found.filter("n = 0").select("a", "b").union(of.select(F.col("vec_id").alias("a"), F.col("rep").alias("b")).filter("a <> b")))
    linked = of.join(counts, "rep", "left").groupBy("vec_id").agg(F.max(F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("vec_id").join(linked, "vec_id", "left").join(roots, F.col("vec_id") == F.col("node"), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"), (F.coalesce("root", "vec_id") == F.col("vec_id")).alias("kept"))


def measured_recall(df: DataFrame, links: DataFrame, threshold: float = 0.93, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", block: int = 2_000) -> tuple[int, int]:
    """(links found, links there are) of the vectors whose id is divisible by `every`, against all vectors.

    links: vec_id, n_links as near_embeddings gives them. The queries go out in blocks; each task compares what it
    reads with a block and returns counts. Vectors that link with nothing by rule are left out on either side.
    """
    spark, vec = df.sparkSession, F.col("vec")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("vec")).filter("vec_id IS NOT NULL AND label IS NOT NULL AND size(vec) > 0")
    rows = rows.filter(F.exists(vec, lambda v: v != 0) & F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    asked = cut(rows.filter(F.col("vec_id") % every == 0).repartitionByRange("vec_id"))
    ids = [r.vec_id for r in asked.select("vec_id").distinct().orderBy("vec_id").toLocalIterator()]
    there = 0
    for lo in range(0, len(ids), block):
        part = asked.filter(F.col("vec_id").between(ids[lo], ids[min(len(ids), lo + block) - 1])).collect()
        by: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        for key in {(r.label, len(r.vec)) for r in part}:
            mine = [r for r in part if (r.label, len(r.vec)) == key]
            by[key] = np.array([r.vec_id for r in mine]), normed(np.array([r.vec for r in mine], float))

        def count(batches: Iterator[pa.RecordBatch], by: dict = by) -> Iterator[pa.RecordBatch]:
            n = 0
            for b in sliced(batches, 1024):
                keys = [(la, len(v)) for la, v in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
                for key in set(keys) & by.keys():
                    at = [i for i, k in enumerate(keys) if k == key]
                    y = normed(np.array(b.column(2).take(pa.array(at)).to_pylist(), float))
                    q, x = by[key]
                    hit = x @ y.T >= threshold
                    n += int((hit & (q[:, None] != b.column(0).to_numpy()[at])).sum())
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

        there += rows.mapInArrow(count, "n long").agg(F.sum("n")).head()[0] or 0
    of = rows.select("vec_id").distinct()
    found = spark.createDataFrame([], "n long").union(links.filter(F.col("vec_id") % every == 0).join(of, "vec_id", "left_semi").select("n_links")).agg(F.sum("n")).head()[0] or 0
    return int(found), int(there)


def _blob(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches, 4096):
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([np.asarray(v, "<f4" if b.column(3).type.value_type == pa.float32() else "<f8").tobytes() for v in b.column(3).to_pylist()], pa.binary())], names=["vec_id", "label", "copies", "vec"])


def _searched(part: DataFrame, index: MultiIndex, dim: int, threshold: float) -> DataFrame:
    """(a, b, n): counts of links (n > 0) and edges of a spanning forest (n = 0)."""
    label = dict(part.dtypes)["label"]
    blobs = part.select(F.col("rep").alias("vec_id"), "label", "copies", "vec").mapInArrow(_blob, f"vec_id long, label {label}, copies long, vec binary")
    placed = cut(blobs.mapInArrow(_placed(index, dim), f"vec_id long, label {label}, copies long, vec binary, cell int, visits array<int>"))
    asks = placed.select("label", F.explode("visits").alias("at"), "vec_id", "copies", "vec", "cell")
    holds = placed.groupBy("label", F.col("cell").alias("at")).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("held"))
    asked = asks.groupBy("label", "at").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("asked"))
    plan = cut(holds.join(asked, ["label", "at"]))
    mine = F.xxhash64("vec_id")
    x = placed.withColumn("at", F.col("cell")).join(plan, ["label", "at"]).select("label", "at", F.pmod(mine, F.col("held")).cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.col("asked") - 1)).alias("q"), F.lit(False).alias("asks"), "vec_id", "copies", "vec", "cell", "visits")
    q = asks.join(plan, ["label", "at"]).select("label", "at", F.explode(F.sequence(F.lit(0), F.col("held") - 1)).alias("x"), F.pmod(mine, F.col("asked")).cast("int").alias("q"), F.lit(True).alias("asks"), "vec_id", "copies", "vec", "cell", F.lit(None).cast("array<int>").alias("visits"))
    return x.union(q).groupBy("label", "at", "x", "q").applyInPandas(_verify(dim, threshold), "a long, b long, n long")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(tables(spark, sf_dir, "embeddings"))

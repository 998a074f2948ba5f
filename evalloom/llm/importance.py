"""Importance resampling towards a target distribution over hashed word n-grams.

The counts of all documents in all buckets are one sparse matrix. It is written once, as a table of CSR blocks in the
shared folder; what follows reads only that. The sums of its columns are the corpus's distribution, those of the target
texts' matrix the target's; from both comes a gain for each bucket, and the matrix times the gains gives each
document's weight. Gumbel noise from the document's id makes the highest scores a draw without replacement.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalloom.llm.common import bytes_of, cut, docs_of, ids_of, shared_path, sliced, tables

BUCKETS, PERCENT, MIN_WORDS, SEED = 10_000, 25, 20, 7
#: Entries of a block after which it is closed, and bytes of a text that are cut into words at once.
BLOCK_ENTRIES, PIECE = 1 << 19, 1 << 20
#: Words whose checksums a task remembers.
KNOWN_WORDS = 200_000
#: Lengths of second words whose checksums are joined by tables; longer ones are computed anew.
JOINED = 64

BLOCK = "doc_ids binary, n_words binary, starts binary, buckets binary, counts binary, width int"
#: A byte as it counts in words: A-Z as a-z, digits, and all that isn't ASCII; other bytes part words.
_AS_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@cache
def _shifts() -> np.ndarray:
    """[n, k, b]: what byte k of value b of a checksum becomes when n more bytes follow.

    A checksum is linear over bits: that of a text and n bytes is the shifted one of the text, xor that of the n bytes.
    """
    step = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    out = np.zeros((JOINED + 1, 4, 256), np.uint32)
    for k in range(4):
        x = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        out[0, k] = x
        for n in range(1, JOINED + 1):
            x = (x >> np.uint32(8)) ^ step[x & np.uint32(255)]
            out[n, k] = x
    return out


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time; each piece but the first begins with the last word of the one before."""
    clean, lo, last = text.translate(_AS_WORD), 0, []
    while lo < len(clean):
        hi = clean.find(b" ", lo + PIECE)
        hi = len(clean) if hi < 0 else hi
        words = last + clean[lo:hi].split()
        yield words
        last, lo = words[-1:], hi


class Hasher:
    """Buckets of the features of texts. Words are looked up once, and pairs are joined from their words' checksums."""

    def __init__(self, buckets: int) -> None:
        self.buckets, self.known = buckets, {}

    def counts(self, text: bytes) -> tuple[np.ndarray, int]:
        """(how often each bucket occurs, number of words)."""
        total, n_words, first = np.zeros(self.buckets, np.int64), 0, True
        for words in pieces(text):
            if len(self.known) > KNOWN_WORDS:
                self.known.clear()
            known = self.known
            for w in set(words).difference(known):
                known[w] = (zlib.crc32(w), zlib.crc32(b" " + w), len(w) + 1)
            if not words:
                continue
            one, other, size = np.array([known[w] for w in words], np.uint32).T
            if len(words) > 1:
                pair, n = one[:-1], np.minimum(size[1:], JOINED)
                table = _shifts()
                both = other[1:] ^ table[n, 0, pair & 255] ^ table[n, 1, (pair >> 8) & 255] ^ table[n, 2, (pair >> 16) & 255] ^ table[n, 3, pair >> 24]
                for i in np.flatnonzero(size[1:] > JOINED):
                    both[i] = zlib.crc32(b" " + words[i + 1], int(one[i]))
                total += np.bincount(both % self.buckets, minlength=self.buckets)
            fresh = one if first else one[1:]  # the word that a piece takes over is counted already
            total += np.bincount(fresh % self.buckets, minlength=self.buckets)
            n_words, first = n_words + len(fresh), False
        return total, n_words


class Block:
    """Rows of the matrix until they are written."""

    def __init__(self) -> None:
        self.ids, self.words, self.ends, self.at, self.of = [], [], [0], [], []

    def add(self, doc_id: int, n_words: int, counts: np.ndarray) -> None:
        at = np.flatnonzero(counts)
        self.ids.append(doc_id)
        self.words.append(n_words)
        self.ends.append(self.ends[-1] + len(at))
        self.at.append(at.astype("<u4"))
        self.of.append(counts[at])

    def written(self) -> pa.RecordBatch:
        at, of = np.concatenate(self.at), np.concatenate(self.of)
        width = next(w for w in (1, 2, 4, 8) if of.max(initial=0) < 1 << (8 * w - (w == 8)))
        cols = [np.array(self.ids, "<i8"), np.array(self.words, "<i8"), np.array(self.ends, "<i8"), at.astype("<u2" if at.max(initial=0) < 1 << 16 else "<u4"), of.astype(f"<u{width}")]
        return pa.RecordBatch.from_arrays([*[pa.array([c.tobytes()], pa.binary()) for c in cols], pa.array([width], pa.int32())], names=["doc_ids", "n_words", "starts", "buckets", "counts", "width"])


def unpacked(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, numbers of words, starts, buckets, counts) of each block."""
    for ids, words, starts, at, of, width in zip(*[c.to_pylist() for c in b.columns], strict=True):
        n = len(of) // width
        yield *(np.frombuffer(x, "<i8") for x in (ids, words, starts)), np.frombuffer(at, f"<u{len(at) // n if n else 2}").astype(np.int64), np.frombuffer(of, f"<u{width}").astype(np.int64)


def matrix(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The CSR blocks of docs (doc_id, text). A block closes by its entries, so its size is bounded whatever the texts' lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, block = Hasher(buckets), Block()
        for b in sliced(batches, 64):
            for i, text in zip(ids_of(b).tolist(), bytes_of(b), strict=True):
                counts, n_words = hasher.counts(text)
                block.add(i, n_words, counts)
                if block.ends[-1] + 16 * len(block.ids) >= BLOCK_ENTRIES:
                    yield block.written()
                    block = Block()
        if block.ids:
            yield block.written()

    return docs.mapInArrow(run, BLOCK)


def stored(spark: SparkSession, blocks: DataFrame, name: str) -> DataFrame:
    """The blocks, written to the shared folder and read from there."""
    path = shared_path(spark, name)
    blocks.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Sums of the matrix's columns: each task adds up its blocks, Spark the tasks, and the driver gets one number a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, _, at, of in unpacked(b):
                np.add.at(total, at, of)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in blocks.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # `buckets` rows at most
        out[r.bucket] = r.n
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of a bucket's smoothed shares), in doubles."""
    n, (s_all, t_all) = len(corpus), (int(corpus.sum()), int(target.sum()))
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weights(blocks: DataFrame, gains: np.ndarray) -> DataFrame:
    """The matrix times the gains: doc_id, n_words, n_features, weight (the floored mean of the gains of its features, 0 without)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, words, starts, at, of in unpacked(b):
                n, total = (np.diff(np.r_[0, np.cumsum(x)][starts]) for x in (of, gains[at] * of))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, words, n, total // np.maximum(n, 1))], names=["doc_id", "n_words", "n_features", "weight"])

    return blocks.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 times Gumbel noise) that the seed and the id alone decide."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with `place`, 1 for the first in this order: sorted ranges, and the number of rows before each of them."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranges = cut(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    sizes = ranges.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each range
    within = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return ranges.join(F.broadcast(before), "_part").withColumn("place", F.col("_before") + within).drop("_part", "_before")


def resample(df: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, buckets: int = BUCKETS, target_id: str = "item_id") -> DataFrame:
    """One row per row: doc_id, n_features, weight, score, rank, n_words.

    Features are the words of a text and the pairs of its neighbouring words, repeats counted; a word is a run of
    letters a-z (A-Z in lower case), digits and characters beyond ASCII. Of the documents with at least min_words words
    the percent (rounded down) of highest scores are drawn and ranked, ties to the smaller doc_id; the others' rank is
    null. A null text is empty, has weight 0 and is never drawn. Rows without an id are left out; rows that repeat an
    id are each a document, with the same noise. Without target texts all gains come from the corpus alone.
    """
    spark = df.sparkSession
    blocks = stored(spark, matrix(docs_of(df), buckets), "importance-corpus")
    wanted = stored(spark, matrix(docs_of(target.withColumn(target_id, F.coalesce(F.col(target_id).cast("long"), F.lit(0))), target_id), buckets), "importance-target")
    gains = gains_of(column_sums(blocks, buckets), column_sums(wanted, buckets))
    scored = cut(weights(blocks, gains).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    able = scored.filter(F.col("n_words") >= min_words)
    draw = able.count() * percent // 100
    order = [F.desc("score"), F.asc("doc_id"), F.desc("weight"), F.asc("n_features")]
    drawn = ranked(able, order).withColumn("rank", F.when(F.col("place") <= draw, F.col("place")).cast("long"))
    rest = scored.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.drop("place").unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "benchmark"))


#: The checksum is taken byte by byte, on distinct features, by a table that SQL derives itself.
OP13_SQL = """
WITH crc AS (
    SELECT list(c ORDER BY b) AS step FROM (
        SELECT b, list_reduce(list_prepend(b, range(8)::BIGINT[]), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c
        FROM (SELECT unnest(range(256))::BIGINT AS b))
), both_texts AS (
    SELECT doc_id AS id, 0 AS wanted, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL
    UNION ALL SELECT item_id, 1, coalesce(text, '') FROM benchmark
), worded AS (
    SELECT id, wanted, list_filter(string_split(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '), lambda w: w <> '') AS words
    FROM both_texts
), featured AS (
    SELECT id, wanted, unnest(words || list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS f FROM worded
), counted AS (SELECT id, wanted, f, count(*) AS n FROM featured GROUP BY ALL
), hexed AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM counted)
), summed AS (
    SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
        lambda x, y: xor(x >> 8, step[xor(x & 255, y) + 1]))) % 10000 AS bucket
    FROM hexed, crc
), entries AS (SELECT id, wanted, bucket, sum(n)::BIGINT AS n FROM counted JOIN summed USING (f) GROUP BY ALL
), sums AS (SELECT bucket, coalesce(sum(n) FILTER (wanted = 0), 0) AS s, coalesce(sum(n) FILTER (wanted = 1), 0) AS t FROM entries GROUP BY bucket
), gains AS (
    SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM sums) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM sums) + 10000)::DOUBLE)))::BIGINT AS gain
    FROM sums
), weighed AS (SELECT id, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight FROM entries JOIN gains USING (bucket) WHERE wanted = 0 GROUP BY id
), scored AS (
    SELECT id AS doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
    FROM worded LEFT JOIN weighed USING (id) WHERE wanted = 0
), placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN place <= 25 * (SELECT count(*) FROM placed) // 100 THEN place END AS rank, n_words::BIGINT AS n_words
FROM scored LEFT JOIN placed USING (doc_id)
"""

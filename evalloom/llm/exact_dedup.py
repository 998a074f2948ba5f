"""Exact duplicates by a log-structured merge index of digests.

Digests are computed in the JVM. Memtables (one after another within a task) flush sorted runs, cut by
digest range and each with a Bloom filter; compaction of a range merges its runs level by level, FAN at a time,
keeps the smallest id of a digest and adds up the counts. The filters spare the merge: of the runs merged, an
entry that is in no other one's filter is handed on to the next level as it is, so the work is the number of
entries times the levels, however many memtables there are. Members of a group are then compared byte
by byte with the row that stays; were two texts to share a digest, each would get a group of its own.

A group of any size is safe: memtables pre-aggregate it before the shuffle, the join back to rows is
salted, and the text that stays is copied once per 1,024 members for the comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm.common import cut, docs_of, ids_of, tables

#: What the contract calls white space.
SPACES = r"[\x20\x09-\x0D]+"
MEMTABLE_ROWS = 100_000
#: Digests that one range of the index is planned for.
RANGE_ROWS = 200_000
SALTS = 16
#: Members of groups (ids and digests, under 10 MB) that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
BITS_PER_KEY = 10
#: Runs that are merged at once.
FAN = 8


def bloom(keys: np.ndarray) -> np.ndarray:
    """A Bloom filter of 64-bit keys, with three probes: an array of bits."""
    out = np.zeros(max(64, -(-len(keys) * BITS_PER_KEY // 8) * 8), bool)
    for p in probes(keys, len(out)):
        out[p] = True
    return out


def probes(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    n = np.uint64(bits)
    return [((keys >> np.uint64(s)) ^ (keys << np.uint64(7))) % n for s in (3, 17, 31)]


def maybe_in(filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    out = np.ones(len(keys), bool)
    for p in probes(keys, len(filter_)):
        out &= filter_[p]
    return out


def words_of(raw: np.ndarray) -> np.ndarray:
    """Digests (rows of bytes) as rows of 64-bit words in the same order."""
    n, width = raw.shape
    wide = np.zeros((n, -(-width // 8) * 8), np.uint8)
    wide[:, :width] = raw
    return wide.view(">u8").astype(np.uint64)


def reduced(words: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct digests with their smallest id and summed count."""
    order = np.lexsort(words.T[::-1])
    w, i, c = words[order], ids[order], counts[order]
    first = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]).any(axis=1)])
    return w[first], np.minimum.reduceat(i, first), np.add.reduceat(c, first)


def memtables(ranges: int, rows: int):
    """A function for mapInArrow: (doc_id, digest) -> sorted runs, a row for each run and digest range."""

    def flush(raw: list[bytes], ids: list[np.ndarray]) -> pa.RecordBatch:
        got = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)
        w, i, c = reduced(words_of(got), np.concatenate(ids), np.ones(len(raw), np.int64))
        part = ((w[:, 0] >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        out = []
        for r in np.unique(part):
            lo, hi = np.searchsorted(part, [r, r + np.uint64(1)])
            out.append((int(r), w[lo:hi].tobytes(), i[lo:hi].tobytes(), c[lo:hi].tobytes(), np.packbits(bloom(w[lo:hi, 0])).tobytes()))
        cols = [pa.array([x[0] for x in out], pa.int32()), *(pa.array([x[k] for x in out], pa.binary()) for k in (1, 2, 3, 4))]
        return pa.RecordBatch.from_arrays(cols, names=["range", "digests", "ids", "counts", "filter"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, ids = [], []
        for b in batches:
            raw += b.column(b.schema.get_field_index("digest")).to_pylist()
            ids.append(ids_of(b).astype(np.int64))
            if len(raw) >= rows:
                yield flush(raw, ids)
                raw, ids = [], []
        if raw:
            yield flush(raw, ids)

    return run


Run = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # digests, smallest ids, counts, filter


def merged(runs: list[Run]) -> Run:
    """One run of several: entries that another one's filter may hold are sorted together, the others pass."""
    picked, rest = [], []
    for k, (w, ids, counts, _) in enumerate(runs):
        may = np.zeros(len(w), bool)
        for j, other in enumerate(runs):
            if j != k:
                left = np.flatnonzero(~may)
                may[left] = maybe_in(other[3], w[left, 0])
        picked.append((w[may], ids[may], counts[may]))
        rest.append((w[~may], ids[~may], counts[~may]))
    if any(len(x[0]) for x in picked):
        rest.append(reduced(*(np.concatenate([x[k] for x in picked]) for k in range(3))))
    w, ids, counts = (np.concatenate([x[k] for x in rest]) for k in range(3))
    return w, ids, counts, bloom(w[:, 0])


def compacted(runs: list[Run], fan: int = FAN) -> Run:
    while len(runs) > 1:
        runs = [merged(runs[i : i + fan]) for i in range(0, len(runs), fan)]
    return runs[0]


def compact(width: int, fan: int):
    """A function for applyInPandas: all runs of a digest range -> the digests that occur more than once."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        n_words = -(-width // 8)
        runs = [(np.frombuffer(a, np.uint64).reshape(-1, n_words), np.frombuffer(b, np.int64), np.frombuffer(c, np.int64), np.unpackbits(np.frombuffer(f, np.uint8)).astype(bool)) for a, b, c, f in zip(pdf["digests"], pdf["ids"], pdf["counts"], pdf["filter"], strict=True)]
        w, i, c, _ = compacted(runs, fan)
        many = c > 1
        raw = w[many].astype(">u8").view(np.uint8).reshape(-1, n_words * 8)[:, :width]
        return pd.DataFrame({"digest": pd.Series([x.tobytes() for x in raw], dtype=object), "keep_id": i[many], "group_size": c[many]})

    return merge


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 32, memtable_rows: int = MEMTABLE_ROWS, range_rows: int = RANGE_ROWS, fan: int = FAN) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space became one space; null is empty, so
    all empty texts are one group. Rows without an id are left out. Rows that repeat an id count as rows
    of their own, and all rows with the id that stays are kept. An empty table gives an empty result.
    width: bytes of the SHA-256 that the index uses (32: all; fewer only to test the byte comparison).
    """
    norm = F.regexp_replace("text", SPACES, " ")
    docs = docs_of(df, id_col, text_col)
    seen = cut(docs.select("doc_id", F.unhex(F.sha2(norm.cast("binary"), 256)).alias("sha")))
    keyed = seen.select("doc_id", F.substring("sha", 1, width).alias("digest"))
    ranges = max(1, -(-seen.count() // range_rows))
    runs = keyed.mapInArrow(memtables(ranges, memtable_rows), "range int, digests binary, ids binary, counts binary, filter binary")
    groups = cut(runs.groupBy("range").applyInPandas(compact(width, fan), "digest binary, keep_id long, group_size long"))

    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    of_row = cut(seen.withColumns({"digest": F.substring("sha", 1, width), "salt": F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")}).join(salted, ["digest", "salt"], "left").select("doc_id", "sha", "digest", "keep_id", F.coalesce("group_size", F.lit(1)).alias("group_size")))

    # The bytes of every member are held against those of the row that stays.
    share = F.greatest(F.lit(1), F.ceil(F.col("group_size") / 1024)).cast("int")
    members = of_row.filter("group_size > 1").select("doc_id", "digest", "keep_id", share.alias("copies")).distinct()
    members = F.broadcast(members) if members.count() <= BROADCAST_ROWS else members
    sha = F.unhex(F.sha2(F.col("norm").cast("binary"), 256))
    texts = docs.join(members, "doc_id").withColumn("norm", norm).filter(F.substring(sha, 1, width) == F.col("digest")).drop("text")
    kept = texts.filter("doc_id = keep_id").groupBy("digest", "copies").agg(F.min("norm").alias("kept_norm")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    told = texts.withColumn("part", F.pmod(F.xxhash64("doc_id", "norm"), F.col("copies")).cast("int")).join(kept, ["digest", "part"])
    odd = cut(told.filter("norm <> kept_norm").select("doc_id", "digest", "norm"))
    if odd.isEmpty():
        pairs = of_row.select("doc_id", "sha", F.coalesce("keep_id", "doc_id").alias("keep_id"), "group_size")
    else:  # texts that share a digest with another: groups by their bytes
        shas = seen.select("doc_id", "sha").distinct()
        alone = odd.groupBy("digest", "norm").agg(F.min("doc_id").alias("odd_keep"), F.count("*").alias("odd_size"))
        own = odd.join(alone, ["digest", "norm"]).withColumn("sha", F.unhex(F.sha2(F.col("norm").cast("binary"), 256))).groupBy("doc_id", "sha").agg(F.first("odd_keep").alias("odd_keep"), F.first("odd_size").alias("odd_size")).join(shas, ["doc_id", "sha"])
        lost = odd.groupBy("digest").agg(F.count("*").alias("lost"))
        pairs = of_row.join(own, ["doc_id", "sha"], "left").join(lost, "digest", "left").select("doc_id", "sha", F.coalesce("odd_keep", "keep_id", "doc_id").alias("keep_id"), F.coalesce("odd_size", F.col("group_size") - F.coalesce("lost", F.lit(0))).alias("group_size"))
    return pairs.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), (F.col("doc_id") == F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(tables(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""

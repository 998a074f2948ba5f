"""Helpers that the training-data operators share.

Input rule for all of them: only the named id and text columns are read (so other columns, whatever
their names, never clash), a null text counts as empty, and a row with a null id cannot be named in a
result and is left out of it.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one step of a Python worker handles at once, whatever Arrow's batches hold.
SLICE_ROWS = 512
#: Bytes of such a step, unless one row has more.
SLICE_BYTES = 8 << 20
#: So many rows of a few numbers, or so many bytes, may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset, one of our own, on a single machine only."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir")
    if path is None:
        found = sc._jsc.sc().getCheckpointDir()
        if found.isEmpty() and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = found.get() if found.isDefined() else f"file://{tempfile.mkdtemp(prefix='evalloom-')}"
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder.

    Spark removes the files with the last reference if spark.cleaner.referenceTracking.cleanCheckpoints is set, as
    evalloom.session does; else they stay until the folder is emptied.
    """
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    df.sparkSession._jvm.System.gc()  # shuffle files go when the driver collects what refers to them, which a quiet driver seldom does
    return out


def few(df: DataFrame) -> DataFrame:
    """df, of a few numbers a row, to be broadcast if its rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def few_bytes(df: DataFrame, size: Column) -> DataFrame:
    """df, to be broadcast if its rows' sizes add up to little."""
    return F.broadcast(df) if (df.agg(F.sum(size)).head()[0] or 0) <= BROADCAST_BYTES else df


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def docs_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string): null texts are empty, rows without an id are left out."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter("doc_id IS NOT NULL")


def trimmed() -> None:
    """Gives memory that is free back to the system: workers live on between tasks, and several share an executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows and SLICE_BYTES, so that very long texts come by themselves."""
    trimmed()
    for b in batches:
        waiting = [b.slice(i, rows) for i in range(0, b.num_rows, rows)][::-1]
        while waiting:
            part = waiting.pop()
            if part.nbytes > SLICE_BYTES and part.num_rows > 1:
                half = part.num_rows // 2
                waiting += [part.slice(half), part.slice(0, half)]
            else:
                yield part


def ids_of(b: pa.RecordBatch, name: str = "doc_id") -> np.ndarray:
    return b.column(b.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def bytes_of(b: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The column's values as bytes, without decoding them."""
    col = b.column(b.schema.get_field_index(name))
    return col.cast(pa.binary() if pa.types.is_string(col.type) else pa.large_binary()).to_pylist()


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection that scatters 64-bit words (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


#: Bytes of texts that are hashed at once, about.
HASHED_BYTES = 1 << 20
_SPACE = np.isin(np.arange(256), np.r_[9:14, 32])
_LETTER = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LETTER[65:91] = _LETTER[97:123]  # A-Z as a-z
_STEP = np.uint64(0xD1342543DE82EF97)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs of anything but ASCII white space, A-Z in lower case), and the number of words of each text."""
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[buf]
    first = np.flatnonzero(~space & np.r_[True, space[:-1]])
    end = np.flatnonzero(space & np.r_[False, ~space[:-1]])
    size = end - first
    stops = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.r_[0, np.searchsorted(first, stops)])
    out, lo = np.zeros(len(first), np.uint64), 0
    power = np.ones(int(size.max(initial=0)), np.uint64)
    with np.errstate(over="ignore"):
        power[1:] = _STEP
        power = np.cumprod(power, dtype=np.uint64)
        while lo < len(first):
            hi = max(lo + 1, int(np.searchsorted(end, first[lo] + HASHED_BYTES, "right")))
            n = size[lo:hi]
            at = np.r_[0, np.cumsum(n)]
            within = np.arange(at[-1]) - np.repeat(at[:-1], n)
            letters = buf[first[lo] : end[hi - 1]][~space[first[lo] : end[hi - 1]]]
            out[lo:hi] = mix64(np.add.reduceat(_LETTER[letters] * power[within], at[:-1]) + n.astype(np.uint64))
            lo = hi
    return out, counts


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, from the words' hashes; of the whole where there are fewer than k."""
    if len(h) == 0:
        return h
    k = min(k, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j] + np.uint64(j + 1))
    return out


def gram_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Each text's set of runs of k words, as sorted hashes; its whole sequence where it has fewer words."""
    h, counts = word_hashes(texts)
    grams = rolled(h, k) if len(h) >= k else h[:0]
    at = np.r_[0, np.cumsum(counts)].tolist()
    return [np.unique(grams[lo : hi - k + 1]) if hi - lo >= k else rolled(h[lo:hi], k) for lo, hi in zip(at[:-1], at[1:], strict=True)]


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: int) -> bool:
    """True for the quarter of ids whose labels no model may see."""
    import zlib

    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def held_out_col(c: str = "doc_id"):
    return F.crc32(F.col(c).cast("string").cast("binary")) % 4 == 2


def sample_of(df: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """At most about `most` rows of df, those whose key hashes lowest: the same rows on every run.

    Only the keys are sorted for it. Rows of one key come together.
    """
    mark = F.xxhash64(F.col(key).cast("string"))
    last = df.select(mark.alias("h")).orderBy("h").limit(most).agg(F.max("h")).head()[0]
    return df.filter(mark <= F.lit(last)) if last is not None else df.limit(0)

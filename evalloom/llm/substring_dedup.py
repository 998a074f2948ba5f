"""Repeated passages across documents: MinHash banding of paragraphs, exact check, clusters of removals.

Long texts seldom keep their line breaks when a passage is copied into them, so a paragraph here is defined
by content: it has min_words words and begins where, of PLACES places in a row, the shingle's hash is lowest
(winnowing). So any PLACES + min_words - 1 words in a row (49, by default) that two texts share hold a whole
paragraph that both have, wherever they stand. Paragraphs overlap. Their five-word shingles are hashed to
bands tuned for recall at the threshold.

A task reads texts once and folds some million words at a time: it sends, packed, each paragraph's place and
mark (a sketch of its shingles and a hash of its words) and its bands with the sketch. Paragraphs with one mark
are a class; what a fold has several of goes to the buckets once, so a very common passage weighs little.
Classes that share a band, and whose sketches don't rule the threshold out, are verified by exact Jaccard
similarity: those of one fold there (most are overlapping paragraphs of one text), those of two folds by a join
with what is in them, read again at their first places. In a band of very many classes all are held against
the first one, and what is unlike it against all others, in chunks, so that no task grows with the band. Links
are between classes; their components are the clusters. Of each cluster the first document's paragraphs stay
and the others are removals, joined to passages where they overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evalloom.llm.common import bytes_of, cut, docs_of, few_bytes, ids_of, mix64, rolled, sliced, tables, word_hashes
from evalloom.llm.components import components, forest

MIN_WORDS, SHINGLE, PERCENT, RECALL = 24, 5, 80, 0.98
#: Of so many places in a row one begins a paragraph.
PLACES = 26
#: Bits of a sketch.
SKETCH = 40
#: Words whose paragraphs are folded within a task before the shuffle, about, and band entries of a bucket.
FOLD_WORDS, BUCKET_ENTRIES = 1_000_000, 500_000
#: Classes of a band that meet in one task, from either side.
CHUNK = 1_024


def tuned(similarity: float, recall: float) -> tuple[int, int]:
    """Bands and rows of a band: the fewest bands of at least two rows that reach the recall."""
    rows, bands = 2, 1
    while 1 - (1 - similarity**rows) ** bands < recall:
        bands += 1
    return bands, rows


def lowest(x: np.ndarray, size: int) -> np.ndarray:
    """The minimum of each `size` values in a row."""
    step = 1
    while 2 * step <= size:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (size - step)], x[size - step :]) if size > step else x


class Paragraphs:
    """Cuts texts into paragraphs, marks and signs them; whole batches at once."""

    def __init__(self, min_words: int, k: int, bands: int, rows: int) -> None:
        if not 1 <= k <= min_words:
            raise ValueError("a paragraph must hold a shingle")
        self._min, self._k, self._bands, self._rows = min_words, k, bands, rows
        seeds = mix64(np.arange(1, bands * rows + 1, dtype=np.uint64))
        self._seeds = [(s, mix64(s) | np.uint64(1)) for s in seeds]
        self._factors = mix64(np.arange(1001, 1001 + min_words, dtype=np.uint64)) | np.uint64(1)

    def cut(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word) of each paragraph, the hashes of its shingles and of its words, a row each."""
        h, size = word_hashes(texts)
        which = np.flatnonzero(size >= self._min)
        if not len(which):
            return which, which, np.zeros((0, self._min - self._k + 1), np.uint64), np.zeros((0, self._min), np.uint64)
        grams = rolled(h, self._k)
        first = (np.cumsum(size) - size)[which]
        size = size[which]
        starts = self._starts(grams, first, size - self._min + 1)
        text = np.searchsorted(first, starts, "right") - 1
        return which[text], starts - first[text], grams[starts[:, None] + np.arange(self._min - self._k + 1)], h[starts[:, None] + np.arange(self._min)]

    def _starts(self, grams: np.ndarray, first: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Of any PLACES places in a row in a text the lowest (of equal ones the last); of all, where there are fewer."""
        end = np.uint64((1 << 32) - 1)
        rank = grams >> np.uint64(32) << np.uint64(32) | end - np.arange(len(grams), dtype=np.uint64)
        long = places >= PLACES
        runs = np.where(long, places - PLACES + 1, 0)
        at = np.repeat(first - np.r_[0, np.cumsum(runs)[:-1]], runs) + np.arange(runs.sum())
        low = lowest(rank, PLACES)[at] if len(at) else rank[:0]
        cuts = np.column_stack([first[~long], first[~long] + places[~long]]).ravel()
        few_ = np.minimum.reduceat(np.r_[rank, end], cuts)[::2] if len(cuts) else rank[:0]
        return np.unique((end - (np.r_[low, few_] & end)).astype(np.int64))

    def marks(self, grams: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row a scattered sketch of its shingles (with some bits of hash) and a hash of its words; together they name its class.

        Bit i of the SKETCH bits tells whether an odd number of distinct shingles fall to i, so two sketches differ
        in no more bits than there are shingles in one set alone. The bits of hash below it tell texts of few
        different words apart, which have few sketches.
        """
        g = np.sort(grams, axis=1)
        bit = np.uint64(1) << ((g >> np.uint64(40)) * np.uint64(SKETCH) >> np.uint64(24))
        bit[:, 1:][g[:, 1:] == g[:, :-1]] = 0
        with np.errstate(over="ignore"):
            m2 = mix64(h @ self._factors)
        return mix64(np.bitwise_xor.reduce(bit, axis=1) << np.uint64(64 - SKETCH) | m2 >> np.uint64(SKETCH)), m2

    def sign(self, grams: np.ndarray) -> np.ndarray:
        """Band keys, a row for each paragraph."""
        keys = np.zeros((len(grams), self._bands), np.uint64)
        with np.errstate(over="ignore"):
            for j, (seed, odd) in enumerate(self._seeds):
                low = ((grams ^ seed) * odd).min(axis=1)
                b = j // self._rows
                keys[:, b] = mix64(keys[:, b] * np.uint64(31) + low + np.uint64(b + 1))
        return keys


#: What travels to a bucket, by kind. lone, paras: places (documents and texts of rows, paragraphs of each, first words)
#: with their marks; bands: sketches with band keys; cands: sketches; pairs, links: two sketches or classes; large: sketches with bands.
NAMES = ["bucket", "kind", "docs", "texts", "of", "at", "marks", "more"]
TYPES = "bucket int, kind string, docs binary, texts binary, of binary, at binary, marks binary, more binary"
ROW = np.dtype([("doc_id", "<i8"), ("text_id", "<i8")])
#: Bytes of a band's key within its bucket.
KEY = 3


def lows(x: np.ndarray, k: int) -> bytes:
    """The lowest k bytes of each number."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :k].tobytes()


def of_lows(b: bytes, k: int) -> np.ndarray:
    out = np.zeros((len(b) // k, 8), np.uint8)
    out[:, :k] = np.frombuffer(b, np.uint8).reshape(-1, k)
    return out.view("<u8").ravel()


def narrow(x: np.ndarray) -> bytes:
    """Numbers from 0 on, each in as many bytes as the largest needs."""
    return lows(x, max(1, -(-int(x.max(initial=0)).bit_length() // 8)))


def wide(b: bytes, n: int) -> np.ndarray:
    """The n numbers of narrow."""
    return of_lows(b, max(1, len(b) // max(1, n)))


def bucket_of(x: np.ndarray, buckets: int) -> np.ndarray:
    return (((x >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def named(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Band keys by their bucket and their lowest KEY bytes; keys of one bucket that differ elsewhere alone are rare, and only make candidates."""
    return bucket_of(keys, buckets).astype(np.uint64) << np.uint64(32) | keys & np.uint64((1 << 8 * KEY) - 1)


class Places:
    """Columns of paragraphs: row (document and text), first word, mark."""

    def __init__(self, row: np.ndarray, at: np.ndarray, m1: np.ndarray, m2: np.ndarray) -> None:
        self.row, self.at, self.m1, self.m2 = row, at, m1, m2

    def __getitem__(self, i) -> Places:
        return Places(self.row[i], self.at[i], self.m1[i], self.m2[i])

    def sorted(self) -> Places:
        return self[np.lexsort((self.at, self.row["text_id"], self.row["doc_id"], self.m2, self.m1))]

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """Of sorted ones: where a mark's run begins and ends."""
        new = np.r_[True, (self.m1[1:] != self.m1[:-1]) | (self.m2[1:] != self.m2[:-1])][: len(self.m1)]
        start = np.flatnonzero(new)
        return start, np.r_[start[1:], len(self.m1)]

    def packed(self, bucket: int, kind: str) -> tuple:
        """Row by row, in few bytes; what m1 holds of m2 is left out."""
        p = self[np.lexsort((self.at, self.row["text_id"], self.row["doc_id"]))]
        start, n = runs_in(p.row)
        doc_id = p.row["doc_id"][start].astype(np.uint64)
        docs = doc_id[:1].tobytes() + narrow(doc_id - doc_id[:1])
        return bucket, kind, docs, p.row["text_id"][start].tobytes(), narrow(n), narrow(p.at), p.m1.tobytes(), lows(p.m2, SKETCH // 8)

    @staticmethod
    def read(parts: list[tuple]) -> Places:
        rows, at = [], []
        for _, _, docs, texts, of, first, m1, _ in parts:
            u = np.empty(len(texts) // 8, ROW)
            u["doc_id"] = (np.frombuffer(docs[:8], np.uint64) + wide(docs[8:], len(u))).view(np.int64)
            u["text_id"] = np.frombuffer(texts, np.int64)
            rows.append(np.repeat(u, wide(of, len(u)).astype(np.int64)))
            at.append(wide(first, len(m1) // 8).astype(np.int32))
        m1 = np.frombuffer(b"".join(p[6] for p in parts), np.uint64)
        return Places(np.concatenate(rows), np.concatenate(at), m1, unmixed(m1) << np.uint64(SKETCH) | of_lows(b"".join(p[7] for p in parts), SKETCH // 8))


def split(x: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    cuts = np.searchsorted(x, np.arange(buckets + 1))
    for i in np.flatnonzero(np.diff(cuts)):
        yield int(i), slice(cuts[i], cuts[i + 1])


def parted(p: Places, kind: str, buckets: int) -> Iterator[tuple]:
    """Places sorted by mark, by the bucket of their mark."""
    for i, s in split(bucket_of(p.m1, buckets), buckets):
        yield p[s].packed(i, kind)


#: Classes of a band that are compared by shifts, and those that are compared in one task at all.
SMALL, LARGE = 16, 512


def near_pairs(start: np.ndarray, n: np.ndarray, sketch: np.ndarray, apart: int, large: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places in one run (start, n) of `large` or fewer whose sketches differ in `apart` bits or fewer."""
    run = np.repeat(np.arange(len(n)), n)
    small = np.repeat(n <= min(SMALL, large), n)
    left, right = [start[:0]], [start[:0]]
    for off in range(1, min(SMALL, int(n.max(initial=1)))):
        i = np.flatnonzero((run[off:] == run[:-off]) & small[off:])
        i = i[np.bitwise_count(sketch[i] ^ sketch[i + off]) <= apart]
        left.append(i)
        right.append(i + off)
    mid = (n > SMALL) & (n <= large)
    for lo, k in zip(start[mid].tolist(), n[mid].tolist(), strict=True):
        s = sketch[lo : lo + k]
        i, j = np.nonzero(np.triu(np.bitwise_count(s[:, None] ^ s) <= apart, 1))
        left.append(lo + i)
        right.append(lo + j)
    return np.concatenate(left), np.concatenate(right)


def runs_in(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Beginnings and lengths of the runs of equal values."""
    start = np.flatnonzero(np.r_[True, x[1:] != x[:-1]][: len(x)])
    return start, np.diff(np.r_[start, len(x)])


def alike(grams: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which of the pairs of rows are sets that reach percent by exact Jaccard similarity."""
    g = np.sort(grams, axis=1)
    again = np.zeros(g.shape, bool)
    again[:, 1:] = g[:, 1:] == g[:, :-1]
    g[again] = 0
    lost = again.sum(axis=1)
    out = np.zeros(len(i), bool)
    for lo in range(0, len(i), 20_000):
        a, b = i[lo : lo + 20_000], j[lo : lo + 20_000]
        both = np.sort(np.c_[g[a], g[b]], axis=1)
        zeros = lost[a] + lost[b]
        common = (both[:, 1:] == both[:, :-1]).sum(axis=1) - np.maximum(0, zeros - 1)
        out[lo : lo + 20_000] = 100 * common >= percent * (2 * g.shape[1] - zeros - common)
    return out


def node_of(m1: np.ndarray, m2: np.ndarray) -> np.ndarray:
    """The class of a mark, as one number."""
    with np.errstate(over="ignore"):
        return mix64(m1 * np.uint64(0x9E3779B97F4A7C15) ^ mix64(m2))


def unmixed(x: np.ndarray) -> np.ndarray:
    """Undoes mix64."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))
        x = x * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
        x = x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))
        x = x * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
        return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


def sketch_of(x: np.ndarray) -> np.ndarray:
    """The sketch in a mark's first part."""
    return unmixed(x) >> np.uint64(64 - SKETCH)


def cands(marks: np.ndarray, buckets: int) -> Iterator[tuple]:
    marks = np.unique(marks)
    for i, s in split(bucket_of(marks, buckets), buckets):
        yield i, "cands", b"", b"", b"", b"", marks[s].tobytes(), b""


def two(bucket: int, kind: str, a: np.ndarray, b: np.ndarray) -> tuple:
    return bucket, kind, b"", b"", b"", b"", a.tobytes(), b.tobytes()


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.string(), *[pa.binary()] * 6)
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)], names=NAMES)


def fold(make: tuple, percent: int, buckets: int, apart: int, most: int):
    """A function for mapInArrow: (doc_id, text, text_id) -> what goes to the buckets.

    Of a mark that several documents have here only the first and the last place go to its bucket to meet
    others; the rest are known to repeat. Of a band that very many classes have here only the first goes. Of the
    links found here as many go as connect what they connect.
    """

    def emit(held: list[tuple], turn: int) -> pa.RecordBatch:
        row, at, m1, m2, keys, grams = (np.concatenate([x[j] for x in held]) for j in range(6))
        order = np.lexsort((m2, m1))
        c = order[np.r_[True, (m1[order][1:] != m1[order][:-1]) | (m2[order][1:] != m2[order][:-1])]]
        bands, who = named(keys[c].ravel(), buckets), np.repeat(np.arange(len(c)), keys.shape[1])
        order = np.argsort(bands, kind="stable")
        bands, who = bands[order], who[order]
        start, n = runs_in(bands)
        i, j = near_pairs(start, n, sketch_of(m1[c])[who], apart, most)
        met = np.unique(np.minimum(who[i], who[j]) * len(c) + np.maximum(who[i], who[j]))
        i, j = met // len(c), met % len(c)
        true = alike(grams[c], i, j, percent)
        i, j = forest(c[i[true]], c[j[true]])
        large = np.repeat(n > most, n)
        rows = list(cands(np.r_[m1[i], m1[j], m1[c][who[large]]], buckets))
        here = turn % buckets
        if len(i):
            rows.append(two(here, "links", node_of(m1[i], m2[i]), node_of(m1[j], m2[j])))
        if large.any():
            rows.append(two(here, "large", m1[c][who[large]], bands[large]))
        stands = ~large
        stands[start] = True
        bands, marks = bands[stands], m1[c][who[stands]]
        for k, s in split((bands >> np.uint64(32)).astype(np.int64), buckets):
            rows.append((k, "bands", b"", b"", b"", b"", marks[s].tobytes(), lows(bands[s], KEY)))
        p = Places(row, at, m1, m2).sorted()
        start, end = p.groups()
        ends = np.zeros(len(at), bool)
        ends[start] = ends[end - 1] = True
        known = np.repeat(p.row["doc_id"][start] != p.row["doc_id"][end - 1], end - start) & ~ends
        rows += parted(p[~known], "lone", buckets)
        if known.any():
            rows.append(p[known].packed(here, "paras"))
        return batch_of(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, held, n, turn = Paragraphs(*make), [], 0, 0
        for b in sliced(batches, 256):
            texts = bytes_of(b)
            of = np.empty(len(texts), ROW)
            of["doc_id"], of["text_id"] = ids_of(b), ids_of(b, "text_id")
            turn = turn or int(of["doc_id"][0]) % 7919
            text, at, grams, h = cutter.cut(texts)
            if len(at):
                held.append((of[text], at, *cutter.marks(grams, h), cutter.sign(grams), grams))
            n += len(at) * PLACES // 2
            if n >= FOLD_WORDS:
                yield emit(held, turn)
                held, n, turn = [], 0, turn + 1
        if held:
            yield emit(held, turn)

    return run


def bucketed(buckets: int, apart: int, most: int):
    """A function for applyInPandas: a bucket -> paragraphs known to repeat or linked within a fold, and pairs to verify."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        of = {k: list(x.itertuples(index=False, name=None)) for k, x in pdf.groupby("kind")}
        rows = [x for k in ("paras", "links", "large") for x in of.get(k, [])]
        here = int(pdf["bucket"].iloc[0])
        if "bands" in of:
            bands = of_lows(b"".join(x[7] for x in of["bands"]), KEY)
            marks = np.frombuffer(b"".join(x[6] for x in of["bands"]), np.uint64)
            folds = np.repeat(np.arange(len(of["bands"])), [len(x[6]) // 8 for x in of["bands"]])
            order = np.lexsort((folds, marks, bands))
            b, m = bands[order], marks[order]
            new = np.r_[True, (b[1:] != b[:-1]) | (m[1:] != m[:-1])][: len(b)]
            b, m, f = b[new], m[new], folds[order][new]
            start, n = runs_in(b)
            i, j = near_pairs(start, n, sketch_of(m), apart, most)
            i, j = i[f[i] != f[j]], j[f[i] != f[j]]  # those of one fold were verified there
            pairs = np.unique(np.c_[np.minimum(m[i], m[j]), np.maximum(m[i], m[j])], axis=0)
            large = np.repeat(n > most, n)
            if len(pairs):
                rows.append(two(here, "pairs", np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])))
            if large.any():
                rows.append(two(here, "large", m[large], b[large] | np.uint64(here) << np.uint64(32)))
        if "lone" in of:
            p = Places.read(of["lone"]).sorted()
            start, end = p.groups()
            hit = np.repeat(p.row["doc_id"][start] != p.row["doc_id"][end - 1], end - start)
            if "cands" in of:
                hit |= np.isin(p.m1, np.frombuffer(b"".join(x[6] for x in of["cands"]), np.uint64))
            if hit.any():
                rows.append(p[hit].packed(here, "paras"))
        return pd.DataFrame(rows, columns=NAMES)

    return run


def place_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches, 64):
        p = Places.read(list(zip(*(c.to_pylist() for c in b.columns), strict=True))) if b.num_rows else Places(np.zeros(0, ROW), *(np.zeros(0, t) for t in (np.int32, np.uint64, np.uint64)))
        cols = [np.ascontiguousarray(p.row["doc_id"]), np.ascontiguousarray(p.row["text_id"]), p.at.astype(np.int32), node_of(p.m1, p.m2).view(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["doc_id", "text_id", "first_word", "node"])


def two_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of packed pairs."""
    for b in sliced(batches, 64):
        x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.int64) for k in range(2))
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])


MET = "doc_id long, text_id long, first_word int, sketch long, node long, grams array<long>"


def gram_rows(make: tuple, wanted: np.ndarray | None = None, inside: bool = True):
    """A function for mapInArrow: (doc_id, text, text_id) -> paragraphs with a wanted sketch, and what is in them if asked.

    wanted: sketches in order; where it is None all paragraphs, or those at the places of a fourth column.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Paragraphs(*make)
        for b in sliced(batches, 256):
            text, at, grams, h = cutter.cut(bytes_of(b))
            m1, m2 = cutter.marks(grams, h)
            if wanted is not None:
                near = np.searchsorted(wanted, m1)
                hit = wanted[np.minimum(near, len(wanted) - 1)] == m1 if len(wanted) else np.zeros(len(at), bool)
            elif b.num_columns > 3:
                places = b.column(3).to_pylist()
                hit = np.fromiter((int(a) in places[t] for t, a in zip(text.tolist(), at.tolist(), strict=True)), bool, len(at))
            else:
                hit = np.ones(len(at), bool)
            of, m1, m2 = text[hit], m1[hit], m2[hit]
            node, told = node_of(m1, m2), set()
            if inside:  # a class is told once a batch
                told = set(np.unique(node, return_index=True)[1].tolist())
            sets = pa.array([np.unique(g).view(np.int64) if k in told else None for k, g in enumerate(grams[hit])], pa.list_(pa.int64()))
            cols = [pa.array(ids_of(b)[of], pa.int64()), pa.array(ids_of(b, "text_id")[of], pa.int64()), pa.array(at[hit].astype(np.int32)), pa.array(m1.view(np.int64)), pa.array(node.view(np.int64)), sets]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text_id", "first_word", "sketch", "node", "grams"])

    return run


#: Sketches that are sent to the tasks (16 MB) to find their paragraphs; more are found by a join.
WANTED = 2_000_000


def found_again(docs: DataFrame, make: tuple, marks: DataFrame, most: int) -> DataFrame:
    """The paragraphs with these sketches (marks: sketch), wherever they are, with what is in them."""
    if marks.count() <= most:
        wanted = np.sort(marks.toArrow().column(0).to_numpy().view(np.uint64))
        return docs.mapInArrow(gram_rows(make, wanted), MET)
    places = docs.mapInArrow(gram_rows(make, inside=False), MET).join(marks, "sketch", "left_semi").groupBy("doc_id", "text_id").agg(F.collect_set("first_word").alias("places"))
    return docs.join(few_bytes(cut(places), 24 + 4 * F.size("places")), ["doc_id", "text_id"]).select("doc_id", "text", "text_id", "places").mapInArrow(gram_rows(make), MET)


def sketches(grams: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Of sets of distinct shingles that begin at start: which of SKETCH bits an odd number of them falls to."""
    bit = np.uint64(1) << ((grams >> np.uint64(40)) * np.uint64(SKETCH) >> np.uint64(24))
    return np.bitwise_xor.reduceat(bit, start)


def colliding(percent: int):
    """A function for mapInArrow: (band, x, y, asks, of, grams) sorted by them -> a spanning forest of each group's links.

    Those that ask are held against all others of their group, but where their sketches differ too much or they
    are connected already.
    """

    def forest_of(group: list[tuple]) -> list[tuple[int, int]]:
        asks, holds = ([x for x in group if x[0] == k] for k in (True, False))
        if not asks or not holds:
            return []
        (sa, na), (sh, nh) = ((np.array([x[2] for x in part], np.uint64), np.array([len(x[3]) for x in part])) for part in (asks, holds))
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := root.get(x, x)) != x:
                root[x] = root.get(y, y)
                x = y
            return x

        out, sets = [], {}
        for k, (_, i, _, g) in enumerate(asks):
            s = frozenset(g.tolist())
            for c in np.flatnonzero((100 + percent) * np.bitwise_count(sa[k] ^ sh).astype(np.int64) <= (100 - percent) * (na[k] + nh)).tolist():
                x, y = find(i), find(holds[c][1])
                if x != y:
                    if c not in sets:
                        sets[c] = frozenset(holds[c][3].tolist())
                    both = len(s & sets[c])
                    if 100 * both >= percent * (na[k] + nh[c] - both):
                        root[max(x, y)] = min(x, y)
                        out.append((i, holds[c][1]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in sliced(batches, 4096):
            links = []
            col = b.column(5)
            grams, start = col.flatten().to_numpy().view(np.uint64), col.offsets.to_numpy() - col.offsets[0].as_py()
            marks = sketches(grams, start[:-1]) if b.num_rows else start[:0]
            for k, (*group, ask, i) in enumerate(zip(*(b.column(j).to_pylist() for j in range(5)), strict=True)):
                if group != at:
                    links += forest_of(held)
                    at, held = group, []
                held.append((ask, i, marks[k], grams[start[k] : start[k + 1]]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])
        links = forest_of(held)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

    return run


def links_of(shared: DataFrame, inside: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among the classes of each band, as many as connect all that is connected. shared: band, of; inside: of, grams."""
    of_band = shared.groupBy("band").agg(F.count("*").alias("n"), F.min("of").alias("lead")).filter("n > 1")
    near = shared.join(of_band, "band").filter("of <> lead")
    pairs = near.select("of", "lead").distinct()
    both = F.size(F.array_intersect("grams", "lead_grams"))
    alike = 100 * both >= percent * (F.size("grams") + F.size("lead_grams") - both)
    told = cut(pairs.join(inside, "of").join(inside.select(F.col("of").alias("lead"), F.col("grams").alias("lead_grams")), "lead").select("of", "lead", alike.alias("alike")))

    # what is unlike its band's first is held against the others of the band, chunk by chunk
    left = cut(near.filter("n > 2").join(told.filter("NOT alike"), ["of", "lead"]).select("band", "of"))
    asked = left.groupBy("band").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("asked"))
    plan = cut(of_band.join(asked, "band").select("band", "lead", "asked", F.ceil(F.col("n") / CHUNK).cast("int").alias("held")))
    mine = F.xxhash64("of")
    asks = left.join(plan, "band").select("band", F.pmod(mine, F.col("asked")).cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.col("held") - 1)).alias("y"), F.lit(True).alias("asks"), "of")
    holds = shared.join(plan, "band").filter("of <> lead").select("band", F.explode(F.sequence(F.lit(0), F.col("asked") - 1)).alias("x"), F.pmod(mine, F.col("held")).cast("int").alias("y"), F.lit(False).alias("asks"), "of")
    dealt = asks.union(holds).join(inside, "of").select("band", "x", "y", "asks", "of", "grams")
    found = dealt.repartition(int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions")), "band", "x", "y").sortWithinPartitions("band", "x", "y").mapInArrow(colliding(percent), "a long, b long")
    return told.filter("alike").select(F.col("of").alias("a"), F.col("lead").alias("b")).union(found).distinct()


def repeated_passages(df: DataFrame, min_words: int = MIN_WORDS, k: int = SHINGLE, percent: int = PERCENT, recall: float = RECALL, bucket_entries: int = BUCKET_ENTRIES, most: int = LARGE, wanted: int = WANTED) -> DataFrame:
    """One row per repeated passage: doc_id, first_word, n_words, cluster_doc_id, kept, text_id.

    A passage is a run of a document's words covered by paragraphs that another document has, too (similar
    by percent or more), and whose clusters begin in the same document, cluster_doc_id; kept: it is this one,
    so the passage stays. Passages of different clusters may overlap; words that a kept one covers stay, whatever
    others say. Words are runs of anything but ASCII white space, A-Z in lower case. Texts
    of fewer than min_words words, empty ones and null ones have no paragraph and no row; repeats within one
    document alone are none. Rows without an id are left out; rows that repeat an id count as one document,
    and text_id (a hash of the text) tells which of its texts a passage is in. Results don't hang on most, the
    classes of a band that one task compares, nor on wanted and bucket_entries.
    """
    docs = docs_of(df).withColumn("text_id", F.xxhash64("text"))
    make = (min_words, k, *tuned(percent / 100, recall))
    words = docs.agg(F.sum(F.length("text")) / 6).head()[0] or 0  # about
    buckets = max(1, int(-(-words * 2 * make[2] // (PLACES * bucket_entries))))
    apart = int(2 * (min_words - k + 1) * (100 - percent) / (100 + percent) + 1e-9)  # shingles in one set alone, of two that reach percent
    told = cut(docs.mapInArrow(fold(make, percent, buckets, apart, most), TYPES).groupBy("bucket").applyInPandas(bucketed(buckets, apart, most), TYPES))

    def pairs_of(kind: str) -> DataFrame:
        return told.filter(F.col("kind") == kind).select("marks", "more").mapInArrow(two_rows, "a long, b long")

    # Classes of several folds that are still to be verified: their paragraphs are found again, with what is in them.
    pairs, large = cut(pairs_of("pairs").distinct()), cut(pairs_of("large").distinct().toDF("sketch", "band"))
    marks = cut(pairs.select(F.col("a").alias("sketch")).union(pairs.select("b")).union(large.select("sketch")).distinct())
    met = cut(found_again(docs, make, marks, wanted))
    inside = cut(met.filter("grams IS NOT NULL").select("sketch", "node", "grams").dropDuplicates(["node"]))
    paras = told.filter("kind = 'paras'").mapInArrow(place_rows, "doc_id long, text_id long, first_word int, node long").union(met.select("doc_id", "text_id", "first_word", "node"))
    classes = cut(paras.groupBy("node").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")))
    x, y = (inside.select(F.col("sketch").alias(k), F.col("node").alias(f"node_{k}"), F.col("grams").alias(f"grams_{k}")) for k in "ab")
    both = F.size(F.array_intersect("grams_a", "grams_b"))
    reach = 100 * both >= percent * (F.size("grams_a") + F.size("grams_b") - both)
    links = pairs_of("links").union(pairs.join(x, "a").join(y, "b").filter(reach).select("node_a", "node_b"))
    if not large.isEmpty():
        shared = cut(large.join(inside.select("sketch", F.col("node").alias("of")), "sketch").select("band", "of").distinct())
        links = links.union(links_of(shared, inside.select(F.col("node").alias("of"), "grams"), percent))
    roots = components(links)

    named_ = classes.join(roots, "node", "left").select("node", "low", "high", F.coalesce("root", "node").alias("root"))
    clusters = named_.groupBy("root").agg(F.min("low").alias("cluster_doc_id"), F.max("high").alias("last")).filter("cluster_doc_id < last").drop("last")
    found = cut(named_.join(clusters, "root").select("node", "cluster_doc_id"))
    hits = paras.join(found, "node").select("doc_id", "text_id", "first_word", "cluster_doc_id")

    before = W.partitionBy("doc_id", "text_id", "cluster_doc_id").orderBy("first_word")
    opens = (F.col("first_word") > F.coalesce(F.lag("first_word").over(before), F.lit(-1 - min_words)) + min_words).cast("int")
    runs = hits.withColumn("opens", opens).withColumn("run", F.sum("opens").over(before.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "text_id", "cluster_doc_id", "run").agg(F.min("first_word").alias("first_word"), (F.max("first_word") + min_words - F.min("first_word")).alias("n_words")).select("doc_id", "first_word", "n_words", "cluster_doc_id", (F.col("doc_id") == F.col("cluster_doc_id")).alias("kept"), "text_id")


def without_passages(df: DataFrame, passages: DataFrame) -> DataFrame:
    """df with the removals of repeated_passages cut out of text, but for words of kept ones; the words left are joined by one space.

    Columns and rows stay as they are otherwise; rows without an id or a removal keep their text as it is.
    """
    run = F.struct("first_word", "n_words")
    runs = [F.collect_set(F.when(kept, run)).alias(c) for kept, c in ((~F.col("kept"), "gone"), (F.col("kept"), "stay"))]
    cuts = passages.groupBy("doc_id", "text_id").agg(*runs).filter(F.size("gone") > 0).select(F.struct("doc_id", "text_id").alias("key"), F.struct("gone", "stay").alias("runs"))
    rows = df.select(F.struct(*[df[c].alias(c) for c in df.columns]).alias("row"))
    at = rows.join(cuts, (F.col("row")["doc_id"].cast("long") == F.col("key.doc_id")) & (F.xxhash64(F.col("row")["text"]) == F.col("key.text_id")), "left")
    text = F.col("row")["text"]
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def covered(runs: Column, i: Column) -> Column:
        return F.exists(runs, lambda r: (i >= r.first_word) & (i < r.first_word + r.n_words))

    left = F.array_join(F.filter(words, lambda w, i: ~covered(F.col("runs.gone"), i) | covered(F.col("runs.stay"), i)), " ")
    return at.select(*[F.when(F.col("key").isNull(), text).otherwise(left).alias(c) if c == "text" else F.col("row")[c].alias(c) for c in df.columns])


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(tables(spark, sf_dir, "documents"))

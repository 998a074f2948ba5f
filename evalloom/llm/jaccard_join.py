"""Joining documents by the Jaccard similarity of their word n-grams, by T-occurrence search (DivideSkip).

Documents with equal sets are one class; only its smallest id is searched. With a threshold t, a partner of
a set of n grams shares at least T = ceil(t n) of them. In any order that all sets use (here: by hash), two
partners share at least l grams within their first n - T + l ones; these alone are indexed, and each gram's
inverted list holds the documents that have it there. A document is dropped when fewer of its grams are in lists
of two or more than the l of its smallest partner (of T grams).

Documents that are left and share entries make up clusters. Within a cluster the search proper runs, chunk by
chunk: a query's longest lists are set aside, its short lists are merged with counts, and each candidate that
can still reach the overlap is probed in the long lists by binary search.

Components need not see every pair of a large group of near copies: documents that are connected within
a task are not probed again, and a task returns a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evalloom.llm.common import bytes_of, cut, docs_of, few, gram_sets, ids_of, mix64, sliced, tables
from evalloom.llm.components import components

#: Documents whose lists are folded within a task before the shuffle, and grams of their sets, unless one slice has more.
FOLD_DOCS, FOLD_GRAMS = 4_096, 4 << 20
#: Entries of inverted lists in one bucket, about.
BUCKET_ENTRIES = 500_000
#: Share of a set that its prefix is longer than it needs to be, in percent.
EXTRA = 20
#: The same for the documents that are left after the first look.
MORE = 50
#: Documents of a cluster that meet in one task, from either side.
CHUNK = 1_024


def needed(n, percent: int):
    """The least overlap that a partner of a set of n has: ceil(percent n / 100)."""
    return -(-percent * n // 100)


def extra(n, share: int):
    return np.maximum(1, -(-share * n // 100))


def at_least(percent: int, share: int) -> Column:
    """Entries that a set of n shares with any partner, of those that a prefix with this share of extra ones has.

    Two prefixes share no more than the smaller set's extra ones; the smallest partner has needed(n) grams.
    """
    return F.greatest(F.lit(1), F.ceil(F.ceil(F.col("n") * percent / 100) * share / 100))


def prefix_size(n: np.ndarray, percent: int, share: int) -> np.ndarray:
    return np.minimum(n, n - needed(n, percent) + extra(n, share))


def full_sets(k: int):
    """A function for mapInArrow: texts -> (doc_id, n, grams)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 256):
            sets = gram_sets(bytes_of(b), k)
            yield pa.RecordBatch.from_arrays([pa.array(ids_of(b)), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["doc_id", "n", "grams"])

    return run


FULL = "doc_id long, n long, grams binary"
#: What travels to a bucket: list entries (docs, runs, grams), or counted hits (docs, runs) and documents (docs, sizes, digests).
PARTS = ["bucket", "kind", "docs", "runs", "grams"]
PART_TYPES = "bucket int, kind string, docs binary, runs binary, grams binary"


def fold(k: int, percent: int, buckets: int):
    """A function for mapInArrow: texts -> parts for the buckets, from a few thousand documents at a time.

    A gram that several of these have is one entry (of document -1), so that a very common gram weighs
    little in its bucket; the hits of its documents are counted here.
    """

    def emit(ids: np.ndarray, sets: list[np.ndarray], turn: int) -> pa.RecordBatch:
        import xxhash

        n = np.array([len(x) for x in sets], np.int64)
        rows = [(turn % buckets, "docs", ids.tobytes(), n.tobytes(), b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in sets))]
        most = prefix_size(n, percent, EXTRA)
        grams = np.concatenate([x[:m] for x, m in zip(sets, most.tolist(), strict=True)])
        docs = np.repeat(ids, most)
        order = np.argsort(grams, kind="stable")
        g, d = grams[order], docs[order]
        first = np.r_[True, g[1:] != g[:-1]][: len(g)]
        many = ~first
        many[:-1] |= many[1:].copy()
        if many.any():
            u, c = np.unique(d[many], return_counts=True)
            rows.append((turn % buckets, "hits", u.tobytes(), c.astype(np.int64).tobytes(), b""))
        keep = first
        g, d = g[keep], np.where(many[keep], -1, d[keep])
        bucket = ((g >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        order = np.lexsort((d, bucket))
        g, d, bucket = g[order], d[order], bucket[order]
        new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (bucket[1:] != bucket[:-1])][: len(d)])
        runs = np.diff(np.r_[new, len(d)]).astype(np.uint16 if len(d) < 1 << 16 else np.uint32)
        runs = runs.astype(np.uint32)
        cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
        heads = np.searchsorted(new, cuts)
        for i in np.flatnonzero(np.diff(cuts)):
            rows.append((int(i), "entries", d[new[heads[i] : heads[i + 1]]].tobytes(), runs[heads[i] : heads[i + 1]].tobytes(), g[cuts[i] : cuts[i + 1]].tobytes()))
        kinds = (pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)], names=PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sets, held, grams, turn = [], [], 0, 0, 0
        for b in sliced(batches):
            new = gram_sets(bytes_of(b), k)
            ids.append(ids_of(b))
            sets += new
            held += b.num_rows
            grams += sum(map(len, new))
            if held >= FOLD_DOCS or grams >= FOLD_GRAMS:
                turn += 1 + int(ids[0][0]) % 7919
                yield emit(np.concatenate(ids), sets, turn)
                ids, sets, held, grams = [], [], 0, 0
        if held:
            yield emit(np.concatenate(ids), sets, turn + 1 + int(ids[0][0]) % 7919)

    return run


COUNTED = "part int, kind string, docs binary, numbers binary, digests binary"


def bucket_hits(buckets: int):
    """A function for applyInPandas: a bucket -> how many grams documents share with others, by part of the documents.

    What documents have in all buckets meets in their part; packed, so that rows don't grow with the buckets.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [(i % buckets, "docs", d, n, g) for i, (k, d, n, g) in enumerate(zip(pdf["kind"], pdf["docs"], pdf["runs"], pdf["grams"], strict=True), int(pdf["bucket"].iloc[0])) if k == "docs"]
        told = [(np.frombuffer(d, np.int64), np.frombuffer(n, np.int64)) for k, d, n in zip(pdf["kind"], pdf["docs"], pdf["runs"], strict=True) if k == "hits"]
        p = pdf[pdf["kind"] == "entries"]
        if len(p):
            g = np.frombuffer(b"".join(p["grams"]), np.uint64)
            d = np.repeat(np.frombuffer(b"".join(p["docs"]), np.int64), np.frombuffer(b"".join(p["runs"]), np.uint32))
            order = np.argsort(g, kind="stable")
            g, d = g[order], d[order]
            many = np.r_[False, g[1:] == g[:-1]]
            many[:-1] |= many[1:].copy()
            hit = d[many & (d >= 0)]
            told.append((hit, np.ones(len(hit), np.int64)))
        if told:
            u, c = summed(told)
            part = (mix64(u.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            u, c, part = u[order], c[order], part[order]
            cuts = np.searchsorted(part, np.arange(buckets + 1))
            out += [(int(i), "hits", u[cuts[i] : cuts[i + 1]].tobytes(), c[cuts[i] : cuts[i + 1]].tobytes(), b"") for i in np.flatnonzero(np.diff(cuts))]
        return pd.DataFrame(out, columns=["part", "kind", "docs", "numbers", "digests"])

    return run


def summed(told: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    u, at = np.unique(np.concatenate([x for x, _ in told]), return_inverse=True)
    return u, np.bincount(at, weights=np.concatenate([y for _, y in told]), minlength=len(u)).astype(np.int64)


def part_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    """(doc_id, n, digest, hits): documents with size and digest, and (n = -1) the hits of documents, a row each."""
    p, h = pdf[pdf["kind"] == "docs"], pdf[pdf["kind"] == "hits"]
    digests = b"".join(p["digests"])
    ids, n = (np.frombuffer(b"".join(p[c]), np.int64) for c in ("docs", "numbers"))
    u, c = summed([(np.frombuffer(d, np.int64), np.frombuffer(x, np.int64)) for d, x in zip(h["docs"], h["numbers"], strict=True)]) if len(h) else (ids[:0], ids[:0])
    marks = [digests[i : i + 16] for i in range(0, len(digests), 16)] + [b""] * len(u)
    return pd.DataFrame({"doc_id": np.r_[ids, u], "n": np.r_[n, np.full(len(u), -1)], "digest": pd.Series(marks, dtype=object), "hits": np.r_[np.zeros(len(ids), np.int64), c]})


def _exploded(percent: int):
    """A function for mapInArrow: full sets -> (gram, doc_id, n), a row for each entry of the prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 256):
            n = ids_of(b, "n").astype(np.int64)
            most = prefix_size(n, percent, MORE)
            grams = np.concatenate([np.frombuffer(x, np.int64, m) for x, m in zip(b.column(2).to_pylist(), most.tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(np.repeat(ids_of(b), most)), pa.array(np.repeat(n, most))], names=["gram", "doc_id", "n"])

    return run


def block(percent: int, aside: bool):
    """A function for applyInPandas: two chunks of a cluster (side 0 and 1) -> a spanning forest of their links.

    T-occurrence search on the chunk's inverted lists: of a query's lists the longest are set aside, as many
    as it may share without reaching the overlap; the short ones are merged, and the candidates that reach
    what is left of the overlap are probed in the long ones by binary search. Documents that are connected
    already are not probed again.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        same = right.empty  # a chunk with itself comes once
        right = left if same else right
        sets = [np.frombuffer(x, np.uint64) for x in right["grams"]]
        ids, sizes = right["doc_id"].to_numpy(), np.array([len(x) for x in sets])
        grams = np.concatenate(sets)
        order = np.argsort(grams, kind="stable")
        lists, start = np.unique(grams[order], return_index=True)
        holders = np.repeat(np.arange(len(sets)), sizes)[order]
        length = np.diff(np.r_[start, len(grams)])
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := root.get(x, x)) != x:
                root[x] = root.get(y, y)
                x = y
            return x

        a, b = [], []
        for k, (me, blob) in enumerate(zip(left["doc_id"].tolist(), left["grams"], strict=True)):
            mine = np.frombuffer(blob, np.uint64)
            n = len(mine)
            at = np.searchsorted(lists, mine)
            at = at[(at < len(lists)) & (lists[np.minimum(at, len(lists) - 1)] == mine)]
            least = needed(n, percent)
            if len(at) < least:
                continue
            at = at[np.argsort(length[at], kind="stable")]
            longest = min(least - 1, int(least / (0.5 * np.log2(1 + length[at[-1]]) + 1))) if aside else 0  # the longer they are, the fewer
            short, rest = at[: len(at) - longest], np.sort(at[len(at) - longest :])
            merged = np.concatenate([holders[start[i] : start[i] + length[i]] for i in short])
            count = np.bincount(merged, minlength=len(sets))
            # |both| >= percent (n + m) / (100 + percent); at most the long lists and the rest of each set are missing
            wanted = -(-percent * (n + sizes) // (100 + percent))
            for c in np.flatnonzero((count >= wanted - longest) & (count > 0)).tolist():
                if (same and c <= k) or ids[c] == me or find(me) == find(int(ids[c])):
                    continue
                both = int(count[c])
                if longest:
                    probes = lists[rest]
                    found = np.searchsorted(sets[c], probes)
                    both += int((sets[c][np.minimum(found, sizes[c] - 1)] == probes).sum())
                if 100 * both >= percent * (n + int(sizes[c]) - both):
                    x, y = find(me), find(int(ids[c]))
                    root[max(x, y)] = min(x, y)
                    a.append(me)
                    b.append(int(ids[c]))
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return run


def jaccard_join(df: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """One row per row of df: doc_id, n_shingles, component_id.

    Words are runs of anything but ASCII white space, with A-Z in lower case. A set has the distinct runs of
    k words, or the whole text where it has fewer; a null or wordless text has none and links with nothing.
    Rows link when 100 |both| >= percent |either|. Rows without an id are left out; rows that repeat an
    id are one node. An empty table gives an empty result.
    """
    docs = docs_of(df)
    words = (docs.agg(F.sum(F.length("text"))).head()[0] or 0) / 6  # about
    buckets = max(1, int(-(-words * (100 - percent + EXTRA) // (100 * BUCKET_ENTRIES))))
    parts = docs.mapInArrow(fold(k, percent, buckets), PART_TYPES)
    told = cut(parts.groupBy("bucket").applyInPandas(bucket_hits(buckets), COUNTED).groupBy("part").applyInPandas(part_rows, "doc_id long, n long, digest binary, hits long"))
    sets = told.filter("n >= 0").select("doc_id", "n", "digest")

    # One of each class, with enough grams in lists of two or more.
    classes = sets.filter("n > 0").groupBy("digest", "n").agg(F.min("doc_id").alias("rep"))
    hits = told.filter("n < 0").groupBy(F.col("doc_id").alias("rep")).agg(F.sum("hits").alias("hits"))
    likely = classes.join(hits, "rep").filter(F.col("hits") >= at_least(percent, EXTRA))
    found = few(cut(likely.select(F.col("rep").alias("doc_id")).distinct()))

    full = cut(docs.join(found, "doc_id", "left_semi").mapInArrow(full_sets(k), FULL))
    links = links_between(full.mapInArrow(_exploded(percent), "gram long, doc_id long, n long"), full, percent, at_least(percent, MORE))

    # Rows of equal sets link; so do rows that repeat an id.
    same = sets.filter("n > 0").join(classes, ["digest", "n"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).filter("a <> b").distinct()
    joined = components(links.union(same))
    return sets.select("doc_id", F.col("n").alias("n_shingles")).join(joined, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def links_between(search: DataFrame, full: DataFrame, percent: int, least: Column | None = None) -> DataFrame:
    """Links (a, b) that connect all that is connected, from entries (gram, doc_id, n) and the full sets (doc_id, n, grams).

    Partners share least(n) entries or more (one, by default). Documents that share an entry, directly or
    through others, form a cluster, found by one edge for each entry. A cluster is cut into chunks by
    size, and each two chunks whose sizes may link are one small task: no pair is ever a row.
    """
    lists, own = W.partitionBy("gram"), W.partitionBy("doc_id", "n")
    index = search.withColumns({"df": F.count("*").over(lists)}).filter("df > 1").drop("df")
    if least is not None:  # too few shared entries for any partner: these go, and what they shared is counted anew
        index = index.withColumn("have", F.count("*").over(own)).filter(F.col("have") >= least).drop("have")
    edges = index.withColumn("first", F.min("doc_id").over(lists)).filter("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b")).distinct()
    roots = components(edges)
    clusters = cut(roots.union(roots.select("root", "root").distinct()).toDF("doc_id", "cluster"))
    sized = full.join(few(clusters), "doc_id").select("cluster", "doc_id", "n", "grams")
    # places by size within a cluster, from narrow rows; then chunks and the partners that they may have
    placed = full.select("doc_id", "n").join(few(clusters), "doc_id").withColumn("chunk", F.floor((F.row_number().over(W.partitionBy("cluster").orderBy("n", "doc_id")) - 1) / CHUNK).cast("int"))
    chunks = cut(placed.groupBy("cluster", "chunk").agg(F.min("n").alias("low"), F.max("n").alias("high")))
    x, y = chunks.alias("x"), chunks.alias("y")
    pairs = cut(x.join(y, "cluster").filter(f"x.chunk <= y.chunk and 100 * x.high >= {percent} * y.low").select("cluster", F.col("x.chunk").alias("i"), F.col("y.chunk").alias("j")))
    sides = pairs.select("cluster", "i", "j", F.lit(0).alias("side"), F.col("i").alias("chunk")).union(pairs.filter("i < j").select("cluster", "i", "j", F.lit(1), "j"))
    dealt = sized.join(placed.select("doc_id", "chunk"), "doc_id").join(few(sides), ["cluster", "chunk"]).select("cluster", "i", "j", "side", "doc_id", "grams")
    return cut(dealt.groupBy("cluster", "i", "j").applyInPandas(block(percent, least is not None), "a long, b long"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(tables(spark, sf_dir, "documents"))

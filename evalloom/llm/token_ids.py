"""Token ids of documents, and their file format.

Ids come from the tokenizers library. Where a vocabulary's pre-tokenizer never joins pieces across ASCII white
space, a word's ids don't depend on its neighbours: each worker encodes a word once and keeps its ids (a
bounded cache), which is what makes whole corpora affordable. Texts of other vocabularies are encoded whole.

Format: a dataset of shards, one row per shard, with the columns range, shard (ascending doc_id order is
that of the pair), dict_hash (SHA-256 of the shared zstandard dictionary), width (bytes of an id: 2, or 4
where the vocabulary needs them), n_ids, first (ids of the range before this shard), doc_ids (int64 each),
n_tokens (int64 each), offsets (int64, one more than documents), payload. Document k of a shard is the
zstandard frame payload[offsets[k]:offsets[k + 1]], compressed by itself with the shared dictionary; it holds
the ids as little-endian unsigned integers of that width. The dictionary lies beside the shards, in the folder
dict. A short document is thus read without touching its neighbours.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm.common import bytes_of, docs_of, ids_of, sample_of, shared_path, sliced, tables

END_ID = 1
#: Documents whose ids train the dictionary, at most, and the characters of each that are used, from anywhere in it.
TRAIN_DOCS, TRAIN_CHARACTERS = 1_000, 8_000
DICT_BYTES = 64_000
#: Documents of a shard, at most, and bytes of their frames, unless one document has more.
SHARD_DOCS, SHARD_BYTES = 4_000, 64 << 20
#: Shards of a range of doc_id, about; a range is written by one task. Beyond so many ranges each has more shards.
RANGE_SHARDS, MOST_RANGES = 4, 1 << 20
CACHED_WORDS = 300_000


def public_vocabulary() -> str:
    """The vocabulary that the queries use, installed on each node."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Steps of vocabularies that may be encoded a word at a time: white space and case are dropped, and pieces are runs of one Unicode class.
WORD_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None,
}


#: Letters of ASCII and Latin-1, whose case, normal form and class are told without the library's chain, and marks of ASCII after them:
#: two pieces for the pre-tokenizer. Words come with A-Z in lower case.
PLAIN = re.compile(r"([a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-/:-@\[-`{-~]*)")
#: The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LEVEL = dict(zip([b for b in range(256) if b not in _SHOWN], map(chr, range(256, 512)), strict=False))


class WordEncoder:
    """Ids of texts as the tokenizers library gives them: a word at a time if the vocabulary's steps are WORD_STEPS, else whole.

    The tests hold it against the library's own encoding of whole texts. Texts come as UTF-8 bytes; each ends
    with end_id. A word that ends in marks is looked up without them; words of ASCII and Latin-1 letters go straight
    to the library's BPE model, others through its whole chain, many joined by a mark of their own.
    """

    MARK = "\x01"

    def __init__(self, path: str, end_id: int = END_ID, most: int = CACHED_WORDS) -> None:
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        self._model = self._tok.model
        self._dtype = np.dtype("<u2" if self._tok.get_vocab_size() <= 1 << 16 else "<u4")
        self._end, self._most, self._of = np.array([end_id], self._dtype).tobytes(), most, {}
        steps = json.loads(self._tok.to_str())
        self.by_word = all(steps.get(k) == v for k, v in WORD_STEPS.items()) and steps["model"]["type"] == "BPE"
        if not self.by_word:
            return
        (self._mark,) = self._ids(self.MARK)
        self._ends, self._tails = {m.encode(): self._packed(self._ids(m)) for m in ".,"}, {}

    @property
    def dtype(self) -> np.dtype:
        return self._dtype

    def _ids(self, text: str) -> list[int]:
        return self._tok.encode(text, add_special_tokens=False).ids

    def _packed(self, ids: list[int]) -> bytes:
        return np.array(ids, self._dtype).tobytes()

    def _learn(self, new: set[bytes]) -> None:
        known, ends, tails = self._of, self._ends, self._tails
        cores, letters, chain, tailed = {}, set(), set(), []
        for w in new:
            text = w.decode()
            if m := PLAIN.fullmatch(text):
                core, tail = m.groups()
                letters.add(core)
                if tail:
                    tailed.append((w, core.encode(), tail))
            elif w[-1:] in ends and text[:-1].lower().isalpha():
                cores[w] = w[:-1]
                if w[:-1] not in known:
                    chain.add(text[:-1])
            else:
                chain.add(text)
        tokenize = self._model.tokenize
        for core in letters:
            if (key := core.encode()) not in known:
                known[key] = self._packed([t.id for t in tokenize(core if core.isascii() else core.lower().encode().decode("latin-1").translate(BYTE_LEVEL))])
        for w, core, tail in tailed:
            if tail not in tails:
                tails[tail] = self._packed(self._ids(tail))
            known[w] = known[core] + tails[tail]
        plain = [w for w in chain if self.MARK not in w]
        for w in chain:
            if self.MARK in w:
                known[w.encode()] = self._packed(self._ids(w))
        parts = [plain[i : i + 64] for i in range(0, len(plain), 64)]
        glue = f" {self.MARK} "
        for part, e in zip(parts, self._tok.encode_batch_fast([glue.join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self._dtype)
            cuts = np.flatnonzero(ids == self._mark).tolist()
            for w, lo, hi in zip(part, [-1, *cuts], [*cuts, len(ids)], strict=True):
                known[w.encode()] = ids[lo + 1 : hi].tobytes()
        for w, core in cores.items():
            known[w] = known[core] + ends[w[-1:]]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, serialized."""
        if not self.by_word:
            return [self._packed(e.ids) + self._end for e in self._tok.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        words = [t.lower().split() for t in texts]  # of bytes: ASCII letters, ASCII white space
        if len(self._of) > self._most:
            self._of.clear()
            self._tails.clear()
        self._learn(set().union(*words) - self._of.keys())
        get = self._of.__getitem__
        return [b"".join(map(get, ws)) + self._end for ws in words]


def encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[np.ndarray, list[bytes], np.dtype]]:
    """Doc ids and serialized ids of a few hundred documents at a time."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    enc = WordEncoder(path)
    for b in sliced(batches):
        yield ids_of(b).astype(np.int64), enc.encode(bytes_of(b)), enc.dtype


def train_dictionary(df: DataFrame, path: str, size: int = DICT_BYTES, most: int = TRAIN_DOCS) -> bytes:
    """A zstandard dictionary trained on the id arrays of at most `most` documents (those of smallest hash).

    Too few samples to train on give a dictionary of raw content.
    """
    import zstandard

    spare = F.greatest(F.lit(1), F.length("text") - TRAIN_CHARACTERS)
    rows = sample_of(df, most).select(F.substring("text", 1 + F.pmod(F.xxhash64("doc_id"), spare).cast("int"), F.lit(TRAIN_CHARACTERS)).alias("text")).limit(2 * most).collect()
    enc = WordEncoder(path)
    samples = enc.encode([r.text.encode() for r in rows])
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:size] or b"\0" * 8


def _dictionary(raw: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(raw)


def write_token_shards(df: DataFrame, out: str, path: str, level: int = 3, shard_docs: int = SHARD_DOCS, shard_bytes: int = SHARD_BYTES) -> None:
    """Write the documents' ids to the folder out, in the format above.

    A document is encoded and compressed in the task that reads it; only its frame moves. Shards follow
    ranges of doc_id that are equally full, so a gap or a cluster of ids doesn't matter. Rows that repeat
    an id lie side by side. An empty table writes no shard.
    """
    spark = df.sparkSession
    docs = docs_of(df)
    raw = train_dictionary(docs, path)
    mark = hashlib.sha256(raw).hexdigest()
    spark.createDataFrame([(mark, bytearray(raw))], "dict_hash string, content binary").write.mode("overwrite").parquet(f"{out}/dict")
    ranges = min(MOST_RANGES, max(1, -(-docs.count() // (RANGE_SHARDS * shard_docs))))
    cuts = [] if ranges == 1 else docs.select("doc_id").approxQuantile("doc_id", [k / ranges for k in range(1, ranges)], 0.25 / ranges)
    bounds, width = np.unique(np.array(cuts, np.int64)), WordEncoder(path).dtype.itemsize

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(raw))
        for ids, blobs, kind in encoded(batches, path):
            cols = [pa.array(np.searchsorted(bounds, ids, "left").astype(np.int32)), pa.array(ids), pa.array([len(x) // kind.itemsize for x in blobs], pa.int64()), pa.array([z.compress(x) for x in blobs], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["range", "doc_id", "n_tokens", "frame"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted frames -> shards; a shard is closed when it is full or the next range begins."""
        at, shard, first, size, ids, counts, frames = None, 0, 0, 0, [], [], []

        def closed() -> pa.RecordBatch:
            offsets = np.r_[0, np.cumsum([len(x) for x in frames])].astype("<i8")
            row = {"range": at, "shard": shard, "dict_hash": mark, "width": width, "n_ids": sum(counts), "first": first, "doc_ids": np.array(ids, "<i8").tobytes(), "n_tokens": np.array(counts, "<i8").tobytes(), "offsets": offsets.tobytes(), "payload": b"".join(frames)}
            return pa.RecordBatch.from_pylist([row], pa.schema(SHARD_FIELDS))

        for b in batches:
            for r, i, c, f in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if ids and (r != at or len(ids) == shard_docs or size + len(f) > shard_bytes):
                    yield closed()
                    shard, first = (shard + 1, first + sum(counts)) if r == at else (0, 0)
                    size, ids, counts, frames = 0, [], [], []
                at = r
                size += len(f)
                ids.append(i)
                counts.append(c)
                frames.append(f)
        if ids:
            yield closed()

    frames = docs.mapInArrow(compress, "range int, doc_id long, n_tokens long, frame binary")
    dealt = frames.repartitionById(ranges, "range").sortWithinPartitions("range", "doc_id", "n_tokens", F.xxhash64("frame"))
    dealt.mapInArrow(build, "range int, shard int, dict_hash string, width int, n_ids long, first long, doc_ids binary, n_tokens binary, offsets binary, payload binary").write.mode("overwrite").parquet(f"{out}/shards")


SHARD_FIELDS = [("range", pa.int32()), ("shard", pa.int32()), ("dict_hash", pa.string()), ("width", pa.int32()), ("n_ids", pa.int64()), ("first", pa.int64()), *((k, pa.binary()) for k in ("doc_ids", "n_tokens", "offsets", "payload"))]


class TokenReader:
    """Documents of a shard, one at a time."""

    def __init__(self, dictionary: bytes) -> None:
        import zstandard

        self.dict_hash = hashlib.sha256(dictionary).hexdigest()
        self._z = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def read(self, shard: dict, k: int) -> np.ndarray:
        """The ids of document k of a shard; another dictionary than the shard's own is refused."""
        if shard["dict_hash"] != self.dict_hash:
            raise ValueError("the shard was written with another dictionary")
        lo, hi = np.frombuffer(shard["offsets"], "<i8", 2, 8 * k)
        return np.frombuffer(self._z.decompress(shard["payload"][lo:hi]), f"<u{shard['width']}")


def read_token_shards(spark: SparkSession, out: str, with_ids: bool = False) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids.

    start counts the ids of all documents before it. The sums of the ranges (a million at most) are added up on
    the driver.
    """
    raw = bytes(spark.read.parquet(f"{out}/dict").head().content)
    shards = spark.read.parquet(f"{out}/shards")
    sums = shards.groupBy("range").agg(F.sum("n_ids").alias("total")).orderBy("range").collect()
    before = dict(zip([r["range"] for r in sums], np.r_[0, np.cumsum([r["total"] for r in sums])].tolist(), strict=False))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = TokenReader(raw)
        for b in batches:
            for row in range(b.num_rows):
                shard = {f: b.column(i)[row].as_py() for i, f in enumerate(b.schema.names)}
                ids = np.frombuffer(shard["doc_ids"], "<i8")
                counts = np.frombuffer(shard["n_tokens"], "<i8")
                starts = before[shard["range"]] + shard["first"] + np.r_[0, np.cumsum(counts)[:-1]]
                for lo in range(0, len(ids), 256):
                    part = [reader.read(shard, k) for k in range(lo, min(len(ids), lo + 256))]
                    at = slice(lo, lo + len(part))
                    if [len(x) for x in part] != counts[at].tolist():
                        raise ValueError(f"range {shard['range']}, shard {shard['shard']}: a document's length differs from the index")
                    cols = [pa.array(ids[at]), pa.array(starts[at].astype(np.int64)), pa.array(counts[at]), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in part], pa.int64())]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        cols, names = [*cols, pa.array([x.astype(np.int32) for x in part], pa.list_(pa.int32()))], [*names, "ids"]
                    yield pa.RecordBatch.from_arrays(cols, names=names)

    return shards.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_path(spark, "op4-tokens")
    write_token_shards(tables(spark, sf_dir, "documents"), out, public_vocabulary())
    return read_token_shards(spark, out)

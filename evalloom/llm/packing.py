"""Packing examples into sequences under several limits at once, by vector bin packing.

An example has tokens, some of which bear loss; a piece of it has tokens, loss-bearing tokens and counts
as one segment. A sequence holds at most max_tokens, max_segments and max_loss. Pieces are placed by the
dot-product heuristic: of the open pieces that fit into the sequence's remaining capacity, the one whose
demand (each dimension over its limit) has the greatest dot product with that capacity goes next. Where
none fits whole, the best one is cut to fill it. A sequence that can't be filled (the segments run out,
or the task's input ends) is cut along its pieces into lengths that are powers of two, which need no
padding.

Each task packs what it reads, so nothing is shuffled and no group can grow in one place; a task carries
over a bounded set of open pieces and leaves at most one short tail of a sequence.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm.common import docs_of, sliced, tables
from evalloom.llm.token_ids import WordEncoder, encoded, public_vocabulary

#: Of each sequence of the query.
MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS = 2048, 64, 2048
#: Pieces that wait to be placed, at most; then sequences are filled from them.
OPEN_PIECES = 1024
#: Piece sizes are grouped by this many tokens; the heuristic looks at one piece of each group.
GROUP = 32


class Packer:
    """Places pieces (example, start, length, loss) into sequences; hands out finished sequences."""

    def __init__(self, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS, open_pieces: int = OPEN_PIECES) -> None:
        if max_tokens < 1 or max_segments < 1 or max_loss < 1:
            raise ValueError("limits must be positive")
        self._limits = np.array([max_tokens, max_segments, max_loss], float)
        self._max, self._segments, self._loss = max_tokens, max_segments, max_loss
        self._open: dict[tuple[int, int], list] = defaultdict(list)  # by size and loss, in groups
        self._n, self._most = 0, open_pieces

    def add(self, example: int, loss: np.ndarray) -> Iterator[list[tuple[int, int, int]]]:
        """An example with a flag for each token: does it bear loss? Yields sequences as they fill up."""
        before = np.r_[0, np.cumsum(loss)]
        start, n = 0, len(loss)
        while n - start >= self._max and before[start + self._max] - before[start] <= self._loss:
            yield [(example, start, self._max)]
            start += self._max
        while start < n:
            end = min(n, start + self._max, int(np.searchsorted(before, before[start] + self._loss, "right")) - 1)
            end = max(end, start + 1)
            self._put((example, start, end - start, before))
            start = end
        while self._n > self._most:
            yield from self._sequence()

    def finish(self) -> Iterator[list[tuple[int, int, int]]]:
        while self._n:
            yield from self._sequence()

    def _put(self, piece: tuple) -> None:
        ex, start, n, before = piece
        self._open[n // GROUP, int(before[start + n] - before[start]) // GROUP].append(piece)
        self._n += 1

    def _take(self, free: np.ndarray) -> tuple[tuple | None, bool]:
        """The best piece that fits whole; else the best to cut. It leaves the open ones."""
        weight = free / self._limits**2
        fits, cut, best, best_cut = None, None, -1.0, -1.0
        for key, pieces in self._open.items():
            ex, start, n, before = pieces[-1]
            loss = before[start + n] - before[start]
            score = n * weight[0] + weight[1] + loss * weight[2]
            if n <= free[0] and loss <= free[2]:
                if score > best:
                    fits, best = key, score
            elif score > best_cut:
                cut, best_cut = key, score
        key = fits if fits is not None else cut
        if key is None:
            return None, True
        piece = self._open[key].pop()
        if not self._open[key]:
            del self._open[key]
        self._n -= 1
        return piece, fits is not None

    def _sequence(self) -> Iterator[list[tuple[int, int, int]]]:
        free, out = self._limits.copy(), []
        while free[0] > 0 and free[1] > 0 and self._n:
            piece, whole = self._take(free)
            ex, start, n, before = piece
            if not whole:
                most = int(np.searchsorted(before, before[start] + free[2], "right")) - 1 - start
                part = int(min(n, free[0], most))
                if part <= 0:
                    self._put(piece)
                    break
                self._put((ex, start + part, n - part, before))
                n = part
            out.append((ex, start, n))
            free -= (n, 1, before[start + n] - before[start])
        if out:
            yield from in_powers(out, self._max)


class WholePacker:
    """As Packer, but an example that fits a sequence is never cut, and sequences are padded instead.

    Only what no sequence can hold is cut, into pieces as large as the limits let them be. A sequence takes,
    of the pieces that fit whole, the one whose demands go best with what is free (the dot product of both, as
    shares of the limits, and each limit weighed by what all waiting pieces ask of it), until none fits.
    """

    def __init__(self, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS, open_pieces: int = OPEN_PIECES) -> None:
        if max_tokens < 1 or max_segments < 1 or max_loss < 1:
            raise ValueError("limits must be positive")
        self._limits, self._most = np.array([max_tokens, max_segments, max_loss]), open_pieces
        self._pieces: list[tuple[int, int, int]] = []
        self._needs: list[tuple[int, int, int]] = []

    def add(self, example: int, loss: np.ndarray) -> Iterator[list[tuple[int, int, int]]]:
        before, start = np.r_[0, np.cumsum(loss)], 0
        while start < len(loss):
            end = min(len(loss), start + self._limits[0], np.searchsorted(before, before[start] + self._limits[2], "right") - 1)
            self._pieces.append((example, start, int(end) - start))
            self._needs.append((int(end) - start, 1, int(before[end] - before[start])))
            start = int(end)
        while len(self._pieces) > self._most:
            yield self._sequence()

    def finish(self) -> Iterator[list[tuple[int, int, int]]]:
        while self._pieces:
            yield self._sequence()

    def _sequence(self) -> list[tuple[int, int, int]]:
        needs = np.array(self._needs)
        shares = needs / self._limits
        asked, free, waits, out = shares.sum(0), self._limits.copy(), np.ones(len(needs), bool), []
        while (fits := waits & (needs <= free).all(1)).any():
            i = int(np.argmax(np.where(fits, shares @ (asked * free / self._limits), -1)))  # of equals the oldest
            out.append(self._pieces[i])
            waits[i] = False
            free -= needs[i]
        left = np.flatnonzero(waits)
        self._pieces, self._needs = [self._pieces[i] for i in left], [self._needs[i] for i in left]
        return out


def in_powers(pieces: list[tuple[int, int, int]], full: int) -> Iterator[list[tuple[int, int, int]]]:
    """A sequence as it is if full; else cut into sequences whose lengths are powers of two."""
    left = sum(n for _, _, n in pieces)
    if left == full:
        yield pieces
        return
    queue = pieces[::-1]
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        part = []
        while room:
            ex, start, n = queue.pop()
            if n > room:
                queue.append((ex, start + room, n - room))
                n = room
            part.append((ex, start, n))
            room -= n
        yield part


def all_but_first(ids: np.ndarray) -> np.ndarray:
    """Loss flags of plain text: nothing predicts a document's first token, all others bear loss."""
    out = np.ones(len(ids), bool)
    out[:1] = False
    return out


Example = tuple[int, np.ndarray, np.ndarray]  # id, token ids, loss flags


def _packed(examples: Callable[[Iterator[pa.RecordBatch]], Iterator[list[Example]]], limits: tuple[int, int, int], with_ids: bool, packer_of: type[Packer] | type[WholePacker] = Packer):
    """A function for mapInArrow: what examples() reads from the batches, packed; rows as pack() tells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = packer_of(*limits)
        sequence = TaskContext.get().partitionId() << 33
        held: dict[int, list] = {}  # example -> doc_id, ids, loss flags, tokens not yet placed
        rows: list[tuple] = []

        def placed(sequences: Iterator[list[tuple[int, int, int]]]) -> None:
            nonlocal sequence
            for pieces in sequences:
                offset = 0
                for ex, start, n in pieces:
                    doc_id, ids, loss, _ = held[ex]
                    part = ids[start : start + n]
                    rows.append((doc_id, start, n, zlib.crc32(part.astype("<u4").tobytes()), len(ids), sequence, offset, int(loss[start : start + n].sum()), part.astype(np.int32) if with_ids else None))
                    offset += n
                    held[ex][3] -= n
                    if not held[ex][3]:
                        del held[ex]
                sequence += 1

        def batch() -> pa.RecordBatch:
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss"]
            cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(8)]
            if with_ids:
                names, cols = [*names, "ids"], [*cols, pa.array([r[8] for r in rows], pa.list_(pa.int32()))]
            rows.clear()
            return pa.RecordBatch.from_arrays(cols, names=names)

        ex = 0
        for some in examples(batches):
            for doc_id, ids, loss in some:
                held[ex] = [doc_id, ids, loss, len(ids)]
                placed(packer.add(ex, loss))
                ex += 1
            yield batch()
        placed(packer.finish())
        yield batch()

    return run


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss long"


def pack(df: DataFrame, path: str, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS, loss_of: Callable[[np.ndarray], np.ndarray] = all_but_first, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss (, ids).

    A null text is empty: its one piece is the end id. Rows without an id are left out; rows that repeat
    an id are examples of their own. An empty table gives no piece. loss_of: flags of an example's
    ids. sequence_id: the task's number times 2^33, plus a count.
    """

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[list[Example]]:
        for doc_ids, blobs, kind in encoded(batches, path):
            yield [(i, ids, loss_of(ids)) for i, ids in zip(doc_ids.tolist(), (np.frombuffer(x, kind) for x in blobs), strict=True)]

    return docs_of(df).mapInArrow(_packed(examples, (max_tokens, max_segments, max_loss), with_ids), PIECES + ", ids array<int>" * with_ids)


#: Limits of the query over conversations; the tokens that an assistant says bear loss.
CHAT_SEGMENTS, CHAT_LOSS = 16, 1024


def pack_conversations(df: DataFrame, path: str, max_tokens: int = MAX_TOKENS, max_segments: int = CHAT_SEGMENTS, max_loss: int = CHAT_LOSS, speaks: str = "assistant", with_ids: bool = False) -> DataFrame:
    """Instruction data: an example is a conversation (conv_id, turn, role, text), its turns one after another; rows as from pack.

    The tokens of turns whose role is `speaks`, and the end id after such a turn, bear loss. A null text is
    empty, a null role bears none; turns of equal number come by role and text. Rows without an id are left out.

    A conversation that fits a sequence is never cut; sequences that aren't full are padded (padding(pieces, powers=False)).
    """
    said = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = df.filter("conv_id IS NOT NULL").groupBy(F.col("conv_id").cast("long").alias("doc_id")).agg(F.array_sort(F.collect_list(said)).alias("t"))
    parts = turns.select("doc_id", F.transform("t", lambda t: t["role"] == speaks).alias("speaks"), F.transform("t", lambda t: t["text"]).alias("texts"))

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[list[Example]]:
        enc = WordEncoder(path)
        for b in sliced(batches, 64):
            out = []
            columns = [b.column(k).to_pylist() for k in range(3)]
            # all turns of a slice at once: a call to the library for each conversation costs more than its words
            ids = iter(enc.encode([t.encode() for texts in columns[2] for t in texts]))
            for i, flags, texts in zip(*columns, strict=True):
                each = [np.frombuffer(x, enc.dtype) for x in islice(ids, len(texts))]
                each = [x[:-1] for x in each[:-1]] + each[-1:]  # one end id, after the last turn
                out.append((i, np.concatenate(each), np.repeat(np.array(flags, bool), [len(x) for x in each])))
            yield out

    return parts.mapInArrow(_packed(examples, (max_tokens, max_segments, max_loss), with_ids, WholePacker), PIECES + ", ids array<int>" * with_ids)


def padding(pieces: DataFrame, max_tokens: int = MAX_TOKENS, powers: bool = True) -> DataFrame:
    """Of packed pieces: sequences, tokens and padding tokens. powers: a sequence that is a power of two long has none."""
    size = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    whole = F.lit(powers) & F.expr("bit_count(n) = 1")
    return size.agg(F.count("*").alias("sequences"), F.sum("n").alias("tokens"), F.sum(F.when(whole, 0).otherwise(F.lit(max_tokens) - F.col("n"))).alias("padding"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(tables(spark, sf_dir, "documents"), public_vocabulary()).drop("loss")


def packed_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations: at most 2,048 tokens, 1,024 that bear loss (what binds in the given tables) and 16 segments a sequence."""
    return pack_conversations(tables(spark, sf_dir, "conversations"), public_vocabulary())

"""Vector best-fit packing of token sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, map_arrow, pieces, save
from .tokens import default_vocabulary, encoded

#: Capacities of a sequence: tokens, pieces, attention cost (the sum of squared lengths). With these the token capacity is the one that binds.
TOKENS = 2048
PIECES = 2048
ATTENTION = TOKENS * TOKENS
#: Weights of the three residuals.
WEIGHTS = (1.0, 0.05, 0.25)
#: Pieces that are packed together, about.
GROUP = 16_000

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(docs: DataFrame, vocabulary: str | None = None, tokens: int = TOKENS) -> DataFrame:
    """Pieces of every document: its ids and the end id, cut from the back, so that only the first piece may be short. A null text is empty."""
    path = vocabulary or default_vocabulary()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for b in batches:
            for part in pieces(b, 256):
                rows = []
                for d, raw in zip(part.column("doc_id").to_pylist(), encoded(part, path), strict=True):
                    n = len(raw) // 4
                    ends = range(n % tokens or tokens, n + 1, tokens)
                    lo = 0
                    for k, e in enumerate(ends):
                        rows.append((d, k, lo, e - lo, zlib.crc32(raw[4 * lo : 4 * e])))
                        lo = e
                yield batch(schema, *zip(*rows, strict=True))

    return map_arrow(docs.select("doc_id", "text"), run, PIECE)


class Bins:
    """Open sequences as residual vectors, by demand of (tokens, 1, tokens squared) over the capacities.

    best(): of the sequences that hold the piece under every constraint, the one with
    the least weighted norm of what would be left, or with the greatest weighted
    product of demand and residual. Sequences with equal residuals are one class, so
    a search costs no more than there are classes.
    """

    def __init__(self, capacity: tuple[int, int, int], weights=WEIGHTS, rule: str = "norm"):
        self.cap, self.w, self.rule = np.array(capacity, float), np.array(weights, float), rule
        self.free, self.live = np.zeros((1024, 3)), np.zeros(1024, bool)  # what is left, by class; classes with members
        self.n, self.members, self.of = 0, [], {}

    def _join(self, free: tuple[int, int, int], seq: int) -> None:
        if free not in self.of:
            if self.n == len(self.free):
                self._tidy()
            self.of[free] = self.n
            self.free[self.n] = free
            self.members.append([])
            self.n += 1
        self.members[self.of[free]].append(seq)
        self.live[self.of[free]] = True

    def _tidy(self) -> None:
        keep = np.flatnonzero(self.live[: self.n])
        free, size = self.free[keep], max(1024, 2 * len(keep))
        self.free, self.live = np.zeros((size, 3)), np.zeros(size, bool)
        self.free[: len(keep)], self.live[: len(keep)] = free, True
        self.members = [self.members[i] for i in keep.tolist()]
        self.n, self.of = len(keep), {tuple(map(int, f)): i for i, f in enumerate(free)}

    def best(self, length: int) -> int | None:
        d = np.array([length, 1, length * length], float)
        free = self.free[: self.n]
        fits = np.flatnonzero(self.live[: self.n] & (free[:, 0] >= d[0]) & (free[:, 1] >= d[1]) & (free[:, 2] >= d[2]))
        if not len(fits):
            return None
        if self.rule == "dot":
            return int(fits[((free[fits] / self.cap) * (d / self.cap) * self.w).sum(1).argmax()])
        return int(fits[((((free[fits] - d) / self.cap) ** 2) * self.w).sum(1).argmin()])

    def put(self, length: int, fresh: int) -> tuple[int, int]:
        """Sequence and offset for a piece; fresh is the number of a new sequence, used if none has room."""
        at = self.best(length)
        if at is None:
            free, seq = tuple(map(int, self.cap)), fresh
        else:
            free, seq = tuple(map(int, self.free[at])), self.members[at].pop()
            self.live[at] = bool(self.members[at])
        left = (free[0] - length, free[1] - 1, free[2] - length * length)
        if min(left) >= 0 and left[0] > 0 and left[1] > 0:
            self._join(left, seq)
        return seq, int(self.cap[0]) - free[0]


def pack(lengths: np.ndarray, capacity=(TOKENS, PIECES, ATTENTION), weights=WEIGHTS, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; pieces are placed from the longest to the shortest."""
    bins, seqs, offs, n = Bins(capacity, weights, rule), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        if size > capacity[0] or size * size > capacity[2]:
            raise ValueError("a piece is larger than a sequence")
        seqs[i], offs[i] = bins.put(size, n)
        n += seqs[i] == n
    return seqs, offs


def pack_pieces(cuts: DataFrame, tokens: int = TOKENS, most: int = PIECES, attention: int = ATTENTION, weights=WEIGHTS, rule: str = "norm", group: int = GROUP) -> DataFrame:
    """cuts with sequence_id and offset added.

    Pieces are dealt by hash to groups of about group pieces (counts of lengths decide
    how many), and each group is packed by itself, longest first; a group wastes less
    than a sequence or two. The order within a group is fixed by length and piece, so a
    task that runs again gives the same numbers. Full pieces need no search.
    """
    n = cuts.count()
    parts = max(1, n // group)
    dealt = cuts.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "start"), F.lit(parts)).cast("int"))
    names = [c for c in cuts.columns]
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]):
        held: list[pa.RecordBatch] = []
        now = None

        def flush():
            t = pa.Table.from_batches(held).combine_chunks()
            seq, off = pack(t.column("length").to_numpy(), (tokens, most, attention), weights, rule)
            cols = [t.column(c).combine_chunks() for c in names]
            return batch(schema, *cols, seq + (now << 32), off)

        for b in batches:
            g = b.column("_group").to_numpy()
            edge = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                if lo == hi:
                    continue
                if now is not None and int(g[lo]) != now:
                    yield flush()
                    held = []
                now = int(g[lo])
                held.append(b.slice(lo, hi - lo))
        if held:
            yield flush()

    ordered = dealt.repartition("_group").sortWithinPartitions("_group", F.col("length").desc(), "doc_id", "piece", "start", "ids_crc32")
    return map_arrow(ordered, run, PIECE + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, tokens: int = TOKENS, **params) -> DataFrame:
    """All of it; the pieces are written once, so that counting them doesn't encode the texts again."""
    return pack_pieces(save(cut(docs, vocabulary, tokens), "pieces"), tokens, **params)

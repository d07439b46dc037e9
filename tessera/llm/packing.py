"""Harmonic packing of token ids into sequences of a fixed capacity.

Lengths fall into reciprocal-capacity classes: class k holds pieces of floor(capacity / k) ids, and a bin of
class k is filled with exactly k of them. A document is cut greedily into the longest class lengths that fit (whole
capacities first), so a piece always lies at the top of its class and a full bin wastes fewer than k ids. The
classes are k = 1..LINEAR and the powers of two up to the capacity. Every worker fills its own bins: no shuffle,
and a worker holds fewer than k pieces for each class.

What is left when a worker's rows end: pieces of a length that is no power of two are cut into powers of two and
join those classes; the rest of each such class is taken in groups of 2^j pieces, sequences whose length is
a power of two and needs no padding.

Null or empty texts are one end id. Repeated rows are packed again (their pieces tell them apart by sequence and
offset). Text of any length is cut into capacities as it comes. An empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices, tidy
from tessera.llm.tokens import encoder

LINEAR = 16
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def classes(capacity: int) -> dict[int, int]:
    """Pieces in a bin, by length of piece; capacity is a power of two."""
    found = {capacity // k: k for k in range(1, min(LINEAR, capacity) + 1)}
    k = 1
    while k <= capacity:
        found[capacity // k] = k
        k *= 2
    return found


def cuts(capacity: int) -> list[list[int]]:
    """The piece lengths for each count of ids below the capacity."""
    lengths = sorted(classes(capacity), reverse=True)
    out: list[list[int]] = [[]]
    for n in range(1, capacity):
        first = next(x for x in lengths if x <= n)
        out.append([first, *out[n - first]])
    return out


class Packer:
    """The bins of one worker. A piece is (doc_id, start, length, ids, doc_tokens)."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.per_bin, self.cuts = capacity, classes(capacity), cuts(capacity)
        self.open: dict[int, list[tuple]] = defaultdict(list)
        self.next, self.rows = first_sequence, []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        n, at = len(ids), 0
        for length in [*[self.capacity] * (n // self.capacity), *self.cuts[n % self.capacity]]:
            self._put((doc_id, at, length, ids[at : at + length].astype("<u4").tobytes(), n))
            at += length

    def _put(self, piece: tuple) -> None:
        group = self.open[piece[2]]
        group.append(piece)
        if len(group) == self.per_bin[piece[2]]:
            self._close(group)
            self.open[piece[2]] = []

    def _close(self, group: list[tuple]) -> None:
        offset = 0
        for doc_id, start, length, ids, n in group:
            self.rows.append((doc_id, start, length, ids, n, self.next, offset))
            offset += length
        self.next += 1

    def finish(self) -> None:
        for length in sorted(self.open, reverse=True):
            if length & (length - 1):
                for doc_id, start, size, ids, n in self.open.pop(length):
                    at, bit = 0, 1 << (size.bit_length() - 1)
                    while bit:
                        if size & bit:
                            self._put((doc_id, start + at, bit, ids[4 * at : 4 * (at + bit)], n))
                            at += bit
                        bit >>= 1
        for group in self.open.values():
            take = 1 << len(group).bit_length()
            while take := take >> 1:
                if len(group) & take:
                    self._close(group[:take])
                    group = group[take:]

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, r)) for r in rows], schema=_ARROW) if not rows else pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


def pack(df: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 4096, blank: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents: SCHEMA, with ids as little-endian unsigned 32-bit integers."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids_of, bins = encoder(vocabulary, blank), Packer(capacity, TaskContext.get().partitionId() << 36)
        end = np.array([end_id], np.uint32)
        for whole in batches:
            for batch in slices(whole):
                ids, at = ids_of.encode(batch.column(1))
                for k, doc in enumerate(batch.column(0).to_pylist()):
                    bins.add(doc, np.concatenate([ids[at[k] : at[k + 1]], end]))
                yield bins.taken()
        bins.finish()
        yield bins.taken()

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(tidy(packed), SCHEMA)

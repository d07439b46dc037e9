"""Helpers shared by the training-data operators: table access, Arrow batches and vectorised word hashes."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.tables import Table, shared_folder, written  # noqa: F401

U64 = np.uint64
_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
BYTE = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
_POWERS: dict[str, np.ndarray] = {}

#: Most keys that `likely` makes a filter of: 64 MB at most.
LIKELY = 1 << 24

#: `[\x20\x09-\x0D]` separates words.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: All ASCII but digits and lower-case letters separates words (text is lower-cased first).
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_join(many: DataFrame, few: DataFrame, key: str, parts: int = 16) -> DataFrame:
    """A left join on key, once in `few`, that deals the rows of one key in `many` to `parts` tasks."""
    dealt = few.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    hashed = [f.name for f in many.schema if "map<" not in f.dataType.simpleString()]
    own = F.pmod(F.xxhash64(*hashed), F.lit(parts)).cast("int")
    return many.withColumn("__part", own).join(dealt, [key, "__part"], "left").drop("__part")


def likely(keys: DataFrame, key: str) -> Column:
    """Whether a row's `key` (a number) may be among those of `keys`: always if it is, else of some 70 rows for one.

    Joins that few rows of a wide table meet are asked this first, so that the others are not shuffled. The answer is a
    Bloom filter (16 to 32 bits a key, two of them set) that all tasks are sent; of more than LIKELY keys it is yes. `keys`
    is read twice. A null is a key like others.
    """
    hashed = F.xxhash64(F.col(key).cast("long"))
    hashes = keys.select(hashed.alias("h")).distinct()
    n = hashes.count()
    if n > LIKELY:
        return F.lit(True)
    words = 1 << max(4, (n // 4).bit_length())
    # One bit by the lower half of the hash, one by the upper half.
    bit = F.explode(F.array(F.col("h").bitwiseAND(F.lit(64 * words - 1)), F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(64 * words - 1)))).alias("bit")
    rows = hashes.select(bit).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("bits")).toArrow()
    made = np.zeros(words, U64)
    made[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(U64)
    table = keys.sparkSession.sparkContext.broadcast(made)

    @F.arrow_udf("boolean")
    def may(hashes: pa.Array) -> pa.Array:
        h = hashes.to_numpy(zero_copy_only=False).view(U64)
        out = np.ones(len(h), bool)
        for half in (h, h >> U64(32)):
            at = half & U64(64 * len(table.value) - 1)
            out &= (table.value[(at >> U64(6)).astype(np.int64)] >> (at & U64(63)) & U64(1)).astype(bool)
        return pa.array(out)

    return may(hashed)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse."""
    if "p" not in _POWERS or len(_POWERS["p"]) < n:
        size = max(n, 1 << 16)
        for key, base in (("p", _MULT), ("i", _INV)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _POWERS[key] = np.cumprod(steps, dtype=U64)
    return _POWERS["p"][:n], _POWERS["i"][:n]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most `limit` bytes of the column, or one row."""
    arr = batch.column(batch.schema.get_field_index(column))
    if len(arr) == 0:
        return
    wide = pa.types.is_large_string(arr.type)
    offsets = np.frombuffer(arr.buffers()[1], np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    at = 0
    while at < len(arr):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets; null is empty."""
    wide = pa.types.is_large_string(arr.type)
    offsets = np.frombuffer(arr.buffers()[1], np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = arr.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """All words of the rows of a string column: 64-bit hashes, byte spans, and the word range of each row."""

    def __init__(self, arr: pa.Array, lower: bool = False, between: np.ndarray = WHITE):
        data, rows = utf8(arr)
        if lower:
            data = _LOWER[data]
        self.data, self.rows = data, rows
        inside = ~between[data]
        before = np.zeros(len(data) + 1, bool)
        before[1:] = inside
        first = np.zeros(len(data) + 1, bool)
        first[rows] = True
        flag = np.append(inside, False)
        self.start = np.flatnonzero(flag & (~before | first))
        self.end = np.flatnonzero(before & (~flag | first))
        power, inverse = powers(len(data) + 1)
        total = np.zeros(len(data) + 1, U64)
        np.cumsum(BYTE[data] * power[:-1], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * inverse[self.start] + (self.end - self.start).astype(U64))
        self.bounds = np.searchsorted(self.start, rows)
        self.row_end = np.repeat(self.bounds[1:], np.diff(self.bounds))

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; only those that end within the row count (see `whole`)."""
        return grams(self.hash, k)

    def whole(self, k: int) -> np.ndarray:
        return np.arange(len(self.hash)) + k <= self.row_end


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Rolling hash of k items by doubling; what runs over the end is filled up with zeros."""
    n, mult = len(words), U64(0xD6E8FEB86659FD93)
    out, done, part, size = np.zeros(n, U64), 0, words, 1
    rest = k
    while rest:
        if rest & 1:
            moved = np.zeros(n, U64)
            moved[: max(0, n - done)] = part[done:] if done else part
            out = mix(out * mult + moved)
            done += size
        rest >>= 1
        if rest:
            moved = np.zeros(n, U64)
            moved[: max(0, n - size)] = part[size:]
            part = mix(part * mult + moved + U64(1))
            size *= 2
    return out


def give_back() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run):  # noqa: ANN001, ANN201
    """A batch function that gives its memory back to the system when its task ends: workers wait for their next task with little."""

    @functools.wraps(run)
    def wrapped(batches):  # noqa: ANN001, ANN202
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def strings(arr: pa.Array) -> list[str]:
    """The rows of a string column; null is empty."""
    return [x or "" for x in arr.to_pylist()]


class IdStore:
    """Runs of ids by a 64-bit key, kept by a worker from batch to batch; starts anew beyond `most` keys or `most_ids` ids."""

    def __init__(self, most: int, most_ids: int):
        self.most, self.most_ids = most, most_ids
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def missing(self, keys: np.ndarray) -> np.ndarray:
        """Which of the distinct keys, in order, are not there."""
        if len(self.keys) > self.most or self.used > self.most_ids:
            self.clear()
        place = np.searchsorted(self.keys, keys)
        out = np.ones(len(keys), bool)
        known = place < len(self.keys)
        out[known] = self.keys[place[known]] != keys[known]
        return out

    def add(self, keys: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """The runs of new keys in order, all ids in a row."""
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        at = self.used + np.cumsum(size) - size
        self.used += len(ids)
        place = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.size = (np.insert(x, place, y) for x, y in ((self.keys, keys), (self.at, at), (self.size, size)))

    def gather(self, keys: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the keys numbered `which` in a row, and the offset after each (from 0)."""
        place = np.searchsorted(self.keys, keys)
        size = self.size[place][which]
        ends = np.cumsum(size)
        count = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.at[place][which] - ends + size, size) + np.arange(count)]
        return ids, np.concatenate([[0], ends])

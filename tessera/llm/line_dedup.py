"""Line dedup: a line that stands in several documents stays in the first of them only.

Two Bloom filters hold what has been seen once and what has been seen twice. They are cut into segments by the first
bits of a line's hash. Tasks send each segment the hashes of their lines, one for each line and many documents; the
segment's task adds a hash to the second filter when the first one has it. Only lines that the second filter may hold
(the suspects: repeats, and some 0.3 % of the others) leave their document: they are grouped by their whole text, which
settles whether two documents hold them and which is the first. Documents without a suspect are never shuffled.

The filters have 16 bits a line. A second filter of at most `SEGMENTS` segments (64 MB, for 33 million lines) is sent to
all tasks. A longer one stays in its tasks, and the hashes of lines come to it, each with the place of its line; a hash
that a task has met in two documents is a suspect without asking. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import _LOWER, BYTE, U64, WHITE, Table, mix, powers, slices, split_join, tidy, utf8, written

#: Bits of a segment of a filter, bits of a filter for each line, bits set for a line, and segments that may be broadcast.
SEGMENT, PER_LINE, PROBES, SEGMENTS = 1 << 23, 16, 4, 64
#: Lines that a task gathers before it sends their hashes on.
WINDOW = 1 << 20

_SENT = "segment int, twice boolean, hashes binary"
_PLACE = "segment int, hash long, row long, line int"
_FOUND = "array<struct<line: int, key: string>>"


class Lines:
    """All lines of a string column: row, number in the row, and for those with a key of `least` code points its hash and bytes."""

    def __init__(self, arr: pa.Array, least: int):
        data, rows = utf8(arr)
        self.data = _LOWER[data]
        breaks = np.flatnonzero(data == 10)
        starts, ends = np.sort(np.concatenate([rows[:-1], breaks + 1])), np.sort(np.concatenate([breaks, rows[1:]]))
        count = np.diff(np.searchsorted(breaks, rows)) + 1
        row = np.repeat(np.arange(len(arr)), count)
        number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        solid = np.flatnonzero(~WHITE[data])
        left, right = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
        some = left < right
        self.start, self.end = solid[left[some]], solid[right[some] - 1] + 1
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        long = points[self.end] - points[self.start] >= least
        self.start, self.end = self.start[long], self.end[long]
        self.row, self.number = row[some][long], number[some][long]
        power, inverse = powers(len(data) + 1)
        total = np.zeros(len(data) + 1, U64)
        np.cumsum(BYTE[self.data] * power[:-1], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * inverse[self.start] + (self.end - self.start).astype(U64))

    def key(self, k: int) -> str:
        return self.data[self.start[k] : self.end[k]].tobytes().decode()


def _parts(texts: pa.Array) -> Iterator[pa.Array]:
    for part in slices(pa.RecordBatch.from_arrays([texts], ["text"])):
        yield part.column(0)


def _segment(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def _places(hashes: np.ndarray) -> np.ndarray:
    """The bits of each hash in its segment."""
    one = mix(hashes)
    return ((one[:, None] + np.arange(PROBES, dtype=U64) * (mix(one) | U64(1))[:, None]) & U64(SEGMENT - 1)).astype(np.int64)


def _windows(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(hash, row number, line number) of the lines of many documents, and the row keys, if the batches have them."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for batch in batches:
        keys = batch.column(1).to_numpy(zero_copy_only=False) if batch.num_columns > 1 else np.zeros(batch.num_rows, np.int64)
        at = 0
        for part in _parts(batch.column(0)):
            lines = Lines(part, least)
            held.append((lines.hash, keys[at : at + len(part)][lines.row], lines.number, lines.row + size))
            at += len(part)
            size += max(len(part), len(lines.hash))
            if size >= WINDOW:
                yield tuple(map(np.concatenate, zip(*held)))
                held, size = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def _documents(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes in order, in how many rows of the window each is, and the number of each line's hash."""
    unique, which = np.unique(hashes, return_inverse=True)
    order = np.lexsort((rows, which))
    w, r = which[order], rows[order]
    first = np.ones(len(w), bool)
    first[1:] = (w[1:] != w[:-1]) | (r[1:] != r[:-1])
    return unique, np.bincount(w[first], minlength=len(unique)), which


def _sent(least: int, bits: int):  # noqa: ANN202
    """Batches of texts -> for each window and segment the hashes of lines, apart for those in one and in more documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, _, _, rows in _windows(batches, least):
            unique, count, _ = _documents(hashes, rows)
            out: list[tuple[int, bool, bytes]] = []
            for twice in (False, True):
                own = unique[(count > 1) == twice]
                segments = _segment(own, bits)
                for s in np.unique(segments).tolist():
                    a, b = np.searchsorted(segments, [s, s + 1])
                    out.append((s, twice, own[a:b].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.bool_(), pa.binary()))], ["segment", "twice", "hashes"])

    return tidy(run)


def _filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _sent, segment by segment -> each segment's filter of what was seen twice."""

    def told() -> Iterator[pa.RecordBatch]:
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(second).tobytes()], pa.binary())], ["segment", "bits"])

    at, first, second = None, None, None
    for batch in batches:
        for segment, twice, hashes in zip(*(c.to_pylist() for c in batch.columns)):
            if segment != at:
                yield from told()
                at, first, second = segment, np.zeros(SEGMENT, bool), np.zeros(SEGMENT, bool)
            places = _places(np.frombuffer(hashes, U64))
            second[places if twice else places[first[places].all(axis=1)]] = True
            first[places] = True
    yield from told()


def _holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    places = _places(hashes)
    return ((bits[places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1).astype(bool).all(axis=1)


def _found_here(filters: dict[int, bytes], least: int, bits: int):  # noqa: ANN202
    """Texts -> the suspects of each, by filters that are at hand."""

    @F.arrow_udf(_FOUND)
    def found(texts: pa.Array) -> pa.Array:
        out: list[list[dict]] = []
        for part in _parts(texts):
            lines = Lines(part, least)
            segments = _segment(lines.hash, bits)
            hit = np.zeros(len(segments), bool)
            for s in np.unique(segments).tolist():
                if s in filters.value:
                    own = np.flatnonzero(segments == s)
                    hit[own] = _holds(np.frombuffer(filters.value[s], np.uint8), lines.hash[own])
            rows: list[list[dict]] = [[] for _ in range(len(part))]
            for k in np.flatnonzero(hit).tolist():
                rows[lines.row[k]].append({"line": lines.number[k], "key": lines.key(k)})
            out += rows
        return pa.array(out, pa.list_(pa.struct([("line", pa.int32()), ("key", pa.string())])))

    return found


def _asked(least: int, bits: int):  # noqa: ANN202
    """Batches (text, row) -> a question for each line of one document in its window; lines of more are suspects already (segment null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, keys, numbers, rows in _windows(batches, least):
            _, count, which = _documents(hashes, rows)
            segment = pa.array(_segment(hashes, bits), pa.int32(), mask=count[which] > 1)
            yield pa.RecordBatch.from_arrays([segment, pa.array(hashes.view(np.int64)), pa.array(keys, pa.int64()), pa.array(numbers, pa.int32())], ["segment", "hash", "row", "line"])

    return tidy(run)


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Filters and questions, segment by segment, the filter first -> the places of suspects."""
    at, bits = None, None
    for batch in batches:
        segments, filters = batch.column(0).to_numpy(), batch.column(1)
        cuts = [0, *(np.flatnonzero(np.diff(segments)) + 1).tolist(), len(segments)] if len(segments) else []
        for a, b in zip(cuts, cuts[1:]):
            if segments[a] != at:
                at, bits = segments[a], None
            for k in range(a, b):
                if not filters[k].is_valid:
                    break
                bits = np.frombuffer(filters[k].as_py(), np.uint8)
                a = k + 1
            if a < b and bits is not None:
                part = batch.slice(a, b - a)
                hit = _holds(bits, part.column(2).to_numpy().view(U64))
                yield part.select(["row", "line"]).filter(pa.array(hit))


def _keys_at(least: int):  # noqa: ANN202
    """Texts and numbers of lines -> those lines with their keys."""

    @F.arrow_udf(_FOUND)
    def found(texts: pa.Array, wanted: pa.Array) -> pa.Array:
        out: list[list[dict]] = []
        for part in _parts(texts):
            lines, rows = Lines(part, least), [[] for _ in range(len(part))]
            own = [set(w or ()) for w in wanted.slice(len(out), len(part)).to_pylist()]
            for k, (r, n) in enumerate(zip(lines.row.tolist(), lines.number.tolist())):
                if n in own[r]:
                    rows[r].append({"line": n, "key": lines.key(k)})
            out += rows
        return pa.array(out, pa.list_(pa.struct([("line", pa.int32()), ("key", pa.string())])))

    return found


def _without(texts: pa.Array, lines: pa.Array) -> pa.Array:
    """The texts without the numbered lines."""
    out = []
    for t, gone in zip(texts.to_pylist(), lines.to_pylist()):
        drop = set(gone or ())
        out.append("\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop) if drop else t)
    return pa.array(out, pa.string())


def _line_count() -> Column:
    return F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1


def _suspects(rows: DataFrame, least: int, broadcast: int) -> DataFrame:
    """rows (id, row, text, rest) with `found`, the suspects of each text; a table in the shared folder, which several steps read."""
    spark, texts = rows.sparkSession, rows.select("text")
    total = texts.agg(F.sum(_line_count())).first()[0] or 0
    bits = max(0, (-(-total * PER_LINE // SEGMENT) - 1).bit_length())
    sent = texts.where("text IS NOT NULL").mapInArrow(_sent(least, bits), _SENT)
    filters = Table(sent.repartition("segment").sortWithinPartitions("segment").mapInArrow(_filters, "segment int, bits binary"))
    if 1 << bits <= broadcast:
        at_hand = spark.sparkContext.broadcast({r.segment: bytes(r.bits) for r in filters.df.toLocalIterator()})
        marked = written(rows.withColumn("found", _found_here(at_hand, least, bits)("text")))
        filters.drop()
        return marked
    asked = rows.where("text IS NOT NULL").select("text", "row").mapInArrow(_asked(least, bits), _PLACE)
    told = filters.df.select("segment", "bits", F.lit(None).cast("long").alias("hash"), F.lit(None).cast("long").alias("row"), F.lit(None).cast("int").alias("line"))
    both = told.unionByName(asked.where("segment IS NOT NULL").withColumn("bits", F.lit(None).cast("binary")))
    answered = both.select("segment", "bits", "hash", "row", "line").repartition("segment").sortWithinPartitions("segment", F.col("bits").isNull()).mapInArrow(_answered, "row long, line int")
    lines = answered.unionByName(asked.where("segment IS NULL").select("row", "line")).groupBy("row").agg(F.collect_set("line").alias("wanted"))
    joined = rows.join(lines, "row", "left")
    found = F.when(F.col("wanted").isNotNull(), _keys_at(least)("text", "wanted")).otherwise(F.array().cast(_FOUND))
    marked = written(joined.withColumn("found", found).drop("wanted"))
    filters.drop()
    return marked


def dedup_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 10, broadcast: int | None = None) -> DataFrame:
    """df with the repeated lines cut out of its texts, and the columns n_lines (before) and n_dropped.

    Lines are what stands between line feeds. A line's key is the line without [\\x20\\x09-\\x0D] at both ends, A-Z in lower
    case. A key of at least `least` code points that two documents hold loses its lines in all but the least of them, where all
    stay, also repeats. Other lines stay as they are and in order.

    Rows that share an id are one document; rows without one are together one document, after all others. A null text has
    one empty line and stays null; so has an empty one. All columns are kept; n_lines and n_dropped replace columns of
    these names. Empty tables give empty tables. `broadcast` is the number of filter segments sent to all tasks (SEGMENTS).
    """
    others = [c for c in df.columns if c not in (doc_id, text, "n_lines", "n_dropped")]
    own = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(0).alias("none"))
    rows = df.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"), own.alias("rest"))
    rows = rows.withColumn("row", F.xxhash64("id", "text"))
    marked = _suspects(rows, least, SEGMENTS if broadcast is None else broadcast)
    some = marked.where(F.size("found") > 0)
    each = some.select("id", "row", F.explode("found").alias("f")).select("id", "row", "f.line", "f.key")
    holders = each.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.bool_or(F.col("id").isNull()).alias("loose"))
    repeated = holders.where((F.col("first") != F.col("last")) | (F.col("loose") & F.col("first").isNotNull()))
    digest: Column = F.unhex(F.sha2("key", 256))
    joined = split_join(each.select("id", "row", "line", digest.alias("digest")), repeated.select(digest.alias("digest"), "first"), "digest")
    drops = joined.where(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))).groupBy("id", "row").agg(F.collect_set("line").alias("drop"))
    drops = drops.select(F.col("id").alias("drop_id"), F.col("row").alias("drop_row"), "drop")
    cut = some.join(drops, F.col("id").eqNullSafe(F.col("drop_id")) & (F.col("row") == F.col("drop_row")), "left").select("id", "text", "rest", F.coalesce("drop", F.array().cast("array<int>")).alias("drop"))
    cut = cut.withColumn("kept", F.arrow_udf(_without, "string")("text", "drop"))
    whole = marked.where(F.coalesce(F.size("found"), F.lit(0)) <= 0).select("id", "text", "rest", F.array().cast("array<int>").alias("drop"), F.col("text").alias("kept"))
    back = [F.col("id").alias(doc_id) if c == doc_id else F.col("kept").alias(text) if c == text else F.col(f"rest.`{c}`") for c in df.columns if c not in ("n_lines", "n_dropped")]
    return cut.unionByName(whole).select(*back, F.coalesce(_line_count(), F.lit(1)).cast("long").alias("n_lines"), F.size("drop").cast("long").alias("n_dropped"))

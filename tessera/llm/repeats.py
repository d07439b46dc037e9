"""Sparse suffix arrays: passages of at least `PASSAGE` words that stand in more than one place.

A suffix is retained where the K-word run that it begins with is the leftmost one of least hash of WINDOW runs next to
each other (a minimiser). A passage of PASSAGE = K + WINDOW - 1 words has WINDOW such runs, so it belongs to exactly
one retained suffix, and to the same one in each of its copies. The retained suffixes of all documents are sorted by
the hash of their first K words, document and place. A suffix carries its matches to the left and the right as the
hashes of the passages of PASSAGE words around it that belong to it, from the farthest left on. Suffixes of one key
are neighbours; in the order of their passages, equal ones stand side by side: the first in the order of document and
place is the first place of a passage, the others repeat it. Passages next to each other extend to one span.

The sort is a range partitioning by the whole order, document and place included: a passage that a third of all
documents share is spread over many tasks. A key that reaches a border of a task, or has more than HELD suffixes, may
have copies elsewhere: each task hands on the first two places of every passage of such keys, Spark finds the first two
of all, and its suffixes are read again with these. (A counted table of up to FEW repeated passages is broadcast; of a
longer one every passage looks its first places up by a join.) All ways give the same rows, so rows do not depend on
where the borders are. Words are split at white space and told apart with their case; passages of
one key (64 bits of hash over K words) are told apart by 40 bits more, over all their words.

Null or empty texts and texts under PASSAGE words hold no passage. Rows with one id are one document: a row that
repeats another with its id is no repeat. Null ids are one document too. An empty table gives no rows. Text of any
length is one row's work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import U64, Table, Words, likely, mix, slices, split_join, tidy, written

K, WINDOW = 25, 26
PASSAGE = K + WINDOW - 1
#: Suffixes of one key that a task looks at together.
HELD = 50_000
#: Bytes of a passage's hash.
SIZE = 5
#: Most repeated passages of open keys in a broadcast (32 bytes each).
FEW = 200_000
_SUFFIX = "key long, doc_id long, start long, passages binary"
_MATCH = "doc_id long, start_word long, end_word long, is_repeat boolean, other_doc_id long, key long, passages binary"
_MATCH_ARROW = pa.schema([("doc_id", pa.int64()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("is_repeat", pa.bool_()), ("other_doc_id", pa.int64()), ("key", pa.int64()), ("passages", pa.binary())])
#: Stands for a null id, which is one document's too.
_NULL_ID = -(1 << 63)


def leftmost_least(x: np.ndarray, width: int) -> np.ndarray:
    """The place of the least of the `width` elements from each element on; of equal ones the leftmost."""
    at = np.arange(len(x))

    def joined(x: np.ndarray, at: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
        least, place = x.copy(), at.copy()
        n = max(0, len(x) - by)
        less = x[by:] < x[:n]
        least[:n][less], place[:n][less] = x[by:][less], at[by:][less]
        return least, place

    size = 1
    while size * 2 <= width:
        x, at = joined(x, at, size)
        size *= 2
    return joined(x, at, width - size)[1] if size < width else at


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole):
            words = Words(batch.column(1))
            start = np.flatnonzero(words.whole(PASSAGE))
            if not len(start):
                continue
            run = words.grams(K)
            place = leftmost_least(run, WINDOW)[start]
            first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
            row = np.searchsorted(words.bounds, start[first], "right") - 1
            ids = batch.column(0).to_numpy(zero_copy_only=False)[row]
            data = np.ascontiguousarray(words.grams(PASSAGE)[start].astype(">u8").view(np.uint8).reshape(-1, 8)[:, :SIZE])
            offsets = (np.append(first, len(start)) * SIZE).astype(np.int32)
            passages = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
            yield pa.record_batch([pa.array(run[place[first]].view(np.int64)), pa.array(ids, pa.int64()), pa.array(start[first] - words.bounds[row]), passages], names=["key", "doc_id", "start", "passages"])


class _Passages:
    """All passages of some suffixes in their order: hash, document, place, and the suffix each belongs to."""

    def __init__(self, suffixes: pa.RecordBatch):
        key, doc, start = (suffixes.column(k).to_numpy() for k in range(3))
        column = suffixes.column(3)
        at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        raw = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].reshape(-1, SIZE).astype(U64)
        size = np.diff(at) // SIZE
        self.suffix = np.repeat(np.arange(len(key)), size)
        own = np.zeros(len(raw), U64)
        for k in range(SIZE):
            own = (own << U64(8)) | raw[:, k]
        self.hash = mix(mix(key.view(U64))[self.suffix] ^ own)
        self.doc = doc[self.suffix]
        self.start = start[self.suffix] + np.arange(len(raw)) - (at[:-1] - at[0])[self.suffix] // SIZE


def _open(suffixes: pa.RecordBatch) -> pa.RecordBatch:
    """The suffixes as they are, to be looked at when the first places of their passages are known."""
    key, doc, start, passages = suffixes.columns
    none = [pa.nulls(len(key), t) for t in (pa.int64(), pa.bool_(), pa.int64())]
    return pa.record_batch([doc, start, *none, key, passages], schema=_MATCH_ARROW)


def _spans(p: _Passages, state: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
    """Rows for passages next to each other in one state (0: stands alone, 1: first place, 2: repeat)."""
    edge = np.append(True, (state[1:] != state[:-1]) | (p.suffix[1:] != p.suffix[:-1]))
    first = np.flatnonzero(edge)
    last = np.append(first[1:], len(state)) - 1
    least = np.minimum.reduceat(other, first)
    on = state[first] > 0
    first, last = first[on], last[on]
    none = [pa.nulls(len(first), t) for t in (pa.int64(), pa.binary())]
    return pa.record_batch([pa.array(p.doc[first]), pa.array(p.start[first]), pa.array(p.start[last] + PASSAGE), pa.array(state[first] == 2), pa.array(least[on]), *none], schema=_MATCH_ARROW)


def _joined(spans: pa.RecordBatch) -> pa.RecordBatch:
    """Spans of one document and kind that overlap or touch become one."""
    doc, start, end, repeat, other = (spans.column(k).to_numpy(zero_copy_only=False) for k in range(5))
    if not len(doc):
        return spans
    order = np.lexsort((end, start, repeat, doc))
    doc, start, end, repeat, other = (x[order] for x in (doc, start, end, repeat, other))
    edge = np.append(True, (doc[1:] != doc[:-1]) | (repeat[1:] != repeat[:-1]))
    lift = (np.cumsum(edge) - 1) * (int(end.max()) + 1)  # so that a running maximum starts anew at each edge
    reach = np.maximum.accumulate(end + lift) - lift
    first = np.flatnonzero(edge | np.append(True, reach[:-1] < start[1:]))
    none = [pa.nulls(len(first), t) for t in (pa.int64(), pa.binary())]
    columns = [doc[first], start[first], np.maximum.reduceat(end, first), repeat[first], np.minimum.reduceat(other, first)]
    return pa.record_batch([*map(pa.array, columns), *none], schema=_MATCH_ARROW)


def _closed(suffixes: pa.RecordBatch) -> pa.RecordBatch:
    """The spans of suffixes in the order of key, document and place, with all that have their keys."""
    p = _Passages(suffixes)
    order = np.argsort(p.hash, kind="stable")  # one hash is of one key, so its passages stay in the order of document and place
    h, doc, start = p.hash[order], p.doc[order], p.start[order]
    new = np.append(True, h[1:] != h[:-1])
    fresh = new | np.append(True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1]))
    order, new, doc = order[fresh], new[fresh], doc[fresh]
    more = ~np.append(new[1:], True)  # the next one has the same words
    lead = doc[np.flatnonzero(new)[np.cumsum(new) - 1]]
    kind = np.where(new, more.astype(np.int8), np.int8(2))  # 0: stands alone, 1: first place, 2: repeat
    state, other = np.zeros(len(p.doc), np.int8), np.zeros(len(p.doc), np.int64)
    state[order], other[order] = kind, np.where(new, np.append(doc[1:], 0), lead)
    return _spans(p, state, other)


def _matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _MATCH from suffixes in order; keys that may have suffixes in other tasks, or too many, are left open."""
    held, open_keys = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        key = batch.column(0).to_numpy()
        if not open_keys:
            open_keys.append(key[0])
        cut = int(np.searchsorted(key, key[-1]))
        done, held = batch.slice(0, cut), batch.slice(cut)
        if cut:
            own = key[:cut]
            alone = np.append(True, own[1:] != own[:-1]) & np.append(own[1:] != own[:-1], True)
            leave = np.isin(own, open_keys)
            if leave.any():
                yield _open(done.filter(pa.array(leave)))
            pick = ~leave & ~alone
            if pick.any():
                yield _closed(done.filter(pa.array(pick)))
            open_keys = open_keys[-1:]
        if held.num_rows > HELD:
            yield _open(held)
            open_keys, held = [key[-1]], None
    if held is not None:
        yield _open(held)


_PLACES = "passage long, doc_id long, start_word long"


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All passages of open suffixes."""
    for batch in batches:
        if batch.num_rows:
            p = _Passages(batch)
            yield pa.record_batch([pa.array(p.hash.view(np.int64)), pa.array(p.doc), pa.array(p.start)], names=["passage", "doc_id", "start_word"])


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first two places of every passage in a batch."""
    for batch in batches:
        if batch.num_rows:
            p = _Passages(batch)
            order = np.lexsort((p.start, p.doc, p.hash))
            h, doc, start = p.hash[order], p.doc[order], p.start[order]
            new = np.append(True, h[1:] != h[:-1])
            fresh = new | np.append(True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1]))
            h, doc, start, new = h[fresh], doc[fresh], start[fresh], new[fresh]
            early = new | np.append(True, new[:-1])
            yield pa.record_batch([pa.array(h[early].view(np.int64)), pa.array(doc[early]), pa.array(start[early])], names=["passage", "doc_id", "start_word"])


def _looked_up(table):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The spans of open suffixes in the order of document and place, joined; table: passages in order, their first document and word, and the document after it."""
        hashes, doc, start, follower = table.value
        for batch in batches:
            if not batch.num_rows or not len(hashes):
                continue
            p = _Passages(batch)
            at = np.minimum(np.searchsorted(hashes, p.hash), len(hashes) - 1)
            is_first = (doc[at] == p.doc) & (start[at] == p.start)
            state = np.where(hashes[at] != p.hash, 0, np.where(is_first, 1, 2)).astype(np.int8)
            yield _joined(_spans(p, state, np.where(is_first, follower[at], doc[at])))

    return run


def _of_open_keys(suffixes: DataFrame) -> DataFrame:
    """doc_id, start_word, end_word, is_repeat, other_doc_id from the suffixes of open keys."""
    columns = ["doc_id", "start_word", "end_word", "is_repeat", "other_doc_id"]
    heads = suffixes.mapInArrow(tidy(_heads), _PLACES).groupBy("passage").agg(F.sort_array(F.collect_set(F.struct("doc_id", "start_word"))).alias("places"))
    first = written(heads.where(F.size("places") > 1).select("passage", F.col("places")[0].alias("first"), F.col("places")[1]["doc_id"].alias("follower")))
    if first.count() <= FEW:
        rows = first.select("passage", "first.doc_id", "first.start_word", "follower").toArrow()
        passage, doc, start, follower = (rows.column(k).to_numpy() for k in range(4))
        order = np.argsort(passage.view(U64))
        table = suffixes.sparkSession.sparkContext.broadcast((passage.view(U64)[order], doc[order], start[order], follower[order]))
        # Suffixes of one document meet, so that a copy gives a span or two and not one for each of its suffixes.
        by_document = suffixes.repartition("doc_id").sortWithinPartitions("doc_id", "start")
        return by_document.mapInArrow(tidy(_looked_up(table)), _MATCH).select(columns)
    placed = suffixes.mapInArrow(tidy(_exploded), _PLACES).join(first, "passage").withColumn("is_repeat", F.col("first") != F.struct("doc_id", "start_word"))
    return placed.select("doc_id", "start_word", (F.col("start_word") + PASSAGE).alias("end_word"), "is_repeat", F.when(F.col("is_repeat"), F.col("first.doc_id")).otherwise(F.col("follower")).alias("other_doc_id"))


def repeated_passages(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start_word, end_word (exclusive), n_words, is_repeat, other_doc_id: the passages that stand elsewhere too.

    is_repeat: every PASSAGE words of the span stand at an earlier place too, in the order of document and place;
    other_doc_id is the least document that is the first place of some of them. Else all of them stand here first
    and later again; other_doc_id is the least document that follows. Spans of one kind that overlap or touch are one.
    """
    rows = df.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_NULL_ID)).alias("doc_id"), F.col(text).cast("string").alias("text"))
    order = ["key", "doc_id", "start"]
    suffixes = rows.mapInArrow(tidy(_suffixes), _SUFFIX).repartitionByRange(*order).sortWithinPartitions(*order)
    found = written(suffixes.mapInArrow(tidy(_matches), _MATCH))
    spans = found.where(F.col("key").isNull()).drop("key", "passages")
    opened = found.where(F.col("key").isNotNull()).select("key", "doc_id", F.col("start_word").alias("start"), "passages")
    spans = spans.unionByName(_of_open_keys(opened))
    order_in = Window.partitionBy("doc_id", "is_repeat").orderBy("start_word", "end_word")
    before = F.max("end_word").over(order_in.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("__new", F.when(F.coalesce(before < F.col("start_word"), F.lit(True)), 1).otherwise(0))
    islands = marked.withColumn("__island", F.sum("__new").over(order_in.rowsBetween(Window.unboundedPreceding, 0))).groupBy("doc_id", "is_repeat", "__island").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"), F.min("other_doc_id").alias("other_doc_id"))
    back = lambda c: F.when(F.col(c) != _NULL_ID, F.col(c))
    return islands.select(back("doc_id").alias("doc_id"), "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "is_repeat", back("other_doc_id").alias("other_doc_id"))


def cut_repeats(df: DataFrame, passages: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df with the repeats cut out of its texts (the words of a span and the space after it); wholly cut texts go.

    Spans are places in the one text of an id. Where rows of an id have different texts, or rows have no id, use
    without_repeats. df may have columns of any names.
    """
    own = lambda name: name + "_" * max(map(len, df.columns))  # noqa: E731 (longer than any column)
    at, found = own("id"), own("spans")
    spans = passages.where("is_repeat").groupBy(F.col("doc_id").alias(at)).agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias(found))
    spans = written(spans)
    # Texts without a repeat are not shuffled.
    may = likely(spans.select(F.col(at).alias(doc_id)), doc_id)
    joined = df.where(may).join(spans, F.col(doc_id).eqNullSafe(F.col(at)), "left")

    @F.pandas_udf("string")
    def cut(texts, spans):  # noqa: ANN001, ANN202
        import pandas as pd

        out = []
        for t, own in zip(texts, spans):
            raw = (t or "").encode()
            words = Words(pa.array([t or ""]))
            parts, at = [], 0
            for s in own:
                parts.append(raw[at : words.start[s["start_word"]]])
                at = int(words.start[s["end_word"]]) if s["end_word"] < len(words.start) else len(raw)
            out.append(b"".join([*parts, raw[at:]]).decode())
        return pd.Series(out, dtype=object)

    touched = F.col(found).isNotNull()
    whole, parted = joined.where(~touched), joined.where(touched).withColumn(text, cut(F.col(text), F.col(found)))
    parted = parted.where(F.col(text).rlike(r"[^\x20\x09-\x0D]"))
    return whole.unionByName(parted).drop(at, found).unionByName(df.where(~may))


def without_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df with every repeated passage left in its first place only, whatever ids its rows have; wholly cut texts go.

    A row is a document of its own unless another one has the same id and text. Of the texts of one id (or of no id)
    the one of least hash keeps its place in the order of documents, the others come after all ids. All columns stay.
    """
    packed = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(doc_id).cast("long"), F.col(text).cast("string")).alias("h"), F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text]).alias("rest"))
    shared = packed.groupBy("id").agg(F.min("h").alias("lead"), F.max("h").alias("last")).where("lead <> last").select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("name"), "lead")
    shared = Table(shared)
    rows = packed
    if not shared.df.isEmpty():
        named = packed.withColumn("name", F.coalesce(F.col("id").cast("string"), F.lit("")))
        late = F.lit(1 << 62) + F.pmod(F.col("h"), F.lit(1 << 61))
        moved = F.when(F.col("lead").isNull() | (F.col("lead") == F.col("h")), F.col("id")).otherwise(late)
        rows = split_join(named, shared.df, "name").withColumn("id", moved).drop("name", "lead")
    cut = cut_repeats(rows, repeated_passages(rows, "id"), "id")
    return cut.select(*[F.col("text").alias(text) if c == text else F.col(f"rest.`{c}`") for c in df.columns])

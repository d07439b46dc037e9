"""Token ids of documents in files of range-coded blocks, and reading them back.

Format: a Parquet folder; a row is a segment of whole documents in ascending id order. Its columns are shard and
segment (the order of the rows), first (ids of the shard before it), doc_ids and doc_sizes, and the blocks: sizes
(ids), bytes, crc32 of the coded bytes, and data, the coded blocks in a row. A block has at most `block` ids, is
coded from an empty model (see range_coder) and checked before it is decoded. Shards are ranges of ids.

One shuffle deals the texts out by ranges of doc_id; a shard is written as its rows come. Offsets over all shards
need only the number of ids in each shard, one row for each.

Null texts are empty documents (their end id only). Documents of one id stay in one shard, in the order of their
texts. A text of any length is one document of one segment. An empty table gives an empty folder and no rows. Only
the id and text columns are read, whatever else there is.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import slices, tidy
from tessera.llm.range_coder import LONGEST, decode_blocks, encode_blocks
from tessera.llm.tokens import encoder

SCHEMA = "shard int, segment long, first long, n_ids long, doc_ids array<long>, doc_sizes array<long>, block_sizes array<int>, block_bytes array<int>, block_crc32 array<long>, data binary"
_ARROW = pa.schema([("shard", pa.int32()), ("segment", pa.int64()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_sizes", pa.list_(pa.int64())), ("block_sizes", pa.list_(pa.int32())), ("block_bytes", pa.list_(pa.int32())), ("block_crc32", pa.list_(pa.int64())), ("data", pa.binary())])
_READ = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("shard_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
#: Ids of a segment, unless one document has more.
SEGMENT = 1 << 17
#: Ids that are coded, or decoded, side by side.
SIDE_BY_SIDE = 2 << 20


class CorruptBlock(ValueError):
    """A block's bytes do not have the checksum that was written with them."""


def _segments(shard: int, number: int, first: int, docs: list, ids: np.ndarray, at: np.ndarray, block: int) -> list[dict]:
    """The rows for some documents in order."""
    rows, blocks, a = [], [], 0
    while a < len(docs):
        b = max(a + 1, int(np.searchsorted(at, at[a] + SEGMENT, "right")) - 1)
        own = ids[at[a] : at[b]]
        parts = [own[i : i + block] for i in range(0, len(own), block)]
        rows.append({"shard": shard, "segment": number + len(rows), "first": first + int(at[a]), "n_ids": len(own), "doc_ids": docs[a:b], "doc_sizes": np.diff(at[a : b + 1]), "block_sizes": [len(p) for p in parts]})
        blocks += parts
        a = b
    coded = iter(encode_blocks(blocks))
    for row in rows:
        own = [next(coded) for _ in row["block_sizes"]]
        row |= {"block_bytes": [len(x) for x in own], "block_crc32": [zlib.crc32(x) for x in own], "data": b"".join(own)}
    return rows


def write_ids(df: DataFrame, path: str, vocabulary: str, end_id: int = 2, block: int = 1024, blank: bool = False, doc_id: str = "doc_id", text: str = "text") -> None:
    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids_of, shard, number, first = encoder(vocabulary, blank), TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []

        def coded_so_far() -> Iterator[pa.RecordBatch]:
            nonlocal number, first
            docs = [d for own, _, _ in held for d in own]
            sizes = np.concatenate([np.diff(at) for _, _, at in held])
            ids = np.concatenate([x for _, x, _ in held])
            rows = _segments(shard, number, first, docs, ids, np.concatenate([[0], np.cumsum(sizes)]), block)
            number, first = number + len(rows), first + len(ids)
            held.clear()
            for row in rows:
                yield pa.RecordBatch.from_pylist([row], schema=_ARROW)

        for whole in batches:
            for batch in slices(whole):
                ids, at = ids_of.encode(batch.column(1))
                held.append((batch.column(0).to_pylist(), np.insert(ids, at[1:], end_id), at + np.arange(len(at))))
                if sum(len(x) for _, x, _ in held) >= SIDE_BY_SIDE:
                    yield from coded_so_far()
        if held:
            yield from coded_so_far()

    if not 0 < block <= LONGEST:
        raise ValueError(f"a block has 1 to {LONGEST} ids, not {block}")
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(tidy(coded), SCHEMA).write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, and ids as little-endian unsigned 32-bit integers."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for a in range(0, len(rows), SIDE_BY_SIDE // SEGMENT):
                group, coded, sizes = rows[a : a + SIDE_BY_SIDE // SEGMENT], [], []
                for row in group:
                    at = 0
                    for n, crc in zip(row["block_bytes"], row["block_crc32"]):
                        coded.append(row["data"][at : at + n])
                        at += n
                        if zlib.crc32(coded[-1]) != crc:
                            raise CorruptBlock(f"shard {row['shard']}, segment {row['segment']}")
                    sizes += row["block_sizes"]
                blocks = iter(decode_blocks(coded, np.array(sizes, np.int64)))
                for row in group:
                    ids = np.concatenate([np.zeros(0, np.uint32), *[next(blocks) for _ in row["block_sizes"]]]).astype("<u4")
                    ends = np.cumsum(row["doc_sizes"])
                    starts = ends - row["doc_sizes"]
                    raw = memoryview(ids.tobytes())
                    yield pa.record_batch([pa.array([row["shard"]] * len(ends), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["first"] + starts), pa.array(row["doc_sizes"], pa.int64()), pa.array([bytes(raw[4 * s : 4 * e]) for s, e in zip(starts, ends)], pa.binary())], schema=_READ)

    segments = spark.read.schema(SCHEMA).parquet(path)
    before = segments.groupBy("shard").agg(F.sum("n_ids").alias("own")).select("shard", (F.sum("own").over(Window.orderBy("shard")) - F.col("own")).alias("before"))
    docs = segments.mapInArrow(tidy(decoded), "shard int, doc_id long, shard_start long, n_tokens long, ids binary")
    # One short row for each shard: bounded by the number of tasks that wrote the files.
    return docs.join(F.broadcast(before), "shard").select("doc_id", (F.col("before") + F.col("shard_start")).alias("start"), "n_tokens", "ids")

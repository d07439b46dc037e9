"""The prefix trie of conversations, from a Cartesian tree over the common prefixes of sorted neighbours.

1. `sequences` turns each conversation into the 128-bit hashes and word counts of its turns; texts are not shuffled.
2. `prefix_trie` sorts the conversations by those hashes in ranges, one range a block. LCP(i) is the number of first turns
   that row i shares with the row before. A node of depth d is a longest stretch of rows whose inner LCPs are d or more, so
   it ends at the nearest smaller value on each side.
3. Each block finds the nearest smaller values of its LCPs by one pass with a stack of open intervals: equal LCPs are one
   interval, and an interval stands for all depths between its own and its parent's, which are told apart when it
   closes, with what its rows add up to.
4. Intervals that touch a block's edge go on in other blocks. The minima of the blocks tell in which block each begins
   (the nearest one before with a smaller minimum), and so its parts come together by (block, depth): a few rows for a block.
   What edge nodes add to one another is summed by prefix sums over the blocks.

Conversations that are copies lie in as many blocks as they need. A conversation is one row of 20 bytes a turn, as a
document is one row in the other operators: at most some 80 million turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Table, split_join, tidy

WIDTH = 16
_EMPTY = hashlib.sha256(b"").hexdigest()
_ROWS = "block int, pos long, lcp int, key binary, words array<int>, conv_id long"
_GROWN = "edge boolean, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, words long, ends string, born int, block int, parent_born int"
_TYPES = [pa.bool_(), *[pa.int64()] * 8, pa.string(), pa.int32(), pa.int32(), pa.int32()]


def sequences(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turns <turn, symbol, words>: each conversation's turns by number (none first), ties by their hash.

    A null role or text is empty; rows without a conversation are left out; other columns too; rows that repeat are turns of their own.
    """
    who, said = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    symbol = F.substring(F.sha2(F.concat(F.length(who).cast("string"), F.lit(":"), who, said), 256), 1, 2 * WIDTH)
    words = F.regexp_count(said, F.lit(r"[^\x20\x09-\x0D]+")).cast("int")
    one = F.struct(F.col(turn).alias("turn"), symbol.alias("symbol"), words.alias("words"))
    rows = turns.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv_id"), one.alias("one"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))


def grafted(seqs: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """Each conversation c begins with the first h turns of conversation c - c % family, h = crc32(decimal c) % most (all if
    there are fewer, none if there is no such conversation), and goes on with its own turns after its first h."""
    heads = seqs.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    none = F.array().cast(seqs.schema["turns"].dataType)
    joined = seqs.join(heads, F.col("conv_id") - F.col("conv_id") % family == F.col("base"), "left")
    return joined.select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), h), F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


def _common(a: bytes, b: bytes) -> int:
    """How many first symbols two keys share."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDTH
    k = 0
    while a[k : k + WIDTH] == b[k : k + WIDTH]:
        k += WIDTH
    return k // WIDTH


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (key, words, conv_id) -> the same with block, place in it, and LCP with the row before in it."""
    block, at, last = TaskContext.get().partitionId(), 0, None
    for batch in batches:
        keys = batch.column(0).to_pylist()
        lcp = [None if a is None else _common(a, b) for a, b in zip([last, *keys], keys)]
        n, last = batch.num_rows, keys[-1] if keys else last
        head = [pa.array(np.full(n, block, np.int32)), pa.array(np.arange(at, at + n)), pa.array(lcp, pa.int32())]
        yield pa.RecordBatch.from_arrays([*head, *batch.columns], ["block", "pos", "lcp", "key", "words", "conv_id"])
        at += n


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        first, last = (batch.column(k).to_pylist() for k in (2, 3))
        before = [-1 if b is None else _common(a, b) for a, b in zip(first, last)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(before, pa.int32())], ["block", "low", "before"])


class Open:
    """An open interval of rows that share `depth` turns; it stands for all depths down to the one below on the stack."""

    __slots__ = ("children", "count", "depth", "ends", "kids", "least", "leaves", "left", "saved", "words")

    def __init__(self, depth: int, words: list[int], left: bool):
        self.depth, self.words, self.left = depth, words, left
        self.count = self.children = self.leaves = self.saved = 0
        self.least: int | None = None
        self.ends: list[int] = []
        self.kids: list[list] = []

    def add(self, count: int, least: int) -> None:
        self.count += count
        self.least = least if self.least is None else min(self.least, least)


class Block:
    """The stack pass over one block. Rows of `out` are as _GROWN: whole nodes, and parts of those that cross an edge."""

    def __init__(self, number: int, before: int, after: int, starts: np.ndarray, words: list[int]):
        self.number, self.after, self.starts = number, after, starts
        self.stack = [Open(max(before, 0), words, before >= 0)]
        self.out: list[list] = []

    def row(self, lcp: int, words: list[int], conv: int) -> None:
        self._close_to(lcp)
        if len(words) > lcp:
            self.stack.append(Open(len(words), words, False))
        top = self.stack[-1]
        top.add(1, conv)
        top.ends.append(conv)

    def end(self) -> None:
        self._close_to(self.after)
        while self.stack:
            top = self.stack.pop()
            self._part(top, self.stack[-1].depth if self.stack else -1)

    def _close_to(self, depth: int) -> None:
        while self.stack and self.stack[-1].depth > depth:
            top = self.stack.pop()
            below = self.stack[-1].depth if self.stack else -1
            if below < depth:  # what closes is the only one of a longer interval so far
                self.stack.append(Open(depth, top.words, top.left))
            (self._part if top.left else self._whole)(top, max(depth, below))

    def _up(self, top: Open) -> Open | None:
        """Adds a closed interval to the one around it."""
        if not self.stack:
            return None
        around = self.stack[-1]
        if top.count:
            around.add(top.count, top.least)
        around.leaves += top.leaves
        around.saved += top.saved
        return around

    def _born(self, top: Open, depth: int) -> int:
        return int(self.starts[depth]) if top.left else self.number

    def _whole(self, top: Open, low: int) -> None:
        """All nodes of an interval that lies within the block."""
        for kid in top.kids:
            kid[3] = top.least
        self.out += top.kids
        top.leaves = top.leaves or 1
        ends = hashlib.sha256(",".join(map(str, top.ends)).encode()).hexdigest()
        for depth in range(top.depth, low, -1):
            words = top.words[depth - 1] if depth else 0
            top.saved += (top.count - 1) * words
            mine = depth == top.depth
            self.out.append([False, top.least, depth, top.least, top.count, top.children if mine else 1, top.leaves, top.saved, words, ends if mine else _EMPTY, None, None, None])
        around = self._up(top)
        last = self.out[-1]
        last[3] = None  # its parent is another interval
        if around is not None:
            around.children += 1
            around.kids.append(self.out.pop())

    def _part(self, top: Open, low: int) -> None:
        """This block's part of all nodes of an interval that crosses its edge; its leaves and saved words are those of whole nodes only."""
        for kid in top.kids:
            kid[10:13] = None, None, self._born(top, top.depth)
        self.out += top.kids
        for depth in range(top.depth, low, -1):
            mine = depth == top.depth
            below = (self.stack[-1] if depth == low + 1 and self.stack else top) if depth else None
            parent = None if below is None else self._born(below, depth - 1)
            children = top.children if mine else 0 if top.left else 1
            ends = ",".join(map(str, top.ends)) if mine and top.ends else None
            self.out.append([True, top.least, depth, None, top.count, children, top.leaves, top.saved, top.words[depth - 1] if depth else 0, ends, self._born(top, depth), self.number, parent])
        around = self._up(top)
        if around is not None and not top.left:
            around.children += 1


def _grown(edges: list[tuple[int, int, int]]):  # noqa: ANN202
    """Sorted blocks -> rows of Block. `edges`: (block, least inner LCP, LCP with the block before) in order, -1 for the first."""
    numbers = np.array([e[0] for e in edges], np.int64)
    before = np.array([e[2] for e in edges] + [-1], np.int64)
    minima = np.array([min(e[1], e[2]) for e in edges], np.int64)

    def starts(k: int) -> np.ndarray:
        """For each depth up to that of the block's left edge the nearest block before with a smaller minimum."""
        falling = np.minimum.accumulate(minima[:k][::-1])
        return numbers[k - 1 - np.searchsorted(-falling, -np.arange(before[k] + 1), "right")] if before[k] >= 0 else numbers[:0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], [x.split()[0] for x in _GROWN.split(", ")])

        block = None
        for b in batches:
            for number, lcp, words, conv in zip(*(b.column(k).to_pylist() for k in (0, 2, 4, 5))):
                if block is None or block.number != number:
                    if block is not None:
                        block.end()
                        yield batch(block.out)
                    k = int(np.searchsorted(numbers, number))
                    block = Block(number, int(before[k]), int(before[k + 1]), starts(k), words)
                    lcp = max(int(before[k]), 0)
                block.row(lcp, words, conv)
                if len(block.out) >= 20_000:
                    yield batch(block.out)
                    block.out = []
        if block is not None:
            block.end()
            if block.out:
                yield batch(block.out)

    return tidy(run)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces (born, depth, block, ends) in order -> the hash of each node's pieces, comma-joined."""
    at, digest = None, None
    for batch in batches:
        told = []
        for born, depth, _, ends in zip(*(c.to_pylist() for c in batch.columns)):
            if at == (born, depth):
                digest.update(b",")
            else:
                if at is not None:
                    told.append((*at, digest.hexdigest()))
                at, digest = (born, depth), hashlib.sha256()
            digest.update(ends.encode())
        if told:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*told), (pa.int32(), pa.int64(), pa.string()))], ["born", "depth", "ends_sha256"])
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int64()), pa.array([digest.hexdigest()])], ["born", "depth", "ends_sha256"])


def _edge_nodes(parts: DataFrame, blocks: DataFrame) -> DataFrame:
    """The nodes that cross block edges, from their parts: born (block), depth and the columns of a node."""
    whole = parts.groupBy("born", "depth").agg(
        F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("words").alias("words"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"), F.max("block").alias("last"), F.max("parent_born").alias("parent_born"),
    )
    whole = whole.withColumn("own", (F.col("n_convs") - 1) * F.col("words")).withColumn("leaf", (F.col("n_children") == 0).cast("long"))
    above = Window.partitionBy("born").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    whole = whole.withColumns({"in_own": F.sum("own").over(above), "in_leaf": F.sum("leaf").over(above)})
    total = whole.groupBy(F.col("born").alias("block")).agg(F.sum("own").alias("own"), F.sum("leaf").alias("leaf"))
    so_far = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)  # one row for each block
    sums = blocks.join(total, "block", "left").select("block", *[F.sum(F.coalesce(c, F.lit(0))).over(so_far).alias(f"sum_{c}") for c in ("own", "leaf")], *[F.coalesce(c, F.lit(0)).alias(f"at_{c}") for c in ("own", "leaf")])
    first = sums.select(F.col("block").alias("born"), F.col("sum_own").alias("a_own"), F.col("sum_leaf").alias("a_leaf"))
    last = sums.select(F.col("block").alias("last"), (F.col("sum_own") - F.col("at_own")).alias("b_own"), (F.col("sum_leaf") - F.col("at_leaf")).alias("b_leaf"))
    whole = whole.join(first, "born").join(last, "last")
    pieces = parts.where("ends IS NOT NULL").select("born", "depth", "block", "ends").repartition("born", "depth").sortWithinPartitions("born", "depth", "block")
    ends = pieces.mapInArrow(tidy(_hashed), "born int, depth long, ends_sha256 string")
    parent = whole.select(F.col("born").alias("parent_born"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    out = whole.join(parent, ["parent_born", "depth"], "left").join(ends, ["born", "depth"], "left")
    more = lambda c, own: (F.col(c) + F.col(f"in_{own}") + F.col(f"b_{own}") - F.col(f"a_{own}")).alias(c)
    return out.select("born", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", more("n_leaves", "leaf"), more("saved", "own"), F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))


def prefix_trie(seqs: DataFrame) -> DataFrame:
    """The nodes of the trie of sequences(): every distinct beginning of a conversation, the empty one (root) too.

    conv_id: least member (conversation with this beginning); depth; parent_conv_id: the parent's conv_id (root: null);
    n_convs: members; n_children; n_leaves: nodes without children in the subtree; saved_tokens: over the subtree, words of
    a node's last text times (members - 1); ends_sha256: of the members that end here, comma-joined in order. Without
    conversations there is no node; a conversation without turns ends at the root.
    """
    hexes: Column = F.array_join(F.transform("turns", lambda t: t["symbol"]), "")
    rows = seqs.select(F.unhex(hexes).alias("key"), F.transform("turns", lambda t: t["words"]).alias("words"), "conv_id")
    order = ["key", "conv_id"]
    ordered = Table(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(tidy(_numbered), _ROWS))
    ends = ordered.df.groupBy("block").agg(F.min("lcp").alias("low"), F.min_by("key", "pos").alias("first"), F.max_by("key", "pos").alias("last"))
    lagged = ends.select("block", "low", "first", F.lag("last").over(Window.orderBy("block")).alias("last"))  # one row for each block
    edges = sorted((r.block, r.before if r.low is None else r.low, r.before) for r in lagged.mapInArrow(_neighbours, "block int, low int, before int").toLocalIterator())
    grown = Table(ordered.df.repartitionByRange("block").sortWithinPartitions("block", "pos").mapInArrow(_grown(edges), _GROWN))
    ordered.drop()
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256"]
    whole, parts = grown.df.where("NOT edge").withColumnRenamed("ends", "ends_sha256"), grown.df.where("edge")
    if len(edges) < 2:
        return whole.select(*names)
    blocks = seqs.sparkSession.createDataFrame([(e[0],) for e in edges], "block int")
    crossing = _edge_nodes(parts, blocks)
    place = F.concat_ws(":", "parent_born", F.col("depth") - 1)
    around = crossing.select(F.concat_ws(":", "born", "depth").alias("place"), F.col("conv_id").alias("edge_conv_id"))
    under = split_join(whole.where("parent_born IS NOT NULL").withColumn("place", place), around, "place").withColumn("parent_conv_id", F.col("edge_conv_id"))
    return whole.where("parent_born IS NULL").select(*names).unionByName(under.select(*names)).unionByName(crossing.select(*names))

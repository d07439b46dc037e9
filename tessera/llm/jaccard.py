"""N-gram Jaccard join by prefix trees: which texts share at least THRESHOLD of their word n-grams.

1. Every text becomes the set of its distinct 5-word shingles, in the order of their hashes. Equal sets are one class.
2. Two linked sets of n and m shingles have their first min(n, m) // 8 + 1 common shingles among the first
   n // 4 + n // 8 + 1 of the one and as many, by m, of the other. So a class can only have a link if enough of the
   shingles at its beginning stand at the beginning of other classes too. Each task looks among its own classes first
   and hands on one class for each shingle; those shingles, in ten bytes each, are the one large shuffle.
3. The texts of the classes that are left are gathered (the others, told by a Bloom filter, are not shuffled), and their sets ordered anew: plain shingles by hash, then the
   frequent ones (a table of at most FREQUENT, counted over all these texts) from the rarer to the commoner. Classes
   that share one of their first n // 4 + 1 shingles, and have sizes that a link allows, are tied; each task ties its
   own classes first and hands on two for each shingle and size step, so that no shingle gathers many more rows than
   there are tasks. The components of these ties part the classes into groups that no link crosses. Any order gives
   the same links; this one keeps common passages from tying unlike texts. Groups of several trees are tied anew with
   the shingles outside the table in the order of exact counts.
4. The sets of a group are stored in a prefix tree (a trie with runs of shingles as nodes). A set walks through it
   level by level: overlaps with a shared run are counted once for all sets below, subtrees whose sizes or remaining
   lengths cannot reach the overlap that a link needs are left, and so are sets of the walker's own component.
   A group that one task can hold is one tree, and each of its sets walks. A larger one is dealt out in blocks: up to
   PAIRED of them as pairs of blocks, a tree each; of more, every block is a tree. First the HUBS sets of its commonest shingles walk through all blocks; the sets that they are linked with are
   one component with them and need no walk of their own, since every link that they have is met by the walk of the
   set at its other end, or joins what is joined already. Of the sets that are left, new hubs walk as long as that
   leaves clearly fewer; then all that are left walk through every block. A group of near copies of one text is so
   read a few times, not once for each pair of blocks.
5. Links give components, which are joined over the blocks.

Empty texts have no shingles and no links; texts under five words have one shingle, all their words. Null texts are
empty. Rows that repeat one another are one class. A row without an id is no document and links nothing; it is listed
with the component of the documents of its own class, null if there is none. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Table, U64, Words, likely, mix, slices, split_join, tidy, written
from tessera.llm.components import components

N = 5
#: A class needs one in MORE of its shingles, besides its first quarter and as many more, to be shared. Powers of two that shingles are dealt out by.
MORE, BUCKETS = 8, 1 << 12
#: Most shingles in the table of frequent ones (8 bytes each, broadcast).
FREQUENT = 1 << 16
#: Shingles that a task looks at together (some 100 bytes each while it sorts them).
HELD = 1_000_000
#: Sets of a tree, or of a group of many trees, that walk past all others before the rest.
HUBS = 4
#: Most sets of a block, and shingles in all of them (unless one set has more).
BLOCK, SHINGLES = 1024, 2_000_000
#: Most blocks of a group that are met pair by pair, each set going to as many tasks.
PAIRED = 6
#: Bytes of text that are split into words together (some 60 bytes each while they are).
TOGETHER = 1 << 19
_TOP = U64(1 << 63)


def needed(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Least overlap of sets of n and m shingles with 100 * overlap >= 75 * union: 7 * overlap >= 3 * (n + m)."""
    return -((-3 * (n + m)) // 7)


class Sets:
    """The shingle sets of the rows of a string column, in a row, each in the global order."""

    def __init__(self, arr: pa.Array, frequent: np.ndarray):
        """frequent: hashes in ascending order, and their ranks, as one array of two rows."""
        words = Words(arr, lower=True)
        count = np.diff(words.bounds)
        row = np.repeat(np.arange(len(count)), count)
        gram, whole = words.grams(N), words.whole(N)
        short = np.flatnonzero((count > 0) & (count < N))
        first = words.bounds[short]
        own = np.zeros(len(short), U64)
        for k in range(N - 1):
            there = count[short] > k
            own[there] = mix(own[there] * U64(0xD6E8FEB86659FD93) + words.hash[first[there] + k] + U64(k + 1))
        token = np.concatenate([gram[whole], own])
        row = np.concatenate([row[whole], short])
        key = plain = token & ~_TOP
        if frequent.shape[1]:
            at = np.minimum(np.searchsorted(frequent[0], key), frequent.shape[1] - 1)
            hot = frequent[0][at] == key
            key = np.where(hot, _TOP | frequent[1][at], key)
        order = np.lexsort((key, row))
        key, row, plain = key[order], row[order], plain[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
        self.key, self.row, self.plain = key[fresh], row[fresh], plain[fresh]
        self.bounds = np.searchsorted(self.row, np.arange(len(count) + 1))
        self.n = np.diff(self.bounds)

    def classes(self) -> np.ndarray:
        """One number for each distinct set, whatever the order; 0 for the empty one."""
        total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(self.plain))])
        twice = np.concatenate([np.zeros(1, U64), np.cumsum(mix(self.plain ^ U64(0x5851F42D4C957F2D)))])
        a, b = (x[self.bounds[1:]] - x[self.bounds[:-1]] for x in (total, twice))
        return np.where(self.n > 0, mix(a * U64(3) ^ mix(b + self.n.astype(U64))), U64(0)).view(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that a task sees often, with counts."""
    for shingle, _, _, _, _ in _held(batches, np.zeros((2, 0), U64), lambda n: n):
        key, count = np.unique(shingle, return_counts=True)
        often = count >= 2
        yield pa.record_batch([pa.array(key[often]), pa.array(count[often])], names=["shingle", "n"])


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Hashes in order and ranks (0: the rarest) of the at most FREQUENT commonest shingles."""
    counts = docs.mapInArrow(tidy(_counted), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    rows = counts.orderBy(F.desc("n"), "shingle").limit(FREQUENT).collect()
    key = np.array([r.shingle for r in rows], np.int64).view(U64)
    rank = np.arange(len(rows))[::-1].astype(U64)
    order = np.argsort(key)
    return np.stack([key[order], rank[order]]) if len(rows) else np.zeros((2, 0), U64)


def _spread(shingle: np.ndarray, n: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows in the order of shingle, size and class, once each; and where a row has nothing to tie to before it."""
    order = np.lexsort((group, n, shingle))
    shingle, n, group = shingle[order], n[order], group[order]
    fresh = np.ones(len(n), bool)
    fresh[1:] = (shingle[1:] != shingle[:-1]) | (group[1:] != group[:-1])
    shingle, n, group = shingle[fresh], n[fresh], group[fresh]
    opens = np.ones(len(n), bool)
    opens[1:] = (shingle[1:] != shingle[:-1]) | (4 * n[:-1] < 3 * n[1:])
    return shingle, n, group, opens


def _ties(group: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """Distinct pairs of a class and the first one of its run."""
    first = np.flatnonzero(opens)
    lead = group[first[np.cumsum(opens) - 1]] if len(group) else group
    pairs = np.stack([group, lead], 1)[group != lead]
    return np.unique(pairs, axis=0) if len(pairs) else pairs


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n, class of every text."""
    none = np.zeros((2, 0), U64)
    for whole in batches:
        for batch in slices(whole, limit=TOGETHER):
            sets = Sets(batch.column(1), none)
            yield pa.record_batch([batch.column(0), pa.array(sets.n.astype(np.int64)), pa.array(sets.classes())], names=["doc_id", "n", "class"])


def _held(batches: Iterator[pa.RecordBatch], frequent: np.ndarray, length, column: int = 1) -> Iterator[tuple[np.ndarray, ...]]:  # noqa: ANN001
    """(shingle, n, class) of the first length(n) shingles of a task's distinct classes, HELD at a time; then (n, class) of all."""
    seen, held, classes, size = set(), [], [], 0
    for whole in batches:
        for batch in slices(whole, limit=TOGETHER):
            sets = Sets(batch.column(column), frequent)
            group, n = sets.classes(), sets.n.astype(np.int64)
            new = np.zeros(len(n), bool)
            for k, g in enumerate(group.tolist()):
                if g and g not in seen:
                    seen.add(g)
                    new[k] = True
            place = np.arange(len(sets.key)) - sets.bounds[sets.row]
            on = new[sets.row] & (place < length(n)[sets.row])
            held.append((sets.key[on].view(np.int64), n[sets.row[on]], group[sets.row[on]]))
            classes.append((n[new], group[new]))
            size += int(on.sum())
            if size > HELD:
                yield (*(np.concatenate(x) for x in zip(*held)), *(np.concatenate(x) for x in zip(*classes)))
                held, classes, size = [], [], 0
    if held:
        yield (*(np.concatenate(x) for x in zip(*held)), *(np.concatenate(x) for x in zip(*classes)))


def least_shared(n: np.ndarray) -> np.ndarray:
    """Shingles that a linked set of n shares with the other at both beginnings: the other has 3 * n / 4 or more."""
    return (3 * n + 3) // 4 // MORE + 1


def _begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, packed rows) with each shingle of a task once, to be looked up elsewhere; (class, need, count) of those shared within the task.

    A packed row is 40 more bits of the shingle, and 39 of the class with one that says whether the task has other classes
    of this shingle. Shingles or classes that these bits do not tell apart only leave more classes.
    """
    for shingle, _, group, n_all, all_classes in _held(batches, np.zeros((2, 0), U64), lambda n: n // 4 + n // MORE + 1):
        order = np.lexsort((group, shingle))
        shingle, group = shingle[order], group[order]
        first = np.append(True, shingle[1:] != shingle[:-1]) if len(shingle) else np.zeros(0, bool)
        alone = first & np.append(first[1:], True) if len(shingle) else first
        by = np.argsort(all_classes)
        count = np.bincount(by[np.searchsorted(all_classes[by], group[~first])], minlength=len(all_classes))
        bucket, rest = shingle[first] & (BUCKETS - 1), shingle[first] // BUCKETS
        by = np.argsort(bucket, kind="stable")
        bucket = bucket[by]
        packed = np.empty((len(by), 10), np.uint8)
        for at, x in ((0, rest), (5, _short(group[first]) * 2 + ~alone[first])):
            packed[:, at : at + 5] = x[by].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
        start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
        offsets = (np.append(start, len(bucket)) * 10).astype(np.int32)
        data = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(packed.tobytes())])
        yield pa.record_batch([pa.array(bucket[start]), data, *[pa.nulls(len(start), pa.int64())] * 3], names=_BEGUN)
        yield pa.record_batch([pa.nulls(len(count), pa.int64()), pa.nulls(len(count), pa.binary()), pa.array(_short(all_classes)), pa.array(least_shared(n_all)), pa.array(count.astype(np.int64))], names=_BEGUN)


_BEGUN = ["bucket", "packed", "class", "need", "count"]


def _short(group: np.ndarray) -> np.ndarray:
    return group & ((1 << 39) - 1)


def _unpacked(packed: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all packed rows the shingle's 40 bits, the class and flag, and the number of the value they are in."""
    at = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
    raw = np.frombuffer(packed.buffers()[2], np.uint8)[at[0] : at[-1]].reshape(-1, 10)
    wide = np.zeros((2, len(raw), 8), np.uint8)
    wide[0, :, :5], wide[1, :, :5] = raw[:, :5], raw[:, 5:]
    rest, own = wide.view("<i8")[:, :, 0]
    return rest, own, np.repeat(np.arange(len(packed)), np.diff(at) // 10)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts from rows in the order of buckets: a shingle counts for its classes if it has two or more, here or in one's task."""
    left = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def counted(bucket: np.ndarray, rest: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((own, rest, bucket))
        bucket, rest, own = bucket[order], rest[order], own[order]
        same = (bucket[1:] == bucket[:-1]) & (rest[1:] == rest[:-1])
        # Of rows of one shingle and class the last one has the flag if any has it.
        last = np.append(~(same & (own[1:] // 2 == own[:-1] // 2)), True)
        bucket, rest, own = bucket[last], rest[last], own[last]
        same = (bucket[1:] == bucket[:-1]) & (rest[1:] == rest[:-1])
        classes, count = np.unique(own[np.append(False, same) | np.append(same, False) | (own % 2 == 1)] // 2, return_counts=True)
        return pa.record_batch([pa.array(classes), pa.nulls(len(classes), pa.int64()), pa.array(count)], names=_BEGUN[2:])

    for batch in batches:
        own = batch.filter(batch.column(0).is_valid())
        rest = batch.filter(batch.column(0).is_null())
        if rest.num_rows:
            yield rest.select([2, 3, 4])
        if own.num_rows:
            shingle, group, at = _unpacked(own.column(1))
            rows = [np.concatenate(x) for x in zip(left, (own.column(0).to_numpy()[at], shingle, group))]
            # A bucket that goes on in the next batch is kept back.
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            if cut:
                yield counted(*(x[:cut] for x in rows))
            left = tuple(x[cut:] for x in rows)
    if len(left[0]):
        yield counted(*left)


def _tying(frequent):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ties within the task (class, other) and rows (shingle, n, class) for those over tasks."""
        for shingle, n, group, _, _ in _held(batches, frequent.value, lambda n: n // 4 + 1):
            yield from _handed_on(shingle, n, group)

    return run


def _handed_on(shingle: np.ndarray, n: np.ndarray, group: np.ndarray) -> Iterator[pa.RecordBatch]:
    shingle, n, group, opens = _spread(shingle, n, group)
    pairs = _ties(group, opens)
    if len(pairs):
        yield pa.record_batch([pa.nulls(len(pairs), pa.int64()), pa.nulls(len(pairs), pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=_TYING)
    # Of sets within a factor of 4 / 3 in size, the least and the largest stand for those between.
    step = np.floor(np.log(n) / np.log(4 / 3))
    starts = opens.copy()
    starts[1:] |= step[1:] != step[:-1]
    on = starts | np.append(starts[1:], True)
    yield pa.record_batch([pa.array(shingle[on]), pa.array(n[on]), pa.array(group[on]), pa.nulls(int(on.sum()), pa.int64())], names=_TYING)


_TYING = ["shingle", "n", "class", "other"]


def _tied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ties of rows (shingle, n, class) in order; a shingle's rows may lie in two batches."""
    left: list[np.ndarray] | None = None
    for batch in batches:
        shingle, n, group = (c.to_numpy() for c in batch.columns)
        if not len(n):
            continue
        if left is not None:
            shingle, n, group = (np.concatenate([a, b]) for a, b in zip(left, (shingle, n, group)))
        s, m, g, opens = _spread(shingle, n, group)
        last = int(np.flatnonzero(opens)[-1])
        left = [s[[last, -1]], m[[last, -1]], g[[last, -1]]]  # of the open run, the first row and the last
        pairs = _ties(g, opens)
        if len(pairs):
            yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _of_classes(frequent):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All plain shingles (shingle, class), one row (class, n, quota) for each class, and what _tying gives of the frequent shingles that begin a class."""
        for key, n, group, n_all, classes in _held(batches, frequent.value, lambda n: n):
            first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
            place = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
            plain = key >= 0
            own = np.add.reduceat(plain.astype(np.int64), first) if len(first) else first
            none = lambda k: pa.nulls(k, pa.int64())
            yield pa.record_batch([pa.array(key[plain]), none(int(plain.sum())), pa.array(group[plain]), none(int(plain.sum())), none(int(plain.sum()))], names=_ROWS)
            yield pa.record_batch([none(len(first)), pa.array(n[first]), pa.array(group[first]), none(len(first)), pa.array(n[first] // 4 + 1 - own)], names=_ROWS)
            on = ~plain & (place < n // 4 + 1)
            for made in _handed_on(key[on], n[on], group[on]) if on.any() else ():
                # This quota tells these rows from the others.
                yield pa.record_batch([*made.columns, pa.array(np.full(made.num_rows, -(1 << 40)))], names=_ROWS)

    return run


_ROWS = [*_TYING, "quota"]


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """class, shingle, count of the shingles in two classes or more, from rows (shingle, class) in order."""
    left = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def counted(shingle: np.ndarray, group: np.ndarray) -> pa.RecordBatch:
        fresh = np.append(True, (shingle[1:] != shingle[:-1]) | (group[1:] != group[:-1]))
        shingle, group = shingle[fresh], group[fresh]
        first = np.flatnonzero(np.append(True, shingle[1:] != shingle[:-1]))
        size = np.diff(np.append(first, len(shingle)))
        count = np.repeat(size, size)
        on = count >= 2
        return pa.record_batch([pa.array(group[on]), pa.array(shingle[on]), pa.array(count[on])], names=["class", "shingle", "count"])

    for batch in batches:
        shingle, group = (np.concatenate([a, c.to_numpy()]) for a, c in zip(left, batch.columns))
        if len(shingle):
            cut = int(np.searchsorted(shingle, shingle[-1]))
            if cut:
                yield counted(shingle[:cut], group[:cut])
            left = shingle[cut:], group[cut:]
    if len(left[0]):
        yield counted(*left)


def _begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shingle, n, class) of what begins a class in the order of counts, from rows (class, count, shingle, n, quota) in order, those without a count first."""
    left: pa.RecordBatch | None = None

    def begun(rows: pa.RecordBatch) -> pa.RecordBatch:
        group, n, quota = rows.column(0).to_numpy(), *(c.fill_null(0).to_numpy() for c in rows.columns[3:])
        head = rows.column(1).is_null().to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        size = np.diff(np.append(first, len(group)))
        heads = np.add.reduceat(head.astype(np.int64), first)
        place = np.arange(len(group)) - np.repeat(first + heads, size)
        # Shingles of this class only come before all that it shares.
        on = ~head & (place < np.repeat(size - heads + quota[first], size))
        return pa.record_batch([rows.column(2).filter(pa.array(on)), pa.array(np.repeat(n[first], size)[on]), pa.array(group[on])], names=_TYING[:3])

    for batch in batches:
        rows = batch if left is None else pa.Table.from_batches([left, batch]).combine_chunks().to_batches()[0]
        if rows.num_rows:
            cut = int(np.searchsorted(rows.column(0).to_numpy(), rows.column(0)[-1].as_py()))
            if cut:
                yield begun(rows.slice(0, cut))
            left = rows.slice(cut)
    if left is not None and left.num_rows:
        yield begun(left)


def _narrower(texts: DataFrame) -> DataFrame:
    """node, root of the groups that texts (class, text) fall into when all their shingles are in the order of exact counts.

    The table of frequent shingles is bounded, so in a large corpus many that are common stand among the rare ones in the
    order of hashes, and tie unlike texts to groups that grow faster than the corpus. Here every shingle that is not in the table is
    counted by a shuffle (its rows are few, as the commoner ones are in the table), and a class is tied by its rarest ones only.
    """
    frequent = texts.sparkSession.sparkContext.broadcast(frequent_shingles(texts))
    rows = Table(texts.mapInArrow(tidy(_of_classes(frequent)), "shingle long, n long, class long, other long, quota long"))
    plain = rows.df.where("quota IS NULL").select("shingle", "class")
    shared = plain.repartition("shingle").sortWithinPartitions("shingle", "class").mapInArrow(tidy(_repeated), "class long, shingle long, count long")
    heads = rows.df.where(f"quota > {-(1 << 40)}").select("class", F.lit(None).cast("long").alias("count"), "shingle", "n", "quota")
    none = F.lit(None).cast("long")
    of_class = heads.unionByName(shared.select("class", "count", "shingle", none.alias("n"), none.alias("quota")))
    begun = of_class.repartition("class").sortWithinPartitions("class", F.col("count").asc_nulls_first(), "shingle").mapInArrow(tidy(_begin), "shingle long, n long, class long")
    handed = rows.df.where(f"quota = {-(1 << 40)}")
    order = ["shingle", "n", "class"]
    across = begun.unionByName(handed.where("other IS NULL").select(*order)).repartition("shingle").sortWithinPartitions(*order).mapInArrow(tidy(_tied), "a long, b long")
    out = components(handed.where("other IS NOT NULL").select(F.col("class").alias("a"), F.col("other").alias("b")).union(across))
    rows.drop()
    return out


class PrefixTree:
    """Sets in lexicographic order as a trie with runs of shingles as nodes, kept by levels."""

    def __init__(self, sets: list[np.ndarray], whole: np.ndarray):
        """sets: dense numbers, ascending, of the shingles that stand in more than one set; in lexicographic order. whole: sizes with the other shingles."""
        size = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        at = np.cumsum(size) - size
        shared = [0] * len(sets)
        for k in range(1, len(sets)):
            a, b = sets[k - 1], sets[k]
            m = min(len(a), len(b))
            differ = a[:m] != b[:m]
            d = int(differ.argmax()) if m else 0
            shared[k] = d if m and differ[d] else m
        self.levels = []
        level = [(0, len(sets), 0, -1)]  # first set, end, depth already walked, parent's number in its level
        while level:
            nodes, below = [], []
            for first, end, depth, parent in level:
                to = int(size[first]) if end == first + 1 else min(shared[first + 1 : end])
                nodes.append((first, end, depth, to, parent))
                if end > first + 1:
                    me, start = len(nodes) - 1, first
                    for k in range(first + 1, end):
                        if shared[k] == to:
                            below.append((start, k, to, me))
                            start = k
                    below.append((start, end, to, me))
            first, end, depth, to, parent = (np.array(x, np.int64) for x in zip(*nodes))
            runs = to - depth
            starts = np.cumsum(runs) - runs
            tokens = np.concatenate([flat[at[f] + d : at[f] + t] for f, d, t in zip(first, depth, to)]) if runs.sum() else np.zeros(0, np.int64)
            spans = np.stack([first, end], 1).ravel()
            least = np.minimum.reduceat(np.append(whole, 1 << 40), spans)[::2]
            most, longest = (np.maximum.reduceat(np.append(x, -1), spans)[::2] for x in (whole, size))
            self.levels.append({"first": first, "end": end, "parent": parent, "runs": runs, "starts": starts, "tokens": tokens, "least": least, "most": most, "after": longest - to, "with": longest - depth})
            level = below

    def walk(self, own: np.ndarray, shared: int, n: int, skip: np.ndarray, limit: int) -> np.ndarray:
        """Sets before `limit` and not in `skip` that the set with the marks `own` (`shared` of its n shingles) is linked with."""
        found = []
        overlap_above = np.zeros(1, np.int64)
        alive = np.ones(1, bool)
        for k, level in enumerate(self.levels):
            at = np.flatnonzero(alive[level["parent"]] & (level["first"] < limit)) if k else np.zeros(1, np.int64)
            overlap = overlap_above[level["parent"][at]] if k else np.zeros(1, np.int64)
            need = needed(n, level["least"][at])
            # Sets of other sizes, too few shingles to come, and whole subtrees of the walker's component: no look at their shingles.
            good = (3 * level["least"][at] <= 4 * n) & (4 * level["most"][at] >= 3 * n) & (overlap + np.minimum(shared - overlap, level["with"][at]) >= need)
            good &= skip[level["end"][at]] - skip[level["first"][at]] < level["end"][at] - level["first"][at]
            at, overlap, need = at[good], overlap[good], need[good]
            if not len(at):
                break
            runs, starts = level["runs"][at], level["starts"][at]
            ends = np.cumsum(runs)
            total = int(ends[-1])
            if total:
                marks = np.cumsum(own[level["tokens"][np.repeat(starts - ends + runs, runs) + np.arange(total)]], dtype=np.int64)
                marks = np.append(0, marks)
                overlap = overlap + marks[ends] - marks[ends - runs]
            first = level["first"][at]
            leaf = level["end"][at] == first + 1
            found.append(first[leaf & (overlap >= needed(n, level["most"][at]))])
            go = ~leaf & (overlap + np.minimum(shared - overlap, level["after"][at]) >= need)
            alive = np.zeros(len(level["first"]), bool)
            alive[at[go]] = True
            overlap_above = np.zeros(len(level["first"]), np.int64)
            overlap_above[at] = overlap
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def tree_components(sets: list[np.ndarray], walks: np.ndarray | None = None) -> np.ndarray:
    """The component (a set's number) of each set, by links; walks: the sets whose links are asked for, if not all."""
    whole = np.array([len(s) for s in sets], np.int64)
    out, left = np.arange(len(sets)), np.arange(len(sets))
    shared = sets
    while len(left) > 1:
        # Shingles of one set only cannot be common; sets that they leave with too few others have no link.
        keys, at, count = np.unique(np.concatenate(shared), return_inverse=True, return_counts=True)
        cuts = np.cumsum([len(s) for s in shared])[:-1]
        shared = [s[c >= 2] for s, c in zip(shared, np.split(count[at], cuts))]
        enough = np.array([4 * len(s) for s in shared]) >= 3 * whole[left]
        if enough.all():
            break
        shared, left = [s for s, e in zip(shared, enough) if e], left[enough]
    if len(left) < 2:
        return out
    keys, at, count = np.unique(np.concatenate(shared), return_inverse=True, return_counts=True)
    parts = np.split(at, np.cumsum([len(s) for s in shared])[:-1])
    order = sorted(range(len(parts)), key=lambda k: parts[k].astype(">u4").tobytes())
    ordered, own = [parts[k] for k in order], np.zeros(len(keys), np.int8)
    size = whole[left[order]]
    tree = PrefixTree(ordered, size)
    root = np.arange(len(order))  # by place in the order
    asked = np.arange(len(order)) if walks is None else np.flatnonzero(walks[left[order]])
    # Sets of common shingles walk first, past all others: they gather most of a component, which later walks then leave out.
    common = np.array([count[s].mean() if len(s) else 0.0 for s in ordered])
    hubs = asked[np.argsort(-common[asked], kind="stable")[:HUBS]].tolist()
    for at_most, k in enumerate([*hubs, *asked.tolist()]):
        # Once the hubs have walked, links within the component of most sets join nothing, and others are met from their other end.
        if walks is None and at_most >= len(hubs):
            if at_most == len(hubs):
                main = np.bincount(root).argmax()
            if root[k] == root[main]:
                continue
        same = root == root[k]
        own[ordered[k]] = 1
        met = tree.walk(own, len(ordered[k]), int(size[k]), np.concatenate([[0], np.cumsum(same)]), len(order))
        own[ordered[k]] = 0
        met = met[~same[met]]
        if len(met):
            together = np.isin(root, np.append(root[met], root[k]))
            root[together] = root[together].min()
    out[left[order]] = left[order][root]
    return out


def _commonness(frequent):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """class, group, n, score: the mean rank of a set's shingles, 0 for those that are not frequent."""
        for whole in batches:
            for batch in slices(whole, limit=TOGETHER):
                made = Sets(batch.column("text"), frequent.value)
                rank = np.where(made.key & _TOP > 0, (made.key & ~_TOP) + U64(1), U64(0)).astype(float)
                score = np.bincount(made.row, rank, len(made.n)) / np.maximum(made.n, 1)
                yield pa.record_batch([batch.column("class"), batch.column("group"), batch.column("n"), pa.array(score)], names=["class", "group", "n", "score"])

    return run


def _linked(frequent):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ties (a, b) by links, from rows (group, block, walkers, class, walks, text) in the order of the first four."""
        key, classes, sets, walks = None, [], [], []

        def done() -> Iterator[pa.RecordBatch]:
            if len(classes) > 1 and any(walks):
                root = tree_components(sets, None if all(walks) else np.array(walks))
                pairs = [(c, classes[r]) for c, r in zip(classes, root) if c != classes[r]]
                if pairs:
                    a, b = zip(*pairs)
                    yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for whole in batches:
            for batch in slices(whole, limit=TOGETHER):
                made = Sets(batch.column("text"), frequent.value)
                own = made.classes().tolist()
                heads = zip(*(batch.column(x).to_pylist() for x in ("group", "block", "walkers", "class", "walks")))
                for k, (*now, group, walker) in enumerate(heads):
                    if tuple(now) != key:
                        yield from done()
                        key, classes, sets, walks = tuple(now), [], [], []
                    if own[k] != group:
                        continue  # another row with this id
                    if classes and classes[-1] == group:
                        walks[-1] |= walker
                        continue
                    classes.append(group)
                    sets.append(made.key[made.bounds[k] : made.bounds[k + 1]].copy())
                    walks.append(walker)
        yield from done()

    return run


def _blocks() -> Column:
    """Trees for all sets of a group, from its columns sets and shingles."""
    return F.greatest(F.ceil(F.col("sets") / BLOCK), F.ceil(F.col("shingles") / SHINGLES)).cast("int")


def _of_trees(dealt: DataFrame, frequent) -> DataFrame:  # noqa: ANN001
    keys = ["group", "block", "walkers"]
    rows = dealt.select(*keys, "class", "walks", "text").repartition(*keys).sortWithinPartitions(*keys, "class")
    return written(rows.mapInArrow(tidy(_linked(frequent)), "a long, b long"))


def _of_large_groups(large: DataFrame, frequent) -> DataFrame:  # noqa: ANN001
    """Ties by links of the groups of several blocks; large: class, group, n, blocks, block, text."""
    found: list[DataFrame] = []
    rest = written(large.mapInArrow(tidy(_commonness(frequent)), "class long, group long, n long, score double"))
    before = None
    while not rest.isEmpty():
        counts = rest.groupBy("group").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
        counts = counts.withColumn("parts", _blocks())
        if before is None:
            last = F.col("parts") == 1
        else:
            counts = counts.join(before, "group")
            last = (F.col("parts") == 1) | (F.col("sets") > 0.8 * F.col("sets_before"))
        counts = written(counts.select("group", "sets", "parts", last.alias("last")))
        ranked = rest.withColumn("at", F.row_number().over(Window.partitionBy("group").orderBy(F.desc("score"), "class"))).where(F.col("at") <= HUBS)
        hubs = ranked.join(counts.where("NOT last"), "group").select("class", "group", F.lit(0).alias("walkers"))
        all_left = rest.join(counts.where("last"), "group").select("class", "group", F.pmod(F.xxhash64("class", F.lit("walkers")), "parts").cast("int").alias("walkers"))
        walking = written(hubs.unionByName(all_left))
        trees = counts.select("group", F.when(F.col("last"), F.col("parts")).otherwise(1).alias("parts"))
        staying = large.join(trees, "group").withColumn("walkers", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("walks", F.lit(False))
        walkers = large.drop("block").join(walking.drop("group"), "class").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("walks", F.lit(True))
        columns = ["group", "block", "walkers", "class", "walks", "text"]
        found.append(_of_trees(staying.select(columns).unionByName(walkers.select(columns)), frequent))
        # Links within the largest component of a group join nothing more; all others have a set that has walked or is left.
        going = rest.join(counts.where("NOT last").select("group"), "group").join(walking, "class", "left_anti")
        ties = found[0]
        for more in found[1:]:
            ties = ties.union(more)
        labels = large.select("class", "group").join(components(ties).withColumnRenamed("node", "class"), "class")
        sizes = labels.groupBy("group", "root").agg(F.count("*").alias("sets"))
        main = sizes.groupBy("group").agg(F.max_by("root", F.struct("sets", "root")).alias("root"))
        inside = labels.join(main, ["group", "root"]).select("class")
        before = counts.select("group", F.col("sets").alias("sets_before"))
        rest = written(going.join(inside, "class", "left_anti"))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def jaccard_components(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: the least doc_id that links lead to, itself included."""
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    of_docs = written(docs.mapInArrow(tidy(_named), "doc_id long, n long, class long"))
    begun = docs.mapInArrow(tidy(_begun), "bucket long, packed binary, class long, need long, count long")
    # Rows without a bucket are counts already; any partition will do for them.
    dealt_to = F.coalesce("bucket", "class")
    counts = begun.repartition(dealt_to).sortWithinPartitions("bucket").mapInArrow(tidy(_shared), "class long, need long, count long")
    # Classes that are one in these bits need what the least of them needs.
    left = counts.groupBy("class").agg(F.min("need").alias("need"), F.sum("count").alias("count")).where("count >= need").select(F.col("class").alias("short"))
    holders = of_docs.where("class != 0").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n")).withColumn("short", F.col("class").bitwiseAND(F.lit((1 << 39) - 1)))
    holders = Table(holders.join(left, "short").drop("short"))
    # One text stands for a class; the other rows of its id, if any, have another class.
    kept = Table(docs.where(likely(holders.df, "doc_id")).join(holders.df, "doc_id").select("class", "n", "text"))
    holders.drop()
    texts = kept.df
    frequent = df.sparkSession.sparkContext.broadcast(frequent_shingles(texts.select("class", "text")))
    tying = Table(texts.select("class", "text").mapInArrow(tidy(_tying(frequent)), "shingle long, n long, class long, other long"))
    order = ["shingle", "n", "class"]
    across = tying.df.where("other IS NULL").select(*order).repartition("shingle").sortWithinPartitions(*order).mapInArrow(tidy(_tied), "a long, b long")
    groups = components(tying.df.where("other IS NOT NULL").select(F.col("class").alias("a"), F.col("other").alias("b")).union(across))
    tying.drop()
    n_of = of_docs.where("class != 0").groupBy("class").agg(F.max("n").alias("n"))

    def sizes_of(groups: DataFrame) -> DataFrame:
        sized = groups.withColumnRenamed("node", "class").join(n_of, "class")
        return sized.groupBy("root").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles")).select("root", _blocks().alias("blocks"))

    sizes = written(sizes_of(groups))
    if not sizes.where("blocks > 1").isEmpty():
        # What ties a group that takes several trees is looked at anew.
        wide = written(groups.join(sizes.where("blocks > 1"), "root").select(F.col("node").alias("class")))
        loose = Table(texts.where(likely(wide, "class")).join(wide, "class").select("class", "text"))
        groups = groups.join(sizes.where("blocks = 1").select("root"), "root").select("node", "root").union(_narrower(loose.df).select("node", "root"))
        groups = written(groups)
        loose.drop()
        sizes = sizes_of(groups)
    placed = written(groups.join(sizes, "root").select(F.col("node").alias("class"), F.col("root").alias("group"), "blocks", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block")))
    one = texts.where(likely(placed.where("blocks = 1"), "class")).join(placed.where("blocks = 1"), "class").select("*", F.lit(0).alias("walkers"), F.lit(True).alias("walks"))
    links = _of_trees(one, frequent)
    few, several = placed.where(F.col("blocks").between(2, PAIRED)), placed.where(F.col("blocks") > PAIRED)
    if not few.isEmpty():
        pairs = texts.where(likely(few, "class")).join(few, "class").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        pairs = pairs.withColumns({"block": F.least("block", "other"), "walkers": F.greatest("block", "other"), "walks": F.lit(True)})
        links = links.union(_of_trees(pairs, frequent))
    if not several.isEmpty():
        large = Table(texts.where(likely(several, "class")).join(several, "class"))
        links = links.union(_of_large_groups(large.df, frequent))
        large.drop()
    kept.drop()
    roots = components(links).withColumnRenamed("node", "class")
    # Classes of several documents or with links look their component up; rows of one class or component are dealt to several tasks.
    sole = of_docs.where("class != 0").groupBy("class").agg(F.min("doc_id").alias("own"), F.count("*").alias("rows")).join(roots, "class", "left")
    least = sole.where("root IS NOT NULL").groupBy("root").agg(F.min("own").alias("least"))
    least = split_join(sole.where("rows > 1 OR root IS NOT NULL"), least, "root").select("class", F.coalesce("least", "own").alias("least"))
    out = split_join(of_docs, least, "class")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("class") == 0, F.col("doc_id")).otherwise(F.coalesce("least", "doc_id")).alias("component_id"))

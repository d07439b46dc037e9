"""Exact top-k search: an inverted index with block-max WAND pruning for BM25, by shards, with global statistics.

A shard is an index of up to SHARD documents and POSTINGS postings, built where they are read: terms in the order of their hashes, and for
each the documents and term frequencies in document order. Documents of a shard are put in the order of clusters (a few
rounds of spherical k-means over its commonest words), so that a block, up to BLOCK neighbours of one cluster, holds
texts of one language or one kind.

A query is the distinct terms of a text with their document frequencies over all shards (counted by a shuffle of each
shard's terms); packs of PACK queries share one list of terms. On a shard all posting lists are cut at the blocks, each
with the greatest weight of every term in it. The pivot of a query is chosen from these maxima: of the blocks whose
summed maxima can reach its k-th best score so far, the one of the greatest sum; all its cursors skip to that block,
and it is done when no block can reach that score. (Cursors that all stand at one pivot block take the place of a pivot
for each document: a query is a whole text of some hundred terms, of which most documents of its language hold some.)
Queries that stand at one block are scored together: its commonest terms are a dense matrix, the others posting lists.
The product of the dense part is in single precision and only tells which documents may be among the k best, with a
margin for its rounding; these are scored in full. The best k of every task are merged by one window. Nothing is
approximate: maxima are exact, and all statistics cover all documents.

    score = sum over terms of ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))

Scores are rounded to 6 places; ties go to the lesser doc_id. A query meets its own document too. Null and empty texts
match nothing and find nothing. Repeated rows are found as often as they stand there. Rows without an id are no
documents and no queries; texts of one query id are one query. Each shard meets each query: the work grows with queries times shards, as it must for an
exact answer. Shards and packs meet by a Cartesian product that reads both from the shared folder, so that neither is
shuffled. A task holds one shard and one pack at a time and carries the best scores of its pack from shard to shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import NOT_ALNUM, U64, Words, give_back, slices, tidy, written

K1, B = 1.2, 0.75
SHARD, BLOCK, WIDE = 32_768, 32_768, 512
#: Postings that a shard holds at most, but for those of its last few texts (some 40 bytes each while it is built).
POSTINGS = 3 << 20
#: Queries and terms (a query's distinct ones) of a pack at most, but for its last query.
PACK, PACK_TERMS = 4096, 1 << 21
#: Terms of queries that meet a shard at once, queries that meet a block at once, their scores, and postings that are added at once, or those of one query.
ASKED, AT_ONCE, CELLS, ADDED = 1 << 17, 256, 1 << 21, 1 << 17
#: Documents of a block that are bounded together.
STRETCH = 8
#: Share of a block's documents from which a term is in its dense matrix (of WIDE terms at most); below, posting lists are quicker.
DENSE = 0.08
#: Common words that clusters are found by, clusters to begin with, the cosine from which two become one, and that below which a document is of none.
COMMON, CLUSTERS, ALIKE, FAR = 256, 16, 0.5, 0.3
#: Single precision errs by less than (WIDE + 8) * 2 ** -24 of a score (all terms are positive): a third of this.
MARGIN = 1e-4
_INDEX = "shard long, n_docs long, length long, doc_ids binary, doc_lengths binary, blocks binary, terms binary, counts binary, docs binary, freqs binary"
_COLUMNS = [x.split()[0] for x in _INDEX.split(", ")]
_PACKS = "pack long, query_ids binary, sizes binary, query_terms binary, dfs binary, numbers binary"


def _pairs(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, frequency) of all rows, and the lengths of the rows."""
    words = Words(arr, lower=True, between=NOT_ALNUM)
    length = np.diff(words.bounds)
    row = np.repeat(np.arange(len(length)), length)
    order = np.lexsort((words.hash, row))
    term, row = words.hash[order], row[order]
    first = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (row[1:] != row[:-1]))) if len(term) else np.zeros(0, np.int64)
    return row[first], term[first], np.diff(np.append(first, len(term))), length


def _narrow(x: np.ndarray) -> bytes:
    """Whole numbers from 0 in 1, 2 or 4 bytes each."""
    most = int(x.max(initial=0))
    return x.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4").tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    """n numbers of `_narrow`."""
    return np.frombuffer(raw, {1: "<u1", 2: "<u2", 4: "<u4"}[len(raw) // n] if n else "<u1")


def _clusters(row: np.ndarray, begin: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """A cluster for each of n documents; row: the documents of each term in a row, begin and size: where a term's lie."""
    common = np.argsort(-size, kind="stable")[:COMMON]
    x = np.zeros((n, max(len(common), 1)), np.float32)
    for k, t in enumerate(common.tolist()):
        x[row[begin[t] : begin[t] + size[t]], k] = np.log(1 + n / size[t])
    norm = np.sqrt((x * x).sum(1))
    some = np.flatnonzero(norm > 0)
    if not len(some):
        return np.zeros(n, np.int64)
    x /= np.maximum(norm, 1e-9)[:, None]
    unit = lambda c: c / np.maximum(np.sqrt((c * c).sum(1)), 1e-9)[:, None]
    centres, near = [x[some[0]]], x[some] @ x[some[0]]
    while len(centres) < CLUSTERS and near.min() < ALIKE:
        centres.append(x[some[near.argmin()]])
        near = np.maximum(near, x[some] @ centres[-1])
    c = np.array(centres)
    for _ in range(8):
        own = np.zeros((n, len(c)), np.float32)
        own[some, (x[some] @ c.T).argmax(1)] = 1
        c = unit(own.T @ x)
    near = x @ c.T
    label, near, count = near.argmax(1), near.max(1), own.sum(0)
    # Clusters alike are one; small ones are one too, with all documents that are far from their centre.
    to = np.arange(len(c))
    for a in range(len(c)):
        for b in np.flatnonzero(c[a] @ c.T >= ALIKE).tolist():
            to[to == to[b]] = to[a]
    count = np.bincount(to, count, len(c))[to]
    to[count < n / 64] = len(c)
    return np.where(near < FAR, len(c), to[label])


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    shard, held, docs, postings = TaskContext.get().partitionId() << 24, [], 0, 0

    def index() -> pa.RecordBatch:
        base = np.cumsum([0, *[len(h[0]) for h in held]])
        ids, length = np.concatenate([h[0] for h in held]), np.concatenate([h[4] for h in held])
        row = np.concatenate([h[1] + np.uint32(a) for h, a in zip(held, base)])
        term, freq = np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held])
        held.clear()
        order = np.argsort(term, kind="stable")  # in each term by document
        row, term, freq = row[order], term[order], freq[order]
        at = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
        size, term = np.diff(np.append(at, len(term))), term[at]
        cluster = _clusters(row, at, size, len(ids))
        new = np.lexsort((ids, cluster))
        place = np.empty(len(ids), U64)
        place[new] = np.arange(len(ids), dtype=U64)
        order = np.argsort(np.repeat(np.arange(len(at), dtype=U64) << U64(32), size) | place[row])
        row, freq = place[row[order]], freq[order]
        blocks = [min(BLOCK, n - a) for n in np.bincount(cluster).tolist() for a in range(0, n, BLOCK)]
        raw = [ids[new].astype("<i8").tobytes(), length[new].astype("<i8").tobytes(), np.array(blocks, "<u4").tobytes(), term.astype("<u8").tobytes(), size.astype("<u4").tobytes(), _narrow(row), _narrow(freq)]
        values = [shard, len(ids), int(length.sum()), *raw]
        return pa.record_batch([pa.array([v], pa.int64() if isinstance(v, int) else pa.binary()) for v in values], names=_COLUMNS)

    for whole in batches:
        for batch in slices(whole):
            row, term, freq, length = _pairs(batch.column(1))
            held.append((batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), row.astype(np.uint32), term, freq.astype(np.uint32), length))
            docs, postings = docs + len(length), postings + len(term)
            if docs >= SHARD or postings >= POSTINGS:
                yield index()
                shard, docs, postings = shard + 1, 0, 0
                give_back()
    if held:
        yield index()


def _tasks(df: DataFrame) -> int:
    """Twice the cores, or 12: parts that are read in one task make one shard, or as many full ones as they give."""
    return max(12, 2 * df.sparkSession.sparkContext.defaultParallelism)


def build_index(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The shards of df's documents, one row each, written to the shared folder."""
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    docs = docs.where(F.col("doc_id").isNotNull()).coalesce(_tasks(df))
    return written(docs.mapInArrow(tidy(_indexed), _INDEX), rows=1)


def _parts(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of ranges in a row."""
    ends = np.cumsum(size, dtype=np.int64)
    return np.repeat(begin - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)


def _cuts(size: np.ndarray, most: int) -> list[int]:
    """Where stretches of sizes begin that sum to at most `most`, or are one size; the end is the last cut."""
    ends, cuts = np.cumsum(size, dtype=np.int64), [0]
    while cuts[-1] < len(size):
        before = int(ends[cuts[-1] - 1]) if cuts[-1] else 0
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, before + most, "right"))))
    return cuts


def _best(k: int, query: np.ndarray, score: np.ndarray, doc_id: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query, in the order of query, score (the greatest first) and doc_id."""
    order = np.lexsort((doc_id, -score, query))
    query, score, doc_id = query[order], score[order], doc_id[order]
    first = np.searchsorted(query, query)
    kept = np.arange(len(query)) - first < k
    return query[kept], score[kept], doc_id[kept]


class _Block:
    """Documents from `begin` to `end`, with the dense matrix of their commonest terms."""

    def __init__(self, begin: int, end: int):
        self.begin, self.end, self.n = begin, end, end - begin
        self.weight = np.zeros((0, self.n), np.float32)
        self.freq = np.zeros((self.n, 0), np.uint16)


class Shard:
    def __init__(self, row: dict, average: float):
        read = lambda name, kind: np.frombuffer(row[name], kind)
        self.ids, length = read("doc_ids", "<i8"), read("doc_lengths", "<i8")
        self.terms, counts = read("terms", "<u8"), read("counts", "<u4").astype(np.int64)
        postings = int(counts.sum())
        self.docs, self.freqs = _wide(row["docs"], postings), _wide(row["freqs"], postings)
        self.norm = K1 * (1 - B + B * length / average)
        n = len(self.ids)
        sizes = read("blocks", "<u4").tolist() if "blocks" in row else [min(BLOCK, n - a) for a in range(0, n, BLOCK)]
        ends = np.cumsum([0, *sizes]).tolist()
        self.blocks = [_Block(a, b) for a, b in zip(ends, ends[1:])]
        block_of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        # Runs of a term's postings in one block, with their greatest weight, some hundred thousand postings at a time; those of the cuts are two.
        self.until, pieces = np.cumsum(counts), []
        for own, owner in self._pieces():
            place = block_of[self.docs[own]]
            first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (place[1:] != place[:-1])))
            pieces.append((owner[first], place[first], np.maximum.reduceat(self.weights(own), first), (first + own.start).astype(np.int32), np.diff(np.append(first, len(place))).astype(np.int32)))
        empty = [np.zeros(0, t) for t in (np.int32, np.int32, float, np.int32, np.int32)]
        owner, self.place, self.most, self.begin, self.size = (np.concatenate(x) for x in zip(empty, *pieces))
        self.term_runs = np.searchsorted(owner, np.arange(len(counts) + 1))
        self.column = np.full(len(owner), -1, np.int16)  # of a run in its block's matrix
        for k, block in enumerate(self.blocks):
            self._dense(block, np.flatnonzero((self.place == k) & (self.size >= DENSE * block.n)))

    def _pieces(self) -> Iterator[tuple[slice, np.ndarray]]:
        """All postings, a part at a time, and the number of the term of each."""
        for a in range(0, len(self.docs), 1 << 18):
            own = slice(a, min(a + (1 << 18), len(self.docs)))
            lo, hi = np.searchsorted(self.until, [own.start, own.stop - 1], "right").tolist()
            inside = np.diff(np.minimum(self.until[lo : hi + 1], own.stop), prepend=own.start)
            yield own, np.repeat(np.arange(lo, hi + 1, dtype=np.int32), inside)

    def weights(self, postings: slice) -> np.ndarray:
        freq = self.freqs[postings].astype(float)
        return freq * (K1 + 1) / (freq + self.norm[self.docs[postings]])

    def _dense(self, block: _Block, runs: np.ndarray) -> None:
        runs = np.sort(runs[np.argsort(-self.size[runs], kind="stable")[:WIDE]])
        # Frequencies that two bytes do not hold stay in their lists.
        runs = runs[[int(self.freqs[self.begin[r] : self.begin[r] + self.size[r]].max()) < 1 << 16 for r in runs.tolist()]] if self.freqs.itemsize > 2 else runs
        block.weight = np.zeros((len(runs), block.n), np.float32)
        block.freq = np.zeros((block.n, len(runs)), self.freqs.dtype if self.freqs.itemsize < 2 else np.uint16)
        self.column[runs] = np.arange(len(runs))
        for h, r in enumerate(runs.tolist()):
            own = slice(self.begin[r], self.begin[r] + self.size[r])
            docs = self.docs[own].astype(np.int64) - block.begin
            block.weight[h, docs] = self.weights(own)
            block.freq[docs, h] = self.freqs[own]

    def best(self, terms: np.ndarray, idf: np.ndarray, k: int) -> list[tuple[float, int]]:
        """(-score, doc_id) of the k best of this shard; terms in the order of their hashes."""
        number = self.valued(terms, idf)
        _, score, doc_id = self.best_of(np.zeros(len(terms), np.int64), number, np.full(1, -1.0), k)
        return list(zip((-score).tolist(), doc_id.tolist()))

    def valued(self, terms: np.ndarray, idf: np.ndarray) -> np.ndarray:
        """Takes the idf of the terms to be asked for; the numbers of these terms in this shard, -1 of those that it does not hold."""
        number = np.full(len(terms), -1)
        if len(self.terms):
            at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
            number = np.where(self.terms[at] == terms, at, -1)
        self.idf = np.zeros(len(self.terms))
        self.idf[number[number >= 0]] = idf[number >= 0]
        self.value = np.empty(len(self.docs))  # what a posting gives to a score
        for own, owner in self._pieces():
            self.value[own] = self.weights(own) * self.idf[owner]
        return number

    def best_of(self, query: np.ndarray, term: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query, score and doc_id of the k best of this shard for each query, if they reach `least` of it (-1: all).

        query and term (a number of `valued`): of each term of each query, in the order of queries and terms.
        """
        query, term = query[term >= 0], term[term >= 0]
        size = self.term_runs[term + 1] - self.term_runs[term]
        runs, query, idf = _parts(self.term_runs[term], size), np.repeat(query, size), np.repeat(self.idf[term], size)
        place, m, n = self.place[runs], len(self.blocks), len(least)
        bound = np.bincount(query * m + place, idf * self.most[runs], n * m).astype(float, copy=False).reshape(n, m)
        pivots = np.argsort(-bound, axis=1, kind="stable")
        bound = np.take_along_axis(bound, pivots, 1)
        # Terms of each block in the order of queries, and where those of a query begin.
        of_block = np.argsort(place, kind="stable")
        until = np.searchsorted(place[of_block], np.arange(m + 1))
        asked = []
        for b in range(m):
            own = of_block[until[b] : until[b + 1]]
            asked.append((runs[own], idf[own], np.searchsorted(query[own], np.arange(n + 1))))
        least, found = least.copy(), (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        for turn in range(m):
            open_ = (bound[:, turn] > 0) & (bound[:, turn] + 1e-5 >= least)
            if not open_.any():
                break
            more = [found]
            for b in np.unique(pivots[open_, turn]).tolist():
                block, own = self.blocks[b], np.flatnonzero(open_ & (pivots[:, turn] == b))
                for a in range(0, len(own), step := max(1, min(AT_ONCE, CELLS // block.n))):
                    now = own[a : a + step]
                    q, score, doc = self._scored(block, *asked[b], now, least[now], k)
                    more.append((now[q], score, doc))
            found = _best(k, *(np.concatenate(x) for x in zip(*more)))
            full = np.flatnonzero(np.bincount(found[0], minlength=n) >= k)
            least[full] = np.maximum(least[full], found[1][np.searchsorted(found[0], full, "right") - 1])
        return found

    def _stretches(self, block: _Block, query: np.ndarray, runs: np.ndarray, n: int) -> np.ndarray:
        """What the runs of each of n queries give to a stretch of STRETCH documents of the block, all in all."""
        of = -(-block.n // STRETCH)
        out, begin, size = np.zeros((n, of)), np.searchsorted(query, np.arange(n + 1)), self.size[runs]
        cuts = _cuts(np.diff(np.append(0, np.cumsum(size, dtype=np.int64))[begin]), ADDED)
        for a, b in zip(cuts, cuts[1:]):
            own = slice(begin[a], begin[b])
            if begin[a] < begin[b]:
                post = _parts(self.begin[runs[own]], size[own])
                key = (self.docs[post].astype(np.int64) - block.begin) // STRETCH + np.repeat((query[own] - a) * of, size[own])
                out[a:b] = np.bincount(key, self.value[post], (b - a) * of).reshape(b - a, of)
        return out

    def _listed(self, block: _Block, runs: np.ndarray) -> np.ndarray:
        """What the runs of one query give to the score of each document of the block."""
        post = _parts(self.begin[runs], self.size[runs])
        return np.bincount(self.docs[post], self.value[post], block.end)[block.begin :].astype(float, copy=False)

    def _scored(self, block: _Block, runs: np.ndarray, idf: np.ndarray, begin: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query (a place in `queries`), score and doc_id of the k best of a block for each query, if they may reach `least` of it.

        runs and idf: of the terms of all queries in the block, those of a query from its `begin`.
        """
        size = begin[queries + 1] - begin[queries]
        own, query = _parts(begin[queries], size), np.repeat(np.arange(len(queries)), size)
        runs, idf = runs[own], idf[own]
        column = self.column[runs]
        dense, sparse = column >= 0, column < 0
        asked = np.zeros((len(queries), len(block.weight)))
        asked[query[dense], column[dense]] = idf[dense]
        top = np.bincount(query[dense], idf[dense] * self.most[runs[dense]], len(queries))
        runs, query = runs[sparse], query[sparse]
        begin = np.searchsorted(query, np.arange(len(queries) + 1))
        reach = np.maximum(least * (1 - MARGIN) - 1e-5, 1e-30)
        heavy, found = (top >= reach).tolist(), []
        # Where all terms of the matrix cannot reach `least`, a block without a stretch whose lists give the rest is skipped,
        light = np.flatnonzero(top < reach)
        here = top[query] < reach[query]
        rank = np.cumsum(top < reach) - 1
        doubtful = self._stretches(block, rank[query[here]], runs[here], len(light)).max(1, initial=0) >= (reach - top)[light]
        # and where few documents are left, they need no product.
        for q in light[doubtful].tolist():
            rest = self._listed(block, runs[begin[q] : begin[q + 1]])
            doc = np.flatnonzero(rest >= reach[q] - top[q])
            heavy[q] = len(doc) > block.n // 64
            if not heavy[q]:
                found.append((q, doc, rest[doc]))
        heavy = np.flatnonzero(heavy)
        product, step = asked[heavy].astype(np.float32) @ block.weight, min(64, block.n // (4 * k))
        for q, total in zip(heavy.tolist(), product):
            rest = self._listed(block, runs[begin[q] : begin[q + 1]])
            total = total + rest
            if step and least[q] < 0:  # of the maxima of stretches of documents the k-th is no more than the k-th best score
                most = total[: block.n // step * step].reshape(-1, step).max(1)
                reach[q] = max(reach[q], np.partition(most, -k)[-k] * (1 - MARGIN) - 1e-5)
            doc = np.flatnonzero(total >= reach[q])
            found.append((q, doc, rest[doc]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        q, doc, score = np.repeat([x[0] for x in found], [len(x[1]) for x in found]), *(np.concatenate([x[c] for x in found]) for c in (1, 2))
        for a in range(0, len(q) if len(block.weight) else 0, 2048):
            own = slice(a, a + 2048)
            freq = block.freq[doc[own]].astype(float)
            score[own] += np.einsum("ij,ij->i", freq * (K1 + 1) / (freq + self.norm[block.begin + doc[own], None]), asked[q[own]])
        return _best(k, q, np.round(score, 6), self.ids[block.begin + doc])


def top_k(queries: DataFrame, index: DataFrame, k: int = 10, query_id: str = "doc_id", text: str = "text") -> DataFrame:
    """query_id, rank, doc_id, score: the k best documents of the index for each query."""
    size = index.agg(F.sum("n_docs").alias("n"), F.sum("length").alias("length")).first()
    n, average = size.n or 0, max((size.length or 0) / max(size.n or 0, 1), 1e-9)

    def terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                term, count = (np.frombuffer(batch.column(c)[row].as_py(), t) for c, t in ((0, "<u8"), (1, "<u4")))
                yield pa.record_batch([pa.array(term.view(np.int64)), pa.array(count.astype(np.int64))], names=["term", "df"])

    def query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                row, term, _, _ = _pairs(batch.column(1))
                yield pa.record_batch([pa.array(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)[row]), pa.array(term.view(np.int64))], names=["query_id", "term"])

    asked = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(text).cast("string").alias("text")).where(F.col("query_id").isNotNull())
    asked = written(asked.mapInArrow(tidy(query_terms), "query_id long, term long").distinct())
    df = index.select("terms", "counts").mapInArrow(tidy(terms_of), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    # Of a query its terms in a row, with their frequencies: no more than its text.
    each = asked.join(df, "term").groupBy("query_id").agg(F.collect_list(F.struct("term", "df")).alias("x"))
    each = written(each.select("query_id", F.col("x.term").alias("query_terms"), F.col("x.df").alias("dfs")))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pack, held, terms = TaskContext.get().partitionId() << 24, [], 0

        def row() -> pa.RecordBatch:
            ids, sizes = (np.array(x) for x in zip(*((h[0], len(h[1])) for h in held)))
            term, df = (np.concatenate([h[c] for h in held]) for c in (1, 2))
            distinct, first, number = np.unique(term.view(U64), return_index=True, return_inverse=True)
            number = number[np.lexsort((number, np.repeat(np.arange(len(ids)), sizes)))]
            values = [pack, ids.astype("<i8").tobytes(), sizes.astype("<u4").tobytes(), distinct.astype("<u8").tobytes(), df[first].astype("<i8").tobytes(), number.astype("<u4").tobytes()]
            return pa.record_batch([pa.array([v], pa.int64() if isinstance(v, int) else pa.binary()) for v in values], names=[x.split()[0] for x in _PACKS.split(", ")])

        for batch in batches:
            for i in range(batch.num_rows):
                held.append((batch.column(0)[i].as_py(), *(batch.column(c)[i].values.to_numpy() for c in (1, 2))))
                terms += len(held[-1][1])
                if len(held) >= PACK or terms >= PACK_TERMS:
                    yield row()
                    pack, terms = pack + 1, 0
                    held.clear()
        if held:
            yield row()

    packs = written(each.coalesce(max(1, -(-each.count() // PACK))).mapInArrow(tidy(packed), _PACKS), rows=1)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # by pack: number of the query, score, doc_id
        least: dict[int, np.ndarray] = {}
        query_ids: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: x[i].as_buffer() if pa.types.is_binary(x.type) else x[i].as_py() for c, x in zip(batch.schema.names, batch.columns)}
                shard = Shard(row, average)
                pack, ids, sizes = row["pack"], np.frombuffer(row["query_ids"], "<i8"), np.frombuffer(row["sizes"], "<u4")
                df, number = np.frombuffer(row["dfs"], "<i8"), np.frombuffer(row["numbers"], "<u4")
                term = shard.valued(np.frombuffer(row["query_terms"], "<u8"), np.log(1 + (n - df + 0.5) / (df + 0.5)))
                if pack not in found:
                    found[pack], least[pack], query_ids[pack] = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)), np.full(len(ids), -1.0), ids.copy()
                ends, cuts, more = np.cumsum([0, *sizes]), _cuts(sizes, ASKED), [found[pack]]
                for a, b in zip(cuts, cuts[1:]):
                    own = number[ends[a] : ends[b]]
                    q, score, doc = shard.best_of(np.repeat(np.arange(b - a), sizes[a:b]), term[own], least[pack][a:b], k)
                    more.append((q + a, score, doc))
                found[pack] = q, score, _ = _best(k, *(np.concatenate(x) for x in zip(*more)))
                full = np.flatnonzero(np.bincount(q, minlength=len(ids)) >= k)
                least[pack][full] = score[np.searchsorted(q, full, "right") - 1]
                shard = row = ids = sizes = df = number = own = None  # before the next one is read
            batch = None
            give_back()
        for pack, (q, score, doc) in found.items():
            yield pa.record_batch([pa.array(query_ids[pack][q]), pa.array(doc), pa.array(score)], names=["query_id", "doc_id", "score"])

    pairs = index.coalesce(_tasks(index)).crossJoin(packs.hint("shuffle_replicate_nl"))
    found = written(pairs.mapInArrow(tidy(search), "query_id long, doc_id long, score double"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")).cast("long"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")

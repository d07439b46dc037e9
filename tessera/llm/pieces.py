"""SentencePiece encoding with merge-dropout, and decoding.

Encoding merges neighbouring symbols in the order of the vocabulary's scores (the agenda). A candidate merge is
skipped when a keyed hash of the seed, the text's key, and the place of the two symbols falls under `dropout`; the
same seed gives the same pieces on every machine and retry. Whatever is skipped, the pieces spell the text, so that
decoding gives it back; but U+2581, which stands for a space in pieces, comes back as a space. dropout = 0 gives the library's own pieces.

Pieces never continue over the beginning of a run of spaces, so texts are cut there. A worker keeps the pieces and the
merges of each distinct chunk without dropout. The hash is keyed by the text's key and the chunk's number, for every
occurrence: where it skips none of the kept merges the kept pieces stand (a candidate that is never merged changes
nothing), and all other occurrences are encoded anew: short chunks side by side in numpy, one merge of each in a step;
long ones by a heap.

Texts are encoded where they lie: no shuffle. Null and empty texts have no pieces; repeated rows have equal pieces;
memory is that of a batch of at most 2 MB, or one text.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import IdStore, U64, mix, powers, slices, strings, tidy

SPACE = 0x2581
LONG = 40
#: Distinct chunks that a worker keeps while it runs a task (about 60 bytes each).
KEPT, KEPT_IDS = 1_000_000, 16_000_000
_NONE = np.int64(1) << 60
_MODELS: dict[str, "Vocabulary"] = {}


class Vocabulary:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(self.size)]
        plain = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(self.size)]
        number = {p: i for i, p in enumerate(pieces) if plain[i]}
        self.rank = np.array([-sp.get_score(i) for i in range(self.size)]).argsort(kind="stable").argsort().astype(np.int64)
        self.ranks = self.rank.tolist()
        self.byte = np.zeros(256, np.int64)
        for i, p in enumerate(pieces):
            if sp.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
        self.char = np.full(0x110000, -1, np.int64)
        merges = {}
        for p, i in number.items():
            if len(p) == 1:
                self.char[ord(p)] = i
            for k in range(1, len(p)):
                if p[:k] in number and p[k:] in number:
                    merges[number[p[:k]] * self.size + number[p[k:]]] = i
        self.merges = merges
        spelled = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() if plain[i] else b"" for i, p in enumerate(pieces)]
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_size = np.array([len(x) for x in spelled], np.int64)
        self.spelled_at = np.cumsum(self.spelled_size) - self.spelled_size
        # Merges by an open hash table: a pair's slot, or one of those after it.
        self.slots = 1 << 20
        self.slot_key, self.slot_piece = np.full(self.slots, -1, np.int64), np.zeros(self.slots, np.int64)
        for key, piece in merges.items():
            at = (key * 0x9E3779B97F4A7C15 >> 40) % self.slots
            while self.slot_key[at] >= 0:
                at = (at + 1) % self.slots
            self.slot_key[at], self.slot_piece[at] = key, piece

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two pieces make, or -1."""
        key = left * self.size + right
        at = ((key.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(40)).astype(np.int64) % self.slots
        out = np.full(len(key), -1, np.int64)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        while len(todo):
            have = self.slot_key[at[todo]]
            hit = have == key[todo]
            out[todo[hit]] = self.slot_piece[at[todo[hit]]]
            todo = todo[(have >= 0) & ~hit]
            at[todo] = (at[todo] + 1) % self.slots
        return out


def _skipped(key: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray, limit: int) -> np.ndarray:
    where = (start.astype(U64) << U64(42)) ^ (middle.astype(U64) << U64(21)) ^ end.astype(U64)
    return mix(key ^ mix(where + U64(1))) < U64(limit)


_M64 = (1 << 64) - 1


def _mixed(x: int) -> int:
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _M64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _M64
    return x ^ (x >> 31)


def _by_heap(v: Vocabulary, symbols: list[int], key: int, limit: int, merges: list[tuple[int, int, int]] | None = None) -> list[tuple[int, int, int]]:
    """(piece or -1, start, end) of one chunk; its merges (start, middle, end) are put to `merges`."""
    n = len(symbols)
    piece, end, after, before = list(symbols), list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    agenda: list[tuple[int, int, int, int]] = []
    rank = v.ranks

    def offer(i: int) -> None:
        j = after[i] if i >= 0 else n
        if i < 0 or j >= n or piece[i] < 0 or piece[j] < 0:
            return
        made = v.merges.get(piece[i] * v.size + piece[j], -1)
        if made >= 0 and not (limit and _mixed(key ^ _mixed((((i << 42) & _M64) ^ ((j << 21) & _M64) ^ end[j]) + 1 & _M64)) < limit):
            heapq.heappush(agenda, (rank[made], i, j, end[j]))

    for i in range(n):
        offer(i)
    alive = [True] * n
    while agenda:
        _, i, j, to = heapq.heappop(agenda)
        if not (alive[i] and j < n and alive[j] and after[i] == j and end[j] == to):
            continue
        if merges is not None:
            merges.append((i, j, to))
        piece[i], end[i], after[i], alive[j] = v.merges[piece[i] * v.size + piece[j]], end[j], after[j], False
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        offer(before[i])
    return [(piece[i], i, end[i]) for i in range(n) if alive[i]]


def _side_by_side(v: Vocabulary, symbols: np.ndarray, sizes: np.ndarray, keys: np.ndarray, limit: int, merges: list[tuple[np.ndarray, ...]] | None = None) -> tuple[np.ndarray, ...]:
    """(chunk, piece or -1, start, end) of all chunks, each in its order; merges (chunk, start, middle, end) are put to `merges`."""
    chunk = np.repeat(np.arange(len(sizes)), sizes)
    start = np.arange(len(symbols)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    end, done = start + 1, []
    piece = symbols.copy()
    made = np.full(len(piece), -1, np.int64)
    fresh = np.arange(len(piece))
    while len(piece):
        # Candidates whose left or right symbol is new; the others stand from the step before.
        i = fresh[fresh + 1 < len(piece)]
        i = i[chunk[i] == chunk[i + 1]]
        made[fresh] = -1
        made[i] = v.merged(piece[i], piece[i + 1])
        if limit:
            i = i[made[i] >= 0]
            made[i[_skipped(keys[chunk[i]], start[i], start[i + 1], end[i + 1], limit)]] = -1
        order = np.where(made >= 0, (v.rank[made] << 24) | start, _NONE)
        heads = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1]))
        best = np.minimum.reduceat(order, heads)
        going = best < _NONE
        size = np.diff(np.append(heads, len(piece)))
        stay = np.repeat(going, size)
        if not going.all():
            done.append((chunk[~stay], piece[~stay], start[~stay], end[~stay]))
            if not going.any():
                break
        at = np.flatnonzero(order == np.repeat(best, size))
        at = at[stay[at]]
        if merges is not None:
            merges.append((chunk[at], start[at], start[at + 1], end[at + 1]))
        piece[at], end[at] = made[at], end[at + 1]
        keep = stay
        keep[at + 1] = False
        new = np.zeros(len(piece), bool)
        new[at] = True
        new[np.maximum(at - 1, 0)] = True
        # The symbol before a merged one may be of another chunk; offering it again does no harm.
        chunk, piece, start, end, made, new = (x[keep] for x in (chunk, piece, start, end, made, new))
        fresh = np.flatnonzero(new)
    if not done:
        return (np.zeros(0, np.int64),) * 4
    chunk, piece, start, end = (np.concatenate(x) for x in zip(*done))
    order = np.lexsort((start, chunk))
    return chunk[order], piece[order], start[order], end[order]


class Encoder:
    def __init__(self, vocabulary: Vocabulary, dropout: float, seed: int):
        self.v, self.seed = vocabulary, seed
        self.store, self.merges = IdStore(KEPT, KEPT_IDS), IdStore(KEPT, KEPT_IDS)
        self.limit = min(int(dropout * 2**64), 2**64 - 1)

    def encode(self, texts: list[str], keys: list[str]) -> list[np.ndarray]:
        """The piece ids of each text; `keys` name the texts for the hash."""
        v = self.v
        whole = "".join("▁" + t.replace(" ", "▁") for t in texts if t)
        code = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        length = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        bounds = np.concatenate([[0], np.cumsum(length)])
        if not len(code):
            return [np.zeros(0, np.uint32) for _ in texts]
        space = code == SPACE
        opens = space.copy()
        opens[1:] &= ~space[:-1]
        opens[bounds[:-1][length > 0]] = True
        at = np.flatnonzero(opens)
        to = np.append(at[1:], len(code))
        text_of = np.searchsorted(bounds, at, "right") - 1
        number = np.arange(len(at)) - np.searchsorted(at, bounds[:-1])[text_of]
        total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(code.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(7)) * powers(len(code))[0])])
        name = mix((total[to] - total[at]) * powers(len(code))[1][at] + (to - at).astype(U64))
        names, first, which = np.unique(name, return_index=True, return_inverse=True)
        if self.merges.used > KEPT_IDS:  # three numbers for each merge
            self.store.clear()
        new = self.store.missing(names)
        if len(self.store.keys) == 0:  # both start anew together
            self.merges.clear()
        if new.any():
            x, y = at[first[new]], to[first[new]]
            ids, size, merges, many = self._chunks(code, x, y, np.zeros(len(x), U64), 0)
            self.store.add(names[new], ids, size)
            if self.limit:
                self.merges.add(names[new], merges, many)
        flat, ends = self.store.gather(names, which)
        if self.limit:
            own = np.array([_text_key(k, self.seed) for k in keys], U64)
            key = mix(own[text_of] + mix(number.astype(U64) + U64(1)))
            flat, ends = self._dropped(code, at, to, key, names, which, flat, ends)
        cut = ends[np.searchsorted(at, bounds)]
        return [flat[x:y] for x, y in zip(cut[:-1], cut[1:])]

    def _dropped(self, code: np.ndarray, at: np.ndarray, to: np.ndarray, key: np.ndarray, names: np.ndarray, which: np.ndarray, flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The kept ids of all occurrences, but those of which a merge is skipped encoded with their own key."""
        merges, till = self.merges.gather(names, which)
        start, middle, end = (x.astype(np.int64) for x in merges.reshape(-1, 3).T)
        of = np.repeat(np.arange(len(at)), np.diff(till) // 3)
        hit = np.zeros(len(at), bool)
        hit[of[_skipped(key[of], start, middle, end, self.limit)]] = True
        changed = np.flatnonzero(hit)
        if not len(changed):
            return flat, ends
        ids, size, _, _ = self._chunks(code, at[changed], to[changed], key[changed], self.limit)
        old = np.diff(ends)
        sizes = old.copy()
        sizes[changed] = size
        out = np.zeros(int(sizes.sum()), np.uint32)
        anew = np.repeat(hit, sizes)
        out[anew], out[~anew] = ids, flat[~np.repeat(hit, old)]
        return out, np.concatenate([[0], np.cumsum(sizes)])

    def _chunks(self, code: np.ndarray, a: np.ndarray, b: np.ndarray, keys: np.ndarray, limit: int) -> tuple[np.ndarray, ...]:
        """Ids of all chunks in a row and how many each has; without dropout also their merges, three numbers each."""
        v, size = self.v, b - a
        short, found, made = np.flatnonzero(size <= LONG), [], []
        if len(short):
            n = size[short]
            run = np.cumsum(n)
            symbols = v.char[code[np.repeat(a[short] - run + n, n) + np.arange(int(run[-1]))]]
            own: list[tuple[np.ndarray, ...]] = []
            chunk, piece, start, end = _side_by_side(v, symbols, n, keys[short], limit, None if limit else own)
            found.append((short[chunk], piece, start, end))
            made += [(short[c], *x) for c, *x in own]
        for k in np.flatnonzero(size > LONG):
            one: list[tuple[int, int, int]] = []
            piece, start, end = (np.array(x, np.int64) for x in zip(*_by_heap(v, v.char[code[a[k] : b[k]]].tolist(), int(keys[k]), limit, None if limit else one)))
            found.append((np.full(len(piece), k), piece, start, end))
            if one:
                made.append((np.full(len(one), k), *np.array(one, np.int64).T))
        chunk, piece, start, end = (np.concatenate(x) for x in zip(*found))
        bare = piece < 0
        ids, each = piece.astype(np.uint32), np.ones(len(piece), np.int64)
        if bare.any():  # characters outside the vocabulary are spelled in bytes
            spelled = [chr(x).encode() for x in code[a[chunk[bare]] + start[bare]].tolist()]
            each[bare] = [len(x) for x in spelled]
            ids = np.repeat(ids, each)
            ids[np.repeat(bare, each)] = v.byte[np.frombuffer(b"".join(spelled), np.uint8)]
        order = np.argsort(np.repeat(chunk, each), kind="stable")
        merges, many = np.zeros(0, np.uint32), np.zeros(len(a), np.int64)
        if made:
            of, *places = (np.concatenate(x) for x in zip(*made))
            merges = np.stack(places, 1)[np.argsort(of, kind="stable")].astype(np.uint32).ravel()
            many = 3 * np.bincount(of, minlength=len(a))
        return ids[order], np.bincount(chunk, each, len(a)).astype(np.int64), merges, many

    def decode(self, ids: np.ndarray) -> str:
        return decode(self.v, ids)


def decode(v: Vocabulary, ids: np.ndarray) -> str:
    size = v.spelled_size[ids]
    run = np.cumsum(size)
    raw = v.spelled[np.repeat(v.spelled_at[ids] - run + size, size) + np.arange(int(run[-1]) if len(run) else 0)].tobytes()
    return raw.decode("utf-8", "replace")[1:] if len(ids) else ""


def _text_key(key: str, seed: int) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(f"{seed}:{key}".encode(), digest_size=8).digest(), "big")


def vocabulary(path: str) -> Vocabulary:
    if path not in _MODELS:
        _MODELS[path] = Vocabulary(path)
    return _MODELS[path]


def encode_pieces(df: DataFrame, path: str, dropout: float = 0.1, seed: int = 1, doc_id: str = "doc_id", text: str = "text", check: bool = False) -> DataFrame:
    """doc_id, n_pieces, ids (little-endian unsigned 32-bit), and, if asked for, lossless: whether they decode to the text."""
    kind = "doc_id long, n_pieces long, ids binary" + ", lossless boolean" * check

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary(path), dropout, seed)
        for whole in batches:
            for batch in slices(whole):
                docs = batch.column(0).to_pylist()
                texts = strings(batch.column(1))
                ids = encoder.encode(texts, [str(d) for d in docs])
                columns = [pa.array(docs, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())]
                if check:
                    columns.append(pa.array([encoder.decode(x) == t for x, t in zip(ids, texts)]))
                yield pa.record_batch(columns, names=["doc_id", "n_pieces", "ids", "lossless"][: len(columns)])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(tidy(run), kind)


def decode_pieces(df: DataFrame, path: str) -> DataFrame:
    """df (with a column ids) and `decoded`, the text that the ids spell."""

    @F.pandas_udf("string")
    def run(column):  # noqa: ANN001, ANN202
        import pandas as pd

        v = vocabulary(path)
        return pd.Series([None if x is None else decode(v, np.frombuffer(x, "<u4")) for x in column], dtype=object)

    return df.withColumn("decoded", run(F.col("ids")))

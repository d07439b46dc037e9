"""Token ids of whole texts by the tokenizers library, a distinct chunk at a time.

A text is cut where a single space stands between two characters that are no white space (or, for a vocabulary
without ids for white space, at every space and line end). The vocabularies cut there too, so the ids of the
chunks in a row are the ids of the text. Each distinct chunk is encoded once by the library in a worker, and its
ids are gathered for all places where it occurs. Chunks are told apart by a 64-bit hash of their bytes. Added tokens
in a text (`<|endoftext|>`) are found as the library finds them by default.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tessera.llm.common import BYTE, U64, IdStore, mix, powers, utf8

#: Distinct chunks (about 40 bytes each) and ids (4 bytes each) that a worker keeps; beyond either the store starts anew.
KEPT, KEPT_IDS = 1_000_000, 16_000_000
_ENCODERS: dict[tuple[str, bool], "Encoder"] = {}
_PRINT = np.zeros(256, bool)
_PRINT[0x21:0x7F] = True
_PRINT[0x80:] = True
#: Lead bytes of the UTF-8 forms of white space beyond ASCII.
_MAYBE_WHITE = np.zeros(256, bool)
_MAYBE_WHITE[[0xC2, 0xE1, 0xE2, 0xE3]] = True


class Encoder:
    def __init__(self, path: str, blank: bool):
        """blank: the vocabulary has no ids for white space."""
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.blank = blank
        self.store = IdStore(KEPT, KEPT_IDS)

    def _spans(self, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        if self.blank:
            inside = (data != 0x20) & (data != 0x0A)
            before = np.zeros(n + 1, bool)
            before[1:] = inside
            flag, edge = np.append(inside, False), np.zeros(n + 1, bool)
            edge[rows] = True
            return np.flatnonzero(flag & (~before | edge)), np.flatnonzero(before & (~flag | edge))
        edge = np.zeros(n + 1, bool)
        edge[rows] = True
        if n >= 3:
            plain = _PRINT[data]
            lead = _MAYBE_WHITE[data]
            after = plain & ~lead
            ends = plain.copy()  # the last byte of a character that is surely no white space
            high = data >= 0x80
            ends[1:] &= ~(high[1:] & lead[:-1])
            ends[2:] &= ~(high[2:] & lead[:-2])
            cut = np.zeros(n + 1, bool)
            cut[1 : n - 1] = (data[1:-1] == 0x20) & ends[:-2] & after[2:]
            cut[1 : n - 1] &= ~edge[2:n]
            edge |= cut
        edge[n] = True
        at = np.flatnonzero(edge)
        return at[:-1], at[1:]

    def _learn(self, chunks: list[str], keys: np.ndarray) -> None:
        sizes, ids = [], []
        for a in range(0, len(chunks), 20_000):
            group = chunks[a : a + 20_000]
            found = self.tokenizer.encode(group, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.asarray(found.ids, np.uint32))
            sizes.append(np.bincount(np.asarray(found.word_ids, np.int64), minlength=len(group)))
        self.store.add(keys, np.concatenate(ids), np.concatenate(sizes))

    def encode(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string column in a row, and the offset of each row's first id (one more at the end)."""
        data, rows = utf8(arr)
        start, end = self._spans(data, rows)
        power, inverse = powers(len(data) + 1)
        total = np.zeros(len(data) + 1, U64)
        np.cumsum(BYTE[data] * power[:-1], out=total[1:])
        hashed = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(U64))
        keys, first, which = np.unique(hashed, return_index=True, return_inverse=True)
        new = self.store.missing(keys)
        if new.any():
            raw = data.tobytes()
            spans = zip(start[first[new]].tolist(), end[first[new]].tolist())
            self._learn([raw[s:e].decode() for s, e in spans], keys[new])
        ids, ends = self.store.gather(keys, which)
        return ids, ends[np.searchsorted(start, rows)]


def encoder(path: str, blank: bool) -> Encoder:
    """One encoder for each worker process."""
    if (path, blank) not in _ENCODERS:
        _ENCODERS[path, blank] = Encoder(path, blank)
    return _ENCODERS[path, blank]

"""Adaptive context-mixing range coder for blocks of token ids.

Every block starts from the same empty model and is coded on its own, so a damaged or lost block costs no other.
The model numbers the ids of its block in the order of their first occurrence and predicts the next number:

* order 2: the last id seen after the same two ids, with the context itself stored for a check;
* order 1: the last id seen after the same id; both with the share of right guesses at their present confidence;
* order 0: the counts of all ids so far, in a two-level table of sums.

The three are mixed, with weights that follow whichever has done better, to the frequencies of "order 2's id", "order
1's id", "another known id" and "an id new to the block" that drive the range coder. A known id follows by its order-0
count, a new one by adaptive frequencies of its magnitude (its number of binary digits: frequent pieces have small
ids) and its other digits plainly. All arithmetic is on integers, so every machine decodes alike.

The coder keeps a lower end and a range of 48 bits and puts out 16 bits at a time; a carry is added to the words
already out when the block ends. Blocks are coded side by side: one numpy operation advances all by one id.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_SLOTS = 10  # bits of the order-2 table
_LEVELS = 8  # of a predictor's confidence
_WIDE = 32  # sums in a row of the order-0 table
#: Most ids of a block.
LONGEST = _WIDE * _WIDE
_TARGET = np.array([[0 if j <= s else 65536 - 16 for j in range(16)] + [65536 - 16] for s in range(16)], np.int32)
_FLOOR = np.arange(17, dtype=np.int32)
_STEPS = np.arange(_WIDE, dtype=np.int16)
# Whether the first k of a row's sums lie before element h: 0 for j <= h, 1 beyond.
_BEYOND = (np.arange(_WIDE)[None, :] > np.arange(_WIDE)[:, None]).astype(np.int16)


class _Model:
    """The predictors of `lanes` blocks side by side."""

    def __init__(self, lanes: int):
        self.lanes = np.arange(lanes, dtype=np.int64)
        # Packed entries: id number (10 bits), confidence (3), and for order 2 the first id of the context (10) plus one.
        self.one, self.two = np.zeros(lanes * LONGEST, np.int32), np.zeros(lanes << _SLOTS, np.int32)
        start = np.array([600, 20000, 30000, 38000, 44000, 50000, 54000, 58000], np.int64)
        self.right2, self.right1 = np.tile(start, lanes), np.tile(start // 2, lanes)
        self.weight = np.full(lanes, 160, np.int64)  # of order 2, of 256
        self.new = np.tile(np.array([60000, 30000, 20000], np.int64), lanes)  # share of new ids, by the confidence of order 1
        self.id_of = np.zeros(lanes * LONGEST, np.uint16)
        self.rows = np.zeros((lanes, _WIDE), np.int16)  # order-0 counts of rows before each row
        self.cells = np.zeros((lanes * _WIDE, _WIDE), np.int16)  # of cells in the row before each cell
        self.count = np.zeros(lanes * LONGEST, np.int16)
        self.distinct = np.zeros(lanes, np.int64)
        self.before, self.last = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        flat = np.arange(17, dtype=np.int32) * ((65536 - 16) // 16)
        flat[16] = 65536 - 16
        self.magnitude = np.tile(flat, (lanes, 1))

    def predict(self, n: int, t: int) -> tuple[np.ndarray, ...]:
        """For the first n blocks, after t ids: both numbers, and the ends of their frequencies and of "known" of 65536."""
        lanes, before, last = self.lanes[:n], self.before[:n], self.last[:n]
        base = lanes * LONGEST
        self.at2 = (lanes << _SLOTS) + (((before * 0x9E3779B1 + last * 0x85EBCA6B) >> 15) & ((1 << _SLOTS) - 1))
        self.at1 = base + last
        e2, e1 = self.two[self.at2], self.one[self.at1]
        e2 = np.where((e2 >> 13) == before + 1, e2, 0)
        n2, n1 = (e2 & 1023).astype(np.int64), (e1 & 1023).astype(np.int64)
        s2, s1 = (e2 >> 10) & 7, (e1 >> 10) & 7
        self.l2, self.l1 = lanes * _LEVELS + s2, lanes * _LEVELS + s1
        self.l0 = lanes * 3 + np.minimum(s1, 2)
        p2, p1, p0 = self.right2[self.l2], self.right1[self.l1], self.new[self.l0]
        w = self.weight[:n]
        f2, f1 = (w * p2) >> 8, ((256 - w) * p1) >> 8
        rest = 65536 - f2 - f1
        known = (rest * (65536 - p0)) >> 16
        # Order 0 speaks for the two ids as well.
        if t:
            f2 += known * self.count[base + n2] // t
            f1 += known * self.count[base + n1] // t
        differ = n2 != n1
        f2 = np.where(differ, f2, f2 + f1)
        f1 = np.where(differ, f1, 0)
        f2 = np.minimum(f2, 60000) + 16
        f1 = np.where(differ, np.minimum(f1, 64000 - f2) + 16, 0)
        rest = 65536 - f2 - f1
        fresh = np.clip((rest * p0) >> 16, 16, rest - 16)
        self.now = n2, n1, s2, s1, p2, p1, p0
        return n2, n1, f2, f2 + f1, 65536 - fresh

    def find(self, n: int, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts before a number, and its own."""
        row, cell = number >> 5, number & 31
        at = self.lanes[:n] * _WIDE + row
        before = self.rows.reshape(-1)[at].astype(np.int64) + self.cells.reshape(-1)[at * _WIDE + cell]
        return before, self.count[self.lanes[:n] * LONGEST + number].astype(np.int64)

    def number_at(self, n: int, value: np.ndarray) -> np.ndarray:
        """The number whose counts hold the value."""
        rows = self.rows[:n]
        v = value.astype(np.int16)
        row = (rows <= v[:, None]).sum(1, dtype=np.int64) - 1
        at = self.lanes[:n] * _WIDE + row
        v = v - self.rows.reshape(-1)[at]
        cell = (self.cells[at] <= v[:, None]).sum(1, dtype=np.int64) - 1
        return row * _WIDE + cell

    def update(self, n: int, number: np.ndarray, new: np.ndarray) -> None:
        """number: of the id that came, new: whether it was new (its number is then the next one)."""
        n2, n1, s2, s1, p2, p1, p0 = self.now
        lanes = self.lanes[:n]
        hit2, hit1 = number == n2, number == n1
        if new.any():
            hit2, hit1 = hit2 & ~new, hit1 & ~new
        self.right2[self.l2] = p2 + (((hit2 * 65535) - p2) >> 5)
        self.right1[self.l1] = p1 + (((hit1 * 65535) - p1) >> 5)
        self.new[self.l0] = p0 + (((new * 65535) - p0) >> 5)
        gain = np.where(hit2, p2, 65536 - p2) - np.where(hit1, p1, 65536 - p1)
        self.weight[:n] = np.clip(self.weight[:n] + (gain >> 12), 16, 240)
        number32 = number.astype(np.int32)
        for hit, old, s, at, table, tag in ((hit2, n2, s2, self.at2, self.two, (self.before[:n].astype(np.int32) + 1) << 13), (hit1, n1, s1, self.at1, self.one, np.int32(0))):
            sure = np.where(hit, np.minimum(s + 1, _LEVELS - 1), np.where(s > 1, s >> 1, 1))
            table[at] = np.where(hit | (s > 1), old.astype(np.int32), number32) | (sure << 10) | tag
        self.count[lanes * LONGEST + number] += 1
        row, cell = number >> 5, number & 31
        self.rows[:n] += _BEYOND[row]
        at = lanes * _WIDE + row
        self.cells[at] += _BEYOND[cell]
        self.distinct[:n] += new
        self.before[:n], self.last[:n] = self.last[:n], number


def _learned(rows: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    return rows + ((_TARGET[symbol] - rows) >> 5)


class _Encoder:
    def __init__(self, lanes: int, words: int):
        self.low, self.span = np.zeros(lanes, _U), np.full(lanes, 1 << 48, _U)
        self.out, self.words, self.used = np.zeros(lanes * words, np.uint32), words, np.arange(lanes, dtype=np.int64) * words

    def put(self, lanes: slice | np.ndarray, start: np.ndarray, size: np.ndarray, total: int | None = None) -> None:
        """Narrow the range of the lanes to size of total (65536) from start on."""
        step = self.span[lanes] >> _U(16) if total is None else self.span[lanes] // _U(total)
        low, span = self.low[lanes] + step * start.astype(_U), step * size.astype(_U)
        at = self.used[lanes]
        self.out[at] = low >> _U(32)
        small = span < _U(1 << 32)
        shift = small.astype(_U) << _U(4)
        self.low[lanes] = np.where(small, low & _U(0xFFFFFFFF), low) << shift
        self.span[lanes] = span << shift
        self.used[lanes] = at + small

    def finish(self) -> list[bytes]:
        """What was put out for each lane: the words, two more (what is missing is zero), carries added."""
        n = len(self.low)
        first = np.arange(n, dtype=np.int64) * self.words
        # Any number in the range will do: its lower end rounded up to the next 16 bits is (ranges are over 32 bits).
        low = self.low + _U(0xFFFFFFFF)
        self.out[self.used] = low >> _U(32)
        length = self.used - first + 1
        table = self.out.reshape(n, self.words)
        for t in range(int(length.max(initial=1)) - 1, 0, -1):
            carry = table[:, t] >> 16
            if carry.any():
                live = length > t
                table[:, t - 1] += np.where(live, carry, 0).astype(np.uint32)
        return [row[:k].astype("<u2").tobytes() for row, k in zip(table & np.uint32(0xFFFF), length.tolist())]


class _Decoder:
    def __init__(self, lanes: int, words: np.ndarray, at: np.ndarray, end: np.ndarray):
        """words: of all blocks in a row, with some to spare; at, end: where each block's begin and end."""
        self.words, self.at, self.end = words, at, end
        self.span, self.code = np.full(lanes, 1 << 48, _U), np.zeros(lanes, _U)
        for _ in range(3):
            self.code = (self.code << _U(16)) | self._next(slice(None))
            self.at = self.at + 1

    def _next(self, lanes: slice | np.ndarray) -> np.ndarray:
        at = self.at[lanes]
        return np.where(at < self.end[lanes], self.words[np.minimum(at, len(self.words) - 1)], 0).astype(_U)

    def look(self, lanes: slice | np.ndarray, total: int | None = None) -> np.ndarray:
        step = self.span[lanes] >> _U(16) if total is None else self.span[lanes] // _U(total)
        return np.minimum(self.code[lanes] // step, _U((total or 65536) - 1)).astype(np.int64)

    def take(self, lanes: slice | np.ndarray, start: np.ndarray, size: np.ndarray, total: int | None = None) -> None:
        step = self.span[lanes] >> _U(16) if total is None else self.span[lanes] // _U(total)
        code, span = self.code[lanes] - step * start.astype(_U), step * size.astype(_U)
        small = span < _U(1 << 32)
        shift = small.astype(_U) << _U(4)
        self.code[lanes] = (code << shift) | np.where(small, self._next(lanes), _U(0))
        self.span[lanes] = span << shift
        self.at[lanes] += small


def _order(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks from the longest to the shortest, and how many are still running at each step."""
    order = np.argsort(-sizes, kind="stable")
    steps = int(sizes.max(initial=0))
    return order, len(sizes) - np.searchsorted(np.sort(sizes), np.arange(steps), "right")


def _numbered(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each id in its block (a column) by first occurrence, and whether it is the first."""
    steps, lanes = ids.shape
    on = np.arange(steps)[:, None] < sizes[None, :]
    lane, step = np.nonzero(on.T)
    value = ids[step, lane]
    key = (lane << 16) | value
    order = np.argsort(key, kind="stable")
    k = key[order]
    head = np.append(True, k[1:] != k[:-1]) if len(k) else np.zeros(0, bool)
    new = np.zeros(len(key), bool)
    new[order[head]] = True
    # In the order of lanes and steps, the running count of first occurrences within the lane.
    seen = np.cumsum(new)
    begin = np.searchsorted(lane, np.arange(lanes))
    base = np.where(begin > 0, np.append(seen, 0)[begin - 1], 0)
    rank = seen - 1 - base[lane]
    number = np.empty(len(key), np.int64)
    number[order] = rank[order[np.flatnonzero(head)]][np.cumsum(head) - 1] if len(k) else rank
    out, fresh = np.zeros(ids.shape, np.int64), np.zeros(ids.shape, bool)
    out[step, lane], fresh[step, lane] = number, new
    return out, fresh


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block of at most LONGEST ids (below 65536) as bytes."""
    if not blocks:
        return []
    sizes = np.array([len(b) for b in blocks], np.int64)
    order, running = _order(sizes)
    steps, lanes = len(running), len(blocks)
    ids = np.zeros((steps, lanes), np.int64)
    for lane, k in enumerate(order):
        ids[: sizes[k], lane] = blocks[k]
    numbers, fresh = _numbered(ids, sizes[order])
    model, coder = _Model(lanes), _Encoder(lanes, 3 * steps + 4)
    for t, n in enumerate(running):
        every = slice(0, int(n))
        number, new = numbers[t, :n], fresh[t, :n]
        n2, n1, a, b, c = model.predict(n, t)
        is2 = (number == n2) & ~new
        is1 = (number == n1) & ~new & ~is2
        low = np.where(is2, 0, np.where(is1, a, np.where(new, c, b)))
        coder.put(every, low, np.where(is2, a, np.where(is1, b, np.where(new, 65536, c))) - low)
        known = np.flatnonzero(~(is2 | is1 | new))
        if len(known):
            start, size = model.find(n, number)
            coder.put(known, start[known], size[known], t)
        other = np.flatnonzero(new)
        if len(other):
            value = ids[t, other]
            symbol = np.maximum(np.frexp(value)[1] - 1, 0)
            have = model.magnitude[other]
            each = have + _FLOOR
            k = np.arange(len(other))
            start = each[k, symbol]
            coder.put(other, start, each[k, symbol + 1] - start)
            model.magnitude[other] = _learned(have, symbol)
            bits = 16 - np.maximum(symbol, 1)
            coder.put(other, (value - np.where(symbol > 0, 1 << symbol, 0)) << bits, 1 << bits)
        model.update(n, number, new)
    coded = coder.finish()
    out: list[bytes] = [b""] * lanes
    for lane, k in enumerate(order):
        out[k] = coded[lane]
    return out


def decode_blocks(coded: list[bytes], sizes: np.ndarray) -> list[np.ndarray]:
    """The ids of each block."""
    if not coded:
        return []
    sizes = np.asarray(sizes, np.int64)
    order, running = _order(sizes)
    steps, lanes = len(running), len(coded)
    joined = np.frombuffer(b"".join(coded[k] for k in order) + bytes(8), "<u2")
    length = np.array([len(coded[k]) // 2 for k in order], np.int64)
    end = np.cumsum(length)
    coder, model = _Decoder(lanes, joined, end - length, end), _Model(lanes)
    ids = np.zeros((steps, lanes), np.int64)
    for t, n in enumerate(running):
        every = slice(0, int(n))
        n2, n1, a, b, c = model.predict(n, t)
        at = coder.look(every)
        is2, new = at < a, at >= c
        is1 = ~is2 & (at < b)
        low = np.where(is2, 0, np.where(is1, a, np.where(new, c, b)))
        coder.take(every, low, np.where(is2, a, np.where(is1, b, np.where(new, 65536, c))) - low)
        number = np.where(is2, n2, np.where(is1, n1, model.distinct[:n]))
        known = np.flatnonzero(~(is2 | is1 | new))
        if len(known):
            value = np.zeros(n, np.int64)
            value[known] = coder.look(known, t)
            found = model.number_at(n, value)
            number[known] = found[known]
            start, size = model.find(n, number)
            coder.take(known, start[known], size[known], t)
        other = np.flatnonzero(new)
        if len(other):
            have = model.magnitude[other]
            each = have + _FLOOR
            k = np.arange(len(other))
            symbol = (each[:, 1:] <= coder.look(other).astype(np.int32)[:, None]).sum(1)
            start = each[k, symbol]
            coder.take(other, start, each[k, symbol + 1] - start)
            model.magnitude[other] = _learned(have, symbol)
            bits = 16 - np.maximum(symbol, 1)
            plain = coder.look(other) >> bits
            coder.take(other, plain << bits, 1 << bits)
            model.id_of[other * LONGEST + number[other]] = plain + np.where(symbol > 0, 1 << symbol, 0)
        ids[t, :n] = model.id_of[model.lanes[:n] * LONGEST + number]
        model.update(n, number, new)
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * lanes
    for lane, k in enumerate(order):
        out[k] = ids[: sizes[k], lane].astype(np.uint32)
    return out

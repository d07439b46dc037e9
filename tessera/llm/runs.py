"""Periodic runs in the word sequence of a text, from Lyndon arrays of two opposite orders of its words.

The longest Lyndon word that starts at word i ends where the next smaller suffix starts. By the runs theorem every run
of period q has a place i whose longest Lyndon word, in an order of words or in its opposite, is one period long and is
followed by an equal word; so the pairs (i, next smaller suffix) are the only candidates. Words are only compared with
one another: no suffix array or tree, no hash of words or of stretches.

* Next smaller suffixes come from right to left. Where the first words of two suffixes differ, that settles it. Else the
  common beginning of i and j is known from that of i and the suffix before j in the chain, unless both are of equal
  length; only then words are compared, from that length on.
* What has matched at a distance d is remembered: a later comparison at the same distance that reaches it jumps to its
  end, so no two words are compared twice as equal. Long periodic texts cost a step for each word.
* A candidate is extended to the left in the same way.

Words are numbered in the order of their first appearance, which is one order of the alphabet; the opposite is the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices, tidy

Run = tuple[int, int, int]  # start, length, period

_OUT = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def lyndon(w: list[int]) -> tuple[list[int], dict[int, int]]:
    """For w, whose last item is less than all others: the next smaller suffix of each place, and how many items it shares
    with the suffix of the place (only places that share one or more)."""
    n = len(w) - 1
    smaller = [n] * (n + 1)
    shared: dict[int, int] = {}
    matched: dict[int, tuple[int, int]] = {}  # distance -> the last stretch of equal items, [from, to)
    for i in range(n - 1, -1, -1):
        a, j = w[i], i + 1
        b = w[j]
        while b > a:
            j = smaller[j]
            b = w[j]
        if b == a:
            m = 0
            while True:
                d, x = j - i, i + m
                start, end = matched.get(d, (n, n))
                while x < start and w[x] == w[x + d]:
                    x += 1
                if x >= start:
                    x = end
                matched[d] = (i, x)
                m = x - i
                # While i's suffix is the smaller one, the chain goes on; what j shares with its next says how i compares.
                while w[i + m] < w[j + m]:
                    less = shared.get(j, 0)
                    j = smaller[j]
                    if less <= m:
                        break
                else:
                    break
                if less < m:
                    m = less
                    break
            if m:
                shared[i] = m
        smaller[i] = j
    return smaller, shared


def runs(items: list[int], least: int = 12) -> list[Run]:
    """All runs (start, length, period) of at least `least` items and two periods, by start and period. Items are 0, 1, ..."""
    n, top = len(items), max(items, default=0)
    if n < max(least, 2) or top + 1 == n:
        return []
    found: set[Run] = set()
    for w in ([*items, -1], [*(top - x for x in items), -1]):
        smaller, shared = lyndon(w)
        known: dict[int, tuple[int, int]] = {}  # period -> the last stretch looked at
        for i, right in shared.items():
            p = smaller[i] - i
            start, end = known.get(p, (n, n))
            if start <= i < end:
                continue
            s = i
            while s and w[s - 1] == w[s - 1 + p]:
                s -= 1
            length = i + right - s + p
            known[p] = (s, i + right)
            if length >= 2 * p and length >= least:
                found.add((s, length, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept(n: int, found: list[Run]) -> np.ndarray:
    """Which of n items no run holds after its first period."""
    step = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        step[start + period] += 1
        step[start + length] -= 1
    return np.cumsum(step[:-1]) == 0


def _judged(text: bytes | None, least: int) -> tuple[int, list[Run], bytes]:
    words = (text or b"").split()  # at [\x20\x09-\x0D]
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    found = runs([number[w] for w in words], least)
    if found:
        stay = kept(len(words), found).tolist()
        return len(words), found, b" ".join(w for w, ok in zip(words, stay) if ok)
    return len(words), found, b" ".join(words)


def periodic_runs(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 12) -> DataFrame:
    """doc_id, n_words, runs <start, length, period> by start and period, and the collapsed text, for each row.

    A run is a stretch of words [^\\x20\\x09-\\x0D]+ of smallest period q and at least max(least, 2 q) words that no
    neighbouring word extends; of each run the first q words stay in the collapsed text, whose words are joined by one
    space. A null, empty or blank text has no words, no runs and an empty collapsed text. Each row is judged alone, whole,
    and without a shuffle: rows that repeat or share an id, or have none, each give their own row; other columns go.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                judged = [_judged(t, least) for t in part.column(1).cast(pa.binary()).to_pylist()]
                flat = np.array([r for _, found, _ in judged for r in found], np.int64).reshape(-1, 3)
                ends = np.cumsum([0, *(len(found) for _, found, _ in judged)])
                rows = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
                arrays = [part.column(0), pa.array([n for n, _, _ in judged], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows), pa.array([c for _, _, c in judged], pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "runs", "collapsed"])

    own = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(tidy(run), f"doc_id {own.schema['doc_id'].dataType.simpleString()}, {_OUT}")


def repeated_tail(doc_id: Column, text: Column) -> Column:
    """The text with a periodic tail: for h = crc32(decimal id), h % 10 = 0 and n > 0 words, each word i >= a becomes word
    a + (i - a) % p, for g = floor(h / 10), a = g % n, p = 1 + floor((n - a) / (3 + g % 8)). Other texts stay."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))), 1, n - a)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, 1, a), tail), " ")).otherwise(text)


def summary(found: DataFrame) -> DataFrame:
    """The digest of periodic_runs: number of runs, the longest one (ties: smallest start, then period), and sha256 of all runs and of the collapsed text."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("__best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("__best.s").alias("start"), (-F.col("__best.l")).alias("length"), F.col("__best.p").alias("period"),
        F.floor(-1000 * F.col("__best.l") / F.col("__best.p")).cast("long").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

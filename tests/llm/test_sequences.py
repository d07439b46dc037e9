"""Conversation trie, line dedup and periodic runs against brute force, with nulls, ties, repeated rows, long texts and empty tables."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import line_dedup
from tessera.llm.conversation_trie import grafted, prefix_trie, sequences
from tessera.llm.line_dedup import dedup_lines
from tessera.llm.queries import ORACLES, QUERIES
from tessera.llm.runs import kept, lyndon, periodic_runs, runs
from tests.conftest import DATA, same_rows

SPACE = " \t\n\x0b\x0c\r"


@pytest.mark.parametrize("name", ["op11_cartesian_lcp_trie", "op12_bloom_line_dedup", "op13_lyndon_runs"])
def test_matches_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, DATA), duck.sql(ORACLES[name]))


# --- conversation trie -----------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, block int, depth string"


def trie_by_hand(rows):
    symbol = lambda t: hashlib.sha256(f"{len(t[1])}:{t[1]}{t[2]}".encode()).hexdigest()
    told = collections.defaultdict(list)
    for c, n, r, x, *_ in rows:
        if c is not None:
            told[c].append((n, r or "", x or ""))
    seqs = {c: [t[1:] for t in sorted(v, key=lambda t: (t[0] is not None, t[0] or 0, symbol(t)))] for c, v in told.items()}
    nodes = collections.defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes[tuple(s[:d])].append(c)
    kids = collections.Counter(p[:-1] for p in nodes if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    ends = {p: ",".join(map(str, sorted(c for c in m if len(seqs[c]) == len(p)))) for p, m in nodes.items()}
    return sorted(((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in nodes.items()), key=str)


def chats(seed, n, copies=0, long=0):
    draw = random.Random(seed)
    rows = []
    for c in range(n):
        for k in range(draw.choice([1, 2, 4, 7])):
            rows.append((c * 3 - 20, k if draw.random() < 0.9 else None, draw.choice(["user", "bot", None]), draw.choice(["hi", "how are you", None, " \t"]), 1, "x"))
    rows += [(10_000 + c, k, "user", f"copy {k}", None, None) for c in range(copies) for k in range(3 + (c % 5 == 0))]
    rows += [(20_000 + c, k, "bot", f"w {k % 3}", None, None) for c in range(2) for k in range(long)]
    return rows + rows[:5] + [(None, 1, "user", "nobody's", 1, "x")]


@pytest.mark.parametrize(("partitions", "rows"), [(1, chats(1, 30)), (7, chats(2, 60, 40)), (40, chats(3, 90, 200, 300)), (64, chats(4, 3, 60))])
def test_trie(spark, partitions, rows):
    settings = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = sorted(map(tuple, prefix_trie(sequences(spark.createDataFrame(rows, TURNS))).collect()), key=str)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == trie_by_hand(rows)


def test_trie_of_nothing_and_of_turnless(spark):
    assert prefix_trie(sequences(spark.createDataFrame([], TURNS))).collect() == []
    # 21 and 27 begin with the first turns of 20, as many as crc32 says (1 and 2), or with none where 20 is not there.
    rows = [(20, 0, "u", "a", 0, ""), (20, 1, "u", "b", 0, ""), (21, 0, "u", "z", 0, ""), (27, 0, "u", "y", 0, ""), (47, 0, "u", "y", 0, "")]
    shown = {r.conv_id: [t.symbol for t in r.turns] for r in grafted(sequences(spark.createDataFrame(rows, TURNS))).collect()}
    import zlib

    for c in (21, 27):
        h = zlib.crc32(str(c).encode()) % 4
        assert shown[c][:h] == shown[20][:h] and len(shown[c]) == min(h, 2) + max(0, 1 - h)
    h = zlib.crc32(b"47") % 4
    assert len(shown[47]) == max(0, 1 - h)
    nodes = prefix_trie(grafted(sequences(spark.createDataFrame(rows, TURNS)))).collect()
    assert [r.n_convs for r in nodes if r.depth == 0] == [4]


# --- line dedup ------------------------------------------------------------------------------------------------

DOCS = "doc_id long, text string, n_lines string, found string, `row` int, rest string, `a.b` int"


def dedup_by_hand(rows):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(SPACE))
    rank = lambda i: (i is None, i or 0)
    holders = collections.defaultdict(set)
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                holders[key(x)].add(i)
    first = {k: min(v, key=rank) for k, v in holders.items() if len(v) > 1}
    out = []
    for i, t, *rest in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if first.get(key(x), i) == i]
        out.append((i, None if t is None else "\n".join(stay), *rest[1:], len(lines), len(lines) - len(stay)))
    return sorted(out, key=str)


def pages_of_lines(seed, n):
    draw = random.Random(seed)
    pool = ["A common line of words", "  a COMMON line of words\t", "short", "", "ĐƯỜNG này dài", "đường này dài", "Ünïcode line", "exactly 10", "exactly9c", *[f"line number {k} of the pool" for k in range(60)]]
    rows = [(draw.randrange(n), "\n".join(draw.choice(pool) if draw.random() < 0.7 else f"own line {draw.random()}" for _ in range(draw.choice([1, 1, 3, 30]))), "x", "y", 1, "z", 2) for _ in range(n)]
    text = "A common line of words\n" * 3 + "x" * 5000
    return rows + rows[:4] + [(None, text, "x", "y", 1, "z", 2), (None, None, None, None, None, None, None), (n + 1, None, "", "", 0, "", 0), (n + 2, "", "", "", 0, "", 0), (n + 3, text, "", "", 0, "", 0), (n + 4, "\r\n \n\n", "", "", 0, "", 0), (n + 5, "only here, twice\n" * 2, "", "", 0, "", 0)]


@pytest.mark.parametrize("broadcast", [None, 0])
@pytest.mark.parametrize("n", [3, 300])
def test_line_dedup(spark, monkeypatch, broadcast, n):
    rows = pages_of_lines(n, n)
    got = dedup_lines(spark.createDataFrame(rows, DOCS).repartition(5), broadcast=broadcast)
    assert got.columns == ["doc_id", "text", "found", "row", "rest", "a.b", "n_lines", "n_dropped"]
    assert sorted(map(tuple, got.collect()), key=str) == dedup_by_hand(rows)


@pytest.mark.parametrize("broadcast", [None, 0])
def test_line_dedup_of_many_segments(spark, monkeypatch, broadcast):
    """Small segments and much too small filters: nearly all lines are suspects, with the same result."""
    monkeypatch.setattr(line_dedup, "PER_LINE", 1 << 20)
    rows = pages_of_lines(7, 40)
    got = dedup_lines(spark.createDataFrame(rows, DOCS).repartition(3), broadcast=1 << 20 if broadcast is None else 0)
    assert sorted(map(tuple, got.collect()), key=str) == dedup_by_hand(rows)
    monkeypatch.setattr(line_dedup, "_holds", lambda bits, hashes: hashes == hashes)
    got = dedup_lines(spark.createDataFrame(rows, DOCS), broadcast=broadcast)
    assert sorted(map(tuple, got.collect()), key=str) == dedup_by_hand(rows)


def test_line_dedup_of_nothing(spark):
    for broadcast in (None, 0):
        assert dedup_lines(spark.createDataFrame([], DOCS), broadcast=broadcast).collect() == []
    only = spark.createDataFrame([("b", "the same line here"), ("a", "the same line here")], "name string, body string")
    got = {r.name: (r.body, r.n_dropped) for r in dedup_lines(only, "name", "body").collect()}
    assert got == {"a": ("the same line here", 0), "b": ("", 1)}


# --- periodic runs ---------------------------------------------------------------------------------------------


def runs_by_hand(w, least):
    found = []
    for q in range(1, len(w) // 2 + 1):
        x = 0
        while x + q < len(w):
            s = x
            while x + q < len(w) and w[x] == w[x + q]:
                x += 1
            length = x - s + q
            if length >= max(2 * q, least) and not any(w[s : s + length - z] == w[s + z : s + length] for z in range(1, q)):
                found.append((s, length, q))
            x = max(x, s + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def numbered(w):
    first = {}
    return [first.setdefault(x, len(first)) for x in w]


def test_runs_by_hand():
    draw = random.Random(11)
    for _ in range(1500):
        n = draw.randint(0, 70)
        w = [draw.randrange(draw.choice([1, 2, 3, 5, 9])) for _ in range(n)]
        if n > 5 and draw.random() < 0.5:
            a = draw.randrange(n)
            p = draw.randint(1, max(1, (n - a) // 2))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        w = numbered(w)
        smaller, shared = lyndon([*w, -1])
        for i in range(n):
            j = next((j for j in range(i + 1, n) if w[j:] < w[i:]), n)
            assert smaller[i] == j
            assert shared.get(i, 0) == next((k for k in range(n) if j + k == n or w[i + k] != w[j + k]), 0)
        for least in (2, 12):
            assert runs(w, least) == runs_by_hand(w, least)


class Counted(int):
    """A number that counts how often it is compared."""

    n = 0

    def _told(name):  # noqa: N805
        def f(self, other):  # noqa: ANN001, ANN202
            Counted.n += 1
            return getattr(int, name)(self, other)

        return f

    __eq__, __lt__, __gt__, __hash__ = _told("__eq__"), _told("__lt__"), _told("__gt__"), int.__hash__


@pytest.mark.parametrize("period", [1, 2, 7, 300])
def test_runs_compare_few_words(period):
    """A periodic text of n words takes some comparisons for each word, not for each pair."""
    n = 4000
    w = [Counted(k * 7919 % 997) for k in range(period)] * (n // period)
    Counted.n = 0
    lyndon([*w, Counted(-1)])
    assert Counted.n < 8 * n
    fib, more = [0], [0, 1]
    while len(more) < n:
        fib, more = more, more + fib
    Counted.n = 0
    lyndon([*map(Counted, more[:n]), Counted(-1)])
    assert Counted.n < 20 * n


def test_periodic_runs(spark):
    a, b = "the cat sat on a mat ", "ring the bell "
    texts = [a * 3, "start " + b * 5 + "ring", None, "", " \n", "no no " * 4, "no " * 11, "no\t" * 12, "x" * 9999, " ".join(f"w{k}" for k in range(3000)), (a * 2 + b * 4) * 2, "é è " * 20_000]
    rows = [(None if k == 1 else k % 9, t, "x") for k, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, runs string").repartition(3)
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(df).collect()), key=str)
    want = []
    for i, t, _ in [*rows, rows[0]]:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        found = runs_by_hand(w, 12) if len(w) < 5000 else [(0, len(w), 2)]
        stay = kept(len(w), found) if w else []
        want.append((i, len(w), found, " ".join(x for x, ok in zip(w, stay) if ok)))
    assert got == sorted(want, key=str)
    assert periodic_runs(df.where("doc_id > 99")).collect() == []
    named = spark.createDataFrame([("k", "a b " * 6)], "name string, body string")
    assert periodic_runs(named, "name", "body").select("doc_id", F.size("runs"), "collapsed").first()[:] == ("k", 1, "a b")

"""Parts of the training-data operators against brute force, without Spark."""

import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")

ODD = [" ", "  ", "\n", "\t", "a", "B", "é", "é", "́", "'s", "12", "😀", "\u00a0", "\u3000", "\x1c", "Σ", "中", "<|endoftext|>", "_", "\r\n", "\x85", "ing", "\x00"]
odd_texts = st.lists(st.sampled_from(ODD), max_size=25).map("".join)


@pytest.fixture(scope="module")
def bpe():
    from tokenizers import Tokenizer

    from tessera.llm.tokens import Encoder

    out = {}
    for name, blank in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        out[name] = (Tokenizer.from_file(public_tokenizers.path(name)), Encoder(public_tokenizers.path(name), blank))
    return out


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@settings(max_examples=60, deadline=None)
@given(texts=st.lists(odd_texts, min_size=1, max_size=8))
def test_chunked_ids_are_the_library_s(bpe, name, texts):
    plain, chunked = bpe[name]
    ids, at = chunked.encode(pa.array([*texts, None]))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)] + [[]]


@pytest.fixture(scope="module")
def by_default():
    from tokenizers import Tokenizer

    return {name: Tokenizer.from_file(public_tokenizers.path(name)) for name in ("byte_bpe_50k.json", "word_bpe_49k.json")}


@pytest.mark.parametrize(("name", "blank"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
@settings(max_examples=100, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from([*ODD, "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", " "]), max_size=25).map("".join), min_size=1, max_size=8))
def test_added_tokens_are_the_library_s_default(by_default, name, blank, texts):
    from tessera.llm.tokens import encoder

    texts = ["a <|endoftext|> b", *texts]
    ids, at = encoder(public_tokenizers.path(name), blank).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [e.ids for e in by_default[name].encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 65535), st.integers(0, 5)), max_size=60), max_size=9))
def test_range_coder_round_trip(blocks):
    from tessera.llm.range_coder import decode_blocks, encode_blocks

    arrays = [np.array(b, np.uint32) for b in blocks]
    back = decode_blocks(encode_blocks(arrays), np.array([len(b) for b in arrays], np.int64))
    assert [b.tolist() for b in back] == blocks


def test_range_coder_learns():
    from tessera.llm.range_coder import decode_blocks, encode_blocks

    assert len(encode_blocks([np.tile(np.array([7, 30000, 12], np.uint32), 340)])[0]) < 300
    # Order 0: ids of a skewed law without any order take fewer bits than zlib needs for them.
    rng = np.random.default_rng(8)
    blocks = [np.minimum(rng.zipf(1.3, 1024) * 7, 50_000).astype(np.uint32) for _ in range(40)]
    coded = encode_blocks(blocks)
    assert all((a == b).all() for a, b in zip(blocks, decode_blocks(coded, np.full(40, 1024))))
    assert sum(map(len, coded)) < 0.85 * sum(len(zlib.compress(b.astype("<u2").tobytes(), 9)) for b in blocks)


def test_packer_is_whole_and_close():
    from tessera.llm.packing import Packer

    rng, packer, docs = random.Random(5), Packer(4096, 0), {}
    for k in range(400):
        docs[k] = np.arange(rng.choice([1, 2, 4095, 4096, 4097, 9000, rng.randint(1, 3000)]), dtype=np.uint32) + k
        packer.add(k, docs[k])
    packer.finish()
    parts, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for doc, start, length, ids, n, sequence, offset in packer.rows:
        assert n == len(docs[doc]) and ids == docs[doc][start : start + length].astype("<u4").tobytes()
        parts[doc].append((start, length))
        sequences[sequence].append((offset, length))
    for doc, own in parts.items():
        at = 0
        for start, length in sorted(own):
            assert start == at
            at += length
        assert at == len(docs[doc])
    used = padded = 0
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
        used, padded = used + at, padded + (at if at & (at - 1) == 0 else 4096)
    assert padded / used < 1.01


def _reference_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda d: sum((v := int(c) * (1 + k % 2)) - 9 * (v > 9) for k, c in enumerate(reversed(d))) % 10 == 0
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["1", "2", "255", "999", ".", "..", " ", "-", "+", "(", ")", "@", "a", "b.c", "é", "4111111111111111", "٣"]), max_size=16).map("".join))
def test_pattern_spans(text):
    from tessera.llm.pii import pattern_spans

    assert pattern_spans(text) == _reference_spans(text)


def test_field_on_held_out_texts():
    from tessera.llm.pii import all_spans, generated, labelled, trained_field

    field = trained_field()
    tokens, labels = labelled(*generated(991, 200))
    assert (field.marginals(tokens).argmax(1) == np.concatenate(labels)).mean() > 0.97
    secret = "1eb9c654e721b4f812088970e66a6345cee33dd6"
    base, spans = all_spans([f'the token = "{secret}" and far away {secret} again'], field)[0]
    assert base == [] and [s[0] for s in spans] == ["secret", "secret"]
    assert all_spans([f"commit {secret} of 2024, v2.0, 3.14 and 50%"], field)[0] == ([], [])


def test_field_ties_all_places_of_a_token():
    from tessera.llm.pii import LABELS, all_spans, tokens_of, trained_field

    field = trained_field()
    secret = "1eb9c654e721b4f812088970e66a6345cee33dd6"
    text = f'the token = "{secret}" and ' + f"far away {secret} again " * 40
    _, spans = all_spans([text], field)[0]
    assert [s[0] for s in spans] == ["secret"] * 41
    # Named against the shape: evidence reaches the last place as well as the second.
    odd = "the token = abc-1234 and " + "far away abc-1234 again " * 40
    tokens = tokens_of(odd, [])
    p = field.marginals([tokens])[:, LABELS.index("secret")]
    assert len(p) == 41 and abs(p[1] - p[-1]) < 1e-3


@pytest.mark.parametrize("size", [24, 48, 256, 257, 400, 1200, 10_000])
def test_secrets_of_any_length(size):
    from tessera.llm.pii import all_spans, trained_field

    rng = random.Random(size)
    secret = "9f" + "".join(rng.choice("0123456789abcdef") for _ in range(size - 2))
    text = f'{"x" * 300} token = "{secret}" and later {secret} again'
    _, spans = all_spans([text], trained_field())[0]
    at = text.index(secret)
    assert spans == [("secret", at, at + size), ("secret", text.rindex(secret), text.rindex(secret) + size)]


def test_field_on_sentences_of_another_kind():
    """Sentences that the generator of the training texts does not write: what is found and what is left alone."""
    from tessera.llm.pii import all_spans, trained_field

    key = "Zx9" + "aB3dE5fG7h" * 4
    found = [
        ("Bitte den API_KEY: {} niemandem zeigen.", key, "secret"), ("export password={} # do not commit", "0c1d" * 10, "secret"), ("curl with secret {} works", "77aa88bb" * 4, "secret"),
        ("reach me by mobile: {} after six", "415-555-2671", "phone"), ("the visa {} expired", "4012888888881881", "card"), ("ping host {} twice", "192.168.10.4", "ip"), ("write to {} today", "jane.doe@mail.example.org", "email"),
    ]
    texts = [t.format(x) for t, x, _ in found]
    hits = sum(any(k == kind and a <= t.index(x) + 4 and b >= t.index(x) + len(x) - 4 for k, a, b in spans) for t, (_, spans), (_, x, kind) in zip(texts, all_spans(texts, trained_field()), found))
    assert hits >= 6
    clean = ["In 1987 about 12,500 people lived there (3.4% more than in 1970).", "See chapter 12, pages 304-311 of volume 2.", "Version 10.2.1 was built on 2021-03-04 at 12:45.", "The 4th of 7 teams won 3:2."]
    assert all(spans == [] for _, spans in all_spans(clean, trained_field()))


def test_many_patterns_in_one_token():
    from tessera.llm.pii import _FEATURES, KINDS, pattern_spans, tokens_of

    text = "1.2.3.4,5.6.7.8,9.10.11.12,13.14.15.16,17.18.19.20,a@b.example.com"
    (token,) = tokens_of(text, pattern_spans(text))
    assert token.base and {_FEATURES - len(KINDS) + KINDS.index(k) for k in ("email", "ip")} <= set(token.features)


def test_field_texts_are_judged_alone():
    from tessera.llm.pii import generated, labelled, trained_field

    field = trained_field()
    tokens, _ = labelled(*generated(17, 40))
    alone = np.concatenate([field.marginals([t]) for t in tokens])
    assert np.abs(field.marginals(tokens) - alone).max() < 1e-6


def test_patterns_are_linear():
    import time

    from tessera.llm.pii import all_spans, trained_field

    begun = time.time()
    all_spans(["a" * 500_000, "1" * 500_000, "1." * 200_000, "+1" * 200_000, "@" * 200_000, ""], trained_field())
    assert time.time() - begun < 60


@pytest.fixture(scope="module")
def pieces():
    from sentencepiece import SentencePieceProcessor

    from tessera.llm.pieces import vocabulary

    path = public_tokenizers.path("piece_bpe_32k.model")
    return SentencePieceProcessor(model_file=path), vocabulary(path)


@settings(max_examples=60, deadline=None)
@given(texts=st.lists(odd_texts, min_size=1, max_size=6))
def test_pieces(pieces, texts):
    from tessera.llm.pieces import Encoder

    library, v = pieces
    keys = [str(k) for k in range(len(texts))]
    assert [x.tolist() for x in Encoder(v, 0, 1).encode(texts, keys)] == library.encode(texts)
    for dropout in (0.3, 1.0):
        encoder = Encoder(v, dropout, 3)
        assert [encoder.decode(x) for x in encoder.encode(texts, keys)] == texts


def test_heap_and_side_by_side_agree(pieces, monkeypatch):
    from tessera.llm import pieces as module

    texts = ["the international organisation of understanding " * 3, "überraschungen und unverständlichkeiten"]
    one = module.Encoder(pieces[1], 0.4, 9).encode(texts, ["a", "b"])
    monkeypatch.setattr(module, "LONG", 0)
    two = module.Encoder(pieces[1], 0.4, 9).encode(texts, ["a", "b"])
    assert [x.tolist() for x in one] == [x.tolist() for x in two]
    other = module.Encoder(pieces[1], 0.4, 10).encode(texts, ["a", "b"])
    assert [x.tolist() for x in other] != [x.tolist() for x in two]


def test_dropout_of_every_occurrence_is_its_own(pieces):
    from tessera.llm.pieces import Encoder, _by_heap, _text_key, mix

    v, words = pieces[1], 3000
    (ids,) = Encoder(v, 0.3, 5).encode(["understanding " * words], ["a"])
    ends = np.cumsum(v.spelled_size[ids])
    cuts = np.searchsorted(ends, np.arange(1, words + 1) * len(" understanding"))
    got = [tuple(x.tolist()) for x in np.split(ids, cuts[:-1] + 1)][:words]
    assert len(set(got)) > 50
    symbols, own, limit = v.char[[ord(c) for c in "▁understanding"]].tolist(), _text_key("a", 5), int(0.3 * 2**64)
    for k in range(words - 1):  # the last chunk is followed by a lone space
        key = mix(np.array([own], np.uint64) + mix(np.array([k + 1], np.uint64)))
        assert got[k] == tuple(x for x, _, _ in _by_heap(v, symbols, int(key[0]), limit))


def test_url_rules():
    from tessera.llm.queries import URL_RULES
    from tessera.llm.url_rules import RuleTrie, split_url

    rng, trie = random.Random(2), RuleTrie(URL_RULES)
    for _ in range(4000):
        host = ".".join(rng.choice(["example", "com", "net", "org", "x", ""]) for _ in range(rng.randint(0, 4)))
        path = "".join(rng.choice(["/", "en", "de", "es", "7", "8", "75"]) for _ in range(rng.randint(0, 6)))
        fits = [(len(h + p), v, h + p) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        assert trie.find(host, path) == (best and (best[1], best[2]))
    assert split_url("http://A.Com/En?x#y") == ("a.com", "/En")
    assert split_url(None) == split_url("no url") == ("", "")


def test_trees():
    from tessera.llm.jaccard import tree_components

    rng = random.Random(4)
    for trial in range(150):
        base, sets = [rng.getrandbits(40) for _ in range(rng.randint(3, 60))], []
        for _ in range(rng.randint(2, 20)):
            x = set(base)
            for _ in range(rng.randint(0, 8)):
                x.discard(rng.choice(base)) if rng.random() < 0.5 else x.add(rng.getrandbits(40))
            if x:
                sets.append(tuple(sorted(x)))
        sets = [np.array(t, np.uint64) for t in dict.fromkeys(sets)]
        if not sets:
            continue
        walks = np.array([rng.random() < 0.4 for _ in sets]) if trial % 2 else None
        root = list(range(len(sets)))

        def find(a):
            while root[a] != a:
                a = root[a]
            return a

        for a in range(len(sets)):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if (walks is None or walks[a] or walks[b]) and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    root[find(a)] = find(b)
        groups = lambda of: sorted(sorted(g) for g in _grouped(of))
        assert groups([find(a) for a in range(len(sets))]) == groups(tree_components(sets, walks).tolist())


def _grouped(labels):
    out = collections.defaultdict(list)
    for k, x in enumerate(labels):
        out[x].append(k)
    return out.values()


def test_block_checksums_are_of_the_coded_bytes():
    from tessera.llm.id_files import _segments

    rows = _segments(0, 0, 0, [1, 2], np.arange(3000, dtype=np.uint32), np.array([0, 1000, 3000]), 1024)
    (row,) = rows
    at = 0
    for n, crc in zip(row["block_bytes"], row["block_crc32"]):
        assert zlib.crc32(row["data"][at : at + n]) == crc
        at += n


def test_shards_give_the_best_of_all(monkeypatch):
    """A shard's k best, with ties at the k-th, against the scores of all documents."""
    from tessera.llm import search

    monkeypatch.setattr(search, "BLOCK", 4)
    monkeypatch.setattr(search, "WIDE", 3)
    rng = np.random.default_rng(5)
    for trial in range(30):
        n, vocabulary = int(rng.integers(1, 120)), int(rng.integers(1, 30))
        texts = [np.minimum(rng.zipf(1.6, rng.integers(0, 20)), vocabulary) for _ in range(n)]
        pairs = [(t, k, int((x == t).sum())) for k, x in enumerate(texts) for t in np.unique(x)]
        pairs.sort()
        terms = np.unique([p[0] for p in pairs]).astype("<u8")
        counts = np.array([sum(p[0] == t for p in pairs) for t in terms], "<u4")
        length = np.array([len(x) for x in texts], "<i8")
        ids = rng.permutation(n).astype("<i8")
        row = {"doc_ids": ids, "doc_lengths": length, "terms": terms, "counts": counts, "docs": np.array([p[1] for p in pairs], "<u4"), "freqs": np.array([p[2] for p in pairs], "<u2")}
        average = max(length.mean(), 1e-9)
        shard = search.Shard({name: x.tobytes() for name, x in row.items()}, average)
        asked = np.unique(rng.integers(1, vocabulary + 3, 6)).astype(np.uint64)
        idf = rng.random(len(asked)) + 0.1
        weight = {int(t): w for t, w in zip(asked, idf)}
        score = np.zeros(n)
        for t, k, f in pairs:
            score[k] += weight.get(int(t), 0.0) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length[k] / average))
        score = np.round(score, 6)
        expected = sorted((-s, int(i)) for s, i in zip(score, ids) if s > 0)[:7]
        got = shard.best(asked, idf, 7)
        assert [i for _, i in got] == [i for _, i in expected] and np.allclose([s for s, _ in got], [s for s, _ in expected])


def test_held_suffixes_beyond_the_bound_are_left_open(monkeypatch):
    """All suffixes come out, closed or open, whatever the batches; a key that is open in part is open as a whole."""
    from tessera.llm import repeats

    monkeypatch.setattr(repeats, "HELD", 3)
    rng = np.random.default_rng(3)
    key = np.sort(rng.choice([1, 2, 3, 4, 5, 6], 60, p=[0.1, 0.5, 0.1, 0.1, 0.1, 0.1]))
    doc = np.concatenate([np.arange((key == k).sum()) for k in range(1, 7)])
    rows = pa.record_batch([pa.array(key), pa.array(doc), pa.array(np.zeros(60, np.int64)), pa.array([b"abcde"] * 60, pa.binary())], names=["key", "doc_id", "start", "passages"])
    for size in (1, 4, 60):
        out = pa.Table.from_batches(list(repeats._matches(iter([rows.slice(a, size) for a in range(0, 60, size)])))).to_pydict()
        found = collections.Counter(k for k in out["key"] if k is not None)
        closed = sum(k is None for k in out["key"])
        assert all(n == (key == k).sum() for k, n in found.items()) and {1, 6} <= set(found)
        assert closed == sum((key == k).sum() for k in range(1, 7) if k not in found and (key == k).sum() > 1)


def test_shards_carry_the_best_scores_on(monkeypatch):
    """Many queries at once against shards in a row, each told the k-th best scores of those before, and plain scores of all texts."""
    import math
    import types
    from collections import Counter

    import pyspark

    from tessera.llm import search

    monkeypatch.setattr(pyspark, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 1)))
    rng, k = np.random.default_rng(11), 3
    words = [[f"{kind}{x}" for x in range(300)] for kind in "abc"]
    texts = []
    for kind in rng.choice(3, 500, p=[0.7, 0.2, 0.1]).tolist():
        texts.append(" ".join(words[kind][min(x, 299)] for x in rng.zipf(1.3, rng.integers(0, 60)).tolist()))
    texts += [texts[7]] * 20 + [texts[9] + " " + texts[10], None, "", "a1 " * 70_000 + "b2", *(f"a1 c{x}" for x in range(40))]
    ids = rng.permutation(len(texts)).tolist()
    held = [Counter((t or "").split()) for t in texts]
    df, n = Counter(w for h in held for w in h), len(texts)
    average = sum(sum(h.values()) for h in held) / n
    asked = [i for i in range(0, n, 3) if held[i]]
    batch = pa.record_batch([pa.array(ids), pa.array(texts)], names=["doc_id", "text"])
    hashed = {w: search.Words(pa.array([w])).hash[0] for w in df}
    terms = np.unique(np.array(list(hashed.values())))
    idf = np.zeros(len(terms))
    for w, h in hashed.items():
        idf[np.searchsorted(terms, h)] = math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
    rows = [np.sort(np.searchsorted(terms, [hashed[w] for w in held[i]])) for i in asked]
    query = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    expected = []
    for q in asked:
        scores = [round(sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * h[w] * 2.2 / (h[w] + 1.2 * (0.25 + 0.75 * sum(h.values()) / average)) for w in held[q] if w in h), 6) for h in held]
        expected.append(sorted((-s, ids[d]) for d, s in enumerate(scores) if held[d].keys() & held[q].keys())[:k])
    for small in ({}, {"POSTINGS": 900, "STRETCH": 4, "DENSE": 0.3, "AT_ONCE": 5, "CELLS": 300, "ADDED": 50}, {"POSTINGS": 2500, "BLOCK": 150, "WIDE": 5, "DENSE": 0.1, "ADDED": 7}):
        for name, value in small.items():
            monkeypatch.setattr(search, name, value)
        found, least = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)), np.full(len(asked), -1.0)
        shards = list(search._indexed(iter([batch.slice(a, 40) for a in range(0, n, 40)])))
        assert len(shards) > 1 or not small
        for made in shards:
            shard = search.Shard({c: made.column(c)[0].as_py() for c in made.schema.names}, average)
            number = shard.valued(terms, idf)
            more = shard.best_of(query, number[np.concatenate(rows)], least, k)
            found = search._best(k, *(np.concatenate(x) for x in zip(found, more)))
            for q in range(len(asked)):
                own = found[1][found[0] == q]
                least[q] = own[-1] if len(own) == k else -1
        for q, best in enumerate(expected):
            got = sorted(zip((-found[1][found[0] == q]).tolist(), found[2][found[0] == q].tolist()))
            assert [i for _, i in got] == [i for _, i in best] and np.allclose([s for s, _ in got], [s for s, _ in best], atol=1.1e-6), (small, q)

"""The training-data operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from tessera.llm.queries import vocabulary  # noqa: E402
from tests.conftest import DATA, same_rows  # noqa: E402

PROSE = " ".join(f"w{k * 7919 % 613}" for k in range(90))
OTHER = " ".join(f"v{k * 104729 % 811}" for k in range(120))
TEXTS = [
    PROSE, PROSE, PROSE + " and one more", OTHER, None, "", " \n\t ", "one", "two words", OTHER.upper(), PROSE.replace("w7 ", "changed "),
    "start here " + " ".join(OTHER.split()[20:90]) + " end there", "a.12@mail.example.com x +1 (523) 555-1055 y 4111111111111111 z 10.0.0.1", "x" * 30_000, "word " * 6_000,
    "Released under the MIT License.", "# " * 40, "line of text\n" * 5 + "tail " * 20,
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, `class` string, start string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else "s", len(t or ""), "x", "y", "z") for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_id_files(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    from tessera.llm.id_files import read_ids, write_ids

    path = vocabulary("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    write_ids(docs, str(tmp_path / "a"), path)
    got = {r.doc_id: r for r in read_ids(spark, str(tmp_path / "a")).collect()}
    at = 0
    for k, t in enumerate(TEXTS):
        ids = np.array(plain.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        assert (got[k].start, got[k].n_tokens, bytes(got[k].ids)) == (at, len(ids), ids.tobytes())
        at += len(ids)
    write_ids(none, str(tmp_path / "b"), path)
    assert read_ids(spark, str(tmp_path / "b")).count() == 0
    bad = spark.read.parquet(str(tmp_path / "a")).withColumn("data", F.concat(F.unhex(F.lit("ffff")), F.expr("substring(data, 3)")))
    bad.write.parquet(str(tmp_path / "c"))
    with pytest.raises(Exception, match="CorruptBlock"):
        read_ids(spark, str(tmp_path / "c")).collect()


def test_packing(spark, docs, none):
    from tokenizers import Tokenizer

    from tessera.llm.packing import pack

    path = vocabulary("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    parts = collections.defaultdict(list)
    for r in pack(docs, path).collect():
        parts[r.doc_id].append((r.start, bytes(r.ids)))
    for k, t in enumerate(TEXTS):
        ids = np.array(plain.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        assert b"".join(x for _, x in sorted(parts[k])) == ids.tobytes()
    assert pack(none, path).count() == 0


def test_quality_statistics(docs, none):
    from tessera.llm.quality import judge

    word = re.compile(r"[^\x20\x09-\x0D]+")
    got = {r.doc_id: r for r in judge(docs).collect()}
    for k, t in enumerate(TEXTS):
        t = t or ""
        w = word.findall(t)
        windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        repeated = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if word.search(x)]
        failed = len(w) < 20 or 100 * len(repeated) > 30 * len(w)
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeated), failed)
        assert r.kept == (not failed) and r.ids == "x"
    assert judge(none).count() == 0


def test_quality_outliers(spark):
    from tessera.llm.quality import judge

    rng = random.Random(3)
    clean = [(k, " ".join(f"word{rng.randrange(500)}" for _ in range(60 + k % 40)), "en", "a") for k in range(200)]
    junk = [(1000 + k, " ".join(f"bad{j}$$$%%%" for j in range(60 + k)), "en", "a") for k in range(20)]
    kept = {r.doc_id: r.kept for r in judge(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")).collect()}
    assert all(kept[k] for k in range(200)) and not any(kept[1000 + k] for k in range(20))


def brute_mcd(x, share, tries=300):
    """Squared distances by the least determinant of many random starts, with the operator's floors, levels and reweighting."""
    from tessera.llm.quality import CHI2_975, CHI2_MEDIAN, FLOORS

    rng = np.random.default_rng(1)
    floors = np.diag(np.square(FLOORS))

    def estimate(rows):
        return rows.mean(0), np.cov(rows.T, bias=True).reshape(4, 4) + floors

    def distances(centre, scatter):
        y = np.linalg.solve(np.linalg.cholesky(scatter), (x - centre).T)
        return (y * y).sum(0)

    def top(d, part):
        levels = np.sort(np.floor(32 * np.log2(d + 1e-6)))
        return levels[int(np.ceil(part * len(d) - 1e-9)) - 1]

    best = None
    for _ in range(tries):
        fit, volume = estimate(x[rng.choice(len(x), 8, replace=False)]), np.inf
        while True:
            d = distances(*fit)
            fit = estimate(x[np.floor(32 * np.log2(d + 1e-6)) <= top(d, share)])
            now = np.linalg.slogdet(fit[1])[1]
            if now >= volume - 1e-4:
                break
            volume, kept = now, fit
        if best is None or volume < best[0]:
            best = volume, kept
    d = distances(*best[1])
    scale = max(2.0 ** ((top(d, 0.5) + 1) / 32) / CHI2_MEDIAN, 0.05)
    return distances(*estimate(x[d <= max(scale, 1.0) * CHI2_975]))


def test_quality_distances_against_brute_force(spark):
    """Groups with a cluster of outliers: the verdicts are those of the least determinant of 300 starts, the distances near."""
    from tessera.llm.quality import _KEYS, _STATS, _distances, _fitted

    rng = np.random.default_rng(12)
    groups = {}
    for name, n, out in (("a", 300, 0), ("b", 200, 60), ("c", 150, 50)):
        x = rng.normal(size=(n, 4)) @ rng.normal(size=(4, 4)) * 0.4
        groups[name] = np.concatenate([x, rng.normal(size=(out, 4)) * 0.1 + [6, -5, 4, 5]])
    rows = [("en", g, *map(float, v)) for g, x in groups.items() for v in x]
    table = spark.createDataFrame(rows, [*_KEYS, *_STATS])
    got = {(r[_KEYS[1]], *(r[c] for c in _STATS)): r["__q_d"] for r in _distances(table, _fitted(table, 0.6, 1e-4)).collect()}
    for g, x in groups.items():
        ours = np.array([got[(g, *map(float, v))] for v in x])
        least = brute_mcd(x, 0.6)
        assert ((ours > 20) == (least > 20)).all() and np.median(np.abs(ours / least - 1)) < 0.08


def test_quality_outliers_of_small_groups(spark):
    """Sources of a row each, and languages under the least count: each passing row is judged."""
    from tessera.llm.quality import judge

    rng = random.Random(4)
    words = lambda n: " ".join(f"word{rng.randrange(500)}" for _ in range(n))
    rows = [(k, words(60 + k % 40), "en", f"host{k}") for k in range(120)] + [(200 + k, words(60 + k), None, None) for k in range(5)]
    rows += [(1000 + k, " ".join(f"bad{j}$$$%%%" for j in range(60 + k)), ("en", "de", None)[k % 3], f"junk{k}") for k in range(6)]
    got = {r.doc_id: r for r in judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert len(got) == len(rows) and all(r.distance is not None for r in got.values())
    assert {k for k, r in got.items() if not r.kept} == {1000 + k for k in range(6)}


def test_pii(docs, none):
    from tessera.llm.pii import find_pii

    got = {r.doc_id: r for r in find_pii(docs, redact=True).collect()}
    assert (got[12].n_email, got[12].n_ip, got[12].n_card, got[12].n_phone) == (1, 1, 1, 1)
    assert got[12].text == "[EMAIL] x [PHONE] y [CARD] z [IP]"
    assert all(got[k].text == t for k, t in enumerate(TEXTS) if k != 12)
    assert find_pii(none).count() == 0


def test_licenses(docs, none):
    from tessera.llm.licenses import scan_licenses

    got = {r.doc_id: r for r in scan_licenses(docs).collect()}
    assert (got[15].n_base, got[15].first_word, got[15].labels, got[15].score) == (1, 3, "mit", 1.0)
    assert len(got) == len(TEXTS) and all(r.labels == "" for k, r in got.items() if k != 15)
    assert scan_licenses(none).count() == 0
    spark = docs.sparkSession
    near = spark.createDataFrame([(1, "x Permission is hereby granted free of any charge, to any person obtaining one copy of this software and associated documentation files y")] * 2, "doc_id long, text string")
    assert [r.labels for r in scan_licenses(near).collect()] == ["mit", "mit"]


LGPL = "This file is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."
GPL = LGPL.replace("Lesser ", "")


def brute_licenses(text, templates, least=0.6, k=3, near=4):
    """Contract columns and labels by plain loops over words."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own, base = words(text), []
    for phrase, label in {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}.items():
        p = phrase.split()
        base += [(i, label) for i in range(len(own)) if own[i : i + len(p)] == p]
    spans = []
    for label, t in templates:
        t = words(t)
        runs = range(len(t) - k + 1)
        votes = [(i - j, i, j) for i in range(len(own) - k + 1) for j in runs if own[i : i + k] == t[j : j + k]]
        group, last, end = [], None, None
        for d in sorted({v[0] for v in votes}):
            at = [v for v in votes if v[0] == d]
            if last is None or d - last > near or at[0][1] > end + k + near:
                group.append([])
            last, end = d, max(end or 0, at[-1][1])
            group[-1] += at
        for g in group:
            held = len({v[2] for v in g})
            if held >= least * len(runs):
                spans.append((-held / len(runs), -held, label, {v[1] for v in g}))
    labels = set()
    for s in spans:
        won = sum(min(o for o in spans if i in o[3])[2] == s[2] for i in s[3])
        if 2 * won >= len(s[3]):
            labels.add((s[2], -s[0]))
    at, held = [i for i, _ in base], {x for _, x in base}
    return (len(own), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(held)), ",".join(sorted(held | {x for x, _ in labels})), max((x for _, x in labels), default=0.0))


def test_licenses_against_brute_force(docs):
    from tessera.llm.licenses import TEMPLATES, scan_licenses

    spark, rng = docs.sparkSession, random.Random(5)
    texts = [LGPL, GPL, GPL + " -- " + LGPL, LGPL.upper(), "cc by cc by CC-BY\nMIT license apache, license", *TEXTS[:13], *TEXTS[15:]]
    for _ in range(60):
        parts = []
        for _, t in rng.choices(TEMPLATES, k=rng.randrange(1, 4)):
            w = t.split()
            w = [x for x in w if rng.random() > 0.04] if rng.random() < 0.6 else w[: rng.randrange(len(w)) + 1]
            parts += [*w, *rng.choices(["of", "the", "license", "cc", "by", "MIT", "é", "n0"], k=rng.randrange(9))]
        texts.append(rng.choice([" ", "\n", " * "]).join(parts))
    rows = [(k, t, "a", "b", "c", [1.5]) for k, t in enumerate(texts)] + [(0, texts[0], None, None, None, None), (None, texts[1], "a", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, labels string, words string, `__w` string, grams array<double>").repartition(3)
    got = collections.defaultdict(list)
    for r in scan_licenses(df).collect():
        got[r.doc_id].append((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)))
    for k, t in enumerate(texts):
        *base, score = brute_licenses(t, TEMPLATES)
        assert got[k] == [(*base, round(score, 9))] * (2 if k == 0 else 1), t
    assert got[None] == got[1]
    assert [got[k][0][5] for k in range(4)] == ["lgpl", "gpl", "gpl,lgpl", "lgpl"]


def brute_repeats(texts):
    """(doc, is_repeat): {word place: the least other document}, from all 50-word windows."""
    word, places = re.compile(r"[^\x20\x09-\x0D]+"), collections.defaultdict(list)
    for k, t in enumerate(texts):
        w = word.findall(t or "")
        for i in range(len(w) - 49):
            places[tuple(w[i : i + 50])].append((k, i))
    starts = collections.defaultdict(dict)
    for own in places.values():
        if len(own) > 1:
            starts[own[0][0], False][own[0][1]] = own[1][0]
            for k, i in own[1:]:
                starts[k, True][i] = own[0][0]
    out = set()
    for (k, repeat), own in starts.items():
        begin = end = other = None
        for i in sorted(own):
            if end is None or i > end:
                if end is not None:
                    out.add((k, begin, end, repeat, other))
                begin, other = i, own[i]
            end, other = i + 50, min(other, own[i])
        out.add((k, begin, end, repeat, other))
    return out


def found_repeats(df):
    from tessera.llm.repeats import repeated_passages

    rows = repeated_passages(df).collect()
    assert all(r.n_words == r.end_word - r.start_word for r in rows)
    out = {(r.doc_id, r.start_word, r.end_word, r.is_repeat, r.other_doc_id) for r in rows}
    assert len(out) == len(rows)
    return out


def test_repeats(spark, docs, none):
    from tessera.llm.repeats import cut_repeats, repeated_passages

    assert found_repeats(docs) == brute_repeats(TEXTS)
    assert repeated_passages(none).count() == 0
    cut = {r.doc_id: r.text for r in cut_repeats(docs, repeated_passages(docs)).collect()}
    assert cut[0] == PROSE and 1 not in cut and cut[2] == "and one more" and cut[11] == "start here end there" and cut[4] is None


def test_repeats_with_many_surroundings(spark, monkeypatch):
    """One passage with many surroundings, within texts and over them; tables, tasks and held groups of several sizes."""
    from tessera.llm import repeats

    common = [f"c{k}" for k in range(55)]
    texts = [" ".join([f"a{n}_{k}" for k in range(n % 9)] + common + [f"b{n % 7}_{k}" for k in range(n % 31)] + (common if n % 40 == 3 else [])) for n in range(120)]
    texts += [" ".join(common * 3), " ".join(f"r{k % 7}" for k in range(200))]
    expected = brute_repeats(texts)
    for parts in (1, 64):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
        assert found_repeats(df) == expected
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for shuffled in ("7", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", shuffled)
            assert found_repeats(df) == expected
            monkeypatch.setattr(repeats, "FEW", 0)  # then by joins
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repeats_null_and_shared_ids(spark):
    """Rows of one id, or of none, are one document: a row that stands twice repeats nothing."""
    rows = [(None, PROSE), (None, PROSE), (4, PROSE), (4, PROSE), (9, OTHER), (9, OTHER)]
    got = found_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == {(None, 0, 90, False, 4), (4, 0, 90, True, None)}


def brute_links(texts):
    lower, sets = {c: c + 32 for c in range(65, 91)}, []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(sets)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(s), find(k)) for k, s in enumerate(sets)}


def test_jaccard(spark, docs, none):
    from tessera.llm.jaccard import jaccard_components

    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()}
    assert got == brute_links(TEXTS)
    assert jaccard_components(none).count() == 0


def test_jaccard_passages_of_unlike_texts(spark, monkeypatch):
    """Passages that tie unlike texts in a long chain leave no large group, even if few shingles are known as frequent."""
    from tessera.llm import jaccard

    passage = lambda k: " ".join(f"p{k}x{i}" for i in range(50))
    texts = [" ".join([passage(k), *(f"t{k}x{i}" for i in range(120)), passage(k + 1)]) for k in range(48)]
    texts += [texts[3].replace("t3x60 ", "changed "), texts[9] + " more", texts[9] + " other"]
    monkeypatch.setattr(jaccard, "FREQUENT", 1)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "_of_large_groups", None)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    assert got == {k: {48: 3, 49: 9, 50: 9}.get(k, k) for k in range(51)}


def test_jaccard_near_copies(spark, monkeypatch):
    from tessera.llm import jaccard

    rng, base, texts = random.Random(6), [f"t{k}" for k in range(80)], []
    for _ in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(1000)}"
        texts.append(" ".join(w[: rng.randint(55, 80)]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    expected, before = brute_links(texts), spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()} == expected
    for block, shingles in ((40, 400_000), (1024, 900)):  # pairs of blocks, then many blocks
        monkeypatch.setattr(jaccard, "BLOCK", block)
        monkeypatch.setattr(jaccard, "SHINGLES", shingles)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()} == expected
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_jaccard_null_ids_and_repeated_rows(spark):
    from tessera.llm.jaccard import jaccard_components

    rows = [(None, PROSE), (None, PROSE + " more"), (5, PROSE), (5, PROSE), (3, OTHER), (None, "no copy of this text"), (8, None), (9, OTHER + " x")]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(None, 86, 5), (None, 87, None), (5, 86, 5), (3, 116, 3), (None, 1, None), (8, 0, 8), (9, 117, 3)}


def test_search(spark, docs, none):
    from tessera.llm.search import build_index, top_k

    rows = top_k(docs.where("doc_id IN (0, 3, 4, 5)"), build_index(docs), k=3).collect()
    got = {(r.query_id, r.rank): r.doc_id for r in rows}
    assert got[0, 1] == 0 and got[0, 2] == 1 and {q for q, _ in got} == {0, 3}
    assert top_k(none, build_index(docs)).count() == 0 and top_k(docs, build_index(none)).count() == 0


def test_search_in_few_shards_and_several_packs(spark, monkeypatch):
    """The parts of an input do not make shards of their own, nor rows for each of them; packs of queries give what one gives."""
    from tessera.llm import search

    few = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").limit(200).localCheckpoint()
    many = few.repartition(50)
    index = search.build_index(many)
    assert index.count() <= search._tasks(many) < 50
    rows = lambda: {tuple(r) for r in search.top_k(few.where("doc_id % 5 = 0"), index, k=4).collect()}
    whole = rows()
    monkeypatch.setattr(search, "PACK", 7)
    assert rows() == whole and len(whole) > 100


def test_pieces(docs, none):
    from tessera.llm.pieces import decode_pieces, encode_pieces

    path = vocabulary("piece_bpe_32k.model")
    out = decode_pieces(encode_pieces(docs, path, 0.2, 4, check=True), path).collect()
    assert all(r.lossless and r.decoded == (TEXTS[r.doc_id] or "") for r in out) and len(out) == len(TEXTS)
    assert encode_pieces(none, path).count() == 0


def test_url_filter(spark):
    from tessera.llm.queries import URL_RULES
    from tessera.llm.url_rules import judge_urls

    rows = [(1, "http://www.example.com/en/75?x"), (2, "https://a.com/en/"), (3, None), (4, "plain"), (4, "plain"), (5, "x://a.net/de/8#"), (6, "x://example.net/de/8")]
    got = [(r.page_id, r.rule, r.verdict, r.kind) for r in judge_urls(spark.createDataFrame(rows, "page_id int, url string").withColumn("kind", F.lit("k")), URL_RULES).orderBy("page_id").collect()]
    assert got == [(1, "example.com/en/7", "allow", "k"), (2, "com/en/", "block", "k"), (3, None, "allow", "k"), (4, None, "allow", "k"), (4, None, "allow", "k"), (5, "net/de/", "allow", "k"), (6, "example.net/de/8", "block", "k")]


def test_url_filter_by_trie_and_by_join(spark):
    """Both ways agree with plain loops over all rules, on names that clash, repeated and null rows and empty tables."""
    from tessera.llm.url_rules import judge_urls, split_url

    rng = random.Random(8)
    part = lambda many: "".join(rng.choice(["/", "en", "de", "7", "8", "75", ".", "\n"]) for _ in range(rng.randrange(many)))
    host = lambda: ".".join(rng.choice(["example", "com", "net", "x", ""]) for _ in range(rng.randrange(4)))
    rules = [(rng.choice(["allow", "block"]), host(), part(5)) for _ in range(60)]
    rules = [*rules, ("block", "com", "/en/"), ("allow", "com", "/en/"), ("allow", "", "/7")]
    urls = [*(f"http://{host()}{rng.choice(['', '/'])}{part(6)}{rng.choice(['', '?q', '#f'])}" for _ in range(300)), None, "", "plain", "http://COM/en/x", "http://COM/en/x", "http://a.com/" + "en/" * 3000]
    df = spark.createDataFrame([(k, u, "r", "h", {"a": 1}) for k, u in enumerate(urls)], "page_id long, url string, rule string, host string, more map<string,int>")
    table = spark.createDataFrame([*rules, (None, "com", "/")], "verdict string, host string, path string")
    for most in (1000, 5):
        for given in (rules, table):
            got = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.more) for r in judge_urls(df, given, most=most).collect()}
            for k, u in enumerate(urls):
                h, p = split_url(u)
                fits = [(len(a + b), v == "allow", a + b, v) for v, a, b in rules if (not a or h == a or h.endswith("." + a)) and p.startswith(b)]
                best = max(fits, default=(0, 0, None, "allow"))
                assert got[k] == (h, p, best[2], best[3], {"a": 1}), (u, most)
        assert judge_urls(df.limit(0), rules, most=most).count() == 0
        kept = judge_urls(df.limit(3), table, prefix="url_", most=most)
        assert kept.where("host = 'h' AND rule = 'r'").count() == 3
    assert judge_urls(df, table.limit(0)).where("verdict = 'allow' AND rule IS NULL").count() == len(urls)


@pytest.mark.parametrize("name", ["op3_block_max_wand", "op7_url_rules", "op9_sparse_suffix_arrays", "op10_prefix_tree_join"])
def test_sql(spark, duck, name):
    from tessera.llm.queries import ORACLES, QUERIES

    same_rows(QUERIES[name](spark, DATA), duck.sql(ORACLES[name]))


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = corpus_pipeline.near_copies(spark, corpus_pipeline.quality(spark, docs, DATA), DATA)
    assert kept.columns == docs.columns
    texts = [r.text for r in kept.orderBy("doc_id").collect()]
    assert all(root == k for k, (_, root) in brute_links(texts).items())
    out = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id for r in out} <= {r.doc_id for r in kept.collect()} and len(out) > 100
    assert all(len(r.ids) == 4 * r.length for r in out)


def test_likely(spark):
    from tessera.llm import common

    keys = spark.range(0, 3000, 3).union(spark.sql("SELECT CAST(NULL AS BIGINT)"))
    rows = keys.union(spark.range(1, 30001, 3))
    found = [r.id for r in rows.where(common.likely(keys, "id")).collect()]
    assert {None, *range(0, 3000, 3)} <= set(found) and len(found) < 1001 + 500
    assert spark.range(5).where(common.likely(keys.where("id < 0"), "id")).count() == 0


def shuffled(spark):
    """Bytes of all shuffles so far."""
    context = spark.sparkContext
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_texts_without_copies_are_not_shuffled(spark):
    """The last steps of repeats and near copies, and the gathering of texts that may have links, as in large tables (no broadcast)."""
    import corpus_pipeline
    from tessera.llm.jaccard import jaccard_components
    from tessera.llm.repeats import without_repeats

    rng = random.Random(4)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=5000)) + f" {k}" for k in range(300)]
    own = [" ".join(f"r{k}x{i}" for i in range(120)) for k in range(4)]
    rows = [*enumerate(texts + own), (400, own[1] + " more"), (401, own[2])]
    size = sum(len(t) for _, t in rows)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string")
        for step, expected in ((without_repeats, {400: "more", 401: None}), (lambda df: corpus_pipeline.near_copies(spark, df, DATA), {400: None, 401: None})):
            at = shuffled(spark)
            got = {r.doc_id: r.text for r in step(df).collect()}
            assert shuffled(spark) - at < size / 3
            assert got == {k: t for k, t in (dict(rows) | expected).items() if t is not None}
        at = shuffled(spark)
        assert {r.doc_id for r in jaccard_components(df).where("component_id != doc_id").collect()} == {400, 401}
        assert shuffled(spark) - at < size / 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_shingles_are_handed_on_in_ten_bytes():
    import pyarrow as pa

    from tessera.llm import jaccard

    texts = [" ".join(f"a{i}" for i in range(204)), " ".join(f"a{i}" for i in range(200)), " ".join(f"b{i}" for i in range(204))]
    tasks = [[texts[0], texts[1]], [texts[2]], [texts[2] + " x"]]
    rows = [b for own in tasks for b in jaccard._begun(iter([pa.record_batch([pa.array(range(len(own))), pa.array(own)], names=["doc_id", "text"])]))]
    table = pa.Table.from_batches(rows)
    begin = lambda t: (x := jaccard.Sets(pa.array([t]), np.zeros((2, 0), np.uint64))).key[: x.n[0] // 4 + x.n[0] // 8 + 1].tolist()
    assert sum(len(x.as_py() or b"") for x in table["packed"]) == 10 * sum(len({s for t in own for s in begin(t)}) for own in tasks)
    total = collections.Counter()
    for b in jaccard._shared(iter(table.sort_by("bucket").combine_chunks().to_batches())):
        for group, _, count in zip(*(c.to_pylist() for c in b.columns)):
            total[group] += count
    classes = jaccard._short(jaccard.Sets(pa.array([texts[0], texts[1], texts[2], tasks[2][0]]), np.zeros((2, 0), np.uint64)).classes()).tolist()
    begins = [set(begin(t)) for t in (texts[0], texts[1], texts[2], tasks[2][0])]
    # A shingle that a class shares is counted once for it, not by its task and again over all.
    assert [total[c] for c in classes] == [len(begins[k] & begins[k ^ 1]) for k in range(4)]

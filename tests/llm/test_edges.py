"""Rows that share an id or have none, clashing names, and the pipeline over such rows."""

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from tessera.llm.quality import judge  # noqa: E402
from tessera.llm.repeats import cut_repeats, repeated_passages, without_repeats  # noqa: E402

LONG = " ".join(f"w{k * 7919 % 100_003}" for k in range(60))
OTHER = " ".join(f"v{k * 104_729 % 100_019}" for k in range(120))
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def cut_by_hand(rows):
    """Texts without the repeats: the first place of a 50-word passage stays, in the order of (id, text), ids without rows last."""
    seen, out = set(), []
    for i, t in rows:
        w = (t or "").split()
        gone = set()
        for k in range(len(w) - 49):
            passage = tuple(w[k : k + 50])
            if passage in seen:
                gone |= set(range(k, k + 50))
            seen.add(passage)
        left = [x for k, x in enumerate(w) if k not in gone]
        if not gone or left:
            out.append((i, " ".join(left)))
    return sorted(out, key=str)


def test_rows_that_share_an_id(spark):
    """The passage stays in one of the texts, and words that repeat nothing stay in all."""
    rows = [(1, LONG), (2, "a few words"), (2, f"{LONG} tail"), (2, OTHER), (None, "none at all"), (None, f"head {LONG}"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, without_repeats(df).collect()), key=str)
    want = [(1, LONG), (2, "a few words"), (2, "tail"), (2, OTHER), (None, "none at all"), (None, "head "), (None, None)]
    assert got == sorted(want, key=str)


def test_ids_of_one_text(spark):
    rows = [(k, t) for k, t in enumerate([OTHER, f"x {LONG}", f"{LONG} y", OTHER, "short", f"{OTHER} {LONG}", ""])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(((r.doc_id, " ".join(r.text.split())) for r in without_repeats(df).collect()), key=str)
    assert got == cut_by_hand(rows)
    assert sorted(map(tuple, cut_repeats(df, repeated_passages(df)).collect())) == sorted(map(tuple, without_repeats(df).collect()))


def test_clashing_names(spark):
    rows = [(1, LONG, 1, 2, 3, 4, 5), (2, f"{LONG} z", 1, 2, 3, 4, 5)]
    names = ["doc_id", "text", "__spans", "__id", "id_", "spans_", "a.b"]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` {'string' if n == 'text' else 'long'}" for n in names))
    want = [rows[0], (2, "z", *rows[1][2:])]
    assert sorted(map(tuple, without_repeats(df).collect())) == want
    odd = df.withColumnsRenamed({"__spans": "__q_x0", "__id": "__q_lang", "id_": "__q_d"}).withColumns({"lang": F.lit("en"), "source": F.lit("s"), "m": F.create_map(F.lit("a"), F.lit(1))})
    out = judge(odd)
    assert set(odd.columns) <= set(out.columns) and {(r["__q_x0"], r["__q_lang"]) for r in out.collect()} == {(1, 2)}


def test_pipeline_over_shared_and_missing_ids(spark, tmp_path):
    plain = " ".join(f"word{k % 37} and{k}" for k in range(40))
    texts = [(1, LONG), (2, f"{plain} mail me at a.b@example.org"), (2, f"{LONG} and a tail of other words that stay here for good"), (None, OTHER), (None, f"{OTHER} more"), (3, None), (4, ""), (5, LONG), (5, LONG), (None, None)]
    folder = str(tmp_path / "in")
    rows = [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else "web", len(t or "")) for k, (i, t) in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).repartition(2).write.parquet(f"{folder}/documents.parquet")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), DOCS)
        kept.append(sorted(((r.doc_id, r.text) for r in docs.collect()), key=str))
        assert all(r.n_chars == len(r.text or "") for r in docs.collect()) or name == "quality rules"
    quality, near, cut, clean = kept
    assert [x for x in quality if not x[1] or len(x[1].split()) < 20] == []
    assert near.count((5, LONG)) == 0 and (1, LONG) in near
    assert (1, LONG) in cut and all(LONG not in t for i, t in cut if i != 1)
    assert all("a.b@example.org" not in t for _, t in clean) and len(clean) == len(cut)
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert sum(r.length for r in pieces if r.start == 0) > 0 and len({r.doc_id for r in pieces}) == len({i for i, _ in clean})


def test_pipeline_over_no_rows(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_shards_bounded_by_postings(monkeypatch):
    """Texts of many words close a shard before it has all its documents."""
    import types

    import pyarrow as pa
    import pyspark

    from tessera.llm import search

    texts = [" ".join(f"w{(k * j) % 17}" for j in range(1, 12)) for k in range(40)]
    batches = [pa.record_batch([pa.array(range(k, k + 4)), pa.array(texts[k : k + 4])], names=["doc_id", "text"]) for k in range(0, 40, 4)]
    monkeypatch.setattr(pyspark, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 1)))
    (whole,) = search._indexed(iter(batches))
    monkeypatch.setattr(search, "POSTINGS", 60)
    parts = list(search._indexed(iter(batches)))
    assert whole.column(1)[0].as_py() == 40 and len(parts) > 4
    assert sum(p.column(1)[0].as_py() for p in parts) == 40 and len({p.column(0)[0].as_py() for p in parts}) == len(parts)
    assert sum(p.column(2)[0].as_py() for p in parts) == whole.column(2)[0].as_py()

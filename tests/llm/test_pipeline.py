"""The pipeline's stages against brute force, each on its own input."""

import re

from pyspark.sql import functions as F

import corpus_pipeline as P
from mercadia.llm import toxicity
from mercadia.llm._common import stored, table
from mercadia.llm.jaccard_join import near_duplicates
from tests.llm.cases import documents, empty, rows
from tests.llm.test_native import brute_leaks


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    scores = {r.doc_id: r.score for r in toxicity.toxicity(docs, table(spark, sf, "labels")).collect()}
    clean = P.drop_toxic(spark, docs, sf).cache()
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == {i for i, s in scores.items() if s < 0.5}
    safe = P.drop_contaminated(spark, clean, sf)
    items = [tuple(r) for r in table(spark, sf, "benchmark").collect()]
    leaks = {r[0] for r in brute_leaks([(r.doc_id, r.text) for r in clean.collect()], items) if r[5]}
    assert leaks and safe.columns == columns and {r.doc_id for r in safe.collect()} == {r.doc_id for r in clean.collect()} - leaks
    hidden = P.hide_secrets(spark, clean, sf)
    assert hidden.columns == columns and hidden.count() == clean.count()
    assert rows(P.hide_secrets(spark, hidden, sf)) == rows(hidden)


def test_run(spark, sf):
    got = P.run(spark, sf)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    n = table(spark, sf, "documents").count()
    assert 0.5 * n < got.count() < n and got.select("doc_id").distinct().count() == got.count()


def test_stages_on_cases(spark, sf):
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, empty(spark), sf).count() == 0, name
        assert stage(spark, documents(spark), sf).columns == documents(spark).columns, name


def test_columns_of_any_name(spark, sf):
    docs = table(spark, sf, "documents").limit(60)
    odd = ["__m_key", "__m_score", "a.b", "tick`s", "key", "place", "Text"]
    for i, name in enumerate(odd):
        docs = docs.withColumn(f"o{i}", F.concat(F.lit(f"{name}:"), F.col("doc_id").cast("string")))
    docs = stored(docs.toDF(*docs.columns[: -len(odd)], *odd[:-1], "Text2"), "odd")
    for name, stage in P.STAGES[:-1]:
        got = stage(spark, docs, sf)
        assert got.columns == docs.columns, name
        kept = [tuple(r) for r in got.toDF(*[f"c{i}" for i in range(len(docs.columns))]).collect()]
        assert kept and all(v == f"{o}:{r[0]}" for r in kept for o, v in zip(odd, r[-len(odd) :])), name
    assert P.mix_sources(spark, docs, sf).columns == ["doc_id", "size", "source_size", "target", "taken"]


def test_near_duplicates_and_mix_within_the_pipeline(spark, sf):
    """The two stages against what their operators say of the same documents."""
    docs = table(spark, sf, "documents")
    found = near_duplicates(docs).where("kept").select("doc_id")
    kept = P.drop_near_duplicates(spark, docs, sf)
    assert rows(kept, "doc_id") == rows(found) and kept.count() < docs.count()
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in kept.collect()}
    mixed = {r.doc_id: r for r in P.mix_sources(spark, kept, sf).collect()}
    assert {i: r["size"] for i, r in mixed.items()} == words
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in mixed.values())
    totals: dict = {}
    for r in kept.collect():
        totals.setdefault(r.source, [0, 0.0, 0])
        totals[r.source][0] += mixed[r.doc_id]["taken"]
        totals[r.source][1] = mixed[r.doc_id]["target"]
        totals[r.source][2] += words[r.doc_id]
    longest = max(words.values())
    assert all(abs(taken - target) <= 2 * longest and target <= 2 * size + 1e-6 for taken, target, size in totals.values())


def test_toxicity_gives_python_few_rows_and_leaves_no_model(spark, sf, monkeypatch):
    """A batch of texts is held by the JVM and by Python at once, and what Python workers and executors hold stays for the next stages."""
    docs = table(spark, sf, "documents").coalesce(1)
    most, freed = 64, []

    def small(batches):
        for batch in batches:
            assert batch.num_rows <= most
            yield batch

    def score(rows, model, *keep, **how):
        rows = rows.mapInArrow(small, rows.schema)
        monkeypatch.setattr(model, "unship", lambda f=model.unship: freed.append(f()))
        return toxicity.score(rows, model, *keep, **how)

    monkeypatch.setattr(P, "score", score)
    monkeypatch.setattr(P, "ROWS_AT_ONCE", most)
    kept = P.drop_toxic(spark, docs, sf)
    assert docs.count() > most and 0 < kept.count() < docs.count() and freed == [None]

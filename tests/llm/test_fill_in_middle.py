"""Cuts of fill-in-the-middle documents against plain slicing."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from mercadia.llm import fill_in_middle as M
from mercadia.llm._common import table
from mercadia.llm.queries import QUERIES
from tests.llm.cases import documents, empty

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def brute(doc_id, text):
    text = text or ""
    n, d = len(text), sha(f"1:{'null' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(d[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def some_text(rng, size):
    return "".join(rng.choice(["a", "P", ">", "<", "<P", "<S", "M>", "<M>" if rng.random() < 0.02 else "<", "é", "中", "\U0001f600", " ", "\n"]) for _ in range(size))


def order(r):
    return (r[0] is None, r[0] or 0, r[1], r[5])


def test_summaries_compose_as_runs_do():
    rng = random.Random(3)
    for _ in range(400):
        data = some_text(rng, rng.randrange(40)).encode()
        whole = [M.run(data, s) for s in range(M.STATES)]
        nxt, points, marks = M.summary(data)
        assert whole == list(zip(nxt, points, marks))
        size, state, n, k = rng.randrange(1, 9), 0, 0, 0
        for i in range(0, len(data), size):
            nxt, points, marks = M.summary(data[i : i + size])
            state, n, k = nxt[state], n + points[state], k + marks[state]
        text = data.decode()
        assert (n, k) == (len(text), sum(text.count(x) for x in ("<P>", "<S>", "<M>")))


@pytest.mark.parametrize("chunk, block", [(5, 3), (64, 2), (M.CHUNK, M.BLOCK)])
def test_documents_against_slices(spark, chunk, block):
    rng = random.Random(chunk)
    made = [(i, some_text(rng, rng.choice([0, 1, 3, 10, 100, 700]))) for i in range(150)] + [(7, "é" * 300), (7, "é" * 300), (None, "abc" * 40), (8, None)]
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(5)
    got = M.fill_in_middle(docs, chunk, block)
    found = sorted(map(tuple, got.collect()), key=order)
    assert found == sorted((brute(*r) for r in made), key=order)
    assert {r[2] for r in found} == {"plain", "psm", "spm"}
    back = got.select("doc_id", F.col("n"), F.length(M.restored(F.col("output"), F.col("form"))).alias("m"), M.restored(F.col("output"), F.col("form")).alias("t")).collect()
    assert all(r.n == r.m for r in back) and sorted(r.t for r in back) == sorted(t or "" for _, t in made)


def test_query_and_cases(spark, sf):
    want = {r.doc_id: brute(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()}
    text = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    for r in QUERIES["op13_fill_in_middle"](spark, sf).collect():
        w = want.pop(r.doc_id)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == w[1:5]
        assert (r.output_sha256, r.restored_sha256) == (sha(w[5]), sha(text[r.doc_id]))
    assert not want
    assert M.fill_in_middle(empty(spark)).count() == 0
    cases = [(r.doc_id, r.text) for r in documents(spark).collect()]
    assert sorted(map(tuple, M.fill_in_middle(documents(spark), 1000).collect()), key=order) == sorted((brute(*c) for c in cases), key=order)

"""Removal of repeated passages against brute force."""

import hashlib
import re

import numpy as np
import pytest

from mercadia.llm import substring_dedup as S
from mercadia.llm._common import table
from tests.llm.cases import documents, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, window=50):
    words = [WORD.findall(t or "") for _, t in docs]
    low = {}
    for (d, _), w in zip(docs, words):
        for k in range(len(w) - window + 1 if d is not None else 0):
            x = tuple(w[k : k + window])
            low[x] = min(low.get(x, d), d)
    out = []
    for (d, _), w in zip(docs, words):
        gone = set()
        for k in range(len(w) - window + 1 if d is not None else 0):
            if low[tuple(w[k : k + window])] < d:
                gone |= set(range(k, k + window))
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return sorted(out, key=lambda t: (t[0] is None, t[0] or 0, str(t)))


def run(docs, **options):
    got = S.remove_repeats(docs, **options).drop("ranges").collect()
    return sorted(map(tuple, got), key=lambda t: (t[0] is None, t[0] or 0, str(t)))


@pytest.mark.parametrize("options", [{}, {"shard_words": 3000, "hot": 2}])
def test_documents(spark, sf, options):
    docs = table(spark, sf, "documents")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert run(docs, **options) == want and sum(w[2] > 0 for w in want) > 5


def test_cases(spark, monkeypatch):
    base = " ".join(f"w{i}" for i in range(60))
    more = spark.createDataFrame([(20, base + " a " + base), (21, "x " * 300), (22, "x " * 120), (23, "y " * 40 + base[: base.index(" w55")] + " z" * 60), (23, base), (24, " ".join(f"q{i}" for i in range(60)))], "doc_id long, text string")
    docs = documents(spark).select("doc_id", "text").unionByName(more).repartition(3)
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert run(docs) == want
    monkeypatch.setattr(S, "BROADCAST_BYTES", 0)
    assert run(docs) == want
    assert run(empty(spark)) == []


@pytest.mark.parametrize("levels", [0, 4])
def test_hot_keys(spark, monkeypatch, levels):
    """One passage in all documents, between words that differ, and many whole copies: every key is refined."""
    monkeypatch.setattr(S, "LEVELS", levels)
    shared = [f"s{i}" for i in range(70)]
    rows = [(i, " ".join([f"a{i % 7}x{k}" for k in range(i % 11)] + shared + [f"b{i % 5}x{k}" for k in range(i % 13)])) for i in range(60)]
    rows += [(100 + i, " ".join(shared[:55] + ["n%d" % (i % 9)] + shared[:60])) for i in range(30)] + [(i, " ".join(shared)) for i in range(90, 130)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert run(docs, hot=1) == run(docs, hot=6, shard_words=500) == run(docs) == brute(rows)


def test_index():
    rng = np.random.default_rng(1)
    passages = [rng.integers(0, 3, rng.integers(10, 40)).astype(np.uint64) for _ in range(60)]
    docs = rng.integers(0, 1000, 60)
    # windows of 33 to 64 words; longer runs of few symbols, so that many recur
    passages = [np.tile(p, 8)[: rng.integers(34, 100)] for p in passages]
    index = S.FMIndex(passages, docs, 34)
    low = {}
    for p, d in zip(passages, docs):
        for k in range(len(p) - 33):
            x = tuple(p[k : k + 34])
            low[x] = min(low.get(x, d), d)
    strange = [np.concatenate([passages[0][-50:], [np.uint64(9)], passages[1]]), passages[2][5:], np.concatenate([passages[3], passages[4]])]
    for p, found in zip(passages + strange, index.lowest(passages + strange)):
        assert found.tolist() == [low.get(tuple(p[k : k + 34]), np.iinfo(np.int64).max) for k in range(len(p) - 33)]

"""Near-duplicates by n-grams and by embeddings against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mercadia.llm import embedding_dedup, jaccard_join
from mercadia.llm._arrays import forest, low_words
from mercadia.llm._common import table
from mercadia.llm.components import components
from tests.llm.cases import documents, empty, rows


def roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


def test_components(spark):
    rng = np.random.default_rng(3)
    pairs = [tuple(map(int, p)) for p in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 440)]
    want = roots(500, pairs)
    nodes = {x for p in pairs for x in p if p[0] != p[1]}
    got = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {x: want[x] for x in nodes}
    a, b = np.array(pairs).T
    assert forest(a, b, 500).tolist() == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute(texts, n=5, threshold=0.8):
    """(class_id, component_id, n_links) by id, for unique ids."""
    sets = []
    for i, t in texts:
        w = low_words((t or "").encode())
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    pairs = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    ids = [i for i, _ in texts]
    root = roots(len(sets), pairs)
    links = [sum(x in p for p in pairs) for x in range(len(sets))]
    first = {}
    for i, t in texts:
        first.setdefault(t, i)
    return [(i, first[t] if s else i, ids[r], k) for (i, t), s, r, k in zip(texts, sets, root, links)]


@pytest.mark.parametrize("block", [256, 3])
def test_jaccard(spark, sf, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    docs = table(spark, sf, "documents").limit(60)
    base = docs.select("text").first().text.split()
    rng = np.random.default_rng(5)
    more = [(10_000 + i, " ".join(w for w in base[:80] if rng.random() > i % 7 * 0.01)) for i in range(40)] + [(20_000 + i, " ".join(base[:60])) for i in range(5)] + [(30_000, ""), (30_001, None), (30_002, "%%"), (30_003, "%%"), (30_004, "one two"), (30_005, "One two!")]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string")).repartition(3)
    texts = sorted((r.doc_id, r.text) for r in docs.collect())
    want = brute(texts)
    got = jaccard_join.near_duplicates(docs).select("doc_id", "class_id", "component_id", "n_links").collect()
    assert sorted(map(tuple, got)) == want
    assert max(w[3] for w in want) > 10
    kept = {r.doc_id for r in jaccard_join.keep_one(docs).collect()}
    assert kept == {w[0] for w in want if w[0] == w[2]}


def test_jaccard_repeated_grams(spark):
    """Sizes are numbers of distinct n-grams: a text and the same text several times over are near-duplicates."""
    words = [f"w{i}" for i in range(60)]
    texts = [(1, " ".join(words)), (2, " ".join(words * 2)), (3, " ".join(words * 5)), (4, " ".join(words[:30]))]
    got = jaccard_join.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).select("doc_id", "class_id", "component_id", "n_links").collect()
    assert sorted(map(tuple, got)) == brute(texts) == [(1, 1, 1, 2), (2, 2, 1, 2), (3, 3, 1, 2), (4, 4, 4, 0)]


@pytest.mark.parametrize("recall, block, sample", [(0.1, 256, 1 << 14), (0.1, 3, 40), (0.9, 3, 1 << 14)])
def test_jaccard_missed_by_bands(spark, recall, block, sample, monkeypatch):
    """One band, or a few, miss most pairs near the threshold; the links are the same as by brute force."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "SAMPLE", sample)
    rng = np.random.default_rng(8)
    texts = []
    for g in range(25):
        base = [f"g{g}w{i}" for i in range(int(rng.integers(5, 120)))]
        for _ in range(int(rng.integers(1, 14))):
            at = int(rng.integers(0, 1 + len(base) // 6))
            # a line that every third text holds, and words that differ
            own = base[at:] if rng.random() < 0.5 else [w if rng.random() > 0.02 else f"x{rng.integers(10**9)}" for w in base]
            texts.append((len(texts), " ".join(own + (["a", "very", "common", "line", "of", "words"] if rng.random() < 0.3 else []))))
    texts += [(1000, texts[0][1]), (1001, texts[0][1]), (1002, None), (1003, "one two")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = jaccard_join.near_duplicates(docs, recall=recall).select("doc_id", "class_id", "component_id", "n_links").collect()
    want = brute(texts)
    assert sorted(map(tuple, got)) == want
    assert sum(w[3] for w in want) > 200


def test_jaccard_cases(spark):
    docs = documents(spark)
    got = {(r.doc_id, r.n_links, r.component_id) for r in jaccard_join.near_duplicates(docs).collect()}
    assert {(1, 5, 1), (2, 5, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 5, 1), (None, 0, None)} <= got
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 10]
    # equal rows, id included: one stays
    twice = docs.where("doc_id = 2")
    assert jaccard_join.keep_one(twice).count() == 1
    assert jaccard_join.near_duplicates(empty(spark)).count() == 0 and jaccard_join.keep_one(empty(spark)).count() == 0


def test_band_count():
    assert jaccard_join.band_count(0.8, 0.9999, 5) == 24
    assert (1 - 0.8**5) ** jaccard_join.band_count(0.8, 0.99, 5) <= 0.01


def brute_vectors(vectors, threshold=0.9):
    ok = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for _, v in vectors]
    x = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if o else None for (_, v), o in zip(vectors, ok)]
    pairs = [(a, b) for a in range(len(x)) for b in range(a + 1, len(x)) if ok[a] and ok[b] and len(x[a]) == len(x[b]) and x[a] @ x[b] >= threshold]
    root = roots(len(x), pairs)
    return sorted((i, sum(a in p for p in pairs), vectors[root[a]][0], root[a] == a) for a, (i, _) in enumerate(vectors))


def test_embeddings(spark, sf):
    got = embedding_dedup.near_duplicates(table(spark, sf, "embeddings"))
    vectors = sorted((r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect())
    assert rows(got, "vec_id", "n_links", "component_id", "kept") == brute_vectors(vectors)


@pytest.mark.parametrize("block,coarse", [(2048, 2048), (4, 2048), (64, 6)])
def test_embeddings_in_blocks(spark, block, coarse, monkeypatch):
    # with few coarse centroids, lists are pairs of a coarse and a fine one
    monkeypatch.setattr(embedding_dedup, "COARSE", coarse)
    monkeypatch.setattr(embedding_dedup, "MEMBERS", block)
    monkeypatch.setattr(embedding_dedup, "QUERIES", block)
    monkeypatch.setattr(embedding_dedup, "LIST_SIZE", 32)
    rng = np.random.default_rng(9)
    base = rng.normal(size=(60, 12))
    x = [(i, [float(c) for c in base[i % 60] + rng.normal(size=12) * 0.15 * (i % 4)]) for i in range(400)]
    x += [(500 + i, [1.0, 2.0] + [0.0] * 10) for i in range(30)]
    x += [(600, None), (601, [0.0] * 12), (602, [1.0, None] + [0.0] * 10), (603, [float("nan")] + [1.0] * 11), (604, []), (605, [float("inf")] + [1.0] * 11), (606, [1.0, 2.0]), (607, [1.0, 2.0])]
    x += [(700 + i, [float(c) for c in rng.normal(size=5)]) for i in range(3)] + [(710, [3.0]), (711, [5.0]), (712, [-1.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in x], "vec_id long, embedding array<double>, key int, task string").repartition(4)
    want = brute_vectors(x)
    assert {w[0]: w[1] for w in want}[606] == 1 and {w[0]: w[1] for w in want}[710] == 1
    got = rows(embedding_dedup.near_duplicates(df), "vec_id", "n_links", "component_id", "kept")
    lost = sum(b[1] for b in want) - sum(a[1] for a in got)
    assert 0 <= lost <= 0.002 * sum(b[1] for b in want)
    if not lost:
        assert got == want
    none = df.where(F.col("vec_id") >= 600).where(F.col("vec_id") < 606)
    assert rows(embedding_dedup.near_duplicates(none), "vec_id", "n_links", "kept") == [(i, 0, True) for i in range(600, 606)]
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_recall_on_vectors_that_trained_nothing(spark):
    rows_ = table(spark, "/root/testdata/sf0.1", "embeddings").collect()
    x = np.array([r.embedding for r in rows_ if r.embedding is not None and len(r.embedding) == 64], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rng = np.random.default_rng(4)
    half = len(x) // 2
    q = embedding_dedup.Quantiser(x[:half], 40, 0.9, embedding_dedup.RECALL)
    y = rng.normal(size=(half, 64))
    a = x[half : 2 * half]
    y -= (y * a).sum(1, keepdims=True) * a
    y = 0.9 * a + np.sqrt(1 - 0.81) * y / np.linalg.norm(y, axis=1, keepdims=True)
    pa_, pb = q.code(a)[0], q.code(y)[0]
    met = (pa_ == pb[:, :1]).any(1) | (pb == pa_[:, :1]).any(1)
    assert q.probes < 40 and met.mean() >= 0.98

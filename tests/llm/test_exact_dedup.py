"""The stateful deduplication against grouping by whole texts."""

import hashlib
import random

import pytest

from mercadia.llm import exact_dedup as X
from mercadia.llm._common import table
from tests.llm.cases import documents, empty

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    """rows in the order in which they stand -> the expected rows."""
    groups = {}
    for i, (doc_id, text) in enumerate(rows):
        groups.setdefault((text or "").translate(FOLD), []).append((doc_id is None, -(doc_id or 0), i))
    out = []
    for i, (doc_id, text) in enumerate(rows):
        body = (text or "").translate(FOLD)
        none, negative, first = min(groups[body])
        out.append((doc_id, None if none else -negative, len(groups[body]), i == first, hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=str)


def some_rows(rng, n, start=0):
    texts = ["", None, "Straße Ä", "straße Ä", "STRASSE ä", *[f"Text {i} Body" for i in range(n // 6)], *[f"text {i} body" for i in range(n // 12)]]
    return [(start + i if rng.random() < 0.97 else None, rng.choice(texts) if rng.random() < 0.7 else "hot copy") for i in range(n)]


def write(spark, rows, path, files=1):
    step = -(-len(rows) // files)
    for k in range(files):
        spark.createDataFrame(rows[k * step : (k + 1) * step], "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("chars", [64, 1])
def test_files_that_come_later(spark, tmp_path, chars):
    """A second run reads the new files only, and knows what the first has seen; chars=1 makes keys collide."""
    rng = random.Random(chars)
    first, second = some_rows(rng, 90), some_rows(rng, 60, 500)
    folder, state = f"{tmp_path}/docs", f"file://{tmp_path}/state"
    write(spark, first, folder, 3)
    once = X.deduplicate(spark, folder, state, chars, 1).collect()
    ids = lambda rows: sorted(((r[0], r[1], r[2], r[4]) for r in rows), key=str)
    assert ids(once) == ids(brute(first)) and sum(r["kept"] for r in once) == len({b[4] for b in brute(first)})
    seen = spark.read.parquet(f"{state}/log").count()
    write(spark, second, folder, 2)
    both = X.deduplicate(spark, folder, state, chars, 1).collect()
    assert ids(both) == ids(brute(first + second)) and sum(r["kept"] for r in both) == len({b[4] for b in brute(first + second)})
    fresh = spark.read.parquet(f"{state}/log").count() - seen
    assert 0 < fresh <= len(second)
    odd = X.differing(spark, folder, spark.read.schema(X._LOG).parquet(f"{state}/log")).count()
    assert (odd > 0) == (chars == 1)


def test_cases(spark, tmp_path):
    docs = documents(spark).coalesce(1)
    docs.write.parquet(f"{tmp_path}/docs")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tmp_path}/docs").collect()]
    assert sorted(map(tuple, X.deduplicate(spark, f"{tmp_path}/docs").collect()), key=str) == brute(rows)
    empty(spark).write.parquet(f"{tmp_path}/none")
    assert X.deduplicate(spark, f"{tmp_path}/none").count() == 0


def test_hot_copies_are_folded_before_the_state(spark, tmp_path):
    write(spark, [(i, "Same text" if i % 3 else f"own {i}") for i in range(900)], f"{tmp_path}/docs")
    log = X.watch(spark, f"{tmp_path}/docs", f"file://{tmp_path}/state")
    assert log.count() == 301 and log.agg({"n": "sum"}).first()[0] == 900


def test_table_of_the_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    assert sorted(map(tuple, X.deduplicate(spark, f"{sf}/documents.parquet").collect()), key=str) == brute(rows)

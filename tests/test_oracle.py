"""Every query against its SQL, run by DuckDB over the same files."""

import math
from collections import Counter

import duckdb
import pytest

from mercadia.plans.catalog import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    found = duck.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    expected = Counter(tuple(value(row[columns.index(c)]) for c in df.columns) for row in found.fetchall())
    assert Counter(tuple(map(value, row)) for row in df.collect()) == expected


def test_queries_without_sql_are_those_that_tests_hold_otherwise():
    assert set(QUERIES) - set(ORACLES) == {"q_normalise_name", "q_fuzzy_match", "q_locks", "q_word_overlap", "q_recognise", "q_image_score", "q_rate_limit"}

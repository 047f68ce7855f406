"""Ratios of blocks of names against the rules for two strings, and the searches that use them."""

import random

import numpy as np
import pytest

from mercadia.functions.ratios import blocks
from mercadia.functions.similarity import token_set_ratio, token_sort_ratio
from mercadia.operators import fuzzy


def names(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("ABCÉ1", k=rng.randint(1, rng.choice([3, 3, 3, 60]))))
    return [" ".join(word() for _ in range(rng.randint(0, rng.choice([3, 6, 30])))) for _ in range(n)]


def test_ratios_of_blocks_follow_the_rules():
    held, asked = names(1, 150), [*names(2, 60), "A A B", "   "]
    for at, block in blocks(held):
        for q in asked:
            by_set, by_sort, near = block.set_ratios(q), block.sort_ratios(q), set(block.reachable(q, 55.0).tolist())
            some = np.arange(0, len(at), 2)
            assert (block.set_ratios(q, some) == by_set[some]).all() and (block.sort_ratios(q, some) == by_sort[some]).all()
            for k, i in enumerate(at):
                assert by_set[k] == pytest.approx(token_set_ratio(q, held[i]), abs=1e-9) and by_sort[k] == pytest.approx(token_sort_ratio(q, held[i]), abs=1e-9)
                assert by_set[k] < 55 or k in near


def test_sums_over_blocks_and_shares(spark, monkeypatch):
    """A table's pairs are dealt over blocks of bounded size; each pair is met once."""
    monkeypatch.setattr(fuzzy, "NAMES", 20)
    monkeypatch.setattr(fuzzy, "SHARE", 200)
    held, asked = sorted({n for n in names(3, 60) if n}), sorted({n for n in names(4, 30) if n})
    prices = spark.createDataFrame([(1, n, 1.0, i) for i, n in enumerate(held)], "table_id int, name string, price double, row_no int")
    items = spark.createDataFrame([(1, q) for q in asked] + [(2, "A")], "table_id int, name string")
    got = {r.quoted: (r.names, r.by_set, r.by_sort, r.best) for r in fuzzy.ratio_sums(items, prices).collect()}
    whole = lambda x: int(x * 1000 + 0.5)
    assert got == {q: (len(held), sum(whole(token_set_ratio(q, n)) for n in held), sum(whole(token_sort_ratio(q, n)) for n in held), max(whole(token_set_ratio(q, n)) for n in held)) for q in asked}

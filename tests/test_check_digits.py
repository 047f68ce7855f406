"""Check digits against plain sums, without interpreted folds."""

import random

from pyspark.sql import functions as F

from mercadia.functions import codes


def test_check_digits_are_weighted_sums_and_no_folds(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choices("0123456789", k=14)) for _ in range(300)] + ["0" * 14, "9" * 14]
    sums = [([1, 3] * 6), ([3, 1] * 6 + [3]), list(range(10, 1, -1)), list(range(11, 1, -1)), [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = df.select("t", *[codes._weighted(F.col("t"), w).alias(f"w{i}") for i, w in enumerate(sums)], *[codes._mod11(F.col("t"), w).alias(f"m{i}") for i, w in enumerate(sums[2:])])
    for r in found.collect():
        expected = [sum(int(d) * w for d, w in zip(r.t, ws)) for ws in sums]
        rests = [s % 11 for s in expected[2:]]
        assert list(r)[1:] == expected + [0 if x < 2 else 11 - x for x in rests]
    plan = df.select(codes.ean13_check(F.col("t")), codes.dun14_check(F.col("t")), codes.tax_document_kind(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan

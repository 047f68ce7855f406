"""Locks compare answers that names gave once, and pairs of equal answers are asked once."""

from pyspark.sql import functions as F

from mercadia.functions.names import BrandRules, name_features
from mercadia.operators import fuzzy
from mercadia.operators.locks import light_locks, strict_locks

RULES = BrandRules((("CAFE", "PILAO"), ("CAFE", "UNIAO")))


def test_equal_answers_are_one_to_the_locks(spark):
    names = spark.createDataFrame([("CAFE PILAO ABC 500G",), ("CAFE PILAO XYZ 500G",), ("CAFE UNIAO ABC 500G",)], "n string")
    features = name_features(F.col("n"), RULES).alias("f")
    assert names.select(features).distinct().count() == 2
    assert not {"name", "tokens", "letters"} & set(names.select(features).schema["f"].dataType.names)


def test_blocked_pairs_count_each_pair_of_any_table_once(spark):
    held = [(1, "CAFE PILAO ABC 500G"), (1, "CAFE PILAO XYZ 500G"), (1, "CAFE UNIAO 1KG"), (2, "CAFE PILAO ABC 500G"), (2, "CAFE UNIAO 1KG"), (3, "CHA 20G")]
    asked = [(1, "CAFE PILAO 500G"), (2, "CAFE PILAO 500G"), (2, "CAFE UNIAO 900G"), (3, "CAFE PILAO 500G")]
    items = spark.createDataFrame(asked, "table_id int, name string")
    prices = spark.createDataFrame([(t, n, 1.0, i) for i, (t, n) in enumerate(held)], "table_id int, name string, price double, row_no int")
    locks = light_locks(RULES) | strict_locks(RULES)
    locks = {n: locks[n] for n in ("weight", "category_brand", "unknown_brand")}
    got = {r["lock"]: r["pairs"] for r in fuzzy.blocked_pairs(items, prices, locks, RULES).collect()}
    # pairs: PILAO 500G with ABC, XYZ, UNIAO 1KG and CHA; UNIAO 900G with ABC and UNIAO 1KG, which for coffee isn't near
    assert got == {"weight": 4, "category_brand": 2, "unknown_brand": 3}

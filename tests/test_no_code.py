"""Rows without a code don't meet in one task."""

from pyspark.sql import functions as F

from mercadia.operators import matching


def test_rows_without_a_code_are_dealt_over_tasks(spark):
    items = spark.range(4000).select("id", F.lit(None).cast("string").alias("code")).union(spark.createDataFrame([(-1, "7890000000017"), (-2, "x")], "id long, code string"))
    prices = spark.createDataFrame([("7890000000017", 2.5, 1)], "ean string, price double, row_no int")
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        rows = matching.match_codes(items, prices).withColumn("at", F.spark_partition_id()).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(rows) == 4002 and {r["id"]: r["table_price"] for r in rows if r["table_price"]} == {-1: 2.5}
    assert {(r["ean"], r["kind"]) for r in rows if r["code"] is None} == {("", None)}
    at = [r["at"] for r in rows if r["code"] is None]
    assert max(map(at.count, set(at))) < 2000

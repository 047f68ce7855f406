"""Quotes against price tables: joins by code, the cheaper price, learned prices, several tables, statistics.

Inputs: items (item_id, code, current), prices (ean, price, row_no). Rows of either may have other columns;
those of items are kept. Item rows need not be unique. Joins are plain equi-joins on the code, so Catalyst
picks broadcast or sort-merge by the sizes it measures, and AQE splits a code that many items share.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercadia.functions.codes import clean_ean, unit_ean_of_dun14
from mercadia.functions.prices import table_price


def usable_prices(table: DataFrame) -> DataFrame:
    """Rows of a price table with a name or a code, and a price above 0. Columns name, code, price text, row_no."""
    named = ~F.upper(F.trim(F.coalesce("name", F.lit("")))).isin("", "NONE", "NAN")
    read = table.withColumns({"ean": clean_ean(F.col("code")), "price": table_price(F.col("price"))})
    return read.where((named | (F.col("ean") != "")) & F.col("price").isNotNull())


def price_by_code(prices: DataFrame) -> DataFrame:
    """(ean, price): of rows with one code the last in the table counts."""
    return prices.where(F.coalesce("ean", F.lit("")) != "").groupBy("ean").agg(F.max_by("price", "row_no").alias("price"))


def to_match(items: DataFrame) -> DataFrame:
    """Items that are empty, or filled with a known price, and have a name or a code. Columns filled, current, name, code."""
    return items.where((~F.col("filled") | F.col("current").isNotNull()) & ((F.coalesce("name", F.lit("")) != "") | (clean_ean(F.col("code")) != "")))


def code_prices(codes: DataFrame, prices: DataFrame) -> DataFrame:
    """(code, ean, table_price) of each of codes (code): the price of its code, or of the unit's code inside a package code.

    Prices are joined twice, but their rows are aggregated once and the exchange is reused.
    """
    known = price_by_code(prices)
    coded = codes.select("code", clean_ean(F.col("code")).alias("ean"))
    coded = coded.withColumn("__unit", unit_ean_of_dun14(F.col("ean")))
    direct = known.select("ean", F.col("price").alias("__p1"))
    unit = known.select(F.col("ean").alias("__unit"), F.col("price").alias("__p2"))
    return coded.join(direct, "ean", "left").join(unit, "__unit", "left").select("code", "ean", F.coalesce("__p1", "__p2").alias("table_price"))


def match_codes(items: DataFrame, prices: DataFrame) -> DataFrame:
    """items with ean, table_price (by the code, or by the unit's code inside a package code) and kind EAN or null.

    Each distinct code is cleaned and looked up once; a code without digits has no price.
    """
    found = code_prices(items.select("code").where("code IS NOT NULL").distinct(), prices)
    found = found.select(F.concat(F.lit("c"), "code").alias("__found"), "ean", "table_price")
    # rows without a code find nothing: dealt by all that they hold, they don't meet in one task
    key = F.when(F.col("code").isNull(), F.concat(F.lit("n"), F.xxhash64(*items.columns).cast("string"))).otherwise(F.concat(F.lit("c"), "code"))
    joined = items.withColumn("__key", key).join(found, F.col("__key") == F.col("__found"), "left").drop("__key", "__found")
    return joined.withColumns({"ean": F.coalesce("ean", F.lit("")), "kind": F.when(F.col("table_price").isNotNull(), F.lit("EAN"))})


def cheaper(found: Column, current: Column) -> Column:
    """The found price, or the current one if that is above 0 and lower; null if none was found."""
    return F.when(found.isNotNull() & (current > 0), F.least(found, current)).otherwise(found)


def decision(final: Column, current: Column) -> Column:
    """not_found, keep (the price is no lower than the current one) or update."""
    return F.when(final.isNull(), F.lit("not_found")).when(current.isNotNull() & (final >= current), F.lit("keep")).otherwise(F.lit("update"))


def should_update(final: Column, current: Column) -> Column:
    """Only a strictly lower price replaces a current one."""
    return final.isNotNull() & (current.isNull() | (final < current))


def with_learned(matched: DataFrame, learned: DataFrame) -> DataFrame:
    """matched (user_id, table_id, name_key, price, kind) with confirmed learned prices in place of found ones, even cheaper ones.

    learned: (user_id, table_id, name_key, price, confirmed, updated_at), any number of rows a key; the last counts.
    """
    newest = latest(learned, ["user_id", "table_id", "name_key"], "updated_at").where("confirmed")
    newest = newest.select(F.col("user_id").alias("__u"), F.col("table_id").alias("__t"), F.col("name_key").alias("__n"), F.col("price").alias("__price"))
    joined = matched.join(newest, (F.col("user_id") == F.col("__u")) & (F.col("table_id") == F.col("__t")) & (F.col("name_key") == F.col("__n")), "left")
    kind = F.when(F.col("__price").isNotNull(), F.lit("LEARNED")).otherwise(F.col("kind"))
    return joined.withColumns({"kind": kind, "price": F.coalesce("__price", "price")}).drop("__u", "__t", "__n", "__price")


def latest(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    """The row with the greatest time of each key: one aggregate with map-side combine, no sort of groups."""
    others = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(time, *[c for c in others if c != time])).alias("__row"))
    return one.select(*keys, *[F.col("__row")[c].alias(c) for c in others])


def reviewed(results: DataFrame) -> DataFrame:
    """results (price, kind, edited, approved): an edited price above 0 replaces the found one; what isn't approved is null."""
    edited = F.col("edited") > 0
    price = F.when(edited, F.col("edited")).otherwise(F.col("price"))
    kind = F.when(edited & F.col("kind").isNull(), F.lit("MANUAL")).otherwise(F.col("kind"))
    done = results.withColumns({"price": price, "kind": kind})
    return done.withColumn("price", F.when(F.col("approved"), F.col("price")))


def lessons(results: DataFrame) -> DataFrame:
    """What a review teaches: (user_id, table_id, name_key, price, confirmed, updated_at), from matches that aren't by code."""
    taught = results.where(F.col("price").isNotNull() & ~F.col("kind").eqNullSafe("EAN"))
    return taught.select("user_id", "table_id", "name_key", F.when(F.col("approved"), F.col("price")).alias("price"), F.col("approved").alias("confirmed"), "updated_at")


def score_of_kind(kind: Column) -> Column:
    """The score that a kind such as "SIMILAR 83%" tells: 1 for codes and learned prices, null for none."""
    number = F.regexp_extract(kind, r"(\d+(?:\.\d+)?)%?$", 1).try_cast("double") / 100
    return F.when(kind.isNull(), F.lit(None)).when(kind.isin("EAN", "LEARNED"), F.lit(1.0)).otherwise(F.coalesce(number, F.lit(0.0)))


def review_status(kind: Column) -> Column:
    return F.when(kind.isNull(), F.lit("no_match")).when(kind.isin("EAN", "LEARNED"), F.lit("approved")).otherwise(F.lit("pending"))


def review_counts(results: DataFrame, *by: str) -> DataFrame:
    """Counts of results (kind) by review status."""
    of = lambda s: F.count_if(review_status(F.col("kind")) == s).alias(s)
    return results.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), of("approved"), of("pending"), of("no_match"))


def match_stats(results: DataFrame, *by: str) -> DataFrame:
    """Counts of results (price, kind) by kind."""
    found, kind = F.col("price").isNotNull(), F.col("kind")
    of = lambda name: F.count_if(found & kind.eqNullSafe(name))
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~found).alias("no_match"),
        of("EAN").alias("by_code"),
        of("LEARNED").alias("learned"),
        of("MANUAL").alias("manual"),
        F.count_if(found & ~F.coalesce(kind, F.lit("")).isin("EAN", "LEARNED", "MANUAL")).alias("by_name"),
    )


def batch_stats(results: DataFrame, *by: str) -> DataFrame:
    """Filled, kept and not found of results (price, current)."""
    final, current = F.col("price"), F.col("current")
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(should_update(final, current)).alias("filled"),
        F.count_if(final.isNotNull() & ~should_update(final, current)).alias("kept"),
        F.count_if(final.isNull()).alias("not_found"),
    )


def best_of_tables(answers: DataFrame) -> DataFrame:
    """The lowest price of each item over tables, with the row it came from; of equal prices the first table's.

    answers: (item_id, table_no, price, ...). Rows without a price above 0 don't count.
    """
    others = [c for c in answers.columns if c != "item_id"]
    best = answers.where(F.col("price") > 0).groupBy("item_id").agg(F.min_by(F.struct(*others), F.struct("price", "table_no")).alias("best"))
    return best.select("item_id", *[F.col("best")[c].alias(c) for c in others])


def kept_items(kept: DataFrame, priced: DataFrame) -> DataFrame:
    """Items that some table kept and none priced."""
    return kept.select("item_id").distinct().join(priced.select("item_id"), "item_id", "left_anti")


def missing_items(items: DataFrame, priced: DataFrame, kept: DataFrame) -> DataFrame:
    """Items that were neither priced nor kept."""
    return items.join(priced.select("item_id").unionByName(kept.select("item_id")).distinct(), "item_id", "left_anti")


def enriched(prices: DataFrame, items: DataFrame) -> DataFrame:
    """Prices with the name and code of their items; unknown ones stay."""
    return prices.join(items.select("item_id", "name", "code"), "item_id", "left")


def first_distinct(df: DataFrame, keys: list[str], order: str, most: int = 40) -> DataFrame:
    """The first row of each key in order, and of those the first `most`: the feature is a report's top rows."""
    others = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.min_by(F.struct(*others), order).alias("__row"))
    return one.select(*keys, *[F.col("__row")[c].alias(c) for c in others]).orderBy(order, *keys).limit(most)


def over_tables(items: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """Items after one price table after another, each keeping the cheaper price: column price.

    A chain of tables equals the least of their prices, so the tables are united and joined once.
    """
    one = [price_by_code(t) for t in tables]
    lowest = reduce(DataFrame.unionByName, one).groupBy("ean").agg(F.min("price").alias("price")).withColumn("row_no", F.lit(0))
    matched = match_codes(items, lowest)
    return matched.withColumn("price", F.coalesce(cheaper(F.col("table_price"), F.col("current")), F.col("current"))).drop("table_price")

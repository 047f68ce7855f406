"""What goes out: cells of filled quotes, term price tables, CSV exports, audit events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercadia.functions.prices import term_price
from mercadia.functions.text import clean_metadata, escape_csv
from mercadia.sources.sheets import TERMS


def result_cells(items: DataFrame, cells: DataFrame) -> DataFrame:
    """(file, sheet, row, col, value) to write into quotes: the price at the quote's price column, or right of the sheet.

    items (file, sheet, row_no, price, price_col); cells are the quote's own. Where a sheet has no price
    column, the one after its last is taken, so no cell is overwritten.
    """
    width = cells.groupBy("file", "sheet").agg(F.max("col").alias("last_col"))
    priced = items.where("price IS NOT NULL").join(width, ["file", "sheet"], "left")
    return priced.select("file", "sheet", F.col("row_no").alias("row"), F.coalesce("price_col", F.col("last_col") + 1).alias("col"), F.col("price").alias("value"))


def first_empty_cells(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """rows (file, sheet, row, price_col, start_col) with col: price_col, or the first empty cell of the row from start_col on.

    cells (file, sheet, row, col, value) are what stands in the sheets; null and blank values are empty. A row's occupied
    columns from start_col on are numbered in order: as long as one stands where its number says, no cell is free before it.
    """
    key = ["file", "sheet", "row"]
    taken = cells.where(F.trim(F.col("value").cast("string")) != "").select(*key, F.col("col").alias("taken")).distinct()
    behind = rows.where("price_col IS NULL").select(*key, "start_col").distinct().join(taken, key).where("taken >= start_col")
    place = F.row_number().over(Window.partitionBy(*key, "start_col").orderBy("taken"))
    run = behind.withColumn("place", place).where(F.col("taken") - F.col("start_col") == F.col("place") - 1)
    used = run.groupBy(*key, "start_col").agg(F.count(F.lit(1)).cast("int").alias("used"))
    return rows.join(used, [*key, "start_col"], "left").withColumn("col", F.coalesce("price_col", F.col("start_col") + F.coalesce("used", F.lit(0)))).drop("used")


def term_table(prices: DataFrame, percents: dict[int, float], terms: tuple[int, ...] = TERMS) -> DataFrame:
    """name, ean and one column of prices for each term: term_7 and so on. A term without a percentage costs the base price."""
    return prices.select("name", "ean", *[term_price(F.col("price"), F.lit(float(percents.get(t, 0.0)))).alias(f"term_{t}") for t in terms])


def write_csv(df: DataFrame, path: str, separator: str = ";") -> None:
    """CSV files that spreadsheets open; fields are quoted where they must be."""
    df.write.option("sep", separator).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def csv_lines(df: DataFrame, separator: str = ";") -> DataFrame:
    """Lines of a CSV export as a column, for sinks that take text."""
    fields: list[Column] = [escape_csv(F.col(f"`{c}`"), separator) for c in df.columns]
    return df.select(F.concat_ws(separator, *fields).alias("line"))


def audit_rows(events: DataFrame, at: str) -> DataFrame:
    """Events (action, user_id, status, metadata map<string,string>) as an audit log takes them: secrets hidden, a time added."""
    return events.select("action", "user_id", F.coalesce("status", F.lit("info")).alias("status"), clean_metadata(F.col("metadata")).alias("metadata"), F.lit(at).cast("timestamp").alias("created_at"))

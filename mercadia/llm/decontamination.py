"""Benchmark decontamination by a prefix-filtered join of item windows with documents.

Native: only DataFrame functions. The tokens of an item window are ordered by rarity in the documents.
Containment must be whole, so the necessary prefix of a window is its rarest token alone: a document that
holds the window holds that token, at a known offset. Document words are joined with these tokens; the
offset bounds where the window may start, its length where it must end; then the words there are compared
with the window's, in order.

Edge cases: a null or empty text has no words and is never hit; an item without words has no window; an
item of fewer words than a window is one window; repeated documents give equal rows, repeated items count
by their item_id once; a null item_id is left out of the digest's list of ids but its windows count as
hits; empty tables give no hits or no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercadia.llm._common import BROADCAST_BYTES, WORD_ANY_CASE, checked_broadcast, count_matches, fits, lower_words, row_key, stored

WINDOW = 10


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(win array<string>, items array<string>): each distinct window of the items (item_id, text)."""
    words = items.select(F.col("item_id").cast("string").alias("item_id"), lower_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("win")).groupBy("win").agg(F.collect_set("item_id").alias("items"))


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(row_key, start, length, items): where windows of items occur in docs (doc_id, text); start in words, from 0.

    Prefix tokens of up to broadcast_bytes are shipped to the documents. More are shuffled with the documents'
    words; what is left then meets the documents' word arrays, which are shuffled once.
    """
    windows = stored(item_windows(items, window), "windows")
    tokens = windows.select(F.explode(F.array_distinct("win")).alias("token")).distinct()
    words = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("row_key"), lower_words(F.col("text")).alias("w"))
    rarity = stored(words.select(F.explode("w").alias("token")).join(checked_broadcast(tokens, broadcast_bytes), "token").groupBy("token").agg(F.count(F.lit(1)).alias("df")), "rarity")
    # a window with a token that no document holds can't occur and drops out here
    keyed = windows.withColumn("id", F.md5(F.concat_ws(" ", "win"))).select("id", "win", "items", F.posexplode("win").alias("offset", "token")).join(checked_broadcast(rarity, broadcast_bytes), "token", "left")
    prefix = stored(
        keyed.groupBy("id")
        .agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "offset", "token")).alias("rarest"), F.first("win").alias("win"), F.first("items").alias("items"))
        .where(F.col("rarest.df") > 0)
        .select(F.col("rarest.token").alias("token"), F.col("rarest.offset").alias("offset"), "win", F.size("win").alias("length"), "items"),
        "prefixes",
    )
    at = F.col("pos") - F.col("offset")
    inside = (at >= 0) & (at + F.col("length") <= F.col("n"))
    same = F.slice("w", F.greatest(at + 1, F.lit(1)), F.col("length")) == F.col("win")
    words = words.withColumn("n", F.size("w"))
    if fits(prefix, broadcast_bytes):
        met = words.select("row_key", "n", "w", F.posexplode("w").alias("pos", "token")).join(F.broadcast(prefix), "token").where(inside)
    else:
        met = words.select("row_key", "n", F.posexplode("w").alias("pos", "token")).join(prefix, "token").where(inside)
        met = met.join(words.select("row_key", "w").dropDuplicates(["row_key"]), "row_key")
    return met.where(same).select("row_key", at.alias("start"), "length", "items")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per row of docs: n_words, n_hit (words inside any occurrence), n_items, items_sha256, contaminated."""
    hits = (
        occurrences(docs, items, window, broadcast_bytes)
        .groupBy("row_key")
        .agg(F.collect_set(F.struct("start", "length")).alias("spans"), F.collect_set("items").alias("items"))
        .select(
            "row_key",
            F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1))))).cast("long").alias("hit"),
            F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"),
        )
    )
    base = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("row_key"), count_matches(F.col("text"), WORD_ANY_CASE).alias("n_words"))
    ids = F.coalesce("items", F.array().cast("array<string>"))
    return base.join(hits, "row_key", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"),
        (F.coalesce("hit", F.lit(0)) > 0).alias("contaminated"),
        "row_key",
    )

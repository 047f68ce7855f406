"""Product recognition: descriptions against a dictionary of categories, brands and attributes.

The dictionary is a table of terms (category, brand or null, field, value, term): field is category, brand,
flavour, fragrance or line; term is a text that stands for value. A description's runs of 1 to LONGEST words
are joined with the terms on equality, so a larger dictionary makes no task larger.

Inputs: descriptions (text). Out: one row a distinct text, without a category if none was found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercadia.functions.text import description_key, description_measures

#: Words of the longest term that is looked for.
LONGEST = 5
AMBIGUOUS_WITHIN, AMBIGUOUS_MOST = 0.08, 0.78
#: Package words and what they stand for; fixed values.
PACKAGES = (("pct", "pacote"), ("pc", "pacote"), ("un", "unidade"), ("und", "unidade"), ("cx", "caixa"))


def terms_table(knowledge: DataFrame) -> DataFrame:
    """Dictionary rows with their terms in the form of description_key; empty ones go. A row's ordinal breaks ties."""
    return knowledge.withColumn("term", description_key(F.col("term"))).where("term <> ''")


def _runs(words: Column) -> Column:
    """Every run of 1 to LONGEST words."""
    n = F.size(words)
    starts = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    return F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST), n - i + 1)), lambda k: F.array_join(F.slice(words, i, k), " ")))))


def recognise(descriptions: DataFrame, knowledge: DataFrame) -> DataFrame:
    """(text, key, category, brand, flavour, fragrance, line, weight, volume, package, confidence, alerts)."""
    texts = descriptions.select("text").where("text IS NOT NULL").distinct().withColumn("key", description_key(F.col("text")))
    texts = texts.withColumn("words", F.split("key", " "))
    hits = texts.select("text", F.explode(_runs(F.col("words"))).alias("term")).join(terms_table(knowledge), "term")
    strength = F.when(F.contains("term", F.lit(" ")), 0.25).otherwise(0.2)
    hits = hits.withColumn("strength", strength)
    brands = hits.where("field = 'brand'").select("text", "category", "brand").distinct()
    # a brand's attributes count only where the brand was found; a category's own (brand null) always
    owned = hits.where("field IN ('flavour', 'fragrance', 'line')").join(brands.withColumnRenamed("brand", "found"), ["text", "category"], "left")
    attributes = owned.where(F.col("brand").isNull() | (F.col("brand") == F.col("found"))).select("text", "category", "field", "value", "ordinal").distinct()
    first = lambda field: F.min_by("value", F.when(F.col("field") == field, F.col("ordinal")))
    described = attributes.groupBy("text", "category").agg(first("flavour").alias("flavour"), first("fragrance").alias("fragrance"), first("line").alias("line"))
    scored = hits.where("field IN ('category', 'brand')").groupBy("text", "category").agg(
        F.max(F.when(F.col("field") == "category", F.col("strength"))).alias("category_score"),
        F.max(F.when(F.col("field") == "brand", F.col("strength"))).alias("brand_score"),
        F.min_by("brand", F.when(F.col("field") == "brand", F.struct(-F.col("strength"), "ordinal"))).alias("brand"),
    )
    sized = texts.select("text", "key", "words", description_measures(F.col("key")).alias("m"))
    found = scored.join(described, ["text", "category"], "left").join(sized.select("text", "m"), "text")
    any_attribute = F.coalesce("flavour", "fragrance", "line").isNotNull()
    measured = F.coalesce("m.weight", "m.volume").isNotNull()
    score = F.lit(0.35) + F.coalesce("category_score", F.lit(0.0)) + F.coalesce("brand_score", F.lit(0.0)) + F.when(any_attribute, 0.15).otherwise(0.0) + F.when(measured, 0.1).otherwise(0.0)
    found = found.withColumn("score", F.least(F.round(score, 6), F.lit(0.98)))
    order = Window.partitionBy("text").orderBy(F.desc("score"), "category")
    found = found.withColumns({"place": F.row_number().over(order), "next": F.lead("score").over(order)}).where("place = 1")
    ambiguous = F.coalesce(F.col("next") >= F.col("score") - AMBIGUOUS_WITHIN, F.lit(False))
    best = found.select("text", "category", "brand", "flavour", "fragrance", "line", "score", ambiguous.alias("ambiguous"))
    out = sized.join(best, "text", "left")
    package = F.coalesce(*[F.when(F.arrays_overlap("words", F.array(F.lit(a), F.lit(b))), F.lit(b)) for a, b in PACKAGES])
    confidence = F.when(F.col("category").isNull(), F.lit(0.0)).when(F.col("ambiguous"), F.least(F.round("score", 2), F.lit(AMBIGUOUS_MOST))).otherwise(F.round("score", 2))
    known = F.col("category").isNotNull()
    alerts = F.array_compact(
        F.array(
            F.when(~known, F.lit("no_category")),
            F.when(F.col("brand").isNull(), F.lit("no_brand")),
            F.when(known & F.coalesce("flavour", "fragrance", "line").isNull(), F.lit("no_variant")),
            F.when(F.col("ambiguous"), F.lit("ambiguous")),
        )
    )
    return out.select("text", "key", "category", "brand", "flavour", "fragrance", "line", "m.weight", "m.volume", package.alias("package"), confidence.alias("confidence"), alerts.alias("alerts"))

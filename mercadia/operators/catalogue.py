"""Offers: price refresh, photos, image candidates, order of items, carts, and expiry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercadia.functions.codes import clean_ean_offer, clean_ean_photo
from mercadia.functions.text import fold_marks, search_key


def _unique(rows: DataFrame, key: Column) -> DataFrame:
    """(key, price) of keys that exactly one row has: ambiguous ones never match."""
    return rows.withColumn("__k", key).where("__k <> ''").groupBy("__k").agg(F.count(F.lit(1)).alias("__n"), F.first("price").alias("__price")).where("__n = 1").drop("__n")


def refreshed_prices(items: DataFrame, table: DataFrame) -> DataFrame:
    """Offer items (name, ean, price) with new_price: of the table's row with the same code, or, without a code, the same name."""
    priced = table.where(F.col("price") > 0)
    by_code = _unique(priced, clean_ean_offer(F.col("ean"))).withColumnsRenamed({"__k": "__code", "__price": "__p1"})
    by_name = _unique(priced, search_key(F.col("name"))).withColumnsRenamed({"__k": "__name", "__price": "__p2"})
    keyed = items.withColumns({"__c": clean_ean_offer(F.col("ean")), "__m": search_key(F.col("name"))})
    joined = keyed.join(by_code, F.col("__c") == F.col("__code"), "left").join(by_name, (F.col("__c") == "") & (F.col("__m") == F.col("__name")), "left")
    return joined.withColumn("new_price", F.coalesce("__p1", "__p2")).drop("__c", "__m", "__code", "__name", "__p1", "__p2")


def photos(items: DataFrame, learned: DataFrame, bank: DataFrame, candidates: DataFrame) -> DataFrame:
    """Items (ean) with photo: learned before bank before candidate (each (ean, url)); of rows with one code the first url in order counts."""
    out = items.withColumn("__e", clean_ean_photo(F.col("ean")))
    for n, source in enumerate((learned, bank, candidates)):
        one = source.select(clean_ean_photo(F.col("ean")).alias(f"__e{n}"), "url").where(f"__e{n} <> ''").groupBy(f"__e{n}").agg(F.min("url").alias(f"__u{n}"))
        out = out.join(one, F.col("__e") == F.col(f"__e{n}"), "left").drop(f"__e{n}")
    return out.withColumn("photo", F.coalesce("__u0", "__u1", "__u2")).drop("__e", "__u0", "__u1", "__u2")


def photo_manifest(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """(ean, url) of approved rows (ean, url, status, row_no), the first row of a code, under overrides (ean, url)."""
    first = rows.where("status = 'approved'").withColumn("ean", clean_ean_photo(F.col("ean"))).where("ean <> ''").groupBy("ean").agg(F.min_by("url", "row_no").alias("url"))
    manual = overrides.select(clean_ean_photo(F.col("ean")).alias("ean"), F.col("url").alias("manual")).groupBy("ean").agg(F.min("manual").alias("manual"))
    return first.join(manual, "ean", "full").select("ean", F.coalesce("manual", "url").alias("url"))


def learned_image(images: DataFrame, user_id) -> DataFrame:
    """By name: a user's own image before others', the most chosen, then the newest. images (name, created_by, selected, updated_at, url)."""
    order = F.struct((F.col("created_by") == F.lit(user_id)).cast("int"), "selected", "updated_at", "url")
    return images.where("name <> ''").groupBy("name").agg(F.max_by("url", order).alias("url"))


def with_metadata(items: DataFrame, about: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Items (ean) with columns of about (ean, ...) by code, and the defaults where a code or value is unknown; of rows with one code the least counts."""
    one = about.select(clean_ean_photo(F.col("ean")).alias("__e"), *defaults).where("__e <> ''").groupBy("__e").agg(F.min(F.struct(*defaults)).alias("__a"))
    joined = items.withColumn("__k", clean_ean_photo(F.col("ean"))).join(one, F.col("__k") == F.col("__e"), "left")
    return joined.withColumns({c: F.coalesce(F.nullif(F.col("__a")[c], F.lit("")), F.lit(d)) for c, d in defaults.items()}).drop("__k", "__e", "__a")


# ---- image candidates ----
#: Terms whose images are not wanted, and words that tell nothing; fixed values.
BLOCKED_TERMS = ("PINTEREST", "FACEBOOK", "INSTAGRAM", "YOUTUBE", "TIKTOK", "RECEITA", "COMO FAZER", "UNBOXING", "REVIEW", "AVALIACAO", "ISTOCK", "ALAMY", "SHUTTERSTOCK", "PEXELS", "DREAMSTIME", "ADOBE", "VECTEEZY", "WIKIPEDIA", "WIKIMEDIA", "PDF", "MANUAL", "FOTO DE", "MAO", "HOLDING", "PESSOA")
IMAGE_NOISE = ("A", "O", "E", "DE", "DO", "DA", "DAS", "DOS", "EM", "AO", "COM", "SEM", "PARA", "UN", "UND", "UNID", "CX", "FD", "KG", "G", "ML", "L", "LT", "PT", "PCT", "PO", "LIQ", "TRAD", "TRADICIONAL", "PRODUTO", "EMBALAGEM")
CATEGORY_WORDS = ("ABS", "ABSORVENTE", "ABSORVENTES", "ACENDEDOR", "ACETONA", "ACHOCOLATADO", "ADOCANTE", "AGUA", "ALCOOL", "AMACIANTE", "BALA", "BEB", "BISC", "COND", "CONDICIONADOR", "CR", "DT", "LAVA", "MICELAR", "NOITE", "OXIGENADA", "PALLET", "POTE", "PROT", "REMOVEDOR", "ROUPA", "SAB", "SACHET", "SH", "SHAMPOO", "SUAVE")
IMAGE_WORDS = ((" C/", " COM "), (" S/", " SEM "), (" C ", " COM "), (" S ", " SEM "), ("ACHOC", "ACHOCOLATADO"), ("ADOC", "ADOCANTE"), ("AMAC", "AMACIANTE"), ("CATCHUP", "KETCHUP"))
#: Scores from which a candidate is taken, and needs no review.
LEAST_SCORE, SURE_SCORE = 145, 190


def image_words(c: Column) -> Column:
    text = F.upper(fold_marks(c))
    for word, other in IMAGE_WORDS:
        text = F.replace(text, F.lit(word), F.lit(other))
    return F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit("[A-Z0-9]+"), F.lit(0)), lambda w: (F.length(w) > 1) & ~w.isin(*IMAGE_NOISE)))


def probable_brands(words: Column) -> Column:
    """The first two words that are no category."""
    return F.slice(F.filter(words, lambda w: ~w.isin(*CATEGORY_WORDS) & w.rlike("^[A-Z]+$")), 1, 2)


def quantities(c: Column) -> Column:
    """Numbers with their units, such as 500 ML."""
    text = F.replace(F.upper(fold_marks(c)), F.lit(","), F.lit("."))
    found = lambda g: F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)\s*(KG|G|ML|L|UND|UNID|UN|VOL)"), F.lit(g))
    unit = lambda u: F.when(u.isin("UND", "UNID"), F.lit("UN")).otherwise(u)
    return F.array_distinct(F.zip_with(found(1), found(2), lambda n, u: F.concat_ws(" ", F.regexp_replace(n, r"\.0$", ""), unit(u))))


def image_candidates(candidates: DataFrame) -> DataFrame:
    """candidates (product, image_url, thumb_url, text, width, height, rank from 0) with score, blocked, flags and review."""
    w, h = F.coalesce("width", F.lit(0)), F.coalesce("height", F.lit(0))
    sized = (w > 0) & (h > 0)
    points = lambda c, n: F.when(c, F.lit(n)).otherwise(0)
    resolution = points(F.coalesce("image_url", F.lit("")) != "", 100) + F.when(sized, F.least(F.floor(w.cast("long") * h / 10000), F.lit(120))).otherwise(0)
    resolution = resolution + points(sized & (w >= 500) & (h >= 500), 60) - points(sized & ((w < 250) | (h < 250)), 80)
    resolution = resolution - points(F.contains(F.lower(F.coalesce("image_url", "thumb_url", F.lit(""))), F.lit("thumb")), 30)
    whole = F.concat_ws(" ", "text", "image_url", "thumb_url")
    out = candidates.withColumns({"__p": image_words(F.col("product")), "__c": image_words(whole), "__pq": quantities(F.col("product")), "__cq": quantities(whole)})
    brands = probable_brands(F.col("__p"))
    branded = F.arrays_overlap(brands, F.col("__c"))
    shared = F.arrays_overlap("__pq", "__cq")
    units = lambda q: F.transform(q, lambda x: F.substring_index(x, " ", -1))
    asked = (F.size("__pq") > 0) & ~shared
    conflict = asked & F.arrays_overlap(units("__pq"), units("__cq"))
    no_brand = (F.size(brands) > 0) & ~branded
    score = resolution + F.greatest(F.lit(0), 50 - F.col("rank") * 4) + F.least(F.size(F.array_intersect("__p", "__c")), F.lit(6)) * 16 + points(branded, 35) + points(shared, 35)
    score = score - points(no_brand, 70) - points(asked & ~conflict, 25) - points(conflict, 85)
    flags = F.array_compact(F.array(F.when(no_brand, F.lit("brand_unconfirmed")), F.when(conflict, F.lit("quantity_conflict")), F.when(asked & ~conflict, F.lit("quantity_unconfirmed"))))
    upper = F.upper(fold_marks(whole))
    blocked = reduce(lambda a, b: a | b, [F.contains(upper, F.lit(t)) for t in BLOCKED_TERMS])
    out = out.withColumns({"score": score.cast("int"), "flags": flags, "blocked": blocked})
    return out.withColumn("review", (F.size("flags") > 0) | F.col("blocked") | (F.col("score") < SURE_SCORE)).drop("__p", "__c", "__pq", "__cq")


def best_images(scored: DataFrame, most: int = 6, strict: bool = True) -> DataFrame:
    """The best `most` candidates of each product; strict leaves out blocked and low ones."""
    url = F.coalesce(F.nullif("image_url", F.lit("")), "thumb_url")
    usable = scored.withColumn("url", url).where(F.col("url").isNotNull() & ~F.lower("url").endswith(".svg"))
    usable = usable.where(~F.col("blocked") & (F.col("score") >= LEAST_SCORE)) if strict else usable
    once = usable.withColumn("__r", F.row_number().over(Window.partitionBy("product", "url").orderBy("rank"))).where("__r = 1").drop("__r")
    return once.withColumn("place", F.row_number().over(Window.partitionBy("product").orderBy(F.desc("score"), "rank"))).where(F.col("place") <= most)


# ---- order, carts, expiry ----
def reordered(items: DataFrame, order: DataFrame) -> DataFrame:
    """items (offer_id, item_id, sort_order) under given orders (offer_id, item_ids): unlisted ones keep their place number."""
    places = order.select("offer_id", F.posexplode("item_ids").alias("__place", "item_id")).groupBy("offer_id", "item_id").agg(F.max("__place").alias("__place"))
    return items.join(places, ["offer_id", "item_id"], "left").withColumn("sort_order", F.coalesce("__place", "sort_order")).drop("__place")


def cart_totals(cart: DataFrame, items: DataFrame) -> DataFrame:
    """By cart: lines still offered and their total. cart (cart_id, item_id, quantity), items (item_id, price)."""
    lines = cart.join(items.select("item_id", "price"), "item_id")
    return lines.groupBy("cart_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.col("price") * F.col("quantity")).alias("total"))


def still_offered(cart: DataFrame, items: DataFrame) -> DataFrame:
    return cart.join(items.select("item_id"), "item_id", "left_semi")


def expiry(c: Column, zone: str) -> Column:
    """When an offer ends: a bare date at the end of that day in the zone, other texts as timestamps; null if unreadable."""
    text = F.trim(c)
    day = F.to_utc_timestamp(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")) + F.expr("INTERVAL '86399.999999' SECOND"), zone)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), day).otherwise(F.try_to_timestamp(text))


def is_public(active: Column, expires: Column, now: str) -> Column:
    """Active, and not strictly after its expiry."""
    return active & ~F.coalesce(expires < F.lit(now).cast("timestamp"), F.lit(False))


def active_items(offers: DataFrame) -> DataFrame:
    """offers (items array<struct<active, ...>>) with the items that aren't switched off."""
    return offers.withColumn("items", F.filter("items", lambda i: F.coalesce(i["active"], F.lit(True))))

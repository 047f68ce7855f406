"""Locks: conditions under which two product names must not share a price, as Column expressions.

A lock takes the features (functions.names.name_features) of the quoted item's name and of the price table's
name, in this order, and is true where the pair is blocked. `strict` and `light` combine them. What is asked of one name
alone is answered in its features, mostly as bits of sets of words (functions.answers): a lock only compares answers.

Where a group of kinds excludes one another, the first kind in the group's order that a name holds counts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce, wraps

from pyspark.sql import Column
from pyspark.sql import functions as F

from mercadia.functions.answers import held, yes
from mercadia.functions.names import BrandRules

Lock = Callable[[Column, Column], Column]


# ---- building blocks ----
def _some(c: Column) -> Column:
    return F.size(c) > 0


def _apart(a: Column, b: Column) -> Column:
    """Both have values and none is shared."""
    return _some(a) & _some(b) & ~F.arrays_overlap(a, b)


def _clash(a: Column, b: Column, *sets: str) -> Column:
    """Both hold words of the sets and share none."""
    any_ = lambda bits: reduce(lambda p, q: p | q, [x != 0 for x in bits])
    of = lambda x: [held(x, s) for s in sets]
    return any_(of(a)) & any_(of(b)) & ~any_([x.bitwiseAND(y) for x, y in zip(of(a), of(b))])


def _differ(a: Column, b: Column, of: str) -> Column:
    """The words of a set that they hold aren't the same."""
    return held(a, of) != held(b, of)


def _shared(a: Column, b: Column, of: str) -> Column:
    """Whether both hold one word of a set."""
    return held(a, of).bitwiseAND(held(b, of)) != 0


def _both(a: Column, b: Column, *flags: str) -> Column:
    return yes(a, *flags) & yes(b, *flags)


def _either(a: Column, b: Column, *flags: str) -> Column:
    return yes(a, *flags) | yes(b, *flags)


def _one(a: Column, b: Column, *flags: str) -> Column:
    return yes(a, *flags) != yes(b, *flags)


def _either_way(lock: Lock) -> Lock:
    @wraps(lock)
    def both(a: Column, b: Column) -> Column:
        return lock(a, b) | lock(b, a)

    return both


def _at(values: Column, keys: Column, key: Column) -> Column:
    """The value beside a key, or null."""
    return F.get(values, F.array_position(keys, key).cast("int") - 1)


def _brands(x: Column, category: Column) -> Column:
    """The brands of a category of the brand table that a name holds, or null for none."""
    return _at(x["brands"], x["branded"], category)


def _brands_of(x: Column, categories: tuple[str, ...]) -> Column:
    return F.flatten(F.array_compact(F.array(*[_brands(x, F.lit(c)) for c in categories])))


def _no(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


# ---- locks ----
def category_clash(a: Column, b: Column) -> Column:
    return _apart(a["safe"], b["safe"])


def brand_clash(a: Column, b: Column) -> Column:
    """Of a shared safe category: different brands, or a brand on one side alone where it is required."""
    common = F.array_intersect(a["safe"], b["safe"])
    of = lambda x: F.flatten(F.transform(common, lambda c: _at(x["safe_brands"], x["safe"], c)))
    both = F.array(F.struct(of(a).alias("x"), of(b).alias("y")))
    return F.arrays_overlap(a["safe"], b["safe"]) & F.exists(both, lambda p: _apart(p["x"], p["y"]) | (_shared(a, b, "branded") & (_some(p["x"]) != _some(p["y"]))))


def snack_flavour(a: Column, b: Column) -> Column:
    return _shared(a, b, "salty") & _clash(a, b, "snack")


def cleaning_fragrance(a: Column, b: Column) -> Column:
    return _shared(a, b, "scented") & _differ(a, b, "fragrance")


def package_count(a: Column, b: Column) -> Column:
    cups = _shared(a, b, "cups") & (_some(a["counts"]) != _some(b["counts"]))
    return _shared(a, b, "counted") & (cups | _apart(a["counts"], b["counts"]))


def cross_category(a: Column, b: Column) -> Column:
    return _apart(a["categories"], b["categories"])


def olive_oil_kind(a: Column, b: Column) -> Column:
    return _clash(a, b, "oil")


def foil_size(a: Column, b: Column) -> Column:
    return _apart(a["foil"], b["foil"])


def _tolerance(a: Column, b: Column) -> Column:
    """How near the smaller of two measures must come to the larger, as a share."""
    return F.when(_either(a, b, "wine"), F.lit(0.85)).when(_either(a, b, "near"), F.lit(0.95)).otherwise(F.lit(0.7))


def weight(a: Column, b: Column, exempt: tuple[str, ...] = ()) -> Column:
    """No measure is shared and none comes near another. `exempt`: flags of which a pair must not share one."""
    near = F.exists(a["values"], lambda v: F.exists(b["values"], lambda w: F.least(v, w) / F.greatest(v, w) >= _tolerance(a, b)))
    free = reduce(lambda p, q: p | q, [_both(a, b, t) for t in exempt], F.lit(False))
    return _apart(a["measures"], b["measures"]) & ~free & ~near


@_either_way
def implied_weight(a: Column, b: Column) -> Column:
    """A number without a unit against measures of which one is far from it."""
    far = F.exists(a["bare"], lambda n: F.exists(b["values"], lambda v: F.least(n, v) / F.greatest(n, v) < 0.7))
    return ~_some(a["measures"]) & _some(b["measures"]) & _some(a["bare"]) & far


def pack_size(a: Column, b: Column) -> Column:
    return _apart(a["packs"], b["packs"])


def pack_size_light(a: Column, b: Column) -> Column:
    return _apart(a["packs_light"], b["packs_light"])


@_either_way
def category_brand(a: Column, b: Column) -> Column:
    """Different brands of a category that either name is of: its words stand before others in the name."""
    return F.exists(a["applied"], lambda c: _no(~F.arrays_overlap(_brands(a, c), _brands(b, c))))


@_either_way
def brand_across_categories(a: Column, b: Column) -> Column:
    """The same brand of a category that only one of the names is of."""
    return F.exists(a["applied"], lambda c: ~F.array_contains(b["applied"], c) & _no(F.arrays_overlap(_brands(a, c), _brands(b, c))))


def subtype(a: Column, b: Column) -> Column:
    """Different kinds of a group of which a name can be of one: not all groups of both have the same kind."""
    return F.size(F.array_intersect(a["groups"], b["groups"])) > F.size(F.array_intersect(a["kinds"], b["kinds"]))


def variant_words(a: Column, b: Column) -> Column:
    return _clash(a, b, "variants", "more variants", "last variants")


def fruit(a: Column, b: Column) -> Column:
    return _clash(a, b, "fruit")


def flavour(a: Column, b: Column) -> Column:
    return _clash(a, b, "flavour")


@_either_way
def olive_oil_line(a: Column, b: Column) -> Column:
    lines = ("EXTRAVIRGEM", "SUAVE", "DIA A DIA")
    return yes(b, "AZEITE") & (held(a, "flags", *lines).bitwiseAND(F.bitwise_not(held(b, "flags", *lines))) != 0)


@_either_way
def milk_kind(a: Column, b: Column) -> Column:
    return _either(a, b, "LEITE") & yes(a, "skimmed") & ~yes(b, "skimmed or whole")


@_either_way
def light_sauce(a: Column, b: Column) -> Column:
    return yes(a, "LIGHT") & ~yes(b, "LIGHT") & yes(b, "mayonnaise or sauce")


@_either_way
def sachet_or_pot(a: Column, b: Column) -> Column:
    return yes(a, "sachet") & yes(b, "pot")


@_either_way
def can_or_sachet(a: Column, b: Column) -> Column:
    return yes(a, "LT") & yes(b, "SC") & _either(a, b, "canned")


@_either_way
def carton_or_glass(a: Column, b: Column) -> Column:
    return yes(a, "TP") & yes(b, "VD") & _either(a, b, "drink")


def alcohol(a: Column, b: Column) -> Column:
    """Gel against liquid, other degrees, or other fragrances."""
    scent = ((held(a, "scents") != 0) != (held(b, "scents") != 0)) | _clash(a, b, "scents")
    return _both(a, b, "ALCOOL") & (_one(a, b, "GEL") | _clash(a, b, "degrees") | scent)


@_either_way
def deodorant_for(a: Column, b: Column) -> Column:
    return _both(a, b, "deodorant") & yes(a, "F") & yes(b, "M")


@_either_way
def powder_or_liquid(a: Column, b: Column) -> Column:
    return yes(a, "powder") & yes(b, "liquid")


def diaper_size(a: Column, b: Column) -> Column:
    return _either(a, b, "FRAL") & _clash(a, b, "diaper")


def corn_and_peas(a: Column, b: Column) -> Column:
    """A mixture against one alone, or corn against peas."""
    mixed = lambda x: yes(x, "MILHO") & yes(x, "ERVILHA")
    only = lambda x, w, v: yes(x, w) & ~yes(x, v)
    crossed = (only(a, "ERVILHA", "MILHO") & only(b, "MILHO", "ERVILHA")) | (only(b, "ERVILHA", "MILHO") & only(a, "MILHO", "ERVILHA"))
    return (mixed(a) != mixed(b)) | crossed


def coconut(a: Column, b: Column) -> Column:
    return (_both(a, b, "COCO") & _one(a, b, "flakes")) | (_either(a, b, "COCO RAL") & _one(a, b, "SEMACUCAR"))


def tomato_extract(a: Column, b: Column) -> Column:
    brands = _apart(_brands_of(a, ("EXTR TOM",)), _brands_of(b, ("EXTR TOM",)))
    return _both(a, b, "EXTR TOM") & (_differ(a, b, "extract package") | _differ(a, b, "extract kind") | _apart(a["measures"], b["measures"]) | brands)


def _same_brand(a: Column, b: Column, *categories: str) -> Column:
    """True where brands differ or only one side tells one."""
    x, y = _brands_of(a, categories), _brands_of(b, categories)
    return _apart(x, y) | (_some(x) != _some(y))


def ketchup(a: Column, b: Column) -> Column:
    return _both(a, b, "KETCHUP") & (_one(a, b, "hot") | _same_brand(a, b, "KETCHUP"))


def mayonnaise_lime(a: Column, b: Column) -> Column:
    return _both(a, b, "mayonnaise") & _one(a, b, "LIMAO")


def sauce(a: Column, b: Column) -> Column:
    return _both(a, b, "sauce") & (_differ(a, b, "sauce kind") | _same_brand(a, b, "MOLHO", "MOL TOM"))


def canned_fish(a: Column, b: Column) -> Column:
    brands = _apart(_brands_of(a, ("ATUM", "SARD")), _brands_of(b, ("ATUM", "SARD")))
    return _both(a, b, "fish") & (_clash(a, b, "fish") | ((held(a, "fish") != 0) != (held(b, "fish") != 0)) | brands)


def stock_cube(a: Column, b: Column) -> Column:
    """Sets of flavours that differ, even if they share one."""
    return (held(a, "stock") != 0) & (held(b, "stock") != 0) & _differ(a, b, "stock")


def unknown_brand(a: Column, b: Column) -> Column:
    """The first name's brand is known in its category; the second has another of that category, or none."""

    def clash(c: Column) -> Column:
        x, y = _brands(a, c), _brands(b, c)
        return y.isNull() | _some(F.array_except(y, x)) | (F.size(x) > 1)

    return F.exists(a["inside"], clash)


@_either_way
def kerosene(a: Column, b: Column) -> Column:
    return yes(a, "QUEROSENE") & yes(b, "DESINF")


def starch(a: Column, b: Column) -> Column:
    return _one(a, b, "AMIDO")


def wine_colour(a: Column, b: Column) -> Column:
    return _clash(a, b, "wine")


def shampoo_kit(a: Column, b: Column) -> Column:
    return _either(a, b, "shampoo") & _one(a, b, "kit")


def gum_pot(a: Column, b: Column) -> Column:
    return _both(a, b, "TRIDENT") & _one(a, b, "POTE")


def razor_line(a: Column, b: Column) -> Column:
    return _clash(a, b, "razor")


def fish_cut(a: Column, b: Column) -> Column:
    return _either(a, b, "fish inside") & _clash(a, b, "cut")


def spirit(a: Column, b: Column) -> Column:
    return _clash(a, b, "spirit")


def knowledge(a: Column, b: Column) -> Column:
    """Conflicts of two recognised products (operators.recognise): struct(category, brand, flavour, fragrance, line, confidence)."""
    differ = lambda f: a[f].isNotNull() & b[f].isNotNull() & (a[f] != b[f])
    sure = lambda least: (a["confidence"] >= least) & (b["confidence"] >= least)
    details = differ("brand") | differ("flavour") | differ("fragrance") | differ("line")
    return F.coalesce(sure(0.7) & ((differ("category") & sure(0.85)) | ((a["category"] == b["category"]) & details)), F.lit(False))


_SAFE: tuple[Lock, ...] = (category_clash, brand_clash, snack_flavour, cleaning_fragrance, package_count)
_BOTH: tuple[Lock, ...] = (cross_category, olive_oil_kind, foil_size, implied_weight, category_brand, fruit, can_or_sachet, powder_or_liquid, coconut, tomato_extract, ketchup, mayonnaise_lime, sauce, canned_fish, stock_cube, kerosene, wine_colour, shampoo_kit, gum_pot, razor_line)


def strict_locks(rules: BrandRules) -> dict[str, Lock]:
    """The locks of the first and third tier, by name."""
    own = (pack_size, flavour, olive_oil_line, milk_kind, light_sauce, sachet_or_pot, carton_or_glass, alcohol, deodorant_for, diaper_size, corn_and_peas, starch)
    named = {f.__name__: f for f in (*_SAFE, *_BOTH, *own)}
    return named | {"weight": lambda a, b: weight(a, b, ("LA ACO",)), "subtype": subtype, "variant_words": variant_words}


def light_locks(rules: BrandRules) -> dict[str, Lock]:
    """The locks of the second tier, by name."""
    return {f.__name__: f for f in (*_SAFE, *_BOTH, pack_size_light, brand_across_categories, unknown_brand, fish_cut, spirit)} | {"weight": weight}


def blocked(a: Column, b: Column, locks: dict[str, Lock]) -> Column:
    return reduce(lambda p, q: p | q, [F.coalesce(lock(a, b), F.lit(False)) for lock in locks.values()], F.lit(False))

"""Locks, fuzzy matching and recognition: cases, and brute force over small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from mercadia.functions.names import BrandRules, name_features, normal_name
from mercadia.functions import similarity
from mercadia.functions.similarity import may_reach, profiled, set_ratio, sort_ratio, token_set_ratio, token_sort_ratio
from mercadia.operators import fuzzy
from mercadia.operators.catalogue import best_images, image_candidates
from mercadia.operators.locks import light_locks, strict_locks
from mercadia.operators.recognise import recognise
from mercadia.plans.catalog import QUERIES

RULES = BrandRules((("CAFE", "PILAO"), ("CAFE", "UNIAO"), ("KETCHUP", "HEINZ"), ("KETCHUP", "QUERO"), ("MOLHO", "QUERO"), ("LAVA ROUPA", "OMO"), ("LAVA ROUPA", "ACE"), ("ATUM", "COQUEIRO"), ("EXTR TOM", "ELEFANTE"), ("BATATA", "PRINGLES")))

BLOCKED = [
    ("weight", "CAFE PILAO 500G", "CAFE PILAO 250G"),
    ("category_brand", "CAFE PILAO 500G", "CAFE UNIAO 500G"),
    ("pack_size", "PAPEL HIG C4", "PAPEL HIG C12"),
    ("category_clash", "ALCOOL 1L", "AMIDO 1L"),
    ("fruit", "SUCO UVA 1L", "SUCO LARANJA 1L"),
    ("powder_or_liquid", "LAVA ROUPA PO OMO", "LAVA ROUPA LIQ OMO"),
    ("can_or_sachet", "MILHO VERDE LT", "MILHO VERDE SC"),
    ("ketchup", "KETCHUP HEINZ PICANTE", "KETCHUP HEINZ TRAD"),
    ("sauce", "MOLHO QUERO PIZZA", "MOLHO QUERO TRAD"),
    ("canned_fish", "ATUM COQUEIRO TOMATE", "ATUM COQUEIRO OLEO"),
    ("coconut", "COCO RAL FLOCOS", "COCO RAL"),
    ("stock_cube", "CALDO GALINHA CARNE", "CALDO GALINHA"),
    ("mayonnaise_lime", "MAIONESE LIMAO", "MAIONESE"),
    ("alcohol", "ALCOOL GEL 70", "ALCOOL LIQ 70"),
    ("diaper_size", "FRALDA P", "FRALDA XG"),
    ("starch", "AMIDO MILHO", "MILHO VERDE"),
    ("wine_colour", "VIN TINTO", "VIN BRANCO"),
    ("shampoo_kit", "SH SEDA +COND", "SH SEDA 1L"),
    ("olive_oil_kind", "AZEITE EXTRAVIRGEM", "AZEITE TIPO UNICO"),
    ("foil_size", "PAPEL ALUM 30X4", "PAPEL ALUM 45X4"),
    ("implied_weight", "LAVA ROUPA OMO 400", "LAVA ROUPA OMO 1.6KG"),
    ("cleaning_fragrance", "DESINF LAVANDA 1L", "DESINF PINHO 1L"),
    ("corn_and_peas", "ERVILHA MILHO", "MILHO"),
    ("milk_kind", "LEITE SEMI 1L", "LEITE 1L"),
    ("light_sauce", "MAIONESE LIGHT", "MAIONESE"),
    ("sachet_or_pot", "KETCHUP SACHE", "KETCHUP POTE"),
    ("carton_or_glass", "SUCO UVA TP", "SUCO UVA VD"),
    ("deodorant_for", "DESOD DOVE F", "DESOD DOVE M"),
    ("tomato_extract", "EXTR TOM ELEFANTE SACHE", "EXTR TOM ELEFANTE POTE"),
    ("kerosene", "QUEROSENE X", "DESINF X"),
    ("gum_pot", "TRIDENT POTE", "TRIDENT"),
    ("razor_line", "APAR BIC SOLEIL", "APAR BIC COMFORT"),
    ("subtype", "CAFE MAIONESE", "CAFE MOSTARDA"),
    ("subtype", "CR DENT COLGATE LUMINOUS WHITE 70G", "CR DENT COLGATE MPA A/CARIE 90G"),
    ("subtype", "CR DENT COLGATE NAT 90G", "CR DENT COLGATE MPA 90G"),
    ("subtype", "CR DENT COLGATE NEUTRACUCAR 70G", "CR DENT COLGATE TOTAL12 90G"),
    ("subtype", "BATON 70% 30G", "BATON 40% 30G"),
    ("subtype", "SUCO UVA S/ACUC", "SUCO UVA LIGHT"),
    ("subtype", "CERV LONG NECK", "CERV LN"),
    ("variant_words", "SH PANTENE HIDRATACAO", "SH PANTENE NUTRICAO"),
    ("variant_words", "DESOD DOVE VANILLA", "DESOD DOVE OCEAN"),
    ("variant_words", "BALA HORTELA", "BALA CAMOMILA"),
    ("flavour", "BALA MENTA", "BALA BAUNILHA"),
    ("olive_oil_line", "AZEITE SUAVE", "AZEITE"),
    ("snack_flavour", "BATATA QUEIJO", "BATATA CEBOLA"),
    ("package_count", "APAR C2", "APAR C4"),
    ("cross_category", "CAFE X", "KETCHUP X"),
    ("unknown_brand", "CAFE PILAO 500G", "CAFE 500G"),
    ("brand_across_categories", "CAFE UNIAO X", "CAFEZINHO UNIAO X"),
    ("fish_cut", "ATUM SOLIDO", "ATUM RALADO"),
    ("spirit", "VODKA X", "WHISKY X"),
    ("brand_clash", "LAVA ROUPA OMO 1KG", "LAVA ROUPA ACE 1KG"),
    ("pack_size_light", "PAPEL C4", "PAPEL C8"),
]
FREE = [("CAFE PILAO 500G", "CAFE PILAO TRAD 500G"), ("LA ACO 60G", "LA ACO 44G"), ("ACUCAR 1KG", "ACUCAR 1KG"), ("CAFE 500G", "CAFE 500G"), ("SUCO UVA 1L", "SUCO 1L"), ("CR DENT COLGATE MPA A/CARIE 90G", "CR DENT COLGATE MPA A CARIE 90G"), ("CR DENT SENSODYNE SENSIVEL 90G", "CR DENT SENSODYNE 90G"), ("SH SEDA HIDRATACAO", "SH SEDA HIDRATACAO BRILHO"), ("SOLAR 1L", "SOLUVEL 1L")]


@pytest.fixture(scope="module")
def verdicts(spark):
    """All locks over all pairs of the cases."""
    rows = [(n, a, b) for n, a, b in BLOCKED] + [("", a, b) for a, b in FREE]
    df = spark.createDataFrame(rows, "lock string, x string, y string").select("*", name_features(F.col("x"), RULES).alias("a"), name_features(F.col("y"), RULES).alias("b"))
    locks = light_locks(RULES) | strict_locks(RULES)
    out: dict = {}
    for some in (list(locks)[i : i + 8] for i in range(0, len(locks), 8)):
        for r in df.select("x", "y", *[F.coalesce(locks[n](F.col("a"), F.col("b")), F.lit(False)).alias(n) for n in some]).collect():
            out.setdefault((r["x"], r["y"]), {}).update({n: r[n] for n in some})
    return out


@pytest.mark.parametrize(("lock", "a", "b"), BLOCKED)
def test_lock_blocks(verdicts, lock, a, b):
    assert verdicts[a, b][lock]


@pytest.mark.parametrize(("a", "b"), FREE)
def test_strict_locks_let_pass(verdicts, a, b):
    assert not [n for n in strict_locks(RULES) if verdicts[a, b][n]]


def test_fuzzy_matches_as_brute_force_without_locks_in_the_way(spark):
    table = ["CAFE PILAO 500G", "CAFE UNIAO 500G", "ARROZ CAMIL 5KG", "FEIJAO CAMIL 1KG", "CAFE PILAO 500G VACUO"]
    quoted = ["CAFE PILAO 500G", "PILAO CAFE 500G", "ARROZ CAMIL TIPO 5KG", "NADA"]
    prices = spark.createDataFrame([(1, n, float(i), i) for i, n in enumerate(table)], "table_id int, name string, price double, row_no int")
    items = spark.createDataFrame([(1, n) for n in quoted], "table_id int, name string")
    got = {r["name"]: (r["matched"], r["kind"]) for r in fuzzy.match_names(items, prices, RULES).collect()}
    for n in quoted:
        scores = [(max(token_sort_ratio(n, t), token_set_ratio(n, t)) / 100, -i, t) for i, t in enumerate(table) if token_set_ratio(n, t) >= 55]
        best = max(scores, default=None)
        # the locks let all of these pass, so the best score decides
        assert bool(best and best[0] >= 0.82) == (n in got)
        if n in got:
            assert got[n] == (best[2], f"SIMILAR {int(best[0] * 100)}%")
    assert set(got) == set(quoted) - {"NADA"}


def test_second_and_third_tier_and_knowledge(spark):
    # (quoted, table's name): 2 of 3 words shared; the weight lock is of both kinds, the subtype lock only strict
    table = ["KETCHUP HEINZ BISNAGA PREMIUM NOVO", "ARROZ CAMIL BRANCO LONGO FINO SELETO"]
    prices = spark.createDataFrame([(1, n, float(i + 1), i) for i, n in enumerate(table)], "table_id int, name string, price double, row_no int")
    items = spark.createDataFrame([(1, "KETCHUP HEINZ POTE PREMIUM NOVO"), (1, "ARROZ CAMIL AGULHA TOP ESPECIAL")], "table_id int, name string")
    found = {r["quoted"]: r for r in fuzzy.with_locks(fuzzy.candidates(items, prices), RULES).where("substring(quoted, 1, 5) = substring(name, 1, 5)").collect()}
    one, other = found["KETCHUP HEINZ POTE PREMIUM NOVO"], found["ARROZ CAMIL AGULHA TOP ESPECIAL"]
    assert one["strict"] and not one["light"] and one["score"] >= fuzzy.TIER_2
    tier = lambda score, strict, light, same, ok: spark.range(1).select(fuzzy.tier_of(F.lit(score), F.lit(strict), F.lit(light), F.lit(same), F.lit(ok))).first()[0]
    assert [tier(0.9, False, True, False, False), tier(0.9, True, False, False, False), tier(0.7, False, False, False, False), tier(0.63, False, False, True, True), tier(0.63, False, False, True, False), tier(0.63, True, False, True, True), tier(0.7, False, True, True, True), tier(0.6, False, False, True, True)] == [1, 2, 2, 3, None, None, 3, None]
    got = {r["name"]: r["kind"] for r in fuzzy.match_names(items, prices, RULES).collect()}
    assert got["KETCHUP HEINZ POTE PREMIUM NOVO"].startswith("SIMILAR ")
    assert other["score"] < fuzzy.TIER_3 and "ARROZ CAMIL AGULHA TOP ESPECIAL" not in got
    # a knowledge table that tells both products' flavours blocks what the names alone let pass
    known = spark.createDataFrame([(i, *r) for i, r in enumerate(KNOWLEDGE)], "ordinal int, category string, brand string, field string, value string, term string")
    pair = spark.createDataFrame([("REF PO TANGO LARANJA 18G", "REF PO TANGO UVA 18G"), ("REF PO TANGO UVA 18G", "REF PO TANGO UVA 18 G")], "quoted string, name string")
    flags = {r["name"]: (r["strict"], r["light"]) for r in fuzzy.with_locks(pair, RULES, known).collect()}
    assert flags["REF PO TANGO UVA 18G"] == (True, True) and flags["REF PO TANGO UVA 18 G"][1] is False


def test_ratios_are_those_of_the_plain_rules(spark):
    """10,000 pairs: names, letters in any order, other alphabets, repeated words, and texts longer than one bigint."""
    rng = random.Random(8)
    words = ["CAFE", "PILAO", "500G", "TORRADO", "É+", "UVA", "AB", "BA", "ARROZ", "C12", "CAFÉ", "A" * 20, "😀X"]

    def text():
        if rng.random() < 0.9:
            return " ".join(rng.choices(words[: rng.choice([6, 13])], k=rng.randint(0, 5)))
        return "".join(rng.choices("ABC DEÉ😀1", k=rng.choice([0, 1, 5, 30, 61, 62, 63, 130])))

    rows = [(a, b, similarity._common(a, b), token_set_ratio(a, b), token_sort_ratio(a, b)) for a, b in ((text(), text()) for _ in range(10_000))]
    df = spark.createDataFrame(rows, "a string, b string, common int, by_set double, by_sort double").repartition(16)
    df = profiled(profiled(df, "a", "x"), "b", "y")
    found = df.select("a", "b", "by_set", (similarity.common(F.col("a"), F.col("b")) - F.col("common")).alias("d0"), (set_ratio("x", "y") - F.col("by_set")).alias("d1"), (sort_ratio("x", "y") - F.col("by_sort")).alias("d2"), may_reach("x", "y", 55.0).alias("may")).collect()
    assert not [r for r in found if r.d0 or abs(r.d1) > 1e-9 or abs(r.d2) > 1e-9]
    # the bound holds for whole names; names that share no word have no other ratio
    strangers = [r for r in found if not set(r.a.split()) & set(r.b.split())]
    assert not [r for r in strangers if r.by_set >= 55 and not r.may] and sum(not r.may for r in strangers) > 500


def product_names(rng, n):
    kinds = "CAFE ARROZ FEIJAO MACARRAO BISCOITO LEITE SABAO AMACIANTE DETERGENTE SHAMPOO REFRIGERANTE SUCO CERVEJA VINHO MOLHO AZEITE ACUCAR FARINHA CHOCOLATE PAPEL FRALDA CREME".split()
    syllables = "BA BE BI CO CU DA DI FA FE GI LA LU MA ME NI NO PA PE RA RO SA SI TA TO VE ZA".split()
    brands = ["".join(rng.choices(syllables, k=rng.randint(2, 4))) for _ in range(n // 12)]
    kept = "TRADICIONAL LIMAO MORANGO UVA LARANJA INTEGRAL LIGHT ZERO EXTRA FORTE SUAVE FLORAL NEUTRO COCO AVEIA MEL VERDE SECO DOCE".split()
    one = lambda: " ".join([rng.choice(kinds), rng.choice(brands), *rng.sample(kept, rng.randint(0, 3)), rng.choice("100G 200G 500G 1KG 5KG 300ML 1L 2L".split())])
    return list(dict.fromkeys(one() for _ in range(2 * n)))[:n]


def brute_candidates(quoted, names, most=40):
    scores = sorted((-token_set_ratio(quoted, n), i) for i, n in enumerate(names) if token_set_ratio(quoted, n) >= 55)[:most]
    return [(k + 1, names[i], round(-s, 9), round(max(-s, token_sort_ratio(quoted, names[i])) / 100, 9)) for k, (s, i) in enumerate(scores)]


def test_candidates_are_those_of_all_pairs(spark, monkeypatch):
    """No candidate is lost or added, and few pairs are made for them; a table's pairs are dealt over several shares."""
    monkeypatch.setattr(fuzzy, "SHARE", 100_000)
    rng = random.Random(21)
    names = product_names(rng, 900)
    quoted = [*names[:60], *[" ".join(rng.sample(n.split(), max(1, len(n.split()) - 1))) for n in rng.sample(names, 200)], "ZZZ QQQ", "CAFE", "5KG", "A B C D"]
    quoted = list(dict.fromkeys(quoted))
    prices = spark.createDataFrame([(1, n, float(i), i) for i, n in enumerate(names)] + [(2, "CAFE", 1.0, 0)], "table_id int, name string, price double, row_no int")
    items = spark.createDataFrame([(1, q) for q in quoted] + [(2, "CHA"), (3, "CAFE")], "table_id int, name string")
    got: dict = {}
    for r in fuzzy.candidates(items, prices).collect():
        got.setdefault((r.table_id, r.quoted), []).append((r.rank, r.name, round(r.set, 9), round(r.score, 9)))
    for q in quoted:
        assert sorted(got.pop((1, q), [])) == brute_candidates(q, names), q
    assert got.pop((2, "CHA")) == brute_candidates("CHA", ["CAFE"]) and got == {}
    q, n = profiled(fuzzy._quoted(items), "quoted", "q"), profiled(fuzzy._table_rows(prices), "name", "n")
    first = fuzzy.sharing(q, n).select("table_id", "quoted", "name").distinct().count()
    assert first < 0.15 * len(quoted) * len(names)


def test_a_table_matches_itself(spark):
    names = ["CAFE PILAO 500G", "KETCHUP HEINZ 397G", "LAVA ROUPA PO OMO 1.6KG"]
    prices = spark.createDataFrame([(1, n, float(i), i) for i, n in enumerate(names)], "table_id int, name string, price double, row_no int")
    got = fuzzy.match_names(prices.select("table_id", "name"), prices, RULES).collect()
    assert sorted((r["name"], r["matched"], r["kind"]) for r in got) == sorted((n, n, "SIMILAR 100%") for n in names)


def test_blocked_pairs_are_exact_pairs_that_share_a_word(spark, sf):
    prices = spark.createDataFrame([(1, "A B", 1.0, 0), (1, "C D", 2.0, 1)], "table_id int, name string, price double, row_no int")
    items = spark.createDataFrame([(1, "A X"), (1, "Y")], "table_id int, name string")
    pairs = lambda mode: {(r["quoted"], r["name"]) for r in fuzzy.pairs(items, prices, mode).collect()}
    assert pairs("exact") == {(q, n) for q in ("A X", "Y") for n in ("A B", "C D")}
    assert pairs("blocked") == {("A X", "A B")}


def test_normal_names_are_stable(spark, sf):
    out = QUERIES["q_normalise_name"](spark, sf)
    assert out.where(normal_name(F.col("name")) != F.col("name")).count() == 0
    assert out.agg(F.sum("rows")).first()[0] == spark.read.parquet(f"{sf}/part.parquet").count()


KNOWLEDGE = [
    ("drink powder", None, "category", "drink powder", "ref po"),
    ("drink powder", "Tango", "brand", "Tango", "tango"),
    ("drink powder", "Tango", "flavour", "laranja", "laranja"),
    ("drink powder", "Tango", "flavour", "uva", "uva"),
    ("softener", None, "category", "softener", "amaciante"),
    ("softener", None, "fragrance", "lavanda", "lavanda"),
    ("softener", "Fofa", "brand", "Fofa", "fofa"),
]


def test_recognition(spark):
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(KNOWLEDGE)], "ordinal int, category string, brand string, field string, value string, term string")
    texts = spark.createDataFrame([("Suco Pó Tango Laranja 18g",), ("Amaciante lavanda 2 litros",), ("Parafuso",), ("Tango amaciante",), ("Laranja amaciante fofa",), (None,), ("",)], "text string")
    got = {r["text"]: r for r in recognise(texts, rows).collect()}
    a = got["Suco Pó Tango Laranja 18g"]
    assert (a["category"], a["brand"], a["flavour"], a["weight"], a["confidence"], a["alerts"]) == ("drink powder", "Tango", "laranja", "18g", 0.98, [])
    b = got["Amaciante lavanda 2 litros"]
    assert (b["category"], b["brand"], b["fragrance"], b["volume"], b["confidence"]) == ("softener", None, "lavanda", "2l", 0.8)
    assert got["Parafuso"]["confidence"] == 0 and "no_category" in got["Parafuso"]["alerts"]
    assert "ambiguous" in got["Tango amaciante"]["alerts"]
    assert got["Laranja amaciante fofa"]["flavour"] is None
    assert None not in got and got[""]["category"] is None


def test_image_scores(spark):
    rows = [
        ("CAFE PILAO 500G", "http://x/cafe-pilao-500g.jpg", None, "Café Pilao 500g", 800, 800, 0),
        ("CAFE PILAO 500G", "http://x/thumb.jpg", None, "Café Uniao 250g", 100, 100, 1),
        ("CAFE PILAO 500G", "http://pinterest/x.jpg", None, "Café Pilao 500g", 800, 800, 2),
    ]
    df = image_candidates(spark.createDataFrame(rows, "product string, image_url string, thumb_url string, text string, width int, height int, rank int"))
    got = {r["rank"]: r for r in df.collect()}
    # 100 + 64 + 60 for the image, 50 for its rank, 3 shared words, brand and quantity
    assert got[0]["score"] == 100 + 64 + 60 + 50 + 3 * 16 + 35 + 35 and not got[0]["review"]
    assert got[1]["flags"] == ["quantity_conflict"] and got[2]["blocked"]
    assert [r["rank"] for r in best_images(df).collect()] == [0]


@pytest.mark.parametrize("name", ["q_word_overlap", "q_image_score", "q_recognise"])
def test_other_queries_give_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0

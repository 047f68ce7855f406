"""Product names: normal forms under rule tables, and what names say of measures, packages, brands and kinds.

The rules are parameters. `NameRules` and `BrandRules` come with short defaults; a company's full tables are
read with `from_table`. Everything is a Column expression, so a name is handled in one pass in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercadia.functions.answers import answers, literal, lookup
from mercadia.functions.answers import words as _words
from mercadia.functions.text import fold_ascii

#: Rows a rule table may have: rules become literals of the plan.
MOST_RULES = 5_000


def _rows(table: DataFrame, *columns: str) -> list:
    rows = table.select(*columns).limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"a rule table may have {MOST_RULES} rows at most")
    return rows


@dataclass(frozen=True)
class NameRules:
    """Ordered rules of normal forms; order is part of their meaning."""

    #: (first words, replacement): the first rule that fits a name's beginning, alone, is applied.
    prefixes: tuple[tuple[str, str], ...] = (
        ("PAP HIG", "PAPEL HIG"),
        ("PAPEL ALUMINIO", "PAPEL ALUM"),
        ("PAPEL TOALHA", "TOALHA PAP"),
        ("TIRA MANCHAS", "T MANCHA"),
        ("TIRA MANCHA", "T MANCHA"),
        ("PANO DE CHAO", "PANO CHAO"),
        ("VINHO", "VIN"),
        ("OLEO DE", "OLEO"),
    )
    #: (text, replacement): spellings, replaced wherever they occur, before units.
    spellings: tuple[tuple[str, str], ...] = (("EXTRA FORTE", "EXTRAFORTE"), ("EXTRA-FORTE", "EXTRAFORTE"), ("EXTRA VIRGEM", "EXTRAVIRGEM"), ("EXTRA-VIRGEM", "EXTRAVIRGEM"))
    #: (text, replacement): synonyms, replaced wherever they occur, in order, after units.
    synonyms: tuple[tuple[str, str], ...] = (
        ("SABAO EM PO", "LAVA ROUPA PO"),
        ("SABAO PO", "LAVA ROUPA PO"),
        ("SABAO LIQUIDO", "LAVA ROUPA LIQ"),
        ("LIQUIDO", "LIQ"),
        ("TRADICIONAL", "TRAD"),
        ("ORIGINAL", "ORIG"),
        ("MACARRAO", "MACAR"),
        ("SHAMPOO", "SH"),
        ("CONDICIONADOR", "COND"),
        ("DETERGENTE", "DET"),
        ("DESINFETANTE", "DESINF"),
        ("SACHET", "SACHE"),
        ("REFRESCO", "REFR"),
        ("CONCENTRADO", "CONC"),
        ("BOLACHA", "BISC"),
        ("BISCOITO", "BISC"),
        ("AZEITE DE OLIVA", "AZEITE"),
        ("ACHOCOLATADO", "ACHOC"),
        ("AMACIANTE", "AMAC"),
        ("SABONETE", "SAB"),
        ("LEITE CONDENSADO", "LEITE COND"),
        ("LEITE EM PO", "LEITE PO"),
        ("COCO RALADO", "COCO RAL"),
        ("CREME DENTAL", "CR D"),
        ("CREME DE LEITE", "CR LEITE"),
    )
    #: (brand, category): a name with the brand but without the category's first word gets the category.
    brand_categories: tuple[tuple[str, str], ...] = ()
    #: Names that begin with one of these words get no category.
    settled: tuple[str, ...] = ()

    @staticmethod
    def from_table(table: DataFrame) -> NameRules:
        """From rows (kind, position, source, target); kind is a field of this class."""
        found: dict[str, list] = {k: [] for k in NameRules.__dataclass_fields__}
        for r in sorted(_rows(table, "kind", "position", "source", "target"), key=lambda r: r["position"]):
            found[r["kind"]].append(r["source"] if r["kind"] == "settled" else (r["source"], r["target"]))
        return NameRules(**{k: tuple(v) for k, v in found.items()})


def _pairs(rules: tuple[tuple[str, str], ...]) -> Column:
    return F.expr(literal([{"a": a, "b": b} for a, b in rules]))


_UNITS = (
    (r"(?:GR|GRAMAS|GRS|GRAMA|G)", "G"),
    (r"(?:KG|K|KILOS|KGS|QUILO|QUILOS|QUILOGRAMA|QUILOGRAMAS)", "KG"),
    (r"(?:ML|MLS|MILILITRO|MILILITROS)", "ML"),
)


def normal_name(c: Column, rules: NameRules = NameRules()) -> Column:
    """A product name in upper-case ASCII, in the rules' words, units glued to numbers, packs as C12; "" for none.

    The stages, in order: ASCII; entities; one prefix; decimal points; spellings; units; packs; loose dots;
    synonyms; a category after its brand. Replacements are of substrings, not of words.
    """
    name = F.trim(F.upper(fold_ascii(c)))
    for entity, plain in (("&AMP;", "&"), ("&LT;", "<"), ("&GT;", ">"), ("&QUOT;", '"'), ("&NBSP;", " ")):
        name = F.replace(name, F.lit(entity), F.lit(plain))

    def prefixed(n: Column) -> Column:
        out = None
        for words, short in rules.prefixes:
            pattern = "^" + r"\.?\s+".join(words.split()) + r"\b\.?"
            changed = F.trim(F.concat(F.lit(f"{short} "), F.trim(F.regexp_replace(n, pattern, ""))))
            out = F.when(n.rlike(pattern), changed) if out is None else out.when(n.rlike(pattern), changed)
        return n if out is None else out.otherwise(n)

    # a fold over one element binds the name so far to a variable: the plan's size stays linear in the rules
    def staged(n: Column, stage) -> Column:
        return F.aggregate(F.array(n), F.lit(""), lambda _, x: stage(x))

    name = F.regexp_replace(staged(name, prefixed), r"(\d+),(\d+)", "$1.$2")
    for text, other in rules.spellings:
        name = F.replace(name, F.lit(text), F.lit(other))
    for unit, short in _UNITS:
        name = F.regexp_replace(name, rf"\b(\d+(?:\.\d+)?)\s*{unit}\b", f"$1{short}")
    metres = lambda n: F.when(n.rlike("PAPEL|FILME|ALUMINIO|PLASTICO"), n).otherwise(F.regexp_replace(n, r"\b(\d{2,})M\b", "$1ML"))
    name = staged(name, metres)
    name = F.regexp_replace(name, r"\b(\d+(?:\.\d+)?)\s*(?:LITROS|LITRO|LTR|LT|L)\b", "$1L")
    name = F.regexp_replace(name, r"\b(\d+(?:\.\d+)?)\s*(?:METROS|METRO|MTS|MT)\b", "$1M")
    name = F.regexp_replace(name, r"\b(?:C/|COM\s+)(\d+)\b", "C$1")
    name = F.regexp_replace(name, r"(\d+(?:\.\d+)?(?:KG|G|ML|L|M|UN))(?=[A-Z])(?<!\dM(?=L))", "$1 ")
    name = F.regexp_replace(name, r"\bC\s+(\d+)\b", "C$1")
    name = F.regexp_replace(name, r"\b(\d+)\s*(?:UNIDADES|UNIDADE|UNDS|UNID|UND|UN)\b", "C$1")
    name = F.regexp_replace(F.replace(name, F.lit("&"), F.lit("E")), r"\.(\s|$)", "$1")
    for text, other in rules.synonyms:
        name = F.replace(name, F.lit(text), F.lit(other))
    if rules.brand_categories:
        settled = F.array(*[F.lit(w) for w in rules.settled]).cast("array<string>")

        def with_category(n: Column, rule: Column) -> Column:
            whole = F.contains(F.concat(F.lit(" "), n, F.lit(" ")), F.concat(F.lit(" "), rule["a"], F.lit(" ")))
            lacks = ~F.contains(n, F.substring_index(rule["b"], " ", 1))
            free = ~F.array_contains(settled, F.substring_index(n, " ", 1))
            return F.when(whole & lacks & free, F.concat_ws(" ", n, rule["b"])).otherwise(n)

        name = F.aggregate(_pairs(rules.brand_categories), name, with_category)
    return F.when(F.lower(F.trim(F.coalesce(c, F.lit("")))).isin("", "nan"), F.lit("")).otherwise(F.trim(F.regexp_replace(name, r"\s+", " ")))


def normalise_names(df: DataFrame, column: str, out: str, rules: NameRules = NameRules()) -> DataFrame:
    """df with the normal form of a column of names, worked out once a distinct name."""
    distinct = df.select(F.col(column).alias("__n")).where(F.col("__n").isNotNull()).distinct().withColumn(out, normal_name(F.col("__n"), rules))
    return df.join(distinct, F.col(column) == F.col("__n"), "left").drop("__n").withColumn(out, F.coalesce(out, F.lit("")))


def _all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


_MEASURE = r"\d+(?:\.\d+)?(?:KG|G|ML|LT|L|M|UN)\b"


def measures(name: Column) -> Column:
    """Measures such as 500G, and those inside packs such as 2X500G."""
    return F.array_distinct(F.concat(_all(name, rf"\b{_MEASURE}"), _all(name, rf"\b\d+\s*X\s*({_MEASURE})", 1)))


def measure_value(measure: Column) -> Column:
    """Grams or millilitres of a measure; null for units. A bare M counts as a litre."""
    number = F.regexp_extract(measure, r"^\d+(?:\.\d+)?", 0).try_cast("double")
    unit = F.regexp_extract(measure, r"[A-Z]+$", 0)
    return F.when(unit.isin("KG", "L", "LT", "M"), number * 1000).when(unit.isin("G", "ML"), number)


def foil_sizes(name: Column) -> Column:
    """Sizes such as 30X7.5 of aluminium foil, the smaller number first."""
    pattern = r"\b(\d+(?:\.\d+)?)\s*(?:CM|M)?\s*X\s*(\d+(?:\.\d+)?)\s*(?:CM|M)?\b"
    numbers = lambda g: F.transform(_all(name, pattern, g), lambda x: x.try_cast("double"))
    sizes = F.zip_with(numbers(1), numbers(2), lambda a, b: F.concat_ws("X", F.least(a, b).cast("string"), F.greatest(a, b).cast("string")))
    return F.when(F.contains(name, F.lit("PAPEL ALUM")), sizes).otherwise(F.array().cast("array<string>"))


#: What is counted on packages and the form of its number; fixed values.
PACKAGE_COUNTS = (
    ("C", r"\bC(\d+)\b"),
    ("CX", r"\bCX\s*(\d+)\b"),
    ("NIGHT", r"\b(\d+)\s*NOIT(?:E|ES)?\b"),
    ("TABLET", r"\b(\d+)\s*PAST(?:ILHA|ILHAS)?\b"),
    ("TAKE", r"\bLV\s*(\d+)\b"),
    ("PAY", r"\bPG\s*(\d+)\b"),
)


def package_counts(name: Column) -> Column:
    def found(kind: str, form: str) -> Column:
        return F.transform(_all(name, form, 1), lambda x: F.concat(F.lit(f"{kind}:"), x))

    return F.array_distinct(F.concat(*[found(kind, form) for kind, form in PACKAGE_COUNTS]))


def bare_numbers(name: Column) -> Column:
    """Numbers of 50 to 2000 without a unit, which are likely grams."""
    return F.filter(F.transform(_all(name, r"(?<!\d)(\d{2,4})(?!\d|G|KG|ML|L)", 1), lambda x: x.try_cast("double")), lambda x: x.between(50, 2000))


#: Signs of a category that count in names; fixed values. A trailing blank asks for a whole word.
CATEGORY_SIGNS = (
    ("AGUA SANITARIA", ("AGUA SANIT", "AGUA SAN ", "SANITARIA")),
    ("ACUCAR", ("ACUCAR",)),
    ("ALVEJANTE", ("ALVEJ", "ALV ", "T MANCHA")),
    ("ALCOOL", ("ALCOOL",)),
    ("ALGODAO", ("ALGODAO",)),
    ("AMIDO", ("AMIDO",)),
    ("AMAC", ("AMAC", "AMACIANTE")),
    ("ANIL", ("ANIL",)),
    ("APAR", ("APAR", "BARB")),
    ("CREME DENTAL", ("CR D ", "CR DENT", "CREME DENT")),
    ("DESINF", ("DESINF",)),
    ("DETERGENTE LOUCA", ("DET ", "DETERG", "LV LOUCA", "LAVA LOUCA")),
    ("FRAL", ("FRAL", "FRALDA")),
    ("INSET", ("INSET", "MATA INSET", "REPEL")),
    ("LAVA ROUPA", ("LAVA ROUPA", "LV ROUPA", "SABAO PO", "SAB PO")),
    ("LIMPADOR", ("LIMP ", "LIMPADOR", "MULTIUSO")),
    ("LIMPA VIDRO", ("LIMPA VID", "LIMP VID")),
    ("LUSTRA MOVEL", ("LUSTRA", "LUST MOV")),
    ("LA ACO", ("LA ACO",)),
    ("SAPONACEO", ("SAPON",)),
    ("VINHO", ("VIN ", "VINHO")),
)
#: Names of one category; fixed values.
SAME_CATEGORY = (
    ("DET", "LV LOUCA"),
    ("DETERGENTE", "LV LOUCA"),
    ("DESINFETANTE", "DESINF"),
    ("SABAO", "SAB"),
    ("BISCOITO", "BISC"),
    ("AGUARDENTE", "AGUARD"),
    ("CACHACA", "CACHAC"),
    ("SHAMPOO", "SH"),
    ("CONDICIONADOR", "COND"),
    ("REPELENTE", "REPEL"),
    ("MACAR", "MAC"),
    ("MAIONESE", "MAION"),
    ("POLPA TOM", "MOL TOM"),
    ("POLPA", "MOL TOM"),
    ("FRALDA", "FRAL"),
    ("PAPEL HIGIENICO", "PAPEL HIG"),
    ("CATCHUP", "KETCHUP"),
    ("T MANCHA", "ALV"),
    ("SABAO BARRA", "SABAO"),
    ("SABAO PASTA", "SABAO"),
)
#: Fragrances and the words that name them; fixed values.
FRAGRANCES = (
    ("LAVANDA", ("LAVANDA", "LAV", "LAVANDER")),
    ("EUCALIPTO", ("EUCALIPTO", "EUCAL")),
    ("LIMAO", ("LIMAO", "LEMON", "CITRUS", "CITRICO")),
    ("FLORAL", ("FLORAL", "FLOR")),
    ("TALCO", ("TALCO",)),
    ("NEUTRO", ("NEUTRO",)),
    ("AZUL", ("AZUL", "BLUE")),
    ("ROSA", ("ROSA", "ROSAS")),
    ("PRIMAVERA", ("PRIMAVERA",)),
    ("COCO_BAUNILHA", ("COCO BAUNILHA", "COCO", "BAUNILHA", "VANILLA")),
    ("ALGODAO", ("ALGODAO",)),
    ("AMENDOAS", ("AMENDOA", "AMENDOAS")),
    ("ORIENTAL", ("ORIENTAL", "ORIENT")),
)


#: Kinds of which a name can be of one in each group; fixed values. Groups of one kind, which exclude nothing, are left out.
SUBTYPES = (
    ("SACARINA", "SUCRALOSE", "STEVIA", "XILITOL", "FRUTOSE", "CICLAMATO", "ERITRITOL"),
    ("POTE", "COPO", "BALDE", "BISNAGA", "FRASCO"),
    ("SACHE", "SACHET", "SACHÊ", "POUCH", "REFIL", "REFILL"),
    ("AEROSSOL", "AEROSOL", "SPRAY"),
    ("STICK", "BASTAO", "BASTÃO"),
    ("DESOD AERO", "DESOD ROL", "DESOD CR", "DES SPRAY"),
    ("SUAVE", "INTENSO"),
    ("DIA A DIA", "DIAADI"),
    (" VD ", " VIDRO ", " LT ", " LATA ", " PET "),
    ("NEW WAFF", "WAFER"),
    ("DIPLOMATA", "ALPINO", "CRUNCH", "GALAK", "SUFLAIR", "CHARGE", "CHOKITO", "PRESTIGIO", "KIT KAT", "KITKAT", "TALENTO", "SERENATA", "BATON", "SONHO DE VALSA", "OURO BRANCO", "DIAMANTE NEGRO", "LAKA", "SHOT", "AMARO", "FIVE STAR", "BISAO", "TRENTO", "AO LEITE", "MEIO AMARGO", "BRANCO", "CROCANTE", "RECH"),
    ("SOJA", "CANOLA", "GIRASSOL", "MILHO"),
    ("COB SORV", "PO SORVETE"),
    ("SOLUVEL", "SOL"),
    ("LAVA ROUPA PO", "LAVA ROUPA LIQ"),
    ("40%", "60%", "70%", "80%", "85%", "90%", "95%"),
    ("INTEGRAL", "SEMIDESNATADO", "SEMI", "DESNATADO", "0% LACTOSE", "ZERO LACTOSE", "Z LAC"),
    ("LIGHT", "S/ACUC", "SEMACUCAR", "ZERO"),
    ("SOLIDO", "PEDACO", "RALADO"),
    ("OLEO", "NATURAL", "TOMATE"),
    ("DESINF", "DESINFETANTE", "MULTIUSO", "LIMP M U", "DESENG", "DESENGORDURANTE", "BANHEIRO", "LV LOUCA"),
    ("SUPREME", "TQ SEDA", "TOQ SEDA"),
    ("FOLHA DUPLA", "FOLHA SIMPLES", "F DUPLA", "F SIMPLES"),
    ("ALUM", "ALUMINIO", "MANTEIGA", "SULF"),
    ("PASTA", "BARRA", "PO", "LIQ"),
    ("RN", "PP", "XP"),
    ("JUMBO", "HIPER", "MEGA", "GIGA", "ECONOM"),
    ("FILTRO", "FILME"),
    ("MAIONESE", "KETCHUP", "MOSTARDA"),
    ("POLPA TOM", "MOL TOM", "EXTR TOM"),
    ("PARAF", "SPAG", "CURTO", "PENNE", "ESPAGUETE", "GRAVATA", "AVE MARIA", "FUSILLI", "FETTUCCINE", "LASANHA"),
    ("TOMATE PELADO", "MOL TOM", "EXTR TOM", "POLPA TOM"),
    ("INSET", "LIMP", "DESINF"),
    ("FRALDA", "PAPEL HIG"),
    ("FRAL", "PAPEL HIG"),
    ("VODKA", "APERITIVO", "CACHAC", "AGUARD", "CONHAQUE", "WHISKY"),
    ("BEB", "VODKA", "APERITIVO", "CACHAC", "AGUARD", "CONHAQUE", "WHISKY", "CERV", "VIN"),
    ("FIO DENT", "ESC DENT", "CR DENTAL", "CR D"),
    ("TORRADA", "BISC", "PAO"),
    ("BISC", "SALG", "BATATA", "TORRADA", "CHICLE", "BALA", "PAST"),
    ("MAC INS", "MACAR"),
    ("ARROZ", "FEIJAO"),
    ("COPO", "POTE", "PRATO", "DES", "DESOD"),
    ("CERA", "REMOVEDOR", "QUEROSENE", "DESINF", "LIMP", "SAPON"),
    ("TOALHA", "PAPEL HIG", "LENCO UMED"),
    ("PARBOILIZADO", "PARBO"),
    ("CARIOCA", "PRETO", "FRADINHO", "JALO", "BRANCO", "VERMELHO"),
    ("LN", "LONGNECK", "LONG NECK"),
    ("LUMINOUS WHITE", "MPA", "TOTAL12", "NAT", "NEUTRACUCAR", "SENSIVEL", "TRIPLA ACAO", "WHITENING", "ANTICARIE", "MAXFRESH", "EXTRAFRESH"),
    ("SOLEIL", "SENSITIVE", "INTENSITY", "COMFORT", "VENUS", "PRESTOBARBA"),
    ("ALC", "ALCALINA", "COMUM"),
)


@dataclass(frozen=True)
class BrandRules:
    """Which brands a category has; a category without a row of its own is unknown to the locks."""

    brands: tuple[tuple[str, str], ...] = ()
    #: Groups of kinds that exclude one another, each group in order.
    subtypes: tuple[tuple[str, ...], ...] = SUBTYPES

    @property
    def categories(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(c for c, _ in self.brands))

    def of(self, *categories: str) -> tuple[str, ...]:
        return tuple(sorted({b for c, b in self.brands if c in categories}))

    @staticmethod
    def from_table(table: DataFrame, groups: DataFrame | None = None) -> BrandRules:
        """From rows (category, brand), and rows (group_no, position, kind) of kinds that exclude one another."""
        brands = tuple(sorted({(r["category"], r["brand"]) for r in _rows(table, "category", "brand")}))
        if groups is None:
            return BrandRules(brands)
        found: dict = {}
        for r in sorted(_rows(groups, "group_no", "position", "kind"), key=lambda r: (r["group_no"], r["position"])):
            found.setdefault(r["group_no"], []).append(r["kind"])
        return BrandRules(brands, tuple(map(tuple, found.values())))


def _sign(name: Column, sign: str) -> Column:
    """Whether a sign is in a name: as a whole word, or as a substring if it has several words."""
    if sign.endswith(" "):
        return F.contains(F.concat(F.lit(" "), name, F.lit(" ")), F.lit(f" {sign}"))
    if " " in sign:
        return F.contains(name, F.lit(sign))
    return name.rlike(rf"(?<![A-Z0-9]){sign}(?![A-Z0-9])")


def _those(name: Column, table) -> Column:
    """Names of the table's entries that have a sign in the name."""
    found = []
    for value, signs in table:
        hit = F.lit(False)
        for s in signs:
            hit = hit | _sign(name, s)
        found.append(F.when(hit, F.lit(value)))
    return F.array_compact(F.array(*found))


def _canonical(categories: Column, more: tuple[tuple[str, str], ...] = ()) -> Column:
    same = lookup(dict((*SAME_CATEGORY, *more)), "string")
    return F.array_distinct(F.transform(categories, lambda c: F.coalesce(F.try_element_at(same, c), c)))


#: Kinds are numbered through: their group's number times this, and their place in it.
KINDS = 10_000


def _kinds(name: Column, groups: tuple[tuple[str, ...], ...]) -> Column:
    """Numbers of the first kind of each group, in its order, that a name holds: as a substring if it has a blank, else as a word."""
    letters = F.regexp_replace(name, "[^A-Z0-9]", " ")
    kind = lambda g, i, k: {"k": k, "w": f" {k} " if k.isalnum() and k.isascii() else "", "id": g * KINDS + i}
    listed = F.expr(literal([[kind(n, i, k) for i, k in enumerate(g)] for n, g in enumerate(groups) if len(g) > 1]))
    padded = F.concat(F.lit(" "), letters, F.lit(" "))
    word = lambda k: F.concat(F.lit(r"(?<![A-Z0-9])\Q"), k, F.lit(r"\E(?![A-Z0-9])"))
    held = lambda x: F.when(x["w"] != "", F.contains(padded, x["w"])).when(F.contains(x["k"], F.lit(" ")), F.contains(name, x["k"])).otherwise(F.rlike(name, word(x["k"])))
    return F.array_compact(F.transform(listed, lambda g: F.get(F.filter(g, held), F.lit(0))["id"]))


#: Under which names the brand table lists a safe category's brands, where they differ.
BRAND_LISTS = (
    ("AGUA SANITARIA", ("SANITARIA",)),
    ("COPO", ("COPO", "COPO DESC")),
    ("DETERGENTE LOUCA", ("DET", "LV LOUCA")),
    ("LIMPADOR", ("LIMP",)),
    ("LIMPA VIDRO", ("LIMP",)),
    ("LUSTRA MOVEL", ("LUSTRA",)),
    ("FRAL", ("FRAL", "FRALDA")),
    ("MAION", ("MAIONESE", "MAION")),
    ("DESOD", ("DESOD", "DES")),
    ("SALG", ("SALG", "BATATA")),
    ("BATATA", ("BATATA", "SALG")),
    ("CREME DENTAL", ("CR D", "CR DENTAL")),
    ("VINHO", ("VIN", "VINHO")),
)


def name_features(name: Column, rules: BrandRules) -> Column:
    """All that the locks ask of a normal name, as one struct: worked out once a distinct name, not once a pair.

    Neither the name nor its words are part of it: names with equal features are one to the locks. Brands stand by category:
    `brands` beside `branded` (categories of the brand table that have one in the name), `safe_brands` beside `safe`.
    """
    padded = F.concat(F.lit(" "), name, F.lit(" "))
    listed = _words(rules.categories)
    inside = F.filter(listed, lambda c: F.contains(name, F.concat(c, F.lit(" "))) | (name == c))
    whole = F.filter(listed, lambda c: F.contains(padded, F.concat(F.lit(" "), c, F.lit(" "))))
    safe = F.array_union(_those(name, CATEGORY_SIGNS), _canonical(whole, (("LV LOUCA", "LV LOUCA"),)))
    drop = lambda cats, if_in, value: F.when(F.array_contains(cats, if_in), F.array_remove(cats, value)).otherwise(cats)
    for if_in, value in (("AGUA SANITARIA", "AGUA"), ("LIMPA VIDRO", "LIMPADOR"), ("CREME DENTAL", "CREME")):
        safe = drop(safe, if_in, value)
    pairs = F.filter(_pairs(rules.brands), lambda r: F.contains(padded, F.concat(F.lit(" "), r["b"], F.lit(" ")))) if rules.brands else F.array().cast("array<struct<a:string,b:string>>")
    raw = F.struct(
        name.alias("name"),
        F.split(name, " ").alias("tokens"),
        F.array_distinct(_all(name, "[A-Z]{3,}")).alias("letters"),
        inside.alias("inside"),
        safe.alias("safe"),
        pairs.alias("pairs"),
        F.array_distinct(F.transform(pairs, lambda r: r["a"])).alias("branded"),
        measures(name).alias("measures"),
        _those(name, FRAGRANCES).alias("fragrances"),
        _kinds(name, rules.subtypes).alias("kinds"),
    )
    lists = lookup(dict(BRAND_LISTS), "array<string>")

    def of(x: Column, names: Column) -> Column:
        return F.array_distinct(F.transform(F.filter(x["pairs"], lambda r: F.array_contains(names, r["a"])), lambda r: r["b"]))

    def told(x: Column) -> Column:
        return F.struct(
            *answers(x, rules.categories),
            _canonical(x["inside"]).alias("categories"),
            x["safe"].alias("safe"),
            F.transform(x["safe"], lambda c: of(x, F.coalesce(F.try_element_at(lists, c), F.array(c)))).alias("safe_brands"),
            x["branded"].alias("branded"),
            F.transform(x["branded"], lambda c: of(x, F.array(c))).alias("brands"),
            F.array_intersect(x["inside"], x["branded"]).alias("inside"),
            F.filter(F.array_intersect(x["inside"], x["branded"]), lambda c: F.contains(x["name"], F.concat(c, F.lit(" ")))).alias("applied"),
            x["measures"].alias("measures"),
            F.filter(F.transform(x["measures"], measure_value), lambda v: v > 0).alias("values"),
            foil_sizes(x["name"]).alias("foil"),
            bare_numbers(x["name"]).alias("bare"),
            F.array_distinct(_all(x["name"], r"(?:C|L)(\d+)", 1)).alias("packs"),
            F.array_distinct(F.concat(_all(x["name"], r"\bC(\d+)\b", 1), _all(x["name"], r"L(\d+)P", 1))).alias("packs_light"),
            package_counts(x["name"]).alias("counts"),
            x["kinds"].alias("kinds"),
            F.transform(x["kinds"], lambda k: F.floor(k / KINDS).cast("int")).alias("groups"),
        )

    return F.get(F.transform(F.array(raw), told), F.lit(0))


def first_word(name: Column) -> Column:
    return F.substring_index(name, " ", 1)


def longest_brand(name: Column, rules: BrandRules) -> Column:
    """The longest brand that is in a normal name as whole words; "" for none."""
    ordered = sorted({b for _, b in rules.brands}, key=lambda b: (-len(b), b))
    padded = F.concat(F.lit(" "), name, F.lit(" "))
    return F.coalesce(F.get(F.filter(_words(ordered), lambda b: F.contains(padded, F.concat(F.lit(" "), b, F.lit(" ")))), F.lit(0)), F.lit(""))

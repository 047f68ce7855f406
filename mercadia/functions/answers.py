"""What the locks ask of one name alone, answered once a distinct name and packed in bits of bigints.

A set is a choice of words of which a name may hold some; each word has a bit of its own. FLAGS are questions with yes or no,
and are a set too. operators.locks compares the bits of two names, so a pair costs no look at the names' letters.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values ----
FRUITS = ("ABACAXI", "ACEROLA", "AMORA", "BANANA", "CAJU", "CARAMBOLA", "CEREJA", "COCO", "FRAMBOESA", "GOIABA", "GRAPE", "GUARANA", "JABUTICABA", "LARANJA", "LIMAO", "MACA", "MAMAO", "MANGA", "MARACUJA", "MELANCIA", "MORANGO", "PESSEGO", "TANGERINA", "TAMARINDO", "UVA", "UVAIA")
FLAVOURS = ("ABACAXI", "ACEROLA", "AMORA", "BANANA", "BAUNILHA", "BERRY", "CAJU", "CARAMBOLO", "CEREJA", "CHOC", "CHOCOLATE", "COCO", "CREME", "CREM", "FRAMBOESA", "GOIABA", "GRAPE", "GUARANA", "LARANJA", "LIMAO", "MACA", "MAMAO", "MANGA", "MARACUJA", "MELANCIA", "MENTA", "MORANGO", "PESSEGO", "TANGERINA", "TAMARINDO", "UVA", "UVAIA")
SNACK_FLAVOURS = ("ORIG", "ORIGINAL", "TRAD", "TRADICIONAL", "QUEIJO", "CHEDDAR", "REQUEIJAO", "CHURRASCO", "CEBOLA", "SALSA", "BACON", "PAPRICA", "PIMENTA", "PICANTE", "CREME", "CREM", "NACHO", "PRESUNTO", "BARBECUE", "BBQ", "RANCH", "CREAMCHEESE")
STOCK_FLAVOURS = ("BACON", "CARNE", "COSTELA", "GALINHA", "FRANGO", "LEGUMES", "PICANHA", "CAMARAO", "PEIXE", "FEIJAO", "COSTELINHA")
STOCK_BRANDS = ("KNORR", "MAGGI")
FISH_VARIANTS = ("TOMATE", "MOLHO", "PICANTE", "LIMAO", "OLEO", "DEFUMADO", "NATURAL")
ALCOHOL_FRAGRANCES = ("EUCALIPTO", "LAVANDA", "MIMO", "CITRONELA", "CRAVO", "BAUNILHA", "CANELA", "ERVA DOCE", "FLORAL", "CITRICO")
SPIRITS = ("VODKA", "APERITIVO", "CACHAC", "AGUARD", "CONHAQUE", "WHISKY")
DIAPER_SIZES = ("P", "M", "G", "PQ", "MD", "GD", "XG", "XXG", "XXXG", "RN", "PP", "XP")
RAZOR_LINES = ("SOLEIL", "SENSIVEL", "SENSITIVE", "INTENSITY", "COMFORT", "VENUS")
WINE_COLOURS = ("TINTO", "BRANCO", "ROSE")
FISH_CUTS = ("SOLIDO", "PEDACO", "RALADO")
#: Words of variants of which two names must share one if both have any.
VARIANTS = (
    "ABACAXI", "ACEROLA", "ACONCHEGO", "ALGODAO", "ALHO", "AMENDOA", "AMORA", "AZUL", "BABOSA", "BAMBU", "BANANA", "BAUNILHA", "BICARBONATO", "BIOTINA", "BRANCO", "BRISA", "CACAU", "CAJU", "CAMOMILA", "CAMPESTRE",
    "CANELA", "CAPIM", "CAPPUCCINO", "CEREJA", "CHA", "CHOCOLATE", "CITRICO", "CITRONELA", "CLEAR", "COCO", "COLONIA", "CRISTAL", "CUIDADO", "ERVA", "EUCAL", "EUCALIPTO", "FLOR", "FLORAL", "FRAMBOESA", "FRESCOR",
    "FRESH", "GLICERINA", "GOIABA", "GRAPE", "GUARANA", "HIALURONICO", "HORTELA", "INVISIBLE", "JASMIM", "KARITE", "LARANJA", "LAVANDA", "LIMAO", "LIRIOS", "MACA", "MACIEZ", "MAMAE", "MANGA", "MARACUJA", "MARINE",
    "MEL", "MELANCIA", "MENTA", "MICELAR", "MORANGO", "NEUTRO", "NOZES", "ORQUIDEA", "PESSEGO", "PIMENTA", "PINHO", "POWDER", "PRETO", "PRIMAVERA", "PURO", "RESTAURACAO", "ROSA", "ROSAS", "ROXO", "SEDA",
    "SPORT", "SUPREME", "TALCO", "TANGERINA", "TURQUESA", "TUTTI", "UVA", "VERAO", "VERDE", "PICANTE", "VERMELHA", "VERMELHO", "VERMELHAS", "VERMELHOS", "AMARELA", "AMARELO", "INCOLOR", "ARDOSIA", "DOURADO", "DOURADA",
    "YOGURTE", "CANDY", "VANILLA", "FIERCE", "PASSION", "OCEAN", "ENERGY", "EXTREME", "DETOX", "CLASS", "VANILLE", "CARVA", "PROTECAO", "SECA", "SENSIVEL", "LOVE", "MOVING", "ALUM", "BLACK", "ACTIVE",
    "INVISI", "HIDRATACAO", "CERAMIDAS", "NUTRICAO", "BOMBA", "BRILHO", "LISO", "CACHEADO", "ONDULADO", "FRIZZ", "RECONSTRUCAO",
)
#: Categories whose brand must be told on both sides or on neither.
BRAND_REQUIRED = ("AGUA SANITARIA", "AGUA COCO", "ACUCAR", "ALGODAO", "AMAC", "AMIDO", "ANIL", "DESINF", "DETERGENTE LOUCA", "LAVA ROUPA", "LIMPADOR", "LIMPA VIDRO", "LUSTRA MOVEL", "FRAL", "INSET", "APAR", "ALCOOL", "SH", "COND", "CR TRAT", "CR LEITE", "SAB", "DESOD", "CREME DENTAL", "SALG", "BATATA", "LA ACO", "MAION", "COPO", "ERVILHA", "MILHO")
#: Categories whose fragrances must agree.
SCENTED = ("AGUA SANITARIA", "ALCOOL", "AMAC", "DESINF", "DETERGENTE LOUCA", "LAVA ROUPA", "LIMPADOR", "LIMPA VIDRO", "LUSTRA MOVEL", "SAPONACEO")
#: Categories whose packages must hold the same number.
COUNTED = ("FRAL", "INSET", "APAR", "COPO")
SALTY = ("BATATA", "SALG")
DEGREES = ("46", "46.2", "70", "80", "92", "96")
SKIMMED = ("SEMI", "SEMIDESNATADO", "DESNATADO", "Z LAC", "ZERO LACTOSE", "0% LACTOSE")
FRAGRANCE_NAMES = ("LAVANDA", "EUCALIPTO", "LIMAO", "FLORAL", "TALCO", "NEUTRO", "AZUL", "ROSA", "PRIMAVERA", "COCO_BAUNILHA", "ALGODAO", "AMENDOAS", "ORIENTAL")

#: Bits of one bigint that are used.
BITS = 62


# ---- literals: tables of hundreds of values as one SQL text, which is parsed at once; a Column a value takes seconds ----
def literal(value) -> str:
    """A text, an integer, a dict (a struct) or a sequence of such, as SQL."""
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, dict):
        return f"named_struct({', '.join(f'{literal(k)}, {literal(v)}' for k, v in value.items())})"
    return str(value) if isinstance(value, int) else f"array({', '.join(map(literal, value))})"


def words(values) -> Column:
    return F.expr(f"cast({literal(tuple(values))} AS array<string>)")


def lookup(table: dict, kind: str) -> Column:
    """A map of texts to values of a type."""
    return F.expr(f"cast(map({', '.join(f'{literal(k)}, {literal(v)}' for k, v in table.items())}) AS map<string,{kind}>)")


# ---- building blocks: x is a struct with name, tokens, letters (words of letters), safe and fragrances ----
def _has(x: Column, *of: str) -> Column:
    """Whether a name has one of the words as a token."""
    return F.arrays_overlap(x["tokens"], words(of))


def _in(x: Column, *texts: str) -> Column:
    """Whether one of the texts is anywhere in a name."""
    return reduce(lambda a, b: a | b, [F.contains(x["name"], F.lit(t)) for t in texts])


def _word(x: Column, word: str) -> Column:
    return x["name"].rlike(rf"(?<![A-Z0-9]){word}(?![A-Z0-9])")


def _ends(x: Column, word: str) -> Column:
    return x["name"].rlike(f" {word}( |$)")


def _wine(x: Column) -> Column:
    return _in(x, "VIN ") | x["name"].startswith("VIN")


def _where(gate: Column, held: Column) -> Column:
    return F.when(gate, held).otherwise(words(()))


def _first(*cases: tuple[Column, str]) -> Column:
    """The word of the first case that holds, alone."""
    out = F.when(cases[0][0], F.lit(cases[0][1]))
    for case, word in cases[1:]:
        out = out.when(case, F.lit(word))
    return F.array_compact(F.array(out))


def _oil(x: Column) -> Column:
    oil = F.contains(F.concat(F.lit(" "), x["name"], F.lit(" ")), F.lit(" AZEITE ")) | x["name"].startswith("AZEITE")
    return _first((oil & _has(x, "RESERVA"), "R"), (oil & _has(x, "EXTRAVIRGEM"), "E"), (oil & (_in(x, "TIPO UNICO", "TIPOUNICO") | _has(x, "TRAD")), "U"))


def _stock(x: Column) -> Column:
    held = lambda of: F.arrays_overlap(x["letters"], words(of))
    return F.array_contains(x["letters"], "CALDO") | (held(STOCK_BRANDS) & held(STOCK_FLAVOURS))


#: Questions with yes or no.
FLAGS: dict[str, Callable[[Column], Column]] = {
    "wine": _wine,
    "near": lambda x: x["name"].rlike("MAIONESE|MAION|ACHOC|AZEITE|OLEO|CAFE|PAPEL ALUM|TRIDENT|SH |COND |CR PENTE|SUSTAGEM|EXTR TOM"),
    "LA ACO": lambda x: _in(x, "LA ACO"),
    "AZEITE": lambda x: _in(x, "AZEITE"),
    "EXTRAVIRGEM": lambda x: _in(x, "EXTRAVIRGEM"),
    "SUAVE": lambda x: _in(x, "SUAVE"),
    "DIA A DIA": lambda x: _in(x, "DIA A DIA"),
    "LEITE": lambda x: _in(x, "LEITE"),
    "skimmed": lambda x: _in(x, *SKIMMED),
    "skimmed or whole": lambda x: _in(x, *SKIMMED, "INTEGRAL"),
    "LIGHT": lambda x: _in(x, "LIGHT"),
    "mayonnaise or sauce": lambda x: _in(x, "MAIONESE", "MAION", "MOLHO"),
    "sachet": lambda x: _has(x, "SACHE", "SACHET"),
    "pot": lambda x: _has(x, "POTE", "COPO", "BALDE", "BISNAGA"),
    "canned": lambda x: _in(x, "MILHO", "ERVILHA", "ATUM", "SARD"),
    "LT": lambda x: _word(x, "LT"),
    "SC": lambda x: _word(x, "SC"),
    "drink": lambda x: _in(x, "SUCO", "REFR", "AGUA", "LEITE"),
    "TP": lambda x: _ends(x, "TP"),
    "VD": lambda x: _ends(x, "VD"),
    "ALCOOL": lambda x: _in(x, "ALCOOL"),
    "GEL": lambda x: _has(x, "GEL"),
    "deodorant": lambda x: _in(x, "DES ", "DESOD ", "DESODORANTE "),
    "F": lambda x: x["name"].rlike(r"\bF\b"),
    "M": lambda x: x["name"].rlike(r"\bM\b"),
    "powder": lambda x: _has(x, "PO") | _in(x, "LAVA ROUPA PO"),
    "liquid": lambda x: _has(x, "LIQ", "LQ") | _in(x, "LAVA ROUPA LIQ", "LAVA ROUPA LQ"),
    "FRAL": lambda x: _in(x, "FRAL"),
    "MILHO": lambda x: _in(x, "MILHO"),
    "ERVILHA": lambda x: _in(x, "ERVILHA"),
    "COCO": lambda x: _in(x, "COCO"),
    "flakes": lambda x: _has(x, "FLOCOS", "FLOCOCO"),
    "COCO RAL": lambda x: _in(x, "COCO RAL"),
    "SEMACUCAR": lambda x: _has(x, "SEMACUCAR"),
    "EXTR TOM": lambda x: _in(x, "EXTR TOM"),
    "KETCHUP": lambda x: _has(x, "KETCHUP"),
    "hot": lambda x: _has(x, "PICANTE", "PIMENTA", "APIMENTADO"),
    "mayonnaise": lambda x: _has(x, "MAIONESE", "MAION"),
    "LIMAO": lambda x: _has(x, "LIMAO"),
    "sauce": lambda x: _has(x, "MOLHO") | _in(x, "MOL TOM"),
    "fish": lambda x: _has(x, "ATUM", "SARD"),
    "fish inside": lambda x: _in(x, "ATUM", "SARD"),
    "QUEROSENE": lambda x: _in(x, "QUEROSENE"),
    "DESINF": lambda x: _in(x, "DESINF"),
    "AMIDO": lambda x: _has(x, "AMIDO"),
    "shampoo": lambda x: _in(x, "SH ", "COND "),
    "kit": lambda x: _in(x, "+COND", "SH COND"),
    "TRIDENT": lambda x: _in(x, "TRIDENT"),
    "POTE": lambda x: _has(x, "POTE"),
}
#: The words of each set, and those of them, among others, that a name holds.
SETS: dict[str, tuple[tuple[str, ...], Callable[[Column], Column]]] = {
    "flags": (tuple(FLAGS), lambda x: F.array_compact(F.array(*[F.when(ask(x), F.lit(name)) for name, ask in FLAGS.items()]))),
    "oil": (("R", "E", "U"), _oil),
    "wine": (WINE_COLOURS, lambda x: _where(_wine(x), x["tokens"])),
    "variants": (VARIANTS[:BITS], lambda x: x["letters"]),
    "more variants": (VARIANTS[BITS : 2 * BITS], lambda x: x["letters"]),
    "last variants": (VARIANTS[2 * BITS :], lambda x: x["letters"]),
    "diaper": (DIAPER_SIZES, lambda x: x["tokens"]),
    "fruit": (FRUITS, lambda x: x["letters"]),
    "flavour": (FLAVOURS, lambda x: x["letters"]),
    "snack": (SNACK_FLAVOURS, lambda x: x["letters"]),
    "fragrance": (FRAGRANCE_NAMES, lambda x: x["fragrances"]),
    "scented": (SCENTED, lambda x: x["safe"]),
    "counted": (COUNTED, lambda x: x["safe"]),
    "cups": (("COPO",), lambda x: x["safe"]),
    "salty": (SALTY, lambda x: x["safe"]),
    "branded": (BRAND_REQUIRED, lambda x: x["safe"]),
    "degrees": (DEGREES, lambda x: F.regexp_extract_all(x["name"], F.lit(r"(?<!\d)(46(?:\.2)?|70|80|92|96)(?!\d)"), F.lit(1))),
    "scents": (ALCOHOL_FRAGRANCES, lambda x: F.array_compact(F.array(*[F.when(_in(x, f), F.lit(f)) for f in ALCOHOL_FRAGRANCES]))),
    "extract package": (("S", "P"), lambda x: _first((_has(x, "SACHE", "SACHET", "POUCH", "SC"), "S"), (_has(x, "POTE", "PT"), "P"))),
    "extract kind": (("C", "A"), lambda x: _first((_has(x, "CARNE") & _has(x, "PANELA"), "C"), (_has(x, "CEB", "CEBOLA") & _has(x, "ALHO"), "A"))),
    "sauce kind": (("B", "Z", "M", "P"), lambda x: _first((_has(x, "BOLONHESA", "BOLONHES"), "B"), (_has(x, "PIZZA"), "Z"), (_has(x, "MANJERICAO"), "M"), (_has(x, "PARMEGIANA", "PARM"), "P"))),
    "fish": (FISH_VARIANTS, lambda x: x["tokens"]),
    "stock": (STOCK_FLAVOURS, lambda x: _where(_stock(x), x["letters"])),
    "razor": (RAZOR_LINES, lambda x: _where(_in(x, "APAR", "BARB"), x["tokens"])),
    "cut": (FISH_CUTS, lambda x: _first(*[(x["name"].rlike(rf"\b{c}\b"), c) for c in FISH_CUTS])),
    "spirit": (SPIRITS, lambda x: x["tokens"]),
}


def _layout() -> tuple[dict[str, tuple[str, int]], int]:
    """The bigint of each set and the place of its first bit; and how many bigints there are."""
    places, free = {}, []
    for name, (words, _) in SETS.items():
        assert len(words) <= BITS, name
        at = next((i for i, n in enumerate(free) if n >= len(words)), len(free))
        free += [BITS] * (at == len(free))
        places[name] = (f"bits_{at}", BITS - free[at])
        free[at] -= len(words)
    return places, len(free)


_PLACES, _MANY = _layout()


def _packed(held: Column, bits: dict[str, int]) -> Column:
    table = lookup(bits, "bigint")
    none = F.lit(0).cast("bigint")
    return F.aggregate(held, none, lambda found, w: found.bitwiseOR(F.coalesce(F.try_element_at(table, w), none)))


def answers(x: Column, without: tuple[str, ...] = ()) -> list[Column]:
    """The bigints of a name; `without`: words that are no variants."""
    parts: dict[str, list[Column]] = {f"bits_{i}": [] for i in range(_MANY)}
    for name, (all_, held) in SETS.items():
        field, first = _PLACES[name]
        bits = {w: 1 << (first + i) for i, w in enumerate(all_) if not (name.endswith("variants") and w in without)}
        if bits:
            parts[field].append(_packed(held(x), bits))
    return [reduce(lambda a, b: a.bitwiseOR(b), cs, F.lit(0).cast("bigint")).alias(field) for field, cs in parts.items()]


def held(x: Column, of: str, *words: str) -> Column:
    """The bits of a set, or of some of its words, in a name's answers."""
    field, first = _PLACES[of]
    all_ = SETS[of][0]
    mask = sum(1 << (first + all_.index(w)) for w in (words or all_))
    return x[field].bitwiseAND(mask)


def yes(x: Column, *flags: str) -> Column:
    """Whether one of the flags holds."""
    return held(x, "flags", *flags) != 0

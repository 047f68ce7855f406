"""Indel ratios of names as column expressions: a longest common subsequence by machine words of bits.

The bits of a name's letters are made once a name (`profiled`); a pair costs one fold over the characters that the names
don't share. `token_set_ratio` and `token_sort_ratio` are the same rules for two Python strings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# ---- the rules, for two strings ----
def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine word of bits a character of a."""
    if not a or not b:
        return 0
    place: dict[str, int] = {}
    for i, c in enumerate(a):
        place[c] = place.get(c, 0) | 1 << i
    every = (1 << len(a)) - 1
    rows = every
    for c in b:
        hit = rows & place.get(c, 0)
        rows = ((rows + hit) | (rows - hit)) & every
    return len(a) - rows.bit_count()


def _ratio(a: str, b: str) -> float:
    """100 * 2 * LCS / (len(a) + len(b)); two empty texts are equal."""
    total = len(a) + len(b)
    return 200.0 * _common(a, b) / total if total else 100.0


def token_sort_ratio(a: str, b: str) -> float:
    """Ratio of the words in order of the alphabet."""
    return _ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among shared words, and those with either side's other words; 100 if one side has no others."""
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    both = " ".join(sorted(left & right))
    only_left, only_right = " ".join(sorted(left - right)), " ".join(sorted(right - left))
    if both and (not only_left or not only_right):
        return 100.0
    with_left, with_right = f"{both} {only_left}".strip(), f"{both} {only_right}".strip()
    best = _ratio(with_left, with_right)
    if both:
        best = max(best, _ratio(both, with_left), _ratio(both, with_right))
    return best


# ---- the same as expressions ----
#: Characters of a name in one bigint: sums of two stay positive.
BITS = 62
_EVERY = (1 << BITS) - 1


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", _long(1), place.cast("int"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _words(name: Column) -> Column:
    return F.filter(F.split(F.coalesce(name, F.lit("")), r"\s+"), lambda w: w != "")


def _letter_bits(text: Column, letters: Column) -> Column:
    """array<array<bigint>>: for each of letters where it stands in text, BITS characters a bigint."""
    chars = F.split(text, "")
    blocks = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / BITS).cast("int") - 1, F.lit(0)))
    bits = lambda part, c: F.aggregate(F.transform(part, lambda x, i: F.when(x == c, _bit(i)).otherwise(_long(0))), _long(0), lambda m, x: m.bitwiseOR(x))
    return F.transform(letters, lambda c: F.transform(blocks, lambda k: bits(F.slice(chars, k * BITS + 1, F.lit(BITS)), c)))


def common(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two texts of any length."""
    blocks = F.greatest(F.ceil(F.length(a) / BITS).cast("int"), F.lit(1))

    def step(rows: Column, bits: Column) -> Column:
        def add(acc: Column, z: Column) -> Column:
            hit = z["x"].bitwiseAND(z["m"])
            total = z["x"] + hit + acc["carry"]
            row = total.bitwiseAND(_long(_EVERY)).bitwiseOR(z["x"] - hit)
            return F.struct(F.shiftright(total, BITS).alias("carry"), F.concat(acc["out"], F.array(row)).alias("out"))

        start = F.struct(_long(0).alias("carry"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(F.arrays_zip(rows.alias("x"), bits.alias("m")), start, add)["out"]

    def fold(held: Column) -> Column:
        at = lambda c: F.array_position(held["letters"], c)
        rows = F.aggregate(F.split(b, ""), F.array_repeat(_long(_EVERY), blocks), lambda r, c: F.when(at(c) > 0, step(r, held["bits"][(at(c) - 1).cast("int")])).otherwise(r))
        return BITS * blocks - F.aggregate(rows, F.lit(0), lambda n, r: n + F.bit_count(r))

    letters = F.array_distinct(F.split(a, ""))
    whole = _let(letters, lambda ls: _let(F.struct(ls.alias("letters"), _letter_bits(a, ls).alias("bits")), fold))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0)).otherwise(whole).cast("int")


def ratio(a: Column, b: Column) -> Column:
    """100 * 2 * LCS / (length + length); two empty texts are equal."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise(200.0 * common(a, b) / total)


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 "
#: Counts of letters in bigints: five bits each, of which the highest stays free for comparing.
_FIELD, _FIELDS, _MOST = 5, 12, 15
PACKS = -(-(len(_LETTERS) + 1) // _FIELDS)
_GUARD = sum(1 << _FIELD * i + _FIELD - 1 for i in range(_FIELDS))
_EVEN = sum(31 << 2 * _FIELD * i for i in range(_FIELDS // 2))


def profiled(df: DataFrame, name: str, p: str) -> DataFrame:
    """df with what the ratios and bounds ask of a name, in columns that begin with p.

    {p}_words: distinct words in order; {p}_text: those as one text; {p}_size: its length; {p}_pack0 and on: counts of
    letters; {p}_wide: a count doesn't fit; {p}_letters, {p}_bits, {p}_spans: places of letters and words if the text
    fits one bigint; {p}_sorted: all words in order.
    """
    col = lambda c: F.col(f"{p}_{c}")
    df = df.withColumns({f"{p}_words": F.array_sort(F.array_distinct(_words(F.col(name)))), f"{p}_sorted": F.array_join(F.array_sort(_words(F.col(name))), " ")})
    df = df.withColumn(f"{p}_text", F.array_join(col("words"), " "))
    count = lambda c: F.length(col("text")) - F.length(F.replace(col("text"), F.lit(c), F.lit("")))
    other = F.length(F.regexp_replace(col("text"), f"[{_LETTERS}]", ""))
    df = df.withColumns({f"{p}_size": F.length(col("text")), f"{p}_counts": F.array(*[count(c) for c in _LETTERS], other)})
    pack = lambda k: sum((F.least(col("counts")[i], F.lit(_MOST)).cast("bigint") * (1 << _FIELD * (i - k * _FIELDS)) for i in range(k * _FIELDS, min((k + 1) * _FIELDS, len(_LETTERS) + 1))), _long(0))
    # names of up to BITS of _LETTERS alone: words with their letters' numbers, a blank before each, and the places they take
    fits = (col("size") <= BITS) & (col("counts")[len(_LETTERS)] == 0)
    numbers = lambda text: F.transform(F.split(text, ""), lambda c: F.position(c, F.lit(_LETTERS)) - 1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<word:string,codes:array<int>,places:bigint,gap:bigint>>").alias("out"))
    places = lambda a, w: (_bit(F.length(w)) - 1) * _bit(a["at"])
    gap = lambda a: F.when(a["at"] > 0, _bit(a["at"] - 1)).otherwise(_long(0))
    span = lambda a, w: F.struct(w.alias("word"), numbers(F.concat(F.lit(" "), w)).alias("codes"), places(a, w).bitwiseOR(gap(a)).alias("places"), gap(a).alias("gap"))
    spans = F.aggregate(col("words"), start, lambda a, w: F.struct((a["at"] + F.length(w) + 1).alias("at"), F.concat(a["out"], F.array(span(a, w))).alias("out")))["out"]
    every = F.array(*[F.lit(c) for c in _LETTERS])
    df = df.withColumns({**{f"{p}_pack{k}": pack(k) for k in range(PACKS)}, f"{p}_wide": F.array_max(col("counts")) > _MOST, f"{p}_spans": F.when(fits, spans)})
    bits = F.transform(_letter_bits(col("text"), every), lambda x: x[0])
    codes = lambda c: F.when(fits & (F.length(col(c)) > 0), numbers(col(c)))
    return df.withColumns({f"{p}_bits": F.when(fits, bits), f"{p}_codes": codes("text"), f"{p}_all": codes("sorted")}).drop(f"{p}_counts")


def _within(bits: Column, keep: Column, codes: Column) -> Column:
    """Longest common subsequence of the letters `codes` and those of `bits` at the places of keep."""

    def step(rows: Column, c: Column) -> Column:
        hit = rows.bitwiseAND(bits[c]).bitwiseAND(keep)
        return (rows + hit).bitwiseOR(rows - hit).bitwiseAND(_long(_EVERY))

    return F.lit(BITS) - F.bit_count(F.aggregate(codes, _long(_EVERY), step))


def set_ratio(a: str, b: str) -> Column:
    """token_set_ratio of the names that are profiled as a and b."""
    wa, wb = F.col(f"{a}_words"), F.col(f"{b}_words")
    size_a, size_b, bits = F.col(f"{a}_size"), F.col(f"{b}_size"), F.col(f"{b}_bits")
    fit = F.col(f"{a}_codes").isNotNull() & F.col(f"{b}_codes").isNotNull()
    strangers = 200.0 * F.when(fit, _within(bits, _long(_EVERY), F.col(f"{a}_codes"))).otherwise(common(F.col(f"{b}_text"), F.col(f"{a}_text"))) / (size_a + size_b)

    def apart(rest_a: Column, rest_b: Column) -> Column:
        """Of what only a has with what only b has."""
        codes = F.flatten(F.transform(F.filter(F.col(f"{a}_spans"), lambda s: F.array_contains(rest_a, s["word"])), lambda s: s["codes"]))
        places = F.filter(F.col(f"{b}_spans"), lambda s: F.array_contains(rest_b, s["word"]))
        keep = _let(places, lambda s: F.aggregate(s, _long(0), lambda m, x: m.bitwiseOR(x["places"])) - s[0]["gap"])
        quick = _let(keep, lambda k: _within(bits, k, F.slice(codes, 2, BITS)))
        return F.when(fit, quick).otherwise(common(F.array_join(rest_b, " "), F.array_join(rest_a, " ")))

    def related(rest: Column) -> Column:
        # the shared words stand first on both sides, so they are common to the end
        both = F.length(F.array_join(F.array_intersect(wa, wb), " "))
        best = lambda n: F.greatest(200.0 * (n + 1 + apart(rest["a"], rest["b"])) / (size_a + size_b), 200.0 * n / (n + F.least(size_a, size_b)))
        return F.when((F.size(rest["a"]) == 0) | (F.size(rest["b"]) == 0), F.lit(100.0)).otherwise(_let(both, best))

    rest = F.struct(F.array_except(wa, wb).alias("a"), F.array_except(wb, wa).alias("b"))
    return F.when((size_a == 0) | (size_b == 0), F.lit(0.0)).when(F.arrays_overlap(wa, wb), _let(rest, related)).otherwise(strangers)


def sort_ratio(a: str, b: str) -> Column:
    """token_sort_ratio of the names that are profiled as a and b."""
    sa, sb = F.col(f"{a}_sorted"), F.col(f"{b}_sorted")
    fit = F.col(f"{a}_all").isNotNull() & F.col(f"{b}_codes").isNotNull() & (sb == F.col(f"{b}_text"))
    whole = F.when(fit, _within(F.col(f"{b}_bits"), _long(_EVERY), F.col(f"{a}_all"))).otherwise(common(sb, sa))
    total = F.length(sa) + F.length(sb)
    return F.when(total == 0, F.lit(100.0)).otherwise(200.0 * whole / total)


def may_reach(a: str, b: str, least: Column | float) -> Column:
    """False only for pairs whose words, compared as wholes, have a ratio below `least`.

    No common subsequence is longer than the letters that both have. All counts of a bigint are compared at once. Names with
    one side's words within the other's, or long shared words, can have a higher set ratio for those words alone.
    """
    guard, low, even = _long(_GUARD), _long(_GUARD // 16 * 15), _long(_EVEN)

    def least_of(k: int) -> Column:
        x, y = F.col(f"{a}_pack{k}"), F.col(f"{b}_pack{k}")
        over = (x.bitwiseOR(guard) - y).bitwiseAND(guard)
        of_y = over - F.shiftright(over, _FIELD - 1)
        lesser = y.bitwiseAND(of_y).bitwiseOR(x.bitwiseAND(low - of_y))
        return lesser.bitwiseAND(even) + F.shiftright(lesser, _FIELD).bitwiseAND(even)

    total = sum((least_of(k) for k in range(1, PACKS)), least_of(0)) % 1023
    return F.col(f"{a}_wide") | F.col(f"{b}_wide") | (total * 200.0 >= (F.col(f"{a}_size") + F.col(f"{b}_size")) * (F.lit(least) if isinstance(least, float) else least))

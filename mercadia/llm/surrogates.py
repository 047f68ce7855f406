"""PII: detected entities receive keyed surrogates of their own type, gender, script and format.

Native: only DataFrame functions. One pattern finds the entities of a text; splitting the text by it gives
what lies between them. A surrogate is drawn from an HMAC, under a secret key, of the entity's canonical form,
so that the same entity has the same surrogate in every document and however it is written:

* email: letters and digits of the local part are replaced one by one, case, script and marks kept; the host
  becomes letters under the same last label;
* phone: international numbers of 8 to 15 digits and national ones with an area code in brackets or in the
  layout 3-3-4; country code, a trunk 0 and layout are kept, the national number is replaced;
* ip: four octets, or the hexadecimal digits of an IPv6 address, layout kept; forms of one IPv6 address that
  are shortened differently count as different;
* card: digits are replaced, separators kept; the last one makes the check digit valid, as it was;
* name: found by its evidence: a title; or a known given name before a capitalised word; or a cue such as
  "name:" or "Dear" before two capitalised words. The last word is the family name, those before it are given
  names, and each has a surrogate of its own, so that "Ms Meier" and "Anna Meier" stay one family. A given
  name's gender is that of the name lists, else that of the title, else that of its ending.

Collision checks: the distinct entities of all texts are compared by surrogate. Of several with one
surrogate all but the first draw again, and so do those whose surrogate is itself an entity of the texts,
until every surrogate belongs to one entity. Names and emails grow longer as they draw again, so that there is
always room. Only those that drew again are joined with the documents.

Whoever has the key can test a guess at an entity, so the key is a parameter without a default.

Numbers of card length that fail the check digit, and dotted numbers with an octet over 255, stay.
Edge cases: null texts stay null; empty texts stay empty; repeated rows give equal rows; a null doc_id is
kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercadia.llm._common import checked_broadcast, let, row_key, stored

#: Given names by script and gender, and syllables of family names by script.
GIVEN = {
    "latin": {"m": "Adam Bruno Carlo David Emil Felix Georg Hugo Ivan Jonas Karl Leon Marco Niels Oscar Paul".split(), "f": "Anna Berta Clara Diana Emma Flora Greta Helga Irene Julia Karin Laura Maria Nina Olga Paula".split()},
    "cyrillic": {"m": "Антон Борис Виктор Глеб Денис Егор Захар Иван Кирилл Лев Марк Никита Олег Павел Роман Семён".split(), "f": "Анна Белла Вера Галина Дарья Ева Зоя Ирина Клара Лидия Мария Нина Ольга Полина Рита Софья".split()},
    "greek": {"m": "Άρης Βασίλης Γιώργος Δήμος Ηλίας Θάνος Ιάσων Κώστας Λάμπρος Μάνος Νίκος Ορέστης Πέτρος Σπύρος Τάσος Φώτης".split(), "f": "Άννα Βάσω Γεωργία Δάφνη Ελένη Ζωή Ηρώ Θάλεια Ιωάννα Κλειώ Λένα Μαρία Νίκη Ξένια Όλγα Σοφία".split()},
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ka ke la le lo ma me mi na ne no pa pe ra re ro sa se ta te to va".split(),
    "cyrillic": "ба бе бо да де до фа фе га го ка ке ла ле ло ма ме ми на не но па пе ра ре ро са се та те то ва".split(),
    "greek": "βα βε βο δα δε δο φα φε γα γο κα κε λα λε λο μα με μι να νε νο πα πε ρα ρε ρο σα σε τα τε το ζα".split(),
}
#: Lower and upper case letters that replace those of a script, by the script's name in patterns.
ALPHABETS = {
    "IsCyrillic": ("".join(map(chr, range(0x430, 0x450))), "".join(map(chr, range(0x410, 0x430)))),
    "IsGreek": ("".join(chr(c) for c in range(0x3B1, 0x3CA) if c != 0x3C2), "".join(chr(c) for c in range(0x391, 0x3AA) if c != 0x3A2)),
    "IsArmenian": ("".join(map(chr, range(0x561, 0x587))), "".join(map(chr, range(0x531, 0x557)))),
    **{
        script: ("".join(map(chr, range(first, last))),) * 2
        for script, first, last in (
            ("IsHebrew", 0x5D0, 0x5EB),
            ("IsArabic", 0x628, 0x63B),
            ("IsDevanagari", 0x915, 0x93A),
            ("IsHiragana", 0x304B, 0x3080),
            ("IsKatakana", 0x30AB, 0x30E0),
            ("IsHangul", 0xAC00, 0xAD00),
            ("IsHan", 0x4E00, 0x4F00),
        )
    },
}

#: Rounds that find each other's surrogates before a word or email grows by a part.
ROOM = 4
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}"
IP = r"(?<![\d.])(?=\d)(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)"
_HEX = "[0-9A-Fa-f]{1,4}"
IP6 = rf"(?<![\p{{L}}\p{{N}}:.])(?=[0-9A-Fa-f:]*\d)(?:(?:{_HEX}:){{7}}{_HEX}|{_HEX}(?::{_HEX}){{0,5}}::(?:{_HEX}(?::{_HEX}){{0,5}})?|::{_HEX}(?::{_HEX}){{1,6}})(?![\p{{L}}\p{{N}}:])"
CARD = r"(?<![\p{L}\p{N}])(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7})(?![\p{L}\p{N}])"
#: Country codes of one and two digits (fixed values); all others have three.
COUNTRY = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}"
_WORLD = rf"\+(?=(?:[ .()-]{{0,2}}\d){{8,15}}(?![ .()-]{{0,2}}\d))(?:{COUNTRY})(?:[ .()-]{{0,2}}\d)+"
_NATION = r"(?:\(0?\d{2,4}\)[ .-]?\d{3,5}[ .-]?\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})"
PHONE = rf"(?<![\p{{L}}\p{{N}}])(?:{_WORLD}|{_NATION})(?![\p{{L}}\p{{N}}])"
MALE, FEMALE = ("Mr", "Herr", "Sr", "Señor", "Monsieur", "Г-н", "Κύριος"), ("Mrs", "Ms", "Miss", "Frau", "Sra", "Señora", "Mme", "Madame", "Г-жа", "Κυρία")
NEUTRAL = ("Dr", "Prof")
CUES = ("name", "contact", "signed", "author", "dear", "nome", "nombre", "nom", "имя")
TITLE = rf"(?:{'|'.join((*MALE, *FEMALE, *NEUTRAL))})\.? "
_WORD = r"\p{Lu}\p{Ll}+(?:['’-]\p{Lu}?\p{Ll}+)*"
_GIVEN = "|".join(dict.fromkeys(n for by in GIVEN.values() for names in by.values() for n in names))
NAME = rf"(?<![\p{{L}}\p{{N}}])(?=\p{{Lu}})(?:{TITLE}{_WORD}(?: {_WORD}){{0,2}}|(?:{_GIVEN})(?: {_WORD}){{1,2}}|(?<=(?i:{'|'.join(CUES)})[:,]? ){_WORD} {_WORD})(?![\p{{L}}\p{{N}}])"
ENTITY = "|".join((EMAIL, IP, IP6, CARD, PHONE, NAME))
#: Kinds of entities, and the column that counts each; a name is counted by its last word.
KINDS = {"email": "n_email", "ip": "n_ip", "ip6": "n_ip", "card": "n_card", "phone": "n_phone", "family": "n_name"}


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _digit(s: Column, i: Column) -> Column:
    return F.substring(s, i, F.lit(1)).cast("int")


def _luhn(digits: Column, shift: int) -> Column:
    """Sum of the digits, every second doubled; shift 0 if the check digit is among them, 1 if it is to follow."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = _digit(digits, i)
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when((n - i + shift) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def parts(before: Column, m: Column) -> Column:
    """array<struct<before, m, kind, sex>>: the entities of one match of ENTITY, and what stands before each.

    A name has one of each of its words; kind is null for what stays: titles, and numbers that are no entity.
    """
    long = F.length(_digits(m)) >= 13
    kind = F.when(m.contains("@"), "email").when(m.contains(":"), "ip6").when(m.rlike(rf"^{IP}$"), "ip").when(m.rlike(r"^\d") & long, F.when(_luhn(_digits(m), 0) % 10 == 0, "card")).otherwise("phone")
    of = lambda b, text, kind, sex: F.struct(b.alias("before"), text.alias("m"), kind.alias("kind"), sex.alias("sex"))
    none = F.lit(None).cast("string")
    title = F.regexp_extract(m, f"^{TITLE}", 0)
    words = F.split(F.regexp_replace(m, f"^{TITLE}", ""), " ")
    sex = F.when(title.rlike(rf"^(?:{'|'.join(FEMALE)})\b|^(?:Г-жа|Κυρία)"), "f").when(title.rlike(rf"^(?:{'|'.join(MALE)})\b|^(?:Г-н|Κύριος)"), "m")
    named = F.transform(
        words,
        lambda w, i: of(
            F.when(i > 0, " ").otherwise(F.concat(before, title)),
            w,
            F.when(i == F.size(words) - 1, "family").otherwise("given"),
            F.when(i < F.size(words) - 1, F.when(w.isin(_known("f")), "f").when(w.isin(_known("m")), "m").otherwise(F.coalesce(sex, F.when(w.rlike("[aаяαη]$"), "f").otherwise("m")))),
        ),
    )
    return F.when(m.rlike(r"^\p{Lu}") & ~m.rlike("[@:0-9]"), named).otherwise(F.array(of(before, m, kind, none)))


def _known(sex: str) -> list[str]:
    return [n for by in GIVEN.values() for n in by[sex]]


def canonical(m: Column, kind: Column, sex: Column) -> Column:
    """What two spellings of one entity share."""
    return (
        F.when(kind == "phone", F.regexp_replace(_digits(F.regexp_replace(m, rf"^\+(?:{COUNTRY})", "")), "^0", ""))
        .when(kind == "card", _digits(m))
        .when(kind == "given", F.concat_ws(" ", sex, F.lower(m)))
        .otherwise(F.lower(m))
    )


def with_pads(df: DataFrame, key: str) -> DataFrame:
    """df with the two padded keys of an HMAC in every row, from a table of one row.

    They are data and not part of an expression, so that no plan, and no log of plans, shows them.
    """
    secret = key.encode("utf-8")
    if len(secret) > 64:
        secret = hashlib.sha256(secret).digest()
    pads = [bytearray(b ^ pad for b in secret.ljust(64, b"\0")) for pad in (0x36, 0x5C)]
    return df.crossJoin(F.broadcast(df.sparkSession.createDataFrame([tuple(pads)], "pad_inner binary, pad_outer binary")))


def _stream(kind: Column, form: Column, attempt: Column) -> Column:
    """128 hexadecimal digits for an entity's attempt: two HMACs by SHA-256, of a row that has the pads."""
    inner, outer = F.col("pad_inner"), F.col("pad_outer")
    mac = lambda text: F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(text, "UTF-8")), 256))), 256)
    seed = F.concat_ws("|", kind, attempt.cast("string"), form)
    return F.concat(mac(F.concat(F.lit("1|"), seed)), mac(F.concat(F.lit("2|"), seed)))


def _byte(stream: Column, i: Column | int) -> Column:
    """The i-th number from 0 to 255 of a stream, from 0."""
    at = (F.lit(i) if isinstance(i, int) else i) % 64 * 2 + 1
    return F.conv(F.substring(stream, at, F.lit(2)), 16, 10).cast("int")


def _pick(words: list[str], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), number % len(words) + 1)


def _spelt(s: Column, stream: Column) -> Column:
    """s with each digit and letter replaced from the stream; case and script kept."""
    pick = lambda letters, b: F.substring(F.lit(letters), b % len(letters) + 1, F.lit(1))

    def one(c: Column, i: Column) -> Column:
        b = _byte(stream, i)
        low, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        foreign = F.lit(None).cast("string")
        for script, (small, large) in ALPHABETS.items():
            foreign = F.coalesce(foreign, F.when(c.rlike(rf"\p{{{script}}}"), F.when(c.rlike(r"\p{Lu}"), pick(large, b)).otherwise(pick(small, b))))
        return (
            F.when(c.rlike("[0-9]"), (b % 10).cast("string"))
            .when(c.rlike(r"[^\x00-\x7F]") & c.rlike(r"\p{L}") & foreign.isNotNull(), foreign)
            .when(c.rlike(r"\p{Lu}"), pick(up, b))
            .when(c.rlike(r"\p{L}"), pick(low, b))
            .when(c.rlike(r"\p{N}"), (b % 10).cast("string"))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(s, ""), one), "")


def _laid(m: Column, digits: Column) -> Column:
    """m with its last digits taken from `digits`, by their place from the right."""

    def one(c: Column, i: Column) -> Column:
        right = F.length(_digits(F.substring(m, i + 1, F.length(m))))
        return F.when(c.rlike("[0-9]") & (right <= F.length(digits)), F.substring(digits, F.length(digits) - right + 1, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(m, ""), one), "")


def _coined(e: Column, script: str) -> Column:
    """A family name, or a given name that is in no list: syllables, more of them the more often it drew."""
    more = F.floor(e["attempt"] / ROOM).cast("int")
    part = lambda shift, least: F.initcap(F.array_join(F.transform(F.sequence(F.lit(1), least + more), lambda i: _pick(SYLLABLES[script], _byte(e["stream"], i + shift))), ""))
    double = F.when((e["kind"] == "family") & e["m"].contains("-"), F.concat(F.lit("-"), part(20, 2))).otherwise("")
    end = {"latin": ("n", "na"), "cyrillic": ("н", "на"), "greek": ("ς", "να")}[script]
    return F.concat(part(0, 3), double, F.when(e["kind"] == "given", F.when(e["sex"] == "f", end[1]).otherwise(end[0])).otherwise(""))


def _name(e: Column) -> Column:
    out = F.lit(None).cast("string")
    for script, sign in (("greek", r"\p{IsGreek}"), ("cyrillic", r"\p{IsCyrillic}"), ("latin", r"\p{IsLatin}")):
        listed = F.when(e["sex"] == "f", _pick(GIVEN[script]["f"], _byte(e["stream"], 0))).otherwise(_pick(GIVEN[script]["m"], _byte(e["stream"], 0)))
        out = F.coalesce(out, F.when(e["m"].rlike(sign), F.when((e["kind"] == "given") & (e["attempt"] == 0), listed).otherwise(_coined(e, script))))
    return F.coalesce(out, _spelt(e["m"], e["stream"]))


def drawn(items: Column, attempt: Callable[[Column, Column], Column]) -> Column:
    """array<struct<before, m, kind, form, new>>: the surrogates of an array of parts; new is m where kind is null.

    attempt: a function of kind and form. The steps are transforms of their own, so that each is worked out
    once an entity: an expression that a lambda repeats would be worked out for every character.
    """
    held = ["before", "m", "kind", "sex"]
    step = lambda a, **new: F.transform(a, lambda e: F.struct(*[e[c].alias(c) for c in held], *[f(e).alias(c) for c, f in new.items()]))
    out = items
    for new in (
        {"form": lambda e: canonical(e["m"], e["kind"], e["sex"])},
        {"attempt": lambda e: F.when(e["kind"].isNotNull(), attempt(e["kind"], e["form"]))},
        {"stream": lambda e: F.when(e["kind"].isNotNull(), _stream(e["kind"], e["form"], e["attempt"]))},
        {"numbers": lambda e: F.when(e["kind"].isin("card", "phone"), F.concat((_byte(e["stream"], 19) % 9 + 1).cast("string"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(18)), lambda i: (_byte(e["stream"], i) % 10).cast("string")), "")))},
        {"body": lambda e: F.substring(e["numbers"], F.lit(1), F.length(e["form"]) - F.when(e["kind"] == "card", 1).otherwise(0))},
        {"digits": lambda e: F.when(e["kind"] == "card", F.concat(e["body"], ((10 - _luhn(e["body"], 1) % 10) % 10).cast("string"))).otherwise(e["body"])},
    ):
        out = step(out, **new)
        held += new

    def new(e: Column) -> Column:
        m, stream = e["m"], e["stream"]
        local, host = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
        longer = F.substring(F.translate(stream, "0123456789", "ghijklmnop"), F.lit(100), F.floor(e["attempt"] / ROOM).cast("int"))
        email = F.concat(_spelt(local, stream), longer, F.lit("@"), _spelt(F.substring_index(host, ".", 1), F.reverse(stream)), F.lit(".example."), F.substring_index(host, ".", -1))
        ip = F.concat_ws(".", *[(_byte(stream, i) % (223 if i == 0 else 256) + (1 if i == 0 else 0)).cast("string") for i in range(4)])
        digit = lambda c, i: F.when(c.rlike("[A-F]"), F.upper(F.substring(stream, i + 1, F.lit(1)))).when(c == ":", c).otherwise(F.substring(stream, i + 1, F.lit(1)))
        ip6 = F.array_join(F.transform(F.split(m, ""), digit), "")
        return F.when(e["kind"].isNull(), m).when(e["kind"] == "email", email).when(e["kind"] == "ip", ip).when(e["kind"] == "ip6", ip6).when(e["kind"].isin("given", "family"), _name(e)).otherwise(_laid(m, e["digits"]))

    return F.transform(out, lambda e: F.struct(*[e[c].alias(c) for c in ("before", "m", "kind", "sex", "form")], new(e).alias("new")))


def entities(docs: DataFrame) -> DataFrame:
    """(row_key, kind, sex, form, example): the entities of each text of docs (doc_id, text)."""
    text = F.col("text")
    matches = F.array_distinct(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)))
    found = docs.where(text.rlike(ENTITY)).select(row_key(F.col("doc_id"), text).alias("row_key"), F.explode(F.flatten(F.transform(matches, lambda m: parts(F.lit(""), m)))).alias("e")).where("e.kind is not null")
    return found.select("row_key", "e.kind", "e.sex", canonical(F.col("e.m"), F.col("e.kind"), F.col("e.sex")).alias("form"), F.col("e.m").alias("example")).distinct()


def redrawn(found: DataFrame, key: str) -> DataFrame:
    """(kind, form, attempt) of the entities whose first surrogate is another's, or is itself an entity."""
    known = stored(found.groupBy("kind", "form").agg(F.min("example").alias("example"), F.min("sex").alias("sex")), "forms")
    tried = known.withColumn("attempt", F.lit(0))
    while True:
        item = F.struct(F.lit("").alias("before"), F.col("example").alias("m"), "kind", "sex")
        tried = with_pads(tried, key).withColumn("one", drawn(F.array(item), lambda kind, form: F.col("attempt"))[0])
        tried = stored(tried.select("kind", "form", "example", "sex", "attempt", canonical(F.col("one.new"), F.col("kind"), F.col("sex")).alias("new")), "drawn")
        # of those that share a surrogate the one that drew most often, then the first, keeps it
        shared = tried.groupBy("kind", "new").agg(F.count(F.lit(1)).alias("n"), F.max_by("form", F.struct("attempt", F.expr("-xxhash64(form)"), "form")).alias("keeper")).where("n > 1")
        taken = tried.join(known.select("kind", F.col("form").alias("new")), ["kind", "new"], "left_semi").select("kind", "form")
        losers = tried.join(shared, ["kind", "new"]).where("form <> keeper").select("kind", "form").unionByName(taken).distinct()
        losers = stored(losers.withColumn("again", F.lit(1)), "losers")
        if not losers.limit(1).count():
            return tried.where("attempt > 0").select("kind", "form", "attempt")
        tried = tried.join(losers, ["kind", "form"], "left").select("kind", "form", "example", "sex", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt"))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """One row per row of docs: doc_id, text with surrogates under a secret key, and how many entities of each kind it had."""
    if not key:
        raise ValueError("surrogates need a secret key")
    found = stored(entities(docs), "entities")
    again = found.join(redrawn(found, key), ["kind", "form"]).groupBy("row_key").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws(":", "kind", "form"), "attempt"))).alias("attempts"))
    slim = docs.select("doc_id", "text", row_key(F.col("doc_id"), F.col("text")).alias("row_key"))
    joined = with_pads(slim, key).join(checked_broadcast(stored(again.select("row_key", F.map_entries("attempts").alias("attempts")), "redrawn")), "row_key", "left")

    def attempt(kind: Column, form: Column) -> Column:
        drew = F.filter("attempts", lambda e: e["key"] == F.concat_ws(":", kind, form))
        return F.when(F.col("attempts").isNull(), F.lit(0)).otherwise(F.coalesce(F.get(drew, F.lit(0))["value"], F.lit(0)))

    text = F.col("text")

    def items(e: Column) -> Column:
        """The parts of all matches; the last one holds what follows them."""
        tail = F.struct(F.element_at(e["pieces"], -1).alias("before"), F.lit("").alias("m"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("sex"))
        return F.concat(F.flatten(F.zip_with(F.slice(e["pieces"], F.lit(1), F.size(e["matches"])), e["matches"], parts)), F.array(tail))

    matched = F.struct(F.split(text, ENTITY, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)).alias("matches"))
    new = F.when(text.rlike(ENTITY), drawn(let(matched, items), attempt))
    done = joined.select("doc_id", "text", new.alias("new"))
    out = F.when(F.col("new").isNull(), text).otherwise(F.array_join(F.transform("new", lambda n: F.concat(n["before"], n["new"])), ""))
    number = lambda column: F.coalesce(F.size(F.filter("new", lambda n: n["kind"].isin([k for k, c in KINDS.items() if c == column]))), F.lit(0))
    return done.select("doc_id", out.alias("text"), *[F.greatest(number(c), F.lit(0)).cast("long").alias(c) for c in dict.fromkeys(KINDS.values())])

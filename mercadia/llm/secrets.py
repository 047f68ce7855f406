"""Secret scans: base patterns, and multipart credential linking by an interval join of weak parts.

Native: only DataFrame functions. Positions come from splitting a text by a pattern: the pieces between
the matches and the matches themselves give every start. Weak parts (opaque tokens, account names,
endpoints) mean nothing alone. They are exploded, dealt to buckets of one scope's width, and joined with
the complementary parts of the same document that start within the scope.

Edge cases: a null text counts as empty and gives one row without spans; repeated rows give equal rows; a
null doc_id is kept; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercadia.llm._common import before, let, row_key, stored

#: Kinds in the order in which ties of start are listed.
KINDS = ["assign", "access", "hex", "secret", "identifier", "endpoint"]
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Weak parts. An opaque token of 32 to 64 characters must mix lower case, upper case and digits.
OPAQUE = r"(?<![A-Za-z0-9+/])(?=[A-Za-z0-9+/]{0,63}[a-z])(?=[A-Za-z0-9+/]{0,63}[A-Z])(?=[A-Za-z0-9+/]{0,63}[0-9])[A-Za-z0-9+/]{32,64}(?![A-Za-z0-9+/])"
IDENTIFIER = r"""(?<![A-Za-z])(?i:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}"""
ENDPOINT = r"""https?://[A-Za-z0-9.-]+(?::[0-9]+)?[A-Za-z0-9._~/?&=%-]*"""
#: Complementary parts must start at most this many code points apart.
SCOPE = 200
#: Characters of the pieces that a text is cut into before spans are taken from it.
PIECE = 4096

_SPAN = "array<struct<start:bigint,k:int,end:bigint>>"


def _spans(text: Column, pattern: str, kind: str, group: int = 0, least: int = 0) -> Column:
    """Spans of the matches whose group has at least `least` characters; code points, end exclusive."""
    lengths = lambda texts: F.transform(texts, lambda t: F.length(t).cast("bigint"))
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    gaps = F.split(text, pattern, -1)

    def placed(found: Column) -> Column:
        m, g, gap = (found[c] for c in ("m", "g", "gap"))
        starts = before(F.zip_with(gap, m, lambda a, b: a + F.coalesce(b, F.lit(0))), lambda a, b: a + b)
        spans = F.zip_with(F.zip_with(m, g, lambda a, b: F.struct(a.alias("m"), b.alias("g"))), F.zip_with(gap, starts, lambda a, b: a + b), lambda x, s: F.struct(s.alias("start"), F.lit(KINDS.index(kind)).alias("k"), (s + x["m"]).alias("end"), x["g"].alias("g")))
        return F.transform(F.filter(spans, lambda s: s["g"] >= least), lambda s: F.struct(s["start"], s["k"], s["end"]))

    found = let(F.struct(lengths(matches).alias("m"), lengths(groups).alias("g"), lengths(gaps).alias("gap")), placed)
    return F.when(text.rlike(pattern), found.cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["k"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per row of docs (doc_id, text): row_key, base and added spans, each sorted by start and kind."""
    text = F.coalesce("text", F.lit(""))
    slim = docs.select("doc_id", text.alias("text"), row_key(F.col("doc_id"), F.col("text")).alias("row_key"))
    has = lambda s: F.col("text").contains(s)
    none = F.array().cast(_SPAN)
    found = stored(
        slim.select(
            "doc_id",
            "row_key",
            F.array_sort(F.concat(_spans(F.col("text"), ASSIGN, "assign", 1, 6), F.when(has("AKIA"), _spans(F.col("text"), ACCESS, "access")).otherwise(none), _spans(F.col("text"), HEX, "hex"))).alias("base"),
            F.concat(
                _spans(F.col("text"), OPAQUE, "secret"),
                F.when(F.col("text").rlike("[:=]"), _spans(F.col("text"), IDENTIFIER, "identifier")).otherwise(none),
                F.when(has("://"), _spans(F.col("text"), ENDPOINT, "endpoint")).otherwise(none),
            ).alias("weak"),
        ),
        "secrets",
    )
    k = {name: i for i, name in enumerate(KINDS)}
    # What a part can complement: base access ids serve as identifiers, assignments as secrets.
    parts = (
        found.where(F.size("weak") > 0)
        .dropDuplicates(["row_key"])
        .select("row_key", F.explode(F.concat("base", "weak")).alias("s"))
        .where(F.col("s.k") != k["hex"])
        .select(
            "row_key",
            "s.*",
            F.when(F.col("s.k").isin(k["assign"], k["secret"]), "secret").when(F.col("s.k").isin(k["access"], k["identifier"]), "identifier").otherwise("endpoint").alias("role"),
        )
        .withColumn("bucket", F.floor(F.col("start") / scope))
    )
    other = parts.select("row_key", F.col("start").alias("o_start"), F.col("role").alias("o_role"), F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    linked = (
        parts.where(F.col("k") >= k["secret"])
        .join(other, ["row_key", "bucket"])
        .where((F.abs(F.col("start") - F.col("o_start")) <= scope) & (F.col("role") != F.col("o_role")))
        .groupBy("row_key", "start", "k", "end")
        .agg(F.max((F.col("o_role") == "secret").cast("int")).alias("s"), F.max((F.col("o_role") == "identifier").cast("int")).alias("i"), F.max((F.col("o_role") == "endpoint").cast("int")).alias("e"))
        # a token needs an account or an endpoint, an account needs a secret, an endpoint needs both
        .where(F.when(F.col("k") == k["secret"], (F.col("i") == 1) | (F.col("e") == 1)).when(F.col("k") == k["identifier"], F.col("s") == 1).otherwise((F.col("s") == 1) & (F.col("i") == 1)))
        .groupBy("row_key")
        .agg(F.array_sort(F.collect_list(F.struct("start", "k", "end"))).alias("added"))
    )
    return found.select("doc_id", "row_key", "base").join(linked, "row_key", "left").select("doc_id", "row_key", "base", F.coalesce("added", none).alias("added"))


def secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The digest columns of the scan, one row per document."""
    n = lambda kind: F.size(F.filter("base", lambda s: s["k"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return scan(docs, scope).select(
        "doc_id",
        n("assign"),
        n("access"),
        n("hex"),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_linked"),
    )


def _cut(text: Column, spans: Column, mark: str) -> Column:
    """text with each run of overlapping spans, sorted by start, replaced by mark.

    Text is taken from pieces of PIECE characters, as reaching a place in a string means reading what is before it.
    """

    def between(pieces: Column, a: Column, b: Column) -> Column:
        at = lambda p, x: F.greatest(F.lit(0), F.least(F.lit(PIECE), x - p * PIECE)).cast("int")
        some = F.sequence(F.floor(a / PIECE), F.floor((b - 1) / PIECE))
        return F.when(b > a, F.array_join(F.transform(some, lambda p: F.substring(F.element_at(pieces, (p + 1).cast("int")), at(p, a) + 1, at(p, b) - at(p, a))), "")).otherwise("")

    def done(e: Column) -> Column:
        pieces, spans, covered = e["pieces"], e["spans"], e["covered"]
        fresh = F.filter(F.zip_with(spans, F.slice(covered, F.lit(1), F.size(spans)), lambda s, c: F.struct(c.alias("a"), s["start"].alias("b"))), lambda g: g["b"] >= g["a"])
        return F.concat(F.array_join(F.transform(fresh, lambda g: F.concat(between(pieces, g["a"], g["b"]), F.lit(mark))), ""), between(pieces, F.element_at(covered, -1), e["n"]))

    covered = before(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return let(F.struct(pieces.alias("pieces"), spans.alias("spans"), covered.alias("covered"), F.length(text).cast("bigint").alias("n")), done)


def redact(docs: DataFrame, scope: int = SCOPE, mark: str = "[SECRET]") -> DataFrame:
    """docs with every found span replaced in text, and n_chars, where there is one, set anew."""
    spans = scan(docs, scope).select("row_key", F.array_sort(F.concat("base", "added")).alias("__m_spans")).where(F.size("__m_spans") > 0).dropDuplicates(["row_key"])
    keyed = docs.withColumn("__m_key", row_key(F.col("doc_id"), F.col("text")))
    joined = keyed.join(spans.withColumnRenamed("row_key", "__m_key"), "__m_key", "left")
    found = F.col("__m_spans").isNotNull()
    done = joined.withColumn("__m_text", F.when(found, _cut(F.col("text"), F.col("__m_spans"), mark)).otherwise(F.col("text")))
    keep = [F.col("__m_text").alias("text") if c == "text" else F.when(found, F.length("__m_text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns]
    return done.select(*keep)

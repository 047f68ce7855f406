"""Alignment of two tokenizers over the same bytes, in relations.

Tokens of both tokenizers are exploded with their positions; a window sums their lengths to the bytes at which they end; an
equi-join on text and end finds where both end, the cuts; a running count of cuts is a token's group; a join on
group, restricted to overlapping byte ranges, gives the links. Counts of (A id, B id) pairs over the corpus come from the
links.

What is aligned is a distinct unit, once for all its occurrences. A unit is a stretch of text that both tokenizers
cut off from what surrounds it, whatever that is: it begins with a blank or line feed that stands alone between characters that
are no white space, and reaches to the next such. Tokenizer A splits there by its pattern, and no piece of B reaches over
(`Pair.check` looks through the vocabulary; where it does, whole texts are the units). A document is the sequence of its
units, so its counts are sums of theirs and its groups stand one after the other. The units that occur most, a
bounded number of short ones, are shipped to the tasks that read documents; the others reach their documents by a join.

One unit's tokens pass through one task, as a sorted stream. A unit is nearly always a word; a text
without lone blanks is one unit.

Edge cases: null and empty texts, and texts whose joined tokens of B aren't the blank and the text (as with U+2581 in them), have
no tokens and count for nothing; repeated rows give equal rows, and count as often as they stand; very long texts are aligned
whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mercadia.llm._common import arrow_rows, checked_broadcast, stored

MARK = "▁"
#: Units that are shipped to tasks at most, and bytes of one at most. Others are joined.
SHIPPED, SHIPPED_BYTES = 400_000, 128
#: A token's size in bytes has so many bits.
SIZE_BITS = 20
SIZES = 1 << SIZE_BITS
#: Distinct units a task counts before it passes the counts on.
HELD = 400_000
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
#: White space that no unit begins with, and pairs of it.
_OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_RUNS = [a + b for a in " \n" for b in " \n"]
_CUT = re.compile(rf"(?<=[^\s{MARK}])(?=[ \n][^\s{MARK}])")


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones as themselves, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Pair:
    """Tokenizer A (byte-level BPE, a JSON file) and B (a sentencepiece model), from their files' bytes."""

    def __init__(self, a: bytes, b: bytes):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has a core
        import sentencepiece
        from tokenizers import Tokenizer

        spec = json.loads(a)
        if spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or not spec["pre_tokenizer"].get("use_regex", True):
            raise ValueError("A must be a byte-level tokenizer with its usual pattern and no normaliser")
        self.a = Tokenizer.from_str(a.decode())
        self.a.encode_special_tokens = True
        letters = _byte_letters()
        self.a_bytes = {i: bytes(letters[c] for c in entry) for entry, i in spec["model"]["vocab"].items() if all(c in letters for c in entry)}
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = {i: bytes([int(_BYTE.fullmatch(p)[1], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)}
        self.mark = self.b.piece_to_id(MARK)
        ordinary = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        self.cuts = self.check(ordinary)
        self.fallback = any(self.b.is_byte(i) for i in range(len(pieces)))
        self.known = {p for p in ordinary if len(p) == 1}

    def check(self, pieces: list[str]) -> bool:
        """Whether no piece of B reaches over the places where units are cut, and B leaves texts as they are."""
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto.FromString(self.b.serialized_model_proto())
        rules = model.normalizer_spec
        self.as_is = not rules.precompiled_charsmap and not rules.remove_extra_whitespaces and rules.add_dummy_prefix and rules.escape_whitespaces
        return self.as_is and self.mark > 0 and not any(re.search(rf"[^{MARK}]{MARK}|\n.|.\n", p) for p in pieces)

    def faithful(self, text: str | None) -> bool:
        """Whether the tokens of B, joined, are the blank and the text."""
        if not text or MARK in text:
            return False
        if not self.as_is and self.b.normalize(text) != MARK + text.replace(" ", MARK):
            return False
        return self.fallback or set(text.replace(" ", MARK)) <= self.known

    def units(self, text: str) -> list[str]:
        """The units of blank and text. A unit's first blank is left out, unless another white space follows it."""
        if not self.cuts:
            return [" " + text if text[0].isspace() else text]
        if text[0] not in " \n" and text[-1] not in " \n" and MARK not in text and not any(x in text for x in _RUNS) and not any(c in text for c in _OTHER_SPACE):
            return text.replace("\n", " \n").split(" ")
        return [u[1:] if u[0] == " " and len(u) > 1 and not u[1].isspace() else u for u in _CUT.split(" " + text)]

    def encode(self, units: list[str]) -> list[tuple[list[int], list[int]]]:
        """The tokens of units, which must be faithful ones."""
        whole = [u if u[0] in " \n" else " " + u for u in units]
        a = [x.ids for x in self.a.encode_batch(whole, add_special_tokens=False)]
        # B puts a blank before what it encodes
        b = [x if w[0] == " " else x[1:] for w, x in zip(whole, self.b.encode([w[1:] if w[0] == " " else w for w in whole], num_threads=1))]
        for w, x, y in zip(whole, a, b):
            if b"".join(map(self.b_bytes.__getitem__, y)) != w.encode() or b"".join(map(self.a_bytes.__getitem__, x)) != w.encode():
                raise RuntimeError(f"tokens aren't the text: {w[:80]!r}")
        return list(zip(a, b))


#: The pair that this worker built last, by the digest of its files.
_built: dict[str, Pair] = {}


class Shipped:
    """The files of two tokenizers, for tasks."""

    def __init__(self, spark: SparkSession, a_path: str, b_path: str):
        with open(a_path, "rb") as a, open(b_path, "rb") as b:
            files = a.read(), b.read()
        self.digest = hashlib.md5(files[0] + files[1]).hexdigest()
        self.files = spark.sparkContext.broadcast(files)

    def __call__(self) -> Pair:
        if self.digest not in _built:
            _built.clear()
            _built[self.digest] = Pair(*self.files.value)
        return _built[self.digest]


@contextmanager
def _kept_apart(spark: SparkSession) -> Iterator[None]:
    """Joins on (uid, ...) planned and run inside use rows that are dealt by uid as they are."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def counted_units(docs: DataFrame, pair: Shipped) -> DataFrame:
    """(uid, unit, n) of the distinct units of docs (text)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers, counts = pair(), Counter()

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["unit", "n"])
            counts.clear()
            return rows

        for batch in batches:
            for text in batch.column(0):
                if tokenizers.faithful(text := text.as_py()):
                    counts.update(tokenizers.units(text))
                if len(counts) >= HELD:
                    yield out()
        yield out()

    found = docs.select("text").mapInArrow(task, "unit string, n long")
    return stored(found.groupBy("unit").agg(F.sum("n").alias("n")).withColumn("uid", F.monotonically_increasing_id()), "units", "zstd")


def encoded(units: DataFrame, pair: Shipped) -> DataFrame:
    """(uid, tokens): how many tokens A has, then those of A, then those of B, each as SIZES * id + size in bytes.

    They stand in one column so that both sides read the same shuffled rows.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = pair()
        a_code, b_code = ({i: SIZES * i + len(x) for i, x in side.items()}.__getitem__ for side in (tokenizers.a_bytes, tokenizers.b_bytes))
        for batch in batches:
            values, ends = [], [0]
            for a, b in tokenizers.encode(batch.column(1).to_pylist()):
                values.append(len(a))
                values += map(a_code, a)
                values += map(b_code, b)
                ends.append(len(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64()))], names=["uid", "tokens"])

    return units.select("uid", "unit").mapInArrow(task, "uid long, tokens array<bigint>")


def _tokens(pieces: DataFrame, side: str) -> DataFrame:
    """(uid, {side}_pos, {side}, {side}_start, end): a row a token."""
    n_a = F.col("tokens")[0].cast("int")
    own = F.slice("tokens", F.lit(2), n_a) if side == "a" else F.slice("tokens", n_a + 2, F.size("tokens") - n_a - 1)
    rows = pieces.select("uid", F.posexplode(own).alias("pos", "token"))
    rows = rows.select("uid", "pos", F.shiftright("token", SIZE_BITS).cast("int").alias("id"), F.col("token").bitwiseAND(F.lit(SIZES - 1)).alias("size"))
    upto = Window.partitionBy("uid").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum("size").over(upto))
    return rows.select("uid", F.col("pos").alias(f"{side}_pos"), F.col("id").alias(side), (F.col("end") - F.col("size")).alias(f"{side}_start"), "end")


def _grouped(tokens: DataFrame, ends: DataFrame, side: str) -> DataFrame:
    """tokens with `grp`, how many cuts lie before their end, and {side}_end."""
    met = tokens.join(ends.select("uid", "end", F.lit(1).alias("cut")), ["uid", "end"], "left")
    before = Window.partitionBy("uid").orderBy("end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = F.coalesce("cut", F.lit(0))
    return met.withColumn("grp", F.sum(cut).over(before) - cut).withColumnRenamed("end", f"{side}_end").drop("cut")


def links(pieces: DataFrame) -> DataFrame:
    """(uid, a_pos, b_pos, a, b, grp, cut) of all pairs of tokens of both sides that share bytes.

    cut: both end at the same byte. pieces: as `encoded` gives them.
    """
    dealt = pieces.repartition("uid").sortWithinPartitions("uid")
    a, b = _tokens(dealt, "a"), _tokens(dealt, "b")
    left, right = _grouped(a, b, "a"), _grouped(b, a, "b").withColumnsRenamed({"uid": "uid_b", "grp": "grp_b"})
    same = (F.col("uid") == F.col("uid_b")) & (F.col("grp") == F.col("grp_b"))
    overlap = (F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end"))
    return left.join(right, same & overlap).select("uid", "a_pos", "b_pos", "a", "b", "grp", (F.col("a_end") == F.col("b_end")).alias("cut"))


def aligned_units(units: DataFrame, pair: Shipped) -> DataFrame:
    """(uid, unit, n, links), links in order of position: structs (a_pos, b_pos, a, b, cut)."""
    spark = units.sparkSession
    with _kept_apart(spark):
        rows = links(encoded(units, pair))
        gathered = rows.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("a_pos", "b_pos", "a", "b", "cut"))).alias("links"))
        return stored(gathered.join(units, "uid").select("uid", "unit", "n", "links"), "aligned", "zstd")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, count, best): links of each id pair over the corpus, and whether no pair of the same b has more."""
    found = aligned.select("n", F.explode("links").alias("l")).groupBy(F.col("l.a").alias("a"), F.col("l.b").alias("b")).agg(F.sum("n").alias("count"))
    found = stored(found, "pairs")
    most = found.groupBy("b").agg(F.max("count").alias("most"))
    return found.join(F.broadcast(most), "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, unit, n, links) -> (uid, unit, n, n_a, n_b, n_groups, n_links, groups)."""
    for batch in batches:
        out, linked = [], batch.column(3)
        fields = linked.flatten()
        rows = zip(*(fields.field(f).to_pylist() for f in ("a_pos", "b_pos", "a", "b", "cut")))
        for size in linked.value_lengths().to_pylist():
            parts, a_ids, b_ids, last_a, last_b = [], [], [], -1, -1
            for a_pos, b_pos, a, b, cut in islice(rows, size):
                if a_pos > last_a:
                    last_a = a_pos
                    a_ids.append(str(a))
                if b_pos > last_b:
                    last_b = b_pos
                    b_ids.append(str(b))
                if cut:
                    parts.append(f"{','.join(a_ids)}|{','.join(b_ids)}")
                    a_ids, b_ids = [], []
            out.append((last_a + 1, last_b + 1, len(parts), size, ";".join(parts)))
        columns = list(zip(*out)) or [()] * 5
        kinds = [pa.int64()] * 4 + [pa.string()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=["uid", "unit", "n", "n_a", "n_b", "n_groups", "n_links", "groups"])


_SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def dictionary(aligned: DataFrame, pairs: DataFrame) -> DataFrame:
    """(unit, n, entry) of every unit; entry: its sums, separated by blanks, and its groups, a line each."""
    spark = aligned.sparkSession
    each = aligned.select("uid", F.explode("links").alias("l")).select("uid", F.col("l.a").alias("a"), F.col("l.b").alias("b"))
    valued = each.join(checked_broadcast(pairs), ["a", "b"]).groupBy("uid").agg(F.sum(F.col("best").cast("bigint")).alias("n_best"), F.sum("count").alias("count_sum"))
    with arrow_rows(spark, 2000):
        named = aligned.mapInArrow(_written, "uid long, unit string, n long, n_a long, n_b long, n_groups long, n_links long, groups string")
        entry = F.concat_ws("\n", F.concat_ws(" ", *_SUMS), "groups")
        return stored(named.join(valued, "uid").select("unit", "n", entry.alias("entry")), "dictionary", "zstd")


#: Sums of a text, side by side in one number, have so many bits each.
_WIDE = 72


def _read(entry: str) -> tuple[str, tuple[str, int]]:
    """What follows an entry's two lines, and its groups and sums."""
    sums, groups, *unit = entry.split("\n", 2)
    return "".join(unit), (groups, sum(int(x) << _WIDE * i for i, x in enumerate(sums.split(" "))))


#: The entries that this worker read last, by the name of what was shipped.
_shipped: dict[str, dict[str, tuple[str, int]]] = {}


class Entries:
    """A bounded number of rows (unit, entry), shipped as an Arrow table and read once a worker."""

    def __init__(self, rows: DataFrame):
        sink = pa.BufferOutputStream()
        table = rows.toArrow()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        self.name = uuid.uuid4().hex
        self.data = rows.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())

    def __call__(self) -> dict[str, tuple[str, int]]:
        if self.name not in _shipped:
            _shipped.clear()
            held: dict[str, tuple[str, int]] = {}
            for batch in pa.ipc.open_stream(self.data.value):
                held.update((u, _read(e)[1]) for u, e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            _shipped[self.name] = held
        return _shipped[self.name]


def most_frequent(known: DataFrame, most: int) -> Column:
    """Whether a unit is one of those that occur most, `most` of them at most: those of the highest steps of a scale of counts."""
    step, short = F.floor(F.log2("n") * 16), F.octet_length("unit") <= SHIPPED_BYTES
    steps, total, least = sorted(known.where(short).groupBy(step.alias("step")).count().collect(), reverse=True), 0, None
    for r in steps:
        total += r["count"]
        if total > most:
            break
        least = r["step"]
    return F.lit(False) if least is None else short & (step >= least)


def align(docs: DataFrame, a_path: str, b_path: str, with_groups: bool = True, shipped: int = SHIPPED) -> DataFrame:
    """One row per row of docs (doc_id, text): n_a, n_b, n_groups, n_links, n_best, count_sum, and groups or, without
    with_groups, their SHA-256 as groups_sha256.

    groups: `a1,a2|b1;a3|b2,b3`, the ids of each group in order; empty without tokens.
    """
    spark = docs.sparkSession
    pair = Shipped(spark, a_path, b_path)
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    units = counted_units(docs, pair)
    aligned = aligned_units(units, pair)
    known = dictionary(aligned, pair_counts(aligned))
    often = most_frequent(known, shipped)
    hot = Entries(known.where(often).select("unit", "entry"))
    # documents with one key would only get each other's units too
    keyed = docs.withColumn("key", F.xxhash64("doc_id", "text"))

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers, held = pair(), hot()
        for batch in batches:
            keys, found = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if tokenizers.faithful(text):
                    own = [u for u in set(tokenizers.units(text)) if u not in held]
                    keys += [key] * len(own)
                    found += own
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, pa.string())], names=["key", "unit"])

    wanted = keyed.select("key", "text").mapInArrow(rare, "key long, unit string")
    found = wanted.join(known.where(~often).select("unit", "entry"), "unit")
    entries = found.groupBy("key").agg(F.collect_set(F.concat_ws("\n", "entry", "unit")).alias("entries"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers, get = pair(), hot().get
        for batch in batches:
            out = []
            for text, entries in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if not tokenizers.faithful(text):
                    out.append(("", *[0] * len(_SUMS)))
                    continue
                own = dict(map(_read, entries or ()))
                groups, counts = zip(*[get(u) or own[u] for u in tokenizers.units(text)])
                groups, total = ";".join(groups), sum(counts)
                out.append((groups if with_groups else hashlib.sha256(groups.encode()).hexdigest(), *[total >> _WIDE * i & (1 << _WIDE) - 1 for i in range(len(_SUMS))]))
            columns = list(zip(*out)) or [()] * (1 + len(_SUMS))
            kinds = [pa.string()] + [pa.int64()] * len(_SUMS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=["doc_id", name, *_SUMS])

    name = "groups" if with_groups else "groups_sha256"
    joined = keyed.join(entries, "key", "left").select("doc_id", "text", "entries")
    with arrow_rows(spark, 1000):
        out = stored(joined.mapInArrow(sums, f"doc_id long, {name} string, " + ", ".join(f"{c} long" for c in _SUMS)), "sums")
    return out.select("doc_id", *_SUMS, name)

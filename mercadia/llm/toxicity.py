"""Toxicity by two class-conditional Kneser-Ney models, toxic and ordinary.

Both models read characters, across words: a text is its lower-cased words, each closed by a blank, and every
character x is predicted from the ORDER - 1 characters h before it. At the highest order N_c(hx) is the number
of documents of class c that hold hx; below it N_c(hx) is the number of different characters before hx in
class c, the continuation count. Counts are discounted by D, and what that frees goes to the context without
its first character:

    P_c(x | h) = (max(N_c(hx) - D, 0) + D K_c(h) P_c(x | h')) / N_c(h.)

where N_c(h.) sums over characters, K_c(h) is how many follow h in class c, and a context that the class lacks
leaves all to h'. Up to SHARED characters the continuation counts are those of both classes together, so that a
rare expression is judged by how all texts are spelt. The bottom is the same for every character.

A text's score compares its log-likelihoods by a logistic function of two differences, toxic less ordinary:
of the whole text per character, and of the TOP words where it is largest, per word.

The difference at a position adds up over its n-grams, of which each has two weights: one for its last
character, one for the character that follows. Weights of at most SHIPPED n-grams are sent to tasks; beyond
that the words of all texts, with the characters before them, are joined with the weights, with equal results.

Counts are of all labelled rows in folds 1 to 3 of crc32(doc_id) mod 5; fold 4 fits the numbers of the logistic
function on at most CALIBRATION_ROWS rows; fold 0 is held out.

Edge cases: null and empty texts, and those without words, have differences of 0; labels that are null are
ignored, of several labels of a doc_id the largest counts; documents with a null doc_id aren't learnt from and
count as not held out; repeated rows give equal rows; without labels of both classes in fold 4 every score is
the share of toxic ones there, or near 0 without any; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mercadia.llm._arrays import LOWER, frugal, group_starts, mixed, raw_texts
from mercadia.llm._common import arrow_rows, checked_broadcast, row_key, stored

#: Characters of the longest n-gram, and of the longest whose counts the classes share.
ORDER, SHARED = 6, 3
DISCOUNT = 0.75
#: Characters that the bottom of both models holds equally likely.
CHARACTERS = 0x110000
#: Words of a text whose difference is largest.
TOP = 3
#: Most n-grams whose weights are shipped to tasks.
SHIPPED = 8_000_000
CALIBRATION_ROWS = 40_000
#: N-grams that a counting task holds at once, and characters that a scoring task reads at once.
HELD, READ = 1_000_000, 1 << 18
#: Rows with texts that a task of Python gets at a time.
ROWS_AT_ONCE = 1024
_PAD = ORDER - 1
#: An odd base of the polynomials that n-grams are hashed by.
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _codes(text: bytes) -> np.ndarray:
    """Code points of the words, each closed by a blank, after as many blanks as a context has."""
    words = text.translate(LOWER).split()
    plain = b" ".join([*words, b""]).decode("utf-8", "replace")
    return np.frombuffer((" " * _PAD + plain).encode("utf-32-le"), np.uint32)


def _polynomials(x: np.ndarray, least: int, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """For n from least to most the values, modulo 2**64, of all runs of n code points as polynomials."""
    out = np.zeros(len(x) + 1, np.uint64)
    for n in range(1, most + 1):
        out = out[:-1] * _BASE
        out += x[n - 1 :]
        if n >= least:
            yield n, out


def _hashes(x: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n code points."""
    return mixed(*[out for _, out in _polynomials(x, n, n)]) if len(x) >= n else np.zeros(0, np.uint64)


def _strings(grams: np.ndarray) -> pa.Array:
    """Rows of code points as strings."""
    plain, n = np.ascontiguousarray(grams, "<u4").tobytes().decode("utf-32-le"), grams.shape[1]
    return pa.array([plain[i : i + n] for i in range(0, len(plain), n)], pa.string())


def count_grams(train: DataFrame) -> DataFrame:
    """(gram, toxic, ordinary): in how many rows of train (text, toxic) of either class an n-gram of ORDER is."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def merged():
            columns = [list(z) for z in zip(*held)]
            held.clear()
            # one column after another, so that only one is there twice
            h, grams, counts = (np.concatenate(columns.pop(0)) for _ in range(3))
            _, first, at = np.unique(h, return_index=True, return_inverse=True)
            return h[first], grams[first], np.stack([np.bincount(at, counts[:, c], len(first)) for c in (0, 1)], 1).astype(np.int64)

        def out():
            _, grams, counts = merged()
            return pa.RecordBatch.from_arrays([_strings(grams), pa.array(counts[:, 1]), pa.array(counts[:, 0])], names=["gram", "toxic", "ordinary"])

        for batch in batches:
            for text, y in zip(raw_texts(batch.column(0)), batch.column(1).to_pylist()):
                x = _codes(text)
                if len(x) < ORDER:
                    continue
                h, first = np.unique(_hashes(x, ORDER), return_index=True)
                counts = np.zeros((len(h), 2), np.int64)
                counts[:, int(bool(y))] = 1
                held.append((h, np.lib.stride_tricks.sliding_window_view(x, ORDER)[first], counts))
                rows += len(h)
                if rows >= 2 * HELD:
                    held = [merged()]
                    rows = len(held[0][0])
                    if rows >= HELD:
                        yield out()
                        held, rows = [], 0
        if held:
            yield out()

    return train.select("text", "toxic").mapInArrow(frugal(task), "gram string, toxic long, ordinary long").groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def weights(train: DataFrame) -> DataFrame:
    """(gram, own, next): an n-gram's weights for its last character and for the character that follows it."""
    with arrow_rows(train.sparkSession, ROWS_AT_ONCE):
        counts = {ORDER: stored(count_grams(train), "grams").withColumn("both", F.lit(0).cast("long"))}
    for n in range(ORDER - 1, 0, -1):
        # how many different characters stand before an n-gram, in either class and in both together
        more = counts[n + 1].groupBy(F.substring("gram", 2, n).alias("gram"))
        counts[n] = stored(more.agg(*[F.sum((F.col(c) > 0).cast("long")).alias(c) for c in ("toxic", "ordinary")], F.count(F.lit(1)).alias("both")), "continuations")
    low, found = None, []
    for n in range(1, ORDER + 1):
        rows = counts[n].withColumn("h", F.substring("gram", 1, n - 1)).withColumn("shorter", F.substring("gram", 2, n - 1))
        classes = ("both", "both") if n <= SHARED else ("toxic", "ordinary")
        contexts = rows.groupBy("h").agg(*[f for i, c in enumerate(classes) for f in (F.sum(c).alias(f"n{i}"), F.sum((F.col(c) > 0).cast("long")).alias(f"k{i}"))])
        contexts = contexts.select("h", "n0", "n1", *[F.when(F.col(f"n{i}") > 0, DISCOUNT * F.col(f"k{i}") / F.col(f"n{i}")).otherwise(1.0).alias(f"freed{i}") for i in (0, 1)])
        rows = rows.join(contexts, "h")
        if low is None:
            rows = rows.withColumn("low0", F.lit(1 / CHARACTERS)).withColumn("low1", F.lit(1 / CHARACTERS))
        else:
            rows = rows.join(low.select(F.col("gram").alias("shorter"), F.col("p0").alias("low0"), F.col("p1").alias("low1")), "shorter")
        own = lambda i, c: F.when(F.col(f"n{i}") > 0, F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.col(f"n{i}")).otherwise(0.0)
        low = rows.select("gram", "h", "freed0", "freed1", "low0", "low1", *[(own(i, c) + F.col(f"freed{i}") * F.col(f"low{i}")).alias(f"p{i}") for i, c in enumerate(classes)])
        low = stored(low, "model")
        if n > SHARED:
            passed = F.log(F.col("freed0") / F.col("freed1"))
            found.append(low.select("gram", (F.log(F.col("p0") / F.col("p1")) - F.log(F.col("low0") / F.col("low1")) - passed).alias("own"), F.lit(0.0).alias("next")))
            found.append(low.groupBy(F.col("h").alias("gram")).agg(F.lit(0.0).alias("own"), F.first(passed).alias("next")))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return stored(every.groupBy("gram").agg(*[F.sum(c).cast("float").alias(c) for c in ("own", "next")]), "weights")


class Weights:
    """Weights by n-gram in a hash table of arrays: slots by the high bits of a hash, told apart by the low ones."""

    def __init__(self, hashes: np.ndarray, own: np.ndarray, after: np.ndarray):
        self.bits = max(8, int(2 * len(hashes)).bit_length())
        self.key = np.zeros(1 << self.bits, np.uint32)
        self.own, self.next = np.zeros(1 << self.bits, np.float32), np.zeros(1 << self.bits, np.float32)
        at, left, placed = self._slot(hashes), np.arange(len(hashes)), np.zeros(len(hashes), bool)
        while len(left):
            free = left[self.key[at[left]] == 0]
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.key[at[won]] = self._sign(hashes[won])
            self.own[at[won]], self.next[at[won]] = own[won], after[won]
            placed[won] = True
            left = left[~placed[left]]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def _sign(self, h: np.ndarray) -> np.ndarray:
        return (h & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)

    def of(self, h: np.ndarray, *kinds: np.ndarray) -> list[np.ndarray]:
        """The weights of each hash, of each kind; 0 where it isn't found."""
        at, sign = self._slot(h), self._sign(h)
        key = self.key.take(at)
        miss = key != sign
        out = [kind.take(at) for kind in kinds]
        for found in out:
            found[miss] = 0
        left = np.flatnonzero(miss & (key != 0))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            key = self.key.take(at[left])
            hit = left[key == sign[left]]
            for kind, found in zip(kinds, out):
                found[hit] = kind.take(at[hit])
            left = left[(key != sign[left]) & (key != 0)]
        return out

    def differences(self, x: np.ndarray) -> np.ndarray:
        """The difference of log-likelihoods at each position of code points; 0 at the first ones."""
        out = np.zeros(len(x))
        for n, polynomial in _polynomials(x, SHARED, min(ORDER, len(x))):
            kinds = [self.own] * (n > SHARED) + [self.next] * (n < ORDER)
            found = self.of(mixed(polynomial), *kinds)
            if n > SHARED:
                out[n - 1 :] += found[0]
            if n < ORDER:
                out[n:] += found[-1][:-1]
        out[:_PAD] = 0
        return out


@dataclass
class Model:
    """Weights as a table, their shipped form if they are few enough, and the numbers of the logistic function."""

    table: DataFrame | None
    shipped: object | None
    numbers: tuple[float, float, float]

    def unship(self) -> None:
        """Frees the shipped weights on the executors; who scores again gets them again."""
        if self.shipped is not None:
            self.shipped.unpersist()


def ship(table: DataFrame, most: int = SHIPPED) -> Model:
    """The model of a table of weights; its numbers are still to be fitted."""
    if table.count() > most:
        return Model(table, None, (0.0, 0.0, 0.0))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, h = batch.column(0).to_pylist(), np.zeros(batch.num_rows, np.uint64)
            sizes = np.array([len(g) for g in grams])
            for n in set(sizes.tolist()):
                same = np.flatnonzero(sizes == n)
                x = np.frombuffer("".join(grams[i] for i in same).encode("utf-32-le"), np.uint32)
                h[same] = _hashes(x, n)[::n]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(1), batch.column(2)], names=["h", "own", "next"])

    got = table.select("gram", "own", "next").mapInArrow(task, "h long, own float, next float").toArrow()
    arrays = Weights(got["h"].to_numpy().view(np.uint64), got["own"].to_numpy(), got["next"].to_numpy())
    del got
    pa.default_memory_pool().release_unused()
    return Model(table, table.sparkSession.sparkContext.broadcast(arrays), (0.0, 0.0, 0.0))


def _measured(texts: list[bytes], model: Weights) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the mean difference per character, and the mean of its TOP words."""
    codes = [_codes(t) for t in texts]
    sizes = np.array([len(x) for x in codes])
    x, text = np.concatenate(codes), np.repeat(np.arange(len(codes)), sizes)
    start = np.repeat(np.cumsum(sizes) - sizes, sizes)
    body = np.arange(len(x)) - start >= _PAD
    each = np.where(body, model.differences(x), 0)
    mean, top = np.zeros(len(texts)), np.zeros(len(texts))
    ends = np.flatnonzero(body & (x == 32))
    if len(ends):
        # a word reaches from its first character to its closing blank
        first = np.concatenate([[0], ends[:-1] + 1])
        words, of = np.add.reduceat(each, first), text[ends]
        chars = np.maximum(sizes - _PAD, 1)
        mean = np.bincount(of, words, len(texts)) / chars
        order = np.lexsort((-words, of))
        starts = group_starts(of[order])
        place = np.arange(len(order)) - np.repeat(starts[:-1], np.diff(starts))
        best = order[place < TOP]
        top = np.bincount(of[best], words[best], len(texts)) / TOP
    return mean, top


def _by_shipping(docs: DataFrame, model: Model, keep: tuple[str, ...], with_text: bool) -> DataFrame:
    shipped = model.shipped
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["text string"] * with_text + ["__m_mean double", "__m_top double"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mean, top, held, size = [], [], [], 0
            for text in raw_texts(batch.column(len(keep))):
                held.append(text)
                size += len(text)
                if size >= READ:
                    for into, got in zip((mean, top), _measured(held, shipped.value)):
                        into.append(got)
                    held, size = [], 0
            if held:
                for into, got in zip((mean, top), _measured(held, shipped.value)):
                    into.append(got)
            numbers = [pa.array(np.concatenate(z) if z else np.zeros(0)) for z in (mean, top)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep) + with_text], *numbers], names=[*keep, *["text"] * with_text, "__m_mean", "__m_top"])

    return docs.select(*keep, "text").mapInArrow(frugal(task), schema)


def _by_joining(docs: DataFrame, model: Model, keep: tuple[str, ...], with_text: bool) -> DataFrame:
    """The same from joins: words with the characters before them meet their n-grams' weights once each."""
    key = row_key(F.lit(None), F.col("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1))):
                plain = _codes(text).tobytes().decode("utf-32-le")
                ends = [i + 1 for i in range(_PAD, len(plain)) if plain[i] == " "]
                units = Counter(plain[a - _PAD : b] for a, b in zip([_PAD, *ends], ends))
                for at in range(0, len(units), HELD):
                    some = list(units.items())[at : at + HELD]
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(some)), pa.array([u for u, _ in some], pa.string()), pa.array([n for _, n in some], pa.int64())], names=["key", "unit", "times"])

    units = stored(docs.select(key.alias("key"), "text").dropDuplicates(["key"]).mapInArrow(task, "key string, unit string, times long"), "units")
    distinct = units.select("unit").distinct()

    def grams(n: int, last: int) -> Column:
        """The n-grams of a unit that end at its word's characters, or, for last = 1, at those before them."""
        ends = F.sequence(F.lit(_PAD + 1 - last), F.length("unit") - last)
        return F.transform(ends, lambda e: F.struct(F.substring("unit", e - n + 1, F.lit(n)).alias("gram"), F.lit(last).alias("last")))

    places = F.concat(*[grams(n, 0) for n in range(SHARED + 1, ORDER + 1)], *[grams(n, 1) for n in range(SHARED, ORDER)])
    each = distinct.select("unit", F.explode(places).alias("g")).select("unit", "g.gram", "g.last").join(model.table, "gram", "left")
    sums = each.groupBy("unit").agg(F.sum(F.coalesce(F.when(F.col("last") == 0, F.col("own")).otherwise(F.col("next")).cast("double"), F.lit(0.0))).alias("sum"))
    words = stored(units.join(sums, "unit").select("key", "times", "sum", (F.length("unit") - _PAD).alias("chars")), "words")
    ranked = words.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("sum"), F.desc("times")))).where(F.col("rank") <= TOP)
    copies = ranked.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("times", F.lit(TOP)).cast("int"))))
    best = copies.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("sum"), "rank", "copy"))).where(F.col("place") <= TOP).groupBy("key").agg((F.sum("sum") / TOP).alias("__m_top"))
    whole = words.groupBy("key").agg((F.sum(F.col("times") * F.col("sum")) / F.sum(F.col("times") * F.col("chars"))).alias("__m_mean"))
    numbers = whole.join(best, "key").withColumnRenamed("key", "__m_key")
    rows = docs.select(*keep, "text").withColumn("__m_key", key).join(numbers, "__m_key", "left")
    return rows.select(*keep, *["text"] * with_text, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("__m_mean", "__m_top")])


def measure(docs: DataFrame, model: Model, *keep: str, with_text: bool = False) -> DataFrame:
    """keep, __m_mean and __m_top of each row of docs (and its text, if so asked)."""
    return (_by_joining if model.shipped is None else _by_shipping)(docs, model, keep, with_text)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, shipped: int = SHIPPED) -> Model:
    """The weights and the logistic function's numbers, from rows that aren't held out."""
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    marks = checked_broadcast(stored(marks.withColumn("fold", fold).where("fold <> 0"), "labels"))
    train = docs.select("doc_id", "text").join(marks, "doc_id")
    model = ship(weights(train.where("fold <> 4")), shipped)
    with arrow_rows(docs.sparkSession, ROWS_AT_ONCE):
        rows = measure(train.where("fold = 4"), model, "doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "__m_mean").limit(CALIBRATION_ROWS).toArrow()
    y, mean, top = (rows[c].to_numpy().astype(float) for c in ("toxic", "__m_mean", "__m_top"))
    if len(set(y)) < 2:
        share = float(y.mean()) if len(y) else 0.0
        model.numbers = (math.log(max(share, 1e-6) / max(1 - share, 1e-6)), 0.0, 0.0)
    else:
        model.numbers = tuple(_logistic(np.stack([np.ones_like(y), mean, top], 1), y).tolist())
    return model


def score(docs: DataFrame, model: Model, *keep: str, with_text: bool = False, name: str = "score") -> DataFrame:
    """keep and a score from 0 to 1, under `name`, of each row of docs (and its text, if so asked)."""
    a, b, c = model.numbers
    z = F.lit(a) + F.lit(b) * F.col("__m_mean") + F.lit(c) * F.col("__m_top")
    return measure(docs, model, *keep, with_text=with_text).withColumn(name, 1 / (1 + F.exp(-z))).drop("__m_mean", "__m_top")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted."""
    scored = score(docs, fit(docs, labels), "doc_id")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

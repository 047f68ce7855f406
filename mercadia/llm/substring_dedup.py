"""Substring dedup with compressed FM-indexes: words of passages that an earlier document holds go.

1. Every window of WINDOW words has a key, the least hash among its runs of GRAM words. Neighbouring windows
   with one key form a passage. Equal windows have equal keys, so only keys that occur in several documents
   matter, and all passages with one key belong to one shard.
2. A shard holds the distinct passages of its keys, each with the smallest doc_id it occurs in, as an
   FM-index: the words' Burrows-Wheeler transform in a wavelet matrix of packed bits with rank samples. Its
   suffixes are sorted by their first 64 words, which is all that windows of up to 64 words ask for.
3. The documents' passages are streamed through backward search, all of a shard in step: a passage is read
   from its end, word by word to the left; once WINDOW words match, the oldest one is let go by widening the
   interval to the suffixes that share WINDOW - 1 words. The interval of a full match names the smallest
   doc_id among its occurrences; windows with one below the document's own are reported.
4. A document's reported windows cover the words to remove.

Shards are sized by their words. A key with more than HOT passages, which may be a third of all, is refined inside the
same method: its equal passages are merged first, by an aggregate that combines before the shuffle, and while more than
HOT distinct ones are left, their windows are divided by a further least hash under another order, in the end by all
their words. Equal windows stay together at every level. Each level's passages are indexed and searched as in 2 and 3;
what is found for a distinct passage is joined back to the documents that hold it. Positions are counted in words
`[^\\x20\\x09-\\x0D]+`.

Edge cases: null, empty and short texts lose nothing; documents with a null doc_id lose nothing and are no
earlier occurrence; rows that share a doc_id don't remove each other's words; a window that recurs within one
document alone stays; texts of any length are cut into passages of at most PASSAGE windows; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercadia.llm._arrays import WordNumbers, mixed, raw_texts
from mercadia.llm._common import BROADCAST_BYTES, checked_broadcast, row_key, stored

WINDOW = 50
GRAM = 10
#: Windows of one passage at most.
PASSAGE = 64
#: Words of a shard, before equal passages are merged.
SHARD_WORDS = 1_500_000
#: Passages from which a key is refined; so many fill a shard.
HOT = 20_000
#: Further least hashes that divide a hot key, before all words of a window do.
LEVELS = 4


def _grams(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of GRAM = 8 + 2 words, by doubling."""
    odd = np.uint64(0x9E3779B97F4A7C15)
    two = mixed(words[:-1] * odd + words[1:])
    four = mixed(two[:-2] * odd + two[2:])
    eight = mixed(four[:-4] * odd + four[4:])
    return mixed(eight[:-2] * odd + two[8:])


def _passages(words: np.ndarray, window: int, level: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, key) of a document's passages; each level orders the runs of words in another way."""
    if len(words) < window:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.uint64)
    if level > LEVELS:
        whole = np.zeros(len(words) - window + 1, np.uint64)
        for k in range(window):
            whole = mixed(whole) + words[k : k + len(whole)]
        return np.arange(len(whole)), np.ones(len(whole), int), whole
    least, span, width = _grams(words), window - GRAM + 1, 1
    if level:
        least = mixed(least ^ np.uint64(level))
    while width * 2 <= span:
        least, width = np.minimum(least[:-width], least[width:]), width * 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    starts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    sizes = np.diff(np.append(starts, len(least)))
    pieces = -(-sizes // PASSAGE)
    if (pieces > 1).any():
        inner = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        ends = np.repeat(starts + sizes, pieces)
        starts = np.repeat(starts, pieces) + inner * PASSAGE
        sizes = np.minimum(PASSAGE, ends - starts)
    return starts, sizes, least[starts]


class FMIndex:
    """An FM-index over passages of word numbers, for patterns of up to `window` words, at most 64."""

    def __init__(self, passages: list[np.ndarray], docs: np.ndarray, window: int = WINDOW):
        sizes = np.array([len(p) for p in passages])
        flat = np.concatenate(passages)
        self.alphabet, code = np.unique(flat, return_inverse=True)
        # 0 closes each passage and is in no pattern
        n = len(flat) + len(passages)
        ends = np.cumsum(sizes + 1) - 1
        text = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends] = False
        text[inside] = code + 1
        rank, width, at_32 = text, 1, None
        while width < 64:
            if width == 32:
                at_32 = rank
            shifted = np.zeros(n, np.int64)
            shifted[: n - width] = rank[width:] + 1
            _, rank = np.unique(rank * (n + 1) + shifted, return_inverse=True)
            width *= 2
        order = np.argsort(rank, kind="stable")

        def runs(length: int) -> np.ndarray:
            """Run numbers of suffixes in order that share `length` words, 33 to 64."""
            second = np.full(n, -1, np.int64)
            second[: n - (length - 32)] = at_32[length - 32 :]
            a, b = at_32[order], second[order]
            return np.concatenate([[0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))])

        def bounds(run: np.ndarray) -> np.ndarray:
            return np.concatenate([[0], np.flatnonzero(run[1:] != run[:-1]) + 1, [n]])

        self.window, self.n = window, n
        self.full, self.near = runs(window), runs(window - 1)
        self.near_bounds = bounds(self.near)
        owner = np.repeat(docs, sizes + 1)
        self.low_doc = np.minimum.reduceat(owner[order], bounds(self.full)[:-1])
        bwt = text[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(self.alphabet) + 1))])
        self._wavelet(bwt, max(1, int(len(self.alphabet)).bit_length()))

    def _wavelet(self, symbols: np.ndarray, levels: int) -> None:
        """Packed bits of each level from the highest, with ones before each 64-bit word, and zeros in all."""
        self.levels, start = [], np.zeros(len(self.alphabet) + 1, np.int64)
        every = np.arange(len(self.alphabet) + 1)
        for level in reversed(range(levels)):
            bit = (symbols >> level & 1).astype(np.uint8)
            packed = np.packbits(np.pad(bit, (0, -len(bit) % 64 + 64)), bitorder="little").view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed))])[:-1].astype(np.int64)
            zeros = int(len(bit) - bit.sum())
            self.levels.append((level, packed, before, zeros))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
            start = self._down(len(self.levels) - 1, start, every >> level & 1)
        self.start = start

    def _down(self, k: int, at: np.ndarray, bit: np.ndarray) -> np.ndarray:
        _, packed, before, zeros = self.levels[k]
        word = at >> 6
        ones = before[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
        return np.where(bit, zeros + ones, at - ones)

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals after one word more to the left."""
        at, bits = np.concatenate([low, high]), np.concatenate([symbol, symbol])
        for k, (level, *_) in enumerate(self.levels):
            at = self._down(k, at, bits >> level & 1)
        at = at - self.start[bits] + self.first[bits]
        return at[: len(low)], at[len(low) :]

    def lowest(self, passages: list[np.ndarray]) -> list[np.ndarray]:
        """For each window of each passage the smallest document that holds it, or the largest integer."""
        none = np.iinfo(np.int64).max
        sizes = np.array([len(p) for p in passages])
        windows = np.maximum(0, sizes - self.window + 1)
        ends = np.cumsum(windows)
        found = np.full(int(ends[-1]), none, np.int64)
        order = np.argsort(-sizes, kind="stable")
        flat, offsets = np.concatenate(passages), np.concatenate([[0], np.cumsum(sizes)])
        place = np.minimum(np.searchsorted(self.alphabet, flat), len(self.alphabet) - 1)
        place = np.where(self.alphabet[place] == flat, place + 1, 0)
        last, size = offsets[order + 1] - 1, sizes[order]
        low, high, length = np.zeros(len(order), np.int64), np.full(len(order), self.n, np.int64), np.zeros(len(order), np.int64)
        broken = np.zeros(len(order), bool)
        for step in range(int(size[0])):
            live = int(np.searchsorted(-size, -step, "left"))
            full = np.flatnonzero(length[:live] == self.window)
            # let the last word go: widen to the suffixes that share all words but that
            run = self.near[low[full]]
            low[full], high[full] = self.near_bounds[run], self.near_bounds[run + 1]
            length[full] -= 1
            symbol = place[last[:live] - step]
            low[:live], high[:live] = self.step(symbol, low[:live], high[:live])
            length[:live] += 1
            lost = np.flatnonzero((high[:live] <= low[:live]) | (symbol == 0))
            broken[lost] = True
            low[lost], high[lost], length[lost] = 0, self.n, 0
            full = np.flatnonzero(length[:live] == self.window)
            at = order[full]
            found[ends[at] - windows[at] + size[full] - 1 - step] = self.low_doc[self.full[low[full]]]
        out = np.split(found, ends[:-1])
        # a passage that the index lacks may still hold windows that it has: those are searched one by one
        for i in order[broken]:
            if windows[i] > 1:
                out[i] = np.concatenate(self.lowest([passages[i][k : k + self.window] for k in range(windows[i])]))
        return out


def _numbered(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """(batch, row, word numbers) of every text."""
    numbers = WordNumbers()
    for batch in batches:
        for row, text in enumerate(raw_texts(batch.column(text_at))):
            yield batch, row, numbers.of(text.split())


def _flush(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [[]] * len(schema), schema)], schema=schema)


def _emit(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _flush(held, schema)
            held = []
    yield _flush(held, schema)


def _signed(key: np.ndarray) -> list[int]:
    return key.view(np.int64).tolist()


def repeated_keys(slim: DataFrame, window: int) -> DataFrame:
    """(key, passages) of the keys that occur in several documents."""
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("passages", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, row, words in _numbered(batches, 1):
            keys, counts = np.unique(_passages(words, window)[2], return_counts=True)
            if len(keys):
                doc = np.full(len(keys), batch.column(0)[row].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(doc), pa.array(counts.astype(np.int64))], schema=schema)

    found = slim.select("doc_id", "text").mapInArrow(task, "key long, doc_id long, passages long")
    return found.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.sum("passages").alias("passages")).where("a < b").select("key", "passages")


def _passage_rows(slim: DataFrame, keys: DataFrame, window: int) -> DataFrame:
    """(key, doc_id, row_key, first, words) of the passages whose key is among keys."""
    small = 24 * keys.count() <= BROADCAST_BYTES
    if small:
        given = slim.select("doc_id", "row_key", "text")
    else:
        # too many keys to broadcast: first the keys of each document, then its text beside them
        schema = pa.schema([("row_key", pa.string()), ("key", pa.int64())])

        def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _emit(((batch.column(0)[row].as_py(), k) for batch, row, words in _numbered(batches, 1) for k in _signed(np.unique(_passages(words, window)[2]))), schema)

        listed = slim.select("row_key", "text").mapInArrow(mine, "row_key string, key long").distinct().join(keys.select("key"), "key").groupBy("row_key").agg(F.collect_list("key").alias("wanted"))
        given = slim.join(listed, "row_key").select("doc_id", "row_key", "text", "wanted")
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("row_key", pa.string()), ("first", pa.int32()), ("words", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch, row, words in _numbered(batches, 2):
                starts, sizes, key = _passages(words, window)
                if not small:
                    wanted = np.isin(key.view(np.int64), np.array(batch.column(3)[row].as_py(), np.int64))
                    starts, sizes, key = starts[wanted], sizes[wanted], key[wanted]
                doc, row_key_ = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                for first, size, k in zip(starts.tolist(), sizes.tolist(), _signed(key)):
                    yield k, doc, row_key_, first, words[first : first + size + window - 1].tobytes()

        yield from _emit(rows(), schema)

    found = given.mapInArrow(cut, "key long, doc_id long, row_key string, first int, words binary")
    return found.join(F.broadcast(keys.select("key")), "key") if small else found


def _refined(rows: DataFrame, window: int, shard_words: int, hot: int) -> Iterator[tuple[DataFrame, DataFrame]]:
    """For each level of hot keys (passages (passage, doc_id, row_key, first), lows (passage, lows)).

    passage is a digest of a passage's words; lows has the smallest document of each of its windows.
    """
    to_lows = pa.schema([("passage", pa.binary()), ("lows", pa.binary())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lowest, passages = [], [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            lowest += batch.column(1).to_pylist()
            passages += [np.frombuffer(w, np.uint64) for w in batch.column(2).to_pylist()]
        if ids:
            found = FMIndex(passages, np.array(lowest, np.int64), window).lowest(passages)
            yield from _emit(((i, f.tobytes()) for i, f in zip(ids, found)), to_lows)

    def divide(level: int):
        schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("row_key", pa.string()), ("first", pa.int32()), ("words", pa.binary())])

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def each() -> Iterator[tuple]:
                for batch in batches:
                    for old, doc, row_key_, first, held in zip(*(batch.column(i).to_pylist() for i in range(5))):
                        words = np.frombuffer(held, np.uint64)
                        starts, sizes, key = _passages(words, window, level)
                        key = mixed(key ^ np.array([old], np.int64).view(np.uint64))
                        for start, size, k in zip(starts.tolist(), sizes.tolist(), _signed(key)):
                            yield k, doc, row_key_, first + start, words[start : start + size + window - 1].tobytes()

            yield from _emit(each(), schema)

        return task

    for level in range(LEVELS + 2):
        rows = stored(rows.withColumn("passage", F.unhex(F.md5("words"))), "passages")
        merged = stored(rows.groupBy("key", "passage", "words").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")), "merged")
        # a key of one document only removes nothing
        sizes = merged.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("a"), F.max("high").alias("b")).where("a < b")
        sizes = stored(sizes.withColumn("whole", (F.col("n") <= hot) | F.lit(level > LEVELS)), "sizes")
        total = sizes.where("whole").agg(F.sum("n").alias("n")).first()["n"] or 0
        if total:
            shards = max(1, -(-total * (window + 20) // shard_words))
            ready = merged.join(checked_broadcast(sizes.where("whole").select("key")), "key").select("passage", "low", "words", "key")
            lows = stored(ready.repartition(shards, "key").mapInArrow(search, "passage binary, lows binary"), "lows")
            yield rows.select("passage", "doc_id", "row_key", "first"), lows
        left = sizes.where("not whole").select("key")
        if not left.limit(1).count():
            return
        rows = rows.join(checked_broadcast(left), "key").select("key", "doc_id", "row_key", "first", "words")
        rows = rows.mapInArrow(divide(level + 1), "key long, doc_id long, row_key string, first int, words binary")


def repeated_ranges(docs: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, hot: int = HOT) -> DataFrame:
    """(row_key, ranges): words [a, b) of rows of docs (doc_id, text) that an earlier document holds in a window."""
    # rows that share id and text have one answer
    slim = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("doc_id"), F.col("text")).alias("row_key"), "text")
    keys = stored(repeated_keys(slim, window), "keys")
    total = keys.where(F.col("passages") <= hot).agg(F.sum("passages").alias("n")).first()["n"] or 0
    shards = max(1, -(-total * (window + 20) // shard_words))
    schema = pa.schema([("row_key", pa.string()), ("a", pa.int32()), ("b", pa.int32())])

    def ranges(row_key_: str, first: int, hit: np.ndarray) -> Iterator[tuple]:
        edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            yield row_key_, first + a, first + b - 1 + window

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # copies of a passage are searched once
        number: dict[bytes, int] = {}
        lowest: list[int] = []
        asked: list[tuple[int, str, int, int]] = []
        for batch in batches:
            for doc, row_key_, first, words in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                i = number.setdefault(words, len(lowest))
                if i == len(lowest):
                    lowest.append(doc)
                lowest[i] = min(lowest[i], doc)
                asked.append((doc, row_key_, first, i))
        if not asked:
            return
        passages = [np.frombuffer(w, np.uint64) for w in number]
        number.clear()
        found = FMIndex(passages, np.array(lowest, np.int64), window).lowest(passages)
        yield from _emit((r for doc, row_key_, first, i in asked for r in ranges(row_key_, first, found[i] < doc)), schema)

    rows = _passage_rows(slim, keys.where(F.col("passages") <= hot), window)
    hits = rows.repartition(shards, "key").mapInArrow(shard, "row_key string, a int, b int")
    often = keys.where(F.col("passages") > hot)
    if often.limit(1).count():
        for asked_, lows in _refined(_passage_rows(slim, often, window), window, shard_words, hot):

            def late(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                def each() -> Iterator[tuple]:
                    for batch in batches:
                        for doc, row_key_, first, low in zip(*(batch.column(i).to_pylist() for i in range(4))):
                            yield from ranges(row_key_, first, np.frombuffer(low, np.int64) < doc)

                yield from _emit(each(), schema)

            joined = asked_.join(checked_broadcast(lows), "passage").select("doc_id", "row_key", "first", "lows")
            hits = hits.unionByName(joined.mapInArrow(late, "row_key string, a int, b int"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for spans in batch.column(1).to_pylist():
                flat: list[int] = []
                for s in sorted((s["a"], s["b"]) for s in spans):
                    if flat and s[0] <= flat[-1]:
                        flat[-1] = max(flat[-1], s[1])
                    else:
                        flat += s
                out.append(flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["row_key", "ranges"])

    grouped = stored(hits, "hits").groupBy("row_key").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    return stored(grouped.mapInArrow(merge, "row_key string, ranges array<int>"), "ranges")


def remove_repeats(docs: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, hot: int = HOT) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256, and ranges of the words removed."""
    found = repeated_ranges(docs, window, shard_words, hot).withColumnRenamed("row_key", "__m_key")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("doc_id"), F.col("text")).alias("__m_key"), "text")
    joined = slim.join(checked_broadcast(found), "__m_key", "left").select("doc_id", "text", "ranges")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, kept = [], [], []
            for text, cut in zip(raw_texts(batch.column(1)), batch.column(2).to_pylist()):
                words, left, at = text.split(), [], 0
                for a, b in zip((cut or ())[::2], (cut or ())[1::2]):
                    left += words[at:a]
                    at = b
                left += words[at:]
                n.append(len(words))
                gone.append(len(words) - len(left))
                kept.append(hashlib.sha256(b" ".join(left)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), batch.column(2)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "ranges"])

    return joined.mapInArrow(task, "doc_id long, n_words long, n_removed long, kept_sha256 string, ranges array<int>")

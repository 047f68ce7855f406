"""N-gram Jaccard join: MinHash banding, and verification of pairs on full n-gram sets.

1. Each text's signature is cut into bands; their number follows from the rows a band and the target
   recall at the threshold. Equal texts become one class, found by a sum before any join.
2. Classes are shuffled on band hashes. A bucket of several classes is cut into blocks, so that a task gets
   two blocks at most; no pair is a row. A pair of classes belongs to the first band that both share, so it
   is looked at once although it may meet in many buckets. Here only signatures travel.
3. Classes with a pair of their own in a bucket get their full n-gram sets sent there, and the pairs'
   Jaccard similarities are computed exactly. What leaves a task is, for each class, its number of links,
   and a spanning forest of the links.
4. Connected components of the forests show what the bands may have missed: pairs within a component that
   don't all link, and pairs of different components. The first are met in blocks where the links are a
   fair part of a component's pairs. All others are met by prefixes: a set's rarest n-grams, so many that two
   sets at the threshold must share one of them. Pairs that share no band and aren't ruled out by sizes, places in the
   prefixes or parities (which bound how much two sets differ) are then verified as in step 3, so that no link is left to
   chance. Their links, a ten-thousandth or so of all, are rows, and join the forests.

Sets are of 64-bit hashes of n-grams. A sample of texts tells which n-grams are frequent; it only orders them (any
order that all sets share gives the same links), so that frequent ones stand in few prefixes.

Words are runs of digits, letters and code points from 0x80 up, with A-Z lower-cased; a text of fewer than
n words, but not none, is one n-gram. Edge cases: null and empty texts and those without words link with
nothing, equal ones of them too; a null doc_id is kept, and is the smallest of its class only if all are null;
repeated rows are copies of one another; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercadia.llm._arrays import WordNumbers, forest, frugal, grams, group_starts, low_words, mixed, raw_texts, whole_groups
from mercadia.llm._common import arrow_rows, checked_broadcast, stored
from mercadia.llm.components import components

N = 5
THRESHOLD = 0.8
RECALL = 0.9999
ROWS = 5
#: Classes of one block of a bucket; a task holds two blocks.
BLOCK = 256
#: Rows with n-gram sets or signatures that a task of Python gets at a time.
ROWS_AT_ONCE = 1024
#: Keys of texts whose n-gram sets are wanted are broadcast up to this size.
WANTED_BYTES = 8 << 20
#: N-gram columns of a matrix product at a time.
COLUMNS = 4096
#: Texts that tell which n-grams are frequent, in how many of them such a one is, and how many n-grams are told apart.
SAMPLE = 1 << 14
FREQUENT = 3
TOLD = 200_000
#: Texts of the sample whose n-grams one task counts.
SAMPLE_AT_ONCE = 256
#: Pairs of a component to one of its links, up to which all its pairs are met.
PAIRS_A_LINK = 16


def band_count(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands needed so that a pair at the threshold shares one with the probability `recall`."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def _sets(texts: Iterator[bytes], n: int, numbers: WordNumbers) -> Iterator[np.ndarray]:
    """Sorted hashes of each text's distinct n-grams."""
    for text in texts:
        yield np.unique(grams(numbers.of(low_words(text)), n))


def _bands(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """One row of band hashes for each set of hashes; no set may be empty."""
    rng = np.random.default_rng(11)
    odd, add = rng.integers(0, 2**31, bands * rows, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, bands * rows, np.uint32)
    out = np.empty((len(sets), bands), np.uint64)
    at = 0
    while at < len(sets):
        to, size = at, 0
        while to < len(sets) and (to == at or size + len(sets[to]) <= 1 << 15):
            size += len(sets[to])
            to += 1
        flat = (np.concatenate(sets[at:to]) >> np.uint64(32)).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[at : to - 1]], dtype=int)]) if to - at > 1 else np.zeros(1, int)
        for b in range(bands):
            h = np.full(to - at, b + 1, np.uint64)
            for r in range(b * rows, (b + 1) * rows):
                h = mixed(h) + np.minimum.reduceat(flat * odd[r] + add[r], starts)
            out[at:to, b] = mixed(h)
        at = to
    return out


def frequent_grams(docs: DataFrame, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n-grams that are frequent in a sample of the distinct texts, sorted, and in how many of its texts each is."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = WordNumbers()
        for batch in batches:
            sets = list(_sets(raw_texts(batch.column(0)), n, numbers))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64))], names=["gram"])

    rows = docs.count()
    some = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < math.ceil(1_000_000 * SAMPLE / max(rows, 1))) if rows > SAMPLE else docs.select("text")
    # dealt over so many tasks that none counts the n-grams of more than a few hundred texts
    counts = some.distinct().repartition(math.ceil(SAMPLE / SAMPLE_AT_ONCE)).mapInArrow(frugal(task), "gram long").groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FREQUENT)
    told = counts.orderBy(F.desc("n"), "gram").limit(TOLD).toArrow()
    hashes, n_texts = told.column("gram").to_numpy().view(np.uint64), told.column("n").to_numpy()
    order = np.argsort(hashes)
    return hashes[order], n_texts[order]


def _prefix(set_: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], threshold: float) -> np.ndarray:
    """The rarest n-grams of a sorted set, in one order for all sets; sets at the threshold share one in their prefixes."""
    size = len(set_) - math.ceil(threshold * len(set_) - 1e-9) + 1
    hashes, counts = frequent
    if len(hashes):
        at = np.minimum(np.searchsorted(hashes, set_), len(hashes) - 1)
        set_ = set_[np.argsort(np.where(hashes[at] == set_, counts[at], 0), kind="stable")]
    return set_[:size]


def _parities(set_: np.ndarray) -> bytes:
    """One bit for each of 2^k, and as many as n-grams at least, remainders of hashes: whether the number of n-grams that have it is odd."""
    width = max(64, 1 << (len(set_) - 1).bit_length())
    return np.packbits((np.bincount((set_ & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).astype(np.uint8), bitorder="little").tobytes()


def signatures(docs: DataFrame, n: int = N, bands: int | None = None, rows: int = ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, tid, grams, bands, parities, prefix): the text's digest, how many distinct n-grams it has, its band hashes and parities, binary, and its rarest n-grams.

    Only one of the equal texts that a task sees soon after one another has a prefix.
    """
    bands = bands or band_count(threshold, rows=rows)
    frequent = frequent_grams(docs, n)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = WordNumbers()
        seen: set[bytes] = set()
        for batch in batches:
            sets = list(_sets(raw_texts(batch.column(2)), n, numbers))
            some = [i for i, s in enumerate(sets) if len(s)]
            hashes: list[bytes | None] = [None] * len(sets)
            for i, row in zip(some, _bands([sets[i] for i in some], bands, rows) if some else ()):
                hashes[i] = row.tobytes()
            if len(seen) > 500_000:
                seen.clear()
            prefixes = []
            for tid, s in zip(batch.column(1).to_pylist(), sets):
                prefixes.append(s[:0] if tid in seen or not len(s) else _prefix(s, frequent, threshold))
                seen.add(tid)
            ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            parities = pa.array([_parities(s) if len(s) else None for s in sets], pa.binary())
            prefix = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*prefixes, np.zeros(0, np.uint64)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(hashes, pa.binary()), parities, prefix], names=["doc_id", "tid", "grams", "bands", "parities", "prefix"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("tid"), "text")
    return slim.mapInArrow(frugal(task), "doc_id long, tid binary, grams long, bands binary, parities binary, prefix array<long>")


def _pairs(starts: np.ndarray, side: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(group, i, j): pairs of small groups at once as group -1, of large groups one by one.

    side is 2 in a group of one block, which has all its pairs; in a group of two it tells the blocks
    apart, and the group has the pairs across them only.
    """
    sizes = np.diff(starts)
    for g in np.flatnonzero(sizes > 8):
        at = np.arange(starts[g], starts[g + 1])
        if side[at[0]] == 2:
            i, j = at[np.stack(np.triu_indices(len(at), 1))]
        else:
            i, j = np.meshgrid(at[side[at] == 0], at[side[at] == 1], indexing="ij")
        yield int(g), i.ravel(), j.ravel()
    for size in range(2, 9):
        first = starts[:-1][sizes == size]
        if len(first):
            a, b = np.triu_indices(size, 1)
            i, j = (first[:, None] + a).ravel(), (first[:, None] + b).ravel()
            keep = (side[i] == 2) | (side[i] != side[j])
            yield -1, i[keep], j[keep]


def _near_sizes(grams_: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    return np.minimum(grams_[i], grams_[j]) >= threshold * np.maximum(grams_[i], grams_[j]) - 1e-9


def _owned(bands: np.ndarray, band: np.ndarray, grams_: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs belong to this band, and may reach the threshold by their numbers of n-grams."""
    ok = _near_sizes(grams_, i, j, threshold)
    out = np.zeros(len(i), bool)
    for at in range(0, len(i), 1 << 16):
        k = np.flatnonzero(ok[at : at + (1 << 16)]) + at
        same = bands[i[k]] == bands[j[k]]
        out[k] = same.argmax(1) == band[i[k]]
    return out


def _apart(part: np.ndarray, place: np.ndarray, grams_: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs, of different parts, may reach the threshold by sizes and places.

    place is the n-gram's in each prefix. If it is the first that both sets share, they share no more than it and
    what follows it in the shorter rest; a pair that is ruled out by a later n-gram is met at its first one.
    """
    ok = (part[i] != part[j]) & _near_sizes(grams_, i, j, threshold)
    rest = grams_ - place
    return ok & ((1 + threshold) * np.minimum(rest[i], rest[j]) >= threshold * (grams_[i] + grams_[j]) - 1e-6)


def _no_band(bands: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs share no band."""
    return np.concatenate([np.zeros(0, bool)] + [~(bands[i[at : at + (1 << 16)]] == bands[j[at : at + (1 << 16)]]).any(1) for at in range(0, len(i), 1 << 16)])


def _alike(parities: list[bytes], grams_: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs may reach the threshold by parities: each that differs shows an n-gram that one set has only."""
    words = np.array([len(p) // 8 for p in parities], int)
    width = np.minimum(words[i], words[j])
    out = np.zeros(len(i), bool)
    for w in np.unique(width).tolist():
        k = np.flatnonzero(width == w)
        own, at = np.unique(np.concatenate([i[k], j[k]]), return_inverse=True)
        # wider ones are folded: remainders by half the width have the sum of two
        table = np.stack([np.bitwise_xor.reduce(np.frombuffer(parities[x], np.uint64).reshape(-1, w), axis=0) for x in own])
        a, b, step = at[: len(k)], at[len(k) :], max(1, (1 << 20) // w)
        for start in range(0, len(k), step):
            x, y = a[start : start + step], b[start : start + step]
            differ = np.bitwise_count(table[x] ^ table[y]).sum(1, dtype=np.int64)
            out[k[start : start + step]] = (1 + threshold) * differ <= (1 - threshold) * (grams_[own[x]] + grams_[own[y]]) + 1e-6
    return out


def _intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sorted sets, for pairs of few sets: by matrix products over shared n-grams."""
    own, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    if len(i) < 16:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)], int)
    flat = np.concatenate([sets[k] for k in own])
    row = np.repeat(np.arange(len(own)), [len(sets[k]) for k in own])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    shared = count[column] > 1
    row, column = row[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    product = np.zeros((len(own), len(own)), np.float32)
    for start in range(0, int(number[-1]) + 1, COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        block = np.zeros((len(own), COLUMNS), np.float32)
        block[row[a:b], column[a:b] - start] = 1
        product += block @ block.T
    return product[at[: len(i)], at[len(i) :]].astype(int)


def _linked(sets: list[np.ndarray], size: np.ndarray, starts: np.ndarray, g: int, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of a group of _pairs are links."""
    if g < 0:
        both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)], int)
    else:
        both = _intersections(sets[starts[g] : starts[g + 1]], i - starts[g], j - starts[g])
    return both >= threshold * (size[i] + size[j] - both) - 1e-9


def _dealt(members: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(columns, task, side) of members, which have a block out of so many `blocks` of their key: a task for each pair of a key's blocks."""
    # block x meets every block: as the first of a pair with later ones, as the second with earlier ones
    return members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        *columns, F.xxhash64(key, F.least("block", "other"), F.greatest("block", "other")).alias("task"), F.when(F.col("block") == F.col("other"), 2).otherwise((F.col("block") > F.col("other")).cast("int")).alias("side")
    )


def _by_task(df: DataFrame) -> DataFrame:
    return df.repartition("task").sortWithinPartitions("task")


def _class_sets(wanted: DataFrame, classes: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """(tid, set): the n-grams of one text of each class in wanted (tid)."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = WordNumbers()
        for batch in batches:
            sets = [s.tobytes() for s in _sets(raw_texts(batch.column(1)), n, numbers)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["tid", "set"])

    texts = docs.select(F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("tid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    # few of them don't make all texts travel
    wanted = checked_broadcast(stored(wanted.join(classes.select("tid", F.col("doc_id").alias("first_id")), "tid").withColumnRenamed("tid", "w_tid"), "wanted"), WANTED_BYTES)
    texts = texts.join(wanted, (F.col("tid") == F.col("w_tid")) & F.col("doc_id").eqNullSafe(F.col("first_id"))).dropDuplicates(["tid"])
    return texts.select("tid", "text").mapInArrow(frugal(whole), "tid binary, set binary")


def link_classes(classes: DataFrame, docs: DataFrame, n: int = N, threshold: float = THRESHOLD, bands: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Links between the classes (tid, doc_id, copies, grams, bands) of docs.

    Returns (tid, links, classes): documents, and classes, that a class's documents link with, other than its own; and
    a spanning forest (a, b) of the links. Only pairs that share a band are met.
    """
    bands = bands or band_count(threshold)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int64).reshape(-1, bands)
            take = pa.array(np.repeat(np.arange(len(h)), bands))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(np.tile(np.arange(bands, dtype=np.int32), len(h))), pa.array(h.ravel())], names=["tid", "band", "bucket"])

    some = classes.where("grams > 0")
    met = some.select("tid", "copies", "grams", "bands").mapInArrow(frugal(explode), "tid binary, band int, bucket long")
    # buckets of several classes, and into how many blocks each is cut
    full = stored(met.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("bucket", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "buckets")
    members = met.join(full, "bucket").withColumn("block", F.pmod(F.xxhash64("tid"), F.col("blocks")).cast("int"))
    members = _dealt(members, "bucket", ["tid", "band"])
    members = stored(members, "members")
    dealt = members.join(some.select("tid", "grams", "bands"), "tid")

    def need(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "task", ROWS_AT_ONCE):
            keys, side, band, size = (t.column(c).to_numpy() for c in ("task", "side", "band", "grams"))
            h = np.frombuffer(b"".join(t.column("bands").to_pylist()), np.uint64).reshape(-1, bands)
            wanted = np.zeros(len(keys), bool)
            for _, i, j in _pairs(group_starts(keys), side):
                own = _owned(h, band, size, i, j, threshold)
                wanted[i[own]] = wanted[j[own]] = True
            took = t.select(["tid", "band", "task", "side"]).filter(pa.array(wanted))
            yield from took.to_batches()

    with arrow_rows(docs.sparkSession, ROWS_AT_ONCE):
        needed = stored(_by_task(dealt.select("tid", "band", "task", "side", "grams", "bands")).mapInArrow(frugal(need), "tid binary, band int, task long, side int"), "needed")

    sets = _class_sets(needed.select("tid").distinct(), classes, docs, n).join(classes.select("tid", "copies", "bands"), "tid")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "task", 512):
            keys, side, band, copies = (t.column(c).to_numpy() for c in ("task", "side", "band", "copies"))
            tids = t.column("tid").combine_chunks()
            sets = [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]
            size = np.array([len(s) for s in sets])
            h = np.frombuffer(b"".join(t.column("bands").to_pylist()), np.uint64).reshape(-1, bands)
            links, others, near = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), []
            starts = group_starts(keys)
            for g, i, j in _pairs(starts, side):
                own = _owned(h, band, size, i, j, threshold)
                i, j = i[own], j[own]
                if not len(i):
                    continue
                linked = _linked(sets, size, starts, g, i, j, threshold)
                i, j = i[linked], j[linked]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                others += np.bincount(np.concatenate([i, j]), minlength=len(keys))
                near.append((i, j))
            a, b = (np.concatenate(x) for x in zip(*near)) if near else (np.zeros(0, int), np.zeros(0, int))
            root = forest(a, b, len(keys))
            own = np.flatnonzero((links > 0) | (root != np.arange(len(keys))))
            yield pa.RecordBatch.from_arrays([tids.take(pa.array(own)), tids.take(pa.array(root[own])), pa.array(links[own]), pa.array(others[own])], names=["a", "b", "links", "classes"])

    joined = needed.join(sets, "tid").select("tid", "band", "task", "side", "set", "copies", "bands")
    with arrow_rows(docs.sparkSession, ROWS_AT_ONCE):
        found = stored(_by_task(joined).mapInArrow(frugal(verify), "a binary, b binary, links long, classes long"), "links")
    return found.groupBy(F.col("a").alias("tid")).agg(F.sum("links").alias("links"), F.sum("classes").alias("classes")), found.where("a <> b").select("a", "b")


def missed_links(classes: DataFrame, rows: DataFrame, docs: DataFrame, links: DataFrame, roots: DataFrame, n: int = N, threshold: float = THRESHOLD, bands: int | None = None) -> DataFrame:
    """(a, b), each link once, of the classes that share no band; rows are signatures, links and roots what the bands found."""
    bands = bands or band_count(threshold)
    some = classes.where("grams > 0").select("tid", F.xxhash64("tid").alias("cid"), "grams")
    # components of which all pairs are met, and those of them that have pairs without a link
    inside = roots.select(F.col("node").alias("tid"), "root").join(links, "tid")
    whole = inside.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.sum("classes").alias("ends"))
    whole = whole.where((F.col("size") <= BLOCK) | (F.col("ends") * PAIRS_A_LINK >= F.col("size") * (F.col("size") - 1)))
    inside = stored(inside.select("tid", "root").join(whole, "root").join(some.select("tid", "grams"), "tid"), "inside")
    sparse = inside.where(F.col("ends") < F.col("size") * (F.col("size") - 1))
    sparse = sparse.select("tid", "grams", F.xxhash64(F.lit("root"), "root").alias("key"), F.xxhash64("tid").alias("part"), F.lit(0).alias("place"), F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))

    # n-grams that stand in the prefixes of several classes, and then of several parts
    placed = rows.where("size(prefix) > 0").select(F.xxhash64("tid").alias("cid"), F.posexplode("prefix").alias("place", "gram"))
    gram = Window.partitionBy("gram")
    shared = placed.withColumns({"low": F.min("cid").over(gram), "high": F.max("cid").over(gram)}).where("low < high").select("gram", "cid", "place")
    shared = stored(shared, "shared").distinct()
    part = some.join(inside.select("tid", "root"), "tid", "left").select("tid", "cid", "grams", F.xxhash64(F.coalesce("root", "tid")).alias("part"))
    across = shared.join(part, "cid").withColumns({"low": F.min("part").over(gram), "high": F.max("part").over(gram), "size": F.count(F.lit(1)).over(gram)}).where("low < high")
    across = across.select("tid", "grams", F.xxhash64(F.lit("gram"), "gram").alias("key"), "part", "place", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))

    members = sparse.unionByName(across).withColumn("block", F.pmod(F.xxhash64("tid"), F.col("blocks")).cast("int"))
    dealt = _dealt(members, "key", ["tid", "part", "place", "grams"])

    def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "task"):
            keys, side, part, place, size = (t.column(c).to_numpy() for c in ("task", "side", "part", "place", "grams"))
            wanted = np.zeros(len(keys), bool)
            for _, i, j in _pairs(group_starts(keys), side):
                own = _apart(part, place, size, i, j, threshold)
                wanted[i[own]] = wanted[j[own]] = True
            yield from t.filter(pa.array(wanted)).to_batches()

    kept = "tid binary, part long, place int, grams long, task long, side int"
    columns = ["tid", "part", "place", "grams", "task", "side"]
    met = stored(_by_task(dealt.select(columns)).mapInArrow(frugal(may), kept), "members")

    def need(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "task", ROWS_AT_ONCE):
            keys, side, part, place, size = (t.column(c).to_numpy() for c in ("task", "side", "part", "place", "grams"))
            h = np.frombuffer(b"".join(t.column("bands").to_pylist()), np.uint64).reshape(-1, bands)
            parities = t.column("parities").to_pylist()
            wanted = np.zeros(len(keys), bool)
            for _, i, j in _pairs(group_starts(keys), side):
                for hold in (lambda i, j: _apart(part, place, size, i, j, threshold), lambda i, j: _no_band(h, i, j), lambda i, j: _alike(parities, size, i, j, threshold)):
                    own = hold(i, j)
                    i, j = i[own], j[own]
                wanted[i] = wanted[j] = True
            yield from t.select(columns).filter(pa.array(wanted)).to_batches()

    with arrow_rows(docs.sparkSession, ROWS_AT_ONCE):
        needed = stored(_by_task(met.join(classes.select("tid", "bands", "parities"), "tid").select(*columns, "bands", "parities")).mapInArrow(frugal(need), kept), "needed")
    sets = _class_sets(needed.select("tid").distinct(), classes, docs, n).join(classes.select("tid", "bands"), "tid")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "task", 512):
            keys, side, part, place, size = (t.column(c).to_numpy() for c in ("task", "side", "part", "place", "grams"))
            tids = t.column("tid").combine_chunks()
            sets = [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]
            h = np.frombuffer(b"".join(t.column("bands").to_pylist()), np.uint64).reshape(-1, bands)
            starts = group_starts(keys)
            for g, i, j in _pairs(starts, side):
                own = _apart(part, place, size, i, j, threshold)
                i, j = i[own], j[own]
                own = _no_band(h, i, j)
                i, j = i[own], j[own]
                if len(i):
                    linked = _linked(sets, size, starts, g, i, j, threshold)
                    yield pa.RecordBatch.from_arrays([tids.take(pa.array(x[linked])) for x in (i, j)], names=["a", "b"])

    joined = needed.join(sets, "tid").select(*columns, "set", "bands")
    with arrow_rows(docs.sparkSession, ROWS_AT_ONCE):
        found = stored(_by_task(joined).mapInArrow(frugal(verify), "a binary, b binary"), "missed")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per row of docs (doc_id, text): class_id, component_id, n_links, kept.

    class_id is the smallest doc_id of an equal text; component_id the smallest doc_id reachable over links;
    n_links how many other rows a row links with, equal texts included; kept is true for the rows whose
    doc_id is component_id. `first` marks one row, of the rows of a component that are kept.
    """
    bands = band_count(threshold, recall)
    with arrow_rows(docs.sparkSession, ROWS_AT_ONCE):
        rows = stored(signatures(docs, n, bands, threshold=threshold), "signatures")
    classes = rows.groupBy("tid", "doc_id").agg(F.count(F.lit(1)).alias("copies"), F.first("grams").alias("grams"), F.first("bands").alias("bands"), F.first("parities").alias("parities"))
    classes = stored(classes.groupBy("tid").agg(F.min("doc_id").alias("doc_id"), F.sum("copies").alias("copies"), F.first("grams").alias("grams"), F.first("bands").alias("bands"), F.first("parities").alias("parities")), "classes")
    links, edges = link_classes(classes, docs, n, threshold, bands)
    roots = components(edges)
    missed = stored(missed_links(classes, rows, docs, links, roots, n, threshold, bands), "missed")
    if missed.limit(1).count():
        ends = stored(missed.unionByName(missed.select(F.col("b").alias("a"), F.col("a").alias("b"))), "ends")
        # components that a missed link joins: links between roots, and nodes that had none are their own
        known = roots.unionByName(ends.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct().join(roots, "node", "left_anti"))
        known = stored(known, "known")
        joined = missed.join(known.toDF("a", "root_a"), "a").join(known.toDF("b", "root_b"), "b")
        up = components(joined.select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))).toDF("root", "top")
        roots = known.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        ends = ends.join(classes.select(F.col("tid").alias("b"), "copies"), "b").select(F.col("a").alias("tid"), F.col("copies").alias("links"))
        links = links.select("tid", "links").unionByName(ends).groupBy("tid").agg(F.sum("links").alias("links"))
    links = links.select("tid", "links")
    ids = classes.select(F.col("tid").alias("node"), "doc_id")
    groups = stored(roots.join(ids, "node"), "roots")
    lowest = groups.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    grouped = groups.join(lowest, "root").select(F.col("node").alias("tid"), "component_id")
    about = classes.select("tid", F.col("doc_id").alias("class_id"), "copies", "grams").join(grouped, "tid", "left").join(links, "tid", "left")
    about = about.where((F.col("copies") > 1) | F.col("component_id").isNotNull()).withColumnRenamed("grams", "c_grams")
    lone = F.col("grams") == 0
    out = rows.select("doc_id", "tid", "grams").join(about, "tid", "left")
    class_id = F.when(lone, F.col("doc_id")).otherwise(F.coalesce("class_id", "doc_id"))
    component_id = F.when(lone, F.col("doc_id")).otherwise(F.coalesce("component_id", "class_id", "doc_id"))
    n_links = F.when(lone, F.lit(0)).otherwise(F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1)
    return out.select("doc_id", class_id.alias("class_id"), component_id.alias("component_id"), n_links.cast("long").alias("n_links"), F.col("doc_id").eqNullSafe(component_id).alias("kept"), F.hex("tid").alias("text_md5"))


def keep_one(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The rows of docs that stay: of each group of near-duplicates the one with the smallest doc_id."""
    found = near_duplicates(docs, n, threshold, recall)
    kept = found.where("kept").groupBy("doc_id", "text_md5").agg(F.count(F.lit(1)).alias("times"), F.max("n_links").alias("linked"))
    kept = kept.select(F.col("doc_id").alias("__m_id"), F.col("text_md5").alias("__m_md5"), "times", "linked").withColumnsRenamed({"times": "__m_times", "linked": "__m_linked"})
    text = F.hex(F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    joined = docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("__m_id")) & (text == F.col("__m_md5")))
    once = joined.where((F.col("__m_times") == 1) | (F.col("__m_linked") == 0)).select(*docs.columns)
    # rows that share both id and text: one of them stays
    again = joined.where((F.col("__m_times") > 1) & (F.col("__m_linked") > 0))
    again = again.withColumn("__m_row", F.row_number().over(Window.partitionBy("__m_id", "__m_md5").orderBy(*[F.col(c).cast("string") for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(1)]))).where("__m_row = 1")
    return once.unionByName(again.select(*docs.columns))

"""Embedding near-dedup by product quantisation: inverted lists, residual codes, table lookups, exact rerank.

1. Equal vectors become one class, by a sum before any join. Classes of every length are linked on their own.
2. A bounded sample (SAMPLE) trains the coarse centroids of unit vectors, finer centroids of what they leave
   over, and one codebook for each subspace of the residuals. A list is a pair of a coarse and a fine centroid,
   so that their number grows with the vectors while both kinds stay few. Every vector is assigned, coded, and
   given its probes, the lists nearest to it. Their number is the least that covers RECALL of pairs at the very
   threshold, made from vectors of the sample that the training didn't see; a pair is covered if either vector
   probes the other's list.
3. Queries and members meet in tasks of one block of each, so that a list of any size is split. Distances
   between a query and coded members come from the query's table of distances to the codewords. A member's
   own coding error bounds how far that may be off, so candidates are all members whose looked-up distance
   is within the radius plus that error; then the cosine is computed exactly.
4. Of a task leave the classes' numbers of links and a spanning forest of the links, whose connected
   components are the groups. A pair that meets in both directions counts once for either side.

Edge cases: vectors that are null, zero, or hold null or non-finite components link with nothing, equal ones
of them too; vectors of different lengths have no cosine and don't link; a null vec_id is kept; repeated rows
are copies of one another; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercadia.llm._arrays import forest, group_starts, whole_groups
from mercadia.llm._common import stored
from mercadia.llm.components import components

THRESHOLD = 0.9
#: Share of pairs at the threshold that the probes must cover, measured on the sample.
RECALL = 0.999
#: Most vectors that training sees.
SAMPLE = 16_384
#: Vectors of a list on average, most coarse centroids, and most fine ones.
LIST_SIZE, COARSE, FINE = 512, 2048, 1024
SUBSPACES, CODEWORDS = 8, 256
QUERIES, MEMBERS = 1024, 2048
#: Distances that coding holds at once.
AT_ONCE = 1 << 21


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), np.finfo(float).tiny)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances between rows of x and of c, less the rows' own squares."""
    return (c * c).sum(1) - 2 * x @ c.T


def _means(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _squared(x, c).argmin(1)
        count = np.bincount(near, minlength=len(c))
        sums = np.stack([np.bincount(near, x[:, d], len(c)) for d in range(x.shape[1])], 1)
        c[count > 0] = sums[count > 0] / count[count > 0, None]
    return c


class Quantiser:
    """Coarse and fine centroids, residual codebooks, and the number of probes that covers pairs at the threshold."""

    def __init__(self, sample: np.ndarray, lists: int, threshold: float, recall: float):
        train, rest = (sample, sample) if len(sample) < 64 else (sample[len(sample) // 8 :], sample[: len(sample) // 8])
        self.coarse = _means(train, max(1, min(COARSE, len(train) // 8, lists)), 1)
        left = train - self.coarse[self._nearest(train, self.coarse)]
        many = min(FINE, len(train) // 8, -(-lists // len(self.coarse)))
        self.fine = _means(left, many, 99) if many > 1 else np.zeros((1, train.shape[1]))
        left = left - self.fine[self._nearest(left, self.fine)]
        self.cuts = np.array_split(np.arange(train.shape[1]), min(SUBSPACES, train.shape[1]))
        self.books = [_means(left[:, cut], CODEWORDS, 2 + i) for i, cut in enumerate(self.cuts)]
        # partners exactly at the threshold, in random directions
        x = rest[:2000]
        y = np.random.default_rng(7).normal(size=x.shape)
        y -= (y * x).sum(1, keepdims=True) * x
        norm = np.sqrt((y * y).sum(1, keepdims=True))
        y = threshold * x + np.sqrt(1 - threshold**2) * y / np.where(norm > 0, norm, 1)
        # how many coarse centroids must be looked into, and then how many lists probed
        share = 1 - (1 - recall) / (2 if len(self.fine) > 1 else 1)
        self.wide = len(self.coarse)
        self.wide = self._least(_squared(x, self.coarse), _squared(y, self.coarse), share, len(self.coarse))
        lists_x, lists_y = self._lists(x), self._lists(y)
        place = lambda lists, own: np.where((lists == own[:, None]).any(1), (lists == own[:, None]).argmax(1), lists.shape[1])
        ranks = np.sort(np.minimum(place(lists_x, lists_y[:, 0]), place(lists_y, lists_x[:, 0])))
        self.probes = min(lists_x.shape[1], int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) + 1)

    @staticmethod
    def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        step = max(1, AT_ONCE // len(c))
        return np.concatenate([_squared(x[i : i + step], c).argmin(1) for i in range(0, len(x), step)])

    @staticmethod
    def _least(dx: np.ndarray, dy: np.ndarray, share: float, most: int) -> int:
        """How many nearest centroids of one vector must be taken to meet the other's nearest, for a share of pairs."""
        at = np.arange(len(dx))
        rank = lambda d, j: (d < d[at, j][:, None]).sum(1)
        ranks = np.sort(np.minimum(rank(dx, dy.argmin(1)), rank(dy, dx.argmin(1))))
        return min(most, int(ranks[min(len(ranks) - 1, int(np.ceil(share * len(ranks))))]) + 1)

    def _lists(self, x: np.ndarray) -> np.ndarray:
        """The lists of the nearest coarse centroids, nearest first; a vector's own list is that of its nearest coarse one."""
        out, fine = [], len(self.fine)
        step = max(1, AT_ONCE // max(len(self.coarse), self.wide * fine))
        for i in range(0, len(x), step):
            part = x[i : i + step]
            d = _squared(part, self.coarse)
            near = np.argpartition(d, self.wide - 1, axis=1)[:, : self.wide]
            near = np.take_along_axis(near, np.take_along_axis(d, near, 1).argsort(1, kind="stable"), 1)
            if fine == 1:
                out.append(near)
                continue
            far = np.take_along_axis(d, near, 1)[:, :, None] + (self.fine * self.fine).sum(1) - 2 * ((part @ self.fine.T)[:, None] - (self.coarse @ self.fine.T)[near])
            own = far[:, 0].argmin(1)
            far[np.arange(len(part)), 0, own] = -np.inf
            order = far.reshape(len(part), -1).argsort(1, kind="stable")
            out.append(np.take_along_axis(near, order // fine, 1) * fine + order % fine)
        return np.concatenate(out)

    def centre(self, lists: np.ndarray) -> np.ndarray:
        return self.coarse[lists // len(self.fine)] + self.fine[lists % len(self.fine)]

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lists to probe, nearest first; codes; and coding errors."""
        probes = self._lists(x)[:, : self.probes].astype(np.int32)
        residual = x - self.centre(probes[:, 0])
        codes = np.stack([self._nearest(residual[:, cut], book) for cut, book in zip(self.cuts, self.books)], 1).astype(np.uint8)
        error = sum(((residual[:, cut] - book[codes[:, i]]) ** 2).sum(1) for i, (cut, book) in enumerate(zip(self.cuts, self.books)))
        return probes, codes, np.sqrt(error)

    def looked_up(self, x: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances between queries and the coded members of one list."""
        residual = x - self.centre(np.array([cell]))
        out = np.zeros((len(x), len(codes)), np.float32)
        for i, (cut, book) in enumerate(zip(self.cuts, self.books)):
            part = residual[:, cut]
            table = ((part * part).sum(1)[:, None] + _squared(part, book)).astype(np.float32)
            out += table.take(codes[:, i], axis=1)
        return out


def _matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    """Unit vectors of doubles from the bytes of vectors of `size` components, which are floats or doubles."""
    rows = column.to_pylist()
    return _unit(np.frombuffer(b"".join(rows), np.dtype(f"f{len(rows[0]) // size}")).reshape(len(rows), size).astype(float))


def _keyed(vectors: DataFrame) -> DataFrame:
    """(vec_id, key, dim, vec): the bytes of vectors; null where a vector links with nothing."""
    narrow = vectors.schema["embedding"].dataType.elementType.simpleString() == "float"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, dims, vecs = [], [], []
            for v in batch.column(1):
                x = None if not v.is_valid or not len(v) or v.values.null_count else v.values.to_numpy(zero_copy_only=False)
                ok = x is not None and bool(np.isfinite(x).all()) and bool(x.any())
                data = (x + x.dtype.type(0)).tobytes() if ok else None
                keys.append(hashlib.md5(data).digest() if ok else None)
                dims.append(len(x) if ok else None)
                vecs.append(data)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(vecs, pa.binary())], names=["vec_id", "key", "dim", "vec"])

    slim = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if narrow else "array<double>").alias("embedding"))
    return slim.mapInArrow(task, "vec_id long, key binary, dim int, vec binary")


def link(classes: DataFrame, size: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """Links between classes (key, copies, vec) of one length: (key, links), and a spanning forest (a, b)."""
    spark = classes.sparkSession
    sample = _matrix(classes.select("key", "vec").orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("vec").toArrow()["vec"], size)
    shipped = spark.sparkContext.broadcast(Quantiser(sample, max(1, -(-classes.count() // LIST_SIZE)), threshold, recall))
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Quantiser = shipped.value
        for batch in batches:
            if batch.num_rows:
                probes, codes, error = q.code(_matrix(batch.column(2), size))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(probes), pa.list_(pa.int32())), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)], names=["key", "copies", "vec", "probes", "codes", "error"])

    coded = stored(classes.select("key", "copies", "vec").mapInArrow(code, "key binary, copies long, vec binary, probes array<int>, codes binary, error double"), "coded")
    members = coded.withColumn("cell", F.col("probes")[0])
    queries = coded.withColumn("cell", F.explode("probes"))
    n_m = members.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("m_blocks"))
    n_q = queries.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("q_blocks"))
    cells = stored(n_m.join(n_q, "cell"), "cells")

    def dealt(rows: DataFrame, side: int, own: str, other: str) -> DataFrame:
        block = F.pmod(F.xxhash64("key"), F.col(own)).cast("int")
        rows = rows.join(cells, "cell").withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        m, q = ("own", "other") if side else ("other", "own")
        # a query needs its own list, a member all of its probes
        probes = F.col("probes") if side else F.slice("probes", 1, 1)
        coded = [F.col(c) if side else F.lit(None).cast(t).alias(c) for c, t in (("codes", "binary"), ("error", "double"))]
        return rows.select(F.xxhash64("cell", m, q).alias("task"), F.lit(side).alias("side"), "cell", "key", "copies", "vec", probes.alias("probes"), *coded)

    both = dealt(members, 1, "m_blocks", "q_blocks").unionByName(dealt(queries, 0, "q_blocks", "m_blocks"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Quantiser = shipped.value
        for t in whole_groups(batches, "task", 512):
            tasks, side, cell, copies, error = (t.column(c).to_numpy() for c in ("task", "side", "cell", "copies", "error"))
            keys = t.column("key").combine_chunks()
            vec, listed = _matrix(t.column("vec"), size), t.column("probes").to_pylist()
            own = np.array([p[0] for p in listed])
            members = np.flatnonzero(side == 1)
            probes, codes = np.zeros((len(tasks), q.probes), np.int32), np.zeros((len(tasks), len(q.cuts)), np.uint8)
            if len(members):
                probes[members] = [listed[i] for i in members]
                codes[members] = np.frombuffer(b"".join(t.column("codes").filter(pa.array(side == 1)).to_pylist()), np.uint8).reshape(len(members), -1)
            _, same = np.unique(np.array(keys.to_pylist(), object), return_inverse=True)
            links, near = np.zeros(len(tasks), np.int64), []
            starts = group_starts(tasks)
            for a, b in zip(starts[:-1], starts[1:]):
                mine = np.arange(a, b)
                x, y = mine[side[a:b] == 0], mine[side[a:b] == 1]
                if not len(x) or not len(y):
                    continue
                d = np.sqrt(np.maximum(q.looked_up(vec[x], cell[a], codes[y]), 0))
                i, j = np.nonzero(d <= (radius + error[y] + 1e-4)[None])
                i, j = x[i], y[j]
                keep = same[i] != same[j]
                i, j = i[keep], j[keep]
                cosine = np.concatenate([np.einsum("ij,ij->i", vec[i[s : s + 65536]], vec[j[s : s + 65536]]) for s in range(0, len(i), 65536)] or [np.zeros(0)])
                ok = cosine >= threshold
                i, j = i[ok], j[ok]
                # the member meets the query again if it probes the query's list
                again = (probes[j] == own[i, None]).any(1)
                np.add.at(links, i, copies[j])
                np.add.at(links, j[~again], copies[i[~again]])
                near.append((i, j))
            i, j = (np.concatenate(z) for z in zip(*near)) if near else (np.zeros(0, int), np.zeros(0, int))
            # the two rows of a class in a table are one node
            i, j = same[i], same[j]
            root = forest(i, j, int(same.max()) + 1)
            first = np.zeros(len(root), int)
            first[same[::-1]] = np.arange(len(same))[::-1]
            total = np.bincount(same, links, len(root)).astype(np.int64)
            some = np.flatnonzero((total > 0) | (root != np.arange(len(root))))
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(first[some])), keys.take(pa.array(first[root[some]])), pa.array(total[some])], names=["a", "b", "links"])

    found = stored(both.repartition("task").sortWithinPartitions("task").mapInArrow(compare, "a binary, b binary, links long"), "links")
    return found.groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links")), found.where("a <> b").select("a", "b")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per row of vectors (vec_id, embedding): vec_id, n_links, component_id, kept."""
    rows = stored(_keyed(vectors), "vectors")
    classes = rows.where("key is not null").groupBy("key", "dim").agg(F.min("vec_id").alias("class_id"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec"))
    classes = stored(classes, "classes")
    # a length is linked by jobs of its own; one of a single class has nothing to link
    sizes = [r["dim"] for r in classes.groupBy("dim").count().where("count > 1").orderBy("dim").collect()]
    if not sizes:
        links, edges = classes.select("key", F.lit(0).cast("long").alias("links")).limit(0), classes.select(F.col("key").alias("a"), F.col("key").alias("b")).limit(0)
    for i, size in enumerate(sizes):
        more, pairs = link(classes.where(F.col("dim") == size), size, threshold, recall)
        links, edges = (more, pairs) if not i else (links.unionByName(more), edges.unionByName(pairs))
    roots = stored(components(edges).join(classes.select(F.col("key").alias("node"), "class_id"), "node"), "roots")
    lowest = roots.groupBy("root").agg(F.min("class_id").alias("component"))
    grouped = roots.join(lowest, "root").select(F.col("node").alias("key"), "component")
    about = classes.select("key", "class_id", "copies").join(grouped, "key", "left").join(links, "key", "left").where((F.col("copies") > 1) | F.col("component").isNotNull())
    component = F.coalesce("component", "class_id", "vec_id")
    n_links = F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1
    return rows.select("vec_id", "key").join(about, "key", "left").select("vec_id", n_links.cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))

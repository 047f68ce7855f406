"""Names against price tables: candidates, then three tiers of similarity behind locks.

Pairs are of distinct normal names of one price table, so a name that a million items share is scored once.
`exact` deals both sides of a table over blocks of bounded size, and a task meets one block of each: there pairs whose letters
and words can't reach the cut are left out, the others scored in numpy (functions.ratios), and of each quoted name the best of
the block leave the task.

`indexed` finds the same without Python and without meeting all pairs. A set ratio has two sources, and each has an index:

* long shared words. If the shared words are to be long enough against the shorter name, a pair must share one of that
  name's rarest words: so many that what the others could add falls short. Those are joined with inverted lists of words.
* letters in the same order. No common subsequence is longer than the letters both have, whose counts are packed in bigints and
  compared inside the join, which lets only pairs pass that may reach the bound.

The pairs of the first index are scored first. What is then the CANDIDATES-best ratio of a quoted name is the bound of
the second: below it no pair can be a candidate any more. A table whose pairs are many is dealt over tasks by a hash of the quoted names.
`blocked` pairs only names that share a word: a lossy search; compare its recall before use. Nothing is a
cross join: all are equi-joins on the table's id, and on a word or a share.

Columns in: items (table_id, name), prices (table_id, name, price, row_no). Names are normal forms already.
Out: one row a distinct (table_id, name) of items that found a price: price, kind, matched.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from mercadia.functions import ratios
from mercadia.functions.names import BrandRules, first_word, longest_brand, name_features
from mercadia.functions.similarity import may_reach, profiled, set_ratio, sort_ratio
from mercadia.operators.locks import Lock, blocked, knowledge, light_locks, strict_locks
from mercadia.operators.recognise import recognise

#: Candidates of an item, and the least token-set ratio of one; a feature of the search.
CANDIDATES, CUT_OFF = 40, 55.0
TIER_1, TIER_2, TIER_3 = 0.82, 0.65, 0.62
#: Pairs of one table that are compared in a task.
SHARE = 1_000_000
#: About how many names of a table a block has.
NAMES = 2_048
#: Sides are compared as doubles: this much below a bound still counts as reaching it.
SLACK = 1e-9


def _table_rows(prices: DataFrame) -> DataFrame:
    """(table_id, name, price, row_no): of rows with one name the first in the table."""
    return prices.where("name <> ''").groupBy("table_id", "name").agg(F.min_by("price", "row_no").alias("price"), F.min("row_no").alias("row_no"))


def _quoted(items: DataFrame) -> DataFrame:
    return items.where("name <> ''").select("table_id", F.col("name").alias("quoted")).distinct()


def pairs(items: DataFrame, prices: DataFrame, mode: str = "exact") -> DataFrame:
    """(table_id, quoted, name, price, row_no): with `exact` all pairs of a table, with `blocked` those that share a word."""
    quoted, rows = _quoted(items), _table_rows(prices)
    if mode == "exact":
        return _dealt(quoted, rows, F.lit(True))
    if mode != "blocked":
        raise ValueError("mode is exact or blocked")
    left = quoted.withColumn("word", F.explode(F.array_distinct(F.split("quoted", " "))))
    right = rows.withColumn("word", F.explode(F.array_distinct(F.split("name", " "))))
    return left.join(right, ["table_id", "word"]).drop("word").distinct()


def _by(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to all partitions: rows that make many pairs are few, and would else be put together by their size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to all cores, few rows too: the work on each of them is long."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8), *keys)


def every_pair(items: DataFrame, prices: DataFrame) -> DataFrame:
    """All pairs of each table with both names profiled, as q and n."""
    return _dealt(profiled(_quoted(items), "quoted", "q"), profiled(_table_rows(prices), "name", "n"), F.lit(True))


def _dealt(quoted: DataFrame, rows: DataFrame, condition: Column) -> DataFrame:
    """The pairs of each table that meet condition, which the join itself tests.

    A table of many pairs has several shares of quoted names, each with all of the table's rows.
    """
    sizes = quoted.groupBy("table_id").agg(F.count(F.lit(1)).alias("n")).join(rows.groupBy("table_id").agg(F.count(F.lit(1)).alias("m")), "table_id")
    shares = sizes.select("table_id", F.ceil(F.col("n") * F.col("m") / SHARE).alias("shares"))
    left = quoted.join(shares, "table_id").withColumn("share", F.pmod(F.xxhash64("quoted"), F.col("shares"))).drop("shares")
    right = rows.join(shares, "table_id").withColumn("share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shares") - 1))).drop("shares")
    right = right.withColumnsRenamed({"table_id": "__t", "share": "__s"})
    left, right = _by(left, "table_id", "share"), _by(right, "__t", "__s")
    return left.join(right, (F.col("table_id") == F.col("__t")) & (F.col("share") == F.col("__s")) & condition).drop("__t", "__s", "share")


def in_blocks(quoted: DataFrame, rows: DataFrame, work: Callable[[ratios.Block, str], tuple[np.ndarray | None, dict[str, np.ndarray]]], **out) -> DataFrame:
    """(table_id, quoted, the columns of rows, and those of out): what work finds for each quoted name in each block of rows.

    work returns the numbers of the rows it found, or None for one row of sums without the columns of rows. `out`: its columns
    with their types.
    """
    many = lambda of, c: F.greatest(F.ceil(c / of), F.lit(1))
    sizes = quoted.groupBy("table_id").agg(F.count(F.lit(1)).alias("n")).join(rows.groupBy("table_id").agg(F.count(F.lit(1)).alias("m")), "table_id")
    shares = sizes.select("table_id", many(NAMES, F.col("m")).alias("__of_n"), "n", "m").withColumn("__of_q", many(SHARE, F.col("n") * F.col("m") / F.col("__of_n"))).drop("n", "m")
    places = lambda of: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(of) - 1))
    dealt = lambda df, own, name, other: df.join(shares, "table_id").withColumn(own, F.pmod(F.xxhash64(name), F.col(f"__of{own[1:]}"))).withColumn(other, places(f"__of{other[1:]}")).drop("__of_q", "__of_n")
    left, right = dealt(quoted, "__q", "quoted", "__n"), dealt(rows, "__n", "name", "__q")
    kept = [c for c in rows.columns if c != "table_id"]
    single = [f for f in rows.schema if f.name in kept]
    sums = "names" in out
    schema = StructType([quoted.schema["table_id"], quoted.schema["quoted"], *([] if sums else single), *[StructField(c, t) for c, t in out.items()]])

    def task(a: pa.Table, b: pa.Table) -> pa.Table:
        asked, found = a.column("quoted").to_pylist(), b.select(kept).combine_chunks()
        parts = []
        for at, block in ratios.blocks(found.column("name").to_pylist()) if asked and len(found) else ():
            for k, name in enumerate(asked):
                which, values = work(block, name)
                n = 1 if which is None else len(which)
                if n:
                    held = [] if which is None else found.take(pa.array(at[which])).columns
                    parts.append(pa.table([a.column(c).take(pa.array(np.full(n, k))) for c in ("table_id", "quoted")] + held + [pa.array(v) for v in values.values()], names=schema.names))
        if not parts:
            return pa.table({c: a.column(c).slice(0, 0) for c in ("table_id", "quoted")} | {c: found.column(c).slice(0, 0) for c in kept if not sums} | {c: pa.array([], pa.int64() if t == LongType() else pa.float64()) for c, t in out.items()})
        return pa.concat_tables(parts).combine_chunks()

    right = right.withColumnsRenamed({"table_id": "__t", "__q": "__rq", "__n": "__rn"})
    by = lambda df, *keys: _by(df, *keys).groupBy(*keys)
    return by(left, "table_id", "__q", "__n").cogroup(by(right, "__t", "__rq", "__rn")).applyInArrow(task, schema)


def ratio_sums(items: DataFrame, prices: DataFrame) -> DataFrame:
    """(table_id, quoted, names, by_set, by_sort, best): both ratios, in thousandths, with all names of the table summed, and the best set ratio."""

    def thousandths(ratio: np.ndarray) -> np.ndarray:
        whole = np.floor(ratio * 1000)
        return (whole + (ratio * 1000 - whole >= 0.5)).astype(np.int64)

    def work(block: ratios.Block, name: str) -> tuple[None, dict[str, np.ndarray]]:
        s, o = thousandths(block.set_ratios(name)), thousandths(block.sort_ratios(name))
        return None, {"names": np.array([len(s)]), "by_set": np.array([s.sum()]), "by_sort": np.array([o.sum()]), "best": np.array([s.max()])}

    found = in_blocks(_quoted(items), _table_rows(prices), work, names=LongType(), by_set=LongType(), by_sort=LongType(), best=LongType())
    return found.groupBy("table_id", "quoted").agg(*[F.sum(c).alias(c) for c in ("names", "by_set", "by_sort")], F.max("best").alias("best"))


def _best_of_blocks(quoted: DataFrame, rows: DataFrame) -> DataFrame:
    """(table_id, quoted, name, price, row_no, set, sort): the CANDIDATES best pairs of each quoted name in each block, from CUT_OFF up."""

    def work(block: ratios.Block, name: str) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        which = block.reachable(name, CUT_OFF)
        by_set = block.set_ratios(name, which)
        near = by_set >= CUT_OFF
        which, by_set = which[near], by_set[near]
        if len(which) > CANDIDATES:
            # all that are as good as the last: of equal ones the first in the table count, which is decided over all blocks
            last = np.partition(by_set, -CANDIDATES)[-CANDIDATES]
            which, by_set = which[by_set >= last], by_set[by_set >= last]
        return which, {"set": by_set, "sort": block.sort_ratios(name, which)}

    return in_blocks(quoted, rows, work, set=DoubleType(), sort=DoubleType())


def _needed(words: DataFrame, name: str, p: str) -> DataFrame:
    """The words of which a pair must share one, if its shared words are to reach CUT_OFF against this, the shorter, name.

    What is left out are a name's most frequent words, as long as all of them together fall short.
    """
    share = (CUT_OFF - SLACK) / (200.0 - CUT_OFF + SLACK)
    often = Window.partitionBy("table_id", name).orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    together = F.sum(F.length("word") + 1).over(often) - 1
    return words.withColumn("together", together).where(F.col("together") >= share * F.col(f"{p}_size")).drop("together")


def sharing(quoted: DataFrame, rows: DataFrame) -> DataFrame:
    """All pairs whose shared words alone may reach CUT_OFF, some of them several times. Both sides are profiled."""
    held = rows.withColumn("word", F.explode("n_words"))
    counts = held.groupBy("table_id", "word").agg(F.count(F.lit(1)).alias("n"))
    asked = quoted.withColumn("word", F.explode("q_words"))
    few = lambda words, name, p: _needed(words.join(counts, ["table_id", "word"]), name, p).select("table_id", name, "word")
    by_quoted = asked.join(few(asked.select("table_id", "quoted", "q_size", "word"), "quoted", "q"), ["table_id", "quoted", "word"])
    by_name = held.join(few(held.select("table_id", "name", "n_size", "word"), "name", "n"), ["table_id", "name", "word"])
    met = lambda a, b: _by(a, "table_id", "word").join(_by(b, "table_id", "word"), ["table_id", "word"])
    return met(by_quoted, held).where("q_size <= n_size").unionByName(met(asked, by_name).where("n_size < q_size"))


def alike(quoted: DataFrame, rows: DataFrame) -> DataFrame:
    """All pairs whose letters may reach `bound`, a column of quoted. Both sides are profiled."""
    return _dealt(quoted, rows, may_reach("q", "n", F.col("bound") - SLACK))


def _scored(found: DataFrame) -> DataFrame:
    """(table_id, quoted, name, price, row_no, set, sort) of the pairs from CUT_OFF up, each once.

    Pairs are scored where they are made: what the ratios need of two names is many times as long as the names. A filter on
    the ratio would be worked out apart from the column, so the ratio passes through an array that is empty below.
    """
    kept = F.filter(F.array(set_ratio("q", "n")), lambda s: s >= CUT_OFF)
    near = found.withColumn("set", F.explode(kept))
    return near.select("table_id", "quoted", "name", "price", "row_no", "set", sort_ratio("q", "n").alias("sort")).distinct()


def _ranked(scored: DataFrame) -> DataFrame:
    order = Window.partitionBy("table_id", "quoted").orderBy(F.desc("set"), "row_no")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= CANDIDATES)


def candidates(items: DataFrame, prices: DataFrame, mode: str = "exact") -> DataFrame:
    """The CANDIDATES best pairs of each quoted name by token-set ratio, from CUT_OFF up, with score from 0 to 1."""
    if mode == "exact":
        return _ranked(_best_of_blocks(_quoted(items), _table_rows(prices))).withColumn("score", F.greatest("set", "sort") / 100).drop("sort")
    # both indexes and both scorings read the profiles; kept in memory or on disk, they are worked out once a name
    quoted, rows = profiled(_quoted(items), "quoted", "q").persist(), profiled(_table_rows(prices), "name", "n").persist()
    if mode == "indexed":
        first = _ranked(_scored(sharing(quoted, rows)))
        bounds = first.where(F.col("rank") == CANDIDATES).select("table_id", "quoted", F.col("set").alias("bound"))
        bounded = quoted.join(bounds, ["table_id", "quoted"], "left").fillna({"bound": CUT_OFF})
        # what isn't among the first CANDIDATES of its index can't be among those of both
        scored = _scored(alike(bounded, rows)).union(first.drop("rank")).distinct()
    else:
        near = pairs(items, prices, mode).select("table_id", "quoted", "name")
        scored = _scored(near.join(quoted, ["table_id", "quoted"]).join(rows, ["table_id", "name"]))
    return _ranked(scored).withColumn("score", F.greatest("set", "sort") / 100).drop("sort")


def with_locks(found: DataFrame, rules: BrandRules, known: DataFrame | None = None) -> DataFrame:
    """Candidates with the flags strict and light: whether locks of either kind block the pair.

    Features are worked out once a distinct name, in a row of their own so that no field is worked out apart, and joined to the pairs. With a knowledge table (see
    operators.recognise) both kinds also block pairs whose recognised products conflict.
    """
    names = _spread(found.select(F.explode(F.array("quoted", "name")).alias("n")).distinct(), "n")
    if known is None:
        featured = names.select("n", F.explode(F.array(name_features(F.col("n"), rules))).alias("features"))
    else:
        fields = ("category", "brand", "flavour", "fragrance", "line", "confidence")
        products = recognise(names.select(F.col("n").alias("text")), known).select(F.col("text").alias("n"), F.struct(*fields).alias("product"))
        featured = names.join(products, "n", "left").select("n", F.explode(F.array(name_features(F.col("n"), rules).withField("product", F.col("product")))).alias("features"))
    featured = featured.persist()
    out = found.join(featured.select(F.col("n").alias("quoted"), F.col("features").alias("fa")), "quoted").join(featured.select(F.col("n").alias("name"), F.col("features").alias("fb")), "name")
    strict = blocked(F.col("fa"), F.col("fb"), strict_locks(rules))
    light = blocked(F.col("fa"), F.col("fb"), light_locks(rules))
    if known is not None:
        conflict = F.coalesce(knowledge(F.col("fa.product"), F.col("fb.product")), F.lit(False))
        strict, light = strict | conflict, light | conflict
    return out.withColumns({"strict": strict, "light": light}).drop("fa", "fb")


def blocked_pairs(items: DataFrame, prices: DataFrame, locks: dict[str, Lock], rules: BrandRules) -> DataFrame:
    """(lock, pairs): how many distinct pairs of names that some table holds each lock blocks.

    Names with equal features that stand in the same tables are one row with their number, and a pair of such rows is asked
    once, in the first table of both: pairs are made where the features are and none is shuffled.
    """

    features = name_features(F.col("name"), rules).alias("f")

    def told(names: DataFrame, name: str, p: str) -> DataFrame:
        held = _spread(names.groupBy(F.col(name).alias("name")).agg(F.sort_array(F.collect_set("table_id")).alias(f"{p}_tables")), "name").select(f"{p}_tables", features)
        return held.groupBy(f"{p}_tables", F.col("f").alias(name)).agg(F.count(F.lit(1)).alias(f"{p}_n")).select("*", F.explode(f"{p}_tables").alias("table_id")).persist()

    a, b = told(_quoted(items), "quoted", "q"), told(prices.where("name <> ''").select("table_id", "name"), "name", "n")
    first = F.array_min(F.array_intersect("q_tables", "n_tables")) == F.col("table_id")
    met = _dealt(a, b, first).select((F.col("q_n") * F.col("n_n")).alias("n"), F.array(*[F.coalesce(lock(F.col("quoted"), F.col("name")), F.lit(False)) for lock in locks.values()]).alias("flags"))
    counts = met.groupBy("flags").agg(F.sum("n").alias("n")).agg(*[F.coalesce(F.sum(F.when(F.col("flags")[i], F.col("n"))), F.lit(0)).alias(lock) for i, lock in enumerate(locks)])
    return counts.select(F.explode(F.create_map(*[x for lock in locks for x in (F.lit(lock), F.col(lock))])).alias("lock", "pairs"))


def tier_of(score: Column, strict: Column, light: Column, same_category: Column, brand_ok: Column) -> Column:
    """The tier that accepts a candidate, or null."""
    return (
        F.when((score >= TIER_1) & ~strict, F.lit(1))
        .when((score >= TIER_2) & ~light, F.lit(2))
        .when((score >= TIER_3) & ~strict & same_category & brand_ok, F.lit(3))
    )


def match_names(items: DataFrame, prices: DataFrame, rules: BrandRules = BrandRules(), mode: str = "exact", known: DataFrame | None = None) -> DataFrame:
    """The best candidate of the first tier that accepts any; of equal scores the one that ranks first.

    A candidate's tier doesn't depend on the others', so one aggregate by (tier, score, rank) replaces a
    cascade of joins.
    """
    found = candidates(items, prices, mode).persist()
    brands = found.select("quoted").distinct().withColumn("brand", longest_brand(F.col("quoted"), rules))
    found = with_locks(found, rules, known).join(brands, "quoted")
    same = first_word(F.col("quoted")) == first_word(F.col("name"))
    has_brand = (F.col("brand") == "") | F.contains(F.concat(F.lit(" "), F.col("name"), F.lit(" ")), F.concat(F.lit(" "), F.col("brand"), F.lit(" ")))
    tiers = found.withColumn("tier", tier_of(F.col("score"), F.col("strict"), F.col("light"), same, has_brand))
    # a filter on the tier would ask the locks apart from the column; without an order a row isn't the best
    order = F.when(F.col("tier").isNotNull(), F.struct("tier", -F.col("score"), "rank"))
    best = tiers.groupBy("table_id", "quoted").agg(F.min_by(F.struct("tier", "score", "name", "price"), order).alias("b")).where("b IS NOT NULL")
    label = F.concat(F.when(F.col("b.tier") == 3, F.lit("APROX ")).otherwise(F.lit("SIMILAR ")), F.floor(F.col("b.score") * 100).cast("string"), F.lit("%"))
    return best.select("table_id", F.col("quoted").alias("name"), F.col("b.price").alias("price"), label.alias("kind"), F.col("b.name").alias("matched"))


def word_overlap(items: DataFrame, prices: DataFrame, most: int = 150, least_letters: int = 4) -> DataFrame:
    """Rows of each table ranked by how many of the items' longer words they contain, the first `most` of them.

    items and prices: (table_id, name), prices also row_no. A price name counts a word if the word is one of
    its own words.
    """
    words = items.select("table_id", F.explode(F.split(F.upper("name"), r"\s+")).alias("word")).where(F.length("word") >= least_letters).distinct()
    rows = prices.select("table_id", "row_no", "name", F.explode(F.array_distinct(F.split(F.upper("name"), r"\s+"))).alias("word"))
    hits = rows.join(words.withColumn("hit", F.lit(1)), ["table_id", "word"], "left").groupBy("table_id", "row_no", "name").agg(F.count("hit").alias("hits"))
    order = Window.partitionBy("table_id").orderBy(F.desc("hits"), "row_no")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)

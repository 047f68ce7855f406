"""Mixing sources to target weights by a min-cost flow over membership patterns.

A document may belong to several sources. Documents are summed up by their set of sources; words flow
from these patterns to the sources' quotas. The first copy of a pattern's words costs 0, the second 1, and
so on, so that repeats are used only where first copies cannot fill the quotas. Up to MAX_NODES patterns the
flow is solved on the driver. Beyond that targets are found by sums over the table of sources, and the flow
in tasks of one connected component of sources and patterns each, with equal results; documents of one source
make components of one pattern. Documents never go to either: a pattern's share becomes whole copies of all
its documents and a cut in a seeded order, which is found by sums over hash buckets and an exact order within
the one bucket that holds the cut.

Edge cases: a null text has size 0; a null source is a source of its own, last in order; repeated rows are
documents of their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercadia.llm._common import NOT_SPACE, count_matches, stored
from mercadia.llm.components import components

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2
SEED = 20240607
#: Buckets of the seeded order of a pattern; the cut falls into one, which alone is sorted.
BUCKETS = 4096
#: Most membership patterns whose flow is solved on the driver.
MAX_NODES = 20_000


def targets(sizes: dict, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> dict:
    """Source to target: share of all sizes by repeating weights, none above cap times its own size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left, free = {}, share * sum(sizes.values()), list(order)
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > cap * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        out |= {s: float(cap * sizes[s]) for s in over}
        left = max(0.0, left - sum(out[s] for s in over))
        free = [s for s in free if s not in out]
    return out


def flow(patterns: dict[tuple, int], quotas: dict, copies: int = CAP) -> dict[tuple, int]:
    """Words taken from each pattern: the largest flow into the quotas, and the cheapest of those.

    A pattern's k-th copy costs k - 1 a word. All paths of one cost are used up before dearer ones open,
    by breadth-first augmentation; flow already sent may be turned to other sources but is never undone.
    """
    of_source: dict = {}
    for p in patterns:
        for s in p:
            of_source.setdefault(s, []).append(p)
    sent = {p: dict.fromkeys(p, 0) for p in patterns}
    supplied = dict.fromkeys(patterns, 0)
    left = {s: int(quotas[s]) for s in of_source}
    for k in range(1, copies + 1):
        for p in sorted(patterns, key=lambda p: (len(p), [(s is None, s or "") for s in p])):
            while (room := k * patterns[p] - supplied[p]) > 0:
                came: dict = {("p", p): None}
                todo, end = deque([("p", p)]), None
                while todo and end is None:
                    kind, x = node = todo.popleft()
                    if kind == "p":
                        near = [("s", s) for s in x]
                    else:
                        if left[x] > 0:
                            end = node
                            break
                        near = [("p", q) for q in of_source[x] if sent[q][x] > 0]
                    for y in near:
                        if y not in came:
                            came[y] = node
                            todo.append(y)
                if end is None:
                    break
                path, node = [], end
                while node:
                    path.append(node)
                    node = came[node]
                path.reverse()
                amount = min([room, left[end[1]]] + [sent[b[1]][a[1]] for a, b in zip(path[1::2], path[2::2])])
                for a, b in zip(path, path[1:]):
                    if a[0] == "p":
                        sent[a[1]][b[1]] += amount
                    else:
                        sent[b[1]][a[1]] -= amount
                supplied[p] += amount
                left[end[1]] -= amount
    return supplied


def _plan_here(patterns: DataFrame, weights: tuple[float, ...], share: float, copies: int) -> DataFrame:
    """(p_sources, source_size, target, taken) of few patterns (sources, words)."""
    words = {tuple(r["sources"]): r["words"] for r in patterns.collect()}
    sizes: dict = {}
    for p, n in words.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    goal = targets(sizes, weights, share, copies)
    taken = flow(words, goal, copies)
    rows = [(list(p), sizes[p[0]] if p else 0, float(goal[p[0]]) if p else 0.0, taken[p]) for p in words]
    return patterns.sparkSession.createDataFrame(rows, "p_sources array<string>, source_size long, target double, taken long")


def spread_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, size, target): `targets` of a table of sources (source, size). A task ranks the sources; the rest are sums."""
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), place % len(weights) + 1)
    state = stored(sizes.select("source", "size", weight.alias("weight"), F.lit(None).cast("double").alias("target")), "targets")
    left = share * (state.agg(F.sum("size")).first()[0] or 0)
    while True:
        free = state.where("target IS NULL")
        total = free.agg(F.sum("weight")).first()[0]
        if not total:
            return state.drop("weight")
        part, most = F.lit(left) * F.col("weight") / F.lit(total), F.lit(float(cap)) * F.col("size")
        over = free.where(part > most).agg(F.sum(most)).first()[0]
        if over is None:
            return state.select("source", "size", F.coalesce("target", part).alias("target"))
        state = stored(state.withColumn("target", F.coalesce("target", F.when(part > most, most))), "targets")
        left = max(0.0, left - over)


def _plan_spread(patterns: DataFrame, weights: tuple[float, ...], share: float, copies: int) -> DataFrame:
    """The same of any number of patterns: a flow for each connected component of sources and patterns."""
    name = lambda s: F.coalesce(F.concat(F.lit("s"), F.md5(s)), F.lit("s"))
    listed = stored(patterns.select(F.concat(F.lit("p"), F.md5(F.to_json(F.struct("sources")))).alias("pattern"), "sources", "words"), "patterns")
    pairs = listed.select("pattern", "words", F.posexplode_outer("sources").alias("place", "source")).where("place IS NOT NULL")
    goal = stored(spread_targets(pairs.groupBy("source").agg(F.sum("words").alias("size")), weights, share, copies), "goals")
    near = pairs.join(goal, pairs["source"].eqNullSafe(goal["source"])).select("pattern", "place", goal["source"], "size", "target")
    about = near.groupBy("pattern").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "size", "target"))), lambda x: F.struct(x["size"].alias("size"), x["target"].alias("target"))).alias("goals"))
    roots = components(pairs.select(F.col("pattern").alias("a"), name(F.col("source")).alias("b"))).select(F.col("node").alias("pattern"), "root")
    given = stored(listed.join(about, "pattern").join(roots, "pattern"), "components")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        words = {tuple(p): int(w) for p, w in zip(pdf["sources"], pdf["words"])}
        quotas = {s: g["target"] for p, goals in zip(pdf["sources"], pdf["goals"]) for s, g in zip(p, goals)}
        taken = flow(words, quotas, copies)
        return pd.DataFrame({"p_sources": pdf["sources"], "source_size": [g[0]["size"] for g in pdf["goals"]], "target": [g[0]["target"] for g in pdf["goals"]], "taken": [taken[tuple(p)] for p in pdf["sources"]]})

    schema = "p_sources array<string>, source_size long, target double, taken long"
    solved = given.select("root", "sources", "words", "goals").groupBy("root").applyInPandas(solve, schema)
    none = listed.where("size(sources) = 0").select(F.col("sources").alias("p_sources"), F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("taken"))
    return stored(solved.unionByName(none), "plan")


def mix(docs: DataFrame, sources: Column | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, copies: int = CAP, seed: int = SEED, here: int = MAX_NODES) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, sources.

    sources: an array of a document's sources; by default the one in its column source. source_size and
    target are those of the first of them. A document in several sources counts fully in each.
    """
    members = F.array("source") if sources is None else sources
    sized = stored(
        docs.select(
            "doc_id",
            count_matches(F.col("text"), NOT_SPACE).alias("size"),
            F.array_sort(F.array_distinct(members)).alias("sources"),
        ).withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "size")).withColumn("bucket", F.pmod(F.shiftright("h", 40), F.lit(BUCKETS)).cast("int")),
        "mix",
    )
    sums = sized.groupBy("sources", "bucket").agg(F.sum("size").alias("words"))
    patterns = sized.groupBy("sources").agg(F.sum("size").alias("words"))
    solved = (_plan_here if patterns.count() <= here else _plan_spread)(patterns, weights, share, copies)
    plan = solved.join(patterns, F.col("p_sources").eqNullSafe(F.col("sources"))).select(
        "p_sources",
        "source_size",
        "target",
        *[F.coalesce(F.expr(e), F.lit(0)).alias(c) for e, c in (("CASE WHEN words > 0 THEN taken div words END", "full"), ("CASE WHEN words > 0 THEN taken % words END", "rest"))],
    )
    same = F.col("sources").eqNullSafe(F.col("p_sources"))
    up_to = F.sum("words").over(Window.partitionBy("sources").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    # the bucket in which the running sum passes the rest, and what of the rest is left on entering it
    cut = (
        sums.withColumn("up_to", up_to)
        .join(plan.select("p_sources", "rest"), same)
        .where((F.col("up_to") > F.col("rest")) & (F.col("up_to") - F.col("words") <= F.col("rest")))
        .groupBy("p_sources")
        .agg(F.min(F.struct("bucket", (F.col("rest") - F.col("up_to") + F.col("words")).alias("left"))).alias("cut"))
    )
    full_plan = plan.join(cut, "p_sources", "left").select("p_sources", "source_size", "target", "full", F.coalesce("cut.bucket", F.lit(BUCKETS)).alias("cut"), F.coalesce("cut.left", F.lit(0)).alias("left"))
    laid = sized.join(full_plan, same)
    out = lambda df, extra: df.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("full") + extra.cast("long"))).alias("taken"), "sources")
    order = Window.partitionBy("sources").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    # within the cut, a document is in if that comes at least as near to the share as leaving it out
    sorted_cut = laid.where(F.col("bucket") == F.col("cut")).withColumn("run", F.sum("size").over(order))
    return out(laid.where(F.col("bucket") != F.col("cut")), F.col("bucket") < F.col("cut")).unionByName(out(sorted_cut, F.col("run") * 2 - F.col("size") <= F.col("left") * 2))

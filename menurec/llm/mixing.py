"""Mixing overlapping sources to target weights by min-cost flow (operator 1).

1. Documents are aggregated by membership pattern: the set of sources they
   belong to.  Only one row per pattern (tokens) reaches the driver.
2. A flow network routes token capacity: each pattern offers its tokens once
   at cost 0, once more at cost 1, and so on (convex repetition costs), and may
   send to the quotas of its sources.  The cheapest largest flow is found by
   augmenting shortest paths, cost level by cost level.
3. Documents are laid on a line per pattern in seeded hash order; the flow says
   how often the whole line is taken and how far the last, partial round goes.
   The part of the line that a partial round takes ends between documents; one
   more document, the best fit, closes the gap.

The line positions need no single-task running total: words are summed per
(pattern, hash bucket), the few bucket sums are accumulated, and only the
bucket that holds the cut is ordered document by document.

Defined cases: a null source is a source of its own, ordered last; a null or
empty text has size 0 and is taken 0 words; repeated rows are separate
documents; equal hashes are ordered by doc_id, then size; an empty table gives
an empty result; extra columns are ignored.  Patterns are limited to
``MAX_PATTERNS`` (an error beyond it), which bounds the driver's share.
"""

from __future__ import annotations

import json
from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from menurec.llm.common import materialised, n_words

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEATS = 2
MAX_PATTERNS = 100_000
BUCKETS = 4096


def source_targets(sizes: dict[str | None, int], weights=WEIGHTS, share: float = SHARE, repeats: int = MAX_REPEATS) -> dict[str | None, float]:
    """Targets by source: ``share`` of all words dealt by weight, none above
    ``repeats`` times its size; the excess is dealt again among the others."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), list(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        want = {s: left * weight[s] / total for s in open_}
        over = [s for s in open_ if want[s] > repeats * sizes[s]]
        if not over:
            out.update(want)
            break
        for s in over:
            out[s] = float(repeats * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def cheapest_flow(supply: list[int], members: list[list[int]], quotas: list[int], repeats: int) -> list[dict[int, int]]:
    """Flow per pattern and source that fills the quotas as far as possible at
    the lowest repetition cost.

    ``supply[p]`` words at cost 0, as many at cost 1, ...  Costs sit on the
    supply edges only, so shortest paths come in order of cost level: the flow
    of a level is saturated before the next level opens.
    """
    flow: list[dict[int, int]] = [dict.fromkeys(m, 0) for m in members]
    inside: list[list[int]] = [[] for _ in quotas]
    for p, m in enumerate(members):
        for s in m:
            inside[s].append(p)
    room = list(quotas)
    spare = [0] * len(supply)
    for _ in range(repeats):
        spare = [a + b for a, b in zip(spare, supply)]
        while True:
            # breadth first from patterns with spare words, over residual edges, to quotas with room
            came_s: dict[int, int] = {}
            came_p: dict[int, int | None] = {p: None for p, x in enumerate(spare) if x > 0}
            queue, goal = deque(came_p), None
            while queue and goal is None:
                p = queue.popleft()
                for s in members[p]:
                    if s in came_s:
                        continue
                    came_s[s] = p
                    if room[s] > 0:
                        goal = s
                        break
                    for q in inside[s]:
                        if q not in came_p and flow[q][s] > 0:
                            came_p[q] = s
                            queue.append(q)
            if goal is None:
                break
            path, s = [], goal
            while True:
                p = came_s[s]
                path.append((p, s))
                if came_p[p] is None:
                    break
                s = came_p[p]
            first = path[-1][0]
            amount = min(room[goal], spare[first], *(flow[p][came_p[p]] for p, _ in path if came_p[p] is not None))
            for p, s in path:
                flow[p][s] += amount
                if came_p[p] is not None:
                    flow[p][came_p[p]] -= amount
            room[goal] -= amount
            spare[first] -= amount
    return flow


def mix(docs: DataFrame, memberships: Column, size: Column, targets: dict[str | None, float],
        keep: tuple[str, ...] = ("doc_id",), repeats: int = MAX_REPEATS, seed: int = 11) -> DataFrame:
    """``keep``, ``pattern`` (JSON list of the sources), ``size``, ``copies`` and
    ``taken`` (copies * size) for every row of ``docs``.  ``keep[0]`` breaks ties."""
    spark = docs.sparkSession
    names = list(targets)
    place = F.xxhash64(F.lit(seed), keep[0], "size")
    slim = materialised(docs.select(*keep, F.to_json(F.array_sort(F.array_distinct(memberships))).alias("pattern"), size.cast("bigint").alias("size"))
                        .withColumn("place", place).withColumn("bucket", F.pmod("place", F.lit(BUCKETS)).cast("int")))
    patterns = slim.groupBy("pattern").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(patterns) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns; merge small sources first")
    patterns = sorted((r["pattern"], r["size"]) for r in patterns)
    index = {s: i for i, s in enumerate(names)}
    members = [[index[s] for s in json.loads(p) if s in index] for p, _ in patterns]
    flow = cheapest_flow([n for _, n in patterns], members, [round(targets[s]) for s in names], repeats)
    plan = [(p, sum(f.values()) // n if n else 0, sum(f.values()) % n if n else 0) for (p, n), f in zip(patterns, flow)]
    rounds = F.broadcast(spark.createDataFrame(plan, "pattern string, whole int, rest bigint"))  # at most MAX_PATTERNS rows

    # words before each bucket of a pattern: at most BUCKETS rows per pattern meet in a window
    ahead = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = materialised(slim.groupBy("pattern", "bucket").agg(F.sum("size").alias("words"))
                           .withColumn("before", F.coalesce(F.sum("words").over(ahead), F.lit(0))))
    # the bucket of each pattern that holds the cut: one row per pattern
    cut = (buckets.join(rounds, "pattern").filter("before <= rest and rest < before + words")
           .select("pattern", F.col("bucket").alias("cut"), "before"))
    state = F.broadcast(materialised(rounds.join(cut, "pattern", "left")))
    placed = slim.join(state, "pattern")
    tie = ["place", *(c for c in keep), "size"]
    upto = Window.partitionBy("pattern").orderBy(*tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = (placed.filter("bucket = cut").withColumn("upto", F.col("before") + F.sum("size").over(upto))
            .withColumn("extra", (F.col("upto") <= F.col("rest")).cast("int")))
    rest = placed.filter("cut is null or bucket <> cut").withColumn("extra", F.when(F.col("bucket") < F.col("cut"), 1).otherwise(0))
    columns = [*slim.columns, "whole", "rest", "extra"]
    chosen = materialised(edge.select(*columns).unionByName(rest.select(*columns)))
    # the gap that is left, and the document outside that fits it best
    gaps = chosen.groupBy("pattern").agg((F.max("rest") - F.sum(F.col("extra") * F.col("size"))).alias("gap"))
    gaps = F.broadcast(materialised(gaps))  # one row per pattern
    miss = F.abs(F.col("size") - F.col("gap"))
    fit = (chosen.filter("extra = 0 and size > 0").join(gaps, "pattern").filter(miss < F.col("gap"))
           .groupBy("pattern").agg(F.min(F.struct(miss.alias("miss"), *tie)).alias("best")))
    fit = F.broadcast(materialised(fit.select("pattern", *[F.col(f"best.{c}").alias(f"best_{c}") for c in dict.fromkeys(tie)])))
    same = F.lit(True)
    for c in dict.fromkeys(tie):
        same = same & F.col(c).eqNullSafe(F.col(f"best_{c}"))
    # rows repeated in all of these are told apart by a row number among the equal ones
    closed = chosen.join(fit, "pattern", "left").withColumn("hit", F.coalesce(same & (F.col("extra") == 0) & F.col("best_place").isNotNull(), F.lit(False)))
    twin = F.row_number().over(Window.partitionBy("pattern").orderBy(*tie))
    hits = closed.filter("hit").withColumn("extra", F.when(twin == 1, 1).otherwise(0))
    done = closed.filter("not hit").unionByName(hits)
    copies = (F.col("whole") + F.when(F.col("whole") < repeats, F.col("extra")).otherwise(0)).alias("copies")
    return done.select(*keep, "pattern", "size", copies).withColumn("taken", F.col("copies") * F.col("size"))


def mix_by_source(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), seed: int = 11) -> DataFrame:
    """Mix with one source per document: ``keep``, size, source_size, target, copies, taken."""
    spark = docs.sparkSession
    sized = materialised(docs.select(*keep, F.col("source").alias("__source"), n_words().alias("size")))
    totals = {r["__source"]: r["n"] for r in sized.groupBy("__source").agg(F.sum("size").alias("n")).limit(MAX_PATTERNS + 1).collect()}
    if len(totals) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} sources; merge small ones first")
    targets = source_targets(totals)
    mixed = mix(sized, F.array("__source"), F.col("size"), targets, keep=(*keep, "__source"), seed=seed)
    goals = F.broadcast(spark.createDataFrame([(s, n, targets[s]) for s, n in totals.items()], "__name string, source_size bigint, target double"))
    return (mixed.join(goals, F.col("__source").eqNullSafe(F.col("__name")), "left")
            .select(*keep, "size", "source_size", "target", "copies", F.col("taken").cast("bigint").alias("taken")))

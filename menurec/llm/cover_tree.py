"""Hard negatives by cover trees over norm-augmented vectors (operator 11).

Every vector gets one more component, so that all have the length of the
longest of its block.  Then the inner product with an anchor falls with the
distance, and if all points below a node lie within the radius r of its point
p, their scores lie within ``score(p) - |anchor| r`` and
``score(p) + |anchor| r``.

Rows are dealt by hash into blocks; each block becomes a cover tree whose nodes
halve the covering distance from level to level and carry the true covering
radius of what is below them and its label, if it is only one.  Anchors descend
best bound first.  A node is skipped if its bounds lie outside every open
window of scores, or if it holds no admitted label; every point that is reached
is scored exactly, in integers.  Descent ends when no bound left can enter a
list of the best.

1. Positives: the best ``n_positives`` other rows of the anchor's label.
2. Negatives: for each positive, the best ``n_negatives`` rows of other labels
   with a score of at least ``share`` percent of the positive's, and no larger.

Anchors and blocks meet in a grid (a stated query set against all rows, in
blocks); each cell returns its best rows, which a ranking window merges.

Defined cases: rows with a null id, label or vector, or with null or non-finite
components, take no part; shorter vectors count as padded with zeros; rows that
share an id stay apart (each is a row of its own); ties go to the smaller id; an
empty table, no anchor or no other row gives an empty result; components and
scores outside the long range stay at its end; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from menurec.llm.common import materialised
from menurec.llm.va_file import EXACT, matrix

TREE_ROWS = 4096
CELL_TREES = 4
ANCHOR_BLOCK = 2048
EXPAND = 64  # nodes opened at once
MIXED = np.iinfo(np.int64).min  # label of a node with several labels below it


def usable(vectors: DataFrame, scale: int) -> DataFrame:
    """(row, vec_id, label, ints): every usable row, numbered."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return (vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & finite)
            .select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("bigint").alias("vec_id"),
                    F.col("label").cast("bigint").alias("label"), F.transform(x, lambda v: F.floor(v * scale)).alias("ints")))


class CoverTree:
    """Nodes are points; a node's children lie side by side in ``kids``.

    ``radius`` is the largest distance to a point below the node, ``only`` the
    one label of the node and all below it, or ``MIXED``."""

    def __init__(self, points: np.ndarray, labels: np.ndarray):
        self.points = points.astype(float)
        norms = (self.points ** 2).sum(axis=1)
        lift = np.sqrt(np.maximum(norms.max(initial=0.0) - norms, 0.0))
        self.lifted = np.c_[self.points, lift]
        n = len(points)
        self.radius, self.only = np.zeros(n), labels.astype(np.int64).copy()
        self.first, self.n_kids = np.zeros(n, np.int64), np.zeros(n, np.int64)
        kids: list[np.ndarray] = []
        at = 0
        todo = [(0, np.arange(1, n))] if n else []
        while todo:
            node, below = todo.pop()
            if not len(below):
                continue
            away = self._distance(node, below)
            self.radius[node] = away.max()
            if not (labels[below] == labels[node]).all():
                self.only[node] = MIXED
            found = []
            # rings: what lies beyond half the covering distance gets children of its own, then the half, and so on
            while len(below):
                half = away.max() / 2
                near = away <= half if half > 0 else np.zeros(len(below), bool)
                ring = below[~near]
                while len(ring):
                    child = int(ring[0])
                    if half > 0:
                        close = self._distance(child, ring) <= half
                    else:
                        close = np.zeros(len(ring), bool)  # copies of the point are leaves
                    close[0] = True
                    found.append(child)
                    todo.append((child, ring[close][1:]))
                    ring = ring[~close]
                below, away = below[near], away[near]
            self.first[node], self.n_kids[node] = at, len(found)
            at += len(found)
            kids.append(np.array(found, np.int64))
        self.kids = np.concatenate(kids) if kids else np.empty(0, np.int64)

    def _distance(self, node: int, others: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.lifted[others] - self.lifted[node]) ** 2).sum(axis=1))

    def best(self, anchor: np.ndarray, ids: np.ndarray, admitted, lows, highs, k: int):
        """Per window (low, high) of scores: places and scores of the ``k`` best
        admitted points, larger scores and then smaller ids first.

        ``admitted`` is a pair of masks: the points, and the nodes with an
        admitted point at them or below."""
        is_in, may_hold = admitted
        length = np.sqrt((anchor ** 2).sum())
        slack = 1e-6 + 1e-9 * length * np.sqrt((self.points ** 2).sum(axis=1).max(initial=0.0))
        found = [(np.empty(0, np.int64), np.empty(0)) for _ in lows]
        floor = np.array(lows, float)
        highs = np.asarray(highs, float)
        front = np.zeros(0, np.int64)
        upper = lower = np.empty(0)
        fresh = np.zeros(min(1, len(ids)), np.int64)  # the root
        while True:
            scores = self.points[fresh] @ anchor
            for w in range(len(floor)):
                ok = is_in[fresh] & (scores >= floor[w]) & (scores <= highs[w])
                if ok.any():
                    at, s = np.r_[found[w][0], fresh[ok]], np.r_[found[w][1], scores[ok]]
                    order = np.lexsort((ids[at], -s))[:k]
                    found[w] = at[order], s[order]
                    if len(order) == k:
                        floor[w] = max(floor[w], s[order[-1]])
            deep = (self.n_kids[fresh] > 0) & may_hold[fresh]
            reach = length * self.radius[fresh[deep]] + slack
            front = np.r_[front, fresh[deep]]
            upper, lower = np.r_[upper, scores[deep] + reach], np.r_[lower, scores[deep] - reach]
            open_ = np.zeros(len(front), bool)
            for w in range(len(floor)):
                open_ |= (upper >= floor[w]) & (lower <= highs[w])
            front, upper, lower = front[open_], upper[open_], lower[open_]
            if not len(front):
                return found
            if len(front) > EXPAND:
                top = np.argpartition(-upper, EXPAND)
                now, rest = top[:EXPAND], top[EXPAND:]
            else:
                now, rest = np.arange(len(front)), np.empty(0, np.int64)
            node = front[now]
            many = self.n_kids[node]
            fresh = self.kids[np.repeat(self.first[node] - np.r_[0, many.cumsum()[:-1]], many) + np.arange(int(many.sum()))]
            front, upper, lower = front[rest], upper[rest], lower[rest]


def plain_best(points, anchor, ids, is_in, lows, highs, k):
    """The same by whole-number arithmetic, where doubles are no longer exact."""
    scores = [max(-2 ** 63, min(2 ** 63 - 1, int(s))) for s in points.astype(object) @ anchor.astype(object)]
    out = []
    for low, high in zip(lows, highs):
        fit = [i for i in np.flatnonzero(is_in).tolist() if low <= scores[i] <= high]
        fit = sorted(fit, key=lambda i: (-scores[i], ids[i]))[:k]
        out.append((np.array(fit, np.int64), [scores[i] for i in fit]))
    return out


class Block:
    """A tree with the rows it was built from."""

    def __init__(self, table: pa.Table, dims: int):
        self.rows, self.ids, self.labels = (table.column(c).to_numpy() for c in ("number", "id", "of"))
        self.points = matrix(table.column("point"), dims)
        self.tree = CoverTree(self.points, self.labels)
        self.top = float(np.abs(self.points.astype(float)).max(initial=0.0))

    def best(self, row: int, anchor: np.ndarray, label: int, same: bool, lows, highs, k: int):
        is_in = (self.labels == label) == same
        if same:
            own = np.flatnonzero(self.rows == row)
            is_in[own] = False
            may_hold = (self.tree.only == label) | (self.tree.only == MIXED)
        else:
            may_hold = self.tree.only != label
        if np.abs(anchor.astype(float)).max(initial=0.0) * self.top * max(1, len(anchor)) >= EXACT:
            return plain_best(self.points, anchor, self.ids, is_in, lows, highs, k)
        return self.tree.best(anchor.astype(float), self.ids, (is_in, may_hold), lows, highs, k)


def search(rows: DataFrame, anchors: DataFrame, same: bool, k: int, share: int, dims: int, down: int, across: int) -> DataFrame:
    """anchor, own, vec_id, score: the best ``k`` rows of each block per anchor row and window.

    ``anchors`` has row, label, ints and ``tops``: the upper ends of the
    windows (null: one window without ends)."""
    cell = lambda seed, m: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(m)).cast("int")
    across_cells = -(-across // CELL_TREES)
    candidates = (rows.select(F.col("row").alias("number"), F.col("vec_id").alias("id"), F.col("label").alias("of"), F.col("ints").alias("point"),
                              cell(2, across).alias("tree"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("down"))
                  .withColumn("across", (F.col("tree") / CELL_TREES).cast("int")))
    queries = (anchors.withColumn("i", cell(1, down))
               .withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(across_cells - 1)))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = ([], [], [], [])
        if left.num_rows and right.num_rows:
            vectors = matrix(left.column("ints"), dims)
            asked = list(zip(left.column("row").to_pylist(), left.column("label").to_pylist(), left.column("tops").to_pylist()))
            numbers = right.column("tree").to_numpy()
            for t in np.unique(numbers).tolist():
                block = Block(right.filter(pa.array(numbers == t)), dims)
                for (row, label, tops), vector in zip(asked, vectors):
                    if tops is None:
                        lows, highs = [-np.inf], [np.inf]
                    else:  # share * top <= 100 * score
                        lows, highs = [-(-share * s // 100) for s in tops], tops
                    for top, (at, scores) in zip([None] if tops is None else tops, block.best(row, vector, label, same, lows, highs, k)):
                        out[0].extend([row] * len(at))
                        out[1].extend([top] * len(at))
                        out[2].extend(block.ids[at].tolist())
                        out[3].extend(int(s) for s in scores)
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["row", "top", "vec_id", "score"])

    best = Window.partitionBy("row", "top").orderBy(F.desc("score"), "vec_id")
    return (queries.groupBy("i", "j").cogroup(candidates.groupBy("down", "across"))
            .applyInArrow(run, "row bigint, top bigint, vec_id bigint, score bigint")
            .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k))


def hard_negatives(vectors: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 5, share: int = 80, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, embedding and label; ``is_anchor`` is a condition on
    ``vec_id``.  ``share`` is the percentage of the positive's score that a
    negative reaches at least."""
    rows = materialised(usable(vectors, scale))
    dims, n, n_anchors = rows.agg(F.max(F.size("ints")), F.count("*"), F.count(F.when(is_anchor, 1))).first()
    dims, down, across = max(1, dims or 0), max(1, -(-n_anchors // ANCHOR_BLOCK)), max(1, -(-n // TREE_ROWS))
    anchors = rows.filter(is_anchor)
    asked = anchors.withColumn("tops", F.lit(None).cast("array<bigint>"))
    positives = materialised(search(rows, asked, True, n_positives, share, dims, down, across)
                             .select("row", F.col("vec_id").alias("positive_id"), F.col("score").alias("top")))
    tops = positives.groupBy("row").agg(F.array_sort(F.collect_set("top")).alias("tops"))
    negatives = search(rows, anchors.join(tops, "row"), False, n_negatives, share, dims, down, across)
    named = anchors.select("row", F.col("vec_id").alias("anchor_id")).join(positives, "row")
    return (negatives.select("row", "top", "rank", F.col("vec_id").alias("negative_id"), "score").join(named, ["row", "top"])
            .select("anchor_id", "positive_id", "rank", "negative_id", F.col("top").alias("positive_score"), F.col("score").alias("negative_score")))

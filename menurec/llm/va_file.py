"""Exact top-k inner-product search by vector-approximation files (operator 2).

The approximation file holds, for every vector, one small cell number per
dimension (equal-width cells between the dimension's extremes).  A cell gives
bounds for a component, so a scan of the cells bounds every score from both
sides.  Per query, candidates whose upper bound is below the k-th largest
lower bound are out; the exact vectors of the others are read best bound
first, until the k-th exact score is above every bound still unread.

Queries and candidates are dealt into a grid of blocks (query block x
candidate block); each grid cell is one bounded task, and the per-block
winners are merged by a ranking window.  The grid is a stated query set
against all rows, in blocks; no row pair is emitted but the k best of a block.

Defined cases: vectors that are null or hold null or non-finite components, and
rows without an id, take no part; rows that repeat an id are all candidates of
each other and, as queries, all answered; shorter vectors count as padded with zeros; ties go to the smaller id;
an empty table or no query gives an empty result; components whose scaled
floor leaves the long range stay at its end, and so do scores; extra columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from menurec.llm.common import materialised

CELLS = 32
CANDIDATE_BLOCK = 8192
QUERY_BLOCK = 2048
ROWS_AT_ONCE = 256  # queries scored together: 256 x 8192 doubles
EXACT = 2.0 ** 53
KEPT = ("row", "vec_id", "ints")


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """(row, vec_id, ints): floor(scale * x) of every usable vector; ``row`` tells
    rows apart, also those that repeat an id (fixed once the frame is materialised)."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return (vectors.filter(F.col(id_col).isNotNull() & x.isNotNull() & finite)
            .select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("vec_id"),
                    F.transform(x, lambda v: F.floor(v * scale)).alias("ints")))


def bounds(ints: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest component by dimension (padding counts as zero)."""
    rows = (ints.select(F.posexplode("ints").alias("at", "x")).groupBy("at")
            .agg(F.min("x").alias("low"), F.max("x").alias("high")).orderBy("at").collect())
    low = np.array([min(r["low"], 0) for r in rows], float)
    high = np.array([max(r["high"], 0) for r in rows], float)
    return low, high


def matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """A list column as an int64 matrix, short rows padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    lens = np.diff(column.offsets.to_numpy()) if len(column) else np.empty(0, np.int64)
    if len(lens) and (lens == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(lens), dims), np.int64)
    out[np.arange(dims) < lens[:, None]] = flat
    return out


def approximate(ints: DataFrame, low: np.ndarray, high: np.ndarray) -> DataFrame:
    """The approximation file: row, vec_id, ints and one byte per dimension."""
    dims, step = len(low), np.maximum((high - low) / CELLS, 1e-9)

    def run(batches):
        for batch in batches:
            cells = np.clip((matrix(batch.column("ints"), dims) - low) // step, 0, CELLS - 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*map(batch.column, KEPT), pa.array([c.tobytes() for c in cells], pa.binary())], names=[*KEPT, "cells"])

    return ints.select(*KEPT).mapInArrow(run, "row bigint, vec_id bigint, ints array<bigint>, cells binary")


def block_search(query_rows, queries, rows, ids, vectors, cells, low, step, k):
    """Exact top k of one block for every query: (query row, vec_id, score) lists."""
    out_q, out_v, out_s = [], [], []
    order = np.lexsort((rows, ids))  # positions break ties
    rows, ids, vectors, cells = rows[order], ids[order], vectors[order], cells[order]
    by_row = np.argsort(rows)
    at_row = np.searchsorted(rows[by_row], query_rows)
    place = by_row[np.minimum(at_row, len(rows) - 1)]
    own = np.where(rows[place] == query_rows, place, -1)  # the query's own row, if it is in the block
    q, x = queries.astype(float), vectors.astype(float)
    big = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, x.shape[1])
    if big >= EXACT:  # beyond double precision: plain integers, no pruning
        for n, mine, query in zip(query_rows, own, queries.astype(object)):
            scores = np.array([max(-2 ** 63, min(2 ** 63 - 1, int(s))) for s in vectors.astype(object) @ query], np.int64)
            best = [i for i in np.lexsort((ids, -scores.astype(object))) if i != mine][:k]
            out_q += [n] * len(best)
            out_v += ids[best].tolist()
            out_s += scores[best].tolist()
        return out_q, out_v, out_s
    middles = low + (cells + 0.5) * step
    slack = np.abs(q) @ (step / 2) * (1 + 1e-9) + 1e-6
    for at in range(0, len(q), ROWS_AT_ONCE):
        part_of = slice(at, at + ROWS_AT_ONCE)
        guess = q[part_of] @ middles.T
        mine = own[part_of]
        guess[np.flatnonzero(mine >= 0), mine[mine >= 0]] = -np.inf
        kth = np.partition(guess, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(guess), -np.inf)
        for i, line in enumerate(guess):
            gap = slack[at + i]
            left = np.flatnonzero((line + gap >= kth[i] - gap) & (line > -np.inf))
            left = left[np.argsort(-line[left], kind="stable")]
            top_s, top_i, read = np.empty(0), np.empty(0, np.int64), 0
            while read < len(left):
                if len(top_s) >= k and top_s[k - 1] > line[left[read]] + gap:
                    break  # no unread bound reaches the k-th score
                part = left[read:read + max(4 * k, 64)]
                read += len(part)
                top_i = np.r_[top_i, part]
                top_s = np.r_[top_s, x[part] @ q[at + i]]
                keep = np.lexsort((top_i, -top_s))[:k]
                top_i, top_s = top_i[keep], top_s[keep]
            out_q += [query_rows[at + i]] * len(top_i)
            out_v += ids[top_i].tolist()
            out_s += top_s.astype(np.int64).tolist()
    return out_q, out_v, out_s


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` largest inner products of
    every row that ``is_query`` (a condition on ``vec_id``) admits against all others."""
    spark = vectors.sparkSession
    schema = "query_row bigint, query_id bigint, vec_id bigint, score bigint"
    ints = materialised(integer_vectors(vectors, id_col, vector, scale))
    low, high = bounds(ints)
    if not len(low):
        low, high = np.zeros(1), np.zeros(1)
    dims, step = len(low), np.maximum((high - low) / CELLS, 1e-9)
    n, n_queries = ints.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    if not n_queries:
        return spark.createDataFrame([], schema).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    down, across = -(-n_queries // QUERY_BLOCK), -(-n // CANDIDATE_BLOCK)
    file = materialised(approximate(ints, low, high))
    cell = lambda seed, m: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(m)).cast("int")
    candidates = (file.withColumn("j", cell(2, across))
                  .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))))
    queries = (ints.filter(is_query).withColumn("i", cell(1, down))
               .withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(across - 1)))))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        got = ([], [], [])
        if left.num_rows and right.num_rows:
            cells = np.frombuffer(b"".join(right.column("cells").to_pylist()), np.uint8).reshape(-1, dims)
            got = block_search(left.column("row").to_numpy(), matrix(left.column("ints"), dims), right.column("row").to_numpy(),
                               right.column("vec_id").to_numpy(), matrix(right.column("ints"), dims), cells, low, step, k)
        ids = dict(zip(left.column("row").to_pylist(), left.column("vec_id").to_pylist()))
        return pa.table({"query_row": pa.array(got[0], pa.int64()), "query_id": pa.array([ids[r] for r in got[0]], pa.int64()),
                         "vec_id": pa.array(got[1], pa.int64()), "score": pa.array(got[2], pa.int64())})

    found = queries.groupBy("i", "j").cogroup(candidates.groupBy("i", "j")).applyInArrow(search, schema)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

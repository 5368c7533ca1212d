"""Deep learning recommendation model (DLRM) trained and scored as Spark jobs.

Architecture (the source's): one shared embedding table that every
categorical code indexes, summed per row; a bottom MLP over the dense
features (two ReLU layers); the bottom output ``h`` and the embedding sum
``e`` form ``z = [h, e]``; the upper triangle (with diagonal) of ``z z^T``
is concatenated with ``h`` and fed to a top MLP (two ReLU layers, then one
linear output).  The output is a raw logit.  The pairs are built a run at a
time (:func:`forward`); many rows under fixed weights are scored by category
code (:func:`scorer`), which leaves only the pairs within ``h``.

The maths is plain numpy on Arrow batches (``mapInPandas``); Spark
partitions and moves the rows:

* scoring (:func:`dlrm_score`) adds a ``prediction`` column to every row,
  with the weights shipped once per executor as a broadcast whose size is
  fixed by the configuration (checked against ``MAX_MODEL_BYTES``);
* training (:func:`dlrm_train`) is data-parallel over logical shards of
  ``shard_rows`` rows: rows are numbered in a fixed order, and a row's number
  gives its shard and its batch (:func:`shards`).  Tasks grow with the rows, and
  a re-run, on any number of executors, trains on the same batches in the same
  order.  Each round every shard streams its batches through AdamW, starting
  from the same weights.  A task takes a group of neighbouring shards
  (:func:`_group_size`) and averages their weights and optimiser moments, weighted
  by rows, as it goes; the groups' averages are written as a table and averaged
  as a tree of Spark aggregations over weight chunks, so the driver only receives
  the averaged model, and the written states stay under ``STATE_BYTES``.  With one shard
  this is plain sequential training (the source's one worker); with more it is
  periodic model averaging -- ``rounds_per_epoch`` sets how often shards
  synchronise.  A ledger keeps rows, batches, steps and losses of every shard
  and round.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from functools import lru_cache
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from menurec.schemas import DENSE_FEATURES, LABEL, SPARSE_FEATURES

MAX_MODEL_BYTES = 1 << 30          # broadcast limit for weights + moments
CHUNK_FLOATS = 1 << 18             # weight chunk size for the averaging step
AVERAGE_FAN = 32                   # weight chunks averaged by one task at once
SCORE_BATCH = 256                  # rows per forward pass (bounds memory), more for
PAIR_BYTES = 32 << 20              # a model whose pairs of that many rows stay below this
RUN_BYTES = 1 << 20                # of the pairs that are held at once, so that they stay in a cache
TABLE_BYTES = 128 << 20            # of the tables by category code that scoring may build
STEP_FLOATS = 1 << 16              # weights that the optimiser takes at once, likewise
LOSS_ROWS = 8192                   # rows scored at once for the loss
STATE_BYTES = 2 << 30              # of all states that a training round writes
GROUP_ROWS = 16_384                # rows of a task's shards, at least

PARAM_NAMES = ["emb", "bw0", "bb0", "bw1", "bb1", "tw0", "tb0", "tw1", "tb1", "tw2", "tb2"]


@dataclass
class DLRMConfig:
    """Model and optimiser settings; defaults are the source's."""
    n_sparse: int = len(SPARSE_FEATURES)
    n_dense: int = len(DENSE_FEATURES)
    num_embeddings: int = 142
    embed_dim: int = 128
    bottom: tuple[int, int] = (256, 128)
    top: tuple[int, int] = (128, 128)
    lr: float = 1e-3
    weight_decay: float = 0.01        # AdamW only; optimizer="adam" has none
    optimizer: str = "adamw"          # "adamw" (main notebook) or "adam" (trial)
    betas: tuple[float, float] = (0.9, 0.999)
    eps: float = 1e-8
    batch_size: int = 256
    epochs: int = 2
    seed: int = 42
    rounds_per_epoch: int = 1
    keep: str = "best"                # "best" validation loss, or "last" epoch
    shard_rows: int = 16_384          # rows of a logical shard (whole batches)
    precision: str = "float32"        # of weights, inputs and losses in training

    @property
    def z_dim(self) -> int:
        return self.bottom[1] + self.embed_dim

    @property
    def top_in(self) -> int:
        d = self.z_dim
        return d * (d + 1) // 2 + self.bottom[1]

    def shapes(self) -> dict[str, tuple[int, ...]]:
        b0, b1 = self.bottom
        t0, t1 = self.top
        return {
            "emb": (self.num_embeddings, self.embed_dim),
            "bw0": (self.n_dense, b0), "bb0": (b0,),
            "bw1": (b0, b1), "bb1": (b1,),
            "tw0": (self.top_in, t0), "tb0": (t0,),
            "tw1": (t0, t1), "tb1": (t1,),
            "tw2": (t1, 1), "tb2": (1,),
        }

    def n_params(self) -> int:
        return sum(int(np.prod(s)) for s in self.shapes().values())


# ---------------------------------------------------------------------------
# numpy model
# ---------------------------------------------------------------------------

def init_params(cfg: DLRMConfig) -> dict[str, np.ndarray]:
    """Embeddings ~ N(0, 1); linear layers ~ U(-1/sqrt(fan_in), 1/sqrt(fan_in))."""
    rng = np.random.default_rng(cfg.seed)
    shapes = cfg.shapes()
    out = {}
    for name, shape in shapes.items():
        if name == "emb":
            out[name] = rng.standard_normal(shape).astype(np.float32)
        else:
            fan_in = shapes[name[0] + "w" + name[2]][0]   # bias shares its layer's fan-in
            bound = 1.0 / math.sqrt(fan_in)
            out[name] = rng.uniform(-bound, bound, shape).astype(np.float32)
    return out


@lru_cache(maxsize=4)
def _starts(d: int) -> list[int]:
    """The place of pair (i, i) for every column i, and the number of pairs."""
    return np.concatenate([[0], np.cumsum(d - np.arange(d))]).tolist()


def _runs(z_t: np.ndarray, live: np.ndarray):
    """Runs (i, j) of live columns, each of few enough pairs (or one column), and
    an array that holds a run's pairs.  A column of zeros has only zero pairs."""
    d, b = z_t.shape
    at = _starts(d)
    most = max(d, RUN_BYTES // max(1, b * z_t.itemsize))
    runs, i = [], 0
    while i < d:
        j = i + 1
        if live[i]:
            while j < d and live[j] and at[j + 1] - at[i] <= most:
                j += 1
            runs.append((i, j))
        i = j
    return runs, np.empty((min(most, at[d]), b), z_t.dtype)


def _pairs(z_t: np.ndarray, i: int, j: int, held: np.ndarray) -> np.ndarray:
    """The pairs of columns i to j - 1 with themselves and the later ones, a row each."""
    at = _starts(len(z_t))
    for c in range(i, j):
        np.multiply(z_t[c:], z_t[c], out=held[at[c] - at[i]:at[c + 1] - at[i]])
    return held[:at[j] - at[i]]


def _add_pairs(u: np.ndarray, z_t: np.ndarray, w: np.ndarray, live: np.ndarray) -> None:
    """Add ``pairs @ w`` to ``u``, a run of pairs at a time."""
    at = _starts(len(z_t))
    runs, held = _runs(z_t, live)
    for i, j in runs:
        u += _pairs(z_t, i, j, held).T @ w[at[i]:at[j]]


def _inputs(p: dict[str, np.ndarray], xs: np.ndarray, xd: np.ndarray):
    e = np.zeros((len(xs), p["emb"].shape[1]), p["emb"].dtype)
    for f in range(xs.shape[1]):
        e += p["emb"][xs[:, f]]
    h0 = np.maximum(xd @ p["bw0"] + p["bb0"], 0)
    h1 = np.maximum(h0 @ p["bw1"] + p["bb1"], 0)
    return e, h0, h1


def _live(h1: np.ndarray, d: int, w: np.ndarray) -> np.ndarray:
    """Columns of z to take: all but the units of ``h1`` that are 0 in every row
    (unless their weights are not finite: then they make every sum a NaN)."""
    at = _starts(d)
    live = np.ones(d, dtype=bool)
    for i in np.flatnonzero(~h1.any(axis=0)).tolist():
        live[i] = not np.isfinite(w[at[i]:at[i + 1]]).all()
    return live


def _top(p: dict[str, np.ndarray], u: np.ndarray):
    t0 = np.maximum(u, 0)
    t1 = np.maximum(t0 @ p["tw1"] + p["tb1"], 0)
    return t0, t1, (t1 @ p["tw2"] + p["tb2"])[:, 0]


def forward(p: dict[str, np.ndarray], xs: np.ndarray, xd: np.ndarray, keep: bool = False):
    """Logits for a batch: ``xs`` (B, n_sparse) int codes, ``xd`` (B, n_dense).

    The top MLP's input ``[pairs, h]`` is never built: its first layer is
    computed as ``pairs @ W[:P] + h @ W[P:]``, the pairs in runs of columns of
    ``z`` that stay in a cache, from the transposed ``z`` so that they are
    written in place one after the other.
    """
    e, h0, h1 = _inputs(p, xs, xd)
    z_t = np.ascontiguousarray(np.concatenate([h1, e], axis=1).T)
    n_pairs = _starts(len(z_t))[-1]
    u = (h1 @ p["tw0"][n_pairs:] + p["tb0"]).astype(np.float64)   # a sum of many runs
    _add_pairs(u, z_t, p["tw0"], _live(h1, len(z_t), p["tw0"]))
    t0, t1, out = _top(p, u.astype(z_t.dtype))
    if keep:
        return out, dict(xs=xs, xd=xd, h0=h0, h1=h1, z_t=z_t, t0=t0, t1=t1)
    return out


def scorer(p: dict[str, np.ndarray]):
    """A function (codes, dense values) -> logits for many rows under fixed weights.

    ``e`` is a sum of embeddings, so what the pairs ``(h, e)`` and ``(e, e)`` add
    to the top MLP's first layer is, for every category code of a row, ``z`` times
    a matrix that depends on that code alone.  These matrices are made once; the
    rows of a code are multiplied together.  Only the pairs ``(h, h)`` are left to
    be built, of the units that are not 0 in every row.  Where the matrices would
    be too large, or save nothing, the rows go through :func:`forward`.
    """
    emb, w = p["emb"], p["tw0"]
    n_h = p["bw1"].shape[1]
    d = n_h + emb.shape[1]
    at, at_h = _starts(d), _starts(n_h)
    width = w.shape[1]
    finite = all(np.isfinite(a).all() for a in p.values())
    batch = max(SCORE_BATCH, min(8192, PAIR_BYTES // (8 * len(w))))
    tables = None

    def plain(xs, xd):
        return np.concatenate([forward(p, xs[s:s + batch], xd[s:s + batch])
                               for s in range(0, len(xs), batch)] or [np.empty(0, emb.dtype)])

    def by_code(xs, xd):
        nonlocal tables
        if tables is None:
            upper = np.zeros((d, d - n_h, width), w.dtype)   # weights of the pairs (z_i, e_j)
            for i in range(d):
                upper[i, max(0, i - n_h):] = w[at[i] + max(0, n_h - i):at[i + 1]]
            tables = np.tensordot(emb, upper, axes=(1, 1))
        e, _, h1 = _inputs(p, xs, xd)
        u = h1 @ w[at[d]:] + p["tb0"]
        z = np.concatenate([h1, e], axis=1)
        for f in range(xs.shape[1]):
            order = np.argsort(xs[:, f], kind="stable")
            codes, first = np.unique(xs[order, f], return_index=True)
            for code, rows in zip(codes.tolist(), np.split(order, first[1:])):
                u[rows] += z[rows] @ tables[code]
        units = np.flatnonzero(h1.any(axis=0))
        i, j = (units[k] for k in np.triu_indices(len(units)))
        w_h = w[np.asarray(at)[i] + j - i]
        live = np.ones(len(units), dtype=bool)
        for s in range(0, len(xs), SCORE_BATCH):
            _add_pairs(u[s:s + SCORE_BATCH], np.ascontiguousarray(h1[s:s + SCORE_BATCH, units].T), w_h, live)
        return _top(p, u)[2]

    def pays(n_sparse: int) -> bool:
        return (finite and len(emb) * d * width * w.itemsize <= TABLE_BYTES
                and at_h[-1] + n_sparse * d < at[d])

    return lambda xs, xd: (by_code if len(xs) and pays(xs.shape[1]) else plain)(xs, xd)


def bce_with_logits(logits: np.ndarray, y: np.ndarray):
    """Mean binary cross-entropy on logits and its gradient."""
    loss = np.maximum(logits, 0) - logits * y + np.log1p(np.exp(-np.abs(logits)))
    sig = 1.0 / (1.0 + np.exp(-logits))
    return float(loss.mean()), ((sig - y) / len(y)).astype(logits.dtype)


def backward(p: dict[str, np.ndarray], c: dict, g: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of every parameter given ``g`` = dLoss/dlogit (B,)."""
    grads = {}
    g = g[:, None]
    grads["tw2"] = c["t1"].T @ g
    grads["tb2"] = g.sum(axis=0)
    g1 = (g @ p["tw2"].T) * (c["t1"] > 0)
    grads["tw1"] = c["t0"].T @ g1
    grads["tb1"] = g1.sum(axis=0)
    g0 = (g1 @ p["tw1"].T) * (c["t0"] > 0)
    z_t, w = c["z_t"], p["tw0"]
    d, hb = len(z_t), c["h1"].shape[1]
    at = _starts(d)
    grads["tw0"] = np.zeros_like(w)
    np.matmul(c["h1"].T, g0, out=grads["tw0"][at[d]:])
    grads["tb0"] = g0.sum(axis=0)
    # The gradient of a unit that is 0 in every row stays 0 behind its ReLU.
    runs, held = _runs(z_t, _live(c["h1"], d, w))
    g_held, gz_t, g0_t = np.empty_like(held), np.zeros_like(z_t), np.ascontiguousarray(g0.T)
    for i, j in runs:
        np.matmul(_pairs(z_t, i, j, held), g0, out=grads["tw0"][at[i]:at[j]])
        g_pairs = np.matmul(w[at[i]:at[j]], g0_t, out=g_held[:at[j] - at[i]])
        for k in range(i, j):   # d(z_k z_j): z_j to column k, z_k to column j
            part = g_pairs[at[k] - at[i]:at[k + 1] - at[i]]
            gz_t[k] += np.einsum("jb,jb->b", part, z_t[k:])
            part *= z_t[k]
            gz_t[k:] += part
    gh1 = (gz_t[:hb].T + g0 @ w[at[d]:].T) * (c["h1"] > 0)
    ge = np.ascontiguousarray(gz_t[hb:].T)
    grads["bw1"] = c["h0"].T @ gh1
    grads["bb1"] = gh1.sum(axis=0)
    gh0 = (gh1 @ p["bw1"].T) * (c["h0"] > 0)
    grads["bw0"] = c["xd"].T @ gh0
    grads["bb0"] = gh0.sum(axis=0)
    gemb = np.zeros_like(p["emb"])
    for f in range(c["xs"].shape[1]):
        np.add.at(gemb, c["xs"][:, f], ge)
    grads["emb"] = gemb
    return grads


def adam_step(p, grads, m, v, t: int, cfg: DLRMConfig) -> None:
    """One AdamW (or Adam) update in place; ``t`` is the 1-based step."""
    b1, b2 = cfg.betas
    for k in PARAM_NAMES:
        rows = max(1, STEP_FLOATS // max(1, p[k][:1].size))
        for s in range(0, len(p[k]), rows):
            part = slice(s, s + rows)
            pk, gk, mk, vk = p[k][part], grads[k][part], m[k][part], v[k][part]
            if cfg.optimizer == "adamw" and cfg.weight_decay:
                pk *= (1.0 - cfg.lr * cfg.weight_decay)
            mk *= b1
            mk += (1 - b1) * gk
            vk *= b2
            vk += (1 - b2) * gk * gk
            step = mk / (1 - b1 ** t)
            step *= cfg.lr
            root = vk / (1 - b2 ** t)
            np.sqrt(root, out=root)
            root += cfg.eps
            step /= root
            pk -= step


def predict(p: dict[str, np.ndarray], xs: np.ndarray, xd: np.ndarray,
            batch: int | None = None) -> np.ndarray:
    if batch is None:
        return scorer(p)(xs, xd).astype(np.float64)
    out = np.empty(len(xs), dtype=np.float64)
    for s in range(0, len(xs), batch):
        out[s:s + batch] = forward(p, xs[s:s + batch], xd[s:s + batch])
    return out


# ---------------------------------------------------------------------------
# flat vectors (weights + optimiser moments travel as chunks)
# ---------------------------------------------------------------------------

def flatten(*dicts: dict[str, np.ndarray], dtype="float32") -> np.ndarray:
    return np.concatenate([d[k].ravel() for d in dicts for k in PARAM_NAMES]).astype(dtype)


def unflatten(vec: np.ndarray, cfg: DLRMConfig, n: int) -> list[dict[str, np.ndarray]]:
    shapes = cfg.shapes()
    out, pos = [], 0
    for _ in range(n):
        d = {}
        for k in PARAM_NAMES:
            size = int(np.prod(shapes[k]))
            d[k] = vec[pos:pos + size].reshape(shapes[k]).astype(cfg.precision)
            pos += size
        out.append(d)
    return out


def _check_model_size(cfg: DLRMConfig, copies: int) -> None:
    size = cfg.n_params() * np.dtype(cfg.precision).itemsize * copies
    if size > MAX_MODEL_BYTES:
        raise ValueError(f"model state of {size} bytes exceeds the broadcast limit "
                         f"{MAX_MODEL_BYTES}")


# ---------------------------------------------------------------------------
# Spark jobs
# ---------------------------------------------------------------------------

def _arrays(pdf: pd.DataFrame, sparse: Sequence[str], dense: Sequence[str],
            num_embeddings: int, null_codes: str):
    """Model inputs from a pandas batch.

    NULL category codes: ``"error"`` raises, ``"reserve"`` maps them to the
    last embedding row (size the table one row larger), ``"drop"`` expects
    them removed already.  NULL dense values become 0 (the scaled minimum).
    """
    xs = pdf[list(sparse)].to_numpy(dtype=np.float64)
    missing = np.isnan(xs)
    if missing.any():
        if null_codes != "reserve":
            raise ValueError("NULL category code (unseen value) in model input; "
                             "use null_codes='reserve' or 'drop'")
        xs[missing] = num_embeddings - 1
    if len(xs) and (xs.max() >= num_embeddings or xs.min() < 0):
        raise ValueError("category code outside the embedding table")
    xd = np.nan_to_num(pdf[list(dense)].to_numpy(dtype=np.float64)).astype(np.float32)
    return xs.astype(np.int64), xd


def dlrm_score(df: DataFrame, params: dict[str, np.ndarray], cfg: DLRMConfig,
               sparse: Sequence[str] = SPARSE_FEATURES,
               dense: Sequence[str] = DENSE_FEATURES,
               out: str = "prediction", null_codes: str = "error",
               partitions: int | None = None) -> DataFrame:
    """Add the model's logit as ``out`` to every row of ``df``.

    Scoring costs far more per row than reading it, so ``partitions``
    spreads the rows over that many tasks first (Spark's round-robin
    repartition, made deterministic by its local sort); leave it unset when
    the input already has enough partitions.

    ``null_codes``: ``"error"`` fails on a NULL (unseen) category code,
    ``"reserve"`` scores it with the reserved last embedding row, ``"drop"``
    removes such rows first.  The scorer never pulls rows to the driver.
    """
    _check_model_size(cfg, 1)
    if null_codes == "drop":
        df = df.dropna(subset=list(sparse))
    elif null_codes not in ("error", "reserve"):
        raise ValueError("null_codes must be 'error', 'reserve' or 'drop'")
    if partitions:
        df = df.repartition(partitions)
    bc = df.sparkSession.sparkContext.broadcast(params)
    sparse, dense = list(sparse), list(dense)
    n_emb = cfg.num_embeddings

    def score(batches):
        logits = scorer(bc.value)
        for rb in batches:   # only the model's inputs are converted
            xs, xd = _arrays(rb.select([*sparse, *dense]).to_pandas(), sparse, dense, n_emb, null_codes)
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(logits(xs, xd).astype(np.float64), pa.float64())],
                                             names=[*rb.schema.names, out])

    schema = T.StructType(df.schema.fields + [T.StructField(out, T.DoubleType())])
    return df.mapInArrow(score, schema)


def _group_size(n_shards: int, shard_rows: int, state_bytes: int = 0) -> int:
    """Neighbouring shards that one task takes: at least ``GROUP_ROWS`` rows, and
    no more groups than states fit into ``STATE_BYTES``.  It depends on the rows
    and the model alone, not on the cluster."""
    most = max(1, STATE_BYTES // state_bytes) if state_bytes else n_shards
    return max(1, GROUP_ROWS // shard_rows, -(-n_shards // max(1, most)))


def _grouped(df: DataFrame, cols: Sequence[str], shard_rows: int,
             order: Sequence[Column | str] | None, state_bytes: int = 0) -> tuple[DataFrame, int]:
    """The rows of :func:`shards`, not checkpointed, and the shards of a group;
    a group is a partition."""
    from menurec.functions.hashing import pair_key
    from menurec.functions.numbering import numbered
    if order is None:
        order = [F.md5(pair_key(*cols)), *cols]
    keyed = df.select(*cols, *[(F.col(c) if isinstance(c, str) else c).alias(f"__o{i}")
                               for i, c in enumerate(order)])
    placed = numbered(keyed, [f"__o{i}" for i in range(len(order))]).select(
        F.floor(F.col("pos") / shard_rows).alias("shard"), "pos", *cols)
    n = (placed.select(F.max("shard")).first()[0] or 0) + 1
    each = _group_size(n, shard_rows, state_bytes)
    groups = placed.repartitionById(-(-n // each), F.floor(F.col("shard") / each).cast("int"))
    return groups.sortWithinPartitions("shard", "pos"), each


def shards(df: DataFrame, cols: Sequence[str], shard_rows: int,
           order: Sequence[Column | str] | None = None) -> DataFrame:
    """``shard``, ``pos`` and ``cols`` of every row, checkpointed by groups of shards.

    Rows are numbered in ``order`` (default: a hash of the columns, then the
    columns themselves, so tied rows are equal); ``shard_rows`` rows in a row
    form a shard, which lies in one partition, sorted by number.
    """
    return _grouped(df, cols, shard_rows, order)[0].checkpoint(eager=True)


def _mini_batches(batches, cfg: DLRMConfig, sparse, dense, label, null_codes):
    """Mini-batches of a stream of Arrow batches sorted by (shard, pos):
    (shard, codes, dense values, labels).  Holds one mini-batch at a time."""
    cols = [*sparse, *dense, label]
    held: list[np.ndarray] = []
    size, now = 0, None

    def batch():
        x = np.concatenate(held)
        pdf = pd.DataFrame(x, columns=cols)
        xs, xd = _arrays(pdf, sparse, dense, cfg.num_embeddings, null_codes)
        return now, xs, xd.astype(cfg.precision), pdf[label].to_numpy().astype(cfg.precision)

    for rb in batches:
        shard = rb.column("shard").to_numpy()
        values = np.column_stack([rb.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)
                                  for c in cols])
        at = 0
        while at < len(shard):
            if shard[at] != now or size == cfg.batch_size:
                if size:
                    yield batch()
                held, size, now = [], 0, shard[at]
            end = int(np.searchsorted(shard, now, side="right"))
            take = min(end - at, cfg.batch_size - size)
            held.append(values[at:at + take])
            size, at = size + take, at + take
    if size:
        yield batch()


def _joined(mini_batches):
    """Lists of neighbouring mini-batches, scored together."""
    few, size = [], 0
    for one in mini_batches:
        few.append(one)
        size += len(one[3])
        if size >= LOSS_ROWS:
            yield few
            few, size = [], 0
    if few:
        yield few


_ROUND_SCHEMA = ("shard long, chunk int, rows long, batches long, steps long, loss double, "
                 "first_loss double, data binary")


# A state is a few large rows: small row groups, checked row by row, keep the
# writer's and the reader's buffers at a few chunks.
_STATE_OPTIONS = {
    "compression": "uncompressed", "parquet.enable.dictionary": "false",
    "parquet.block.size": str(4 * CHUNK_FLOATS * 8),
    "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1",
    "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1",
}


STATS = -1   # chunk of a row that has a shard's stats and no weights


def _round_row(shard: int, chunk: int, stats: tuple, data: bytes) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays(
        [pa.array([shard], pa.int64()), pa.array([chunk], pa.int32()),
         *[pa.array([v], k) for v, k in zip(stats, kinds)], pa.array([data], pa.binary())],
        names=[f.split()[0] for f in _ROUND_SCHEMA.split(", ")])


def _state_batches(group: int, total: np.ndarray, rows: int, precision: str):
    """The averaged state of a group, a row per weight chunk."""
    for i, s in enumerate(range(0, len(total), CHUNK_FLOATS)):
        mean = (total[s:s + CHUNK_FLOATS] / rows).astype(precision)
        yield _round_row(group, i, (rows, None, None, None, None), mean.tobytes())


def _add_state(total: np.ndarray, state: list[dict[str, np.ndarray]], rows: int) -> None:
    at = 0
    for part in (d[k] for d in state for k in PARAM_NAMES):
        total[at:at + part.size] += rows * part.ravel().astype(np.float64)
        at += part.size


def _train_shards(data: DataFrame, state_vec: np.ndarray, step: int, cfg: DLRMConfig,
                  round_idx: int, sparse: list[str], dense: list[str], label: str,
                  null_codes: str, path: str, each: int) -> DataFrame:
    """Train every shard from the same state; the stats of every shard and the
    averaged new state of every group of ``each`` shards at ``path``."""
    bc = data.sparkSession.sparkContext.broadcast(state_vec)
    cfg_d = asdict(cfg)

    def local(batches):
        c = DLRMConfig(**cfg_d)
        now, group, state, number = None, None, None, 0
        stats = [0, 0, step, 0.0, None]
        total, rows = np.zeros(len(bc.value)), 0

        for shard, xs, xd, y in _mini_batches(batches, c, sparse, dense, label, null_codes):
            if shard != now:
                if stats[1]:
                    yield _round_row(int(now), STATS, tuple(stats), b"")
                    _add_state(total, state, stats[0])
                    rows += stats[0]
                if shard // each != group:
                    if rows:
                        yield from _state_batches(int(group), total, rows, c.precision)
                        total[:], rows = 0.0, 0
                    group = shard // each
                now, number, stats = shard, 0, [0, 0, step, 0.0, None]
                state = unflatten(bc.value, c, 3)
            number += 1
            if (number - 1) % c.rounds_per_epoch != round_idx:
                continue
            logits, cache = forward(state[0], xs, xd, keep=True)
            loss, g = bce_with_logits(logits, y)
            stats[2] += 1
            adam_step(state[0], backward(state[0], cache, g), state[1], state[2], stats[2], c)
            stats[0] += len(y)
            stats[1] += 1
            stats[3] += loss
            stats[4] = loss if stats[4] is None else stats[4]
        if stats[1]:
            yield _round_row(int(now), STATS, tuple(stats), b"")
            _add_state(total, state, stats[0])
            rows += stats[0]
        if rows:
            yield from _state_batches(int(group), total, rows, c.precision)

    # Written, not kept in a lineage: a lost executor later re-reads the states
    # instead of training again.
    data.mapInArrow(local, _ROUND_SCHEMA).write.options(**_STATE_OPTIONS).parquet(path)
    bc.destroy()
    return data.sparkSession.read.schema(_ROUND_SCHEMA).parquet(path)


def _average(states: DataFrame, n_shards: int, precision: str) -> np.ndarray | None:
    """Row-weighted mean of the shards' states: a tree of aggregations, of which
    no task holds more than ``AVERAGE_FAN`` chunks."""
    def averaged(level: DataFrame, dtype: str) -> DataFrame:
        def mean(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            order = np.argsort(table.column("shard").to_numpy(), kind="stable")
            rows = table.column("rows").to_numpy()
            total = 0.0
            for i in order.tolist():   # in shard order: the same sum every time
                total = total + rows[i] * np.frombuffer(table.column("data")[i].as_py(), dtype).astype(np.float64)
            n = int(rows.sum())
            return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()),
                             "shard": pa.array([key[1].as_py()], pa.int64()),
                             "rows": pa.array([n], pa.int64()),
                             "data": pa.array([(total / n).tobytes()], pa.binary())})

        return level.groupBy("chunk", F.floor(F.col("shard") / AVERAGE_FAN).alias("part")) \
            .applyInArrow(mean, "chunk int, shard long, rows long, data binary")

    level = averaged(states.select("chunk", "shard", "rows", "data"), precision)
    while (n_shards := -(-n_shards // AVERAGE_FAN)) > 1:
        level = averaged(level, "float64")
    got = level.orderBy("chunk").collect()   # one row per chunk of the model
    if not got:
        return None
    return np.concatenate([np.frombuffer(r["data"], np.float64) for r in got]).astype(precision)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def dlrm_loss_parts(df: DataFrame, params: dict[str, np.ndarray], cfg: DLRMConfig,
                    sparse: Sequence[str] = SPARSE_FEATURES,
                    dense: Sequence[str] = DENSE_FEATURES, label: str = LABEL,
                    null_codes: str = "error",
                    order: Sequence[Column | str] | None = None) -> DataFrame:
    """shard, rows, batches, loss (summed over batches) of the model over ``df``,
    cut into shards and batches as in training."""
    sparse, dense = list(sparse), list(dense)
    data = _grouped(df, [*sparse, *dense, label], cfg.shard_rows, order)[0]   # read once
    return _loss_of(data, params, cfg, sparse, dense, label, null_codes)


def _loss_of(data, params, cfg, sparse, dense, label, null_codes) -> DataFrame:
    # the model's size is checked (_check_model_size)
    bc = data.sparkSession.sparkContext.broadcast(params)
    cfg_d = asdict(cfg)

    def part(batches):
        c, score = DLRMConfig(**cfg_d), scorer(bc.value)
        got: dict[int, list] = {}
        for few in _joined(_mini_batches(batches, c, sparse, dense, label, null_codes)):
            logits = score(*(np.concatenate([b[i] for b in few]) for i in (1, 2)))
            at = 0
            for shard, _, _, y in few:
                entry = got.setdefault(int(shard), [0, 0, 0.0])
                entry[0] += len(y)
                entry[1] += 1
                entry[2] += bce_with_logits(logits[at:at + len(y)], y)[0]
                at += len(y)
        columns = list(zip(*[(s, *e) for s, e in got.items()])) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))],
            names=["shard", "rows", "batches", "loss"])

    return data.mapInArrow(part, "shard long, rows long, batches long, loss double")


def dlrm_loss(df: DataFrame, params: dict[str, np.ndarray], cfg: DLRMConfig,
              sparse: Sequence[str] = SPARSE_FEATURES,
              dense: Sequence[str] = DENSE_FEATURES, label: str = LABEL,
              null_codes: str = "error", order: Sequence[Column | str] | None = None) -> float:
    """Mean per-batch BCE loss over ``df`` (batches of ``cfg.batch_size`` rows
    numbered as in training); NaN without rows."""
    return _mean_loss(dlrm_loss_parts(df, params, cfg, sparse, dense, label, null_codes, order))


def _mean_loss(parts: DataFrame) -> float:
    row = parts.agg(F.sum("loss").alias("loss"), F.sum("batches").alias("batches")).first()
    return float(row["loss"]) / row["batches"] if row["batches"] else float("nan")


@dataclass
class TrainResult:
    params: dict[str, np.ndarray]
    history: list[dict] = field(default_factory=list)
    best_epoch: int = 0
    ledger: DataFrame | None = None   # epoch, round, shard, rows, batches, steps, loss, first_loss


def dlrm_train(train: DataFrame, val: DataFrame | None, cfg: DLRMConfig,
               sparse: Sequence[str] = SPARSE_FEATURES,
               dense: Sequence[str] = DENSE_FEATURES, label: str = LABEL,
               null_codes: str = "error", save_best: str | None = None,
               max_rows: int | None = None, order: Sequence[Column | str] | None = None,
               start: dict[str, np.ndarray] | None = None) -> TrainResult:
    """Train for ``cfg.epochs`` epochs; keep the best-validation (or last) weights.

    Rows are cut into shards of ``cfg.shard_rows`` (:func:`shards`, in
    ``order``), so the result does not depend on the input's partitions or on
    the cluster.  Train loss is the mean of batch losses; validation loss
    likewise.  ``start`` gives the first weights (default: random from
    ``cfg.seed``).  ``save_best`` writes the kept weights to that path whenever
    they change.  ``max_rows`` trains on at most that many rows (the source caps
    training at 100,000): the rows with the smallest hash of their model
    columns; by default every row is used.

    The ledger has a row per epoch, round and shard: rows and batches taken,
    the optimiser step after the last of them, their summed loss, and the loss
    of the first.  It is a table in the shared folder.
    """
    from menurec.session import checkpoint_dir
    _check_model_size(cfg, 3)
    if cfg.shard_rows % cfg.batch_size:
        raise ValueError("shard_rows must be a multiple of batch_size")
    spark = train.sparkSession
    folder = f"{checkpoint_dir(spark)}/dlrm-{uuid.uuid4().hex}"
    sparse, dense = list(sparse), list(dense)
    cols = sparse + dense + [label]
    if max_rows is not None:
        from menurec.operators.split import capped
        train = capped(train, cols, max_rows)
    data, each = _grouped(train, cols, cfg.shard_rows, order,
                          3 * cfg.n_params() * np.dtype(cfg.precision).itemsize)
    data = data.checkpoint(eager=True)
    if val is not None:
        val = shards(val, cols, cfg.shard_rows, order)
    p = {k: a.astype(cfg.precision) for k, a in (start or init_params(cfg)).items()}
    zeros = {k: np.zeros_like(a) for k, a in p.items()}
    vec = flatten(p, zeros, zeros, dtype=cfg.precision)
    step = 0
    result = TrainResult(params=p)
    best = math.inf
    for epoch in range(1, cfg.epochs + 1):
        for r in range(cfg.rounds_per_epoch):
            path = f"{folder}/states-{epoch}-{r}"
            states = _train_shards(data, vec, step, cfg, r, sparse, dense, label, null_codes, path, each)
            done = states.filter(F.col("chunk") == STATS)
            (done.select(
                F.lit(epoch).alias("epoch"), F.lit(r).alias("round"), "shard", "rows", "batches",
                "steps", "loss", "first_loss").write.mode("append").parquet(f"{folder}/ledger"))
            last = done.agg(F.max("shard"), F.max("steps")).first()
            if last[0] is not None:
                vec, step = _average(states.filter("chunk >= 0"), last[0] // each + 1, cfg.precision), last[1]
            _remove(spark, path)
        result.ledger = spark.read.parquet(f"{folder}/ledger")
        taken = result.ledger.filter(F.col("epoch") == epoch)
        train_loss = _mean_loss(taken)
        if math.isnan(train_loss) and not taken.limit(1).count():
            raise ValueError("no training rows")
        params = unflatten(vec, cfg, 1)[0]
        val_loss = _mean_loss(_loss_of(val, params, cfg, sparse, dense, label, null_codes)) \
            if val is not None else float("nan")
        if val is not None and math.isnan(val_loss):
            raise ValueError("the validation loss is not a number: no validation rows, or the training diverged")
        result.history.append({"epoch": epoch, "train_loss": train_loss, "val_loss": val_loss})
        better = val is not None and val_loss < best
        if cfg.keep == "last" or better or (val is None):
            if better:
                best = val_loss
            result.params = params
            result.best_epoch = epoch
            if save_best:
                save_weights(spark, params, save_best)
    return result


# ---------------------------------------------------------------------------
# weights on shared storage
# ---------------------------------------------------------------------------

def save_weights(spark: SparkSession, params: dict[str, np.ndarray], path: str) -> None:
    rows = []
    for k in PARAM_NAMES:
        flat = params[k].astype(np.float32).ravel()
        for i, s in enumerate(range(0, max(len(flat), 1), CHUNK_FLOATS)):
            rows.append((k, list(params[k].shape), i, flat[s:s + CHUNK_FLOATS].tobytes()))
    spark.createDataFrame(rows, "name string, shape array<int>, chunk int, data binary") \
        .write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    rows = spark.read.parquet(path).orderBy("name", "chunk").collect()
    out: dict[str, list] = {}
    shapes = {}
    for r in rows:
        out.setdefault(r["name"], []).append(np.frombuffer(r["data"], dtype=np.float32))
        shapes[r["name"]] = tuple(r["shape"])
    return {k: np.concatenate(v).reshape(shapes[k]).copy() for k, v in out.items()}

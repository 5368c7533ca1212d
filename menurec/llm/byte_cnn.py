"""Quality classifier: a byte-level convolutional network in numpy (operator 4).

A text's bytes are embedded, 32 filters of 8 bytes slide over them in steps of
4, and each filter is max-pooled over blocks of 128 bytes.  Two neighbouring
blocks make a chunk (chunks overlap by a block and cover the whole text); a
hidden layer reads each chunk's pooled filters, and its largest and mean
activations over all chunks are combined into one probability.  A batch of
texts is laid end to end, so both filter phases are plain matrix products.

``fit`` trains embedding, filters and both layers by backpropagation (Adam) in
one task, on a bounded, balanced sample of labelled rows (``per_class`` of
each label); of a text over ``TRAIN_BYTES`` it takes evenly spread blocks of
that many bytes.  The class rate of all admitted labels calibrates the result.
Scoring reads every whole text in Arrow batches.

Defined cases: null and empty texts are one block of padding and get a score;
repeated rows get equal scores; without labelled rows of both classes every
score is the class rate; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from pyspark.sql import functions as F

from menurec.llm.common import label_rate, labelled_sample, materialised, raw_texts

EMBED, WIDTH, STEP, FILTERS, HIDDEN = 8, 8, 4, 32, 16
BLOCK = 128
PAD = 256
PIECE = 1 << 20
TRAIN_BYTES = 16 << 10
PER_CLASS = 1500
EPOCHS, BATCH, RATE = 8, 48, 4e-3


def initial(seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    shape = {"embed": (257, EMBED), "filter": (EMBED * WIDTH, FILTERS), "fbias": (FILTERS,), "w1": (FILTERS, HIDDEN),
             "b1": (HIDDEN,), "w2": (2 * HIDDEN,), "b2": (1,)}
    scale = {"embed": 0.5, "filter": (EMBED * WIDTH) ** -0.5, "w1": FILTERS ** -0.5, "w2": (2 * HIDDEN) ** -0.5}
    return {k: (rng.standard_normal(s) * scale.get(k, 0.0)).astype(np.float32) for k, s in shape.items()}


def lay_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts end to end, each padded to whole blocks with at least one
    filter width of padding; and the number of blocks of each."""
    blocks = np.array([(len(t) + WIDTH + BLOCK - 1) // BLOCK for t in texts], np.int64)
    flat = np.full(int(blocks.sum()) * BLOCK, PAD, np.int16)
    at = 0
    for t, n in zip(texts, blocks):
        flat[at:at + len(t)] = np.frombuffer(t, np.uint8)
        at += int(n) * BLOCK
    return flat, blocks


def final_blocks(blocks: np.ndarray) -> np.ndarray:
    """Marks the last block of every text."""
    out = np.zeros(int(blocks.sum()), bool)
    out[blocks.cumsum() - 1] = True
    return out


def pool_blocks(flat: np.ndarray, final: np.ndarray, net, positions: bool = False):
    """Largest filter response in every block (and its byte position).

    Positions are the multiples of ``STEP``; a position's bytes may reach into
    the next block.  The last position of a text is left out: it holds padding
    and what comes from the next text.
    """
    wide = np.concatenate([flat, np.full(WIDTH, PAD, flat.dtype)])
    x = net["embed"][wide]
    n = len(flat) // WIDTH
    even = x[:-WIDTH].reshape(n, WIDTH * EMBED) @ net["filter"]
    odd = x[STEP:STEP - WIDTH].reshape(n, WIDTH * EMBED) @ net["filter"]
    per = BLOCK // WIDTH
    even, odd = even.reshape(-1, per, FILTERS), odd.reshape(-1, per, FILTERS)
    odd[final, -1] = -np.inf
    best_e, best_o = even.max(axis=1), odd.max(axis=1)
    top = np.maximum(best_e, best_o) + net["fbias"]
    if not positions:
        return top
    where = np.where(best_e >= best_o, WIDTH * even.argmax(axis=1), WIDTH * odd.argmax(axis=1) + STEP)
    return top, where + BLOCK * np.arange(len(top))[:, None], wide


def chunked(top: np.ndarray, blocks: np.ndarray):
    """Chunk i pools blocks i and i+1 of the same text (the last block alone)."""
    last = final_blocks(blocks)
    nxt = np.minimum(np.arange(len(top)) + 1, len(top) - 1)
    follow = np.where(last[:, None], -np.inf, top[nxt])
    return np.maximum(top, follow), follow > top


def heads(chunk: np.ndarray, blocks: np.ndarray, net):
    hidden = np.maximum(np.maximum(chunk, 0) @ net["w1"] + net["b1"], 0)
    first = np.r_[0, blocks.cumsum()[:-1]]
    high = np.maximum.reduceat(hidden, first, axis=0)
    mean = np.add.reduceat(hidden, first, axis=0) / blocks[:, None]
    return hidden, np.concatenate([high, mean], axis=1), first


def logits(texts: list[bytes], net) -> np.ndarray:
    """One logit per text; memory is bounded by pieces of ``PIECE`` bytes."""
    out, group, held = [], [], 0
    for t in texts:
        if group and held + len(t) > PIECE:
            out.append(_logits(group, net))
            group, held = [], 0
        group.append(t)
        held += len(t) + BLOCK
    if group:
        out.append(_logits(group, net))
    return np.concatenate(out) if out else np.empty(0, np.float32)


def _logits(texts, net):
    flat, blocks = lay_out(texts)
    final = final_blocks(blocks)
    if len(flat) > 2 * PIECE:  # a very long text: pool its blocks piece by piece, with one more block each
        n = PIECE // BLOCK
        top = np.concatenate([pool_blocks(flat[a * BLOCK:(a + n + 1) * BLOCK], final[a:a + n + 1], net)[:n] for a in range(0, len(final), n)])
    else:
        top = pool_blocks(flat, final, net)
    _, doc, _ = heads(chunked(top, blocks)[0], blocks, net)
    return doc @ net["w2"] + net["b2"][0]


def gradients(texts: list[bytes], labels: np.ndarray, net) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy of a batch and its gradients."""
    flat, blocks = lay_out(texts)
    top, where, wide = pool_blocks(flat, final_blocks(blocks), net, positions=True)
    chunk, from_next = chunked(top, blocks)
    hidden, doc, first = heads(chunk, blocks, net)
    z = doc @ net["w2"] + net["b2"][0]
    p = 1 / (1 + np.exp(-z))
    n = len(labels)
    loss = float(np.mean(np.maximum(z, 0) - z * labels + np.log1p(np.exp(-np.abs(z)))))
    dz = ((p - labels) / n).astype(np.float32)
    g = {"w2": doc.T @ dz, "b2": dz.sum(keepdims=True)}
    ddoc = dz[:, None] * net["w2"]
    owner = np.repeat(np.arange(n), blocks)
    is_high = hidden == doc[owner, :HIDDEN]
    share = np.add.reduceat(is_high.astype(np.float32), first, axis=0)
    dhidden = is_high * (ddoc[:, :HIDDEN] / share)[owner] + (ddoc[:, HIDDEN:] / blocks[:, None])[owner]
    dhidden *= hidden > 0
    act = np.maximum(chunk, 0)
    g["w1"], g["b1"] = act.T @ dhidden, dhidden.sum(axis=0)
    dchunk = (dhidden @ net["w1"].T) * (chunk > 0)
    dtop = np.where(from_next, 0, dchunk)
    moved = np.where(from_next, dchunk, 0)
    dtop[1:] += moved[:-1]
    g["fbias"] = dtop.sum(axis=0)
    # only the positions that won a pool carry a gradient
    b, f = np.nonzero(dtop)
    value = dtop[b, f]
    spots = where[b, f]
    codes = wide[spots[:, None] + np.arange(WIDTH)]
    windows = net["embed"][codes].reshape(len(b), -1)
    order = np.argsort(f, kind="stable")
    edges = np.searchsorted(f[order], np.arange(FILTERS + 1))
    dfilter = np.zeros_like(net["filter"])
    for i in range(FILTERS):
        rows = order[edges[i]:edges[i + 1]]
        dfilter[:, i] = value[rows] @ windows[rows]
    g["filter"] = dfilter
    back = (value[:, None] * net["filter"].T[f]).reshape(-1, EMBED)
    flat_codes = codes.ravel()
    g["embed"] = np.stack([np.bincount(flat_codes, back[:, e], 257) for e in range(EMBED)], axis=1).astype(np.float32)
    return loss, g


def train(texts: list[bytes], labels: list[int], seed: int = 3, epochs: int = EPOCHS) -> dict[str, np.ndarray]:
    """Adam over shuffled batches, the rate falling to a tenth."""
    net, rng = initial(seed), np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    m = {k: np.zeros_like(v) for k, v in net.items()}
    v = {k: np.zeros_like(x) for k, x in net.items()}
    step, total = 0, max(1, epochs * -(-len(texts) // BATCH))
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            rows = order[at:at + BATCH]
            _, g = gradients([texts[i] for i in rows], y[rows], net)
            step += 1
            rate = RATE * (1 - 0.9 * step / total)
            for k in net:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] * g[k]
                net[k] = (net[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return net


def shortened(text: bytes, most: int = TRAIN_BYTES) -> bytes:
    """For training only: evenly spread blocks of a very long text."""
    if len(text) <= most:
        return text
    n = most // (4 * BLOCK)
    starts = np.linspace(0, len(text) - 4 * BLOCK, n).astype(int)
    return b"".join(text[s:s + 4 * BLOCK] for s in starts)


def fit(documents: DataFrame, labels: DataFrame, allowed: Column, target: str = "quality", per_class: int = PER_CLASS) -> dict:
    """Weights and offset; trained in one task on at most ``2 * per_class`` rows."""
    rate = label_rate(labels, target, allowed)
    prior = math.log(rate / (1 - rate))
    sample = materialised(labelled_sample(documents, labels, target, per_class, allowed))
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return {"net": None, "offset": prior}
    names = list(initial())

    def run(batches):
        rows = []
        for batch in batches:
            rows += [(d, shortened(t), y) for d, t, y in zip(batch.column("doc_id").to_pylist(), raw_texts(batch), batch.column("label").to_pylist())]
        if rows:
            rows.sort()
            net = train([t for _, t, _ in rows], [y for *_, y in rows])
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([net[k].ravel().tolist() for k in names], pa.list_(pa.float32()))],
                                             names=["name", "values"])

    shapes = {k: v.shape for k, v in initial().items()}
    got = sample.coalesce(1).mapInArrow(run, "name string, values array<float>").collect()
    net = {r["name"]: np.array(r["values"], np.float32).reshape(shapes[r["name"]]) for r in got}
    return {"net": net, "offset": prior - math.log(sizes[1] / sizes[0])}


def score(docs: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus score (probability of label 1) of every whole text."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + ", score double"
    net, offset = model["net"], model["offset"]

    def run(batches):
        for batch in batches:
            z = logits(raw_texts(batch, "__text"), net).astype(float) if net else np.zeros(batch.num_rows)
            p = 1 / (1 + np.exp(-np.clip(z + offset, -60, 60)))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(p, pa.float64())], names=[*keep, "score"])

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)

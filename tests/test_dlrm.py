"""DLRM: gradients, numpy forward vs a plain loop, Spark scorer, training."""

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from menurec.operators import dlrm
from menurec.operators.dlrm import (DLRMConfig, adam_step, backward, bce_with_logits, dlrm_loss,
                                    dlrm_score, dlrm_train, forward, init_params,
                                    load_weights, predict, save_weights)

SMALL = dict(num_embeddings=12, embed_dim=8, bottom=(16, 8), top=(16, 16),
             n_sparse=3, n_dense=2)


def naive_forward(p, xs, xd):
    out = []
    for s, x in zip(xs, xd):
        e = sum(p["emb"][c] for c in s)
        h = np.maximum(np.maximum(x @ p["bw0"] + p["bb0"], 0) @ p["bw1"] + p["bb1"], 0)
        z = np.concatenate([h, e])
        pairs = [z[i] * z[j] for i in range(len(z)) for j in range(i, len(z))]
        u = np.concatenate([np.array(pairs), h])
        t = np.maximum(np.maximum(u @ p["tw0"] + p["tb0"], 0) @ p["tw1"] + p["tb1"], 0)
        out.append((t @ p["tw2"] + p["tb2"])[0])
    return np.array(out)


def test_default_size_matches_source():
    cfg = DLRMConfig()
    assert cfg.top_in == 33024
    assert cfg.n_params() == 4296449


def test_forward_matches_loop():
    cfg = DLRMConfig(**SMALL)
    p = {k: v.astype(np.float64) for k, v in init_params(cfg).items()}
    rng = np.random.default_rng(1)
    xs = rng.integers(0, 12, (9, 3))
    xd = rng.standard_normal((9, 2))
    assert np.allclose(forward(p, xs, xd), naive_forward(p, xs, xd))


def test_gradients_match_finite_differences():
    cfg = DLRMConfig(**SMALL)
    p = {k: v.astype(np.float64) for k, v in init_params(cfg).items()}
    rng = np.random.default_rng(2)
    xs = rng.integers(0, 12, (6, 3))
    xd = rng.standard_normal((6, 2))
    y = (rng.random(6) > 0.5).astype(np.float64)
    logits, cache = forward(p, xs, xd, keep=True)
    _, g = bce_with_logits(logits, y)
    grads = backward(p, cache, g.astype(np.float64))
    eps = 1e-6
    for k, a in p.items():
        for _ in range(4):
            idx = tuple(int(rng.integers(0, s)) for s in a.shape)
            old = a[idx]
            a[idx] = old + eps
            up = bce_with_logits(forward(p, xs, xd), y)[0]
            a[idx] = old - eps
            down = bce_with_logits(forward(p, xs, xd), y)[0]
            a[idx] = old
            assert abs((up - down) / (2 * eps) - grads[k][idx]) < 1e-6


def _toy(spark, n=2000, seed=3):
    rng = np.random.default_rng(seed)
    xs = rng.integers(0, 12, (n, 3))
    xd = rng.random((n, 2))
    y = ((xs[:, 0] % 2 == 0) ^ (xd[:, 0] > 0.5)).astype(int)
    pdf = pd.DataFrame({"a": xs[:, 0], "b": xs[:, 1], "c": xs[:, 2],
                        "x": xd[:, 0], "w": xd[:, 1], "purchased": y})
    return spark.createDataFrame(pdf)


def test_spark_scorer_equals_local(spark):
    cfg = DLRMConfig(**SMALL)
    p = init_params(cfg)
    df = _toy(spark, 300)
    scored = dlrm_score(df, p, cfg, ["a", "b", "c"], ["x", "w"], partitions=3).toPandas()
    local = predict(p, scored[["a", "b", "c"]].to_numpy(), scored[["x", "w"]].to_numpy(np.float32))
    assert np.allclose(scored["prediction"].to_numpy(), local, atol=1e-5)


def test_null_codes(spark):
    cfg = DLRMConfig(**SMALL)
    p = init_params(cfg)
    df = spark.createDataFrame([(1, None, 2, 0.1, 0.2, 1), (1, 2, 3, 0.3, 0.4, 0)],
                               "a int, b int, c int, x double, w double, purchased int")
    with pytest.raises(Exception):
        dlrm_score(df, p, cfg, ["a", "b", "c"], ["x", "w"]).collect()
    assert dlrm_score(df, p, cfg, ["a", "b", "c"], ["x", "w"], null_codes="drop").count() == 1
    assert dlrm_score(df, p, cfg, ["a", "b", "c"], ["x", "w"], null_codes="reserve").count() == 2


def test_training_reduces_loss(spark):
    cfg = DLRMConfig(**SMALL, epochs=3, lr=1e-2, batch_size=64)
    train = _toy(spark, 2000, 4)
    val = _toy(spark, 500, 5)
    before = dlrm_loss(val, init_params(cfg), cfg, ["a", "b", "c"], ["x", "w"])
    res = dlrm_train(train, val, cfg, ["a", "b", "c"], ["x", "w"])
    losses = [h["train_loss"] for h in res.history]
    assert losses[-1] < losses[0]
    assert min(h["val_loss"] for h in res.history) < before
    assert res.best_epoch >= 1


COLS = (["a", "b", "c"], ["x", "w"])


def _by_hand(pdf, cfg):
    """Sequential AdamW over the rows of one shard, in plain numpy."""
    p = {k: v.astype(np.float64) for k, v in init_params(cfg).items()}
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    losses, step = [], 0
    for _ in range(cfg.epochs):
        for s in range(0, len(pdf), cfg.batch_size):
            part = pdf.iloc[s:s + cfg.batch_size]
            xs, xd = part[COLS[0]].to_numpy(), part[COLS[1]].to_numpy()
            logits, cache = forward(p, xs, xd.astype(np.float32).astype(np.float64), keep=True)
            loss, g = bce_with_logits(logits, part["purchased"].to_numpy(np.float64))
            step += 1
            adam_step(p, backward(p, cache, g), m, v, step, cfg)
            losses.append(loss)
    return p, losses


def test_one_shard_is_sequential_training(spark):
    cfg = DLRMConfig(**SMALL, epochs=2, batch_size=32, shard_rows=4096, precision="float64")
    train = _toy(spark, 500, 6).withColumn("id", F.monotonically_increasing_id())
    got = dlrm_train(train.repartition(5), None, cfg, *COLS, order=["id"])
    want, losses = _by_hand(train.orderBy("id").toPandas(), cfg)
    for k in want:
        assert np.allclose(got.params[k], want[k], rtol=1e-9, atol=1e-12)
    assert np.isclose(got.history[0]["train_loss"], np.mean(losses[:16]))
    assert np.isclose(got.history[1]["train_loss"], np.mean(losses[16:]))


def test_training_is_the_same_on_any_partitions(spark, monkeypatch):
    """Several shards, two levels of averaging, two rounds an epoch."""
    monkeypatch.setattr(dlrm, "AVERAGE_FAN", 2)
    cfg = DLRMConfig(**SMALL, epochs=2, batch_size=32, shard_rows=128, rounds_per_epoch=2)
    train, val = _toy(spark, 800, 6), _toy(spark, 300, 7)
    runs = []
    for n in (1, 4, 7):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", str(n + 1))
        try:
            runs.append(dlrm_train(train.repartition(n), val.repartition(n), cfg, *COLS))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    for other in runs[1:]:
        assert other.history == runs[0].history
        for k in other.params:
            assert np.array_equal(runs[0].params[k], other.params[k])
    rows = sorted(map(tuple, runs[0].ledger.select("epoch", "round", "shard", "rows", "batches", "steps").collect()))
    # 6 shards of 128 rows (4 batches, 2 a round) and one of 32 (one batch, in the first round)
    want, step = [], 0
    for epoch in (1, 2):
        for r in (0, 1):
            want += [(epoch, r, s, 64, 2, step + 2) for s in range(6)] + [(epoch, r, 6, 32, 1, step + 1)] * (r == 0)
            step += 2
    assert rows == sorted(want)


def test_a_group_writes_one_state(spark, monkeypatch):
    """A task averages the states of its shards; the result is that of a state per shard."""
    cfg = DLRMConfig(**SMALL, epochs=2, batch_size=32, shard_rows=128, precision="float64")
    train, size = _toy(spark, 800, 6), 3 * cfg.n_params() * 8
    monkeypatch.setattr(dlrm, "GROUP_ROWS", 1)
    average, states = dlrm._average, []

    def seen(df, n, precision):
        states.append((n, df.select("shard").distinct().count()))
        return average(df, n, precision)

    monkeypatch.setattr(dlrm, "_average", seen)
    runs = []
    for held in (7, 3):
        monkeypatch.setattr(dlrm, "STATE_BYTES", held * size)
        runs.append(dlrm_train(train, None, cfg, *COLS))
    assert states == [(7, 7)] * 2 + [(3, 3)] * 2   # 7 shards: alone, then by three
    for k in runs[0].params:
        assert np.allclose(runs[0].params[k], runs[1].params[k], rtol=1e-9, atol=1e-12)
    ledgers = [sorted(map(tuple, r.ledger.select("epoch", "shard", "rows", "batches", "steps").collect())) for r in runs]
    assert ledgers[0] == ledgers[1] and len(ledgers[0]) == 14


def test_small_shards_share_tasks(spark):
    df = spark.range(2000)
    assert dlrm.shards(df, ["id"], 64).rdd.getNumPartitions() == 1
    got = dlrm._grouped(df, ["id"], 64, ["id"], dlrm.STATE_BYTES // 4)[0]   # four states allowed, 32 shards
    assert got.rdd.getNumPartitions() == 1 and dlrm._group_size(32, 16_384, dlrm.STATE_BYTES // 4) == 8


def test_scores_do_not_depend_on_the_pass(spark):
    cfg = DLRMConfig(**SMALL)
    p = init_params(cfg)
    pdf = _toy(spark, 700, 3).toPandas()
    xs, xd = pdf[COLS[0]].to_numpy(), pdf[COLS[1]].to_numpy().astype(np.float32)
    assert np.allclose(dlrm.predict(p, xs, xd), dlrm.predict(p, xs, xd, 256), rtol=1e-5, atol=1e-6)


def test_scoring_by_code(monkeypatch):
    """Rows of a code multiplied together, one unit 0 in every row, several passes
    over the pairs: the loop's logits.  A model of large tables goes row by row."""
    cfg = DLRMConfig(**SMALL)
    p = {k: v.astype(np.float64) for k, v in init_params(cfg).items()}
    p["bb1"][2] = -100.0
    rng = np.random.default_rng(4)
    xs, xd = rng.integers(0, 12, (50, 3)), rng.standard_normal((50, 2))
    want = naive_forward(p, xs, xd)
    monkeypatch.setattr(dlrm, "SCORE_BATCH", 16)
    monkeypatch.setattr(dlrm, "RUN_BYTES", 16 * 8 * 20)
    passes, plain = [], dlrm.forward
    monkeypatch.setattr(dlrm, "forward", lambda *a: passes.append(1) or plain(*a))
    score = dlrm.scorer(p)
    assert np.allclose(score(xs, xd), want, rtol=1e-10) and np.allclose(score(xs[:1], xd[:1]), want[:1], rtol=1e-10)
    assert not passes and len(score(xs[:0], xd[:0])) == 0
    monkeypatch.setattr(dlrm, "TABLE_BYTES", 0)
    assert np.allclose(dlrm.scorer(p)(xs, xd), want, rtol=1e-10) and passes


def test_passes_hold_few_pairs():
    """The source's model on one batch: its pairs (34 MB) and their matrices
    (67 MB) are never held, and scoring takes the pairs of h alone."""
    cfg = DLRMConfig()
    p = init_params(cfg)
    rng = np.random.default_rng(5)
    xs, xd = rng.integers(0, 142, (256, 9)), rng.random((256, 5)).astype(np.float32)
    peak = {}

    def held(name, f):
        tracemalloc.start()
        got = f()
        peak[name] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return got

    logits, cache = held("forward", lambda: forward(p, xs, xd, keep=True))
    grads = held("backward", lambda: backward(p, cache, logits / 256))
    score = dlrm.scorer(p)
    score(xs, xd)   # makes the tables
    scored = held("score", lambda: score(xs, xd))
    assert peak["forward"] < 8 << 20 and peak["score"] < 8 << 20
    assert peak["backward"] < grads["tw0"].nbytes + (8 << 20)
    assert np.allclose(scored, logits, atol=1e-5)


def test_gradients_of_columns_of_zeros(monkeypatch):
    """A unit that is 0 in every row gets no gradient, an embedding column of zeros does."""
    monkeypatch.setattr(dlrm, "RUN_BYTES", 1)
    cfg = DLRMConfig(**SMALL)
    p = {k: v.astype(np.float64) for k, v in init_params(cfg).items()}
    p["bb1"][2], p["emb"][:, 3] = -100.0, 0.0
    rng = np.random.default_rng(6)
    xs, xd = rng.integers(0, 12, (6, 3)), rng.standard_normal((6, 2))
    y = (rng.random(6) > 0.5).astype(np.float64)
    logits, cache = forward(p, xs, xd, keep=True)
    assert np.allclose(logits, naive_forward(p, xs, xd))
    grads = backward(p, cache, bce_with_logits(logits, y)[1])
    assert not grads["bw1"][:, 2].any() and grads["emb"][:, 3].any()
    for k, idx in [("emb", (int(xs[0, 0]), 3)), ("emb", (int(xs[1, 1]), 0)), ("bw1", (4, 2)), ("bw1", (4, 1)),
                   *(("tw0", (i, 5)) for i in (0, 2, 16, 31, 60, 100, 135, 136, 143))]:
        old, losses = p[k][idx], []
        for step in (1e-6, -1e-6):
            p[k][idx] = old + step
            losses.append(bce_with_logits(forward(p, xs, xd), y)[0])
        p[k][idx] = old
        assert abs((losses[0] - losses[1]) / 2e-6 - grads[k][idx]) < 1e-6
    p["tw0"][dlrm._starts(16)[2]] = np.nan   # a weight of the unit that is 0
    assert np.isnan(forward(p, xs, xd)).all() and np.isnan(dlrm.scorer(p)(xs, xd)).all()


def test_optimiser_steps_in_parts(monkeypatch):
    cfg = DLRMConfig(**SMALL)
    rng = np.random.default_rng(7)
    runs = []
    grads = [{k: rng.standard_normal(a.shape).astype(np.float32) for k, a in init_params(cfg).items()} for _ in range(2)]
    for floats in (1, 50, 1 << 20):
        monkeypatch.setattr(dlrm, "STEP_FLOATS", floats)
        p = init_params(cfg)
        m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
        for t, g in enumerate(grads, 1):
            adam_step(p, g, m, v, t, cfg)
        runs.append((p, m, v))
    for k, first in init_params(cfg).items():
        m = v = 0.0
        for t, g in enumerate(grads, 1):
            first = first * (1 - cfg.lr * cfg.weight_decay)
            m, v = 0.9 * m + 0.1 * g[k], 0.999 * v + 0.001 * g[k] ** 2
            first = first - cfg.lr * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + cfg.eps)
        assert np.allclose(runs[0][0][k], first, rtol=1e-5, atol=1e-7)
        assert all(np.array_equal(a[k], b[k]) for other in runs[1:] for a, b in zip(runs[0], other))


def test_loss_scores_batches_together(spark):
    cfg = DLRMConfig(**SMALL, batch_size=32, shard_rows=64, precision="float64")
    p = {k: v.astype(np.float64) for k, v in init_params(cfg).items()}
    df = _toy(spark, 300, 9)
    assert [[len(b[3]) for b in few] for few in dlrm._joined((0, None, None, [0] * n) for n in (5000, 4000, 3, 8192, 2))] \
        == [[5000, 4000], [3, 8192], [2]]
    got = sorted(map(tuple, dlrm.dlrm_loss_parts(df, p, cfg, *COLS).collect()))
    data = dlrm._grouped(df, [*COLS[0], *COLS[1], "purchased"], 64, None)[0].toArrow()
    want = {}
    for s, xs, xd, y in dlrm._mini_batches(data.sort_by([("shard", "ascending"), ("pos", "ascending")]).to_batches(),
                                           cfg, *COLS, "purchased", "error"):
        want[int(s)] = want.get(int(s), 0.0) + bce_with_logits(forward(p, xs, xd), y)[0]
    assert [g[0] for g in got] == sorted(want) and np.allclose([g[3] for g in got], [want[g[0]] for g in got])


def test_average_of_shards(spark, monkeypatch):
    monkeypatch.setattr(dlrm, "AVERAGE_FAN", 3)
    monkeypatch.setattr(dlrm, "CHUNK_FLOATS", 4)
    rng = np.random.default_rng(1)
    states, sizes = rng.standard_normal((20, 10)).astype(np.float32), rng.integers(1, 50, 20)
    rows = [(s, c, int(sizes[s]), 1, 1, 0.0, 0.0, states[s, i:i + 4].tobytes())
            for s in range(20) for c, i in enumerate(range(0, 10, 4))]
    got = dlrm._average(spark.createDataFrame(rows, dlrm._ROUND_SCHEMA), 20, "float32")
    assert np.allclose(got, (states * sizes[:, None]).sum(axis=0) / sizes.sum(), rtol=1e-5)


def test_mini_batches_stream():
    """Batches break at shards and never wait for a whole partition."""
    cfg = DLRMConfig(**SMALL, batch_size=4)
    shard = [0] * 9 + [1] * 3 + [5] * 4
    table = pa.table({"shard": pa.array(shard, pa.int64()), **{c: pa.array(range(16)) for c in "abc"},
                      "x": [0.5] * 16, "w": [None] + [1.0] * 15, "purchased": [i % 2 for i in range(16)]})
    cfg.num_embeddings = 16
    taken = []

    def feed():
        for at in range(0, 16, 3):
            taken.append(at)
            yield from table.slice(at, 3).to_batches()

    got = []
    for s, xs, xd, y in dlrm._mini_batches(feed(), cfg, *COLS, "purchased", "error"):
        got.append((s, xs[:, 0].tolist()))
        if len(got) == 1:
            assert taken == [0, 3] and xd[0, 1] == 0.0
    assert got == [(0, [0, 1, 2, 3]), (0, [4, 5, 6, 7]), (0, [8]), (1, [9, 10, 11]), (5, [12, 13, 14, 15])]


def test_shards_number_rows(spark):
    df = spark.range(1000).selectExpr("cast((id * 7919) % 1000 as int) as a").repartition(6)
    got = dlrm.shards(df, ["a"], 64, ["a"])
    assert [(r.shard, r.pos) for r in sorted(got.collect(), key=lambda r: r.a)] == [(i // 64, i) for i in range(1000)]
    parts = got.select("shard", F.spark_partition_id().alias("p")).distinct()
    assert parts.count() == 16   # a shard lies in one partition
    assert dlrm.shards(df.limit(0), ["a"], 64).count() == 0


def test_loss_parts(spark):
    cfg = DLRMConfig(**SMALL, batch_size=32, shard_rows=64, precision="float64")
    p = {k: v.astype(np.float64) for k, v in init_params(cfg).items()}
    df = _toy(spark, 150, 9).withColumn("id", F.monotonically_increasing_id())
    pdf = df.orderBy("id").toPandas()
    xd = pdf[COLS[1]].to_numpy().astype(np.float32).astype(np.float64)
    logits, y = forward(p, pdf[COLS[0]].to_numpy(), xd), pdf["purchased"].to_numpy(np.float64)
    batches = [bce_with_logits(logits[s:s + 32], y[s:s + 32])[0] for s in range(0, 150, 32)]
    got = sorted(map(tuple, dlrm.dlrm_loss_parts(df, p, cfg, *COLS, order=["id"]).collect()))
    assert [g[:3] for g in got] == [(0, 64, 2), (1, 64, 2), (2, 22, 1)]
    assert np.allclose([g[3] for g in got], [sum(batches[:2]), sum(batches[2:4]), batches[4]])
    assert np.isclose(dlrm_loss(df, p, cfg, *COLS, order=["id"]), np.mean(batches))
    assert np.isnan(dlrm_loss(df.limit(0), p, cfg, *COLS))
    with pytest.raises(ValueError):
        dlrm_train(df.limit(0), None, cfg, *COLS)
    with pytest.raises(ValueError):
        dlrm_train(df, None, DLRMConfig(**SMALL, batch_size=32, shard_rows=100), *COLS)


def test_weights_round_trip(spark, tmp_dir):
    cfg = DLRMConfig(**SMALL)
    p = init_params(cfg)
    save_weights(spark, p, f"{tmp_dir}/w")
    q = load_weights(spark, f"{tmp_dir}/w")
    for k in p:
        assert np.array_equal(p[k], q[k])


def test_training_row_cap_is_deterministic(spark):
    from menurec.operators.split import capped
    cfg = DLRMConfig(**SMALL, epochs=1, batch_size=64)
    train = _toy(spark, 600, 8)
    cols = ["a", "b", "c", "x", "w", "purchased"]
    assert capped(train, cols, 200).count() == 200
    a = dlrm_train(train, None, cfg, ["a", "b", "c"], ["x", "w"], max_rows=200)
    b = dlrm_train(train.repartition(5), None, cfg, ["a", "b", "c"], ["x", "w"], max_rows=200)
    assert a.history[0]["train_loss"] == b.history[0]["train_loss"]

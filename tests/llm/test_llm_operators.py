"""Brute-force checks of the numbered operators on small inputs."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from menurec.llm import bwt_dedup, byte_cnn, decontaminate, licenses, mixing, recurrent_lm, secret_scan, simhash, toxicity, va_file
from menurec.llm.queries import QUERIES
from menurec.session import ship_package

SF = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SPACES = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def small(spark):
    ship_package(spark)
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(small):
    return {r["doc_id"]: r["text"] for r in small.collect()}


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def odd_docs(spark):
    """Nulls in every column, empty, repeated, very long and clashing names."""
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    rows = [(1, base, "en", "a", 3), (2, base, "en", None, None), (2, base, "en", None, None), (3, "", None, "b", 0), (4, None, "en", "b", 0),
            (None, base, "en", "a", 1), (None, None, None, None, None), (5, "x " * 30000, "en", "a", 9), (6, "é€ \U0001d11e " * 40, "fr", "c", 2),
            (7, "word", "en", "c", 4), (7, "other word", "en", "c", 4)]
    frame = spark.createDataFrame(rows, DOC)
    return frame.withColumns({c: F.lit(1) for c in ("score", "fp", "size", "row", "label", "word", "place", "path", "spans", "base")})


# --- 1 mixing -----------------------------------------------------------------

def slow_targets(sizes):
    names = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target = {s: 1.5 * sum(sizes.values()) * weight[s] / sum(weight.values()) for s in names}
    capped = set()
    for _ in range(200):
        excess = sum(max(0.0, target[s] - 2 * sizes[s]) for s in names)
        for s in names:
            if target[s] >= 2 * sizes[s] - 1e-12:
                target[s] = 2.0 * sizes[s]
                capped.add(s)
        free = [s for s in names if s not in capped]
        if excess < 1e-9 or not free:
            break
        for s in free:
            target[s] += excess * weight[s] / sum(weight[x] for x in free)
    return target


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.one_of(st.none(), st.text("abé\U0001d11e", max_size=3)), st.integers(0, 1000), min_size=1, max_size=8))
def test_targets(sizes):
    got, want = mixing.source_targets(sizes), slow_targets(sizes)
    assert got.keys() == want.keys()
    assert all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-6) for s in want)


def best_cost(supply, members, quotas, repeats):
    """Largest flow and its least cost by trying all splits (tiny inputs)."""
    from itertools import product

    best = (0, 0)
    edges = [(p, s) for p, m in enumerate(members) for s in m]
    for split in product(*[range(repeats * supply[p] + 1) for p, _ in edges]):
        out, into = Counter(), Counter()
        for (p, s), x in zip(edges, split):
            out[p] += x
            into[s] += x
        if any(out[p] > repeats * supply[p] for p in out) or any(into[s] > quotas[s] for s in into):
            continue
        cost = sum(max(0, min(supply[p], out[p] - k * supply[p])) * k for p in out for k in range(repeats))
        best = max(best, (sum(split), -cost))
    return best


@pytest.mark.parametrize("seed", range(12))
def test_flow_is_cheapest(seed):
    rng = random.Random(seed)
    n, k = rng.randint(1, 2), rng.randint(1, 2)
    members = [sorted(rng.sample(range(k), rng.randint(1, k))) for _ in range(n)]
    supply, quotas = [rng.randint(0, 3) for _ in range(n)], [rng.randint(0, 5) for _ in range(k)]
    flow = mixing.cheapest_flow(supply, members, quotas, 2)
    total = [sum(f.values()) for f in flow]
    cost = sum(max(0, t - s) for t, s in zip(total, supply))
    assert (sum(total), -cost) == best_cost(supply, members, quotas, 2)
    assert all(sum(f.get(s, 0) for f in flow) <= q for s, q in enumerate(quotas))


def test_mixing(spark, small):
    rows = QUERIES["op1_mixing"](spark, SF).collect()
    again = QUERIES["op1_mixing"](spark, SF).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    docs = {r["doc_id"]: r for r in small.collect()}
    size = {d: len(SPACES.findall(r["text"] or "")) for d, r in docs.items()}
    total = Counter()
    for d, r in docs.items():
        total[r["source"]] += size[d]
    want, taken, longest = slow_targets(total), Counter(), Counter()
    assert len(rows) == len(docs)
    for r in rows:
        s = docs[r["doc_id"]]["source"]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == total[s] and math.isclose(r["target"], want[s])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
        longest[s] = max(longest[s], r["size"])
    assert all(abs(taken[s] - want[s]) <= max(2, longest[s] / 2) for s in want)


def test_mixing_overlap(spark):
    rows = [(i, ["a"] if i % 3 == 0 else ["a", "b"] if i % 3 == 1 else ["b", None], 10 + i % 7) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, member array<string>, n bigint")
    total = sum(n for *_, n in rows)
    out = mixing.mix(docs, F.col("member"), F.col("n"), {"a": 0.5 * total, "b": 0.8 * total}).collect()
    assert len(out) == 300 and all(r["copies"] in (0, 1, 2) for r in out)
    assert abs(sum(r["taken"] for r in out) - 1.3 * total) < 40


# --- 2 top-k ------------------------------------------------------------------

def slow_top(rows, k=20):
    vec = []
    for i, x in rows:
        if i is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        vec.append((i, [math.floor(64 * v) for v in x]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for at, (q, x) in enumerate(vec):
        if q % 20 == 0:
            best = sorted((-dot(x, v), i) for n, (i, v) in enumerate(vec) if n != at)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_topk_cases(spark):
    ship_package(spark)
    rng = random.Random(4)
    rows = [(i, [rng.choice([-0.4, 0.0, 0.3, 0.31]) for _ in range(5)]) for i in range(300)]
    rows += [(400, [1e300] + [0.0] * 4), (420, None), (440, [None, 1.0, 1.0, 1.0, 1.0]), (None, [1.0] * 5), (460, [float("nan")] * 5), (480, [0.5, 0.5]), (20, [0.9] * 5)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted(map(tuple, va_file.top_k(frame.filter("vec_id <> 400 or vec_id is null"), F.col("vec_id") % 20 == 0).collect()))
    assert got == slow_top([r for r in rows if r[0] != 400])
    assert va_file.top_k(frame, F.col("vec_id") % 20 == 0).count() > 0  # beyond double precision
    assert va_file.top_k(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_topk_blocks(spark, monkeypatch):
    monkeypatch.setattr(va_file, "CANDIDATE_BLOCK", 60)
    monkeypatch.setattr(va_file, "QUERY_BLOCK", 7)
    frame = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = sorted(map(tuple, va_file.top_k(frame, F.col("vec_id") % 20 == 0).collect()))
    assert got == slow_top([(r["vec_id"], r["embedding"]) for r in frame.collect()])


# --- 3 language model ---------------------------------------------------------

def test_lm_counts_and_base(spark, texts, monkeypatch):
    monkeypatch.setattr(recurrent_lm, "MAX_LOOKUP", 300)  # most words take the joined path
    rows = QUERIES["op3_lm_score"](spark, SF).collect()
    tokens = {d: lower(t).encode().split() + [None] for d, t in texts.items()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    count = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(count.values()), len(count)
    assert len(rows) == len(texts)
    better = 0
    for r in rows:
        ws = tokens[r["doc_id"]]
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(ws), sum(count[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        better += r["score"] > base
    assert better > 0.8 * len(rows)


def tiny_vocabulary():
    v = object.__new__(recurrent_lm.Vocabulary)
    v.ends, v.tokens, v.kinds = 10, 100, 40
    v.head = v.words = [b"w%d" % i for i in range(30)]
    v.counts = np.arange(30, 0, -1)
    v.class_n, v.class_v = np.full(recurrent_lm.TAIL_CLASSES, 2.0), np.full(recurrent_lm.TAIL_CLASSES, 1.0)
    return v


def test_lm_gradients_and_lanes():
    rng = np.random.default_rng(0)
    net = {k: v.astype(np.float64) for k, v in recurrent_lm.initial(tiny_vocabulary()).items()}
    texts = [np.append(rng.choice([*range(1, 31), recurrent_lm.HEAD + 3], n), 0).astype(np.int32) for n in (3, 0, 9, 5)]
    tokens, target, mask, owner, live = next(recurrent_lm.windows(texts, 3))
    state = np.zeros((live, recurrent_lm.HIDDEN))
    loss, grad, _ = recurrent_lm.gradients(net, tokens, target, mask, state)
    for name in ("u", "inp", "bias", "wc", "wh"):
        at = np.unravel_index(np.abs(grad[name]).argmax(), grad[name].shape)
        eps = 1e-3
        moved = {k: v.copy() for k, v in net.items()}
        moved[name][at] += eps
        up = recurrent_lm.gradients(moved, tokens, target, mask, state)[0]
        moved[name][at] -= 2 * eps
        down = recurrent_lm.gradients(moved, tokens, target, mask, state)[0]
        assert math.isclose((up - down) / (2 * eps), grad[name][at], rel_tol=0.05, abs_tol=1e-5), name
    # packing, lanes and windows change nothing
    net = {k: v.astype(np.float32) for k, v in net.items()}
    long = texts + [np.append(rng.integers(1, 31, 200), 0).astype(np.int32)]
    together = recurrent_lm.log_likelihood(net, long, 3)
    alone = [recurrent_lm.log_likelihood(net, [t])[0] for t in long]
    assert np.allclose(together, alone, rtol=1e-4)


def test_lm_reads_texts_together(spark, monkeypatch):
    """Ids and classes made for many words at once are those of each word alone."""
    rng = np.random.default_rng(7)
    pool = np.frombuffer(b"abW \t\n\x0b\x0c\r\x1c\x00\x08\x0e\xc3\xa9", np.uint8)
    texts = [b"", b" ", b"a", b"ab ", b"W1 w2 unknown", b"\x1cab\x0bAB", b"x" * 500] + [rng.choice(pool, n).tobytes() for n in rng.integers(0, 40, 300)]
    head = tiny_vocabulary().inputs()
    plain = [[head.get(w) or recurrent_lm.HEAD + recurrent_lm.tail_class(w) for w in t.lower().split()] + [0] for t in texts]
    for size in (1 << 19, 16):
        monkeypatch.setattr(recurrent_lm, "READ_BYTES", size)
        assert [s.tolist() for s in recurrent_lm.sequences(texts, head)] == plain
        assert not list(recurrent_lm.sequences([], head))
    docs = spark.createDataFrame([("a ab abc abcd é €uro",), (None,), ("A",)], "text string")
    got = {r["word"]: (r["n"], r["cls"]) for r in recurrent_lm.word_counts(docs).collect()}
    assert got == {w: (n, recurrent_lm.tail_class(w.encode())) for w, n in [("a", 2), ("ab", 1), ("abc", 1), ("abcd", 1), ("é", 1), ("€uro", 1), ("", 3)]}


def test_lm_softmax_against_plain(monkeypatch):
    """Blocks of rows and groups of classes change no bit; the sums are the plain softmax, also of logits that overflow."""
    rng = np.random.default_rng(8)
    net = recurrent_lm.initial(tiny_vocabulary())
    net["wh"] += rng.standard_normal(net["wh"].shape).astype(np.float32)
    hidden = rng.standard_normal((700, recurrent_lm.HIDDEN)).astype(np.float32)
    target = rng.integers(0, recurrent_lm.INPUTS, 700)
    target[:300] = rng.integers(0, 40, 300)

    def plain(h, w):
        log_softmax = lambda x: x - x.max() - np.log(np.exp(x - x.max()).sum())
        c = recurrent_lm.CLASS_OF[w]
        x = log_softmax(h @ net["wc"].astype(float) + net["bc"])[c]
        return x if w >= recurrent_lm.HEAD else x + log_softmax(h @ net["wh"][c].astype(float) + net["bh"][c])[w % recurrent_lm.CLASS_WORDS]

    for factor in (1, 60):
        h = hidden * np.float32(factor)
        logp, grad = recurrent_lm.outputs(net, h, target, want_gradient=True)
        assert np.allclose(logp, [plain(a.astype(float), w) for a, w in zip(h, target)], rtol=1e-4, atol=1e-3)
        with monkeypatch.context() as m:
            m.setattr(recurrent_lm, "HEAD_ROWS", 7)
            other, small = recurrent_lm.outputs(net, h, target, want_gradient=True)
        if factor == 1:
            assert (logp == other).all() and all((grad[k] == small[k]).all() for k in grad)
            assert (logp == recurrent_lm.outputs(net, h, target)[0]).all()


def test_lm_weights_are_summed_in_parts():
    """A part's sum stays exact in integers, whatever the batches."""
    rng = np.random.default_rng(9)
    rows = [(int(p), rng.integers(-2 ** 40, 2 ** 40, 5)) for p in rng.integers(0, 3, 20)]
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array([p for p, _ in part], pa.int32()), pa.array([w.tobytes() for _, w in part], pa.binary())], names=["part", "w"])
    (out,) = recurrent_lm._part_sums(iter([batch(rows[:3]), batch(rows[3:4]), batch(rows[4:])]))
    got = {p: np.frombuffer(w, np.int64).tolist() for p, w in zip(out.column("part").to_pylist(), out.column("w").to_pylist())}
    assert got == {q: sum(w for p, w in rows if p == q).tolist() for q in {p for p, _ in rows}}
    assert next(recurrent_lm._part_sums(iter([]))).num_rows == 0


# --- 4 quality ----------------------------------------------------------------

def test_cnn_gradients():
    rng = np.random.default_rng(1)
    net = {k: v.astype(np.float64) for k, v in byte_cnn.initial().items()}
    net = {k: v + 0.05 * rng.standard_normal(v.shape) for k, v in net.items()}
    texts = [bytes(rng.integers(32, 120, n).astype(np.uint8)) for n in (0, 50, 300, 900)]
    y = np.array([0, 1, 1, 0], float)
    _, grad = byte_cnn.gradients(texts, y, net)
    for name in net:
        at = np.unravel_index(np.abs(grad[name]).argmax(), grad[name].shape)
        values = []
        for step in (1e-5, -1e-5):
            moved = {k: v.copy() for k, v in net.items()}
            moved[name][at] += step
            values.append(byte_cnn.gradients(texts, y, moved)[0])
        assert math.isclose((values[0] - values[1]) / 2e-5, grad[name][at], rel_tol=0.02, abs_tol=1e-4), name


def test_cnn_pieces(monkeypatch):
    rng = np.random.default_rng(2)
    net = byte_cnn.initial()
    texts = [bytes(rng.integers(32, 120, n).astype(np.uint8)) for n in (0, 5, 128, 121, 7000, 300)]
    whole = byte_cnn.logits(texts, net)
    monkeypatch.setattr(byte_cnn, "PIECE", 1024)
    assert np.allclose(byte_cnn.logits(texts, net), whole, atol=1e-4)
    assert np.allclose([byte_cnn.logits([t], net)[0] for t in texts], whole, atol=1e-4)


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("query, target, modulus, rest", [("op4_quality", "quality", 4, 2), ("op7_toxicity", "toxic", 5, 0)])
def test_classifiers_on_held_out(spark, query, target, modulus, rest):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r[target] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES[query](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == rest)
        assert r["predicted"] == int(r["score"] >= (0.7 if target == "quality" else 0.5))
    pairs = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert auc(pairs) > 0.8


# --- 5 secrets ----------------------------------------------------------------

def slow_secrets(text):
    text = text or ""
    key = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    out = [(m.start(), 0, m.end()) for m in re.finditer(key + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets(spark, texts):
    for r in QUERIES["op5_secrets"](spark, SF).collect():
        want = slow_secrets(texts[r["doc_id"]])
        text = ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == i for _, k, _ in want) for i in range(3))
        assert set(filter(None, text.split(","))) <= set(r["spans"].split(","))


@settings(max_examples=150, deadline=None)
@given(st.text("aAkKiI0f=: \"'passwordtokn_é", max_size=80), st.sampled_from(["", "PassWD='x.y+z9'", "api_key: abcdef", "AKIA" + "Q7" * 9, "deadbeef" * 4, "ſecret=abcdefgh", "toKen=abcdefgh"]))
def test_secret_patterns(noise, planted):
    text = noise[:40] + planted + noise[40:]
    assert secret_scan.scan_text(text.encode())[0] == slow_secrets(text)


def test_battery_and_fdr(spark):
    rng = random.Random(3)
    uniform = ["".join(rng.choices(secret_scan.ALPHABETS["alnum"], k=40)) for _ in range(400)]
    ps = sorted(secret_scan.battery(s, "alnum") for s in uniform)
    assert all(abs(ps[int(q * 400)] - q) < 0.12 for q in (0.25, 0.5, 0.75))
    words = ["".join(rng.choices("aeinorst", k=40)) for _ in range(400)]
    docs = spark.createDataFrame([(i, f"x {a}\n{b}") for i, (a, b) in enumerate(zip(uniform, words))], "doc_id bigint, text string")
    spans = [(s["start"] == 2) for r in secret_scan.secrets(docs).collect() for s in r["spans"] if s["kind"] == 3]
    assert sum(spans) > 300 and spans.count(False) <= 0.1 * len(spans)
    masked = {r["doc_id"]: r["text"] for r in secret_scan.redact(docs).collect()}
    assert len(masked) == 400 and sum("[SECRET]" in t for t in masked.values()) > 300
    assert secret_scan.masked("abcdefgh", [(1, 3), (2, 4), (4, 5), (7, 8)], "*") == "a*fg*"


# --- 6 substring dedup --------------------------------------------------------

def slow_dedup(rows, span=50):
    """(doc_id, n_bytes, n_removed, n_spans, sha) by a table of all strings."""
    rank = lambda d: (d is None, d or 0)
    first = {}
    data = [(d, (t or "").encode()) for d, t in rows]
    for d, b in data:
        for i in range(len(b) - span + 1):
            w = b[i:i + span]
            first[w] = min(first.get(w, rank(d)), rank(d))
    out = []
    for d, b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - span + 1):
            if first[b[i:i + span]] < rank(d):
                gone[i:i + span] = True
        starts = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone]) if b else b""
        out.append((d, len(b), int(gone.sum()), starts, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_substring_dedup(spark, texts):
    got = sorted(map(tuple, QUERIES["op6_substring_dedup"](spark, SF).collect()), key=str)
    assert got == slow_dedup(texts.items())


def test_substring_dedup_hard(spark, monkeypatch):
    monkeypatch.setattr(bwt_dedup, "SLICE", 300)
    monkeypatch.setattr(bwt_dedup, "PART", 110)
    monkeypatch.setattr(bwt_dedup, "AT_ONCE", 40)
    rng = random.Random(8)
    line = "".join(rng.choices("abcd é", k=90))
    rows = [(i, "".join(rng.choices(["ab", "a", "ba", line[:60], line, "€", "z" * 70, line[20:75]], k=rng.randint(0, 9)))) for i in range(60)]
    rows += [(3, rows[5][1]), (3, rows[3][1]), (None, line + "q"), (None, line + "q"), (None, None), (70, ""), (71, line[:49]), (72, line[:50]), (-5, "pre" + line)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = bwt_dedup.dedup(frame).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, out), key=str) == slow_dedup(rows)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "ab" * 20, "a" * 55, "cab" * 18]), max_size=6).map("".join), min_size=1, max_size=8))
def test_substring_core(texts):
    part = bwt_dedup.Slice(50)
    for i, t in enumerate(texts):
        for _ in part.add(i, 0, t.encode()):
            pass
    spans = defaultdict(list)
    for bucket in range(3):
        blobs = [b for k, b in part.blobs(3) if k == bucket]
        for doc, _, start, end in bwt_dedup.repeated_spans(blobs, 50) if blobs else ():
            for d, s, e in zip(doc, start, end):
                spans[int(d)].append((int(s), int(e)))
    want = {r[0]: (r[2], r[3]) for r in slow_dedup(list(enumerate(texts)))}
    for i in range(len(texts)):
        runs = sorted(spans[i])
        s, e = bwt_dedup.merged(*(np.array(x) for x in zip(*runs))) if runs else (np.empty(0), np.empty(0))
        assert (int((e - s).sum()), len(s)) == want[i]


# --- 7 toxicity ---------------------------------------------------------------

def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc", min_size=4, max_size=10), min_size=1, max_size=5, unique=True), st.text("abcd", max_size=12))
def test_automaton(terms, word):
    want = None
    for i, t in enumerate(terms):
        d = min(edits(word[:k], t) for k in range(len(word) + 1))
        if d <= toxicity.edit_budget(t):
            rank = (d, -len(t), i)
            want = rank if want is None else min(want, rank)
    assert toxicity.Matcher(terms).match(word) == (want and (want[2], want[0]))


def test_quotation_and_misspelling():
    lex = toxicity.Lexicon(["disgusting"], {(0, e, q): (0.0 if q else 4.0 - e) for e in range(3) for q in (False, True)}, -2.0)
    m = toxicity.Matcher(lex.terms)
    score = lambda t: lex.score(toxicity.hits(t, m))
    assert score("you are disgustng") > 0.5 > score('the report quoted "you are disgusting" twice')
    assert score("nothing here") == score("") < 0.5


@pytest.mark.parametrize("text", ["an id1ot here", "idi0t", "you st*pid", "a m0ron!", "p@thetic", "oh-st*pid-you", "1diot", "st-upid"])
def test_signs_in_place_of_letters(text):
    m = toxicity.Matcher(["idiot", "stupid", "moron", "pathetic"])
    found = toxicity.hits(text, m)
    assert [f[1] for f in found] == [1]
    assert all(edits(text[s:e].lower(), m.terms[t]) <= 1 for t, _, _, s, e in found)


@settings(max_examples=200, deadline=None)
@given(st.text("abid1*- ", max_size=30))
def test_joined_words_only_add_hits(text):
    m = toxicity.Matcher(["abbid", "iddab", "baad"])
    found = {f[3:]: f[:2] for f in toxicity.hits(text, m)}
    for word in toxicity.LETTERS.finditer(text):
        if m.match(word[0]):
            assert found[word.span()] == m.match(word[0])
    assert toxicity.hits("well-known co-op, 3rd x2y", m) == []


def test_every_stem_is_kept(spark):
    ship_package(spark)
    words = sorted({"".join(random.Random(n).choices("abcdefghijklmnop", k=9)) for n in range(700)})
    words = list({w[:4]: w for w in words}.values())
    rows = [(i, " ".join(words) if i % 2 else f"plain text {i}") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id bigint, toxic int")
    lexicon = toxicity.learn(docs, labels, F.lit(True))
    assert len(words) > 600 and sorted(lexicon.terms) == words


# --- 8 decontamination --------------------------------------------------------

def substring_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        old, row = row, [i]
        for j, y in enumerate(text, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return min(row), row.index(min(row))


@settings(max_examples=150, deadline=None)
@given(st.text("abc ", min_size=1, max_size=70), st.text("abcd ", max_size=90))
def test_myers(item, text):
    masks = decontaminate.Items([(0, item)]).mask(0)
    assert decontaminate.myers(masks, len(item), text, len(item)) == substring_distance(item, text)


@settings(max_examples=60, deadline=None)
@given(st.randoms(use_true_random=False), st.integers(0, 8))
def test_planted_items(rng, n_edits):
    words = lambda n: " ".join("".join(rng.choices("etaoinshr", k=rng.randint(2, 8))) for _ in range(n))
    items = [(i, decontaminate.normal(words(15))) for i in range(4)]
    copy = list(items[2][1])
    for _ in range(n_edits):
        at = rng.randrange(len(copy))
        copy[at:at + 1] = rng.choice([[], ["q"], [copy[at], "q"]])
    text = decontaminate.normal(words(20) + " " + "".join(copy) + " " + words(20))
    found = {i: (d, e) for i, d, e in decontaminate.Items(items).search(text)}
    for i, item in items:
        d, _ = substring_distance(item, text)
        assert (i in found) == (d <= decontaminate.edit_budget(item))
        assert i not in found or found[i][0] == d


def test_decontaminate(spark, small, texts):
    bench = {r["item_id"]: decontaminate.normal(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op8_decontaminate"](spark, SF).collect()}
    exact = {(d, i) for d, t in texts.items() for i, b in bench.items() if b in decontaminate.normal(t)}
    assert exact and exact <= got
    assert all(substring_distance(bench[i], decontaminate.normal(texts[d]))[0] <= decontaminate.edit_budget(bench[i]) for d, i in got - exact)
    left = decontaminate.drop_contaminated(small, spark.read.parquet(f"{SF}/benchmark.parquet"), block_bytes=2000)
    assert {r["doc_id"] for r in left.collect()} == set(texts) - {d for d, _ in got} and left.columns == small.columns


# --- 9 simhash ----------------------------------------------------------------

def slow_print(text):
    words = SPACES.findall(lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    """{position: smallest position reachable} by a search over all pairs."""
    near = lambda a, b: bin(a ^ b).count("1") <= 2
    out = {}
    for start in range(len(prints)):
        if start in out:
            continue
        todo, out[start] = [start], start
        while todo:
            a = todo.pop()
            for b in range(len(prints)):
                if b not in out and near(prints[a], prints[b]):
                    out[b] = start
                    todo.append(b)
    return out


def test_simhash(spark, texts):
    rows = {r["doc_id"]: r for r in QUERIES["op9_simhash"](spark, SF).collect()}
    ids = sorted(texts)
    prints = [slow_print(texts[d]) for d in ids]
    comp = slow_components(prints)
    assert len(rows) == len(ids)
    for i, d in enumerate(ids):
        assert rows[d]["fingerprint"] == f"{prints[i]:016x}" and rows[d]["component_id"] == ids[comp[i]]


def test_simhash_chains(spark):
    """Chains and stars of fingerprints, more than one round of contraction."""
    rng = random.Random(5)
    prints = []
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(40):
            prints.append(x)
            x ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
    prints = sorted(set(prints))
    signed = [p - 2 ** 64 if p >= 2 ** 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    root = {r["fp"]: r["root"] for r in simhash.classes(frame).collect()}
    comp = slow_components(prints)
    for i, a in enumerate(signed):
        for j, b in enumerate(signed):
            assert (root[a] == root[b]) == (comp[i] == comp[j])
    pairs = {frozenset((r["a"], r["b"])) for r in simhash.links(frame).collect()}
    assert pairs == {frozenset((a, b)) for i, a in enumerate(signed) for j, b in enumerate(signed) if i < j and bin(prints[i] ^ prints[j]).count("1") <= 2}


# --- 10 licenses --------------------------------------------------------------

def slow_licenses(rows):
    """{id: (license, score)} by comparing all lines with all notices."""
    vocabulary = {w for _, t in licenses.NOTICES for w in licenses.notice_words(t)}
    df = Counter(w for _, t in rows for w in set(licenses.notice_words(t or "")) & vocabulary)
    vectors, idf = licenses.notice_vectors(licenses.NOTICES, len(rows), df)
    out = {}
    for d, t in rows:
        best = None
        for n, line in enumerate((t or "").split("\n")):
            tf = {w: c * idf(w) for w, c in Counter(licenses.notice_words(line)).items()}
            norm = math.sqrt(sum(v * v for v in tf.values()))
            for i, (name, vec) in enumerate(vectors):
                s = round(sum(v * vec.get(w, 0) for w, v in tf.items()) / norm, 9) if norm else 0
                if s >= licenses.THRESHOLD:
                    rank = (s, -n, -i, name)
                    best = rank if best is None else max(best, rank)
        out[d] = best and (best[3], best[0])
    return out


def test_licenses(spark, small, texts):
    rows = QUERIES["op10_licenses"](spark, SF).collect()
    want = slow_licenses(list(texts.items()))
    assert len(rows) == len(texts) and any(want.values())
    for r in rows:
        got = (r["license"], r["score"]) if r["license"] else None
        assert (got and got[0]) == (want[r["doc_id"]] and want[r["doc_id"]][0])
        assert not got or math.isclose(got[1], want[r["doc_id"]][1], abs_tol=1e-6)


def test_license_inheritance(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [("LICENSE", mit), ("a/b/LICENSE", apache), ("a/x", "code"), ("a/b/c/y", "code"), ("/a/b/z", mit + "\n" + "code " * 40), ("q", None), (None, ""), ("a/b/c/y", "code")]
    docs = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], "doc_id bigint, path string, text string")
    got = {r["doc_id"]: (r["license"], r["is_file"], r["inherited"], r["effective"]) for r in licenses.scan(docs, F.col("path")).collect()}
    assert got[2] == (None, False, "MIT", "MIT") and got[3] == got[7] == (None, False, "Apache-2.0", "Apache-2.0")
    assert got[4] == ("MIT", False, "Apache-2.0", "MIT") and got[5][3] == got[6][3] == "MIT" and got[0][1]


def test_license_candidates(spark):
    """Only texts that hold a strong word as a word are kept, joined ones included; words that no template holds are not exploded."""
    texts = ["Released under the MIT License.", "Licensed under Apache+", "sublicensers undergo conversions " * 3, "x\nSPDX-License-Identifier: MIT", "a licensed+ b", "a+b", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "__row bigint, text string")
    short = (*licenses.NOTICES, *licenses.HEADERS)
    counts = licenses.document_frequencies(docs, sorted({w for _, t in (*short, *licenses.TEXTS) for w in licenses.header_words(t)}), licenses.header_words_of)
    near = licenses.can_match(docs, short, licenses.TEXTS, counts, lines=licenses.NOTICES)
    assert {r["__row"] for r in near.collect()} == {0, 1, 3, 4}
    words = spark.createDataFrame([(["b", "a", "b", "c", "b", "a"],), ([],)], "words array<string>")
    assert [r[0] for r in words.select(licenses.squared_counts(F.col("words"))).collect()] == [14.0, 0.0]
    vectors, idf = licenses.notice_vectors([("L", "a b")], 1, {})
    parts = spark.createDataFrame([(1, ["a", "b", "x", "x"]), (2, ["a", "b"]), (2, ["a", "b"]), (3, ["x"]), (4, ["a", "b", "x", "x"]), (4, ["a", "b", "x", "x"])], "k int, words array<string>")
    got = {r["k"]: r["score"] for r in licenses.cosines(parts, ["k"], vectors, idf, ["a", "b"], 0.1).collect()}
    assert got == {1: round(2 / math.sqrt(12), 9), 2: 1.0, 4: round(2 / math.sqrt(12), 9)}


# --- defined cases, pipeline --------------------------------------------------

def test_odd_rows(spark):
    ship_package(spark)
    docs = odd_docs(spark)
    n = docs.count()
    ids = sorted(str(r["doc_id"]) for r in docs.collect())
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 1), (None, None, None), (3, 1, 0)], "doc_id bigint, quality int, toxic int")
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota"), (2, None), (None, "x"), (3, "")], "item_id bigint, text string")
    same = lambda frame: sorted(str(r["doc_id"]) for r in frame.collect()) == ids
    always = F.lit(True)
    for frame in (docs, docs.limit(0)):
        some = frame is docs
        outs = [mixing.mix_by_source(frame), recurrent_lm.train_and_score(frame, always), byte_cnn.score(frame, byte_cnn.fit(frame, labels, always)),
                secret_scan.secrets(frame), bwt_dedup.dedup(frame), toxicity.score(frame, toxicity.learn(frame, labels, always)),
                simhash.near_duplicates(frame), licenses.scan(frame, F.col("source"))]
        for out in outs:
            assert same(out) if some else out.count() == 0
        assert secret_scan.redact(frame).count() == (n if some else 0)
        hits = decontaminate.matches(frame, bench).collect()
        assert sorted(str(r["doc_id"]) for r in hits) == (["1", "2", "2", "None"] if some else [])
        assert decontaminate.matches(frame, bench.limit(0)).count() == 0
        left = simhash.keep_one(frame).collect()
        assert [len(left), len({r["text"] for r in left})] == ([6, 6] if some else [0, 0])
    comp = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert comp[2] == 1 and comp[4] == 3 and comp[None] in (1, 3)


def test_the_kept_document_is_one_row(spark):
    """Rows that share id and text but not the source, and rows whose columns only
    trade their nulls, are told apart; the choice does not hang on the partitions."""
    ship_package(spark)
    rows = [(1, "b b b b", "s", None), (1, "b b b b", None, "s"), (1, "b b b b", "t", "s"), (1, "b b b b", "t", "s"),
            (5, "other words are here", None, None), (None, "lone text of its own", "s", "s"), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    left = {str(sorted(simhash.keep_one(docs.repartition(n)).collect(), key=str)) for n in (1, 3, 8)}
    assert len(left) == 1
    kept = simhash.keep_one(docs).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "5", "None", "None"]


def test_pipeline(spark, texts):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash", "decontaminate", "secrets", "mixing"] and corpus_pipeline.ORACLE_SQL is None
    prints, at = {d: slow_print(t) for d, t in texts.items()}, docs
    for name, stage in corpus_pipeline.STAGES:
        out = spark.createDataFrame(stage(spark, at, SF).toArrow())
        if name != "mixing":
            assert out.columns == docs.columns
        if name == "simhash":
            ids = sorted(r["doc_id"] for r in at.collect())
            comp = slow_components([prints[d] for d in ids])
            assert sorted(r["doc_id"] for r in out.collect()) == sorted({ids[c] for c in comp.values()})
        if name == "secrets":
            was = {r["doc_id"]: r["text"] for r in at.collect()}
            now = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
            assert was.keys() == now.keys()
            for d, (t, n) in now.items():
                assert not slow_secrets(t) and (t == was[d] or n == len(t)) and (slow_secrets(was[d]) or "[SECRET]" in t or t == was[d])
        at = out
    assert {r["doc_id"] for r in at.collect()} <= set(texts)
    assert json.dumps(sorted(at.columns)) == json.dumps(sorted(["doc_id", "size", "source_size", "target", "copies", "taken"]))
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_licenses_known_words_are_the_words_of_the_vocabulary(spark):
    vocabulary = sorted({w for _, t in licenses.NOTICES for w in licenses.notice_words(t)})
    texts = ["", "..license-- .the.License, LICENSE-x License\n-mit-", "2.0. 2.0.0 v2.0 .2.0-", "mit.mit MIT", "--", "bsd-style. -bsd-style bsd--style",
             "éMIT mité MIT", "the the " * 500, "x" * 5000 + " license", *[t for _, t in licenses.NOTICES]]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "text string")
    got = df.select("text", licenses.known_words(F.lower("text"), vocabulary).alias("k")).collect()
    assert {r["text"]: r["k"] for r in got} == {
        **{t: [w for w in licenses.notice_words(t) if w in vocabulary] for t in texts}, None: None}


def test_licenses_bound_admits_every_matching_line(spark):
    lines = [text + tail for _, text in licenses.NOTICES for tail in ("", " x1", " x1 x2 x3", " the the", " x1" * 40)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    wide = licenses.declared(docs, ["doc_id"], threshold=0.2)   # a low threshold keeps the bound wide
    want = {(r["doc_id"], r["license"], r["score"]) for r in wide.collect() if r["score"] >= 0.75}
    assert want and want == {(r["doc_id"], r["license"], r["score"]) for r in licenses.declared(docs, ["doc_id"]).collect()}


def test_licenses_headers_and_license_files(spark):
    """Headers over several comment lines, tags, notices among other words, and whole licence texts."""
    from menurec.llm.license_texts import TEXTS

    gpl = """#!/bin/sh
# Copyright (C) 2020 Somebody
#
# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
""" + "echo some code and other words\n" * 30
    texts = dict(TEXTS)
    mit = texts["MIT"].replace("<year> <copyright holders>", "2021 Jane Roe and others")
    rows = [("a/run.sh", gpl, "GPL-3.0", False), ("a/main.c", "/* SPDX-License-Identifier: MIT */\nint main() { return 0; }\n" * 1, "MIT", False),
            ("a/two.c", "// SPDX-License-Identifier: GPL-2.0-or-later\nint x;", "GPL-2.0", None),
            ("a/readme", "my small tool reads all files of one folder twice. Released under the MIT License. see the web page for more", "MIT", False),
            ("b/LICENSE", mit, "MIT", True), ("c/LICENSE", texts["Apache-2.0"], "Apache-2.0", True), ("d/COPYING", texts["GPL-3.0"], "GPL-3.0", True),
            ("e/COPYING", texts["LGPL-3.0"], "LGPL-3.0", True), ("f/COPYING", texts["GPL-2.0"], "GPL-2.0", True),
            ("g/plain", "the public work of a general is under the version", None, False)]
    rows += [(f"{d}/src/x", "just code " + d, None, False) for d in "abcdef"]
    rows += [(f"z/{i}", " ".join(f"w{i % 7} the of to in and a public".split()[: 2 + i % 8]), None, False) for i in range(200)]
    docs = spark.createDataFrame([(i, p, t) for i, (p, t, *_) in enumerate(rows)], "doc_id bigint, path string, text string")
    got = {r["path"]: r for r in licenses.scan(docs, F.col("path")).collect()}
    for path, _, name, is_file in rows:
        assert got[path]["license"] == name, path
        assert is_file is None or got[path]["is_file"] == is_file, path
    assert [got[f"{d}/src/x"]["inherited"] for d in "abcdef"] == [None, "MIT", "Apache-2.0", "GPL-3.0", "LGPL-3.0", "GPL-2.0"]


def test_secrets_after_names_inside_runs_and_alone(spark):
    """NAME=VALUE without quotes, a value joined to words, and a single secret in a corpus of its own."""
    rng = random.Random(5)
    key = "wJalrXUtnFEMIqK7MDENGbPxRfiCYzX9Q2Lmn4Tr"
    long = "".join(rng.choices(secret_scan.ALPHABETS["alnum"], k=40))
    texts = [f"AWS_SECRET_ACCESS_KEY={key}", f"see /static/assets/{long}/index_of_all_files now", f"call?sig={key} ok",
             "some_very_long_function_name_of_words and InternationalizationConfigurationManager", "2021030405060708091011 ----------------------------"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for frame in (docs, *(docs.filter(F.col("doc_id") == i) for i in range(3))):
        got = {r["doc_id"]: r["text"] for r in secret_scan.redact(frame).collect()}
        for i, text in got.items():
            assert (key not in text and long not in text and "[SECRET]" in text) if i < 3 else text == texts[i]
    spans = {r["doc_id"]: [texts[r["doc_id"]][s["start"]:s["stop"]] for s in r["spans"] if s["kind"] == 3] for r in secret_scan.secrets(docs).collect()}
    assert spans[0] == [key] and long in spans[1] and spans[3] == spans[4] == []


def test_decontaminate_short_items_and_null_ids(spark):
    ship_package(spark)
    bench = spark.createDataFrame([(1, "What is 7 times 8?"), (2, "日本の首都はどこですか"), (None, "a question that was listed without any id in the table"), (3, " ")],
                                  "item_id bigint, text string")
    rows = [(1, "so: what  is 7 TIMES 8? it is 56"), (2, "問題：日本の首都はどこですか。東京"), (3, "what is 7 times 80"), (4, "Asked: a question that was listed without any id in the table."),
            (5, "somewhat is 7 times 8?"), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted((r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.matches(docs, bench).collect()) == [(1, 1, 0), (2, 2, 0)]
    assert {r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).collect()} == {3, 5, 6}

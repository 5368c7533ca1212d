"""Brute-force checks of hard-negative mining, divergence and phrase dedup."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from menurec.llm import cover_tree, divergence, phrase_automata
from menurec.session import ship_package

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
VEC = "vec_id bigint, embedding array<float>, label int"
LAST = 2 ** 63 - 1


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def clashing(frame, names):
    """The frame with more columns, named as the operators name theirs."""
    return frame.withColumns({c: F.lit(1) for c in names.split() if c not in frame.columns})


# --- 11 hard negatives --------------------------------------------------------

def slow_negatives(rows, anchor, n_pos=5, n_neg=5, share=80, scale=256):
    use = [(i, lab, [int(np.floor(np.float64(np.float32(x)) * scale)) for x in v]) for i, v, lab in rows
           if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (a, la, va) in enumerate(use):
        if not anchor(a):
            continue
        scored = sorted(((-sum(x * y for x, y in zip(va, v)), i, lab == la) for m, (i, lab, v) in enumerate(use) if m != n), key=lambda r: r[:2])
        for ps, p, _ in [r for r in scored if r[2]][:n_pos]:
            fit = [(s, i) for s, i, same in scored if not same and share * -ps <= 100 * -s <= 100 * -ps][:n_neg]
            out += [(a, p, k, i, -ps, -s) for k, (s, i) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, anchor, **kw):
    frame = clashing(spark.createDataFrame(rows, VEC), "row ints tops rank score i j tree top")
    return sorted(map(tuple, cover_tree.hard_negatives(frame, anchor, **kw).collect()))


def test_hard_negatives_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6)], int(rng.integers(3))) for i in range(120)]
    rows += [(200 + i, [0.5, 0.25, 0.0, 0.0, 1.0, 0.0], i % 2) for i in range(30)]        # copies: ties everywhere
    rows += [(7, [1.0, 2.0, 0.5, 0.0, 0.0, 0.0], 1)] * 2 + [(10, [3.0] * 6, 0)]               # repeated ids and rows
    rows += [(300, None, 1), (310, [1.0, None], 1), (320, [float("nan")], 1), (330, [float("inf")], 0), (340, [1.0] * 6, None),
             (None, [2.0] * 6, 1), (350, [0.0] * 6, 0), (360, [1.5], 2), (370, [], 1)]       # unusable, zero, shorter, empty
    assert mined(spark, rows, F.col("vec_id") % 10 == 0) == slow_negatives(rows, lambda i: i % 10 == 0)
    assert mined(spark, [], F.col("vec_id") % 10 == 0) == []
    assert mined(spark, rows, F.lit(False)) == []
    assert mined(spark, rows[:1], F.lit(True)) == []


def test_hard_negatives_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "TREE_ROWS", 16)
    monkeypatch.setattr(cover_tree, "CELL_TREES", 2)
    monkeypatch.setattr(cover_tree, "ANCHOR_BLOCK", 4)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=4) + 3 * (i % 3)], i % 3) for i in range(150)]
    assert mined(spark, rows, F.col("vec_id") % 9 == 0) == slow_negatives(rows, lambda i: i % 9 == 0)


def test_beyond_doubles(spark):
    rows = [(i, [1e6 * (i + 1), 2e6], i % 2) for i in range(8)]
    assert mined(spark, rows, F.col("vec_id") == 2) == slow_negatives(rows, lambda i: i == 2)


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 60), st.integers(1, 4), st.integers(0, 10 ** 6))
def test_cover_tree(n, dims, seed):
    rng = np.random.default_rng(seed)
    points, labels, ids = rng.integers(-4, 5, (n, dims)), rng.integers(0, 3, n), rng.permutation(n)
    tree = cover_tree.CoverTree(points, labels)
    below, seen = {}, []
    def under(i):
        kids = tree.kids[tree.first[i]:tree.first[i] + tree.n_kids[i]].tolist()
        seen.append(i)
        below[i] = [i] + [x for k in kids for x in under(k)]
        return below[i]
    assert sorted(under(0)) == list(range(n)) and len(seen) == n
    for i, inside in below.items():
        far = np.sqrt(((tree.lifted[inside] - tree.lifted[i]) ** 2).sum(axis=1)).max()
        assert far <= tree.radius[i] + 1e-9
        assert tree.only[i] == (labels[i] if len(set(labels[inside].tolist())) == 1 else cover_tree.MIXED)
    anchor, low, high = rng.integers(-4, 5, dims), int(rng.integers(-20, 5)), int(rng.integers(0, 30))
    is_in = labels == 1
    may_hold = (tree.only == 1) | (tree.only == cover_tree.MIXED)
    scores = points @ anchor
    got = tree.best(anchor.astype(float), ids, (is_in, may_hold), [low, -np.inf], [high, np.inf], 3)
    for (at, s), (a, b) in zip(got, [(low, high), (-np.inf, np.inf)]):
        want = sorted((-scores[i], ids[i]) for i in range(n) if is_in[i] and a <= scores[i] <= b)[:3]
        assert [(-x, ids[i]) for x, i in zip(s, at)] == want


# --- 12 divergence ------------------------------------------------------------

PATTERN = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def found_terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in PATTERN.findall(text or "")]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aZz09_ \t\n\x0b\x1c\x7fé€\U0001d11e[`{@.\x85 "), max_size=30))
def test_terms(text):
    assert [t.decode() for t in divergence.terms(text.encode())] == found_terms(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 10 ** 14), min_size=1, max_size=5), st.integers(1, 10 ** 5))
def test_shares(counts, kept):
    total = sum(counts)
    got = divergence.shares(np.array([counts]), np.array([[total]]), np.array([[kept]]))
    assert got.tolist() == [[1 + 10 ** 9 * (c + 5) // (total + 5 * kept) for c in counts]]


def slow_audit(rows, min_docs, top):
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        n[lang, source].update(found_terms(text))
        docs[lang].update(set(found_terms(text)))
    out = []
    for lang in {g for g, _ in groups}:
        kept = [t for t, c in docs[lang].items() if c >= min_docs]
        names = sorted(s for g, s in groups if g == lang)

        def share(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10 ** 9 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = {s: share(n[lang, s]) for s in names}, share(sum((n[lang, s] for s in names), Counter()))
        for s in names:
            pairs = sorted(((sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in names if o != s), key=lambda r: (-r[0], r[1].encode()))
            over = sorted(((p[s][t] - q[t], t) for t in kept if n[lang, s][t] and p[s][t] > q[t]), key=lambda r: (-r[0], r[1].encode()))[:top]
            out += [(lang, s, part, i, v, k) for part, rows_ in (("pair", pairs), ("term", over)) for k, (v, i) in enumerate(rows_, 1)]
    return sorted(out)


@pytest.mark.parametrize("tile,cells,held", [(256, 1 << 16, 200_000), (2, 8, 5)])
def test_divergence(spark, monkeypatch, tile, cells, held):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "CELLS", cells)
    monkeypatch.setattr(divergence, "HELD_TERMS", held)
    rng = random.Random(4)
    words = "alpha Beta GAMMA délta épsilon zeta_eta 9theta \U0001d11e ï".split()
    rows = [(i, " ".join(rng.choices(words, weights=range(1, 10), k=rng.randrange(12))), rng.choice(["en", "fr", None, ""]),
             rng.choice(["a", "b", "c", "é", None, "\U0001d11e", "￮"]), i) for i in range(300)]
    rows += [(None, None, "xx", "a", None), (1, "", "xx", "b", 0), (2, "one term", "yy", None, 0), (3, "long " * 40000, "en", "a", 1)] + rows[:5]
    frame = clashing(spark.createDataFrame(rows, DOC), "term n docs item value rank i j block part")
    assert sorted(map(tuple, divergence.audit(frame, min_docs=6, top_terms=4).collect())) == slow_audit([r[1:4] for r in rows], 6, 4)
    assert divergence.audit(frame.limit(0)).collect() == []


# --- 13 repeated phrases ------------------------------------------------------

def slow_dedup(rows, span):
    words = [((LAST if i is None else i), re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t in rows]
    least = {}
    for i, w in words:
        for a in range(len(w) - span + 1):
            least[tuple(w[a:a + span])] = min(i, least.get(tuple(w[a:a + span]), i))
    out = []
    for (i, w), (shown, _) in zip(words, rows):
        gone = [False] * len(w)
        for a in range(len(w) - span + 1):
            if least[tuple(w[a:a + span])] < i:
                gone[a:a + span] = [True] * span
        out.append((shown, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def deduped(spark, rows, span, **kw):
    frame = clashing(spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOC), "key grp doc g k anchor words h lo place block n several home")
    found = phrase_automata.dedup(frame, span, **kw)
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found.collect()), key=str), found


@pytest.mark.parametrize("span,symbols,shard", [(13, 64, 1 << 17), (13, 2, 7), (5, 3, 1 << 17)])
def test_phrase_dedup(spark, monkeypatch, span, symbols, shard):
    """Few symbols make many clashes, small shards many automata."""
    monkeypatch.setattr(phrase_automata, "SYMBOLS", symbols)
    monkeypatch.setattr(phrase_automata, "SHARD", shard)
    rng = random.Random(span + symbols)
    words = [f"w{i}é" for i in range(40)] + ["a", "\U0001d11e"]
    passage = " ".join(rng.choices(words, k=90))
    rows = []
    for i in range(60):
        parts = [rng.choice(words) for _ in range(rng.randrange(0, 60))]
        if i % 3 == 0:
            a = rng.randrange(60)
            parts[len(parts) // 2:len(parts) // 2] = passage.split()[a:a + rng.randrange(5, 40)]
        rows.append((rng.choice([i, i // 2, None]) if i % 7 == 0 else i, rng.choice([" ", "\n", "\t \r\x0b\x0c"]).join(parts)))
    rows += [(100, passage), (101, passage), (50, passage), (50, passage + " x"), (None, passage), (None, passage), (None, "tail " + passage)]
    rows += [(102, None), (103, ""), (104, " \n "), (105, "one"), (106, "again " * 3000), (3, "again " * 30), (107, "x" * 3_000_000 + " y")] + rows[:4]
    got, found = deduped(spark, rows, span)
    assert got == slow_dedup(rows, span)
    for r in found.select("n_removed", "spans").collect():
        assert r.n_removed == sum(s.stop - s.start for s in r.spans)
        assert all(a.stop < b.start for a, b in zip(r.spans, r.spans[1:]))


def test_phrase_dedup_many_groups(spark, monkeypatch):
    """Small groups and blocks: passages travel between groups."""
    monkeypatch.setattr(phrase_automata, "BLOCK", 4)
    monkeypatch.setattr(phrase_automata, "PART", 50)
    rng = random.Random(9)
    common = " ".join(f"c{i}" for i in range(40))
    rows = [(i, " ".join([f"u{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(20))] + common.split()[rng.randrange(20):] * (i % 3 == 0))) for i in range(200)]
    got, _ = deduped(spark, rows, 13, group_bytes=300)
    assert got == slow_dedup(rows, 13)
    assert deduped(spark, [], 13)[0] == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abé \n\x0b\x85 ", max_size=40), max_size=6))
def test_words(texts):
    phrase_automata.PART, before = 3, phrase_automata.PART
    try:
        held = phrase_automata.Words([t.encode() for t in texts])
        parts = [re.findall(rb"[^\x20\x09-\x0D]+", t.encode()) for t in texts]
        flat = [w for p in parts for w in p]
        assert held.n_words.tolist() == [len(p) for p in parts]
        assert [held.window(i, 1) for i in range(len(flat))] == flat
        phrase_automata.PART = before
        again = phrase_automata.Words(flat)
        assert again.hashes.tolist() == held.hashes.tolist()
        assert len(set(zip(flat, held.hashes.tolist()))) == len(set(flat)) == len(set(held.hashes.tolist()))
    finally:
        phrase_automata.PART = before

"""Language-model scoring by a gated recurrent network in numpy (operator 3).

Model: a GRU reads one token at a time from a zero state at the start of each
document.  The softmax is class-factored: the most frequent words form
``HEAD_CLASSES`` classes of ``CLASS_WORDS`` words, each with a softmax of its
own; all other words fall into ``TAIL_CLASSES`` classes by their ending, inside
which the corpus counts decide ((c + 1) / (N_class + V_class + 1), with one
share left for unseen words).

1. Counts: one pass counts all training tokens (partial counts per task, then
   one aggregation); they grow with the corpus and stay a table.
2. Training: ``ROUNDS`` passes, each over its own part of the training
   documents.  Documents (in stretches of ``SEGMENT`` tokens) are packed into
   lanes; windows of ``WINDOW`` steps are trained by truncated backpropagation,
   the state carried from window to window.  Tasks start a round from the same weights and are averaged by
   tokens; sums are integers, so the average doesn't depend on task order.
3. Scoring: the same packing over all whole texts.  A bounded dictionary of
   the most frequent words (``MAX_LOOKUP``) goes to every task; the other words
   are joined with the count table by shuffle.

Defined cases: a null or empty text is one end token; a null id counts as '' in
the split; repeated rows are repeated in the result; without training
documents N = V = 0 and the untrained network scores; very long texts keep
their state over all windows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from menurec.llm.common import materialised, raw_texts, row_key

HIDDEN = 24
HEAD_CLASSES, CLASS_WORDS, TAIL_CLASSES = 32, 32, 64
HEAD = HEAD_CLASSES * CLASS_WORDS  # id 0 is the end of a document
INPUTS, CLASSES = HEAD + TAIL_CLASSES, HEAD_CLASSES + TAIL_CLASSES
WINDOW = 32
SEGMENT = 2048  # training cuts longer texts, so that one does not keep the other lanes waiting
ROUNDS = 4
RATES = (8e-3, 5e-3, 3e-3, 1.5e-3)
TRAIN_LANES, SCORE_LANES = 128, 512
MAX_LOOKUP = 400_000
READ_BYTES = 1 << 19
FLUSH_WORDS = 300_000
FLUSH_TOKENS = 2_000_000
FLUSH_BYTES = 24 << 20
LN10 = math.log(10)
FIXED_POINT = 2 ** 20
SUM_WEIGHTS = 2048  # weights that are summed over the tasks together
CACHED_ROWS = 1024  # softmax rows handled at once, to stay in the processor's cache
HEAD_ROWS, STEP_WEIGHTS = 2048, 8192  # likewise of the softmax inside the classes, and weights of a training step


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % TAIL_CLASSES


_CRC_STEP = np.array([zlib.crc32(bytes([i])) ^ zlib.crc32(b"\0") for i in range(256)], np.uint32)


def tail_classes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """``tail_class`` of each word of a text, and where the words end."""
    raw = np.frombuffer(text, np.uint8)
    white = np.ones(len(raw) + 2, bool)
    white[1:-1] = (raw == 32) | (raw - np.uint8(9) < 5)
    edges = np.flatnonzero(white[1:] != white[:-1])
    starts, ends = edges[::2], edges[1::2]
    sizes, crc = ends - starts, np.full(len(ends), 0xFFFFFFFF, np.uint32)
    for back in (3, 2, 1):
        byte = raw[np.maximum(ends - back, 0)]
        crc = np.where(sizes >= back, _CRC_STEP[(crc ^ byte) & 255] ^ (crc >> 8), crc)
    return (~crc % TAIL_CLASSES).astype(np.int32), ends


def sequences(texts: list[bytes], head: dict[bytes, int]):
    """The input ids of each text, its end (0) included; a word of the head has
    its place, another one that of its tail class.  Texts are read together, up
    to ``READ_BYTES`` or one at a time."""
    a = 0
    while a < len(texts):
        b, size = a + 1, len(texts[a])
        while b < len(texts) and size + len(texts[b]) <= READ_BYTES:
            size += len(texts[b])
            b += 1
        text = b" ".join(texts[a:b]).lower()
        words = text.split()
        cls, ends = tail_classes(text)
        ids = np.fromiter(map(head.get, words, repeat(0)), np.int32, len(words))
        ids = np.where(ids > 0, ids, cls + HEAD)
        limits = np.cumsum([len(t) + 1 for t in texts[a:b]])
        at = 0
        for to in np.searchsorted(ends, limits).tolist():
            seq = np.zeros(to - at + 1, np.int32)
            seq[:-1] = ids[at:to]
            yield seq
            at = to
        a = b


# --- counts -------------------------------------------------------------------

def word_counts(train: DataFrame) -> DataFrame:
    """(word, n, cls) over all texts; the word '' counts the documents' ends."""

    def run(batches):
        counts: Counter = Counter()

        def rows():
            words = list(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in raw_texts(batch):
                counts.update(text.lower().split())
                counts[b""] += 1
                if len(counts) > FLUSH_WORDS:
                    yield from rows()
                    counts.clear()
        yield from rows()

    cls = F.crc32(F.substring(F.col("word").cast("binary"), -3, 3)) % TAIL_CLASSES  # tail_class
    return (train.select("text").mapInArrow(run, "word string, n bigint")
            .groupBy("word").agg(F.sum("n").alias("n")).withColumn("cls", cls.cast("int")))


def _octave(n: Column) -> Column:
    return F.floor(F.log2(n) * 16)


class Vocabulary:
    """What the driver keeps of the counts: totals, class totals and the most
    frequent words, at most ``MAX_LOOKUP`` (cut at a level of frequency found
    from a histogram of levels, a few hundred rows)."""

    def __init__(self, counts: DataFrame):
        ends, total, kinds = counts.agg(F.sum(F.when(F.col("word") == "", F.col("n"))), F.sum("n"), F.count("*")).first()
        self.ends, self.tokens, self.kinds = ends or 0, total or 0, kinds or 0
        words = counts.filter(F.col("word") != "")
        levels = words.groupBy(_octave(F.col("n")).alias("level")).agg(F.count("*").alias("k")).orderBy(F.desc("level")).collect()
        held, self.cut = 0, None
        for r in levels:
            held += r["k"]
            if held > MAX_LOOKUP:
                break
            self.cut = r["level"]
        frequent = words.filter(_octave(F.col("n")) >= self.cut).select("word", "n").toArrow() if self.cut is not None else None
        if frequent is None or not frequent.num_rows:
            names, n = [], np.empty(0, np.int64)
        else:
            names = frequent.column("word").cast(pa.binary()).to_pylist()
            n = frequent.column("n").to_numpy()
        order = sorted(range(len(names)), key=lambda i: (-n[i], names[i]))
        self.words = [names[i] for i in order]
        self.counts = n[order] if len(order) else n
        self.tail = counts.filter(_octave(F.col("n")) < self.cut) if self.cut is not None else words
        self.tail = self.tail.filter(F.col("word") != "").select("word", F.col("n").alias("c"))
        # totals of the tail classes: all words but the head's
        self.class_n, self.class_v = np.zeros(TAIL_CLASSES), np.zeros(TAIL_CLASSES)
        for r in words.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
            self.class_n[r["cls"]], self.class_v[r["cls"]] = r["n"], r["v"]
        self.head = self.words[:HEAD - 1]
        for w, c in zip(self.head, self.counts):
            self.class_n[tail_class(w)] -= c
            self.class_v[tail_class(w)] -= 1

    def inputs(self) -> dict[bytes, int]:
        return {w: i + 1 for i, w in enumerate(self.head)}


# --- network ------------------------------------------------------------------

CLASS_OF = np.concatenate([np.arange(HEAD) // CLASS_WORDS, HEAD_CLASSES + np.arange(TAIL_CLASSES)]).astype(np.int16)
SHAPES = {"inp": (INPUTS, 3 * HIDDEN), "bias": (3 * HIDDEN,), "u": (HIDDEN, 3 * HIDDEN), "wc": (HIDDEN, CLASSES), "bc": (CLASSES,),
          "wh": (HEAD_CLASSES, HIDDEN, CLASS_WORDS), "bh": (HEAD_CLASSES, CLASS_WORDS)}


def initial(vocabulary: Vocabulary, seed: int = 5) -> dict[str, np.ndarray]:
    """Small random weights; the output biases start at the words' frequencies."""
    rng = np.random.default_rng(seed)
    scale = {"inp": 0.3, "u": HIDDEN ** -0.5, "wc": 0.05, "wh": 0.05}
    net = {k: rng.standard_normal(s) * scale.get(k, 0.0) for k, s in SHAPES.items()}
    head = np.full(HEAD, 1e-9)
    head[0] += vocabulary.ends
    head[1:1 + len(vocabulary.head)] += vocabulary.counts[:len(vocabulary.head)]
    head = head.reshape(HEAD_CLASSES, CLASS_WORDS)
    net["bh"] = np.log(head / head.sum(axis=1, keepdims=True))
    mass = np.concatenate([head.sum(axis=1), vocabulary.class_n]) + 0.1
    net["bc"] = np.log(mass / mass.sum())
    net["bias"][:HIDDEN] = 1.0  # starts by keeping its state
    return {k: v.astype(np.float32) for k, v in net.items()}


def recur(net, tokens: np.ndarray, state: np.ndarray, trace: bool = False):
    """States after each of the (steps, lanes) input tokens; input 0 starts a
    document from a zero state.  ``trace`` keeps what backpropagation needs:
    (previous states, update and reset gates, candidates, their recurrent part).

    The logistic is a scaled tanh; its factor 1/2 is put into the weights, and
    every step writes into buffers made once.  The two gates of a step lie one
    behind the other, so that every operation runs over unbroken memory.
    """
    steps, lanes = tokens.shape
    two = 2 * HIDDEN
    kind = net["u"].dtype
    table = net["inp"] + net["bias"]
    by_gate = np.concatenate([table[:, :HIDDEN], table[:, HIDDEN:two]])
    by_gate *= 0.5
    gate_ids = tokens[:, None, :] + np.array([[0], [INPUTS]])
    cands_by = np.ascontiguousarray(table[:, two:])
    u_gates = np.stack([0.5 * net["u"][:, :HIDDEN], 0.5 * net["u"][:, HIDDEN:two]])
    u_cand = np.ascontiguousarray(net["u"][:, two:])
    starts = _starts(tokens)
    kept = steps if trace else 1
    prevs, cands, lifts = (np.empty((kept, lanes, HIDDEN), kind) for _ in range(3))
    gates = np.empty((kept, 2, lanes, HIDDEN), kind)
    out, gates_in, cand_in = (np.empty((k, lanes, HIDDEN), kind) for k in (steps, 2, 1))
    for t in range(steps):
        i = t if trace else 0
        prev, zr, n, lift, now = prevs[i], gates[i], cands[i], lifts[i], out[t]
        if trace or t in starts:
            prev[:] = state
            if t in starts:
                prev[starts[t]] *= 0
        else:
            prev = state
        np.matmul(prev, u_gates, out=zr)
        zr += np.take(by_gate, gate_ids[t], axis=0, out=gates_in, mode="clip")
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        np.matmul(prev, u_cand, out=lift)
        np.multiply(zr[1], lift, out=n)
        n += np.take(cands_by, gate_ids[t, 0], axis=0, out=cand_in[0], mode="clip")
        np.tanh(n, out=n)
        np.subtract(prev, n, out=now)
        now *= zr[0]
        now += n
        state = now
    return out, (prevs, gates, cands, lifts), starts


def _starts(tokens: np.ndarray) -> dict[int, list[int]]:
    """The lanes in which a document starts, of each step that has some."""
    starts: dict[int, list[int]] = {}
    for at in np.flatnonzero(tokens == 0).tolist():
        step, lane = divmod(at, tokens.shape[1])
        starts.setdefault(step, []).append(lane)
    return starts


def _softmax_parts(logit, ones, parts=(slice(None),)):
    """exp(logit) and its row sums, made part by part; rows are shifted only if
    they overflow."""
    e = np.exp(logit)
    total = np.empty(len(e), e.dtype)
    for of in parts:
        np.matmul(e[of], ones, out=total[of])
    if not np.isfinite(total).all() or not total.all():
        top = logit.max(axis=1, keepdims=True)
        e = np.exp(logit - top)
        return e, e @ ones, top[:, 0]
    return e, total, 0.0


def _column_sums(x):
    return np.ones(len(x), x.dtype) @ x


def outputs(net, hidden: np.ndarray, target: np.ndarray, want_gradient: bool = False):
    """Natural log-probability of each target given its state (a tail word's is
    that of its class); with gradients of the mean negative log-likelihood.
    Rows are sorted by class once, so that each class is one matrix product; all
    else runs over the rows of many classes at a time."""
    cls = np.take(CLASS_OF, target)
    order = np.argsort(cls, kind="stable")
    cls, word, h = cls[order], target[order], np.take(hidden, order, axis=0)
    n, rows = len(order), np.arange(len(order))
    edges = np.searchsorted(cls, np.arange(HEAD_CLASSES + 1)).tolist()
    logp = np.empty(n, h.dtype)
    grad = None
    if want_gradient:
        grad = {k: np.zeros(SHAPES[k], h.dtype) for k in ("wc", "bc", "wh", "bh")}
        back = np.empty_like(h)
    room, ones = np.empty((min(n, CACHED_ROWS), CLASSES), h.dtype), np.ones(CLASSES, h.dtype)
    at = rows % CACHED_ROWS * CLASSES + cls
    with np.errstate(over="ignore"):
        for a in range(0, n, CACHED_ROWS):
            seg = slice(a, a + CACHED_ROWS)
            x = h[seg]
            logit = np.matmul(x, net["wc"], out=room[:len(x)])
            logit += net["bc"]
            found = logit.reshape(-1)[at[seg]]
            e, total, top = _softmax_parts(logit, ones)
            logp[seg] = found - top - np.log(total)
            if want_gradient:
                e *= (1 / (total * n))[:, None]
                e.reshape(-1)[at[seg]] -= 1 / n
                grad["wc"] += x.T @ e
                grad["bc"] += _column_sums(e)
                np.matmul(e, net["wc"].T, out=back[seg])
        # the words of the head's classes: some whole classes at a time
        ones, done = ones[:CLASS_WORDS], 0
        while done < HEAD_CLASSES and edges[done] < edges[-1]:
            last = done + 1
            while last < HEAD_CLASSES and edges[last + 1] - edges[done] <= HEAD_ROWS:
                last += 1
            a, b = edges[done], edges[last]
            seg, runs = slice(a, b), [(c, slice(edges[c] - a, edges[c + 1] - a)) for c in range(done, last) if edges[c] < edges[c + 1]]
            done, x, at = last, h[seg], rows[:b - a] * CLASS_WORDS + word[seg] % CLASS_WORDS
            line = np.empty((b - a, CLASS_WORDS), h.dtype)
            for c, of in runs:
                np.matmul(x[of], net["wh"][c], out=line[of])
            line += np.take(net["bh"], cls[seg], axis=0)
            found = line.reshape(-1)[at]
            e, total, top = _softmax_parts(line, ones, [of for _, of in runs])
            logp[seg] += found - top - np.log(total)
            if want_gradient:
                e *= (1 / (total * n))[:, None]
                e.reshape(-1)[at] -= 1 / n
                more = np.empty_like(x)
                for c, of in runs:
                    np.matmul(x[of].T, e[of], out=grad["wh"][c])
                    grad["bh"][c] = _column_sums(e[of])
                    np.matmul(e[of], net["wh"][c].T, out=more[of])
                back[seg] += more
    out = np.empty_like(logp)
    out[order] = logp
    if want_gradient:
        place = np.empty_like(order)
        place[order] = rows
        grad["hidden"] = np.take(back, place, axis=0)
    return out, grad


def lay_lanes(lengths: np.ndarray, lanes: int):
    """Pack sequences into lanes, longest first onto the shortest lane.

    Returns the order in which sequences lie end to end, and each lane's
    offset and load; lanes go from the fullest to the emptiest.
    """
    lanes = max(1, min(lanes, len(lengths)))
    heap = [(0, i) for i in range(lanes)]
    members: list[list[int]] = [[] for _ in range(lanes)]
    for i in np.argsort(-lengths, kind="stable"):
        load, lane = heap[0]
        members[lane].append(int(i))
        heapq.heapreplace(heap, (load + int(lengths[i]), lane))
    loads = np.array([lengths[m].sum() for m in members], np.int64)
    rank = np.argsort(-loads, kind="stable")
    order = np.array([i for lane in rank for i in members[lane]], np.int64)
    loads = loads[rank]
    return order, np.r_[0, loads.cumsum()[:-1]], loads


def windows(texts: list[np.ndarray], lanes: int):
    """(inputs, targets, mask, sequence numbers, lanes) of window after window; each
    text's ids, the end (0) included, lie in one lane."""
    order, offset, loads = lay_lanes(np.array([len(t) for t in texts], np.int64), lanes)
    flat = np.concatenate([texts[i] for i in order])
    owner = np.repeat(order, [len(texts[i]) for i in order])
    before = np.r_[0, flat[:-1]]
    before[np.cumsum([0, *(len(texts[i]) for i in order[:-1])])] = 0  # each sequence starts anew
    for at in range(0, int(loads[0]), WINDOW):
        live = int((loads > at).sum())
        steps = np.arange(at, min(at + WINDOW, int(loads[0])))
        spot = offset[:live] + steps[:, None]
        mask = steps[:, None] < loads[:live]
        spot = np.minimum(spot, len(flat) - 1)
        yield np.where(mask, before[spot], 0), flat[spot], mask, owner[spot], live


def log_likelihood(net, texts: list[np.ndarray], lanes: int = SCORE_LANES) -> np.ndarray:
    """Sum of natural log-probabilities of each text's ids."""
    out = np.zeros(len(texts))
    if not texts:
        return out
    state = np.zeros((min(lanes, len(texts)), HIDDEN), np.float32)
    for tokens, target, mask, owner, live in windows(texts, lanes):
        hidden, _, _ = recur(net, tokens, state[:live])
        state = hidden[-1]
        spot = np.flatnonzero(mask)
        logp, _ = outputs(net, np.take(hidden.reshape(-1, HIDDEN), spot, axis=0), target.ravel()[spot])
        out += np.bincount(owner.ravel()[spot], logp.astype(float), len(texts))
    return out


def gradients(net, tokens, target, mask, state):
    """Mean loss of a window, its gradients and the state after it."""
    hidden, (prev, gates, n, lift), starts = recur(net, tokens, state, trace=True)
    steps, lanes, _ = hidden.shape
    two = 2 * HIDDEN
    spot = np.flatnonzero(mask)
    logp, grad = outputs(net, np.take(hidden.reshape(-1, HIDDEN), spot, axis=0), target.ravel()[spot], want_gradient=True)
    dout = grad.pop("hidden")
    if len(spot) < mask.size:
        live, dout = dout, np.zeros((mask.size, HIDDEN), hidden.dtype)
        dout[spot] = live
    dout = dout.reshape(hidden.shape)
    dgate = np.empty((steps, lanes, 3 * HIDDEN), hidden.dtype)
    back = np.zeros((lanes, HIDDEN), hidden.dtype)
    rest, other, slope = (np.empty_like(back) for _ in range(3))
    ut_gates, ut_cand = np.ascontiguousarray(net["u"][:, :two].T), np.ascontiguousarray(net["u"][:, two:].T)
    for t in range(steps - 1, -1, -1):
        (z, r), cand, lifted = gates[t], n[t], lift[t]
        back += dout[t]
        # the candidate's: (1 - z) (1 - n^2) of what comes back
        np.subtract(1, z, out=rest)
        np.multiply(cand, cand, out=slope)
        np.subtract(1, slope, out=slope)
        slope *= rest
        np.multiply(back, slope, out=slope)
        dn = slope
        dgate[t, :, two:] = dn
        # the reset gate's: lift r (1 - r) of the candidate's; the recurrent part gives way to its own gradient
        lifted *= r
        lifted *= np.subtract(1, r, out=other)
        np.multiply(dn, lifted, out=dgate[t, :, HIDDEN:two])
        np.multiply(dn, r, out=lifted)
        # the update gate's: (prev - n) z (1 - z)
        np.subtract(prev[t], cand, out=cand)
        cand *= z
        cand *= rest
        np.multiply(back, cand, out=dgate[t, :, :HIDDEN])
        back *= z
        back += np.matmul(dgate[t, :, :two], ut_gates, out=rest)
        back += np.matmul(lifted, ut_cand, out=rest)
        if t in starts:
            back[starts[t]] *= 0
    rows = dgate.reshape(-1, 3 * HIDDEN)
    before = prev.reshape(-1, HIDDEN).T
    grad["u"] = np.concatenate([before @ rows[:, :two], before @ lift.reshape(-1, HIDDEN)], axis=1)
    grad["bias"] = _column_sums(rows)
    ids = tokens.ravel().astype(np.int16)
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    first = np.flatnonzero(np.diff(ids, prepend=-1))
    grad["inp"] = np.zeros(SHAPES["inp"], rows.dtype)
    grad["inp"][ids[first]] = np.add.reduceat(np.take(rows, order, axis=0), first, axis=0)
    return -float(logp.mean()), grad, hidden[-1]


class Trainer:
    """Truncated backpropagation with Adam over windows of packed texts."""

    def __init__(self, net, rate: float):
        self.net = {k: v.copy() for k, v in net.items()}
        self.rate, self.step, self.tokens, self.loss = rate, 0, 0, []
        self.m = {k: np.zeros_like(v) for k, v in net.items()}
        self.v = {k: np.zeros_like(v) for k, v in net.items()}
        self.scratch = np.empty(STEP_WEIGHTS, np.float32)

    def learn(self, texts: list[np.ndarray], lanes: int = TRAIN_LANES) -> None:
        total = sum(map(len, texts))
        if not total:
            return
        self.tokens += total
        texts = [t[a:a + SEGMENT] for t in texts for a in range(0, len(t), SEGMENT)]
        lanes = min(lanes, max(8, total // 4096), len(texts))
        state = np.zeros((lanes, HIDDEN), np.float32)
        for tokens, target, mask, _, live in windows(texts, lanes):
            loss, grad, state = gradients(self.net, tokens, target, mask, state[:live])
            self.loss.append(loss)
            norm = math.sqrt(sum(float(np.vdot(g, g)) for g in grad.values()))
            clip = min(1.0, 1.0 / (norm + 1e-9))
            self.step += 1
            rate = self.rate * mask.sum() / (WINDOW * lanes)  # a window of few live lanes counts less
            a, b = 1 - 0.9 ** self.step, 1 - 0.99 ** self.step
            for k, g in grad.items():
                flat = [x.reshape(-1) for x in (g, self.m[k], self.v[k], self.net[k])]
                for at in range(0, len(flat[0]), STEP_WEIGHTS):
                    g, m, v, weights = (x[at:at + STEP_WEIGHTS] for x in flat)
                    step = self.scratch[:len(g)]
                    m *= 0.9
                    m += np.multiply(g, 0.1 * clip, out=step)
                    v *= 0.99
                    v += np.square(step, out=step)
                    np.sqrt(v, out=step)
                    step /= math.sqrt(b)
                    step += 1e-6
                    np.divide(m, step, out=step)
                    step *= rate / a
                    weights -= step


# --- Spark jobs ---------------------------------------------------------------

def _part_sums(batches):
    """The sum of each part of the weights over the training tasks, as integers."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, w in zip(batch.column("part").to_pylist(), batch.column("w").to_pylist()):
            sums[part] = sums.get(part, 0) + np.frombuffer(w, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["part", "w"])


def train(docs: DataFrame, vocabulary: Vocabulary, part: Column, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Train on all ``docs``, round ``i`` on those whose ``part`` is ``i``."""
    net = initial(vocabulary)
    ids = vocabulary.inputs()
    names = list(SHAPES)
    for i in range(rounds):
        rate = RATES[min(i, len(RATES) - 1)]

        def run(batches, net=net, rate=rate):
            trainer, held, size = Trainer(net, rate), [], 0
            for batch in batches:
                for seq in sequences(raw_texts(batch), ids):
                    held.append(seq)
                    size += len(seq)
                    if size > FLUSH_TOKENS:
                        trainer.learn(held)
                        held, size = [], 0
            trainer.learn(held)
            if trainer.tokens:
                weight = max(1, trainer.tokens // 1000)
                flat = np.concatenate([trainer.net[k].ravel() for k in names] + [np.ones(1)])
                flat = np.rint(flat * FIXED_POINT).astype(np.int64) * weight
                parts = [flat[a:a + SUM_WEIGHTS].tobytes() for a in range(0, len(flat), SUM_WEIGHTS)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["part", "w"])

        sums = (docs.filter(part == i).select("text").mapInArrow(run, "part int, w binary")
                .repartition("part").mapInArrow(_part_sums, "part int, w binary").orderBy("part").toArrow())
        if sums.num_rows:
            flat = np.frombuffer(b"".join(sums.column("w").to_pylist()), np.int64).astype(float)
            flat, at = flat[:-1] / flat[-1], 0
            net = {}
            for k in names:
                n = math.prod(SHAPES[k])
                net[k] = flat[at:at + n].reshape(SHAPES[k]).astype(np.float32)
                at += n
    return net


class _Lookup:
    """A task's dictionary, made once from the broadcast."""

    def __init__(self, words: bytes, counts: np.ndarray, class_norm: np.ndarray):
        names = words.split(b"\n") if words else []
        self.at = {w: i for i, w in enumerate(names)}
        self.log_count = np.log10(counts + 1.0)
        self.input = tail_classes(words)[0].astype(np.int64) + HEAD
        self.input[:HEAD - 1] = np.arange(1, min(len(names), HEAD - 1) + 1)
        cls = self.input - HEAD
        # log10 of a tail word inside its class; a head word's is the network's
        self.inside = np.where(cls >= 0, self.log_count - class_norm[np.maximum(cls, 0)], 0.0)


def score(docs: DataFrame, vocabulary: Vocabulary, net: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row."""
    spark = docs.sparkSession
    norm = np.log10(vocabulary.class_n + vocabulary.class_v + 1.0)
    shared = spark.sparkContext.broadcast(  # at most MAX_LOOKUP words and the network
        (b"\n".join(vocabulary.words), vocabulary.counts, norm, net, math.log10(vocabulary.ends + 1.0)))
    rest = math.log10(vocabulary.tokens + vocabulary.kinds + 1.0)
    ends = vocabulary.ends

    def run(batches):
        words, counts, norm, net, log_end = shared.value
        table = _Lookup(words, counts, norm)
        get = table.at.get

        def flush(rows):
            seqs = []
            out = {k: [] for k in ("doc_id", "row", "word", "n", "ll", "base", "known", "tokens")}
            for doc_id, row, text in rows:
                tokens = text.lower().split()
                at = np.fromiter(map(get, tokens, repeat(-1)), np.int64, len(tokens))
                seq = np.zeros(len(at) + 1, np.int32)
                hit = at >= 0
                found = at[hit]
                ll, base = 0.0, log_end
                if len(found):
                    seq[:-1][hit] = table.input[found]
                    ll = float(table.inside[found].sum())
                    base += float(table.log_count[found].sum())
                if len(found) < len(at):
                    missed = np.flatnonzero(~hit)
                    others = [tokens[i] for i in missed.tolist()]
                    cls = np.array(list(map(tail_class, others)), np.int32)
                    seq[missed] = HEAD + cls
                    ll -= float(norm[cls].sum())
                    rare = Counter(others)
                    k = len(rare)
                    out["word"] += rare.keys()
                    out["n"] += rare.values()
                    for name, value in (("doc_id", doc_id), ("row", row), ("ll", 0.0), ("base", 0.0), ("known", 0), ("tokens", 0)):
                        out[name] += [value] * k
                seqs.append(seq)
                for name, value in (("doc_id", doc_id), ("row", row), ("word", b"\n%d" % row), ("n", 0), ("ll", ll), ("base", base),
                                    ("known", len(found) + (ends > 0)), ("tokens", len(seq))):
                    out[name].append(value)
            heads = [i for i, t in enumerate(out["tokens"]) if t]
            for i, x in zip(heads, log_likelihood(net, seqs) / LN10):
                out["ll"][i] += x
            kinds = {"doc_id": pa.int64(), "row": pa.int64(), "n": pa.int64(), "ll": pa.float64(), "base": pa.float64(), "known": pa.int64(), "tokens": pa.int64()}
            return pa.RecordBatch.from_arrays(
                [pa.array(v, pa.binary()).cast(pa.string()) if k == "word" else pa.array(v, kinds[k]) for k, v in out.items()], names=list(out))

        held, size = [], 0
        for batch in batches:
            for item in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), raw_texts(batch)):
                held.append(item)
                size += len(item[2])
                if size > FLUSH_BYTES:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_key("doc_id", "text").alias("row"), "text").mapInArrow(
        run, "doc_id bigint, row bigint, word string, n bigint, ll double, base double, known bigint, tokens bigint")
    # a document's own row has a key that is no word, so that these rows spread over the join's tasks too
    joined = rows.join(vocabulary.tail, "word", "left")
    inside = F.col("n") * F.coalesce(F.log10(F.col("c") + 1), F.lit(0.0))
    summed = (joined.groupBy("doc_id", "row")
              .agg(F.sum(F.col("ll") + inside).alias("ll"), F.sum(F.col("base") + inside).alias("base"),
                   F.sum(F.col("known") + F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("known"),
                   F.sum("tokens").alias("tokens"), F.count(F.when(F.col("tokens") > 0, 1)).alias("times")))
    each = summed.select("*", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    whole = lambda c: F.expr(f"{c} div times").alias
    n = F.expr("tokens div times")
    return each.select("doc_id", whole("tokens")("n_tokens"), whole("known")("n_known"), F.lit(vocabulary.tokens).cast("bigint").alias("train_tokens"),
                       (F.col("base") / F.col("times") - n * F.lit(rest)).alias("base_score"), (F.col("ll") / F.col("times")).alias("score"))


def train_and_score(docs: DataFrame, is_training: Column) -> DataFrame:
    """Learn from the rows that ``is_training`` (a condition on doc_id) admits and score all."""
    training = docs.filter(is_training)
    vocabulary = Vocabulary(materialised(word_counts(training)))
    net = train(training, vocabulary, F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)))
    return score(docs, vocabulary, net)

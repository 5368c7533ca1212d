"""Removal of repeated phrases with Aho-Corasick automata (operator 13).

A word goes if it lies in a window of ``span`` consecutive words that also
starts in a document with a smaller id.

1. Dealing: documents are dealt into groups of bounded size by a hash of the
   id; every later step meets a group's texts in one task.
2. Candidates: a window's anchor is the least hash of its ``ANCHOR``-word
   strings.  Groups report their distinct anchors; only anchors of two
   documents can belong to a recurring window.
3. Recurring passages: windows with such an anchor are compared by a 96-bit
   hash (one row per window and group).  The least document of a recurring
   window is its home; every other group that holds the window asks the home
   for the passage, a block of ``BLOCK`` window starts.
4. Confirmation and removal: homes send the words of the passages.  Each group
   compiles its passages into Aho-Corasick automata (pyahocorasick) of at most
   ``SHARD`` windows, one after the other, and streams all its documents through
   each.  Automata work on one symbol for every ``GRAM`` neighbouring words;
   every hit is confirmed by its words, so the hash of step 3 only decides which
   passages are sent.

Whole copies need no windows: texts with equal SHA-256 are found first, and all
but the one with the least id lose every word (if there are ``span`` of them).

The steps are one plan over one exchange of the texts.  No step gathers rows by
a window, an anchor or a text alone: a window in a third of all documents has
one row per group of documents.

Defined cases: null texts have no words; texts of fewer than ``span`` words keep
all; rows that share an id never remove from each other; null ids rank after all
others; repeated rows are repeated in the result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from menurec.llm.common import raw_texts

SPAN = 13
ANCHOR = 7
BLOCK = 64
SHARD = 1 << 17
GRAM = 8
PART = 1 << 20  # bytes whose words are hashed at once
GROUP_BYTES = 8 << 20
SYMBOLS = 64
NO_ID = np.iinfo(np.int64).max
STEP, STEP_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
BYTE = np.random.default_rng(13).integers(1, 2 ** 64, 256, np.uint64)


class Words:
    """Texts laid end to end, their words one space apart: bytes, word bounds and hashes."""

    def __init__(self, texts: list[bytes]):
        parts = [t.split() for t in texts]
        self.n_words = np.array([len(p) for p in parts], np.int64)
        self.data = b"".join(b" ".join(p) + b" " for p in parts if p)
        raw = np.frombuffer(self.data, np.uint8)
        self.end = np.flatnonzero(raw == 32)
        self.begin = np.r_[0, self.end[:-1] + 1] if len(self.end) else self.end
        self.start = np.r_[0, self.n_words.cumsum()]
        self.hashes = np.empty(len(self.end), np.uint64)
        at = 0
        while at < len(self.end):  # a part of the words at once
            upto = max(at + 1, int(np.searchsorted(self.end, self.begin[at] + PART)))
            lo, hi = self.begin[at], self.end[upto - 1] + 1  # each word with the space behind it
            first = self.begin[at:upto] - lo
            size = np.diff(np.r_[first, hi - lo])
            offset = np.arange(hi - lo) - np.repeat(first, size)
            power = np.cumprod(np.r_[np.uint64(1), np.full(int(size.max()), STEP)])
            self.hashes[at:upto] = np.add.reduceat(BYTE[raw[lo:hi]] * power[offset], first)
            at = upto
        self.hashes ^= self.hashes >> np.uint64(31)
        self.hashes *= STEP_2

    def windows(self, span: int, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Start of every window, and its text; texts marked in ``without`` have none."""
        size = np.maximum(self.n_words - span + 1, 0)
        if without is not None:
            size = np.where(without, 0, size)
        doc = np.repeat(np.arange(len(size)), size)
        return self.start[doc] + np.arange(len(doc)) - np.repeat(size.cumsum() - size, size), doc

    def window(self, at: int, span: int) -> bytes:
        return self.data[self.begin[at]:self.end[at + span - 1]]


class Texts(Words):
    """The documents of a group; ``least`` has the least id of texts with copies."""

    def __init__(self, table: pa.Table, least: dict):
        super().__init__([t for b in table.to_batches() for t in raw_texts(b)])
        self.ids = np.array([NO_ID if i is None else i for i in table.column("doc_id").to_pylist()], np.int64)
        self.is_copy = np.array([least.get(k, i) < i for i, k in zip(self.ids.tolist(), table.column("key").to_pylist())], bool)


def rolled(hashes: np.ndarray, n: int, step: np.uint64) -> np.ndarray:
    """Hash of every ``n`` neighbouring words."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for j in range(n if len(out) else 0):
        out *= step
        out += hashes[j:j + len(out)]
    out ^= out >> np.uint64(29)
    out *= STEP
    return out ^ (out >> np.uint64(32))


def window_anchors(hashes: np.ndarray, span: int, size: int) -> np.ndarray:
    """The least hash of the ``size``-word strings of every window."""
    least, have, want = rolled(hashes, size, STEP), 1, span - size + 1
    while 2 * have <= want:
        least, have = np.minimum(least[:-have], least[have:]), 2 * have
    return np.minimum(least[:len(least) - (want - have)], least[want - have:]) if have < want else least


def edges(*sorted_keys: np.ndarray) -> np.ndarray:
    """First position of every run of equal keys."""
    new = np.zeros(len(sorted_keys[0]), bool)
    new[:1] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def signed(group: int, several: np.ndarray) -> np.ndarray:
    """The group's number; negative where two of its documents share the key."""
    return np.where(several, -1 - group, group).astype(np.int32)


def group_anchors(texts: Texts, group: int, span: int, size: int):
    """(key, grp): the distinct anchors of a group."""
    at, doc = texts.windows(span, texts.is_copy)
    key = window_anchors(texts.hashes, span, size)[at]
    run = edges(key, doc)
    key, ids = key[run], texts.ids[doc[run]]
    order = np.lexsort((ids, key))
    key, ids = key[order], ids[order]
    run = edges(key)
    last = np.r_[run[1:], len(key)][:len(run)] - 1
    return key[run].view(np.int64), signed(group, ids[run] != ids[last])


def group_windows(texts: Texts, anchors: np.ndarray, group: int, span: int, size: int):
    """(h, h2, lo, at, grp): the group's distinct windows with one of the anchors,
    with their least document and the first place in it."""
    at, doc = texts.windows(span, texts.is_copy)
    anchors = np.sort(anchors.view(np.uint64))
    key = window_anchors(texts.hashes, span, size)[at]
    place = np.searchsorted(anchors, key)
    held = anchors[np.minimum(place, len(anchors) - 1)] == key if len(anchors) else np.zeros(len(at), bool)
    at, doc = at[held], doc[held]
    h = rolled(texts.hashes, span, STEP)[at]
    h2 = (rolled(texts.hashes, span, STEP_2)[at] >> np.uint64(33)).astype(np.int32)
    ids, place = texts.ids[doc], (at - texts.start[doc]).astype(np.int32)
    order = np.lexsort((place, ids, h2, h))
    h, h2, ids, place = h[order], h2[order], ids[order], place[order]
    run = edges(h, h2)
    last = np.r_[run[1:], len(h)][:len(run)] - 1
    return h[run].view(np.int64), h2[run], ids[run], place[run], signed(group, ids[run] != ids[last])


def symbols(hashes: np.ndarray, gram: int) -> str:
    """One symbol for every ``gram`` neighbouring words."""
    return (rolled(hashes, gram, STEP) % np.uint64(SYMBOLS) + np.uint64(48)).astype(np.uint8).tobytes().decode("latin-1")


def automata(passages: Words, homes: list[int], span: int, gram: int):
    """Aho-Corasick automata over all windows of the passages (whose homes ascend),
    ``SHARD`` windows at once: (automaton of window starts, clashes).

    Of equal windows the first, with the least home, is kept.  Clashes are
    windows with the symbols of another window of the shard: {words: home}."""
    import ahocorasick

    size = span - gram + 1
    at, text = passages.windows(span)
    signs = symbols(passages.hashes, gram)
    for lo in range(0, len(at), SHARD):
        shard, clashes = ahocorasick.Automaton(ahocorasick.STORE_INTS), {}
        for i, t in zip(at[lo:lo + SHARD].tolist(), text[lo:lo + SHARD].tolist()):
            sign = signs[i:i + size]
            known = shard.get(sign, -1)
            if known < 0:
                shard.add_word(sign, i)
            elif (words := passages.window(i, span)) != passages.window(known, span):
                clashes.setdefault(words, homes[t])
        shard.make_automaton()
        yield shard, clashes


def repeated(texts: Texts, passages: list[tuple[int, bytes]], span: int, gram: int) -> np.ndarray:
    """Which words of the texts lie in a window that a passage of a smaller id holds."""
    passages = sorted(passages)
    sent, homes = Words([p for _, p in passages]), [d for d, _ in passages]
    home_at = np.repeat(np.array(homes, np.int64), sent.n_words).tolist()
    signs, ids, found = symbols(texts.hashes, gram), texts.ids.tolist(), []
    size = span - gram + 1
    for shard, clashes in automata(sent, homes, span, gram):
        for t in np.flatnonzero((texts.n_words >= span) & ~texts.is_copy).tolist():
            first, doc = int(texts.start[t]), ids[t]
            for end, i in shard.iter(signs[first:int(texts.start[t + 1]) - gram + 1]):
                at = first + end - size + 1
                if home_at[i] < doc and sent.window(i, span) == texts.window(at, span):
                    found.append(at)
                elif clashes and clashes.get(texts.window(at, span), doc) < doc:
                    found.append(at)
    change = np.zeros(len(texts.hashes) + span + 1, np.int64)
    found = np.array(found, np.int64)
    np.add.at(change, found, 1)
    np.add.at(change, found + span, -1)
    gone = change.cumsum()[:len(texts.hashes)] > 0
    return gone | np.repeat(texts.is_copy & (texts.n_words >= span), texts.n_words)


def dedup(docs: DataFrame, span: int = SPAN, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, spans (start, stop: removed runs of words) and
    kept_sha256 (of the kept words joined by a space) per row."""
    if span < 2:
        raise ValueError("span must be at least 2 words")
    size, gram = max(1, min(ANCHOR, span - 1)), max(1, min(GRAM, span - 3))
    total = docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    groups = int(max(12, total // group_bytes))

    def dealt(of: Column) -> Column:
        return F.pmod(F.xxhash64(of), F.lit(groups)).cast("int")

    key = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    texts = (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", key.alias("key"))
             .withColumn("grp", F.when(F.col("doc_id").isNull(), dealt(F.col("key"))).otherwise(dealt(F.col("doc_id")))))
    by_group = texts.groupBy("grp")

    # whole copies: the least id of every text that several ids share, one row per group
    # that holds a larger one; what else groups are sent has the same columns
    same = Window.partitionBy("k")
    copies = (texts.select(F.col("grp").alias("g"), F.col("key").alias("k"), F.coalesce("doc_id", F.lit(int(NO_ID))).alias("id"))
              .groupBy("g", "k").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
              .withColumn("doc", F.min("lo").over(same)).filter("hi > doc")
              .selectExpr("g", "doc", "k", "cast(null as bigint) as anchor", "cast(null as binary) as words"))

    def batch(schema: str, *columns) -> pa.Table:
        kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
        fields = [f.split() for f in schema.split(", ")]
        return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])

    def of_group(left: pa.Table, right: pa.Table) -> tuple[Texts, int]:
        least = {k: d for d, k in zip(right.column("doc").to_pylist(), right.column("k").to_pylist()) if k is not None}
        return Texts(left, least), left.column("grp")[0].as_py()

    first = "key bigint, grp int"

    def anchors_of(left: pa.Table, right: pa.Table) -> pa.Table:
        return batch(first, *(group_anchors(*of_group(left, right), span, size) if left.num_rows else ([], [])))

    same = Window.partitionBy("key")
    number = F.when(F.col("grp") < 0, -1 - F.col("grp")).otherwise(F.col("grp"))
    shared = (by_group.cogroup(copies.groupBy("g")).applyInArrow(anchors_of, first)
              .withColumn("n", F.count("*").over(same)).withColumn("several", F.min("grp").over(same))
              .filter("n > 1 or several < 0")
              .select(number.alias("g"), F.col("key").alias("anchor")))

    second = "h bigint, h2 int, lo bigint, place int, grp int"

    def windows_of(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return batch(second, *[[]] * 5)
        group, number = of_group(left, right)
        anchors = right.column("anchor").drop_null().to_numpy()
        return batch(second, *group_windows(group, anchors, number, span, size))

    same = Window.partitionBy("h", "h2")
    asked = (by_group.cogroup(shared.unionByName(copies, True).groupBy("g")).applyInArrow(windows_of, second)
             .withColumn("n", F.count("*").over(same)).withColumn("several", F.min("grp").over(same))
             .withColumn("home", F.min(F.struct("lo", "place")).over(same))
             .filter(f"(n > 1 or several < 0) and home.lo < {NO_ID}")
             .filter((F.col("grp") < 0) | (F.col("grp") != dealt(F.col("home.lo"))))
             .select(F.col("home.lo").alias("doc"), (F.col("home.place") / BLOCK).cast("int").alias("block"), number.alias("g"))
             .repartition("doc", "block").distinct())

    third = "doc bigint, block int, words binary"
    wanted = asked.select("doc", "block").distinct().withColumn("g", dealt(F.col("doc")))

    def passages_of(left: pa.Table, right: pa.Table) -> pa.Table:
        out = ([], [], [])
        blocks: dict[int, list[int]] = {}
        for doc, block in zip(right.column("doc").to_pylist(), right.column("block").to_pylist()):
            blocks.setdefault(doc, []).append(block)
        for doc, text in zip(left.column("doc_id").to_pylist(), (t for b in left.to_batches() for t in raw_texts(b))):
            words = text.split() if doc in blocks else []
            for block in blocks.get(doc, ()):
                part = words[block * BLOCK:(block + 1) * BLOCK + span - 1]
                if len(part) >= span:
                    for column, value in zip(out, (doc, block, b" ".join(part))):
                        column.append(value)
        return batch(third, *out)

    passages = (by_group.cogroup(wanted.groupBy("g")).applyInArrow(passages_of, third)
                .join(asked, ["doc", "block"]).select("g", "doc", "words"))

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        out = ([], [], [], [], [])
        if left.num_rows:
            group, _ = of_group(left, right)
            sent = {(d, w) for d, w in zip(right.column("doc").to_pylist(), right.column("words").to_pylist()) if w is not None}
            all_gone = repeated(group, list(sent), span, gram)
            for i, (doc, n) in enumerate(zip(group.ids.tolist(), group.n_words.tolist())):
                first = int(group.start[i])
                gone = all_gone[first:first + n]
                change = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8))).reshape(-1, 2)
                kept = np.r_[0, change.ravel(), n].reshape(-1, 2) + first
                text = b" ".join(group.data[group.begin[a]:group.end[b - 1]] for a, b in kept.tolist() if b > a)
                for column, value in zip(out, (None if doc == NO_ID else doc, n, int(gone.sum()),
                                               [{"start": a, "stop": b} for a, b in change.tolist()], hashlib.sha256(text).hexdigest())):
                    column.append(value)
        runs = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), runs, pa.string())
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "n_words", "n_removed", "spans", "kept_sha256"])

    return by_group.cogroup(copies.unionByName(passages, True).groupBy("g")).applyInArrow(
        remove, "doc_id bigint, n_words bigint, n_removed bigint, spans array<struct<start:int,stop:int>>, kept_sha256 string")

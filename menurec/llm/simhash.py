"""SimHash near-duplicates by a binary-trie self-join (operator 9).

1. ``fingerprints``: every whole text becomes a 64-bit SimHash of its word
   shingles (XXH64, seed 42), in Arrow batches.
2. ``links``: distinct fingerprints meet when at least one of ``max_bits + 1``
   bit blocks is equal (pigeonhole), so Spark shuffles them by (block, value).
   Within a block value a binary trie over the remaining bits is joined with
   itself: pairs of nodes go down together, their differing bits are summed
   and a pair is dropped once the budget is exceeded.
3. ``components``: alternating large-star / small-star rounds on the links.

Defined cases: a null or wordless text has fingerprint zero and is linked like
any other; copies share one fingerprint, so a hot group is one trie leaf; rows
with a null id get the smallest non-null id of their component (null when it
has none); rows repeated in the input are repeated in the output; columns other
than the id and the text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from menurec.llm.common import materialised, raw_texts

BITS = 64
SEED = 42
FRONTIER = 1 << 20  # node pairs that are expanded at once


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of one UTF-8 text; a bit is set if over half of the shingles set it."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    n = len(words) - shingle + 1
    joined = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(SEED)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 4096):
        bits = np.unpackbits(hashes[at:at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus ``fp`` (the fingerprint's 64 bits as a signed long)."""
    kept = docs.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", fp bigint"

    def run(batches):
        for batch in batches:
            prints = np.array([fingerprint(t, shingle) for t in raw_texts(batch, "__text")], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(prints.view(np.int64))], names=[*keep, "fp"])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def block_bounds(max_bits: int) -> list[tuple[int, int]]:
    """(first bit from the top, width) of the ``max_bits + 1`` blocks."""
    n = max_bits + 1
    cuts = [round(i * BITS / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def trie_self_join(values: np.ndarray, depth: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions in ``values`` (sorted, distinct uint64) whose top
    ``depth`` bits are equal and whose other bits differ in ``max_bits`` at most.

    A trie node is a range of the sorted array; a frontier holds node pairs
    with the bits they differ in so far.
    """
    out_a, out_b = [], []
    if len(values) < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    heads = values >> np.uint64(BITS - depth) if depth else np.zeros(len(values), np.uint64)
    cut = np.flatnonzero(np.diff(heads)) + 1
    lo, hi = np.r_[0, cut], np.r_[cut, len(values)]
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    stack = [(depth, lo, hi, lo, hi, np.zeros(len(lo), np.int64))]
    while stack:
        d, alo, ahi, blo, bhi, diff = stack.pop()
        if not len(alo):
            continue
        if len(alo) > FRONTIER:
            for s in range(0, len(alo), FRONTIER):
                part = slice(s, s + FRONTIER)
                stack.append((d, alo[part], ahi[part], blo[part], bhi[part], diff[part]))
            continue
        # two leaves: the remaining bits are counted at once
        leaf = (ahi - alo == 1) & (bhi - blo == 1) & (alo != blo)
        if leaf.any():
            a, b = alo[leaf], blo[leaf]
            near = np.bitwise_count(values[a] ^ values[b]) <= max_bits
            out_a.append(a[near])
            out_b.append(b[near])
        go = ~leaf & ~((alo == blo) & (ahi - alo == 1))
        alo, ahi, blo, bhi, diff = (x[go] for x in (alo, ahi, blo, bhi, diff))
        if d == BITS or not len(alo):
            continue
        bit = np.uint64(BITS - 1 - d)

        def middle(first, last, bit=bit):
            above = (values[first] >> bit >> np.uint64(1)) << np.uint64(1)
            return np.clip(np.searchsorted(values, (above | np.uint64(1)) << bit), first, last)

        am, bm = middle(alo, ahi), middle(blo, bhi)
        same = alo == blo
        children = [(alo, am, blo, bm, diff, None), (am, ahi, bm, bhi, diff, None),
                    (alo, am, bm, bhi, diff + 1, None), (am, ahi, blo, bm, diff + 1, ~same)]
        parts = []
        for cal, cah, cbl, cbh, cd, only in children:
            ok = (cal < cah) & (cbl < cbh) & (cd <= max_bits)
            if only is not None:
                ok &= only
            parts.append(tuple(x[ok] for x in (cal, cah, cbl, cbh, cd)))
        stack.append((d + 1, *(np.concatenate(x) for x in zip(*parts))))
    if not out_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(out_a), np.concatenate(out_b)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position reachable from each of ``n`` positions over the links."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        open_ = low != high
        if not open_.any():
            break
        a, b = a[open_], b[open_]
        np.minimum.at(root, high[open_], low[open_])
        while True:  # pointer jumping
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def links(prints: DataFrame, max_bits: int = 2, fp: str = "fp", spanning: bool = False) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints with ``max_bits`` or fewer differing
    bits, ``a`` and ``b`` in rotated-trie order; each pair once per block that
    agrees.  ``spanning=True`` gives (node, smallest node of its class) per
    block value instead: the same components, at most one link per node."""
    bounds = block_bounds(max_bits)
    one = prints.select(F.col(fp).alias("fp"))
    turned = [F.struct(F.lit(i).alias("block"),
                       (F.col("fp") if at == 0 else F.shiftleft("fp", at).bitwiseOR(F.shiftrightunsigned("fp", BITS - at))).alias("turned"))
              for i, (at, _) in enumerate(bounds)]
    spread = one.select(F.explode(F.array(*turned)).alias("x")).select("x.block", "x.turned")
    widths = [w for _, w in bounds]
    key = F.coalesce(*[F.when(F.col("block") == i, F.shiftrightunsigned("turned", BITS - w)) for i, w in enumerate(widths)])
    dealt = spread.withColumn("key", key).repartition("block", "key").sortWithinPartitions("block", "key")

    def run(batches):
        held = []

        def solve(block, values):
            """All whole groups of one block: rotated back to fingerprints."""
            at, width = bounds[block]
            values = np.unique(values)
            a, b = trie_self_join(values, width, max_bits)
            if spanning:
                root = local_roots(len(values), a, b)
                a = np.flatnonzero(root != np.arange(len(values)))
                b = root[a]
            back = lambda x: ((x >> np.uint64(at)) | (x << np.uint64(BITS - at)) if at else x).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(back(values[a])), pa.array(back(values[b]))], names=["a", "b"])

        for batch in batches:
            block = batch.column("block").to_numpy(zero_copy_only=False)
            turned_ = batch.column("turned").to_numpy(zero_copy_only=False).view(np.uint64)
            group = batch.column("key").to_numpy(zero_copy_only=False)
            if len(block):
                held.append((block, group, turned_))
            block, group, turned_ = (np.concatenate(x) for x in zip(*held)) if held else (np.empty(0, int),) * 3
            if not len(block):
                continue
            # groups that are whole: all but the last one seen
            open_from = np.flatnonzero((block != block[-1]) | (group != group[-1]))
            whole = open_from[-1] + 1 if len(open_from) else 0
            for i in np.unique(block[:whole]):
                yield solve(i, turned_[:whole][block[:whole] == i])
            held = [(block[whole:], group[whole:], turned_[whole:])]
        if held:
            yield solve(held[0][0][0], np.concatenate([h[2] for h in held]))

    return dealt.mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node
    reachable.  Alternating stars; each half round is checkpointed, and minima
    are joined as tables of their own so that a hub's rows can be split."""

    def half(pairs: DataFrame, keep_u: bool) -> DataFrame:
        low = materialised(pairs.groupBy("u").agg(F.min("v").alias("m")))
        near = low.select(F.col("u"), F.least("u", "m").alias("m"))
        joined = pairs.filter("v > u" if not keep_u else "v < u").join(near, "u")
        out = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        if keep_u:
            out = out.unionByName(near.filter("u <> m").select("u", F.col("m").alias("v")))
        return materialised(out.distinct())

    def mark(pairs: DataFrame):
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = materialised(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = mark(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        now = half(both, keep_u=False)
        now = half(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), keep_u=True)
        after = mark(now)
        if after == seen:
            break
        seen = after
    return (now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))


def classes(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """(fp, root) for the distinct fingerprints of ``prints``; root names the component."""
    distinct = materialised(prints.select("fp").distinct())
    tied = materialised(components(links(distinct, max_bits, spanning=True)))
    return materialised(distinct.join(tied, distinct["fp"] == tied["node"], "left")
                        .select("fp", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row per input row: doc_id, fp, component_id (smallest doc_id reachable)."""
    prints = materialised(fingerprints(docs, shingle))
    mapped = classes(prints, max_bits)
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    smallest = materialised(least.join(mapped, "fp").groupBy("root").agg(F.min("low").alias("component_id")))
    named = materialised(mapped.join(smallest, "root").select("fp", "component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """The documents left when one of each component stays: the one with the
    smallest doc_id (null last), then the smallest hash of its text, source and
    lang.  Columns are unchanged; rows equal in id and those three count as one
    document.  A row is known by its id and 128 bits, so no document is lost to
    another's hash."""
    known = [c for c in ("doc_id", "text", "source", "lang") if c in docs.columns]
    content = [x for c in known for x in (F.col(c), F.isnull(c))]   # a hash passes over nulls
    keyed = docs.withColumns({"__row": F.xxhash64(*content), "__check": F.xxhash64(F.lit("check"), *content)})
    key = ("doc_id", "__row", "__check")
    prints = materialised(fingerprints(keyed, shingle, keep=key))
    mapped = classes(prints, max_bits)
    order = F.struct(F.col("doc_id").isNull().alias("none"), *key)
    per_print = materialised(prints.groupBy("fp").agg(F.min(order).alias("first")))
    stay = materialised(per_print.join(mapped, "fp").groupBy("root").agg(F.min("first").alias("first"))
                        .select(*[F.col(f"first.{c}").alias(f"stay_{c}") for c in key]))
    same = [F.col(c).eqNullSafe(F.col(f"stay_{c}")) for c in key]
    return keyed.join(stay, same, "left_semi").dropDuplicates(list(key)).select(*docs.columns)

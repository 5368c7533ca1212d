"""Divergence of sources within a language, by term shares (operator 12).

Terms are runs of ASCII letters and non-ASCII characters.  One ``bytes.translate``
lowers A-Z and blanks every other ASCII byte, ``bytes.split`` yields the terms
and a ``Counter`` per document the counts, which are added up sparsely: first in
the task, per (lang, source), then by Spark, per (lang, source, term) and per
(lang, term).  Terms in enough documents of a language are kept.

The shares of all sources for a block of kept terms form a small matrix (zeros
filled in).  Blocks yield, for every pair of sources, their part of the sum of
the differences of shares, and each source's terms furthest above the whole
language; sums and ranks of these are the result.  Very many sources are dealt
into tiles, so that a matrix stays small.

Defined cases: a null text, lang or source counts as ''; a group without terms
has the smoothed share of a count of zero for each kept term; without kept terms
every pair differs by 0 and no term is reported; repeated rows count as
documents of their own; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from menurec.llm.common import materialised, raw_texts

MIN_DOCS = 30
SMOOTHING = 5
UNIT = 10 ** 9
TOP_TERMS = 50
HELD_TERMS = 200_000  # counts held in a task before they are handed on
CELLS = 1 << 16
TILE = 256

LETTERS = bytes(range(65, 91)), bytes(range(97, 123))
TABLE = bytes(LETTERS[1][LETTERS[0].index(b)] if b in LETTERS[0] else b if b in LETTERS[1] or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a text."""
    return text.translate(TABLE).split()


def counted(batches):
    """lang, source, term, n, docs: sums over the documents of a task; a row
    with the empty term stands for the group itself."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def rows():
        out = ([], [], [], [], [])
        for (lang, source), (n, docs) in held.items():
            out[0].extend([lang] * (len(n) + 1))
            out[1].extend([source] * (len(n) + 1))
            out[2].append(b"")
            out[2].extend(n)
            out[3].append(0)
            out[3].extend(n.values())
            out[4].append(0)
            out[4].extend(docs[t] for t in n)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.binary()).cast(pa.string()),
                                           pa.array(out[3], pa.int64()), pa.array(out[4], pa.int64())], names=["lang", "source", "term", "n", "docs"])

    size = 0
    for batch in batches:
        for text, lang, source in zip(raw_texts(batch), batch.column("lang").to_pylist(), batch.column("source").to_pylist()):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            before = len(n)
            found = Counter(terms(text))
            for term, count in found.items():
                n[term] += count
            docs.update(found.keys())
            size += len(n) - before
            if size >= HELD_TERMS:
                yield rows()
                held, size = {}, 0
    if held:
        yield rows()


def shares(counts: np.ndarray, totals: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + SMOOTHING) / (total + SMOOTHING * kept)), exactly.

    The quotient is worked out by thousands, so that no step leaves 64 bits."""
    below = totals + SMOOTHING * kept
    rest, out = counts + SMOOTHING, np.zeros_like(counts)
    for _ in range(3):
        whole, rest = np.divmod(rest * 1000, below)
        out = out * 1000 + whole
    return out + 1


def measured(cells: pa.Table, groups: pa.Table, top_terms: int) -> dict[str, list]:
    """The rows of one block of terms and one tile of sources."""
    out = {"source": [], "part": [], "item": [], "value": []}
    names = groups.column("group").to_pylist()
    left, right = (np.flatnonzero(groups.column(c).to_numpy(zero_copy_only=False)) for c in ("is_left", "is_right"))
    total, kept = (groups.column(c).to_numpy() for c in ("total", "kept"))
    words, term = np.unique(np.array(cells.column("term").to_pylist(), object), return_inverse=True) if cells.num_rows else ([], [])
    counts = np.zeros((len(names), len(words)), np.int64)
    if len(words):
        place = {s: i for i, s in enumerate(names)}
        counts[[place[s] for s in cells.column("source").to_pylist()], term] = cells.column("n").to_numpy()
        share = shares(counts, total[:, None], kept[:, None])
    else:
        share = counts
    for i in left.tolist():
        gap = np.abs(share[right] - share[i]).sum(axis=1)
        for j, value in zip(right.tolist(), gap.tolist()):
            if i != j:
                out["source"].append(names[i])
                out["part"].append("pair")
                out["item"].append(names[j])
                out["value"].append(value)
    if len(words) and groups.column("is_first")[0].as_py():
        whole = np.zeros(len(words), np.int64)
        whole[term] = cells.column("lang_n").to_numpy()
        q = shares(whole, groups.column("lang_total").to_numpy()[:1], kept[:1])
        for i in left.tolist():
            at = np.flatnonzero((counts[i] > 0) & (share[i] > q))
            gap = share[i][at] - q[at]
            at = at[np.lexsort((np.array([words[a].encode() for a in at], object), -gap))[:top_terms]] if len(at) else at
            for a in at.tolist():
                out["source"].append(names[i])
                out["part"].append("term")
                out["item"].append(words[a])
                out["value"].append(int(share[i][a] - q[a]))
    return out


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank per source."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    partial = docs.select("text", blank("lang"), blank("source")).mapInArrow(counted, "lang string, source string, term string, n bigint, docs bigint")
    by_source = partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = materialised(by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"),
                                                              F.collect_list(F.struct("source", "n")).alias("sources"))
                        .filter((F.col("docs") >= min_docs) | (F.col("term") == "")))
    entries = kept.select("lang", "term", "lang_n", F.inline("sources"))
    size = (entries.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if(F.col("term") != "").alias("held")))
    langs = kept.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count_if(F.col("term") != "").alias("kept"),
                                     F.max(F.size("sources")).alias("n_sources"))
    most = langs.agg(F.max("n_sources"), F.max("kept")).first()
    n_sources, n_terms = most[0] or 0, most[1] or 0
    tiles, wide = -(-max(1, n_sources) // TILE), min(n_sources, TILE)
    blocks = max(1, -(-n_terms * 2 * wide // max(CELLS, 16 * wide * wide)))
    tile = lambda c: F.pmod(F.xxhash64(c), F.lit(tiles)).cast("int")
    every = F.array(*[F.lit(t) for t in range(tiles)]) if tiles <= 64 else F.sequence(F.lit(0), F.lit(tiles - 1))

    def spread(df: DataFrame, source: str) -> DataFrame:
        """Each row to every pair of tiles (i, j) that its source's tile belongs to."""
        own = tile(source)
        pairs: Column = F.array_distinct(F.concat(F.transform(every, lambda t: F.struct(own.alias("i"), t.alias("j"))),
                                                  F.transform(every, lambda t: F.struct(t.alias("i"), own.alias("j")))))
        return df.select("*", F.inline(pairs))

    cells = spread(entries.filter("term <> ''").withColumn("block", F.pmod(F.xxhash64("term", F.lit(1)), F.lit(blocks)).cast("int")), "source")
    groups = spread(size.join(langs, "lang").select(F.col("lang").alias("of"), F.col("source").alias("group"), "total", "kept", "lang_total",
                                                    F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("at")), "group")
    groups = groups.select("of", "group", "total", "kept", "lang_total", "at", F.col("i").alias("down"), F.col("j").alias("across"),
                           (tile("group") == F.col("i")).alias("is_left"), (tile("group") == F.col("j")).alias("is_right"),
                           (F.col("i") == F.col("j")).alias("is_first"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = measured(left, right, top_terms) if right.num_rows else {"source": [], "part": [], "item": [], "value": []}
        lang = right.column("of")[0].as_py() if right.num_rows else ""
        return pa.table({"lang": pa.array([lang] * len(found["item"]), pa.string()), "source": pa.array(found["source"], pa.string()),
                         "part": pa.array(found["part"], pa.string()), "item": pa.array(found["item"], pa.string()),
                         "value": pa.array(found["value"], pa.int64())})

    parts = (cells.groupBy("lang", "block", "i", "j").cogroup(groups.groupBy("of", "at", "down", "across"))
             .applyInArrow(run, "lang string, source string, part string, item string, value bigint"))
    total = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return (total.withColumn("rank", F.row_number().over(order)).filter((F.col("part") == "pair") | (F.col("rank") <= top_terms))
            .select("lang", "source", "part", "item", "value", "rank"))

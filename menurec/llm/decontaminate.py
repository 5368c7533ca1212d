"""Benchmark decontamination by pigeonhole edit matching (operator 8).

A test item may appear in a document with up to ``budget`` edits (a share of
its length).  Cut into ``budget + 1`` pieces, at least one piece must then
appear unchanged (pigeonhole), so one Aho-Corasick pass over each whole text
finds every place an item can be.  Each hit fixes a diagonal; Myers'
bit-parallel algorithm (Python integers as bit vectors, any item length)
verifies the item's edit distance to the best substring near that diagonal.

Items and texts are compared after lower-casing and with every run of white
space as one blank; items shorter than ``min_chars`` after that must appear
unchanged and at word boundaries (scripts without blanks have none).  The items are split into blocks of at most
``block_bytes`` characters; each block is one pass over the documents, so what
a task holds is bounded whatever the size of the benchmark.

Defined cases: null or empty texts and items match nothing; equal items are
reported each under its own id; an item that occurs several times in a text is
reported once, with the smallest distance (then the first end); a null item_id
is not reported, but its item counts where documents are dropped; repeated document rows repeat their rows; extra columns are
ignored.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from menurec.llm.common import materialised

RATE = 0.06
MIN_CHARS = 40
BLOCK_BYTES = 8 << 20


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def edit_budget(item: str, rate: float = RATE) -> int:
    return int(len(item) * rate)


def pieces(item: str, rate: float = RATE) -> list[tuple[int, str]]:
    """(offset, piece): ``budget + 1`` pieces of nearly equal length."""
    n = edit_budget(item, rate) + 1
    cuts = [round(i * len(item) / n) for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(item_masks: dict[str, int], length: int, text: str, limit: int) -> tuple[int, int]:
    """(smallest edit distance of the item to a substring of ``text``, first end
    that reaches it); the distance is ``limit + 1`` if it exceeds the limit."""
    full = (1 << length) - 1
    top = 1 << (length - 1)
    plus, minus, score = full, 0, length
    best, at = (length, 0) if length <= limit else (limit + 1, -1)
    get = item_masks.get
    for i, c in enumerate(text):
        eq = get(c, 0)
        zero = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | ~(zero | plus) & full
        down = zero & plus
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1) & full  # a match may start anywhere: the first row stays zero
        plus = ((down << 1) & full) | ~(zero | up) & full
        minus = up & zero
        if score < best:
            best, at = score, i + 1
    return best, at


def joined(a: str, b: str) -> bool:
    """Whether two neighbouring characters belong to one word; from U+2E80 on scripts set no blanks."""
    return a.isalnum() and b.isalnum() and max(a, b) < "\u2e80"


def at_boundaries(text: str, start: int, end: int) -> bool:
    return not (start and joined(text[start - 1], text[start]) or end < len(text) and joined(text[end - 1], text[end]))


class Items:
    """A block of test items with their automaton; those shorter than ``min_chars`` match as whole words only."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE, min_chars: int = MIN_CHARS):
        self.ids = [i for i, _ in items]
        self.texts = [t for _, t in items]
        self.short = [len(t) < min_chars for t in self.texts]
        self.budgets = [edit_budget(t, rate) for t in self.texts]
        self.masks: list[dict[str, int] | None] = [None] * len(items)
        where: dict[str, list[tuple[int, int]]] = {}
        for n, text in enumerate(self.texts):
            for at, piece in [(0, text)] if self.short[n] else pieces(text, rate):
                where.setdefault(piece, []).append((n, at))
        self.tree = ahocorasick.Automaton()
        for piece, places in where.items():
            self.tree.add_word(piece, (len(piece), places))
        self.tree.make_automaton()

    def mask(self, n: int) -> dict[str, int]:
        if self.masks[n] is None:
            bits: dict[str, int] = {}
            for i, c in enumerate(self.texts[n]):
                bits[c] = bits.get(c, 0) | 1 << i
            self.masks[n] = bits
        return self.masks[n]

    def search(self, text: str) -> list[tuple[int, int, int]]:
        """(item_id, distance, end in the normalised text) of every item found."""
        spots: dict[int, set[int]] = {}
        for end, (size, places) in self.tree.iter(text):
            for n, at in places:
                spots.setdefault(n, set()).add(end + 1 - size - at)
        out = []
        for n, starts in spots.items():
            budget, length = self.budgets[n], len(self.texts[n])
            if self.short[n]:
                ends = [s + length for s in starts if at_boundaries(text, s, s + length)]
                if ends:
                    out.append((self.ids[n], 0, min(ends)))
                continue
            best = None
            for low, high in windows(sorted(starts), length, budget):
                low = max(0, low)
                part = text[low:high]
                exact = part.find(self.texts[n])
                if exact >= 0:
                    found = (0, low + exact + length)
                else:
                    distance, stop = myers(self.mask(n), length, part, budget)
                    found = (distance, low + stop) if distance <= budget else None
                if found and (best is None or found < best):
                    best = found
            if best:
                out.append((self.ids[n], *best))
        return sorted(out)


def windows(starts: list[int], length: int, budget: int):
    """Stretches of text that hold every match on the given diagonals, merged."""
    low = high = None
    for s in starts:
        a, b = s - budget, s + length + budget
        if low is None:
            low, high = a, b
        elif a <= high:
            high = b
        else:
            yield low, high
            low, high = a, b
    if low is not None:
        yield low, high


def item_blocks(benchmark: DataFrame, block_bytes: int, null_ids: bool = False):
    """The normalised items in blocks of bounded size, one at a time on the driver; ``null_ids`` keeps items without an id, as -1."""
    clean = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    item = F.coalesce("item_id", F.lit(-1)) if null_ids else F.col("item_id")
    sized = materialised(benchmark.select(item.alias("item_id"), "text", F.length(clean).alias("size"))
                         .filter(F.col("item_id").isNotNull() & (F.col("size") > 0)))
    total = sized.agg(F.sum("size")).first()[0] or 0
    n = 1 + 2 * total // block_bytes
    for k in range(n):
        rows = sized.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).select("item_id", "text").distinct().collect()
        kept = [(r["item_id"], t) for r in rows if (t := normal(r["text"]))]
        if kept:
            yield sorted(kept)


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, min_chars: int = MIN_CHARS,
            block_bytes: int = BLOCK_BYTES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, item_id, distance, end_at: one row per document row and item it holds."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    schema += ", item_id bigint, distance int, end_at int"
    out = None
    for block in item_blocks(benchmark, block_bytes):

        def run(batches, block=block):
            items = Items(block, rate, min_chars)
            for batch in batches:
                found = [(i, *hit) for i, t in enumerate(batch.column("__text").to_pylist()) if t for hit in items.search(normal(t))]
                rows = pa.array([f[0] for f in found], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).take(rows) for c in keep]
                    + [pa.array([f[j] for f in found], kind) for j, kind in ((1, pa.int64()), (2, pa.int32()), (3, pa.int32()))],
                    names=[*keep, "item_id", "distance", "end_at"])

        part = docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, min_chars: int = MIN_CHARS,
                      block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without those that hold a test item; columns and other rows stay.
    Each block of items is one narrow filter pass, nothing is shuffled."""
    names = docs.columns
    for block in item_blocks(benchmark, block_bytes, null_ids=True):

        def run(batches, block=block):
            items = Items(block, rate, min_chars)
            for batch in batches:
                clean = [not (t and items.search(normal(t))) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(clean, pa.bool_())) for c in (batch.column(n) for n in names)], names=names)

        docs = docs.mapInArrow(run, docs.schema)
    return docs

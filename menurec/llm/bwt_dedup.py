"""Exact substring dedup by column-wise multi-document construction (operator 6).

A byte is removed if it lies in a ``span``-byte string that also starts in a
document with a smaller id.  Sorting all suffixes of all texts is not needed
for that: strings of ``span`` bytes suffice, and equal ones can be brought
together first.

1. Dealing: every ``span``-byte window is assigned to its smallest 8-byte
   piece (by hash, leftmost on ties).  Consecutive windows with the same piece
   form a read of at most ``span + 42`` bytes, so the reads of a text hold each
   window exactly once, and equal windows of different texts lie at the same
   offset of reads that share the piece.  Reads go to buckets by the piece,
   packed and compressed: one sequential file per slice and bucket.
2. Construction, per bucket: reads whose 29 bytes around the piece no other
   document shares on either side can hold no repeat and are left out; copies
   are merged.  The others are aligned at the piece and built column by column
   from the right: each round inserts one symbol per read, a stable sort by
   the inserted symbol turns the order of the suffixes (this sequence of
   symbols in the old order is the round's part of the collection's
   Burrows-Wheeler transform) and the common prefixes follow by range minima.
   Runs with a common prefix of ``span`` are equal windows; each gets the
   smallest document id of its run.
3. Removal: the spans go back to their documents, are merged, and the kept
   bytes are hashed; both sides meet packed, by a hash of the id.

The check is by symbols, not by hashes.  Inputs are bounded per task by the
number of buckets, which grows with the total size.

Defined cases: null and empty texts have no byte; texts shorter than ``span``
keep all; rows that share an id never remove from each other; a null id ranks
after all others; repeated rows are repeated in the result; very long texts are
cut into overlapping pieces, which changes no window; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from menurec.llm.common import raw_texts

SPAN = 50
PIECE = 8
SLICE = 8 << 20
PART = 1 << 20  # bytes whose pieces are hashed at once
BUCKET_BYTES = 4 << 20
GROUP_BYTES = 16 << 20
AT_ONCE = 1 << 16
NO_ID = np.iinfo(np.int64).max
MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
POSITION = np.uint64((1 << 24) - 1)


def pack(arrays: list[np.ndarray]) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(arrays, protocol=5))


def unpack(blob: bytes) -> list[np.ndarray]:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def words_at(data: np.ndarray) -> np.ndarray:
    """Every 8 neighbouring bytes as one number, without a copy (unaligned view)."""
    return np.ndarray((len(data) - PIECE + 1,), "<u8", np.ascontiguousarray(data).data, 0, (1,))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * MIX1
    x ^= x >> np.uint64(31)
    x *= MIX2
    x ^= x >> np.uint64(29)
    return x


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The positions of all ranges, one after the other."""
    first = np.repeat(starts - np.r_[0, lens.cumsum()[:-1]], lens)
    return first + np.arange(int(lens.sum()))


def cut_reads(data: np.ndarray, piece_start: np.ndarray, piece_len: np.ndarray, span: int):
    """Reads of a slice of texts laid end to end: start, number of windows, place
    of the shared piece in the read, the piece."""
    none = np.empty(0, np.int64)
    long_ = piece_len >= span
    if not long_.any():
        return none, none, none, np.empty(0, np.uint64)
    words = words_at(data)
    best = mixed(words)
    best &= ~POSITION
    best |= np.arange(len(best), dtype=np.uint64)
    size, want = 1, span - PIECE + 1
    while 2 * size <= want:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    if size < want:
        best = np.minimum(best[:size - want], best[want - size:])
    at = ranges(piece_start[long_], piece_len[long_] - span + 1)
    anchor = (best[at] & POSITION).astype(np.int64)
    new = np.r_[True, (np.diff(at) != 1) | (np.diff(anchor) != 0)]
    first = np.flatnonzero(new)
    start = at[first]
    return start, np.diff(np.r_[first, len(at)]), anchor[first] - start, words[anchor[first]]


class Slice:
    """Texts laid end to end until a slice is full; very long ones in pieces."""

    def __init__(self, span: int):
        self.span, self.size = span, 0
        self.parts, self.doc, self.key, self.base = [], [], [], []

    def add(self, doc_id: int, key: int, text: bytes):
        """Adds the text, yielding the slice whenever it is full."""
        for base in range(0, max(1, len(text) - self.span + 1), PART):
            part = text[base:base + PART + self.span - 1]
            if self.parts and self.size + len(part) > SLICE:
                yield self
                self.__init__(self.span)
            self.parts.append(part)
            self.doc.append(doc_id)
            self.key.append(key)
            self.base.append(base)
            self.size += len(part)

    def blobs(self, buckets: int):
        """(bucket, packed reads)."""
        lens = np.array([len(p) for p in self.parts], np.int64)
        begin = np.r_[0, lens.cumsum()[:-1]].astype(np.int64)
        data = np.frombuffer(b"".join(self.parts), np.uint8)
        found, at = [], 0
        while at < len(lens):  # a megabyte of texts at a time: the hashes take eight times their bytes
            upto = max(at + 1, int(np.searchsorted(begin, begin[at] + PART)))
            a, b = begin[at], begin[upto - 1] + lens[upto - 1]
            start, wins, rel, piece = cut_reads(data[a:b], begin[at:upto] - a, lens[at:upto], self.span)
            found.append((start + a, wins, rel, piece))
            at = upto
        start, wins, rel, piece = (np.concatenate(x) for x in zip(*found))
        if not len(start):
            return
        bucket = (mixed(piece ^ MIX2) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket.astype(np.uint16), kind="stable") if buckets <= 1 << 16 else np.argsort(bucket, kind="stable")
        start, wins, rel, bucket = start[order], wins[order], rel[order], bucket[order]
        owner = np.searchsorted(begin, start, side="right") - 1
        # empty parts share a begin; the last one that begins there is never empty unless at the end
        sizes = wins + self.span - 1
        doc, key, base = np.array(self.doc, np.int64), np.array(self.key, np.int64), np.array(self.base, np.int64)
        for first, last in zip(*_runs(bucket)):
            rows = slice(first, last)
            used, local = np.unique(owner[rows], return_inverse=True)
            where = (start[rows] - begin[owner[rows]] + base[owner[rows]]).astype(np.int32)
            yield int(bucket[first]), pack([
                np.diff(doc[used], prepend=0), key[used], local.astype(np.uint32), where, wins[rows].astype(np.uint8), rel[rows].astype(np.uint8),
                data[ranges(start[rows], sizes[rows])]])


def _runs(sorted_values: np.ndarray):
    """(first, one past last) of the runs of equal values."""
    edge = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])
    return edge, np.r_[edge[1:], len(sorted_values)]


def shared_by_docs(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which rows have a key that another document has too."""
    out = np.zeros(len(keys), bool)
    if len(keys):
        order = np.argsort(keys)
        edge, end = _runs(keys[order])
        ids = doc[order]
        several = np.minimum.reduceat(ids, edge) < np.maximum.reduceat(ids, edge)
        out[order] = np.repeat(several, end - edge)
    return out


def candidates(flat, offset, sizes, rel, doc, span):
    """Reads whose piece and half of the other window bytes, to its left or its
    right, occur in another document; any repeated window needs one of these."""
    padded = np.concatenate([flat, np.zeros(2 * span, np.uint8)])
    words = words_at(padded)
    spot = offset + rel
    side = (span - PIECE + 1) // 2
    keep = np.zeros(len(rel), bool)
    piece = mixed(words[spot])
    for left in (True, False):
        has = np.flatnonzero(rel >= side if left else sizes - rel - PIECE >= side)
        at = spot[has]
        marks = range(-side, -PIECE, PIECE) if left else range(PIECE, side, PIECE)
        key = piece[has]
        for m in [*marks, -PIECE if left else side]:
            key = mixed(key ^ words[at + m])
        keep[has] |= shared_by_docs(key, doc[has])
    return keep


def smallest_owner(text: np.ndarray, size: np.ndarray, wins: np.ndarray, rel: np.ndarray, owner: np.ndarray, span: int) -> np.ndarray:
    """Per read (row of ``text``) and window the smallest owner of an equal window.

    Column-wise construction: columns are offsets from the shared piece.  From
    the last column to the first, each read inserts its symbol (0: none, its
    text ends); ``order`` is the order of the suffixes that begin at the
    column, ``common`` the common prefix with the suffix before, up to ``span``.
    """
    n, most = len(size), span - PIECE + 1
    out = np.full((n, most), NO_ID, np.int64)
    order, common = np.arange(n), np.zeros(n, np.int16)
    for offset in range(span - 1, -most, -1):
        place = rel[order] + offset
        here = (place >= 0) & (place < size[order])
        symbol = np.where(here, text[order, np.clip(place, 0, text.shape[1] - 1)].astype(np.uint16) + 1, 0).astype(np.uint16)
        turn = np.argsort(symbol, kind="stable")
        order, symbol = order[turn], symbol[turn]
        # between neighbours with one symbol: one more than the smallest prefix between their old places
        low = np.minimum.reduceat(np.r_[common, np.int16(span)], turn + 1)[:-1]
        same = (symbol[1:] == symbol[:-1]) & (symbol[1:] > 0)
        common = np.r_[np.int16(0), np.where(same, np.minimum(low + 1, span), 0).astype(np.int16)]
        if offset > 0:
            continue
        edge = np.flatnonzero(common < span)
        length = np.diff(np.r_[edge, n])
        least = np.repeat(np.minimum.reduceat(owner[order], edge), length)
        place = rel[order] + offset
        own = (place >= 0) & (place < wins[order])
        out[order[own], place[own]] = least[own]
    return out


def repeated_spans(blobs: list[bytes], span: int):
    """(doc id, key, start, end) of every repeated stretch in a bucket."""
    docs, keys, local, where, wins, rel, flat = ([] for _ in range(7))
    seen = 0
    for blob in blobs:
        d, k, l, w, n, r, f = unpack(blob)
        docs.append(d.cumsum())
        keys.append(k)
        local.append(l.astype(np.int64) + seen)
        where.append(w)
        wins.append(n)
        rel.append(r)
        flat.append(f)
        seen += len(d)
    docs, keys, local, where, wins, rel, flat = (np.concatenate(x) for x in (docs, keys, local, where, wins, rel, flat))
    wins, rel = wins.astype(np.int64), rel.astype(np.int64)
    sizes = wins + span - 1
    offset = np.r_[0, sizes.cumsum()[:-1]]
    doc = docs[local]
    keep = np.flatnonzero(candidates(flat, offset, sizes, rel, doc, span))
    if not len(keep):
        return
    offset, sizes, wins, rel, doc, where, key = offset[keep], sizes[keep], wins[keep], rel[keep], doc[keep], where[keep].astype(np.int64), keys[local[keep]]
    width = -(-(2 * span - PIECE) // 8) * 8
    text = np.zeros((len(keep), width), np.uint8)
    text[np.arange(width) < sizes[:, None]] = flat[ranges(offset, sizes)]
    del flat
    # copies of a read become one, owned by the smallest id; a hash that lies only splits them
    piece = words_at(text.ravel())[np.arange(len(keep)) * width + rel]
    mark = mixed(piece ^ (rel * 256 + wins).astype(np.uint64))
    for column in text.view("<u8").T:
        mark = mixed(mark ^ column)
    order = np.lexsort((mark, piece))
    differs = (piece[order][1:] != piece[order][:-1]) | (rel[order][1:] != rel[order][:-1]) | (wins[order][1:] != wins[order][:-1])
    differs |= (text[order[1:]] != text[order[:-1]]).any(axis=1)
    edge = np.flatnonzero(np.r_[True, differs])
    unique = order[edge]
    owner = np.minimum.reduceat(doc[order], edge)
    member = np.empty(len(order), np.int64)
    member[order] = np.repeat(np.arange(len(edge)), np.diff(np.r_[edge, len(order)]))
    by_unique = np.argsort(member, kind="stable")
    occurrence = np.searchsorted(member[by_unique], np.arange(len(edge) + 1))
    # whole groups of one piece at a time
    first, last = _runs(piece[unique])
    at = 0
    while at < len(first):
        upto = max(at + 1, int(np.searchsorted(last, first[at] + AT_ONCE, side="right")))
        lo, hi = first[at], last[upto - 1]
        rows = unique[lo:hi]
        least = smallest_owner(text[rows], sizes[rows], wins[rows], rel[rows], owner[lo:hi], span)
        reads = by_unique[occurrence[lo]:occurrence[hi]]
        for a in range(0, len(reads), AT_ONCE):
            part = reads[a:a + AT_ONCE]
            flag = np.zeros((len(part), least.shape[1] + 2), np.int8)
            flag[:, 1:-1] = (least[member[part] - lo] < doc[part, None]) & (np.arange(least.shape[1]) < wins[part, None])
            change = np.diff(flag, axis=1)
            row, begin = np.nonzero(change == 1)
            _, stop = np.nonzero(change == -1)
            yield doc[part][row], key[part][row], where[part][row] + begin, where[part][row] + stop + span - 1
        at = upto


def group_of(doc: np.ndarray, groups: int) -> np.ndarray:
    return (mixed(doc.astype(np.uint64)) % np.uint64(groups)).astype(np.int64)


def grouped(doc: np.ndarray, groups: int):
    """(group, positions) of the ids."""
    group = group_of(doc, groups)
    order = np.argsort(group, kind="stable")
    for first, last in zip(*_runs(group[order])) if len(order) else ():
        yield int(group[order[first]]), order[first:last]


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals sorted by start; touching ones become one."""
    reach = np.maximum.accumulate(end)
    new = np.r_[True, start[1:] > reach[:-1]]
    edge = np.flatnonzero(new)
    return start[edge], reach[np.r_[edge[1:] - 1, len(start) - 1]]


def dedup(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (start, end) and kept_sha256 per row.

    ``span`` is at least 29: the halves around an 8-byte piece are compared by
    whole words."""
    if not 29 <= span <= 120:
        raise ValueError("span must be 29 to 120 bytes")
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, groups = int(max(24, total // BUCKET_BYTES)), int(max(12, total // GROUP_BYTES))
    # rows that share an id are told apart by a checksum of the text; usually there are none
    keyed = bool(slim.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count())

    def rows(batch):
        ids = [NO_ID if i is None else i for i in batch.column("doc_id").to_pylist()]
        texts = raw_texts(batch)
        return ids, [zlib.crc32(t) if keyed else 0 for t in texts], texts

    def batch_of(found, *names):
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.binary() if i == len(names) - 1 else pa.int32())
                                           for i in range(len(names))], names=list(names))

    def deal(batches):
        held = Slice(span)
        for batch in batches:
            for doc, key, text in zip(*rows(batch)):
                for full in held.add(doc, key, text):
                    yield batch_of(list(full.blobs(buckets)), "bucket", "blob")
        if held.parts:
            yield batch_of(list(held.blobs(buckets)), "bucket", "blob")

    def search(table: pa.Table) -> pa.Table:
        spans: dict[int, list] = {}
        for doc, key, start, end in repeated_spans(table.column("blob").to_pylist(), span):
            for group, at in grouped(doc, groups):
                spans.setdefault(group, []).append((doc[at], key[at], start[at].astype(np.int32), end[at].astype(np.int32)))
        found = [(g, 1, pack([np.concatenate(x) for x in zip(*parts)])) for g, parts in sorted(spans.items())]
        return pa.Table.from_batches([batch_of(found, "grp", "kind", "blob")])

    def texts(batches):
        def out(ids, keys, held):
            found = []
            for group, at in grouped(np.array(ids, np.int64), groups):
                found.append((group, 0, pack([np.array(ids, np.int64)[at], np.array(keys, np.int64)[at], [held[i] for i in at]])))
            return batch_of(found, "grp", "kind", "blob")

        ids, keys, held, size = [], [], [], 0
        for batch in batches:
            for doc, key, text in zip(*rows(batch)):
                if held and size + len(text) > SLICE:
                    yield out(ids, keys, held)
                    ids, keys, held, size = [], [], [], 0
                ids.append(doc)
                keys.append(key)
                held.append(text)
                size += len(text)
        if held:
            yield out(ids, keys, held)

    def remove(table: pa.Table) -> pa.Table:
        kinds, blobs = table.column("kind").to_pylist(), table.column("blob")
        spans = [unpack(blobs[i].as_py()) for i, k in enumerate(kinds) if k]
        by: dict[tuple[int, int], tuple[int, int]] = {}
        if spans:
            doc, key, start, end = (np.concatenate(x) for x in zip(*spans))
            order = np.lexsort((start, key, doc))
            doc, key, start, end = doc[order], key[order], start[order].astype(np.int64), end[order].astype(np.int64)
            edge = np.flatnonzero(np.r_[True, (np.diff(doc) != 0) | (np.diff(key) != 0)])
            for a, b in zip(edge, np.r_[edge[1:], len(doc)]):
                by[int(doc[a]), int(key[a])] = (int(a), int(b))
        out = ([], [], [], [], [], [])
        for i, k in enumerate(kinds):
            if k:
                continue
            for d, c, text in zip(*unpack(blobs[i].as_py())):
                a, b = by.get((int(d), int(c)), (0, 0))
                runs = list(zip(*(x.tolist() for x in merged(start[a:b], end[a:b])))) if b else []
                digest, at = hashlib.sha256(), 0
                for s, e in runs:
                    digest.update(text[at:s])
                    at = e
                digest.update(text[at:])
                for column, value in zip(out, (None if d == NO_ID else int(d), len(text), sum(e - s for s, e in runs), len(runs),
                                               [{"start": s, "stop": e} for s, e in runs], digest.hexdigest())):
                    column.append(value)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), kind, pa.string()))],
                        names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256"])

    packed = "grp int, kind int, blob binary"
    found = slim.mapInArrow(deal, "bucket int, blob binary").groupBy("bucket").applyInArrow(search, packed)
    return (slim.mapInArrow(texts, packed).unionByName(found).groupBy("grp")
            .applyInArrow(remove, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, spans array<struct<start:int,stop:int>>, kept_sha256 string"))

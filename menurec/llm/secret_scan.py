"""Secret scan: fixed patterns plus a randomness test battery (operator 5).

Patterns (fixed values) give the base spans.  Beside them, every run of 20 or
more token characters ('=' only as padding at its end) is a candidate, and so is
every part of 20 or more characters between its separators.  Its encoding is
inferred (hex, upper-case base32, base64 and its URL form, lower-case
alphanumeric) and three tests ask whether it looks like uniform draws from that
alphabet:

* chi-squared: equal frequencies over equal bins of the alphabet;
* runs: the number of runs above / below the middle of the alphabet;
* serial correlation: lag-one correlation of the symbol ranks.

Fisher's rule joins the three p-values; a candidate that fails them at the level
``LEVEL`` is not random.  For the others the null hypothesis is non-random text:
letters as frequent as in English, in stretches of one case, digits or
separators.  By Markov's inequality the likelihood under that model over the
likelihood under uniform draws is a valid p-value for a string of any length, on
its own.  Benjamini-Hochberg over all candidates keeps the false-discovery share
within ``fdr``; a strong secret is reported however few candidates there are.

Defined cases: null and empty texts have no span and the digest of an empty
string; ties (equal starts) are ordered by kind; repeated rows repeat their
results; texts are read whole; extra columns are ignored.  Offsets count code
points, the end exclusive.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from menurec.llm.common import materialised, raw_texts

# The base patterns, by kind, in the order that breaks ties.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")

# Any long run; access and hex spans lie inside one.
LONG = re.compile(rb"[A-Za-z0-9+/_-]{20,}=*")
PART = re.compile("[A-Za-z0-9+]{20,}=*")
KEYWORDS = (b"passw", b"secret", b"token", b"api")

ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "234567ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "alnum": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "+-/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz",
}
RANKS = {name: {c: i for i, c in enumerate(letters)} for name, letters in ALPHABETS.items()}
BINS = 8
LEVEL = 0.01
MOST_BITS = 1000

# The model of non-random text (fixed values): letters per thousand, the share of each class of characters, the chance to stay in it.
LETTERS = dict(zip("abcdefghijklmnopqrstuvwxyz", (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)))
SHARES = {"lower": 0.6, "upper": 0.2, "digit": 0.15, "mark": 0.05}
STAY = 0.85


def _class_of(c: str) -> str:
    return "digit" if c.isdigit() else "mark" if not c.isalpha() else "lower" if c.islower() else "upper"


def _text_model(alphabet: str):
    """Class and log2 share in its class of every symbol, and the log2 share of every class."""
    weight = {c: LETTERS.get(c.lower(), 1) for c in alphabet}
    total: dict[str, float] = {}
    for c in alphabet:
        total[_class_of(c)] = total.get(_class_of(c), 0.0) + weight[c]
    whole = sum(SHARES[k] for k in total)
    return {c: (_class_of(c), math.log2(weight[c] / total[_class_of(c)])) for c in alphabet}, {k: math.log2(SHARES[k] / whole) for k in total}


MODELS = {name: _text_model(letters) for name, letters in ALPHABETS.items()}


def evidence(run: str, encoding: str) -> float:
    """-log2 of the p-value of a run against non-random text (0 at least).

    The model is an even mixture of single characters and of stretches of one class.
    """
    body = run.rstrip("=")
    symbols, classes = MODELS[encoding]
    single = stretch = 0.0
    last = None
    for c in body:
        kind, bits = symbols[c]
        single += bits + classes[kind]
        if last is None:
            stretch += bits + classes[kind]
        else:
            move = (STAY if kind == last else 0.0) + (1 - STAY) * 2 ** classes[kind]
            stretch += bits + math.log2(move)
        last = kind
    high, low = max(single, stretch), min(single, stretch)
    text = high - 1 + math.log2(1 + 2 ** max(low - high, -1000))
    return max(0.0, -text - len(body) * math.log2(len(ALPHABETS[encoding])))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind index, end) of the base matches, by start then kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out)


def infer_encoding(run: str) -> str | None:
    body = run.rstrip("=")
    letters = set(body)
    for name, alphabet in ALPHABETS.items():
        if letters <= set(alphabet):
            return name
    return None


def _chi2_tail(x: float, df: int) -> float:
    """Upper tail of chi-squared (Wilson-Hilferty for odd, exact series for even df)."""
    if x <= 0:
        return 1.0
    if df % 2 == 0:
        term = total = math.exp(-x / 2)
        for i in range(1, df // 2):
            term *= x / 2 / i
            total += term
        return min(1.0, total)
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(run: str, encoding: str) -> float:
    """Joint p-value of the three tests for "uniform over the alphabet"."""
    body = run.rstrip("=")
    size = len(ALPHABETS[encoding])
    ranks = np.array([RANKS[encoding][c] for c in body], float)
    n = len(ranks)
    # chi-squared over bins of (nearly) equal alphabet shares
    bins = np.floor(ranks * BINS / size).astype(int)
    shares = np.bincount(np.floor(np.arange(size) * BINS / size).astype(int), minlength=BINS) / size
    seen = np.bincount(bins, minlength=BINS)
    p_chi = _chi2_tail(float(((seen - n * shares) ** 2 / (n * shares)).sum()), BINS - 1)
    # runs above / below the middle
    high = ranks >= size / 2
    a, b = int(high.sum()), int(n - high.sum())
    if a and b:
        mean = 1 + 2 * a * b / n
        var = 2 * a * b * (2 * a * b - n) / (n * n * (n - 1))
        p_runs = _two_sided((1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(var)) if var > 0 else 0.0
    else:
        p_runs = 0.0
    # lag-one correlation
    dev = ranks - ranks.mean()
    total = float((dev * dev).sum())
    p_serial = _two_sided((float((dev[1:] * dev[:-1]).sum()) / total + 1 / n) * math.sqrt(n)) if total > 0 else 0.0
    floor = 1e-300
    fisher = -2 * sum(math.log(max(p, floor)) for p in (p_chi, p_runs, p_serial))
    return _chi2_tail(fisher, 6)


def candidates(run: str):
    """(start, end, bits) of a run and of its parts between separators; bits are 0 if the battery fails."""
    spans = {(0, len(run)), *(m.span() for m in PART.finditer(run))}
    for start, end in sorted(spans):
        part = run[start:end]
        encoding = infer_encoding(part)
        if encoding and len(part.rstrip("=")) >= 20:
            bits = evidence(part, encoding)
            if bits >= 1 and battery(part, encoding) < LEVEL:
                bits = 0.0
            yield start, end, min(MOST_BITS, int(bits))


def scan_text(raw: bytes):
    """(base spans, candidates) of one text; a candidate is (start, end, bits of evidence)."""
    low = raw.lower()
    runs = [m.span() for m in LONG.finditer(raw)]
    named = any(k in low for k in KEYWORDS)
    if not runs and not named:
        return [], []
    text = raw.decode("utf-8", "replace")
    base = base_spans(text)
    found = []
    ascii_only = len(text) == len(raw)
    at = chars = 0
    for start, end in runs:
        if not ascii_only:  # byte offset to code point offset, in one pass
            chars += len(raw[at:start].decode("utf-8", "replace"))
            at = start
        s = start if ascii_only else chars
        run = raw[start:end].decode()
        found += [(s + a, s + b, bits) for a, b, bits in candidates(run)]
    return base, found


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: ``keep``, ``base`` spans and ``candidates`` with their evidence."""
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep]
    base_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32())]))
    cand_type = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("bits", pa.int32())]))

    def run(batches):
        for batch in batches:
            got = [scan_text(t) for t in raw_texts(batch, "__text")]
            base = [[{"start": s, "kind": k, "stop": e} for s, k, e in b] for b, _ in got]
            cand = [[dict(zip(("start", "stop", "bits"), c)) for c in cs] for _, cs in got]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(base, base_type), pa.array(cand, cand_type)],
                                             names=[*keep, "base", "candidates"])

    schema = [*kept, "base array<struct<start:int,kind:int,stop:int>>",
              "candidates array<struct<start:int,stop:int,bits:int>>"]
    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, ", ".join(schema))


def threshold(scanned: DataFrame, fdr: float = 0.05) -> int:
    """The fewest bits of evidence to report (Benjamini-Hochberg within ``fdr``).

    Works on a histogram over all candidates: ``MOST_BITS + 1`` rows at most,
    however many candidates there are.  Bits are rounded down, p-values up.
    """
    rows = scanned.select(F.explode("candidates").alias("c")).groupBy("c.bits").agg(F.count("*").alias("n")).collect()
    total, above, cut = sum(r["n"] for r in rows), 0, MOST_BITS + 1
    for bits, n in sorted(((r["bits"], r["n"]) for r in rows), reverse=True):
        above += n
        if bits and 2.0 ** -bits <= fdr * above / total:
            cut = bits
    return cut


def secrets(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), fdr: float = 0.05) -> DataFrame:
    """``keep``, ``base`` and ``spans``: base spans plus accepted random runs, by
    start, then kind (array of start, kind index, stop)."""
    scanned = materialised(scan(docs, keep))
    cut = threshold(scanned, fdr)

    def as_span(c):
        return F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["stop"].alias("stop"))

    extra = F.transform(F.filter("candidates", lambda c: c["bits"] >= cut), as_span)
    return scanned.select(*keep, "base", F.array_sort(F.concat("base", extra)).alias("spans"))


def span_text(column: str):
    """kind:start:end of every span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(column, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))))


def redact(docs: DataFrame, mask: str = "[SECRET]", fdr: float = 0.05) -> DataFrame:
    """``docs`` with every secret span replaced by ``mask`` (overlapping spans as
    one); other columns stay, ``n_chars`` follows the text where it exists.  No
    document is dropped, and texts without a span are untouched.  The false-
    discovery thresholds come from a first pass; the second masks in place, so
    no text is shuffled."""
    cut = threshold(materialised(scan(docs.select("text"), ())), fdr)
    schema = docs.schema
    names = docs.columns

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            changed = {}
            for i, raw in enumerate(raw_texts(batch, "text")):
                base, found = scan_text(raw)
                spans = [(s, e) for s, _, e in base] + [(s, e) for s, e, bits in found if bits >= cut]
                if spans:
                    changed[i] = masked(texts[i], sorted(spans), mask)
            columns = [batch.column(c) for c in names]
            if changed:
                columns[names.index("text")] = pa.array([changed.get(i, t) for i, t in enumerate(texts)], batch.column("text").type)
                if "n_chars" in names:
                    was = batch.column("n_chars")
                    columns[names.index("n_chars")] = pa.array(
                        [len(changed[i]) if i in changed else n for i, n in enumerate(was.to_pylist())], was.type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, schema)


def masked(text: str, spans: list[tuple[int, int]], mask: str) -> str:
    """``text`` with the union of the sorted ``spans`` masked."""
    out, at, i = [], 0, 0
    while i < len(spans):
        start, end = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] <= end:
            i += 1
            end = max(end, spans[i][1])
        out += [text[at:start], mask]
        at, i = end, i + 1
    return "".join(out + [text[at:]])

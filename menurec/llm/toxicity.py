"""Toxicity by Levenshtein automata over a lexicon trie (operator 7).

``learn`` mines the lexicon from a bounded labelled sample: every word stem whose
documents are far more often toxic (a likelihood-ratio test), each extended
while its support stays.  The stems form a trie; ``Matcher`` runs all their
Levenshtein automata at once along it, determinised lazily: a state is a set
of (trie node, edits), and a word leaves it as soon as every pair is over
budget.  A word hits a stem if one of its prefixes is within the stem's edit
budget.  Letters that only a digit or sign or two parts (``st*pid``) are also read
together, so a sign in a letter's place is one edit.  Every hit is judged in a window of words around it: inside quotation
marks or beside a reporting phrase it counts as a quotation.  Evidence per
(stem, edits, quoted) is a smoothed log-odds from the sample; a document's
score is the logistic of its strongest evidence plus a share of the rest.

Defined cases: a null or empty text has no hit and gets the base score; very
long texts are read whole; repeated rows get equal scores; without labelled
rows of both classes the lexicon is empty and all get the base score; extra
columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from menurec.llm.common import label_rate, labelled_sample, materialised

LETTERS = re.compile(r"[^\W\d_]+")
RUN = re.compile(r"[^\W\d_]++(?:[\d@$*!|#%&+^~_-]{1,2}[^\W\d_]++)*+")   # words, and what stands for a letter inside
QUOTES = "\"“”«»„"
REPORTING = re.compile(r"\b(said|says|quoted?|called|calling|wrote|dijo|sagte|disait|a dit)\b")
SHORTEST, LONGEST = 4, 12
CACHE = 300_000
SAMPLE_PARTITIONS = 24


def edit_budget(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Matcher:
    """Union of the Levenshtein automata of all stems, walked along their trie."""

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[int] = [-1]
        self.budget: list[int] = [0]
        self.terms = terms
        for i, word in enumerate(terms):
            node, most = 0, edit_budget(word)
            self.budget[0] = max(self.budget[0], most)
            for c in word:
                nxt = self.children[node].get(c)
                if nxt is None:
                    nxt = len(self.children)
                    self.children[node][c] = nxt
                    self.children.append({})
                    self.term.append(-1)
                    self.budget.append(0)
                node = nxt
                self.budget[node] = max(self.budget[node], most)
            self.term[node] = i
        self.states: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.members: list[frozenset] = []
        self.accepts: list[tuple[tuple[int, int], ...]] = []
        self.start = self._state({0: 0})
        self.cache: dict[str, tuple[int, int] | None] = {}
        self.runs: dict[str, list] = {}

    def _state(self, nodes: dict[int, int]) -> int:
        """Close under skipped stem letters; -1 is the dead state."""
        todo, low = list(nodes.items()), {}
        while todo:
            node, edits = todo.pop()
            if edits > self.budget[node] or low.get(node, 99) <= edits:
                continue
            low[node] = edits
            todo.extend((child, edits + 1) for child in self.children[node].values())
        if not low:
            return -1
        key = frozenset(low.items())
        if key not in self.states:
            self.states[key] = len(self.moves)
            self.moves.append({})
            self.members.append(key)
            self.accepts.append(tuple((self.term[n], e) for n, e in low.items()
                                      if self.term[n] >= 0 and e <= edit_budget(self.terms[self.term[n]])))
        return self.states[key]

    def _move(self, state: int, c: str) -> int:
        nxt: dict[int, int] = {}

        def put(node, edits):
            if edits < nxt.get(node, 99):
                nxt[node] = edits

        for node, edits in self.members[state]:
            put(node, edits + 1)  # a letter too many
            for letter, child in self.children[node].items():
                put(child, edits + (letter != c))
        to = self._state(nxt)
        self.moves[state][c] = to
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        """(stem, edits) of the best stem: fewest edits, then the longest, then the first."""
        if word in self.cache:
            return self.cache[word]
        best, state = None, self.start
        for c in word:
            to = self.moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if state < 0:
                break
            for term, edits in self.accepts[state]:
                rank = (edits, -len(self.terms[term]), term)
                if best is None or rank < best:
                    best = rank
        if len(self.cache) >= CACHE:
            self.cache.clear()
        got = self.cache[word] = None if best is None else (best[2], best[0])
        return got


def is_quoted(text: str, start: int, end: int, window: int = 60) -> bool:
    """Quotation marks on both sides within the window, or a reporting phrase before."""
    before, after = text[max(0, start - window):start], text[end:end + window]
    if any(q in before for q in QUOTES) and any(q in after for q in QUOTES):
        return True
    return REPORTING.search(before) is not None


def run_hits(run: str, matcher: Matcher) -> list[tuple[int, int, int, int]]:
    """(stem, edits, start, end) in a run: of its words, and where a word alone has
    none, of the words from it on, joined by what stands between them until they hit."""
    parts, out, i = [m.span() for m in LETTERS.finditer(run)], [], 0
    while i < len(parts):
        start, j = parts[i][0], i
        got = matcher.match(run[start:parts[i][1]])
        while got is None and j + 1 < len(parts) and parts[j + 1][0] - start <= LONGEST + 2:
            j += 1
            if matcher.match(run[parts[j][0]:parts[j][1]]):
                break  # a word of its own
            got = matcher.match(run[start:parts[j][1]])
        if got:
            out.append((*got, start, parts[j][1]))
        i = j + 1 if got else i + 1
    if len(run) <= 2 * LONGEST:
        if len(matcher.runs) >= CACHE:
            matcher.runs.clear()
        matcher.runs[run] = out
    return out


def hits(text: str, matcher: Matcher) -> list[tuple[int, int, bool, int, int]]:
    """(stem, edits, quoted, start, end) of every hit, by position in the lower-cased text."""
    low = text.lower()
    seen = matcher.runs
    bad = {run: got for run in set(RUN.findall(low)) if (got := seen[run] if run in seen else run_hits(run, matcher))}
    if not bad:
        return []
    return [(term, edits, is_quoted(low, m.start() + start, m.start() + end), m.start() + start, m.start() + end)
            for m in RUN.finditer(low) for term, edits, start, end in bad.get(m[0], ())]


@dataclass
class Lexicon:
    terms: list[str] = field(default_factory=list)
    weights: dict[tuple[int, int, bool], float] = field(default_factory=dict)
    base: float = 0.0

    def score(self, found) -> float:
        evidence = sorted((self.weights.get((t, e, q), 0.0) for t, e, q, *_ in found), reverse=True)
        total = self.base + (evidence[0] + 0.25 * sum(evidence[1:4]) if evidence else 0.0)
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, total))))

    def to_json(self) -> str:
        return json.dumps({"terms": self.terms, "base": self.base,
                           "weights": [[*k, v] for k, v in sorted(self.weights.items())]})


def log_ratio(n_tox: int, n_clean: int) -> Column:
    """Signed likelihood-ratio statistic of a stem's document counts ``tox`` and ``clean``."""
    share = n_tox / (n_tox + n_clean)
    total, g = F.col("tox") + F.col("clean"), F.lit(0.0)
    for seen, part in ((F.col("tox"), share), (F.col("clean"), 1 - share)):
        g = g + F.when(seen > 0, seen * F.log(seen / (total * part))).otherwise(0.0)
    return F.when(F.col("tox") > total * share, 2 * g).otherwise(-2 * g)


def learn(documents: DataFrame, labels: DataFrame, allowed: Column, target: str = "toxic",
          per_class: int = 3000, strength: float = 25.0) -> Lexicon:
    """Fit the lexicon on at most ``per_class`` labelled documents of each class."""
    sample = materialised(labelled_sample(documents, labels, target, per_class, allowed))
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_clean, n_tox = sizes.get(0, 0), sizes.get(1, 0)
    rate = label_rate(labels, target, allowed)
    prior = math.log(rate / (1 - rate))
    if not n_clean or not n_tox:
        return Lexicon(base=prior)

    def stems(batches):
        counts: tuple[Counter, Counter] = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                words = set(LETTERS.findall((text or "").lower()))
                counts[label].update({w[:k] for w in words for k in range(SHORTEST, min(len(w), LONGEST) + 1)})
        names = list(counts[0].keys() | counts[1].keys())
        for at in range(0, len(names), 50_000):
            part = names[at:at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([counts[1][w] for w in part], pa.int64()),
                                              pa.array([counts[0][w] for w in part], pa.int64())], names=["stem", "tox", "clean"])

    counted = (sample.repartition(SAMPLE_PARTITIONS, "doc_id").mapInArrow(stems, "stem string, tox bigint, clean bigint")
               .groupBy("stem").agg(F.sum("tox").alias("tox"), F.sum("clean").alias("clean")))
    # rates apart by ten or more, and surely so
    apart = counted.filter((F.col("tox") >= 3) & (F.col("tox") * n_clean >= 10 * F.col("clean") * n_tox)
                           & (log_ratio(n_tox, n_clean) >= strength))
    good = {r["stem"]: r["tox"] for r in apart.select("stem", "tox").collect()}
    longer: dict[str, list[str]] = {}
    for w in sorted(good):
        longer.setdefault(w[:-1], []).append(w)
    terms = set()
    for stem in good:
        if any(stem[:k] in good for k in range(SHORTEST, len(stem))):
            continue  # a shorter stem covers it
        low = good[stem]
        while kept := [w for w in longer.get(stem, ()) if good[w] >= 0.95 * low]:
            stem = kept[0]  # the longest stem with the same support
        terms.add(stem)
    ranked = sorted(terms, key=lambda w: (-good[w], w))

    def found(batches):
        matcher = Matcher(ranked)
        seen: Counter = Counter()
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                keys = {h[:3] for h in hits(text or "", matcher)}
                seen.update((*k, label) for k in keys or {(-1, 0, False)})
        keys = list(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.bool_()),
             pa.array([k[3] for k in keys], pa.int32()), pa.array([seen[k] for k in keys], pa.int64())], names=["term", "edits", "quoted", "label", "n"])

    table = Counter()
    for r in (sample.mapInArrow(found, "term int, edits int, quoted boolean, label int, n bigint")
              .groupBy("term", "edits", "quoted", "label").agg(F.sum("n").alias("n")).collect()):
        table[(r["term"], r["edits"], r["quoted"]), r["label"]] = r["n"]

    def odds(key, doubt=0.5):
        return math.log((table[key, 1] + 0.5) / (n_tox + 1)) - math.log((table[key, 0] + doubt) / (n_clean + 1))

    weights = {}
    for i, word in enumerate(ranked):
        for edits in range(edit_budget(word) + 1):
            plain = max(0.0, odds((i, edits, False)))
            if edits and not table[(i, edits, False), 1] + table[(i, edits, False), 0]:
                plain = max(0.0, weights[(i, edits - 1, False)] - 1.0)  # unseen misspelling: as its neighbour, a little less
            seen = table[(i, edits, True), 1] + table[(i, edits, True), 0]
            weights[(i, edits, False)] = plain
            weights[(i, edits, True)] = max(0.0, odds((i, edits, True))) if seen >= 5 else max(0.0, plain - 3.0)
    return Lexicon(ranked, weights, prior + odds((-1, 0, False)) if ranked else prior)


def score(docs: DataFrame, lexicon: Lexicon, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus score double, n_hits int and spans (start, end in
    the lower-cased text, stem, edits, quoted) of every whole text."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    kind = "array<struct<start:int,stop:int,stem:string,edits:int,quoted:boolean>>"
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("stem", pa.string()), ("edits", pa.int32()), ("quoted", pa.bool_())]))

    def run(batches):
        matcher = Matcher(lexicon.terms)
        for batch in batches:
            found = [hits(t or "", matcher) for t in batch.column("__text").to_pylist()]
            spans = [[{"start": s, "stop": e, "stem": lexicon.terms[t], "edits": d, "quoted": q} for t, d, q, s, e in f] for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array([lexicon.score(f) for f in found], pa.float64()),
                                                   pa.array([len(f) for f in found], pa.int32()), pa.array(spans, arrow)],
                names=[*keep, "score", "n_hits", "spans"])

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, f"{schema}, score double, n_hits int, spans {kind}")


def drop_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows scored ``threshold`` or more; a narrow filter, all columns kept."""
    names = docs.columns

    def run(batches):
        matcher = Matcher(lexicon.terms)
        for batch in batches:
            clean = pa.array([lexicon.score(hits(t or "", matcher)) < threshold for t in batch.column("text").to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(n).filter(clean) for n in names], names=names)

    return docs.mapInArrow(run, docs.schema)

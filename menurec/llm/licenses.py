"""License scan with DataFrame functions only (operator 10).

Texts are compared with licence templates by the cosine of sparse TF-IDF
vectors; document frequencies come from all texts, and a word that no template
holds weighs as if unseen.  Three parts of a text are compared:

* every line with the notices;
* windows of words with the notices and headers.  Line breaks, comment marks
  and other signs are no words, so a header is found over several lines, and a
  notice among the other words of its line.  A window lies where a strong word
  of the template would put it, once at the template's length and twice half as
  long again (words in between);
* the whole document with all templates, whole licence texts included.

Parts that share none of a template's strong words cannot reach the threshold
(Cauchy-Schwarz on the rest), nor can lines whose other words hold too much of
the norm, so tests on those words pick what to explode.

A document with a matching part declares that licence; a whole licence text
goes before its parts.  One that as a whole matches a template is a licence
file and speaks for its directory; documents without a declaration inherit from
the nearest ancestor directory that has a licence file (a join of distinct
directories' ancestors).

Defined cases: null or empty texts declare nothing; ties in cosine go to lines
before windows, then to the first place, then to the template listed first,
licence files of one directory to the highest score,
then the name; a null path lies in the root directory; repeated rows are
repeated in the result; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from menurec.llm.common import materialised, row_key
from menurec.llm.license_texts import TEXTS as TEXTS_ON_FILE

# Usual notices of public licences.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
)
_GNU = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by "
        "the Free Software Foundation, either version {} of the License, or (at your option) any later version.")
_GNU_ONLY = ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by "
             "the Free Software Foundation; version {} of the License.")
_GNU_KINDS = (("GPL-3.0", "General", "3"), ("GPL-2.0", "General", "2"), ("LGPL-3.0", "Lesser General", "3"),
              ("LGPL-2.1", "Lesser General", "2.1"), ("AGPL-3.0", "Affero General", "3"))
_TAGS = tuple((name, name) for name in ("Apache-2.0", "MIT", "BSD-3-Clause", "MPL-2.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0"))
_TAGS += tuple((name, name + end) for name, *_ in _GNU_KINDS for end in ("", "-only", "-or-later", "+"))
# Headers of source files and titles.
HEADERS = (
    *((name, text.format(kind, version)) for text in (_GNU, _GNU_ONLY) for name, kind, version in _GNU_KINDS),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
     "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
     "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
     "See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
     "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
     "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
     "You can obtain one at https://mozilla.org/MPL/2.0/."),
    *((name, f"SPDX-License-Identifier: {tag}") for name, tag in _TAGS),
)
# The Affero text is the GPL's but for its name and section 13.
_AFFERO = """Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users
interacting with it remotely through a computer network (if your version supports such interaction) an opportunity to receive the Corresponding
Source of your version by providing access to the Corresponding Source from a network server at no charge, through some standard or customary
means of facilitating copying of software."""
TEXTS = (*TEXTS_ON_FILE, *(("AGPL-3.0", re.sub(r"(?i)GNU General", "GNU Affero General", t) + _AFFERO) for name, t in TEXTS_ON_FILE if name == "GPL-3.0"))
BREAKS = r"[^a-z0-9.-]+"
THRESHOLD = 0.75


def notice_words(text: str) -> list[str]:
    return [w for w in (x.strip(".-") for x in re.split(BREAKS, text.lower())) if w]


def words_of(text: Column) -> Column:
    """Words of letters, digits, inner dots and dashes, lower-cased."""
    return F.filter(F.transform(F.split(F.lower(text), BREAKS), lambda w: F.btrim(w, F.lit(".-"))), lambda w: w != "")


TAG_START = "spdx-license-identifier:"
TAG = TAG_START + r"[ \t]*"


def header_words(text: str) -> list[str]:
    """The words of a template; an SPDX tag and its licence are one word."""
    return notice_words(re.sub(TAG, "spdx-license-identifier-", text.lower()).replace("+", "-plus "))


def header_words_of(text: Column) -> Column:
    """The same words of a column, by one split."""
    return F.filter(_pieces(text), lambda w: w != "")


def _pieces(text: Column) -> Column:
    low = F.lower(text)
    # few texts hold a tag, and finding its fixed part is quicker than the expression
    low = F.when(F.contains(low, F.lit(TAG_START)), F.regexp_replace(low, TAG, "spdx-license-identifier-")).otherwise(low)
    low = F.btrim(F.replace(low, F.lit("+"), F.lit("-plus ")), F.lit(".-"))
    return F.split(low, "[.-]*[^a-z0-9.-][^a-z0-9]*")


def listed(words) -> str:
    """Words (letters, digits, dots and dashes) as an SQL list; a Column for each takes seconds to build.  Spark
    makes a set of such a list once, not for every row."""
    return ", ".join(f"'{w}'" for w in sorted(words)) or "NULL"


def among(words: str, vocabulary) -> str:
    """SQL: the elements of an array that are in ``vocabulary``, repeats included."""
    return f"filter({words}, w -> w IN ({listed(vocabulary)}))"


def known_words(low: Column, vocabulary: list[str]) -> Column:
    """Words of a lower-cased text that are in ``vocabulary``, repeats included.

    The same words as :func:`words_of` finds, without an array of all others.
    """
    either = "|".join(re.escape(w) for w in vocabulary)
    return F.regexp_extract_all(low, F.lit(rf"(?<![a-z0-9.-])[.-]*({either})[.-]*(?![a-z0-9.-])"), F.lit(1))


def document_frequencies(docs: DataFrame, vocabulary: list[str], words=lambda text: words_of(text)) -> tuple[int, dict[str, int]]:
    """Documents, and documents that hold each word; at most the vocabulary comes back."""
    held = F.array_distinct(F.expr(among("held", vocabulary)))
    rows = (docs.select(words(F.coalesce("text", F.lit(""))).alias("held")).select(F.explode(F.array_append(held, F.lit(""))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect())
    got = {r["w"]: r["n"] for r in rows}
    return got.pop("", 0), got


def notice_vectors(notices, n: int, df: dict[str, int], words=notice_words):
    """Unit vector of every notice and the idf of every word."""
    idf = lambda w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1.0
    out = []
    for name, text in notices:
        raw = {w: c * idf(w) for w, c in Counter(words(text)).items()}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        out.append((name, {w: v / norm for w, v in raw.items()}))
    return out, idf


def strong_words(vectors, threshold: float, common=lambda w: 0.0) -> list[str]:
    """Words of which any line with a cosine of ``threshold`` shares at least one.

    Per notice the words most ``common`` and the shortest, which are parts of many others, are set aside
    while their norm is below the threshold; a line that shares only those has
    a cosine below it.
    """
    out = set()
    for _, vector in vectors:
        rest = 0.0
        for word, weight in sorted(vector.items(), key=lambda x: (-common(x[0]), len(x[0]), x[0])):
            if math.sqrt(rest + weight * weight) < threshold - 1e-9:
                rest += weight * weight
            else:
                out.add(word)
    return sorted(out)


def can_reach(text: Column, vocabulary: list[str], idf, unseen: float, threshold: float) -> Column:
    """Whether the share of the vocabulary in a line's squared norm allows the cosine.

    A notice is a unit vector over the vocabulary, so no cosine exceeds the norm
    of the line's known words divided by that of all its words.  Unknown words
    add at least their count times the squared weight of an unseen word.
    """
    weight = F.create_map(*[F.lit(x) for w in vocabulary for x in (w, idf(w))])
    low = F.lower(text)
    total = F.regexp_count(low, F.lit("[a-z0-9.-]*[a-z0-9][a-z0-9.-]*"))

    def square(known: Column, w: Column) -> Column:
        return F.pow(F.size(F.filter(known, lambda k: k == w)) * F.element_at(weight, w), F.lit(2.0))

    def enough(known: Column) -> Column:
        held = F.aggregate(F.array_distinct(known), F.lit(0.0), lambda acc, w: acc + square(known, w))
        others = (total - F.size(known)) * F.lit(unseen * unseen)
        return held * (1 + 1e-9) >= (held + others) * (threshold * threshold)

    return F.element_at(F.transform(F.array(known_words(low, vocabulary)), enough), 1)


def covers(vectors, n: int, df: dict[str, int], threshold: float):
    """SQL: whether an array ``held`` of distinct words holds enough of a long template for the threshold; and the words it looks for.

    By Cauchy-Schwarz the template's words that a text holds make up at least the
    squared threshold of the template's squared norm.  Of any part of the template
    (here its words in few documents, but at least 0.6 of that norm) a text
    therefore lacks a bounded share, which no fewer than ``least`` words leave.
    """
    needs = []
    for _, vector in vectors:
        part, share = [], 0.0
        for word in sorted(vector, key=lambda w: (df.get(w, 0), w)):
            if share >= 0.6 and df.get(word, 0) > 0.05 * n:
                break
            part.append(word)
            share += vector[word] ** 2
        need, least = share - (1 - threshold * threshold) - 1e-9, 0
        for word in sorted(part, key=lambda w: -vector[w]):
            if need <= 0:
                break
            need -= vector[word] ** 2
            least += 1
        needs.append((sorted(part), least))
    union = sorted({w for part, _ in needs for w in part})
    return " OR ".join(["false", *(f"size({among('held', part)}) >= {least}" for part, least in needs)]), union


def commonness(n: int, df: dict[str, int]):
    """Share of documents in which a word counts as held, in twentieths; words of up to three letters in all."""
    return lambda w: 20 if len(w) < 4 else 20 * df.get(w, 0) // (n + 1)


def holds(words: list[str]):
    """Whether a text holds one of the words, as a function of a column."""
    # a tag is one word here, but not in the text; a word that holds another one needs no test of its own
    starts = {w.split("identifier-")[0] for w in words}
    words = sorted(w for w in starts if not any(v != w and v in w for v in starts))

    def holds_one(low: Column) -> Column:
        return F.exists(F.lit(words), lambda w: F.contains(low, w))

    # the lambda binds the lower-cased text, so that it is made once and not for every word
    return lambda text: F.element_at(F.transform(F.array(F.lower(text)), holds_one), 1)


def squared_counts(words: Column) -> Column:
    """Sum of the squared number of times that each word comes, from the runs of the sorted words."""
    start = F.struct(F.lit("").alias("word"), F.lit(0).cast("bigint").alias("run"), F.lit(0.0).alias("sum"))

    def add(acc: Column, w: Column) -> Column:
        run = F.when(acc["word"] == w, acc["run"] + 1).otherwise(F.lit(1).cast("bigint"))
        return F.struct(w.alias("word"), run.alias("run"), (acc["sum"] + 2 * run - 1).alias("sum"))

    return F.aggregate(F.sort_array(words), start, add, lambda acc: acc["sum"])


def cosines(parts: DataFrame, keys: list[str], vectors, idf, vocabulary: list[str], threshold: float) -> DataFrame:
    """keys, notice, license, score of every part (an array ``words``) and template within the threshold.

    Parts with the same keys have the same words; together they hold each as many times more.
    """
    spark = parts.sparkSession
    table = F.broadcast(spark.createDataFrame(  # one row per template word
        [(w, i, name, v) for i, (name, vec) in enumerate(vectors) for w, v in vec.items()], "word string, notice int, license string, weight double"))
    weights = F.broadcast(spark.createDataFrame([(w, idf(w)) for w in vocabulary], "word string, idf double"))
    # words that no template holds all weigh the same and only add to the norm, so they are counted in place; '' counts the parts
    others = squared_counts(F.expr(f"filter(words, w -> w NOT IN ({listed(vocabulary)}))"))
    known = F.array_append(F.expr(among("words", vocabulary)), F.lit(""))
    # counted before the explode; beside it, Spark would count once a word
    tf = (parts.select(*keys, others.alias("others"), known.alias("known")).select(*keys, "others", F.explode("known").alias("word"))
          .groupBy(*keys, "word").agg(F.count("*").alias("tf"), F.max("others").alias("others")))
    weighed = tf.join(weights, "word", "left").withColumn("value", F.col("tf") * F.col("idf"))
    square = F.when(F.col("word") == "", F.col("tf") * F.col("tf") * F.col("others") * F.lit(idf("\0") ** 2)).otherwise(F.col("value") * F.col("value"))
    norms = weighed.groupBy(*keys).agg(F.sqrt(F.sum(square)).alias("norm"),
                                       F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("word", "value"))).alias("parts"))
    dots = (norms.select(*keys, "norm", F.explode("parts").alias("p")).join(table, F.col("p.word") == table["word"])
            .groupBy(*keys, "norm", "notice", "license")
            .agg((F.sum(F.col("p.value") * F.col("weight")) / F.col("norm")).alias("score")))
    # rounded, so that the order of a sum cannot break ties
    return dots.filter(F.col("score") >= threshold).select(*keys, "notice", "license", F.round("score", 9).alias("score"))


def first_best(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, license, score of the nearest template, the first of several."""
    best = F.max(F.struct("score", (-F.col("notice")).alias("first"), "license")).alias("b")
    return found.groupBy(*keys).agg(best).select(*keys, F.col("b.license").alias("license"), F.col("b.score").alias("score"))


def declared(docs: DataFrame, keys: list[str], notices=NOTICES, threshold: float = THRESHOLD, counts=None) -> DataFrame:
    """keys, line, license, score for every line that matches a notice."""
    vocabulary = sorted({w for _, text in notices for w in notice_words(text)})
    n, df = counts or document_frequencies(docs, vocabulary)
    vectors, idf = notice_vectors(notices, n, df)
    near = holds(strong_words(vectors, threshold))
    lines = (docs.select(*keys, "text").filter(near(F.col("text")))
             .select(*keys, F.posexplode(F.split("text", "\n")).alias("line", "part")).filter(near(F.col("part")))
             .filter(can_reach(F.col("part"), vocabulary, idf, idf("\0"), threshold))
             .dropDuplicates([*keys, "line"])
             .select(*keys, "line", words_of(F.col("part")).alias("words")))
    return first_best(cosines(lines, [*keys, "line"], vectors, idf, vocabulary, threshold), [*keys, "line"])


def windows(docs: DataFrame, keys: list[str], templates, counts, threshold: float = THRESHOLD) -> DataFrame:
    """keys, line (the place of its first word), license, score for every window of words that matches a template."""
    vocabulary = sorted({w for _, text in templates for w in header_words(text)})
    vectors, idf = notice_vectors(templates, *counts, header_words)
    strong = set(strong_words(vectors, threshold, commonness(*counts)))
    near = holds(sorted(strong))
    places = set()  # (word, words before it, words in the window)
    for _, text in templates:
        words = header_words(text)
        size, more = len(words), len(words) // 2
        for at, word in enumerate(words):
            if word in strong:
                places |= {(word, at, size), (word, at, size + more), (word, at + more, size + more)}
    reach = max(size for _, _, size in places)
    anchors = F.broadcast(docs.sparkSession.createDataFrame(sorted(places), "word string, before int, size int"))
    texts = docs.filter(near(F.col("text"))).select(*keys, header_words_of(F.col("text")).alias("words"))
    # every strong word with the words around it, so that a window needs no second look at its text
    hits = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda h: h["word"].isin(sorted(strong)))
    around = F.transform(hits, lambda h: F.struct(h["word"].alias("word"), h["at"].alias("at"), F.greatest(h["at"] - reach, F.lit(0)).alias("low"),
                                                  F.slice("words", F.greatest(h["at"] - reach, F.lit(0)) + 1, F.lit(2 * reach + 1)).alias("near")))
    cut = (texts.select(*keys, F.explode(around).alias("h")).join(anchors, F.col("h.word") == anchors["word"])
           .withColumn("line", F.greatest(F.col("h.at") - F.col("before"), F.lit(0)))
           .select(*keys, "line", "size", F.slice("h.near", F.col("line") - F.col("h.low") + 1, F.col("size")).alias("words")))
    found = cosines(cut.dropDuplicates([*keys, "line", "size"]), [*keys, "line", "size"], vectors, idf, vocabulary, threshold)
    return first_best(found, [*keys, "line"])


def can_match(docs: DataFrame, short, texts, counts, threshold: float = THRESHOLD, lines=()) -> DataFrame:
    """The documents that can match a template as a whole or by a window, or ``lines`` by a line.

    One look at a document's words decides.  A line's words are among them,
    but where a plus or a tag was joined to them; such texts are searched.
    """
    few, many = notice_vectors(short, *counts, header_words)[0], notice_vectors(texts, *counts, header_words)[0]
    enough, parts = covers(many, *counts, threshold)
    by_line = strong_words(notice_vectors(lines, *counts)[0], threshold)
    strong = {*strong_words(few, threshold, commonness(*counts)), *by_line}
    # the lambda binds the words held, so that they are found once and not for every test
    test = F.expr(f"element_at(transform(array(array_distinct({among('__words', {*strong, *parts})})), "
                  f"held -> exists(held, w -> w IN ({listed(strong)})) OR {enough}), 1)")
    if by_line:
        joined = F.contains("text", F.lit("+")) | F.contains(F.lower("text"), F.lit(TAG_START))
        test = test | (joined & holds(by_line)(F.col("text")))
    return docs.withColumn("__words", _pieces(F.col("text"))).filter(test).drop("__words")


def whole(docs: DataFrame, keys: list[str], short, texts, counts, threshold: float = THRESHOLD) -> DataFrame:
    """keys, notice, license, score for every document that as a whole matches a template.

    Rows with the same keys have the same text, which leaves the cosine as it is.
    """
    vocabulary = sorted({w for _, text in (*short, *texts) for w in header_words(text)})
    vectors, idf = notice_vectors((*short, *texts), *counts, header_words)
    parts = can_match(docs, short, texts, counts, threshold).select(*keys, header_words_of(F.col("text")).alias("words"))
    return cosines(parts, keys, vectors, idf, vocabulary, threshold)


def folder(path: Column) -> Column:
    """Directory of a path without slashes at its ends; '' is the root."""
    clean = F.btrim(F.coalesce(path, F.lit("")), F.lit("/"))
    return F.when(clean.contains("/"), F.regexp_replace(clean, "/+[^/]*$", "")).otherwise("")


def ancestors(folders: Column) -> Column:
    """The directory itself and all above it, the root ('') included."""
    parts = F.filter(F.split(folders, "/+"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def scan(docs: DataFrame, path: Column, id_col: str = "doc_id", notices=NOTICES, threshold: float = THRESHOLD,
         headers=HEADERS, texts=TEXTS) -> DataFrame:
    """One row per row of ``docs``: id, path, license (declared), score, is_file,
    inherited (of the nearest ancestor directory) and effective."""
    base = docs.select(F.col(id_col).alias("id"), path.alias("path"), "text").withColumn("__row", row_key("id", "path", "text"))
    keyed, keys, short = base.select("__row", "text"), ["__row"], (*notices, *headers)
    vocabulary = {w for _, text in (*short, *texts) for w in header_words(text)} | {w for _, text in notices for w in notice_words(text)}
    counts = document_frequencies(keyed, sorted(vocabulary), header_words_of)
    # one pass over the texts for the few that can match any template
    keyed = materialised(can_match(keyed.filter(F.col("text").isNotNull()), short, texts, counts, threshold, notices))
    full = materialised(whole(keyed, keys, short, texts, counts, threshold))
    files = full.groupBy("__row").agg(F.lit(True).alias("is_file"))
    # a licence text goes before the lines and windows inside it
    as_text = first_best(full.filter(F.col("notice") >= len(short)), keys)
    rank = lambda frame, n: frame.select("__row", F.lit(n).alias("rank"), "line", "license", "score")
    hits = (rank(as_text.withColumn("line", F.lit(0)), 2).unionByName(rank(declared(keyed, keys, notices, threshold, counts), 1))
            .unionByName(rank(windows(keyed, keys, short, counts, threshold), 0)))
    top = F.max(F.struct((F.col("rank") == 2).alias("text"), "score", "rank", (-F.col("line")).alias("first"), "license")).alias("b")
    per_row = hits.groupBy("__row").agg(top).join(files, "__row", "full")
    slim = base.select("id", "path", "__row", folder(F.col("path")).alias("dir"))
    named = materialised(slim.join(per_row, "__row", "left")
                         .select("id", "path", "dir", F.col("b.license").alias("license"), F.col("b.score").alias("score"),
                                 F.coalesce("is_file", F.lit(False)).alias("is_file")))
    speaks = (named.filter("is_file AND license IS NOT NULL").groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("l"))
              .select(F.col("dir").alias("above"), F.col("l.license").alias("inherited")))
    chain = (named.groupBy("dir").agg(F.lit(1).alias("one")).select("dir", F.posexplode(ancestors(F.col("dir"))).alias("depth", "above")))
    nearest = materialised(chain.join(speaks, "above").groupBy("dir").agg(F.max(F.struct("depth", "inherited")).alias("n"))
                           .select("dir", F.col("n.inherited").alias("inherited")))
    return (named.join(nearest, "dir", "left")
            .select(F.col("id").alias(id_col), "path", "license", "score", "is_file", "inherited", F.coalesce("license", "inherited").alias("effective")))

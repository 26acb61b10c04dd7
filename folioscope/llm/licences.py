"""Licence scans, with DataFrame and SQL functions and Spark's own logistic regression.

Paragraphs, and the lines, sentences and windows in them that may hold a notice, are classified by multinomial logistic regression
over hashed word uni- and bigrams, trained on variations of short notices of each family and of
sentences that mention licences without granting one (class ``unknown``), alone and inside other words.
The probability that a family needs is calibrated on sentences that took no part in the fit: all but one
in a hundred of their variations stay below it. A prediction counts once a template confirms it: the
piece holds most word bigrams of a notice of the predicted family. Templates of other families are not asked.
"""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNKNOWN = "unknown"
FEATURES = 4096
#: Least share of a notice's bigrams in the paragraph.
CONFIRM = 0.6
#: Words of the overlapping windows that are compared with the notices; neighbours share half.
WINDOWS = (20, 40, 80)
#: Variations of each text, and words in a hundred that a variation leaves out. Every second one has other words around it.
VARIATIONS, LEFT_OUT = 16, 8

# fixed values: what licence notices say
NOTICES = {
    "agpl": ["Licensed under the GNU Affero General Public License, version 3.",
             "This program is free software under the terms of the GNU Affero General Public License version 3 or later."],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License."],
    "bsd": ["Released under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."],
    "epl": ["Licensed under the Eclipse Public License, version 2.0.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License."],
    "cc0": ["To the extent possible under law, the author has waived all copyright under CC0 1.0 Universal.", "Dedicated to the public domain under CC0 1.0."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 2.",
            "This program is free software: you can redistribute it under the terms of the GNU General Public License as published by the Free Software Foundation."],
    "isc": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1.",
             "This library is free software under the terms of the GNU Lesser General Public License version 3."],
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."],
    "mpl": ["Licensed under the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "proprietary": ["Copyright, all rights reserved.", "No part of this publication may be reproduced without the prior written permission of the publisher."],
    "unlicense": ["Released under the Unlicense.", "This is free and unencumbered software released into the public domain."],
    "zlib": ["Released under the zlib License.", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."],
}
# sentences that grant nothing
OTHER = [
    "The driver lost his licence after the accident.", "A fishing license costs ten crowns a year.", "She applied for a licence to sell wine in the market.",
    "The court asked who owns the copyright of the song.", "Copyright law differs from one country to the next.", "He needed permission from the mayor to leave the town.",
    "The warranty of the machine ends after two years.", "Poetic license lets the author bend the facts.", "The city licensed forty new taxis last spring.",
    "They redistribute the water among the fields.", "With the permission of the king they sailed north.", "The public domain contains many old tales.",
    "Which license should I choose for my project?", "The licensing office opens at nine in the morning.", "Our team compared several licenses and found none that fits.",
    "A pilot's licence must be renewed every year.", "The film was licensed to a foreign station for a season.", "All rights come with duties, said the teacher.",
    "The agreement grants permission to cross the field.", "No license is required to keep bees here.", "A software license may be sold on in some countries.",
    "The committee will license the trade again next year.", "He was granted permission to speak under the terms of the treaty.", "This program of the public library is free for children.",
    "Copyright notices belong on the first page of a book.", "The terms of the lease are set out in version 2 of the document.", "You may not use this door without permission.",
    "Software that ships without a license worries our lawyers.", "The general public asked for a license to fish in the lake.", "The source of the river is in the public domain of the state.",
    "The work of the creative team was licensed last year.", "Please read the license before you install the program.", "The warranty is void where the seal is broken.",
    "Without permission nobody enters the tower.", "The author licensed the painting to a museum.", "Free software is discussed in the next chapter.",
]
# what may stand around either
AROUND = [
    "The meeting was moved to the second week of May because of the weather.", "See the next section for details and examples of the command line.",
    "Contact the team with questions about the build.", "Many of the towns along the coast were founded in that century.",
    "This file holds the functions that read and write tables.", "It took three days to cross the mountains on foot.",
    "The results are listed in the table below with their errors.", "Version 3 of the library adds new options for the user.",
]
_CUE = r"(?i)licen[sc]|copyright|permission|warrant|redistribut|public\W+domain|\bcc\W*(?:by|0)\b|rights\W+reserved|free\W+software|\b(?:bsd|gpl|apache|mozilla)\b"

#: A word that every such mention has.
_CUE_WORD = r"licen[sc]|copyright|permission|warrant|redistribut|^(?:cc|ccby.*|cc0.*|domain.*|reserved.*|software.*|bsd|gpl|apache|mozilla)$"
#: What stands between paragraphs: the end of a line, and lines without a letter or digit.
_BREAK = r"\r?\n(?:[^\p{L}\p{N}\r\n]*+\r?\n)++"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def bigrams(w: Column) -> Column:
    return F.when(F.size(w) < 2, w).otherwise(F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i))))


def grams(w: Column) -> Column:
    return F.concat(w, F.when(F.size(w) < 2, F.array().cast("array<string>")).otherwise(bigrams(w)))


def labelled_table(spark: SparkSession) -> DataFrame:
    """``family, words, held``: variations of the notices and of the other sentences, of fixed size.

    A sentence of the class ``unknown`` is held back with all its variations or with none.
    """
    rows = [(f, t) for f, texts in NOTICES.items() for t in texts] + [(UNKNOWN, t) for t in (*OTHER, *AROUND)]
    table = spark.createDataFrame(rows, "family string, text string").withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(VARIATIONS - 1))))
    thinned = F.filter(F.col("w"), lambda x: (F.col("v") == 0) | (F.pmod(F.xxhash64(x, F.col("v"), F.col("text")), F.lit(100)) >= LEFT_OUT))
    around = lambda side: words(F.element_at(
        F.array(*map(F.lit, AROUND)), (F.pmod(F.xxhash64("v", "text", F.lit(side)), F.lit(len(AROUND))) + 1).cast("int")))
    table = table.withColumn("w", words(F.col("text"))).withColumn("w", thinned)
    inside = F.when(F.col("v") % 2 == 1, F.concat(around("before"), F.col("w"), around("after"))).otherwise(F.col("w"))
    held = (F.col("family") == UNKNOWN) & (F.pmod(F.xxhash64("text"), F.lit(4)) == 0)
    return table.select("family", inside.alias("words"), held.alias("held"))


def _features(df: DataFrame, gram_column: str = "grams") -> DataFrame:
    return HashingTF(numFeatures=FEATURES, inputCol=gram_column, outputCol="features", binary=True).transform(df)


def fit(labelled: DataFrame) -> tuple[LogisticRegressionModel, list[str], float]:
    """Model, its classes, and the calibrated probability that a family needs.

    Fitted without the rows that are held back; those calibrate.
    """
    names = sorted([*NOTICES, UNKNOWN])
    number = F.array_position(F.array(*map(F.lit, names)), F.col("family")) - 1
    table = _features(labelled.withColumn("grams", grams(F.col("words"))).withColumn("label", number.cast("double")))
    model = LogisticRegression(maxIter=60, regParam=0.002, family="multinomial").fit(table.where(~F.col("held")))
    unknown = names.index(UNKNOWN)
    best = F.array_max(F.transform(vector_to_array("probability"), lambda p, i: F.when(i == unknown, 0.0).otherwise(p)))
    level = model.transform(table.where("held")).agg(F.percentile(best, 0.99)).first()[0]
    return model, names, max(0.5, level or 0.0)


def _ranges(text: Column, by: str) -> Column:
    """Places ``(a, b)`` of the words of each piece of a text that is split by an expression."""
    marked = F.regexp_replace(F.translate(text, "\x01", " "), by, " \x01 ")
    tokens = F.filter(F.split(F.lower(marked), r"[^\p{L}\p{N}\x01]+"), lambda x: x != "")
    ends = F.filter(F.transform(F.concat(tokens, F.array(F.lit("\x01"))), lambda x, i: F.when(x == "\x01", i)), lambda i: i.isNotNull())
    ends = F.transform(ends, lambda i, k: i - k)  # marks are no words
    return F.filter(F.zip_with(F.concat(F.array(F.lit(0)), ends), ends, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda r: r["a"] < r["b"])


def _windows(cues: Column, size: int, n: Column) -> Column:
    """Places ``(a, b)`` of the windows that hold one of some places; each starts half a window after another."""
    half = size // 2
    first = F.array_distinct(F.transform(cues, lambda i: F.floor(i / half).cast("int") * half))
    starts = F.array_distinct(F.concat(first, F.transform(first, lambda a: F.greatest(a - half, F.lit(0)))))
    return F.transform(starts, lambda a: F.struct(a.alias("a"), F.least(a + size, n).alias("b")))


def _notice_table() -> list[tuple[str, str]]:
    return [(f, t) for f, texts in NOTICES.items() for t in texts]


def _notice_pairs() -> list[list[str]]:
    """Word bigrams of every notice, as :func:`bigrams` gives them."""
    told = lambda text: [w for w in re.split(r"[\W_]+", text.lower()) if w]
    return [sorted({f"{x} {y}" for x, y in zip(w, w[1:])}) for w in (told(t) for _, t in _notice_table())]


#: Words of the notices that any prose has.
_COMMON = "a all and any are as be by except for free from have has in is it may no not of or part that the this to under use will with without work you".split()


def _anchors() -> str:
    """Expression that finds a word in every lower-case text that may hold the share ``CONFIRM`` of a notice's bigrams.

    Of each notice so many words that the bigrams without any of them are too few; rarer kinds of words first.
    """
    found = set()
    for pairs in _notice_pairs():
        left = [p.split(" ") for p in pairs]
        while len(left) >= CONFIRM * len(pairs):
            word = min({w for p in left for w in p}, key=lambda w: (w in _COMMON or w.isdigit(), -sum(w in p for p in left), -len(w), w))
            found.add(word)
            left = [p for p in left if word not in p]
    return rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(sorted(found))})(?![\p{{L}}\p{{N}}])"


def pieces(docs: DataFrame, everywhere: bool = False) -> DataFrame:
    """``doc_id, paragraph, block, mention, a, b, whole, words``: what is classified of each paragraph.

    Lines without letters and digits part paragraphs; within one, line ends are blanks. Every paragraph that mentions
    licensing or may hold a notice is classified as a whole, with ``everywhere`` each with a word. Its other pieces are the lines, sentences and overlapping windows of 20, 40 and 80 words in
    which a template may confirm a family, with or without a word about licensing: a notice can only be confirmed where
    the paragraph holds the share ``CONFIRM`` of its bigrams, and in pieces that hold one of these. What is left out
    could not count, whatever its class; pieces around words about licensing are classified in any case.
    ``a`` and ``b`` are their first word and the one after their last, ``block`` the hash of the paragraph.
    """
    # outer, so that no filter on the arrays computes them twice; neither is ever empty
    anchors, told = _anchors(), lambda text: F.col(text).rlike(_CUE)
    worth = lambda text: F.col(text).isNotNull() if everywhere else told(text) | F.lower(text).rlike(anchors)
    blocks = docs.where(worth("text")).select("doc_id", F.posexplode_outer(F.split("text", _BREAK)).alias("paragraph", "block"))
    blocks = blocks.where(worth("block") & F.col("block").rlike(r"[\p{L}\p{N}]")).withColumn("mention", told("block")).withColumn("w", words(F.col("block")))
    n, cut = F.size("w"), lambda c, a, b: F.slice(c, a + 1, b - a)
    notices = _notice_pairs()
    every = sorted({g for held in notices for g in held})
    pair = lambda x, i: F.concat_ws(" ", x, F.get(F.col("w"), i + 1))
    # the few bigrams of a paragraph that stand in a notice, with their places
    hits = F.filter(F.transform("w", lambda x, i: F.struct(i.alias("i"), pair(x, i).alias("g"))), lambda h: h["g"].isin(every))
    # behind a generator: what reads the hits does not look for them again
    blocks = blocks.select("*", F.explode_outer(F.array(hits)).alias("hits"))
    held = F.transform("hits", lambda h: h["g"])
    able = F.array(*[F.when(F.size(F.array_intersect(F.array(*map(F.lit, g)), held)) >= CONFIRM * len(g), F.array(*map(F.lit, g))) for g in notices])
    # fewer hits than the shortest notice needs: nothing to compare
    fewest = min(math.ceil(CONFIRM * len(g)) for g in notices)
    able = F.when(F.size("hits") >= fewest, F.flatten(F.filter(able, lambda g: g.isNotNull()))).otherwise(F.array().cast("array<string>"))
    blocks = blocks.select("*", F.explode_outer(F.array(able)).alias("able"))
    if not everywhere:
        blocks = blocks.where(F.col("mention") | (F.size("able") > 0))
    told = F.transform(F.filter("hits", lambda h: F.array_contains(F.col("able"), h["g"])), lambda h: h["i"])
    cues = F.when(F.col("mention"), F.filter(F.transform("w", lambda x, i: F.when(x.rlike(_CUE_WORD), i)), lambda i: i.isNotNull())).otherwise(F.array().cast("array<int>"))
    blocks = blocks.withColumn("marks", F.array_distinct(F.concat(told, cues)))
    near = lambda r: F.exists("marks", lambda i: (i >= r["a"]) & (i < r["b"]))
    none = F.array().cast("array<struct<a:int,b:int>>")
    ranges = [F.filter(_ranges(F.col("block"), by), near) for by in (r"\r?\n", r"(?<=[.!?])\s+")]
    ranges += [_windows(F.col("marks"), size, n) for size in WINDOWS]
    parts = F.when(F.size("marks") > 0, F.concat(*ranges)).otherwise(none)
    # a range as one number, so that equal ones are found by hashing
    coded = F.transform(F.concat(parts, F.array(F.struct(F.lit(0).alias("a"), n.alias("b")))), lambda r: F.shiftleft(r["a"].cast("long"), 32) + r["b"])
    cuts = F.transform(F.array_distinct(coded), lambda c: F.struct(
        F.shiftright(c, 32).cast("int").alias("a"), (c % (1 << 32)).cast("int").alias("b"),
        cut(F.col("w"), F.shiftright(c, 32).cast("int"), (c % (1 << 32)).cast("int")).alias("words")))
    # the words are cut before the rows are made, so no row carries the whole paragraph
    rows = blocks.select("doc_id", "paragraph", F.md5("block").alias("block"), "mention", n.alias("n"), F.explode_outer(cuts).alias("p"))
    whole = (F.col("p.a") == 0) & (F.col("p.b") == F.col("n"))
    return rows.select("doc_id", "paragraph", "block", "mention", "p.a", "p.b", whole.alias("whole"), "p.words")


def _apart(found: Column) -> Column:
    """Of ranked ranges, best first, those that overlap none that was taken before."""
    free = lambda held, c: F.forall(held, lambda h: (h["b"] <= c["a"]) | (c["b"] <= h["a"]))
    kind = "array<struct<similarity:double,same:int,length:int,place:int,a:int,b:int,family:string,probability:double>>"
    return F.aggregate(found, F.array().cast(kind), lambda held, c: F.when(free(held, c), F.array_append(held, c)).otherwise(held))


def scan(docs: DataFrame, fitted: tuple[LogisticRegressionModel, list[str], float], everywhere: bool = False) -> DataFrame:
    """Licence families of the paragraphs of ``docs (doc_id, text)``.

    Every paragraph is searched. With ``everywhere`` each gives rows; without it those that hold a family or
    mention licensing. Every piece that may count is classified, and a template of the predicted family must confirm it. Of the
    confirmed pieces of a paragraph the most alike goes first, then the longer match, the shorter piece and the
    earlier one; what overlaps it goes; each that is left is a part. A paragraph without a confirmed piece is one
    part of family ``unknown``, with its own probability and likeness to the predicted family.

    Returns ``doc_id, paragraph, part, family, probability, similarity``. Null and empty texts have no
    paragraph; repeated rows are given each; ties of probability go to the first family by name.
    Other columns are not read.
    """
    model, names, least = fitted
    rows = pieces(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), everywhere)
    rows = model.transform(_features(rows.withColumn("grams", grams(F.col("words")))))
    unknown = names.index(UNKNOWN)
    rows = rows.select("doc_id", "paragraph", "block", "mention", "a", "b", "whole", "words", vector_to_array("probability").alias("p"))
    odds = F.transform("p", lambda p, i: F.when(i == unknown, F.lit(-1.0)).otherwise(p))
    rows = rows.withColumn("probability", F.array_max(odds)).withColumn("sure", (F.col("probability") >= least) & (F.col("probability") > F.get("p", F.lit(unknown))))
    rows = rows.where("sure OR whole").withColumn("family", F.element_at(F.array(*map(F.lit, names)), F.array_position(odds, F.col("probability")).cast("int")))
    # a few rows, fixed above
    notices = docs.sparkSession.createDataFrame(_notice_table(), "family string, notice string")
    notices = notices.groupBy("family").agg(F.collect_list(F.array_distinct(bigrams(words(F.col("notice"))))).alias("notices"))
    rows = rows.withColumn("own", F.array_distinct(bigrams(F.col("words")))).join(F.broadcast(notices), "family")
    same = lambda n: F.size(F.array_intersect(n, F.col("own")))
    rows = rows.withColumn("like", F.array_max(F.transform("notices", lambda n: F.struct((same(n) / F.size(n)).alias("similarity"), same(n).alias("same")))))
    piece = F.struct(F.col("like.similarity").alias("similarity"), F.col("like.same").alias("same"), (F.col("a") - F.col("b")).alias("length"), (-F.col("a")).alias("place"),
                     "a", "b", "family", "probability")
    rows = rows.select("doc_id", "paragraph", "block", "mention", "whole", piece.alias("piece"), (F.col("sure") & (F.col("like.similarity") >= CONFIRM)).alias("confirmed"))
    rows = rows.where("confirmed OR whole")
    # equal rows share their block: their pieces are the same, and each of them has one whole paragraph
    found = rows.groupBy("doc_id", "paragraph", "block", "mention").agg(
        F.count_if("whole").alias("copies"), F.collect_set(F.when(F.col("confirmed"), F.col("piece"))).alias("found"), F.first(F.when(F.col("whole"), F.col("piece")), True).alias("all"))
    if not everywhere:
        found = found.where((F.size("found") > 0) | F.col("mention"))
    picked = F.array_sort(_apart(F.sort_array("found", asc=False)), lambda x, y: x["a"] - y["a"])
    parts = F.when(F.size("found") > 0, picked).otherwise(F.array(F.col("all").withField("family", F.lit(UNKNOWN))))
    out = found.select("doc_id", "paragraph", parts.alias("parts"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    out = out.select("doc_id", "paragraph", F.posexplode("parts").alias("part", "r"))
    return out.select("doc_id", "paragraph", "part", "r.family", "r.probability", "r.similarity")

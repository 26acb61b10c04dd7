"""Licence scans against a plain walk over the words, with the fitted weights as they are."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.ml.feature import HashingTF

from folioscope.llm import licences

CUE_WORD = re.compile(r"licen[sc]|copyright|permission|warrant|redistribut|^(?:cc|ccby.*|cc0.*|domain.*|reserved.*|software.*|bsd|gpl|apache|mozilla)$")
MENTION = re.compile(r"licen[sc]|copyright|permission|warrant|redistribut|public\W+domain|\bcc\W*(?:by|0)\b|rights\W+reserved|free\W+software|\b(?:bsd|gpl|apache|mozilla)\b", re.I)


def told(text):
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def pairs(words):
    return [f"{x} {y}" for x, y in zip(words, words[1:])] if len(words) > 1 else list(words)


def plain_scan(rows, fitted):
    model, names, least = fitted
    weights, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    hashing = HashingTF(numFeatures=licences.FEATURES, binary=True)
    known = {}

    def judge(words):
        grams = set(words) | set(pairs(words) if len(words) > 1 else [])
        for g in grams - known.keys():
            known[g] = hashing.indexOf(g)
        slots = sorted({known[g] for g in grams})
        raw = weights[:, slots].sum(axis=1) + bias
        odds = np.exp(raw - raw.max())
        odds /= odds.sum()
        other = odds[names.index(licences.UNKNOWN)]
        best, family = max((odds[i], -i) for i, n in enumerate(names) if n != licences.UNKNOWN)
        family = names[-family]
        own = set(pairs(words))
        notices = [set(pairs(told(t))) for t in licences.NOTICES[family]]
        similarity, same = max((len(n & own) / len(n), len(n & own)) for n in notices)
        return family, best, best >= least and best > other and similarity >= licences.CONFIRM, similarity, same

    out = []
    for doc, text in rows:
        lines, blocks = (text or "").split("\n"), [[]]
        for i, line in enumerate(lines):
            # a line without letters and digits parts paragraphs unless nothing follows or precedes it
            if not told(line) and 0 < i < len(lines) - 1:
                if blocks[-1]:
                    blocks.append([])
            else:
                blocks[-1].append(line)
        for number, block in enumerate(blocks):
            if not MENTION.search("\n".join(block)):
                continue
            words = told("\n".join(block))
            marks = [i for i, w in enumerate(words) if CUE_WORD.search(w)]
            ranges = {(0, len(words))}
            for cut in (block, re.split(r"(?<=[.!?])\s+", "\n".join(block))):
                at = 0
                for part in cut:
                    end = at + len(told(part))
                    if any(at <= m < end for m in marks):
                        ranges.add((at, end))
                    at = end
            for size in licences.WINDOWS:
                half = size // 2
                starts = {s for m in marks for s in (m // half * half, max(m // half * half - half, 0))}
                ranges |= {(s, min(s + size, len(words))) for s in starts}
            seen = {r: judge(words[r[0]:r[1]]) for r in ranges}
            ranked = sorted((r for r in ranges if seen[r][2]), key=lambda r: (-seen[r][3], -seen[r][4], r[1] - r[0], r[0]))
            held = []
            for a, b in ranked:
                if all(d <= a or b <= c for c, d in held):
                    held.append((a, b))
            for part, r in enumerate(sorted(held)):
                out.append((doc, number, part, seen[r][0], round(seen[r][1], 6), round(seen[r][3], 6)))
            if not held:
                _, best, _, similarity, _ = seen[0, len(words)]
                out.append((doc, number, 0, licences.UNKNOWN, round(best, 6), round(similarity, 6)))
    return sorted(out)


@pytest.fixture(scope="module")
def fitted(spark):
    return licences.fit(licences.labelled_table(spark))


def test_scan_equals_a_plain_walk(spark, fitted):
    filler = " ".join(f"w{i} and" for i in range(60))
    texts = [t for texts in licences.NOTICES.values() for t in texts] + licences.OTHER[:6]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [
        (100, f"{filler} Released under the MIT License {filler}\n\nLicensed under the Mozilla\nPublic License, version 2.0.\n* * *\nCopyright law is old."),
        (101, "Licensed under the Apache License, Version 2.0. " * 40), (102, None), (103, ""), (104, "license"), (105, "no word about it"),
        (106, "a license b. A license c! Released under the ISC License? " * 3), (101, "Licensed under the Apache License, Version 2.0. " * 40),
        (107, "\n\nReleased under the zlib License.\n"), (None, "Released under the BSD 3-Clause License."),
    ]
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, family string, piece int")
    got = [(r.doc_id, r.paragraph, r.part, r.family, round(r.probability, 6), round(r.similarity, 6)) for r in licences.scan(table, fitted).collect()]
    key = lambda r: (r[0] is None, r)
    assert sorted((r for r in got if r[0] is not None)) == plain_scan([r for r in rows if r[0] is not None], fitted)
    assert [r[3] for r in got if r[0] is None] == ["bsd"] and sorted(got, key=key)[-1][0] is None
    assert licences.scan(table.limit(0), fitted).count() == 0


def test_classifier_leads_and_templates_confirm(spark, fitted):
    """Unseen wordings: the family is told by the classifier; a prediction that no template confirms stays unknown."""
    texts = ["We license this thing to you under the GNU Lesser General Public License, version 2.1.", "See the LICENSE file, MIT.", "The license of the shop is on the wall."]
    found = {r.doc_id: r.family for r in licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), fitted).collect()}
    assert found == {0: "lgpl", 1: "unknown", 2: "unknown"}


def test_held_back_sentences_take_no_part_in_the_fit(spark):
    rows = licences.labelled_table(spark).collect()
    held = {" ".join(r.words) for r in rows if r.held}
    assert held and {r.family for r in rows if r.held} == {licences.UNKNOWN}
    assert not held & {" ".join(r.words) for r in rows if not r.held}


def test_every_paragraph_is_classified_and_notices_need_no_word_about_licensing(spark, fitted):
    """A notice whose words about licensing are lost is found, and every paragraph with a word gives a row."""
    eclipse = "This program and the accompanying materials are made available under the terms of the Eclipse Public"
    blind = next(t for t in [eclipse, *[re.sub(r"(?i)\blicen[sc]\w*|software", "x", t) for texts in licences.NOTICES.values() for t in texts]] if not MENTION.search(t))
    rows = [(1, "no word about it\n\n" + blind), (2, "plain text"), (3, "--"), (4, None), (5, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.paragraph, r.family) for r in licences.scan(table, fitted, everywhere=True).collect())
    assert [g[:2] for g in got] == [(1, 0), (1, 1), (2, 0)] and got[1][2] == "epl" and got[2][2] == licences.UNKNOWN
    assert [(r.doc_id, r.paragraph, r.family) for r in licences.scan(table, fitted).collect()] == [(1, 1, "epl")]

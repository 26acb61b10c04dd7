"""Small cases of each operator, against brute force or an exact round trip."""

import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.llm import chat, components, decontaminate, language, licences, mixing, near_dup, personal, tokens, vector_dup, warc
from folioscope.session import shared_dir

BASE = " ".join(f"w{i}" for i in range(60))


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def changed(places):
    w = BASE.split()
    for p in places:
        w[p] = f"x{p}"
    return " ".join(w)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 9)] + [(7, 7)]
    got = dict(components.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(21)}, **{100 + i: 100 for i in range(9)}}


def test_near_duplicates_agree_with_brute_force(spark):
    rng = random.Random(1)
    texts = [BASE, BASE.upper(), None, "", " \t", "one two", "One  two", "one two three"]
    texts += [changed(rng.sample(range(60), k)) for k in (1, 1, 2, 3, 4, 8) for _ in range(4)]
    texts += [" ".join(f"q{rng.randint(0, 9)}" for _ in range(3000))] * 2
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(0, BASE, "again"), (None, BASE, "no id")]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "id long, text string, component_id string")).collect()
    assert len(got) == len(rows)
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    part = {i: i for i in sets}
    for a, b in itertools.combinations(sets, 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            lo, hi = sorted((part[a], part[b]))
            part = {k: lo if v == hi else v for k, v in part.items()}
    for r in got:
        if r.id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.n_shingles, r.kept) == (part[r.id], len(sets[r.id]), part[r.id] == r.id)


def test_near_duplicates_of_an_id_with_two_texts(spark):
    rows = [(1, BASE), (2, BASE), (2, "a b c d e f g h"), (3, "a b c d e f g h")]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "id long, text string")).collect()
    assert {r.component_id for r in got} == {1}
    one = near_dup.one_of_each(spark.createDataFrame([(9, BASE, 1), (9, BASE, 1), (9, BASE, 0), (None, BASE, 5)], "doc_id long, text string, more int"))
    assert sorted(map(tuple, one.collect()), key=str) == [(9, BASE, 0), (None, BASE, 5)]


def test_key_bound():
    rng = np.random.default_rng(0)
    for _ in range(300):  # any 13 places may differ, and a key still agrees
        differ = set(rng.choice(near_dup.PLACES, near_dup.DISTANCE, replace=False).tolist())
        assert any(not differ & set(chosen) for _, chosen in near_dup.KEYS)


def test_far_signatures_of_like_texts_are_compared(spark):
    tail = sum(math.comb(24, k) * 0.25**k * 0.75 ** (24 - k) for k in range(near_dup.FAR + 1, 25))
    assert tail < 1e-6
    rng, base = random.Random(5), [f"w{i}" for i in range(300)]
    found = None
    while not found:
        texts = [" ".join(base)]
        for _ in range(2000):
            w = list(base)
            for p in rng.sample(range(300), 9):
                w[p] = f"x{rng.random()}"
            texts.append(" ".join(w))
        made = next(near_dup._signed([pa.record_batch({"id": pa.array(range(len(texts))), "text": pa.array(texts)})]))
        signs = np.array(made.column("signature").to_pylist())
        for i in np.flatnonzero((signs[1:] != signs[0]).sum(axis=1) > near_dup.DISTANCE) + 1:
            a, b = shingles(texts[0]), shingles(texts[i])
            key = any(all(signs[0][p] == signs[i][p] for p in chosen) for _, chosen in near_dup.KEYS)
            if key and 100 * len(a & b) >= 75 * len(a | b):
                found = [(1, texts[0]), (2, texts[i])]
    got = near_dup.near_duplicates(spark.createDataFrame(found, "id long, text string")).collect()
    assert {r.component_id for r in got} == {1}


def test_containment_agrees_with_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    vocabulary = [f"v{i}" for i in range(4000)]
    run = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, run(n)) for i, n in enumerate([6, 9, 14, 30, 59, 200])] + [(10, None), (11, ""), (12, "short one"), (0, run(12))]
    docs = [(i, f"{run(3000)} {t} {run(20)}", 0) for i, t in items if t] + [(50, None, 0), (51, "", 0), (52, "Short ONE", 0), (53, run(20), 0)]
    cut = items[4][1].split()
    docs += [(60, " ".join([*cut[:20], "zz", *cut[20:]]), 0), (61, " ".join(cut[:30]), 0), (60, cut[0], 0)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted((i, j, len(shingles(u)), len(shingles(t) & shingles(u))) for i, t, _ in docs for j, u in items
                  if shingles(u) and 100 * len(shingles(t) & shingles(u)) >= 75 * len(shingles(u)))
    assert sorted(map(tuple, decontaminate.contained(d, b).collect())) == want
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 500)
    assert sorted(map(tuple, decontaminate.contained(d, b).collect())) == want
    leaks = {w[0] for w in want}
    assert {r.doc_id for r in decontaminate.clean(d, b).collect()} == {x[0] for x in docs} - leaks
    assert decontaminate.contained(d, b.limit(0)).count() == 0


def test_pieces_count_like_whole_texts(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["", None, " lead", "trail ", "two  spaces", "a \n b\tc  \n\n d", "it's we'll 'tis 5 000 x1y2", "<|endoftext|> a<|endoftext|>b <|endoftext|>",
             "naïve été x  y", "日本語 テキスト 漢字", "x" * 5000, "word " * 4000, "a\x1c b \x1c c", " ", "  "]
    got = tokens.token_counts(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), P.path("byte_bpe_50k.json")).collect()
    for r in got:
        t = texts[r.doc_id] or ""
        n = len(whole.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 1024), t[:20]
    assert [sum(map(len, b)) for b in tokens.balanced(["ab"] * 5, 16)] == [4, 4, 2]


def test_patterns_and_added_spans(spark):
    text = "a.b@c.de, x@y 1.2.3.4 300.1.1.1, 4111 1111 1111 1111, +1 (017) 555-7713, +12, 4111111111111112"
    assert [[text[a:b] for a, b in k] for k in personal.pattern_spans(text)] == [
        ["a.b@c.de"], ["1.2.3.4"], ["4111 1111 1111 1111"], ["+1 (017) 555-7713"]]
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    rng = random.Random(3)
    for _ in range(500):
        t = "".join(rng.choice("ab.@- ") for _ in range(30))
        assert personal.pattern_spans(t)[0] == [m.span() for m in email.finditer(t)], t
    model = personal.fit(personal.labelled_table(spark))
    held = personal.labelled_table(spark, 200, seed=77).collect()
    found = personal._decoded([r["text"] for r in held], *model, personal.TokenClasses())
    want = [{(personal.KINDS.index(s["kind"]), s["start"], s["stop"]) for s in r["spans"]} for r in held]
    right = sum(len(set(f) & w) for f, w in zip(found, want))
    assert right >= 0.9 * sum(map(len, found)) and right >= 0.85 * sum(map(len, want))
    rows = [(1, "write to ann (at) host (dot) com now"), (2, None), (3, ""), (4, "plain words only"), (1, "mail a@b.cd " * 3000)]
    got = personal.personal_data(spark.createDataFrame(rows, "doc_id long, text string"), model, True).collect()
    assert got[0]["n_added"] == 1 and "[EMAIL]" in got[0]["redacted"] and got[1]["spans"] == got[2]["spans"] == got[3]["spans"] == ""
    assert got[4]["n_email"] == 3000
    docs = spark.createDataFrame([(1, "a@b.cd", "en", 6), (2, None, "en", None)], "doc_id long, text string, lang string, n_chars long")
    assert [tuple(r) for r in personal.without(docs, model).collect()] == [(1, "[EMAIL]", "en", 7), (2, None, "en", None)]


def test_spelled_addresses_without_digits(spark):
    model = personal.fit(personal.labelled_table(spark))
    filler = "nothing of note stands here and so it goes on. " * 8
    forms = ["jane at example dot com", "JANE AT EXAMPLE DOT COM", "jane (AT) example (DOT) com", "jane [At] example [Dot] org", "jane {at} example {dot} net", "jane <at> example <dot> de"]
    texts = [f"{filler}write to {f}, {filler}" for f in forms]
    _, both = personal.all_spans(texts, *model, personal.TokenClasses())
    assert [[t[a:b] for a, b in k[0]] for t, k in zip(texts, both)] == [[f] for f in forms]


def test_viterbi_agrees_with_all_paths():
    rng = np.random.default_rng(4)
    e, m = rng.normal(size=(1, 3, personal.N_STATES)), rng.normal(size=(personal.N_STATES + 1, personal.N_STATES))
    score = lambda p: m[-1, p[0]] + sum(e[0, t, s] for t, s in enumerate(p)) + sum(m[a, b] for a, b in zip(p, p[1:]))
    best = max(itertools.product(range(personal.N_STATES), repeat=3), key=score)
    assert tuple(personal.viterbi(e, m, np.array([3]))[0]) == best


def test_vectors_agree_with_brute_force(spark):
    rng = np.random.default_rng(5)
    center = rng.normal(size=(4, 16))
    rows = [(i, [float(x) for x in center[i % 4] + rng.normal(size=16) * 0.12], int(i % 2)) for i in range(300)]
    rows += [(300, rows[0][1], 0), (300, rows[0][1], 0), (301, None, 0), (302, [0.0] * 16, 0), (303, [1.0, None], 0), (304, [float("nan")] * 16, 0),
             (305, rows[0][1], None), (306, rows[0][1][:8], 0), (307, [], 0), (308, [1e300] * 16, 3), (None, rows[0][1], 0)]
    got = vector_dup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert len(got) == len(rows)
    sound = [(i, np.array(v) / np.linalg.norm(v), l) for i, v, l in rows if i is not None and l is not None and v and None not in v and np.isfinite(v).all() and any(v) and i != 308]
    want = {}
    for k, (i, v, l) in enumerate(sound):
        want[i] = sum(1 for n, (_, u, o) in enumerate(sound) if n != k and o == l and len(u) == len(v) and u @ v >= 0.93)
    assert {r.vec_id: r.n_links for r in got if r.vec_id in want} == want
    assert all(r.n_links == 0 for r in got if r.vec_id not in want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)


def test_chat_reads_back(spark):
    rows = [(1, 0, "user", "a <|end|> b"), (1, 1, "user", None), (1, 2, "assistant", "<||x<|"), (1, 2, "assistant", "<||x<|"), (2, None, "a|>%7C", "x<"),
            (None, 0, None, ""), (3, 0, "assistant", "y" * 100_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.read_back(chat.formatted(turns)).collect()}
    assert got == {1: [("user", "a <|end|> b"), ("user", ""), ("assistant", "<||x<|"), ("assistant", "<||x<|")], 2: [("a|>%7C", "x<")],
                   None: [("", "")], 3: [("assistant", "y" * 100_000)]}
    assert chat.formatted(turns.limit(0)).count() == 0


def test_mix_meets_its_targets(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randint(0, 40), rng.choice(["a", "b", "c", None]), 0) for i in range(400)] + [(7, None, "a", 0), (None, "x y", "b", 0), (7, None, "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target int")
    got = mixing.mixed(docs).collect()
    assert len(got) == len(rows) and got == mixing.mixed(docs).collect()
    for s in "abc":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 80 and all(r.taken <= 2 * r.size for r in own)
        assert own[0].source_size == sum(r.size for r in own) and own[0].target <= 2 * own[0].source_size
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(1.5 * sum(r.size for r in got))
    out = mixing.emitted(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in got)
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_licences(spark):
    fitted = licences.fit(licences.labelled_table(spark))
    rows = [(1, "Foo.\nReleased under the MIT License."), (2, "He lost his driving licence."), (3, None), (4, ""), (5, "LICENSED under CC BY-SA 4.0!"),
            (6, "plain"), (1, "Foo.\nReleased under the MIT License."), (7, "word " * 3000 + ". Licensed under the Apache License, Version 2.0.")]
    got = sorted((r.doc_id, r.family) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), fitted).collect())
    assert got == [(1, "mit"), (1, "mit"), (2, "unknown"), (5, "cc-by-sa"), (7, "apache-2.0")]


def test_licence_notices_wrapped_over_lines(spark):
    fitted = licences.fit(licences.labelled_table(spark))
    bsd = """ * Copyright (c) 2020, Someone
 *
 * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are
 * met:
 *
 * 1. Something else."""
    lgpl = """# This library is free software; you can redistribute it and/or
# modify it under the terms of the GNU Lesser General Public
# License as published by the Free Software Foundation; either
# version 2.1 of the License, or (at your option) any later version."""
    publisher = "No part of this publication may be reproduced\r\nwithout the prior written permission\r\nof the publisher"
    nc = "This work is licensed under a Creative Commons Attribution\nNonCommercial 4.0 International License."
    both = "Released under the MIT License.\nLicensed under the Apache License, Version 2.0."
    prose = " ".join(f"word{i} and" for i in range(200))
    texts = [bsd, lgpl, publisher, nc, both, f"{prose}\nNo part of this publication may\nbe reproduced without the prior written\npermission of the publisher. {prose}",
             f"{prose}\n{prose[:90]}\nLicensed under CC BY 4.0\n{prose}", "// Dedicated to the public\n// domain under CC0 1.0."]
    found = licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), fitted).where("family != 'unknown'").collect()
    assert sorted((r.doc_id, r.family) for r in found) == [
        (0, "bsd"), (1, "lgpl"), (2, "proprietary"), (3, "cc-by-nc"), (4, "apache-2.0"), (4, "mit"), (5, "proprietary"), (6, "cc-by"), (7, "cc0")]


def test_language_fuses_its_evidence(spark):
    words = {"aa": "the and of that with", "bb": "der und die das nicht"}
    train = spark.createDataFrame([(" ".join(random.Random(i).choices(w.split(), k=40)), k) for i in range(30) for k, w in words.items()], "text string, language string")
    model = language.fit(train)
    assert model.names == ["aa", "bb"]
    rows = [(i, "the of and that with the", "aa", "aa", "x.host.com") for i in range(30)] + [(100, None, "aa", None, "x.host.com"), (101, "", None, None, None),
            (102, "und das nicht die der und das nicht und die der", "aa", None, "x.host.com"), (103, "qzx " * 300, None, None, None), (104, "12 34 !?", "bb", "bb", None)]
    rows += [(200 + i, "und die das nicht der", "bb", "bb", "y.other.com") for i in range(10)]
    got = {r.id: r for r in language.identify(spark.createDataFrame(rows, "id long, text string, declared string, suffix string, host string"), model).collect()}
    assert len(got) == len(rows)
    assert [got[i].language for i in (0, 100, 102, 103, 104)] == ["aa", "aa", "bb", "und", "bb"]
    assert got[101].language == "aa" and got[0].posterior > 0.9
    docs = spark.createDataFrame([(1, "the and of", "aa", "s"), (2, "qzx " * 300, "aa", "s"), (3, None, "aa", "s"), (None, "die und das", "bb", None)], "doc_id long, text string, lang string, source string")
    assert {r.doc_id for r in language.known(docs, model).collect()} == {1, 3, None}


def test_language_of_many_copies_and_of_no_model(spark, monkeypatch):
    monkeypatch.setattr(language, "FIT_ROWS", 4)
    own = [(f"the cat number {w} sleeps", "en") for w in "abcdefghijklmnopqrst"] * 5
    copies = [("кошка спит на окне", "ru")] * 3000
    docs = spark.createDataFrame(own + copies, "text string, language string")
    assert language.fit(docs).names == ["en", "ru"]
    table = docs.selectExpr("monotonically_increasing_id() AS doc_id", "text", "language AS lang", "'s' AS source").cache()
    assert language.known(table).count() == len(own) + len(copies)


def test_every_declared_language_has_a_model(spark):
    rng = random.Random(8)
    words = {f"l{i:02}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(8)] for i in range(90)}
    rows = [(" ".join(rng.choices(w, k=30)), name) for name, w in words.items() for _ in range(3)]
    model = language.fit(spark.createDataFrame(rows, "text string, language string"))
    assert model.names == sorted(words)
    asked = [(i, " ".join(rng.choices(w, k=60)), None, None, None) for i, w in enumerate(words.values())]
    asked = spark.createDataFrame(asked, "id long, text string, declared string, suffix string, host string")
    assert {r.id: r.language for r in language.identify(asked, model).collect()} == dict(enumerate(words))


def test_long_text_and_empty_tables_of_language(spark):
    train = spark.createDataFrame([("the and of that with " * 9, "aa"), ("der und die das nicht " * 9, "bb")], "text string, language string")
    model = language.fit(train)
    rows = spark.createDataFrame([(1, "the of and " * 300_000, None, None, None)], "id long, text string, declared string, suffix string, host string")
    assert language.identify(rows, model).first().language == "aa"
    assert language.identify(rows.limit(0), model).count() == 0 and language.fit(train.limit(0)).names == []
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert language.known(docs).count() == 0


def plain_language(train, rows):
    """Languages and posteriors by dictionaries."""
    logs, names = {}, sorted({lang for _, lang in train})
    for name in names:
        three, two, one, pairs = {}, {}, {}, {}
        for text in sorted({t for t, lang in train if lang == name}):
            b = bytes(language._bytes(text))
            for x, y, z in zip(b, b[1:], b[2:]):
                for table, key in ((three, (x, y, z)), (pairs, (x, y)), (two, (y, z)), (one, z)):
                    table[key] = table.get(key, 0) + 1
        firsts = {}
        for (y, _), n in two.items():
            firsts[y] = firsts.get(y, 0) + n
        logs[name] = {k: math.log(0.85 * n / pairs[k[:2]] + 0.1 * two[k[1:]] / firsts[k[1]] + 0.04 * one[k[2]] / sum(one.values()) + 0.01 / 256)
                      for k, n in three.items()}
    everyone, told, seen = [*names, "und"], [], {}
    for i, text, declared, suffix, host in rows:
        b = bytes(language._bytes(text or ""))
        scores = [0.0] * len(everyone)
        if len(b) >= 4:
            total = [0.1 * sum(logs[n].get(t, math.log(0.01 / 256)) for t in zip(b, b[1:], b[2:])) for n in names] + [0.1 * (len(b) - 2) * math.log(1 / 256)]
            scores = [max(t - max(total), -30.0) for t in total]
            told.append((everyone[scores.index(max(scores))], declared, suffix, host))
        seen[i] = scores
    whole = {n: sum(t[0] == n for t in told) for n in everyone}
    prior = [0.99 * (whole[n] + 1) / (len(told) - whole["und"] + len(names)) for n in names] + [0.01]
    lean = lambda own, above: [(sum(t[0] == n for t in own) + 5 * p) / (len(own) + 5) for n, p in zip(everyone, above)]
    out = {}
    for i, text, declared, suffix, host in rows:
        p = prior
        if host:
            domain = lambda h: ".".join(h.split(".")[-2:])
            of = lambda test: [t for t in told if t[3] and test(t[3])]
            if of(lambda h: h == host):
                p = lean(of(lambda h: h.split(".")[-1] == host.split(".")[-1]), prior)
                p = lean(of(lambda h: domain(h) == domain(host)), p)
                p = lean(of(lambda h: h == host), p)
        total = [s + math.log(x) for s, x in zip(seen[i], p)]
        for at, value in ((1, declared), (2, suffix)):
            if value and (own := [t for t in told if t[at] == value]):
                total = [s + math.log(x / q) for s, x, q in zip(total, lean(own, prior), prior)]
        top = max(total)
        out[i] = (everyone[total.index(top)], 1 / sum(math.exp(s - top) for s in total))
    return out


def test_language_agrees_with_dictionaries(spark):
    rng = random.Random(12)
    words = {"aa": "the and of that with", "bb": "der und die das nicht", "cc": "le et la que dans"}
    train = [(" ".join(rng.choices(w.split(), k=12)), k) for k, w in words.items() for _ in range(6)]
    rows = []
    for i in range(120):
        own = rng.choice(list(words))
        text = rng.choice([" ".join(rng.choices(words[own].split(), k=rng.randint(1, 3))), "", None, "zzq xxj", "the und le"])
        rows.append((i, text, rng.choice([own, "aa", None, ""]), rng.choice([own, None, "zz"]), rng.choice([f"{own}.site.org", "x.site.org", f"www.{own}.net", None, "local"])))
    model = language.fit(spark.createDataFrame(train, "text string, language string"))
    got = language.identify(spark.createDataFrame(rows, "id long, text string, declared string, suffix string, host string"), model)
    want = plain_language(train, rows)
    for r in got.collect():
        assert r.posterior == pytest.approx(want[r.id][1], rel=1e-4)
        assert r.language == want[r.id][0] or r.posterior < 0.5001


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_archives_read_back(spark, compression):
    html = "<p>é</p>\r\n\r\n" * 3
    rows = [(3, "http://a/x", html), (1, "http://a/ y", html), (2, None, None), (5, "u", ""), (None, "v", html), (9, "w", "z" * 600_000), (9, "w", "z" * 600_000)]
    path = f"{shared_dir(spark)}/test-{compression}-{random.random()}"
    warc.write(warc.with_revisits(spark.createDataFrame(rows, "page_id long, url string, html string")), path, compression=compression)
    got = warc.read(spark, path, verify="true").where("record_type != 'warcinfo'").collect()
    assert sorted((r.record_id[9:], r.record_type, r.refers_to and r.refers_to[9:]) for r in got) == sorted([
        ("1", "response", None), ("3", "revisit", "1"), ("none", "revisit", "1"), ("2", "response", None), ("5", "revisit", "2"), ("9", "response", None), ("9", "response", None)])
    assert {bytes(r.payload) for r in got if r.record_type == "response"} == {html.encode(), b"", b"z" * 600_000}
    assert all(r.payload_bytes == len(html.encode()) for r in got if r.record_id[9:] in ("1", "3", "none"))
    some = warc.read(spark, path, payload="false").where(F.col("record_type").isin("revisit") & (F.col("target_uri") == "u"))
    assert [(r.record_id, r.payload) for r in some.collect()] == [("urn:page:5", None)]


def test_archives_grow_by_commits_and_show_cuts(spark, tmp_path):
    pages = lambda ids: spark.createDataFrame([(i, "http://a", "y" * 1000) for i in ids], "page_id long, url string, html string")
    path = f"{shared_dir(spark)}/test-append-{random.random()}"
    for ids in ([1], [2], [3]):
        warc.write(warc.with_revisits(pages(ids)), path)
    assert sorted(r.record_id for r in warc.read(spark, path).where("record_type = 'response'").collect()) == [f"urn:page:{i}" for i in (1, 2, 3)]
    record = warc.record("response", "urn:page:1", "http://a", None, b"y" * 1000, "1970-01-01T00:00:00Z")
    for name, data, payload in (("plain.warc", record[:-500], "true"), ("head.warc", record[:-500], "false"),
                                ("packed.warc.gz", warc.member(record)[:-40], "false"), ("full.warc.gz", warc.member(record)[:-40], "true")):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(Exception, match="cut"):
            warc.read(spark, f"file://{tmp_path}/{name}", payload=payload).collect()
    (tmp_path / "whole.warc").write_bytes(record[:-4])  # only the blank lines at the end are missing
    assert len(warc.read(spark, f"file://{tmp_path}/whole.warc").first().payload) == 1000
    assert re.sub(warc._S3, "s3://", "s3a://bucket/a") == "s3://bucket/a"


def test_columns_of_any_name_pass_the_stages(spark):
    columns = "doc_id int, text string, lang string, source string, n_chars int, row string, __row string, __copies int, more int"
    rows = [(1, "the and of " * 4, "en", "s", 44, "r", "rr", 5, 6), (2, "write to ann@example.com the and of", "en", "s", 35, "q", "qq", 5, 6), (2, None, "en", None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, columns)
    model = personal.fit(personal.labelled_table(spark))
    kept = {"known": language.known(docs), "clean": decontaminate.clean(docs, spark.createDataFrame([(1, "nothing of this")], "item_id long, text string")),
            "without": personal.without(docs, model), "emitted": mixing.emitted(docs), "one_of_each": near_dup.one_of_each(docs)}
    for name, out in kept.items():
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        for r in out.collect():
            same = next(x for x in rows if x[0] == r[0] and (x[1] is None) == (r[1] is None))
            assert tuple(r)[5:] == same[5:], name
    texts = {(r.doc_id, r.n_chars): r.text for r in kept["without"].collect()}
    redacted = next(t for (i, n), t in texts.items() if i == 2 and n)
    assert "ann@" not in redacted and (2, len(redacted)) in texts and (2, None) in texts
    for out in (language.known(docs.limit(0)), personal.without(docs.limit(0), model), mixing.emitted(docs.limit(0))):
        assert out.count() == 0


def test_base_spans_of_numbers_agree_with_brute_force():
    rng = random.Random(14)

    def luhn(digits):
        return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0

    def plain(text):
        cases = [("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
                 ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(d := [int(c) for c in m if c.isdigit()]) <= 19 and luhn(d)),
                 ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= sum(c.isdigit() for c in m) <= 15)]
        return {k: [(m.start(), m.end()) for m in re.finditer(p, text) if ok(m[0])] for k, p, ok in cases}

    for _ in range(400):
        text = "".join(rng.choice(["4111 1111 1111 1111", "1.2.3.4", "256.1.1.1", "+49 30 12345", "+1", "-", " ", ".", "7", "00", "(", ")", "x"]) for _ in range(rng.randint(1, 14)))
        base = dict(zip(personal.KINDS, personal.pattern_spans(text)))
        for kind, spans in plain(text).items():
            assert base[kind] == spans, (kind, text)

"""All stages of the pipeline on one small table, each against plain Python on what the stage before kept."""

import hashlib
import itertools
import math
import random
import re

import corpus_pipeline

EN = "the and of that with which from have this were their into only over such".split()
DE = "der und die das nicht eine auch wird sich von dem mit aus nach wurde".split()
PASSAGE = " ".join(f"item{i}" for i in range(30))


def documents(rng):
    rows = []
    for i in range(60):
        words, lang = (EN, "en") if i % 3 else (DE, "de")
        rows.append([i, " ".join(rng.choices(words, k=rng.randint(20, 60))), lang, "hot" if i % 4 else rng.choice(["b", "c", None]), None])
    rows[5][1] = rows[4][1]  # an exact copy, and a near one
    rows[8][1] = " ".join(rows[7][1].split() + ["tail"])
    rows[10][1] = f"{rows[10][1]} {PASSAGE} {rows[11][1]}"
    rows[13][1] = f"{rows[13][1]} write to ann.lee@example.com {rows[14][1]}"
    rows += [[60, "qzx jjk " * 80, None, "hot", None], [61, None, "en", "hot", None], [62, "", None, None, None],
             [63, "12 34", "en", "hot", None], [None, " ".join(rng.choices(EN, k=30)), "en", "hot", None]]
    for r in rows:
        r[4] = None if r[1] is None else len(r[1])
    return [tuple(r) for r in rows]


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def shingles(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i: i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def one_of_each(rows):
    part = {r[0]: r[0] for r in rows if r[0] is not None}
    sets = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    for a, b in itertools.combinations(sets, 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            lo, hi = sorted((part[a], part[b]))
            part = {k: lo if v == hi else v for k, v in part.items()}
    return [r for r in rows if r[0] is None or part[r[0]] == r[0]]


def mix(rows):
    """Every row as often as systematic sampling in order of size takes it."""
    size = lambda r: len(words(r[1]))
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size(r) for r in rows if r[3] == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    left, open_, target = 1.5 * sum(total.values()), set(sources), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 2 * total[s]}
        for s in full or open_:
            target[s] = 2 * total[s] if full else level * weight[s]
            left -= target[s]
        open_ -= full or set(open_)
    out = []
    for s in sources:
        each = target[s] / total[s] if total[s] else 0.0
        start = int(hashlib.md5(("mix" + ("\0" if s is None else s)).encode()).hexdigest()[:8], 16) / 2**32
        own = sorted((r for r in rows if r[3] == s), key=lambda r: (size(r), r[0] is not None, r[0] or 0))
        for k, r in enumerate(own):
            out += [r] * (math.floor((k + 1) * each + start) - math.floor(k * each + start))
    return out


def test_each_stage_against_plain_python(spark, tmp_path):
    rows = documents(random.Random(21))
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, PASSAGE), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    redact = lambda r: (r[0], t := r[1] and r[1].replace("ann.lee@example.com", "[email]"), *r[2:4], t if t is None else len(t))
    plain = {
        "language": lambda rows: [r for r in rows if r[0] != 60],
        "near_duplicates": one_of_each,
        "decontaminate": lambda rows: [r for r in rows if 100 * len(shingles(r[1]) & shingles(PASSAGE)) < 75 * len(shingles(PASSAGE))],
        "personal_data": lambda rows: [redact(r) for r in rows],
        "mix": mix,
    }
    order = lambda r: tuple((x is not None, x) for x in r)
    docs, held = spark.read.parquet(f"{tmp_path}/documents.parquet"), rows
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        held = plain[name](held)
        got = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
        if name == "personal_data":  # the mark's wording is the operator's own
            got = [(r[0], m := r[1] and re.sub(r"\S*(?i:email)\S*", "[email]", r[1]), *r[2:4], m if m is None else len(m)) for r in got]
            assert sorted(got, key=order) == sorted(held, key=order), name
            held = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
            continue
        assert sorted(got, key=order) == sorted(held, key=order), name
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((tuple(r) for r in run.collect()), key=order) == sorted(got, key=order)

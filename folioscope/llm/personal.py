"""Personal data: fixed patterns, and a linear-chain conditional random field that adds what they miss.

The field labels tokens (letter runs, digit runs, single signs) as outside, or as first or further
token of an e-mail address, an IP address, a card or a phone number. Its features are the classes of
the token and of its two neighbours on either side: word shape and length, digits and how many,
the sign itself, a cue word, and whether white space stands before. It is trained on a small labelled table by
maximum likelihood and decoded by Viterbi over batches of stretches of even length.

A stretch is what stands within ``REACH`` characters of a digit, an at sign, the word "at" in brackets or
the word "at" shortly before the word "dot", in any case of letters; the rest of a text is not decoded. A decoded span is kept if its digits are
plausible for its kind and it overlaps no pattern span.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

KINDS = ("email", "ip", "card", "phone")
#: Most labelled rows that are fitted.
FIT_ROWS = 2000
#: Characters around a digit, at sign or spelled "at" that are decoded.
REACH = 80
#: Score that the first token of a span must overcome besides; favours precision.
CAUTION = 1.5
ROUNDS, RATE, PENALTY = 90, 0.15, 0.002

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match can only begin where a run of digits begins, since runs are taken whole
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def pattern_spans(text: str) -> list[list[Span]]:
    """Spans of each kind that the fixed patterns find, leftmost first, none overlapping in a kind."""
    emails, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            emails.append((start, found.end()))
        end = found.end() if found else at + 1
        at = text.find("@", end)
    if not _DIGIT.search(text):
        return [emails, [], [], []]
    ips = [m.span() for m in _IP.finditer(text) if all(_small(p) for p in m[0].split("."))]
    cards = [m.span() for m in _CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    phones = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return [emails, ips, cards, phones]


def _small(part: str) -> bool:
    part = part.lstrip("0") or "0"
    return len(part) <= 3 and int(part) <= 255


# ---------------------------------------------------------------- tokens and features

_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\S")
CUES = ("at", "dot", "mail", "email", "e", "phone", "tel", "call", "fax", "mobile", "card", "visa", "ip", "host", "server",
        "version", "isbn", "page", "token", "com", "org", "net", "de", "fr", "es")
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CLASSES = {name: i for i, name in enumerate(
    ["edge", "other", *(f"digits{n}" for n in range(1, 21)), *(f"word {c}" for c in CUES), *_SIGNS,
     *(f"{shape}{size}" for shape in ("lower", "upper", "title", "mixed") for size in (1, 2, 3))])}
N_CLASSES = 2 * len(_CLASSES)
OFFSETS = (-2, -1, 0, 1, 2)
N_STATES = 1 + 2 * len(KINDS)  # outside, then first and further token of each kind


def token_class(token: str) -> int:
    if token[0] in "0123456789":
        return _CLASSES[f"digits{min(len(token), 20)}"]
    if token in _CLASSES:
        return _CLASSES[token]
    if not token[0].isalpha():
        return _CLASSES["other"]
    if f"word {token.lower()}" in _CLASSES:
        return _CLASSES[f"word {token.lower()}"]
    shape = "lower" if token.islower() else "upper" if token.isupper() else "title" if token.istitle() else "mixed"
    return _CLASSES[f"{shape}{1 if len(token) == 1 else 2 if len(token) < 6 else 3}"]


class TokenClasses(dict):
    def __missing__(self, token: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[token] = value = token_class(token)
        return value


def tokenized(text: str, start: int, end: int, classes: TokenClasses) -> tuple[list[Span], np.ndarray]:
    """Places of the tokens between two places, and their feature classes."""
    spans = [m.span() for m in _TOKEN.finditer(text, start, end)]
    ids = [2 * classes[text[a:b]] + (a == 0 or text[a - 1].isspace()) for a, b in spans]
    return spans, np.array(ids, dtype=np.int64)


def _emissions(ids: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Scores (rows, places, states); rows are padded with 0, the class of an edge."""
    wide = np.pad(ids, ((0, 0), (2, 2)))
    n = ids.shape[1]
    return sum(weights[i][wide[:, 2 + o : 2 + o + n]] for i, o in enumerate(OFFSETS))


def _allowed() -> np.ndarray:
    """0 where a state may follow another, else a score that forbids it; the last row is the start."""
    out = np.zeros((N_STATES + 1, N_STATES))
    for k in range(len(KINDS)):
        out[:, 2 + 2 * k] = -1e4
        out[1 + 2 * k, 2 + 2 * k] = out[2 + 2 * k, 2 + 2 * k] = 0
    return out


def viterbi(emissions: np.ndarray, moves: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best states of each row of a batch; beyond a row's length the answer is 0."""
    rows, n, _ = emissions.shape
    back = np.zeros((rows, n, N_STATES), dtype=np.int8)
    best = emissions[:, 0] + moves[N_STATES]
    final = best.copy()
    for t in range(1, n):
        scores = best[:, :, None] + moves[None, :N_STATES]
        back[:, t] = scores.argmax(axis=1)
        best = scores.max(axis=1) + emissions[:, t]
        final = np.where((lengths > t)[:, None], best, final)
    out = np.zeros((rows, n), dtype=np.int8)
    state = final.argmax(axis=1)
    for t in range(n - 1, -1, -1):
        live = lengths > t
        out[live, t] = state[live]
        state = np.where(live, back[np.arange(rows), t, state], state)
    return out


# ---------------------------------------------------------------- training

def train(sequences: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Weights (offset, class, state) and moves (state before or start, state) from labelled token rows."""
    n = max((len(i) for i, _ in sequences), default=1)
    rows = len(sequences)
    ids, gold, lengths = np.zeros((rows, n), int), np.zeros((rows, n), int), np.array([len(i) for i, _ in sequences])
    for r, (i, g) in enumerate(sequences):
        ids[r, : len(i)], gold[r, : len(g)] = i, g
    real = np.arange(n)[None] < lengths[:, None]
    wide = np.pad(ids, ((0, 0), (2, 2)))
    views = [wide[:, 2 + o : 2 + o + n] for o in OFFSETS]
    before = np.concatenate([np.full((rows, 1), N_STATES), gold[:, :-1]], axis=1)
    truth = np.eye(N_STATES)[gold]
    weights, moves, fixed = np.zeros((len(OFFSETS), N_CLASSES, N_STATES)), np.zeros((N_STATES + 1, N_STATES)), _allowed()
    steps = [[np.zeros_like(weights), np.zeros_like(weights)], [np.zeros_like(moves), np.zeros_like(moves)]]
    gold_moves = np.zeros_like(moves)
    np.add.at(gold_moves, (before[real], gold[real]), 1)
    for turn in range(1, ROUNDS + 1):
        e, m = _emissions(ids, weights), np.exp(moves + fixed)
        e = np.exp(e - e.max(axis=2, keepdims=True))
        ahead, behind = np.empty_like(e), np.ones_like(e)
        ahead[:, 0] = e[:, 0] * m[N_STATES]
        for t in range(1, n):
            now = (ahead[:, t - 1] @ m[:N_STATES]) * e[:, t]
            ahead[:, t] = np.where(real[:, t, None], now / now.sum(axis=1, keepdims=True), ahead[:, t - 1])
        for t in range(n - 2, -1, -1):
            now = (e[:, t + 1] * behind[:, t + 1]) @ m[:N_STATES].T
            behind[:, t] = np.where(real[:, t + 1, None], now / now.max(axis=1, keepdims=True), 1)
        expected = ahead * behind
        expected = expected / expected.sum(axis=2, keepdims=True) * real[:, :, None]
        wanted = np.zeros_like(moves)
        wanted[N_STATES] = expected[:, 0].sum(axis=0)
        for t in range(1, n):
            came, goes = ahead[:, t - 1], e[:, t] * behind[:, t]
            mass = ((came @ m[:N_STATES]) * goes).sum(axis=1, keepdims=True)
            wanted[:N_STATES] += m[:N_STATES] * ((came * (real[:, t, None] / mass)).T @ goes)
        miss = (truth - expected) * real[:, :, None]
        slope = np.zeros_like(weights)
        for i, view in enumerate(views):
            np.add.at(slope[i], view[real], miss[real])
        for x, (one, two), g in ((weights, steps[0], slope - PENALTY * weights * rows), (moves, steps[1], gold_moves - wanted - PENALTY * moves * rows)):
            g = g / rows
            one += 0.1 * (g - one)
            two += 0.01 * (g * g - two)
            x += RATE * (one / (1 - 0.9**turn)) / (np.sqrt(two / (1 - 0.99**turn)) + 1e-6)
    return weights, moves + fixed


def labelled_table(spark: SparkSession, rows: int = 420, seed: int = 3) -> DataFrame:
    """``text, spans array<struct<kind, start, stop>>``: made-up sentences that follow written forms
    of each kind, and numbers that are no personal data. About two in five hold none."""
    rng = random.Random(seed)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuvéäñ") for _ in range(rng.randint(1, 10)))
    name = lambda: "".join(rng.choice("abcdefghilmnoprst") for _ in range(rng.randint(3, 9)))
    byte = lambda: str(rng.randint(0, 255))
    top = lambda: rng.choice(["com", "org", "net", "de", "fr", "es"])
    pair = lambda: rng.choice(["()", "[]", "{}", "<>"])
    case = lambda t: rng.choice([t, t, t.upper(), t.title()])
    bracketed = lambda b: case(f"{name()} {b[0]}at{b[1]} {name()} {b[0]}dot{b[1]} {top()}")
    forms = {
        "email": [
            lambda: f"{name()}@{name()}.{top()}", lambda: f"{name()}.{d(2)}@{name()}{d(1)}.{name()}.{top()}",
            lambda: f"{name()} (at) {name()} (dot) {top()}", lambda: f"{name()} [at] {name()} [dot] {top()}",
            lambda: f"{name()} @ {name()} . {top()}", lambda: f"{name()}{d(2)} at {name()}{d(1)} dot {top()}",
            lambda: case(f"{name()} at {name()} dot {top()}"), lambda: case(f"{name()} at {name()} dot {top()}"), lambda: bracketed(pair()),
            lambda: case(f"{name()} dot {name()} at {name()} dot {top()}"), lambda: case(f"{name()} at {name()} dot {name()} dot {top()}")],
        "ip": [
            lambda: ".".join(byte() for _ in range(4)), lambda: "[.]".join(byte() for _ in range(4)),
            lambda: "(.)".join(byte() for _ in range(4)), lambda: " . ".join(byte() for _ in range(4))],
        "card": [
            lambda: d(16), lambda: " ".join(d(4) for _ in range(4)), lambda: "-".join(d(4) for _ in range(4)),
            lambda: ".".join(d(4) for _ in range(4)), lambda: "/".join(d(4) for _ in range(4)), lambda: f"{d(4)} {d(6)} {d(5)}", lambda: d(15)],
        "phone": [
            lambda: f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", lambda: f"+{d(2)} {d(3)} {d(7)}", lambda: f"({d(3)}) {d(3)}-{d(4)}",
            lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"0{d(3)}/{d(7)}", lambda: f"00{d(2)} {d(3)} {d(6)}", lambda: f"{d(3)}.{d(3)}.{d(4)}"],
    }
    plain = [
        lambda: f"20{d(2)}-0{d(1)}-1{d(1)}", lambda: f"1{d(1)}:{d(2)}", lambda: f"version {d(1)}.{d(1)}", lambda: f"v{d(1)}.{d(1)}.{d(2)}",
        lambda: f"${d(1)},{d(3)}.{d(2)}", lambda: f"{d(2)} %", lambda: d(4), lambda: d(6), lambda: f"page {d(3)}", lambda: f"{d(2)}.{d(2)}.20{d(2)}",
        lambda: f'token = "{"".join(rng.choice("0123456789abcdef") for _ in range(40))}"', lambda: f"ISBN 978-{d(1)}-{d(3)}-{d(5)}-{d(1)}",
        lambda: f"{d(3)} x {d(3)}", lambda: f"{d(1)},{d(3)},{d(3)}", lambda: f"{d(4)}-{d(4)}", lambda: f"{name()} at {name()}", lambda: case(f"{name()} at the {name()} dot"), lambda: f"{name()} dot at {name()}", lambda: f"@{name()}",
        lambda: f"CC BY-NC {d(1)}.{d(1)}", lambda: f"{d(2)}:{d(2)}:{d(2)}", lambda: f"#{d(5)}", lambda: f"{d(1)}.{d(5)}", lambda: f"{d(10)}", lambda: f"{d(13)}"]
    cues = {"email": ["mail", "e-mail:", "write to"], "ip": ["ip", "host", "server"], "card": ["card", "visa"], "phone": ["tel", "call", "phone:", "mobile"]}
    out = []
    for _ in range(rows):
        text, spans = "", []
        for part in range(rng.randint(1, 3)):
            for _ in range(rng.randint(0, 5)):
                w = word()
                text += (w.title() if rng.random() < 0.2 else w) + rng.choice([" ", " ", " ", ", ", ". "])
            if rng.random() < 0.6:
                kind = rng.choice(KINDS)
                if rng.random() < 0.5:
                    text += rng.choice(cues[kind]) + " "
                made = rng.choice(forms[kind])()
                spans.append((kind, len(text), len(text) + len(made)))
                text += made
            else:
                text += rng.choice(plain)()
            text += rng.choice([" ", ", ", ". ", " "])
        out.append((text + word(), spans))
    return spark.createDataFrame(out, "text string, spans array<struct<kind string, start int, stop int>>")


def fit(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Weights from ``labelled (text, spans)``: all of its rows, or the ``FIT_ROWS`` of least text hash."""
    classes, sequences = TokenClasses(), []
    drawn = labelled.where("text is not null").select("text", "spans").orderBy(F.xxhash64("text"), "text").limit(FIT_ROWS)
    for row in drawn.orderBy("text").collect():
        places, ids = tokenized(row["text"], 0, len(row["text"]), classes)
        gold = np.zeros(len(ids), dtype=np.int64)
        for span in row["spans"] or []:
            inside = [i for i, (a, b) in enumerate(places) if a >= span["start"] and b <= span["stop"]]
            for i in inside:
                gold[i] = 1 + 2 * KINDS.index(span["kind"]) + (i != inside[0])
        if len(ids):
            sequences.append((ids, gold))
    return train(sequences)


# ---------------------------------------------------------------- decoding

_TRIGGER = re.compile(r"[0-9@]|[(\[{<]\s*[Aa][Tt]\s*[)\]}>]|\b[Aa][Tt]\b(?=(?s:.){1,%d}?\b[Dd][Oo][Tt]\b)" % REACH)


def stretches(text: str) -> list[Span]:
    """What stands near a digit, an at sign or a spelled "at", in stretches that do not overlap."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = m.start(), m.end()
        if out and a - 2 * REACH <= out[-1][1] + 2 * REACH:
            out[-1][1] = b
        else:
            out.append([a, b])
    cut = []
    for a, b in out:
        a, b = max(0, a - REACH), min(len(text), b + REACH)
        # to the ends of words of ordinary length
        head, tail = max(0, a - REACH), min(len(text), b + REACH)
        while a > head and not text[a - 1].isspace():
            a -= 1
        while b < tail and not text[b].isspace():
            b += 1
        cut.append((a, b))
    return cut


def _plausible(kind: str, text: str) -> bool:
    digits = _digits(text)
    if kind == "email":
        return ("@" in text or re.search(r"(?i)\bat\b", text) is not None) and ("." in text or re.search(r"(?i)\bdot\b", text) is not None)
    if kind == "ip":
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(map(_small, parts))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 8 <= len(digits) <= 15


def _decoded(texts: list[str], weights: np.ndarray, moves: np.ndarray, classes: TokenClasses) -> list[list[tuple[int, int, int]]]:
    """Spans ``(kind, start, end)`` of each text that the field finds."""
    jobs = []
    for row, text in enumerate(texts):
        for a, b in stretches(text):
            places, ids = tokenized(text, a, b, classes)
            if places:
                jobs.append((len(ids), row, places, ids))
    jobs.sort(key=lambda j: j[0])
    out: list[list] = [[] for _ in texts]
    at = 0
    while at < len(jobs):
        # stretches of like length together, and not too many cells at once
        stop = at + 1
        while stop < len(jobs) and stop - at < 512 and jobs[stop][0] <= 1.3 * jobs[at][0] + 8 and jobs[stop][0] * (stop - at) < 200_000:
            stop += 1
        some = jobs[at:stop]
        lengths = np.array([j[0] for j in some])
        ids = np.zeros((len(some), lengths.max()), dtype=np.int64)
        for r, j in enumerate(some):
            ids[r, : j[0]] = j[3]
        e = _emissions(ids, weights)
        e[:, :, 1::2] -= CAUTION
        for (n, row, places, _), states in zip(some, viterbi(e, moves, lengths)):
            i = 0
            while i < n:
                if states[i] % 2:  # first token of a span
                    k, first = states[i] // 2, i
                    while i + 1 < n and states[i + 1] == 2 * k + 2:
                        i += 1
                    out[row].append((int(k), places[first][0], places[i][1]))
                i += 1
        at = stop
    return out


def all_spans(texts: list[str], weights: np.ndarray, moves: np.ndarray, classes: TokenClasses) -> tuple[list, list]:
    """Pattern spans of each text by kind, and all spans by kind."""
    base = [pattern_spans(t) for t in texts]
    both = []
    for text, own, more in zip(texts, base, _decoded(texts, weights, moves, classes)):
        kinds = [list(k) for k in own]
        taken = sorted(s for k in own for s in k)
        for k, a, b in more:
            if not any(x < b and a < y for x, y in taken) and _plausible(KINDS[k], text[a:b]):
                kinds[k].append((a, b))
        both.append([sorted(k) for k in kinds])
    return base, both


def _listed(kinds: list[list[Span]]) -> str:
    return ",".join(f"{name}:{a}:{b}" for name, spans in zip(KINDS, kinds) for a, b in spans)


def redacted(text: str, kinds: list[list[Span]]) -> str:
    """The text with each span replaced by its kind; of overlapping spans the first by place counts."""
    out, end = [], 0
    for a, b, name in sorted((a, b, name) for name, spans in zip(KINDS, kinds) for a, b in spans):
        if a >= end:
            out += [text[end:a], f"[{name.upper()}]"]
        end = max(end, b)
    return "".join(out) + text[end:]


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, redacted string"


def _finder(model, with_text: bool):
    def run(batches):
        weights, moves = model.value
        classes = TokenClasses()
        for batch in batches:
            whole = [t or "" for t in batch.column("text").to_pylist()]
            base, both = [], []
            for at in range(0, len(whole), 128):
                some_base, some_both = all_spans(whole[at : at + 128], weights, moves, classes)
                base += some_base
                both += some_both
            counts = [pa.array([len(b[k]) for b in base], pa.int64()) for k in range(len(KINDS))]
            columns = {n: batch.column(n) for n in batch.schema.names if n != "text"}
            columns |= {f"n_{kind}": c for kind, c in zip(KINDS, counts)}
            columns["base_sha256"] = pa.array([hashlib.sha256(_listed(b).encode()).hexdigest() for b in base])
            columns["spans"] = pa.array([_listed(b) for b in both])
            columns["n_added"] = pa.array([sum(map(len, x)) - sum(map(len, y)) for x, y in zip(both, base)], pa.int64())
            columns["redacted"] = pa.array([redacted(t, b) if with_text else None for t, b in zip(whole, both)], pa.string())
            yield pa.record_batch(columns)

    return run


def personal_data(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], with_text: bool = False) -> DataFrame:
    """Personal data of each row of ``docs (doc_id, text)``.

    Returns ``doc_id``, the number of pattern spans of each kind, ``base_sha256`` of the pattern
    spans, ``spans`` with those that the field adds, ``n_added``, and ``redacted``, the text with all
    spans replaced (null unless asked for). A null text is empty. Repeated rows are answered each;
    other columns are not read. Nothing is shuffled.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_finder(sent, with_text), "doc_id long, " + FOUND)


def without(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``docs`` (text, n_chars and any columns) with personal data replaced; null texts stay null.

    ``n_chars`` is counted again where there is such a column, in its own type. Empty texts and
    empty tables come back as they are, repeated rows each for itself; nothing is shuffled.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    counted = next((to_arrow_type(f.dataType) for f in docs.schema if f.name == "n_chars"), None)

    def run(batches):
        weights, moves = sent.value
        classes = TokenClasses()
        for batch in batches:
            new = []
            texts = batch.column("text").to_pylist()
            for at in range(0, len(texts), 128):
                some = texts[at : at + 128]
                _, both = all_spans([t or "" for t in some], weights, moves, classes)
                new += [None if t is None else redacted(t, b) for t, b in zip(some, both)]
            columns = {n: batch.column(n) for n in batch.schema.names}
            columns["text"] = pa.array(new, pa.string())
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in new], pa.int64()).cast(counted)
            yield pa.record_batch(columns)

    return docs.mapInArrow(run, docs.schema)

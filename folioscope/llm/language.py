"""Language identification by fusing evidence.

Three kinds of evidence are combined by Bayes' rule:

* the text: likelihood of its bytes under a trigram model of each language, P(byte | two before),
  mixed with the bigram, the unigram and the uniform model, and under the uniform model alone,
  which stands for "no language we know";
* what is declared: the markup (or metadata) language and the address suffix, by how often each
  value goes with each language, counted over all rows;
* where it comes from: a prior of the host, smoothed towards its domain, that towards its top-level
  domain, and that towards the whole table. Counts are grouped aggregations over all rows of the
  languages that the text alone suggests.

The likelihood of a text is tempered, since neighbouring trigrams are not independent, and
bounded, so that a long text does not drown the other evidence.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import small_side
from .tables import kept, unused

#: Most labelled texts of each language that the text model is fitted on; every language has a model.
FIT_ROWS = 400
UNKNOWN = "und"
#: Trigrams are looked up by a hash of so many bits.
SLOT_BITS = 18
#: Share of trigram, bigram, unigram and uniform model.
MIX = (0.85, 0.1, 0.04, 0.01)
#: Share of the log likelihood that counts, and the most that one text can say.
TEMPER, MOST = 0.1, 30.0
#: Rows by which each level of the host hierarchy leans on the one above, and of declared values.
LEAN = 5.0
#: Prior share of rows in no known language.
UNKNOWN_PRIOR = 0.01

_NONE = "\x00none"


#: Slots of a text that are looked up at once, which bounds memory for any text and number of languages.
LOOKED_UP = 4096


@dataclass(frozen=True)
class Model:
    """Languages, and for each trigram slot the languages that know it with log P(byte | two bytes before).

    Slots that no language knows are not held. ``starts[i]`` to ``starts[i + 1]`` are the entries of ``slots[i]``;
    ``gain`` is what an entry adds to the value of an unknown trigram, which is the same in all languages.
    """

    names: list[str]
    slots: np.ndarray
    starts: np.ndarray
    language: np.ndarray
    gain: np.ndarray

    def log_likelihood(self, slots: np.ndarray) -> np.ndarray:
        """Of a text with these trigram slots, for each language."""
        out = np.full(len(self.names), len(slots) * _UNSEEN)
        slots, counts = np.unique(slots, return_counts=True)
        at = np.minimum(np.searchsorted(self.slots, slots), max(0, len(self.slots) - 1))
        known = self.slots[at] == slots if len(self.slots) else np.zeros(len(slots), dtype=bool)
        at, counts = at[known], counts[known]
        for begin in range(0, len(at), LOOKED_UP):
            some, n = at[begin: begin + LOOKED_UP], counts[begin: begin + LOOKED_UP]
            sizes = self.starts[some + 1] - self.starts[some]
            before = np.cumsum(sizes) - sizes
            entries = np.arange(sizes.sum()) + np.repeat(self.starts[some] - before, sizes)
            out += np.bincount(self.language[entries], self.gain[entries] * np.repeat(n, sizes), len(self.names))
        return out


def fit(labelled: DataFrame) -> Model:
    """Text model of every language of ``labelled (text, language)``.

    A bounded sample is used: of each language the ``FIT_ROWS`` distinct texts of least hash. A hash
    threshold that follows the number of distinct texts, and lets all of up to twice ``FIT_ROWS`` through, comes
    before, so copies take no place and no large language is ordered as a whole. Trigrams are counted by the
    tasks that hold the texts; what comes to the driver is one row per language. Rows without text or
    language are left out.
    """
    rows = labelled.where("text is not null and language is not null and language != ''").withColumn("language", F.lower("language"))
    hashed = rows.select("language", "text", F.xxhash64("text").alias("h"))
    counts = hashed.groupBy("language", "h").agg(F.lit(1)).groupBy("language").agg(F.count("*").alias("n"))
    spread = 1 << 30
    limit = counts.select("language", F.least(F.lit(spread), F.floor(F.lit(2 * FIT_ROWS * spread) / F.col("n"))).alias("below"))
    drawn = hashed.join(small_side(limit), "language").where(F.pmod("h", F.lit(spread)) < F.col("below"))
    drawn = drawn.groupBy("language", "h").agg(F.min("text").alias("text"))
    place = Window.partitionBy("language").orderBy("h")
    drawn = drawn.withColumn("nth", F.row_number().over(place)).where(F.col("nth") <= FIT_ROWS)

    def counted(batches):
        for batch in batches:
            for name, text in zip(batch.column("language").to_pylist(), batch.column("text").to_pylist()):
                codes, n = np.unique(_trigrams(_bytes(text)), return_counts=True)
                yield pa.record_batch({"language": pa.array([name] * len(codes), pa.string()), "code": codes.astype(np.int32), "n": n.astype(np.int64)})

    def logged(table):
        slots, logs = _logs(table.column("code").to_numpy(), table.column("n").to_numpy())
        return pa.table({"language": table.column("language").slice(0, 1), "slots": pa.array([slots.tobytes()], pa.binary()), "gain": pa.array([logs.tobytes()], pa.binary())})

    sums = drawn.select("language", "text").mapInArrow(counted, "language string, code int, n long").groupBy("language", "code").agg(F.sum("n").alias("n"))
    found = sorted(sums.groupBy("language").applyInArrow(logged, "language string, slots binary, gain binary").collect())
    slots = [np.frombuffer(r["slots"], dtype=np.uint32) for r in found]
    gains = [np.frombuffer(r["gain"], dtype=np.float32) for r in found]
    if not found:
        none = np.zeros(0, dtype=np.uint32)
        return Model([], none, np.zeros(1, dtype=np.int64), none, none)
    languages = np.repeat(np.arange(len(found), dtype=np.uint32), [len(s) for s in slots])
    all_slots = np.concatenate(slots)
    order = np.argsort(all_slots, kind="stable")
    distinct, starts = np.unique(all_slots[order], return_index=True)
    return Model([r["language"] for r in found], distinct, np.append(starts, len(order)), languages[order], np.concatenate(gains)[order])


def _bytes(text: str) -> np.ndarray:
    """Bytes of the lower-cased text; whatever is no letter is a blank, and blanks do not repeat."""
    raw = np.frombuffer(b"  " + text.lower().encode("utf-8", "surrogatepass") + b" ", dtype=np.uint8)
    folded = _FOLD[raw]
    blank = folded == 32
    return folded[np.concatenate([[True, True], ~(blank[2:] & blank[1:-1])])]


def _fold() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[:128] = 32
    table[97:123] = np.arange(97, 123)
    return table


_FOLD = _fold()


def _slots(codes: np.ndarray) -> np.ndarray:
    """Hash of three bytes."""
    return (codes.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(32 - SLOT_BITS)


def _trigrams(b: np.ndarray) -> np.ndarray:
    wide = b.astype(np.uint32)
    return (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]


_UNSEEN = np.log(MIX[3] / 256)


def _logs(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of counted trigrams, and log P(byte | two before) above that of unseen ones."""
    order = np.argsort(codes)
    codes, counts = codes[order], counts[order]
    a, b, c = codes >> 16, (codes >> 8) & 255, codes & 255
    three, two, one = np.zeros((256, 256)), np.zeros((256, 256)), np.zeros(256)
    np.add.at(three, (a, b), counts)
    np.add.at(two, (b, c), counts)
    np.add.at(one, c, counts)
    p = (MIX[0] * counts / three[a, b] + MIX[1] * two[b, c] / two.sum(axis=1)[b] + MIX[2] * one[c] / one.sum() + MIX[3] / 256)
    slots, at = np.unique(_slots(codes), return_inverse=True)
    best = np.full(len(slots), -np.inf)
    np.maximum.at(best, at, np.log(p))
    return slots, (best - _UNSEEN).astype(np.float32)


def _scorer(model):
    def run(batches):
        fitted = model.value
        uniform = np.log(1 / 256)
        for batch in batches:
            out, lettered = [], []
            for text in batch.column("text").to_pylist():
                folded = _bytes(text or "")
                if len(folded) < 4 or not fitted.names:  # blanks only
                    out.append([0.0] * (len(fitted.names) + 1))
                    lettered.append(False)
                    continue
                lettered.append(True)
                total = fitted.log_likelihood(_slots(_trigrams(folded))) * TEMPER
                total = np.concatenate([total, [uniform * (len(folded) - 2) * TEMPER]])
                out.append(np.maximum(total - total.max(), -MOST).tolist())
            columns = {name: batch.column(name) for name in ("id", "declared", "suffix", "host")}
            yield pa.record_batch(columns | {"text_logs": pa.array(out, pa.list_(pa.float64())), "letters": pa.array(lettered, pa.bool_())})

    return run


def evidence_of_pages(pages: DataFrame) -> DataFrame:
    """``id, text, declared, suffix, host`` from ``pages (page_id, url, html)``.

    The declared language is the ``lang`` of the html element, the suffix the last label of the
    host if it is a country's, else a two-letter first folder of the path.
    """
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    last = F.regexp_extract(host, r"\.([a-z]{2})$", 1)
    folder = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([A-Za-z]{2})(?:[-_][A-Za-z]{2})?(?:[/?#]|$)", 1))
    bare = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return pages.select(
        F.col("page_id").cast("long").alias("id"),
        F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"&#?\w+;", " ").alias("text"),
        F.lower(F.regexp_extract("html", r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1)).alias("declared"),
        F.when(last != "", last).otherwise(folder).alias("suffix"), host.alias("host"))


def _value(column: str) -> Column:
    return F.when(F.col(column).isNull() | (F.col(column) == ""), F.lit(_NONE)).otherwise(F.col(column))


def _best(logs: Column, names: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in [*names, UNKNOWN]]), F.array_position(logs, F.array_max(logs)).cast("int"))


def identify(rows: DataFrame, model: Model) -> DataFrame:
    """Language of each row of ``rows (id, text, declared, suffix, host)``.

    Returns ``id, language, posterior, text_language, declared, suffix, host``, one row per input
    row. A text without letters, null or empty, is decided by the other evidence; where there is
    none of that either, by the whole table's prior. ``und`` means no known language. A missing
    declared value or suffix says nothing; a missing host has only the prior of the table. Ties go to the first language by name. Other columns are not read.
    """
    names = model.names
    spark = rows.sparkSession
    rows = rows.select(
        F.col("id").cast("long").alias("id"), "text", _value("declared").alias("declared"),
        _value("suffix").alias("suffix"), _value("host").alias("host"))
    scored = kept(rows.mapInArrow(
        _scorer(spark.sparkContext.broadcast(model)),
        "id long, declared string, suffix string, host string, text_logs array<double>, letters boolean"))
    labels = F.split(F.col("host"), r"\.")
    scored = scored.withColumn("text_language", _best(F.col("text_logs"), names)).withColumn(
        "domain", F.when(F.size(labels) > 1, F.concat_ws(".", F.slice(labels, -2, 2))).otherwise(F.col("host"))).withColumn(
        "top", F.element_at(labels, -1))
    # what the text alone suggests, counted once for every level; narrow rows, combined before they move
    told = scored.where("letters").groupBy("host", "domain", "top", "declared", "suffix", "text_language").agg(F.count("*").alias("n"))
    told = kept(told)
    everyone = [*names, UNKNOWN]
    whole = {r[0]: r[1] for r in told.groupBy("text_language").agg(F.sum("n")).collect()}  # one row per language
    total = sum(whole.values())
    prior = {x: (1 - UNKNOWN_PRIOR) * (whole.get(x, 0) + 1) / (total - whole.get(UNKNOWN, 0) + len(names)) for x in names}
    prior[UNKNOWN] = UNKNOWN_PRIOR

    def counts(*by: str) -> DataFrame:
        sums = [F.coalesce(F.sum(F.when(F.col("text_language") == x, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, x in enumerate(everyone)]
        return told.groupBy(*by).agg(*sums, F.sum("n").alias("n"))

    def leaned(above: list[Column]) -> Column:
        return F.array(*[(F.col(f"n{i}") + LEAN * p) / (F.col("n") + LEAN) for i, p in enumerate(above)])

    flat = [F.lit(prior[x]) for x in everyone]
    tops = counts("top").select("top", leaned(flat).alias("p_top"))
    domains = counts("top", "domain").join(tops, "top")
    domains = domains.select("top", "domain", leaned([F.col("p_top")[i] for i in range(len(everyone))]).alias("p_domain"))
    hosts = counts("top", "domain", "host").join(domains, ["top", "domain"])
    hosts = hosts.select("host", leaned([F.col("p_domain")[i] for i in range(len(everyone))]).alias("p_host"))

    def said(column: str) -> DataFrame:
        # P(value | language) up to a factor of the value: P(language | value) / P(language)
        return counts(column).select(column, F.array(*[
            F.log((F.col(f"n{i}") + LEAN * p) / (F.col("n") + LEAN) / p) for i, p in enumerate(flat)]).alias(f"log_{column}"))

    joined = scored.join(hosts, "host", "left").join(said("declared"), "declared", "left").join(said("suffix"), "suffix", "left")

    def part(i: int) -> Column:
        host = F.when(F.col("host") == _NONE, flat[i]).otherwise(F.coalesce(F.col("p_host")[i], flat[i]))
        told_by = [F.when(F.col(c) != _NONE, F.col(f"log_{c}")[i]) for c in ("declared", "suffix")]
        return F.col("text_logs")[i] + F.log(host) + sum(F.coalesce(x, F.lit(0.0)) for x in told_by)

    fused = joined.withColumn("logs", F.array(*[part(i) for i in range(len(everyone))])).withColumn("top_log", F.array_max("logs"))
    mass = F.aggregate("logs", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top_log")))
    shown = [F.when(F.col(c) != _NONE, F.col(c)).alias(c) for c in ("declared", "suffix", "host")]
    return fused.select("id", _best(F.col("logs"), names).alias("language"), (1 / mass).alias("posterior"), "text_language", *shown)


def known(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Rows of ``docs`` (doc_id, text, lang, source and any columns) in a language that it knows.

    ``lang`` is what is declared, ``source`` stands for the host. Only rows found to be in no known
    language by their text and by all evidence go; rows without letters stay, null and empty texts among them.
    Without a model, one is fitted on ``docs``, of every declared language. Rows equal in these four columns go or
    stay together. No rows: no result.
    """
    model = model or fit(docs.select("text", F.col("lang").alias("language")))
    row = unused(docs.columns, "__row")
    keyed = docs.withColumn(row, F.xxhash64("doc_id", "text", "lang", "source"))
    found = identify(keyed.select(
        F.col(row).alias("id"), "text", F.lower("lang").alias("declared"), F.lit(None).cast("string").alias("suffix"),
        F.col("source").alias("host")), model)
    nothing = (F.col("language") == UNKNOWN) & (F.col("text_language") == UNKNOWN)
    gone = found.where(nothing).select(F.col("id").alias(row)).distinct()
    return keyed.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])

"""Text expressions: tokens, titles, sections, chunks. All of them run inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK_TOKENS = 512
CHARS_PER_TOKEN = 4


def _accent_table() -> tuple[str, str]:
    """Letters that are one ASCII letter plus one mark, and the ASCII letters they fold to.

    Bare combining marks come last, without a counterpart, so ``translate`` deletes them.
    """
    accented, plain = [], []
    for code in range(0x00C0, 0x1F00):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) == 2 and parts[0].isascii() and parts[0].islower() and unicodedata.combining(parts[1]):
            accented.append(chr(code))
            plain.append(parts[0])
    marks = [chr(code) for code in range(0x0300, 0x0332)]
    return "".join(accented + marks), "".join(plain)


_ACCENTED, _PLAIN = _accent_table()


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fold(text: Column) -> Column:
    """Lower case without diacritics (``é`` becomes ``e``; ``ß`` stays)."""
    return F.translate(F.lower(text), _ACCENTED, _PLAIN)


def doc_tokens(text: Column) -> Column:
    """Index tokens: runs of letters and digits of the folded text."""
    return F.regexp_extract_all(fold(text), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))


def word_places(tokens: Column, mark: str, positions: bool) -> Column:
    """``n`` tokens and ``words``: term, tf [, positions] of each distinct one and of ``mark``, which stands once at the end.

    Tokens are sorted with their places, so equal ones are neighbours; no shuffle.
    """
    def runs(placed: Column) -> Column:
        starts = F.filter(
            F.transform(placed, lambda x, i: F.when((i == 0) | (x["t"] != F.get(placed, F.greatest(i - 1, F.lit(0)))["t"]), i)), lambda i: i.isNotNull())

        def words(first: Column) -> Column:
            def word(a: Column, k: Column) -> Column:
                n = F.coalesce(F.get(first, k + 1), F.size(placed)) - a
                own = [F.transform(F.slice(placed, a + 1, n), lambda x: x["i"]).alias("positions")] if positions else []
                return F.struct(F.get(placed, a)["t"].alias("term"), n.cast("long").alias("tf"), *own)
            return F.transform(first, word)

        return F.struct((F.size(placed) - 1).alias("n"), let(starts, words).alias("words"))

    marked = F.array_append(tokens, F.lit(mark))
    return let(F.sort_array(F.transform(marked, lambda t, i: F.struct(t.alias("t"), i.alias("i")))), runs)


def query_units(query: Column) -> Column:
    """Query words as arrays of index tokens; ``a_b`` is one unit of two adjacent tokens."""
    words = F.regexp_extract_all(query, F.lit(r"[A-Za-z0-9_]+"), F.lit(0))
    parts = F.transform(words, lambda w: F.filter(F.split(F.lower(w), "_+"), lambda p: p != ""))
    return F.filter(parts, lambda p: F.size(p) > 0)


def long_terms(query: Column, pattern: str, min_len: int) -> Column:
    """Distinct lower-case terms of at least ``min_len`` characters."""
    terms = F.regexp_extract_all(F.lower(query), F.lit(pattern), F.lit(0))
    return F.array_distinct(F.filter(terms, lambda t: F.length(t) >= min_len))


def crawl_terms(query: Column) -> Column:
    return long_terms(query, "[a-z]+", 4)


def boost_terms(query: Column) -> Column:
    return long_terms(query, "[a-z0-9]{4,}", 4)


def keyword_terms(query: Column) -> Column:
    return long_terms(query, r"(?U)\w+", 4)


def tokens_est(text: Column, minimum: int = 0) -> Column:
    """Rough token count: four characters make one token."""
    return F.greatest(F.lit(minimum), F.floor(F.length(text) / CHARS_PER_TOKEN)).cast("long")


def unix_lines(text: Column) -> Column:
    """Every line break a Unicode text may carry becomes one newline; a final one is cut."""
    breaks = r"\r\n|[\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"
    return F.regexp_replace(F.regexp_replace(text, breaks, "\n"), r"\n\z", "")


def lines(text: Column) -> Column:
    return F.split(unix_lines(text), "\n", -1)


_BREAKS = r"\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029"
_LINE, _BREAK, _GAP = rf"[^{_BREAKS}]*", rf"(?:\r\n|[{_BREAKS}])", rf"[\s&&[^{_BREAKS}]]+"


def section_title(text: Column) -> Column:
    """First heading (levels 1 to 4) among the first three lines, or an empty string."""
    heading = rf"\A(?:(?!#{{1,4}}{_GAP}){_LINE}{_BREAK}){{0,2}}#{{1,4}}{_GAP}({_LINE})"
    return F.left(F.trim(F.regexp_extract(text, heading, 1)), F.lit(80))


def page_title(text: Column, fallback: Column | None = None) -> Column:
    """First line without leading ``#`` marks, cut to 80 characters."""
    title = F.left(F.regexp_replace(F.regexp_extract(text, rf"\A({_LINE})", 1), r"^#+\s*", ""), F.lit(80))
    return title if fallback is None else F.when(text == "", fallback).otherwise(title)


def sections(text: Column) -> Column:
    """Split at headings of level 1 to 4 that stand outside fenced code.

    The text is cut at fence lines, so odd pieces are code. Their would-be headings are hidden
    behind a carriage return (none is left after line unification), the text is split at the
    visible ones, and the marks are taken out again. One linear pass, no shuffle.
    """
    def split_body(body: Column) -> Column:
        masked = F.array_join(
            F.transform(
                F.split(body, "(?dm)^```", -1),
                lambda piece, i: F.when(i % 2 == 1, F.replace(piece, F.lit("\n#"), F.lit("\n\r#"))).otherwise(piece),
            ),
            "```",
        )
        shielded = F.when(F.contains(body, F.lit("```")), masked).otherwise(body)
        return F.transform(
            F.split(shielded, "\n(?=#{1,4} )", -1), lambda s: F.replace(s, F.lit("\n\r#"), F.lit("\n#"))
        )

    return let(unix_lines(text), split_body)


def split_oversize(text: Column, limit: int) -> Column:
    """Pieces of at most ``limit`` characters, cut at the last newline before the limit if any."""
    pattern = rf"(?s)(.{{1,{limit}}}\z|.{{1,{limit - 1}}}(?=\n)|.{{{limit}}})\n*"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def pack_paragraphs(section: Column, max_tokens: int = CHUNK_TOKENS) -> Column:
    """Greedy packing of a section's paragraphs into chunks of about ``max_tokens``."""
    strip = r"^\s+|\s+$"
    paragraphs = F.filter(
        F.transform(F.split(section, r"\n\s*\n", -1), lambda p: F.regexp_replace(p, strip, "")), lambda p: p != ""
    )
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("done"), empty.alias("open"), F.lit(0).cast("long").alias("used"))

    def flushed(state: Column) -> Column:
        return F.when(F.size(state["open"]) > 0, F.concat(state["done"], F.array(F.array_join(state["open"], "\n\n")))).otherwise(state["done"])

    def step(state: Column, para: Column) -> Column:
        cost = tokens_est(para, 1)
        oversize = cost > max_tokens
        overflow = (F.size(state["open"]) > 0) & (state["used"] + cost > max_tokens)
        return (
            F.when(oversize, F.struct(
                F.concat(flushed(state), split_oversize(para, max_tokens * CHARS_PER_TOKEN)).alias("done"),
                empty.alias("open"), F.lit(0).cast("long").alias("used")))
            .when(overflow, F.struct(
                flushed(state).alias("done"), F.array(para).alias("open"), cost.alias("used")))
            .otherwise(F.struct(
                state["done"].alias("done"), F.array_append(state["open"], para).alias("open"),
                (state["used"] + cost).alias("used")))
        )

    return F.aggregate(paragraphs, start, step, flushed)


def chunk_text(text: Column, max_tokens: int = CHUNK_TOKENS) -> Column:
    """Heading-aware chunks of a page; sections that fit stay whole, larger ones are packed."""
    limit = max_tokens * CHARS_PER_TOKEN
    pieces = F.flatten(F.transform(
        sections(text),
        lambda s: F.when(F.length(s) <= limit, F.array(s)).otherwise(pack_paragraphs(s, max_tokens)),
    ))
    return let(pieces, lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(text)))

"""Main-text extraction as a chain of regular expressions over the page source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import guards
from .text import let

# Elements without running text, block elements, and character references.
SILENT = "script style noscript template svg form nav header footer aside iframe button select".split()
BLOCKS = (
    "p div section article main ul ol li table tr td th pre blockquote br hr h1 h2 h3 h4 h5 h6 dl dt dd figure figcaption title"
).split()
REFERENCES = [
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
    ("&copy;", "©"), ("&reg;", "®"), ("&middot;", "·"), ("&hellip;", "…"), ("&ndash;", "–"),
    ("&mdash;", "—"), ("&amp;", "&"),
]


def main_text(html: Column) -> Column:
    """Text of the article (or main, or body) without navigation, scripts and markup.

    Headings keep their level as leading ``#`` marks so the chunker can use them.
    """
    body = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    body = F.regexp_replace(body, rf"(?is)<({'|'.join(SILENT)})\b[^>]*>.*?</\1\s*>", "")
    def inside(tag: str, source: Column) -> Column:
        return F.nullif(F.regexp_extract(source, rf"(?is)<{tag}\b[^>]*>(.*)</{tag}\s*>", 1), F.lit(""))

    text = let(body, lambda b: F.coalesce(inside("article", b), inside("main", b), inside("body", b), b))
    for level in range(1, 5):
        text = F.regexp_replace(text, rf"(?i)<h{level}\b[^>]*>", "\n" + "#" * level + " ")
    text = F.regexp_replace(text, rf"(?i)</?({'|'.join(BLOCKS)})\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    for mark, char in REFERENCES:
        text = F.replace(text, F.lit(mark), F.lit(char))
    text = F.regexp_replace(text, r"[ \t\r]+", " ")
    text = F.regexp_replace(text, r" ?\n ?", "\n")
    text = F.regexp_replace(text, r"\n{2,}", "\n\n")
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def extract(html: Column) -> Column:
    """Main text of pages worth extracting, otherwise an empty string."""
    return F.when(guards.worth_extracting(html), main_text(html)).otherwise("")

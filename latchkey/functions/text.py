"""Text columns: tokens, normalisation, mark-up, sentences, stable ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from latchkey.functions import policy as P

SPLIT = "\u0001"


def tokenize(text: Column) -> Column:
    """Lower-cased tokens; parts joined by ``- _ .`` stay one token. Null gives null."""
    return F.regexp_extract_all(F.lower(text), F.lit(P.TOKEN), F.lit(0))


def normalise(text: Column) -> Column:
    """Line ends as LF, no-break spaces as spaces, no blanks before a line end, at most one empty line, trimmed."""
    t = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), " ", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")
    return strip(t)


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    """White space as single spaces, trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def html_to_text(html: Column) -> Column:
    """Text of a page: scripts and styles dropped, block tags as line ends, other tags as spaces, six entities decoded."""
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    t = F.regexp_replace(t, r"(?i)</?(p|div|br|li|h[1-6]|tr|section|article)[^>]*>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n\s*\n+", "\n\n")
    return strip(t)


def front_matter_strip(text: Column) -> Column:
    """A text that starts with ``---`` loses everything through the next ``---``."""
    end = F.locate("---", text, 4)
    return F.when(F.startswith(text, F.lit("---")) & (end > 0), strip(F.substring(text, end + 3, F.length(text)))).otherwise(text)


def roles(column: Column) -> Column:
    """Lower-cased, trimmed, distinct and sorted, without blanks."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(column, lambda r: F.lower(F.trim(r))), lambda r: r != "")))


def stable_id(prefix: str, text: Column, digits: int = 12) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, digits))


def sentences(text: Column) -> Column:
    """Sentence-like parts of at least twelve characters, without bullets, white space squeezed."""
    t = F.regexp_replace(text, r"\n(?:([-*\d#])|\n+)", SPLIT + "$1")
    t = F.regexp_replace(t, r"([.!?])\s+([A-Z0-9£$])", "$1" + SPLIT + "$2")
    parts = F.transform(F.split(t, SPLIT), lambda s: F.trim(F.regexp_replace(squeeze(s), r"^[-*#>\s]+", "")))
    return F.filter(parts, lambda s: F.length(s) >= 12)


def word_tokens(text: Column) -> Column:
    """Tokens of the query features."""
    return F.regexp_extract_all(F.lower(text), F.lit(P.WORD), F.lit(0))

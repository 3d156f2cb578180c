"""Text expressions shared by the jobs. All are built-in Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as the log writers see it: ASCII blanks, the Unicode separator
# classes and NEL.
BLANK = r"[\s\p{Z}\x{85}]"


def trim_all(c: Column) -> Column:
    """Trim every Unicode blank from both ends (``F.trim`` only strips U+0020)."""
    at_edge = F.substring(c, 1, 1).rlike(BLANK) | F.substring(c, -1, 1).rlike(BLANK)
    return F.when(at_edge, F.regexp_replace(c, rf"\A{BLANK}++|(?<!{BLANK}){BLANK}++\z", "")).otherwise(c)


def has_ink(c: Column) -> Column:
    """True where the text holds at least one non-blank character."""
    return c.rlike(r"[^\s\p{Z}\x{85}]")


def none_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def head_line(trimmed: Column) -> Column:
    """Text up to the first newline of an already trimmed value."""
    return F.substring_index(trimmed, "\n", 1)


def first_line(c: Column) -> Column:
    """First line of the trimmed text."""
    return head_line(trim_all(c))


def cut(c: Column, n: int) -> Column:
    """Keep ``n`` characters."""
    return F.substring(c, 1, n)


def ellipsize(c: Column, n: int) -> Column:
    """At most ``n`` characters in all, the last three being dots when cut."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 3), F.lit("..."))).otherwise(c)


def cut_with_dots(c: Column, n: int) -> Column:
    """``n`` characters and then dots when something was cut."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def escape_html(c: Column) -> Column:
    # The five replaced characters; the ampersand goes first.
    for raw, safe in (("&", "&amp;"), ("'", "&#39;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def contains_folded(c: Column, needle: str) -> Column:
    """Case-insensitive containment; an empty needle matches."""
    return F.contains(F.lower(c), F.lit(needle.lower()))


def snippet(c: Column, query: Column, max_len: int) -> Column:
    """Text around the first hit: 20 characters before, ``max_len - 20`` after it.

    ``query`` is in lower case. NULL where it does not occur. Lengths are
    characters.
    """
    hit = F.instr(F.lower(c), query) - 1
    start = F.greatest(hit - 20, F.lit(0))
    stop = F.least(hit + F.length(query) + (max_len - 20), F.length(c))
    body = F.replace(c.substr(start + 1, F.greatest(stop - start, F.lit(0))), F.lit("\n"), F.lit(" "))
    return F.when(
        hit >= 0,
        F.concat(
            F.when(start > 0, F.lit("...")).otherwise(F.lit("")),
            body,
            F.when(stop < F.length(c), F.lit("...")).otherwise(F.lit("")),
        ),
    )


def relevance(c: Column, query: str) -> Column:
    """Match score of a text, 0.0 where any query word is missing.

    Earlier hits and hits at the start of a word score higher; a query of one
    word weighs its length and position more than a query of several words.
    """
    words = query.strip().lower().split()
    text = F.lower(c)
    if not words:
        return F.when(c.isNotNull(), F.lit(0.0))
    single = len(words) == 1
    # Base 10, position window 100, divisor and word-start bonus
    # for one word (10, 10) and for several (20, 5).
    divisor, bonus = (10.0, 10.0) if single else (20.0, 5.0)
    total = F.lit(0.0)
    found = F.lit(True)
    for word in words:
        at = F.instr(text, word) - 1
        before = F.substring(text.substr(at, F.lit(1)), 1, 1)
        at_start = (at == 0) | before.rlike(r"[^A-Za-z0-9_]")
        total = (
            total
            + F.lit(10.0 + (len(word) if single else 0))
            + F.when(at < 100, (F.lit(100) - at) / F.lit(divisor)).otherwise(F.lit(0.0))
            + F.when(at_start, F.lit(bonus)).otherwise(F.lit(0.0))
        )
        found = found & (at >= 0)
    return F.when(c.isNull(), F.lit(0.0)).when(found, total).otherwise(F.lit(0.0))


def is_web_url(c: Column) -> Column:
    return c.rlike("(?i)^https?://")

"""Column functions on texts. Classes of characters are ASCII throughout, so that other engines give the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import CAPITALS, CUT, GENERIC_SUFFIX, HEADING, LEAD, LETTERS, POSSESSIVE, SECTION_PREFIXES, SECTIONS, WORDS

def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


def letters(text: Column) -> Column:
    """Words with their case, a possessive 's cut off."""
    return F.transform(F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0)), lambda w: F.regexp_replace(w, POSSESSIVE, ""))


def capitals(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CAPITALS), F.lit(0))


def body(text: Column, cut: list[str] = CUT) -> Column:
    """The text up to the first heading of cut."""
    return F.regexp_replace(text, r"(?s)\n\n\n(?:" + "|".join(cut) + r")\n.*$", "")


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def section(head: Column) -> Column:
    """The section that a heading opens, by the whole heading or else by its beginning; null: the heading of a part of the current one."""
    out = F.when(F.lit(False), head)
    for name, opens in SECTIONS.items():
        out = out.when(head == name, opens)
    for start, opens in SECTION_PREFIXES:
        out = out.when(head.startswith(start), opens)
    return out


def parts(text: Column) -> Column:
    """head, body of each stretch of a text between headings, in order; the first has the head LEAD."""
    marked = F.regexp_replace(F.concat(F.lit(f"\n\n\n{LEAD}\n"), F.translate(text, "\u0001\u0002", "")), HEADING, "\u0001$1\u0002")
    pieces = F.split(F.substring(marked, 2, 1 << 30), "\u0001")
    return F.transform(pieces, lambda p: F.struct(stripped(F.substring_index(p, "\u0002", 1)).alias("head"), F.element_at(F.split(p, "\u0002"), 2).alias("body")))


def blocks(text: Column) -> Column:
    """Lines of a text that are neither empty nor like headings: over 70 characters, or with an end mark."""
    lines = F.transform(F.split(text, "\n"), stripped)
    return F.filter(lines, lambda x: (F.length(x) > 70) | x.rlike("[.!?]$"))


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens joined by spaces; null where there are fewer."""
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(0), F.size(tokens) - n), lambda i: F.array_join(F.slice(tokens, i + 1, n), " ")))


def truncated(text: Column, n: int = 130) -> Column:
    """Cut at n characters and back to the last space, with an ellipsis."""
    return F.when(F.length(text) > n, F.concat(F.regexp_replace(F.substring(text, 1, n), " [^ ]*$", ""), F.lit("…"))).otherwise(text)


def prefix(text: Column, n: int = 160) -> Column:
    return F.substring(text, 1, n)


def clip(text: Column, term: Column | str, around: int = 170) -> Column:
    """A window around the first place of term; the first 2 * around characters if it has none."""
    at = F.locate(term, text) if isinstance(term, str) else F.position(term, text)
    start = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, text.substr(start, at + F.length(term if isinstance(term, Column) else F.lit(term)) + around - start)).otherwise(F.substring(text, 1, 2 * around))


def clipped(text: Column, term: Column, around: int = 170) -> Column:
    """As clip, with an ellipsis where the window leaves something out."""
    at = F.position(term, text)
    low, high = F.greatest(at - 1 - around, F.lit(0)), F.least(F.length(text), at - 1 + F.length(term) + around)
    window = F.concat(F.when(low > 0, "…").otherwise(""), text.substr(low + 1, high - low), F.when(high < F.length(text), "…").otherwise(""))
    return F.when(at > 0, window).otherwise(F.substring(text, 1, 2 * around))


def label(name: Column) -> Column:
    """Without a closing qualifier in parentheses."""
    return F.regexp_replace(name, r"\s*\([^()]*\)$", "")


def shown_label(name: Column) -> Column:
    """Without a closing qualifier, if it is a generic one."""
    return F.regexp_replace(name, GENERIC_SUFFIX, "")


def qualifier(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"\(([^()]+)\)$", 1), F.lit(""))


def title(link: Column) -> Column:
    """A link's target without its fragment, underscores as spaces, the first letter upper-case."""
    t = F.trim(F.translate(F.substring_index(link, "#", 1), "_", " "))
    return F.concat(F.upper(F.substring(t, 1, 1)), t.substr(F.lit(2), F.length(t)))

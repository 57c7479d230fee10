"""String expressions with Python-like semantics, all inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantia.functions.bind import once

# Whitespace as str.strip() sees it.
SPACES = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)])
) + "\u2028\u2029\u202f\u205f\u3000"


def strip_space(c: Column) -> Column:
    """Remove leading and trailing whitespace; only the ends of the text are read."""
    return F.btrim(c, F.lit(SPACES))


def rstrip_space(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACES))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_filled(*columns: Column) -> Column:
    """First value that is neither null nor an empty string."""
    return F.coalesce(*[blank_to_null(c) for c in columns[:-1]], columns[-1])


def word_count(c: Column) -> Column:
    """Number of whitespace-separated words; 0 for a blank text."""
    return F.regexp_count(c, F.lit(r"[^\s\x1C-\x1F\x85\p{Z}]+"))


def folded(c: Column) -> Column:
    """Lower case, with the letters that a case-blind pattern takes for ASCII ones (long s, Kelvin sign, dotless and dotted i) as those."""
    return F.lower(F.translate(c, "\u017f\u212a\u0131\u0130", "skii"))


def ignoring_case(pattern: str) -> str:
    """Case-insensitive, Unicode classes and boundaries, "." stops at \\n only."""
    return f"(?iUd){pattern}"


def contains_any(c: Column, needles: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(n) for n in needles])


def count_present(c: Column, needles: Iterable[str]) -> Column:
    """How many of the needles occur in the text at least once."""
    return reduce(lambda a, b: a + b, [c.contains(n).cast("int") for n in needles])


def title_case(c: Column) -> Column:
    """Upper-case each letter that follows a non-letter, lower-case the rest.

    initcap() only looks at blanks ("node.js" -> "Node.js"); here every
    non-letter starts a new word ("Node.Js").
    """

    def cased(chars: Column) -> Column:
        return F.transform(
            chars,
            lambda ch, i: F.when(
                (i > 0) & F.get(chars, i - 1).rlike(r"\p{L}"), F.lower(ch)
            ).otherwise(F.upper(ch)),
        )

    return F.array_join(once(F.split(c, ""), cased), "")


def truncate_text(c: Column, max_chars: int = 600) -> Column:
    """Cut long texts, drop blanks at the cut and mark it with an ellipsis."""
    return F.when(
        F.length(c) > max_chars,
        F.concat(rstrip_space(F.substring(c, 1, max_chars)), F.lit("...")),
    ).otherwise(c)

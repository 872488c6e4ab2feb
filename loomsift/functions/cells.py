"""Column expressions on the text of a table cell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that mean that there is no value, in lower case.
MISSING_MARKERS = ("n/a", "na", "n.a.", "-", "--", "null", "none", "nil", "nan", "undefined", "?")
#: White space of the page model: ASCII, no-break space, byte order mark, Unicode spaces.
SPACE = r"[\s ﻿  -     　]"
_NUMBER = r"^[-+]?(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?|\.\d+)$"
PLACEHOLDER = r"\[\[PII:[A-Z_]+:\d+:[0-9a-f]*\]\]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), f"^{SPACE}+|{SPACE}+$", "")


def cell_text(text: Column | str) -> Column:
    """White space collapsed to single spaces, none at the ends."""
    return trimmed(F.regexp_replace(_col(text), f"{SPACE}+", " "))


def is_missing(text: Column | str) -> Column:
    """Null, blank, or one of the closed list of markers in any case."""
    t = F.lower(cell_text(text))
    return t.isNull() | (t == "") | t.isin(*MISSING_MARKERS)


def has_placeholder(text: Column | str) -> Column:
    return _col(text).rlike(PLACEHOLDER)


def parse_number(text: Column | str, signed_parentheses: bool = True) -> Column:
    """A number in one of two unambiguous shapes, else null: digits grouped by commas, or plain.

    One leading plus or currency sign and a trailing percent sign are taken off (a percentage isn't
    divided). Parentheses negate what they hold, so "(-5)" is 5; with `signed_parentheses` off, a
    sign inside parentheses gives null instead.
    """
    t = trimmed(text)
    wrapped = t.rlike(r"^\(.*\)$")
    inner = F.when(wrapped, F.regexp_extract(t, r"^\((.*)\)$", 1)).otherwise(t)
    bare = trimmed(F.regexp_replace(F.regexp_replace(inner, f"^[+$£€¥₹]{SPACE}*", ""), f"{SPACE}*%$", ""))
    fits = bare.rlike(_NUMBER)
    if not signed_parentheses:
        fits = fits & ~(wrapped & bare.rlike("^[-+]"))
    value = F.regexp_replace(bare, ",", "").try_cast("double")
    signed = F.when(wrapped, -value).otherwise(value)
    return F.when(fits & (F.abs(value) < float("inf")), signed)


def column_kind(filled: Column | str, redacted: Column | str, numeric: Column | str, distinct: Column | str) -> Column:
    """The kind of a column from its counts of filled, redacted and numeric cells and of distinct texts."""
    filled, redacted, numeric, distinct = map(_col, (filled, redacted, numeric, distinct))
    open_cells = filled - redacted
    return (
        F.when(filled == 0, "unknown")
        .when(redacted == filled, "redacted")
        .when(numeric >= open_cells * 0.8, "numeric")
        .when((distinct > 0) & (distinct <= F.greatest(F.lit(2.0), open_cells / 4)), "categorical")
        .otherwise("unknown")
    )

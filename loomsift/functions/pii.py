"""Rules for personal data in text: patterns, validators and counts as column expressions.

Word boundaries are those of ASCII words, whatever letters stand beside a number.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A pattern with ASCII boundaries written as `\\b`; validated is the confidence behind a passed check."""

    kind: str
    name: str
    pattern: str
    confidence: float
    check: str | None = None
    validated: float | None = None
    #: What every match holds: a text without it needs no scan.
    needs: str = "[0-9]"


#: Kinds, names, patterns and confidences, in the order in which rules run.
RULES = (
    Rule("email", "email-rfc-lite", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", 0.93, needs="@"),
    Rule("credit-card", "luhn-credit-card", r"\b(?:\d[ -]?){12,18}\d\b", 0.35, "luhn", 0.97),
    Rule("aadhaar", "verhoeff-aadhaar", r"\b[2-9]\d{3}[ -]?\d{4}[ -]?\d{4}\b", 0.40, "verhoeff", 0.97),
    Rule("pan", "pan-format", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", 0.50, "pan", 0.94),
    Rule("ifsc", "ifsc-format", r"\b[A-Z]{4}0[A-Z0-9]{6}\b", 0.88),
    Rule("passport", "passport-in", r"\b[A-PR-WY][0-9]{7}\b", 0.55),
    Rule("ssn", "ssn-us", r"\b\d{3}-\d{2}-\d{4}\b", 0.50, "ssn", 0.93),
    Rule("phone", "phone-in-e164", r"(?:\+91[ -]?)?\b[6-9]\d{9}\b", 0.82),
    Rule("phone", "phone-intl", r"\+\d{1,3}[ -]?\(?\d{2,4}\)?[ -]?\d{3,4}[ -]?\d{3,4}", 0.70),
    Rule("ip-address", "ipv4", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", 0.40, "ipv4", 0.85),
    Rule("api-key", "api-key-prefixed", r"\b(?:sk|pk|rk)-[A-Za-z0-9_-]{16,}\b|\bghp_[A-Za-z0-9]{20,}\b|\bAKIA[0-9A-Z]{16}\b", 0.95, needs="sk-|pk-|rk-|ghp_|AKIA"),
    Rule("dob", "date-dmy", r"\b(?:0?[1-9]|[12]\d|3[01])[/-](?:0?[1-9]|1[0-2])[/-](?:19|20)\d{2}\b", 0.45),
    Rule("bank-account", "account-long-digits", r"\b\d{9,18}\b", 0.30),
)
#: Kinds of personal data.
KINDS = ("password", "otp", "api-key", "credit-card", "cvv", "bank-account", "ifsc", "aadhaar", "pan", "passport", "ssn", "email", "phone", "person-name", "postal-address", "dob", "ip-address", "face", "signature", "id-document", "unknown-sensitive")
#: Letters in fourth place of a PAN that name a holder's type.
PAN_HOLDERS = "ABCFGHJLPT"
#: Text that some rule could match; the others need no scan.
ANY_RULE = "|".join(dict.fromkeys(r.needs for r in RULES))


def java_pattern(rule: Rule) -> str:
    """The pattern with ASCII boundaries for the JVM's engine, whose own \\b counts other letters.

    A boundary that opens an alternative stands before a word character, one that closes it behind one.
    """
    closed = re.sub(r"\\b(?=\||$)", r"(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])", rule.pattern)
    return closed.replace(r"\b", "(?<![A-Za-z0-9_])")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def digits_of(value: Column | str) -> Column:
    return F.regexp_replace(_col(value), "[^0-9]", "")


def _digits(text: Column) -> Column:
    """Digits as an array of numbers, the last first."""
    return F.transform(F.split(F.reverse(text), ""), lambda d: d.try_cast("int"))


def luhn(value: Column | str) -> Column:
    """12 to 19 digits whose weighted sum is a multiple of ten."""
    text = digits_of(value)
    total = F.aggregate(F.transform(_digits(text), lambda d, i: F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)), F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0)))
    return F.length(text).between(12, 19) & (total % 10 == 0)


def _dihedral(a: Column, b: Column) -> Column:
    """Product in the group of the pentagon's symmetries: 0 to 4 rotate, 5 to 9 reflect."""
    turn = F.when(a < 5, (a + b) % 5).otherwise((a - b + 5) % 5)
    return turn + F.when((a < 5) == (b < 5), 0).otherwise(5)


def verhoeff_product(a: int, b: int) -> int:
    """The group's product for numbers."""
    return ((a + b) % 5 if a < 5 else (a - b) % 5) + (0 if (a < 5) == (b < 5) else 5)


#: The permutation that Verhoeff's check applies once a place.
VERHOEFF_STEP = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)


def verhoeff_powers() -> list[list[int]]:
    """The permutation applied 0 to 7 times."""
    rows = [list(range(10))]
    for _ in range(7):
        rows.append([VERHOEFF_STEP[x] for x in rows[-1]])
    return rows


def verhoeff(value: Column | str) -> Column:
    """Twelve digits whose dihedral checksum is zero."""
    text = digits_of(value)
    powers = F.array(*[F.lit(x) for row in verhoeff_powers() for x in row])
    moved = F.transform(_digits(text), lambda d, i: F.get(powers, (i % 8) * 10 + d))
    total = F.aggregate(moved, F.lit(0), lambda a, d: _dihedral(a, F.coalesce(d, F.lit(0))))
    return (F.length(text) == 12) & (total == 0)


def pan(value: Column | str) -> Column:
    return F.upper(_col(value)).rlike(f"^[A-Z]{{3}}[{PAN_HOLDERS}][A-Z][0-9]{{4}}[A-Z]$")


def ssn(value: Column | str) -> Column:
    """Nine digits of an area, group and serial that are issued."""
    return digits_of(value).rlike(r"^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$")


def ipv4(value: Column | str) -> Column:
    return _col(value).rlike(r"^(?:(?:0{0,2}[0-9]|0?[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])(?:\.(?!$)|$)){4}$")


CHECKS = {"luhn": luhn, "verhoeff": verhoeff, "pan": pan, "ssn": ssn, "ipv4": ipv4}


def matches(text: Column | str, rule: Rule) -> Column:
    """All matches of a rule that pass its check, in order."""
    found = F.regexp_extract_all(_col(text), F.lit(java_pattern(rule)), F.lit(0))
    return F.filter(found, CHECKS[rule.check]) if rule.check else found


def char_class(value: Column | str) -> Column:
    """numeric, alpha, alphanumeric, mixed, or unknown if empty."""
    v = _col(value)
    return F.when(v == "", "unknown").when(v.rlike("[^a-zA-Z0-9]"), "mixed").when(v.rlike("[0-9]") & v.rlike("[a-zA-Z]"), "alphanumeric").when(v.rlike("[0-9]"), "numeric").when(v.rlike("[a-zA-Z]"), "alpha").otherwise("unknown")


def preserved_shape(value: Column | str) -> Column:
    """What may be told of a redacted value: struct(length, char_class)."""
    v = _col(value)
    return F.struct(F.length(v).cast("long").alias("length"), char_class(v).alias("char_class"))


def fnv1a(text: Column | str) -> Column:
    """32-bit FNV-1a over UTF-16 code units, as eight hex digits."""
    raw = F.hex(F.encode(_col(text), "UTF-16BE"))
    units = F.transform(F.sequence(F.lit(0), (F.length(raw) / 4).cast("int") - 1), lambda i: F.conv(F.substring(raw, i * 4 + 1, F.lit(4)), 16, 10).cast("long"))
    mixed = F.aggregate(F.when(F.length(raw) >= 4, units).otherwise(F.array().cast("array<bigint>")), F.lit(2166136261).cast("long"), lambda h, u: (h.bitwiseXOR(u) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.lpad(F.lower(F.hex(mixed)), 8, "0")


def salted_hash(value: Column | str, salt: Column | str) -> Column:
    return fnv1a(F.concat(F.lit(salt) if isinstance(salt, str) else salt, F.lit(":"), _col(value)))

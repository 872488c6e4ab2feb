"""Spans of personal data in texts, their redaction, and the check that none is left.

A span has kind, rule, start and end in code points (end exclusive), and a confidence. All steps are
column expressions on one row: matches are found with their gaps, so positions are running sums, and
overlaps are resolved in the array of one text. No row meets another, so keys may repeat or be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsift.functions import pii
from loomsift.functions.cells import PLACEHOLDER

SPAN = "array<struct<kind:string,rule:string,start:bigint,end:bigint,confidence:double>>"
#: What is done with a kind that isn't named here is a placeholder.
STRATEGIES = {"password": "drop-attribute", "otp": "drop-attribute", "cvv": "drop-attribute", "face": "blur", "signature": "blackout", "id-document": "blackout"}


#: Items that running sums take at once, whose sums are then added up; characters of a run of a text.
_RUN, _CHARS = 128, 1024
#: A character that marks matches, and what stands for it in texts meanwhile; neither is a part of any rule's match, nor a word's.
_MARK, _OTHER = "\x01", "\x02"


def let(value: Column, body) -> Column:
    """`body` of the value, which is written, and computed, once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, step=lambda a, b: a + b, first: int = 0) -> Column:
    """Running sums of an array of whole numbers, or what else `step` gives. Work grows with the array's length, times a constant."""
    # An array that grows item by item, and its last value.
    start = F.struct(F.lit(first).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))
    grow = lambda a, n: F.struct(step(a["at"], n).alias("at"), F.concat(a["out"], F.array(step(a["at"], n))).alias("out"))
    shift = lambda a, r: F.struct(step(a["at"], r["at"]).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
    add = lambda x: F.transform(x["r"]["out"], lambda v: step(v, x["b"]))

    def in_runs(n: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.ceil(F.size(n) / _RUN).cast("int") - 1), lambda i: F.aggregate(F.slice(n, i * _RUN + 1, F.lit(_RUN)), start, grow))
        joined = let(runs, lambda r: F.flatten(F.transform(F.arrays_zip(r.alias("r"), F.aggregate(r, start, shift)["out"].alias("b")), add)))
        return F.when(F.size(n) > _RUN, joined).otherwise(F.aggregate(n, start, grow)["out"])

    return let(values, in_runs)


def pieces(text: Column, spots: Column) -> Column:
    """The parts of a text between spots, structs with start and end in order and apart, and the part behind the last.

    The text is cut into runs once, so that a part is found without reading all that stands before it.
    """

    def part(runs: Column, low: Column, high: Column) -> Column:
        at, to = F.floor(low / _CHARS).cast("int"), F.floor(high / _CHARS).cast("int")
        held = F.array_join(F.slice(runs, at + 1, to - at + 1), "")
        return F.when(high > low, F.substring(held, (low - at * _CHARS + 1).cast("int"), (high - low).cast("int"))).otherwise("")

    def cut(runs: Column) -> Column:
        zero = F.lit(0).cast("bigint")
        lows = F.concat(F.array(zero), F.transform(spots, lambda s: s["end"].cast("bigint")))
        highs = F.concat(F.transform(spots, lambda s: s["start"].cast("bigint")), F.array(F.length(text).cast("bigint")))
        return F.transform(F.arrays_zip(lows.alias("low"), highs.alias("high")), lambda x: part(runs, x["low"], x["high"]))

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHARS}}}"), F.lit(0)), cut)


def spliced(text: Column, entries: Column, put) -> Column:
    """The text with `put` of each entry, in order and apart, in its place."""
    between = lambda parts: F.array_join(F.flatten(F.transform(F.arrays_zip(parts.alias("p"), entries.alias("e")), lambda x: F.array(x["p"], F.when(x["e"].isNotNull(), put(x["e"])).otherwise("")))), "")
    return F.when(F.size(entries) > 0, let(pieces(text, entries), between)).otherwise(text)


def _passes(rule: Column, hit: Column) -> Column:
    """Does a match pass the check of its rule, given by number?"""
    ok = F.lit(True)
    for i, r in enumerate(pii.RULES):
        if r.check:
            ok = F.when(rule == i, pii.CHECKS[r.check](hit)).otherwise(ok)
    return F.coalesce(ok, F.lit(False))


def text_spans(text: Column | str, min_confidence: float = 0.0) -> Column:
    """All spans of a text that pass their rule's check, rule by rule, overlaps and all; none for a null text.

    A match that fails its check still uses up its characters.
    """
    text = F.col(text) if isinstance(text, str) else text
    confidence = [float(r.validated if r.check else r.confidence) for r in pii.RULES]
    rules = [(i, r, pii.java_pattern(r)) for i, r in enumerate(pii.RULES) if confidence[i] >= min_confidence]
    none = F.array().cast(SPAN)
    if not rules:
        return none
    of_rule = lambda values, x: F.element_at(F.array(*[F.lit(v) for v in values]), x["r"] + 1)

    def placed(x: Column) -> Column:
        """Of the parts of a text, gaps and matches of one rule in turn, the matches as spans."""
        ends = F.arrays_zip(x["parts"].alias("hit"), running(F.transform(x["parts"], lambda p: F.length(p).cast("bigint"))).alias("end"))
        span = lambda m: F.struct(of_rule([r.kind for r in pii.RULES], x).alias("kind"), of_rule([r.name for r in pii.RULES], x).alias("rule"), (m["end"] - F.length(m["hit"])).cast("bigint").alias("start"), m["end"].alias("end"), of_rule(confidence, x).alias("confidence"))
        return F.transform(F.filter(ends, lambda m, i: (i % 2 == 1) & _passes(x["r"], m["hit"])), span)

    def found(t: Column) -> Column:
        parts = lambda p: F.split(F.regexp_replace(t, p, f"{_MARK}$0{_MARK}"), _MARK, -1)
        hits = F.array(*[F.when(t.rlike(r.needs), F.struct(F.lit(i).alias("r"), parts(p).alias("parts"))) for i, r, p in rules])
        return F.coalesce(F.when(t.rlike(pii.ANY_RULE), F.flatten(F.transform(F.filter(hits, lambda x: F.size(x["parts"]) > 1), placed))), none)

    return let(F.replace(text, F.lit(_MARK), F.lit(_OTHER)), found)


def resolve_overlaps(spans: Column | str) -> Column:
    """The spans of one text without overlaps: the more confident, then the longer, then the earlier wins.

    Spans that reach into each other, directly or by others, form a cluster, in which they are
    compared; so the work grows with the clusters.
    """
    spans = F.col(spans) if isinstance(spans, str) else spans
    none = F.array().cast(SPAN)
    free = lambda kept, s: ~F.exists(kept, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"]))
    best = lambda s: F.struct((-s["confidence"]).alias("c"), (s["start"] - s["end"]).alias("l"), s["start"].alias("s"), s["rule"].alias("r"), s.alias("span"))
    first = lambda s: F.struct(s["start"].alias("s"), s["end"].alias("e"), s["rule"].alias("r"), s.alias("span"))
    ordered = lambda items, by: F.transform(F.array_sort(F.transform(items, by)), lambda x: x["span"])

    def settled(cluster: Column) -> Column:
        kept = F.aggregate(ordered(cluster, best), none, lambda acc, s: F.when(free(acc, s), F.concat(acc, F.array(s))).otherwise(acc))
        return F.when(F.size(cluster) > 1, ordered(kept, first)).otherwise(cluster)

    def clusters(every: Column) -> Column:
        reach = running(F.transform(every, lambda s: s["end"]), F.greatest, -1)
        begins = lambda r: F.filter(F.transform(every, lambda s, i: F.when((i == 0) | (s["start"] >= F.get(r, i - 1)), i)), lambda i: i.isNotNull())
        parts = lambda b: F.transform(b, lambda i, k: F.slice(every, i + 1, F.coalesce(F.get(b, k + 1), F.size(every)) - i))
        return let(let(reach, begins), parts)

    return F.flatten(F.transform(let(ordered(spans, first), clusters), settled))


def found_spans(texts: DataFrame, key: str, text: str, min_confidence: float = 0.0) -> DataFrame:
    """(key, kind, rule, start, end, confidence) of every match that passes its rule's check, of every row."""
    return texts.select(F.col(key).alias("key"), F.explode(text_spans(text, min_confidence)).alias("s")).select("key", "s.*")


def scan_texts(texts: DataFrame, key: str, text: str, min_confidence: float = 0.0) -> DataFrame:
    """(key, spans) of each row whose text has any, overlaps resolved; the threshold comes before."""
    # As one item to explode, since a condition on a column would move to below it and find all spans once more.
    whole = F.explode(F.array(resolve_overlaps(text_spans(text, min_confidence))))
    return texts.select(F.col(key).alias(key), whole.alias("spans")).where(F.size("spans") > 0)


def kind_token(kind: Column) -> Column:
    return F.upper(F.replace(kind, F.lit("-"), F.lit("_")))


def placeholder(kind: Column, ordinal: Column, nonce: str) -> Column:
    return F.concat(F.lit("[[PII:"), kind_token(kind), F.lit(":"), ordinal.cast("string"), F.lit(f":{nonce}]]"))


def strip_forgeries(text: Column | str) -> Column:
    """Without placeholders that the text brought along."""
    return F.regexp_replace(text, PLACEHOLDER, "")


def count_forgeries(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(PLACEHOLDER)), F.lit(0))


def drop_foreign_placeholders(text: Column | str, nonce: str) -> Column:
    return F.regexp_replace(text, rf"\[\[PII:[A-Z_]+:\d+:(?!{nonce}\]\])[0-9a-f]*\]\]", "")


def strategy_for(kind: Column, has_rect: Column, in_span: Column, attr: Column, strategies: dict[str, str] | None = None) -> Column:
    """What is done with a detection: the kind's intent, fitted to where it is."""
    table = STRATEGIES | (strategies or {})
    intent = F.coalesce(*[F.when(kind == k, v) for k, v in table.items()], F.lit("placeholder"))
    return (
        F.when(intent.isin("blur", "blackout", "pixelate"), F.when(has_rect, intent).otherwise("placeholder"))
        .when(in_span, F.when(intent == "mask-chars", intent).otherwise("placeholder"))
        .when(attr == "value", F.when(intent == "placeholder", intent).otherwise("drop-attribute"))
        .when(attr.isNotNull(), "placeholder")
        .when(intent == "remove-node", intent)
        .when(kind.isin("face", "signature", "id-document") & has_rect, "blackout")
        .otherwise("placeholder")
    )


def redact_texts(texts: DataFrame, key: str, text: str, nonce: str = "0", min_confidence: float = 0.5, strategies: dict[str, str] | None = None, name: str = "redaction") -> DataFrame:
    """All columns of `texts` with the text redacted, and the struct `name`: n, forgeries, by_kind, entries.

    Forged placeholders go first. Spans at or over the threshold become placeholders numbered per
    kind from the right, or asterisks where the kind's strategy is mask-chars. A null text stays null.
    Rows are redacted one by one, whatever their key. A column of `texts` called `name` gives way.
    """
    row = F.struct(F.lit(0).alias("none"), *[texts[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(texts.columns) if c != text])
    mask = [k for k, v in (strategies or {}).items() if v == "mask-chars"]

    def put(e: Column) -> Column:
        stars = F.repeat(F.lit("*"), (e["end"] - e["start"]).cast("int"))
        return F.when(e["kind"].isin(*mask), stars).otherwise(placeholder(e["kind"], e["ordinal"], nonce)) if mask else placeholder(e["kind"], e["ordinal"], nonce)

    def numbered(every: Column) -> Column:
        """With their numbers: of a kind's spans the last has 1. Kinds are few, so each counts along all spans once."""
        kinds = F.array_distinct(F.transform(every, lambda s: s["kind"]))
        counts = F.transform(kinds, lambda k: running(F.transform(every, lambda s: F.when(s["kind"] == k, 1).otherwise(0).cast("bigint"))))
        ordinal = lambda x, s, i: let(F.get(x["counts"], F.array_position(x["kinds"], s["kind"]).cast("int") - 1), lambda c: F.element_at(c, -1) - F.get(c, i) + 1)
        return let(F.struct(kinds.alias("kinds"), counts.alias("counts")), lambda x: F.transform(every, lambda s, i: F.struct(s["kind"].alias("kind"), s["rule"].alias("rule"), s["start"].alias("start"), s["end"].alias("end"), ordinal(x, s, i).cast("int").alias("ordinal"))))

    def done(clean: Column) -> Column:
        held = F.filter(resolve_overlaps(text_spans(clean)), lambda s: s["confidence"] >= min_confidence)
        told = lambda n: F.transform(n, lambda e: F.struct(e["kind"].alias("kind"), e["rule"].alias("rule"), e["start"].alias("start"), e["end"].alias("end"), put(e).alias("put")))
        entries = let(let(held, numbered), told)
        return let(entries, lambda e: F.struct(spliced(clean, e, lambda x: x["put"]).alias("text"), e.alias("entries")))

    # What may raise duplicates of a long expression stands behind a bound variable.
    found = texts.select(row.alias("row"), count_forgeries(F.col(text)).alias("forged"), let(strip_forgeries(F.col(text)), done).alias("done"))

    def info(entries: Column, forged: Column) -> Column:
        kinds = F.array_distinct(F.transform(entries, lambda e: e["kind"]))
        by_kind = let(kinds, lambda k: F.map_from_arrays(k, F.transform(k, lambda one: F.size(F.filter(entries, lambda e: e["kind"] == one)).cast("long"))))
        return F.struct(F.size(entries).cast("long").alias("n"), F.coalesce(forged, F.lit(0)).cast("long").alias("forgeries"), by_kind.alias("by_kind"), entries.alias("entries"))

    whole = let(F.struct("done", "forged"), lambda d: F.struct(d["done"]["text"].alias("text"), info(d["done"]["entries"], d["forged"]).alias("info"))).alias("whole")
    told = found.select("row", whole)
    back = [F.col("whole.text").alias(c) if c == text else F.col(f"row.c{i}").alias(c) for i, c in enumerate(texts.columns) if c.lower() != name.lower()]
    return told.select(*back, F.col("whole.info").alias(name))


#: Elements whose tags in a text that leaves show that markup got through.
MARKUP_TAGS = ("html", "body", "head", "script", "iframe", "form", "input", "div", "span", "table")


def text_leaks(text: Column | str, nonce: str, min_confidence: float = 0.5) -> Column:
    """Findings in a text that should be clean, as structs (code, n): spans left beside placeholders, foreign placeholders, markup. No values."""
    text = F.col(text) if isinstance(text, str) else text
    count = lambda pattern: F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")
    foreign = F.struct(F.lit("foreign-placeholder").alias("code"), count(rf"\[\[PII:[A-Z_]+:\d+:(?!{nonce}\]\])[0-9a-f]*\]\]").alias("n"))
    markup = F.struct(F.lit("raw-markup").alias("code"), count(rf"(?i)<\s*(?:{'|'.join(MARKUP_TAGS)})\b").alias("n"))

    def by_kind(kinds: Column) -> Column:
        return F.transform(F.array_distinct(kinds), lambda k: F.struct(F.concat(F.lit("pii:"), k).alias("code"), F.size(F.filter(kinds, lambda x: x == k)).cast("long").alias("n")))

    left = let(F.transform(text_spans(strip_forgeries(text), min_confidence), lambda s: s["kind"]), by_kind)
    return F.filter(F.concat(left, F.array(foreign, markup)), lambda f: f["n"] > 0)


def leaks(texts: DataFrame, key: str, text: str, nonce: str, min_confidence: float = 0.5) -> DataFrame:
    """(key, code, n) of the findings of every row; see text_leaks."""
    return texts.select(F.col(key), F.explode(text_leaks(text, nonce, min_confidence)).alias("f")).select(key, "f.*")

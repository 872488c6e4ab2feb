"""Line dedup by a segment-partition edit join, in DataFrame operations only.

Lines are in classes of near lengths. A line has one segment more than the edits allowed, so a line
within that many edits holds one of them unchanged, near its place from the left or the right end.
Lines are probed with their substrings against the segments of lines of each class in reach, and
pairs are verified by banded edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomsift.operators.spans import let

from ._common import checkpoint

#: Lengths in a class of lines. Its segments are cut for the least of them.
CLASS = 8


def probes(edits: int) -> list[tuple[int, int, int, bool, bool]]:
    """(length difference, segment, move, lead, own) of the substrings to look up.

    With i segments in front and edits - i behind, edits that don't touch segment i shift it by no
    more than i, counted from the left end, and by no more than edits - i, counted from the right.
    It is placed from the end that allows fewer moves. Differences that lead to one class look up
    the same: the first that allows a move is `lead`, later ones count where they enter another class.
    `own` is the segment itself.
    """
    out = []
    for i in range(edits + 1):
        near, far = min(i, edits - i), max(i, edits - i)
        for move in range(-near, near + 1):
            gaps = [gap for gap in range(edits + 1) if abs(gap - move) <= far]
            out += [(gap, i, move, gap == gaps[0], not gap and not move) for gap in gaps]
    return out


def postings(lines: DataFrame, edits: int, least_chars: int) -> DataFrame:
    """h1, part, own of lines (h1, line): what a line looks up, `own` where others find it."""
    parts = edits + 1
    # One expression for all substrings, as a method with each of them written out is too long to be compiled.
    each = F.array(*[F.struct(F.lit(gap).alias("gap"), F.lit(i).alias("i"), F.lit(move).alias("move"), F.lit(lead).alias("lead"), F.lit(own).alias("own")) for gap, i, move, lead, own in probes(edits)])
    rows = lines.select("h1", "line", F.length("line").alias("n"), F.explode(each).alias("e")).select("h1", "line", "n", "e.*")
    over = F.col("n") - F.col("gap") - least_chars
    rows = rows.where((over >= 0) & (F.col("lead") | ((over + 1) % CLASS == 0)))
    least = F.col("n") - F.col("gap") - over % CLASS
    size = F.floor(least / parts).cast("int")
    left = F.col("i") * size + F.col("move")
    right = F.col("n") - (parts - F.col("i")) * size - F.col("move")
    start = F.when(F.col("i") * 2 <= edits, left).otherwise(right) + 1
    return rows.select("h1", F.xxhash64(least, "i", F.col("line").substr(start, size)).alias("part"), "own")


def text_number(text: str) -> Column:
    """Tells texts of one key apart, all those of a null key too: 96 bits."""
    return F.struct(F.xxhash64(F.lit("text"), F.col(text)).alias("high"), F.hash(F.lit("text"), F.col(text)).alias("low"))


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, high, place, line: the place has the low half of the text's number, then the line's, from 0."""
    # Numbered before the lines are apart, or each line would number its text anew; the outer form,
    # as the other one cuts each text twice more to leave out those without lines.
    texts = docs.select(F.col(key).alias("key"), text_number(text).alias("number"), F.split(F.col(text), "\n", -1).alias("lines"))
    lines = texts.select("key", F.col("number.high").alias("high"), F.shiftleft(F.col("number.low").cast("bigint"), 32).alias("low"), F.posexplode_outer("lines").alias("pos", "line"))
    return lines.select("key", "high", (F.col("low") + F.col("pos")).alias("place"), "line")


def duplicate_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", edits: int = 2, least_chars: int = 30) -> DataFrame:
    """(key, text_number, dropped): the ascending positions, from 0, of the lines to drop; only for texts that have any.

    A line is dropped if the same line, or one within `edits` edits (insertions, deletions,
    substitutions of characters), occurs earlier; order is by key, a null key first, then by the
    text's number where texts share a key, then by position. Lines under `least_chars` characters are
    never dropped and count for nothing. Rows alike in key and text are one text's copies: they lose
    the same lines, and none to each other. Null and empty texts have no such line.
    """
    if least_chars < edits + 1:
        raise ValueError("least_chars must exceed the edits, or a segment would be empty")
    n = F.length("line")
    seen = lines_of(docs, key, text).where(n >= least_chars).select("key", "high", "place", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), "line")
    # Equal lines become one, with their first place; copies are merged before they move. The rows
    # are read again below: all of them are taken whole (so the count is asked for), and shuffled once.
    distinct = seen.groupBy("h1").agg(F.min(F.struct("key", "high", "place", "h2", "line")).alias("first"), F.count("*").alias("n")).where("n > 0")
    posted = postings(distinct.select("h1", "first.line"), edits, least_chars)
    same = Window.partitionBy("part")
    shared = posted.withColumns({"low": F.min("h1").over(same), "high": F.max("h1").over(same), "indexed": F.max("own").over(same)}).where("low <> high and indexed").select("part", "h1", "own")
    # Only lines that share a segment take their text along. A line looks for any earlier one and
    # stops at the first it finds, so no pairs come out. Both sides have the same columns, so they move once.
    told = shared.join(distinct, "h1").select("part", "h1", "own", F.struct("first.key", "first.high", "first.place").alias("first"), "first.line", F.length("first.line").alias("n"))
    early = told.select(*[F.col(c).alias(f"e_{c}") for c in told.columns])
    near = (F.col("part") == F.col("e_part")) & (F.col("own") | F.col("e_own")) & (F.abs(F.col("n") - F.col("e_n")) <= edits) & (F.col("h1") != F.col("e_h1")) & (F.col("e_first") < F.col("first")) & (F.levenshtein("line", "e_line", edits) >= 0)
    found = told.join(early, near, "left_semi").select("h1").distinct().withColumn("late", F.lit(True))
    # Lines of equal h1 and another h2 are no copies of the first; they stay.
    firsts = distinct.select("h1", F.struct("first.key", "first.high", "first.place", "first.h2").alias("first"), "n").join(found, "h1", "left").where("n > 1 or late")
    own = F.col("key").eqNullSafe(F.col("first.key")) & (F.col("high") == F.col("first.high")) & (F.col("place") == F.col("first.place"))
    places = seen.select("key", "high", "place", "h1", "h2").join(firsts, "h1").where((F.col("h2") == F.col("first.h2")) & (F.col("late").isNotNull() | ~own))
    lost = places.select("key", F.struct("high", F.shiftright("place", 32).cast("int").alias("low")).alias("text_number"), F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("pos"))
    return lost.groupBy("key", "text_number").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))


def drop_duplicate_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", edits: int = 2, least_chars: int = 30, name: str = "n_dropped") -> DataFrame:
    """All columns of `docs`, the text without its duplicate lines, and their number, `name`; see duplicate_lines.

    A text without such lines, null ones too, stays as it is; one of which no line is left is empty.
    A column of `docs` that is called `name` gives way.
    """
    found = checkpoint(duplicate_lines(docs, key, text, edits, least_chars)).select(F.col("key").alias("found_key"), F.col("text_number").alias("found_number"), "dropped")
    others = F.struct(F.lit(0).alias("none"), *[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text])
    rows = docs.select(others.alias("row"), F.col(key).alias("key"), text_number(text).alias("text_number"), F.col(text).alias("text"))
    met = rows.join(found, F.col("key").eqNullSafe(F.col("found_key")) & (F.col("text_number") == F.col("found_number")), "left")
    kept = lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "dropped"), lambda i: F.get(lines, i)), "\n")
    # Cut behind a bound variable, so that a text is cut once.
    cleaned = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(let(F.split("text", "\n", -1), kept)).alias(text)
    back = [cleaned if c == text else F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() != name.lower()]
    return met.select(*back, F.coalesce(F.size("dropped"), F.lit(0)).alias(name))

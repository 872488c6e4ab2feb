"""Source divergence audit: how far each source's words are from its language's, and from those of the other sources.

Counts of a term in a source and in its whole language become smoothed whole-number probabilities, so
all arithmetic is exact. The terms that stand out most in a source are searched by upper bounds: its terms are
put into buckets of like counts, the extreme probabilities of a bucket bound what its terms can reach,
and buckets are opened from the best bound on until none that is closed can reach the k-th value.
Divergences of pairs of sources are summed from the terms' postings; terms that one source or both
lack come in by the counts' histogram of the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import NO_LETTER, checkpoint, chunks, lowered_texts, mix64, span_hashes, text_buffers, word_spans

#: Text bytes counted at once, counted rows that a task holds before they go on, and pairs made at once.
_BYTES, _HELD, _PAIRS = 4 << 20, 1 << 20, 1 << 21
#: Groups are sent to all executors if their rows are known to take no more than this.
SEND_BYTES = 32 << 20
COUNTED = "lang string, source string, term string, n long, docs long"


def count_terms(group: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Per group and term of some texts: group, term, occurrences, texts."""
    starts, ends, first = word_spans(data, offsets, NO_LETTER)
    if not len(starts):
        return np.empty(0, np.int64), pa.array([], pa.string()), np.empty(0, np.int64), np.empty(0, np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    key = mix64(span_hashes(data, starts, ends) + mix64((group[row] + 1).astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    sorted_key, sorted_row = key[order], row[order]
    new = np.ones(len(order), bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    begin = np.flatnonzero(new)
    # Rows of a term ascend, so each text shows as a change.
    text = new.copy()
    text[1:] |= sorted_row[1:] != sorted_row[:-1]
    shown = order[begin]
    return group[row[shown]], lowered_texts(data, starts[shown], ends[shown]), np.diff(np.append(begin, len(order))), np.add.reduceat(text.astype(np.int64), begin)


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with lang and source to counts per lang, source and term; each lang and source has a row without a term too."""
    groups: dict[tuple[str, str], int] = {}
    held: list[pa.Table] = []
    n = 0

    def summed() -> pa.Table:
        return pa.concat_tables(held).group_by(["g", "term"]).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns(["g", "term", "n", "docs"])

    def told(table: pa.Table | None) -> Iterator[pa.RecordBatch]:
        names = list(groups)
        lang, source = (pa.array([x[i] for x in names], pa.string()) for i in (0, 1))
        zeros = pa.array(np.zeros(len(names), np.int64))
        yield pa.RecordBatch.from_arrays([lang, source, pa.nulls(len(names), pa.string()), zeros, zeros], names=["lang", "source", "term", "n", "docs"])
        if table is not None:
            for b in table.to_batches(max_chunksize=1 << 16):
                g = b.column("g")
                yield pa.RecordBatch.from_arrays([lang.take(g), source.take(g), b.column("term"), b.column("n"), b.column("docs")], names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        pairs = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
        group = np.array([groups.setdefault(p, len(groups)) for p in pairs], np.int64)
        data, offsets = text_buffers(batch.column("text"))
        for low, high in chunks(offsets, _BYTES):
            g, term, count, docs = count_terms(group[low:high], data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
            held.append(pa.table({"g": g, "term": term, "n": count, "docs": docs}))
            n += len(g)
        if n > _HELD:
            held = [summed()]
            n = held[0].num_rows
            if n > _HELD // 2:
                yield from told(held[0])
                groups, held, n = {}, [], 0
    if groups:
        yield from told(summed() if held else None)


def smoothed(count: Column, size: Column) -> Column:
    """1 + floor(1e9 * (count + 1) / size) by long division, three digits a step, so that no product leaves 64 bits."""
    out, left = F.lit(0).cast("long"), (count + 1).cast("long")
    for _ in range(3):
        scaled = left * 1000
        left = F.pmod(scaled, size)
        out = out * 1000 + (scaled - left) / size
        out = out.cast("long")
    return out + 1


def _quotient(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def divergence(p: Column, q: Column) -> Column:
    return _quotient((p - q) * (p - q), q)


def _with_groups(rows: DataFrame, groups: DataFrame, small: bool) -> DataFrame:
    return rows.join(F.broadcast(groups) if small else groups, ["lang", "source"])


def top_terms(postings: DataFrame, groups: DataFrame, top: int, small: bool) -> DataFrame:
    """lang, source, item, value, rank of the `top` terms per group whose probability in it exceeds that in the language."""
    level = lambda c: F.when(F.col(c) < 16, F.col(c)).otherwise(F.floor(F.log2(F.col(c).cast("double")) * 4)).cast("int")
    placed = postings.select("lang", "source", "term", "n", "total", level("n").alias("own"), level("total").alias("of_lang"))
    key = ["lang", "source", "own", "of_lang"]
    buckets = placed.groupBy(*key).agg(F.count("*").alias("terms"), F.min("n").alias("least"), F.max("n").alias("most"), F.min("total").alias("rare"), F.max("total").alias("common"))
    sizes = groups.select("lang", "source", "size", "lang_size")
    of = _with_groups(buckets, sizes, small)
    most, rare, least, common = (smoothed(F.col(c), F.col(s)) for c, s in (("most", "size"), ("rare", "lang_size"), ("least", "size"), ("common", "lang_size")))
    bounded = of.withColumns({"p1": most, "q1": rare, "p0": least, "q0": common}).where("p1 > q1").withColumns({"bound": divergence(F.col("p1"), F.col("q1")), "sure": F.when(F.col("p0") > F.col("q0"), F.col("terms")).otherwise(0)})
    bounded = checkpoint(bounded.select(*key, "size", "lang_size", "bound", "sure"))
    best_first = Window.partitionBy("lang", "source").orderBy(F.desc("bound"), "own", "of_lang")
    opened = bounded.withColumn("before", F.sum("sure").over(best_first.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("sure")).where(F.col("before") < top).drop("before", "bound", "sure")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")

    def evaluated(chosen: DataFrame) -> DataFrame:
        met = placed.join(chosen, key).withColumns({"p": smoothed(F.col("n"), F.col("size")), "q": smoothed(F.col("total"), F.col("lang_size"))}).where("p > q")
        return met.select("lang", "source", "term", divergence(F.col("p"), F.col("q")).alias("value")).withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)

    reached = evaluated(opened).groupBy("lang", "source").agg(F.when(F.count("*") >= top, F.min("value")).alias("kth"))
    # The k-th value so far; what is strictly below it stays closed.
    needed = bounded.join(reached, ["lang", "source"], "left").where(F.col("kth").isNull() | (F.col("bound") >= F.col("kth"))).select(*key, "size", "lang_size")
    return evaluated(needed).select("lang", "source", F.col("term").alias("item"), "value", "rank")


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _summed(code: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(code, kind="stable")
    code, value = code[order], value[order]
    begin = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.empty(0, np.int64)
    return code[begin], np.add.reduceat(value, begin) if len(begin) else value


def pair_sums(start: np.ndarray, end: np.ndarray, place: np.ndarray, p: np.ndarray, p0: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place << 31 | other's place, value) summed over terms that both have: the value beyond what the histograms give.

    start, end: of the term of each posting. At most some 2**21 pairs are held at a time.
    """
    row = 0
    width = end - start
    done = np.concatenate([[0], np.cumsum(width)])
    while row < len(place):
        stop = max(row + 1, int(np.searchsorted(done, done[row] + _PAIRS, "right")) - 1)
        reps = width[row:stop]
        left = np.repeat(np.arange(row, stop), reps)
        right = start[left] + np.arange(len(left)) - np.repeat(done[row:stop] - done[row], reps)
        left, right = left[left != right], right[left != right]
        value = _f(p[left], p[right]) - _f(p[left], p0[right]) - _f(p0[left], p[right]) + _f(p0[left], p0[right])
        yield _summed((place[left] << 31) | place[right], value)
        row = stop


def _pairing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings (lang, term, place, p, p0) in the order of lang and term to sums per lang and pair of places."""
    held, lang = None, None
    sums: list[tuple[np.ndarray, np.ndarray]] = []

    def told() -> Iterator[pa.RecordBatch]:
        if sums:
            code, value = _summed(*(np.concatenate(x) for x in zip(*sums, strict=True)))
            sums.clear()
            for at in range(0, len(code), 1 << 16):
                c = code[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(c >> 31), pa.array(c & ((1 << 31) - 1)), pa.array(value[at : at + (1 << 16)])], names=["lang", "a", "b", "value"])

    def terms(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """Whole terms."""
        nonlocal lang
        codes = [table.column(c).combine_chunks().dictionary_encode() for c in ("lang", "term")]
        l, t = (c.indices.to_numpy() for c in codes)
        new = np.append(True, (l[1:] != l[:-1]) | (t[1:] != t[:-1]))
        begin = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        stop = np.append(begin[1:], len(l))
        start, end = begin[run], stop[run]
        place, p, p0 = (table.column(c).to_numpy() for c in ("place", "p", "p0"))
        cuts = np.append(np.flatnonzero(np.append(True, l[1:] != l[:-1])), len(l))
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            if (name := codes[0].dictionary[int(l[low])].as_py()) != lang:
                yield from told()
                lang = name
            for found in pair_sums(start[low:high] - low, end[low:high] - low, place[low:high], p[low:high], p0[low:high]):
                sums.append(found)
                if sum(len(c) for c, _ in sums) > 2 * _PAIRS:
                    sums[:] = [_summed(*(np.concatenate(x) for x in zip(*sums, strict=True)))]
                    if len(sums[0][0]) > _PAIRS:
                        yield from told()

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        last = (held.column("lang")[-1], held.column("term")[-1])
        same = pa.compute.and_(pa.compute.equal(held.column("lang"), last[0]), pa.compute.equal(held.column("term"), last[1])).to_numpy()
        at = len(same) - int(same.sum())
        if at:
            yield from terms(held.slice(0, at))
            held = held.slice(at)
    if held is not None:
        yield from terms(held)
    yield from told()


def pair_divergences(postings: DataFrame, groups: DataFrame, small: bool) -> DataFrame:
    """lang, source, item (another source of the language), value: the sum over all kept terms."""
    own = groups.select("lang", "source", "place", "size", "p0")
    met = _with_groups(postings, own, small).select("lang", "term", "place", smoothed(F.col("n"), F.col("size")).alias("p"), "p0")
    both = met.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_pairing, "lang string, a long, b long, value long")
    # What a source's own terms give with the other's probability of a term that it lacks.
    histogram = checkpoint(met.groupBy("lang", "place", "p", "p0").agg(F.count("*").alias("terms")))
    other = groups.select("lang", F.col("place").alias("b"), F.col("p0").alias("q0"))
    crossed = histogram.join(other, "lang").where("place <> b")
    there = crossed.select("lang", F.col("place").alias("a"), "b", (F.col("terms") * divergence(F.col("p"), F.col("q0"))).alias("value"))
    back = crossed.select("lang", F.col("b").alias("a"), F.col("place").alias("b"), (F.col("terms") * divergence(F.col("q0"), F.col("p"))).alias("value"))
    sums = both.union(there).union(back).groupBy("lang", "a", "b").agg(F.sum("value").alias("some"))
    n_terms = histogram.groupBy("lang", "place").agg(F.sum("terms").alias("own_terms"))
    sized = groups.join(n_terms, ["lang", "place"], "left").select("lang", "source", "place", "p0", "terms", F.coalesce("own_terms", F.lit(0)).alias("own_terms"))
    a = sized.select("lang", "source", F.col("place").alias("a"), F.col("p0").alias("pa"), "terms", F.col("own_terms").alias("ta"))
    b = sized.select("lang", F.col("source").alias("item"), F.col("place").alias("b"), F.col("p0").alias("pb"), F.col("own_terms").alias("tb"))
    # A row per pair is the result.
    pairs = a.join(b, "lang").where("a <> b").join(sums, ["lang", "a", "b"], "left")
    neither = (F.col("terms") - F.col("ta") - F.col("tb")) * divergence(F.col("pa"), F.col("pb"))
    return pairs.select("lang", "source", "item", (F.coalesce("some", F.lit(0)) + F.coalesce(neither, F.lit(0))).cast("long").alias("value"))


def divergence_audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): per group the other sources (`pair`) and its standing-out terms (`term`).

    A group is a lang and source that occur. Null lang, source and text are empty texts. Terms are runs of letters: of A-Z,
    a-z and all that isn't ASCII, with A-Z lower-cased. A language keeps the terms that occur in `least_docs`
    of its rows. For a term that occurs c times among the N of a group or language that keeps V terms, p is
    1 + floor(1e9 (c + 1) / (N + V)); the value of p against q is floor((p - q)² / q). Pairs sum it over all kept
    terms, in all ranks; terms are those that occur in the group and have p > q there, in `top` ranks. Ties go by
    item. Repeated rows count each; a group without terms has pairs only; an empty table gives no rows.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    counted = docs.select(empty(lang).alias("lang"), empty(source).alias("source"), F.col(text).alias("text")).mapInArrow(_counting, COUNTED)
    counts = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    same = Window.partitionBy("lang", "term")
    every = counts.withColumns({"total": F.sum("n").over(same), "in_docs": F.sum("docs").over(same), "leads": F.min("source").over(same) == F.col("source")})
    # A group's row without a term stays, so that the group does.
    rows = checkpoint(every.where(F.col("term").isNull() | (F.col("in_docs") >= least_docs)).select("lang", "source", "term", "n", "total", "leads"))
    kept = rows.where(F.col("term").isNotNull())
    langs = rows.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count_if(F.col("leads") & F.col("term").isNotNull()).alias("terms"))
    sized = rows.groupBy("lang", "source").agg(F.sum("n").alias("own_n")).join(langs, "lang")
    place = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long")
    size, lang_size = F.nullif(F.col("own_n") + F.col("terms"), F.lit(0)), F.nullif(F.col("lang_n") + F.col("terms"), F.lit(0))
    groups = checkpoint(sized.select("lang", "source", "terms", place.alias("place"), size.alias("size"), lang_size.alias("lang_size"), smoothed(F.lit(0), size).alias("p0")))
    takes = groups.agg(F.sum(F.octet_length("lang") + F.octet_length("source") + 96)).first()[0] or 0
    postings = kept.select("lang", "source", "term", "n", "total")
    terms = top_terms(postings, groups, top, takes <= SEND_BYTES)
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_divergences(postings, groups, takes <= SEND_BYTES).withColumn("rank", F.row_number().over(by_value))
    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
    return part(pairs, "pair").union(part(terms, "term"))

"""Language ID with interpolated Kneser-Ney character models, kept as sorted hash arrays.

A word is a run of letters, lower-cased, between a start and an end mark; n-grams do not cross
words. So the score of a text is the sum over its words, and each distinct word of a batch is scored
once. Each language has its own arrays, so memory grows with what was learned of it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import mix64, range_sums

UNDETERMINED = "und"
START, END = 1, 2
#: Letters whose scores a worker looks up at once; longer texts are scored in blocks, whole.
BLOCK_LETTERS = 1 << 20
#: Distinct words a worker remembers before it starts anew; bounds its memory, not the result.
CACHE_WORDS = 400_000
#: Bytes of the samples of all languages together, at most; many languages share it.
ALL_BYTES = 300_000_000

_tables: list[np.ndarray] = []


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: is it a letter, and its lower case where that is one character."""
    if not _tables:
        # One character at a time: a list of all takes some 75 MB of every worker.
        _tables.append(np.fromiter((c.isalpha() for c in map(chr, range(0x110000))), bool, 0x110000))
        _tables.append(np.fromiter((ord(c.lower()) if len(c.lower()) == 1 else i for i, c in enumerate(map(chr, range(0x110000)))), np.uint32, 0x110000))
    return _tables[0], _tables[1]


_PLACE = mix64(np.arange(1, 17, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def words_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points of a text, and the starts and ends of its runs of letters."""
    is_letter, lower = _letters()
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    held = np.zeros(len(codes) + 2, np.int8)
    held[1:-1] = is_letter[codes]
    edge = np.diff(held)
    return lower[codes], np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def marked(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with start and end marks, one after the other: codes, place in the word, word number."""
    size = ends - starts + 2
    first = np.concatenate([[0], np.cumsum(size)])
    word = np.repeat(np.arange(len(size)), size)
    place = np.arange(first[-1]) - first[word]
    out = np.full(first[-1], START, np.uint32)
    inner = (place > 0) & (place < size[word] - 1)
    out[inner] = codes[(starts[word] + place - 1)[inner]]
    out[first[1:] - 1] = END
    return out, place, word


def gram_hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """For k = 1..order the hash of the k characters that end at each place (index k)."""
    out, total, n = [np.zeros(len(codes), np.uint64)], np.zeros(len(codes), np.uint64), len(codes)
    for k in range(1, order + 1):
        total[k - 1 :] += codes[: n - k + 1] * _PLACE[k - 1] if n >= k else 0
        out.append(mix64(total + np.uint64(k)))
    return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index in sorted keys, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


@dataclass
class Language:
    """By order k: sorted n-gram hashes with log2 probabilities, sorted context hashes with log2 back-off weights."""

    grams: list[np.ndarray]
    log_p: list[np.ndarray]
    contexts: list[np.ndarray]
    log_back: list[np.ndarray]

    def score(self, hashes: list[np.ndarray], place: np.ndarray, at: np.ndarray, log_base: float) -> np.ndarray:
        """Log2 probability of the character at each of `at`, by the longest known n-gram that ends there."""
        total, rest = np.zeros(len(at)), np.arange(len(at))
        for k in range(len(self.grams) - 1, 0, -1):
            i = at[rest]
            reach = place[i] >= k - 1  # an n-gram of this order fits into the word
            found = np.where(reach, _find(self.grams[k], hashes[k][i]), -1)
            total[rest[found >= 0]] += self.log_p[k][found[found >= 0]]
            rest, i, reach = rest[found < 0], i[found < 0], reach[found < 0]
            context = np.where(reach, _find(self.contexts[k], hashes[k - 1][i - 1] if k > 1 else np.zeros(len(i), np.uint64)), -1)
            total[rest[context >= 0]] += self.log_back[k][context[context >= 0]]
        total[rest] += log_base
        return total


@dataclass
class Model:
    """A model of each language, in the order of `languages`, and what was calibrated."""

    languages: list[str]
    order: int
    models: list[Language] = field(default_factory=list)
    log_base: float = 0.0
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    letter_spread: np.ndarray | None = None
    scale: float = 8.0

    def score(self, codes: np.ndarray, place: np.ndarray, word: np.ndarray, n_words: int) -> np.ndarray:
        """Log2 probability of each word in each language."""
        hashes, at = gram_hashes(codes, self.order), np.flatnonzero(place > 0)
        each = [np.bincount(word[at], m.score(hashes, place, at, self.log_base), n_words) for m in self.models]
        return np.stack(each, 1) if each else np.zeros((n_words, 0))


def learned(words: list[tuple[str, int]], order: int, log_base: float) -> Language:
    """The model of one language from its lower-cased words of letters and their counts."""
    codes = np.frombuffer("".join(w for w, _ in words).encode("utf-32-le"), "<u4")
    size = np.array([len(w) for w, _ in words], np.int64)
    ends = np.cumsum(size)
    text, place, word = marked(codes, ends - size, ends)
    weight, hashes = np.array([n for _, n in words], np.float64)[word], gram_hashes(text, order)
    raw = []  # by order: hash, suffix, context, count, and whether it begins a word
    for k in range(1, order + 1):
        at = np.flatnonzero((place > 0) & (place >= k - 1))
        gram, first, back = np.unique(hashes[k][at], return_index=True, return_inverse=True)
        context = hashes[k - 1][at - 1] if k > 1 else np.zeros(len(at), np.uint64)
        raw.append((gram, hashes[k - 1][at][first], context[first], np.bincount(back, weight[at], len(gram)), (place[at] == k - 1)[first]))
    none = np.empty(0)
    out = Language([np.empty(0, np.uint64)], [none], [np.empty(0, np.uint64)], [none])
    for k, (gram, suffix, context, count, anchored) in enumerate(raw, 1):
        if k < order:  # how many characters stand in front of it, unless it begins a word
            count = np.where(anchored, count, np.bincount(_find(gram, raw[k][1]), minlength=len(gram)))
        n1, n2 = (count == 1).sum(), (count == 2).sum()
        cut = min(0.95, max(0.1, n1 / (n1 + 2 * n2) if n1 + n2 else 0.5))
        contexts, of = np.unique(context, return_inverse=True)
        total = np.bincount(of, count, len(contexts))
        weight = np.where(total > 0, np.bincount(of, np.minimum(count, cut), len(contexts)) / np.maximum(total, 1e-300), 1.0)
        lower = np.exp2(out.log_p[k - 1][_find(out.grams[k - 1], suffix)] if k > 1 else np.full(len(gram), log_base))
        p = np.where(total[of] > 0, np.maximum(count - cut, 0) / np.maximum(total[of], 1e-300), 0) + weight[of] * lower
        out.grams.append(gram)
        out.log_p.append(np.log2(p))
        out.contexts.append(contexts)
        out.log_back.append(np.log2(weight))
    return out


def kneser_ney(words: Iterable[tuple[str, str, int]], languages: list[str], order: int) -> Model:
    """Models of all languages from (language, lower-cased word of letters, count)."""
    by: dict[str, list[tuple[str, int]]] = {name: [] for name in languages}
    for name, w, n in words:
        if name in by:
            by[name].append((w, n))
    alphabet = {c for own in by.values() for w, _ in own for c in w}
    base = float(-np.log2(len(alphabet) + 3))
    return Model(languages, order, [learned(own, order, base) for own in by.values()], base)


class Scorer:
    """Scores texts with a model; remembers distinct words."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.keys, self.values = np.empty(0, np.uint64), np.empty((0, len(self.model.languages)))

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of log2 probabilities by language, and letters and word ends, of each text."""
        scores, sizes = np.zeros((len(texts), len(self.model.languages))), np.zeros(len(texts), np.int64)
        begin = size = 0
        for i, t in enumerate(texts):
            size += len(t) + 1
            if size >= BLOCK_LETTERS or i + 1 == len(texts):
                self._block(texts[begin : i + 1], scores[begin : i + 1], sizes[begin : i + 1])
                begin, size = i + 1, 0
        return scores, sizes

    def _block(self, texts: list[str], scores: np.ndarray, sizes: np.ndarray) -> None:
        codes, starts, ends = words_of("\n".join(texts))
        if not len(starts):
            return
        hashes = mix64(range_sums(mix64(codes + np.uint64(1)), starts, ends) + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        unique, first, of = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > CACHE_WORDS:
            self.forget()
        at = _find(self.keys, unique)
        new = np.flatnonzero(at < 0)
        values = np.empty((len(unique), len(self.model.languages)))
        values[at >= 0] = self.values[at[at >= 0]]
        if len(new):
            fresh = marked(codes, starts[first[new]], ends[first[new]])
            values[new] = self.model.score(*fresh, len(new))
            keys = np.concatenate([self.keys, unique[new]])
            order = np.argsort(keys, kind="stable")
            self.keys, self.values = keys[order], np.concatenate([self.values, values[new]])[order]
        lines = np.cumsum([0] + [len(t) + 1 for t in texts])
        row = np.searchsorted(lines, starts, "right") - 1
        sizes += np.bincount(row, ends - starts + 1, len(texts)).astype(np.int64)
        for j in range(scores.shape[1]):
            scores[:, j] += np.bincount(row, values[of, j], len(texts))


def scoring(broadcast):
    """(key, text) to key, cross-entropy by language in bits a letter, letters and word ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(broadcast.value)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            total, size = scorer.texts(texts)
            bits = -total / np.maximum(size, 1)[:, None]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * bits.shape[1]), pa.array(bits.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat, pa.array(size)], names=["key", "bits", "size"])

    return run


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", order: int = 5, sample_bytes: int = 1_500_000, all_bytes: int = ALL_BYTES) -> Model | None:
    """Fit on a bounded sample of the labelled rows of `docs`; None if there are none.

    Bounds: of each label about `sample_bytes` bytes of whole, distinct texts, chosen by hash, or the
    label's share of `all_bytes` where there are many; no label is left out. Every label is treated
    alike: its texts are dealt into two halves, each half is scored by a model of the other for
    calibration, and the model that is kept learns from both.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.col("lang") != UNDETERMINED))
    place = (F.xxhash64("text").bitwiseAND(F.lit((1 << 40) - 1))) / float(1 << 40)
    placed = rows.withColumns({"place": place, "half": F.pmod(F.xxhash64(F.lit(5), "text"), F.lit(2))})
    least = lambda h: F.min(F.when(F.col("half") == h, F.col("place")))
    sizes = placed.where(F.col("text").rlike(r"\p{L}")).groupBy("lang").agg(F.sum(F.octet_length("text").cast("double")).alias("bytes"), F.greatest(least(0), least(1)).alias("least")).collect()
    if not sizes:
        return None
    # However long its texts are, a label has one of each half.
    bound = min(sample_bytes, all_bytes / len(sizes))
    shares = spark.createDataFrame([(r["lang"], max(bound / r["bytes"], r["least"])) for r in sizes], "lang string, share double")
    # A row per label, which have just been on the driver.
    chosen = placed.join(F.broadcast(shares), "lang").where("place <= share").select("lang", "text", "half").distinct().persist()
    try:
        found = chosen.select("lang", "half", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)).alias("word")).groupBy("lang", "half", "word").count().orderBy("lang", "half", "word").toPandas()
        languages = sorted(found["lang"].unique())
        if not languages:
            return None
        held = []
        for h in (0, 1):
            # One model at a time, so that the driver never holds two.
            half = kneser_ney(found.loc[found["half"] != h, ["lang", "word", "count"]].itertuples(index=False, name=None), languages, order)
            shared = spark.sparkContext.broadcast(half)
            del half
            held.append(chosen.where(F.col("half") == h).select(F.col("lang").alias("key"), "text").mapInArrow(scoring(shared), "key string, bits array<double>, size bigint").where("size > 0").toPandas())
            shared.destroy()
        scored = pd.concat(held, ignore_index=True)
    finally:
        chosen.unpersist()
    both = found.groupby(["lang", "word"], as_index=False)["count"].sum()
    del found
    return calibrate(kneser_ney(both.itertuples(index=False, name=None), languages, order), scored)


def calibrate(model: Model, held: pd.DataFrame) -> Model:
    """Mean and spread of each language's own cross-entropy, and the scale of the confidence."""
    count = len(model.languages)
    model.mean, model.spread, model.letter_spread = np.full(count, np.inf), np.zeros(count), np.zeros(count)
    own, others = [], []
    for key, bits, size in held.itertuples(index=False, name=None):
        j = model.languages.index(key)
        own.append((j, bits[j], size))
        others.append((j, np.asarray(bits)))
    for j in range(count):
        bits = np.array([b for i, b, _ in own if i == j])
        # A single text says nothing of the spread, so its language never rejects.
        if len(bits) >= 2:
            size = np.array([s for i, _, s in own if i == j], float)
            model.mean[j] = np.average(bits, weights=size)
            off = (bits - model.mean[j]) ** 2
            # The spread of short texts falls with their size; that of long ones does not.
            model.letter_spread[j] = np.sqrt(np.median(off * size) / 0.455)
            model.spread[j] = np.sqrt(np.median(off[size >= np.median(size)]) / 0.455)
    if others:
        def loss(scale: float) -> float:
            return -sum(-scale * b[j] - np.log(np.exp(-scale * (b - b.min())).sum()) + scale * b.min() for j, b in others)

        model.scale = float(min((0.5, 1, 2, 4, 8, 16, 32), key=loss))
    return model


def identify(docs: DataFrame, model: Model | None, text: str = "text", tolerance: float = 12.0, name: str = "lang_id") -> DataFrame:
    """All columns of `docs` and a struct column `name` of lang_pred, score, bits, rejected.

    lang_pred is the language of the lowest cross-entropy a letter (ties: first by name). It is `und`
    with score 0 if the text is null or has no letter, or if nothing was learned. score is the
    calibrated share of the winner among the languages. A text is rejected if it is `und`, or if its
    cross-entropy exceeds the language's usual one by `tolerance` spreads for its length.
    Repeated rows are each identified, an empty table gives no rows, and no column but `text` is read.
    A column of `docs` that is called `name` gives way.
    """
    passed = [c for c in docs.columns if c != text]
    rows = docs.select(F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(passed)]).alias("key"), F.col(text).alias("text"))
    back = [F.col("text").alias(c) if c == text else F.col(f"key.c{passed.index(c)}").alias(c) for c in docs.columns if c.lower() != name.lower()]
    if model is None:
        nothing = F.struct(F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits"), F.lit(True).alias("rejected"))
        return rows.select(*back, nothing.alias(name))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scorer = Scorer(m)
        names = np.array([*m.languages, UNDETERMINED], object)
        for batch in batches:
            total, size = scorer.texts([x or "" for x in batch.column(1).to_pylist()])
            bits = -total / np.maximum(size, 1)[:, None]
            best = bits.argmin(1)
            low = bits[np.arange(len(best)), best]
            share = 1 / np.exp(-m.scale * (bits - low[:, None])).sum(1)
            spread = np.sqrt(m.spread[best] ** 2 + m.letter_spread[best] ** 2 / np.maximum(size, 1))
            with np.errstate(invalid="ignore"):
                over = low - m.mean[best] > tolerance * spread
            none = size == 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names[np.where(none, len(m.languages), best)], pa.string()), pa.array(np.where(none, 0.0, share)), pa.array(low, mask=none), pa.array(none | over)],
                names=["key", "text", "lang_pred", "score", "bits", "rejected"],
            )

    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(run, f"key {kind}, text string, lang_pred string, score double, bits double, rejected boolean")
    return out.select(*back, F.struct("lang_pred", "score", "bits", "rejected").alias(name))

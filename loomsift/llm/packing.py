"""Best-fit packing: sum-of-squares placement of token pieces into sequences.

A document's ids are cut only where it is longer than a sequence. Pieces go to shards by hash, and
in each shard every piece is placed where the squared counts of open bins per residual gap become
smallest. What the few bins that stay open hold is then placed once more, each piece into the least
gap that holds it. Pieces that fill a sequence alone need no placement.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpoint, chunks, mix64, span_hashes, text_buffers, word_spans

#: Distinct words a worker remembers before it starts anew; bounds its memory, not the result.
CACHE_ENTRIES = 1_000_000
#: Pieces of a shard, about. A shard wastes a few sequences at its end, so the share lost is small.
SHARD_PIECES = 100_000

_ALNUM = np.array([chr(i).isalnum() and i < 128 for i in range(256)])
_loaded: dict[str, WordIds] = {}


class WordIds:
    """Ids of the texts of a tokenizers file, as unsigned 32-bit numbers.

    Where the file's rules drop white space and case, the ids of a text are those of its words, one
    after the other, and a comma or full stop behind a letter is a unit of its own. Then a batch's
    distinct words (by 64-bit hash) are looked up in sorted arrays, and only new ones are encoded;
    words of letters many in one text, since each ends with an end-of-word token. Else texts are
    encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.ends = np.array([(self.model.id_to_token(i) or "").endswith("</w>") for i in range(self.model.get_vocab_size(True))])
        probe = "one, two  three\nfour\t<|endoftext|> it's ÉTÉ... 12\r\v\f"
        plain = lambda t: self.model.encode(t, add_special_tokens=False).ids
        self.safe = (
            plain(probe) == [i for p in probe.split() for i in plain(p)]
            and not any(map(plain, (" ", "\n", " \n ")))
            and plain("ÉTÉ,") == plain("Été") + plain(",")
            and plain("a1x.") == plain("A1X") + plain(".")
            and plain("it's,") == plain("IT'S") + plain(",")
            and all(self.ends[plain(w)].sum() == 1 for w in ("a", "étexyzq", "ßwhontre"))
        )
        self.forget()

    def forget(self) -> None:
        self.keys, self.at, self.size = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.pool: list[np.ndarray] = []
        self.pooled = 0

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(x.ids, "<u4") for x in self.model.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of words of letters, encoded a thousand at once."""
        out: list[np.ndarray] = []
        groups = [words[i : i + 1000] for i in range(0, len(words), 1000)]
        for group, ids in zip(groups, self._encode([" ".join(g) for g in groups]), strict=True):
            cuts = np.flatnonzero(self.ends[ids]) + 1
            out += np.split(ids, cuts[:-1]) if len(cuts) == len(group) and cuts[-1] == len(ids) else self._encode(group)
        return out

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        """Add words that no array holds yet."""
        raw = data.tobytes() if len(starts) * 64 > len(data) else None
        words = [(raw[s:e] if raw is not None else data[s:e].tobytes()).decode("utf-8", "replace") for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        # Letters below U+0100 neither compose nor change in number.
        letters = [i for i, w in enumerate(words) if w.isalpha() and max(w) < "\u0100"]
        other = sorted(set(range(len(words))) - set(letters))
        ids: list[np.ndarray] = [None] * len(words)
        for i, x in zip(letters, self._words([words[i] for i in letters]), strict=True):
            ids[i] = x
        for i, x in zip(other, self._encode([words[i] for i in other]), strict=True):
            ids[i] = x
        size = np.array([len(x) for x in ids], np.int64)
        at = self.pooled + np.concatenate([[0], np.cumsum(size)[:-1]])
        self.pool = [np.concatenate([*self.pool, *ids])]
        self.pooled = len(self.pool[0])
        keys = np.concatenate([self.keys, hashes])
        order = np.argsort(keys, kind="stable")
        self.keys, self.at, self.size = keys[order], np.concatenate([self.at, at])[order], np.concatenate([self.size, size])[order]

    def ids(self, column: pa.Array, end_id: int) -> Iterator[np.ndarray]:
        """The ids of each text, with `end_id` behind; whole texts, about a MB at once."""
        data, offsets = text_buffers(column)
        for i, j in chunks(offsets):
            part, rows = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            if not self.safe:
                yield from (np.append(x, np.uint32(end_id)) for x in self._encode([part[a:b].tobytes().decode() for a, b in pairwise(rows.tolist())]))
                continue
            starts, ends, first = word_spans(part, rows)
            # A mark behind an ASCII letter or digit, or behind a letter from U+00C0 to U+00FF.
            last, before, third = part[ends - 1], part[np.maximum(ends - 2, 0)], part[np.maximum(ends - 3, 0)]
            latin = (ends - starts > 2) & (third == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)
            cut = ((last == 44) | (last == 46)) & (ends - starts > 1) & (_ALNUM[before] | latin)
            count = 1 + cut
            place = np.concatenate([[0], np.cumsum(count)])
            s, e = np.repeat(starts, count), np.repeat(ends, count)
            marks = place[1:][cut] - 1
            e[marks - 1] -= 1
            s[marks] = e[marks] - 1
            if len(self.keys) > CACHE_ENTRIES:
                self.forget()
            if len(s):
                hashes = span_hashes(part, s, e)
                opening = np.flatnonzero((part[:-1] == 60) & (part[1:] == 124))
                # Case counts in what may be a special token.
                for k in np.unique(np.searchsorted(s, opening, "right") - 1).tolist() if len(opening) else ():
                    hashes[k] ^= mix64(np.array([zlib.crc32(part[s[k] : e[k]].tobytes())], np.uint64))[0]
                hashes, at, of = np.unique(hashes, return_index=True, return_inverse=True)
                where = np.minimum(np.searchsorted(self.keys, hashes), max(len(self.keys) - 1, 0))
                new = self.keys[where] != hashes if len(self.keys) else np.ones(len(hashes), bool)
                if new.any():
                    self._learn(part, s[at[new]], e[at[new]], hashes[new])
                    where = np.searchsorted(self.keys, hashes)
                size, begin = self.size[where][of], self.at[where][of]
            else:
                size = begin = np.empty(0, np.int64)
            # Words and, behind each text, one more place for the end.
            stop = np.concatenate([[0], np.cumsum(size)])
            rows_first = place[first]
            out = np.full(stop[-1] + len(rows) - 1, end_id, "<u4")
            row = np.repeat(np.arange(len(rows) - 1), np.diff(rows_first))
            if stop[-1]:
                shift = np.arange(stop[-1]) - np.repeat(stop[:-1], size)
                out[np.arange(stop[-1]) + np.repeat(row, size)] = self.pool[0][np.repeat(begin, size) + shift]
            cuts = stop[rows_first] + np.arange(len(rows))
            yield from (out[a:b] for a, b in pairwise(cuts.tolist()))


def encoder(path: str) -> WordIds:
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def cutting(path: str, limit: int, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, text) to a row per piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for at, ids in enumerate(model.ids(batch.column(1), end_id)):
                for k in range(0, len(ids), limit):
                    part = ids[k : k + limit]
                    rows.append(at)
                    piece.append(k // limit)
                    start.append(k)
                    length.append(len(part))
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["key", "piece", "start", "length", "ids_crc32"])

    return run


def sum_of_squares(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each item, placed in the order given.

    Placing an item of size s into a bin of residual gap g moves one bin from gap g to g - s. The
    squared counts change by 2 (n[g-s] - n[g]) + 2, or by 2 n[limit-s] + 1 for a new bin; a bin that
    gets full is no longer counted. Among equal changes the smallest gap wins.
    """
    n = np.zeros(limit + 1, np.int64)  # open bins by residual gap; gap `limit` is a new bin
    open_bins: list[list[int]] = [[] for _ in range(limit + 1)]
    used, where, offset = 0, np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    far = np.int64(1) << 40
    for i, s in enumerate(lengths.tolist()):
        here = n[s:limit]  # gaps s .. limit-1
        change = np.where(here > 0, 2 * (n[: limit - s] - here) + 2, far)
        if limit > s and here[0] > 0:
            change[0] = 1 - 2 * here[0]  # it fills the bin
        k = int(change.argmin()) if limit > s else 0
        fresh = 2 * n[limit - s] + 1 if s < limit else 0
        if limit > s and change[k] <= fresh:
            g = s + k
            b = open_bins[g].pop()
            n[g] -= 1
        else:
            g, b = limit, used
            used += 1
        where[i], offset[i] = b, limit - g
        if g > s:
            n[g - s] += 1
            open_bins[g - s].append(b)
    return where, offset


def tighten(lengths: np.ndarray, where: np.ndarray, offset: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Place the items of bins that stayed open once more, the longest first, each into the least gap that holds it."""
    bins = int(where.max(initial=-1)) + 1
    fill = np.bincount(where, lengths, bins).astype(np.int64)
    again = np.flatnonzero(fill[where] < limit)
    again = again[np.argsort(-lengths[again], kind="stable")]
    numbers = np.flatnonzero(fill < limit).tolist()
    gaps: list[tuple[int, int]] = []
    place, used = [], 0
    for s in lengths[again].tolist():
        k = bisect.bisect_left(gaps, (s, -1))
        if k < len(gaps):
            gap, b = gaps.pop(k)
        else:
            gap, b = limit, used
            used += 1
        place.append((b, limit - gap))
        if gap > s:
            bisect.insort(gaps, (gap - s, b))
    if used > len(numbers):
        return where, offset
    where, offset = where.copy(), offset.copy()
    for i, (b, at) in zip(again.tolist(), place, strict=True):
        where[i], offset[i] = numbers[b], at
    return where, offset


def best_fit_packing(docs: DataFrame, path: str, limit: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text", shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Pack whole documents; one row per piece.

    Columns: key, piece (from 0), start (the document's ids before it), length, ids_crc32,
    sequence_id (its numbers are not gapless), offset (gapless from 0 in each sequence).
    A null or empty text is the single id `end_id`. Repeated rows are packed each for itself, an
    empty table gives no rows, and no other column of `docs` is read.
    """
    kind = docs.schema[key].dataType.simpleString()
    pieces = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(cutting(path, limit, end_id), f"key {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")
    # A few numbers per piece; kept, so that no text is encoded twice.
    pieces = checkpoint(pieces)
    whole = pieces.where(F.col("length") == limit)
    parts = pieces.where(F.col("length") < limit)
    shards = max(1, -(-parts.count() // shard_pieces))
    # Full pieces are sequences of their own: negative numbers, the others count up per shard.
    full = whole.select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "key", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        lengths = pdf["length"].to_numpy()
        where, offset = tighten(lengths, *sum_of_squares(lengths, limit), limit)
        return pdf.assign(sequence_id=(pdf["shard"].to_numpy(np.int64) << 32) + where, offset=offset)[["key", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    salted = parts.withColumn("shard", F.pmod(F.xxhash64("key", "piece", "ids_crc32"), F.lit(shards)))
    packed = salted.groupBy("shard").applyInPandas(place, f"key {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
    return packed.unionByName(full).withColumnRenamed("key", key)

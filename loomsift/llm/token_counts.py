"""Token counts: batch encoding in Arrow functions that return lengths only.

Batches have about equal bytes, whatever the rows; a text longer than a batch is taken in parts. Texts
are cut only where no token can span the cut, and each piece is looked up in a bounded cache before
the rest goes to the library as one batch.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import chunks, text_buffers

#: Distinct pieces a worker remembers before it starts anew; bounds its memory, not the result.
CACHE_ENTRIES = 300_000
#: Longer pieces are encoded each time and not remembered.
CACHE_CHARS = 48
#: Text bytes that go through the encoder at once; a longer text is taken in parts of so many characters.
BATCH_BYTES = 4 << 20

_loaded: dict[str, object] = {}


class PieceCounter:
    """Counts of a SentencePiece model, without begin, end or added tokens.

    Cuts stand before a run of spaces. They are safe when no vocabulary piece has the space mark
    after another character, which is checked when the model is loaded; else texts stay whole.
    """

    _cut = re.compile(r" +[^ ]*")

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        probe = [self.model.encode(x, out_type=str) for x in ("a", "  a ", "ﬁ")]
        self.safe = not any("▁" in p.lstrip("▁") for p in pieces) and probe[0] == ["▁a"] and "".join(probe[1]) == "▁▁▁a▁" and "".join(probe[2]).endswith("ﬁ")
        self.cache: dict[str, int] = {"": 0}

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)] if texts else []

    def count_long(self, text: str, size: int) -> int:
        """Count of one text, in parts where cuts are safe."""
        return sum(self.count([part])[0] for part in safe_parts(text.replace("▁", " "), size)) if self.safe else self.lengths([text])[0]

    def count(self, texts: list[str]) -> list[int]:
        if not self.safe:
            return self.lengths(texts)
        split: list[list[str]] = []
        for t in texts:
            t = t.replace("▁", " ")
            if "  " in t or t[:1] == " " or t[-1:] == " ":
                # The model adds one space in front of a text, and so of a piece: a piece leaves one off.
                split.append([x[1:] if x.strip(" ") else x for x in self._cut.findall(" " + t)] if t else [])
            else:
                split.append(t.split(" "))
        if len(self.cache) > CACHE_ENTRIES:
            self.cache = {"": 0}
        cache = self.cache
        unknown = {p for ps in split for p in set(ps) if p not in cache}
        new = list(unknown)
        # A piece of spaces only ends a text: it is counted behind a letter.
        spaces = [not p.strip(" ") for p in new]
        got = self.lengths(["a" + p if s else p for p, s in zip(new, spaces, strict=True)])
        fresh = {p: n - s for p, n, s in zip(new, got, spaces, strict=True)}
        cache.update((p, n) for p, n in fresh.items() if len(p) <= CACHE_CHARS)
        long = {p: n for p, n in fresh.items() if len(p) > CACHE_CHARS}
        if long:
            return [sum(cache[p] if p in cache else long[p] for p in ps) for ps in split]
        look = cache.__getitem__
        return [sum(map(look, ps)) for ps in split]


def safe_parts(text: str, size: int) -> list[str]:
    """A text in parts of about `size` characters, cut before runs of spaces with something behind them.

    The model puts one space in front of a text, so each part but the first leaves one of its own off.
    """
    parts, begin, last = [], 0, len(text.rstrip(" "))
    while len(text) - begin > size:
        at = text.find(" ", begin + size)
        while 0 < at and text[at - 1] == " ":
            at -= 1
        if not begin < at < last:
            break
        parts.append(text[begin:at])
        begin = at + 1
    return [*parts, text[begin:]]


class WholeTextCounter:
    """Counts of a tokenizers file; texts stay whole, since its rules may span any character."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def count(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.model.encode_batch(texts, add_special_tokens=False)]

    def count_long(self, text: str, size: int) -> int:
        return self.count([text])[0]


def counter(path: str):
    """The counter of a vocabulary file, loaded once a worker."""
    if path not in _loaded:
        _loaded[path] = (PieceCounter if path.endswith(".model") else WholeTextCounter)(path)
    return _loaded[path]


def counting(path: str, size: int = BATCH_BYTES) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = counter(path)
        for batch in batches:
            _, offsets = text_buffers(batch.column(1))
            for i, j in chunks(offsets, size):
                texts = [x or "" for x in batch.column(1).slice(i, j - i).to_pylist()]
                out = [model.count_long(texts[0], size)] if len(texts) == 1 and len(texts[0]) > size else model.count(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.asarray(out, np.int64))], names=["key", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 4096, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row per row of `docs`: the key, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows give repeated rows, a null key
    stays null, an empty table gives no rows, and no other column of `docs` is read.
    """
    kind = docs.schema[key].dataType.simpleString()
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    sized = slim.select("key", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    packed = sized.select(F.struct("key", "n_bytes").alias("key"), "text")
    counted = packed.mapInArrow(counting(path, batch_bytes), f"key struct<key:{kind},n_bytes:bigint>, n_tokens bigint")
    return counted.select(F.col("key.key").alias(key), F.col("key.n_bytes").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

"""LM scoring with a weighted back-off automaton over words.

States are word histories (the empty one, words, word pairs); an arc (state, word) is kept when its
n-gram occurs at least `min_count` times, and every state has a failure arc to its longest proper
suffix. Counts grow with the corpus, so they stay distributed:

1. Texts become blocks of token numbers, written once, bucketed by block.
2. Every word gets a number and its count from its part of the vocabulary.
3. A block asks for its own distinct n-grams, as word numbers; parts of the n-grams add up what all
   blocks ask and reply in the order of the asking. A word's n-grams are in one part, or dealt over
   as many as its count needs.
4. A block builds the automaton of its own n-grams, whose weights are those of the whole, and
   traverses its texts from left to right.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpoint, chunks, mix64, n_splits, shared_folder, text_buffers, word_hashes

#: The token that ends every text.
END = int(mix64(np.array([77], np.uint64))[0])
#: Taken from the count of every kept arc.
DISCOUNT = 0.75
#: Tokens of a block, about; a task holds some 100 bytes a token.
BLOCK_TOKENS = 2_000_000
#: Tokens of a long text that are traversed in one go; the next ones start from the state they lead to.
SEGMENT = 1024
_WORDS, _GRAMS = 0, 1


def tokens(column: pa.Array):
    """Per chunk of whole texts: first row, token hashes with the end tokens, first token of each row (rows + 1)."""
    data, offsets = text_buffers(column)
    for i, j in chunks(offsets):
        words, first = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        starts = first + np.arange(len(first))
        out = np.empty(len(words) + len(first) - 1, np.uint64)
        ends = starts[1:] - 1
        inner = np.ones(len(out), bool)
        inner[ends] = False
        out[inner], out[ends] = words, np.uint64(END)
        yield i, out, starts


def _pack(arrays: list[np.ndarray]) -> bytes:
    """64-bit arrays as one compressed value, equal bytes of the numbers side by side."""
    raw = b"".join([np.array([len(arrays), *map(len, arrays)], np.int64).tobytes(), *(np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8).T.tobytes() for a in arrays)])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(data: bytes) -> list[np.ndarray]:
    """The arrays of `_pack`, as int64."""
    raw = np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True), np.uint8)
    count = int(raw[:8].view(np.int64)[0])
    sizes = raw[8 : 8 * (count + 1)].view(np.int64)
    ends = 8 * (count + 1 + np.cumsum(sizes))
    return [np.ascontiguousarray(raw[e - 8 * s : e].reshape(8, -1).T).reshape(-1).view(np.int64) for s, e in zip(sizes.tolist(), ends.tolist())]


def _steps(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as differences, which pack better; `np.cumsum` gives them back."""
    return np.diff(keys, prepend=keys.dtype.type(0))


def _group_steps(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Values that rise within groups of these sizes, as differences from the one before in the group."""
    out = values.copy()
    out[1:] -= values[:-1]
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    out[first] = values[first]
    return out


def _group_values(steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The values of `_group_steps`."""
    total = np.cumsum(steps)
    first = np.cumsum(sizes) - sizes
    before = np.where(first > 0, total[np.maximum(first, 1) - 1], 0) if len(total) else first
    return total - np.repeat(before, sizes)


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    """Part of each key; it rises with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _split(x: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    return np.split(x, np.cumsum(sizes)[:-1])


_ROWS = "kind int, block bigint, part bigint, data binary"


def _rows(rows: list[tuple]) -> pa.Table:
    """(kind, block, part, data) as a table."""
    kind, block, part, data = zip(*rows) if rows else ([], [], [], [])
    return pa.table({"kind": pa.array(kind, pa.int32()), "block": pa.array(block, pa.int64()), "part": pa.array(part, pa.int64()), "data": pa.array(data, pa.binary())})


def _blocks(block_tokens: int):
    """(key, train, text) to a row per block: keys, train, its texts as token numbers, its words with their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        held: list[tuple] = []
        size = 0

        def block() -> pa.RecordBatch:
            length = np.concatenate([h[3] for h in held])
            train = pa.chunked_array([h[1] for h in held]).combine_chunks()
            words, of, every = np.unique(np.concatenate([h[2] for h in held]), return_inverse=True, return_counts=True)
            of = of.reshape(-1)
            n = np.bincount(of[np.repeat(train.to_numpy(zero_copy_only=False), length)], minlength=len(words)).astype(np.int64)
            # Frequent words get small numbers, which pack better.
            rank = np.empty(len(words), np.int64)
            rank[np.argsort(-every, kind="stable")] = np.arange(len(words))
            keys = pa.chunked_array([h[0] for h in held]).combine_chunks()
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            data = _pack([length, every.astype(np.int64), rank[of]])
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), one(keys), one(train), pa.array([data], pa.binary()), pa.array([_pack([_steps(words), n])], pa.binary())], names=["block", "keys", "train", "data", "words"])

        for batch in batches:
            for i, toks, first in tokens(batch.column(2)):
                rows = len(first) - 1
                held.append((batch.column(0).slice(i, rows), batch.column(1).slice(i, rows), toks, np.diff(first)))
                size += len(toks)
                if size >= block_tokens:
                    yield block()
                    held, size, number = [], 0, number + 1
        if held:
            yield block()

    return run


def _asking_words(parts: int):
    """(block, words) to a row per part that a block has words in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, n = _unpack(data)
                words = np.cumsum(words.view(np.uint64))
                edges = np.searchsorted(_part(words, parts), np.arange(parts + 1)).tolist()
                rows = [(_WORDS, block, p, _pack([_steps(words[i:j]), n[i:j]])) for p, (i, j) in enumerate(zip(edges[:-1], edges[1:])) if j > i]
                yield from _rows(rows).to_batches()

    return run


def _answering_words(parts: int, share: int):
    """Per asked word: its number, its count, and the parts that its n-grams are dealt over. A row without block has the totals."""

    def answer(asked: pa.Table) -> pa.Table:
        part, blocks = asked.column("part")[0].as_py(), asked.column("block").to_pylist()
        asks = [_unpack(x) for x in asked.column("data").to_pylist()]
        keys, of = np.unique(np.concatenate([np.cumsum(a[0].view(np.uint64)) for a in asks]), return_inverse=True)
        of = of.reshape(-1)
        c = np.bincount(of, np.concatenate([a[1] for a in asks]), len(keys)).astype(np.int64)
        number = np.empty(len(keys), np.int64)
        number[np.argsort(-c, kind="stable")] = np.arange(len(keys)) * parts + part
        spread = np.clip(-(-c // share), 1, parts)
        split = [_split(x[of], [len(a[0]) for a in asks]) for x in (number, c, spread)]
        rows = [(_WORDS, block, part, _pack([s[i] for s in split])) for i, block in enumerate(blocks)]
        return _rows([*rows, (_WORDS, None, part, _pack([np.array([c.sum(), (c > 0).sum(), (c == 1).sum(), (c == 2).sum()])]))])

    return answer


@dataclass
class Block:
    """The texts of a block and their n-grams; words are numbered by their hashes.

    length: tokens of each text; text: its tokens' words; number, count, spread: of each word, over all
    blocks. Of pairs and triples (distinct, in the order in which a block asks): `pair` and `triple`
    at the token where they end (-1 near the start of a text), their words, and occurrences in training.
    asked: per part the words that open its pairs, how many pairs each has, and how many triples each pair has.
    """

    length: np.ndarray
    text: np.ndarray
    number: np.ndarray
    count: np.ndarray
    pair: np.ndarray
    pairs: np.ndarray
    pair_n: np.ndarray
    triple: np.ndarray
    triples: np.ndarray
    triple_n: np.ndarray
    asked: list[tuple[np.ndarray, np.ndarray]]
    pair_cuts: np.ndarray
    triple_cuts: np.ndarray

    @classmethod
    def read(cls, data: bytes, train: np.ndarray, replies: list[tuple[int, bytes]], parts: int) -> Block:
        length, every, rank = _unpack(data)
        text = np.argsort(-every, kind="stable")[rank]
        number, count, spread = (np.concatenate(x) for x in zip(*(_unpack(d) for _, d in sorted(replies))))
        width, trained = len(number), np.repeat(train, length)
        place = np.arange(len(text)) - np.repeat(np.cumsum(length) - length, length)

        at = np.flatnonzero(place >= 1)
        code, of = np.unique(text[at - 1] * width + text[at], return_inverse=True)
        w1, w2 = np.divmod(code, width)
        salt = number[w2] % spread[w1]
        part = _deal(number[w1], salt, parts)
        order = np.lexsort((number[w2], number[w1], part))
        rank = np.empty(len(code), np.int64)
        rank[order] = np.arange(len(code))
        pair = np.full(len(text), -1)
        pair[at] = rank[of.reshape(-1)]
        pairs, part = np.stack([w1, w2])[:, order], part[order]
        pair_n = np.bincount(pair[at][trained[at]], minlength=len(code)).astype(np.int64)

        at = np.flatnonzero(place >= 2)
        # Words by number, so that triples are in the order of the numbers.
        by_number = np.argsort(number)
        rank = np.empty(width, np.int64)
        rank[by_number] = np.arange(width)
        code, first, of = np.unique(pair[at - 1] * width + rank[text[at]], return_index=True, return_inverse=True)
        triple = np.full(len(text), -1)
        triple[at] = of.reshape(-1)
        # Opening pair, last word, and closing pair.
        triples = np.stack([code // width, by_number[code % width], pair[at][first]])
        triple_n = np.bincount(triple[at][trained[at]], minlength=len(code)).astype(np.int64)

        pair_cuts = np.searchsorted(part, np.arange(parts + 1))
        triple_cuts = np.searchsorted(triples[0], pair_cuts)
        # Frequent words ask every part that has pairs of theirs, so that they learn their sums.
        hot = np.unique(w1[spread[w1] > 1])
        extra = [np.repeat(hot, spread[hot]), np.concatenate([np.arange(s) for s in spread[hot].tolist()] or [np.empty(0, np.int64)])]
        extra_part = _deal(number[extra[0]], extra[1], parts)
        asked = []
        by_part = np.argsort(extra_part, kind="stable")
        extra_cuts = np.searchsorted(extra_part[by_part], np.arange(parts + 1))
        for p in range(parts):
            own = pairs[0][pair_cuts[p] : pair_cuts[p + 1]]
            opens = np.concatenate([own, extra[0][by_part[extra_cuts[p] : extra_cuts[p + 1]]]])
            numbers, first, of = np.unique(number[opens], return_index=True, return_inverse=True)
            asked.append((opens[first], np.bincount(of.reshape(-1)[: len(own)], minlength=len(numbers)).astype(np.int64)))
        return cls(length, text, number, count, pair, pairs, pair_n, triple, triples, triple_n, asked, pair_cuts, triple_cuts)


def _deal(number: np.ndarray, salt: np.ndarray, parts: int) -> np.ndarray:
    return (mix64(number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salt.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _read(texts: pa.Table, replies: pa.Table, parts: int) -> Block:
    rows = zip(*(replies.column(c).to_pylist() for c in ("kind", "part", "data")))
    return Block.read(texts.column("data")[0].as_py(), texts.column("train")[0].values.to_numpy(zero_copy_only=False), [(p, d) for k, p, d in rows if k == _WORDS], parts)


def _asking(parts: int):
    """One row per part that a block has pairs in."""

    def ask(texts: pa.Table, replies: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _rows([])
        b, rows, block = _read(texts, replies, parts), [], texts.column("block")[0].as_py()
        triples_of = np.bincount(b.triples[0], minlength=len(b.pair_n))
        for p, (opens, pairs_of) in enumerate(b.asked):
            if not len(opens):
                continue
            i, j, k, m = *b.pair_cuts[p : p + 2], *b.triple_cuts[p : p + 2]
            second, third = _group_steps(b.number[b.pairs[1][i:j]], pairs_of), _group_steps(b.number[b.triples[1][k:m]], triples_of[i:j])
            rows.append((_GRAMS, block, p, _pack([_steps(b.number[opens]), pairs_of, second, b.pair_n[i:j], triples_of[i:j], third, b.triple_n[k:m]])))
        return _rows(rows)

    return ask


def _answering(least: int):
    """Replies to the n-grams of a part: of each opening word and pair, the kept arcs' sum of counts and number; of each pair and triple, its count if kept, or 0."""

    def answer(asked: pa.Table) -> pa.Table:
        part, blocks = asked.column("part")[0].as_py(), asked.column("block").to_pylist()
        asks = [_unpack(x) for x in asked.column("data").to_pylist()]
        column = lambda k: np.concatenate([a[k] for a in asks])
        opens, of1 = np.unique(np.concatenate([np.cumsum(a[0]) for a in asks]), return_inverse=True)
        second = np.concatenate([_group_values(a[2], a[1]) for a in asks])
        third = np.concatenate([_group_values(a[5], a[4]) for a in asks])
        wide2, wide3 = int(second.max(initial=0)) + 1, int(third.max(initial=0)) + 1
        pairs, of2 = np.unique(np.repeat(of1.reshape(-1), column(1)) * wide2 + second, return_inverse=True)
        triples, of3 = np.unique(np.repeat(of2.reshape(-1), column(4)) * wide3 + third, return_inverse=True)
        of1, of2, of3 = of1.reshape(-1), of2.reshape(-1), of3.reshape(-1)
        c2, c3 = (np.bincount(of, n, len(keys)).astype(np.int64) for of, n, keys in ((of2, column(3), pairs), (of3, column(6), triples)))
        kept2, kept3 = c2 >= least, c3 >= least
        of_word = [np.bincount((pairs // wide2)[kept2], x, len(opens)).astype(np.int64) for x in (c2[kept2], None)]
        of_pair = [np.bincount((triples // wide3)[kept3], x, len(pairs)).astype(np.int64) for x in (c3[kept3], None)]
        values = [*((x, of1, 0) for x in of_word), (np.where(kept2, c2, 0), of2, 2), *((x, of2, 2) for x in of_pair), (np.where(kept3, c3, 0), of3, 5)]
        split = [_split(x[of], [len(a[k]) for a in asks]) for x, of, k in values]
        return _rows([(_GRAMS, block, part, _pack([s[i] for s in split])) for i, block in enumerate(blocks)])

    return answer


@dataclass
class Automaton:
    """States: 0 the empty history, 1 + w a word, 1 + words + b a pair; w and b number those of one block.

    Arcs from words and pairs are sorted by (state, word), with log10 weights and the states they lead
    to; every word has an arc from the empty history. `fail` and `fail_log` are the failure arcs.
    """

    words: int
    log_word: np.ndarray
    arcs: list[np.ndarray]
    arc_log: list[np.ndarray]
    arc_to: list[np.ndarray]
    fail: np.ndarray
    fail_log: np.ndarray
    pair_kept: np.ndarray

    @classmethod
    def build(cls, b: Block, replies: list[tuple[int, bytes]], least: int, n: int, v: int, cut: float) -> Automaton:
        width = len(b.number)
        word_sums = np.zeros((2, width))
        got: list[list[np.ndarray]] = [[] for _ in range(4)]
        for p, data in sorted(replies):
            total, arcs, *rest = _unpack(data)
            opens = b.asked[p][0]
            word_sums[0, opens] += total
            word_sums[1, opens] += arcs
            for x, y in zip(got, rest):
                x.append(y)
        c2, total, arcs, c3 = (np.concatenate(x).astype(np.float64) if x else np.empty(0) for x in got)
        if len(c2) != len(b.pair_n) or len(c3) != len(b.triple_n):
            raise RuntimeError("a block's replies don't match its n-grams")
        c1 = b.count.astype(np.float64)
        p1 = np.where(c1 > 0, c1 - cut, max(cut * v, 1e-9)) / n if n else np.ones(width)

        def left_over(c: np.ndarray, total: np.ndarray, arcs: np.ndarray) -> np.ndarray:
            """What the kept arcs leave to the failure arc; all, for a history that is no state."""
            return np.where(c >= least, 1 - (total - DISCOUNT * arcs) / np.maximum(c, 1), 1.0)

        back1, back2 = left_over(c1, *word_sums), left_over(c2, total, arcs)
        w1, w2 = b.pairs
        pair_kept, triple_kept = c2 >= least, c3 >= least
        p2 = np.where(pair_kept, (c2 - DISCOUNT) / np.maximum(c1[w1], 1), 0) + back1[w1] * p1[w2]
        opening, last, closing = b.triples
        p3 = ((c3 - DISCOUNT) / np.maximum(c2[opening], 1) + back2[opening] * p2[closing])[triple_kept]
        order2, order3 = (np.argsort(x, kind="stable") for x in (((1 + w1) * width + w2)[pair_kept], ((1 + width + opening) * width + last)[triple_kept]))
        pairs = np.flatnonzero(pair_kept)[order2]
        triples = np.flatnonzero(triple_kept)[order3]
        return cls(
            width,
            np.log10(p1),
            [((1 + w1) * width + w2)[pairs], ((1 + width + opening) * width + last)[triples]],
            [np.log10(p2[pairs]), np.log10(p3[order3])],
            [1 + width + pairs, 1 + width + closing[triples]],
            np.concatenate([np.zeros(1 + width, np.int64), 1 + w2]),
            np.log10(np.concatenate([[1.0], back1, back2])),
            pair_kept,
        )

    def traverse(self, b: Block) -> np.ndarray:
        """log10 probability of each text: one pass over its tokens, all texts at once, that carries the state."""
        ends = np.cumsum(b.length)
        parts = -(-b.length // SEGMENT)
        row = np.repeat(np.arange(len(parts)), parts)
        begin = np.repeat(ends - b.length, parts) + SEGMENT * (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts))
        size = np.minimum(begin + SEGMENT, ends[row]) - begin
        order = np.argsort(-size, kind="stable")
        row, begin, size = row[order], begin[order], size[order]
        # The tokens before a later segment lead to their pair's state, if there is one, or to their word's.
        ahead = begin > (ends - b.length)[row]
        pair = b.pair[begin - 1]
        held = ahead & (pair >= 0) & (self.pair_kept[pair] if len(self.pair_kept) else False)
        state = np.where(held, 1 + self.words + pair, np.where(ahead, 1 + b.text[begin - 1], 0))
        score = np.zeros(len(row))
        for step in range(int(size.max(initial=0))):
            active = int(np.searchsorted(-size, -step, "left"))
            word, at, now = b.text[begin[:active] + step], np.arange(active), state[:active].copy()
            # Arcs of pairs first; a state without an arc for the word fails to its suffix.
            for arcs, log, to, least_state in ((self.arcs[1], self.arc_log[1], self.arc_to[1], 1 + self.words), (self.arcs[0], self.arc_log[0], self.arc_to[0], 1)):
                here = now[at] >= least_state
                look, key = at[here], now[at[here]] * self.words + word[at[here]]
                k = np.minimum(np.searchsorted(arcs, key), max(len(arcs) - 1, 0))
                hit = arcs[k] == key if len(arcs) else np.zeros(len(key), bool)
                score[look[hit]] += log[k[hit]]
                state[look[hit]] = to[k[hit]]
                missed = look[~hit]
                score[missed] += self.fail_log[now[missed]]
                now[missed] = self.fail[now[missed]]
                at = np.concatenate([at[~here], missed])
            score[at] += self.log_word[word[at]]
            state[at] = 1 + word[at]
        return np.bincount(row, score, len(b.length))


def lm_scores(docs: DataFrame, is_train, key: str = "doc_id", text: str = "text", min_count: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Train on the rows where the column `is_train` holds, and score the whole text of every row.

    Columns: key, held_out, n_tokens (words and one end), n_known (tokens seen in training),
    train_tokens, base_score (add-one unigrams), score (the automaton's log10 probability). All
    unknown words are one token type for both. Unigrams: absolute discount; its mass is the unknown
    word's. Pairs and triples: every one seen `min_count` times or more is an arc, with absolute
    discount 0.75; the rest goes through the failure arc. A null or empty text is its end token.
    Repeated rows, of one key too, each count and are each scored; keys, null ones too, are only
    passed on. Without training rows every token is unknown and has probability 1. An empty table
    gives no rows. No other column of `docs` is read.
    """
    spark, least = docs.sparkSession, max(min_count, 1)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.coalesce(is_train, F.lit(False)).alias("train"), F.col(text).alias("text"))
    blocks = rows.mapInArrow(_blocks(block_tokens), f"block bigint, keys array<{kind}>, train array<boolean>, data binary, words binary")
    # Bucketed, so that a block meets its replies without moving again; the name goes, the files and the plan stay.
    name = f"loomsift_{uuid.uuid4().hex}"
    folder = os.path.join(shared_folder(spark), name)
    blocks.write.bucketBy(min(n_splits(docs), 100_000), "block").option("path", folder).option("compression", "none").saveAsTable(name)
    stored = spark.table(name)
    parts = max(1, stored.select("block").count())

    asked = stored.select("block", "words").mapInArrow(_asking_words(parts), _ROWS)
    words = checkpoint(asked.groupBy("part").applyInArrow(_answering_words(parts, max(1, block_tokens // 8)), _ROWS))
    n, v, n1, n2 = sum((_unpack(bytes(r.data))[0] for r in words.where("block is null").select("data").toLocalIterator()), np.zeros(4, np.int64)).tolist()
    cut = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5
    numbers = words.where("block is not null")

    texts = stored.select("block", "keys", "train", "data")
    asked = texts.select("block", "train", "data").groupBy("block").cogroup(numbers.groupBy("block")).applyInArrow(_asking(parts), _ROWS)
    grams = checkpoint(asked.groupBy("part").applyInArrow(_answering(least), _ROWS))
    known = max(n + v + 1, 1)

    def score(own: pa.Table, replies: pa.Table) -> pa.Table:
        if not own.num_rows:
            return pa.table({c: pa.array([], t) for c, t in (("key", own.schema.field("keys").type.value_type), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()))})
        b = _read(own, replies, parts)
        got = [(p, d) for k, p, d in zip(*(replies.column(c).to_pylist() for c in ("kind", "part", "data"))) if k == _GRAMS]
        starts = np.cumsum(b.length) - b.length
        base, seen = (np.add.reduceat(x[b.text], starts) for x in (np.log10((b.count + 1) / known), (b.count > 0).astype(np.int64)))
        model = Automaton.build(b, got, least, n, v, cut)
        return pa.table({"key": own.column("keys")[0].values, "train": own.column("train")[0].values, "n_tokens": b.length, "n_known": seen, "base": base, "score": model.traverse(b)})

    scored = texts.groupBy("block").cogroup(numbers.unionByName(grams).groupBy("block")).applyInArrow(score, f"key {kind}, train boolean, n_tokens bigint, n_known bigint, base double, score double")
    spark.sql(f"DROP TABLE {name}")
    return scored.select(F.col("key").alias(key), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")

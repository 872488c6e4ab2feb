"""Conversation structure repair: the cheapest edits that give each conversation a legal order of roles.

Conversations of a task are put into time-major arrays by length. One pass from the last turn back
updates the costs of the four states of all of them at once and stores them; one pass from the first turn on
reads the edits off those costs. Conversations longer than a block are cut into blocks that run side
by side: first from each state they may end in, which gives how costs pass through a block, then from
the right one.

States: 0 nothing yet, 1 after a system turn, 2 after a user turn, 3 after an assistant turn. A
conversation may end in 0 or 3.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELETE, INSERT, RELABEL, TRUNCATED = 2, 5, 1, 5
_INF = np.int64(1) << 40
#: Turns of a block, turns that a task holds at once, and the state that a turn's own role (none, s, u, a) leads to from each state.
BLOCK, AT_ONCE = 2048, 1 << 18
_NEXT = np.full((4, 4), -1, np.int64)
_NEXT[1, 0] = 1
_NEXT[2, [0, 1, 3]] = 2
_NEXT[3, 2] = 3
#: Where a user or assistant turn, whichever is due, leads to.
_DUE = np.array([2, 2, 3, 2])
_D, _I, _K, _R = (ord(c) for c in "DIKR")


def _inserts(cost: np.ndarray) -> np.ndarray:
    """Costs [..., 4] once turns may be inserted first; two in a row at most are of use."""
    out = cost.copy()
    out[..., 2] = np.minimum(cost[..., 2], INSERT + cost[..., 3])
    out[..., 3] = np.minimum(cost[..., 3], INSERT + cost[..., 2])
    for s in (0, 1):
        out[..., s] = np.minimum(cost[..., s], INSERT + out[..., 2])
    return out


def _moves(role: np.ndarray, forced: np.ndarray, cut: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs [conversations, 4] of deleting, keeping and relabelling a turn, given the costs after it."""
    delete = DELETE + after
    to = _NEXT[role]
    extra = np.where(forced, _INF, np.where(cut, TRUNCATED, 0))[:, None]
    keep = np.where(to >= 0, np.take_along_axis(after, np.maximum(to, 0), 1), _INF) + extra
    return delete, keep, after[:, _DUE] + RELABEL + extra


def backward(role: np.ndarray, forced: np.ndarray, cut: np.ndarray, length: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Costs [turns + 1, conversations, 4] of the cheapest edits from each turn on; end: costs after the last one."""
    turns = len(role)
    cost = np.empty((turns + 1, len(length), 4), np.int64)
    cost[turns] = end
    for t in range(turns - 1, -1, -1):
        best = _inserts(np.minimum.reduce(_moves(role[t], forced[t], cut[t], cost[t + 1])))
        # What is shorter has its end here still.
        cost[t] = np.where((length > t)[:, None], best, end)
    return cost


def forward(role: np.ndarray, forced: np.ndarray, cut: np.ndarray, length: np.ndarray, cost: np.ndarray, state: np.ndarray, final: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edits [conversations, 3 places a turn and 2 at the end], 0 for none, each the ASCII-least of the cheapest; and the last states.

    final: where no block follows, so that turns may be inserted at the end.
    """
    turns, n = role.shape[0], len(length)
    edits, state, every = np.zeros((3 * turns + 2, n), np.uint8), state.copy(), np.arange(n)
    for t in range(turns + 1):
        here = (length > t) if t < turns else np.zeros(n, bool)
        ends = (length == t) & final
        moves = _moves(role[t], forced[t], cut[t], cost[t + 1]) if t < turns else None
        for step in (0, 1):
            now = cost[t][every, state]
            held = (moves[0][every, state] == now) if moves is not None else np.zeros(n, bool)
            due = INSERT + cost[t][every, _DUE[state]] == now
            put = due & ((here & ~held) | ends)
            edits[3 * t + step] = np.where(put, _I, 0)
            state = np.where(put, _DUE[state], state)
        if moves is None:
            break
        now, (delete, keep, _) = cost[t][every, state], moves
        gone, kept = delete[every, state] == now, keep[every, state] == now
        edits[3 * t + 2] = np.where(here, np.where(gone, _D, np.where(kept, _K, _R)), 0)
        to = np.where(gone, state, np.where(kept, _NEXT[role[t], state], _DUE[state]))
        state = np.where(here, to, state)
    return edits.T, state


def solve(conversations: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[tuple[int, bytes]]:
    """(cost, edits) per conversation, given by role (0 none, 1 s, 2 u, 3 a), forced and cut of its turns."""
    out: list[tuple[int, bytes]] = [(0, b"")] * len(conversations)
    # Blocks and whole conversations alike; buckets by the next power of two.
    pieces = [(c, b) for c, (role, _, _) in enumerate(conversations) for b in range(0, max(len(role), 1), BLOCK)]
    size = np.array([min(BLOCK, len(conversations[c][0]) - b) for c, b in pieces], np.int64)
    bucket = np.ceil(np.log2(np.maximum(size, 1))).astype(int)
    usual = _inserts(np.array([0, _INF, _INF, 0], np.int64))
    last = np.array([b + BLOCK >= len(conversations[c][0]) for c, b in pieces], bool)
    arrays: dict[int, tuple[np.ndarray, list[np.ndarray]]] = {}
    for k in np.unique(bucket):
        rows = np.flatnonzero(bucket == k)
        turns = int(size[rows].max())
        padded = [np.zeros((turns, len(rows)), kind) for kind in (np.int64, bool, bool)]
        for j, i in enumerate(rows):
            c, b = pieces[i]
            for to, of in zip(padded, conversations[c], strict=True):
                to[: size[i], j] = of[b : b + size[i]]
        arrays[int(k)] = rows, padded
    first = {c: i for i, (c, b) in enumerate(pieces) if b == 0}
    ends = np.tile(usual, (len(pieces), 1))
    if not last.all():
        # How costs pass through a block: from each single state after it.
        through = np.empty((len(pieces), 4, 4), np.int64)
        for rows, padded in arrays.values():
            for s in range(4):
                end = np.full((len(rows), 4), _INF)
                end[:, s] = 0
                through[rows, s] = backward(*padded, size[rows], end)[0]
        for i in range(len(pieces) - 1, -1, -1):
            if not last[i]:
                follow = np.minimum((through[i + 1] + ends[i + 1][:, None]).min(0), _INF)
                ends[i] = follow
    begun = np.zeros(len(pieces), np.int64)
    edits: list[bytes] = [b""] * len(pieces)
    total = np.zeros(len(pieces), np.int64)
    costs = {}
    for k, (rows, padded) in arrays.items():
        costs[k] = backward(*padded, size[rows], ends[rows])
    whole = np.array([last[i] and pieces[i][1] == 0 for i in range(len(pieces))], bool)
    for k, (rows, padded) in arrays.items():
        total[rows] = costs[k][0, :, 0]
        # Where a block starts follows from the one before; so traces start from every state, and the right one is taken.
        states = (0,) if whole[rows].all() else range(4)
        traced = [forward(*padded, size[rows], costs[k], np.full(len(rows), s), last[rows]) for s in states]
        arrays[k] = rows, [traced]
    where = {int(i): (k, j) for k, (rows, _) in arrays.items() for j, i in enumerate(rows)}
    for i, (_, b) in enumerate(pieces):
        k, j = where[i]
        traced = arrays[k][1][0]
        at = begun[i] if len(traced) > 1 else 0
        row, ended = traced[at][0][j], traced[at][1][j]
        edits[i] = row[row > 0].tobytes()
        if not last[i]:
            begun[i + 1] = ended
    for c, i in first.items():
        stop = i + 1
        while stop < len(pieces) and pieces[stop][0] == c:
            stop += 1
        out[c] = int(total[i]), b"".join(edits[i:stop])
    return out


def _blank(text: Column) -> Column:
    return ~text.rlike(r"[^\x20\x09-\x0D]")


def faults(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: Column | None = None) -> DataFrame:
    """conv, turn, role, text (nulls of the last two are one space), mark, initial, flags: 1 blank, 2 truncated, 4 not there."""
    t, r = F.coalesce(F.col(text), F.lit(" ")), F.coalesce(F.col(role), F.lit(" "))
    base = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), r.alias("role"), t.alias("text"), (gone if gone is not None else F.lit(False)).alias("gone"))
    flags = F.when(_blank(F.col("text")), 1).otherwise(0) + F.when(F.col("text").rlike(r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z"), 2).otherwise(0) + F.when(F.col("gone"), 4).otherwise(0)
    initial = F.coalesce(*[F.when(F.startswith("role", F.lit(c)), i) for i, c in ((1, "s"), (2, "u"), (3, "a"))], F.lit(0))
    return base.select("conv", "turn", "role", "text", F.md5("text").alias("mark"), initial.cast("int").alias("initial"), flags.cast("int").alias("flags"))


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Tables of whole conversations of some `most` rows, from rows sorted by conversation."""
    held: list[pa.Table] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        n += batch.num_rows
        if n < most:
            continue
        table = pa.concat_tables(held).combine_chunks()
        ends = _run_ends(table.column("conv"))
        if len(ends) > 1:
            yield table.slice(0, ends[-2])
            table = table.slice(ends[-2])
        held, n, most = [table], table.num_rows, max(most, 2 * table.num_rows)
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _run_ends(column: pa.ChunkedArray) -> list[int]:
    """Ends of the runs of equal values, nulls equal too."""
    if not len(column):
        return []
    codes = column.combine_chunks().dictionary_encode(null_encoding="encode")
    codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy(zero_copy_only=False)
    return [*(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of conversations in order (conv, turn, role, mark, initial, flags) to one row a conversation."""
    for table in _runs(batches, AT_ONCE):
        ends = _run_ends(table.column("conv"))
        initial, flags = (table.column(c).to_numpy() for c in ("initial", "flags"))
        turn_null = table.column("turn").is_null().to_numpy()
        turn = table.column("turn").fill_null(0).to_numpy()
        # One number per role and text, for what was seen earlier.
        said = pa.compute.binary_join_element_wise(table.column("role"), table.column("mark"), ":").combine_chunks()
        said = said.combine_chunks() if isinstance(said, pa.ChunkedArray) else said
        said = said.dictionary_encode().indices.to_numpy()
        there = (flags & 4) == 0
        of = np.repeat(np.arange(len(ends)), np.diff([0, *ends]))
        blank, seen = (flags & 1) != 0, np.ones(len(flags), bool)
        at = np.flatnonzero(there)
        seen[at[np.unique(of[at] * (int(said.max(initial=0)) + 1) + said[at], return_index=True)[1]]] = False
        duplicate = seen & ~blank
        cut = ((flags & 2) != 0) & ~blank & ~duplicate
        rows, begin = [], 0
        for end in ends:
            own = begin + np.flatnonzero(there[begin:end])
            begin = end
            first = initial[own]
            pairs = first[:-1] * 4 + first[1:]
            known = turn[own][~turn_null[own]]
            rows.append((
                int(known.max()) - int(known.min()) + 1 - len(np.unique(known)) if len(known) else 0,
                int(blank[own].sum()), int(duplicate[own].sum()), int(cut[own].sum()),
                int((~np.isin(pairs, (1 * 4 + 2, 2 * 4 + 3, 3 * 4 + 2))).sum()), own,
            ))
        solved = solve([(initial[own], (blank | duplicate)[own], cut[own]) for *_, own in rows])
        keys = table.column("conv").take(pa.array([e - 1 for e in ends], pa.int64())).combine_chunks()
        keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
        columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)]
        yield pa.RecordBatch.from_arrays([keys, *columns, pa.array([c for c, _ in solved], pa.int64()), pa.array([e.decode() for _, e in solved], pa.string())], names=["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])


def repair_reports(found: DataFrame) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost, audit per conversation of `faults`. No text moves for it."""
    kind = found.schema["conv"].dataType.simpleString()
    slim = found.select("conv", F.col("turn").cast("long").alias("turn"), "role", "mark", "initial", "flags")
    return slim.repartition("conv").sortWithinPartitions("conv", "turn", "role", "mark").mapInArrow(_reports, f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


_OUT = ("conv", "place", "role", "text", "edit")


def _repairing(digest: bool):
    """Rows in order, each conversation led by its audit, to repaired turns or to the SHA-256 of their role:text lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, audit, at, place, state, sha = None, "", 0, 0, 0, hashlib.sha256()
        started = False
        kind = None

        def said(role: str, text: str, edit: str) -> None:
            nonlocal place
            if digest:
                sha.update(f"{chr(10) if place else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            else:
                out.append((key, place, role, text, edit))
            place += 1

        def due() -> str:
            nonlocal state
            state = int(_DUE[state])
            return "user" if state == 2 else "assistant"

        def inserted() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                at += 1
                said(due(), "", "I")

        def over() -> None:
            if started:
                inserted()
                if digest:
                    out.append((key, sha.hexdigest()))

        out: list[tuple] = []
        for batch in batches:
            kind = batch.schema.field("conv").type
            convs, lead = batch.column("conv").to_pylist(), batch.column("audit").to_pylist()
            roles, texts, initials = batch.column("role").to_pylist(), batch.column("text").to_pylist(), batch.column("initial").to_pylist()
            for conv, told, role, text, initial in zip(convs, lead, roles, texts, initials, strict=True):
                if told is not None:
                    over()
                    key, audit, at, place, state, sha, started = conv, told, 0, 0, 0, hashlib.sha256(), True
                    continue
                inserted()
                edit = audit[at]
                at += 1
                if edit == "K":
                    state = int(_NEXT[initial, state])
                    said(role, text, "K")
                elif edit == "R":
                    said(due(), text, "R")
            yield from _emit(out, kind, digest)
            out.clear()
        over()
        if kind is not None:
            yield from _emit(out, kind, digest)

    return run


def _emit(out: list[tuple], kind: pa.DataType, digest: bool) -> Iterator[pa.RecordBatch]:
    if out:
        kinds = (kind, pa.string()) if digest else (kind, pa.int64(), pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["conv", "repaired_sha256"] if digest else list(_OUT))


def _led(found: DataFrame, reports: DataFrame) -> DataFrame:
    """The turns that are there, each conversation led by its audit."""
    kind = found.schema["conv"].dataType.simpleString()
    none = lambda t: F.lit(None).cast(t)
    leads = reports.select("conv", F.lit(0).alias("follows"), none("long").alias("turn"), none("string").alias("role"), none("string").alias("mark"), "audit", none("string").alias("text"), none("int").alias("initial"))
    turns = found.where(F.col("flags").bitwiseAND(F.lit(4)) == 0).select("conv", F.lit(1).alias("follows"), F.col("turn").cast("long").alias("turn"), "role", "mark", none("string").alias("audit"), "text", "initial")
    assert kind == leads.schema["conv"].dataType.simpleString()
    return leads.union(turns).repartition("conv").sortWithinPartitions("conv", "follows", "turn", "role", "mark").select("conv", "audit", "role", "text", "initial")


def repaired_turns(found: DataFrame, reports: DataFrame) -> DataFrame:
    """conv, place (from 0), role, text, edit (K kept, R relabelled, I inserted) of the repaired conversations."""
    kind = found.schema["conv"].dataType.simpleString()
    return _led(found, reports).mapInArrow(_repairing(False), f"conv {kind}, place long, role string, text string, edit string")


def repaired_digests(found: DataFrame, reports: DataFrame) -> DataFrame:
    """conv, repaired_sha256: of the repaired turns as role:text, joined by line feeds; a text is hashed as it streams by."""
    kind = found.schema["conv"].dataType.simpleString()
    return _led(found, reports).mapInArrow(_repairing(True), f"conv {kind}, repaired_sha256 string")

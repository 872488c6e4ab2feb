"""Exact top-k search by inner product with block-at-a-time pruning.

Vectors in a range of ids form a document-range block with a forward index (its integer matrix) and,
per term (component), the least and greatest value. For a query, a block's bound is the sum over
terms of the greatest product its term bounds allow. Blocks are scored in the order of their bounds
until the next bound falls below the k-th score so far.

Queries are dealt into tiles and blocks into groups. A tile first searches one group, its home, which
gives every query a k-th score to start from. Then the bounds of all other blocks, a hundredth of
the vectors, meet the tile, and only blocks that may still hold a result of it are sent there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import checkpoint, n_splits

#: Vectors of a document-range block.
BLOCK_ROWS = 256
#: Blocks that one task searches for one tile of queries.
GROUP_BLOCKS = 64
#: Queries of a tile, about. A vector of d components takes 8 d bytes, so a tile or group stays at tens of MB.
TILE_QUERIES = 2048
#: The least long: a start below any score.
FLOOR = np.iinfo(np.int64).min


def quantised(values: list, scale: float) -> np.ndarray | None:
    """floor(scale * x) of every component, or None where the vector takes no part."""
    if values is None or any(v is None for v in values):
        return None
    x = np.asarray(values, np.float64)
    if not np.isfinite(x).all():
        return None
    with np.errstate(over="ignore"):
        x = np.floor(x * scale)
    return x if np.isfinite(x).all() else None


def _matrices(column: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows that take part, and their quantised components with zeros behind shorter vectors."""
    kept, rows = [], []
    if isinstance(column, pa.ListArray) and len(column) and not column.null_count and not column.flatten().null_count:
        size = column.value_lengths().to_numpy()
        if (size == size[0]).all():
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), int(size[0]))
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(flat * scale)
            good = np.isfinite(x).all(1)
            return np.flatnonzero(good), x[good]
    for i, values in enumerate(column.to_pylist()):
        if (x := quantised(values, scale)) is not None:
            kept.append(i)
            rows.append(x)
    width = max([0, *(len(x) for x in rows)])
    return np.array(kept, np.int64), np.array([np.pad(x, (0, width - len(x))) for x in rows]).reshape(len(rows), width)


_PACKED = "block bigint, n int, width int, ids binary, data binary, top binary, low binary"


def _packing(scale: float, size: int):
    """Sorted (id, vector) rows of a task to rows of packed blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            kept, x = _matrices(batch.column(1), scale)
            ids = batch.column(0).to_numpy(zero_copy_only=False)[kept]
            for i in range(0, len(ids), size):
                part = np.ascontiguousarray(x[i : i + size]).astype("<f8")
                values = [number, len(part), part.shape[1], ids[i : i + size].astype("<i8").tobytes(), part.tobytes(), part.max(0).tobytes(), part.min(0).tobytes()]
                kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["block", "n", "width", "ids", "data", "top", "low"])
                number += 1

    return run


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["data"], "<f8").reshape(row["n"], row["width"])


def _queries(rows: pa.Table, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, integer vectors and k-th scores to start from, of a tile's queries."""
    kept, q = _matrices(rows.column("x").combine_chunks(), scale)
    return rows.column("id").to_numpy()[kept], q, rows.column("least").to_numpy()[kept]


def _widen(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def _product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products; saturated to the range of a long where they leave it."""
    most = float(np.abs(q).sum(1).max(initial=0)) * float(np.abs(x).max(initial=0))
    if most < 2.0**53:
        return (q @ x.T).astype(np.int64)
    exact = np.array([[int(v) for v in r] for r in q], object) @ np.array([[int(v) for v in r] for r in x], object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def bounds(q: np.ndarray, top: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Per query and block, a number that no score in the block exceeds."""
    bound = np.maximum(q, 0) @ top.T + np.minimum(q, 0) @ low.T
    # Sums that a double can't hold exactly get room for their rounding; scores end where a long does.
    return np.minimum(bound + np.abs(bound) * 1e-9, 2.0**63)


def search_blocks(queries: tuple[np.ndarray, np.ndarray], blocks: list[tuple[np.ndarray, np.ndarray]], k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The k best (query id, vector id, score) of every query in these blocks; and the pairs of query and block scored.

    least: per query a score that k vectors elsewhere reach; what falls below it may be left out.
    """
    qid, q = queries
    width = max([q.shape[1], *(x.shape[1] for _, x in blocks)])
    q = _widen(q, width)
    blocks = [(i, _widen(x, width)) for i, x in blocks]
    least = np.full(len(qid), FLOOR) if least is None else least
    bound = bounds(q, np.stack([x.max(0) for _, x in blocks]), np.stack([x.min(0) for _, x in blocks]))
    order = np.argsort(-bound, axis=1, kind="stable")
    best_score, best_id = np.full((len(qid), k), FLOOR), np.full((len(qid), k), np.iinfo(np.int64).max)
    filled = np.zeros(len(qid), np.int64)
    active, scored = np.arange(len(qid)), 0
    for step in range(len(blocks)):
        at = order[active, step]
        go = (bound[active, at] >= least[active]) & ((filled[active] < k) | (bound[active, at] >= best_score[active, k - 1]))
        active, at = active[go], at[go]
        if not len(active):
            break
        scored += len(active)
        for b in np.unique(at):
            rows = active[at == b]
            ids, x = blocks[b]
            score = _product(q[rows], x)
            same = ids[None, :] == qid[rows][:, None]
            ids2 = np.broadcast_to(ids, score.shape)
            all_score, all_id = np.concatenate([best_score[rows], score], 1), np.concatenate([best_id[rows], ids2], 1)
            real = np.concatenate([np.arange(k)[None, :] < filled[rows][:, None], ~same], 1)
            pick = np.lexsort((all_id, -np.clip(all_score, FLOOR + 1, None), ~real), axis=1)[:, :k]
            best_score[rows], best_id[rows] = np.take_along_axis(all_score, pick, 1), np.take_along_axis(all_id, pick, 1)
            filled[rows] = np.minimum(k, real.sum(1))
    held = np.arange(k)[None, :] < filled[:, None]
    return np.repeat(qid, filled), best_id[held], best_score[held], scored


def top_k_search(vectors: DataFrame, is_query, k: int = 5, scale: float = 256.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per row for which the column `is_query` holds, the k best other rows by inner product.

    Columns: query_id, rank (from 1), the key, score. Components are floor(scale * x). Ties go to the
    smaller id. Vectors that are null or hold null or non-finite components take no part; a null id
    takes none either. Vectors of unequal length meet as if the shorter ended in zeros. Scores beyond
    a long are held at its end. Rows of one id are each a candidate, but never for that id; as a
    query, of several vectors that take part, the least in the order of arrays counts. An empty table
    gives no rows; other columns are not read.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("x"), F.coalesce(is_query, F.lit(False)).alias("q")).where("id is not null")
    fits = F.forall("x", lambda v: v.isNotNull() & (F.abs(v.cast("double") * scale) < float("inf")) & ~F.isnan(v))
    asked = rows.where(F.col("q") & F.coalesce(fits, F.lit(False))).groupBy("id").agg(F.min("x").alias("x"))
    # Ranges of ids, so that a block is a range; only whole rows move.
    ranged = rows.select("id", "x").repartitionByRange(n_splits(vectors), "id").sortWithinPartitions("id")
    blocks = checkpoint(ranged.mapInArrow(_packing(scale, BLOCK_ROWS), _PACKED))
    # Both numbers follow the counts, so that a tile and a group keep their size.
    groups = max(1, -(-blocks.count() // GROUP_BLOCKS))
    n_tiles = max(1, -(-asked.count() // TILE_QUERIES))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    blocks = blocks.withColumn("group", dealt("block", groups))
    tiled = asked.withColumn("tile", dealt("id", n_tiles)).withColumn("home", dealt("tile", groups))

    def search(tile: pa.Table, group: pa.Table) -> pa.Table:
        have = [_unpack(r) for r in group.select(["ids", "data", "n", "width"]).to_pylist()]
        found = [np.empty(0, np.int64)] * 3
        if have and tile.num_rows:
            ids, q, least = _queries(tile, scale)
            found = search_blocks((ids, q), have, k, least)[:3]
        return pa.table(dict(zip(("query_id", "id", "score"), found)))

    def reach(tile: pa.Table, group: pa.Table) -> pa.Table:
        """Blocks whose bound reaches the k-th score of some query of the tile."""
        kept: list[int] = []
        if tile.num_rows:
            _, q, least = _queries(tile, scale)
            for r in group.to_pylist():
                top, low = (np.frombuffer(r[c], "<f8")[None, :] for c in ("top", "low"))
                width = max(q.shape[1], r["width"])
                if (bounds(_widen(q, width), _widen(top, width), _widen(low, width))[:, 0] >= least).any():
                    kept.append(r["block"])
        tiles = tile.column("tile")[0].as_py() if tile.num_rows else 0
        return pa.table({"tile": pa.array([tiles] * len(kept), pa.int64()), "block": pa.array(kept, pa.int64())})

    found = "query_id bigint, id bigint, score bigint"
    query = lambda df: df.select("tile", "group", "id", "x", "least")
    homes = tiled.select((F.col("tile") + 0).alias("tile"), (F.col("home") + 0).alias("group")).distinct()
    at_home = query(tiled.withColumns({"group": F.col("home"), "least": F.lit(int(FLOOR)).cast("long")}))
    first = checkpoint(at_home.groupBy("tile", "group").cogroup(blocks.join(homes, "group").groupBy("tile", "group")).applyInArrow(search, found))
    if groups > 1:
        kth = first.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("n"), F.min("score").alias("kth"))
        started = tiled.join(kth, "id", "left").withColumn("least", F.when(F.col("n") >= k, F.col("kth")).otherwise(F.lit(int(FLOOR))).cast("long"))
        away = query(started.withColumn("group", upto(groups)).where("group <> home"))
        sketches = blocks.select("group", "block", "width", "top", "low").withColumn("tile", upto(n_tiles))
        needed = checkpoint(away.groupBy("tile", "group").cogroup(sketches.groupBy("tile", "group")).applyInArrow(reach, "tile bigint, block bigint"))
        sent = blocks.join(needed, "block")
        first = first.unionByName(away.groupBy("tile", "group").cogroup(sent.groupBy("tile", "group")).applyInArrow(search, found))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")

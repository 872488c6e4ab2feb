"""Embedding near-dedup: spherical k-means cells, blocked cosine products, one vector kept per group.

Equal vectors become one with a count. A vector is at home in the cell of its nearest centroid and
probes every cell that a vector linked to it can be at home in. A pair is looked for in the home of
its greater id, so it counts once and none is missed. In cells of any size, tiles of probing vectors meet
tiles of those at home, and send back sums and spanning edges, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpoint
from ._components import connected_components, edge_labels

#: Vectors that the centroids are fitted on, about; a bound, chosen by hash.
SAMPLE = 40_000
#: Cells at least, where there are so many vectors, and at most; a cell beyond its aim is compared in more tiles.
LEAST_CELLS, MOST_CELLS = 4, 4096
#: Vectors of one label that a cell aims at.
CELL_ROWS = 2048
#: Rows of a tile: two tiles of d components take 16 d KB.
TILE_ROWS = 1024


def spherical_k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of unit rows; starts from rows picked at even steps; an empty cell keeps its centroid."""
    x = x[np.lexsort(x.T)]
    centroids = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = (x @ centroids.T).argmax(1)
        total = np.zeros_like(centroids)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1)
        centroids[size > 0] = total[size > 0] / size[size > 0, None]
    return centroids


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def probed(unit: np.ndarray, centroids: np.ndarray, threshold: float, margin: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, cell, and whether the cell is its home, for every cell that can be home to a vector of cosine `threshold` or more.

    Such a vector is beyond the plane that bisects the two centroids, which is then at most the link
    angle away: the row's distance to the plane is at most the sine of that angle, of which `margin` is the
    share that is probed.
    """
    cosine = unit @ centroids.T
    home = cosine.argmax(1)
    own = cosine[np.arange(len(home)), home]
    if threshold > 0:
        apart = np.sqrt(np.maximum(2 - 2 * (centroids @ centroids.T), 0))
        # The slack is for rounding.
        near = own[:, None] - cosine <= margin * math.sqrt(max(1 - threshold * threshold, 0)) * apart[home] + 1e-7
    else:
        near = np.ones(cosine.shape, bool)
    near[np.arange(len(home)), home] = True
    row, cell = np.nonzero(near)
    return row, cell, home[row] == cell


def _assigning(shared, threshold: float, margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = shared.value
        for batch in batches:
            size = batch.column(1).value_lengths().to_numpy()
            row, cell, home = np.arange(len(size)), np.zeros(len(size), np.int64), np.ones(len(size), bool)
            fits = np.flatnonzero(size == centroids.shape[1])
            if len(centroids) > 1 and len(fits):
                x = _matrix(batch.column(1).take(pa.array(fits)))
                r, c, h = probed(x / np.linalg.norm(x, axis=1)[:, None], centroids, threshold, margin)
                rest = np.flatnonzero(size != centroids.shape[1])
                row, cell, home = np.concatenate([fits[r], rest]), np.concatenate([c, np.zeros(len(rest), np.int64)]), np.concatenate([h, np.ones(len(rest), bool)])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(cell.astype(np.int32)), pa.array(home)], names=["id", "cell", "home"])

    return run


def near_duplicate_groups(vectors: DataFrame, threshold: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label", cells: int | None = None, margin: float = 1.0) -> DataFrame:
    """One row per row of `vectors`: key, n_links, component_id, kept.

    Two vectors are compared when their labels are equal and not null and their lengths are equal,
    and linked when their cosine in double precision is at least `threshold`. A vector that is null,
    empty, zero or holds null or non-finite components has no link; nor has one with a null key.
    n_links: other rows linked directly; component_id: least key reachable (the row's own without
    links); kept: key = component_id. Rows of one key and vector count as copies; different vectors of
    one key have each their own links, and one class. An empty table gives no rows.

    cells: number of k-means cells, else one for about CELL_ROWS vectors of a label. margin: 1 finds
    every link; less probes fewer cells and may miss links, never adds one.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("x"))
    good = F.col("x").isNotNull() & F.col("id").isNotNull() & F.col("label").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    # Components near the ends of the double range would overflow in squares: the vector is scaled.
    most = F.array_max(F.transform("x", F.abs))
    scaled = F.when((most > 1e100) | (most < 1e-100), F.transform("x", lambda v: v / most)).otherwise(F.col("x"))
    valid = rows.where(F.coalesce(good, F.lit(False))).select("id", "label", scaled.alias("x"))
    keyed = valid.withColumns({"h1": F.xxhash64("label", "x"), "h2": F.xxhash64("x", F.lit(1), "label")})
    once = checkpoint(keyed.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.any_value("label").alias("label"), F.any_value("x").alias("x")))

    n, labels = once.agg(F.count("*"), F.approx_count_distinct("label")).first()
    k = cells or min(MOST_CELLS, max(LEAST_CELLS, round(n / max(1, labels) / CELL_ROWS)))
    width = once.groupBy(F.size("x").alias("w")).count().orderBy(F.desc("count"), "w").first() if n else None
    centroids = np.zeros((1, width["w"] if width else 1))
    if n:
        part = once.where(F.size("x") == width["w"]).where(F.pmod(F.xxhash64("h1"), F.lit(1 << 20)) < F.lit(math.ceil(min(1.0, SAMPLE / n) * (1 << 20)))).select("x").toPandas()
        sample = np.array(part["x"].tolist()).reshape(-1, width["w"])
        if len(sample):
            centroids = spherical_k_means(sample / np.linalg.norm(sample, axis=1)[:, None], min(k, len(sample)))
    kind = once.schema["id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(centroids)
    passed = F.struct("id", "h1", "copies", "label", "x")
    placed = once.select(passed.alias("id"), "x").mapInArrow(_assigning(shared, threshold, margin), f"id {once.select(passed).schema[0].dataType.simpleString()}, cell int, home boolean")
    placed = checkpoint(placed.select("id.*", "cell", "home", F.size("id.x").alias("w")))
    # Rows that probe a cell meet those at home there, tile by tile: each goes to all tiles of the other side.
    sizes = placed.groupBy("label", "w", "cell").agg(F.ceil(F.count("*") / TILE_ROWS).cast("int").alias("probes"), F.ceil(F.count_if("home") / TILE_ROWS).cast("int").alias("homes"))
    tiled = placed.join(sizes, ["label", "w", "cell"])
    own = lambda c: F.pmod(F.xxhash64("h1"), F.greatest(F.col(c), F.lit(1))).cast("int")
    upto = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    met = lambda side, probe, home: F.struct(F.lit(side).alias("side"), probe.alias("probe"), home.alias("at"))
    probing = F.transform(upto("homes"), lambda t: met(0, own("probes"), t))
    at_home = F.when(F.col("home"), F.transform(upto("probes"), lambda t: met(1, t, own("homes")))).otherwise(F.array().cast("array<struct<side:int,probe:int,at:int>>"))
    paired = tiled.withColumn("to", F.explode(F.concat(probing, at_home))).select("label", "w", "cell", "to.*", "id", "h1", "copies", "x")

    def compare(group: pa.Table) -> pa.Table:
        ids, h1, copies, side = (group.column(c).to_numpy() for c in ("id", "h1", "copies", "side"))
        # The order of ids numbers the vectors; one may be on both sides.
        order = np.lexsort((h1, ids))
        fresh = np.ones(len(ids), bool)
        fresh[1:] = (np.diff(ids[order]) != 0) | (np.diff(h1[order]) != 0)
        number = np.empty(len(ids), np.int64)
        number[order] = np.cumsum(fresh) - 1
        first = order[fresh]
        x = _matrix(group.column("x").combine_chunks())
        size = np.linalg.norm(x, axis=1)
        probes, homes = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        n, label = np.zeros(len(first), np.int64), np.arange(len(first))
        edges = []
        for i in range(0, len(probes), 256):
            p = probes[i : i + 256]
            # The greater of a pair is at home here.
            links = ((x[p] @ x[homes].T) / (size[p, None] * size[None, homes]) >= threshold) & (number[p, None] < number[None, homes])
            n[number[p]] += links @ copies[homes]
            n[number[homes]] += copies[p] @ links
            a, b = np.nonzero(links)
            edges.append((number[p[a]], number[homes[b]]))
        a, b = (np.concatenate([e[k] for e in edges]) if edges else np.empty(0, np.int64) for k in (0, 1))
        held = np.flatnonzero(n > 0)
        root = edge_labels(label, a, b)[held]
        return pa.table({"id": ids[first[held]], "h1": h1[first[held]], "n": n[held], "root": ids[first[root]]})

    found = checkpoint(paired.groupBy("label", "w", "cell", "probe", "at").applyInArrow(compare, f"id {kind}, h1 bigint, n bigint, root {kind}"))
    reached = connected_components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    direct = found.groupBy("id", "h1").agg(F.sum("n").alias("n"))
    groups = once.join(direct, ["id", "h1"], "left").join(reached, "id", "left").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n"), F.coalesce("component", "id").alias("component"))
    out = keyed.select("id", "h1", "h2").join(groups, ["h1", "h2"]).select("id", "n", "component").unionByName(rows.where(~F.coalesce(good, F.lit(False))).select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("component")))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_links"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))

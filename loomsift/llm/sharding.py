"""Sharding along a Hilbert curve: rows near in several metadata dimensions come into the same files.

Every dimension is quantised at exact quantiles of all rows. A row's cell in that grid has an index on
the Hilbert curve; rows are sorted by it and the order is cut into runs of equal counts. A run covers
few values of each dimension, so filters on any of them skip most files.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import checkpoint

_PLACE_BITS = 33


def hilbert_index(axes: list[np.ndarray], bits: int) -> np.ndarray:
    """Place on the Hilbert curve of grid points; each axis holds numbers below 2**bits. Axes times bits is 63 at most."""
    if len(axes) * bits > 63:
        raise ValueError("the curve's index has 63 bits: take fewer bits or dimensions")
    x = [np.asarray(a).astype(np.int64) for a in axes]
    for b in range(bits - 1, 0, -1):
        bit, low = np.int64(1 << b), np.int64((1 << b) - 1)
        for i in range(len(x)):
            up = (x[i] & bit) != 0
            # Above the middle the first axis is mirrored; below it, the two axes change places.
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] & np.int64(1 << b)) != 0, np.int64((1 << b) - 1), 0)
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for axis in x:
            out = (out << 1) | (((axis ^ turn) >> b) & 1)
    return out


def in_order(df: DataFrame, by: list[str], parts: int) -> DataFrame:
    """`df` sorted over range partitions, with `part` and `place` (from 0 in its part); written once, so that they stay."""
    placed = df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    return checkpoint(placed).withColumns({"part": F.shiftright("at", _PLACE_BITS), "place": F.col("at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))}).drop("at")


def with_rows_before(placed: DataFrame, n: Column) -> tuple[DataFrame, int]:
    """The parts of in_order with the sum of `n` over all parts before, `before`; and the sum of all.

    A row per part goes through the driver: as many as the partitions that were asked for.
    """
    sums = sorted((r["part"], r["n"]) for r in placed.groupBy("part").agg(F.sum(n).alias("n")).collect())
    rows, total = [], 0
    for part, size in sums:
        rows.append((part, total))
        total += size
    told = placed.sparkSession.createDataFrame(rows, "of_part long, before long")
    return placed.join(F.broadcast(told), F.col("part") == F.col("of_part")).drop("of_part"), total


def cut_points(cells: DataFrame, dim: str, bits: int, parts: int) -> list[tuple[object, int]]:
    """(value, bucket) from the least value on: a value's bucket is its rank among all rows over their number, in 2**bits.

    cells: the dimension, n. Rows with null have no rank. As buckets rise, there are 2**bits of them at most.
    """
    values = in_order(cells.where(F.col(dim).isNotNull()).groupBy(dim).agg(F.sum("n").alias("n")), [dim], parts)
    counted, total = with_rows_before(values, F.col("n"))
    if not total:
        return []
    from pyspark.sql import Window

    run = Window.partitionBy("part").orderBy("place")
    lesser = F.col("before") + F.sum("n").over(run) - F.col("n")
    # lesser < total; split in two, so that the product stays in 64 bits.
    bucket = lambda v: F.floor(v / F.lit(float(total)) * (1 << bits)).cast("int")
    at = counted.select(F.col(dim).alias("v"), bucket(lesser).alias("b"))
    # The least value of each bucket starts it.
    return sorted(((r["v"], min(r["b"], (1 << bits) - 1)) for r in at.groupBy("b").agg(F.min("v").alias("v")).collect()), key=lambda r: r[1])


def bucket_of(value: Column, cuts: list[tuple[object, int]]) -> Column:
    """The bucket of a value, 0 for null."""
    out = F.lit(0)
    for v, b in cuts:
        out = F.when(value >= F.lit(v), F.lit(b)).otherwise(out)
    return out.cast("int")


def hilbert_shards(docs: DataFrame, shards: int, by: list[str], tie: list[str], bits: int = 6, name: str = "sharding") -> DataFrame:
    """All columns of `docs` and the struct `name`: shard (from 0), slot (gapless from 0 in its shard), curve (the index).

    Shards' counts are at most one apart. `by` names the dimensions, of any ordered types; null is in
    the first bucket. Rows of one cell go by the columns of `tie`, nulls first, and alike ones in any order, so
    a hot value or a large group of copies is cut like any other run. What is alike in `tie`'s first
    column and the dimensions stays together, but where a run ends. With fewer rows than shards some
    shards are empty; an empty table gives no rows. A column of `docs` that is called `name` gives way.
    """
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = docs.select(F.struct(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"), *[docs[f"`{c}`"].alias(f"d{i}") for i, c in enumerate(by)], *[docs[f"`{c}`"].alias(f"t{i}") for i, c in enumerate(tie)])
    dims, ties = [f"d{i}" for i in range(len(by))], [f"t{i}" for i in range(len(tie))]
    # Distinct combinations with their counts, from one scan of these columns.
    cells = checkpoint(rows.groupBy(*dims).agg(F.count("*").alias("n")))
    grid = [bucket_of(F.col(d), cut_points(cells, d, bits, parts)) for d in dims]

    def index(*axes: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index([a.to_numpy() for a in axes], bits))

    curve = F.pandas_udf(index, "long")(*grid)
    # Copies have numbers of their own, so that no range of the order is theirs alone.
    ordered = in_order(rows.select("row", *ties, curve.alias("curve"), F.monotonically_increasing_id().alias("of_row")), ["curve", *ties, "of_row"], max(parts, shards))
    counted, total = with_rows_before(ordered, F.lit(1))
    low, more = divmod(total, shards)
    rank = F.col("before") + F.col("place")
    late = rank - more * (low + 1)
    one = F.lit(max(low, 1)).cast("long")
    shard = F.when(late < 0, F.floor(rank / (low + 1))).otherwise(more + (late - F.pmod(late, one)) / one)
    slot = F.when(late < 0, F.pmod(rank, F.lit(low + 1))).otherwise(F.pmod(late, one))
    kept = [F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() != name.lower()]
    return counted.select(*kept, F.struct(shard.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.col("curve").alias("curve")).alias(name))


def write_shards(docs: DataFrame, folder: str, shards: int, by: list[str], tie: list[str], bits: int = 6) -> DataFrame:
    """Write `docs` as Parquet, a folder shard=N each, rows in the curve's order; returns and writes its manifest.

    The manifest has a row per shard: shard, n, and least_<dim>, most_<dim>, nulls_<dim>; see shards_for.
    """
    name = "sharding"
    while name in docs.columns or "shard" in docs.columns:
        if "shard" in docs.columns:
            raise ValueError("a column is called shard, as the folders are")
        name += "_"
    put = hilbert_shards(docs, shards, by, tie, bits, name)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), shards)
    rows = put.select(*[c for c in docs.columns], F.col(f"{name}.shard").alias("shard"), F.col(f"{name}.slot").alias("_slot"))
    rows.repartitionByRange(parts, "shard", "_slot").sortWithinPartitions("shard", "_slot").drop("_slot").write.partitionBy("shard").parquet(f"{folder}/rows")
    written = docs.sparkSession.read.parquet(f"{folder}/rows")
    stats = [x for c in by for x in (F.min(c).alias(f"least_{c}"), F.max(c).alias(f"most_{c}"), F.count_if(F.col(c).isNull()).alias(f"nulls_{c}"))]
    written.groupBy("shard").agg(F.count("*").alias("n"), *stats).coalesce(1).write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.parquet(f"{folder}/manifest")


def shards_for(manifest: DataFrame, box: dict[str, tuple[object, object]]) -> DataFrame:
    """The manifest's shards that can hold rows with every named dimension in its range, ends included."""
    out = manifest
    for c, (low, high) in box.items():
        out = out.where((F.col(f"most_{c}") >= F.lit(low)) & (F.col(f"least_{c}") <= F.lit(high)))
    return out

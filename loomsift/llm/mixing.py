"""Mixing sources to target weights by temperature, in DataFrame operations only.

Weights are source token shares to the power of an exponent, normalised. The exponent is bisected,
many points a round, to meet a target entropy or a repetition limit. The weights become token budgets,
which each source spends on its blocks of documents: whole passes in the order of a permutation
each, then part of one more.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, checkpoint

#: Blocks of a source at most, so that ordering a source's blocks is a small task at any size.
MOST_BLOCKS = 4096
_ROUNDS, _POINTS = 8, 16


def token_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def dealt(*parts) -> Column:
    """A number from 0 to 2**32 - 1 for the parts' texts; the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def _bisect(reaches, low: float = 0.0, high: float = 1.0) -> float:
    """Least exponent in [low, high] at which `reaches` holds; it must hold from there on. high, if nowhere.

    `reaches` gets the points of a round at once, so a round is one job.
    """
    for _ in range(_ROUNDS):
        points = [low + (high - low) * i / _POINTS for i in range(_POINTS + 1)]
        at = next((i for i, ok in enumerate(reaches(points)) if ok), _POINTS)
        low, high = points[max(at - 1, 0)], points[at]
        if at == 0:
            return points[0]
    return high


def exponent(shares: DataFrame, repetition_limit: float | None, target_entropy: float | None) -> float:
    """The exponent for shares (column p, over 0): both conditions hold at the greater of their exponents.

    It is over 1 where the target entropy is below that of the shares. An entropy that no exponent
    reaches, below the logarithm of the number of greatest shares, is an error.
    """
    least, most = shares.agg(F.min("p"), F.max("p")).first()
    if least is None:
        return 1.0
    found = [0.0]
    if repetition_limit is not None:
        # The source with the least share is repeated (most / least) ** (1 - exponent) times.
        room = math.log(max(repetition_limit, 1.0))
        found.append(_bisect(lambda xs: [(1 - x) * math.log(most / least) <= room + 1e-12 for x in xs]))
    if target_entropy is not None:
        # By the greatest share, so that the sums are at least 1 at any exponent.
        p = F.col("p") / F.lit(most)

        def low_enough(xs: list[float]) -> list[bool]:
            got = shares.agg(*[c for x in xs for c in (F.sum(F.pow(p, F.lit(x))), F.sum(F.pow(p, F.lit(x)) * F.log(p)))]).first()
            return [math.log(got[2 * i]) - x * got[2 * i + 1] / got[2 * i] <= target_entropy for i, x in enumerate(xs)]

        ends = [2.0**k for k in range(0, 61, 4)]
        high = next((x for x, ok in zip(ends, low_enough(ends)) if ok), None)
        if high is None:
            raise ValueError(f"no exponent gives an entropy of at most {target_entropy}")
        found.append(_bisect(low_enough, high=high))
    return max(found)


def mixture(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", repetition_limit: float | None = 2.0, target_entropy: float | None = None, budget_tokens: int | None = None, block_tokens: int = 20_000, seed: int = 1, most_blocks: int = MOST_BLOCKS, name: str = "mix") -> DataFrame:
    """The rows of `docs`, each as often as its source's weight asks: all its columns and the struct `name`.

    Its fields: epoch (from 0), block, position (of the block in its epoch's permutation, from 1), n_tokens
    (words). Without `budget_tokens` the budget is the least that uses every row at least once; so
    nothing is lost, and the source of the greatest share is used once. A source's last pass stops
    at the block that comes nearest to its budget. A null source is the source of the empty name.
    Rows without words take no budget and come once, with block and position 0. An empty table
    gives no rows. The order of rows of one key is that of their texts' blocks, so copies stay together.
    A block holds about `block_tokens`, or more where a source would have over `most_blocks`: a power
    of two that bounds the task that orders a source's blocks. A column of `docs` that is called
    `name` gives way.
    """
    of_source = F.coalesce(F.col(source), F.lit(""))
    # A number below 2**32 for each row; its low bits are the fine part of its source, and lower ones its block.
    drawn = dealt(F.lit("block"), F.lit(seed), of_source, F.coalesce(F.col(key).cast("string"), F.lit("")))
    placed = docs.select(F.struct(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"), F.struct(of_source.alias("name"), F.pmod(drawn, F.lit(most_blocks)).alias("part"), token_count(text).alias("n_tokens")).alias("mix"))
    # The one pass that counts: what follows up to the last join works on these sums, `most_blocks` a source at most.
    sizes = checkpoint(placed.groupBy(F.col("mix.name").alias("name"), F.col("mix.part").alias("part")).agg(F.sum("mix.n_tokens").alias("n"))).where("n > 0")
    totals = sizes.groupBy("name").agg(F.sum("n").alias("tokens"))
    # A power of two, so that fine parts add up to blocks.
    wanted = F.least(F.lit(most_blocks), F.greatest(F.lit(1), F.ceil(F.col("tokens") / block_tokens)))
    totals = totals.withColumn("blocks", F.pow(F.lit(2.0), F.ceil(F.log2(wanted.cast("double")))).cast("long"))
    every = totals.agg(F.sum("tokens")).first()[0] or 0
    shares = totals.withColumn("p", F.col("tokens") / F.lit(float(every or 1)))
    power = exponent(shares, repetition_limit, target_entropy)
    weighed = shares.withColumn("w", F.pow("p", F.lit(power)))
    z, need, sources = weighed.agg(F.sum("w"), F.max(F.col("p") / F.col("w")), F.count("*")).first()
    # Repetitions of a source: its weight's share of the budget over its own tokens.
    scale = (budget_tokens / every / z if budget_tokens is not None else need) if every else 1.0
    plan = weighed.withColumn("repeat", F.lit(scale) * F.col("w") / F.col("p")).withColumn("whole", F.floor(F.col("repeat") + 1e-9))

    blocks = sizes.join(plan.select("name", "blocks", "tokens", "repeat", "whole"), "name").groupBy("name", F.pmod("part", "blocks").alias("block"), "blocks", "tokens", "repeat", "whole").agg(F.sum("n").alias("n"))
    passes = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole"))))
    order = Window.partitionBy("name", "epoch").orderBy(dealt(F.lit("pass"), F.lit(seed), F.col("name"), F.col("epoch"), F.col("block")), "block")
    ranked = passes.withColumns({"position": F.row_number().over(order).cast("long"), "before": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")})
    rest = (F.col("repeat") - F.col("whole")) * F.col("tokens")
    chosen = ranked.where((F.col("epoch") < F.col("whole")) | (F.col("before") + F.col("n") / 2 <= rest)).select("name", "block", "blocks", "epoch", "position")
    # One row per fine part of a source, with its block's passes in an array no longer than the repetitions.
    by_block = chosen.groupBy("name", "block", "blocks").agg(F.array_sort(F.collect_list(F.struct("epoch", "position"))).alias("passes"))
    parts = sizes.join(plan.select("name", "blocks"), "name").select("name", "part", F.pmod("part", "blocks").alias("block"))
    by_part = parts.join(by_block, ["name", "block"]).select(F.col("name").alias("_name"), F.col("part").alias("_part"), F.col("block").alias("_block"), "passes")
    # At most `most_blocks` rows a source: sent to every executor for so few sources that this is under 64 MB.
    passes_bytes = 16 * (2 + math.ceil(repetition_limit or 1) if budget_tokens is None and repetition_limit else 1 << 20)
    if sources * most_blocks * (64 + passes_bytes) <= 64 << 20:
        by_part = F.broadcast(by_part)
    met = placed.join(by_part, (placed["mix.name"] == by_part["_name"]) & (placed["mix.part"] == by_part["_part"]), "left")
    zero = F.lit(0).cast("long")
    once = F.array(F.struct(zero.alias("epoch"), zero.alias("position")))
    silent = F.col("mix.n_tokens") == 0
    passes = F.when(silent, once).otherwise(F.col("passes"))
    spread = met.select("row", "mix", F.when(silent, zero).otherwise(F.col("_block")).alias("_block"), F.explode(passes).alias("_pass"))
    kept = [F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() != name.lower()]
    return spread.select(*kept, F.struct(F.col("_pass.epoch").alias("epoch"), F.col("_block").alias("block"), F.col("_pass.position").alias("position"), F.col("mix.n_tokens").alias("n_tokens")).alias(name))

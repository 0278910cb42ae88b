"""For each item the block of text with which it shares most words, within a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.relational import clean_words

#: Items and blocks of a key that meet in one task; keys of more are cut.
CELL = (500, 5000)


def least_shared(size: Column) -> Column:
    """How many words must be shared with a block of ``size`` words: 4, or at least 2 that are over 0.6 of its words."""
    return F.when(size >= 5, 4).when(size == 4, 3).when(size >= 2, 2).otherwise(99)


def best_block(items: DataFrame, blocks: DataFrame, keys: list[str], item: list[str], order: list[str], text: str = "text", cell: tuple[int, int] = CELL) -> DataFrame:
    """(keys, item, order, overlap): the block of each item's key that shares most words with it, the first in ``order`` on ties.

    Words are as in ``clean_words``. Items without an eligible block are left out, and so are null keys.

    Each item and block is sent once, with its set of words, to where its key is, and all pairs of a key are
    counted there. A key of more items or blocks than a ``cell`` takes is cut into cells, each part of its items
    with each of its blocks in a task of its own choice, so no task gets a large key whole.
    """
    named = lambda df, columns: df.select(*keys, *columns, clean_words(text).alias("words"))
    counts = [df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / n).cast("int").alias(c)).where(F.col(c) > 1) for df, n, c in ((items, cell[0], "__is"), (blocks, cell[1], "__bs"))]

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        for large in counts:  # at most one row for each full cell
            rows = rows.join(F.broadcast(large), keys, "left")
        of = {c: F.coalesce(c, F.lit(1)) for c in ("__is", "__bs")}
        mine = F.pmod(F.xxhash64(*(c for c in rows.columns if c not in of)), of[own]).cast("int")
        return rows.withColumns({f"{own}_at": mine, f"{other}_at": F.explode(F.sequence(F.lit(0), of[other] - 1))}).drop(*of)

    left = dealt(named(items, item), "__is", "__bs").withColumnRenamed("words", "__mine")
    right = dealt(named(blocks, order).where(F.size("words") > 1), "__bs", "__is")
    # never by broadcast: sets of words are many times larger in memory than they are in shuffles
    pairs = left.hint("merge").join(right, [*keys, "__is_at", "__bs_at"])
    counted = pairs.select(*keys, *item, *order, F.size("words").alias("size"), F.size(F.array_intersect("words", "__mine")).cast("long").alias("overlap")).where(F.col("overlap") >= least_shared(F.col("size")))
    at = F.struct(*order)
    most = counted.groupBy(*keys, *item).agg(F.min_by(F.struct(*order, "overlap"), F.struct((-F.col("overlap")).alias("o"), at.alias("a"))).alias("b"))
    return most.select(*keys, *item, *(F.col(f"b.{c}").alias(c) for c in (*order, "overlap")))

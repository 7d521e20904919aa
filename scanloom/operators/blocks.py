"""Pairs within groups of very uneven size, without sending one group to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one group that one task may hold; larger groups are split into blocks of about this size.
BLOCK_ROWS = 2000


def pair_blocks(df: DataFrame, group: list[str], row_id: Column, sizes: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with the blocks in which each row meets the others of its group.

    ``sizes`` has the ``group`` columns and ``n``, the rows of the group. A group
    of at most ``block_rows`` rows is one block. A larger one is cut into
    ``b = ceil(n / block_rows)`` parts by a hash of ``row_id`` and a row of part
    ``i`` is sent to the ``b`` block pairs that hold ``i``; every two rows of the
    group then meet in exactly one block pair if ``meets`` is applied to the
    joined rows. Adds ``_part`` (own part), ``_lo`` and ``_hi`` (the block pair).
    Every row is kept; none of the groups is capped.
    """
    b = F.ceil(F.col("_size") / F.lit(block_rows)).cast("int")
    part = F.pmod(F.xxhash64(row_id), b).cast("int")
    out = df.join(sizes.select(*group, F.col("n").alias("_size")).hint("merge"), group).withColumn("_part", part)
    other = F.explode(F.sequence(F.lit(0), b - 1))
    return (
        out.select("*", other.alias("_other"))
        .withColumn("_lo", F.least("_part", "_other"))
        .withColumn("_hi", F.greatest("_part", "_other"))
        .drop("_other", "_size")
    )


def meets(left_part: Column, right_part: Column, lo: Column, hi: Column) -> Column:
    """True for the one block pair (``lo``, ``hi``) in which two rows of these parts are to be compared."""
    return (F.least(left_part, right_part) == lo) & (F.greatest(left_part, right_part) == hi)

"""Order-preserving numbering that survives one graph holding a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions per numbering block; a block is the most one task ever sorts for a single key.
BLOCK = 1 << 16


def block_of(pos: Column, width: int = BLOCK) -> Column:
    return F.floor(pos / F.lit(width)).cast("bigint")


def number_rows(df: DataFrame, keys: Sequence[str], pos: str, out: str, width: int = BLOCK) -> DataFrame:
    """Add ``out``: the dense 0-based rank of each row by ``pos`` within ``keys`` (``pos`` unique per key).

    A single window over ``keys`` would sort a whole hot group in one task. Here rows are ranked inside
    (keys, position block) and shifted by the row count of earlier blocks, so the largest sort is one block. The
    block counts are aggregated before the shuffle and only blocks after a key's first carry a shift, so for
    ordinary groups the joined side is empty and AQE drops the join. Counting evaluates ``df`` a second time, so it
    is best a stored table or a narrow plan.
    """
    keys = list(keys)
    blocked = df.withColumn("_block", block_of(F.col(pos), width))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        blocked.groupBy(*keys, "_block")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_shift", F.sum("_rows").over(earlier))
        .where(F.col("_shift") > 0)
        .drop("_rows")
    )
    rank = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(pos)) - 1
    return (
        blocked.withColumn("_rank", rank)
        .join(shifts, [*keys, "_block"], "left")
        .withColumn(out, (F.col("_rank") + F.coalesce("_shift", F.lit(0))).cast("bigint"))
        .drop("_block", "_rank", "_shift")
    )

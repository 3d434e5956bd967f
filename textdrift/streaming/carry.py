"""Last value carried along a long sequence, block by block.

A key's rows are cut into numbered units (chunks).  A unit's last value is
known inside it; what an earlier unit leaves behind comes from a scan of
several levels: the units' last values are carried inside blocks of units, the
blocks' last values inside blocks of blocks, and so on until a key has one
block.  No window ever holds more than a block, however long the sequence.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textdrift.session import materialize

BLOCK = 1000


def carried(lasts: DataFrame, key: Sequence[str], unit: str, value: str, out: str, block: int = BLOCK) -> DataFrame:
    """``key, unit, out``: the last non-null ``value`` of the units before.

    ``lasts`` holds one row per key and unit with a value or null; units are
    whole numbers from 0 on, and missing ones have no value.
    """
    # the largest unit number: one row
    top = lasts.agg(F.max(unit)).first()[0]
    if top is None or top < block:
        before = Window.partitionBy(*key).orderBy(unit).rowsBetween(Window.unboundedPreceding, -1)
        return lasts.select(*key, unit, F.last(value, ignorenulls=True).over(before).alias(out))
    # names of this level: the unit's own name grows with each level
    upper_unit, own, last, earlier = (f"{unit}_{x}" for x in ("block", "own", "last", "earlier"))
    blocked = lasts.withColumn(upper_unit, F.expr(f"`{unit}` div {block}"))
    inside = Window.partitionBy(*key, upper_unit).orderBy(unit).rowsBetween(Window.unboundedPreceding, -1)
    inner = blocked.withColumn(own, F.last(value, ignorenulls=True).over(inside))
    upper = materialize(blocked.groupBy(*key, upper_unit).agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col(unit))).alias(last)))
    before_block = carried(upper, key, upper_unit, last, earlier, block)
    return (inner.join(before_block, [*key, upper_unit], "left")
            .select(*key, unit, F.coalesce(own, earlier).alias(out)))

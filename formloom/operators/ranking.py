"""Row numbers inside groups of any size.

A plain ``row_number`` sorts a whole group in one task. Where a group may hold a
large share of all rows, the group is cut at a monotone bucket of its order key:
numbers are local to (group, bucket) and shifted by the rows of earlier buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], bucket: Column, name: str) -> DataFrame:
    """Add ``name`` = 1.. in ``order`` within ``keys``; ``bucket`` must not decrease along ``order``."""
    b, n, off = "__bucket", "__n", "__off"
    cut = df.withColumn(b, bucket)
    local = Window.partitionBy(*keys, b).orderBy(*order)
    sizes = cut.groupBy(*keys, b).agg(F.count("*").alias(n))
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(*keys, b, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(off))
    ranked = cut.withColumn(name, F.row_number().over(local))
    return (
        ranked.join(shift, [*keys, b])
        .withColumn(name, (F.col(name) + F.col(off)).cast("bigint"))
        .drop(b, off)
    )


def sum_before(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], bucket: Column, value: str, name: str) -> DataFrame:
    """Add ``name`` = sum of ``value`` over the earlier rows of the group, cut the same way."""
    b, off, part = "__bucket", "__off", "__sum"
    cut = df.withColumn(b, bucket)
    local = Window.partitionBy(*keys, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(*keys, b).agg(F.sum(value).alias(part))
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.select(*keys, b, F.coalesce(F.sum(part).over(before), F.lit(0)).alias(off))
    return (
        cut.withColumn(name, F.coalesce(F.sum(value).over(local), F.lit(0)))
        .join(shift, [*keys, b])
        .withColumn(name, F.col(name) + F.col(off))
        .drop(b, off)
    )


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key; an aggregate, so every map task sends one row per key."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__last"))
    return picked.select(*keys, *[F.col(f"__last.{c}").alias(c) for c in rest]).select(*df.columns)

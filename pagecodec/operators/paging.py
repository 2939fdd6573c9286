"""Cutting tables into ordered pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_page() -> Window:
    """Rows of a page in order."""
    return Window.partitionBy("page_id").orderBy("pos")


def by_page_value() -> Window:
    """Equal values of a page."""
    return Window.partitionBy("page_id", "v")


def paged(df: DataFrame, value: Column | str, *, key: str, order_by: Sequence[str], page_keys: int = 1024) -> DataFrame:
    """``page_id, pos, v``: key-range pages, rows numbered from 0 in a total order. One exchange by page."""
    v = F.expr(value) if isinstance(value, str) else value
    src = df.select(F.floor(F.col(key) / page_keys).cast("bigint").alias("page_id"), v.alias("v"), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order_by)])
    order = Window.partitionBy("page_id").orderBy(*[f"__o{i}" for i in range(len(order_by))])
    return src.select("page_id", (F.row_number().over(order) - 1).cast("bigint").alias("pos"), "v")


def exact_pages(df: DataFrame, value: Column | str, *, order_by: Sequence[str], page_rows: int = 65_536) -> DataFrame:
    """``page_id, pos, v`` with pages of exactly ``page_rows`` rows (the last may be shorter).

    Rows are range-partitioned; a row's number is its place in its partition plus the counts before it, which are one
    number per partition. No window spans the table.
    """
    v = F.expr(value) if isinstance(value, str) else value
    keys = [f"__o{i}" for i in range(len(order_by))]
    src = df.select(v.alias("v"), *[F.col(c).alias(k) for c, k in zip(order_by, keys, strict=True)])
    placed = src.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    # two jobs read it: a written copy where the session has a shared folder, else a cached one
    placed = placed.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else placed.persist()
    part = F.shiftright("at", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("low"))
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("low")).select("part", "start")
    row = F.col("at") + F.col("start")
    return placed.withColumn("part", part).join(F.broadcast(starts), "part").select(F.floor(row / page_rows).cast("bigint").alias("page_id"), (row % page_rows).cast("bigint").alias("pos"), "v")


def slice_window(p: DataFrame, start: int, end: int) -> DataFrame:
    """Rows ``start <= pos < end`` of each page, renumbered from 0."""
    if not 0 <= start <= end:
        raise ValueError("a slice needs 0 <= start <= end")
    return p.where((F.col("pos") >= start) & (F.col("pos") < end)).withColumn("pos", F.col("pos") - start)


def value_at(p: DataFrame, pos: int) -> DataFrame:
    """The value at one place of each page that has it."""
    return p.where(F.col("pos") == pos)


def validity_bitmap(p: DataFrame) -> DataFrame:
    """``page_id, byte_idx, validity_byte``: bit i of byte k is 1 where row 8k+i isn't null."""
    bit = F.when(F.col("v").isNotNull(), F.expr("shiftleft(1L, cast(pos % 8 as int))")).otherwise(F.lit(0))
    return p.groupBy("page_id", F.floor(F.col("pos") / 8).cast("bigint").alias("byte_idx")).agg(F.sum(bit).cast("bigint").alias("validity_byte"))

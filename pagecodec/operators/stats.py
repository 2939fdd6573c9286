"""Page statistics: one pass over pages in order, partial and final aggregation by page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bit_length, float_bits, wrapping_subtract
from .paging import by_page, by_page_value

#: Distinct values that a frequency map keeps; beyond it (or half the page) distinct counts as n.
MAP_LIMIT, STRING_MAP_LIMIT = 256, 4096


def with_change(p: DataFrame) -> DataFrame:
    """Adds ``change``: 1 where a run begins. Floats should be given by their bits."""
    before = F.lag("v").over(by_page())
    return p.withColumn("change", F.when((F.col("pos") > 0) & F.col("v").eqNullSafe(before), 0).otherwise(1))


def int_stats(p: DataFrame) -> DataFrame:
    return p.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("min_v"), F.max("v").alias("max_v"), F.bool_or(F.col("v") < 0).alias("has_negative"))


def run_stats(p: DataFrame) -> DataFrame:
    return with_change(p).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.sum("change").cast("bigint").alias("runs")).withColumn("is_const", F.col("runs") == 1)


def sequence_stats(p: DataFrame) -> DataFrame:
    """Whether a page is base + i * step with a step other than 0."""
    d = wrapping_subtract(F.col("v"), F.lag("v").over(by_page()))
    x = p.withColumn("d", d).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("v", "pos").alias("base"), F.min("d").alias("lo"), F.max("d").alias("hi"))
    ok = F.coalesce((F.col("lo") == F.col("hi")) & (F.col("lo") != 0), F.lit(False))
    return x.select("page_id", "n", ok.alias("is_sequence"), F.when(ok, F.col("base")).alias("base"), F.when(ok, F.col("lo")).alias("step"))


def distinct_stats(p: DataFrame, limit: int = MAP_LIMIT) -> DataFrame:
    """Retained distinct count and highest frequency: n and 0 once the map would be dropped."""
    per = p.groupBy("page_id", "v").agg(F.count(F.lit(1)).alias("c")).groupBy("page_id").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("d"), F.max("c").alias("most"))
    over = F.col("d") > F.greatest(F.lit(1), F.least(F.lit(limit), F.floor(F.col("n") / 2)))
    return per.select("page_id", "n", F.when(over, F.col("n")).otherwise(F.col("d")).cast("bigint").alias("distinct_v"), F.when(over, 0).otherwise(F.col("most")).cast("bigint").alias("most_frequent"))


def dominance(p: DataFrame) -> DataFrame:
    """Whether one value fills nine tenths of the page."""
    return distinct_stats(p).select("page_id", "n", "most_frequent", ((F.col("n") > 0) & (F.least("most_frequent", "n") >= F.col("n") - F.floor(F.col("n") / 10))).alias("dominant"))


def _profile(p: DataFrame, numbers: bool = True) -> DataFrame:
    """One row per page by two sorts of one exchange and one aggregation; ``lo`` and ``hi``: the ends of the deltas."""
    before, own = F.lag("v").over(by_page()), by_page_value()
    x = p.select("page_id", "pos", "v", before.alias("b"), F.row_number().over(own.orderBy("pos")).alias("nth"))
    change = F.when((F.col("pos") > 0) & F.col("v").eqNullSafe(F.col("b")), 0).otherwise(1)
    d = wrapping_subtract(F.col("v"), F.col("b")) if numbers else F.lit(None).cast("bigint")
    return x.select("page_id", "pos", "v", "nth", change.alias("change"), d.alias("d")).groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("min_v"), F.max("v").alias("max_v"), F.sum("change").cast("bigint").alias("runs"), F.count_if(F.col("nth") == 1).alias("d"),
        F.max("nth").cast("bigint").alias("most"), F.min("d").alias("lo"), F.max("d").alias("hi"), F.min_by("v", "pos").alias("base"), F.sum(F.octet_length(F.col("v").cast("string"))).cast("bigint").alias("total_bytes"),
    )


def page_profile(p: DataFrame, limit: int = MAP_LIMIT) -> DataFrame:
    """``page_id, n, min_v, max_v, runs, is_sequence, distinct_v, most_frequent, base, step, d_min, d_max``: what estimates of integer pages need."""
    over = F.col("d") > F.greatest(F.lit(1), F.least(F.lit(limit), F.floor(F.col("n") / 2)))
    ok = F.coalesce((F.col("lo") == F.col("hi")) & (F.col("lo") != 0), F.lit(False))
    return _profile(p).select(
        "page_id", "n", "min_v", "max_v", "runs", ok.alias("is_sequence"), F.when(over, F.col("n")).otherwise(F.col("d")).cast("bigint").alias("distinct_v"),
        F.when(over, 0).otherwise(F.col("most")).cast("bigint").alias("most_frequent"), "base", F.col("lo").alias("step"), F.col("lo").alias("d_min"), F.col("hi").alias("d_max"),
    )


def float_profile(p: DataFrame) -> DataFrame:
    """``page_id, n, runs, distinct_v, most_frequent`` of a page of doubles, by their bits; no frequency beyond the map's limit."""
    x = _profile(p.withColumn("v", float_bits("v")))
    return x.select("page_id", "n", "runs", F.col("d").alias("distinct_v"), F.when(F.col("d") > MAP_LIMIT, 0).otherwise(F.col("most")).cast("bigint").alias("most_frequent"))


def string_profile(p: DataFrame) -> DataFrame:
    """``page_id, n, runs, distinct_v, most_frequent, total_bytes`` of a page of strings; n and 0 beyond the map's limit."""
    over = F.col("d") > STRING_MAP_LIMIT
    return _profile(p, numbers=False).select("page_id", "n", "runs", F.when(over, F.col("n")).otherwise(F.col("d")).alias("distinct_v"), F.when(over, 0).otherwise(F.col("most")).cast("bigint").alias("most_frequent"), "total_bytes")


def null_count(p: DataFrame) -> DataFrame:
    return p.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v").isNull()).cast("bigint").alias("nulls"))


def string_stats(p: DataFrame) -> DataFrame:
    """Distinct strings (n beyond the map's limit), runs and bytes."""
    x = with_change(p).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("v").alias("d"), F.sum("change").cast("bigint").alias("runs"), F.sum(F.octet_length("v")).cast("bigint").alias("total_bytes"))
    return x.select("page_id", "n", F.when(F.col("d") > STRING_MAP_LIMIT, F.col("n")).otherwise(F.col("d")).alias("distinct_v"), "runs", "total_bytes")


def bitwidth_histogram(p: DataFrame) -> DataFrame:
    return p.groupBy("page_id", bit_length(F.col("v")).alias("bit_width")).agg(F.count(F.lit(1)).alias("cnt"))

"""Connected components of a large edge table by alternating large-star and small-star rounds.

Each round is two combinable aggregations and two merge joins (AQE splits hot nodes), written to the shared folder, so
neither edges nor components ever reach the driver, not as a broadcast either; only a count and a checksum per round do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _digest(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return r.n, int(r.h)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``u, v`` (longs) in; ``u, v`` out: each node but the smallest of its component, and that smallest. Raises if ``max_rounds`` don't suffice."""
    e = common.table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _digest(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(lowest.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        e = common.table(small, "edges")
        after = _digest(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components haven't converged after {max_rounds} rounds")
    return e

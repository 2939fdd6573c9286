"""Mixing sources to target weights by systematic sampling.

Each source gets a share of all words by its weight, capped at ``max_repeat`` times its own words; what a capped
source can't take is shared again among the rest (water filling, in closed form). A document's expected copies are
its source's target over its source's words. Within a source, documents are ordered by (size, id), their expected
copies are prefix-summed, one offset in [0, 1) per source is added, and a document is emitted once per integer
crossed. Ordering by size makes the words taken miss the target by little more than one document's size.

Cases: null or empty text has size 0; null source is the last source; ties in size are ordered by id, repeated rows
are interchangeable; an empty table gives an empty table; other columns are ignored.

Scale: only (id, source, size) is shuffled, once, by range over (source, size, id), so a source with a third of all
rows is spread over a third of the tasks. A row's number inside its partition comes from
``monotonically_increasing_id``; the numbers before its partition from a count per (partition, source). Sizes and
ranks are integers, so results don't depend on the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5, 2, 1)
SEED = 42


def offset(source: Column, seed: int = SEED) -> Column:
    """The random offset of a source in [0, 1): 32 bits of a hash of its name and the seed."""
    name = F.coalesce(F.concat(F.lit("s:"), source.cast("string")), F.lit("null"))
    return F.conv(F.substring(F.md5(F.concat(name, F.lit(f"/{seed}")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = 3) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``: one row per source, so windows over it are small.

    Sources are sorted by cap over weight; the first k are capped, where k is the least number for which an equal
    share per weight of the words left exceeds no further source's cap.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double")
    x = sizes.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("w", w).withColumn("cap", (F.col("source_size") * max_repeat).cast("double"))
    x = x.withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", "rank")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    x = x.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    # the level at the first source that needs no cap holds for all from there on
    x = x.withColumn("final", F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return x.select("source", "source_size", F.when(F.col("final").isNull() | (F.col("ratio") <= F.col("final")), F.col("cap")).otherwise(F.col("final") * F.col("w")).alias("target"))


def mix(df: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = 3, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size: Column | None = None) -> DataFrame:
    """``doc_id, size, source_size, target, copies, taken`` of every row."""
    plain = common.pick(df, doc_id=id_col, source=source_col, text=text_col)
    sized = common.table(plain.select("doc_id", "source", (common.n_words_sql("text") if size is None else size).alias("size")), "op3-sizes")
    per_source = common.table(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeat), "op3-targets")
    keys = [F.col("source").asc_nulls_last(), F.col("size").asc(), F.col("doc_id").asc()]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = common.table(sized.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), "op3-placed")
    placed = placed.withColumn("part", F.shiftright("at", 33))
    counts = placed.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # (partition, source) pairs number at most partitions plus sources
    starts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first_at")).select(F.col("source").alias("s"), F.col("part").alias("p"), "before")
    info = starts.join(per_source.withColumnRenamed("source", "t"), F.col("s").eqNullSafe(F.col("t"))).withColumn("offset", offset(F.col("s"), seed)).drop("t")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rank = F.col("at") + F.col("before")
    copies = F.floor((rank + 1) * each + F.col("offset")) - F.floor(rank * each + F.col("offset"))
    joined = placed.join(info, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    return joined.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies")).withColumn("taken", F.col("size") * F.col("copies")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def mixed(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of the mix, repeated as often as it takes them, with the columns of ``df``."""
    rows, names = common.keyed(df, id_col), list(df.columns)
    cell = lambda c: F.col(f"c{names.index(c)}")
    sized = rows.select(F.struct("key_id", "key_hash").alias("doc_id"), cell(source_col).alias("source"), cell(text_col).alias("text"))
    taken = mix(sized, **options).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("copies"))
    return common.emit(rows, taken.select("doc_id.key_id", "doc_id.key_hash", "n", "copies")).toDF(*names)


ORACLE = """
with sized as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size, (row_number() over (order by source nulls last) - 1) as rank from sized group by source),
x as (select *, (case rank % 3 when 0 then 5 when 1 then 2 else 1 end)::double as w, (source_size * 3)::double as cap from s),
y as (select *, cap / w as ratio from x),
z as (select *, (sum(source_size) over () - coalesce(sum(cap) over (order by ratio, rank rows between unbounded preceding and 1 preceding), 0.0))
    / (sum(w) over () - coalesce(sum(w) over (order by ratio, rank rows between unbounded preceding and 1 preceding), 0.0)) as level from y),
f as (select (select level from z where level <= ratio order by ratio, rank limit 1) as final),
t as (select source, source_size, case when final is null or ratio <= final then cap else final * w end as target,
    ('0x' || substr(md5(coalesce('s:' || source, 'null') || '/42'), 1, 8))::bigint::double / 4294967296.0 as off from z, f),
r as (select d.doc_id, d.size, t.source_size, t.target, t.off, case when t.source_size > 0 then t.target / t.source_size else 0.0 end as each,
    row_number() over (partition by d.source order by d.size, d.doc_id) - 1 as rank from sized d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, (size * (floor((rank + 1) * each + off) - floor(rank * each + off)))::bigint as taken,
    (floor((rank + 1) * each + off) - floor(rank * each + off))::bigint as copies from r
"""

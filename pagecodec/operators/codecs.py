"""The codecs as relational transforms. Encoders give the encoded frames, decoders use nothing but those."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bit_length, halves, joined, packed_bytes, unzigzag, wrapping_add, wrapping_scale, wrapping_subtract, zigzag
from .paging import by_page
from .stats import bitwidth_histogram, sequence_stats, with_change

def _page() -> Window:
    return Window.partitionBy("page_id")


# -- const, sequence ------------------------------------------------------------------------------------------------
def const_encode(p: DataFrame) -> DataFrame:
    """``page_id, n, is_const, v`` (v only of constant pages)."""
    x = p.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), (F.min("v") == F.max("v")).alias("is_const"), F.min("v").alias("v"))
    return x.withColumn("v", F.when(F.col("is_const"), F.col("v")))


def const_decode(enc: DataFrame) -> DataFrame:
    return enc.where("is_const").select("page_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("pos"), "v")


def sequence_decode(enc: DataFrame) -> DataFrame:
    return enc.where("is_sequence").select("page_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("pos"), "base", "step").select("page_id", "pos", wrapping_add(F.col("base"), wrapping_scale(F.col("step"), F.col("pos"))).alias("v"))


sequence_encode = sequence_stats


# -- frame of reference, delta, zigzag -----------------------------------------------------------------------------
def for_frames(p: DataFrame) -> DataFrame:
    """``page_id, n, ref_min, bit_width``."""
    x = p.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("ref_min"), wrapping_subtract(F.max("v"), F.min("v")).alias("rng"))
    return x.select("page_id", "n", "ref_min", bit_length(F.col("rng")).alias("bit_width"))


def for_encode(p: DataFrame) -> DataFrame:
    """``page_id, pos, ref_min, residual``."""
    low = F.min("v").over(_page())
    return p.select("page_id", "pos", low.alias("ref_min"), wrapping_subtract(F.col("v"), low).alias("residual"))


def for_decode(enc: DataFrame) -> DataFrame:
    return enc.select("page_id", "pos", wrapping_add(F.col("ref_min"), F.col("residual")).alias("v"))


def delta_encode(p: DataFrame) -> DataFrame:
    """``page_id, pos, d``: the first row's value, then differences."""
    return p.select("page_id", "pos", wrapping_subtract(F.col("v"), F.coalesce(F.lag("v").over(by_page()), F.lit(0).cast("bigint"))).alias("d"))


def delta_decode(enc: DataFrame) -> DataFrame:
    upto = by_page().rowsBetween(Window.unboundedPreceding, 0)
    hi, lo = halves(F.col("d"))
    return enc.select("page_id", "pos", joined(F.sum(hi).over(upto), F.sum(lo).over(upto)).alias("v"))


def zigzag_encode(p: DataFrame) -> DataFrame:
    return p.select("page_id", "pos", zigzag(F.col("v")).alias("z"))


def zigzag_decode(enc: DataFrame) -> DataFrame:
    return enc.select("page_id", "pos", unzigzag(F.col("z")).alias("v"))


# -- bit packing and patches ---------------------------------------------------------------------------------------
def bitpack_widths(p: DataFrame, width_bytes: int = 8) -> DataFrame:
    """``page_id, n, bit_width, exceptions, cost``: the width of least cost, the lowest of equals.

    The candidates of a page are its histogram's widths: between two of them a wider pack only costs more.
    """
    h = bitwidth_histogram(p)
    upto = Window.partitionBy("page_id").orderBy("bit_width").rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum("cnt").over(_page())
    x = h.select("page_id", "bit_width", n.alias("n"), (n - F.sum("cnt").over(upto)).alias("exceptions"))
    x = x.withColumn("cost", packed_bytes(F.col("n"), F.col("bit_width")) + F.col("exceptions") * (width_bytes + 4))
    best = Window.partitionBy("page_id").orderBy("cost", "bit_width")
    return x.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")


def bitpack_encode(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packed low bits ``page_id, pos, low``, and patches ``page_id, pos, v`` of the values too wide."""
    w = bitpack_widths(p).select("page_id", "bit_width")
    x = p.join(w, "page_id")
    mask = F.expr("case when bit_width >= 63 then -1L else shiftleft(1L, bit_width) - 1 end")
    return x.select("page_id", "pos", F.col("v").bitwiseAND(mask).alias("low")), x.where(bit_length(F.col("v")) > F.col("bit_width")).select("page_id", "pos", "v")


def patch_overlay(base: DataFrame, patches: DataFrame, column: str = "v") -> DataFrame:
    """Base rows with patched values instead where there are any."""
    right = patches.select("page_id", "pos", F.col("v").alias("patch"))
    return base.join(right, ["page_id", "pos"], "left").select("page_id", "pos", F.coalesce("patch", F.col(column)).alias("v"))


# -- dictionary and predicates on codes ----------------------------------------------------------------------------
# Everything here stays on the exchange by page: values are grouped inside pages, and rows meet their page's dictionary,
# an array in code order, by page alone.
def dictionary(p: DataFrame, key: Column | None = None) -> DataFrame:
    """``page_id, ord, v, cnt``: values in order of first occurrence. ``key``: what makes values equal (float bits)."""
    k = F.col("v") if key is None else key
    x = p.withColumn("k", k).groupBy("page_id", "k").agg(F.min("pos").alias("first_pos"), F.first("v").alias("v"), F.count(F.lit(1)).alias("cnt"))
    order = Window.partitionBy("page_id").orderBy("first_pos")
    return x.select("page_id", (F.row_number().over(order) - 1).cast("bigint").alias("ord"), "v", "cnt")


def dict_encode(p: DataFrame, key: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Dictionary ``page_id, ord, v, cnt`` and codes ``page_id, pos, ord``. Null is a value like any other."""
    first = F.min("pos").over(Window.partitionBy("page_id", "k"))
    rows = p.withColumn("k", F.col("v") if key is None else key).select("page_id", "pos", first.alias("first_pos"))
    ord_ = F.dense_rank().over(Window.partitionBy("page_id").orderBy("first_pos")) - 1
    return dictionary(p, key), rows.select("page_id", "pos", ord_.cast("bigint").alias("ord"))


def _in_order(d: DataFrame, cell: Column) -> DataFrame:
    """``page_id, cells``: a cell of each dictionary entry, in code order."""
    sorted_ = F.array_sort(F.collect_list(F.struct("ord", cell.alias("cell"))))
    return d.groupBy("page_id").agg(sorted_.alias("cells")).select("page_id", F.col("cells.cell").alias("cells"))


def dict_decode(d: DataFrame, codes: DataFrame) -> DataFrame:
    return codes.join(_in_order(d, F.col("v")), "page_id").select("page_id", "pos", F.col("cells")[F.col("ord").cast("int")].alias("v"))


def dict_filter(d: DataFrame, codes: DataFrame, predicate: Column, *, negate: bool = False) -> DataFrame:
    """Rows whose value satisfies ``predicate``, which is evaluated once per distinct value. Null never matches.

    Pages of whose dictionary no value matches are left out before their codes are looked at.
    """
    hit = F.coalesce(predicate, F.lit(False))
    hits = _in_order(d, (F.col("v").isNotNull() & ~hit) if negate else hit).where(F.array_contains("cells", True))
    return codes.join(hits, "page_id").where(F.col("cells")[F.col("ord").cast("int")]).select("page_id", "pos")


def bsi_equals(d: DataFrame, codes: DataFrame, value: Column, planes: int) -> DataFrame:
    """Rows equal to ``value`` by tests of the codes' lowest ``planes`` bit planes, and of all planes above them together."""
    wanted = d.where(F.col("v") == value).select("page_id", F.col("ord").alias("want"))
    x = codes.join(wanted, "page_id")
    test = F.shiftright("ord", planes) == F.shiftright("want", planes)
    for b in range(planes):
        test &= F.shiftright("ord", b).bitwiseAND(F.lit(1)) == F.shiftright("want", b).bitwiseAND(F.lit(1))
    return x.where(test).select("page_id", "pos")


# -- run-end -------------------------------------------------------------------------------------------------------
def runend_encode(p: DataFrame) -> DataFrame:
    """``page_id, run, v, run_start, run_end`` (exclusive)."""
    x = with_change(p).withColumn("run", F.sum("change").over(by_page().rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return x.groupBy("page_id", "run").agg(F.min_by("v", "pos").alias("v"), F.min("pos").alias("run_start"), (F.max("pos") + 1).alias("run_end"))


def runend_decode(runs: DataFrame) -> DataFrame:
    start = F.lag("run_end", 1, 0).over(Window.partitionBy("page_id").orderBy("run"))
    return runs.select("page_id", "v", start.alias("s"), "run_end").select("page_id", F.explode(F.expr("sequence(s, run_end - 1)")).alias("pos"), "v")


def runend_lookup(runs: DataFrame, points: DataFrame) -> DataFrame:
    """Values at points ``page_id, pos``: runs and points merged in order, each point takes the last run begun."""
    starts = runs.select("page_id", F.col("run_start").alias("pos"), F.lit(0).alias("is_point"), F.struct("v").alias("s"))
    both = starts.unionByName(points.select("page_id", "pos", F.lit(1).alias("is_point"), F.lit(None).cast(starts.schema["s"].dataType).alias("s")))
    upto = Window.partitionBy("page_id").orderBy("pos", "is_point").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("s", F.last("s", ignorenulls=True).over(upto)).where("is_point = 1").select("page_id", "pos", F.col("s.v").alias("v"))


# -- sparse --------------------------------------------------------------------------------------------------------
def _fills(p: DataFrame) -> DataFrame:
    """``page_id, best, n``; of equally frequent values the one that reached the count first."""
    per = p.groupBy("page_id", "v").agg(F.count(F.lit(1)).alias("cnt"), F.max("pos").alias("last_pos"))
    return per.groupBy("page_id").agg(F.min(F.struct((-F.col("cnt")).alias("less"), "last_pos", "v")).alias("best"), F.sum("cnt").alias("n"))


def sparse_fill(p: DataFrame) -> DataFrame:
    """``page_id, fill, cnt``: the most frequent value."""
    return _fills(p).select("page_id", F.col("best.v").alias("fill"), (-F.col("best.less")).alias("cnt"))


def sparse_encode(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fills and page lengths ``page_id, fill, n``; exceptions ``page_id, pos, v``."""
    fill = _fills(p).select("page_id", F.col("best.v").alias("fill"), "n")
    return fill, p.join(fill.select("page_id", "fill"), "page_id").where(~F.col("v").eqNullSafe(F.col("fill"))).select("page_id", "pos", "v")


def sparse_decode(fill: DataFrame, exceptions: DataFrame) -> DataFrame:
    base = fill.select("page_id", F.explode(F.expr("sequence(0L, n - 1)")).alias("pos"), F.col("fill").alias("v"))
    return patch_overlay(base, exceptions)


def sparse_form(p: DataFrame, width: int = 8) -> DataFrame:
    """Bytes of the index form and of the bitmap form, and which is chosen (bitmap only if strictly smaller)."""
    fill, ex = sparse_encode(p)
    k = ex.groupBy("page_id").agg(F.count(F.lit(1)).alias("k"))
    x = fill.join(k, "page_id", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    iw = F.when(F.col("n") <= 256, 1).when(F.col("n") <= 65536, 2).otherwise(4)
    head = 24 + 44 + width
    index = head + 44 + F.col("k") * iw + 44 + F.col("k") * width
    bitmap = head + F.floor((F.col("n") + 7) / 8) + 44 + F.col("k") * width
    return x.select("page_id", "n", "k", index.cast("bigint").alias("index_bytes"), bitmap.cast("bigint").alias("bitmap_bytes"), F.when(bitmap < index, "bitmap").otherwise("index").alias("form"))


# -- nulls ---------------------------------------------------------------------------------------------------------
def nullable_split(p: DataFrame, zero: Column) -> DataFrame:
    """``page_id, pos, masked, valid``: nulls read as ``zero``, validity beside them."""
    return p.select("page_id", "pos", F.coalesce("v", zero).alias("masked"), F.when(F.col("v").isNull(), 0).otherwise(1).alias("valid"))


def nullable_join(enc: DataFrame) -> DataFrame:
    return enc.select("page_id", "pos", F.when(F.col("valid") == 1, F.col("masked")).alias("v"))


def nullable_route(p: DataFrame) -> DataFrame:
    """How a page's nulls are handled: plain, all_null, forced_sparse (nine tenths null) or masked."""
    x = p.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v").isNull()).cast("bigint").alias("nulls"))
    return x.withColumn("route", F.when(F.col("nulls") == 0, "plain").when(F.col("nulls") == F.col("n"), "all_null").when(F.col("nulls") >= F.col("n") - F.floor(F.col("n") / 10), "forced_sparse").otherwise("masked"))


def null_sparse(p: DataFrame, zero: Column) -> DataFrame:
    """Exceptions of the zero-filled sparse form of a nullable page."""
    return p.withColumn("v", F.coalesce("v", zero)).where(F.col("v") != zero)


# -- strings -------------------------------------------------------------------------------------------------------
def string_layout(p: DataFrame) -> DataFrame:
    """``page_id, pos, start_offset, len``: each string's place in its page's byte buffer."""
    n = F.octet_length("v").cast("bigint")
    before = F.sum(n).over(by_page().rowsBetween(Window.unboundedPreceding, -1))
    return p.select("page_id", "pos", F.coalesce(before, F.lit(0)).cast("bigint").alias("start_offset"), n.alias("len"))

"""Sizes and estimates as columns over page statistics: no row is encoded to compare immediate candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bit_length, packed_bytes, wrapping_subtract
from ..operators import stats

ARRAY, NODE = 20, 24
#: The least page worth a sample, the least length and bytes of deltas and symbol tables, the dictionary's limit of doubles, delta's penalty and least ratio.
MIN_RAW, LONG, FLOAT_DICT_LIMIT, DELTA_WORTH, DELTA_LEAST = 256, 1024, 8192, 0.95, 1.25
#: Parent codec and child place to the codecs that the child may not use (besides the parent's own).
EXCLUSIONS = {
    ("dict", 0): ("runend", "sparse"), ("dict", 1): ("for", "sequence", "zigzag", "delta"), ("runend", 1): ("dict", "sparse"), ("zigzag", 0): ("dict", "runend", "sparse"),
    ("delta", 0): ("dict", "runend", "sparse", "sequence", "zigzag"), ("sparse", 1): ("dict", "runend"), ("alp", 1): ("dict", "runend", "sparse"), ("alprd", 0): ("dict", "runend", "sparse"), ("fsst", 0): ("dict", "runend", "sparse"),
}


def raw_size(n, width: int):
    return (NODE + ARRAY + n * width).cast("bigint")


def encoded_size(p: DataFrame, width: int = 8) -> DataFrame:
    """``page_id, n, raw_bytes, for_bytes, sequence_bytes, runend_bytes`` of integer pages."""
    x = stats.with_change(p).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("min_v"), F.max("v").alias("max_v"), F.sum("change").alias("runs"))
    rw = bit_length(wrapping_subtract(F.col("max_v"), F.col("min_v")))
    return x.select(
        "page_id", "n", raw_size(F.col("n"), width).alias("raw_bytes"), (F.lit(2 * NODE + 1 + width) + packed_bytes(F.col("n"), rw)).cast("bigint").alias("for_bytes"),
        F.lit(NODE + 2 * width).cast("bigint").alias("sequence_bytes"), (NODE + 44 + F.col("runs") * width + 44 + (F.col("runs") - 1) * 4).cast("bigint").alias("runend_bytes"),
    )


def _candidates(width: int, unsigned: bool) -> Column:
    """The immediate integer candidates of a page (``stats.page_profile``), as an array of cand_idx, codec, after_bytes."""
    rw = bit_length(wrapping_subtract(F.col("max_v"), F.col("min_v")))
    cb = bit_length(F.col("distinct_v") - 1)
    frame = (rw > 0) & (rw < 8 * width)
    if unsigned:
        frame &= (F.col("min_v") != 0) & (rw < bit_length(F.col("max_v")))
    codes = F.when(F.col("n") >= 4 * F.col("runs"), F.least(cb * F.col("n"), (cb + 32) * F.col("runs"))).otherwise(cb * F.col("n"))
    dict_bits = 8 * width * F.col("distinct_v") + codes
    tiny = NODE + F.least(F.lit(NODE + 2 * width), ARRAY + NODE + F.col("distinct_v") * width) + NODE + 1 + packed_bytes(F.col("n"), cb)
    found = [
        (0, "const", F.col("runs") == 1, F.lit(NODE + ARRAY + width)), (1, "sequence", F.col("is_sequence"), F.lit(NODE + 2 * width)),
        (2, "for", frame, 2 * NODE + 1 + width + packed_bytes(F.col("n"), rw)),
        (4, "dict", (F.col("distinct_v") > 1) & (F.col("distinct_v") <= F.floor(F.col("n") / 2)), F.when(raw_size(F.col("n"), width) < 256, tiny).otherwise(F.floor((dict_bits + 7) / 8))),
    ]
    if unsigned:
        packed = NODE + 1 + packed_bytes(F.col("n"), bit_length(F.col("max_v")))
        found.append((7, "bitpack", packed < raw_size(F.col("n"), width), packed))
    cells = [F.when(ok, F.struct(F.lit(i).alias("cand_idx"), F.lit(c).alias("codec"), size.cast("bigint").alias("after_bytes"))) for i, c, ok, size in found]
    return F.filter(F.array(*cells), lambda x: x.isNotNull())


def scheme_estimates(p: DataFrame, width: int = 8, unsigned: bool = False) -> DataFrame:
    """``page_id, cand_idx, codec, after_bytes`` of the immediate integer candidates that apply to each page."""
    return stats.page_profile(p).select("page_id", F.explode(_candidates(width, unsigned)).alias("x")).select("page_id", "x.*")


def string_raw_size(n: Column, total: Column) -> Column:
    """Offsets of the narrowest width that holds the total, and the bytes."""
    width = F.when(total <= 0xFF, 1).when(total <= 0xFFFF, 2).otherwise(4)
    return (NODE + 24 + (n + 1) * width + total).cast("bigint")


def _verdicts(profile: DataFrame, cells: list[tuple[str, str, Column]]) -> DataFrame:
    found = [F.when(ok, F.struct(F.lit(codec).alias("codec"), F.lit(how).alias("verdict"))) for codec, how, ok in cells]
    return profile.select("page_id", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x")).select("page_id", "x.*")


def _shared_cells(raw: Column) -> tuple[Column, list[tuple[str, str, Column]]]:
    """Whether a page is worth a sample, and the candidates that every type has."""
    n = F.col("n")
    worth = raw >= MIN_RAW
    return worth, [("runend", "sample", worth & (n >= 4 * F.col("runs"))), ("sparse", "sample", worth & (n > 0) & (F.least("most_frequent", "n") >= n - F.floor(n / 10)))]


def integer_verdicts(p: DataFrame, width: int = 8, unsigned: bool = False) -> DataFrame:
    """``page_id, codec, verdict`` of the candidates that need more than statistics: encode the page's sample, or scan its deltas.

    Delta is deferred where even residuals of one bit would be worth its slower decoding.
    """
    worth, cells = _shared_cells(raw_size(F.col("n"), width))
    if not unsigned:
        cells.append(("zigzag", "sample", worth & (F.col("min_v") < 0)))
    best = DELTA_WORTH * raw_size(F.col("n"), width) / _delta_bytes(F.lit(1), width, F.lit(not unsigned))
    cells += [("dict", "sample", worth & (F.col("most_frequent") == 0)), ("delta", "deferred", (F.col("n") >= LONG) & ~F.col("is_sequence") & (best > DELTA_LEAST))]
    return _verdicts(stats.page_profile(p), cells)


def _delta_bytes(bits: Column, width: int, framed: Column) -> Column:
    return F.lit(NODE + width + NODE + 1) + packed_bytes(F.col("n") - 1, bits) + F.when(framed, NODE + width).otherwise(0)


def delta_estimate(p: DataFrame, width: int = 8, unsigned: bool = False) -> DataFrame:
    """``page_id, after_bytes, ratio`` of the pages whose deltas, framed and packed, are worth it: a ratio over 1.25 after a penalty of a twentieth."""
    bits = bit_length(wrapping_subtract(F.col("d_max"), F.col("d_min")))
    after = _delta_bytes(bits, width, F.lit(True) if not unsigned else F.col("d_min") != 0)
    x = stats.page_profile(p).where((F.col("n") >= LONG) & (F.col("d_min") != F.col("d_max"))).select("page_id", raw_size(F.col("n"), width).alias("raw_bytes"), after.cast("bigint").alias("after_bytes"))
    return x.select("page_id", "after_bytes", (F.col("raw_bytes") / F.col("after_bytes") * DELTA_WORTH).alias("ratio")).where(F.col("ratio") > DELTA_LEAST)


def float_verdicts(p: DataFrame) -> DataFrame:
    """``page_id, codec, verdict`` of pages of doubles; both decimal and split-bits codecs are skipped where few values repeat often."""
    n, d = F.col("n"), F.col("distinct_v")
    worth, cells = _shared_cells(raw_size(n, 8))
    scaled = worth & (F.col("runs") > 1) & ~((d >= 2) & (d <= FLOAT_DICT_LIMIT) & (16 * d <= n))
    deferred = (d > 1) & (d <= FLOAT_DICT_LIMIT) & (d <= F.floor(n / 2)) & (_float_dict_bits() < 64 * n)
    return _verdicts(stats.float_profile(p), [*cells, ("alp", "sample", scaled), ("alprd", "sample", scaled), ("dict", "deferred", deferred)])


def _float_dict_bits() -> Column:
    return 64 * F.col("distinct_v") + bit_length(F.col("distinct_v") - 1) * F.col("n")


def float_dict_estimate(p: DataFrame) -> DataFrame:
    """``page_id, after_bits, ratio`` of the pages of doubles for which a dictionary is smaller than the values."""
    d, n = F.col("distinct_v"), F.col("n")
    ok = (d > 1) & (d <= FLOAT_DICT_LIMIT) & (d <= F.floor(n / 2)) & (_float_dict_bits() < 64 * n)
    return stats.float_profile(p).where(ok).select("page_id", _float_dict_bits().cast("bigint").alias("after_bits"), (64 * n / _float_dict_bits()).alias("ratio"))


def string_verdicts(p: DataFrame) -> DataFrame:
    """``page_id, codec, verdict`` of pages of strings: all by sample; a symbol table only for long pages."""
    n, total = F.col("n"), F.col("total_bytes")
    worth, cells = _shared_cells(string_raw_size(n, total))
    return _verdicts(stats.string_profile(p), [*cells, ("dict", "sample", worth & (F.col("distinct_v") <= F.floor(n / 2))), ("fsst", "sample", worth & (n >= LONG) & (total >= LONG))])


def raw_fallback(p: DataFrame, width: int = 8) -> DataFrame:
    """The least immediate estimate of each page, or raw if none is below it."""
    order = F.transform(_candidates(width, False), lambda x: F.struct(x["after_bytes"], x["cand_idx"], x["codec"]))
    x = stats.page_profile(p).select("page_id", raw_size(F.col("n"), width).alias("raw_bytes"), F.array_min(order).alias("b"))
    won = F.coalesce(F.col("b.after_bytes") < F.col("raw_bytes"), F.lit(False))
    return x.select("page_id", F.when(won, F.col("b.codec")).otherwise("raw").alias("codec"), F.when(won, F.col("b.after_bytes")).otherwise(F.col("raw_bytes")).alias("bytes"))


def sample_plan(p: DataFrame) -> DataFrame:
    """``page_id, n, windows, sampled``: 64-row windows, about one row in a hundred and at least 16 windows."""
    n = F.count(F.lit(1)).alias("n")
    wanted = F.greatest(F.lit(16), F.ceil(F.floor(F.floor(F.col("n") / 100) / 64) / 16) * 16)
    whole = wanted * 64 >= F.col("n")
    x = p.groupBy("page_id").agg(n)
    return x.select("page_id", "n", F.when(whole, 1).otherwise(wanted).cast("bigint").alias("windows"), F.when(whole, F.col("n")).otherwise(wanted * 64).cast("bigint").alias("sampled"))


def exclusions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, i, x) for (p, i), xs in EXCLUSIONS.items() for x in xs], "parent string, child_idx int, excluded string")

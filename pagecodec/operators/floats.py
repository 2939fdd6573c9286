"""ALP and ALP-RD for doubles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bit_length, float_bits

MAX_E = 23
#: Doubles beyond this don't fit a long.
EDGE = 9.2e18


def exponents(spark: SparkSession) -> DataFrame:
    """The pairs tried, with powers of ten as literals: never computed."""
    ten = [float(f"1e{k}") for k in range(MAX_E)]
    inv = [float(f"1e-{k}") for k in range(MAX_E)]
    return spark.createDataFrame([(e, f, ten[e], inv[f], inv[e], ten[f]) for e in range(MAX_E) for f in range(e)], "e int, f int, pe double, nf double, ne double, pf double")


def _coded(x: DataFrame) -> DataFrame:
    """Adds ``enc`` (null if it doesn't fit) and ``is_exception``."""
    scaled = F.round(F.col("v") * F.col("pe") * F.col("nf"))
    x = x.withColumn("enc", F.when(F.abs(scaled) < EDGE, scaled.cast("bigint")))
    return x.withColumn("is_exception", F.coalesce(F.col("enc").cast("double") * F.col("ne") * F.col("pf") != F.col("v"), F.lit(True)))


def alp_exponents(p: DataFrame) -> DataFrame:
    """``page_id, e, f, exceptions``: fewest exceptions on the page's sample, then smaller e - f, then smaller e, f.

    The pairs are 253 literal rows, so the nested-loop join is a bounded expansion of the sample (at most 127 rows).
    """
    n = F.count(F.lit(1)).over(Window.partitionBy("page_id"))
    stride = F.when(F.col("n") > 64, F.floor(F.col("n") / 64)).otherwise(F.lit(1))
    sample = p.withColumn("n", n).where(F.col("pos") % stride == 0).select("page_id", "v")
    tried = _coded(sample.join(F.broadcast(exponents(p.sparkSession)), how="cross"))
    per = tried.groupBy("page_id", "e", "f").agg(F.count_if("is_exception").cast("bigint").alias("exceptions"))
    best = Window.partitionBy("page_id").orderBy("exceptions", F.col("e") - F.col("f"), "e", "f")
    return per.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")


def alp_encode(p: DataFrame) -> DataFrame:
    """``page_id, pos, e, f, enc, patch``: patch holds the value where decoding ``enc`` doesn't give it."""
    pairs = alp_exponents(p).select("page_id", "e", "f").join(F.broadcast(exponents(p.sparkSession)), ["e", "f"])
    return _coded(p.join(pairs, "page_id")).select("page_id", "pos", "e", "f", F.coalesce("enc", F.lit(0)).alias("enc"), F.when(F.col("is_exception"), F.col("v")).alias("patch"))


def alp_decode(enc: DataFrame) -> DataFrame:
    x = enc.join(F.broadcast(exponents(enc.sparkSession)), ["e", "f"])
    return x.select("page_id", "pos", F.coalesce("patch", F.col("enc").cast("double") * F.col("ne") * F.col("pf")).alias("v"))


def with_bits(p: DataFrame) -> DataFrame:
    return p.withColumn("bits", float_bits("v"))


def _alprd_lefts(p: DataFrame) -> DataFrame:
    """``page_id, cut, left_part, c, r``: left parts of the page's sample by rank, for each cut of 1 to 16 left bits."""
    n = F.count(F.lit(1)).over(Window.partitionBy("page_id"))
    stride = F.when(F.col("n") > 1024, F.floor(F.col("n") / 1024)).otherwise(F.lit(1))
    s = with_bits(p.withColumn("n", n).where(F.col("pos") % stride == 0)).select("page_id", "bits")
    x = s.select("page_id", "bits", F.explode(F.sequence(F.lit(1), F.lit(16))).alias("cut")).withColumn("left_part", F.expr("shiftrightunsigned(bits, 64 - cut)"))
    g = x.groupBy("page_id", "cut", "left_part").agg(F.count(F.lit(1)).alias("c"))
    return g.withColumn("r", F.row_number().over(Window.partitionBy("page_id", "cut").orderBy(F.desc("c"), "left_part")))


def _alprd_cost(lefts: DataFrame) -> DataFrame:
    y = lefts.groupBy("page_id", "cut").agg(F.sum("c").alias("samples"), F.sum(F.when(F.col("r") <= 8, F.col("c")).otherwise(0)).alias("kept"), F.least(F.max("r"), F.lit(8)).alias("k"), F.filter(F.collect_list(F.when(F.col("r") <= 8, F.struct("r", "left_part"))), lambda w: w.isNotNull()).alias("words"))
    left = F.greatest(F.lit(1), bit_length(F.col("k") - 1))
    return y.select("page_id", "cut", (F.col("samples") - F.col("kept")).alias("exceptions"), (64 - F.col("cut") + left + 32 * (F.col("samples") - F.col("kept")) / F.col("samples")).alias("cost"), "words")


def alprd_costs(p: DataFrame) -> DataFrame:
    """``page_id, cut, exceptions, cost``: cost in bits per value of each cut of 1 to 16 left bits."""
    return _alprd_cost(_alprd_lefts(p)).drop("words")


def alprd_encode(p: DataFrame) -> DataFrame:
    """``page_id, pos, cut, code, left_part, right_part``: code is null at exceptions, which carry their left part.

    Cut and the eight left parts come from the page's sample, as in the binary pages; they are one row a page.
    """
    cuts = _alprd_cost(_alprd_lefts(p)).groupBy("page_id").agg(F.min_by(F.struct("cut", "words"), F.struct("cost", "cut")).alias("b")).select("page_id", "b.*")
    x = with_bits(p).join(cuts, "page_id").select("page_id", "pos", "cut", "words", F.expr("shiftrightunsigned(bits, 64 - cut)").alias("left_part"), F.expr("bits & (shiftleft(1L, 64 - cut) - 1)").alias("right_part"))
    hit = F.filter("words", lambda w: w["left_part"] == F.col("left_part"))
    return x.select("page_id", "pos", "cut", (F.get(hit, F.lit(0))["r"] - 1).alias("code"), "left_part", "right_part")


def alprd_decode(enc: DataFrame) -> DataFrame:
    from ..functions import bits_float

    return enc.select("page_id", "pos", bits_float(F.expr("shiftleft(left_part, 64 - cut) | right_part")).alias("v"))

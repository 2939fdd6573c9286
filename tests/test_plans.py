"""Plans that must not shuffle more than once, and values at the ends of 64 bits."""

import re

import pytest
from pyspark.sql import types as T

from pagecodec import functions
from pagecodec.operators import codecs, stats
from pagecodec.plans import queries as q
from pagecodec.plans import report
from pagecodec.wire import planner

SF = "/root/testdata/sf0.001"
LOW, HIGH = -(1 << 63), (1 << 63) - 1


@pytest.mark.parametrize("name", ["dict_encode", "dict_values", "dict_filter_eq", "roundtrip_dict", "bsi_equals", "sparse_encode", "sparse_fill", "scheme_estimates", "raw_fallback", "encoded_size", "roundtrip_delta", "runend_encode"])
def test_one_exchange_by_page(spark, name):
    """Every exchange is by page alone, and equal ones are read again rather than made again."""
    q.QUERIES[name](spark, SF).collect()
    df = q.QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*?), \d+\)", plan)
    assert dealt and all(re.fullmatch(r"page_id#\d+L", x) for x in dealt), plan
    assert "BroadcastExchange" not in plan or name.startswith(("dict", "bsi", "roundtrip", "sparse"))


def pages(spark, values):
    return spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "page_id long, pos long, v long")


def rows(df):
    return [r.v for r in df.orderBy("pos").collect()]


@pytest.mark.parametrize("values", [[LOW, HIGH, 0, -1, HIGH, LOW], [HIGH, LOW], [LOW], [5, HIGH - 3, LOW + 9, 5]])
def test_the_ends_of_64_bits(spark, values):
    p = pages(spark, values)
    assert rows(codecs.delta_decode(codecs.delta_encode(p))) == values
    assert rows(codecs.for_decode(codecs.for_encode(p))) == values
    assert rows(codecs.zigzag_decode(codecs.zigzag_encode(p))) == values
    width = codecs.for_frames(p).first().bit_width
    assert width == (max(values) - min(values)).bit_length()


def test_a_sequence_that_wraps(spark):
    step = 1 << 62
    values = [(3 + i * step + (1 << 63)) % (1 << 64) - (1 << 63) for i in range(9)]
    p = pages(spark, values)
    found = stats.sequence_stats(p).first()
    assert found.is_sequence and found.step == step
    assert rows(codecs.sequence_decode(codecs.sequence_encode(p))) == values


def test_codes_beyond_the_planes(spark):
    p = pages(spark, [i * 7 % 20 + 100 for i in range(200)])
    for planes in (0, 1, 3, 5, 9):
        got = sorted(r.pos for r in codecs.bsi_equals(*codecs.dict_encode(p), functions.F.lit(103), planes).collect())
        assert got == [i for i in range(200) if i * 7 % 20 == 3]


def test_null_is_a_value_of_the_dictionary(spark):
    values = [1, None, 2, None, 1]
    p = pages(spark, values)
    d, code = codecs.dict_encode(p)
    assert rows(codecs.dict_decode(d, code)) == values
    assert sorted(r.pos for r in codecs.dict_filter(d, code, functions.F.col("v") == 1, negate=True).collect()) == [2]


def test_wide_decimals_are_refused(spark):
    assert functions.ptype_of(T.DecimalType(18, 2)) == "int64"
    for f in (lambda t: functions.ptype_of(t), lambda t: functions.physical(functions.F.lit(1), t)):
        with pytest.raises(ValueError):
            f(T.DecimalType(19, 2))


def test_finaliser_and_trailing_zeros(spark):
    got = spark.createDataFrame([(0,), (1,), (LOW,), (-1,), (48,)], "v long").select("v", functions.trailing_zeros(functions.F.col("v")).alias("z"), functions.mix64(functions.F.col("v")).alias("m")).collect()
    assert {r.v: r.z for r in got} == {0: 64, 1: 0, LOW: 63, -1: 0, 48: 4}

    def mix(x):
        x %= 1 << 64
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % (1 << 64)
        x = (x ^ x >> 27) * 0x94D049BB133111EB % (1 << 64)
        return x ^ x >> 31

    assert all(r.m % (1 << 64) == mix(r.v) for r in got)


def test_sample_rows_sends_a_row_a_page(spark):
    """The windows of a page are one row of the join: no row a sampled place is made, sent or held, and rows are dealt by page alone."""
    df = q.QUERIES["sample_rows"](spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*?), \d+\)", plan)
    assert "Generate" not in plan and dealt and all(re.fullmatch(r"page_id#\d+L", x) for x in dealt), plan


@pytest.mark.parametrize("lengths", [[1, 2, 1023], [1024, 1025, 1039, 1040], [4096, 4100], [108_800, 250_001]])
def test_sample_rows_are_the_planners_windows(spark, lengths):
    """Also of pages with more than 16 windows, with rows that are equal and with places beyond the page's length."""
    p = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "page_id long, n long").selectExpr("page_id", "explode(sequence(0L, n - 1)) as pos").selectExpr("page_id", "pos", "pos * 3 as v")
    want = {(i, x, 3 * x) for i, n in enumerate(lengths) for a, e in planner.sample_windows(n) for x in range(a, e)}
    got = report.sample_rows(p).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    odd = spark.createDataFrame([(0, 0, 1), (0, 0, 2), (0, 9, 3), (0, None, 4), (0, -1, 5), (None, 0, 6)], "page_id long, pos long, v long")
    assert sorted(r.v for r in report.sample_rows(odd).collect()) == [1, 2]

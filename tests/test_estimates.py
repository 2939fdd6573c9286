"""Estimates as columns against the planner's own, and the planner's notes against what they say."""

import os

import numpy as np
import pytest

from pagecodec.operators import floats
from pagecodec.plans import estimates, report
from pagecodec.plans import queries as q
from pagecodec.wire import kernels, planner

SF = "/root/testdata/sf0.001"


def pages(spark, values, kind):
    return spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], f"page_id long, pos long, v {kind}")


def verdicts(fn, p, **kw):
    return {(r.codec, r.verdict) for r in fn(p, **kw).collect()}


INTS = {
    "few": [i * 7 % 5 for i in range(3000)], "negative": [i * 7919 % 1001 - 500 for i in range(2000)], "sorted": [i + i // 3 for i in range(1500)], "runs": [i // 40 for i in range(1600)],
    "mostly": [9 if i % 20 else i for i in range(1000)], "short": [1, 2, 3], "one": [4], "edge": [i % 2 for i in range(1024)], "below": [i % 2 for i in range(1023)],
}


@pytest.mark.parametrize("name", list(INTS))
def test_integers_want_what_the_planner_tries(spark, name):
    v = np.array(INTS[name], np.int64)
    ctx = planner.Context(3, frozenset())
    s, raw = planner.stats(v, "int64", 0), planner.raw_size(v, "int64")
    want = {(c, "sample") for c in ("runend", "sparse", "zigzag", "dict") if planner.wants_sample(c, v, "int64", s, raw, ctx)}
    got = verdicts(estimates.integer_verdicts, pages(spark, INTS[name], "long"))
    assert {x for x in got if x[1] == "sample"} == want
    r = planner.refined_delta(v, "int64", raw, 0.0, ctx)
    rows = estimates.delta_estimate(pages(spark, INTS[name], "long")).collect()
    assert [round(x.ratio, 9) for x in rows] == ([] if r is None else [round(r, 9)])
    assert not rows or ("delta", "deferred") in got


@pytest.mark.parametrize("values", [[i / 8 for i in range(900)], [float(i % 3) for i in range(900)], [1.5] * 400, [0.1, 0.2], [-0.0, 0.0] * 300])
def test_doubles_want_what_the_planner_tries(spark, values):
    v = np.array(values)
    ctx = planner.Context(3, frozenset())
    s, raw = planner.stats(v, "float64", 0), planner.raw_size(v, "float64")
    want = {(c, "sample") for c in ("alp", "alprd", "runend", "sparse") if planner.wants_sample(c, v, "float64", s, raw, ctx)}
    assert {x for x in verdicts(estimates.float_verdicts, pages(spark, values, "double")) if x[1] == "sample"} == want


@pytest.mark.parametrize("values", [["a"] * 2000, [f"key-{i % 600}" for i in range(1300)], [f"{i}" for i in range(500)], ["x", "y"], ["", ""] * 600])
def test_strings_want_what_the_planner_tries(spark, values):
    v = [x.encode() for x in values]
    ctx = planner.Context(3, frozenset())
    s, raw = planner.stats(v, "string", 0), planner.raw_size(v, "string")
    want = {(c, "sample") for c in ("dict", "runend", "sparse", "fsst") if planner.wants_sample(c, v, "string", s, raw, ctx)}
    assert verdicts(estimates.string_verdicts, pages(spark, values, "string")) == want


def test_an_empty_table_has_no_estimates(spark):
    for fn, kind in ((estimates.integer_verdicts, "long"), (estimates.delta_estimate, "long"), (estimates.float_verdicts, "double"), (estimates.float_dict_estimate, "double"), (estimates.string_verdicts, "string")):
        assert fn(pages(spark, [], kind)).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_sampled_ratios_are_those_of_the_sample(spark):
    p = q.pages(spark, SF, "l_extendedprice").cache()
    notes = report.explain_selection(p).collect()
    samples = [r for r in notes if r.kind == "sample"]
    assert samples and {(r.page_id, r.codec) for r in samples} <= {(r.page_id, r.codec) for r in estimates.float_verdicts(p).where("verdict = 'sample'").collect()}
    lengths = {r.page_id: r.sampled for r in estimates.sample_plan(p).collect()}
    for r in samples:
        assert r.ratio * r.bytes == pytest.approx(44 + 8 * lengths[r.page_id])
    for page in lengths:
        of_page = [r for r in notes if r.page_id == page]
        assert [r.chosen for r in of_page].count(True) == 1
        best = max(of_page, key=lambda r: r.ratio)
        if not best.chosen:  # the sample promised what the whole page doesn't hold
            v = np.array([r.v for r in p.where(p.page_id == page).orderBy("pos").collect()])
            assert planner.BUILD[best.codec](v, "float64", planner.Context(3, frozenset())).size >= planner.raw_size(v, "float64")
            assert next(r for r in of_page if r.chosen).codec == "raw"
    p.unpersist()


@pytest.mark.parametrize("n", [5, 700, 5000])
def test_split_bits_are_those_of_the_binary_pages(spark, n):
    values = [(1000 + i * 37 % 1777) * 1.000000001 * (1 if i % 50 else -1e200) for i in range(n)]
    cut, words = kernels.alprd_cut(np.array(values))
    rows = floats.alprd_encode(pages(spark, values, "double")).orderBy("pos").collect()
    known = [int(w) for w in words]
    assert {r.cut for r in rows} == {cut}
    for r, bits in zip(rows, np.array(values).view(np.uint64), strict=True):
        left = int(bits) >> (64 - cut)
        assert r.left_part == left and r.code == (known.index(left) if left in known else None)
    assert [r.v for r in floats.alprd_decode(floats.alprd_encode(pages(spark, values, "double"))).orderBy("pos").collect()] == values

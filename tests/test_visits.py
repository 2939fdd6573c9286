"""Predicates and point access on loaded pages against decoded rows, and pages that a filter leaves unread."""

import numpy as np
import pytest

from pagecodec.plans import queries as q
from pagecodec.sources import datasource, pages
from pagecodec.wire import nodes, planner, visits

R = np.random.default_rng(3)
CASES = {
    "const": np.full(500, 7), "sequence": np.arange(500) * 3, "dict": R.integers(0, 4, 900) * 10**12 - 10**12, "runs": np.repeat(R.integers(-5, 5, 60), 40), "sparse": np.where(R.random(900) < 0.03, R.integers(0, 1 << 40, 900), 7),
    "narrow": R.integers(0, 200, 700), "outliers": np.where(R.random(900) < 0.01, 1 << 50, R.integers(0, 30, 900)), "negative": R.integers(-30, 30, 800), "wide": R.integers(-(1 << 62), 1 << 62, 300), "one": np.array([9]), "none": np.array([], np.int64),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("nulls", [0, 0.3])
def test_visits_are_decoded_rows(name, nulls):
    v = CASES[name].astype(np.int64)
    valid = None if not nulls else R.random(len(v)) >= nulls
    shown = v if valid is None else np.where(valid, v, 0)
    x = nodes.load(planner.compress(shown, "int64", valid).to_bytes(), "int64")
    known = np.ones(len(v), bool) if valid is None else valid
    for wanted in ([7], [3, 9, -4], [10**12, 0], [1 << 50], [-(1 << 63)], v[:3].tolist()):
        test = lambda a: np.isin(a, np.array(wanted, np.int64))  # noqa: B023, E731
        assert visits.matching(x, test).tolist() == [i for i in range(len(v)) if known[i] and v[i] in wanted], x.tree
        codes = visits.equal_codes(x, wanted[0]) if wanted else None
        assert codes is None or codes.tolist() == [i for i in range(len(v)) if known[i] and v[i] == wanted[0]]
    for i in range(len(v)):
        got = visits.value_at(x, i)
        assert (got is None and not known[i]) or int(got) == v[i]
    with pytest.raises(IndexError):
        visits.value_at(x, len(v))


@pytest.mark.parametrize("values", [[b"a", b"bb", b"a", b""] * 50, [f"url/{i}/path".encode() for i in range(300)], [b"x"] * 90])
def test_string_visits(values):
    x = nodes.load(planner.compress(values, "string", None).to_bytes(), "string")
    test = lambda a: np.array([s in (b"a", b"url/7/path", b"x") for s in a], bool)
    assert visits.matching(x, test).tolist() == [i for i, s in enumerate(values) if s in (b"a", b"url/7/path", b"x")]
    assert [visits.value_at(x, i) for i in range(len(values))] == values


def test_a_dictionary_without_the_value_isnt_decoded(monkeypatch):
    v = (np.arange(2000) * 7919 % 5) * 10**12
    x = nodes.load(planner.compress(v, "int64", None).to_bytes(), "int64")
    assert x.codec == nodes.DICT
    monkeypatch.setattr(x.children[1], "values", lambda: pytest.fail("codes were decoded"), raising=False)
    assert not len(visits.matching(x, lambda a: a == 3))


def test_decode_into_a_buffer():
    x = planner.compress(np.arange(40) % 3, "int64", None)
    out = np.empty(40, np.int64)
    visits.decode_into(x, out)
    assert out.tolist() == [i % 3 for i in range(40)]
    for bad in (np.empty(39, np.int64), np.empty(40, np.int32)):
        with pytest.raises(nodes.FormatError):
            visits.decode_into(x, bad)


def test_filters_leave_pages_unread(spark, tmp_path):
    p = q.pages(spark, "/root/testdata/sf0.001", "o_orderkey", "orders")
    path = str(tmp_path / "sealed")
    pages.seal(p).write.parquet(path)
    sealed = spark.read.parquet(path)
    wanted = sealed.agg({"max_v": "max"}).first()[0]
    found = pages.filter_eq(sealed, "int64", wanted)
    assert found.count() == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(min_v" in plan and "GreaterThanOrEqual(max_v" in plan
    # a page that the bounds exclude may hold anything: it isn't loaded
    broken = sealed.selectExpr("page_id", "n_rows", "min_v", "max_v", f"case when max_v = {wanted} then blob else X'00' end as blob")
    assert pages.filter_eq(broken, "int64", wanted).count() == 1
    path2 = str(tmp_path / "broken")
    broken.write.parquet(path2)
    datasource.register(spark)
    read = lambda where, **o: spark.read.format("pagecodec").options(path=path2, ptype="int64", **o).load().where(where).count()
    assert read(f"v = {wanted}") == 1 and read(f"v >= {wanted}") == 1 and read(f"v in ({wanted}, {wanted + 5})") == 1 and read(f"v > {wanted}") == 0
    with pytest.raises(Exception, match="(?i)limit|format|declares|rows"):
        read(f"v = {wanted}", max_length="10")

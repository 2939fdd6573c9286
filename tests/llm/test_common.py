"""Emitting rows as often as decided, and where tables are written."""

from collections import Counter

import pytest
from pagecodec.llm import common


def test_copies_of_equal_rows_are_emitted_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(common, "COPIES_AT_ONCE", 100)
    df = spark.createDataFrame([(1, "a")] * 30 + [(2, "b"), (3, "c"), (None, "d"), (None, "d"), (4, "e")], "doc_id long, text string").repartition(3)
    rows = common.keyed(df, "doc_id")
    decided = {1: (30, 1001), 2: (1, 3), 3: (1, 0), None: (2, 100)}
    keys = rows.select("key_id", "key_hash").distinct().collect()
    plan = spark.createDataFrame([(r.key_id, r.key_hash, *decided[r.key_id]) for r in keys if r.key_id in decided], "key_id long, key_hash long, n long, copies long")
    out = common.emit(rows, plan)
    assert Counter((r.c0, r.c1) for r in out.collect()) == {(1, "a"): 1001, (2, "b"): 3, (None, "d"): 100, (4, "e"): 1}
    assert out.rdd.glom().map(len).max() < 1001


def test_rows_are_left_out_by_key(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "c"), (None, "d")], "doc_id long, text string")
    rows = common.keyed(df, "doc_id")
    left = common.without(rows, rows.where("c1 in ('a', 'c')"))
    assert sorted(r.c1 for r in left.collect()) == ["b", "d"]


def test_a_cluster_must_name_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):  # noqa: N802
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()  # noqa: N815

    with pytest.raises(ValueError):
        common.shared_root(Session())

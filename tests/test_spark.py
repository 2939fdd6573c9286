"""Operators on small tables: edge cases, plans, the data source, the streaming sink and whole tables."""

import math

import pytest
from pyspark.sql import functions as F

from pagecodec.functions import float_bits, unzigzag, zigzag
from pagecodec.operators import codecs as c
from pagecodec.operators import floats, paging, stats
from pagecodec.plans import queries, report
from pagecodec.sources import datasource, pages


def page(spark, values, kind="bigint"):
    return spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], f"page_id long, pos long, v {kind}")


def rows(df, *cols):
    return sorted((tuple(r[x] for x in cols) for r in df.collect()), key=repr)


def test_delta_in_one_exchange(spark):
    p = paging.paged(spark.range(1000), "id * id", key="id", order_by=["id"], page_keys=100)
    plan = c.delta_decode(c.delta_encode(p))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_scan_prunes_columns(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 3 as a", "cast(id as string) as b").write.parquet(str(tmp_path / "t"))
    p = paging.paged(spark.read.parquet(str(tmp_path / "t")), "a", key="id", order_by=["id"])
    assert "ReadSchema: struct<id:bigint,a:bigint>" in c.for_frames(p)._jdf.queryExecution().toString()


def test_exact_pages(spark):
    got = paging.exact_pages(spark.range(1000), "id", order_by=["id"], page_rows=64)
    assert all(r.page_id * 64 + r.pos == r.v for r in got.collect())
    assert got.count() == 1000


def test_zigzag(spark):
    v = spark.createDataFrame([(0,), (-1,), (1,), (-(2**63),), (2**63 - 1,)], "v long").select("v", zigzag(F.col("v")).alias("z"))
    assert all(r.v == r.w for r in v.select("v", unzigzag(F.col("z")).alias("w")).collect())


def test_float_bits_and_signed_zero(spark):
    p = page(spark, [0.0, -0.0, -0.0, math.nan, 0.0, None], "double")
    got = [r.b for r in p.select(float_bits("v").alias("b")).collect()]
    assert got[0] == 0 and got[1] == -(2**63) and got[3] == 0x7FF8000000000000 and got[5] is None
    d, codes = c.dict_encode(floats.with_bits(p.where("v is not null")), F.col("bits"))
    assert d.count() == 3
    assert [math.copysign(1, r.v) for r in c.dict_decode(d, codes).orderBy("pos").collect()][:3] == [1, -1, -1]


def test_sparse_tie(spark):
    """Of equally frequent values the one that reaches the count first is the fill."""
    assert c.sparse_fill(page(spark, [1, 2, 2, 1])).first().fill == 2
    assert c.sparse_fill(page(spark, [1, 1, 2, 2])).first().fill == 1


def test_null_predicates(spark):
    d, codes = c.dict_encode(page(spark, [1, 2, 1]))
    assert rows(c.dict_filter(d, codes, F.col("v") == 1, negate=True), "pos") == [(1,)]


@pytest.mark.parametrize("values", [[], [None], [None, None], [5], [5, None, 5], [2**62, -(2**62)], list(range(300))])
def test_sealed_edge_pages(spark, values):
    p = page(spark, values)
    assert rows(pages.load(pages.seal(p), "int64", "bigint"), "pos", "v") == rows(p, "pos", "v")


def test_bad_pages(spark):
    blobs = pages.seal(page(spark, list(range(50)))).withColumn("blob", F.expr("substring(blob, 1, 30)"))
    assert pages.load(blobs, "int64", "bigint", on_error="skip").count() == 0
    assert pages.check(blobs, "int64").first().error


def test_runend_lookup(spark):
    p = page(spark, [5] * 5 + [7] * 5 + [None] * 2)
    assert rows(c.runend_lookup(c.runend_encode(p), p.select("page_id", "pos")), "pos", "v") == rows(p, "pos", "v")


def test_statistics_of_map_limits(spark):
    assert stats.distinct_stats(page(spark, list(range(600)))).first().distinct_v == 600
    assert stats.distinct_stats(page(spark, list(range(600)))).first().most_frequent == 0


def test_compress_table_and_data_source(spark, tmp_path):
    df = spark.range(3000).selectExpr("id", "cast(id % 7 as int) as small", "cast(id as decimal(10,2)) as money", "date_add(date'2020-01-01', cast(id as int)) as day", "case when id % 3 = 0 then 'x' end as s")
    sealed = report.compress(df, ["id", "small", "money", "day", "s"], key="id", order_by=["id"])
    assert sealed.count() == 15
    r = {x.column: x for x in report.compression_report(sealed).collect()}
    assert all(x.encoded_bytes <= x.raw_bytes for x in r.values())
    path = str(tmp_path / "pages")
    sealed.where("column = 'id'").write.parquet(path)
    datasource.register(spark)
    got = spark.read.format("pagecodec").option("path", path).option("ptype", "int64").load()
    assert got.count() == 3000
    assert rows(got.where("page_id = 1").agg(F.min("v").alias("a"), F.max("v").alias("b")), "a", "b") == [(1024, 2047)]


def test_streaming_sink(spark, tmp_path):
    from pagecodec.streaming import seal_stream

    spark.range(500).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    q = seal_stream(stream, "id * 2", key="id", order_by=["id"], path=str(tmp_path / "out"), checkpoint=str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("n_rows")).first()[0] == 500


def test_entry_imports_without_the_llm_package():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys, builtins\nreal = builtins.__import__\ndef f(n, *a, **k):\n    if n.startswith('pagecodec.llm') or n == 'corpus_pipeline': raise ModuleNotFoundError(n, name=n)\n    return real(n, *a, **k)\nbuiltins.__import__ = f\nimport __spark_entry__ as e; print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True, check=True)
    assert int(out.stdout) == len(queries.QUERIES)

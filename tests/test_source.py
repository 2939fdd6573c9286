"""Writing pages through the data source, and reading what was written."""

import os

import pyarrow as pa
import pytest

from pagecodec.sources import datasource, pages


def numbers(spark, n, pages_of=100):
    return spark.range(n).selectExpr(f"id div {pages_of} as page_id", f"id % {pages_of} as pos", "if(id % 9 = 0, null, id * 3 - 50) as v")


def read(spark, path, **options):
    return spark.read.format("pagecodec").options(path=path, ptype="int64", **options).load()


def rows(df):
    return sorted((r.page_id, r.pos, r.v is None, r.v or 0) for r in df.collect())


def save(df, path, mode="append"):
    df.write.format("pagecodec").option("path", path).mode(mode).save()


def test_what_is_written_is_read(spark, tmp_path):
    datasource.register(spark)
    path = str(tmp_path / "pages")
    p = numbers(spark, 1050)
    save(pages.in_order(p), path)
    assert rows(read(spark, path)) == rows(p)
    assert not [f for f in os.listdir(path) if f.startswith("_")]
    assert read(spark, path).where("page_id = 3 and v > 900").count() == p.where("page_id = 3 and v > 900").count()
    later = p.selectExpr("page_id + 100 as page_id", "pos", "v")
    save(pages.in_order(later), path)
    assert read(spark, path).count() == 2100
    save(pages.in_order(later), path, "overwrite")
    assert rows(read(spark, path)) == rows(later)


def test_stored_pages_are_those_of_seal(spark, tmp_path):
    datasource.register(spark)
    path, p = str(tmp_path / "pages"), numbers(spark, 500)
    save(pages.in_order(p), path)
    cells = lambda df: sorted(tuple(map(repr, r)) for r in df.select(*[c.split()[0] for c in pages.SEALED.split(", ")]).collect())
    assert cells(spark.read.parquet(path)) == cells(pages.seal(p))


def test_strings_and_an_empty_table(spark, tmp_path):
    datasource.register(spark)
    path, none = str(tmp_path / "s"), str(tmp_path / "none")
    p = spark.range(300).selectExpr("id div 128 as page_id", "id % 128 as pos", "concat('k', id % 7) as v")
    save(pages.in_order(p), path)
    got = spark.read.format("pagecodec").options(path=path, ptype="string", spark_type="string").load()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, p.collect()))
    save(pages.in_order(numbers(spark, 0)), none)
    assert os.listdir(none) == []


def test_pages_that_are_not_whole_are_refused(spark, tmp_path):
    datasource.register(spark)
    path = str(tmp_path / "bad")
    with pytest.raises(Exception, match="in_order"):
        save(numbers(spark, 400).repartition(3, "pos"), path)
    assert not os.path.isdir(path) or all(f.startswith("_") for f in os.listdir(path))

    def batch(*triples):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*triples, strict=True)], names=["page_id", "pos", "v"])

    cut = [batch((0, 0, 5), (0, 1, 6)), batch((0, 2, 7), (4, 0, 8))]
    assert [(k, c.to_pylist()) for k, c in datasource.whole_pages(iter(cut))] == [(0, [5, 6, 7]), (4, [8])]
    for wrong in ([batch((4, 0, 1)), batch((0, 0, 1))], [batch((0, 0, 1), (0, 2, 1))], [batch((0, 1, 1))], [batch((0, 0, 1), (0, 0, 1))], [batch((None, 0, 1), (0, 0, 1))]):
        with pytest.raises(ValueError):
            list(datasource.whole_pages(iter(wrong)))

"""Cross-document line rules, mixing and WARC archives."""

import gzip
import io
import os
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pagecodec.llm import common, mixing, quality_lines, queries, warc

SF = "/root/testdata/sf0.001"


def by_oracle(name, **tables):
    con = duckdb.connect()
    for t, rows in tables.items():
        con.execute(f"create view {t} as select * from read_parquet('{rows}')")
    rel = con.execute(queries.ORACLES[name])
    names = [d[0] for d in rel.description]
    return names, sorted(map(repr, rel.fetchall()))


@pytest.mark.parametrize(("name", "table"), [("op2_warc", "pages"), ("op3_mixing", "documents")])
def test_query_is_its_oracle(spark, name, table):
    names, want = by_oracle(name, **{table: f"{SF}/{table}.parquet"})
    assert sorted(repr(tuple(r[c] for c in names)) for r in queries.QUERIES[name](spark, SF).collect()) == want


# quality rules


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_counts(text):
    w, lines, dup = words(text), set(), 0
    for line in (text or "").split("\n"):
        dup += bool(words(line)) and line in lines
        lines.add(line)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = {x for x, n in Counter(windows).items() if n > 1}
    inside = {i + k for i, x in enumerate(windows) if x in often for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside)


def brute_quality(rows, max_docs=20, max_share=0.001, min_kept=0.3, min_words=10):
    norm = lambda line: re.sub("[0-9]", "0", " ".join(words(line.lower())))
    hosts, lines = Counter(h for _, _, h in rows), Counter()
    for _, t, h in rows:
        lines.update({(h, norm(x)) for x in (t or "").split("\n") if norm(x)})
    out = []
    for i, t, h in rows:
        c = brute_counts(t)
        gone = sum(len(words(norm(x))) for x in (t or "").split("\n") if norm(x) and lines[h, norm(x)] > max(max_docs, hosts[h] * max_share))
        failed = c[0] < 10 or 100 * c[4] > 20 * c[0]
        out.append((i, *c, gone, failed, not failed and c[0] - gone >= min_words and c[0] - gone >= min_kept * c[0]))
    return out


def test_quality_query_is_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    assert sorted(map(tuple, queries.op4_quality_lines(spark, SF).collect())) == sorted(brute_quality(rows))


def test_line_limit_does_not_grow_with_the_host(spark):
    """A line in 25 documents goes from a host of 30 and from one of 30,000."""
    line, own = "shared line of the site that many pages of it hold", "own words"
    rows = [(f"{line}\n{own}", h) for h in ("small", "large") for _ in range(25)] + [(None, "large")] * 29_975 + [(None, "small")] * 5
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, source string")
    got = quality_lines.quality_lines(df).where("n_words > 0").collect()
    assert len(got) == 50 and {r.removed_words for r in got} == {13}


def test_frequent_lines_deplete_documents(spark):
    line, own = "all rights reserved by the owner 2024 of this page here", "words that only document {} has and no other one holds at all"
    rows = [(i, line.replace("2024", str(1000 + i)) + ("\n" + own.format("".join(chr(97 + int(d)) for d in str(i))) if i % 2 else ""), "h") for i in range(60)] + [(100, line, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(map(tuple, quality_lines.quality_lines(df).collect()))
    assert got == sorted(brute_quality(rows))
    assert {r[0] for r in got if not r[8]} == set(range(0, 60, 2))
    # the same by a shuffled join, as beyond the size of a broadcast
    small = quality_lines.FREQUENT_TO_BROADCAST
    quality_lines.FREQUENT_TO_BROADCAST = 0
    try:
        assert sorted(map(tuple, quality_lines.quality_lines(df).collect())) == got
    finally:
        quality_lines.FREQUENT_TO_BROADCAST = small


def test_quality_of_odd_documents(spark, odd, none):
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    assert sorted(map(repr, map(tuple, quality_lines.quality_lines(odd).collect()))) == sorted(map(repr, brute_quality(rows)))
    assert quality_lines.quality_lines(none).count() == 0


# mixing


def test_mix_meets_its_targets(spark):
    got = queries.op3_mixing(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source"), "doc_id").collect()
    taken, largest = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        largest[r.source] = max(largest.get(r.source, 0), r.size)
        assert r.taken <= 3 * r.size and r.taken == r.size * r.copies
    for r in got:
        assert abs(taken[r.source] - r.target) <= largest[r.source]
    by = {r.source: (r.target, r.source_size) for r in got}
    assert sum(t for t, _ in by.values()) == pytest.approx(sum(s for _, s in by.values()))


def test_mix_does_not_depend_on_partitions(spark, odd):
    runs = [sorted(map(repr, mixing.mix(df).collect())) for df in (odd, odd.repartition(7), odd.coalesce(1))]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 13


def test_mix_of_nothing(spark, odd, none):
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0
    assert all(r.target == 0 and r.taken == 0 for r in mixing.mix(odd.where("text is null")).collect())


def test_mixed_repeats_rows(spark, odd):
    copies = Counter()
    for r in mixing.mix(odd).collect():
        copies[r.doc_id] += r.copies
    out = mixing.mixed(odd)
    assert out.columns == odd.columns
    got = Counter(r.doc_id for r in out.collect())
    assert {k: n for k, n in copies.items() if n} == dict(got)


# WARC


def test_archives_are_members_with_an_index(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i % 3}</p>" * 50) for i in range(30)], "page_id long, url string, html string").coalesce(1)
    raw, new = f"file://{tmp_path}/raw", f"file://{tmp_path}/new"
    manifest = common.table(warc.write_monolithic(pages, raw), "t-manifest")
    done = common.table(warc.normalise(warc.revisits(manifest), new), "t-archives").collect()
    (mono,) = os.listdir(tmp_path / "raw")
    data = (tmp_path / "raw" / mono).read_bytes()
    z = zlib.decompressobj(31)
    assert z.decompress(data).count(b"WARC-Type: response") == 30 and z.eof and not z.unused_data  # one stream
    assert [r.records for r in done] == [30]
    path = done[0].archive.removeprefix("file://")
    index = [eval(x) for x in open(done[0].sidecar.removeprefix("file://"))]  # noqa: S307
    with open(path, "rb") as f:
        kinds = [warc.read_record(f, x["offset"], x["length"])[0]["WARC-Type"] for x in index]
    assert kinds == ["response"] * 3 + ["revisit"] * 27
    assert sum(x["length"] for x in index) == os.path.getsize(path) and gzip.open(path).read().count(b"WARC/1.1\r\n") == 30


def test_records_of_any_gzip_layout():
    one = [warc.response(i, f"http://x/{i}", b"\r\n\r\nWARC/1.1" * i, "S" * 32, str(i)) for i in range(5)]
    for data in (gzip.compress(b"".join(one)), b"".join(map(gzip.compress, one)), gzip.compress(one[0] + one[1]) + gzip.compress(b"".join(one[2:]))):
        assert [b for _, b in warc.records(io.BytesIO(data))] == [x[x.index(b"\r\n\r\n") + 4 : -4] for x in one]
    for bad in (gzip.compress(b"".join(one))[:-20], gzip.compress(b"".join(one)[:-9])):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.records(io.BytesIO(bad)))
    assert list(warc.records(io.BytesIO(b""))) == []


def test_odd_pages(spark):
    long = "z" * 3_000_000
    rows = [(1, "u", "same"), (1, "u", "same"), (2, None, None), (3, "a b\r\nX: y", ""), (None, "u", "same"), (4, "é", long), (5, "é", long), (None, None, None)]
    pages = spark.createDataFrame([(*r, "extra", 1) for r in rows], "page_id long, url string, html string, archive string, place long").repartition(3)
    got = warc.normalised_pages(pages).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append((r.payload_bytes, r.record_type, r.refers_to))
    assert sorted(by[1], key=str) == [(4, "response", None), (4, "revisit", 1)]
    assert by[2] == [(0, "response", None)] and by[3] == [(0, "revisit", 2)] and by[4] == [(3_000_000, "response", None)] and by[5] == [(3_000_000, "revisit", 4)]
    assert sorted(by[None]) == [(0, "revisit", 2), (4, "revisit", 1)]
    assert {r.record_type for r in warc.normalised_pages(pages, min_bytes=5).where("payload_bytes < 5").collect()} == {"response"}
    assert warc.normalised_pages(pages.where("false")).count() == 0


def test_damaged_archives_give_their_leading_records():
    one = [warc.response(i, f"http://x/{i}", b"body %d " % i * 2000, "S" * 32, warc.record_id("a", i)) for i in range(6)]
    data = gzip.compress(b"".join(one))
    for cut in (len(data) - 3, len(data) // 2, 40, 3):
        with pytest.raises(ValueError):
            list(warc.records(io.BytesIO(data[:cut])))
        got = [b for _, b in warc.records(io.BytesIO(data[:cut]), salvage=True)]
        assert got == [x[x.index(b"\r\n\r\n") + 4 : -4] for x in one[: len(got)]] and len(got) < 6 + (cut == len(data) - 3)
    odd = b"WARC/1.1\r\nX-Odd: \xff\xfe\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    headers, block = next(warc.records(io.BytesIO(gzip.compress(odd))))
    assert warc.record([h for h in headers if h[0] != "Content-Length"], block) == odd
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(gzip.compress(b"WARC/1.1\r\nX: 1\r\n\r\nhi\r\n\r\n"))))


def test_revisits_name_their_response(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "same" if i % 2 else f"own {i}") for i in range(12)] + [(3, "http://h/3", "same")] * 2, "page_id long, url string, html string").repartition(3)
    raw, new = f"file://{tmp_path}/raw", f"file://{tmp_path}/new"
    manifest = common.table(warc.write_monolithic(pages, raw), "t-manifest")
    done = common.table(warc.normalise(warc.revisits(manifest), new), "t-archives").collect()
    ids, revisits = {}, []
    for r in done:
        with open(r.archive.removeprefix("file://"), "rb") as f:
            for headers, _ in warc.records(f):
                h = dict(headers)
                assert h["WARC-Record-ID"] not in ids
                ids[h["WARC-Record-ID"]] = h
                revisits += [h] * (h["WARC-Type"] == "revisit")
    assert len(ids) == 14 and len(revisits) == 7
    for h in revisits:
        first = ids[h["WARC-Refers-To"]]
        assert first["WARC-Type"] == "response" and first["X-Page-Id"] == h["X-Refers-To-Page-Id"] == "1" and h["WARC-Refers-To-Target-URI"] == first["WARC-Target-URI"]

"""SimHash near-duplicates and components against brute force."""

import random
import re

import pytest
import xxhash
from pagecodec.llm import components, simhash

from .conftest import union_find

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text, width=3):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    near = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    return union_find(len(fps), near)


def test_query_is_brute_force(spark):
    from pagecodec.llm.queries import op10_simhash

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    fps = [brute_fingerprint(r.text) for r in docs]
    want = {(r.doc_id, f"{f:016x}", docs[c].doc_id) for r, f, c in zip(docs, fps, brute_components(fps), strict=True)}
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in op10_simhash(spark, SF).collect()} == want


def test_components_of_close_fingerprints(spark):
    """Every way in which one to four bits fall into the wildcard blocks, chains and crowds included."""
    r = random.Random(11)
    fps = []
    for _ in range(60):
        f = r.getrandbits(64)
        fps.append(f)
        for _ in range(6):
            base = fps[-1] if r.random() < 0.4 else f
            block = r.choice([(0, 22), (22, 43), (43, 64), (0, 64)])
            for b in r.sample(range(*block), r.choice([1, 2, 3, 3, 3, 4])):
                base ^= 1 << b
            fps.append(base)
    fps += [1 << b for b in range(64)] + [0, 7, 2**64 - 1]
    fps = sorted(set(fps), key=simhash.signed)
    want = brute_components(fps)
    got = {q.fp: q.comp for q in simhash.fingerprint_components(spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")).collect()}
    groups = {}
    for f, c in zip(fps, want, strict=True):
        groups.setdefault(c, set()).add(simhash.signed(f))
    found = {}
    for f, c in got.items():
        found.setdefault(c, set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_no_table_passes_through_the_driver(spark, odd, monkeypatch):
    """Neither components nor links are broadcast, however small; only a list of words of bounded length may be."""
    monkeypatch.setattr(simhash, "WORDS_TO_BROADCAST", -1)
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    assert simhash.near_duplicates(odd).count() == 13
    done = store.executionsList(before, 10_000)
    plans = [done.apply(i).physicalPlanDescription() for i in range(done.size())]
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastExchange" in p for p in plans)


def test_radius_of_two(spark):
    nodes = spark.createDataFrame([(0,), (3,), (7 << 20,), (15 << 40,)], "fp long")
    got = {q.fp: q.comp for q in simhash.fingerprint_components(nodes, radius=2).collect()}
    assert got[0] == got[3] and len(set(got.values())) == 3


def test_components_against_union_find(spark):
    r = random.Random(3)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(250)] + [(500 + i, 501 + i) for i in range(60)] + [(700, i) for i in range(701, 760)]
    want = union_find(800, edges)
    got = {x.u: x.v for x in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got.get(n, n) == want[n] for n in {x for e in edges for x in e})
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_that_have_not_converged_are_refused(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(100)], "u long, v long")
    with pytest.raises(RuntimeError):
        components.components(chain, max_rounds=2)
    assert {x.v for x in components.components(chain).collect()} == {0}


def test_odd_documents(spark, odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == 13
    by = {}
    for x in got:
        by.setdefault(x.doc_id, []).append(x)
    assert {x.component_id for x in by[1] + by[2]} == {1} and len(by[1]) == 2
    assert all(x.fingerprint == "0" * 16 and x.component_id == 3 for k in (3, 4, 5) for x in by[k])
    assert len(by[None]) == 2
    assert simhash.near_duplicates(none).count() == 0


def test_one_of_each(spark, odd, none):
    left = simhash.one_of_each(odd)
    assert left.columns == odd.columns
    ids = sorted((x.doc_id for x in left.collect()), key=str)
    assert ids == sorted([1, 3, 6, 7, 8, 8, 9, None], key=str)
    assert simhash.one_of_each(none).count() == 0


def test_long_texts_are_counted_in_stretches():
    text = " ".join(f"w{i * i % 977}" for i in range(3 * simhash.STRETCH))
    assert simhash.fingerprint(text) == brute_fingerprint(text)

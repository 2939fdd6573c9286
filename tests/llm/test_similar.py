"""Groups of similar texts against brute force."""

import random

import numpy as np
import pytest
from pagecodec.llm import similar

from .conftest import union_find


def brute_sets(texts):
    return [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in ((t or "").lower().split() for t in texts)]


def brute_groups(texts):
    s = brute_sets(texts)
    near = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    return union_find(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if near(s[i], s[j])])


def edited(r, base, changes):
    own = list(base)
    for at in r.sample(range(len(own)), changes):
        own[at] = f"x{r.randrange(10**9)}"
    return own


def crowd(seed, n, words=150):
    """Copies of one text with 0 to 7 changed words, and copies of copies: most pairs are close to 0.8 from either side."""
    r = random.Random(seed)
    base = [f"b{r.randrange(4000)}" for _ in range(words)]
    copies = []
    for _ in range(n):
        source = r.choice(copies) if copies and r.random() < 0.4 else base
        copies.append(edited(r, source, r.randrange(0, 8)))
    return [" ".join(c) for c in copies]


@pytest.mark.parametrize("block", [8, 512])
def test_groups_are_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(similar, "BLOCK", block)
    texts = [*crowd(1, 120), *crowd(2, 40, 60), *crowd(3, 6), None, "", " \t", "two words", "Two Words", "one two three four five", *["same text " * 9] * 3]
    roots = brute_groups(texts)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in similar.one_of_each(df).collect()) == sorted(set(roots))


def test_fingerprints_find_what_no_band_shares(spark):
    """No two nodes share a band: only the ball hashing of fingerprints brings them together, and similarity still decides."""
    sets = [np.arange(100, dtype=np.uint64), np.arange(1, 101, dtype=np.uint64), np.arange(500, 600, dtype=np.uint64), np.arange(2, 102, dtype=np.uint64)]
    sims = [0, 7, 1, (1 << 40) - 1]  # the third is near by its fingerprint but unlike, the last alike but far
    nodes = spark.createDataFrame([(k, 100, f, [100 * k + i for i in range(similar.BANDS)]) for k, f in enumerate(sims)], "node long, n int, sim long, bands array<bigint>")
    held = spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in enumerate(sets)], "node long, shingles binary")
    got = {r.node: r.comp for r in similar.similar_components(similar.with_balls(nodes), lambda wanted: held, 0.8).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3}


def test_cells_give_every_link():
    r = np.random.default_rng(4)
    rows = [np.unique(r.integers(0, 90, r.integers(1, 80)).astype(np.uint64)) for _ in range(60)]
    rows += [np.unique(np.concatenate((x[1:], np.array([200 + i], np.uint64)))) for i, x in enumerate(rows)]
    both = similar.overlaps(rows)
    assert all(both[i, j] == len(np.intersect1d(rows[i], rows[j])) for i in range(120) for j in range(120) if i != j)
    roots = [i % 50 for i in range(120)]
    links = similar.cell_links(list(range(120)), roots, rows, 0.8)
    near = [(i, j) for i in range(120) for j in range(i) if roots[i] != roots[j] and 5 * len(np.intersect1d(rows[i], rows[j])) >= 4 * len(np.union1d(rows[i], rows[j]))]
    same = [(i, j) for i in range(120) for j in range(i) if roots[i] == roots[j]]
    assert union_find(120, near + same) == union_find(120, links + same) and set(map(tuple, map(sorted, links))) <= set(map(tuple, map(sorted, near)))


def test_similar_odd_documents(spark, odd, none):
    left = similar.one_of_each(odd)
    assert left.columns == odd.columns
    assert sorted((x.doc_id for x in left.collect()), key=str) == sorted([1, 3, 6, 7, 8, 8, 9, None], key=str)
    assert similar.one_of_each(none).count() == 0

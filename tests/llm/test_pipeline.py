"""The corpus pipeline: stages on odd documents, and their effects."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from pagecodec.llm import simhash

from .conftest import union_find
from .test_simhash import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "simhash", "mixing", "sentencepiece"]


@pytest.mark.parametrize("at", range(5))
def test_stage_on_odd_documents(spark, odd, none, at):
    name, stage = corpus_pipeline.STAGES[at]
    assert stage(spark, none, SF).count() == 0
    out = stage(spark, odd, SF)
    if at < 4:
        assert out.columns == odd.columns
        kept, had = Counter(map(repr, out.collect())), Counter(map(repr, odd.collect()))
        assert kept.keys() <= had.keys()
        if name != "mixing":
            assert not kept - had
    else:
        assert out.count() == odd.count()


def test_language_and_toxicity_keep_clean_documents(spark, docs):
    kept = corpus_pipeline.language(spark, docs, SF)
    assert kept.where("text rlike '[a-zA-Z]{3,}'").count() == docs.where("text rlike '[a-zA-Z]{3,}'").count()
    y = spark.read.parquet(f"{SF}/labels.parquet")
    clean = corpus_pipeline.clean(spark, docs, SF).join(y, "doc_id").groupBy("toxic").count().collect()
    had = {r.toxic: r["count"] for r in docs.join(y, "doc_id").groupBy("toxic").count().collect()}
    left = {r.toxic: r["count"] for r in clean}
    assert left[0] >= had[0] - 3 and left.get(1, 0) <= 0.15 * had[1]


def test_one_document_of_each_group_stays(spark, docs):
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    comps = brute_components([brute_fingerprint(r.text) for r in rows])
    want = sorted(r.doc_id for k, r in enumerate(rows) if comps[k] == k)
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == want


def similarity(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for w in ((t or "").lower().split() for t in (a, b))]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_near_copies_are_found_by_similarity(spark):
    """Copies with changed words at 0.8 or more go, those below stay; chains and a large group of near copies included."""
    r = random.Random(9)
    texts = []
    for _ in range(40):
        base = [f"w{r.randrange(5000)}" for _ in range(200)]
        texts.append(" ".join(base))
        for changes in (1, 2, 3, 4, 6, 9, 14):
            own = list(base)
            for at in r.sample(range(200), changes):
                own[at] = f"x{r.randrange(10**9)}"
            texts.append(" ".join(own))
    base = [f"g{i}" for i in range(300)]
    texts += [" ".join([*base[:k], f"y{k}", *base[k + 1 :]]) for k in range(300)]
    pairs = [(i, j) for g in range(40) for i in range(8 * g, 8 * g + 8) for j in range(8 * g, i) if similarity(texts[i], texts[j]) >= 0.8]
    roots = union_find(len(texts), pairs + [(320, i) for i in range(321, 620)])
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").repartition(3)
    assert sorted(x.doc_id for x in corpus_pipeline.dedup(spark, df, SF).collect()) == sorted({roots[i] for i in range(len(texts))})


def test_run(spark, docs):
    out = corpus_pipeline.run(spark, SF).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert out and all(r.parity and r.roundtrip for r in out)
    assert all((r.n_tokens > 0) == bool(re.search(r"\S", texts[r.doc_id])) for r in out)
    assert max(Counter(r.doc_id for r in out).values()) <= 3

"""Toxicity, language ID and LM scoring: brute force, held-out accuracy and odd documents."""

import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pagecodec.llm import langid, lm_scoring, queries, toxicity

SF = "/root/testdata/sf0.01"


def table(sf, name):
    return pq.read_table(f"/root/testdata/{sf}/{name}.parquet").to_pydict()


# toxicity


@pytest.fixture(scope="module")
def labelled():
    d, y = table("sf0.1", "documents"), table("sf0.1", "labels")
    text = dict(zip(d["doc_id"], d["text"], strict=True))
    return [(i, text[i], t) for i, t in zip(y["doc_id"], y["toxic"], strict=True) if i in text]


def test_held_out_toxicity(labelled):
    half, rest = [r for r in labelled if r[0] % 2 == 0], [r for r in labelled if r[0] % 2]
    texts, y = [r[1] for r in half], np.array([r[2] for r in half])
    chain, oof = toxicity.fit_chain(texts, y)
    found = chain.score([r[1] for r in rest])[:, -1] >= 0.5
    toxic = np.array([r[2] for r in rest]) == 1
    assert found[toxic].mean() > 0.9 and found[~toxic].mean() < 0.005
    # each later model is given the earlier probabilities, those of training out of fold
    assert chain.categories == ["severe", "pervasive", "toxic"]
    assert [len(m.earlier) for m in chain.models] == [0, 1, 2] and oof.shape == (len(half), 3)
    assert not np.allclose(oof[:, 0], chain.score(texts)[:, 0])


def test_earlier_models_change_the_verdict(labelled):
    texts, y = [r[1] for r in labelled[:800]], np.array([r[2] for r in labelled[:800]])
    chain, _ = toxicity.fit_chain(texts, y)
    before = chain.score(texts)
    assert chain.models[-1].earlier.any()
    for m in chain.models[:-1]:
        m.bias += 40 if chain.models[-1].earlier.sum() > 0 else -40
    after = chain.score(texts)
    assert ((before[:, -1] >= 0.5) != (after[:, -1] >= 0.5)).any()


def test_chain_is_brute_force(labelled):
    """Probabilities by dictionaries: each model's own weights over the text's values, then the earlier probabilities."""
    texts, y = [r[1] for r in labelled[:600]], np.array([r[2] for r in labelled[:600]])
    chain, _ = toxicity.fit_chain(texts, y)
    for text in [*texts[:40], None, "", "odd"]:
        tokens = sorted(set((text or "").split()))
        found = {}
        for t in tokens:
            w = re.sub(r"^\W+|\W+$", "", t.lower())
            for f in [w, *(w[:k] + "*" for k in (3, 5, 7) if len(w) > k)] if w else []:
                found[f] = found.get(f, 0) + 100 / (len(tokens) + 20) if f.endswith("*") and f != w else 1.0
        p = []
        for m in chain.models:
            z = m.bias + sum(found.get(f, 0) * v for f, v in zip(chain.names, m.weights, strict=True)) + sum(a * b for a, b in zip(m.earlier, p, strict=True))
            p.append(1 / (1 + math.exp(-max(-35, min(35, z)))))
        assert chain.score([text])[0].tolist() == pytest.approx(p)


def test_out_of_fold_rows_are_unseen():
    """A label that one text alone has can't be learned from that text, nor from its copies; held-out labels change nothing."""
    texts = ["bad word here"] * 4 + [f"good text {i}" for i in range(40)]
    _, oof = toxicity.fit_chain(texts, np.array([1] * 4 + [0] * 40))
    assert (oof[:4] < 0.5).all()
    r = random.Random(4)
    texts = [" ".join(r.choice(["foo", "bar", "baz", "qux", "scum", "idiot"]) for _ in range(8)) + f" {i}" for i in range(200)]
    y = np.array([int("scum" in t) for t in texts])
    s = toxicity.sample(texts, y)
    one = np.flatnonzero(s.fold == 0)
    other = y.copy()
    other[one] = 1 - other[one]
    assert np.allclose(toxicity.fit_chain(texts, y)[1][one, 0], toxicity.fit_chain(texts, other)[1][one, 0])


def test_chain_without_rows_or_kinds():
    chain, oof = toxicity.fit_chain([], np.array([], np.int64))
    assert oof.shape == (0, 3) and (chain.score(["x", None]) < 1e-9).all()
    chain, _ = toxicity.fit_chain(["a", None], np.array([1, 1]))
    assert (chain.score(["a"]) < 1e-9).all()
    assert chain.score([]).shape == (0, 3)


def test_toxicity_of_odd_documents(spark, odd, none):
    bad = spark.createDataFrame([(100 + i, f"you scum idiot {i}", "en", "a") for i in range(12)], "doc_id long, text string, lang string, source string")
    docs = odd.unionByName(bad, allowMissingColumns=True)
    labels = spark.createDataFrame([(i, 0, int(i >= 100)) for i in [1, 2, 6, 7, 8, 9, 3, 4, *range(100, 112)]] + [(None, 0, 1), (5, 0, None), (999, 0, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit_sample(docs, labels)
    clean = toxicity.clean_only(docs, chain)
    assert clean.columns == docs.columns
    assert sorted(map(repr, clean.collect())) == sorted(map(repr, docs.where("doc_id < 100 or doc_id is null").collect()))
    assert toxicity.clean_only(none, chain).count() == 0
    assert toxicity.clean_only(odd, toxicity.fit_sample(odd, labels.where("false"))).count() == odd.count()


def test_toxicity_query(spark):
    got = queries.op1_toxicity(spark, SF)
    assert got.columns == ["doc_id", "p_severe", "p_pervasive", "p_toxic", "is_toxic"] and got.count() == 1000
    y = spark.read.parquet(f"{SF}/labels.parquet")
    hits = got.join(y, "doc_id").where("toxic = 1").agg({"is_toxic": "count"}).first()[0]
    assert got.join(y, "doc_id").where("toxic = 1 and is_toxic").count() > 0.85 * hits and got.join(y, "doc_id").where("toxic = 0 and is_toxic").count() <= 3


# language ID


def brute_text(model_rows, text, effective=20, smoothing=0.5):
    """Words and tempered log likelihoods, by dictionaries."""
    grams = lambda t: [f"_{w}_"[i : i + 3] for w in re.findall(r"[^\W\d_]+", t.lower()) for i in range(len(w))]
    langs = sorted({x for x, _ in model_rows})
    counts = {x: Counter(g for y, t in model_rows if y == x for g in grams(t)) for x in langs}
    known = set().union(*counts.values())
    n = len(re.findall(r"[^\W\d_]+", (text or "").lower()))
    score = lambda x: sum(math.log((counts[x][g] + smoothing) / (sum(counts[x].values()) + smoothing * (len(known) + 1))) for g in grams(text or ""))
    return n, [score(x) * min(1, effective / n) if n else 0.0 for x in langs]


TRAIN = [("en", "the cat and the dog were there with them"), ("fr", "le chat et la souris étaient là où ça"), ("de", "der hund und die katze über straße"), ("en", "with that thing over there")]


@pytest.mark.parametrize("dense", [1 << 23, 0])
def test_likelihoods_are_brute_force(dense, monkeypatch):
    monkeypatch.setattr(langid, "DENSE", dense)
    monkeypatch.setattr(langid, "STRETCH", 7)
    model = langid.fit(TRAIN)
    for t in ["the cat", "été là", "straße über 12 ab² İx 日本", "", None, "12 !?", "x", "the " * 30, "a_b_c the_dog"]:
        n, ll = model.text(t, 20)
        want = brute_text(TRAIN, t)
        assert n == want[0] and ll.tolist() == pytest.approx(want[1])


def test_posterior_is_brute_force(spark):
    pages = [
        ("http://a.example.fr/x", "<html lang='de'><body>the cat</body></html>"), ("http://a.example.fr/y", "le chat et la souris"), ("http://b.example.fr/z", "le chat là"),
        ("http://c.other.com/", "<html lang=en>the dog was there"), (None, "der hund und die katze"), ("not an address", "the"), ("http://A.example.fr/Q", "x<script>var le = 'la'</script>"), ("http://c.other.com/1", ""), ("http://c.other.com/2", None),
    ]
    model, langs = langid.fit(TRAIN), ["de", "en", "fr"]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    got = {r.c0: r for r in langid.identify(df, model, langid.Columns(text="html", declared=None, host=None, url="url")).collect()}
    seen = [(langid.host_of(u), (langid.MARKUP.search(h or "") or [None, None])[1], *model.text(langid.visible(h or ""), 20)) for u, h in pages]
    every = [(h, d, int(np.argmax(ll))) for (h, d, _), _, n, ll in seen if n]
    share = lambda c, parent: [(c[k] + 20 * parent[k]) / (sum(c.values()) + 20) for k in range(3)]
    for i, ((h, d, suffix), declared, n, ll) in enumerate(seen):
        if not n:
            assert got[i].lang_found is None and not got[i].accepted and got[i].posterior == 0
            continue
        votes = list(every)
        votes.remove((h, d, int(np.argmax(ll))))  # its own
        whole = Counter(v[2] for v in votes)
        overall = [(whole[k] + 1) / (len(votes) + 3) for k in range(3)]
        mid = share(Counter(v[2] for v in votes if v[1] == d), overall)
        prior = share(Counter(v[2] for v in votes if v[0] == h), mid) if h else overall
        score = [x + math.log(p) for x, p in zip(ll, prior, strict=True)]
        for x, right in ((declared, 0.9), (suffix, 0.8)):
            if x in langs:
                score = [s + math.log(right if y == x else (1 - right) / 2) for s, y in zip(score, langs, strict=True)]
        p = np.exp(np.array(score) - max(score))
        p /= p.sum()
        assert got[i].lang_found == langs[int(p.argmax())] and got[i].posterior == pytest.approx(float(p.max()), abs=2e-6)


def test_visible_text():
    assert langid.visible("a<b>c</b>&amp;d<SCRIPT>x<y</script >e<style>z").split() == ["a", "c", "d", "e", "z"]
    assert langid.visible("<script>" * 100_000 + "<" * 100_000)
    assert langid.visible("1 < 2").split() == ["1", "<", "2"]


def test_held_out_languages():
    d = table("sf0.1", "documents")
    rows = [(x, t) for x, t in zip(d["lang"], d["text"], strict=True) if x and t]
    model = langid.fit(rows[:1000])
    hits = [model.languages[int(model.text(t, 20)[1].argmax())] == x for x, t in rows[1000:] if model.text(t, 20)[0]]
    assert np.mean(hits) > 0.99


def test_languages_of_odd_documents(spark, odd, none):
    model = langid.fit_sample(odd)
    kept = langid.accepted_only(odd, model)
    assert kept.columns == odd.columns
    assert not kept.where("text is null or doc_id in (3, 4, 5)").count()
    assert kept.where("doc_id in (1, 2)").count() == 3
    assert langid.accepted_only(none, model).count() == 0
    unknown = langid.identify(odd, langid.fit_sample(none)).collect()
    assert len(unknown) == odd.count() and all(r.lang_found is None and r.posterior == 0 and not r.accepted for r in unknown)
    assert langid.accepted_only(none, langid.fit_sample(none)).count() == 0


def test_language_is_found_without_the_label(spark):
    """Accuracy against a label that is no evidence, on rows that the model wasn't fitted on."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    got = langid.identify(docs.where("doc_id % 2 = 1"), langid.fit_sample(docs.where("doc_id % 2 = 0")), langid.Columns(declared=None)).where("lang_found is not null").collect()
    assert len(got) > 480 and sum(r.c2 == r.lang_found for r in got) > 0.99 * len(got)


def test_language_query(spark):
    got = queries.op6_langid(spark, SF).collect()
    assert len(got) == 1000 and sum(r.lang_found == r.declared for r in got) > 990 and sum(r.accepted for r in got) > 990
    pages = queries.langid_pages(spark, SF).collect()
    assert len(pages) == spark.read.parquet(f"{SF}/pages.parquet").count()


# LM scoring


def brute_scores(rows, target, size, mu=lm_scoring.MU):
    texts = {i: (t or "").lower().split() for i, t in rows}
    counts = Counter(w for t in texts.values() for w in t)
    known = {w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size]}
    tokens = {i: [w if w in known else None for w in t] for i, t in texts.items()}

    def model(ids):
        pairs, single = Counter(), Counter()
        begun = 0
        for i in ids:
            t = tokens[i]
            single.update(t)
            pairs.update(zip(["<begin>", *t], t, strict=False))
            begun += bool(t)
        single["<begin>"] = begun
        n, v = sum(single.values()) - begun, len(known) + 2
        word = lambda w: (single[w] + 0.5) / (n + 0.5 * v)
        return lambda a, b: -math.log((pairs[a, b] + mu * word(b)) / (single[a] + mu))

    near, back = model([i for i in tokens if i in target]), model(list(tokens))
    for i, t in tokens.items():
        each = [(near(a, b), back(a, b)) for a, b in zip(["<begin>", *t], t, strict=False)]
        yield i, len(t), *(np.mean(each, 0).tolist() if t else (None, None))


@pytest.mark.parametrize("size", [50_000, 40])
def test_losses_are_brute_force(spark, size):
    rows = [(1, "a good text of good words"), (2, "Good words make a text"), (3, "spam spam spam buy spam"), (4, "buy a good thing"), (5, None), (6, " \t"), (7, "new " * 50 + "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    good = spark.createDataFrame([(1,), (2,), (2,), (None,), (77,)], "id long")
    got = {r.doc_id: r for r in lm_scoring.score(df, good, size=size).collect()}
    for i, n, x, y in brute_scores(rows, {1, 2}, size):
        r = got[i]
        assert r.n_tokens == n
        if n:
            assert r.target_loss == pytest.approx(x, abs=1e-5) and r.background_loss == pytest.approx(y, abs=1e-5) and r.difference == pytest.approx(x - y, abs=1e-5)
        else:
            assert r.target_loss is None and r.difference is None
    assert got[1].difference < got[3].difference


def test_counts_of_pairs_are_exact(spark):
    """More distinct pairs than hashed buckets, words beyond the 50,000th, and pairs shared by several documents without being frequent."""
    r = random.Random(5)
    rows = [(i, " ".join(f"w{r.randrange(60_000)}" for _ in range(1500))) for i in range(800)]
    rows += [(1000 + i, rows[i][1] + " and more " + rows[i + 1][1]) for i in range(0, 40, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    good = spark.createDataFrame([(i,) for i in range(0, 50)], "id long")
    want = {i: (n, x, y) for i, n, x, y in brute_scores(rows, set(range(50)), 10**9)}
    for often in (10, 5_000):
        got = {r.doc_id: r for r in lm_scoring.score(df, good, min_count=1, often=often).collect()}
        assert got.keys() == want.keys()
        for i, (n, x, y) in want.items():
            assert got[i].n_tokens == n and got[i].target_loss == pytest.approx(x, abs=2e-6) and got[i].background_loss == pytest.approx(y, abs=2e-6)


def test_packed_columns_come_back():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        cells = [np.sort(r.integers(0, 1 << 60, n)), r.integers(-5, 5, n), r.integers(-(1 << 62), 1 << 62, n), np.zeros(n, np.int64), (r.random(n) - 0.5).view(np.int64)]
        assert all((a == b).all() and len(a) == n for a, b in zip(lm_scoring.unpacked(lm_scoring.pack(cells), 5), cells, strict=True))
        part = r.integers(0, 7, n)
        got = dict(lm_scoring.packed(part, cells))
        assert all((lm_scoring.unpacked(x, 5)[1] == cells[1][part == k]).all() for k, x in got.items()) and sorted(got) == sorted(set(part.tolist()))


def test_packing_holds_no_second_copy():
    """Columns are put in order a part at a time; sums are made a column at a time."""
    r = np.random.default_rng(6)
    cells, part = [r.integers(0, 1 << 40, 400_000) for _ in range(3)], r.integers(0, 50, 400_000)
    want = dict(lm_scoring.packed(part, cells))
    tracemalloc.start()
    for k, blob in lm_scoring.packed(part, cells):
        assert blob == want[k]
    assert tracemalloc.get_traced_memory()[1] < 2.8 * cells[0].nbytes
    tracemalloc.stop()


def test_vocabulary_has_no_largest_size(spark):
    """Every word of enough occurrences is known, past the 50,000th too."""
    words = [f"v{i}" for i in range(60_000)]
    df = spark.createDataFrame([(i, " ".join(words)) for i in range(5)] + [(9, "rare words here")], "doc_id long, text string")
    marked = lm_scoring._marked(df, spark.createDataFrame([], "id long"), "doc_id", "text")
    assert lm_scoring._words(lm_scoring.word_counts(marked), None, 5).size == 60_002
    assert lm_scoring.score(df, spark.createDataFrame([(1,)], "id long")).count() == 6


def test_counts_cover_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    words = lm_scoring.vocabulary(docs, 1000)
    near, back = lm_scoring.counts(docs, spark.createDataFrame([], "id long"), words)
    tokens = sum(len(r.text.lower().split()) for r in docs.select("text").collect())
    assert near.sum() == 0 and back[: 1 << lm_scoring.BUCKET_BITS].sum() == tokens


def test_scores_tell_good_from_bad(spark):
    got = queries.op9_lm_scoring(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").groupBy("quality").avg("difference").collect()
    by = {r[0]: r[1] for r in got}
    assert by[1] < by[0]


def test_scores_of_odd_documents(spark, odd, none):
    good = spark.createDataFrame([(1,), (9,)], "id long")
    got = lm_scoring.score(odd, good).collect()
    assert len(got) == 13 and sum(r.n_tokens == 0 for r in got) == 4
    assert lm_scoring.score(odd, good.where("false")).count() == 13
    assert lm_scoring.score(none, good).count() == 0

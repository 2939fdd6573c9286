"""Toxicity by a classifier chain.

Categories are predicted one after another by logistic regressions on the presence of words and on the share of words
with the same beginning; each later model also gets the probabilities of the earlier categories. Those are out-of-fold
predictions in training (a row's come from models fitted on other folds), so later models learn from probabilities
as they will meet them; the models that score the corpus are then fitted on all training rows. The last category, toxic,
is given all others and decides.

The training set is bounded by ``train_rows`` labelled rows (those of least id hash, one an id): a documented parameter. Every
row of the corpus is scored, over its whole text.

Cases: null or empty text has no features and is scored by the intercepts; labels without a document and null labels
are ignored; a category without both kinds of rows gets probability 0; all columns are kept, whatever their names;
an empty table stays empty.

Scale: one narrow scan with a model of bounded size; no shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TRAIN_ROWS = 6000
FOLDS = 5
MAX_FEATURES = 5000
MEMO = 100_000
#: Characters of the longest token that a memo keeps; longer ones are looked at anew.
LONGEST_KEPT = 64
EDGE = re.compile(r"^\W+|\W+$")
PREFIXES = (3, 5, 7)
#: Distinct words added to a text's own before shares are taken, so that one word of a short text doesn't weigh too much.
CALM = 20


def features(token: str) -> tuple[str, ...]:
    """Features of one blank-separated token: its word, and the beginnings of a longer word (marked by a star)."""
    w = EDGE.sub("", token.lower())
    return (w, *(w[:k] + "*" for k in PREFIXES if len(w) > k)) if w else ()


def values(of_tokens: list[tuple[str, ...]]) -> dict[str, float]:
    """Feature values of the distinct tokens of a text: 1 for a word, for a beginning the per cent of tokens that have it."""
    out: dict[str, float] = {}
    share = 100 / (len(of_tokens) + CALM)
    for found in of_tokens:
        for f in found:
            out[f] = out.get(f, 0.0) + share if f[-1] == "*" else 1.0
    return out


def feature_values(text: str | None) -> dict[str, float]:
    return values([features(t) for t in sorted(set((text or "").split()))])


def feature_set(text: str | None) -> set[str]:
    return {f for t in set((text or "").split()) for f in features(t)}


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class Sparse:
    """Feature values of texts, row after row; columns are numbered in the order of the features' names."""

    row: np.ndarray
    col: np.ndarray
    value: np.ndarray
    n_rows: int
    n_cols: int

    def take(self, rows: np.ndarray) -> Sparse:
        place = np.full(self.n_rows, -1, np.int32)
        place[rows] = np.arange(len(rows))
        mine = place[self.row] >= 0
        return Sparse(place[self.row[mine]], self.col[mine], self.value[mine], len(rows), self.n_cols)

    def columns(self, chosen: np.ndarray) -> Sparse:
        """Only the chosen columns, numbered anew."""
        place = np.full(self.n_cols, -1, np.int32)
        place[chosen] = np.arange(len(chosen))
        mine = place[self.col] >= 0
        return Sparse(self.row[mine], place[self.col[mine]], self.value[mine].astype(float), self.n_rows, len(chosen))

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.col] * self.value, self.n_rows)

    def sums(self, of_rows: np.ndarray) -> np.ndarray:
        """Sum of each column over rows of the given weights."""
        return np.bincount(self.col, of_rows[self.row] * self.value, self.n_cols)

    def holders(self, rows: np.ndarray) -> np.ndarray:
        """How many of the marked rows hold each column."""
        return np.bincount(self.col[rows[self.row] != 0], minlength=self.n_cols)


@dataclass
class Sample:
    """Training texts: features, the toxic label, the fold, and of toxic texts the columns that each nonblank line holds."""

    names: list[str]
    x: Sparse
    toxic: np.ndarray
    fold: np.ndarray
    lines: dict[int, list[np.ndarray]]


def sample(texts: list[str | None], toxic: np.ndarray, folds: int = FOLDS) -> Sample:
    """Features are those that three toxic texts or more hold, which any model asks for in its own rows; equal texts share a fold."""
    held: Counter = Counter()
    for t, y in zip(texts, toxic, strict=True):
        if y:
            held.update(feature_set(t))
    names = sorted(f for f, n in held.items() if n >= 3)
    place = {f: i for i, f in enumerate(names)}
    cols, kept = [np.zeros(0, np.int32)], [np.zeros(0, np.float32)]
    for t in texts:
        found = sorted((place[f], v) for f, v in feature_values(t).items() if f in place)
        cols.append(np.array([c for c, _ in found], np.int32))
        kept.append(np.array([v for _, v in found], np.float32))
    rows = np.repeat(np.arange(len(texts), dtype=np.int32), [len(c) for c in cols[1:]])
    own = lambda line: np.array([place[f] for f in feature_set(line) if f in place], np.int32)
    lines = {k: [own(x) for x in (texts[k] or "").split("\n") if x.strip()] for k in np.flatnonzero(toxic).tolist()}
    fold = np.array([zlib.crc32((t or "").encode()) % folds for t in texts], np.int64)
    return Sample(names, Sparse(rows, np.concatenate(cols), np.concatenate(kept), len(texts), len(names)), toxic, fold, lines)


def categories(s: Sample, rows: np.ndarray, x: Sparse) -> dict[str, np.ndarray]:
    """Labels of the rows (``x``: their features) from the one given, in the chain's order: severe (toxic, with a greater share of telling features
    than half of the toxic rows), pervasive (toxic, telling features in at least half of the lines), toxic. Telling features are found in at
    least three of the toxic rows and hardly in others; rows outside ``rows`` have no part in it."""
    toxic = s.toxic[rows]
    pos, neg = x.holders(toxic), x.holders(1 - toxic)
    telling = (pos >= 3) & (pos > 0.9 * (pos + neg))
    share = np.bincount(x.row, telling[x.col], x.n_rows) / np.maximum(1, np.bincount(x.row, minlength=x.n_rows))
    half = np.median(share[toxic != 0]) if toxic.any() else 0.0
    spread = np.array([2 * sum(bool(telling[c].any()) for c in s.lines[k]) >= len(s.lines[k]) > 0 if y else False for k, y in zip(rows.tolist(), toxic, strict=True)])
    return {"severe": toxic * (share > half), "pervasive": toxic * spread, "toxic": toxic}


@dataclass
class Linear:
    """A logistic regression: feature weights, weights of earlier categories and an intercept."""

    weights: np.ndarray
    earlier: np.ndarray
    bias: float = -35.0

    def probabilities(self, x: Sparse, given: np.ndarray) -> np.ndarray:
        return _sigmoid(x.times(self.weights) + given @ self.earlier + self.bias)


def train(x: Sparse, y: np.ndarray, given: np.ndarray, steps: int = 1000, l2: float = 3e-6) -> Linear:
    """Fit on the features most telling for the category, by full-batch Adam with a fixed number of steps."""
    n = len(y)
    if not n or y.min() == y.max():
        return Linear(np.zeros(x.n_cols), np.zeros(given.shape[1]))
    pos, neg = x.sums(y.astype(float)), x.sums(1.0 - y)
    odds = np.log((pos + 0.5) / (y.sum() + 1)) - np.log((neg + 0.5) / (n - y.sum() + 1))
    telling = np.flatnonzero((x.holders(y) >= 3) & (odds > 1.5))
    chosen = np.sort(telling[np.argsort(-pos[telling] * odds[telling], kind="stable")][:MAX_FEATURES])
    own = x.columns(chosen)
    w, a, b = np.zeros(len(chosen)), np.zeros(given.shape[1]), np.full(1, np.log(y.sum() / (n - y.sum())))
    state = [[np.zeros_like(v), np.zeros_like(v)] for v in (w, a, b)]
    for t in range(1, steps + 1):
        err = (_sigmoid(own.times(w) + given @ a + b) - y) / n
        for (m, v), g, param in zip(state, (own.sums(err) + l2 * w, given.T @ err + l2 * a, err.sum(keepdims=True)), (w, a, b), strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            param -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    weights = np.zeros(x.n_cols)
    weights[chosen] = w
    return Linear(weights, a, float(b[0]))


@dataclass
class Chain:
    """The models of the categories in turn; ``names`` are the features' names, of which only used ones are kept."""

    categories: list[str]
    names: list[str]
    models: list[Linear]
    memo: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probabilities, a row per text and a column per category."""
        memo, place = self.memo, {f: i for i, f in enumerate(self.names)}
        rows, cols, kept = [], [], []
        for k, text in enumerate(texts):
            tokens = []
            for t in set((text or "").split()):
                f = memo.get(t)
                if f is None:
                    if len(memo) > MEMO:
                        memo.clear()
                    f = tuple(x for x in features(t) if x in place)
                    if len(t) <= LONGEST_KEPT:
                        memo[t] = f
                tokens.append(f)
            for f, v in values(tokens).items():
                rows.append(k)
                cols.append(place[f])
                kept.append(v)
        x = Sparse(np.array(rows, np.int64), np.array(cols, np.int64), np.array(kept, float), len(texts), len(self.names))
        out = np.zeros((len(texts), 0))
        for m in self.models:
            out = np.column_stack([out, m.probabilities(x, out)])
        return out


def fit_chain(texts: list[str | None], toxic: np.ndarray, folds: int = FOLDS) -> tuple[Chain, np.ndarray]:
    """The chain, and the out-of-fold probabilities of the training rows, a column per category.

    A row's own probability of a category comes from a model fitted on the other folds, whose features are chosen and whose
    categories are derived there; that model is given the out-of-fold probabilities of the earlier categories.
    """
    s = sample(texts, toxic, folds)
    own = categories(s, np.arange(len(texts)), s.x)
    oof, models = np.zeros((len(texts), len(own))), []
    parts = [(np.flatnonzero(s.fold != k), np.flatnonzero(s.fold == k)) for k in range(folds)]
    for c, y in enumerate(own.values()):
        for rest, out in parts:
            x = s.x.take(rest)
            theirs = list(categories(s, rest, x).values())[c]
            oof[out, c] = train(x, theirs, oof[rest, :c]).probabilities(s.x.take(out), oof[out, :c])
        models.append(train(s.x, y, oof[:, :c]))
    used = np.flatnonzero(np.any([m.weights != 0 for m in models], axis=0))
    return Chain(list(own), [s.names[i] for i in used], [Linear(m.weights[used], m.earlier, m.bias) for m in models]), oof


def fit_sample(df: DataFrame, labels: DataFrame, *, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Chain:
    """Fit on the ``train_rows`` labelled ids of least hash; ids are chosen first, so only those texts move. Of several rows of an id the least text counts."""
    known = common.pick(labels, id=id_col, y=label_col).where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    chosen = common.table(known.select("id", "y", F.xxhash64("id").alias("h")).orderBy("h", "id").limit(train_rows).withColumnRenamed("id", "i"), "op1-chosen")
    src = common.pick(df, id=id_col, text=text_col)
    held = src.join(F.broadcast(chosen), F.col("id") == F.col("i")).groupBy("i").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    rows = sorted(((r.i, r.text, int(r.y != 0)) for r in held.collect()), key=lambda r: r[0])
    return fit_chain([r[1] for r in rows], np.array([r[2] for r in rows], np.int64))[0]


def score(df: DataFrame, chain: Chain, *, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """All columns of ``df`` by position as ``c0..``, then ``p_<category>`` and ``is_toxic``, the verdict of the chain's last model."""
    names = list(df.columns)
    at = names.index(text_col)
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            p = chain.score(b.column(at).to_pylist()).round(6)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(p[:, k]) for k in range(p.shape[1])), pa.array(p[:, -1] >= threshold)], names=[*(f"c{i}" for i in range(len(names))), *(f"p_{c}" for c in chain.categories), "is_toxic"])

    schema = plain.selectExpr("*", *(f"0d as p_{c}" for c in chain.categories), "true as is_toxic").schema
    return common.map_arrow(plain, run, schema)


def clean_only(df: DataFrame, chain: Chain, **options) -> DataFrame:
    """The rows that aren't toxic, with the columns of ``df``."""
    out = score(df, chain, **options).where("not is_toxic").drop(*(f"p_{c}" for c in chain.categories), "is_toxic")
    return out.toDF(*df.columns)

"""Language identification by Bayesian evidence fusion.

Four pieces of evidence are multiplied: the text's likelihood under each language (character trigrams inside words,
naive Bayes), the language that the markup declares, the language of the address suffix, and the host's prior. Host
priors are smoothed hierarchically, host towards domain towards all, from counts of the languages that the texts alone
suggest, which one grouped aggregation over the whole table computes; a document's own vote isn't counted in its prior. The likelihood counts as that of at most
``effective_words`` words, since words of a text are not independent.

The trigram model is fitted on ``train_rows`` labelled rows (a documented bound; the rows with the least hash of their
id); counts and priors cover all rows.

Cases: null, blank or letterless text is rejected with language null; missing, unknown or odd declarations, suffixes
and hosts are neutral; all columns are kept, whatever their names; repeated rows are judged alike; rows with null ids
are judged as all others; an empty table stays empty; without a labelled row no language is known and every row is
rejected with language null. A domain is the last two labels of the host, also where a registry sells third ones.

Scale: one narrow scan of the texts; evidence of some 100 bytes a row is written. Votes have one row per host; they are
broadcast only if few enough, else joined by shuffle, which moves no text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TRAIN_ROWS = 2000
HOSTS_TO_BROADCAST = 100_000
#: Characters looked at together; bounds memory with long texts.
STRETCH = 1 << 16
#: Trigrams over an alphabet up to which their rows are looked up in a dense table, else by binary search.
DENSE = 1 << 23
MARKUP = re.compile(r"<html[^>]*?\slang\s*=\s*[\"']?([a-zA-Z]{2,3})", re.I)
UNSEEN = re.compile(r"<(script|style)\b", re.I)
CLOSING = {k: re.compile(rf"</{k}\s*>", re.I) for k in ("script", "style")}
TAGS = re.compile(r"<[^>]*>|&\w+;")
SUFFIXES = {"fr": "fr", "de": "de", "at": "de", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl"}


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter (``[^\\W\\d_]``)."""
    return np.fromiter((c.isalnum() and not c.isdecimal() for c in map(chr, range(0x110000))), bool, 0x110000)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)


@dataclass
class TextModel:
    """log P(trigram | language), a row per known trigram and one for all others.

    Letters are numbered by ``alphabet`` from 1, unknown ones alike; whatever stands between words is 0. A trigram is
    the number of its three characters to the base of the letters' count; the middle one is a letter.
    """

    languages: list[str]
    alphabet: np.ndarray
    trigrams: np.ndarray
    logp: np.ndarray
    number: np.ndarray | None = None
    place: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"number": None, "place": None}

    @property
    def base(self) -> int:
        return len(self.alphabet) + 2

    def codes(self, text: str) -> Iterator[tuple[int, np.ndarray]]:
        """Words that begin, and trigrams, in each stretch of the text."""
        if self.number is None:
            self.number = np.where(letters(), self.base - 1, 0).astype(np.int32)
            self.number[self.alphabet] = np.arange(1, self.base - 1)
        ids = np.concatenate(([0], self.number[points(text)], [0]))
        for at in range(0, len(ids) - 2, STRETCH):
            x = ids[at : at + STRETCH + 2].astype(np.int64)
            before, own = x[:-2], x[1:-1]
            inside = own > 0
            yield int((inside & (before == 0)).sum()), ((before * self.base + own) * self.base + x[2:])[inside]

    def rows(self, codes: np.ndarray) -> np.ndarray:
        """Where trigrams stand in ``logp``."""
        unseen = len(self.trigrams)
        if self.base**3 <= DENSE:
            if self.place is None:
                self.place = np.full(self.base**3, unseen, np.int32)
                self.place[self.trigrams] = np.arange(unseen)
            return self.place[codes]
        at = np.minimum(np.searchsorted(self.trigrams, codes), max(0, unseen - 1))
        return np.where(self.trigrams[at] == codes, at, unseen) if unseen else np.zeros(len(codes), np.int64)

    def text(self, text: str | None, effective_words: int) -> tuple[int, np.ndarray]:
        """Words, and the log likelihood of each language, tempered to that of ``effective_words`` words."""
        n, total = 0, np.zeros(max(1, len(self.languages)))
        for found, codes in self.codes(text or ""):
            n += found
            total += np.bincount(self.rows(codes), minlength=len(self.logp)) @ self.logp if len(codes) > len(self.logp) else self.logp[self.rows(codes)].sum(0)
        return n, total * min(1.0, effective_words / n) if n else total


def fit(rows: list[tuple[str, str]], smoothing: float = 0.5) -> TextModel:
    """From (language, text) pairs."""
    languages = sorted({r[0] for r in rows})
    used = np.unique(np.concatenate([np.zeros(0, np.uint32), *(np.unique(points(t)) for _, t in rows)]))
    model = TextModel(languages, used[letters()[used]], np.zeros(0, np.int64), np.zeros((1, max(1, len(languages)))))
    counted: list[Counter] = [Counter() for _ in languages]
    for lang, text in rows:
        for _, codes in model.codes(text):
            at, n = np.unique(codes, return_counts=True)
            counted[languages.index(lang)].update(dict(zip(at.tolist(), n.tolist(), strict=True)))
    model.trigrams = np.array(sorted(set().union(*counted)), np.int64)
    table = np.full((len(model.trigrams) + 1, max(1, len(languages))), smoothing)
    for k, c in enumerate(counted):
        if c:
            table[np.searchsorted(model.trigrams, np.array(list(c), np.int64)), k] += np.array(list(c.values()), float)
    model.logp = np.log(table / table.sum(0))
    return model


def fit_sample(df: DataFrame, *, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> TextModel:
    """Fit on the ``train_rows`` labelled ids of least hash; ids are chosen first, so only those texts move. Of several rows of an id the least counts."""
    src = common.pick(df, id=id_col, text=text_col, label=label_col).where("id is not null and label is not null")
    chosen = common.table(src.select("id", F.xxhash64("id").alias("h")).distinct().orderBy("h", "id").limit(train_rows).select(F.col("id").alias("i")), "op6-chosen")
    held = src.where("text is not null").join(F.broadcast(chosen), F.col("id") == F.col("i"))
    return fit(sorted((r.label, r.text) for r in held.groupBy("i").agg(F.min(F.struct("label", "text")).alias("least")).select("least.*").collect()))


def visible(html: str) -> str:
    """Text between the tags, without scripts and styles; linear in the length, however odd the markup."""
    parts, at, closed = [], 0, set(CLOSING)
    for m in UNSEEN.finditer(html):
        kind = m[1].lower()
        if m.start() < at or kind not in closed:
            continue
        end = CLOSING[kind].search(html, m.end())
        if end is None:
            closed.discard(kind)
            continue
        parts.append(html[at : m.start()])
        at = end.end()
    text = " ".join([*parts, html[at:]])
    last = text.rfind(">") + 1
    return TAGS.sub(" ", text[:last]) + text[last:]


def host_of(url: str | None) -> tuple[str | None, str | None, str | None]:
    """Host, domain (last two labels) and the suffix's language of an address."""
    try:
        host = urlsplit(url or "").hostname
    except ValueError:
        host = None
    if not host:
        return None, None, None
    parts = host.split(".")
    return host, ".".join(parts[-2:]), SUFFIXES.get(parts[-1])


@dataclass(frozen=True)
class Columns:
    """Where the evidence is. With ``url`` the text is HTML; otherwise host and declared language are columns."""

    text: str = "text"
    declared: str | None = "lang"
    host: str | None = "source"
    url: str | None = None


def _evidence(cols: Columns, text: str | None, declared: str | None, host: str | None, url: str | None) -> tuple[str | None, str | None, str | None, str | None, str | None]:
    """Text, declared language, host, domain and suffix language of a row."""
    if cols.url is None:
        return text, declared, host, None, None
    h, domain, suffix = host_of(url)
    found = MARKUP.search(text or "")
    return visible(text or ""), found and found[1].lower(), h, domain, suffix


def _without(counts: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Counts, a row each, less the row's own vote."""
    out = counts.astype(float)
    out[np.arange(len(own)), own] -= 1
    return out


def fuse(ll: np.ndarray, best: np.ndarray, host: np.ndarray, domain: np.ndarray, whole: np.ndarray, known: np.ndarray, said: list[tuple[np.ndarray, float]], strength: float) -> np.ndarray:
    """Posteriors, a row each. ``host, domain, whole``: votes, the row's own among them; ``known``: whether it has a host;
    ``said``: a language number (-1: none) of each row, and how often such a statement is right."""
    n = ll.shape[1]
    smooth = lambda counts, parent: (counts + strength * parent) / (counts.sum(1, keepdims=True) + strength)
    top = _without(np.repeat(whole[None], len(ll), 0), best)
    top = (top + 1) / (top.sum(1, keepdims=True) + n)
    prior = np.where(known[:, None], smooth(_without(host, best), smooth(_without(domain, best), top)), top)
    score = ll + np.log(prior)
    for which, right in said:
        at = np.flatnonzero(which >= 0)
        score[at] += math.log((1 - right) / max(1, n - 1))
        score[at, which[at]] += math.log(right) - math.log((1 - right) / max(1, n - 1))
    p = np.exp(score - score.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def judged(
    rows: DataFrame, model: TextModel, cols: Columns = Columns(), *, effective_words: int = 20, declared_right: float = 0.9, suffix_right: float = 0.8,
    host_strength: float = 20.0, min_posterior: float = 0.6,
) -> DataFrame:
    """``rows`` without its columns ``__text, __declared, __host, __url``, and with ``lang_found, posterior, accepted``.

    Texts are looked at in one narrow scan; only their evidence, some 100 bytes a row, is written and joined with the votes of hosts.
    """
    n_lang, code = len(model.languages), {x: i for i, x in enumerate(model.languages)}
    inputs = ["__text", "__declared", "__host", "__url"]
    others = [c for c in rows.columns if c not in inputs]
    kinds = dict(rows.dtypes)
    kept = ", ".join(f"{c} {kinds[c]}" for c in others)
    if not n_lang:
        return rows.select(*others, F.lit(None).cast("string").alias("lang_found"), F.lit(0.0).alias("posterior"), F.lit(False).alias("accepted"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            b_cols = [b.column(i).to_pylist() for i in range(4)]
            cells: list[list] = [[] for _ in range(6)]
            for values in zip(*b_cols, strict=True):
                text, declared, host, domain, suffix = _evidence(cols, *values)
                n, ll = model.text(text, effective_words)
                for c, v in zip(cells, (host, domain, code.get(declared, -1), code.get(suffix, -1), int(ll.argmax()) if n else None, ll.tolist() if n else None), strict=True):
                    c.append(v)
            kinds_ = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4, b.num_columns)), *(pa.array(c, k) for c, k in zip(cells, kinds_, strict=True))], names=[*others, "__host", "__domain", "__said", "__suffix", "__best", "__ll"])

    schema = f"{kept}, __host string, __domain string, __said int, __suffix int, __best int, __ll array<double>".removeprefix(", ")
    seen = common.table(common.map_arrow(rows.select(*inputs, *others), look, schema), "op6-evidence")
    votes = lambda c: F.array(*(F.count(F.when(F.col(c) == k, 1)) for k in range(n_lang)))
    total = lambda c: F.array(*(F.sum(F.col(c)[k]) for k in range(n_lang)))
    per_host = common.table(seen.where("__best is not null").groupBy("__domain", "__host").agg(votes("__best").alias("h")), "op6-hosts")
    got = per_host.agg(total("h").alias("w")).first().w
    whole = np.array([v or 0 for v in got], float)
    domains = per_host.groupBy("__domain").agg(total("h").alias("d")).withColumnRenamed("__domain", "of")
    hosts = per_host.where("__host is not null").join(domains, F.col("__domain").eqNullSafe(F.col("of"))).select(F.col("__host").alias("key"), "h", "d")
    hosts = common.table(hosts, "op6-votes")
    joined = seen.join(common.broadcast_if(hosts, HOSTS_TO_BROADCAST), F.col("__host") == F.col("key"), "left").select("__said", "__suffix", "__best", "__ll", "h", "d", *others)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.flatnonzero(b.column(2).is_valid().to_numpy(zero_copy_only=False))
            langs, posts, oks = np.full(b.num_rows, None, object), np.zeros(b.num_rows), np.zeros(b.num_rows, bool)
            if len(at):
                c = b.take(pa.array(at))
                known = c.column(4).is_valid().to_numpy(zero_copy_only=False)
                best = c.column(2).to_numpy()
                grid = lambda i: np.array([x or [1] * n_lang for x in c.column(i).to_pylist()], float)  # noqa: B023, E731
                said = [(c.column(i).to_numpy(), right) for i, right in ((0, declared_right), (1, suffix_right))]
                p = fuse(grid(3), best, grid(4), grid(5), whole, known, said, host_strength)
                k = p.argmax(1)
                top = p[np.arange(len(p)), k]
                langs[at], posts[at], oks[at] = np.array(model.languages, object)[k], top.round(6), top >= min_posterior
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(6, b.num_columns)), pa.array(langs, pa.string()), pa.array(posts), pa.array(oks)], names=[*others, "lang_found", "posterior", "accepted"])

    return common.map_arrow(joined, decide, f"{kept}, lang_found string, posterior double, accepted boolean".removeprefix(", "))


def _inputs(rows: DataFrame, names: list[str], cols: Columns, *others: str) -> DataFrame:
    """Of columns ``c0..``, named ``names`` before: what the evidence is taken from, and the others."""
    of = lambda c: (F.col(f"c{names.index(c)}") if c else F.lit(None)).cast("string")
    return rows.select(of(cols.text).alias("__text"), of(cols.declared).alias("__declared"), of(cols.host).alias("__host"), of(cols.url).alias("__url"), *others)


def identify(df: DataFrame, model: TextModel, cols: Columns = Columns(), **options) -> DataFrame:
    """All columns of ``df`` but the text, by position as ``c0..``, then ``lang_found, posterior, accepted``."""
    names = list(df.columns)
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    return judged(_inputs(plain, names, cols, *(f"c{i}" for i in range(len(names)) if i != names.index(cols.text))), model, cols, **options)


def accepted_only(df: DataFrame, model: TextModel, cols: Columns = Columns(), *, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows whose language is found, with the columns of ``df``; equal rows are judged alike."""
    rows = common.keyed(df, id_col)
    verdicts = judged(_inputs(rows, list(df.columns), cols, "key_id", "key_hash"), model, cols, **options)
    return common.without(rows, verdicts.where("not accepted").select("key_id", "key_hash")).toDF(*df.columns)

"""LM scoring by cross-entropy difference.

A target and a background bigram model of the same order, smoothing and vocabulary are counted from the corpus: the
target from documents that a label table marks, the background from all documents. Each document's score is the mean
over its tokens of the target model's loss minus the background model's (nats; lower is nearer the target).

The shared vocabulary holds the lower-cased words that occur ``min_count`` times or more in all documents, however many
these are; other words are one unknown token. Words are known by their XXH64, pairs by (previous, own) word numbers, so
every pair's counts are its own. Probabilities are interpolated: P(w|v) = (c(v,w) + mu P(w)) / (c(v) + mu).

A document is first scored with the counts of the ``OFTEN`` most frequent pairs and, for its other pairs, with the counts
that it has itself, which is right for a pair that no other document holds. Pairs that others hold too are corrected where
the counts of all pairs that occur twice or more are. Pairs are dealt out by their hash and moved as packed columns.

With ``size`` the vocabulary is the ``size`` most frequent words (ties by word). With ``bits`` pairs share ``2**bits``
hashed buckets, an approximation for small memory.

Cases: null and blank texts have no tokens and null losses; without target documents the target is uniform; labels
without a document are ignored; repeated rows count and are scored each; an empty table stays empty.

Scale: three narrow scans. Tasks add up counts before the shuffle; the join's doc side holds no frequent pair, so no key
is hot. The driver and the workers hold 24 bytes per word of the vocabulary, which grows with the input, and per frequent pair.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import batched, chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

VOCABULARY = 50_000
BUCKET_BITS = 20
MU = 20.0
LABELS_TO_BROADCAST = 1_000_000
BEGIN, UNKNOWN = 0, 1
_FLUSH = 400_000
#: Occurrences from which a word belongs to the vocabulary.
MIN_COUNT = 5
#: Most frequent pairs that are sent to the workers; all others are joined.
OFTEN = 1_000_000
#: Words whose numbers a worker remembers.
MEMO = 150_000
#: Pairs that a task adds up together.
_TOGETHER = 1_000_000
#: Rows of an Arrow batch of numbers.
_PAGE = 100_000
SCHEMA = "doc_id long, n_tokens long, target_loss double, background_loss double, difference double"


def vocabulary(df: DataFrame, size: int = VOCABULARY, text_col: str = "text") -> list[str]:
    """The ``size`` most frequent words of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def page() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for b in common.slices(batches):
            for t in b.column(0).to_pylist():
                if t:
                    counts.update(t.lower().split())
            if len(counts) > _FLUSH:
                yield page()
                counts.clear()
        yield page()

    counted = common.map_arrow(common.pick(df, text=text_col), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = common.table(counted, "op9-words")
    # the count at which the vocabulary ends, from how many words have each count: a top-k would send the driver k words of every task
    above = F.sum("words").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1))
    ends = found.groupBy("n").agg(F.count(F.lit(1)).alias("words")).withColumn("above", F.coalesce(above, F.lit(0)))
    end = ends.where(F.col("above") < size).orderBy("n").first()
    if end is None:
        return []
    sure = sorted(found.where(F.col("n") > end.n).collect(), key=lambda r: (-r.n, r.word.encode()))
    ties = found.where(F.col("n") == end.n).orderBy("word").limit(size - end.above).collect()
    return [r.word for r in (*sure, *ties)]


def token_ids(text: str | None, index: dict[str, int]) -> np.ndarray:
    get = index.get
    return np.array([get(w, UNKNOWN) for w in text.lower().split()], np.int64) if text else np.zeros(0, np.int64)


def buckets(ids: np.ndarray, size: int, bits: int) -> np.ndarray:
    """Hashed bucket of each (previous, own) pair; the first token follows ``BEGIN``."""
    previous = np.concatenate(([BEGIN], ids[:-1])).astype(np.uint64)
    with np.errstate(over="ignore"):
        return (((previous * np.uint64(size) + ids.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def counts(df: DataFrame, target: DataFrame, words: list[str], *, bits: int = BUCKET_BITS, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Target and background counts: hashed bigrams, then unigrams. ``target``: ids of target documents, as ``id``."""
    size = len(words) + 2
    width = (1 << bits) + size
    index = {w: i + 2 for i, w in enumerate(words)}
    spark = df.sparkSession
    vocab = spark.sparkContext.broadcast(index)
    ids = target.where("id is not null").select("id").distinct()
    src = common.pick(df, doc_id=id_col, text=text_col)
    marked = src.join(common.broadcast_if(ids, LABELS_TO_BROADCAST).withColumn("hit", F.lit(True)), F.col("doc_id") == F.col("id"), "left").select("text", F.coalesce("hit", F.lit(False)).alias("hit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table = vocab.value, np.zeros((2, width), np.int64)
        for b in common.slices(batches):
            sets = ([], [])
            for text, hit in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = token_ids(text, own)
                if len(t):
                    found = np.concatenate((buckets(t, size, bits), t + (1 << bits), [(1 << bits) + BEGIN]))
                    sets[1].append(found)
                    if hit:
                        sets[0].append(found)
            for k in (0, 1):
                if sets[k]:
                    at, n = np.unique(np.concatenate(sets[k]), return_counts=True)
                    table[k, at] += n
        at = np.flatnonzero(table[1])
        for i in range(0, len(at), 100_000):
            x = at[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)), pa.array(table[0, x]), pa.array(table[1, x])], names=["at", "t", "b"])

    summed = common.map_arrow(marked, run, "at int, t long, b long").groupBy("at").agg(F.sum("t").alias("t"), F.sum("b").alias("b"))
    got = common.table(summed, "op9-counts").toArrow()
    out = np.zeros((2, width), np.float64)
    at = got.column("at").to_numpy()
    out[0, at], out[1, at] = got.column("t").to_numpy(), got.column("b").to_numpy()
    return out[0], out[1]


class Model:
    """An interpolated bigram model over hashed buckets."""

    def __init__(self, table: np.ndarray, size: int, bits: int, mu: float = MU):
        self.pairs, single = table[: 1 << bits].astype(np.float32), table[1 << bits :]
        as_word = single.copy()
        as_word[BEGIN] = 0
        self.single = ((as_word + 0.5) / (as_word.sum() + 0.5 * size)).astype(np.float64)
        self.before, self.mu, self.size, self.bits = single + mu, mu, size, bits

    def losses(self, ids: np.ndarray) -> np.ndarray:
        """Negative log probability of each token."""
        previous = np.concatenate(([BEGIN], ids[:-1]))
        return -np.log((self.pairs[buckets(ids, self.size, self.bits)] + self.mu * self.single[ids]) / self.before[previous])


def hashed_score(df: DataFrame, target: DataFrame, *, size: int = VOCABULARY, bits: int = BUCKET_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, target_loss, background_loss, difference`` of every row, pairs in hashed buckets."""
    words = vocabulary(df, size, text_col)
    near, all_docs = counts(df, target, words, bits=bits, id_col=id_col, text_col=text_col)
    n = len(words) + 2
    shared = df.sparkSession.sparkContext.broadcast(({w: i + 2 for i, w in enumerate(words)}, Model(near, n, bits), Model(all_docs, n, bits)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, a, b_model = shared.value
        for b in common.slices(batches):
            rows = []
            for t in b.column(1).to_pylist():
                ids = token_ids(t, index)
                if len(ids):
                    x, y = float(a.losses(ids).mean()), float(b_model.losses(ids).mean())
                    rows.append((len(ids), round(x, 6), round(y, 6), round(x - y, 6)))
                else:
                    rows.append((0, None, None, None))
            cells = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(cells, (pa.int64(), pa.float64(), pa.float64(), pa.float64()), strict=True))], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return common.map_arrow(common.pick(df, doc_id=id_col, text=text_col), run, SCHEMA)


def word_hash(word: str) -> int:
    """XXH64 of a word, as a signed long."""
    h = xxhash.xxh64_intdigest(word)
    return h - ((h >> 63) << 64)


def _marked(df: DataFrame, target: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text, hit`` of each row: whether it is a target document."""
    ids = target.where("id is not null").select("id").distinct()
    src = common.pick(df, doc_id=id_col, text=text_col)
    return src.join(common.broadcast_if(ids, LABELS_TO_BROADCAST).withColumn("hit", F.lit(True)), F.col("doc_id") == F.col("id"), "left").select("doc_id", "text", F.coalesce("hit", F.lit(False)).alias("hit"))


def word_counts(marked: DataFrame) -> DataFrame:
    """``h, t, b``: target and background count of each word by its hash; the row of null counts texts with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def page() -> pa.RecordBatch:
            begun = [c.pop(None, 0) for c in counts]
            n = len(counts[1])
            h = np.fromiter(map(xxhash.xxh64_intdigest, counts[1]), np.uint64, n).view(np.int64)
            t, b = np.fromiter(map(counts[0].get, counts[1], repeat(0)), np.int64, n), np.fromiter(counts[1].values(), np.int64, n)
            return pa.RecordBatch.from_arrays([pa.array([*h.tolist(), None], pa.int64()), pa.array(np.append(t, begun[0])), pa.array(np.append(b, begun[1]))], names=["h", "t", "b"])

        for b in common.slices(batches):
            for t, hit in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = t.lower().split() if t else []
                for c in counts[1 - hit :]:
                    c.update(words)
                    c[None] += bool(words)
            if len(counts[1]) > _FLUSH:
                yield page()
                for c in counts:
                    c.clear()
        yield page()

    return common.table(common.map_arrow(marked, run, "h long, t long, b long").groupBy("h").agg(F.sum("t").alias("t"), F.sum("b").alias("b")), "op9-words")


class Words:
    """The vocabulary: words' numbers (``hashes`` sorted), and of both models mu times their probability and log of their count as a previous word plus mu."""

    def __init__(self, hashes: np.ndarray, single: np.ndarray, mu: float = MU):
        self.hashes, self.size, self.tokens = hashes, len(hashes) + 2, int(single[1, BEGIN + 1 :].sum())
        as_word = single.astype(np.float64)
        as_word[:, BEGIN] = 0
        self.own = mu * (as_word + 0.5) / (as_word.sum(1, keepdims=True) + 0.5 * self.size)
        self.before = np.log(single + mu)
        self.memo: dict[str, int] = {}

    def numbers(self, words: list[str]) -> np.ndarray:
        """Only words of the vocabulary are remembered: others are rare, and hashed whenever they come."""
        out = np.fromiter(map(self.memo.get, words, repeat(-1)), np.int64, len(words))
        miss = np.flatnonzero(out < 0)
        if len(miss):
            wanted = [words[i] for i in miss.tolist()]
            new = list(set(wanted))
            h = np.fromiter(map(xxhash.xxh64_intdigest, new), np.uint64, len(new)).view(np.int64)
            at = np.searchsorted(self.hashes, h)
            known = at < len(self.hashes)
            known[known] = self.hashes[at[known]] == h[known]
            found = dict(zip(new, np.where(known, at + 2, UNKNOWN).tolist(), strict=True))
            out[miss] = np.fromiter(map(found.__getitem__, wanted), np.int64, len(wanted))
            if len(self.memo) < MEMO:
                self.memo.update((w, k) for w, k in found.items() if k != UNKNOWN)
        return out

    def pairs(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Number of tokens of each text, and the pairs of all tokens, text after text."""
        split = [t.lower().split() if t else [] for t in texts]
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        own = self.numbers(list(chain.from_iterable(split)))
        previous = np.concatenate(([BEGIN], own[:-1]))[: len(own)]
        previous[(np.cumsum(lengths) - lengths)[lengths > 0]] = BEGIN
        return lengths, previous * self.size + own


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array, and how often each occurs."""
    at = np.flatnonzero(np.concatenate((np.ones(min(len(sorted_keys), 1), bool), sorted_keys[1:] != sorted_keys[:-1])))
    return sorted_keys[at], np.diff(np.append(at, len(sorted_keys)))


def _words(found: DataFrame, chosen: list[str] | None, min_count: int) -> Words:
    spark = found.sparkSession
    if chosen is None:
        kept = found.where((F.col("b") >= min_count) & F.col("h").isNotNull())
    else:
        kept = found.join(spark.createDataFrame([(word_hash(w),) for w in chosen], "h long"), "h")
    got = kept.select("h", "t", "b").toArrow()
    h, t, b = (got.column(c).to_numpy() for c in ("h", "t", "b"))
    order = np.argsort(h)
    begun, every = found.where("h is null"), found.where("h is not null")
    begun, every = (tuple(x or 0 for x in d.agg(F.sum("t"), F.sum("b")).first()) for d in (begun, every))
    single = np.stack([np.concatenate(([begun[k], every[k] - c.sum()], c[order])) for k, c in enumerate((t, b))])
    return Words(h[order], single)


def _parts(df: DataFrame, tokens: int) -> int:
    """Partitions for pairs, of which there are at most ``tokens``: what a task holds doesn't grow with the input."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-tokens // _TOGETHER))


_WIDTHS = (np.uint8, np.uint16, np.uint32, np.uint64)


def column_bytes(v: np.ndarray) -> bytes:
    """An int64 column as its least value (of a rising one: its first, then steps) and offsets of as many bytes as the largest needs."""
    if not len(v):
        return b""
    steps = np.diff(v)
    rising = len(steps) > 0 and steps.min() >= 0
    base = int(v[0] if rising else v.min())
    rest = steps if rising else v - base
    most = int(rest.view(np.uint64).max()) if len(rest) else 0  # differences wrap around, as do the sums that undo them
    width = next(k for k, w in enumerate(_WIDTHS) if most <= np.iinfo(w).max)
    return bytes((width | (4 if rising else 0),)) + base.to_bytes(8, "little", signed=True) + rest.astype(_WIDTHS[width]).tobytes()


def packed(part: np.ndarray, cells: list[np.ndarray], order: np.ndarray | None = None) -> Iterator[tuple[int, bytes]]:
    """Each part's share of columns, as one binary: rows, then the columns. Moved so, pairs cost no row each.

    ``order`` is that of the rows inside a part. Columns are put in order a part at a time, so no second copy of them is held.
    """
    part = part if order is None else part[order]
    by = np.argsort(part.astype(np.uint16) if len(part) and part.max() < 1 << 16 else part, kind="stable")
    part, order = part[by], by if order is None else order[by]
    del by
    at = np.flatnonzero(np.concatenate((np.ones(min(len(part), 1), bool), part[1:] != part[:-1])))
    for i, j in zip(at.tolist(), np.append(at, len(part))[1:].tolist(), strict=True):
        yield int(part[i]), pack([c[order[i:j]].astype(np.int64, copy=False) for c in cells])


def pack(cells: list[np.ndarray]) -> bytes:
    return len(cells[0]).to_bytes(8, "little") + b"".join(map(column_bytes, cells))


def unpacked(blob: bytes, n: int) -> list[np.ndarray]:
    """The ``n`` columns of a binary."""
    rows, at, out = int.from_bytes(blob[:8], "little"), 8, []
    for _ in range(n if rows else 0):
        kind, base = blob[at], int.from_bytes(blob[at + 1 : at + 9], "little", signed=True)
        rising, width = kind >= 4, _WIDTHS[kind & 3]
        rest = np.frombuffer(blob, width, rows - rising, at + 9).astype(np.int64)
        at += 9 + rest.size * np.dtype(width).itemsize
        out.append(np.cumsum(np.concatenate(([base], rest))) if rising else rest + base)
    return out or [np.zeros(0, np.int64)] * n


def _part_of(key: np.ndarray, parts: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts


def _blobs(found: Iterable[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    for some in batched(found, 64):
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in some], pa.int32()), pa.array([x for _, x in some], pa.binary())], names=["part", "blob"])


def _joined(held: Iterable[list[np.ndarray]]) -> Iterator[np.ndarray]:
    """Each column's pieces as one array; the pieces are let go before the next column is put together."""
    for pieces in held:
        column = np.concatenate(pieces) if pieces else np.zeros(0, np.int64)
        pieces.clear()
        yield column


def _added(columns: Iterable[np.ndarray]) -> list[np.ndarray]:
    """Distinct keys (the first column) and the sums of their counts; columns are taken one at a time."""
    columns = iter(columns)
    key = next(columns)
    order = np.argsort(key)
    key = key[order]
    at = np.flatnonzero(np.concatenate((np.ones(min(len(key), 1), bool), key[1:] != key[:-1])))
    out = [key[at]]
    del key
    for c in columns:
        out.append(np.add.reduceat(c[order], at) if len(at) else c)
    return out


def pair_counts(marked: DataFrame, shared, parts: int) -> DataFrame:
    """``part, blob``: packed key, target and background count of each pair that occurs twice or more; ``shared``: broadcast ``Words``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, n_held = shared.value, [], 0

        def page() -> Iterator[pa.RecordBatch]:
            (every,) = _joined([held])
            every.sort()
            key, n = runs(every)
            del every
            hit, key = key & 1, key >> 1
            both = np.flatnonzero(key[1:] == key[:-1])  # of a pair in either kind of text, the target's count comes second
            t = n * hit
            t[both], n[both] = n[both + 1], n[both] + n[both + 1]
            first = np.ones(len(key), bool)
            first[both + 1] = False
            key = key[first]
            t, n = t[first], n[first]
            del hit, both, first
            yield from _blobs(packed(_part_of(key, parts), [key, t, n]))

        for b in common.slices(batches):
            lengths, key = words.pairs(b.column(1).to_pylist())
            held.append(key << 1 | np.repeat(np.array(b.column(2).to_pylist(), np.int64), lengths))
            n_held += len(key)
            if n_held > _TOGETHER:
                yield from page()
                n_held = 0
        if n_held:
            yield from page()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, n_held = 0, ([], [], []), 0
        for b in batches:
            for part, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):  # noqa: B007  one part a partition
                cells = unpacked(blob, 3)
                n_held += len(cells[0])
                for pieces, c in zip(held, cells, strict=True):
                    pieces.append(c)
                if n_held > 2 * _TOGETHER:
                    held, n_held = tuple([c] for c in _added(_joined(held))), 0
        if held[0]:
            key, t, b = _added(_joined(held))
            yield from _blobs([(part, pack([c[b > 1] for c in (key, t, b)]))])

    dealt = common.map_arrow(marked, run, "part int, blob binary").repartitionById(parts, F.col("part"))
    return common.table(common.map_arrow(dealt, add, "part int, blob binary"), "op9-pairs")


def _frequent(found: DataFrame, often: int) -> tuple[int, list[np.ndarray]]:
    """The count above which at most ``often`` pairs lie, and those pairs, sorted, with their counts."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(1).to_pylist():
                n, pairs = np.unique(unpacked(blob, 3)[2], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(pairs)], names=["b", "pairs"])

    above = F.sum("pairs").over(Window.orderBy(F.desc("b")))
    # a row for each count that occurs
    ends = common.map_arrow(found, tell, "b long, pairs long").groupBy("b").agg(F.sum("pairs").alias("pairs"))
    least = ends.withColumn("above", above).where(F.col("above") <= often).agg(F.min("b")).first()[0]
    least = 1 << 62 if least is None else least

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(1).to_pylist():
                cells = unpacked(blob, 3)
                yield pa.RecordBatch.from_arrays([pa.array(c[cells[2] >= least]) for c in cells], names=["key", "t", "b"])

    got = common.map_arrow(found, take, "key long, t long, b long").toArrow()
    order = np.argsort(got.column("key").to_numpy())
    return least, [got.column(c).to_numpy()[order] for c in ("key", "t", "b")]


#: Rows of documents by columns; pairs, and what they change, in blobs. ``kind``: 0 a document, 1 its pairs, 2 counts of pairs.
_MIXED = "part int, kind int, blob binary, row long, doc_id long, n_tokens long, x double, y double"


def _mixed(kind: int, part: list[int] | np.ndarray, blobs: list[bytes] | None = None, cells: list[pa.Array] | None = None) -> pa.RecordBatch:
    n = len(part)
    cells = cells or [pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
    blob = pa.nulls(n, pa.binary()) if blobs is None else pa.array(blobs, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([kind] * n, pa.int32()), blob, *cells], names=[c.split()[0] for c in _MIXED.split(", ")])


def score(
    df: DataFrame, target: DataFrame, *, size: int | None = None, bits: int | None = None, min_count: int = MIN_COUNT, often: int = OFTEN, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_tokens, target_loss, background_loss, difference`` of every row."""
    if bits is not None:
        return hashed_score(df, target, size=size or VOCABULARY, bits=bits, id_col=id_col, text_col=text_col)
    spark = df.sparkSession
    marked = _marked(df, target, id_col, text_col)
    shared = spark.sparkContext.broadcast(_words(word_counts(marked), None if size is None else vocabulary(df, size, text_col), min_count))
    parts = _parts(df, shared.value.tokens)
    found = pair_counts(marked, shared, parts)
    least, often_pairs = _frequent(found, often)
    most = spark.sparkContext.broadcast(often_pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (keys, near, back) = shared.value, most.value
        row = TaskContext.get().partitionId() << 33
        pairs = np.int64(words.size) ** 2
        held, n_held = ([], [], []), 0

        def page() -> Iterator[pa.RecordBatch]:
            cells = list(_joined(held))
            for some in batched(packed(_part_of(cells[0], parts), cells, np.argsort(cells[0])), 64):
                yield _mixed(1, [p for p, _ in some], [x for _, x in some])

        for b in common.slices(batches):
            lengths, key = words.pairs(b.column(1).to_pylist())
            key, n = runs(np.sort(np.repeat(np.arange(len(lengths)), lengths) * pairs + key))
            doc, key = key // pairs, key % pairs
            own = n * np.array(b.column(2).to_pylist(), bool)[doc]
            at = np.searchsorted(keys, key)
            hot = at < len(keys)
            hot[hot] = keys[at[hot]] == key[hot]
            v, w = key // words.size, key % words.size
            sums = []
            for k, (counts, mine) in enumerate(((near, own), (back, n))):
                c = mine.astype(np.float64)
                c[hot] = counts[at[hot]]
                sums.append(pa.array(np.bincount(doc, n * (words.before[k, v] - np.log(c + words.own[k, w])), len(lengths))))
            rows = row + np.arange(len(lengths))
            yield _mixed(0, (rows % parts).astype(np.int32), cells=[pa.array(rows), b.column(0).cast(pa.int64()), pa.array(lengths), *sums])
            rest = ~hot
            if rest.any():
                # a target document's counts are negative
                for pieces, c in zip(held, (key[rest], rows[doc[rest]], np.where(own > 0, -n, n)[rest]), strict=True):
                    pieces.append(c)
                n_held += len(held[0][-1])
            if n_held > _TOGETHER:
                yield from page()
                n_held = 0
            row += len(lengths)
        if n_held:
            yield from page()

    def rarer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                cells = unpacked(blob, 3)
                yield _mixed(2, [part], [pack([c[cells[2] < least] for c in cells])])

    def correct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents as they are; of pairs what other documents' counts change, for the part of the document's rows."""
        words, blobs, counted = shared.value, [], ([], [], [])
        for b in batches:
            kind = b.column(1).to_numpy()
            if (kind == 0).any():
                mine = b.filter(pa.array(kind == 0))
                yield _mixed(0, ((mine.column(3).to_numpy() >> 33) % parts).astype(np.int32), cells=mine.columns[3:])
            for k, blob in zip(kind.tolist(), b.column(2).to_pylist(), strict=True):
                if k == 1:
                    blobs.append(blob)
                elif k:
                    for pieces, c in zip(counted, unpacked(blob, 3), strict=True):
                        pieces.append(c)
        known, t, back = _joined(counted)
        order = np.argsort(known)
        known, t, back = known[order], t[order], back[order]
        del order
        if not len(known):
            return
        # pairs stay packed until it is known which of them other documents hold
        hits = ([], [], [], [])
        while blobs:
            key, row, c = unpacked(blobs.pop(), 3)
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            hit = np.flatnonzero(known[at] == key)
            for pieces, x in zip(hits, (at[hit], row[hit], c[hit], key[hit] % words.size), strict=True):
                pieces.append(x)
        at, row, c, w = _joined(hits)
        n = np.abs(c)
        row, place = np.unique(row, return_inverse=True)
        sums = []
        for k, (mine, every) in enumerate(((np.where(c < 0, n, 0), t[at]), (n, back[at]))):
            own = words.own[k, w]
            sums.append(np.bincount(place, n * (np.log(mine + own) - np.log(every + own)), len(row)).view(np.int64))
        for some in batched(packed((row >> 33) % parts, [row, *sums]), 64):
            yield _mixed(1, [p for p, _ in some], [x for _, x in some])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, held = [], [[np.zeros(0, np.int64)] * 3]
        for b in batches:
            kind = b.column(1).to_numpy()
            docs.append(b.filter(pa.array(kind == 0)).select(range(3, 8)))
            held += [unpacked(x, 3) for x in b.column(2).to_pylist() if x is not None]
        if not sum(d.num_rows for d in docs):
            return
        docs = pa.Table.from_batches(docs).combine_chunks()
        rows = docs.column(0).to_numpy()
        order = np.argsort(rows)
        row, *more = (np.concatenate(x) for x in zip(*held, strict=True))
        place = order[np.searchsorted(rows[order], row)]
        n = docs.column(2).to_numpy()
        with np.errstate(invalid="ignore", divide="ignore"):
            x, y = ((docs.column(3 + k).to_numpy() + np.bincount(place, m.view(np.float64), len(rows))) / n for k, m in enumerate(more))
        cells = [pa.array(v.round(6), mask=n == 0) for v in (x, y, x - y)]
        yield from pa.table([docs.column(1), docs.column(2), *cells], names=[c.split()[0] for c in SCHEMA.split(", ")]).to_batches(_PAGE)

    rows = common.map_arrow(marked, run, _MIXED).unionByName(common.map_arrow(found, rarer, _MIXED)).repartitionById(parts, F.col("part"))
    cells = common.map_arrow(rows, correct, _MIXED).repartitionById(parts, F.col("part"))
    return common.map_arrow(cells, finish, SCHEMA)

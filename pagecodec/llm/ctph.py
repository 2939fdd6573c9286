"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last seven bytes ends a chunk wherever it hits the block size; each chunk's hash gives one of
64 characters. A fingerprint is ``block:signature:signature at twice the block``. Two fingerprints are compared where
their block sizes meet (equal, or one twice the other): signatures without a common run of seven characters score 0,
others one minus their insertion/deletion distance over their length.

Cases: null text is empty; empty texts have the fingerprint ``3::``; equal fingerprints are alike by 1; a text is
hashed whole; ties in the id are ordered by the text's hash; null ids come last; a table of one row has itself as its
next document; other columns are ignored.

Scale: a document needs only its next one, so the table is cut at quantiles of the id into many ranges and shuffled
once, texts compressed; the first row of each range is also sent to the range before. Each task streams its rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, LEAST_BLOCK, LENGTH = 7, 3, 64
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def rolling(data: bytes) -> np.ndarray:
    """The rolling hash after each byte: sum, weighted sum and shifted xor of the last seven bytes, added up."""
    c = np.zeros(len(data) + WINDOW - 1, np.uint32)
    c[WINDOW - 1 :] = np.frombuffer(data, np.uint8)
    n = len(data)
    plain, weighted, shifted = (np.zeros(n, np.uint32) for _ in range(3))
    for k in range(WINDOW):  # k bytes back
        x = c[WINDOW - 1 - k : WINDOW - 1 - k + n]
        plain += x
        weighted += x * np.uint32(WINDOW - k)
        shifted ^= x << np.uint32(5 * k) if 5 * k < 32 else np.uint32(0)
    return plain + weighted + shifted


def _signature(data: bytes, ends: np.ndarray) -> str:
    """One character per chunk; all that follows the last kept boundary is one chunk."""
    at, out, h = 0, [], xxhash.xxh32_intdigest
    for e in ends[: LENGTH - 1].tolist():
        out.append(ALPHABET[h(data[at : e + 1]) & 63])
        at = e + 1
    if at < len(data):
        out.append(ALPHABET[h(data[at:]) & 63])
    return "".join(out)


def fingerprint(text: str | None) -> str:
    data = (text or "").encode()
    if not data:
        return f"{LEAST_BLOCK}::"
    r = rolling(data)
    block = LEAST_BLOCK
    while block * LENGTH < len(data):
        block *= 2
    while True:
        ends = np.flatnonzero(r % np.uint32(block) == block - 1)
        if len(ends) >= LENGTH // 2 or block == LEAST_BLOCK:
            break
        block //= 2
    twice = ends[r[ends] % np.uint32(2 * block) == 2 * block - 1]
    return f"{block}:{_signature(data, ends)}:{_signature(data, twice)}"


def _score(a: str, b: str) -> float:
    if a == b and a:
        return 1.0
    if len(a) < WINDOW or len(b) < WINDOW or {a[i : i + WINDOW] for i in range(len(a) - WINDOW + 1)}.isdisjoint(b[i : i + WINDOW] for i in range(len(b) - WINDOW + 1)):
        return 0.0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for ch in b:  # longest common subsequence, a bit per character of a
        u = v & where.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return 2 * (len(a) - v.bit_count()) / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints, 0 to 1."""
    if a == b:
        return 1.0
    (x, a1, a2), (y, b1, b2) = a.split(":"), b.split(":")
    m, n = int(x), int(y)
    if m == n:
        return max(_score(a1, b1), _score(a2, b2))
    return _score(a1, b2) if m == 2 * n else _score(a2, b1) if n == 2 * m else 0.0


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n/2) code points replaced by the first as many of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_SENT = "range long, border boolean, doc_id long, tie long, packed binary"


def _send(cuts: list[int], first: int | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows to their ranges, numbered from the largest id down; the first row of a range to the one before as well.

    ``cuts`` ascend and are ids of the table: range k holds the ids in (cuts[-k-2], cuts[-k-1]].
    """
    pack, last = zstandard.ZstdCompressor(level=3).compress, len(cuts)
    for b in common.slices(batches):
        rows = []
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            data = (text or "").encode()
            at = bisect_left(cuts, doc_id) if doc_id is not None else 0
            row = (last - at, False, doc_id, xxhash.xxh64_intdigest(data) >> 1, pack(data))
            rows.append(row)
            if doc_id is not None and at < last and cuts[at] == doc_id:
                rows.append((last - at - 1, True, *row[2:]))
            if doc_id is not None and doc_id == first and last:
                rows.append((last, True, *row[2:]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["range", "border", "doc_id", "tie", "packed"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Each row of the sorted ranges with its next document: id, text, fingerprint, next text, next fingerprint."""
    unpack = zstandard.ZstdDecompressor().decompress
    current = head = held = None
    closed = False
    for b in common.slices(batches):
        for k, border, doc_id, packed in zip(*(b.column(c).to_pylist() for c in ("range", "border", "doc_id", "packed")), strict=True):
            if k != current:
                if held and not closed:
                    yield *held, head[1], head[2]
                current, head, held, closed = k, None, None, False
            if closed:
                continue
            if border and held is None:
                continue
            text = unpack(packed).decode() if packed else ""
            row = (doc_id, text, fingerprint(text))
            if held:
                yield *held, row[1], row[2]
            head, held, closed = head or row, row, border
    if held and not closed:
        yield *held, head[1], head[2]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def page(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    rows: list[tuple] = []
    for doc_id, text, own, following, next_own in _pairs(batches):
        new = edited(text, following)
        other = fingerprint(new)
        rows.append((doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), own, other, likeness(own, other), likeness(own, next_own)))
        if len(rows) == 1000:
            yield page(rows)
            rows = []
    if rows:
        yield page(rows)


#: UTF-8 bytes of text that a range is meant to hold; the most ranges that bytes ask for, beyond which ranges grow; the
#: ranks that the search for cuts keeps at most.
RANGE_BYTES, MOST_RANGES, MOST_RANKS = 32 << 20, 65_536, 1_000_000


def edited_neighbours(df: DataFrame, *, ranges_per_task: int = 4, range_bytes: int = RANGE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each document and of its text edited with the next one's, and their likeness.

    There are at least ``ranges_per_task`` ranges for each of the session's shuffle partitions, and more where the
    texts would fill them with over ``range_bytes`` on average (up to ``MOST_RANGES``); a task gets about
    ``ranges_per_task`` of them, so up to 2 TB of texts what it reads doesn't grow with the table.
    """
    src = common.pick(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    total = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-total // (range_bytes * ranges_per_task)), MOST_RANGES // ranges_per_task))
    n = parts * ranges_per_task
    # the cuts are ids of the table, one per range
    found = src.where("doc_id is not null").agg(F.max("doc_id").alias("top"), F.percentile_approx("doc_id", [k / n for k in range(1, n)], min(50 * n, MOST_RANKS)).alias("cuts")).first()
    cuts = [c for c in sorted(set(found.cuts or [])) if c != found.top]
    top = found.top

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _send(cuts, top, batches)

    sent = common.map_arrow(src, send, _SENT).repartition(parts, "range")
    ordered = sent.sortWithinPartitions("range", "border", F.col("doc_id").desc_nulls_last(), "tie")
    return common.map_arrow(ordered, _compare, SCHEMA)

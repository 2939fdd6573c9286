"""Quality rules with cross-document line frequency.

Lines (split at \\n) are normalised (ASCII and Unicode case folded, runs of blanks made one space, digits made 0) and
hashed to 64 bits. For each host the number of documents that hold a line is counted; lines held by more than
``max_docs`` documents of the host are removed, however many documents it has, and a document that keeps less than
``min_kept`` of its words, or fewer than ``min_words``, is rejected. Base rules on repetition come first.

Cases: null text has no words and fails the base rules; a null host is a host of its own; each row is a document
(repeated rows count apiece); lines without a word are ignored; an empty table gives an empty table.

Scale: texts are scanned in place and never shuffled. One row per distinct line of a document (host, hash, words)
is shuffled twice: once for counts, combined before the exchange, so that a line in a third of all documents is one
row per task; once to join the counts to their documents, a plain equi-join whose hot partitions AQE splits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SYMBOLS = re.compile(r"[#*$%&|<>]")
DIGITS = re.compile(r"[0-9]")
#: Odd constants that mix the five word numbers of a window into 64 bits.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
#: Frequent lines that may be broadcast to the lines' side of the join; beyond it both sides shuffle.
FREQUENT_TO_BROADCAST = 100_000


def normalise_line(line: str) -> str:
    """The form under which lines count as the same; empty for a line without a word."""
    return DIGITS.sub("0", b" ".join(line.lower().encode().split()).decode())


def repeated_words(tokens: list[bytes], width: int = 5) -> int:
    """Words inside windows of ``width`` words that occur twice or more in the text, the first included."""
    n = len(tokens)
    if n <= width:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in tokens), np.uint64, n)
    windows = n - width + 1
    h = np.zeros(windows, np.uint64)
    for k in range(width):
        h = (h ^ (ids[k : k + windows] + np.uint64(1))) * _MIX[k % len(_MIX)]
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    repeated = np.zeros(windows, bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(repeated)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge[:n]) > 0).sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    text = text or ""
    tokens = text.encode().split()
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.encode().split():
            seen.add(line)
    chars = len(b"".join(tokens).decode())
    return len(tokens), chars, len(SYMBOLS.findall(text)), dup, repeated_words(tokens)


def line_words(text: str | None) -> dict[int, int]:
    """Hash of each normalised line to the number of words that the text has in such lines."""
    out: dict[int, int] = {}
    for line in (text or "").split("\n"):
        if norm := normalise_line(line):
            h = xxhash.xxh3_64_intdigest(norm.encode())
            h -= (h >> 63) << 64
            out[h] = out.get(h, 0) + norm.count(" ") + 1
    return out


_COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def base_rules(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``doc_id, host``, the counts and ``lines`` (array of hash and words) of each row; one narrow scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            texts = b.column(2).to_pylist()
            counts = np.array([base_counts(t) for t in texts], np.int64).reshape(-1, 5)
            lines = [[{"h": h, "w": w} for h, w in line_words(t).items()] for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *(pa.array(counts[:, k]) for k in range(5)), pa.array(lines, pa.list_(pa.struct([("h", pa.int64()), ("w", pa.int32())])))],
                names=["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"],
            )

    src = common.pick(df, doc_id=id_col, host=host_col, text=text_col)
    kinds = dict(src.dtypes)
    return common.map_arrow(src, run, f"doc_id {kinds['doc_id']}, host {kinds['host']}, {_COUNTS}, lines array<struct<h:bigint,w:int>>")


def quality_lines(
    df: DataFrame, *, max_docs: int = 20, min_kept: float = 0.3, min_words: int = 10, max_repeat: int = 20,
    id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
) -> DataFrame:
    """Counts, ``base_failed``, ``removed_words`` (in lines above the limit) and ``kept`` of each row."""
    base = common.table(base_rules(df, id_col=id_col, text_col=text_col, host_col=host_col).withColumn("row", F.monotonically_increasing_id()), "op4-lines")
    lines = base.select("row", "host", F.explode("lines").alias("line")).select("row", F.xxhash64("host", "line.h").alias("key"), F.col("line.w").alias("w"))
    frequent = common.table(lines.groupBy("key").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") > max_docs).select("key"), "op4-frequent")
    removed = lines.join(common.broadcast_if(frequent, FREQUENT_TO_BROADCAST), "key", "left_semi").groupBy("row").agg(F.sum("w").cast("long").alias("gone"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    return (
        base.drop("lines").join(removed, "row", "left")
        .withColumn("removed_words", F.coalesce("gone", F.lit(0)).cast("long"))
        .select("doc_id", *(c.split()[0] for c in _COUNTS.split(", ")), "removed_words", failed.alias("base_failed"), (~failed & (left >= min_words) & (left >= F.col("n_words") * min_kept)).alias("kept"))
    )

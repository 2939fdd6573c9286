"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has 64 bits; a bit is 1 if it is set in more than half of the XXH64 hashes of the word shingles.
Fingerprints link at ``radius`` (2 or 3) or fewer differing bits.

Equal fingerprints are one node. Half the radius is 1: every node emits the 65 words at distance 0 or 1 and two
nodes that emit the same word differ in 2 bits at most. At most 65 nodes can share a word, so chaining them by a
window is bounded. This finds every link of 2 bits, and components under those.

For the odd third bit the 64 positions are cut into three blocks, and one block at a time is a wildcard: every
node emits the words at distance 0 or 1 on the other two blocks. A pair at distance 3 has one differing bit in some
block (then, with that block wild, both emit the same word and their blocks differ in one bit) or all three in one
block (then both agree on the other two). Only words emitted by nodes of different components can add anything; the
rest are dropped by a combinable min/max aggregation. For the remaining ones (word, block) is matched with
(word, block with one bit flipped) by an equi-join, and all-in-one-block pairs by balls of radius 1 and 2 inside the
block, checked by their bit count. No step makes pairs of all members of a group, and none caps anything.
Joins merge, so that no table passes through the driver but a list of at most ``WORDS_TO_BROADCAST`` words, and each kind
of link of each block is written on its own, so that the plans which the driver keeps stay short.

Emitting the balls of radius 1 and 2 of whole words instead would be 2146 rows, some 34 kB, per document.

The pipeline's stage, which has to link at a similarity of 0.8 of five-word shingles, is in ``similar``: it takes these
components as candidates and finds by minimum hashes those beyond, as a pair at 0.8 differs in 4 to 14 of 64 bits.

Cases: null or blank text has fingerprint 0 and links like any other; fewer words than a shingle make one shingle;
null ids keep their row (a component's id is its least non-null id); repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import components

#: Bits of each byte value, to turn byte histograms into bit counts.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BYTE_AT = (np.arange(8) * 256)[None, :]
_POWERS = np.uint64(1) << np.arange(64, dtype=np.uint64)
#: Lowest and one past the highest bit of each wildcard block.
BLOCKS = ((0, 22), (22, 43), (43, 64))
#: Shingles counted together; bounds memory with long texts.
STRETCH = 1 << 14
#: Surviving words that may be broadcast; beyond it the join shuffles both sides.
WORDS_TO_BROADCAST = 200_000


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    tokens = text.encode().lower().split() if text else []
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= width:
        return bits_of([xxhash.xxh64_intdigest(joined, seed)])
    at = list(accumulate((len(t) + 1 for t in tokens), initial=0))
    digest = xxhash.xxh64_intdigest
    return bits_of(digest(joined[a : b - 1], seed) for a, b in zip(at, at[width:], strict=False))


def bits_of(hashes: Iterable[int]) -> int:
    """The bits set in more than half of the hashes, which are counted ``STRETCH`` at a time."""
    n, histogram, source = 0, np.zeros((8, 256), np.int64), iter(hashes)
    while len(h := np.fromiter(islice(source, STRETCH), np.uint64)):
        n += len(h)
        histogram += np.bincount((h.view(np.uint8).reshape(len(h), 8) + _BYTE_AT).ravel(), minlength=2048).reshape(8, 256)
    return int(_POWERS[(histogram @ _BITS).ravel() * 2 > n].sum(dtype=np.uint64))


def signed(x: int) -> int:
    return x - ((x >> 63) << 64)


def fingerprints(df: DataFrame, *, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (a signed long) of each row; one narrow scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([signed(fingerprint(t, width, seed)) for t in b.column(1).to_pylist()], pa.int64())], names=["doc_id", "fp"])

    src = common.pick(df, doc_id=id_col, text=text_col)
    return common.map_arrow(src, run, f"doc_id {dict(src.dtypes)['doc_id']}, fp long")


def _flips(bits: list[int]) -> Column:
    """Literal masks: none, and each of these bits."""
    return F.array(F.lit(0).cast("long"), *(F.lit(signed(1 << b)) for b in bits))


def _xor(a: str | Column, b: str | Column) -> Column:
    return (F.col(a) if isinstance(a, str) else a).bitwiseXOR(F.col(b) if isinstance(b, str) else b)


def _spread(nodes: DataFrame) -> DataFrame:
    """Nodes over all shuffle partitions: their table is small and lies in few files, what they emit isn't."""
    return nodes.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")


def _near_links(nodes: DataFrame) -> DataFrame:
    """Links that connect all nodes at 2 bits or fewer: nodes that share a word are chained."""
    words = _spread(nodes).select("fp", F.explode(_flips(list(range(64)))).alias("flip")).select("fp", _xor("fp", "flip").alias("word"))
    previous = F.lag("fp").over(Window.partitionBy("word").orderBy("fp"))
    return words.select("fp", previous.alias("v")).where("v is not null").select(F.col("fp").alias("u"), "v")


def _wild_words(nodes: DataFrame, block: int) -> DataFrame:
    lo, hi = BLOCKS[block]
    wild = sum(1 << b for b in range(lo, hi))
    kept = [b for b in range(64) if not lo <= b < hi]
    return nodes.select("fp", "comp", F.explode(_flips(kept)).alias("flip")).select(
        F.lit(block).cast("byte").alias("block"), _xor(F.col("fp").bitwiseAND(F.lit(signed(~wild & (2**64 - 1)))), "flip").alias("word"),
        F.col("fp").bitwiseAND(F.lit(signed(wild))).alias("rest"), (F.col("flip") == 0).alias("centre"), "fp", "comp",
    )


def _odd_links(nodes: DataFrame) -> DataFrame:
    """Links between components that connect all nodes at exactly 3 bits; ``nodes``: fp, comp."""
    nodes = _spread(nodes)
    emitted = _wild_words(nodes, 0).unionByName(_wild_words(nodes, 1)).unionByName(_wild_words(nodes, 2))
    shared = emitted.groupBy("block", "word").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("block", "word")
    shared = common.table(shared, "op10-shared")
    few = common.small_enough(shared, WORDS_TO_BROADCAST)
    members = common.table(emitted.join(F.broadcast(shared) if few else shared.hint("merge"), ["block", "word"], "left_semi"), "op10-members")
    # members with equal rest are within 2 bits, hence of one component
    inside = common.table(members.groupBy("block", "word", "rest").agg(F.min("comp").alias("comp")), "op10-inside")
    links = None
    for block, (lo, hi) in enumerate(BLOCKS):
        flips = F.array(*(F.lit(signed(1 << b)) for b in range(lo, hi)))
        own = inside.where(F.col("block") == block)
        moved = own.select("word", F.col("comp").alias("u"), F.explode(flips).alias("flip"), "rest").select("word", _xor("rest", "flip").alias("rest"), "u")
        found = moved.join(own.select("word", "rest", F.col("comp").alias("v")).hint("merge"), ["word", "rest"]).where("u > v").select("u", "v").distinct()
        centres = members.where((F.col("block") == block) & F.col("centre"))
        several = centres.groupBy("word").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("word")
        centres = common.table(centres.join(several.hint("merge"), "word", "left_semi").select("word", "rest", "fp", "comp"), "op10-centres")
        pairs = [(1 << i) | (1 << j) for i in range(lo, hi) for j in range(lo, i)]
        far = F.array(F.lit(0).cast("long"), *(F.lit(signed(m)) for m in [*(1 << b for b in range(lo, hi)), *pairs]))
        ball = lambda flips, fp, comp: centres.select("word", "rest", F.explode(flips).alias("flip"), F.col("fp").alias(fp), F.col("comp").alias(comp)).select("word", _xor("rest", "flip").alias("rest"), fp, comp)  # noqa: B023, E731
        one, two = ball(_flips(list(range(lo, hi))), "f", "u"), ball(far, "g", "v")
        across = one.join(two.hint("merge"), ["word", "rest"]).where((F.col("u") != F.col("v")) & (F.bit_count(_xor("f", "g")) <= 3)).select("u", "v").distinct()
        found, across = common.table(found, "op10-found"), common.table(across, "op10-across")
        links = found.unionByName(across) if links is None else links.unionByName(found).unionByName(across)
    return links.distinct()


def fingerprint_components(nodes: DataFrame, radius: int = 3) -> DataFrame:
    """``fp, comp`` of each distinct fingerprint of ``nodes`` (fp): components under ``radius`` differing bits."""
    if radius not in (2, 3):
        raise ValueError("radius must be 2 or 3")
    nodes = common.table(nodes.select("fp").distinct(), "op10-nodes")
    near = components(_near_links(nodes)).withColumnRenamed("u", "fp").withColumnRenamed("v", "root")
    placed = nodes.join(near.hint("merge"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("comp"))
    if radius == 3:
        placed = common.table(placed, "op10-placed")
        odd = components(_odd_links(placed)).withColumnRenamed("u", "comp").withColumnRenamed("v", "top")
        placed = placed.join(odd.hint("merge"), "comp", "left").select("fp", F.coalesce("top", "comp").alias("comp"))
    return common.table(placed, "op10-comps")


def near_duplicates(df: DataFrame, *, radius: int = 3, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` of each row."""
    docs = common.table(fingerprints(df, width=width, seed=seed, id_col=id_col, text_col=text_col), "op10-docs")
    placed = fingerprint_components(docs, radius)
    lows = docs.groupBy("fp").agg(F.min("doc_id").alias("low")).join(placed.hint("merge"), "fp").groupBy("comp").agg(F.min("low").alias("component_id"))
    named = common.table(placed.join(lows.hint("merge"), "comp").select("fp", "component_id"), "op10-named")
    return docs.join(named.hint("merge"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def least_rows(df: DataFrame, keyed: DataFrame, placed: DataFrame) -> DataFrame:
    """The least row of each component; ``placed``: key_id, key_hash, comp of each row of ``keyed``."""
    order = F.struct(F.col("key_id").isNull().alias("none"), F.col("key_id").alias("i"), F.col("key_hash").alias("h"))
    best = placed.groupBy("comp").agg(F.min(order).alias("best"))
    keys = placed.groupBy("comp", "key_id", "key_hash").agg(F.count(F.lit(1)).alias("n")).join(best, "comp")
    stays = F.col("key_id").eqNullSafe(F.col("best.i")) & (F.col("key_hash") == F.col("best.h"))
    judged = common.table(keys.select("key_id", "key_hash", "n", stays.alias("stays")), "op10-judged")
    return common.emit(keyed, judged.select("key_id", "key_hash", "n", F.col("stays").cast("long").alias("copies"))).toDF(*df.columns)


def one_of_each(df: DataFrame, *, radius: int = 3, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with the columns of ``df``: that of least (id, row hash), null ids last.

    Rows are known by id and a hash of all columns; only ids, hashes and fingerprints are shuffled. Rows to drop are
    removed by an anti-join, broadcast only if few enough; rows equal in every column are reduced to one.
    """
    keyed = common.keyed(df, id_col)
    text = keyed.columns[list(df.columns).index(text_col)]
    kinds = dict(keyed.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([signed(fingerprint(t, width, seed)) for t in b.column(2).to_pylist()], pa.int64())], names=["key_id", "key_hash", "fp"])

    docs = common.table(common.map_arrow(keyed.select("key_id", "key_hash", text), run, f"key_id {kinds['key_id']}, key_hash long, fp long"), "op10-keys")
    placed = docs.join(fingerprint_components(docs, radius), "fp")
    return least_rows(df, keyed, placed)

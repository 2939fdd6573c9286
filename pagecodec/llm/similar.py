"""Groups of texts whose word shingles have a Jaccard similarity of ``similarity`` (0.8) or more, five words a shingle.

Texts with equal sets of shingles are one node. Each node has a SimHash fingerprint of its shingles, and operator 10's ball
hashing puts fingerprints within 3 bits, and chains of them, into one component: a bucket of candidates. A pair at 0.8
differs in 4 to 14 of 64 bits, which no ball hashing bears, so for the rest there are buckets by bands of minimum hashes: 20
bands of four, one of which a pair at 0.8 shares but for 3 in 100,000. Every link, from either kind of bucket, is verified
by the exact similarity of the two sets.

In each bucket the most central node, the one that meets most others over all its buckets, is the pivot. First
every node is compared with its pivots: one comparison a node and bucket. Then, for each pivot, the nodes that it has not
joined (outsiders) are compared with all its other nodes, those of one component left out. That is done inside cells: the
nodes of a pivot are hashed into blocks of bounded size, a cell holds two blocks, and its overlaps are counted by one matrix
product, so no pair becomes a row and no task holds more than two blocks. Groups whose nodes all join their pivot cost
nothing more; a group of n nodes with m outsiders costs n * m multiplications and moves n * m / block rows.

Cases: null and blank texts have no shingles and are one group; fewer words than a shingle make one shingle; null ids keep
their row; repeated rows are reduced to one; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components
from .simhash import bits_of, fingerprint_components, least_rows, signed

#: Bands, and minimum hashes of each; odd multipliers that give the hashes.
BANDS, ROWS = 20, 4
_MULTIPLIERS = (np.random.default_rng(17).integers(1, 1 << 63, BANDS * ROWS, np.uint64) | np.uint64(1))[:, None]
#: Shingles hashed together; bounds memory with long texts.
STRETCH = 1 << 11
#: Nodes, and shingles, of a block on average.
BLOCK, BLOCK_SHINGLES = 512, 400_000
#: Cells of a matrix of nodes by shingles that are multiplied together.
DENSE = 1 << 22


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; blank texts have none, texts of fewer words one."""
    tokens = text.encode().lower().split() if text else []
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    at = list(accumulate((len(t) + 1 for t in tokens), initial=0))
    ends = at[width:] or [len(joined) + 1]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a : b - 1], 42) for a, b in zip(at, ends, strict=False)), np.uint64, len(ends)))


def set_hash(of: np.ndarray) -> int:
    """A signed long that equal sets of shingles share."""
    return signed(xxhash.xxh3_64_intdigest(of.tobytes()))


def bands(of: np.ndarray) -> list[int]:
    """A hash of each band's minimum hashes, as signed longs; the band's number is part of it."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(of), STRETCH):
        h = of[i : i + STRETCH] * _MULTIPLIERS
        h ^= h >> np.uint64(32)
        h *= _MULTIPLIERS
        np.minimum(least, h.min(axis=1), out=least)
    return [signed(xxhash.xxh3_64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i)) for i in range(BANDS)]


def fingerprint(of: np.ndarray) -> int:
    """The SimHash fingerprint of a set of shingles, as a signed long."""
    return signed(bits_of(of)) if len(of) else 0


def with_balls(nodes: DataFrame, radius: int = 3) -> DataFrame:
    """``node, n, bands`` of nodes with their fingerprint ``sim``: the component of fingerprints is one more bucket."""
    placed = fingerprint_components(nodes.select(F.col("sim").alias("fp")), radius)
    joined = nodes.join(placed.select(F.col("fp").alias("sim"), "comp").hint("merge"), "sim")
    return joined.select("node", "n", F.concat("bands", F.array(F.xxhash64("comp", F.lit(BANDS)))).alias("bands"))


def alike(a: int, b: int, both: int, similarity: float) -> bool:
    return both >= similarity * (a + b - both)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (u, v) whose shingles (``sets``: node, shingles) are as similar; two equi-joins, a pair at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, 32):
            ok = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                ok.append(alike(len(p), len(q), len(np.intersect1d(p, q, assume_unique=True)), similarity))
            kept = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(kept), b.column(1).filter(kept)], names=["u", "v"])

    far = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("x")), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("y")), "v")
    return common.map_arrow(far.select("u", "v", "x", "y"), run, "u long, v long")


def overlaps(rows: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two rows share."""
    out = np.zeros((len(rows), len(rows)), np.float32)
    flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    _, token, n = np.unique(flat, return_inverse=True, return_counts=True)
    shared = n > 1
    place = np.cumsum(shared) - 1
    mine = shared[token]
    owner, token = owner[mine], place[token[mine]]
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    step = max(1, DENSE // len(rows))
    for lo in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(token, (lo, lo + step))
        m = np.zeros((len(rows), step), np.float32)
        m[owner[a:b], token[a:b] - lo] = 1
        out += m @ m.T
    return out


def cell_links(nodes: list[int], roots: list[int], rows: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links between nodes of different roots that connect all pairs as similar."""
    both, n = overlaps(rows), np.array([len(r) for r in rows], np.float32)
    _, root = np.unique(np.array(roots), return_inverse=True)
    # a hair of slack for rounding; whoever passes is checked with whole numbers
    found = np.argwhere(np.triu((both >= np.float32(similarity - 1e-4) * (n[:, None] + n - both)) & (root[:, None] != root), 1))
    top, links = list(range(int(root.max()) + 1)), []

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for i, j in found.tolist():
        a, b = find(int(root[i])), find(int(root[j]))
        if a != b and alike(len(rows[i]), len(rows[j]), int(both[i, j]), similarity):
            top[a] = b
            links.append((nodes[i], nodes[j]))
    return links


def _cells(members: DataFrame) -> DataFrame:
    """``pivot, a, b, node, root``: the blocks (a, b) that each node is compared in; ``members``: pivot, node, root, n, out."""
    per = members.groupBy("pivot").agg(
        *(F.sum(F.when(F.col("out") == o, c)).alias(name) for o, c, name in ((True, F.lit(1), "n_out"), (True, F.col("n"), "s_out"), (False, F.lit(1), "n_in"), (False, F.col("n"), "s_in"))),
        F.min("root").alias("low"), F.max("root").alias("high"),
    ).where("n_out > 0 and low <> high")
    blocks = lambda n, s: F.ceil(F.greatest(F.coalesce(F.col(n), F.lit(0)) / BLOCK, F.coalesce(F.col(s), F.lit(0)) / BLOCK_SHINGLES)).cast("int")
    of = members.join(per.select("pivot", blocks("n_out", "s_out").alias("outs"), blocks("n_in", "s_in").alias("ins")), "pivot")
    # outsiders' blocks come first; small groups are one cell
    own = F.when(F.col("outs") + F.col("ins") <= 2, 0).when(F.col("out"), F.pmod(F.xxhash64("node"), "outs")).otherwise(F.col("outs") + F.pmod(F.xxhash64("node"), F.greatest("ins", F.lit(1)))).cast("int")
    last = F.when(F.col("outs") + F.col("ins") <= 2, 0).when(F.col("out"), F.col("outs") + F.col("ins") - 1).otherwise(F.col("outs") - 1)
    cells = of.select("pivot", "node", "root", own.alias("own"), F.explode(F.sequence(F.lit(0), last)).alias("other"))
    return cells.select("pivot", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "node", "root")


def similar_components(nodes: DataFrame, sets, similarity: float) -> DataFrame:
    """``node, comp``: components of similar nodes; ``nodes``: node, n (shingles), bands; ``sets``: gives the shingles of some nodes."""
    words = nodes.select("node", "n", F.explode("bands").alias("band"))
    met = words.groupBy("band").agg(F.count(F.lit(1)).alias("met")).where("met > 1")
    words = common.table(words.join(met, "band"), "similar-words")
    central = words.groupBy("node").agg(F.sum("met").alias("met")).select("node", F.struct("met", "node").alias("rank"))
    placed = words.select("band", "node").join(central, "node")
    pivots = placed.groupBy("band").agg(F.max("rank").alias("top")).select("band", F.col("top.node").alias("pivot"))
    pairs = common.table(words.select("band", "node", "n").join(pivots, "band").where("node <> pivot").select("pivot", "node", "n").distinct(), "similar-pairs")
    held = sets(words.select("node").distinct())
    first = common.table(_verified(pairs.select(F.col("pivot").alias("u"), F.col("node").alias("v")), held, similarity), "similar-first")
    roots = components(first)
    own, of = roots.select(F.col("u").alias("node"), F.col("v").alias("own")), roots.select(F.col("u").alias("pivot"), F.col("v").alias("top"))
    rooted = pairs.join(own, "node", "left").join(of, "pivot", "left").select("pivot", "node", "n", F.coalesce("own", "node").alias("root"), F.coalesce("top", "pivot").alias("top"))
    cells = _cells(common.table(rooted.select("pivot", "node", "n", "root", (F.col("root") != F.col("top")).alias("out")), "similar-members"))

    def run(cell: pa.Table) -> pa.Table:
        rows = [np.frombuffer(x, np.uint64) for x in cell.column("shingles").to_pylist()]
        links = cell_links(cell.column("node").to_pylist(), cell.column("root").to_pylist(), rows, similarity) if rows else []
        return pa.table({"u": pa.array([u for u, _ in links], pa.int64()), "v": pa.array([v for _, v in links], pa.int64())})

    more = cells.join(held, "node").groupBy("pivot", "a", "b").applyInArrow(run, "u long, v long")
    found = components(common.table(first.unionByName(more), "similar-links")).select(F.col("u").alias("node"), F.col("v").alias("top"))
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("top", "node").alias("comp"))


def one_of_each(df: DataFrame, *, similarity: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of similar texts, with the columns of ``df``: that of least (id, row hash), null ids last."""
    keyed = common.keyed(df, id_col)
    text = keyed.columns[list(df.columns).index(text_col)]
    kinds = dict(keyed.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            found = [shingles(t, width) for t in b.column(2).to_pylist()]
            cells = [pa.array([set_hash(x) for x in found], pa.int64()), pa.array([len(x) for x in found], pa.int32()), pa.array([fingerprint(x) for x in found], pa.int64()), pa.array([bands(x) for x in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cells], names=["key_id", "key_hash", "fp", "n", "sim", "bands"])

    docs = common.table(common.map_arrow(keyed.select("key_id", "key_hash", text), run, f"key_id {kinds['key_id']}, key_hash long, fp long, n int, sim long, bands array<bigint>"), "similar-keys")
    # equal sets have equal bands and fingerprints
    nodes = docs.groupBy("fp").agg(*(F.first(c).alias(c) for c in ("n", "sim", "bands"))).withColumnRenamed("fp", "node")
    nodes = common.table(with_balls(common.table(nodes, "similar-sims")), "similar-nodes")

    def sets(wanted: DataFrame) -> DataFrame:
        """The shingles of wanted nodes, from one row of each."""
        rows = docs.select("fp", "key_hash").join(wanted, F.col("fp") == F.col("node")).groupBy("node").agg(F.min("key_hash").alias("h"))
        rows = common.table(rows, "similar-rows")

        def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in common.slices(batches):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t, width).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["node", "shingles"])

        texts = keyed.join(common.broadcast_if(rows, common.KEYS_TO_BROADCAST), F.col("key_hash") == F.col("h")).select("node", F.col(text).alias("text"))
        return common.table(common.map_arrow(texts, again, "node long, shingles binary").dropDuplicates(["node"]), "similar-sets")

    placed = docs.select("key_id", "key_hash", "fp").join(similar_components(nodes, sets, similarity), F.col("fp") == F.col("node"))
    return least_rows(df, keyed, placed)

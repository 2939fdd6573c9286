"""Compressing tables: one row per column and page, and why each page's codec was chosen."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shipping
from ..functions import PTYPES, physical, ptype_class, ptype_of
from ..operators import paging
from ..sources import pages
from ..wire import nodes, planner


def compress(df: DataFrame, columns: Sequence[str], *, key: str, order_by: Sequence[str], page_keys: int = 1024, options: planner.Options = planner.Options()) -> DataFrame:
    """Every column's sealed pages, with ``column`` first. The table is paged and shuffled once for all columns.

    Each page's task gets all its columns, so the exchange moves each value once.
    """
    kinds = {c: df.schema[c].dataType for c in columns}
    ptypes = {c: ptype_of(t) for c, t in kinds.items()}
    keys = [f"__o{i}" for i in range(len(order_by))]
    src = df.select(F.floor(F.col(key) / page_keys).cast("bigint").alias("page_id"), *[F.col(c).alias(k) for c, k in zip(order_by, keys, strict=True)], *[physical(F.col(c), t).alias(c) for c, t in kinds.items()])

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([(k, "ascending") for k in keys])
        rows = []
        for c in columns:
            values, valid = pages.to_arrays(group.column(c), ptypes[c])
            node = planner.compress(values, ptypes[c], valid, options)
            rows.append((c, group.column("page_id")[0].as_py(), ptypes[c], node.n, 0 if valid is None else int((~valid).sum()), nodes.NAMES[node.codec], node.tree, planner.raw_size(values, ptypes[c]), node.size, node.decoded_bytes, *pages.bounds(values, valid, ptypes[c]), node.to_bytes()))
        names = ["column", *(x.split()[0] for x in pages.SEALED.split(", "))]
        kinds_out = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds_out, strict=True)], names=names)

    shipping.ship(df.sparkSession)
    return src.groupBy("page_id").applyInArrow(run, f"column string, {pages.SEALED}")


def compression_report(sealed: DataFrame) -> DataFrame:
    """Bytes and pages per column and root codec."""
    return sealed.groupBy("column", "root_codec").agg(F.count(F.lit(1)).alias("pages"), F.sum("n_rows").alias("row_count"), F.sum("raw_bytes").alias("raw_bytes"), F.sum("encoded_bytes").alias("encoded_bytes"))


def explain_selection(p: DataFrame, options: planner.Options = planner.Options()) -> DataFrame:
    """``page_id, cand_idx, codec, kind, bytes, ratio, chosen``: the candidates of each page in the order considered."""
    kind = ptype_of(p.schema["v"].dataType)

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("pos")
        values, valid = pages.to_arrays(group.column("v"), kind)
        trace: list = []
        node = planner.compress(values, kind, valid, options, trace)
        root = nodes.NAMES[(node.children[0] if node.codec == nodes.NULLABLE else node).codec]
        page = group.column("page_id")[0].as_py()
        rows = [(page, -1, "raw", "fallback", planner.raw_size(values, kind), 1.0, root == "raw")] + [(page, i, c, how, int(b), float(r), c == root) for i, (c, how, b, r) in enumerate(trace)]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.bool_()], strict=True)], names=["page_id", "cand_idx", "codec", "kind", "bytes", "ratio", "chosen"])

    shipping.ship(p.sparkSession)
    return p.groupBy("page_id").applyInArrow(run, "page_id long, cand_idx int, codec string, kind string, bytes long, ratio double, chosen boolean")


def sample_rows(p: DataFrame) -> DataFrame:
    """The rows of each page's sample windows, which follow from the page's length alone.

    A page's windows are one row, so the join holds and sends a row a page, never one a sampled place. Windows lie in equal
    parts of the page (the first ones longer by a row), so a row's part says which one to ask. ``p`` keeps its exchange by page.
    """
    lengths = p.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [planner.sample_windows(n) for n in b.column(1).to_pylist()]
            sides = [pa.array([[w[i] for w in x] for x in found], pa.list_(pa.int64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), *sides], names=["page_id", "n", "s", "e"])

    shipping.ship(p.sparkSession)
    windows = lengths.mapInArrow(run, "page_id long, n long, s array<long>, e array<long>")
    windows = windows.withColumns({"short": F.expr("n div size(s)"), "extra": F.expr("n % size(s)")})
    part = F.expr("cast(if(pos < extra * (short + 1), pos div (short + 1), extra + (pos - extra * (short + 1)) div short) as int)")
    return p.join(windows, "page_id").where((F.col("pos") >= F.get("s", part)) & (F.col("pos") < F.get("e", part))).select("page_id", "pos", "v")


def ptype_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, n, w, ptype_class(n)) for c, (n, w) in PTYPES.items()], "code int, name string, width int, class string")

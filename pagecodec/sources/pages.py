"""Sealing pages into binary and loading them: Arrow functions around the kernels of ``pagecodec.wire``.

A page is one group, bounded by the pager; groups are shuffled by page once. Sealed pages are rows of a table, so
Parquet's statistics on ``page_id``, ``n_rows`` and ``null_count`` prune them without touching a blob.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import shipping
from ..functions import PTYPE_CODES, PTYPES, ptype_of
from ..wire import kernels, nodes, planner, visits

SEALED = "page_id long, ptype string, n_rows long, null_count long, root_codec string, tree string, raw_bytes long, encoded_bytes long, decoded_bytes long, min_v long, max_v long, blob binary"


def to_arrays(column: pa.ChunkedArray | pa.Array, ptype: str) -> tuple:
    """Values (null rows zero or empty) and validity of an Arrow column."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    valid = None if not flat.null_count else np.asarray(flat.is_valid())
    if ptype == "string":
        return [b"" if v is None else v if isinstance(v, bytes) else v.encode() for v in flat.to_pylist()], valid
    v = flat.fill_null(0) if flat.null_count else flat
    return v.to_numpy(zero_copy_only=False).astype(kernels.DTYPES[ptype]), valid


def to_arrow(values, valid: np.ndarray | None, kind: pa.DataType) -> pa.Array:
    mask = None if valid is None else ~valid
    if isinstance(values, list):
        cells = values if valid is None else [v if ok else None for v, ok in zip(values, valid, strict=True)]
        return pa.array(cells, pa.binary()).cast(kind) if pa.types.is_string(kind) else pa.array(cells, kind)
    return pa.array(values, mask=mask).cast(kind)


def bounds(values, valid: np.ndarray | None, ptype: str) -> tuple[int | None, int | None]:
    """Least and greatest value of an integer page without its nulls; None where no long can tell."""
    if ptype in ("string", "float32", "float64"):
        return None, None
    v = values if valid is None else values[valid]
    low, high = (int(v.min()), int(v.max())) if len(v) else (None, None)
    return (low, high) if high is None or high < 1 << 63 else (None, None)


def seal_page(page_id: int, column: pa.ChunkedArray | pa.Array, kind: str, options: planner.Options = planner.Options()) -> pa.Table:
    """One page, its rows in order, as a row of ``SEALED``."""
    values, valid = to_arrays(column, kind)
    node = planner.compress(values, kind, valid, options)
    low, high = bounds(values, valid, kind)
    return pa.table({
        "page_id": pa.array([page_id], pa.int64()), "ptype": [kind], "n_rows": pa.array([node.n]), "null_count": pa.array([0 if valid is None else int((~valid).sum())]), "root_codec": [nodes.NAMES[node.codec]], "tree": [node.tree],
        "raw_bytes": pa.array([planner.raw_size(values, kind)]), "encoded_bytes": pa.array([node.size]), "decoded_bytes": pa.array([node.decoded_bytes]), "min_v": pa.array([low], pa.int64()), "max_v": pa.array([high], pa.int64()), "blob": pa.array([node.to_bytes()], pa.binary()),
    })


def seal(p: DataFrame, ptype: str | None = None, options: planner.Options = planner.Options()) -> DataFrame:
    """Each page of ``page_id, pos, v`` as one row of ``SEALED``."""
    kind = ptype or ptype_of(p.schema["v"].dataType)

    def run(group: pa.Table) -> pa.Table:
        return seal_page(group.column("page_id")[0].as_py(), group.sort_by("pos").column("v"), kind, options)

    shipping.ship(p.sparkSession)
    return p.groupBy("page_id").applyInArrow(run, SEALED)


def in_order(p: DataFrame) -> DataFrame:
    """Pages dealt whole to tasks and sorted, as the data source writes them."""
    return p.repartition("page_id").sortWithinPartitions("page_id", "pos")


def load(sealed: DataFrame, ptype: str, spark_type: str, limits: nodes.Limits = nodes.Limits(), *, on_error: str = "fail") -> DataFrame:
    """``page_id, pos, v`` of sealed pages. Bad pages fail the job, or give no rows with ``on_error='skip'``."""
    schema = f"page_id long, pos long, v {spark_type}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for b in batches:
            for page, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    values, valid = nodes.load(blob, ptype, limits).decode(limits)
                except nodes.FormatError:
                    if on_error == "fail":
                        raise
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([page] * len(values), pa.int64()), pa.array(range(len(values)), pa.int64()), to_arrow(values, valid, to_arrow_type(target))], names=["page_id", "pos", "v"])

    target = sealed.sparkSession.createDataFrame([], schema).schema["v"].dataType
    shipping.ship(sealed.sparkSession)
    return sealed.select("page_id", "blob").mapInArrow(run, schema)


def _rows(sealed: DataFrame, found, column: str, kind: str) -> DataFrame:
    """``found(page, blob)`` gives rows ``pos`` and a cell each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for b in batches:
            for page, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                pos, cells = found(blob)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pos), page, np.int64)), pa.array(pos, pa.int64()), to_arrow(*cells, to_arrow_type(target))], names=["page_id", "pos", column])

    schema = f"page_id long, pos long, {column} {kind}"
    target = sealed.sparkSession.createDataFrame([], schema).schema[column].dataType
    shipping.ship(sealed.sparkSession)
    return sealed.select("page_id", "blob").mapInArrow(run, schema)


def _wanted(values: Sequence, ptype: str) -> list:
    return [v.encode() if isinstance(v, str) else v for v in values] if ptype == "string" else list(values)


def filter_in(sealed: DataFrame, ptype: str, values: Sequence, limits: nodes.Limits = nodes.Limits()) -> DataFrame:
    """``page_id, pos`` of the rows whose value is one of ``values``.

    Integer pages whose bounds exclude all of them are left out by a filter on ``min_v`` and ``max_v``, which reaches the
    Parquet scan; in the others the codec's dictionary, runs or exceptions are asked before any row is decoded.
    """
    wanted = _wanted(values, ptype)

    def test(v) -> np.ndarray:
        if isinstance(v, list):
            return np.array([x in wanted for x in v], bool)
        return np.isin(v, np.array(wanted, v.dtype))

    def found(blob: bytes) -> tuple:
        rows = visits.matching(nodes.load(blob, ptype, limits), test)
        return rows, (np.zeros(len(rows), np.int64), None)

    if wanted and "min_v" in sealed.columns and all(isinstance(v, int) for v in wanted):
        sealed = sealed.where(F.col("min_v").isNull() | ((F.col("min_v") <= max(wanted)) & (F.col("max_v") >= min(wanted))))
    return _rows(sealed, found, "hit", "bigint").select("page_id", "pos")


def filter_eq(sealed: DataFrame, ptype: str, value, limits: nodes.Limits = nodes.Limits()) -> DataFrame:
    return filter_in(sealed, ptype, [value], limits)


def exceptions(sealed: DataFrame, ptype: str, spark_type: str) -> DataFrame:
    """``page_id, pos, v`` of the exceptions of sparse pages; pages of other codecs give none."""

    def found(blob: bytes) -> tuple:
        x = nodes.load(blob, ptype)
        x = x.children[0] if x.codec == nodes.NULLABLE else x
        return (visits.places(x), (x.children[-1].values(), None)) if x.codec == nodes.SPARSE else ([], ([] if ptype == "string" else np.zeros(0, kernels.DTYPES[ptype]), None))

    return _rows(sealed, found, "v", spark_type)


def values_at(sealed: DataFrame, ptype: str, spark_type: str, pos: int) -> DataFrame:
    """``page_id, pos, v`` at one place of each page that has it, without decoding the page where the codec allows it."""

    def found(blob: bytes) -> tuple:
        x = nodes.load(blob, ptype)
        if pos >= x.n:
            return [], ([] if ptype == "string" else np.zeros(0, kernels.DTYPES[ptype]), None)
        v = visits.value_at(x, pos)
        one = [b"" if v is None else v] if ptype == "string" else np.array([0 if v is None else v], kernels.DTYPES[ptype])
        return [pos], (one, np.array([v is not None]))

    return _rows(sealed.where(F.col("n_rows") > pos) if "n_rows" in sealed.columns else sealed, found, "v", spark_type)


def check(sealed: DataFrame, ptype: str, limits: nodes.Limits = nodes.Limits()) -> DataFrame:
    """``page_id, error``: why a page is refused under the limits (null: it isn't)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            errors = []
            for blob in b.column(1).to_pylist():
                try:
                    nodes.load(blob, ptype, limits).decode(limits)
                    errors.append(None)
                except nodes.FormatError as e:
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(errors, pa.string())], names=["page_id", "error"])

    shipping.ship(sealed.sparkSession)
    return sealed.select("page_id", "blob").mapInArrow(run, "page_id long, error string")


def join_blobs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two trees in one blob per page: ``page_id, blob``."""
    return a.select("page_id", "blob").join(b.select("page_id", F.col("blob").alias("next")), "page_id").select("page_id", F.concat("blob", "next").alias("blob"))


def load_prefixes(blobs: DataFrame, ptypes: list[str]) -> DataFrame:
    """``page_id, part, rows, end_at`` of the trees that follow each other in a blob."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for page, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c = nodes.Cursor(blob)
                for i, t in enumerate(ptypes):
                    node = nodes.load_prefix(c, t)
                    rows.append((page, i, node.n, c.at))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 4, names=["page_id", "part", "row_count", "end_at"])

    shipping.ship(blobs.sparkSession)
    return blobs.select("page_id", "blob").mapInArrow(run, "page_id long, part long, row_count long, end_at long")


def _little(blob: str | Column, at: int, size: int) -> Column:
    """A little-endian integer of a blob, read by Catalyst: its bytes' hex digits turned round, pair by pair."""
    h = F.hex(F.substring(blob, at + 1, size))
    turned = F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(size))])
    return F.conv(turned, 16, 10).cast("long")


def headers(sealed: DataFrame) -> DataFrame:
    """``page_id, version, codec, ptype, n_rows, inline_bytes`` from the first 24 bytes alone, without decoding."""
    names = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
    codec, kind = _little("blob", 1, 1), _little("blob", 2, 1)
    return sealed.select(
        "page_id", _little("blob", 0, 1).alias("version"), F.element_at(names(nodes.NAMES), codec.cast("int")).alias("codec"),
        F.element_at(names({c: n for c, (n, _) in PTYPES.items()}), kind.cast("int")).alias("ptype"), _little("blob", 8, 8).alias("n_rows"), _little("blob", 16, 8).alias("inline_bytes"),
    )


__all__ = ["PTYPE_CODES", "SEALED", "check", "exceptions", "filter_eq", "filter_in", "headers", "join_blobs", "load", "load_prefixes", "seal", "values_at"]

"""A Python data source over stored pages: ``spark.read.format("pagecodec")`` and ``df.write.format("pagecodec")``.

Options: ``path`` (a folder of sealed pages in Parquet), ``ptype`` and ``spark_type`` of the column. Filters on
``page_id`` (=, >, >=, <, <=, IN) are pushed to the scan, so refused pages are neither read nor decoded. Those on ``v`` of
integer columns refuse pages by their least and greatest value; Spark tests the rows of the others. Each Parquet file
is one partition. ``max_length, max_bytes, max_decoded, max_depth, max_work`` set the limits of reading.

Writing takes ``page_id, pos, v`` as ``pages.in_order`` gives them: each page whole in one task, rows in order from 0.
Anything else is refused, for a page over two tasks would be two pages. A task seals a page as soon as the next
one begins, so it holds one page. Files get their names when the whole write is committed; those of failed attempts
begin with an underscore, which readers leave out.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..functions import ptype_of
from ..wire import nodes
from .pages import seal_page, to_arrow


class File(InputPartition):
    """One Parquet file."""


class PageReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path, self.ptype, self.schema = options["path"], options["ptype"], schema
        self.filters: list[tuple[str, object]] = []
        self.bounds: list[tuple[str, object]] = []
        self.limits = nodes.Limits(**{f.name: int(options[f.name]) for f in fields(nodes.Limits) if f.name in options})

    def pushFilters(self, filters):  # noqa: N802
        names = {EqualTo: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in"}
        for f in filters:
            if type(f) in names and f.attribute == ("page_id",):
                self.filters.append((names[type(f)], list(f.value) if isinstance(f, In) else f.value))
            else:
                value = getattr(f, "value", None)
                if type(f) in names and f.attribute == ("v",) and all(isinstance(x, int) for x in (value if isinstance(f, In) else (value,))):
                    self.bounds.append((names[type(f)], list(value) if isinstance(f, In) else value))
                yield f

    def partitions(self):
        return [File(f) for f in sorted(ds.dataset(self.path).files)]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        page = pc.field("page_id")
        ops = {"==": page.__eq__, ">": page.__gt__, ">=": page.__ge__, "<": page.__lt__, "<=": page.__le__, "in": page.isin}
        wanted = None
        for op, v in self.filters:
            wanted = ops[op](v) if wanted is None else wanted & ops[op](v)
        data = ds.dataset(partition.value, format="parquet")
        low, high = pc.field("min_v"), pc.field("max_v")
        for op, v in self.bounds if "min_v" in data.schema.names else ():
            most, least = (max(v), min(v)) if op == "in" else (v, v)
            may = {"==": (low <= v) & (high >= v), ">": high > v, ">=": high >= v, "<": low < v, "<=": low <= v}[op] if op != "in" else (low <= most) & (high >= least)
            may = low.is_null() | may
            wanted = may if wanted is None else wanted & may
        for b in data.to_batches(columns=["page_id", "blob"], filter=wanted):
            for page_id, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                values, valid = nodes.load(blob, self.ptype, self.limits).decode(self.limits)
                yield pa.RecordBatch.from_arrays([pa.array([page_id] * len(values), pa.int64()), pa.array(range(len(values)), pa.int64()), to_arrow(values, valid, to_arrow_type(self.schema["v"].dataType))], names=["page_id", "pos", "v"])


@dataclass
class Written(WriterCommitMessage):
    """The file of a task; None if it had no rows."""

    name: str | None


def _place(path: str) -> tuple[fs.FileSystem, str]:
    found, inner = fs.FileSystem.from_uri(path)
    return found, inner.rstrip("/")


def whole_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.ChunkedArray]]:
    """Pages of a task's rows; refuses rows out of order and pages that begin or go on elsewhere."""
    current, held, n = None, [], 0
    for b in batches:
        if b.column("page_id").null_count or b.column("pos").null_count:
            raise ValueError("page_id and pos must not be null")
        ids, pos = b.column("page_id").to_numpy(), b.column("pos").to_numpy()
        cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)] if len(ids) else [0]
        for a, e in zip(cuts, cuts[1:], strict=False):
            page = int(ids[a])
            if page != current:
                if current is not None and page < current:
                    raise ValueError("pages must be in order; see pages.in_order")
                if held:
                    yield current, pa.chunked_array(held)
                current, held, n = page, [], 0
            if (pos[a:e] != np.arange(n, n + e - a)).any():
                raise ValueError(f"rows of page {page} must be whole in one task and in order; see pages.in_order")
            held.append(b.column("v").slice(a, e - a))
            n += e - a
    if held:
        yield current, pa.chunked_array(held)


class PageWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema, overwrite: bool):
        self.path, self.overwrite, self.ptype = options["path"], overwrite, options.get("ptype") or ptype_of(schema["v"].dataType)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = _place(self.path)
        name, out = uuid.uuid4().hex + ".parquet", None
        try:
            for page_id, column in whole_pages(iterator):
                row = seal_page(page_id, column, self.ptype)
                if out is None:
                    store.create_dir(folder, recursive=True)
                    out = pq.ParquetWriter(f"{folder}/_{name}", row.schema, filesystem=store)
                out.write_table(row)
        finally:
            if out is not None:
                out.close()
        return Written(name if out is not None else None)

    def commit(self, messages: list) -> None:
        store, folder = _place(self.path)
        store.create_dir(folder, recursive=True)
        old = [f.path for f in store.get_file_info(fs.FileSelector(folder)) if f.base_name.endswith(".parquet") and not f.base_name.startswith("_")] if self.overwrite else []
        for m in messages:
            if m is not None and m.name:
                store.move(f"{folder}/_{m.name}", f"{folder}/{m.name}")
        for f in old:
            store.delete_file(f)

    def abort(self, messages: list) -> None:
        store, folder = _place(self.path)
        for m in messages:
            if m is not None and m.name:
                store.delete_file(f"{folder}/_{m.name}")


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pagecodec"

    def schema(self) -> str:
        return f"page_id long, pos long, v {self.options.get('spark_type', 'bigint')}"

    def reader(self, schema) -> PageReader:
        return PageReader(self.options, schema)

    def writer(self, schema, overwrite: bool) -> PageWriter:
        return PageWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with filter push-down."""
    from .. import shipping

    shipping.ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageSource)

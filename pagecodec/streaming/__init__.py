"""A streaming sink: each micro-batch is sealed into pages of its own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators import paging
from ..sources import pages
from ..wire import planner


def seal_stream(stream: DataFrame, value: str, *, key: str, order_by: Sequence[str], path: str, checkpoint: str, page_keys: int = 4096, options: planner.Options = planner.Options()):
    """A stream writer that seals ``value`` of each micro-batch; call ``.start()`` on it.

    A batch goes to the folder of its number and overwrites it, so a batch that is retried leaves one copy.
    """

    def write(batch: DataFrame, number: int) -> None:
        p = paging.paged(batch, value, key=key, order_by=order_by, page_keys=page_keys)
        pages.seal(p, options=options).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)

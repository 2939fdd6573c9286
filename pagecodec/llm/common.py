"""Shared plumbing of the training-data operators: shipping code, shared storage, safe columns, text units.

Storage: intermediate tables go to the folder named by ``spark.checkpoint.dir`` (shared by driver and
executors on a cluster). Only where that setting is absent, and the master is local (tests), a temporary folder is set.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship

#: ASCII blanks that separate words in every contract: space, \t \n \v \f \r. ``bytes.split()`` uses exactly these.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows converted to Python objects at a time inside an Arrow batch; bounds worker memory with very long texts.
ROWS_AT_ONCE = 256
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

def shared_root(spark: SparkSession) -> str:
    """The shared folder of the session; sets a local one only if the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="pagecodec-shared-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the application ends."""
    path = f"{shared_root(spark)}/pagecodec/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove_quietly, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Hadoop's file system API."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001  the JVM may be gone at exit
        pass


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pick(df: DataFrame, **names: str) -> DataFrame:
    """Select columns by exact name under new names; other columns, clashing or not, are left out.

    Resolution is positional, so columns that differ only in case or occur twice don't make it ambiguous
    (the first exact match counts).
    """
    cols = list(df.columns)
    plain = df.toDF(*[f"__c{i}" for i in range(len(cols))])
    return plain.select(*[F.col(f"__c{cols.index(old)}").alias(new) for new, old in names.items()])


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into short ones without copying."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def map_arrow(df: DataFrame, fn: Callable, schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` with the package shipped to the workers; batches of texts are kept short unless the session says otherwise."""
    spark = df.sparkSession
    ship(spark)
    if spark.conf.get(BATCH_ROWS) == "10000":  # Spark's default, meant for rows of numbers
        spark.conf.set(BATCH_ROWS, str(4 * ROWS_AT_ONCE))
    return df.mapInArrow(fn, schema)


def words(text: str | None) -> list[bytes]:
    """Words of the contracts, as UTF-8."""
    return text.encode().split() if text else []


def n_words_sql(col: Column | str) -> Column:
    """Number of words, in the JVM (null: 0)."""
    return F.coalesce(F.regexp_count(F.col(col) if isinstance(col, str) else col, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def small_enough(df: DataFrame, most: int) -> bool:
    """Whether ``df`` has at most ``most`` rows; stops counting shortly after."""
    return df.limit(most + 1).count() <= most


def broadcast_if(df: DataFrame, most: int) -> DataFrame:
    """Hint a broadcast only behind a check of the size; beyond it Spark shuffles instead."""
    return F.broadcast(df) if small_enough(df, most) else df


KEYS_TO_BROADCAST = 250_000
#: Copies of a row that one task emits together.
COPIES_AT_ONCE = 10_000


def keyed(df: DataFrame, id_col: str) -> DataFrame:
    """Columns by position as ``c0..``, then ``key_id`` and ``key_hash`` (of all columns): equal keys, equal rows."""
    names = list(df.columns)
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.select("*", F.col(f"c{names.index(id_col)}").alias("key_id"), F.xxhash64(*plain.columns).alias("key_hash"))


def emit(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Emit keyed ``rows`` as often as ``decisions`` say: ``key_id, key_hash, n`` (equal rows) and ``copies`` (of all n).

    Decisions that change nothing aren't joined; the others are broadcast only if few enough. Each key's decision is
    one row, and equal rows (n over 1), if there are any, are reduced to one before they are repeated, ``COPIES_AT_ONCE``
    at a time over all partitions.
    """
    cells = [c for c in rows.columns if c not in ("key_id", "key_hash")]
    changed = table(decisions.where("copies <> 1 or n <> 1").select(F.col("key_id").alias("i"), F.col("key_hash").alias("h"), "n", "copies"), "decisions")
    same = rows["key_id"].eqNullSafe(changed["i"]) & (rows["key_hash"] == changed["h"])
    joined = rows.join(broadcast_if(changed, KEYS_TO_BROADCAST), same, "left")
    out = joined.where("copies is null or (n = 1 and copies > 0)").withColumn("copies", F.coalesce("copies", F.lit(1)))
    several = changed.where("n > 1 and copies > 0")
    if several.limit(1).count():
        again = rows.join(broadcast_if(several, KEYS_TO_BROADCAST), rows["key_id"].eqNullSafe(several["i"]) & (rows["key_hash"] == several["h"]))
        blocks = again.dropDuplicates(["key_id", "key_hash"]).select(*out.columns).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("copies") - 1) / COPIES_AT_ONCE))))
        dealt = blocks.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key_id", "key_hash", "block")
        out = out.unionByName(dealt.withColumn("copies", F.least(F.lit(COPIES_AT_ONCE).cast("bigint"), F.col("copies") - F.col("block") * COPIES_AT_ONCE)).drop("block"))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*cells)


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Keyed ``rows`` less those whose ``key_id, key_hash`` are in ``gone``; broadcast only if few enough."""
    cells = [c for c in rows.columns if c not in ("key_id", "key_hash")]
    gone = table(gone.select(F.col("key_id").alias("i"), F.col("key_hash").alias("h")).distinct(), "gone")
    same = rows["key_id"].eqNullSafe(gone["i"]) & (rows["key_hash"] == gone["h"])
    return rows.join(broadcast_if(gone, KEYS_TO_BROADCAST), same, "left_anti").select(*cells)

"""Helpers the text operators share: reading tables, written intermediates, bounded samples."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[tuple[SparkSession, str]] = []


#: Rows that executors hold at once where they read whole texts and hand them to Python; Spark's own figures are 4096 and 10000.
BATCH_ROWS = {"spark.sql.parquet.columnarReaderBatchSize": 512, "spark.sql.execution.arrow.maxRecordsPerBatch": 1024}


def bound_batches(spark: SparkSession) -> None:
    """Set BATCH_ROWS for the session, where it has no figures of its own: long texts by the thousand need buffers of tens of MB a task."""
    for key, rows in BATCH_ROWS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where the session names none, a temporary one in local mode, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="voxframe-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _WRITTEN:
        atexit.register(_sweep)
    _WRITTEN.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def drop(df: DataFrame | None) -> None:
    """Delete a table made by written() that no later plan reads."""
    path = getattr(df, "_written_path", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _sweep() -> None:
    for spark, path in _WRITTEN:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            return


def id_bucket(col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo: the folds of the query contracts."""
    return F.crc32(F.col(col).cast("string")) % modulus


def bounded_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` rows of df, those of the smallest key hashes, so the choice is repeatable.

    The hash bound is set from a count first: no task ever orders more than about 1.5 * most rows.
    """
    n = df.count()
    h = F.xxhash64(key)
    if n > most:
        share = min(1.0, 1.2 * most / n + 50 / n)
        df = df.where(h < F.lit(int(-(2**63) + share * (2**64 - 1))))
        df = df.orderBy(h, key).limit(most)
    return df


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and one text (that of the least hash) of each of the ids that docs (doc_id, text) has; ids: a sample of bounded size."""
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids.select("doc_id").distinct()), "doc_id")
    return rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def free_name(columns: list[str], wish: str) -> str:
    """wish, or the first of _wish, __wish, .. that no column has; Spark's names differ by more than case."""
    taken = {c.lower() for c in columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


def blocks_for(n: int, per_block: int) -> int:
    return max(1, math.ceil(n / per_block))


def slices(batches, rows: int = 512):
    """The record batches in pieces of so many rows, so that few texts are Python objects at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)

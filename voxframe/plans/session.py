"""Session settings and the shared folder for cut lineages."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with SETTINGS; partition counts are left to the cluster's defaults and AQE."""
    builder = SparkSession.builder.config(map=SETTINGS | settings)
    return (builder.master(master) if master else builder).getOrCreate()


_WRITTEN: list[tuple[SparkSession, str]] = []


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


def _new_path(spark: SparkSession) -> str:
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/table-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_sweep)
    _WRITTEN.append((spark, path))
    return path


def checkpointed(df: DataFrame, by: str | None = None) -> DataFrame:
    """df written once to the shared folder and read back: its lineage ends there. The files go when the program ends, or by drop.

    With `by`, a column of few values, each value has its own files, so that a plan that asks for one value reads only those; its rows are
    spread over tasks.
    """
    path = _new_path(df.sparkSession)
    if by:
        df.repartition(by, F.pmod(F.xxhash64(F.lit(0), *[c for c in df.columns if c != by]), F.lit(4))).write.partitionBy(by).parquet(path)
    else:
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
    out._written_path = path
    return out


def drop(*dfs: DataFrame) -> None:
    """Delete tables made by checkpointed that no later plan reads."""
    for df in dfs:
        path = getattr(df, "_written_path", None)
        if path:
            _delete(df.sparkSession, path)


class Steps:
    """A table that grows by one part a step, each in its own folder below one path, so that the whole is one scan."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.schema = spark, _new_path(spark), None

    def add(self, df: DataFrame, step: int) -> DataFrame:
        """df written as the part of this step and read back."""
        where = f"{self.path}/step={step}"
        df.write.parquet(where)
        self.schema = df.schema
        return self.spark.read.schema(df.schema).parquet(where)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _sweep() -> None:
    for spark, path in _WRITTEN:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            return

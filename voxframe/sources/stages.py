"""Stage tables: names, writing, reading, readiness, removal."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stages of a run in order; the feature tables are its results and outlast the others.
STAGES = ("voxels", "vesselness", "labels", "skeleton", "pixel_class", "branches", "distance", "border", "markers", "flow", "voxel_matches", "reassigned", "edges")
FEATURES = ("features_voxels", "features_nodes", "features_branches", "features_organelles", "features_image")
#: Frames of a table that have folders of their own; tables of more are files of ranges of frames.
MOST_FOLDERS = 1000


@dataclass(frozen=True)
class StageStore:
    """Parquet tables of a run below one root, partitioned by image and frame where they have those columns.

    Each frame has a folder, or, where there are more than MOST_FOLDERS of them, rows are dealt and sorted by frame: files then hold ranges of frames,
    whose bounds tell a reader which of them it needs, and their number doesn't grow with the frames'.
    """

    spark: SparkSession
    root: str

    def path(self, stage: str) -> str:
        if stage not in STAGES + FEATURES:
            raise KeyError(f"unknown stage {stage!r}")
        return f"{self.root.rstrip('/')}/{stage}"

    def write(self, stage: str, df: DataFrame, keys: tuple[str, ...] = ("image_id", "t")) -> DataFrame:
        parts = [c for c in keys if c in df.columns]
        if parts:  # a frame's rows in four files at most, from as many tasks
            share = F.pmod(F.xxhash64(F.lit(0), *[c for c in df.columns if c not in parts and df.schema[c].dataType.typeName() != "map"]), F.lit(4))
            if df.select(*parts).distinct().limit(MOST_FOLDERS + 1).count() > MOST_FOLDERS:
                df, parts = df.select(*[c for c in df.columns if c not in parts], *parts).repartitionByRange(*parts, share).sortWithinPartitions(*parts), []
            else:
                df = df.repartition(*parts, share)
        df.write.mode("overwrite").partitionBy(*parts).parquet(self.path(stage))
        return self.read(stage)

    def read(self, stage: str) -> DataFrame:
        return self.spark.read.parquet(self.path(stage))

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def ready(self, stage: str) -> bool:
        fs, where = self._fs(f"{self.path(stage)}/_SUCCESS")
        return fs.exists(where)

    def missing(self) -> list[str]:
        return [s for s in STAGES if not self.ready(s)]

    def remove_intermediates(self) -> None:
        """Drop every stage but the feature tables."""
        for stage in STAGES:
            fs, where = self._fs(self.path(stage))
            fs.delete(where, True)

    def export(self, stage: str, column: str, path: str, t: int | None = None) -> None:
        """t and one column as CSV, of one frame if t is given."""
        df = self.read(stage)
        df = df if t is None else df.where(df["t"] == t)
        df.select("t", column).write.mode("overwrite").csv(path, header=True)

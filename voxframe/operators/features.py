"""Feature tables of the hierarchy, its containment edges, overlays and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.operators.stats import five_stats, smallest_mode

#: Statistic names in the order they are shown.
FORMS = ("raw", "mean", "std_dev", "min", "max", "sum")


def level_table(voxels: DataFrame, level: str, values: list[str]) -> DataFrame:
    """t, label and the five statistics of each value over the voxels of a level; label 0 is background."""
    by = ["t"] if level == "image" else ["t", level]
    rows = voxels if level == "image" else voxels.where(F.col(level) != 0)
    out = five_stats(rows, by, values)
    return out.withColumn("label", F.lit(0).cast("long")) if level == "image" else out.withColumnRenamed(level, "label")


def branch_to_organelle(voxels: DataFrame, frame: tuple[str, ...] = ("t",)) -> DataFrame:
    """t, branch, organelle: the organelle of each branch's first voxel."""
    return voxels.where("branch != 0").groupBy(*frame, "branch").agg(F.min_by("organelle", "id").alias("organelle"))


def label_joins(voxels: DataFrame, branches: DataFrame, organelles: DataFrame) -> DataFrame:
    """voxels with the columns of the branch and the organelle whose label they carry (tables t, label, ..); voxels of label 0 drop out."""
    of = lambda df, level: df.withColumnsRenamed({"label": level} | {c: f"{level}_{c}" for c in df.columns if c not in ("t", "label")})
    return voxels.join(of(branches, "branch"), ["t", "branch"]).join(of(organelles, "organelle"), ["t", "organelle"])


def containment_edges(voxels: DataFrame, frame: tuple[str, ...] = ("t",)) -> DataFrame:
    """t, kind, src, dst: voxel to branch and organelle, branch to organelle; labels as they are, above 0."""
    vb = voxels.where("branch > 0").select(*frame, F.lit("v_b").alias("kind"), F.col("id").alias("src"), F.col("branch").alias("dst"))
    vo = voxels.where("organelle > 0").select(*frame, F.lit("v_o").alias("kind"), F.col("id").alias("src"), F.col("organelle").alias("dst"))
    bo = branch_to_organelle(voxels, frame).where("organelle > 0").select(*frame, F.lit("b_o").alias("kind"), F.col("branch").alias("src"), F.col("organelle").alias("dst"))
    return vb.unionByName(vo).unionByName(bo)


def overlay(edges: DataFrame, features: DataFrame, value: str, frame: tuple[str, ...] = ("t",)) -> DataFrame:
    """t, src, value: the mean of the feature over all parents of each source; missing values are left out."""
    return edges.join(features.select(*frame, F.col("label").alias("dst"), value), [*frame, "dst"]).groupBy(*frame, "src").agg(F.avg(value).alias(value))


def lookup(voxels: DataFrame, where) -> DataFrame:
    """Voxel, branch, organelle and image ids at the voxels that `where` picks."""
    return voxels.where(where).select("t", "id", "branch", "organelle", F.lit(0).alias("image"))


def reassigned_label(voxels: DataFrame, level: str, label: str, frame: tuple[str, ...] = ("t",)) -> DataFrame:
    """t, label of the level, most frequent new label (the smallest on a tie; 0 counts)."""
    return voxels.where(F.col(level) != 0).groupBy(*frame, F.col(level).alias("label")).agg(smallest_mode(label).alias("reassigned_label"))


def split_name(column: str) -> tuple[str, str]:
    """Feature and form of a column name <feature>_<form>."""
    for form in sorted(FORMS, key=len, reverse=True):
        if column.endswith(f"_{form}"):
            return column[: -len(form) - 1], form
    return column, "raw"


def plottable(df: DataFrame) -> list[str]:
    """Numeric columns but the keys t and label."""
    return [f.name for f in df.schema.fields if f.name not in ("t", "label", "image_id") and f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte")]


def column_for(df: DataFrame, feature: str, form: str | None = None) -> str:
    """The column of a feature in the wanted form, by default the first there is in the order of FORMS."""
    forms = {split_name(c)[1]: c for c in plottable(df) if split_name(c)[0] == feature}
    if form is not None:
        return forms[form]
    return next(forms[f] for f in FORMS if f in forms)

"""Views of the benchmark tables in the shape of the image data model, and the same views as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t, y, x, v: each embedding as an 8 x 8 frame."""
    cells = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("t"), F.posexplode("embedding").alias("p", "e"))
    return cells.select("t", F.floor(F.col("p") / F.lit(8)).cast("int").alias("y"), (F.col("p") % 8).cast("int").alias("x"), F.col("e").cast("double").alias("v"))


def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image, z, y, x, v: eight embeddings as a volume."""
    return raster(spark, sf_dir).select(F.floor(F.col("t") / F.lit(8)).alias("image"), (F.col("t") % 8).cast("int").alias("z"), "y", "x", "v")


def mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t, y, x, v: 64 embeddings as a frame of 64 x 64 cells; cells without one are 0."""
    return _tiled(raster(spark, sf_dir), 64, 8, 1).drop("z")


def mosaic_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t, z, y, x, v: 128 embeddings as a frame of 8 x 32 x 32 cells; cells without one are 0."""
    return _tiled(raster(spark, sf_dir), 128, 4, 8)


def _tiled(cells: DataFrame, each: int, across: int, planes: int) -> DataFrame:
    place = F.floor(F.col("t") / F.lit(planes)) % (across * across)
    at = cells.select(
        F.floor(F.col("t") / F.lit(each)).cast("int").alias("t"), (F.col("t") % planes).cast("int").alias("z"),
        (F.floor(place / F.lit(across)) * 8 + F.col("y")).cast("int").alias("y"), (place % across * 8 + F.col("x")).cast("int").alias("x"), "v",
    )
    line = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    full = at.select("t").distinct().select("t", line("z", planes)).select("*", line("y", 8 * across)).select("*", line("x", 8 * across))
    return full.join(at, ["t", "z", "y", "x"], "left").fillna(0.0, ["v"])


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as voxels: t, id, branch, organelle, intensity, structure, x."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice", "l_discount", "l_quantity")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        (F.year("l_shipdate") - 1995).cast("int").alias("t"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
        (F.col("l_orderkey") + 1).alias("branch"),
        (F.col("o_custkey") + 1).alias("organelle"),
        F.col("l_extendedprice").alias("intensity"),
        F.col("l_discount").alias("structure"),
        F.col("l_quantity").alias("x"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as points of daily frames: t, id, user_id, kind, y, x."""
    seconds = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        (F.dayofmonth("ts") - 1).cast("int").alias("t"), F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("kind"), F.col("value").alias("y"), (seconds / F.lit(1000.0)).alias("x")
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as timed series: user_id, id, s (seconds), value."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("event_id").alias("id"), F.expr("cast(timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts AS timestamp_ntz)) AS double)").alias("s"), "value")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as image metadata: image_id, num, unit, name, kind, price."""
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.col("p_partkey").alias("image_id"), F.col("p_size").alias("num"), (F.col("p_partkey") % 3).cast("int").alias("unit"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_retailprice").alias("price")
    )


RASTER = "r AS (SELECT vec_id AS t, ((p - 1) // 8)::int AS y, ((p - 1) % 8)::int AS x, embedding[p]::double AS v FROM embeddings, range(1, 65) pp(p))"
HIERARCHY = (
    "h AS (SELECT (year(l_shipdate) - 1995)::int AS t, l_orderkey * 8 + l_linenumber AS id, l_orderkey + 1 AS branch, o_custkey + 1 AS organelle, "
    "l_extendedprice AS intensity, l_discount AS structure, l_quantity AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
)
POINTS = (
    "p AS (SELECT (day(ts) - 1)::int AS t, event_id AS id, user_id, event_type AS kind, value AS y, "
    "(hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 1000.0::double AS x FROM events)"
)
SERIES = "s AS (SELECT user_id, event_id AS id, floor(epoch(ts))::double AS s, value FROM events)"
PARTS = "m AS (SELECT p_partkey AS image_id, p_size AS num, (p_partkey % 3)::int AS unit, p_name AS name, p_type AS kind, p_retailprice AS price FROM part)"

"""Image moments of regions of interest as group sums, Hu's invariants as expressions over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDERS = [(p, q) for p in range(4) for q in range(4) if p + q <= 3]


def normalized(df: DataFrame, by: list[str], y: str, x: str, v: str) -> DataFrame:
    """by, n<p><q> for 2 <= p + q <= 3: central moments over powers of the mass; groups without mass drop out.

    Central moments are summed around the centroid, not expanded from raw ones, so they keep their digits.
    """
    mass = df.groupBy(*by).agg(F.sum(v).alias("_m"), (F.sum(F.col(v) * F.col(x))).alias("_x"), (F.sum(F.col(v) * F.col(y))).alias("_y")).where("_m > 0")
    mass = mass.select(*by, "_m", (F.col("_x") / F.col("_m")).alias("_cx"), (F.col("_y") / F.col("_m")).alias("_cy"))
    dx, dy = F.col(x) - F.col("_cx"), F.col(y) - F.col("_cy")
    power = lambda c, k: F.lit(1.0) if k == 0 else (c if k == 1 else (c * c if k == 2 else c * c * c))
    sums = [F.sum(F.col(v) * power(dx, p) * power(dy, q)).alias(f"u{p}{q}") for p, q in ORDERS if p + q >= 2]
    joined = df.join(mass, by).groupBy(*by).agg(F.first("_m").alias("_m"), *sums)
    return joined.select(*by, *[(F.col(f"u{p}{q}") / F.pow("_m", F.lit(1 + (p + q) / 2))).alias(f"n{p}{q}") for p, q in ORDERS if p + q >= 2])


def hu() -> dict[str, Column]:
    """The first six invariants of normalised moments."""
    n = {f"{p}{q}": F.col(f"n{p}{q}") for p, q in ORDERS if p + q >= 2}
    a, b = n["30"] + n["12"], n["21"] + n["03"]
    c, d = n["30"] - 3 * n["12"], 3 * n["21"] - n["03"]
    e = n["20"] - n["02"]
    return {
        "h1": n["20"] + n["02"],
        "h2": e * e + 4 * n["11"] * n["11"],
        "h3": c * c + d * d,
        "h4": a * a + b * b,
        "h5": c * a * (a * a - 3 * b * b) + d * b * (3 * a * a - b * b),
        "h6": e * (a * a - b * b) + 4 * n["11"] * a * b,
    }


def signed_log(h: Column) -> Column:
    """-sign(h) * log10 |h|, 0 for 0; never infinite."""
    return F.when(h == 0, 0.0).otherwise(-F.signum(h) * F.log10(F.greatest(F.abs(h), F.lit(2.2250738585072014e-308))))


def log_hu_table(df: DataFrame, by: list[str], y: str, x: str, v: str) -> DataFrame:
    return normalized(df, by, y, x, v).select(*by, *[signed_log(h).alias(k) for k, h in hu().items()])


def nonzero_stats(df: DataFrame, by: list[str], v: str) -> DataFrame:
    """mean and variance (ddof 0) of the values that aren't 0; 0 where there are none."""
    x = F.when(F.col(v) != 0, F.col(v))
    return df.groupBy(*by).agg(F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop(x), F.lit(0.0)).alias("variance"))


def projections(df: DataFrame, by: list[str], v: str) -> DataFrame:
    """by, axis, a, b, v: the greatest value along z, y and x of a volume; one pass over its rows."""
    views = F.explode(F.array(*[F.struct(F.lit(axis).alias("axis"), F.col(a).alias("a"), F.col(b).alias("b")) for axis, a, b in (("z", "y", "x"), ("y", "z", "x"), ("x", "z", "y"))]))
    return df.select(*by, v, views.alias("p")).groupBy(*by, "p.axis", "p.a", "p.b").agg(F.max(v).alias(v))

"""Radius, nearest and box joins of points: equal cells of a grid first, the exact predicate after."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.plans.session import checkpointed, drop


def _distance(axes: tuple[str, ...]) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, [(F.col(f"l_{a}") - F.col(f"r_{a}")) * (F.col(f"l_{a}") - F.col(f"r_{a}")) for a in axes]))


def shuffled(df: DataFrame) -> DataFrame:
    """df, told to be shuffled in the next join: a table of rows grows with the input and is never gathered in the driver.

    Broadcasts are chosen by the size of compressed files, of which rows in memory take many times as much.
    """
    return df.hint("merge")


def radius_join(left: DataFrame, right: DataFrame, on: list[str], axes: tuple[str, ...], radius: float, strict: bool = False, cells: bool = False) -> DataFrame:
    """Pairs within the radius: on, l_<columns>, r_<columns>, distance; with `cells` also the cell of the left row (cell_keys).

    Both sides go to cells twice the radius wide and the right one to every cell in its reach, so the join is on
    equal keys: it partitions, can be split when skewed, and costs what near pairs cost. Sizes are estimated before the
    cells multiply the rows, so the join is told to shuffle.
    """
    keys = cell_keys(axes)
    pairs = in_cells(left, axes, radius, "l", on).join(shuffled(near_cells(right, axes, radius, "r", on)), [*on, *keys])
    return within(pairs if cells else pairs.drop(*keys), axes, radius, strict)


def cell_keys(axes: tuple[str, ...]) -> list[str]:
    return [f"_c{a}" for a in axes]


def _wide_cell(c: Column, radius: float) -> Column:
    return F.floor(c / F.lit(2.0 * radius)).cast("long")


def in_cells(df: DataFrame, axes: tuple[str, ...], radius: float, side: str, on: list[str]) -> DataFrame:
    """df, its columns but `on` named <side>_<column>, with the cell, twice the radius wide, that each row lies in."""
    named = df.select(*on, *[F.col(c).alias(f"{side}_{c}") for c in df.columns if c not in on])
    return named.withColumns({k: _wide_cell(F.col(f"{side}_{a}"), radius) for k, a in zip(cell_keys(axes), axes, strict=True)})


def near_cells(df: DataFrame, axes: tuple[str, ...], radius: float, side: str, on: list[str]) -> DataFrame:
    """df, named like in in_cells, once for each cell that may hold a point within the radius: at most 2 along each axis."""
    return _in_reach(df.select(*on, *[F.col(c).alias(f"{side}_{c}") for c in df.columns if c not in on]), axes, radius, side)


def _in_reach(named: DataFrame, axes: tuple[str, ...], radius: float, side: str) -> DataFrame:
    reach = F.lit(radius * (1 + 1e-9) + 1e-9)
    for k, a in zip(cell_keys(axes), axes, strict=True):
        named = named.withColumn(k, F.explode(F.sequence(_wide_cell(F.col(f"{side}_{a}") - reach, radius), _wide_cell(F.col(f"{side}_{a}") + reach, radius))))
    return named


def within(pairs: DataFrame, axes: tuple[str, ...], radius: float, strict: bool = False) -> DataFrame:
    """pairs with l_<axes> and r_<axes> and their distance, where it is within the radius."""
    pairs = pairs.withColumn("distance", _distance(axes))
    return pairs.where(F.col("distance") < radius if strict else F.col("distance") <= radius)


#: Rows of one place that travel as one list; a place of more has several.
LIST = 1_024


def _listed(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """by and `name`, the other columns of the rows that agree in `by`, as lists of about LIST rows."""
    rest = F.struct(*[F.col(c) for c in rows.columns if c not in by])
    sizes = rows.groupBy(*by).agg(F.floor((F.count("*") - 1) / F.lit(LIST)).alias("_n")).where("_n > 0")
    dealt = rows.join(shuffled(sizes), by, "left").withColumn("_n", F.pmod(F.xxhash64(*rows.columns), F.coalesce("_n", F.lit(0)) + 1))
    return dealt.groupBy(*by, "_n").agg(F.sort_array(F.collect_list(rest)).alias(name)).drop("_n")


def _unlisted(pairs: DataFrame, keep: list[str], left: list[str], right: list[str]) -> DataFrame:
    """keep and each row of the list _l with each row of _r, one after the other, so that nothing but the lists is held."""
    rows = pairs.select(*keep, F.explode("_l").alias("_l"), "_r").select(*keep, *[F.col(f"_l.{c}").alias(c) for c in left], "_r")
    return rows.select(*keep, *left, F.explode("_r").alias("_r")).select(*keep, *left, *[F.col(f"_r.{c}").alias(c) for c in right])


def radius_rows(left: DataFrame, right: DataFrame, on: list[str], axes: tuple[str, ...], radius: float, strict: bool = False) -> DataFrame:
    """What radius_join gives, for tables with many rows at one place: places meet with lists of their rows.

    What is shuffled grows with the rows and not with the pairs, distances are those of places, and pairs are made where they are
    written, all of one row together. Cells are twice the radius wide, so a right place goes to 2 cells along each axis at most. Rows without a place meet none.
    """
    sides = []
    for df, k in ((left, "l"), (right, "r")):
        named = df.dropna(subset=[*on, *axes]).select(*on, *[F.col(c).alias(f"{k}_{c}") for c in df.columns if c not in on])
        sides.append(_listed(named, [*on, *[f"{k}_{a}" for a in axes]], f"_{k}"))
    lhs, rhs = sides
    keys = cell_keys(axes)
    lhs = lhs.withColumns({k: _wide_cell(F.col(f"l_{a}"), radius) for k, a in zip(keys, axes, strict=True)})
    pairs = within(lhs.join(shuffled(_in_reach(rhs, axes, radius, "r")), [*on, *keys]), axes, radius, strict)
    places = [f"{k}_{a}" for k in "lr" for a in axes]
    rest = [[f"{k}_{c}" for c in df.columns if c not in (*on, *axes)] for df, k in ((left, "l"), (right, "r"))]
    made = _unlisted(pairs.select(*on, *places, "distance", "_l", "_r"), [*on, *places, "distance"], *rest)
    order = [f"{k}_{c}" for df, k in ((left, "l"), (right, "r")) for c in df.columns if c not in on]
    return made.select(*on, *order, "distance")


#: Points that a cell may hold, as its points see it, before rows are first searched in smaller cells.
CROWD = 16


def _spots(right: DataFrame, on: list[str], axes: tuple[str, ...], right_id: str) -> DataFrame:
    """The places of the right rows and the smallest id at each: copies of a point are one spot."""
    return right.dropna(subset=list(axes)).groupBy(*on, *axes).agg(F.min(right_id).alias(right_id))


def _places(left: DataFrame, on: list[str], axes: tuple[str, ...]) -> DataFrame:
    return left.select(*on, *axes).dropna(subset=list(axes)).distinct()


def _best(pairs: DataFrame, on: list[str], axes: tuple[str, ...], right_id: str) -> DataFrame:
    """on, l_<axes>, _d, _id and n_<axes>: of each left place the nearest pair, the smaller id on a tie."""
    at = [*on, *[f"l_{a}" for a in axes]]
    nearest = F.min(F.struct(F.round("distance", 9).alias("d"), F.col(f"r_{right_id}").alias("id"), *[F.col(f"r_{a}").alias(a) for a in axes])).alias("b")
    return pairs.groupBy(*at).agg(nearest).select(*at, F.col("b.d").alias("_d"), F.col("b.id").alias("_id"), *[F.col(f"b.{a}").alias(f"n_{a}") for a in axes])


def _nearest(places: DataFrame, spots: DataFrame, on: list[str], axes: tuple[str, ...], radius: float, right_id: str, strict: bool) -> DataFrame:
    """on, l_<axes>, _d, _id, n_<axes> of the spot nearest to each place within the radius. Both tables are written ones.

    Where cells of the radius are crowded, places are searched within smaller radii first, and only those with nothing that near go on to
    four times the radius: a place meets the spots around it and not all within the radius.
    """
    cell = [F.floor(F.col(a) / F.lit(radius)).cast("long").alias(f"_c{a}") for a in axes]
    crowd = spots.groupBy(*on, *cell).agg(F.count("*").cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 0.0
    rounds = 0
    while crowd > CROWD and rounds < 8:
        crowd, rounds = crowd / 4 ** len(axes), rounds + 1
    if not rounds:
        return _best(radius_join(places, spots, on, axes, radius, strict), on, axes, right_id)
    rest, out = places, None
    for k in range(rounds, -1, -1):
        r = radius / 4**k
        # rows as near as the found one after rounding may lie beyond r by as much
        found = _best(radius_join(rest, spots, on, axes, r + 1e-8) if k else radius_join(rest, spots, on, axes, radius, strict), on, axes, right_id)
        found = checkpointed(found.where(F.col("_d") <= r) if k else found)
        out = found if out is None else out.unionByName(found)
        if k:
            done = found.select(*on, *[F.col(f"l_{a}").alias(a) for a in axes])
            before, rest = rest, checkpointed(rest.join(shuffled(done), [*on, *axes], "left_anti"))
            if before is not places:
                drop(before)
    return out


def _given_back(left: DataFrame, best: DataFrame, on: list[str], axes: tuple[str, ...], left_id: str, right_id: str) -> DataFrame:
    """What was found for places, for the rows of left that lie there."""
    at = left.select(*on, left_id, *[F.col(a).alias(f"l_{a}") for a in axes])
    rows = at.join(shuffled(best.select(*on, *[f"l_{a}" for a in axes], "_d", "_id")), [*on, *[f"l_{a}" for a in axes]]).groupBy(*on, left_id).agg(F.min(F.struct("_d", "_id")).alias("b"))
    return rows.select(*on, left_id, F.col("b._id").alias(f"nearest_{right_id}"), F.col("b._d").alias("distance"))


def nearest_within(left: DataFrame, right: DataFrame, on: list[str], axes: tuple[str, ...], radius: float, left_id: str, right_id: str, strict: bool = True) -> DataFrame:
    """Each left row's nearest right row within the radius, the smaller id on a tie; rows without one drop out.

    Places are searched, not rows: copies of a point on either side cost one search and one join by place.
    """
    best = _nearest(checkpointed(_places(left, on, axes)), checkpointed(_spots(right, on, axes, right_id)), on, axes, radius, right_id, strict)
    return _given_back(left, best, on, axes, left_id, right_id)


def nearest_spots(places: DataFrame, spots: DataFrame, on: list[str], axes: tuple[str, ...], radius: float, strict: bool = True) -> DataFrame:
    """on, axes, n_<axes>, n_id, distance: the spot nearest to each place within the radius, the smaller id on a tie.

    Both are written tables (spots with id) with one row a place, so the search costs places and not the rows that lie there.
    """
    best = _nearest(places.select(*on, *axes), spots.select(*on, *axes, "id"), on, axes, radius, "id", strict)
    return best.select(*on, *[F.col(f"l_{a}").alias(a) for a in axes], *[f"n_{a}" for a in axes], F.col("_id").alias("n_id"), F.col("_d").alias("distance"))


def _pyramid(right: DataFrame, on: list[str], axes: tuple[str, ...], cell: float) -> tuple[DataFrame, list[DataFrame]]:
    """right with its cells _c<axis>, counted from the least cell of its group, and the occupied cells of each level with the box of their points.

    A cell of a level covers two cells of the level before along each axis; in the last level every group is one cell.
    """
    keys = [f"_c{a}" for a in axes]
    placed = right.select("*", *[F.floor(F.col(a) / F.lit(cell)).cast("long").alias(k) for a, k in zip(axes, keys, strict=True)])
    least = placed.groupBy(*on).agg(*[F.min(k).alias(f"_m{k}") for k in keys])
    placed = checkpointed(placed.join(least, on).withColumns({k: F.col(k) - F.col(f"_m{k}") for k in keys}).drop(*[f"_m{k}" for k in keys]))
    levels = [checkpointed(placed.groupBy(*on, *keys).agg(*[F.min(a).alias(f"_low_{a}") for a in axes], *[F.max(a).alias(f"_high_{a}") for a in axes]))]
    while not levels[-1].groupBy(*on).agg(F.count("*").alias("_n")).where("_n > 1").isEmpty():
        up = levels[-1].withColumns({k: F.shiftright(k, 1) for k in keys})
        levels.append(checkpointed(up.groupBy(*on, *keys).agg(*[F.min(f"_low_{a}").alias(f"_low_{a}") for a in axes], *[F.max(f"_high_{a}").alias(f"_high_{a}") for a in axes])))
    return placed, levels


def nearest_any(left: DataFrame, right: DataFrame, on: list[str], axes: tuple[str, ...], cell: float, left_id: str, right_id: str) -> DataFrame:
    """Each left row's nearest right row at whatever distance, the smaller id on a tie.

    Places with a right row within `cell` are done by one join. The others descend a pyramid of the right rows' cells: at each level a place meets the
    halves of the cells it has kept, and keeps those whose box may be nearer than the farthest corner of the most promising one. So a place meets
    the near side of a far crowd, never all of it; copies of a point are one place. Each level is written; rows of groups without a right row drop out.
    """
    at = [f"l_{a}" for a in axes]
    spots = checkpointed(_spots(right, on, axes, right_id))
    places = checkpointed(_places(left, on, axes))
    found = checkpointed(_nearest(places, spots, on, axes, cell, right_id, False))
    rest = places.join(spots.select(*on).distinct(), on, "left_semi").toDF(*on, *at).join(shuffled(found), [*on, *at], "left_anti")
    rest = checkpointed(rest)
    if rest.isEmpty():
        return _given_back(left, found, on, axes, left_id, right_id)
    keys = [f"_c{a}" for a in axes]
    placed, levels = _pyramid(spots, on, axes, cell)
    sides = [(F.col(f"l_{a}"), F.col(f"_low_{a}"), F.col(f"_high_{a}")) for a in axes]
    square = lambda parts: F.sqrt(reduce(lambda p, q: p + q, [x * x for x in parts]))
    at_least = square([F.greatest(low - x, x - high, F.lit(0.0)) for x, low, high in sides])
    at_most = square([F.greatest(F.abs(x - low), F.abs(x - high)) for x, low, high in sides])
    kept = rest.join(levels[-1].select(*on, *keys), on)
    for level in reversed(levels[:-1]):
        halves = level.withColumns({f"_p{k}": F.shiftright(k, 1) for k in keys})
        met = kept.withColumnsRenamed({k: f"_p{k}" for k in keys}).join(halves, [*on, *[f"_p{k}" for k in keys]])
        met = met.withColumn("_least", at_least).withColumn("_bar", F.min(at_most).over(Window.partitionBy(*on, *at)))
        before, kept = kept, checkpointed(met.where(F.col("_least") <= F.col("_bar") + 1e-8).select(*on, *at, *keys))
        drop(before)
    ends = kept.join(placed.select(*on, *keys, F.col(right_id).alias(f"r_{right_id}"), *[F.col(a).alias(f"r_{a}") for a in axes]), [*on, *keys])
    best = _best(ends.withColumn("distance", _distance(axes)), on, axes, right_id)
    return _given_back(left, found.unionByName(best), on, axes, left_id, right_id)


def box_join(points: DataFrame, boxes: DataFrame, on: list[str], axes: tuple[str, ...], cell: int) -> DataFrame:
    """Pairs of point and box with low_<axis> <= point <= high_<axis> on every axis (box columns keep their names).

    A box goes to every cell it touches, a point to its one cell: no pair is found twice.
    """
    keys = [f"_c{a}" for a in axes]
    lhs = points.select("*", *[F.floor(F.col(a) / F.lit(cell)).cast("long").alias(k) for a, k in zip(axes, keys, strict=True)])
    rhs = boxes
    for a, k in zip(axes, keys, strict=True):
        rhs = rhs.withColumn(k, F.explode(F.sequence(F.floor(F.col(f"low_{a}") / F.lit(cell)).cast("long"), F.floor(F.col(f"high_{a}") / F.lit(cell)).cast("long"))))
    inside = reduce(lambda p, q: p & q, [(F.col(a) >= F.col(f"low_{a}")) & (F.col(a) <= F.col(f"high_{a}")) for a in axes])
    return lhs.join(shuffled(rhs), [*on, *keys]).where(inside).drop(*keys)


def box_rows(points: DataFrame, boxes: DataFrame, on: list[str], axes: tuple[str, ...], cell: int) -> DataFrame:
    """What box_join gives, for tables with many rows at one place or many equal boxes: places and boxes meet with lists of their rows."""
    bounds = [f"{end}_{a}" for a in axes for end in ("low", "high")]
    rest = [[c for c in df.columns if c not in (*on, *own)] for df, own in ((points, axes), (boxes, bounds))]
    held = box_join(_listed(points.dropna(subset=[*on, *axes]), [*on, *axes], "_l"), _listed(boxes.dropna(subset=[*on, *bounds]), [*on, *bounds], "_r"), on, axes, cell)
    return _unlisted(held, [*on, *axes, *bounds], *rest).select(*on, *[c for c in points.columns if c not in on], *[c for c in boxes.columns if c not in on])


def box_counts(points: DataFrame, boxes: DataFrame, on: list[str], axes: tuple[str, ...], cell: int, box: str) -> DataFrame:
    """on, box, n: points in each box, those without any left out. Distinct places meet distinct boxes, with how many points they stand for."""
    spots = points.groupBy(*on, *axes).agg(F.count("*").alias("_points"))
    bounds = [f"{end}_{a}" for a in axes for end in ("low", "high")]
    held = box_join(spots, boxes.select(*on, *bounds).distinct(), on, axes, cell).groupBy(*on, *bounds).agg(F.sum("_points").alias("n"))
    return boxes.select(*on, box, *bounds).join(shuffled(held), [*on, *bounds]).select(*on, box, "n")

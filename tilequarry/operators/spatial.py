"""Spatial joins. Pairs meet through grid cells, an equi-join that scales; the exact test follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilequarry.functions import tile


def overlaps(a: str, b: str) -> Column:
    """Whether boxes w, s, e, n of two sides overlap; touching edges count."""
    c = F.col
    return (c(f"{a}.w") <= c(f"{b}.e")) & (c(f"{a}.e") >= c(f"{b}.w")) & (c(f"{a}.s") <= c(f"{b}.n")) & (c(f"{a}.n") >= c(f"{b}.s"))


#: Smallest and largest power of two that is the side of a box's cell, in degrees; the largest holds the world.
FINEST, COARSEST = -20, 9
#: Most times that a cell is halved where boxes crowd, and the candidate pairs that are worth one more row.
HALVINGS, ROW_COST = 6, 30


def _level() -> Column:
    """The smallest power of two that is no less than both sides of a box: it touches four cells of that side at most."""
    side = F.greatest(F.col("e") - F.col("w"), F.col("n") - F.col("s"), F.lit(2.0**FINEST))
    return F.least(F.lit(COARSEST), F.ceil(F.log2(side)).cast("int"))


def _upright(df: DataFrame) -> DataFrame:
    """The boxes that can meet others, with their level ``_own``; those turned round (w > e, s > n) or with null edges cannot."""
    return df.where((F.col("w") <= F.col("e")) & (F.col("s") <= F.col("n"))).withColumn("_own", _level())


def _levels(df: DataFrame) -> list[int]:
    """The levels that boxes have, 30 numbers at most."""
    return sorted(r[0] for r in df.select("_own").distinct().collect() if r[0] is not None)


def _side(halved: dict[int, int]) -> Column:
    """The side of the cells on which boxes of the level ``_l`` meet."""
    return F.element_at(F.create_map(*[F.lit(x) for level, times in halved.items() for x in (level, 2.0 ** (level - times))]), F.col("_l"))


def _cells(df: DataFrame, halved: dict[int, int]) -> DataFrame:
    """Each box once for every cell of the level ``_l`` that it touches, with the first of them."""
    cell = lambda name: F.floor(F.col(name) / F.col("_side")).cast("long")
    df = df.withColumn("_side", _side(halved)).withColumns({"_cx0": cell("w"), "_cy0": cell("s")})
    return df.withColumn("_cx", F.explode(F.sequence("_cx0", cell("e")))).withColumn("_cy", F.explode(F.sequence("_cy0", cell("n"))))


def _at_levels(fine: DataFrame, levels: list[int], equal: bool) -> DataFrame:
    """Each fine box once for every level ``_l`` above its own, or for its own too."""
    above = F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda x: x >= F.col("_own") if equal else x > F.col("_own"))
    return fine.withColumn("_l", F.explode(above))


def _halved(fine: DataFrame, coarse: DataFrame, levels: list[int], equal: bool) -> dict[int, int]:
    """How often to halve the cells of each level, by counts of boxes in its cells of their own size.

    Halving divides the candidate pairs of a cell by four, as long as boxes are small against it, and
    adds rows: those with the smallest sum of both are chosen. So scattered boxes stay in four cells.
    """
    w, h = (F.col("e") - F.col("w")) / F.pow(F.lit(2.0), F.col("_l")), (F.col("n") - F.col("s")) / F.pow(F.lit(2.0), F.col("_l"))

    def counted(df: DataFrame, side: str) -> DataFrame:
        at = [F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_l"))).cast("long").alias(f"{side}{c}") for c in ("w", "s")]
        return df.select(F.col("_l").alias(f"{side}l"), *at, w.alias("x"), h.alias("y")).groupBy(f"{side}l", f"{side}w", f"{side}s").agg(F.count(F.lit(1)).alias(f"{side}n"), F.sum(F.col("x") + F.col("y")).alias(f"{side}sides"), F.sum(F.col("x") * F.col("y")).alias(f"{side}area"))

    a, b = counted(_at_levels(fine, levels, equal), "a"), counted(coarse.withColumn("_l", F.col("_own")), "b")
    sums = [F.sum(c).cast("double").alias(c) for c in ("an", "asides", "aarea", "bn", "bsides", "barea")]
    met = a.join(b, [F.col(f"a{c}") == F.col(f"b{c}") for c in ("l", "w", "s")]).groupBy("al").agg(F.sum(F.col("an").cast("double") * F.col("bn")).alias("pairs"), *sums)
    out = dict.fromkeys(levels, 0)
    for r in met.collect():

        def cost(k: int) -> float:
            rows = [r[f"{s}n"] + 2.0**k * r[f"{s}sides"] + 4.0**k * r[f"{s}area"] for s in "ab"]  # noqa: B023
            return r["pairs"] * (rows[0] / r["an"]) * (rows[1] / r["bn"]) / 4.0**k + ROW_COST * sum(rows)  # noqa: B023

        out[r["al"]] = min(range(HALVINGS + 1), key=cost)
    return out


def _sides(fine: DataFrame, coarse: DataFrame, equal: bool) -> tuple[DataFrame, DataFrame] | None:
    """Both sides in the cells where they meet; none if a side is empty."""
    fine, coarse = _upright(fine.select("id", "w", "s", "e", "n")), _upright(coarse.select("id", "w", "s", "e", "n"))
    levels = _levels(coarse)
    if not levels:
        return None
    halved = _halved(fine, coarse, levels, equal)
    return _cells(_at_levels(fine, levels, equal), halved), _cells(coarse.withColumn("_l", F.col("_own")), halved)


_HERE = ("_l", "_cx", "_cy")


def _met(fine: DataFrame, coarse: DataFrame, equal: bool) -> DataFrame:
    """Pairs (fine box, coarse box) that overlap, the coarse one of a larger level, or of an equal one too."""
    sides = _sides(fine, coarse, equal)
    if sides is None:
        return fine.join(coarse.select(F.col("id").alias("_coarse")), F.lit(False)).select(F.col("id").alias("_fine"), "_coarse")
    # not broadcast: a few files' worth of one side would stream in a few tasks
    a, b = sides[0].alias("a"), sides[1].hint("merge").alias("b")
    here = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in _HERE]
    first = [F.col(f"a.{c}") == F.greatest(F.col(f"a.{c}0"), F.col(f"b.{c}0")) for c in ("_cx", "_cy")]
    return a.join(b, [*here, *first, overlaps("a", "b")]).select(F.col("a.id").alias("_fine"), F.col("b.id").alias("_coarse"))


def overlap_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of boxes (id, w, s, e, n) that overlap: left_id, right_id, each pair once; boxes with null edges or turned round meet none.

    Boxes lie in cells of a grid of their own size, four at most, or where they crowd in finer ones,
    chosen by counts. A pair meets on the grid of its larger box, and is kept only in the
    cell that holds the corner where their common part starts, so no distinct is needed.
    """
    one = _met(left, right, True).select(F.col("_fine").alias("left_id"), F.col("_coarse").alias("right_id"))
    return one.unionByName(_met(right, left, False).select(F.col("_coarse").alias("left_id"), F.col("_fine").alias("right_id")))


def _covers() -> Column:
    """Whether a box covers its cell, edges included: then it overlaps whatever touches the cell."""
    x, y, side = F.col("_cx"), F.col("_cy"), F.col("_side")
    return (F.col("w") <= x * side) & (F.col("e") >= (x + 1) * side) & (F.col("s") <= y * side) & (F.col("n") >= (y + 1) * side)


def _least_of(df: DataFrame) -> DataFrame:
    return df.groupBy(*[F.col(c).alias(f"_k{c}") for c in _HERE]).agg(F.min("id").alias("_least"))


def _cell_of(least: DataFrame, df: DataFrame, how: str) -> DataFrame:
    return df.join(least.hint("merge"), [F.col(c) == F.col(f"_k{c}") for c in _HERE], how)


def first_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """For every left box the overlapping right box of the smallest id, or null.

    Pairs are not made only to be thrown away: of the right boxes that cover a cell only the smallest
    id counts there, and of the others only ids below it; where a left box covers a cell, the
    smallest id in it counts.
    """
    found = []
    sides = _sides(left, right, True)
    if sides is not None:
        a, b = sides
        b = _cell_of(_least_of(b.where(_covers())), b, "left").where(F.col("_least").isNull() | (F.col("id") <= F.col("_least")))
        found.append(_firsts(a, b))
    sides = _sides(right, left, False)
    if sides is not None:
        b, a = sides
        found.append(_cell_of(_least_of(b), a.where(_covers()), "inner").select(F.col("id").alias("_left"), F.col("_least").alias("_right")))
        found.append(_firsts(a.where(~_covers()), b))
    own = left.select(F.col("id").alias("left_id"))
    if not found:
        return own.join(right.select(F.col("id").alias("right_id")), F.lit(False), "left")
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return own.join(pairs.groupBy(F.col("_left").alias("left_id")).agg(F.min("_right").alias("right_id")), "left_id", "left")


def _firsts(left: DataFrame, right: DataFrame) -> DataFrame:
    """_left, _right: of the pairs that overlap in a cell."""
    a, b = left.alias("a"), right.hint("merge").alias("b")
    return a.join(b, [*[F.col(f"a.{c}") == F.col(f"b.{c}") for c in _HERE], overlaps("a", "b")]).select(F.col("a.id").alias("_left"), F.col("b.id").alias("_right"))


def points_in_boxes(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Points (id, lon, lat) inside boxes (id, w, s, e, n), edges included: point_id, box_id. A point on a shared edge is in both."""
    own = points.select("id", F.col("lon").alias("w"), F.col("lat").alias("s"), F.col("lon").alias("e"), F.col("lat").alias("n"))
    return _met(own, boxes, True).select(F.col("_fine").alias("point_id"), F.col("_coarse").alias("box_id"))


def feature_tiles(features: DataFrame, zoom: int) -> DataFrame:
    """Features (id, w, s, e, n) with every tile of a zoom that their box touches: id, z, x, y."""
    from tilequarry.operators import grid

    return grid.grid(features.withColumn("z", F.lit(zoom))).select("id", "z", "x", "y")


#: The finest zoom whose tiles, 4**8 at most, are broadcast when ancestors are looked up.
BROADCAST_ZOOM = 8


def coarser_fallback(wanted: DataFrame, available: DataFrame) -> DataFrame:
    """For every wanted tile (z, x, y) the finest available tile that contains it, itself included, or null: z, x, y, found_z.

    Ancestors are generated (a row for each zoom that is available) and met by an equi-join, so no
    range condition is left. Zooms up to BROADCAST_ZOOM, where many tiles share an ancestor, have 87,381
    tiles at most; they are broadcast, so no shared ancestor gathers rows in one task.
    """
    zooms = sorted(r[0] for r in available.select("z").distinct().collect() if r[0] is not None)
    own = wanted.select("z", "x", "y").distinct()
    if not zooms:
        return own.withColumn("found_z", F.lit(None).cast("int"))
    above = F.filter(F.array(*map(F.lit, zooms)), lambda k: k <= F.col("z"))
    up = own.withColumn("_z", F.explode_outer(above))
    up = up.withColumns({f"_{c}": tile.parent(F.col(c), F.col("z") - F.col("_z")) for c in ("x", "y")})
    have = available.select(F.col("z").alias("_z"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.lit(1).alias("_there")).distinct()
    low = F.coalesce(F.col("_z"), F.lit(0)) <= BROADCAST_ZOOM
    on = ["_z", "_x", "_y"]
    met = up.where(low).join(F.broadcast(have.where(low)), on, "left").unionByName(up.where(~low).join(have.where(~low), on, "left"))
    return met.groupBy("z", "x", "y").agg(F.max(F.when(F.col("_there") == 1, F.col("_z"))).alias("found_z"))


def as_of(values: DataFrame, keys: list, at: str) -> DataFrame:
    """Every row of ``values`` with the largest of a short list of keys that is not above ``at``, as asof; null if none is.

    Keys (the zooms of a style) are literals, searched in place; a table of keys is matched by ``as_of_rows``.
    """
    found = F.array_max(F.filter(F.array(*map(F.lit, sorted(set(keys)))), lambda k: k <= F.col(at))) if keys else F.lit(None)
    return values.withColumn("asof", found)


def as_of_rows(values: DataFrame, keys: DataFrame, by: list[str], at: str, key: str) -> DataFrame:
    """The same for keys in a table, matched within ``by``: both sides lie in one order and the last key seen counts.

    Without a column to match in, the order is one task's: give a coarse part of ``at`` then.
    """
    sides = values.withColumn("_at", F.col(at)).withColumn("_key", F.lit(None).cast(dict(keys.dtypes)[key])).withColumn("_own", F.lit(1))
    marks = keys.select(*by, F.col(key).alias("_at"), F.col(key).alias("_key"), F.lit(0).alias("_own"))
    w = Window.partitionBy(*by).orderBy("_at", "_own").rowsBetween(Window.unboundedPreceding, 0)
    both = sides.unionByName(marks, allowMissingColumns=True).withColumn("asof", F.last("_key", ignorenulls=True).over(w))
    return both.where("_own = 1").select(*values.columns, "asof")


def in_intervals(values: DataFrame, spans: DataFrame, by: list[str], at: str, low: str = "low", high: str = "high") -> DataFrame:
    """Every row of ``values`` whose ``at`` lies in [low, high) of a span, which do not overlap within ``by``, with the span's columns.

    The span that starts last at or before ``at`` is the only one that can hold it, so an as-of match replaces the range condition.
    """
    met = as_of_rows(values, spans, by, at, low)
    sided = spans.select(*[F.col(c).alias(f"_{c}") for c in spans.columns])
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by] + [F.col("asof") == F.col(f"_{low}"), F.col(at) < F.col(f"_{high}")]
    rest = [c for c in spans.columns if c not in by]
    return met.join(sided, on).select(*values.columns, *[F.col(f"_{c}").alias(c) for c in rest if c not in values.columns])


#: Centres that a centre may share its cell with, on average, where the search for nearest ones starts, and centres of one list.
CROWD, LISTED = 4, 256


def nearest(points: DataFrame, centres: DataFrame, degrees: float = 1.0) -> DataFrame:
    """For every point (id, lon, lat) the nearest centre by squared degrees, ties to the smaller id: point_id, centre_id, dist2.

    Cells of ``degrees``, or a power of four of it, that suit how crowded the centres are, grow fourfold
    from turn to turn. A centre is listed in its own cell and the eight around it, so a point looks into one
    cell, and leaves once its best centre is no further than one cell. A candidate is an item of a list, never
    a row; long lists are cut in parts. The last turn's cells hold all.
    """
    todo = points.select(F.col("id").alias("point_id"), "lon", "lat").where("lon is not null and lat is not null")
    c = centres.where("lon is not null and lat is not null").groupBy(F.col("lon").alias("clon"), F.col("lat").alias("clat")).agg(F.min("id").alias("centre_id"))
    sizes = [degrees * 4.0**i for i in range(-10, 1)]
    while sizes[-1] < 1024:
        sizes.append(sizes[-1] * 4)
    at = lambda name, size: F.floor(F.col(name) / size).cast("long")
    cells = c.withColumn("_size", F.explode(F.array(*map(F.lit, sizes)))).groupBy("_size", at("clon", F.col("_size")).alias("_x"), at("clat", F.col("_size")).alias("_y")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    stats = {r["_size"]: r for r in cells.groupBy("_size").agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("shared"), F.max("n").alias("most")).collect()}
    if not stats:
        return todo.limit(0).select("point_id", F.lit(None).cast("long").alias("centre_id"), F.lit(None).cast("double").alias("dist2"))
    start = max([i for i, size in enumerate(sizes) if stats[size]["shared"] <= CROWD], default=0)
    done, step = [], F.sequence(F.lit(-1), F.lit(1))
    for size in sizes[start:]:
        part = F.pmod(F.xxhash64("centre_id"), F.lit(-int(-9 * stats[size]["most"] // LISTED)))
        around = c.withColumn("_dx", F.explode(step)).withColumn("_dy", F.explode(step))
        listed = around.groupBy((at("clon", size) + F.col("_dx")).alias("_cx"), (at("clat", size) + F.col("_dy")).alias("_cy"), part.alias("_part")).agg(F.collect_list(F.struct("clon", "clat", "centre_id")).alias("_list"))
        d2 = lambda x: F.pow(F.col("lon") - x["clon"], 2) + F.pow(F.col("lat") - x["clat"], 2)
        own = F.array_min(F.transform("_list", lambda x: F.struct(d2(x).alias("dist2"), x["centre_id"].alias("centre_id"))))  # noqa: B023
        met = todo.join(listed, (at("lon", size) == F.col("_cx")) & (at("lat", size) == F.col("_cy")), "left").select("point_id", "lon", "lat", own.alias("b"))
        best = met.groupBy("point_id", "lon", "lat").agg(F.min("b").alias("b"))
        last = size >= 1024
        # a hair less than a cell, for cells whose edges are rounded
        sure = F.col("b").isNotNull() & (F.lit(last) | (F.sqrt("b.dist2") <= size * (1 - 1e-9)))
        done.append(best.where(sure))
        todo = best.where(~sure).select("point_id", "lon", "lat")
        if last or not todo.limit(1).count():
            break
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found.groupBy("point_id").agg(F.min("b").alias("b")).select("point_id", "b.centre_id", "b.dist2")


def gaps(rows: DataFrame, group: str, value: str, factor: float = 1.5) -> DataFrame:
    """Steps between neighbours of a group that exceed ``factor`` times its average: group, at, step."""
    w = Window.partitionBy(group).orderBy(value)
    stepped = rows.select(group, value).distinct().withColumn("step", F.lead(value).over(w) - F.col(value))
    mean = stepped.groupBy(group).agg(F.avg("step").alias("_mean"))
    return stepped.join(mean, group).where(F.col("step") > F.col("_mean") * factor).select(group, F.col(value).alias("at"), "step")

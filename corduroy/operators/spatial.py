"""Joins by place: intervals on routes, nearest points, radii, polylines. All are equi-joins on buckets, refined exactly."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.geo import EARTH_KM, edge_place
from ..session import steps
from .ranks import numbered


def interval_join(events: DataFrame, segments: DataFrame, key: str, at: str, low: str, high: str, seg_id: str, order: str, event_id: str, bucket: float) -> DataFrame:
    """events with the id of the first segment (in ``order``) of the same key whose [low, high] holds ``at``; null where none does.

    A segment is sent to each bucket that it overlaps, an event to its own: no range join without equality. Bounds are inclusive.
    """
    spans = segments.select(F.col(key), F.col(low).alias("_low"), F.col(high).alias("_high"), F.col(order).alias("_order"), F.col(seg_id).alias("_seg"), F.explode(F.sequence(F.floor(F.col(low) / bucket), F.floor(F.col(high) / bucket))).alias("_bucket"))
    placed = events.where(F.col(at).isNotNull()).select(event_id, key, at, F.floor(F.col(at) / bucket).alias("_bucket"))
    hits = placed.join(spans, [key, "_bucket"]).where((F.col(at) >= F.col("_low")) & (F.col(at) <= F.col("_high")))
    first = hits.groupBy(event_id).agg(F.min_by("_seg", F.struct("_order", "_seg")).alias(seg_id))
    return events.join(first, event_id, "left")


def _cells(df: DataFrame, x: str, y: str, size: float, reach: int = 0) -> DataFrame:
    cx, cy = F.floor(F.col(x) / size), F.floor(F.col(y) / size)
    if not reach:
        return df.withColumn("_cx", cx).withColumn("_cy", cy)
    return df.withColumn("_cx", F.explode(F.sequence(cx - reach, cx + reach))).withColumn("_cy", F.explode(F.sequence(cy - reach, cy + reach)))


def radius_pairs(left: DataFrame, right: DataFrame, left_xy: tuple[str, str], right_xy: tuple[str, str], radius: float, distance: Column | None = None, also: list[str] | None = None, tasks: int | None = None) -> DataFrame:
    """All pairs within the radius (inclusive), with ``_d``: planar distance, or the expression given.

    Cells are as wide as the radius and the right side goes to its 3 x 3 neighbours; ``also`` names further columns to join on.
    With ``tasks`` the cells are dealt to so many, where pairs are many times their events and sizes in bytes tell little.
    """
    a, b = _cells(left, *left_xy, radius), _cells(right, *right_xy, radius, reach=1)
    if tasks:
        a, b = (x.repartition(tasks, "_cx", "_cy", *(also or [])) for x in (a, b))
    d = F.hypot(F.col(left_xy[0]) - F.col(right_xy[0]), F.col(left_xy[1]) - F.col(right_xy[1])) if distance is None else distance
    return a.join(b, ["_cx", "_cy", *(also or [])]).withColumn("_d", d).where(F.col("_d") <= radius).drop("_cx", "_cy")


def _counted(df: DataFrame, x: str, y: str) -> DataFrame:
    """The places (x, y) of df, each once, with the number ``_n`` of rows there; rows without place are left out."""
    return df.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in (x, y))).groupBy(x, y).agg(F.count("*").alias("_n"))


def radius_counts(left: DataFrame, right: DataFrame, right_id: str, left_xy: tuple[str, str], right_xy: tuple[str, str], radius: float) -> DataFrame:
    """right_id and n, the left points within the radius of a right point, where there are any; pairs are those of places, not of points."""
    pairs = radius_pairs(_counted(left, *left_xy), _counted(right, *right_xy).drop("_n"), left_xy, right_xy, radius)
    n = pairs.groupBy(*right_xy).agg(F.sum("_n").alias("n"))
    return right.select(right_id, *right_xy).join(n, [*right_xy]).groupBy(right_id).agg(F.sum("n").alias("n"))


def radius_semi(left: DataFrame, right: DataFrame, left_xy: tuple[str, str], right_xy: tuple[str, str], radius: float) -> DataFrame:
    """left's rows with a right point within the radius; pairs are those of places, not of points."""
    pairs = radius_pairs(_counted(left, *left_xy).drop("_n"), _counted(right, *right_xy).drop("_n"), left_xy, right_xy, radius)
    return left.join(pairs.select(*left_xy).distinct(), [*left_xy], "left_semi")


def nearest_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_xy: tuple[str, str], right_xy: tuple[str, str], radius: float) -> DataFrame:
    """left with the id and distance of the nearest right point within the radius (ties: smaller id), null beyond it.

    However many points lie within the radius, a place meets the leaves near it only; see nearest_any.
    """
    return nearest_any(left, right, left_id, right_id, left_xy, right_xy, within=radius)


#: Points of a leaf at least, leaves at most (of which all tasks get the boxes, some 3 MB) and leaves under one box above them.
LEAF_POINTS, MOST_LEAVES, FANOUT = 64, 65_536, 256


def _leaves(points: DataFrame, x: str, y: str, key: str) -> tuple[DataFrame, list]:
    """points with ``leaf``, and the box (leaf, x0, y0, x1, y1) of each leaf in order of leaves.

    Points are sorted along a curve through a grid of 2 ** 24 columns and rows, in ranges, and cut into leaves of equal size: an
    outlier or a dense place changes the boxes' sizes, but never how many points one holds.
    """
    low = points.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"), F.count("*").alias("n")).first()

    def bits(c: str, least: float, most: float) -> Column:
        """The column's place in the grid with a zero bit after each of its bits."""
        v = F.floor((F.col(c) - least) / (most - least) * F.lit(float(2**24 - 1))) if most > least else F.lit(0).cast("long")
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    size = max(LEAF_POINTS, -(-low.n // MOST_LEAVES))
    coded = points.withColumn("_code", bits(x, low.x0, low.x1).bitwiseOR(F.shiftleft(bits(y, low.y0, low.y1), 1)))
    placed = numbered(coded, ["_code", x, y, key], "_i").withColumn("leaf", F.floor(F.col("_i") / size)).drop("_code", "_i")
    placed = steps(points.sparkSession)(placed, "leaves")
    boxes = placed.groupBy("leaf").agg(F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(x).alias("x1"), F.max(y).alias("y1"))
    return placed, sorted(tuple(r) for r in boxes.collect())  # MOST_LEAVES rows at most


def _bounds(x, y, x0, y0, x1, y1):
    """Least distance of a place to a box, and a distance within which something in it lies, as each side of a box touches something."""
    import numpy as np

    zero = np.zeros(1)
    least = np.hypot(np.maximum(zero, np.maximum(x0 - x, x - x1)), np.maximum(zero, np.maximum(y0 - y, y - y1)))
    ax, bx, ay, by = np.abs(x - x0), np.abs(x - x1), np.abs(y - y0), np.abs(y - y1)
    return least, np.minimum(np.hypot(np.minimum(ax, bx), np.maximum(ay, by)), np.hypot(np.maximum(ax, bx), np.minimum(ay, by)))


def near_leaves(x, y, boxes, slack: float = 0.0):
    """Numbers (i, k) of places and boxes that may hold a place's nearest neighbour, or one no farther than that by slack; in two levels."""
    import numpy as np

    starts = np.arange(0, len(boxes), FANOUT)
    above = np.concatenate([np.minimum.reduceat(boxes[:, :2], starts), np.maximum.reduceat(boxes[:, 2:], starts)], 1)
    least, within = _bounds(x[:, None], y[:, None], *above.T[:, None])
    i, j = np.nonzero(least <= within.min(1)[:, None] * (1 + 1e-9) + slack)
    n = np.minimum(starts[j] + FANOUT, len(boxes)) - starts[j]
    k = np.repeat(starts[j], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    i = np.repeat(i, n)
    least, within = _bounds(x[i], y[i], *boxes[k].T)
    first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
    best = np.repeat(np.minimum.reduceat(within, first), np.diff(np.append(first, len(i))))
    keep = least <= best * (1 + 1e-9) + slack
    return i[keep], k[keep]


def nearest_any(
    left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_xy: tuple[str, str], right_xy: tuple[str, str],
    within: float | None = None, scale: tuple[float, float, float] | None = None, digits: int | None = None,
) -> DataFrame:
    """left with the id and ``dist`` of the nearest right point at any distance (ties: smaller id); null without place or neighbours.

    Places count once, on the right with their smallest id, on the left for all rows there. Right ones are cut into leaves with
    boxes. A left place goes to the leaves whose box is no farther than the nearest point can be, one to three as a rule, and meets
    their points only. ``within`` bounds the distance; ``scale`` holds factors of x and y and of the distance; with ``digits``
    distances that round alike are equal.
    """
    right = right.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in right_xy)).groupBy(*right_xy).agg(F.min(right_id).alias(right_id))
    if right.isEmpty():
        return left.withColumn(right_id, F.lit(None).cast(right.schema[right_id].dataType)).withColumn("dist", F.lit(None).cast("double"))
    placed, found = _leaves(right, *right_xy, right_id)
    todo = _counted(left.select(*[F.col(c).cast("double").alias(c) for c in left_xy]), *left_xy).drop("_n")
    shared = left.sparkSession.sparkContext.broadcast(found)

    def meet(batches):
        import numpy as np

        by = np.array(scale[:2] if scale else (1.0, 1.0))
        boxes = np.array([b[1:] for b in shared.value], float) * np.tile(by, 2)
        slack = 10.0**-digits / (scale[2] if scale else 1.0) if digits is not None else 0.0
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                some = pdf.iloc[at : at + 512]
                i, k = near_leaves(some[left_xy[0]].to_numpy(float) * by[0], some[left_xy[1]].to_numpy(float) * by[1], boxes, slack)
                yield some.iloc[i].assign(leaf=k)

    sent = todo.mapInPandas(meet, T.StructType([*todo.schema.fields, T.StructField("leaf", T.LongType())]))
    dx, dy = (F.col(a) - F.col(b) for a, b in zip(left_xy, right_xy))
    d = F.hypot(dx, dy) if scale is None else F.sqrt((dx * scale[0]) * (dx * scale[0]) + (dy * scale[1]) * (dy * scale[1])) * scale[2]
    each = sent.join(placed, "leaf").withColumn("_d", d)
    each = each if within is None else each.where(F.col("_d") <= within)
    best = each.groupBy(*left_xy).agg(F.min(F.struct(("_d" if digits is None else F.round("_d", digits).alias("_r")), right_id, F.col("_d").alias("_dist"))).alias("_m"))
    found = best.select(*left_xy, F.col(f"_m.{right_id}").alias(right_id), F.col("_m._dist").alias("dist"))
    return left.join(found, [*left_xy], "left").select(left_id, *[c for c in left.columns if c != left_id], right_id, "dist")


def nearest_metres(left: DataFrame, right: DataFrame, left_id: str, right_id: str, limit_m: float = 2000.0, lat0: float = -10.0, digits: int | None = None) -> DataFrame:
    """left (lat, lon) with the id and ``dist_m`` of the nearest right point (lat2, lon2) in projected metres, null beyond the limit.

    With ``digits`` distances that round alike are equal. Longitudes are shortened by lat0, and distances taken before radians become metres.
    """
    a = left.withColumns({"_x": F.radians("lon"), "_y": F.radians("lat")})
    b = right.select(right_id, F.radians("lon2").alias("_u"), F.radians("lat2").alias("_v"))
    out = nearest_any(a, b, left_id, right_id, ("_x", "_y"), ("_u", "_v"), limit_m, (math.cos(math.radians(lat0)), 1.0, EARTH_KM * 1000), digits)
    return out.drop("_x", "_y").withColumnRenamed("dist", "dist_m")


def box_counts(left: DataFrame, right: DataFrame, left_id: str, left_xy: tuple[str, str], right_xy: tuple[str, str], half: float) -> DataFrame:
    """left_id and the number of right points within a square of +- half around it, zeros included; pairs are those of places."""
    a, b = _cells(_counted(left, *left_xy).drop("_n"), *left_xy, half), _cells(_counted(right, *right_xy), *right_xy, half, reach=1)
    inside = a.join(b, ["_cx", "_cy"]).where((F.abs(F.col(left_xy[0]) - F.col(right_xy[0])) <= half) & (F.abs(F.col(left_xy[1]) - F.col(right_xy[1])) <= half))
    n = inside.groupBy(*left_xy).agg(F.sum("_n").alias("n"))
    return left.select(left_id, *left_xy).join(n, [*left_xy], "left").select(left_id, F.coalesce("n", F.lit(0)).alias("n"))


def project_on_route(points: DataFrame, edges: DataFrame, point_id: str, route: str) -> DataFrame:
    """Nearest edge of the same route for each point (x, y): edges hold edge_id, km0, km1, x0, y0, x1, y1; gives km and dist.

    A route's edges are cut, in order of km0, into about as many stretches as each has edges, with a box around each. A point goes
    to the stretches whose box is no farther than its nearest edge can be. Equal distances (to nine decimals) go to the smaller
    edge_id; points without place or whose route has no edge are left out.
    """
    n = edges.groupBy(route).agg(F.count("*").alias("_n"))
    order = Window.partitionBy(route).orderBy("km0", "edge_id")
    placed = edges.join(n, route).withColumn("_leaf", F.floor((F.row_number().over(order) - 1) / F.ceil(F.sqrt("_n")))).drop("_n")
    placed = steps(edges.sparkSession)(placed, "edges")
    sides = (F.min(F.least("x0", "x1")).alias("x0"), F.min(F.least("y0", "y1")).alias("y0"), F.max(F.greatest("x0", "x1")).alias("x1"), F.max(F.greatest("y0", "y1")).alias("y1"))
    boxes = placed.groupBy(route, "_leaf").agg(*sides).groupBy(route).agg(F.collect_list(F.struct("_leaf", "x0", "y0", "x1", "y1")).alias("_boxes"))

    zero = F.lit(0.0)
    far = lambda c, a, b: F.greatest(F.abs(F.col(c) - a), F.abs(F.col(c) - b))
    near = lambda c, a, b: F.least(F.abs(F.col(c) - a), F.abs(F.col(c) - b))
    out = lambda c, a, b: F.greatest(zero, a - F.col(c), F.col(c) - b)
    least = lambda b: F.hypot(out("x", b["x0"], b["x1"]), out("y", b["y0"], b["y1"]))
    within = lambda b: F.least(F.hypot(near("x", b["x0"], b["x1"]), far("y", b["y0"], b["y1"])), F.hypot(far("x", b["x0"], b["x1"]), near("y", b["y0"], b["y1"])))
    known = points.where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)").select(point_id, route, "x", "y")
    bound = known.join(boxes, route).withColumn("_most", F.array_min(F.transform("_boxes", within)))
    sent = bound.select(point_id, route, "x", "y", F.explode(F.transform(F.filter("_boxes", lambda b: least(b) <= F.col("_most") * (1 + 1e-9) + 1e-9), lambda b: b["_leaf"])).alias("_leaf"))
    t, d = edge_place(F.col("x"), F.col("y"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    km = F.col("km0") + F.col("_t") * (F.col("km1") - F.col("km0"))
    each = sent.join(placed, [route, "_leaf"]).withColumn("_t", t).withColumn("_d", d)
    best = each.groupBy(point_id).agg(F.min(F.struct(F.round("_d", 9).alias("tie"), "edge_id", km.alias("km"), F.col("_d").alias("dist"))).alias("_m"))
    return best.select(point_id, "_m.edge_id", "_m.km", "_m.dist")


def first_containing(names: DataFrame, places: DataFrame) -> DataFrame:
    """names (name) with the first place (place, by ord) whose key contains the name or lies in it; null where none does.

    The shorter text begins with some three letters (or is shorter): the pairs that meet have them in common, and are then compared.
    """
    a, b = names.select("name").where("length(name) > 0").distinct(), places.select("key", "place", "ord").where("length(key) > 0")

    def start(c: str) -> Column:
        return F.substring(c, 1, 3)

    def grams(c: str) -> Column:
        def of(n: int) -> Column:
            return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - (n - 1))), lambda i: F.substring(F.col(c), i, F.lit(n)))

        return F.explode(F.array_distinct(F.concat(of(1), of(2), of(3))))

    inner = a.select("name", start("name").alias("g")).join(b.select("key", "place", "ord", grams("key").alias("g")), "g").where(F.col("key").contains(F.col("name")))
    outer = b.select("key", "place", "ord", start("key").alias("g")).join(a.select("name", grams("name").alias("g")), "g").where(F.col("name").contains(F.col("key")))
    best = inner.unionByName(outer).groupBy("name").agg(F.min_by("place", F.struct("ord", "place")).alias("place"))
    return names.join(best, "name", "left")

"""Route polylines: cumulative distance, resampling, windows, risk along the way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import haversine_km
from .live import near_route
from .spatial import nearest_metres


def cumulative(points: DataFrame) -> DataFrame:
    """points (route_id, i, lat, lon) with ``cum_km`` from the route's first point."""
    w = Window.partitionBy("route_id").orderBy("i")
    step = haversine_km(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    return points.withColumn("_s", F.coalesce(step, F.lit(0.0))).withColumn("cum_km", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def resample(points: DataFrame, step_km: float) -> DataFrame:
    """A point every step_km along each route by interpolation: route_id, k, km, lat, lon.

    Each edge makes the targets that lie on it, so no range join is needed.
    """
    w = Window.partitionBy("route_id").orderBy("i")
    edges = cumulative(points).select("route_id", F.col("cum_km").alias("a"), F.lead("cum_km").over(w).alias("b"), "lat", "lon", F.lead("lat").over(w).alias("lat2"), F.lead("lon").over(w).alias("lon2"), F.when(F.col("i") == F.min("i").over(Window.partitionBy("route_id")), True).otherwise(False).alias("first"))
    low = F.when(F.col("first"), F.lit(0)).otherwise(F.floor(F.col("a") / step_km) + 1)
    on = edges.where("b > a").withColumn("lo", low).withColumn("hi", F.floor(F.col("b") / step_km)).where("lo <= hi").withColumn("k", F.explode(F.sequence("lo", "hi")))
    t = (F.col("k") * step_km - F.col("a")) / (F.col("b") - F.col("a"))
    return on.select("route_id", "k", (F.col("k") * step_km).alias("km"), (F.col("lat") + t * (F.col("lat2") - F.col("lat"))).alias("lat"), (F.col("lon") + t * (F.col("lon2") - F.col("lon"))).alias("lon"))


def windows(places: DataFrame, km: str, width: float) -> DataFrame:
    """A row for each window (``win``) of the width that holds a place; a place on a boundary belongs to both sides."""
    at = F.floor(F.col(km) / width)
    both = F.when((F.col(km) % width == 0) & (at > 0), F.array(at - 1, at)).otherwise(F.array(at))
    return places.withColumn("win", F.explode(both))


def fewest(df: DataFrame, measures: dict[str, str]) -> DataFrame:
    """df with a flag for each label: whether the measure is the least of all (ties keep their flag)."""
    least = df.agg(*[F.min(c).alias(f"_{label}") for label, c in measures.items()])
    out = df.join(F.broadcast(least))  # one row
    return out.withColumns({label: F.col(c) == F.col(f"_{label}") for label, c in measures.items()}).drop(*[f"_{x}" for x in measures])


def live_penalty(score, factor, interrupted, restricted):
    """score * factor + 5 for each interruption + 1 for each restriction."""
    return score * factor + 5 * interrupted + restricted


def strided(points: DataFrame, n: int) -> DataFrame:
    """At most n points of each route (route_id, i), evenly spaced with both ends: those at round(j * (m - 1) / (n - 1))."""
    w = Window.partitionBy("route_id")
    at = points.withColumn("_i", F.row_number().over(w.orderBy("i")) - 1).withColumn("_m", F.count("*").over(w))
    if n < 2:
        return at.where("_i = 0").drop("_i", "_m")
    # place _i is picked if some j rounds to it: the first j from (_i - 0.5) * step on lies below (_i + 0.5) * step
    step = F.lit(n - 1) / (F.col("_m") - 1)
    j = F.ceil((F.col("_i") - 0.5) * step)
    hit = (F.col("_m") <= n) | ((j < (F.col("_i") + 0.5) * step) & (j <= n - 1)) | (F.col("_i") == F.col("_m") - 1)
    return at.where(hit).drop("_i", "_m")


def place_at_km(targets: DataFrame, points: DataFrame, tolerance_km: float = 5.0) -> DataFrame:
    """targets (id, route_id, km) with lat and lon on the route's polyline (route_id, i, lat, lon).

    A kilometre beyond the route's end is drawn to that end within the tolerance; further ones and unknown routes are null. Targets
    and edges meet in kilometres of whole tens, so a long route is not paired with itself.
    """
    w = Window.partitionBy("route_id").orderBy("i")
    c = cumulative(points).select("route_id", F.col("cum_km").alias("a"), F.lead("cum_km").over(w).alias("b"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), F.lead("lat").over(w).alias("lat2"), F.lead("lon").over(w).alias("lon2"))
    ends = cumulative(points).groupBy("route_id").agg(F.max("cum_km").alias("_end"))
    edges = c.where("b > a").withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("a") / 10), F.floor(F.col("b") / 10))))
    known = targets.join(ends, "route_id").where((F.col("km") >= -tolerance_km) & (F.col("km") <= F.col("_end") + tolerance_km))
    at = known.select("id", "route_id", F.least(F.greatest(F.col("km").cast("double"), F.lit(0.0)), F.col("_end")).alias("_km")).withColumn("_bucket", F.floor(F.col("_km") / 10))
    on = at.join(edges, ["route_id", "_bucket"]).where((F.col("_km") >= F.col("a")) & (F.col("_km") <= F.col("b")))
    t = (F.col("_km") - F.col("a")) / (F.col("b") - F.col("a"))
    place = F.struct("a", (F.col("lat1") + t * (F.col("lat2") - F.col("lat1"))).alias("lat"), (F.col("lon1") + t * (F.col("lon2") - F.col("lon1"))).alias("lon"))
    found = on.groupBy("id").agg(F.min(place).alias("_p")).select("id", "_p.lat", "_p.lon")
    return targets.join(found, "id", "left")


def route_risk(lengths: DataFrame, samples: DataFrame, events: DataFrame, alerts: DataFrame, tolls: DataFrame, radius_km: float) -> DataFrame:
    """A route's risk by kilometre, from what lies within the radius of its samples (route_id, s_lat, s_lon).

    lengths: route_id, longitud_km; events: id, lat, lon, peso, fuente; alerts: id, lat, lon, peso; tolls: id, lat, lon, aadt, peso.
    Gives n (events), n_a and n_b (those of the sources A and B), gravedad, n_alertas, n_peajes, aadt_max and score_km.
    """

    def near(points: DataFrame, *columns: str) -> DataFrame:
        return near_route(points, samples, radius_km).join(points.select("id", *columns), "id")

    e = near(events, "peso", "fuente").groupBy("route_id").agg(F.count("*").alias("n"), F.sum("peso").alias("gravedad"), F.count_if(F.col("fuente") == "A").alias("n_a"), F.count_if(F.col("fuente") == "B").alias("n_b"))
    a = near(alerts, "peso").groupBy("route_id").agg(F.count("*").alias("n_alertas"), F.sum("peso").alias("_alertas"))
    t = near(tolls, "aadt", "peso").groupBy("route_id").agg(F.count("*").alias("n_peajes"), F.sum("peso").alias("_trafico"), F.max("aadt").alias("aadt_max"))
    all_ = lengths.join(e, "route_id", "left").join(a, "route_id", "left").join(t, "route_id", "left")
    all_ = all_.na.fill(0, [c for c in all_.columns if c not in ("route_id", "longitud_km")])
    km = F.greatest(F.col("longitud_km"), F.lit(1e-6))
    score = (F.col("n") + 0.5 * F.col("gravedad")) / km + F.col("_alertas") / km + F.col("_trafico") / km
    return all_.withColumn("score_km", F.round(score, 4)).drop("_alertas", "_trafico")


def predicted_rate(samples: DataFrame, segments: DataFrame, limit_m: float = 2000.0, width_km: float = 5.0) -> DataFrame:
    """route_id, win, tasa and cobertura_pct: rates of the nearest segments (seg_id, lat2, lon2, tasa) along each route.

    samples: sample_id, route_id, lat, lon, km. A sample further from any segment than the limit has no rate; win -1 is the whole route.
    """
    snapped = nearest_metres(samples, segments, "sample_id", "seg_id", limit_m).join(segments.select("seg_id", "tasa"), "seg_id", "left")
    each = windows(snapped, "km", width_km).select("route_id", "win", "tasa").unionByName(snapped.select("route_id", F.lit(-1).cast("long").alias("win"), "tasa"))
    return each.groupBy("route_id", "win").agg(F.round(F.coalesce(F.avg("tasa"), F.lit(0.0)), 4).alias("tasa"), F.round(100.0 * F.count("tasa") / F.count("*"), 1).alias("cobertura_pct"))


def synthetic_points(segments: DataFrame) -> DataFrame:
    """A point every kilometre or so of each segment (seg_id, lon0, lat0, lon1, lat1, longitud_km, total): seg_id, i, lat, lon, peso.

    A segment has as many points as whole kilometres, one at least; its total is shared among them alike.
    """
    n = F.greatest(F.lit(1), F.floor("longitud_km")).cast("int")
    at = segments.withColumn("_n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    t = F.col("i") / F.col("_n")
    return at.select("seg_id", F.col("i").cast("long").alias("i"), (F.col("lat0") + t * (F.col("lat1") - F.col("lat0"))).alias("lat"), (F.col("lon0") + t * (F.col("lon1") - F.col("lon0"))).alias("lon"), (F.col("total") / F.col("_n")).alias("peso"))


def sinuosity_by_route(points: DataFrame, route: str) -> DataFrame:
    """route and ``s``: path length over the straight distance of its ends (points: x, y in order of i); null for a closed path."""
    w = Window.partitionBy(route).orderBy("i")
    steps = points.withColumn("_s", F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)))
    p = F.struct("x", "y")
    ends = steps.groupBy(route).agg(F.sum("_s").alias("_path"), F.min_by(p, "i").alias("_a"), F.max_by(p, "i").alias("_b"), F.count("*").alias("_n")).where("_n > 1")
    straight = F.hypot(F.col("_b.x") - F.col("_a.x"), F.col("_b.y") - F.col("_a.y"))
    return ends.select(route, F.try_divide(F.col("_path"), F.nullif(straight, F.lit(0.0))).alias("s"))

"""Live alerts, citizen reports and weather warnings against routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import KM_PER_DEGREE, edge_place, haversine_km, in_box
from ..functions.text import clip_text
from .spatial import radius_pairs


def fresh(df: DataFrame, stamp: str, now: str, seconds: int) -> DataFrame:
    """Rows whose stamp is less than so many seconds before ``now`` (a cache's time to live)."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col(stamp).cast("timestamp"))
    return df.where((age >= 0) & (age < seconds))


def fresh_by(df: DataFrame, stamp: str, now: str, source: str, seconds: dict[str, int]) -> DataFrame:
    """fresh() with a time to live for each source; rows of other sources are not kept."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col(stamp).cast("timestamp"))
    limit = F.create_map(*[F.lit(x) for kv in seconds.items() for x in kv])[F.col(source)]
    return df.where((age >= 0) & (age < limit))


def recent(df: DataFrame, stamp: str, now: str, days: int) -> DataFrame:
    return df.where(F.col(stamp).cast("timestamp") >= F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days)))


def check_reports(reports: DataFrame, kinds: list[str], severities: list[str], box: tuple[float, float, float, float]) -> DataFrame:
    """reports (tipo, severidad, descripcion, lat, lon) with ``motivo``, null where accepted; text clipped, severity defaulted."""
    text = clip_text(F.col("descripcion"))
    reason = (
        F.when(~F.coalesce(F.col("tipo").isin(kinds), F.lit(False)), "tipo")
        .when(F.col("lat").isNull() | F.col("lon").isNull() | ~in_box(F.col("lat"), F.col("lon"), box), "posicion")
        .when(F.coalesce(F.length(text), F.lit(0)) < 5, "descripcion")
    )
    severity = F.when(F.col("severidad").isin(severities), F.col("severidad")).otherwise(severities[0])
    return reports.withColumn("motivo", reason).withColumn("descripcion", text).withColumn("severidad", severity)


def repeated_reports(reports: DataFrame, radius_km: float, seconds: int) -> DataFrame:
    """reports (id, tipo, lat, lon, t in seconds) with ``repeated``: whether a smaller id of the type lies near in place and time.

    Distances are exact, also across the edges of the cells and of the spans of time in which candidates meet.
    """
    r = reports.select("id", "tipo", "lat", "lon", "t", F.floor(F.col("t") / seconds).alias("span"))
    old = r.select(F.col("id").alias("o_id"), "tipo", F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"), F.col("t").alias("o_t"), F.explode(F.array(F.col("span") - 1, F.col("span"), F.col("span") + 1)).alias("span"))
    pairs = radius_pairs(r, old, ("lat", "lon"), ("o_lat", "o_lon"), radius_km / KM_PER_DEGREE * 2, also=["tipo", "span"])
    far = haversine_km(F.col("o_lat"), F.col("o_lon"), F.col("lat"), F.col("lon"))
    hit = pairs.where((F.col("o_id") < F.col("id")) & (F.abs(F.col("t") - F.col("o_t")) <= seconds) & (far <= radius_km))
    return reports.join(hit.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left").withColumn("repeated", F.coalesce("_hit", F.lit(False))).drop("_hit")


def report_statistics(reports: DataFrame, stamp: str, day: str) -> DataFrame:
    return reports.agg(F.count("*").alias("total"), F.count_if(F.to_date(stamp) == F.lit(day).cast("date")).alias("hoy"), F.count_if(F.col("foto").isNotNull()).alias("con_foto"))


def parse_title(title: Column) -> dict[str, Column]:
    """Date (dd/mm/yyyy), hour, place after the last dash, and the district and province in it."""
    place = F.trim(F.substring_index(F.regexp_replace(title, "[–—]", "-"), "-", -1))
    return {
        "fecha": F.try_to_timestamp(F.regexp_extract(title, "(\\d{1,2}/\\d{1,2}/\\d{4})", 1), F.lit("d/M/yyyy")).cast("date"),
        "hora": F.nullif(F.regexp_extract(title, "(\\d{1,2}:\\d{2})", 1), F.lit("")),
        "lugar": place,
        "distrito": F.nullif(F.regexp_extract(place, "(?i)distrito de ([^,]+)", 1), F.lit("")),
        "provincia": F.nullif(F.regexp_extract(place, "(?i)provincia de ([^,]+)", 1), F.lit("")),
    }


def near_route(points: DataFrame, samples: DataFrame, radius_km: float, point_id: str = "id") -> DataFrame:
    """points (id, lat, lon) within the radius of a route's samples (route_id, s_lat, s_lon): with dist_km, the least for each route.

    Cells are sized for the radius at 60 degrees of latitude, so that none is missed below it.
    """
    reach = radius_km / KM_PER_DEGREE * 2
    pairs = radius_pairs(points.select(point_id, "lat", "lon"), samples.select("route_id", "s_lat", "s_lon"), ("lat", "lon"), ("s_lat", "s_lon"), reach)
    d = haversine_km(F.col("lat"), F.col("lon"), F.col("s_lat"), F.col("s_lon"))
    return pairs.withColumn("dist_km", d).where(F.col("dist_km") <= radius_km).groupBy("route_id", point_id).agg(F.min("dist_km").alias("dist_km"))


def _inside(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd test of a point against a closed ring of structs (x, y)."""
    n = F.size(ring)

    def crossed(t: Column, i: Column) -> Column:
        a, b = F.element_at(ring, i), F.element_at(ring, i % n + 1)
        at = (b["x"] - a["x"]) * F.try_divide(y - a["y"], b["y"] - a["y"]) + a["x"]
        return t + F.when(((a["y"] > y) != (b["y"] > y)) & (x < at), 1).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), crossed) % 2 == 1


def warnings_on_route(polygons: DataFrame, samples: DataFrame, buffer_deg: float) -> DataFrame:
    """(polygon_id, route_id) where a sample lies in a polygon (ring) or within the buffer of one of its edges.

    Polygons are sent to the one-degree cells that their buffered boxes touch; only those pairs are tested.
    """
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    box = polygons.select("polygon_id", "ring", (F.array_min(xs) - buffer_deg).alias("x0"), (F.array_max(xs) + buffer_deg).alias("x1"), (F.array_min(ys) - buffer_deg).alias("y0"), (F.array_max(ys) + buffer_deg).alias("y1"))
    cells = box.withColumn("cx", F.explode(F.sequence(F.floor("x0"), F.floor("x1")))).withColumn("cy", F.explode(F.sequence(F.floor("y0"), F.floor("y1"))))
    at = samples.select("route_id", F.col("s_lon").alias("x"), F.col("s_lat").alias("y"), F.floor("s_lon").alias("cx"), F.floor("s_lat").alias("cy"))
    near = at.join(cells, ["cx", "cy"]).where((F.col("x").between(F.col("x0"), F.col("x1"))) & (F.col("y").between(F.col("y0"), F.col("y1"))))
    n = F.size("ring")

    def close(i: Column) -> Column:
        a, b = F.element_at("ring", i), F.element_at("ring", i % n + 1)
        return edge_place(F.col("x"), F.col("y"), a["x"], a["y"], b["x"], b["y"])[1] <= buffer_deg

    hit = _inside(F.col("x"), F.col("y"), F.col("ring")) | F.exists(F.sequence(F.lit(1), n), close)
    return near.where(hit).select("polygon_id", "route_id").distinct()


def claims(rows: list[tuple[str, bool | None, str, str]], spark) -> DataFrame:
    """A table of checked claims: claim, verdict (SI, NO or NO CONCLUYENTE), evidence, limit."""
    say = {True: "SI", False: "NO", None: "NO CONCLUYENTE"}
    return spark.createDataFrame([(c, say[v], e, limit) for c, v, e, limit in rows], "claim string, verdict string, evidence string, `limit` string")


def weather_warnings(features: DataFrame) -> DataFrame:
    """polygon_id, nivel, fecha, descripcion, recomendaciones, responsable and ring of GeoJSON features (polygon_id, feature: JSON).

    The ring is the outer one of the first polygon, as warnings_on_route takes it; features without a polygon give no row, absent
    texts are empty.
    """
    names = {"nivel": ["nivel"], "fecha": ["fecha"], "descripcion": ["descripcio", "descripcion"], "recomendaciones": ["recomendac"], "responsable": ["respons"]}
    properties = ", ".join(f"{x}: string" for xs in names.values() for x in xs)
    kinds = {"_one": "array<array<array<double>>>", "_many": "array<array<array<array<double>>>>"}
    shape = F.get_json_object("feature", "$.geometry.type")
    at = F.get_json_object("feature", "$.geometry.coordinates")
    parsed = features.withColumn("_p", F.from_json(F.get_json_object("feature", "$.properties"), f"struct<{properties}>"))
    parsed = parsed.withColumn("_one", F.when(shape == "Polygon", F.from_json(at, kinds["_one"]))).withColumn("_many", F.when(shape == "MultiPolygon", F.from_json(at, kinds["_many"])))
    outer = F.coalesce(F.get("_one", F.lit(0)), F.get(F.get("_many", F.lit(0)), F.lit(0)))
    ring = F.transform(outer, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    texts = [F.coalesce(*[F.col(f"_p.{x}") for x in xs], F.lit("")).alias(name) for name, xs in names.items()]
    return parsed.select("polygon_id", *texts, ring.alias("ring")).where(F.size("ring") > 0)


def route_forecast(answers: DataFrame) -> DataFrame:
    """A row per route from the forecasts at its points (route_id, i, body: JSON with daily arrays): the extremes over days and points.

    Points without days don't count but in ``puntos``; the date is the first day of the last point that has one; routes without any
    forecast give no row.
    """
    names = {"lo": "temperature_2m_min", "hi": "temperature_2m_max", "rain": "precipitation_probability_max", "wind": "wind_speed_10m_max"}
    daily = F.from_json(F.get_json_object("body", "$.daily"), f"struct<time: array<string>, {', '.join(f'{x}: array<double>' for x in names.values())}>")
    each = answers.withColumn("_d", daily).withColumn("_ok", F.coalesce(F.size("_d.time"), F.lit(0)) > 0)
    known = lambda x: F.when(F.col("_ok"), x)
    rows = each.select(
        "route_id", "i", "_ok", known(F.array_min(f"_d.{names['lo']}")).alias("lo"), known(F.array_max(f"_d.{names['hi']}")).alias("hi"),
        known(F.coalesce(F.array_max(f"_d.{names['rain']}"), F.lit(0.0))).alias("rain"), known(F.coalesce(F.array_max(f"_d.{names['wind']}"), F.lit(0.0))).alias("wind"), known(F.get("_d.time", F.lit(0))).alias("day"),
    )
    out = rows.groupBy("route_id").agg(
        F.max_by("day", F.when(F.col("_ok"), F.col("i"))).alias("fecha"), F.round(F.min("lo"), 1).alias("tmin_c"), F.round(F.max("hi"), 1).alias("tmax_c"),
        F.max("rain").cast("int").alias("precip_prob_max"), F.round(F.max("wind"), 1).alias("viento_max_kmh"), F.count("*").alias("puntos"), F.max("_ok").alias("_any"),
    )
    return out.where("_any").drop("_any")

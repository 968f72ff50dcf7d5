"""Quality, cleaning, matching, panels, estimates, models, routes and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import cleaning as C
from ..operators import matching as M
from ..operators import models as G
from ..operators import panel as P
from ..operators import quality as Q
from ..operators import routes as R
from ..operators import spatial as S
from ..operators.ranks import every_nth
from ..session import shared_folder, steps
from .base import DIRTY, NATION_ROADS, POINTS, ROAD_EVENTS, SEGMENTS, SOURCE, TOLLS, query, r6, rows, table

AS_OF = "2000-06-30"
CONTRACT = {
    "columns": {
        "code": {"type": "integer", "nullable": False, "unique": True},
        "fecha": {"type": "datetime", "nullable": False, "max_date": "2001-01-01", "max_before_today_days": 10},
        "clase": {"type": "string", "allowed_values": ["1-Urgent", "2-High", "3-Medium", "5-Low"], "max_length": 10},
        "estado": {"type": "string", "pattern": "[FO]"},
        "fallecidos": {"type": "integer", "min": 0, "max": 5},
        "velocidad": {"type": "integer", "max": 300},
        "ausente": {"type": "string"},
    }
}
RULES = [
    {"name": "pk_unique", "kind": "pk_unique", "column": "code", "order": "row_id", "severity": "critical"},
    {"name": "fecha_parsable", "kind": "fecha_parsable", "column": "fecha", "severity": "critical"},
    {"name": "fecha_no_futura", "kind": "fecha_no_futura", "column": "fecha", "severity": "warning"},
    {"name": "coordenadas", "kind": "coordenadas", "columns": ["lat", "lon"], "box": (-18.5, 0.2, -81.5, -68.5), "severity": "warning"},
    {"name": "contadores", "kind": "no_negativos", "columns": ["fallecidos"], "severity": "critical"},
    {"name": "clase_catalogo", "kind": "catalogo", "column": "clase", "values": ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"], "severity": "warning"},
    {"name": "velocidad_rango", "kind": "rango", "column": "velocidad", "min": 1, "max": 300, "severity": "warning"},
]
FLAGS = f"""SELECT row_id, row_number() OVER (PARTITION BY code ORDER BY row_id) > 1 AS pk, fecha IS NULL AS sin, coalesce(fecha > DATE '{AS_OF}', FALSE) AS fut,
  NOT (lat BETWEEN -18.5 AND 0.2 AND lon BETWEEN -81.5 AND -68.5) AS geo, coalesce(fallecidos < 0, FALSE) AS neg,
  coalesce(upper(clase) NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW'), FALSE) AS cat, velocidad > 300 OR velocidad < 1 AS vel FROM ({DIRTY})"""
VIOLATIONS = " UNION ALL ".join(
    f"SELECT row_id, '{name}' AS rule, '{col}' AS \"column\", '{sev}' AS severity FROM f WHERE {flag}"
    for name, col, sev, flag in (("pk_unique", "code", "critical", "pk"), ("fecha_parsable", "fecha", "critical", "sin"), ("fecha_no_futura", "fecha", "warning", "fut"), ("coordenadas", "lat,lon", "warning", "geo"), ("contadores", "fallecidos", "critical", "neg"), ("clase_catalogo", "clase", "warning", "cat"), ("velocidad_rango", "velocidad", "warning", "vel"))
)
SPEC = {"required": ["code", "fecha", "clase", "fallecidos"], "ranges": {"fallecidos": (0, 5), "velocidad": (1, 300)}, "catalogs": {"clase": ["1-URGENT", "2-HIGH", "3-MEDIUM"]}, "key": "code", "nominal": ["clase", "estado"], "date": "fecha", "window_days": 365}
DIMENSIONS = f"""SELECT round(100.0::DOUBLE * (count(code) + count(fecha) + count(clase) + count(fallecidos)) / 4 / count(*), 2) AS completeness,
  round((100.0 * avg(CASE WHEN fallecidos IS NOT NULL THEN CAST(fallecidos BETWEEN 0 AND 5 AS INT) END) + 100.0 * avg(CAST(velocidad BETWEEN 1 AND 300 AS INT)) + 100.0 * avg(CASE WHEN clase IS NOT NULL THEN CAST(upper(clase) IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AS INT) END)) / 3, 2) AS validity,
  round(100.0::DOUBLE * (1 - (count(*) - count(DISTINCT code))::DOUBLE / count(*)), 2) AS uniqueness,
  round((100.0 * avg(CASE WHEN clase IS NOT NULL THEN CAST(clase = upper(clase) AS INT) END) + 100.0) / 2, 2) AS consistency, 100.0::DOUBLE AS integrity,
  round(100.0 * avg(CASE WHEN fecha IS NOT NULL THEN CAST(fecha >= DATE '{AS_OF}' - 365 AS INT) END), 2) AS freshness FROM ({DIRTY})"""
DQS = "round(0.22 * completeness + 0.22 * validity + 0.15 * uniqueness + 0.15 * consistency + 0.18 * integrity + 0.08 * freshness, 2)"


@query(f"""WITH x AS ({DIRTY}), n AS (SELECT count(*) FILTER (WHERE fecha IS NULL) AS a, count(*) FILTER (WHERE fecha > DATE '{AS_OF}' - 10) AS b, count(*) FILTER (WHERE fecha > DATE '2001-01-01') AS c,
  count(*) FILTER (WHERE upper(clase) NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')) AS e, count(*) FILTER (WHERE length(clase) > 10) AS f, count(*) FILTER (WHERE NOT regexp_matches(estado, '^(?:[FO])')) AS g,
  count(*) FILTER (WHERE fallecidos < 0) AS h, count(*) FILTER (WHERE fallecidos > 5) AS i, count(*) FILTER (WHERE velocidad > 300) AS j, count(*) - count(DISTINCT code) AS k FROM x)
SELECT "column", rule, CAST(n AS BIGINT) AS n FROM (SELECT unnest(['fecha', 'fecha', 'fecha', 'clase', 'clase', 'estado', 'fallecidos', 'fallecidos', 'velocidad', 'code', 'ausente']) AS "column",
  unnest(['nullable', 'max_before_today_days', 'max_date', 'allowed_values', 'max_length', 'pattern', 'min', 'max', 'max', 'unique', 'missing']) AS rule, unnest([a, b, c, e, f, g, h, i, j, k, 1]) AS n FROM n) WHERE n > 0""")
def f_contract_report(spark, d):
    return Q.contract_report(rows(spark, d, DIRTY), CONTRACT, AS_OF)


@query(f"WITH f AS ({FLAGS}) SELECT rule, \"column\", severity, CAST(count(*) AS BIGINT) AS n FROM ({VIOLATIONS}) GROUP BY 1, 2, 3")
def f_domain_rules(spark, d):
    return Q.violation_table(Q.violations(rows(spark, d, DIRTY), RULES, "row_id", AS_OF))


@query(f"WITH f AS ({FLAGS}) SELECT sha256(concat_ws(':', 'orders', CAST(row_id AS VARCHAR), rule)) AS quarantine_id, row_id, rule FROM ({VIOLATIONS}) WHERE severity = 'critical'")
def sk_quarantine_records(spark, d):
    df = rows(spark, d, DIRTY)
    return Q.quarantine(df, Q.violations(df, RULES, "row_id", AS_OF), "row_id", "orders").drop("record")


@query(f"SELECT *, {DQS} AS dqs FROM ({DIMENSIONS})")
def q_dqs(spark, d):
    return Q.dimensions(rows(spark, d, DIRTY), SPEC, AS_OF)


@query(f"""WITH f AS ({FLAGS}), v AS ({VIOLATIONS})
SELECT dqs, critical, CASE WHEN critical > 0 THEN 'FAILED' WHEN dqs < 90 THEN 'WARNING' ELSE 'PASSED' END AS gate
FROM (SELECT {DQS} AS dqs FROM ({DIMENSIONS})), (SELECT CAST(count(*) AS BIGINT) AS critical FROM v WHERE severity = 'critical')""")
def q_gate(spark, d):
    df = rows(spark, d, DIRTY)
    critical = Q.violations(df, RULES, "row_id", AS_OF).where("severity = 'critical'").agg(F.count("*").alias("critical"))
    both = Q.dimensions(df, SPEC, AS_OF).select("dqs").join(F.broadcast(critical))  # one row each
    return both.withColumn("gate", Q.gate_column(F.col("dqs"), F.col("critical")))


SCENARIOS = {
    "uniforme": dict.fromkeys(Q.WEIGHTS, 1 / 6),
    "frescura": {k: 0.5 if k == "freshness" else 0.1 for k in Q.WEIGHTS},
}


@query(f"""WITH d AS (SELECT *, {DQS} AS dqs FROM ({DIMENSIONS})), s AS (
  SELECT 'uniforme' AS scenario, round((completeness + validity + uniqueness + consistency + integrity + freshness) / 6, 2) AS x, dqs FROM d
  UNION ALL SELECT 'frescura', round(0.1 * (completeness + validity + uniqueness + consistency + integrity) + 0.5 * freshness, 2), dqs FROM d)
SELECT scenario, x AS dqs, round(x - dqs, 2) AS delta FROM s""")
def q_scenarios(spark, d):
    return Q.weight_scenarios(Q.dimensions(rows(spark, d, DIRTY), SPEC, AS_OF), SCENARIOS)


@query("SELECT round(100.0 * count(c_custkey) / count(*), 2) AS integrity FROM (SELECT CASE WHEN o_orderkey % 11 = 0 THEN -1 ELSE o_custkey END AS fk FROM orders) LEFT JOIN customer ON fk = c_custkey")
def q_integrity(spark, d):
    o = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 11 == 0, -1).otherwise(F.col("o_custkey")).alias("fk"))
    return Q.integrity_share(o, "fk", table(spark, d, "customer"), "c_custkey")


@query("""WITH a AS (SELECT DISTINCT n_name FROM nation WHERE n_nationkey < 20), b AS (SELECT n_name FROM nation WHERE n_nationkey > 4)
SELECT round(100.0 * (SELECT count(*) FROM a WHERE n_name IN (SELECT n_name FROM b)) / (SELECT count(*) FROM a), 4) AS circularidad""")
def q_circularity(spark, d):
    n = table(spark, d, "nation")
    return A.overlap(n.where("n_nationkey < 20"), n.where("n_nationkey > 4"), "n_name")


@query("SELECT dataset, fingerprint, n_runs, dqs_range, CASE WHEN n_runs < 2 THEN 'insufficient' WHEN dqs_range <= 40 THEN 'stable' ELSE 'drift' END AS verdict FROM (SELECT r_name AS dataset, CAST(n_nationkey % 2 AS BIGINT) AS fingerprint, CAST(count(*) AS BIGINT) AS n_runs, round(max(q) - min(q), 4) AS dqs_range FROM (SELECT r_name, n_nationkey, CAST(n_nationkey * 7 % 50 AS DOUBLE) AS q FROM nation JOIN region ON n_regionkey = r_regionkey) GROUP BY 1, 2)")
def w_drift_range(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    runs = n.select(F.col("r_name").alias("dataset"), (F.col("n_nationkey") % 2).cast("long").alias("fingerprint"), (F.col("n_nationkey") * 7 % 50).cast("double").alias("dqs"))
    return Q.run_drift(runs, tolerance=40.0)


PROFILED = ["row_id", "fecha", "clase", "fallecidos"]


def _profile_sql(column: str, number: bool) -> str:
    x = f"CAST({column} AS DOUBLE)" if number else "CAST(NULL AS DOUBLE)"
    q = f"quantile_cont({x}, 0.25) AS q25, quantile_cont({x}, 0.75) AS q75" if number else "NULL AS q25, NULL AS q75"
    kind = {"row_id": "bigint", "fecha": "date", "clase": "string", "fallecidos": "bigint"}[column]
    top = f"""(SELECT list(v) FROM (SELECT CAST({column} AS VARCHAR) AS v FROM x WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3))"""
    return f"""SELECT '{column}' AS "column", '{kind}' AS dtype, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) - count({column}) AS BIGINT) AS n_null,
      round(100.0 * (count(*) - count({column})) / count(*), 2) AS pct_null, CAST(count(DISTINCT {column}) AS BIGINT) AS n_unique,
      min({x}) AS min, max({x}) AS max, round(avg({x}), 4) AS mean, round(stddev_samp({x}), 4) AS std, {q}, array_to_string({top}, '|') AS top FROM x"""


@query(f"WITH x AS ({DIRTY}) " + " UNION ALL ".join(_profile_sql(c, c in ("row_id", "fallecidos")) for c in PROFILED))
def a_profile(spark, d):
    p = Q.profile(rows(spark, d, DIRTY).select(*PROFILED), top=3)
    return p.withColumn("top", F.array_join("top_values", "|")).drop("top_values")


@query("SELECT 'o_orderpriority' AS \"column\", o_orderpriority AS value, CAST(count(*) AS BIGINT) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM orders GROUP BY 2 QUALIFY row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) <= 3")
def a_topk_pct(spark, d):
    return Q.top_values(table(spark, d, "orders"), ["o_orderpriority"], 3)


@query(f"SELECT 'fallecidos' AS \"column\", CAST(count(*) - count(fallecidos) AS BIGINT) AS null_before, CAST(0 AS BIGINT) AS null_after FROM ({DIRTY}) UNION ALL SELECT 'clase', count(*) - count(clase), 0 FROM ({DIRTY})")
def q_null_delta(spark, d):
    df = rows(spark, d, DIRTY).select("clase", "fallecidos")
    return C.change_log(df, C.impute(df, {"fallecidos": "median", "clase": "mode"}))


@query(f"SELECT row_id, coalesce(CAST(fallecidos AS DOUBLE), (SELECT quantile_cont(fallecidos, 0.5) FROM ({DIRTY}))) AS fallecidos FROM ({DIRTY})")
def c_impute_median(spark, d):
    return C.impute(rows(spark, d, DIRTY).select("row_id", F.col("fallecidos").cast("double").alias("fallecidos")), {"fallecidos": "median"})


@query(f"SELECT row_id, coalesce(clase, (SELECT clase FROM ({DIRTY}) WHERE clase IS NOT NULL GROUP BY clase ORDER BY count(*) DESC, clase LIMIT 1)) AS clase FROM ({DIRTY})")
def c_impute_mode(spark, d):
    return C.impute(rows(spark, d, DIRTY).select("row_id", "clase"), {"clase": "mode"})


@query(f"WITH x AS (SELECT row_id, code, upper(clase) AS tipo, CAST(velocidad AS DOUBLE) AS velocidad, coalesce(fallecidos, 0) AS fallecidos, row_number() OVER (PARTITION BY code ORDER BY row_id) AS n FROM ({DIRTY})) SELECT row_id, code, tipo, velocidad, fallecidos FROM x WHERE n = 1")
def c_clean_full(spark, d):
    df = rows(spark, d, DIRTY).select("row_id", "code", "clase", F.concat(F.col("velocidad").cast("string"), F.lit("°")).alias("velocidad"), "fallecidos", "estado")
    return C.clean(df, {"rename": {"clase": "tipo"}, "drop": ["estado"], "fold": ["tipo"], "numeric": ["velocidad"], "impute": {"fallecidos": ("constant", 0)}, "key": ["code"], "order": "row_id"})


PANEL = f"""WITH s AS ({SEGMENTS}), e AS (SELECT e.event_id, min(s.seg_id) AS seg_id, CAST(2020 + e.event_id % 5 AS BIGINT) AS anio, CAST(e.event_id % 3 AS BIGINT) AS f FROM ({ROAD_EVENTS}) e JOIN s ON e.ruta = s.ruta AND e.km BETWEEN s.km0 AND s.km1 GROUP BY 1, 3, 4),
p AS (SELECT s.seg_id, y.anio, s.long_km, CAST(count(e.event_id) AS BIGINT) AS n_eventos, CAST(coalesce(sum(e.f), 0) AS BIGINT) AS n_fallecidos FROM s CROSS JOIN (SELECT unnest([2020, 2021, 2022, 2023, 2024])::BIGINT AS anio) y LEFT JOIN e ON e.seg_id = s.seg_id AND e.anio = y.anio GROUP BY 1, 2, 3)"""


def _panel(spark, d):
    s = rows(spark, d, SEGMENTS)
    e = S.interval_join(rows(spark, d, ROAD_EVENTS).select("event_id", "ruta", "km"), s, "ruta", "km", "km0", "km1", "seg_id", "seg_id", "event_id", 25.0)
    e = e.select("seg_id", (2020 + F.col("event_id") % 5).alias("anio"), (F.col("event_id") % 3).alias("fallecidos"))
    return P.build_panel(s, [2020, 2021, 2022, 2023, 2024], e)


@query(PANEL + " SELECT seg_id, anio, n_eventos, n_fallecidos, long_km * 5 AS expo_km_anio, round(n_eventos / CAST(long_km AS DOUBLE), 6) AS densidad_anual FROM p")
def m_panel(spark, d):
    return _panel(spark, d).select("seg_id", "anio", "n_eventos", "n_fallecidos", "expo_km_anio", r6("densidad_anual").alias("densidad_anual"))


@query(PANEL + " SELECT CAST(count(*) AS BIGINT) AS n_cells, round(100.0 * count(*) FILTER (WHERE n_eventos = 0) / count(*), 4) AS pct_zero, CAST(sum(n_eventos) AS BIGINT) AS total, CAST(count(DISTINCT seg_id) AS BIGINT) AS n_segments FROM p")
def m_panel_summary(spark, d):
    return P.panel_summary(_panel(spark, d))


@query(PANEL + " SELECT seg_id, CAST(sum(n_eventos) AS BIGINT) AS total, round(avg(n_eventos), 6) AS media_anual, CAST(sum(n_fallecidos) AS BIGINT) AS fallecidos, CAST(count(*) FILTER (WHERE n_eventos > 0) AS BIGINT) AS anios_con_evento FROM p GROUP BY 1")
def m_panel_totals(spark, d):
    return P.panel_totals(_panel(spark, d))


LOO = f"""WITH s AS ({NATION_ROADS}), p AS (SELECT *, coalesce((sum(y) OVER (PARTITION BY region_id) - y)::DOUBLE / nullif(sum(km) OVER (PARTITION BY region_id) - km, 0), (sum(y) OVER () - y)::DOUBLE / nullif(sum(km) OVER () - km, 0), 0) AS prior FROM s)"""
EB = (
    LOO
    + """, m AS (SELECT sum(km * power(y / km::DOUBLE - prior, 2)) / sum(km) AS var, sum(prior) / sum(km) AS noise, sum(km * prior * prior) / sum(km) AS p2 FROM p WHERE km >= 1),
k AS (SELECT CASE WHEN var > noise THEN p2 / (var - noise) END AS k FROM m),
e AS (SELECT p.*, k.k, CASE WHEN k IS NULL THEN prior ELSE (y + k * prior) / (km + k) END AS eb FROM p, k)"""
)


def _eb(spark, d):
    p = P.leave_one_out_rate(rows(spark, d, NATION_ROADS), "region_id", "y", "km")
    return P.shrink(p, P.prior_strength(p, "y", "km"), "y", "km")


@query(LOO + " SELECT seg_id, round(prior, 8) AS prior FROM p")
def w_loo_rate(spark, d):
    return P.leave_one_out_rate(rows(spark, d, NATION_ROADS), "region_id", "y", "km").select("seg_id", F.round("prior", 8).alias("prior"))


@query(EB + " SELECT round(k, 6) AS k FROM k")
def m_eb_prior(spark, d):
    return P.prior_strength(P.leave_one_out_rate(rows(spark, d, NATION_ROADS), "region_id", "y", "km"), "y", "km").select(r6("k").alias("k"))


@query(EB + " SELECT seg_id, round(eb, 6) AS eb, k IS NULL AS k_degenerate, round((eb - prior) / nullif(prior, 0), 6) AS excess FROM e")
def m_eb_shrink(spark, d):
    return _eb(spark, d).select("seg_id", r6("eb").alias("eb"), "k_degenerate", r6("excess").alias("excess"))


@query(EB + """, r AS (SELECT *, y / km::DOUBLE AS rate, (eb - prior) / nullif(prior, 0) AS excess, (y - prior * km) / sqrt(greatest(prior * km, 1e-9)) AS residual FROM e),
l AS (SELECT region_id, quantile_cont(rate, 0.8) AS ql FROM r GROUP BY 1), g AS (SELECT quantile_cont(excess, 0.8) AS qe, quantile_cont(residual, 0.8) AS qr FROM r)
SELECT seg_id, CAST((rate > ql)::INT + (excess > qe)::INT + (residual > qr)::INT AS BIGINT) AS n_criteria FROM r JOIN l USING (region_id), g WHERE (rate > ql OR excess > qe OR residual > qr) AND y >= 3""")
def m_blackspots(spark, d):
    return P.black_spots(_eb(spark, d), "region_id", "y", "km", min_events=3, q=0.8).select("seg_id", "n_criteria")


CAND = f"""WITH a AS ({SOURCE}0), b AS ({SOURCE}1), c AS (SELECT a.id AS a_id, b.id AS b_id, CAST(abs(datediff('day', a.fecha, b.fecha)) AS BIGINT) AS gap_days, sqrt(power(b.lat - a.lat, 2) + power((b.lon - a.lon) * cos(radians(b.lat)), 2)) * 111 AS dist_km FROM a JOIN b ON abs(datediff('day', a.fecha, b.fecha)) <= 1 AND sqrt(power(b.lat - a.lat, 2) + power(b.lon - a.lon, 2)) <= 0.25 / 111::DOUBLE)"""


def _sources(spark, d):
    return rows(spark, d, SOURCE + "0"), rows(spark, d, SOURCE + "1")


@query(CAND + " SELECT a_id, b_id, gap_days FROM c")
def j_match_candidates(spark, d):
    return M.candidates(*_sources(spark, d), 0.25, 1).select("a_id", "b_id", "gap_days")


@query()
def j_one_to_one(spark, d):
    return M.match_events(*_sources(spark, d), 0.25, 1, steps(spark)).select("a_id", "b_id", r6("dist_km").alias("dist_km"))


@query()
def m_match_union(spark, d):
    a, b = _sources(spark, d)
    return M.union_events(a, b, M.match_events(a, b, 0.25, 1, steps(spark)))


@query()
def a_match_summary(spark, d):
    return M.match_summary(m_match_union(spark, d))


@query("""SELECT n1, n2, m, round(n, 4) AS n_hat, round(n / s, 4) AS low, round(n * s, 4) AS high FROM (
  SELECT *, CAST(n1 AS DOUBLE) * n2 / m AS n, exp(1.96 * sqrt(ln(1 + CAST(n1 - m AS DOUBLE) * (n2 - m) / (CAST(n1 AS DOUBLE) * n2 * m)))) AS s FROM (
    SELECT count(*) FILTER (WHERE user_id % 2 = 0) AS n1, count(*) FILTER (WHERE user_id % 3 = 0) AS n2, count(*) FILTER (WHERE user_id % 6 = 0) AS m FROM events))""")
def m_lincoln_petersen(spark, d):
    n = table(spark, d, "events").agg(*[F.count_if(F.col("user_id") % k == 0).alias(c) for k, c in ((2, "n1"), (3, "n2"), (6, "m"))])
    out = M.lincoln_petersen(n, "n1", "n2", "m")
    return out.select("n1", "n2", "m", *[F.round(c, 4).alias(c) for c in ("n_hat", "low", "high")])


def _independence_sql(column: str) -> str:
    return f"""SELECT '{column}' AS "column", count(*) AS n_a, count(*) FILTER (WHERE v NOT IN (SELECT {column} FROM b)) AS n_only_a,
      round(100.0 * count(*) FILTER (WHERE v NOT IN (SELECT {column} FROM b)) / count(*), 4) AS pct_only_a FROM (SELECT DISTINCT {column} AS v FROM a)"""


HALVES = "SELECT user_id AS ruta, CAST(floor(value) AS BIGINT) AS mes FROM events WHERE event_id % 2 = "


@query(f"WITH a AS ({HALVES}0), b AS ({HALVES}1) {_independence_sql('ruta')} UNION ALL {_independence_sql('mes')}")
def m_independence(spark, d):
    return M.independence(rows(spark, d, HALVES + "0"), rows(spark, d, HALVES + "1"), ["ruta", "mes"])


#: Routes (one a nation) through two points each; customers as events of two sources, suppliers as alerts and tolls.
TWO_POINTS = """SELECT CAST(n_nationkey AS BIGINT) AS route_id, CAST(i AS BIGINT) AS i, CAST((n_nationkey * 5) % 23 + i AS DOUBLE) AS s_lat,
  CAST((n_nationkey * 3) % 16 AS DOUBLE) AS s_lon FROM nation CROSS JOIN (SELECT r_regionkey AS i FROM region WHERE r_regionkey < 2)"""
LENGTHS = "SELECT CAST(n_nationkey AS BIGINT) AS route_id, CAST(10 + n_nationkey AS DOUBLE) AS longitud_km FROM nation"
KM = "2 * 6371 * asin(sqrt(power(sin((radians(s_lat) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(s_lat)) * power(sin((radians(s_lon) - radians(lon)) / 2), 2)))"


@query(f"""WITH s AS ({TWO_POINTS}), l AS ({LENGTHS}),
e AS (SELECT c_custkey AS id, lat, lon, CAST(3 * (c_custkey % 3) + c_custkey % 4 + 1 AS DOUBLE) AS peso, CASE WHEN c_custkey % 2 = 0 THEN 'A' ELSE 'B' END AS fuente FROM ({POINTS})),
t AS (SELECT s_suppkey AS id, lat2 AS lat, lon2 AS lon, CAST(1 + s_suppkey % 5 AS DOUBLE) AS peso, CAST(100 * s_suppkey AS DOUBLE) AS aadt FROM ({TOLLS})),
en AS (SELECT route_id, count(*) AS n, sum(peso) AS g, count(*) FILTER (WHERE fuente = 'A') AS a, count(*) FILTER (WHERE fuente = 'B') AS b FROM (SELECT DISTINCT route_id, id, peso, fuente FROM s, e WHERE {KM} <= 60) GROUP BY 1),
tn AS (SELECT route_id, count(*) AS n, sum(peso) AS g, max(aadt) AS m FROM (SELECT DISTINCT route_id, id, peso, aadt FROM s, t WHERE {KM} <= 60) GROUP BY 1)
SELECT l.route_id, CAST(coalesce(en.n, 0) AS BIGINT) AS n, CAST(coalesce(a, 0) AS BIGINT) AS n_a, CAST(coalesce(b, 0) AS BIGINT) AS n_b, coalesce(en.g, 0) AS gravedad,
  CAST(coalesce(tn.n, 0) AS BIGINT) AS n_peajes, coalesce(m, 0) AS aadt_max, round((coalesce(en.n, 0) + 0.5 * coalesce(en.g, 0)) / longitud_km + 2 * coalesce(tn.g, 0) / longitud_km, 4) AS score_km
FROM l LEFT JOIN en ON l.route_id = en.route_id LEFT JOIN tn ON l.route_id = tn.route_id""")
def m_route_score(spark, d):
    from ..functions.numeric import severity_weight

    id_ = F.col("c_custkey")
    events = rows(spark, d, POINTS).select(id_.alias("id"), "lat", "lon", severity_weight(id_ % 3, id_ % 4).cast("double").alias("peso"), F.when(id_ % 2 == 0, "A").otherwise("B").alias("fuente"))
    tolls = rows(spark, d, TOLLS).select(F.col("s_suppkey").alias("id"), F.col("lat2").alias("lat"), F.col("lon2").alias("lon"), (1 + F.col("s_suppkey") % 5).cast("double").alias("peso"), (100 * F.col("s_suppkey")).cast("double").alias("aadt"))
    out = R.route_risk(rows(spark, d, LENGTHS), rows(spark, d, TWO_POINTS), events, tolls, tolls, 60.0)
    return out.select("route_id", "n", "n_a", "n_b", "gravedad", "n_peajes", "aadt_max", "score_km")


@query("""SELECT seg_id, CAST(i AS BIGINT) AS i, round(lat0 + i * (lat1 - lat0) / n, 6) AS lat, round(lon0 + i * (lon1 - lon0) / n, 6) AS lon, round(total / n, 6) AS peso FROM (
  SELECT *, unnest(range(0, n)) AS i FROM (SELECT p_partkey AS seg_id, greatest(1, p_size) AS n, CAST(p_partkey % 10 AS DOUBLE) AS lat0, CAST(p_partkey % 7 AS DOUBLE) AS lat1,
    CAST(p_partkey % 5 AS DOUBLE) AS lon0, CAST(p_partkey % 3 AS DOUBLE) AS lon1, p_retailprice AS total FROM part))""")
def m_synthetic_points(spark, d):
    k = F.col("p_partkey")
    s = table(spark, d, "part").select(k.alias("seg_id"), (F.col("p_size") + 0.5).alias("longitud_km"), *[(k % m).cast("double").alias(c) for c, m in (("lat0", 10), ("lat1", 7), ("lon0", 5), ("lon1", 3))], F.col("p_retailprice").alias("total"))
    return R.synthetic_points(s).select("seg_id", "i", *[r6(c).alias(c) for c in ("lat", "lon", "peso")])


BY_YEAR = "SELECT c.c_nationkey AS k, CAST(year(o.o_orderdate) AS BIGINT) AS anio, CAST(count(*) AS BIGINT) AS y FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_nationkey, year(o.o_orderdate)"


def _metrics_sql(name: str) -> str:
    return f"""SELECT '{name}' AS model, CAST(count(*) AS BIGINT) AS n, round(avg(abs(y - mu)), 6) AS mae, round(sqrt(avg(power(y - mu, 2))), 6) AS rmse,
      round(1 - sum(power(y - mu, 2)) / nullif(sum(CAST(y * y AS DOUBLE)) - power(sum(y), 2) / count(*), 0), 6) AS r2,
      round(avg(2 * (CASE WHEN y > 0 THEN y * ln(y / mu) ELSE 0 END - (y - mu))), 6) AS deviance, round(avg(mu - y), 6) AS bias
      FROM (SELECT y, CAST({name} AS DOUBLE) AS mu FROM t) WHERE mu IS NOT NULL"""


@query(f"""WITH p AS ({BY_YEAR}), m AS (SELECT avg(y) AS media, quantile_cont(CAST(y AS DOUBLE), 0.5) AS mediana FROM p WHERE anio <= 1999),
t AS (SELECT p.k, p.anio, p.y, media, mediana, b.y AS persistencia FROM p CROSS JOIN m LEFT JOIN p b ON p.k = b.k AND p.anio = b.anio + 1 WHERE p.anio > 1999)
""" + " UNION ALL ".join(_metrics_sql(m) for m in ("media", "mediana", "persistencia")))
def m_baseline_metrics(spark, d):
    p = rows(spark, d, BY_YEAR)
    train, test = G.temporal_holdout(p, "anio", 1999)
    scored = G.persistence(p, G.baselines(train, test, "y"), "k", "anio", "y")
    return G.compare(scored, "y", ["media", "mediana", "persistencia"]).select("model", "n", *[r6(c).alias(c) for c in ("mae", "rmse", "r2", "deviance", "bias")])


def _design(spark, d):
    c = table(spark, d, "customer")
    return c.select((F.col("c_custkey") * 7 % 11 % 5).cast("double").alias("y"), F.lit(1.0).alias("one"), F.log1p((F.col("c_custkey") % 13).cast("double")).alias("x"), F.ln((1 + F.col("c_custkey") % 3).cast("double")).alias("off"), F.col("c_nationkey").alias("cluster"))


def _coefficients(spark, model):
    return spark.createDataFrame([(r["column"], float(r["irr"]), float(r["low"]), float(r["high"]), float(r["p"])) for r in G.rate_ratios(model)], "`column` string, irr double, low double, high double, p double")


@query()
def m_poisson_glm(spark, d):
    return _coefficients(spark, G.fit_counts(_design(spark, d), "y", ["one", "x"], "off"))


@query()
def m_negbin_glm(spark, d):
    return _coefficients(spark, G.fit_negative_binomial(_design(spark, d), "y", ["one", "x"], "off"))


@query()
def m_bootstrap_ci(spark, d):
    return Q.bootstrap_score(rows(spark, d, DIRTY), SPEC, AS_OF)


ROUTE = "SELECT CAST(c_nationkey AS BIGINT) AS route_id, c_custkey AS i, CAST(c_custkey % 17 AS DOUBLE) / 10 AS lat, CAST(c_custkey * 7 % 13 AS DOUBLE) / 10 AS lon FROM customer"
STEPS = f"SELECT *, coalesce(2 * 6371 * asin(sqrt(power(sin((radians(lat) - radians(lag(lat) OVER w)) / 2), 2) + cos(radians(lag(lat) OVER w)) * cos(radians(lat)) * power(sin((radians(lon) - radians(lag(lon) OVER w)) / 2), 2))), 0) AS step FROM ({ROUTE}) WINDOW w AS (PARTITION BY route_id ORDER BY i)"


@query(f"SELECT route_id, i, round(sum(step) OVER (PARTITION BY route_id ORDER BY i), 4) AS cum_km FROM ({STEPS})")
def w_cumdist(spark, d):
    return R.cumulative(rows(spark, d, ROUTE)).select("route_id", "i", F.round("cum_km", 4).alias("cum_km"))


@query(f"""WITH c AS (SELECT *, sum(step) OVER (PARTITION BY route_id ORDER BY i) AS a FROM ({STEPS})),
e AS (SELECT route_id, i, a, lead(a) OVER w AS b, lat, lon, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2, row_number() OVER w AS n FROM c WINDOW w AS (PARTITION BY route_id ORDER BY i)),
k AS (SELECT *, unnest(generate_series(CASE WHEN n = 1 THEN 0 ELSE CAST(floor(a / 5) + 1 AS BIGINT) END, CAST(floor(b / 5) AS BIGINT))) AS k FROM e WHERE b > a)
SELECT route_id, k, round(lat + (k * 5 - a) / (b - a) * (lat2 - lat), 5) AS lat, round(lon + (k * 5 - a) / (b - a) * (lon2 - lon), 5) AS lon FROM k""")
def w_resample(spark, d):
    at = R.resample(rows(spark, d, ROUTE), 5.0)
    return at.select("route_id", "k", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"))


@query(f"SELECT ruta, win, CAST(count(*) AS BIGINT) AS n FROM (SELECT ruta, unnest(CASE WHEN hm % 500 = 0 AND hm > 0 THEN [hm // 500 - 1, hm // 500] ELSE [hm // 500] END) AS win FROM ({ROAD_EVENTS})) GROUP BY 1, 2")
def w_segment_5km(spark, d):
    return R.windows(rows(spark, d, ROAD_EVENTS).select("ruta", "hm"), "hm", 500).groupBy("ruta", "win").agg(F.count("*").alias("n"))


@query("SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS i, count(*) OVER () AS t FROM part) WHERE t <= 500 OR floor((i + 1) * 500 / t::DOUBLE) > floor(i * 500 / t::DOUBLE)")
def w_systematic_sample(spark, d):
    return every_nth(table(spark, d, "part").select("p_partkey"), "p_partkey", 500)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def t_tumbling(spark, d):
    e = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return e.select(F.col("w.start").alias("start"), "event_type", "n")


@query("SELECT start, event_type, CAST(count(*) AS BIGINT) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events) GROUP BY 1, 2")
def t_sliding(spark, d):
    e = table(spark, d, "events").groupBy(F.window("ts", "1 hour", "30 minutes").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return e.select(F.col("w.start").alias("start"), "event_type", "n")


@query("SELECT user_id, min(ts) AS start, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, sum(nuevo) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS nuevo FROM events)) GROUP BY user_id, s")
def t_session(spark, d):
    e = table(spark, d, "events").groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return e.select("user_id", F.col("w.start").alias("start"), "n")


@query()
def t_dedupe_watermark(spark, d):
    """The stream of reports drained once: one report a type and cell within ten minutes."""
    from ..streaming.live import drained, suppress_duplicates

    source = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    reports = source.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("tipo"), (F.col("user_id") % 7).cast("double").alias("lat"), (F.col("user_id") % 5).cast("double").alias("lon"))
    return drained(suppress_duplicates(reports), f"{shared_folder(spark)}/corduroy/reports-{uuid.uuid4().hex[:12]}").select("ts", "tipo", "cell_lat", "cell_lon")

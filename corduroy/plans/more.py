"""Small expressions, segment and route operators, contracts and model checks, as queries of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, numeric, text
from ..operators import aggregates as A
from ..operators import cleaning as C
from ..operators import live
from ..operators import matching as M
from ..operators import models as G
from ..operators import panel as P
from ..operators import quality as Q
from ..operators import routes as R
from ..operators import spatial as S
from ..session import steps
from ..sources import sinks
from .analytic import AS_OF, CONTRACT, ROUTE, STEPS, _panel, _sources
from .analytic import PANEL as PANEL_SQL
from .base import DIRTY, POINTS, SEGMENTS, TOLLS, query, r6, rows, table

#: Orders with numbers as text: plain, quoted, with a decimal comma, negative, or no number at all.
TEXTS = """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN CAST(o_orderkey AS VARCHAR(20)) WHEN 1 THEN concat('"', CAST(o_orderkey AS VARCHAR(20)), '"')
  WHEN 2 THEN concat(CAST(o_orderkey AS VARCHAR(20)), ',25') WHEN 3 THEN concat('-', CAST(o_orderkey AS VARCHAR(20))) WHEN 4 THEN 'km 12' ELSE NULL END AS t,
  CASE o_orderkey % 4 WHEN 0 THEN concat(CAST(o_orderkey % 24 AS VARCHAR(20)), ':30') WHEN 1 THEN '99:00' WHEN 2 THEN 'sin hora' ELSE NULL END AS hora FROM orders"""


@query(f"""SELECT o_orderkey, CASE WHEN regexp_full_match(replace(t, ',', '.'), '-?[0-9]+([.][0-9]+)?') THEN CAST(replace(t, ',', '.') AS DOUBLE) END AS km,
  CASE WHEN o_orderkey % 6 IN (0, 1) THEN o_orderkey WHEN o_orderkey % 6 = 2 THEN o_orderkey * 100 + 25 WHEN o_orderkey % 6 = 3 THEN -o_orderkey ELSE 0 END AS entero,
  CASE WHEN o_orderkey % 6 = 0 THEN CAST(o_orderkey AS DOUBLE) ELSE 0.0::DOUBLE END AS conteo,
  CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey % 24 AS INTEGER) END AS hora FROM ({TEXTS})""")
def p_numbers_from_text(spark, d):
    t = F.col("t")
    return rows(spark, d, TEXTS).select("o_orderkey", text.kilometre(t).alias("km"), numeric.whole_or_zero(t).alias("entero"), numeric.count_or_zero(t).alias("conteo"), text.hour_of(F.col("hora")).alias("hora"))


@query("""SELECT p_partkey, CAST(nullif(abs(p_size - 10), 0) AS DOUBLE) AS largo, CASE WHEN p_size >= 10 THEN round(ln(1 + p_size - 10), 6) END AS log_n,
  CASE WHEN p_size % 14 BETWEEN 1 AND 12 THEN make_date(2000 + p_size % 9, p_size % 14, 15) END AS fecha, p_size > 25 AS excede,
  CAST(upper(p_type) LIKE 'STANDARD%' AS BIGINT) AS estandar FROM part""")
def p_segment_features(spark, d):
    n = F.col("p_size")
    return table(spark, d, "part").select(
        "p_partkey", numeric.span_km(F.lit(10), n).alias("largo"), F.round(numeric.log1p_of(n - 10), 6).alias("log_n"), numeric.mid_month(2000 + n % 9, n % 14).alias("fecha"),
        numeric.over_limit(n, F.lit(25)).alias("excede"), F.upper("p_type").startswith("STANDARD").cast("long").alias("estandar"),
    )


@query(f"""SELECT row_id, CAST(clase IS NOT NULL AND upper(clase) LIKE 'ASFALTADO%' AS BIGINT) AS sup_buena, CAST(m IN ('PE-1', 'PE-1N') AS BIGINT) AS principal,
  lat BETWEEN -18.5 AND 0.2 AND lon BETWEEN -81.5 AND -68.5 AS geo_valid, velocidad > 100 AS excede FROM (
  SELECT *, CASE row_id % 4 WHEN 0 THEN 'PE-1' WHEN 1 THEN 'PE-1N' WHEN 2 THEN 'PE-12' ELSE 'AN-105' END AS m FROM ({DIRTY}))""")
def p_flags(spark, d):
    k = F.col("row_id") % 4
    route = F.when(k == 0, "PE-1").when(k == 1, "PE-1N").when(k == 2, "PE-12").otherwise("AN-105")
    return rows(spark, d, DIRTY).select(
        "row_id", numeric.good_surface(F.col("clase")).alias("sup_buena"), numeric.on_main_route(route).alias("principal"),
        geo.valid_place(F.col("lat"), F.col("lon"), (-18.5, 0.2, -81.5, -68.5)).alias("geo_valid"), numeric.over_limit(F.col("velocidad"), F.lit(100)).alias("excede"),
    )


@query("""SELECT o_orderkey, '{"id":' || CAST(o_orderkey AS VARCHAR) || ',"estado":"' || o_orderstatus || '","lugar":{"cliente":' || CAST(o_custkey AS VARCHAR) || '}}' AS j FROM orders""")
def p_json_projection(spark, d):
    inner = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("estado"), F.struct(F.col("o_custkey").alias("cliente")).alias("lugar"))
    return table(spark, d, "orders").select("o_orderkey", F.to_json(inner).alias("j"))


@query("SELECT l_linestatus = 'O' AS abierto, CAST(count(*) AS BIGINT) AS n, round(avg(l_quantity), 6) AS media, quantile_cont(l_quantity, 0.5) AS mediana FROM lineitem GROUP BY 1")
def a_by_flag(spark, d):
    return A.by_flag(table(spark, d, "lineitem").select((F.col("l_linestatus") == "O").alias("abierto"), "l_quantity"), "abierto", "l_quantity")


@query("""SELECT CAST(year(o_orderdate) AS BIGINT) AS anio, o_orderstatus AS fuente, CAST(count(*) AS BIGINT) AS n, CAST(sum(o_orderkey % 3) AS BIGINT) AS fallecidos,
  round(sum(o_orderkey % 3) / count(*), 6) AS por_evento FROM orders GROUP BY 1, 2""")
def a_severity_ratio(spark, d):
    o = table(spark, d, "orders").select(F.year("o_orderdate").cast("long").alias("anio"), F.col("o_orderstatus").alias("fuente"), (F.col("o_orderkey") % 3).alias("dead"))
    return A.severity_ratio(o, ["anio", "fuente"], "dead")


def _mix_sql(column: str, value: str, k: int) -> str:
    return f"""SELECT ruta, '{column}' AS "column", valor, n, round(100.0 * n / total, 1) AS pct FROM (
      SELECT ruta, {value} AS valor, CAST(count(*) AS BIGINT) AS n, sum(count(*)) OVER (PARTITION BY ruta) AS total FROM e GROUP BY 1, 2)
      QUALIFY row_number() OVER (PARTITION BY ruta ORDER BY n DESC, valor) <= {k}"""


@query(f"WITH e AS (SELECT o_orderpriority AS ruta, o_orderstatus AS tipo, CAST(year(o_orderdate) AS VARCHAR) AS causa FROM orders) {_mix_sql('tipo', 'tipo', 2)} UNION ALL {_mix_sql('causa', 'causa', 3)}")
def a_incident_mix(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("ruta"), F.col("o_orderstatus").alias("tipo"), F.year("o_orderdate").cast("string").alias("causa"))
    return A.incident_mix(o, "ruta", {"tipo": 2, "causa": 3})


@query(f"""SELECT ruta, CAST(count(*) AS BIGINT) AS n, min(km0) AS km_min, max(km1) AS km_max, CAST(sum(km1 - km0) AS DOUBLE) AS long_km,
  greatest(0.0, max(km1) - min(km0) - sum(km1 - km0)) AS missing FROM ({SEGMENTS}) GROUP BY 1""")
def a_segment_stats(spark, d):
    return A.segment_statistics(rows(spark, d, SEGMENTS))


@query("""SELECT CAST(count(*) AS BIGINT) AS n_keys, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS n_both, round(100.0 * count(*) FILTER (WHERE ok) / count(*), 4) AS pct_keys,
  round(100.0 * sum(CASE WHEN ok THEN x END) / sum(x), 4) AS pct_amount FROM (SELECT l_partkey, sum(l_quantity) AS x, l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) AS ok FROM lineitem GROUP BY 1)""")
def a_route_coverage(spark, d):
    li = table(spark, d, "lineitem")
    return M.coverage(li.where("l_quantity > 45"), li, "l_partkey", "l_quantity")


@query("""SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(last) AS BIGINT) AS n_match, round(100.0 * count(last) / count(*), 4) AS pct_match, CAST(count(*) FILTER (WHERE km > last) AS BIGINT) AS n_beyond
FROM (SELECT o_custkey AS code, o_totalprice AS km FROM orders) LEFT JOIN (SELECT o_custkey AS c, max(o_totalprice) AS last FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON code = c""")
def a_code_match(spark, d):
    o = table(spark, d, "orders")
    catalog = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("code"), F.col("o_totalprice").alias("km_max"))
    return A.code_match(o.select(F.col("o_custkey").alias("c"), F.col("o_totalprice").alias("km")), "c", "km", catalog)


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", CAST(count({c}) AS BIGINT) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min,
  quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75, CAST(max({c}) AS DOUBLE) AS max FROM lineitem""" for c in ("l_quantity", "l_tax")))
def a_describe(spark, d):
    return Q.describe(table(spark, d, "lineitem"), ["l_quantity", "l_tax"])


@query("SELECT anio FROM (SELECT unnest(range(1995, 2002)) AS anio) WHERE anio BETWEEN 1995 AND 2001 AND anio IN (1996, 1998, 1999)")
def a_empty_years(spark, d):
    o = table(spark, d, "orders").where("year(o_orderdate) NOT IN (1996, 1998, 1999)")
    return A.years_without(o, "o_orderdate").select(F.col("anio").cast("long").alias("anio"))


@query(f"SELECT CAST(year(fecha) AS BIGINT) AS anio, CAST(count(*) AS BIGINT) AS n FROM ({DIRTY}) WHERE fecha IS NOT NULL GROUP BY 1")
def a_rows_by_year(spark, d):
    return A.rows_by_year(rows(spark, d, DIRTY), "fecha")


@query(PANEL_SQL + """ SELECT anio, CAST(sum(n_eventos) AS BIGINT) AS n_eventos, CAST(sum(n_fallecidos) AS BIGINT) AS n_fallecidos,
  round(100.0 * count(*) FILTER (WHERE n_eventos = 0) / count(*), 4) AS pct_zero, round(sum(n_eventos) / sum(long_km), 8) AS densidad FROM p GROUP BY 1""")
def m_panel_years(spark, d):
    return P.panel_years(_panel(spark, d))


BROKEN = {
    "columns": CONTRACT["columns"] | {"estado": {"type": "datetime"}, "lat": {"type": "integer", "min_length": 1}, "fecha": {"min": "1996-01-01", "min_date": "1996-01-01"}, "clase": {"min": "2", "max": "4"}},
    "allow_extra": False,
}


@query(f"""WITH x AS ({DIRTY}), n AS (SELECT count(*) - count(DISTINCT code) AS a, count(estado) AS b, count(*) FILTER (WHERE lat <> floor(lat)) AS c, count(*) FILTER (WHERE fecha < DATE '1996-01-01') AS e,
  count(*) FILTER (WHERE clase < '2') AS f, count(*) FILTER (WHERE clase > '4') AS g, count(*) FILTER (WHERE fallecidos < 0) AS h, count(*) FILTER (WHERE fallecidos > 5) AS i, count(*) FILTER (WHERE velocidad > 300) AS j FROM x)
SELECT "column", rule, CAST(n AS BIGINT) AS n, CASE rule WHEN 'missing' THEN "column" || ': missing' WHEN 'extra' THEN "column" || ': not in the contract' ELSE "column" || ': ' || n || ' break rule ' || rule END AS message FROM (
  SELECT unnest(['code', 'estado', 'lat', 'fecha', 'fecha', 'clase', 'clase', 'fallecidos', 'fallecidos', 'velocidad', 'ausente', 'row_id', 'lon']) AS "column",
    unnest(['unique', 'type', 'type', 'min', 'min_date', 'min', 'max', 'min', 'max', 'max', 'missing', 'extra', 'extra']) AS rule, unnest([a, b, c, e, e, f, g, h, i, j, 1, 1, 1]) AS n FROM n) WHERE n > 0""")
def f_contract_errors(spark, d):
    return Q.contract_errors(Q.contract_report(rows(spark, d, DIRTY), BROKEN, AS_OF))


@query(f"WITH x AS ({DIRTY}) SELECT FALSE AS valid, CAST(3 AS BIGINT) AS n_errors, CAST(1 + (SELECT count(*) FROM x WHERE fallecidos < 0) + (SELECT count(*) FROM x WHERE velocidad > 300) AS BIGINT) AS n_values")
def f_contract_valid(spark, d):
    columns = {k: CONTRACT["columns"][k] for k in ("fallecidos", "velocidad", "ausente")}
    return Q.contract_valid(Q.contract_report(rows(spark, d, DIRTY), {"columns": columns}))


@query(f"""SELECT 'clase' AS "column", array_to_string(list(v ORDER BY v), '|') AS examples FROM (SELECT DISTINCT clase AS v FROM ({DIRTY}) WHERE upper(clase) NOT IN ('1-URGENT', '2-HIGH') ORDER BY 1 LIMIT 5)""")
def f_disallowed_examples(spark, d):
    found = Q.disallowed_examples(rows(spark, d, DIRTY), {"columns": {"clase": {"allowed_values": ["1-Urgent", "2-High"]}, "nada": {"allowed_values": []}}})
    return found.select("column", F.array_join("examples", "|").alias("examples"))


@query(f"""WITH v AS (SELECT row_id, row_number() OVER (ORDER BY row_id) AS i, count(*) OVER () AS n FROM ({DIRTY}) WHERE velocidad > 300 OR velocidad < 1 OR fallecidos > 4)
SELECT 'velocidad' AS rule, 'velocidad' AS "column", 'warning' AS severity, CAST(max(n) AS BIGINT) AS n, array_to_string(list(row_id ORDER BY row_id), '|') AS rows FROM v WHERE i <= 1000""")
def f_violation_rows(spark, d):
    rule = {"name": "velocidad", "kind": "rango", "column": "velocidad", "min": 1, "max": 300, "limit": ("fallecidos", 4), "severity": "warning"}
    found = Q.violation_table(Q.violations(rows(spark, d, DIRTY), [rule], "row_id", AS_OF), 1000)
    return found.withColumn("rows", F.array_join(F.col("rows").cast("array<string>"), "|"))


EMPTY = f"SELECT *, CAST(NULL AS DOUBLE) AS vacia, CAST(NULL AS DATE) AS sin_fecha FROM ({DIRTY})"


@query(f"""SELECT *, round(0.22 * completeness + 0.22 * validity + 0.15 * uniqueness + 0.15 * consistency + 0.18 * integrity + 0.08 * freshness, 2) AS dqs FROM (
SELECT round(100.0 * (count(code) + count(fecha) + count(fallecidos)) / 3 / count(*), 2) AS completeness,
  round((100.0 * avg(CASE WHEN fallecidos IS NOT NULL THEN CAST(fallecidos BETWEEN 0 AND 5 AS INT) END) + 100.0 * avg(CAST(velocidad <= 300 AS INT)) + 100.0 * avg(CAST(lon >= 0 AS INT)) + 100.0 * avg(CASE WHEN clase IS NOT NULL THEN CAST(upper(clase) IN ('1-URGENT', '2-HIGH') AS INT) END)) / 4, 2) AS validity,
  round(100.0::DOUBLE * (1 - (count(*) - count(DISTINCT (code, estado)))::DOUBLE / count(*)), 2) AS uniqueness,
  round(100.0 * avg(CASE WHEN clase IS NOT NULL THEN CAST(clase = upper(clase) AS INT) END), 2) AS consistency, 100.0::DOUBLE AS integrity, 0.0::DOUBLE AS freshness FROM ({EMPTY}))""")
def q_contract_score(spark, d):
    """A table with an empty column and an empty date, scored by its contract: empty columns don't count, freshness is 0."""
    df = rows(spark, d, EMPTY)
    columns = {
        "code": {"nullable": False}, "fecha": {"nullable": False}, "fallecidos": {"type": "integer", "nullable": False, "min": 0, "max": 5},
        "velocidad": {"type": "integer", "max": 300}, "lon": {"type": "float"}, "vacia": {"type": "float", "min": 1},
    }
    spec = Q.contract_spec(df, {"columns": columns, "primary_key": ["code", "estado"]}, {"clases": ["1-Urgent", "2-High"], "otras": ["x"]}, {"clases": "clase"}, nominal=["clase", "vacia"], date="sin_fecha")
    return Q.dimensions(df, spec, AS_OF)


@query(f"""SELECT c_custkey, s_suppkey, round(m, 3) AS dist_m FROM (SELECT c_custkey FROM ({POINTS})) LEFT JOIN (
  SELECT c_custkey AS c, s_suppkey, m FROM (SELECT c_custkey, s_suppkey, sqrt(power((radians(lon) - radians(lon2)) * cos(radians(-10)), 2) + power(radians(lat) - radians(lat2), 2)) * 6371000 AS m FROM ({POINTS}), ({TOLLS}))
  WHERE m <= 100000 QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY round(m, 3), s_suppkey) = 1) ON c_custkey = c""")
def j_nearest_metres(spark, d):
    return S.nearest_metres(rows(spark, d, POINTS), rows(spark, d, TOLLS), "c_custkey", "s_suppkey", 100000.0, digits=3).select("c_custkey", "s_suppkey", F.round("dist_m", 3).alias("dist_m"))


@query(f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY i) - 1 AS k, count(*) OVER (PARTITION BY route_id) AS m FROM ({ROUTE})),
j AS (SELECT route_id, m, unnest(range(0, 8)) AS j FROM (SELECT DISTINCT route_id, m FROM p))
SELECT route_id, i FROM p WHERE m <= 8 OR EXISTS (SELECT 1 FROM j WHERE j.route_id = p.route_id AND floor(j * (j.m - 1) / 7.0 + 0.5) = k)""")
def w_strided(spark, d):
    return R.strided(rows(spark, d, ROUTE), 8).select("route_id", "i")


@query(f"""WITH c AS (SELECT *, sum(step) OVER (PARTITION BY route_id ORDER BY i) AS a FROM ({STEPS})),
e AS (SELECT route_id, a, lead(a) OVER w AS b, lat, lon, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM c WINDOW w AS (PARTITION BY route_id ORDER BY i)),
t AS (SELECT s_suppkey AS id, CAST(s_nationkey AS BIGINT) AS route_id, CAST(s_suppkey * 37 % 4000 AS DOUBLE) + 0.5 AS km FROM supplier),
m AS (SELECT t.*, z.hi FROM t JOIN (SELECT route_id, max(a) AS hi FROM c GROUP BY 1) z ON t.route_id = z.route_id WHERE km <= hi + 5),
f AS (SELECT id, round(lat + (least(km, hi) - a) / (b - a) * (lat2 - lat), 5) AS lat, round(lon + (least(km, hi) - a) / (b - a) * (lon2 - lon), 5) AS lon FROM m JOIN e ON m.route_id = e.route_id
  WHERE b > a AND least(km, hi) BETWEEN a AND b QUALIFY row_number() OVER (PARTITION BY id ORDER BY a) = 1)
SELECT t.id, f.lat, f.lon FROM t LEFT JOIN f ON t.id = f.id""")
def x_place_at_km(spark, d):
    k = F.col("s_suppkey")
    targets = table(spark, d, "supplier").select(k.alias("id"), F.col("s_nationkey").cast("long").alias("route_id"), ((k * 37 % 4000).cast("double") + 0.5).alias("km"))
    return R.place_at_km(targets, rows(spark, d, ROUTE)).select("id", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"))


RATES = f"SELECT s_suppkey AS seg_id, lat2, lon2, CAST(s_suppkey % 7 AS DOUBLE) AS tasa FROM ({TOLLS})"
SAMPLES = f"SELECT c_custkey AS sample_id, CAST(c_nationkey AS BIGINT) AS route_id, lat, lon, CAST(c_custkey % 40 AS DOUBLE) + 0.5 AS km FROM ({POINTS})"


@query(f"""WITH s AS ({SAMPLES}), n AS (SELECT sample_id, tasa FROM (SELECT sample_id, seg_id, tasa, sqrt(power((radians(lon) - radians(lon2)) * cos(radians(-10)), 2) + power(radians(lat) - radians(lat2), 2)) * 6371000 AS m FROM s, ({RATES}))
  WHERE m <= 60000 QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY m, seg_id) = 1),
w AS (SELECT route_id, CAST(floor(km / 5) AS BIGINT) AS win, tasa FROM s LEFT JOIN n ON s.sample_id = n.sample_id UNION ALL SELECT route_id, -1, tasa FROM s LEFT JOIN n ON s.sample_id = n.sample_id)
SELECT route_id, win, round(coalesce(avg(tasa), 0), 4) AS tasa, round(100.0 * count(tasa) / count(*), 1) AS cobertura_pct FROM w GROUP BY 1, 2""")
def m_predicted_rate(spark, d):
    return R.predicted_rate(rows(spark, d, SAMPLES), rows(spark, d, RATES), 60000.0)


@query("SELECT p_partkey, round(p_retailprice * 1.25 + 5 * (p_size % 3) + p_size % 4, 6) AS score FROM part")
def m_live_penalty(spark, d):
    n = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", r6(R.live_penalty(F.col("p_retailprice"), F.lit(1.25), n % 3, n % 4)).alias("score"))


MU = "SELECT p_partkey, CAST(p_size % 13 AS DOUBLE) AS y, CAST(1 + p_partkey % 4 AS DOUBLE) AS mu FROM part"


@query(f"SELECT CAST(count(*) AS BIGINT) AS n, round(sum(power(y - mu, 2) / (mu + 0.5 * mu * mu)), 6) AS chi2, round(sum(power(y - mu, 2) / (mu + 0.5 * mu * mu)) / (count(*) - 3), 6) AS chi2_df FROM ({MU})")
def m_dispersion(spark, d):
    return G.dispersion(rows(spark, d, MU), "y", "mu", 3, 0.5).select("n", r6("chi2").alias("chi2"), r6("chi2_df").alias("chi2_df"))


@query(f"SELECT p_partkey, round((y - mu) / sqrt(mu), 6) AS pearson FROM ({MU}) WHERE y >= 5 AND (y - mu) / sqrt(mu) > 1.5")
def f_residual_spots(spark, d):
    return G.residual_spots(rows(spark, d, MU), "y", "mu").select("p_partkey", r6("pearson").alias("pearson"))


#: Parts as segments: counts, a surface, points near by, a distance to the next toll, a speed and an exposure that is never 0.
UNITS = """SELECT p_partkey AS seg_id, CAST(p_size % 7 AS BIGINT) AS y, CASE p_partkey % 3 WHEN 0 THEN 'PE-1N' WHEN 1 THEN 'PE-3S' ELSE concat('AN-', CAST(p_partkey % 40 AS VARCHAR(9))) END AS ruta,
  CASE WHEN p_partkey % 4 = 0 THEN 'Asfaltado' ELSE 'Afirmado' END AS superficie, p_size % 5 AS n_near, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_retailprice / CAST(100 AS DOUBLE) END AS dist_km,
  60 AS vel_proy, CAST(1 + p_partkey % 25 AS DOUBLE) AS expo FROM part"""


@query(f"""SELECT seg_id, y, 1.0::DOUBLE AS one, round(ln(1 + n_near), 6) AS log_near, round(ln(1 + dist_km), 6) AS log_dist, CAST(superficie = 'Asfaltado' AS DOUBLE) AS sup_buena,
  CAST(ruta = 'PE-1N' AS DOUBLE) AS main, round(ln(61), 6) AS log_vel, expo, regexp_replace(ruta, '([NSEW])$', '') AS corredor, round(ln(expo), 6) AS log_expo FROM ({UNITS})""")
def m_design(spark, d):
    design, vary, _ = G.checked_design(G.segment_design(rows(spark, d, UNITS)), ["log_near", "log_dist", "sup_buena", "main", "log_vel"], "expo")
    assert "log_vel" not in vary  # constant here
    return design.select("seg_id", "y", "one", *[r6(c).alias(c) for c in ("log_near", "log_dist")], "sup_buena", "main", r6("log_vel").alias("log_vel"), "expo", "corredor", r6("log_expo").alias("log_expo"))


@query()
def m_grouped_validation(spark, d):
    design = G.segment_design(rows(spark, d, UNITS))
    return G.grouped_validation(design, "y", ["log_near", "log_dist", "sup_buena", "main", "log_vel"], "expo", "corredor")


@query(f"""WITH u AS ({UNITS}), m AS (SELECT quantile_cont(dist_km, 0.5) AS m FROM u WHERE seg_id % 5 <> 0)
SELECT seg_id, coalesce(dist_km, m) AS dist_km FROM u, m WHERE seg_id % 5 = 0""")
def c_train_median(spark, d):
    u = rows(spark, d, UNITS).select("seg_id", "dist_km")
    return C.impute(u.where("seg_id % 5 = 0"), {"dist_km": "median"}, fit=u.where("seg_id % 5 <> 0"))


@query()
def m_sensitivity_grid(spark, d):
    return M.sensitivity(*_sources(spark, d), [0.1, 0.25, 0.5, 1.0], [0, 1, 3, 7], steps(spark))


@query(f"""WITH r AS (SELECT c_custkey AS id, c_mktsegment AS tipo, lat, lon, c_nationkey * 60 AS t FROM ({POINTS}))
SELECT id, EXISTS (SELECT 1 FROM r o WHERE o.tipo = r.tipo AND o.id < r.id AND abs(o.t - r.t) <= 600 AND 2 * 6371 * asin(sqrt(power(sin((radians(r.lat) - radians(o.lat)) / 2), 2)
  + cos(radians(o.lat)) * cos(radians(r.lat)) * power(sin((radians(r.lon) - radians(o.lon)) / 2), 2))) <= 15) AS repeated FROM r""")
def t_report_duplicates(spark, d):
    """Reports near an earlier one of the same type in place and time, also across a cell's edge."""
    r = rows(spark, d, POINTS).select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("tipo"), "lat", "lon", (F.col("c_nationkey") * 60).cast("long").alias("t"))
    return live.repeated_reports(r, 15.0, 600).select("id", "repeated")


@query("SELECT CAST(n_nationkey AS BIGINT) AS route_id, CAST(i AS BIGINT) AS orden, CAST(n_nationkey + i AS DOUBLE) AS lat, CAST(n_nationkey - i AS DOUBLE) AS lon FROM nation, (SELECT r_regionkey AS i FROM region)")
def sk_flat_routes(spark, d):
    k = F.col("n_nationkey")
    line = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.array((k - i).cast("double"), (k + i).cast("double")))
    return sinks.flat_routes(table(spark, d, "nation").select(k.cast("long").alias("route_id"), line.alias("geometry")))


@query("""SELECT CAST(n_nationkey AS BIGINT) AS seg_id, n_name AS nombre, '[' || (SELECT string_agg('[' || CAST(c_custkey AS DOUBLE) || ',' || CAST(c_custkey % 9 AS DOUBLE) || ']', ',' ORDER BY c_custkey) FROM customer WHERE c_nationkey = n_nationkey) || ']' AS coords FROM nation""")
def sk_segments_json(spark, d):
    s = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("seg_id"), F.col("n_name").alias("nombre"))
    k = F.col("c_custkey")
    v = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("seg_id"), k.alias("i"), (k % 9).cast("double").alias("lat"), k.cast("double").alias("lon"))
    line = F.transform(F.col("coords"), lambda p: F.concat(F.lit("["), F.array_join(p.cast("array<string>"), ","), F.lit("]")))
    return sinks.segments_json(s, v).withColumn("coords", F.concat(F.lit("["), F.array_join(line, ","), F.lit("]")))


@query("""SELECT step::INTEGER AS step, operation, "column", detail FROM (VALUES (0, 'rename', 'clase', 'tipo'), (1, 'drop', 'estado', ''), (2, 'fold', 'tipo', ''), (3, 'numeric', 'velocidad', ''),
  (4, 'impute', 'fallecidos', 'constant=0'), (5, 'keep_first', 'code', 'row_id')) AS t(step, operation, "column", detail)""")
def c_operation_log(spark, d):
    spec = {"rename": {"clase": "tipo", "ausente": "x"}, "drop": ["estado"], "fold": ["tipo"], "numeric": ["velocidad", "ausente"], "impute": {"fallecidos": ("constant", 0)}, "key": ["code"], "order": "row_id"}
    return C.operation_log(rows(spark, d, DIRTY), spec)

"""Graphs, distribution functions, failing contracts, rule kinds and catalogues, as queries of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, graph, live
from ..operators import models as G
from ..operators import quality as Q
from ..session import steps
from .analytic import AS_OF
from .base import DIRTY, query, rows, table

#: Orders linked to the customer's next one: a chain for each customer.
CHAINS = "SELECT o_orderkey AS u, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS v FROM orders"


@query("SELECT o_orderkey AS node, min(o_orderkey) OVER (PARTITION BY o_custkey) AS component FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) > 1")
def a_components(spark, d):
    """Connected components of long chains."""
    return graph.components(rows(spark, d, CHAINS), steps(spark))


@query("SELECT min(o_orderkey) AS community, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def a_component_sizes(spark, d):
    return graph.community_sizes(graph.components(rows(spark, d, CHAINS), steps(spark)).withColumnRenamed("component", "community"))


@query()
def a_communities(spark, d):
    """Communities of parts and suppliers by label propagation, by size."""
    lines = table(spark, d, "lineitem").select((F.col("l_partkey") * 2).alias("u"), (F.col("l_suppkey") * 2 + 1).alias("v"))
    return graph.community_sizes(graph.label_propagation(lines, steps(spark), rounds=3))


COUNTS = "SELECT CAST(o_orderkey % 23 AS BIGINT) AS y, CAST(1 AS DOUBLE) + CAST(o_custkey % 17 AS DOUBLE) / CAST(2 AS DOUBLE) AS mu FROM orders"


@query(f"""WITH p AS (SELECT y, mu, n, list_sum(list_transform(range(0, y + 1), lambda k: exp(lgamma(k + 2) - lgamma(2) - lgamma(k + 1) + 2 * ln(1 / (1 + 0.5 * mu)) + k * ln(0.5 * mu / (1 + 0.5 * mu))))) AS upto,
  coalesce(list_sum(list_transform(range(0, y), lambda k: exp(lgamma(k + 2) - lgamma(2) - lgamma(k + 1) + 2 * ln(1 / (1 + 0.5 * mu)) + k * ln(0.5 * mu / (1 + 0.5 * mu))))), 0) AS before FROM (SELECT y, mu, count(*) AS n FROM ({COUNTS}) GROUP BY 1, 2))
SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(n) FILTER (WHERE upto >= 0.05 AND before < 0.95) AS BIGINT) AS n_inside, round(100.0 * sum(n) FILTER (WHERE upto >= 0.05 AND before < 0.95) / sum(n), 6) AS coverage FROM p""")
def m_interval_coverage(spark, d):
    """Share of counts inside the central 90 % of their negative-binomial distributions."""
    out = G.interval_counts(rows(spark, d, COUNTS), "y", "mu", 0.5, 0.9)
    return out.withColumn("coverage", F.round("coverage", 6))


#: A contract that every kind of rule breaks.
BROKEN = {
    "columns": {
        "code": {"type": "string"},
        "fecha": {"type": "datetime", "min_date": "1996-01-01", "max_date": "1997-12-31"},
        "clase": {"type": "integer", "min_length": 6, "max_length": 8},
        "lat": {"type": "integer", "min": -10},
        "estado": {"type": "boolean", "allowed_values": ["F"]},
    }
}


@query(f"""WITH t AS ({DIRTY}), c AS (SELECT [
  {{'column': 'code', 'rule': 'type', 'n': count(code)}}, {{'column': 'fecha', 'rule': 'min_date', 'n': count(*) FILTER (WHERE fecha < DATE '1996-01-01')}}, {{'column': 'fecha', 'rule': 'max_date', 'n': count(*) FILTER (WHERE fecha > DATE '1997-12-31')}},
  {{'column': 'clase', 'rule': 'type', 'n': count(clase)}}, {{'column': 'clase', 'rule': 'min_length', 'n': count(*) FILTER (WHERE length(clase) < 6)}}, {{'column': 'clase', 'rule': 'max_length', 'n': count(*) FILTER (WHERE length(clase) > 8)}},
  {{'column': 'lat', 'rule': 'type', 'n': count(*) FILTER (WHERE lat % 1 <> 0)}}, {{'column': 'lat', 'rule': 'min', 'n': count(*) FILTER (WHERE lat < -10)}},
  {{'column': 'estado', 'rule': 'type', 'n': count(estado)}}, {{'column': 'estado', 'rule': 'allowed_values', 'n': count(*) FILTER (WHERE estado <> 'F')}}] AS x FROM t)
SELECT e.column AS "column", e.rule AS rule, CAST(e.n AS BIGINT) AS n FROM (SELECT unnest(x) AS e FROM c) WHERE e.n > 0""")
def f_contract_breaches(spark, d):
    """Types, dates, lengths and bounds that the rows break."""
    return Q.contract_report(rows(spark, d, DIRTY), BROKEN, AS_OF)


#: Rule kinds that the other queries' rules lack, and the range rule with the limit that speeds are held against.
KINDS = [
    {"name": "pk_not_null", "kind": "pk_not_null", "column": "code", "severity": "critical"},
    {"name": "hora", "kind": "formato", "column": "hora", "pattern": "^([01]?[0-9]|2[0-3]):[0-5][0-9]$", "severity": "warning"},
    {"name": "ubigeo", "kind": "consistencia", "columns": ["fecha", "clase"], "severity": "warning"},
    {"name": "velocidad", "kind": "rango", "column": "velocidad", "min": 1, "max": 300, "limit": ("limite", 160), "severity": "warning"},
]
SPEEDS = f"SELECT t.*, CASE row_id % 5 WHEN 0 THEN '7:30' WHEN 1 THEN '25:00' WHEN 2 THEN NULL WHEN 3 THEN '23:59' ELSE 'noche' END AS hora, CASE WHEN row_id % 41 = 0 THEN NULL ELSE row_id % 200 END AS limite FROM ({DIRTY}) t"


@query(f"""WITH t AS ({SPEEDS}) SELECT row_id, 'hora' AS rule, 'hora' AS "column", 'warning' AS severity FROM t WHERE hora IN ('25:00', 'noche')
UNION ALL SELECT row_id, 'ubigeo', 'fecha,clase', 'warning' FROM t WHERE fecha IS NOT NULL AND clase IS NULL
UNION ALL SELECT row_id, 'velocidad', 'velocidad', 'warning' FROM t WHERE coalesce(velocidad < 1 OR velocidad > 300, FALSE) OR coalesce(limite > 160, FALSE)""")
def f_rule_kinds(spark, d):
    """Hours, consistency of two columns, and speeds with a limit over 160."""
    return Q.violations(rows(spark, d, SPEEDS), KINDS, "row_id", AS_OF)


CATALOG = ["economy", "Large ", "MEDIUM", "small", "OTHER"]


@query("""SELECT CAST(count(*) AS BIGINT) AS n_seen, CAST(count(*) FILTER (WHERE v IN ('ECONOMY', 'LARGE', 'MEDIUM', 'SMALL', 'OTHER')) AS BIGINT) AS n_known,
  round(100.0 * count(*) FILTER (WHERE v IN ('ECONOMY', 'LARGE', 'MEDIUM', 'SMALL', 'OTHER')) / count(*), 2) AS pct_known, list(v ORDER BY v) FILTER (WHERE v NOT IN ('ECONOMY', 'LARGE', 'MEDIUM', 'SMALL', 'OTHER')) AS examples
FROM (SELECT DISTINCT upper(p_type) AS v FROM part)""")
def q_catalog_circularity(spark, d):
    """How much of a column's values its catalogue already holds."""
    return audit.catalog_circularity(table(spark, d, "part"), "p_type", CATALOG)


REPORTS = "SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS dia, CASE WHEN o_orderkey % 3 = 0 THEN 'x.jpg' END AS foto FROM orders"


@query(f"SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE dia = DATE '1996-01-02') AS BIGINT) AS hoy, CAST(count(foto) AS BIGINT) AS con_foto FROM ({REPORTS})")
def a_report_statistics(spark, d):
    return live.report_statistics(rows(spark, d, REPORTS), "dia", "1996-01-02")


@query("SELECT event_id FROM events WHERE epoch(TIMESTAMP '2024-01-15 12:00:00') - floor(epoch(ts)) BETWEEN 0 AND 899")
def f_fresh(spark, d):
    """Rows younger than their time to live."""
    e = table(spark, d, "events").select("event_id", F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"))
    return live.fresh(e, "ts", "2024-01-15 12:00:00", 900).select("event_id")

"""Scans, projections, filters, joins, aggregates, windows and sets."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numeric as N
from ..functions import text as T
from ..functions.geo import in_box
from ..operators import aggregates as A
from ..operators import spatial as S
from ..operators.cleaning import keep_first
from ..operators.ranks import quantiles
from .base import DIRTY, POINTS, ROAD_EVENTS, SEGMENTS, TOLLS, query, r6, rows, table

FOLD = "nullif(upper(strip_accents(regexp_replace(trim({0}), '\\s+', ' ', 'g'))), '')"


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000")
def sc_parquet_scan(spark, d):
    return table(spark, d, "orders").where("o_totalprice > 300000").select("o_orderkey", "o_totalprice")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def sc_json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def sc_file_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"))


@query("SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def sc_column_pruned(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("SELECT CAST(count(*) AS BIGINT) AS n_rows, 7 AS n_columns FROM events".replace("7", "6"))
def sc_shape(spark, d):
    e = table(spark, d, "events")
    return e.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(e.columns)))


@query("SELECT page_id, CAST(len(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS BIGINT) AS n_links, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def sc_page_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.size(T.links(F.col("html"))).cast("long").alias("n_links"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("SELECT k, v, stamp FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY stamp DESC) AS n FROM (SELECT o_custkey AS k, o_orderkey AS v, o_orderkey AS stamp FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_custkey, -o_orderkey, o_orderkey FROM orders WHERE o_orderkey % 2 = 1)) WHERE n = 1")
def sk_upsert_latest(spark, d):
    o = table(spark, d, "orders")
    old = o.where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"), F.col("o_orderkey").alias("stamp"))
    new = o.where("o_orderkey % 2 = 1").select(F.col("o_custkey").alias("k"), (-F.col("o_orderkey")).alias("v"), F.col("o_orderkey").alias("stamp"))
    return A.upsert(old, new, ["k"], "stamp")


NEW_KEYS = "SELECT user_id, event_type, CAST(floor(value) AS BIGINT) AS v FROM events WHERE event_id % 2 = "


@query(f"SELECT DISTINCT user_id, event_type, v, 'now' AS primera_vista FROM ({NEW_KEYS}1) WHERE (user_id, event_type, v) NOT IN (SELECT (user_id, event_type, v) FROM ({NEW_KEYS}0))")
def sk_archive_dedupe(spark, d):
    from ..sources.sinks import archive_new

    return archive_new(rows(spark, d, NEW_KEYS + "0"), rows(spark, d, NEW_KEYS + "1"), ["user_id", "event_type", "v"], "now")


@query("SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 23 = 0 THEN 'n/a' ELSE CAST(o_orderkey AS VARCHAR) END AS DOUBLE) AS x FROM orders")
def p_try_numeric(spark, d):
    t = F.when(F.col("o_orderkey") % 23 == 0, "n/a").otherwise(F.col("o_orderkey").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", t.try_cast("double").alias("x"))


@query("SELECT o_orderkey, TRY_CAST(regexp_replace(CASE WHEN o_orderkey % 5 = 0 THEN '-' || CAST(o_orderkey AS VARCHAR) || '.5°' WHEN o_orderkey % 7 = 0 THEN 'x1' ELSE '1,' || CAST(o_orderkey AS VARCHAR) END, '[°º, ]', '', 'g') AS DOUBLE) AS x FROM orders")
def p_strip_cast(spark, d):
    k = F.col("o_orderkey").cast("string")
    t = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("-"), k, F.lit(".5°"))).when(F.col("o_orderkey") % 7 == 0, "x1").otherwise(F.concat(F.lit("1,"), k))
    return table(spark, d, "orders").select("o_orderkey", T.lenient_double(t).alias("x"))


@query("SELECT o_orderkey, CAST(coalesce(try_strptime(t, '%Y-%m-%d'), try_strptime(t, '%d/%m/%Y'), try_strptime(t, '%Y%m%d')) AS DATE) AS fecha FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN strftime(o_orderdate, '%Y%m%d') ELSE 'sin fecha' END AS t FROM orders)")
def p_multi_date_parse(spark, d):
    m, day = F.col("o_orderkey") % 4, F.col("o_orderdate")
    t = F.when(m == 0, F.date_format(day, "yyyy-MM-dd")).when(m == 1, F.date_format(day, "dd/MM/yyyy")).when(m == 2, F.date_format(day, "yyyyMMdd")).otherwise("sin fecha")
    return table(spark, d, "orders").select("o_orderkey", T.parse_date(t, ["yyyy-MM-dd", "dd/MM/yyyy", "yyyyMMdd"]).alias("fecha"))


@query("SELECT l_orderkey, l_linenumber, round(CAST(l_orderkey AS DOUBLE) / nullif(CAST(l_linenumber - 1 AS DOUBLE), 0), 6) AS r FROM lineitem")
def p_safe_ratio(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(N.ratio(F.col("l_orderkey"), F.col("l_linenumber") - 1)).alias("r"))


@query("SELECT o_orderkey, CAST(o_orderstatus = 'O' AS BIGINT) AS estado_1, CAST(o_orderstatus = 'P' AS BIGINT) AS estado_2 FROM orders")
def p_onehot(spark, d):
    return table(spark, d, "orders").select("o_orderkey", *N.one_hot(F.col("o_orderstatus"), ["F", "O", "P"], "estado"))


@query("SELECT event_id, CASE WHEN h <= 6 THEN 'madrugada' WHEN h <= 12 THEN 'manana' WHEN h <= 18 THEN 'tarde' ELSE 'noche' END AS parte FROM (SELECT event_id, hour(ts) AS h FROM events)")
def p_daypart_bins(spark, d):
    return table(spark, d, "events").select("event_id", N.day_part(F.hour("ts")).alias("parte"))


@query("SELECT p_partkey, CASE WHEN v <= 60 THEN '<60' WHEN v <= 80 THEN '60-80' WHEN v <= 100 THEN '80-100' ELSE '>100' END AS banda FROM (SELECT p_partkey, p_size * 3 AS v FROM part)")
def p_speed_bins(spark, d):
    return table(spark, d, "part").select("p_partkey", N.speed_band(F.col("p_size") * 3).alias("banda"))


@query("SELECT event_id, CAST(year(ts) AS BIGINT) AS anio, CAST(month(ts) AS BIGINT) AS mes, CAST(isodow(ts) - 1 AS BIGINT) AS dia_semana, CAST(hour(ts) // 3 * 3 AS BIGINT) AS hora3 FROM events")
def p_calendar_features(spark, d):
    return table(spark, d, "events").select("event_id", *[c.alias(k) for k, c in N.calendar(F.col("ts")).items()])


@query("SELECT event_id, round(CASE isodow(ts) WHEN 6 THEN 1.25 WHEN 7 THEN 1.10 ELSE 1.0 END::DOUBLE * CASE WHEN hour(ts) >= 19 OR hour(ts) < 5 THEN 1.30 WHEN hour(ts) < 8 THEN 1.05 ELSE 1.0 END::DOUBLE, 3) AS factor FROM events")
def p_temporal_factor(spark, d):
    return table(spark, d, "events").select("event_id", N.temporal_factor(F.col("ts")).alias("factor"))


@query("SELECT p_partkey, CASE WHEN p_size < 15 THEN 'Bajo' WHEN p_size <= 35 THEN 'Medio' ELSE 'Alto' END AS nivel FROM part")
def p_risk_level(spark, d):
    return table(spark, d, "part").select("p_partkey", N.risk_level(F.col("p_size"), 15, 35).alias("nivel"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 1.0 WHEN 'F' THEN 3.0 ELSE 0.5 END::DOUBLE AS peso FROM orders")
def p_weight_lookup(spark, d):
    return table(spark, d, "orders").select("o_orderkey", N.weight_of(F.col("o_orderstatus"), {"O": 1.0, "F": 3.0}, 0.5).alias("peso"))


@query("SELECT p_partkey, least(greatest(CAST(p_size - 5 AS DOUBLE), 0), (SELECT quantile_cont(p_size, 0.99) FROM part)) AS v FROM part")
def p_clip_p99(spark, d):
    p = table(spark, d, "part")
    top = quantiles(p, "p_size", [0.99]).select(F.col("q")[0].alias("top"))
    return p.join(F.broadcast(top)).select("p_partkey", N.clip((F.col("p_size") - 5).cast("double"), 0.0, F.col("top")).alias("v"))  # one row


@query(f"SELECT row_id FROM ({DIRTY}) WHERE lat BETWEEN -18.5 AND -3 AND lon BETWEEN -80 AND -70")
def f_bbox(spark, d):
    return rows(spark, d, DIRTY).where(in_box(F.col("lat"), F.col("lon"), (-18.5, -3, -80, -70))).select("row_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus IN ('O')")
def f_in_list(spark, d):
    return table(spark, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & F.col("o_orderstatus").isin("O")).select("o_orderkey")


@query("""WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
SELECT event_id, value FROM events, q WHERE value > b + 1.5 * (b - a)""")
def f_iqr_outliers(spark, d):
    e = table(spark, d, "events").select("event_id", "value")
    q = quantiles(e, "value", [0.25, 0.75])
    return e.join(F.broadcast(q)).where(F.col("value") > F.col("q")[1] + 1.5 * (F.col("q")[1] - F.col("q")[0])).drop("q")  # one row


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-08-01' - INTERVAL 30 DAY")
def f_recent_window(spark, d):
    from ..operators.live import recent

    return recent(table(spark, d, "orders"), "o_orderdate", "2001-08-01", 30).select("o_orderkey")


@query(f"SELECT code, CAST(count(*) - 1 AS BIGINT) AS repeats FROM ({DIRTY}) GROUP BY code HAVING count(*) > 1")
def f_unique_violations(spark, d):
    return rows(spark, d, DIRTY).groupBy("code").agg((F.count("*") - 1).alias("repeats")).where("repeats > 0")


@query(f"SELECT row_id, clase FROM ({DIRTY}) WHERE clase IS NOT NULL AND {FOLD.format('clase')} NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')")
def f_allowed_values(spark, d):
    return rows(spark, d, DIRTY).where(F.col("clase").isNotNull() & ~T.fold(F.col("clase")).isin("1-URGENT", "2-HIGH", "3-MEDIUM")).select("row_id", "clase")


@query("SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def j_left_equi(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_mktsegment")


@query("SELECT a.l_orderkey, a.l_linenumber, b.n FROM lineitem a LEFT JOIN (SELECT l_partkey, l_suppkey, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey")
def j_composite(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    n = li.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n")).where("n > 1")
    return li.join(n, ["l_partkey", "l_suppkey"], "left").select("l_orderkey", "l_linenumber", "n")


@query(f"SELECT e.event_id, min(s.seg_id) AS seg_id FROM ({ROAD_EVENTS}) e LEFT JOIN ({SEGMENTS}) s ON e.ruta = s.ruta AND e.km >= s.km0 AND e.km <= s.km1 GROUP BY e.event_id")
def j_interval_first(spark, d):
    e = rows(spark, d, ROAD_EVENTS).select("event_id", "ruta", "km")
    return S.interval_join(e, rows(spark, d, SEGMENTS), "ruta", "km", "km0", "km1", "seg_id", "seg_id", "event_id", 25.0).select("event_id", "seg_id")


@query(f"WITH p AS ({POINTS}), t AS ({TOLLS}), m AS (SELECT c_custkey, s_suppkey, sqrt(power(lat - lat2, 2) + power(lon - lon2, 2)) AS dist, row_number() OVER (PARTITION BY c_custkey ORDER BY sqrt(power(lat - lat2, 2) + power(lon - lon2, 2)), s_suppkey) AS n FROM p, t WHERE sqrt(power(lat - lat2, 2) + power(lon - lon2, 2)) <= 1.5) SELECT p.c_custkey, m.s_suppkey, round(m.dist, 6) AS dist FROM p LEFT JOIN m ON p.c_custkey = m.c_custkey AND n = 1")
def j_nearest_bounded(spark, d):
    return S.nearest_join(rows(spark, d, POINTS), rows(spark, d, TOLLS), "c_custkey", "s_suppkey", ("lat", "lon"), ("lat2", "lon2"), 1.5).select("c_custkey", "s_suppkey", r6("dist").alias("dist"))


@query(f"SELECT c_custkey, s_suppkey, round(dist, 6) AS dist FROM (SELECT c_custkey, s_suppkey, sqrt(power(lat - lat2, 2) + power(lon - lon2, 2)) AS dist, row_number() OVER (PARTITION BY c_custkey ORDER BY sqrt(power(lat - lat2, 2) + power(lon - lon2, 2)), s_suppkey) AS n FROM ({POINTS}), ({TOLLS})) WHERE n = 1")
def j_nearest_unbounded(spark, d):
    return S.nearest_any(rows(spark, d, POINTS), rows(spark, d, TOLLS), "c_custkey", "s_suppkey", ("lat", "lon"), ("lat2", "lon2")).select("c_custkey", "s_suppkey", r6("dist").alias("dist"))


@query(f"SELECT s_suppkey, CAST(count(*) AS BIGINT) AS n FROM ({POINTS}), ({TOLLS}) WHERE sqrt(power(lat - lat2, 2) + power(lon - lon2, 2)) <= 1.0 GROUP BY 1")
def j_radius(spark, d):
    return S.radius_counts(rows(spark, d, POINTS), rows(spark, d, TOLLS), "s_suppkey", ("lat", "lon"), ("lat2", "lon2"), 1.0)


@query(f"SELECT DISTINCT c_custkey FROM ({POINTS}), ({TOLLS}) WHERE sqrt(power(lat - lat2, 2) + power(lon - lon2, 2)) <= 0.75")
def j_radius_semi(spark, d):
    return S.radius_semi(rows(spark, d, POINTS), rows(spark, d, TOLLS), ("lat", "lon"), ("lat2", "lon2"), 0.75).select("c_custkey").distinct()


@query(f"SELECT p.c_custkey, CAST(count(t.s_suppkey) AS BIGINT) AS n FROM ({POINTS}) p LEFT JOIN ({TOLLS}) t ON abs(lat - lat2) <= 1 AND abs(lon - lon2) <= 1 GROUP BY 1")
def j_box_count(spark, d):
    return S.box_counts(rows(spark, d, POINTS), rows(spark, d, TOLLS), "c_custkey", ("lat", "lon"), ("lat2", "lon2"), 1.0)


EDGES = "SELECT CAST(n_nationkey AS BIGINT) AS edge_id, CAST(n_nationkey % 5 AS BIGINT) AS r, CAST(n_nationkey AS DOUBLE) AS km0, CAST(n_nationkey + 1 AS DOUBLE) AS km1, CAST(n_nationkey * 3 % 16 AS DOUBLE) AS x0, CAST(n_nationkey * 5 % 16 AS DOUBLE) AS y0, CAST((n_nationkey * 3 + 4) % 16 AS DOUBLE) AS x1, CAST((n_nationkey * 5 + 2) % 16 AS DOUBLE) AS y1 FROM nation"
XY = "SELECT c_custkey, CAST(c_nationkey % 5 AS BIGINT) AS r, CAST(c_custkey % 17 AS DOUBLE) AS x, CAST(c_custkey * 7 % 13 AS DOUBLE) AS y FROM customer"


@query(f"""WITH b AS (SELECT c_custkey, edge_id, km0, km1, x, y, x0, y0, x1 - x0 AS dx, y1 - y0 AS dy FROM ({XY}) p JOIN ({EDGES}) e ON p.r = e.r),
t AS (SELECT *, least(1, greatest(0, ((x - x0) * dx + (y - y0) * dy) / (dx * dx + dy * dy))) AS t FROM b),
q AS (SELECT c_custkey, edge_id, km0 + t * (km1 - km0) AS km, sqrt(power(x - (x0 + t * dx), 2) + power(y - (y0 + t * dy), 2)) AS dist FROM t)
SELECT c_custkey, edge_id, round(km, 6) AS km, round(dist, 6) AS dist FROM q QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY round(dist, 9), edge_id) = 1""")
def j_polyline_project(spark, d):
    at = S.project_on_route(rows(spark, d, XY), rows(spark, d, EDGES), "c_custkey", "r")
    return at.select("c_custkey", "edge_id", r6("km").alias("km"), r6("dist").alias("dist"))


@query("""WITH n AS (SELECT DISTINCT substr(n_name, 2, 3) AS name FROM nation UNION SELECT 'QQQ')
SELECT name, (SELECT min_by(n_name, n_nationkey) FROM nation WHERE contains(n_name, name) OR contains(name, n_name)) AS place FROM n""")
def j_substring(spark, d):
    n = table(spark, d, "nation")
    names = n.select(F.substring("n_name", 2, 3).alias("name")).distinct().union(spark.createDataFrame([("QQQ",)], "name string"))
    return S.first_containing(names, n.select(F.col("n_name").alias("key"), F.col("n_name").alias("place"), F.col("n_nationkey").alias("ord")))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
def j_anti(spark, d):
    dear = table(spark, d, "orders").where("o_totalprice > 250000")
    return table(spark, d, "customer").join(dear, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def j_semi(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS n_customer, coalesce(b.n, 0) AS n_supplier FROM (SELECT c_nationkey AS k, CAST(count(*) AS BIGINT) AS n FROM customer WHERE c_acctbal < 0 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, CAST(count(*) AS BIGINT) AS n FROM supplier GROUP BY 1) b ON a.k = b.k")
def j_full_outer(spark, d):
    a = table(spark, d, "customer").where("c_acctbal < 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n_customer"))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n_supplier"))
    return a.join(b, "k", "full_outer").na.fill(0, ["n_customer", "n_supplier"])


YEARLY = "SELECT c.c_nationkey AS k, CAST(year(o.o_orderdate) AS BIGINT) AS anio, CAST(count(*) AS BIGINT) AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_nationkey, year(o.o_orderdate)"


@query(f"SELECT k, anio, n, lag(n) OVER (PARTITION BY k ORDER BY anio) AS previo FROM ({YEARLY})")
def j_lag_year(spark, d):
    return rows(spark, d, YEARLY).withColumn("previo", F.lag("n").over(Window.partitionBy("k").orderBy("anio")))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def j_latest_per_key(spark, d):
    return A.latest(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderkey")


@query("SELECT a.n_name AS a_name, b.r_name AS b_name FROM nation a, region b WHERE a.n_nationkey < 3")
def j_cross_grid(spark, d):
    n = table(spark, d, "nation").where("n_nationkey < 3").select(F.col("n_name").alias("a_name"))
    return n.crossJoin(F.broadcast(table(spark, d, "region").select(F.col("r_name").alias("b_name"))))  # the grid is the result; five regions


@query("SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20")
def a_count_by(spark, d):
    return A.aggregate(table(spark, d, "orders"), {"kind": "count_by", "by": "o_orderpriority"})


@query("SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS total, avg(p_size) AS promedio FROM part GROUP BY 1 ORDER BY total DESC, 1 LIMIT 10")
def a_sum_by(spark, d):
    return A.aggregate(table(spark, d, "part"), {"kind": "sum_by", "by": "p_brand", "value": "p_size", "limit": 10})


@query("SELECT p_type, avg(p_size) AS promedio, CAST(count(p_size) AS BIGINT) AS n FROM part WHERE p_size IS NOT NULL GROUP BY 1 ORDER BY promedio DESC, 1 LIMIT 20")
def a_mean_by(spark, d):
    return A.aggregate(table(spark, d, "part"), {"kind": "mean_by", "by": "p_type", "value": "p_size"})


@query("SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS cantidad, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS pedidos FROM lineitem GROUP BY 1, 2")
def a_multi(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("cantidad"), F.count_distinct("l_orderkey").alias("pedidos"))


@query("SELECT c_nationkey, CAST(count(*) FILTER (WHERE c_acctbal < 0) AS BIGINT) AS negativos, round(100.0 * count(*) FILTER (WHERE c_acctbal < 0) / count(*), 6) AS por_100 FROM customer GROUP BY 1")
def a_conditional_rate(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.count_if(F.col("c_acctbal") < 0).alias("negativos"), r6(F.lit(100.0) * F.count_if(F.col("c_acctbal") < 0) / F.count("*")).alias("por_100"))


@query("SELECT c_nationkey, c_mktsegment AS moda FROM (SELECT c_nationkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS n FROM customer GROUP BY 1, 2) WHERE n = 1")
def a_mode(spark, d):
    return A.mode_by(table(spark, d, "customer"), "c_nationkey", "c_mktsegment")


@query("SELECT quantile_cont(l_quantity, 0.25) AS q25, quantile_cont(l_quantity, 0.5) AS q50, quantile_cont(l_quantity, 0.95) AS q95 FROM lineitem")
def a_quantiles(spark, d):
    q = quantiles(table(spark, d, "lineitem"), "l_quantity", [0.25, 0.5, 0.95])
    return q.select(F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q95"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(corr(l_quantity, {c}), 8) AS r FROM lineitem" for c in ("l_extendedprice", "l_discount", "l_tax")))
def a_corr(spark, d):
    return A.correlations(table(spark, d, "lineitem"), "l_quantity", ["l_extendedprice", "l_discount", "l_tax"])


@query("SELECT l_returnflag, CAST(count(*) FILTER (WHERE l_linestatus = 'F') AS BIGINT) AS F, CAST(count(*) FILTER (WHERE l_linestatus = 'O') AS BIGINT) AS O FROM lineitem GROUP BY 1")
def a_pivot(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).count().na.fill(0)


@query("SELECT mes, round(avg(n), 6) AS media FROM (SELECT CAST(year(o_orderdate) AS BIGINT) AS anio, CAST(month(o_orderdate) AS BIGINT) AS mes, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY mes")
def a_month_mean(spark, d):
    n = table(spark, d, "orders").groupBy(F.year("o_orderdate").cast("long").alias("anio"), F.month("o_orderdate").cast("long").alias("mes")).count()
    return n.groupBy("mes").agg(r6(F.avg("count")).alias("media"))


@query("SELECT event_type, CAST(hour(ts) // 3 * 3 AS BIGINT) AS hora3, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def a_timebuckets(spark, d):
    return table(spark, d, "events").groupBy("event_type", N.calendar(F.col("ts"))["hora3"].alias("hora3")).agg(F.count("*").alias("n"))


@query(f"SELECT row_id, code FROM (SELECT row_id, code, row_number() OVER (PARTITION BY code ORDER BY row_id) AS n FROM ({DIRTY})) WHERE n = 1")
def a_dedupe_first(spark, d):
    return keep_first(rows(spark, d, DIRTY).select("row_id", "code"), ["code"], "row_id")


@query(f"SELECT CAST(count(*) - count(DISTINCT (lat, lon)) AS BIGINT) AS por_punto, CAST(count(*) - count(DISTINCT (lat, lon, estado)) AS BIGINT) AS por_punto_estado FROM ({DIRTY})")
def a_dup_counts(spark, d):
    return rows(spark, d, DIRTY).agg((F.count("*") - F.count_distinct(F.struct("lat", "lon"))).alias("por_punto"), (F.count("*") - F.count_distinct(F.struct("lat", "lon", "estado"))).alias("por_punto_estado"))


@query("SELECT node, CAST(count(*) AS BIGINT) AS degree FROM (SELECT l_partkey AS node FROM lineitem UNION ALL SELECT -l_suppkey FROM lineitem) GROUP BY 1")
def a_degree(spark, d):
    return A.degree(table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), (-F.col("l_suppkey")).alias("dst")))


@query(f"SELECT min(fecha) AS first_day, max(fecha) AS last_day, CAST(sum(n) AS BIGINT) AS n, CAST(sum(d) AS BIGINT) AS n_days, CAST(max(y) - min(y) + 1 - count(*) AS BIGINT) AS empty_years, round(100.0 * max(n) / sum(n), 4) AS modal_pct FROM (SELECT year(fecha) AS y, count(*) AS n, count(DISTINCT fecha) AS d, min(fecha) AS lo, max(fecha) AS hi FROM ({DIRTY}) WHERE fecha IS NOT NULL GROUP BY 1), (SELECT min(fecha) AS fecha FROM ({DIRTY}) UNION ALL SELECT max(fecha) FROM ({DIRTY}))".replace("min(fecha) AS first_day, max(fecha) AS last_day", "min(lo) AS first_day, max(hi) AS last_day", 1).replace(f", (SELECT min(fecha) AS fecha FROM ({DIRTY}) UNION ALL SELECT max(fecha) FROM ({DIRTY}))", ""))
def a_coverage_years(spark, d):
    return A.year_coverage(rows(spark, d, DIRTY), "fecha")


@query("""WITH y AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS anio, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1),
m AS (SELECT *, avg(n) OVER (ORDER BY anio ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM y)
SELECT anio, n, round(m, 6) AS media_previa, round(100.0 * (1 - n / m), 4) AS caida_pct FROM m""")
def a_annual_drop(spark, d):
    return A.annual_drop(A.rows_by_year(table(spark, d, "orders"), "o_orderdate"))


@query(f"SELECT k, anio, round(n / 365.0, 6) AS imd FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY anio DESC) AS r FROM ({YEARLY})) WHERE r = 1")
def a_aadt(spark, d):
    return A.daily_traffic(rows(spark, d, YEARLY).withColumnRenamed("n", "v"), "k", "anio", "v")


@query(f"""WITH e AS (SELECT abs(lat - round(lat)) AS e FROM ({POINTS})) SELECT round(avg(e), 6) AS media,
  {', '.join(f'round(quantile_cont(e, 0.{p}), 9) AS p{p}' for p in (50, 90, 95, 99))},
  round(100.0 * count(*) FILTER (WHERE e < 0.3) / count(*), 4) AS pct_cerca FROM e""".replace("0.50)", "0.5)"))
def a_error_dist(spark, d):
    return A.error_summary(rows(spark, d, POINTS).select(F.abs(F.col("lat") - F.round("lat")).alias("e")), "e", 0.3)


@query("SELECT c_custkey, round(c_acctbal / sum(abs(c_acctbal)) OVER (PARTITION BY c_nationkey), 8) AS parte FROM customer")
def w_group_share(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(F.col("c_acctbal") / F.sum(F.abs("c_acctbal")).over(Window.partitionBy("c_nationkey")), 8).alias("parte"))


@query("SELECT c_custkey FROM customer JOIN (SELECT c_nationkey AS k, quantile_cont(c_acctbal, 0.95) AS q FROM customer GROUP BY 1) ON c_nationkey = k WHERE c_acctbal > q")
def w_group_p95(spark, d):
    c = table(spark, d, "customer")
    return c.join(quantiles(c, "c_acctbal", [0.95], ["c_nationkey"]), "c_nationkey").where(F.col("c_acctbal") > F.col("q")[0]).select("c_custkey")


PARTS = "SELECT c_custkey, c_nationkey AS g, CAST(1000 + c_nationkey AS BIGINT) AS total, CAST(1 + c_custkey % 9 AS BIGINT) AS w FROM customer"


@query(f"WITH x AS (SELECT c_custkey, g, total, CAST(total * w AS DOUBLE) / sum(w) OVER (PARTITION BY g) AS x FROM ({PARTS})), f AS (SELECT *, floor(x) AS f, total - sum(floor(x)) OVER (PARTITION BY g) AS l, row_number() OVER (PARTITION BY g ORDER BY round(x - floor(x), 9) DESC, c_custkey) AS n FROM x) SELECT c_custkey, CAST(f + CASE WHEN n <= l THEN 1 ELSE 0 END AS BIGINT) AS share FROM f")
def w_largest_remainder(spark, d):
    return A.largest_remainder(rows(spark, d, PARTS), "g", "total", "w", "c_custkey").select("c_custkey", "share")


@query(f"SELECT c_custkey, CAST(floor(CAST(total * w AS DOUBLE) / sum(w) OVER (PARTITION BY g) + 0.5) AS BIGINT) AS share FROM ({PARTS})")
def w_prop_round(spark, d):
    w = F.sum("w").over(Window.partitionBy("g"))
    return rows(spark, d, PARTS).select("c_custkey", F.floor(F.col("total") * F.col("w") / w + 0.5).alias("share"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def s_topk(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(15)


@query("SELECT p_partkey, p_size = (SELECT min(p_size) FROM part) AS corta, p_retailprice = (SELECT min(p_retailprice) FROM part) AS segura FROM part")
def s_argmin_ties(spark, d):
    from ..operators.routes import fewest

    return fewest(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), {"corta": "p_size", "segura": "p_retailprice"}).select("p_partkey", "corta", "segura")


@query("SELECT c_custkey AS id, c_mktsegment AS segmento, NULL::BIGINT AS n FROM customer UNION ALL SELECT s_suppkey, NULL, CAST(s_nationkey AS BIGINT) FROM supplier")
def s_union_missing(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segmento"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("n"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT k, 'ambos' AS lado FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT k, 'solo cliente' FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier)")
def s_intersect_except(spark, d):
    a, b = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    return a.intersect(b).withColumn("lado", F.lit("ambos")).unionByName(a.subtract(b).withColumn("lado", F.lit("solo cliente")))


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus <> 'F')
SELECT round(CAST((SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) AS DOUBLE) / (SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)), 6) AS jaccard""")
def s_jaccard(spark, d):
    o = table(spark, d, "orders")
    return A.jaccard(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus <> 'F'"), "o_custkey")


@query(f"SELECT doc_id, {FOLD.format("replace(text, 'ß', 'ss')")} AS t FROM documents".replace("\\s+", "[ \\t\\n\\r\\f\\v]+"))
def x_fold(spark, d):
    return table(spark, d, "documents").select("doc_id", T.fold(F.col("text")).alias("t"))


@query("SELECT doc_id, regexp_replace(lower(strip_accents(text)), '[^a-z0-9]', '', 'g') AS k FROM documents")
def x_alnum_key(spark, d):
    return table(spark, d, "documents").select("doc_id", T.alnum_key(F.col("text")).alias("k"))


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)err|fail') THEN 'fallo' WHEN regexp_matches(text, '(?i)\\?') THEN 'pregunta' WHEN regexp_matches(text, '(?i)the') THEN 'ingles' ELSE 'otro' END AS clase FROM conversations")
def x_regex_class(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.classify(F.col("text"), {"fallo": "err|fail", "pregunta": "\\?", "ingles": "the"}, "otro").alias("clase"))


@query("SELECT page_id, TRY_CAST(replace(regexp_extract(url, '(\\d+(?:[.,]\\d+)?)', 1), ',', '.') AS DOUBLE) AS n FROM pages")
def x_first_number(spark, d):
    return table(spark, d, "pages").select("page_id", T.first_number(F.col("url")).alias("n"))


@query("SELECT n_nationkey, regexp_replace(trim(n_name), '([NSEW])$', '') AS c FROM nation")
def x_corridor(spark, d):
    return table(spark, d, "nation").select("n_nationkey", T.corridor(F.col("n_name")).alias("c"))


@query("""SELECT doc_id, CAST(len(t) AS BIGINT) AS n, md5(array_to_string(t, '|')) AS tokens FROM (SELECT doc_id, list_filter(list_transform(
  string_split_regex(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+[yYeE][ \\t\\n\\r\\f\\v]+|[-–—:()]', '|', 'g'), '\\|'), lambda x: trim(x, ' ')),
  lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^sector\\s*\\d+$')) AS t FROM documents)""")
def x_tokens(spark, d):
    t = table(spark, d, "documents").select("doc_id", T.place_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", "|").cast("binary")).alias("tokens"))


@query(f"SELECT c_custkey, round(2 * 6371 * asin(sqrt(power(sin((radians(lat) - radians(10)) / 2), 2) + cos(radians(10)) * cos(radians(lat)) * power(sin((radians(lon) - radians(5)) / 2), 2))), 4) AS km FROM ({POINTS})")
def x_haversine(spark, d):
    from ..functions.geo import haversine_km

    return rows(spark, d, POINTS).select("c_custkey", F.round(haversine_km(F.lit(10.0), F.lit(5.0), F.col("lat"), F.col("lon")), 4).alias("km"))


@query("SELECT o_orderkey, sha256(concat_ws(':', CAST(o_orderkey AS VARCHAR), o_orderstatus)) AS id FROM orders")
def x_hash_id(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.record_id(F.col("o_orderkey"), F.col("o_orderstatus")).alias("id"))


@query("SELECT p_partkey, round(2 * (CASE WHEN y > 0 THEN y * ln(y / 2.5::DOUBLE) ELSE 0 END - (y - 2.5)), 6) AS dev FROM (SELECT p_partkey, CAST(p_size % 6 AS DOUBLE) AS y FROM part)")
def x_poisson_dev(spark, d):
    return table(spark, d, "part").select("p_partkey", r6(N.poisson_deviance((F.col("p_size") % 6).cast("double"), F.lit(2.5))).alias("dev"))


@query("""SELECT k, round(path / nullif(sqrt(power(lx - fx, 2) + power(ly - fy, 2)), 0), 6) AS s FROM (
  SELECT k, sum(step) AS path, first(x ORDER BY i) AS fx, last(x ORDER BY i) AS lx, first(y ORDER BY i) AS fy, last(y ORDER BY i) AS ly FROM (
    SELECT *, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS step FROM (
      SELECT c_nationkey AS k, c_custkey AS i, CAST(c_custkey % 17 AS DOUBLE) AS x, CAST(c_custkey * 7 % 13 AS DOUBLE) AS y FROM customer) WINDOW w AS (PARTITION BY k ORDER BY i))
  GROUP BY k HAVING count(*) > 1)""")
def x_sinuosity(spark, d):
    from ..operators.routes import sinuosity_by_route

    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("i"), (F.col("c_custkey") % 17).cast("double").alias("x"), (F.col("c_custkey") * 7 % 13).cast("double").alias("y"))
    return sinuosity_by_route(c, "k").select("k", r6("s").alias("s"))
"""Running ranks, matching in rounds, validation, exports and edge cases."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from corduroy.operators import aggregates, cleaning, matching, models, quality, ranks, routes, spatial
from corduroy.session import steps
from corduroy.sources import files, sinks


def quantile(values, q):
    v = sorted(values)
    at = q * (len(v) - 1)
    low = math.floor(at)
    return v[low] * (1 - (at - low)) + v[math.ceil(at)] * (at - low)


def test_quantiles_of_groups_with_ties_nulls_and_one_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot", float(rng.randrange(50))) for _ in range(2000)] + [("b", float(i)) for i in range(7)] + [("b", None), ("none", None), (None, 3.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: list(r.q) for r in ranks.quantiles(df, "v", [0.0, 0.25, 0.9, 1.0], ["k"]).collect()}
    for k in ("hot", "b", None):
        mine = [v for key, v in rows if key == k and v is not None]
        assert got[k] == pytest.approx([quantile(mine, q) for q in (0.0, 0.25, 0.9, 1.0)])
    assert "none" not in got
    assert list(ranks.quantiles(df.limit(0), "v", [0.5]).first().q) == [None]


def test_numbers_follow_the_order_over_all_partitions(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v")).repartition(7)
    assert ranks.numbered(df, ["v"]).where("i <> v").count() == 0
    assert sorted(r.v for r in ranks.every_nth(df, "v", 10).collect()) == [499 + 500 * j for j in range(10)]


def test_matching_in_rounds_equals_greedy(spark, monkeypatch):
    monkeypatch.setattr(matching, "LAST_PAIRS", 5)
    rng = random.Random(9)
    pairs = {(rng.randrange(60), rng.randrange(60)): rng.randrange(20) / 4 for _ in range(500)}
    df = spark.createDataFrame([(a, b, d) for (a, b), d in pairs.items()], "a_id long, b_id long, dist_km double")
    got = {(r.a_id, r.b_id) for r in matching.one_to_one(df, steps(spark)).collect()}
    free, want = set(range(60)), set()
    for b in range(60):
        near = sorted((d, a) for (a, b2), d in pairs.items() if b2 == b and a in free)
        if near:
            want.add((near[0][1], b))
            free.discard(near[0][1])
    assert got == want
    assert matching.one_to_one(df.limit(0), steps(spark)).count() == 0


def test_profile_of_an_empty_table_and_of_empty_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (3, None, "x"), (3, None, None)], "a long, b double, c string")
    got = {r.column: r for r in quality.profile(df, top=2).collect()}
    assert (got["a"].mean, got["a"].q25, got["a"].n_unique, got["b"].n_null, got["b"].min) == (2.3333, 2.0, 2, 3, None)
    assert got["a"].std == round(statistics.stdev([1, 3, 3]), 4) and got["c"].top_values == ["x"]
    assert quality.profile(df.limit(0)).count() == 0


def test_score_of_empty_tables_and_columns(spark):
    spec = {"required": ["a"], "ranges": {"a": (0, 2)}, "numeric": ["a", "b"], "catalogs": {"c": ["ñandú"]}, "key": ["a", "c"], "nominal": ["c"], "date": "d"}
    df = spark.createDataFrame([(1, None, "Nandu", None), (3, None, "Nandu", None)], "a long, b double, c string, d date")
    row = quality.dimensions(df, spec, "2024-01-01").first()
    assert (row.completeness, row.validity, row.uniqueness, row.consistency, row.freshness) == (100.0, 75.0, 100.0, 0.0, 0.0)
    empty = quality.dimensions(df.limit(0), spec, "2024-01-01").first()
    assert (empty.completeness, empty.uniqueness, empty.freshness) == (100.0, 100.0, 0.0)
    boot = {r.dimension: r for r in quality.bootstrap_score(df, spec, "2024-01-01", draws=50).collect()}
    assert boot["dqs"].low <= boot["dqs"].point <= boot["dqs"].high and boot["uniqueness"].width == 0
    with pytest.raises(ValueError):
        quality.contract_report(df, {"columns": {"a": {"max_before_today_days": 3}}})
    with pytest.raises(ValueError):
        quality.contract_report(df, {"columns": {"a": {"type": "number"}}})


def test_contract_ranges_and_catalogue_names():
    contract = {"columns": {"a": {"type": "integer", "min": 1}, "b": {"type": "float"}, "c": {"type": "string", "min": "x"}}}
    assert quality.contract_ranges(contract) == {"a": (1, math.inf)}
    assert quality.resolve_catalogs(["clase"], {"clases": ["x"], "zona": ["y"], "vacio": []}, {"clases": "clase"}) == {"clase": ["x"]}
    assert [quality.sensitivity_verdict(x) for x in (1, 8, 20)] == ["ALTA", "MEDIA", "BAJA"]


def test_medians_come_from_the_training_rows(spark):
    train = spark.createDataFrame([(1.0, None), (3.0, None)], "a double, b double")
    test = spark.createDataFrame([(None, None), (9.0, 4.0)], "a double, b double")
    assert sorted(map(tuple, cleaning.impute(test, {"a": "median", "b": "median"}, fit=train).collect())) == [(2.0, 0.0), (9.0, 4.0)]


def test_exposure_and_constant_columns_are_checked(spark):
    df = spark.createDataFrame([(1.0, 5.0, 1.0), (2.0, 5.0, 2.0)], "x double, same double, expo double")
    _, vary, constant = models.checked_design(df, ["x", "same"], "expo")
    assert (vary, constant) == (["x"], ["same"])
    with pytest.raises(ValueError):
        models.checked_design(df.withColumn("expo", F.col("x") - 1), ["x"], "expo")


def test_likelihood_equals_the_formula(spark):
    rng = random.Random(2)
    rows = [(float(rng.randrange(9)), rng.random() * 4 + 0.1) for _ in range(200)]
    got = models.log_likelihood(spark.createDataFrame(rows, "y double, mu double"), "y", "mu", [0.0, 0.7])
    r = 1 / 0.7
    want = sum(math.lgamma(y + r) - math.lgamma(r) - math.lgamma(y + 1) + r * math.log(r / (r + m)) + y * math.log(m / (r + m)) for y, m in rows)
    assert got[0.7] == pytest.approx(want) and got[0.0] == pytest.approx(sum(y * math.log(m) - m - math.lgamma(y + 1) for y, m in rows))


def test_cluster_covariance_equals_the_sandwich(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    x, g = rng.normal(size=300), rng.integers(0, 12, 300)
    y = rng.poisson(np.exp(0.3 + 0.4 * x))
    df = spark.createDataFrame([(float(a), float(b), int(c)) for a, b, c in zip(y, x, g)], "y double, x double, g long").withColumn("one", F.lit(1.0))
    m = models.fit_counts(df, "y", ["one", "x"])
    design = np.stack([np.ones(300), x], 1)
    score = design * (y - np.exp(design @ m["beta"]))[:, None]
    sums = np.stack([score[g == k].sum(0) for k in range(12)])
    assert models.cluster_cov(df, m, "y", "g") == pytest.approx(m["cov"] @ (sums.T @ sums) @ m["cov"])


def test_strided_points_hold_both_ends(spark):
    df = spark.createDataFrame([("a", i) for i in range(23)] + [("b", i) for i in range(3)], "route_id string, i long")
    for n in (2, 5, 23, 40):
        got = sorted(r.i for r in routes.strided(df, n).where("route_id = 'a'").collect())
        assert got == sorted({math.floor(j * 22 / (n - 1) + 0.5) for j in range(n)}) if n < 23 else got == list(range(23))


def test_places_at_kilometres_beyond_the_ends(spark):
    line = spark.createDataFrame([("r", i, 0.0, i / 10) for i in range(4)], "route_id string, i long, lat double, lon double")
    rows = [(1, "r", 0.0), (2, "r", -3.0), (3, "r", -9.0), (4, "r", 36.0), (5, "r", 60.0), (6, "q", 1.0)]
    got = {r.id: r.lon for r in routes.place_at_km(spark.createDataFrame(rows, "id long, route_id string, km double"), line).collect()}
    assert got[1] == got[2] == 0.0 and got[3] is None and got[4] == pytest.approx(0.3) and got[5] is None and got[6] is None


def test_texts_that_hold_each_other(spark):
    names = spark.createDataFrame([("ab",), ("lima norte",), ("",), ("zz",), (None,)], "name string")
    places = spark.createDataFrame([("cabo", "p1", 2), ("abra", "p2", 1), ("lima", "p3", 3), ("", "p4", 0)], "key string, place string, ord long")
    got = {r.name: r.place for r in spatial.first_containing(names, places).collect()}
    assert got == {"ab": "p2", "lima norte": "p3", "": None, "zz": None, None: None}


def test_registers_exports_and_whole_writes(spark, tmp_path):
    root = f"file://{tmp_path}"
    df = spark.createDataFrame([(1, "ñ", 2.5)], "id long, nombre string, lat double")
    sinks.write_bronze(df, root, "d", "1", "aa", "2024-01-01")
    sinks.write_bronze(df, root, "d", "1", "bb", "2024-01-02")
    assert {r.source_md5: r.superseded for r in sinks.bronze_register(spark, root, "d").collect()} == {"aa": True, "bb": False}
    assert not sinks.exists(spark, f"{root}/nothing")
    (tmp_path / "part").mkdir()
    assert not sinks.exists(spark, f"{root}/part")
    df = df.coalesce(1)
    sinks.write_csv(df, f"{root}/csv")
    text = next((tmp_path / "csv").glob("*.csv")).read_bytes()
    assert text.startswith("\ufeffid,nombre,lat".encode()) and "ñ".encode() in text
    sinks.write_json(df, f"{root}/json", {"lugar": ["nombre", "lat"]})
    assert next((tmp_path / "json").glob("*.json")).read_text() == '{"id":1,"lugar":{"nombre":"ñ","lat":2.5}}\n'
    df.write.parquet(f"{root}/a")
    assert files.query_files(spark, "SELECT count(*) AS n FROM {t}", t=f"{root}/a").first().n == 1
    (tmp_path / "conf").mkdir()
    (tmp_path / "conf" / "b.yaml").write_text("x: 1")
    (tmp_path / "conf" / "a.yml").write_text("")
    assert files.read_configs(f"{tmp_path}/conf") == {"a": {}, "b": {"x": 1}}
    df.createOrReplaceTempView("held_rows")
    assert files.read_table(spark, "held_rows", ["id"]).first().id == 1


def test_lineage_keeps_the_latest_row_of_each_run(spark, tmp_path):
    path = f"file://{tmp_path}/lineage"
    row = lambda run, dqs, at: spark.createDataFrame([(run, dqs, at)], "run_id string, dqs double, created_at string")
    for r in (row("a", 90.0, "1"), row("b", 80.0, "1"), row("a", 95.0, "2")):
        now = sinks.record_lineage(spark, path, r, ["run_id"])
    assert sorted((r.run_id, r.dqs) for r in now.collect()) == [("a", 95.0), ("b", 80.0)]


def test_flags_of_segments_and_empty_years(spark):
    df = spark.createDataFrame([("2020-05-01",), ("2023-01-01",), (None,)], "d string").select(F.to_date("d").alias("d"))
    assert sorted(r.anio for r in aggregates.years_without(df, "d").collect()) == [2021, 2022]
    assert aggregates.years_without(df.limit(0), "d").count() == 0


def test_an_exact_share_is_held_out(spark):
    df = spark.range(103).withColumnRenamed("id", "k")
    one, two = ({r.k for r in models.split_exactly(t, "k").where("is_test").collect()} for t in (df, df.repartition(5)))
    assert one == two and len(one) == 20


def test_letters_with_marks_and_dates_with_the_day_first(spark):
    from corduroy.functions import text

    df = spark.createDataFrame([("Ṽi\u0301ctor  Şahin ǎ", "3/2/2021"), (None, "2021-02-03")], "t string, d string")
    got = df.select(text.fold(F.col("t")).alias("t"), text.parse_date(F.col("d"), ["yyyy-MM-dd"], day_first=True).cast("string").alias("d")).collect()
    assert [tuple(r) for r in got] == [("VICTOR SAHIN A", "2021-02-03"), (None, "2021-02-03")]


def test_each_source_has_its_time_to_live(spark):
    from corduroy.operators import live

    df = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:00:00"), ("c", "2024-01-01 00:00:00")], "s string, at string")
    assert [r.s for r in live.fresh_by(df, "at", "2024-01-01 00:10:00", "s", {"a": 900, "b": 300}).collect()] == ["a"]


def test_runs_of_a_folder_of_configurations_are_tried_again(spark, tmp_path):
    from corduroy import pipeline

    (tmp_path / "x.yaml").write_text("source: {source_type: nothing, path: none}\ncontract: {columns: {}}\nquality: {required: []}\nrow_id: id\n")
    datasets = pipeline.load_config(str(tmp_path))
    (result,) = pipeline.run_all(spark, datasets, f"file://{tmp_path}/lake", "2024-01-01")
    assert list(datasets) == ["x"] and result["status"] == "FAILED" and result["run_id"].endswith("-1")

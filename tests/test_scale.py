"""Components, matching in all tolerances, nearest neighbours, streams, polled feeds, bootstrap, estimators and the lineage log."""

import datetime as dt
import json
import math
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corduroy.functions import numeric
from corduroy.operators import audit, estimators, graph, live, matching, models, quality, spatial
from corduroy.session import steps
from corduroy.sources import polled
from corduroy.sources.lineage import LineageLog
from corduroy.streaming import live as streams

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def roots(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = root(u), root(v)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("last", [3, 10**6])
def test_components_equal_union_find(spark, monkeypatch, last):
    monkeypatch.setattr(graph, "LAST_EDGES", last)
    monkeypatch.setattr(graph, "HELD_NODES", 20 if last == 3 else 10**6)
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(300, 300), (-5, 7), (7, 7)]
    df = spark.createDataFrame([*edges, (None, 3), (4000, None)], "u long, v long")
    assert {r.node: r.component for r in graph.components(df, steps(spark)).collect()} == roots(edges)
    assert graph.components(df.limit(0), steps(spark)).count() == 0


def test_labels_find_two_cliques(spark):
    edges = [(i, j) for i in range(6) for j in range(i)] + [(i, j) for i in range(10, 17) for j in range(10, i)] + [(0, 10), (0, 10), (50, 50)]
    labels = graph.label_propagation(spark.createDataFrame(edges, "u long, v long"), steps(spark))
    assert sorted(tuple(r) for r in graph.community_sizes(labels).collect()) == [(0, 6), (10, 7), (50, 1)]


def greedy(pairs):
    free, out = {a for a, _ in pairs}, set()
    for b in sorted({b for _, b in pairs}):
        near = sorted((d, a) for (a, b2), d in pairs.items() if b2 == b and a in free)
        if near:
            out.add((near[0][1], b))
            free.discard(near[0][1])
    return out


@pytest.mark.parametrize(("bound", "grouped"), [(10**6, False), (40, False), (0, False), (40, True)])
def test_matching_settles_all_cells_like_the_greedy_version(spark, monkeypatch, bound, grouped):
    monkeypatch.setattr(matching, "LAST_PAIRS", bound)
    rng = random.Random(7)
    pairs = {(rng.randrange(40), rng.randrange(40)): rng.randrange(12) / 4 for _ in range(110)}
    cells = {k: rng.randrange(1, 8) for k in pairs}
    df = spark.createDataFrame([(a, b, d, cells[a, b], a // 3, b // 3) for (a, b), d in pairs.items()], "a_id long, b_id long, dist_km double, cells long, at_a long, at_b long")
    rows = matching.settled(df if grouped else df.drop("at_a", "at_b"), steps(spark)).collect()
    for c in range(3):
        assert {(r.a_id, r.b_id) for r in rows if r.cells >> c & 1} == greedy({k: d for k, d in pairs.items() if cells[k] >> c & 1})


def test_grid_of_tolerances_equals_single_matchings(spark):
    rng = random.Random(3)
    day = dt.date(2024, 3, 1)
    rows = lambda: [(i, day + dt.timedelta(rng.randrange(12)), -12 + rng.randrange(12) / 1000, -77 + rng.randrange(12) / 1000) for i in range(60)]
    a, b = (spark.createDataFrame(rows(), "id long, fecha date, lat double, lon double") for _ in range(2))
    got = {(r.radius_km, r.days): r for r in matching.sensitivity(a, b, [0.2, 0.6], [0, 3], steps(spark)).collect()}
    for (km, days), r in got.items():
        near = {(p.a_id, p.b_id): p.dist_km for p in matching.candidates(a, b, 0.6, 3).collect() if p.dist_km <= km and p.gap_days <= days}
        n = len(greedy(near))
        assert (r.n_both, r.n_union, r.n_naive, r.n_avoided) == (n, 120 - n, 120, n)
    assert len(got) == 4
    with pytest.raises(ValueError):
        matching.sensitivity(a, b, [1.0] * 8, list(range(8)), steps(spark))


@pytest.mark.parametrize("outlier", [False, True])
def test_nearest_by_leaves_equals_brute_force(spark, monkeypatch, outlier):
    monkeypatch.setattr(spatial, "FANOUT", 4)
    monkeypatch.setattr(spatial, "LEAF_POINTS", 8)
    rng = random.Random(1)
    right = [(i, rng.random(), rng.choice([0.5, rng.random()])) for i in range(400)] + [(7000, 0.25, 0.25), (6999, 0.25, 0.25)] + ([(9000, 1000.0, -1000.0)] if outlier else [])
    left = [(i, rng.random() * 1.5, rng.random() * 1.5) for i in range(200)] + [(1000, 900.0, -900.0), (1001, 0.25, 0.25), (1002, None, 1.0), (1003, math.nan, 1.0)]
    df = spark.createDataFrame(right, "r long, u double, v double")
    placed, boxes = spatial._leaves(df, "u", "v", "r")
    assert placed.groupBy("leaf").count().agg(F.max("count")).first()[0] == 8 and len(boxes) == -(-len(right) // 8)
    every = spark.createDataFrame([*right, (1, None, 0.0)], df.schema)
    got = {r.l: r for r in spatial.nearest_any(spark.createDataFrame(left, "l long, x double, y double"), every, "l", "r", ("x", "y"), ("u", "v")).collect()}
    for i, x, y in left[:-2]:
        d, r = min((math.hypot(x - u, y - v), r) for r, u, v in right)
        assert (got[i].r, got[i].dist) == (r, pytest.approx(d, rel=1e-12))
    assert got[1002].r is None and got[1003].dist is None and len(got) == len(left)
    nothing = spatial.nearest_any(spark.createDataFrame(left, "l long, x double, y double"), every.limit(0), "l", "r", ("x", "y"), ("u", "v"))
    assert nothing.where("r IS NULL").count() == len(left)


def test_projection_on_long_routes_equals_brute_force(spark):
    rng = random.Random(4)
    edges = []
    for route, n in (("a", 120), ("b", 1), ("c", 7)):
        x = y = 0.0
        for k in range(n):
            u, v = x + rng.uniform(-1, 2), y + rng.uniform(-1, 1)
            edges.append((route, len(edges), float(k), k + 1.0, x, y, u, v))
            x, y = u, v
    edges.append(("a", len(edges), 0.0, 1.0, *edges[0][4:]))  # a tie
    points = [(i, rng.choice("abcz"), rng.uniform(-5, 70), rng.uniform(-20, 20)) for i in range(150)] + [(900, "a", 5000.0, 1.0), (901, "a", None, 1.0)]
    got = {r.p: r for r in spatial.project_on_route(spark.createDataFrame(points, "p long, r string, x double, y double"), spark.createDataFrame(edges, "r string, edge_id long, km0 double, km1 double, x0 double, y0 double, x1 double, y1 double"), "p", "r").collect()}

    def far(x, y, e):
        dx, dy = e[6] - e[4], e[7] - e[5]
        t = min(1.0, max(0.0, ((x - e[4]) * dx + (y - e[5]) * dy) / (dx * dx + dy * dy)))
        return math.hypot(x - e[4] - t * dx, y - e[5] - t * dy)

    want = {i: min((round(far(x, y, e), 9), e[1]) for e in edges if e[0] == r) for i, r, x, y in points if r != "z" and x is not None}
    assert {i: (round(r.dist, 9), r.edge_id) for i, r in got.items()} == want


def test_stream_of_reports_equals_the_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rng, base = random.Random(3), dt.datetime(2024, 1, 1)
    rows = [(i, rng.choice("ab"), -12 + rng.random() * 0.02, -77 + rng.random() * 0.02, base + dt.timedelta(seconds=i * 20 + rng.randrange(300)), i // 50) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, tipo string, lat double, lon double, ts timestamp, batch int")
    closing = spark.createDataFrame([(10**6, "z", 0.0, 0.0, dt.datetime(2030, 1, 1), 9)], df.schema)
    got = streams.finished(lambda s: streams.repeated_stream(s, 0.5, 600), df, closing, "batch", f"file://{tmp_path}", 3).collect()
    want = live.repeated_reports(df.withColumn("t", F.unix_micros("ts") / 1e6), 0.5, 600)
    assert len(got) == 150 and {r.id: r.repeated for r in got} == {r.id: r.repeated for r in want.collect()}
    assert 0 < sum(r.repeated for r in got) < 150


def test_large_batches_of_a_replay_are_several_files_of_one_trigger(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "FILE_ROWS", 10)
    df = spark.range(0, 158, 1, 7).select("id", F.when(F.col("id") < 95, 0).when(F.col("id") < 97, 1).when(F.col("id") < 150, 3).otherwise(9).cast("long").alias("batch"))
    triggers = []
    stream = streams.replay(df, "batch", f"file://{tmp_path}", 4)  # 95, 2, 0 and 53 rows; what has another number is not in the stream
    stream.writeStream.foreachBatch(lambda b, k: triggers.append(sorted(r.id for r in b.collect()))).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert triggers == [list(range(95)), [95, 96], [], list(range(97, 150))]
    sizes = [r.n for r in spark.read.parquet(f"file://{tmp_path}/in").groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 9 + 1 + 5 and max(sizes) < 20


class _Cell:
    """What a processor asks of Spark for one key: list states by name, timers and the watermark."""

    def __init__(self, watermark=0):
        self.lists, self.timers, self.asked, self.watermark = {}, set(), 0, watermark

    def getListState(self, name, schema):
        cell, rows = self, self.lists.setdefault(name, [])

        class State:
            exists = lambda self: bool(rows)
            clear = lambda self: rows.clear()

            def get(self):
                cell.asked += 1
                return iter(list(rows))

            def appendList(self, new):
                rows.extend(new)

            def put(self, new):
                rows[:] = new

        return State()

    def registerTimer(self, ms):
        self.timers.add(ms)

    def getCurrentWatermarkInMs(self):
        return self.watermark


def test_reports_of_a_cell_are_told_with_few_timers_and_leave_no_state():
    """2,000 reports of one place in as many seconds, all but one of each span told at once; what only passes by leaves as well."""
    pdf = pd.DataFrame({"id": range(2000), "lat": -12.0, "lon": -77.0, "t": [k * 1_000_000 for k in range(2000)], "own": True})
    near = streams.NearReports(0.5, 600)
    cell = _Cell()
    near.init(cell)
    at_once = pd.concat(list(near.handleInputRows(("a", 0, 0), iter([pdf]), cell)))
    assert len(at_once) == 1996 and at_once.repeated.all() and len(cell.timers) <= 2 * 4
    later = []
    for ms in sorted(cell.timers):
        cell.watermark = ms
        later += list(near.handleExpiredTimer(("a", 0, 0), cell, None))
    told = {r.id: r.repeated for df in later for r in df.itertuples()}
    assert told == {0: False, 600: True, 1200: True, 1800: True} and not any(cell.lists.values())
    assert cell.asked <= 2 * len(cell.timers)
    cell = _Cell()
    near.init(cell)
    assert not list(near.handleInputRows(("a", 0, 1), iter([pdf.assign(own=False)]), cell)) and any(cell.lists.values())
    for ms in sorted(cell.timers):
        cell.watermark = ms
        assert not list(near.handleExpiredTimer(("a", 0, 1), cell, None))
    assert not any(cell.lists.values())


def test_copies_of_a_report_are_kept_once():
    """State is of places and times, not of reports, and the witness kept is the smallest id."""
    pdf = pd.DataFrame({"id": range(5000, 0, -1), "lat": -12.0, "lon": -77.0, "t": 0, "own": False})
    near, cell = streams.NearReports(0.5, 600), _Cell()
    near.init(cell)
    list(near.handleInputRows(("a", 0, 0), iter([pdf[:2500], pdf[2500:]]), cell))
    assert sum(len(x) for row in cell.lists["seen"] for x in row) <= 2 * streams.KEPT.itemsize
    list(near.handleInputRows(("a", 0, 0), iter([pd.DataFrame({"id": [1, 3], "lat": [-12.003, -11.997], "lon": -77.0, "t": 0, "own": True})]), cell))
    cell.watermark = 10**7
    told = pd.concat(list(near.handleExpiredTimer(("a", 0, 0), cell, None)))
    assert dict(zip(told.id, told.repeated)) == {1: False, 3: True}


def test_stream_of_dense_reports_over_many_cells_equals_the_batch(spark, tmp_path):
    """Places on a grid about as fine as the radius across cells' edges and the equator, equal places, ids in any order, no place."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rng, base = random.Random(8), dt.datetime(2024, 1, 1)
    ids = rng.sample(range(10**6), 1500)
    rows = [(i, rng.choice("ab"), rng.randrange(-12, 13) * 0.125 + rng.choice((0.0, 0.01)), -77 + rng.randrange(24) * 0.125, base + dt.timedelta(seconds=600 * k / 375 * 4 + rng.randrange(1200)), k // 375) for k, i in enumerate(ids)]
    rows += [(10**7 + k, "a", float("nan"), -77.0, base, 0) for k in range(2)]
    df = spark.createDataFrame(rows, "id long, tipo string, lat double, lon double, ts timestamp, batch int")
    closing = spark.createDataFrame([(10**8, "z", 0.0, 0.0, dt.datetime(2030, 1, 1), 9)], df.schema)
    got = streams.finished(lambda s: streams.repeated_stream(s, 15.0, 600, "30 minutes"), df, closing, "batch", f"file://{tmp_path}", 4).where("tipo <> 'z'").collect()

    def far(a, b):
        y, v = math.radians(a[2]), math.radians(b[2])
        h = math.sin((v - y) / 2) ** 2 + math.cos(y) * math.cos(v) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2
        return 2 * 6371 * math.asin(math.sqrt(h))

    want = {r[0]: any(o[0] < r[0] and o[1] == r[1] and abs((o[4] - r[4]).total_seconds()) <= 600 and far(o, r) <= 15 for o in rows) for r in rows}
    assert len(got) == 1502 and {r.id: r.repeated for r in got} == want and 100 < sum(want.values()) < 1400


def test_polled_feed_neither_loses_nor_repeats_after_restarts(spark, tmp_path):
    feed, store = tmp_path / "feed.json", f"file://{tmp_path}/store"

    def show(*items):
        feature = lambda i: {"geometry": {"coordinates": [-77.0, -12.0]}, "properties": {"item": i, "evento": "Choque en puente", "afectacion": "Km 12.5", "fecha_actualizacion": "x"}}
        feed.write_text(json.dumps({"normal": [feature(i) for i in items], "interrumpido": None}), encoding="utf-8-sig")

    def run(ttl=0):
        stream = streams.new_alerts(polled.alerts(polled.polled(spark, f"file://{feed}", store, ttl)), ["item", "fecha_actualizacion"])
        q = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").outputMode("append").trigger(availableNow=True).start(f"{tmp_path}/out")
        q.awaitTermination()
        return sorted(r["item"] for r in spark.read.parquet(f"{tmp_path}/out").collect()), len([f for f in os.listdir(tmp_path / "store") if f.startswith("poll-")])

    show("a", "b")
    assert run() == (["a", "b"], 1)
    assert run() == (["a", "b"], 1)  # an unchanged feed is no further poll
    show("b", "c")
    assert run(ttl=3600) == (["a", "b"], 1)  # the poll is still good
    assert run() == (["a", "b", "c"], 2)
    feed.write_text("not json")
    assert run() == (["a", "b", "c"], 2)
    show("d")
    reader = polled.PolledReader(f"file://{feed}", store, 0)
    assert reader.latestOffset() == {"polls": 3}  # polled, but the query dies before its batch
    show("e")
    assert run() == (["a", "b", "c", "d", "e"], 4)
    row = spark.read.parquet(f"{tmp_path}/out").where("item = 'a'").first()
    assert (row.estado, row.motivo, row.km, row.lat) == ("NORMAL", "ACCIDENTE", 12.5, -12.0)


def test_counters_and_late_rows_of_a_stream(spark, tmp_path):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = [(0, at(1), "x", 1.0), (0, at(2), "y", 1.0), (1, at(10), "x", 1.0), (2, at(20), "x", 1.0), (2, at(2), "y", 1.0), (3, at(3), "x", 1.0), (3, at(20), "x", 1.0)]
    df = spark.createDataFrame(rows, "batch int, ts timestamp, event_type string, value double")
    closing = spark.createDataFrame([(4, at(99), "close", 0.0)], df.schema)
    out = streams.finished(lambda s: streams.windowed_counts(s, "1 hour"), df, closing, "batch", f"file://{tmp_path}/w", 4).where("event_type <> 'close'")
    assert tuple(streams.late_rows(df, out, "n").first()) == (7, 6, 1)  # a batch is judged by the watermark of the one before it
    totals = streams.finished(lambda s: streams.counters(s, "event_type"), df, closing, "batch", f"file://{tmp_path}/c", 4, "complete")
    assert {r.event_type: r.n for r in totals.collect()} == {"x": 5, "y": 2, "close": 1}


def test_bootstrap_of_forty_flags_and_repeatable(spark):
    df = spark.range(3000).select(*[((F.xxhash64("id", F.lit(i)) % 10) != 0).alias(f"c{i}") for i in range(39)], F.when(F.col("id") % 2 == 0, F.col("id") % 4 == 0).alias("c39"))
    flags = [F.col(c) for c in df.columns]
    r = quality.bootstrap_interval(df, flags, draws=60)
    assert r["low"] <= r["point"] <= r["high"] and 87 < r["point"] < 91 and r["high"] - r["low"] < 1
    assert quality.bootstrap_interval(df.repartition(9), flags, draws=60) == r
    share = quality._drawn_shares(df.select("c39"), {"g": [F.col("c39")], "none": [F.lit(None).cast("boolean")]}, 200, 5)
    assert share[0, 0] == 0.5 and abs(share[1:, 0].std() - math.sqrt(0.25 / 1500)) < 0.004 and all(x != x for x in share[:, 1])


def test_negative_binomial_distribution(spark):
    cases = [(float(y), m) for y in (0, 1, 5, 60, 4000) for m in (0.0, 0.01, 3.0, 300.0, 5000.0)]
    upto, before = numeric.nb_distribution(F.col("y"), F.col("m"), 0.5)
    for r in spark.createDataFrame(cases, "y double, m double").select("y", "m", upto.alias("u"), before.alias("b")).collect():
        if r.m == 0:
            assert (r.u, r.b) == (1.0, float(r.y > 0))
            continue
        p = 1 / (1 + 0.5 * r.m)
        pmf = lambda k: math.exp(math.lgamma(k + 2) - math.lgamma(2) - math.lgamma(k + 1) + 2 * math.log(p) + k * math.log1p(-p))  # noqa: B023, E731
        assert r.b == pytest.approx(math.fsum(map(pmf, range(int(r.y)))), abs=1e-9)
        assert r.u == pytest.approx(math.fsum(map(pmf, range(int(r.y) + 1))), abs=1e-9)
    x = spark.createDataFrame([(0.1,), (1.0,), (2.5,), (1e6,)], "x double").select("x", numeric.log_gamma(F.col("x")).alias("g")).collect()
    assert all(r.g == pytest.approx(math.lgamma(r.x), abs=1e-9, rel=1e-13) for r in x)


def test_estimators_fit_save_and_load(spark, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel

    rng = random.Random(2)
    rows = [(f"g{i % 7}", i % 40, 2020 + i % 3, rng.random(), 1.0 + i % 5, float(rng.randrange(0, 9))) for i in range(240)]
    df = spark.createDataFrame(rows, "g string, k long, year int, x double, expo double, y double")
    stages = [
        estimators.CountRegression(labelCol="y", columns=["x"], exposure="expo", predictionCol="poisson"),
        estimators.CountRegression(labelCol="y", columns=["x"], exposure="expo", family="nb2", grid=12, predictionCol="nb2"),
        estimators.BaselineRegressor(labelCol="y", statistic="median", predictionCol="mediana"),
        estimators.BaselineRegressor(labelCol="y", predictionCol="media"),
        estimators.PersistenceRegressor(labelCol="y", key="k", year="year", predictionCol="antes"),
        estimators.EmpiricalBayes(labelCol="y", group="g", exposure="expo", predictionCol="eb"),
    ]
    once = df.dropDuplicates(["k", "year"])
    fitted = Pipeline(stages=stages).fit(once)
    fitted.save(f"{tmp_path}/model")
    new = spark.createDataFrame([("g1", 1, 2022, 0.5, 2.0, 3.0), ("other", 999, 2021, 0.1, 1.0, 0.0)], df.schema)
    want = fitted.transform(new).orderBy("k").collect()
    got = PipelineModel.load(f"{tmp_path}/model").transform(new).orderBy("k").collect()
    assert got == want and want[1].antes is None and want[0].antes is not None
    whole = once.agg(F.sum("y") / F.sum("expo"), F.avg("y")).first()
    assert want[1].prior == pytest.approx(whole[0]) and want[0].media == pytest.approx(whole[1])
    direct = models.fit_counts(once.withColumn("_one", F.lit(1.0)).withColumn("_o", F.ln("expo")), "y", ["_one", "x"], "_o")
    assert fitted.stages[0].fitted()["beta"] == pytest.approx(direct["beta"].tolist())
    assert [r["column"] for r in fitted.stages[1].rate_ratios()] == ["_one", "x"]
    alone = estimators.CountRegression.load(_saved(stages[0], tmp_path))
    assert alone.getOrDefault("columns") == ["x"] and alone.getLabelCol() == "y"


def _saved(stage, tmp_path):
    stage.save(f"{tmp_path}/stage")
    return f"{tmp_path}/stage"


def test_lineage_log_reads_a_snapshot_and_the_newest_deltas(spark, tmp_path):
    root = f"file://{tmp_path}/log"
    log = LineageLog(spark, root, ["asset"], every=4)
    assert log.read() is None and log.vacuum() == 0
    for n in range(10):
        log.append(spark.createDataFrame([(f"a{n % 3}", n, f"2024-01-{n + 1:02d}")], "asset string, n long, created_at string").coalesce(1))
    assert [f.rsplit("/", 1)[1] for f in log.files()] == ["snapshot=000000000008", "delta=000000000009", "delta=000000000010"]
    assert {r.asset: r.n for r in log.read().collect()} == {"a0": 9, "a1": 7, "a2": 8}
    (tmp_path / "log" / "delta=000000000011").mkdir()  # a crashed append
    assert log.append(spark.createDataFrame([("a1", 99, "2024-02-01", "new")], "asset string, n long, created_at string, more string")) == 12
    again = LineageLog(spark, root, ["asset"], every=4)
    assert {r.asset: (r.n, r.more) for r in again.read().collect()} == {"a0": (9, None), "a1": (99, "new"), "a2": (8, None)}
    before = sorted(map(tuple, again.read().collect()))
    assert again.vacuum() > 0 and sorted(map(tuple, again.read().collect())) == before and len(again.files()) <= 5


def test_catalogues_lack_what_they_lack(spark):
    row = audit.catalog_circularity(spark.createDataFrame([("Lima",), ("áncash",), ("Zzz",), (None,)], "c string"), "c", ["LIMA", "Ancash"]).first()
    assert (row.n_seen, row.n_known, row.pct_known, row.examples) == (3, 2, 66.67, ["ZZZ"])


def test_weather_records(spark):
    square = [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]
    features = [
        (1, {"properties": {"nivel": 3, "descripcio": "lluvia", "respons": None}, "geometry": {"type": "Polygon", "coordinates": [square, [[1, 1], [1, 1.5], [1.5, 1]]]}}),
        (2, {"properties": {"descripcion": "nieve"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[5, 5], [6, 5], [6, 6]]], [square]]}}),
        (3, {"properties": None, "geometry": None}), (4, {"properties": {}, "geometry": {"type": "Point", "coordinates": [1, 2]}}),
    ]
    rows = live.weather_warnings(spark.createDataFrame([(i, json.dumps(f)) for i, f in features] + [(5, None), (6, "{")], "polygon_id long, feature string")).orderBy("polygon_id")
    got = rows.collect()
    assert [(r.polygon_id, r.nivel, r.descripcion, r.responsable, len(r.ring), tuple(r.ring[1])) for r in got] == [(1, "3", "lluvia", "", 5, (2.0, 0.0)), (2, "", "nieve", "", 3, (6.0, 5.0))]
    samples = spark.createDataFrame([("r", 1.0, 1.0), ("q", 9.0, 9.0)], "route_id string, s_lat double, s_lon double")
    assert [tuple(r) for r in live.warnings_on_route(rows, samples, 0.05).collect()] == [(1, "r")]


def test_forecast_of_a_route(spark):
    body = lambda day, lo, hi, rain, wind: json.dumps({"daily": {"time": [day, "later"], "temperature_2m_min": lo, "temperature_2m_max": hi, **({"precipitation_probability_max": rain} if rain else {}), "wind_speed_10m_max": wind}})
    answers = [("r", 0, body("d0", [3.04, 5], [20, 21.26], [10, 80], [9, 8])), ("r", 1, body("d1", [4, 2.96], [19, 18], None, [30.55, 1])), ("r", 2, json.dumps({"daily": {"time": []}})), ("s", 0, "{}"), ("s", 1, None)]
    got = live.route_forecast(spark.createDataFrame(answers, "route_id string, i int, body string")).collect()
    assert [tuple(r) for r in got] == [("r", "d1", 3.0, 21.3, 80, 30.6, 3)]


def test_prediction_design_learns_from_the_training_rows(spark):
    schema = "seg long, region string, topografia string, vel_proy double, carriles double, sinuosidad double, dist_peligro_km double, dist_peajes_km double, dist_radares_km double, radares_10km long, sup_buena long, principal long"
    train = spark.createDataFrame([(i, "ABC"[i % 3], "xy"[i % 2], float(40 + i) if i % 4 else None, 2.0, 1 + i / 100, float(i), 1.0, 0.0, 1, 1, 0) for i in range(101)], schema)
    new = spark.createDataFrame([(1, "B", None, None, None, 99.0, math.e - 1, 0.0, 0.0, 0, 0, 1), (2, "Z", "y", 70.0, 4.0, 1.0, 0.0, 0.0, 0.0, 0, 0, 0)], schema)
    rows, names = models.prediction_design(new, fit=train)
    a, b = rows.orderBy("seg").collect()
    assert names[:4] == ["one", "reg_B", "reg_C", "top_y"] and set(names) <= set(rows.columns)
    assert (a.reg_B, a.reg_C, a.top_y, a.carriles, a.log_peligro) == (1.0, 0.0, 0.0, 2.0, pytest.approx(1.0)) and (b.reg_B, b.top_y, b.vel_proy) == (0.0, 1.0, 70.0)
    assert a.sinuosidad == pytest.approx(1.99) and a.vel_proy == train.approxQuantile("vel_proy", [0.5], 0.0)[0]


@pytest.mark.parametrize("most", [10**9, 30])
def test_matching_of_crowded_places_makes_no_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(matching, "LAST_EVENTS", most)
    rng, day = random.Random(5), dt.date(2024, 3, 1)
    rows = lambda: [(i, day + dt.timedelta(rng.randrange(9)), -12 + rng.randrange(9) / 1024, -77 + rng.randrange(3) / 1024) for i in rng.sample(range(900), 300)]
    schema = "id long, fecha date, lat double, lon double"
    a, b = (spark.createDataFrame([*rows(), (1000, None, -12.0, -77.0), (1001, day, math.nan, -77.0)], schema) for _ in range(2))
    near = matching.candidates(a, b, 0.25, 1).collect()
    want = greedy({(p.a_id, p.b_id): p.dist_km for p in near})
    got = matching.match_events(a, b, 0.25, 1, steps(spark)).collect()
    assert {(r.a_id, r.b_id) for r in got} == want and len(got) == len(want)
    far = {(p.a_id, p.b_id): p.dist_km for p in near}
    assert all(r.dist_km == pytest.approx(far[r.a_id, r.b_id], rel=1e-12) for r in got)
    grid = {(r.radius_km, r.days): r.n_both for r in matching.sensitivity(a, b, [0.1, 0.25], [0, 1], steps(spark)).collect()}
    assert grid == {(km, t): len(greedy({(p.a_id, p.b_id): p.dist_km for p in near if p.dist_km <= km and p.gap_days <= t})) for km in (0.1, 0.25) for t in (0, 1)}


def test_matching_grows_with_events_not_with_pairs(spark, tmp_path):
    day = dt.date(2024, 3, 1)
    one = spark.range(20_000).select("id", F.lit(day).alias("fecha"), F.lit(-12.0).alias("lat"), F.lit(-77.0).alias("lon"))
    spent = []

    def write(df, name):
        df.write.parquet(f"file://{tmp_path}/{name}")
        spent.append(sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(tmp_path / name) for f in files))
        return spark.read.parquet(f"file://{tmp_path}/{name}")

    got = matching.match_events(one, one, 0.25, 1, write)
    assert got.where("a_id = b_id").count() == 20_000 and sum(spent) < 5_000_000  # 400,000,000 pairs


def test_crowded_places_make_no_pairs_of_points(spark):
    """40,000 points at each of two places: 1.6e9 pairs of points, four of places."""
    at = lambda n, *names: spark.range(n).select("id", (F.col("id") % 2).cast("double").alias(names[0]), F.lit(0.0).alias(names[1]))
    left, right = at(80_000, "x", "y").withColumnRenamed("id", "l"), at(80_000, "u", "v").withColumnRenamed("id", "r")
    xy, uv = ("x", "y"), ("u", "v")
    more = left.unionByName(spark.createDataFrame([(90_000, 9.0, 9.0), (90_001, None, 0.0)], left.schema))
    near = spatial.nearest_join(more, right, "l", "r", xy, uv, 0.5)
    assert near.columns == ["l", "x", "y", "r", "dist"] and near.where("r = x AND dist = 0").count() == 80_000
    assert near.where("r IS NULL AND dist IS NULL").count() == 2
    assert [tuple(x) for x in spatial.nearest_any(more, right, "l", "r", xy, uv).groupBy("r").count().orderBy("r").collect()] == [(None, 1), (0, 40_000), (1, 40_001)]
    assert spatial.radius_counts(more, right, "r", xy, uv, 0.5).agg(F.count("*"), F.min("n"), F.max("n")).first()[:] == (80_000, 40_000, 40_000)
    assert spatial.radius_counts(more, right, "r", xy, uv, 1.0).agg(F.min("n")).first()[0] == 80_000
    assert spatial.radius_semi(more, right, xy, uv, 0.5).count() == 80_000
    assert {r.n: r["count"] for r in spatial.box_counts(more, right, "l", xy, uv, 0.5).groupBy("n").count().collect()} == {40_000: 80_000, 0: 2}


def test_ties_in_metres_go_to_the_smaller_id(spark):
    left = spark.createDataFrame([(1, 0.375, 1.25), (2, 7.625, 3.125)], "l long, lat double, lon double")
    right = spark.createDataFrame([(n + 10 * k, lat + s / 8, lon) for k, (lat, lon) in enumerate([(0.375, 1.25), (7.625, 3.125)]) for n, s in ((9, 1), (3, -1))], "r long, lat2 double, lon2 double")
    for turn in (right, right.withColumn("r", 100 - F.col("r"))):
        got = {x.l: x.r for x in spatial.nearest_metres(left, turn, "l", "r", 100_000.0, digits=3).collect()}
        ids = sorted(x.r for x in turn.collect())
        assert sorted(got.values()) == [ids[0], ids[2]]
    assert spatial.nearest_metres(left, right, "l", "r", 10_000.0, digits=3).where("r IS NULL AND dist_m IS NULL").count() == 2


def test_rows_near_a_closed_session_belong_to_it(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    # the session of minute 0 is closed by batch 2, at a watermark of 35; the row of minute 20 is not late in batch 3 (20 + 30 > 35)
    rows = [(0, at(0), 1), (0, at(10), 2), (1, at(45), 2), (2, at(50), 2), (3, at(20), 1), (3, at(60), 1)]
    df = spark.createDataFrame(rows, "batch int, ts timestamp, user_id long")
    closing = spark.createDataFrame([(4, at(9999), -1)], df.schema)
    out = streams.finished(lambda s: streams.sessions(s, "30 minutes"), df, closing, "batch", f"file://{tmp_path}", 4).where("user_id = 1")
    assert out.count() == 3
    got = streams.whole_sessions(out).orderBy("start").collect()
    assert [(r.start, r.end, r.n) for r in got] == [(at(0), at(50), 2), (at(60), at(90), 1)]

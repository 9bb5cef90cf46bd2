"""Exact fixtures and invariances of the panel, features, index and profiles."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from quayside.operators import analytics as A
from quayside.operators import features as X
from quayside.operators import panel as P
from quayside.operators import pilot as L
from quayside.settings import Settings
from quayside.sources import contract

SCHEMA = "observation_id string, observed_at timestamp, retailer_id string, store_id string, retailer_product_id string, city_id string, price double, regular_price double, is_available boolean, is_promotion boolean, currency string, canonical_product_id string, match_method string, match_confidence double, match_status string, link_valid_from timestamp, link_valid_to timestamp, category_id string, unit string, quantity double, pack_count int, barcodes array<string>"
COVERAGE = "retailer_id string, store_id string, date date, crawl_status string, is_complete_utc_day boolean"
START = dt.datetime(2026, 8, 1)


def events(spark, rows, retailer="r"):
    """rows: (id, day, price[, available])."""
    data = [(str(r[0]), START + dt.timedelta(days=r[1]), retailer, "s", "p", "c", float(r[2]), None, r[3] if len(r) > 3 else True, False, "KZT", "product", "manual", 1.0, None, START - dt.timedelta(days=90), None, "k", "g", 1.0, 1, ["b"]) for r in rows]
    return spark.createDataFrame(data, SCHEMA)


def coverage(spark, days, failed=()):
    return spark.createDataFrame([("r", "s", (START + dt.timedelta(days=d)).date(), "failed" if d in failed else "successful", True) for d in days], COVERAGE)


def settings(days, **more):
    return Settings(START.date(), (START + dt.timedelta(days=days)).date(), **more)


def test_outage_and_unavailability_censor(spark):
    obs = events(spark, [(1, 0, 100), (2, 4, 100, False), (3, 6, 110)])
    panel = P.build_panel(obs, coverage(spark, range(8), failed={2}), settings(8, assume_continuous_observation=True))
    rows = panel.orderBy("date").collect()
    assert [r.state_eligible for r in rows] == [True, True, False, True, False, False, True, True]
    assert [r.outcome_eligible for r in rows] == [False, True, False, False, False, False, False, True]


def test_carry_forward_and_changes(spark):
    obs = events(spark, [(1, 0, 100), (2, 10, 110)])
    rows = P.build_panel(obs, coverage(spark, []), settings(12, assume_continuous_observation=True)).orderBy("date").collect()
    assert len(rows) == 12 and [r.outcome_eligible for r in rows] == [False] + [True] * 11
    assert rows[10].log_return == pytest.approx(math.log(1.1)) and sum(abs(r.log_return or 0) > 1e-10 for r in rows) == 1


def test_silence_is_no_evidence(spark):
    rows = P.build_panel(events(spark, [(1, 0, 100), (2, 2, 110)]), coverage(spark, []), settings(4)).collect()
    assert not any(r.outcome_eligible for r in rows)


def test_ties_break_by_numeric_id(spark):
    last = P.last_of_day(P.with_ties(events(spark, [(9, 0, 120), (10, 0, 130)]))).first()
    assert (last.price, last.timestamp_multiplicity) == (130.0, 2)


def test_revisions(spark):
    old = events(spark, [(1, 0, 100)]).withColumns({"export_id": F.lit("a"), "snapshot_at": F.lit("2026-09-01").cast("timestamp")})
    new = old.withColumns({"category_id": F.lit("new"), "export_id": F.lit("b"), "snapshot_at": F.lit("2026-10-01").cast("timestamp")})
    for both in (old.unionByName(new), new.unionByName(old)):
        assert [r.category_id for r in contract.deduplicate(both).collect()] == ["new"]
    with pytest.raises(contract.ContractError, match="timezone"):
        contract.normalize(old.withColumn("observed_at", F.col("observed_at").cast("timestamp_ntz")), "x", START)


def test_conflicting_market_data_fails(spark):
    a = contract.normalize(events(spark, [(1, 0, 100)]), "a", START)
    b = contract.normalize(events(spark, [(1, 0, 999)]), "b", START)
    with pytest.raises(contract.ContractError, match="Conflicting market"):
        contract.checked(a.unionByName(b))


def test_index_publishes_by_coverage(spark):
    obs = events(spark, [(1, 0, 100), (2, 1, 110), (3, 2, 0)])
    cfg = settings(4, assume_continuous_observation=True)
    panel = P.build_panel(obs, coverage(spark, range(4)), cfg)
    rows = A.price_index(panel, A.basket(A.basket_candidates(panel, cfg)), cfg).orderBy("date").collect()
    assert rows[0].index_value == pytest.approx(100) and rows[1].index_value == pytest.approx(110)
    assert [r.index_value for r in rows[2:]] == [None, None]


def two_retailers(spark):
    own = events(spark, [(1, 0, 100), (2, 3, 120), (3, 6, 130)])
    peer = events(spark, [(11, 0, 90), (12, 4, 95), (13, 7, 99)], "q")
    return own.unionByName(peer)


def test_exposure_is_legal_and_causal(spark):
    cfg = settings(10, assume_continuous_observation=True)
    obs = two_retailers(spark)
    build = lambda o: X.build_features(P.build_panel(o, coverage(spark, []), cfg), cfg)
    base = X.feature_base(P.build_panel(obs, coverage(spark, []), cfg), cfg)
    peers = X.peer_daily_source(X.targets(base), X.shocks(base), cfg).collect()
    assert peers and all(p.source_retailer != p.retailer_id and 1 <= p.lag_days <= 14 for p in peers)
    cutoff = F.lit((START + dt.timedelta(days=6)).date())
    later = obs.withColumn("price", F.when(F.to_date("observed_at") >= cutoff, F.col("price") * 2).otherwise(F.col("price")))
    key = lambda df: sorted(map(tuple, df.filter(F.col("date") < cutoff).collect()))
    assert key(build(obs)) == key(build(later))


def test_disjoint_barcodes_give_no_exposure(spark):
    cfg = settings(10, assume_continuous_observation=True)
    obs = two_retailers(spark).withColumn("barcodes", F.array("retailer_id"))
    base = X.feature_base(P.build_panel(obs, coverage(spark, []), cfg), cfg)
    v = X.Variant("barcode")
    assert X.peer_daily_source(X.targets(base, v), X.shocks(base, v), cfg, v).isEmpty()


def test_clean_changes(spark):
    rows = [(1, 1.5, 100), (2, 3, 110), (9, 4, 120), (10, 4, 130), (11, 5, 140), (12, 6, 150, False)]
    e = L.build_events(events(spark, rows))
    assert [r.observation_id for r in e.filter("clean_price_change").collect()] == ["2"]
    p = {r.date.day: r.price for r in L.pilot_panel(e, START.date(), dt.date(2026, 8, 8)).collect()}
    assert p[5] == 130.0 and len(p) == 6


@pytest.mark.parametrize("bad", [{"min_train_days": True}, {"exposure_days": 0}, {"min_match_confidence": 2}, {"feed_groups": []}])
def test_settings_are_checked(bad):
    with pytest.raises(ValueError):
        settings(5, **bad)


def test_bootstrap_of_equal_forecasts_is_zero():
    import numpy as np

    from quayside.operators.models import block_bootstrap

    assert block_bootstrap(np.array([[3, 1.0, 1.0]] * 10)) == (0.0, (0.0, 0.0))


def test_queries_match_sql(spark):
    import duckdb

    from quayside.plans import catalogue

    con = duckdb.connect()
    con.execute("CREATE VIEW events AS SELECT * FROM '/root/testdata/sf0.001/events.parquet'")
    for name in ("daily_change_rate", "transitions", "peer_daily_source", "price_index", "lead_lag"):
        df = catalogue.queries()[name](spark, "/root/testdata/sf0.001")
        columns = ", ".join(df.columns)
        want = con.execute(f"SELECT {columns} FROM ({catalogue.oracle_sql()[name]})").fetchall()
        text = lambda rows: sorted(tuple(f"{x:.5f}" if isinstance(x, float) else str(x) for x in r) for r in rows)
        assert text(df.collect()) == text(want), name


def test_focused_models_with_and_without_diffusion(spark):
    import random

    from quayside.operators.models import BASE, DIFFUSION, focused_walk_forward, metrics

    rnd, rows = random.Random(4), []
    for day in range(30):
        for k in range(20):
            signal = rnd.random()
            changed = int(day < 10 or rnd.random() < signal)  # the first fold trains on changes alone
            rows.append((START.date() + dt.timedelta(days=day), f"r{k % 2}", "s", f"p{k}", "c", "k", day % 7, changed, 0.1 * changed, *[rnd.random() for _ in BASE], *[signal] * len(DIFFUSION)))
    kinds = "date date, retailer_id string, store_id string, retailer_product_id string, city_id string, category_id string, day_of_week int, changed int, magnitude double"
    df = spark.createDataFrame(rows, ", ".join([kinds, *(f"{c} double" for c in BASE + DIFFUSION)])).cache()
    cfg = settings(30, min_train_days=10, test_days=10, min_train_events=30)
    out = focused_walk_forward(df, cfg).cache()
    got = {(r.model, r.train_end_exclusive.day): r for r in metrics(out, ["model", "train_end_exclusive"]).collect()}
    assert set(got) == {(m, d) for m in ("time_varying_baseline", "cross_retailer_excitation") for d in (11, 21)}
    assert all(r.n == 200 and r.return_mae == pytest.approx(0.1 * r.events / r.n) for r in got.values())
    assert got["cross_retailer_excitation", 21].brier < got["time_varying_baseline", 21].brier


def test_landing_round_trip(spark, tmp_path):
    import gzip
    import json

    from quayside.sources import landing, manifest, rest

    item = {"observation_id": "1", "observed_at": "2026-08-01T12:00:00+05:00", "retailer_id": "r", "store_id": "s", "city_id": "c", "retailer_product_id": "p", "currency": "KZT", "price": "10.5", "is_available": True, "is_promotion": False}
    pages = {None: {"items": [item], "has_more": True, "next_cursor": "x"}, "x": {"items": [item | {"observation_id": "2"}, item], "has_more": False, "next_cursor": None}}
    source = tmp_path / "in"
    window = [dt.datetime(2026, 8, d, tzinfo=dt.timezone.utc) for d in (1, 2)]
    assert rest.ingest(spark, rest.iter_items(lambda e, p: pages[p.get("cursor")], "observations", {}), source, *window) == 2
    lines = lambda: [x for f in source.glob("*.gz") for x in gzip.open(f, "rt")]
    assert len(lines()) == 2
    for rows, why in (([item, item | {"price": "11"}], "conflicting"), ([item | {"observed_at": "2026-08-02T00:00:00Z"}], "outside"), ([item | {"price": "0"}], "price")):
        with pytest.raises(ValueError, match=why):
            rest.ingest(spark, rows, source, *window, overwrite=True)
        assert len(lines()) == 2 and [f.name for f in tmp_path.iterdir()] == ["in"]
    with pytest.raises(FileExistsError):
        rest.ingest(spark, [item], source, *window)
    assert rest.ingest(spark, [], tmp_path / "none", *window) == 0
    assert rest.ingest(spark, [item, item | {"observation_id": "2"}], source, *window, overwrite=True) == 2
    with pytest.raises(rest.ProtocolError):
        list(rest.iter_items(lambda e, p: {"items": [], "has_more": True, "next_cursor": "x"}, "o", {}))
    path = landing.package_landing(spark, str(source), str(tmp_path / "out"), "e", "2026-09-01T00:00:00Z")
    obs, cov, _ = manifest.load_exports(spark, [path])
    assert obs.count() == 2 and cov is None and obs.first().price == 10.5
    bad = json.loads(path.read_text())
    bad["files"][0]["path"] = "../outside"
    path.write_text(json.dumps(bad))
    with pytest.raises(manifest.ManifestError, match="leaves"):
        manifest.verify_manifest(path)
    (tmp_path / "bad.ndjson").write_text(json.dumps(item | {"price": "0"}))
    with pytest.raises(contract.ContractError, match="price"):
        landing.read_ndjson(spark, str(tmp_path / "bad.ndjson"))


def test_stream_drops_repeats(spark, tmp_path):
    from quayside.streaming.landing import run_batches, stream_events

    rows = events(spark, [(1, 0, 100), (1, 0, 100), (2, 1, 110)])
    rows.write.parquet(str(tmp_path / "in"))
    seen = []
    run_batches(stream_events(spark, str(tmp_path / "in"), SCHEMA), lambda df, i: seen.append(df.count()), str(tmp_path / "cp")).awaitTermination(60)
    assert sum(seen) == 2


def test_nowcast_ignores_late_vintages(spark):
    from quayside.operators.nowcast import evaluate_nowcast

    months = [dt.date(2024 + k // 12, k % 12 + 1, 1) for k in range(20)]
    after = lambda m, d: dt.datetime.combine(m, dt.time()) + dt.timedelta(days=d)
    f = spark.createDataFrame([(m, after(m, 30), float(k % 5), float(k % 3)) for k, m in enumerate(months)], "month date, available_at timestamp, index_change double, diffusion_signal double")
    t = [(m, after(m, 45), 2.0 * (k % 5) + (k % 3)) for k, m in enumerate(months)]
    make = lambda rows: spark.createDataFrame(rows, "month date, released_at timestamp, value double")
    one = evaluate_nowcast(f, make(t))
    two = evaluate_nowcast(f, make(t + [(m, after(m, 4000), 99.0) for m in months]))
    assert one == two and one["status"] == "complete" and one["models"]["index_and_diffusion"]["rmse"] < one["models"]["historical_mean"]["rmse"]
    assert evaluate_nowcast(f, make(t), 50)["status"] == "insufficient_history"


def test_nowcast_refuses_bad_rows(spark):
    from quayside.operators.nowcast import evaluate_nowcast

    x = lambda *rows: spark.createDataFrame(rows, "month date, available_at timestamp, index_change double, diffusion_signal double")
    y = lambda *rows: spark.createDataFrame(rows, "month date, released_at timestamp, value double")
    month, at = dt.date(2024, 1, 1), dt.datetime(2024, 1, 20)
    good, known = (month, at, 1.0, 1.0), (month, at, 1.0)
    for f, t, why in ((x(good, good), y(known), "repeat"), (x(good), y(known, known), "repeat"), (x((month, None, 1.0, 1.0)), y(known), "instant"), (x((month, at, math.nan, 1.0)), y(known), "finite"), (x(good), y((month, at, None)), "finite")):
        with pytest.raises(ValueError, match=why):
            evaluate_nowcast(f, t)


def test_nowcast_equals_a_dense_ridge(spark):
    import numpy as np

    from quayside.operators.nowcast import forecasts
    from quayside.sources.generators import monthly_rows

    f, t = monthly_rows(24)
    got = {r.month: r for r in forecasts(spark.createDataFrame(f, "month date, available_at timestamp, index_change double, diffusion_signal double"), spark.createDataFrame(t, "month date, released_at timestamp, value double")).collect()}
    assert sorted(got) == [r[0] for r in f[12:]]
    month, origin, x, d = f[20]
    known = {}
    for m, released, value in t:  # in order of release within a month
        if m < month and released <= origin:
            known[m] = value
    rows = [r for r in f if r[0] in known]
    z, y = np.array([r[2:] for r in rows]), np.array([known[r[0]] for r in rows])
    mean, spread = z.mean(axis=0), z.std(axis=0)
    a = np.column_stack([np.ones(len(z)), (z - mean) / spread])
    for name, k in (("index_only", 2), ("index_and_diffusion", 3)):
        beta = np.linalg.solve(a[:, :k].T @ a[:, :k] + np.diag([0.0, 1, 1][:k]), a[:, :k].T @ y)
        assert got[month][name] == pytest.approx(np.append(1, (np.array([x, d]) - mean) / spread)[:k] @ beta)


def test_glms_equal_a_dense_solver(spark):
    import numpy as np
    from pyspark.ml.linalg import Vectors

    from quayside.operators import models as M

    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    y = (rng.random(300) < 1 / (1 + np.exp(-x @ [1.0, -0.5, 0.2]))).astype(float)
    df = spark.createDataFrame([(float(b), Vectors.dense(a)) for a, b in zip(x, y)], ["changed", "features"])
    a = np.column_stack([np.ones(300), x])
    for fit, mean, bend in ((M.fit_logistic, lambda e: 1 / (1 + np.exp(-e)), lambda m: m * (1 - m)), (M.fit_poisson, np.exp, lambda m: m)):
        beta = np.array([np.log(y.mean()), 0, 0, 0])
        for _ in range(50):  # Newton steps
            m = mean(a @ beta)
            beta = beta - np.linalg.solve(a.T @ (bend(m)[:, None] * a) + np.diag([0.0, 1, 1, 1]), a.T @ (m - y) + [0, 1, 1, 1] * beta)
        model = fit(df)
        assert np.allclose([model.intercept, *model.coefficients], beta, atol=1e-4)
        with pytest.raises(ValueError, match="rows"):
            fit(df.limit(0))
        with pytest.raises(ValueError, match="domain"):
            fit(df.selectExpr("-1.0 AS changed", "features"))


def test_boosted_trees_by_brute_force():
    import numpy as np

    from quayside.operators.models import BoostedTrees

    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=900), rng.integers(0, 3, 900), np.ones(900)])
    y = (rng.random(900) < np.where((x[:, 0] > 0.3) & (x[:, 1] == 1), 0.8, 0.1)).astype(float)
    model = BoostedTrees(rounds=1).fit(x, y)
    g, h = y - y.mean(), np.full(900, y.mean() * (1 - y.mean()))
    worth = lambda r: g[r].sum() ** 2 / (h[r].sum() + 1)
    best = max(((worth(r) + worth(~r) - worth(r | True), -j, -c) for j in range(3) for c in np.unique(np.quantile(x[:, j], np.arange(1, 16) / 16)) for r in [x[:, j] < c] if min(r.sum(), (~r).sum()) >= 100))
    assert (model.inputs[0, 0], model.thresholds[0, 0]) == (-best[1], pytest.approx(-best[2]))
    r = (x[:, -best[1]] < -best[2])
    small = BoostedTrees(rounds=1, least_node=901).fit(x, y)  # no split at all
    assert np.isinf(small.thresholds).all() and np.allclose(small.probability(x), y.mean()) and 0 < r.sum() < 900
    deep = BoostedTrees().fit(x, y).probability(x)
    assert deep[(x[:, 0] > 0.3) & (x[:, 1] == 1)].mean() > 0.6 and np.array_equal(BoostedTrees().fit(x, y).probability(x), deep)


def test_medians_are_exact(spark):
    import numpy as np

    from quayside.operators.models import medians

    rng = np.random.default_rng(5)
    far = 10.0 ** rng.integers(-300, 300, 101) * rng.choice([-1, 1], 101)
    columns = [rng.normal(size=101), rng.integers(-2, 2, 101).astype(float), np.where(rng.random(101) < 0.8, np.inf, far), far, np.full(101, np.nan)]
    for n in (101, 100, 2, 1):
        df = spark.createDataFrame([tuple(float(c[k]) for c in columns) for k in range(n)], "a double, b double, c double, d double, e double").repartition(3)
        want = [float(np.median(c[:n][np.isfinite(c[:n])])) if np.isfinite(c[:n]).any() else None for c in columns]
        assert [medians(df, [x], bins=8)[x] for x in "abcde"] == [w if w is None else pytest.approx(w, rel=1e-15, abs=0) for w in want]


def test_boosted_sample_stays_off_the_driver(spark, monkeypatch):
    import random

    import numpy as np

    from quayside.operators import models as M

    rnd, rows = random.Random(6), []
    for k in range(1200):
        signal = rnd.random()
        rows.append((START.date(), f"r{k % 2}", "s", f"p{k}", "c", "k", k % 7, int(rnd.random() < signal), *[rnd.random() for _ in M.BASE], *[signal] * len(M.DIFFUSION)))
    kinds = "date date, retailer_id string, store_id string, retailer_product_id string, city_id string, category_id string, day_of_week int, changed int"
    df = spark.createDataFrame(rows, ", ".join([kinds, *(f"{c} double" for c in M.BASE + M.DIFFUSION)])).cache()
    keys = ["date", "retailer_id", "store_id", "retailer_product_id"]
    encoder = M.TreeEncoder.fit(df, True)
    sample = df.orderBy(M.F.xxhash64(*keys, M.F.lit(3))).limit(700).select("changed", *encoder.columns()).toPandas()
    want = M.BoostedTrees().fit(sample.drop(columns="changed").to_numpy(float), sample["changed"].to_numpy(float))
    seen = []
    monkeypatch.setattr(type(df), "toPandas", lambda self: pytest.fail("the sample reached the driver"))
    monkeypatch.setattr(type(df), "collect", lambda self, f=type(df).collect: (seen.append(rows := f(self)), rows)[1])
    found, model = M.fit_boosted(df, True, 3, max_rows=700)
    assert found == encoder and all(np.array_equal(getattr(model, x), getattr(want, x)) for x in ("start", "inputs", "thresholds", "leaves"))
    assert len(seen[-1]) == 1  # the trees
    scored = M.score_boosted(df, found, model).select("probability", *encoder.columns()).toLocalIterator()
    r = next(scored)
    assert r[0] == pytest.approx(model.probability(np.array([r[1:]]))[0])


def tree_rows(spark, n):
    import random

    from quayside.operators import models as M

    rnd, rows = random.Random(8), []
    for k in range(n):
        signal = rnd.random()
        own = [rnd.gauss(0, 1) * 10.0 ** rnd.randrange(-20, 20), rnd.choice([-0.0, 0.0, None, float("inf")]), float(rnd.randrange(-3, 3)), *[rnd.random() for _ in M.BASE[3:]]]
        rows.append((START.date() + dt.timedelta(days=k % 20), f"r{k % 2}", "s", f"p{k}", "c", f"k{k % 3}", k % 7, int(rnd.random() < signal * (0.3 if k < n / 2 else 1)), 0.1, *own, *[signal + rnd.random() for _ in M.DIFFUSION]))
    kinds = "date date, retailer_id string, store_id string, retailer_product_id string, city_id string, category_id string, day_of_week int, changed int, magnitude double"
    return spark.createDataFrame(rows, ", ".join([kinds, *(f"{c} double" for c in M.BASE + M.DIFFUSION)])).repartition(5).cache()


def same_trees(spark, df, encoder, model):
    """Whether a model is that of all rows, fitted side by side."""
    import numpy as np

    from quayside.operators import models as M

    every = df.select("changed", *encoder.columns()).toPandas()
    x, y = every.drop(columns="changed").to_numpy(np.float32), every["changed"].to_numpy(float)
    want = M.BoostedTrees().fit(x, y)
    assert np.array_equal(model.inputs, want.inputs) and np.array_equal(model.thresholds, want.thresholds) and np.isfinite(want.thresholds).mean() > 0.5
    assert model.start == pytest.approx(want.start) and np.allclose(model.leaves, want.leaves, atol=1e-7) and np.allclose(model.probability(x), want.probability(x), atol=1e-7)


def test_boosted_trees_grow_on_all_rows(spark, monkeypatch):
    import inspect

    import numpy as np

    from quayside.operators import models as M

    df = tree_rows(spark, 3000)
    monkeypatch.setattr(M, "CHUNK", 500)
    found, model = M.fit_boosted(df, True, 3, one_task=2999)
    same_trees(spark, df, found, model)
    again = M.fit_boosted(df.repartition(3, "date"), True, 3, encoder=found, one_task=0)[1]  # other tasks and orders, equal to the last bit
    assert all(np.array_equal(getattr(model, x), getattr(again, x)) for x in ("inputs", "thresholds", "leaves"))
    same_trees(spark, df, found, M.fit_boosted(df, True, 3, encoder=found)[1])
    assert inspect.signature(M.fit_boosted).parameters["max_rows"].default is None
    with pytest.raises(ValueError, match="rows"):
        M.fit_boosted(df.limit(0), True, 3, encoder=found)
    for n in (1, 2, 17, 3000):
        rows = df.limit(n).select(*[c.cast("float").alias(f"x{i}") for i, c in enumerate(found.columns())]).cache()
        x, shares = rows.toPandas().to_numpy(float), np.arange(1, 16) / 16
        assert np.array_equal(M.quantiles(rows, rows.columns, n, shares), np.quantile(x, shares, axis=0).T)


def test_walk_forward_fits_all_models_in_few_jobs(spark):
    import random

    import numpy as np

    from quayside.operators import models as M

    rnd, rows = random.Random(7), []
    for day in range(20):
        for k in range(30):
            signal = rnd.random()
            changed = int(rnd.random() < signal)
            rows.append((START.date() + dt.timedelta(days=day), f"r{k % 2}", "s", f"p{k}", "c", f"k{k % 3}", day % 7, changed, changed * rnd.gauss(0.1, 0.05), *[rnd.random() for _ in M.BASE], *[signal + rnd.random() for _ in M.DIFFUSION]))
    kinds = "date date, retailer_id string, store_id string, retailer_product_id string, city_id string, category_id string, day_of_week int, changed int, magnitude double"
    df = spark.createDataFrame(rows, ", ".join([kinds, *(f"{c} double" for c in M.BASE + M.DIFFUSION)])).cache()
    cfg = settings(20, min_train_days=10, test_days=10, min_train_events=30)
    jobs = lambda: spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
    began = jobs()
    got = M.walk_forward(df, cfg, False).toPandas()
    assert jobs() - began < 60
    cut = START.date() + dt.timedelta(days=10)
    for name, diffusion, logistic in (("hazard_baseline", False, True), ("hazard_diffusion", True, True), ("marked_intensity", True, False)):
        encoder = M.Encoder.fit(df.filter(M.F.col("date") < M.F.lit(cut)), diffusion)
        every = df.select("date", "retailer_product_id", "changed", "magnitude", encoder.array().alias("x")).toPandas()
        a = np.column_stack([np.ones(len(every)), np.stack(every.x)])
        train, y, r = (every.date < cut).to_numpy(), every.changed.to_numpy(float), every.magnitude.to_numpy()
        beta, ridge = np.zeros(a.shape[1]), np.append(0.0, np.ones(a.shape[1] - 1))
        for _ in range(60):  # Newton steps
            m = 1 / (1 + np.exp(-a[train] @ beta)) if logistic else np.exp(a[train] @ beta)
            beta -= np.linalg.solve(a[train].T @ ((m * (1 - m) if logistic else m)[:, None] * a[train]) + np.diag(ridge), a[train].T @ (m - y[train]) + ridge * beta)
        hit = train & (y == 1)
        mark = np.linalg.solve(a[hit].T @ a[hit] + np.diag(ridge), a[hit].T @ r[hit])
        p = 1 / (1 + np.exp(-a @ beta)) if logistic else 1 - np.exp(-np.exp(a @ beta))
        own = every.assign(p=p, e=p * (a @ mark))[~train].merge(got[got.model == name], on=["date", "retailer_product_id"])
        assert len(own) == 300 and np.allclose(own.p, own.probability, atol=1e-9) and np.allclose(own.e, own.expected_return, atol=1e-9)


def test_walk_forward_trees_fit_all_rows(spark):
    import numpy as np

    from quayside.operators import models as M

    F = M.F
    days = F.when(F.col("id") < 200_500, F.col("id") % 10).otherwise(10)  # more training rows than one task fits
    signal = F.rand(4)
    df = spark.range(0, 201_000, 1, 5).select(
        F.date_add(F.lit(START.date()), days.cast("int")).alias("date"), F.lit("r").alias("retailer_id"), F.lit("s").alias("store_id"), F.col("id").cast("string").alias("retailer_product_id"), F.lit("c").alias("city_id"),
        F.concat(F.lit("k"), (F.col("id") % 3).cast("string")).alias("category_id"), (F.col("id") % 7).cast("int").alias("day_of_week"), (F.rand(5) < signal * F.when(F.col("id") % 2 == 0, 0.3).otherwise(0.9)).cast("int").alias("changed"), F.lit(0.1).alias("magnitude"),
        *[(F.randn(10 + i) + (F.col("id") % 2 if i == 3 else 0)).alias(c) for i, c in enumerate(M.BASE)], *[(signal + F.rand(30 + i)).alias(c) for i, c in enumerate(M.DIFFUSION)],
    ).cache()
    cut = START.date() + dt.timedelta(days=10)
    got = M.walk_forward(df, settings(11, min_train_days=10, test_days=1, min_train_events=30)).filter(F.col("model").startswith("boosted")).select("model", "retailer_product_id", "probability").toPandas()
    train = df.filter(F.col("date") < F.lit(cut))
    for name, diffusion in (("boosted_baseline", False), ("boosted_competitor", True)):
        encoder = M.TreeEncoder.fit(train, diffusion)
        every = df.select("date", "retailer_product_id", "changed", *encoder.columns()).toPandas()
        x, y, old = every.drop(columns=["date", "retailer_product_id", "changed"]).to_numpy(np.float32), every["changed"].to_numpy(float), (every["date"] < cut).to_numpy()
        assert old.sum() == 200_500
        own = every.assign(p=M.BoostedTrees().fit(x[old], y[old]).probability(x))[~old].merge(got[got.model == name], on="retailer_product_id")
        assert len(own) == 500 and np.allclose(own.p, own.probability, atol=1e-6) and own.p.std() > 0.02


def test_research_run_finds_the_planted_effect(spark, tmp_path):
    import json

    from quayside.run import run_research
    from quayside.sources.generators import START as FIRST
    from quayside.sources.generators import research_rows, write_export

    path = write_export(spark, str(tmp_path / "export"), "demo", *research_rows(100), "2026-01-01T00:00:00Z")
    cfg = Settings(FIRST, FIRST + dt.timedelta(days=100), assume_store_success_confirms_state=True, max_state_age_days=400, min_train_days=70, test_days=30, min_train_events=10)
    out = run_research(spark, [path], cfg, str(tmp_path / "run"), variants=False)
    edge = {(e["source_retailer"], e["target_retailer"]): e["rate_difference"] for e in out["network"]}
    assert edge["north", "south"] > 0.1 and edge["north", "east"] < 0.05
    record = json.loads((tmp_path / "run" / "run.json").read_text())
    assert record["status"] == "complete" and set(record["artefacts"]) == {"results.json", "report.md"}
    brier = {m["model"]: m["brier"] for m in out["metrics"]}
    assert brier["hazard_diffusion"] < brier["hazard_baseline"]

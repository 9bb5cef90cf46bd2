"""Named queries of the price-event engine over the driver's tables, each with its DuckDB equivalent where SQL has one."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.functions.columns import rounded
from quayside.functions.stored import drop_stored, stored
from quayside.operators import analytics as A
from quayside.operators import features as X
from quayside.operators import panel as P
from quayside.operators import pilot as L
from quayside.plans.oracle import OFFER as OFFER_SQL
from quayside.plans.oracle import ROW as ROW_SQL
from quayside.plans.oracle import sql
from quayside.sources import adapter, contract
from quayside.sources.contract import OFFER

CFG = adapter.SETTINGS
ROW = X.ROW
FIRST, LAST = dt.date(2024, 1, 1), dt.date(2024, 2, 1)

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if oracle:
            _SQL[name] = oracle
        return f

    return add


def obs(spark, sf):
    return adapter.observations(spark, sf)


def panel(spark, sf):
    return P.build_panel(obs(spark, sf), adapter.coverage(spark), CFG)


def base(spark, sf):
    return X.feature_base(panel(spark, sf), CFG)


def peers(spark, sf, v=X.Variant()):
    b = base(spark, sf)
    return X.peer_daily_source(X.targets(b, v), X.shocks(b, v), CFG, v)


def features(spark, sf, v=X.Variant()):
    return X.build_features(panel(spark, sf), CFG, v)


def rounds(df: DataFrame) -> DataFrame:
    """Doubles to 6 digits, counts to bigint, other whole numbers to int: sums of doubles depend on their order."""
    out = []
    for f in df.schema:
        kind = f.dataType.simpleString()
        out.append(rounded(F.col(f.name)).alias(f.name) if kind == "double" else F.col(f.name).cast("bigint").alias(f.name) if kind in ("int", "bigint") else F.col(f.name))
    return df.select(*out)


def r(*names: str) -> str:
    return ", ".join(f"round({x.rpartition(' AS ')[0] or x}, 6) + 0.0 AS {x.rpartition(' AS ')[2]}" for x in names)


def b(*names: str) -> str:
    return ", ".join(f"cast({x.rpartition(' AS ')[0] or x} AS BIGINT) AS {x.rpartition(' AS ')[2]}" for x in names)


@query("daily_change_rate", sql(f"SELECT date, {b('count(*) AS outcomes', 'count(*) FILTER (WHERE abs(r) > 1e-10) AS changes')}, {r('avg(r) AS mean_return')} FROM panel WHERE outcome_ok GROUP BY date"))
def _(spark, sf):
    df = panel(spark, sf).filter("outcome_eligible").groupBy("date")
    return rounds(df.agg(F.count(F.lit(1)).alias("outcomes"), F.count_if(F.abs("log_return") > 1e-10).alias("changes"), F.avg("log_return").alias("mean_return")))


@query("contract_nulls", sql("SELECT count(*) FILTER (WHERE price IS NULL OR is_available IS NULL OR observed_at IS NULL) AS null_rows, count(*) FILTER (WHERE trim(retailer_id) = '') AS blank_rows FROM obs"))
def _(spark, sf):
    return contract.required_nulls(obs(spark, sf))


REVISED = "SELECT *, 'e1' AS export_id, TIMESTAMP '2024-02-01' AS snapshot_at FROM obs UNION ALL SELECT * REPLACE (price * 2 AS price, 'reviewed' AS match_status), 'e2', TIMESTAMP '2024-03-01' FROM obs WHERE cast(observation_id AS INT) % 3 = 0"


def revised(spark, sf):
    o = obs(spark, sf)
    first = o.withColumns({"export_id": F.lit("e1"), "snapshot_at": F.lit("2024-02-01").cast("timestamp")})
    again = o.filter("cast(observation_id as int) % 3 = 0").withColumns({"price": F.col("price") * 2, "match_status": F.lit("reviewed"), "export_id": F.lit("e2"), "snapshot_at": F.lit("2024-03-01").cast("timestamp")})
    return first.unionByName(again)


@query("market_conflicts", sql("SELECT observation_id, count(DISTINCT (observed_at, retailer_id, store_id, retailer_product_id, currency, price, regular_price, is_available, is_promotion)) AS versions FROM revised GROUP BY 1 HAVING versions > 1", revised=REVISED))
def _(spark, sf):
    return contract.conflicts(revised(spark, sf), ["observation_id"], contract.CORE)


@query("metadata_conflicts", sql("SELECT observation_id, snapshot_at, count(DISTINCT (match_status, category_id, barcodes)) AS versions FROM u GROUP BY 1, 2 HAVING versions > 1", revised=REVISED, u="SELECT * FROM revised UNION ALL SELECT * REPLACE ('x' AS category_id) FROM revised WHERE cast(observation_id AS INT) % 5 = 0"))
def _(spark, sf):
    df = revised(spark, sf)
    df = df.unionByName(df.filter("cast(observation_id as int) % 5 = 0").withColumn("category_id", F.lit("x")))
    return contract.conflicts(df, ["observation_id", "snapshot_at"], ["match_status", "category_id", "barcodes"]).withColumn("snapshot_at", F.col("snapshot_at").cast("timestamp_ntz"))


@query("dedup_latest", sql("SELECT observation_id, round(price, 6) AS price, match_status, export_id FROM revised QUALIFY row_number() OVER (PARTITION BY observation_id ORDER BY snapshot_at DESC, export_id) = 1", revised=REVISED))
def _(spark, sf):
    return rounds(contract.deduplicate(revised(spark, sf)).select("observation_id", "price", "match_status", "export_id"))


COV = "SELECT r AS retailer_id, r || '_c' || c AS store_id, cast(d AS DATE) AS date, CASE WHEN r = 'error' AND day(d) % 11 = 0 THEN 'failed' ELSE 'successful' END AS crawl_status FROM (VALUES ('click'), ('view'), ('purchase'), ('signup'), ('error')) t(r), range(3) g(c), generate_series(DATE '2024-01-03', DATE '2024-01-30', INTERVAL 1 DAY) s(d)"


@query("coverage_dedup", f"WITH cov AS ({COV}) SELECT retailer_id, store_id, date, CASE WHEN day(date) % 2 = 0 THEN 'partial' ELSE crawl_status END AS crawl_status FROM cov")
def _(spark, sf):
    cov = adapter.coverage(spark)
    old = cov.withColumn("snapshot_at", F.lit("2024-02-01").cast("timestamp"))
    new = cov.filter(F.dayofmonth("date") % 2 == 0).withColumns({"crawl_status": F.lit("partial"), "snapshot_at": F.lit("2024-03-01").cast("timestamp")})
    return contract.checked_coverage(old.unionByName(new)).select("retailer_id", "store_id", "date", "crawl_status")


@query("tie_multiplicity", sql("SELECT observation_id, cast(ties AS BIGINT) AS ties FROM pilot"))
def _(spark, sf):
    return P.with_ties(obs(spark, sf)).select("observation_id", F.col("timestamp_multiplicity").alias("ties"))


@query("last_of_day", sql(f"SELECT {OFFER_SQL}, event_date, observation_id, price FROM lastday"))
def _(spark, sf):
    return P.last_of_day(P.with_ties(obs(spark, sf).filter(F.col("observed_at") < F.lit(CFG.end).cast("timestamp")))).select(*OFFER, "event_date", "observation_id", "price")


@query("daily_states", sql(f"SELECT {ROW_SQL}, price, {b('age AS state_age_days')}, today AS event_recorded_today FROM states"))
def _(spark, sf):
    return rounds(P.daily_states(obs(spark, sf), CFG).select(*ROW, "price", "state_age_days", "event_recorded_today"))


@query("evidence", sql(f"SELECT {ROW_SQL}, problem AS known_collection_problem, trusted AS high_confidence_link, valid AS historical_link_valid FROM flagged"))
def _(spark, sf):
    return P.with_evidence(P.daily_states(obs(spark, sf), CFG), adapter.coverage(spark), CFG).select(*ROW, "known_collection_problem", "high_confidence_link", "historical_link_valid")


@query("panel_flags", sql("SELECT evidence AS evidence_type, state_ok AS state_eligible, match_ok AS match_eligible, count(*) AS n FROM panel GROUP BY ALL"))
def _(spark, sf):
    return panel(spark, sf).groupBy("evidence_type", "state_eligible", "match_eligible").agg(F.count(F.lit(1)).alias("n"))


@query("transitions", sql(f"SELECT {ROW_SQL}, pprice AS previous_price, outcome_ok AS outcome_eligible, {r('r AS log_return')}, promo_switch AS promotion_transition FROM panel"))
def _(spark, sf):
    return rounds(panel(spark, sf).select(*ROW, "previous_price", "outcome_eligible", "log_return", "promotion_transition"))


@query("panel_summary", sql("SELECT count(*) AS states, count(*) FILTER (WHERE today) AS event_days, count(*) FILTER (WHERE state_ok) AS eligible_states, count(*) FILTER (WHERE match_ok) AS matched_states, count(*) FILTER (WHERE outcome_ok) AS eligible_outcomes, count(*) FILTER (WHERE abs(r) > 1e-10) AS changes, count(*) FILTER (WHERE problem) AS problem_days FROM panel"))
def _(spark, sf):
    return P.summary(panel(spark, sf))


LAGS = f"{r('lag_return')}, cast(lag_age AS DOUBLE) AS lag_state_age, lag_date"  # doubles where whole numbers can be null


@query("feature_base", sql(f"SELECT {ROW_SQL}, family AS feed_family, lag_promotion, {LAGS} FROM base"))
def _(spark, sf):
    return rounds(base(spark, sf).select(*ROW, "feed_family", "lag_promotion", "lag_return", F.col("lag_state_age").cast("double").alias("lag_state_age"), "lag_date"))


@query("targets", sql(f"SELECT {ROW_SQL}, {r('r AS log_return')} FROM targets"))
def _(spark, sf):
    return rounds(X.targets(base(spark, sf)).select(*ROW, "log_return"))


@query("shocks", sql(f"SELECT {ROW_SQL}, {r('r AS log_return')} FROM shocks"))
def _(spark, sf):
    return rounds(X.shocks(base(spark, sf)).select(*ROW, "log_return"))


PEERS = f"SELECT {ROW_SQL}, source_retailer, source_date, {b('lag_days')}, {r('mark')} FROM peers"


@query("peer_daily_source", sql(PEERS))
def _(spark, sf):
    return rounds(peers(spark, sf))


@query("peer_daily_source_barcode", sql(PEERS, "AND list_has_any(t.barcodes, s.barcodes)"))
def _(spark, sf):
    return rounds(peers(spark, sf, X.Variant("barcode")))


@query("retailer_exposures", sql(f"SELECT {ROW_SQL}, source_retailer, {b('active_days')}, {r('mean_mark', 'decayed_count', 'mean_lag_days')} FROM exposures"))
def _(spark, sf):
    return rounds(X.retailer_exposures(peers(spark, sf), CFG))


@query("daily_peer_prices", sql(f"SELECT date, canonical_product_id, city_id, family AS feed_family, {r('low AS minimum_price', 'mean AS mean_price')}, {b('offers')} FROM prices"))
def _(spark, sf):
    return rounds(X.daily_peer_prices(base(spark, sf)).drop("unit", "quantity", "pack_count"))


@query("competitor_context", sql(f"SELECT {ROW_SQL}, {r('cheapest AS cheapest_peer_price', 'average AS mean_peer_price')}, {b('families AS peer_families')} FROM rivals"))
def _(spark, sf):
    bb = base(spark, sf)
    return rounds(X.competitor_context(X.targets(bb), X.daily_peer_prices(bb)))


@query("own_history", sql(f"SELECT {ROW_SQL}, cast(since AS DOUBLE) AS days_since_own_change, {r(*[f'rate{n} AS own_change_rate_{n}d' for n in (7, 30, 90)])} FROM history"))
def _(spark, sf):
    return rounds(X.own_history(X.targets(base(spark, sf))).withColumn("days_since_own_change", F.col("days_since_own_change").cast("double")))


@query("category_activity", sql("SELECT date, city_id, category_id, n FROM activity"))
def _(spark, sf):
    return X.category_activity(X.group_activity(X.shocks(base(spark, sf))))


@query("product_context", sql(f"SELECT {ROW_SQL}, cross_city AS cross_city_count, same_product AS same_product_count FROM product"))
def _(spark, sf):
    bb = base(spark, sf)
    return X.product_context(X.targets(bb), X.group_activity(X.shocks(bb)), CFG)


@query("rolling_activity", sql(f"SELECT date, city_id, category_id, {b('n AS category_n')} FROM rolling"))
def _(spark, sf):
    return X.rolling_activity(X.category_activity(X.group_activity(X.shocks(base(spark, sf)))), CFG)


@query("contextual_exposures", sql(f"SELECT {ROW_SQL}, {b('cross_city_count', 'category_count', 'cross_category_count')} FROM context"))
def _(spark, sf):
    bb = base(spark, sf)
    t, groups = X.targets(bb), X.group_activity(X.shocks(bb))
    return rounds(X.contextual_exposures(t, X.product_context(t, groups, CFG), X.rolling_activity(X.category_activity(groups), CFG)))


WHOLE = ["changed", "lag_state_age", "day_of_week", "peer_active_days", *[f"peer_active_{n}d" for n in (1, 3, 7, 14)], "days_since_own_change", "was_cheapest", "priced_peer_families", "cross_city_count", "category_count", "cross_category_count"]
REAL = ["magnitude", "lag_return", "peer_mark", "peer_decay", *[f"own_change_rate_{n}d" for n in (7, 30, 90)], "cheapest_peer_log_gap", "mean_peer_log_gap"]
FEATURES = f"SELECT {ROW_SQL}, canonical_product_id, city_id, category_id, lag_promotion, {b(*WHOLE)}, {r(*REAL)} FROM features"


@query("features", sql(FEATURES))
def _(spark, sf):
    return rounds(features(spark, sf))


NO_PROMO = "SELECT * FROM base WHERE pmatch AND canonical_product_id = pcanon AND NOT is_promotion AND NOT ppromo"


@query("features_no_promo", sql(FEATURES, kept=NO_PROMO))
def _(spark, sf):
    return rounds(features(spark, sf, X.Variant(exclude_promotions=True)))


@query("features_recent", sql(FEATURES, kept="SELECT * FROM base WHERE pmatch AND canonical_product_id = pcanon AND age <= 1 AND lag_age <= 1"))
def _(spark, sf):
    return rounds(features(spark, sf, X.Variant(max_age_days=1)))


@query("features_barcode", sql(FEATURES, "AND list_has_any(t.barcodes, s.barcodes)"))
def _(spark, sf):
    return rounds(features(spark, sf, X.Variant("barcode")))


@query("feature_summary", sql("SELECT count(*) AS n, sum(changed)::BIGINT AS changes, min(date) AS first_date, max(date) AS last_date FROM features"))
def _(spark, sf):
    return features(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.sum("changed").alias("changes"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("basket", sql(f"SELECT {OFFER_SQL}, base_price, {r('weight')} FROM basket"))
def _(spark, sf):
    return rounds(A.basket(A.basket_candidates(panel(spark, sf), CFG)))


WEIGHTED = f"SELECT {OFFER_SQL}, price AS base_price, price / sum(price) OVER () AS weight FROM panel WHERE state_ok AND date = DATE '2024-01-03'"


def weighted(spark, sf):
    candidates = A.basket_candidates(panel(spark, sf), CFG)
    return A.basket(candidates, candidates.select(*OFFER, F.col("price").alias("weight")))


@query("basket_weighted", sql(f"SELECT {OFFER_SQL}, {r('weight')} FROM basket", basket=WEIGHTED))
def _(spark, sf):
    return rounds(weighted(spark, sf).select(*OFFER, "weight"))


INDEX = f"SELECT date, {b('basket_quotes', 'eligible_quotes')}, {r('weight_coverage', 'relative AS weighted_log_relative', 'promotion_weight')}, round(CASE WHEN weight_coverage >= 0.8 THEN 100 * exp(relative / weight_coverage) END, 6) AS index_value FROM index_days"


def index(spark, sf):
    p = panel(spark, sf)
    return A.price_index(p, A.basket(A.basket_candidates(p, CFG)), CFG)


@query("price_index", sql(INDEX))
def _(spark, sf):
    return rounds(index(spark, sf))


@query("price_index_weighted", sql(INDEX, basket=WEIGHTED))
def _(spark, sf):
    return rounds(A.price_index(panel(spark, sf), weighted(spark, sf), CFG))


@query("index_summary", sql("SELECT count(*) AS days, count(*) FILTER (WHERE weight_coverage >= 0.8) AS published_days, round(min(weight_coverage), 6) AS minimum_coverage FROM index_days"))
def _(spark, sf):
    return rounds(index(spark, sf).agg(F.count(F.lit(1)).alias("days"), F.count("index_value").alias("published_days"), F.min("weight_coverage").alias("minimum_coverage")))


@query("network", sql(f"""SELECT e.source_retailer, f.retailer_id AS target_retailer, count(*) AS exposed_risk_rows, {r('avg(changed) AS exposed_change_rate', 'avg(magnitude) FILTER (WHERE changed = 1) AS mean_target_mark', 'avg(mean_mark) AS mean_source_mark', 'avg(active_days) AS mean_source_active_days', 'avg(mean_lag_days) AS mean_exposure_lag_days', 'any_value(base_rate) AS baseline_rate')}, any_value(n) AS risk_rows, round(avg(changed) - any_value(base_rate), 6) AS rate_difference
FROM exposures e JOIN features f USING ({ROW_SQL}) JOIN (SELECT retailer_id, avg(changed) AS base_rate, count(*) AS n FROM features GROUP BY 1) b ON b.retailer_id = f.retailer_id GROUP BY 1, 2"""))
def _(spark, sf):
    return rounds(A.network(features(spark, sf), X.retailer_exposures(peers(spark, sf), CFG)))


@query("promotion_followup", sql(f"""SELECT retailer_id, is_promotion, promo_switch AS promotion_transition, count(*) AS changes, count(*) FILTER (WHERE n = 7) AS complete_followups, round(avg(cast(sign(later - pprice) = sign(price - pprice) AS INT)) FILTER (WHERE n = 7), 6) AS fraction_same_direction
FROM (SELECT a.retailer_id, a.store_id, a.retailer_product_id, a.date, a.is_promotion, a.promo_switch, a.price, a.pprice, count(*) FILTER (WHERE b.state_ok) AS n, max(b.price) FILTER (WHERE b.date = a.date + 7) AS later
 FROM panel a LEFT JOIN panel b ON {" AND ".join(f"a.{c} = b.{c}" for c in OFFER)} AND b.date > a.date AND b.date <= a.date + 7 WHERE a.outcome_ok AND abs(a.r) > 1e-10 GROUP BY ALL) GROUP BY 1, 2, 3"""))
def _(spark, sf):
    return rounds(A.promotion_followup(panel(spark, sf)))


@query("timestamp_audit", sql(f"""SELECT count(*) AS price_change_events, count(DISTINCT cast(observed_at AS TIME)) AS distinct_times_of_day, count(DISTINCT date_trunc('minute', observed_at)) AS distinct_event_minutes, {r("avg(cast(cast(observed_at AS TIME) = TIME '00:00:00' AS DOUBLE)) AS midnight_share")}, count(*) > 0 AND count(DISTINCT cast(observed_at AS TIME)) >= least(100.0, count(*) * 0.05) AS supports_continuous_time
FROM (SELECT *, lag(price) OVER (PARTITION BY {OFFER_SQL} ORDER BY observed_at, observation_id) AS prior FROM obs WHERE price > 0 AND is_available) WHERE prior > 0 AND price <> prior"""))
def _(spark, sf):
    return rounds(A.timestamp_audit(obs(spark, sf)))


def response(spark, sf):
    bb = base(spark, sf)
    t = X.targets(bb)
    return A.response_rows(X.peer_daily_source(t, X.shocks(bb), CFG), t)


RATES = r("avg(changed) AS response_rate", "avg(residual) AS adjusted_rate_difference")


@query("response_overall", sql(f"SELECT {b('lag_days')}, count(*) AS target_days, sum(changed)::BIGINT AS changes, {RATES}, {r('avg(agrees) FILTER (WHERE changed = 1 AND peer_mark <> 0) AS directional_agreement')}, count(*) FILTER (WHERE source_events > 1) AS overlapping_target_days FROM response GROUP BY lag_days"))
def _(spark, sf):
    return rounds(A.response_overall(response(spark, sf)))


@query("response_isolated", sql(f"SELECT {b('lag_days')}, count(*) AS target_days, {RATES} FROM response WHERE source_events = 1 GROUP BY lag_days"))
def _(spark, sf):
    return rounds(A.response_isolated(response(spark, sf)))


@query("response_heterogeneity", sql(f"SELECT retailer_id, category_id, {b('lag_days')}, count(*) AS target_days, {RATES} FROM response GROUP BY retailer_id, category_id, response.lag_days HAVING count(*) >= 30 ORDER BY target_days DESC, retailer_id, category_id NULLS LAST, response.lag_days LIMIT 500"))
def _(spark, sf):
    return rounds(A.response_heterogeneity(response(spark, sf)))


@query("time_to_change", sql(f"""SELECT horizon, direction, count(*) AS observable_episodes, {r('avg(CASE WHEN next <= horizon THEN 1.0 ELSE 0 END) AS cumulative_change_probability')} FROM
(SELECT cast(sign(avg(mark)) AS DOUBLE) AS direction, CASE WHEN min(lag_days) = 1 AND count(DISTINCT lag_days) = max(lag_days) THEN max(lag_days) ELSE 0 END AS through, min(lag_days) FILTER (WHERE abs(r) > 1e-10) AS next
 FROM peers JOIN targets USING ({ROW_SQL}) GROUP BY source_retailer, source_date, {OFFER_SQL}, category_id) e, range(1, 15) h(horizon) WHERE through >= horizon GROUP BY 1, 2"""))
def _(spark, sf):
    bb = base(spark, sf)
    t = X.targets(bb)
    return rounds(A.time_to_change(X.peer_daily_source(t, X.shocks(bb), CFG), t))


@query("excitation_products", sql("SELECT canonical_product_id, count(*) AS risk_days, count(*) FILTER (WHERE abs(r) > 1e-10) AS changes, count(DISTINCT retailer_id) AS retailers FROM targets GROUP BY 1 HAVING retailers >= 2 AND changes >= 10 ORDER BY changes DESC, canonical_product_id LIMIT 100"))
def _(spark, sf):
    return A.excitation_products(X.targets(base(spark, sf)))


@query("monthly_signal", sql(f"""SELECT m.month, {r('index_mean')}, valid_days, {r('diffusion_signal')} FROM (SELECT cast(date_trunc('month', date) AS DATE) AS month, avg(CASE WHEN weight_coverage >= 0.8 THEN 100 * exp(relative / weight_coverage) END) AS index_mean, count(*) FILTER (WHERE weight_coverage >= 0.8) AS valid_days FROM index_days GROUP BY 1) m
LEFT JOIN (SELECT cast(date_trunc('month', date) AS DATE) AS month, avg(peer_decay) AS diffusion_signal FROM features GROUP BY 1) s USING (month)"""))
def _(spark, sf):
    return rounds(A.monthly_signal(index(spark, sf), features(spark, sf)).select("month", "index_mean", "valid_days", "diffusion_signal"))


def events(spark, sf):
    return L.build_events(obs(spark, sf))


@query("clean_events", sql(f"SELECT observation_id, {r('price_change')}, clean AS clean_price_change, trusted AS high_confidence_link FROM pilot"))
def _(spark, sf):
    return rounds(events(spark, sf).select("observation_id", "price_change", "clean_price_change", "high_confidence_link"))


@query("pilot_panel", sql(f"""SELECT cast(g.d AS DATE) AS date, {OFFER_SQL}, price, {b("date_diff('day', event_date, cast(g.d AS DATE)) AS state_age_days")}, CASE WHEN event_date = cast(g.d AS DATE) THEN 'event_recorded' ELSE 'carried_forward_unverified' END AS observation_status
FROM (SELECT *, least(coalesce(lead(event_date) OVER (PARTITION BY {OFFER_SQL} ORDER BY event_date), DATE '2024-02-01'), DATE '2024-02-01') AS upto FROM (SELECT *, cast(observed_at AS DATE) AS event_date FROM pilot QUALIFY row_number() OVER (PARTITION BY {OFFER_SQL}, cast(observed_at AS DATE) ORDER BY observed_at DESC, cast(observation_id AS BIGINT) DESC) = 1)) s,
LATERAL (SELECT unnest(generate_series(greatest(event_date, DATE '2024-01-01'), upto - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS d) g"""))
def _(spark, sf):
    return rounds(L.pilot_panel(events(spark, sf), FIRST, LAST).select("date", *OFFER, "price", "state_age_days", "observation_status"))


@query("totals_profile", sql(f"""SELECT count(*) AS observations, count(*) - count(DISTINCT observation_id) AS duplicate_ids, count(DISTINCT retailer_id) AS retailers, count(DISTINCT (retailer_id, store_id)) AS stores, count(DISTINCT ({OFFER_SQL})) AS offers, count(DISTINCT city_id) AS cities,
count(*) FILTER (WHERE canonical_product_id IS NULL) AS unlinked, count(*) FILTER (WHERE price IS NULL OR price <= 0) AS invalid_prices, count(*) FILTER (WHERE quantity IS NULL OR unit IS NULL) AS missing_unit_metadata, count(*) FILTER (WHERE pack_count <= 0 OR quantity <= 0) AS invalid_pack_metadata,
count(*) FILTER (WHERE is_promotion IS DISTINCT FROM (regular_price IS NOT NULL)) AS promotion_flag_inconsistencies, count(*) FILTER (WHERE regular_price < price) AS reference_below_price, 0::BIGINT AS links_created_after_event, count(*) FILTER (WHERE observation_id IS NULL OR observed_at IS NULL) AS missing_required_fields FROM obs"""))
def _(spark, sf):
    return L.totals_profile(obs(spark, sf))


@query("retailer_profile", sql(f"""SELECT retailer_id, count(*) AS observations, count(DISTINCT store_id) AS stores, count(DISTINCT (store_id, retailer_product_id)) AS offers, count(*) FILTER (WHERE is_promotion) AS promotions, count(*) FILTER (WHERE NOT is_available) AS unavailable, count(*) FILTER (WHERE clean) AS clean_changes,
{r('median((epoch_us(observed_at) - epoch_us(pat)) / 3.6e9) AS median_gap_hours', 'quantile_cont((epoch_us(observed_at) - epoch_us(pat)) / 3.6e9, 0.95) AS p95_gap_hours')} FROM pilot GROUP BY 1"""))
def _(spark, sf):
    return rounds(L.retailer_profile(events(spark, sf)))


@query("matching_profile", sql(f"SELECT match_method, match_status, count(*) AS observations, {r('min(match_confidence)::DOUBLE AS min_confidence', 'avg(match_confidence) AS mean_confidence', 'max(match_confidence)::DOUBLE AS max_confidence')} FROM obs GROUP BY 1, 2"))
def _(spark, sf):
    return rounds(L.matching_profile(obs(spark, sf)))


@query("event_profile", sql("SELECT clean AS clean_price_change, trusted AS high_confidence_link, count(*) AS events FROM pilot GROUP BY 1, 2"))
def _(spark, sf):
    return events(spark, sf).groupBy("clean_price_change", "high_confidence_link").agg(F.count(F.lit(1)).alias("events"))


@query("event_totals", sql(f"""SELECT count(*) FILTER (WHERE pprice IS NULL) AS initial_events, count(*) FILTER (WHERE clean) AS clean_changes, count(*) FILTER (WHERE clean AND trusted) AS high_confidence_changes, count(*) FILTER (WHERE clean AND ppromo = is_promotion) AS changes_without_promotion_transition,
count(*) FILTER (WHERE ties > 1) AS tied_timestamp_rows, count(*) FILTER (WHERE pprice = price) AS unchanged_price_events, {r('median((epoch_us(observed_at) - epoch_us(pat)) / 3.6e9) AS median_gap_hours', 'quantile_cont((epoch_us(observed_at) - epoch_us(pat)) / 3.6e9, 0.95) AS p95_gap_hours')},
count(*) FILTER (WHERE clean AND abs(price / pprice - 1) > 1) AS changes_over_100pct FROM pilot"""))
def _(spark, sf):
    return rounds(L.event_totals(events(spark, sf)))


@query("panel_profile", f"SELECT count(*) AS rows, count(*) FILTER (WHERE observation_status = 'event_recorded') AS event_days, count(*) FILTER (WHERE observation_status <> 'event_recorded') AS carried_days, max(state_age_days)::BIGINT AS max_state_age_days FROM ({_SQL['pilot_panel']})")
def _(spark, sf):
    return L.panel_profile(L.pilot_panel(events(spark, sf), FIRST, LAST)).withColumn("max_state_age_days", F.col("max_state_age_days").cast("long"))


@query("mapping_profile", sql("SELECT count(*) AS rows, count(*) FILTER (WHERE retailer_id <> 'view') AS selected_rows, count(*) FILTER (WHERE x) AS barcode_overlap_rows, count(*) FILTER (WHERE f IS NOT NULL OR u IS NOT NULL) AS historical_validity_rows FROM (SELECT retailer_id, store_id, retailer_product_id, canonical_product_id, bool_or(len(barcodes) > 1) AS x, min(link_valid_from) AS f, max(link_valid_to) AS u FROM obs GROUP BY ALL)"))
def _(spark, sf):
    links = obs(spark, sf).groupBy(*OFFER, "canonical_product_id").agg(F.bool_or(F.size("barcodes") > 1).alias("barcode_overlap"), F.min("link_valid_from").alias("valid_from"), F.max("link_valid_to").alias("valid_to"))
    return L.mapping_profile(links.withColumn("selected_for_observation_export", F.col("retailer_id") != "view"))


@query("mapping_consistency", sql("SELECT count(*) AS unmatched_observations FROM obs WHERE retailer_id = 'view' AND canonical_product_id IS NOT NULL"))
def _(spark, sf):
    o = obs(spark, sf)
    links = o.select(*OFFER, "canonical_product_id").distinct().withColumn("selected_for_observation_export", F.col("retailer_id") != "view")
    return L.mapping_consistency(o, links)


@query("canonical_overlap", sql("SELECT count(*) AS canonical_products, count(*) FILTER (WHERE n >= 2) AS multi_retailer, count(*) FILTER (WHERE c >= 2) AS multi_retailer_changers, count(*) FILTER (WHERE p > 1) AS inconsistent_packs FROM (SELECT canonical_product_id, count(DISTINCT retailer_id) AS n, count(DISTINCT retailer_id) FILTER (WHERE clean AND trusted) AS c, count(DISTINCT (unit, quantity, pack_count)) AS p FROM pilot GROUP BY 1)"))
def _(spark, sf):
    return L.canonical_overlap(events(spark, sf))


@query("store_activity", sql("SELECT s.retailer_id, s.store_id, cast(d AS DATE) AS date, coalesce(n, 0) AS events, CASE WHEN n > 0 THEN 'some_events_recorded' ELSE 'unknown' END AS activity_status FROM (SELECT DISTINCT retailer_id, store_id FROM obs) s CROSS JOIN generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY) g(d) LEFT JOIN (SELECT retailer_id, store_id, cast(observed_at AS DATE) AS day, count(*) AS n FROM obs GROUP BY ALL) a ON a.retailer_id = s.retailer_id AND a.store_id = s.store_id AND a.day = cast(d AS DATE)"))
def _(spark, sf):
    return L.store_activity(obs(spark, sf), FIRST, LAST)


@query("lead_lag", sql("""SELECT source AS source_retailer, target AS target_retailer, count(*) AS paired_source_changes, round(median(h), 6) AS median_lag_hours FROM (SELECT a.observation_id, a.retailer_id AS source, b.retailer_id AS target, min(floor(epoch_us(b.observed_at) / 1000000.0)::BIGINT - floor(epoch_us(a.observed_at) / 1000000.0)::BIGINT) / 3600.0 AS h
FROM pilot a JOIN pilot b ON a.canonical_product_id = b.canonical_product_id AND a.city_id = b.city_id AND a.retailer_id <> b.retailer_id AND sign(a.price_change) = sign(b.price_change) AND b.observed_at > a.observed_at AND b.observed_at <= a.observed_at + INTERVAL 72 HOURS WHERE a.clean AND a.trusted AND b.clean AND b.trusted GROUP BY 1, 2, 3) GROUP BY 1, 2"""))
def _(spark, sf):
    return rounds(L.lead_lag(events(spark, sf)))


@query("persistence", sql(f"SELECT retailer_id, count(pprice) AS observed_transitions, {r('avg(cast(price = pprice AS INT)) FILTER (WHERE pprice IS NOT NULL) AS exact_accuracy', 'avg(abs(price - pprice)) AS mean_absolute_error')} FROM pilot GROUP BY 1"))
def _(spark, sf):
    return rounds(L.persistence(events(spark, sf)))


@query("event_regimes", sql("""SELECT strftime(observed_at, '%Y-%m') AS month, retailer_id, count(*) AS events, count(*) FILTER (WHERE has AND NOT dp AND NOT da AND NOT dr AND NOT dm) AS repeated_states, count(*) FILTER (WHERE has AND dp) AS price_changes, count(*) FILTER (WHERE has AND da) AS availability_changes, count(*) FILTER (WHERE has AND dr) AS reference_changes,
count(*) FILTER (WHERE has AND da AND NOT dp AND NOT dr AND NOT dm) AS availability_only, count(*) FILTER (WHERE ties > 1) AS tied_events FROM (SELECT *, price IS DISTINCT FROM pprice AS dp, is_available IS DISTINCT FROM pavail AS da, regular_price IS DISTINCT FROM pregular AS dr, is_promotion IS DISTINCT FROM ppromo AS dm FROM pilot) GROUP BY 1, 2"""))
def _(spark, sf):
    return L.event_regimes(obs(spark, sf))


SCOPE = "count(*) AS observations, count(DISTINCT (retailer_id, store_id, retailer_product_id)) AS offers, count(*) FILTER (WHERE price <= 0) AS invalid_prices FROM obs GROUP BY 1"


@query("export_months", sql(f"SELECT strftime(observed_at, '%Y-%m') AS month, {SCOPE}"))
def _(spark, sf):
    return L.export_scope(obs(spark, sf), ["month"])


@query("export_categories", sql(f"SELECT category_id, {SCOPE}"))
def _(spark, sf):
    return L.export_scope(obs(spark, sf), ["category_id"])


@query("export_totals", sql("SELECT count(*) AS observations, strftime(min(observed_at), '%Y-%m-%d %H:%M:%S') AS first_observation, strftime(max(observed_at), '%Y-%m-%d %H:%M:%S') AS last_observation, count(DISTINCT retailer_id) AS retailers, count(DISTINCT city_id) AS cities, count(DISTINCT category_id) AS categories, count(*) FILTER (WHERE canonical_product_id IS NULL) AS unlinked, count(*) FILTER (WHERE price <= 0 OR NOT isfinite(price)) AS invalid_prices FROM obs"))
def _(spark, sf):
    return timed(L.export_totals(obs(spark, sf))).drop("dated_links")


@query("export_retailers", sql("SELECT retailer_id, count(*) AS observations, strftime(min(observed_at), '%Y-%m-%d %H:%M:%S') AS first_observation, strftime(max(observed_at), '%Y-%m-%d %H:%M:%S') AS last_observation, count(DISTINCT city_id) AS cities FROM obs GROUP BY 1"))
def _(spark, sf):
    return timed(L.export_retailers(obs(spark, sf)))


def timed(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_observation", "last_observation")})


@query("assumption_audit", sql("SELECT strftime(date, '%Y-%m') AS month, count(*) FILTER (WHERE outcome_ok) AS continuous_rows, count(*) FILTER (WHERE outcome_ok AND today) AS event_rows, round(avg(cast(abs(r) > 1e-10 AS INT)) FILTER (WHERE outcome_ok), 6) AS continuous_rate, round(avg(cast(abs(r) > 1e-10 AS INT)) FILTER (WHERE outcome_ok AND today), 6) AS event_rate FROM panel GROUP BY 1"))
def _(spark, sf):
    hit, ok = (F.abs("log_return") > 1e-10).cast("int"), F.col("outcome_eligible")
    today = ok & F.col("event_recorded_today")
    return rounds(panel(spark, sf).groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(F.count_if(ok).alias("continuous_rows"), F.count_if(today).alias("event_rows"), F.avg(F.when(ok, hit)).alias("continuous_rate"), F.avg(F.when(today, hit)).alias("event_rate")))


@query("peer_association", sql("SELECT peer_active_days > 0 AS exposed, count(*) AS n, round(avg(changed), 6) AS change_rate, round(avg(cast(sign(magnitude) = sign(peer_mark) AS INT)) FILTER (WHERE changed = 1 AND peer_mark <> 0), 6) AS same_direction FROM features GROUP BY 1"))
def _(spark, sf):
    same = (F.signum("magnitude") == F.signum("peer_mark")).cast("int")
    df = features(spark, sf).groupBy((F.col("peer_active_days") > 0).alias("exposed"))
    return rounds(df.agg(F.count(F.lit(1)).alias("n"), F.avg("changed").alias("change_rate"), F.avg(F.when((F.col("changed") == 1) & (F.col("peer_mark") != 0), same)).alias("same_direction")))


@query("asof_releases", "WITH r AS (SELECT cast(o_orderkey % 12 AS BIGINT) AS month, o_orderdate AS released_at, o_totalprice AS value FROM orders), g AS (SELECT make_timestamp(1996 + i, 1, 1, 0, 0, 0) AS origin FROM range(4) t(i)) SELECT origin, month, max(released_at) AS released_at, round(arg_max(value, (released_at, value)), 6) AS value FROM g JOIN r ON released_at <= origin GROUP BY 1, 2")
def _(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    releases = o.select((F.col("o_orderkey") % 12).alias("month"), F.col("o_orderdate").alias("released_at"), F.col("o_totalprice").alias("value"))
    origins = spark.range(4).select(F.make_timestamp_ntz((F.col("id") + 1996).cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("origin"))
    return rounds(A.as_of(releases, F.broadcast(origins)))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# Models: beyond SQL, but for what a constant forecast gives.
def forecasts(spark, sf):
    """The training-rate forecast of each row from a fixed rate."""
    return features(spark, sf).select(*ROW, "changed", F.lit(0.3).alias("probability"), F.lit(0.0).alias("expected_return"), F.col("magnitude").alias("actual_return"), "day_of_week")


@query("metrics", sql(f"SELECT day_of_week::BIGINT AS day_of_week, count(*) AS n, sum(changed)::BIGINT AS events, {r('avg((0.3 - changed) * (0.3 - changed)) AS brier', 'avg(CASE WHEN changed = 1 THEN -ln(0.3) ELSE -ln(0.7) END) AS log_loss', 'avg(0.3::DOUBLE) AS mean_probability', 'avg(changed) AS event_rate', 'avg(abs(magnitude)) AS return_mae', 'sqrt(avg(magnitude * magnitude)) AS return_rmse')} FROM features GROUP BY 1"))
def _(spark, sf):
    from quayside.operators.models import metrics

    return rounds(metrics(forecasts(spark, sf), ["day_of_week"]))


@query("calibration", sql("SELECT least(floor(p * 10), 9)::BIGINT AS bin, count(*) AS n, round(avg(p), 6) + 0.0 AS mean_probability, round(avg(changed), 6) + 0.0 AS observed_rate FROM (SELECT changed, own_change_rate_30d AS p FROM features) GROUP BY 1"))
def _(spark, sf):
    from quayside.operators.models import calibration

    return rounds(calibration(features(spark, sf).withColumn("probability", F.col("own_change_rate_30d")), []))


def _stored_features(spark, sf):
    """What models read of the features, from files: many jobs start from them, and each has a small plan."""
    from quayside.operators.models import BASE, CATEGORIES, DIFFUSION

    b = stored(base(spark, sf), "feature_base")
    columns = dict.fromkeys([*ROW, "changed", "magnitude", *CATEGORIES, *BASE, *DIFFUSION])
    out = stored(X.features_of(b, CFG).select(*columns), "features")
    drop_stored(b)
    return out


def _predictions(spark, sf, boosted=False):
    from quayside.operators.models import walk_forward

    return walk_forward(_stored_features(spark, sf), CFG, boosted)


@query("walk_forward")
def _(spark, sf):
    from quayside.operators.models import metrics

    return rounds(metrics(_predictions(spark, sf, True), ["model", "train_end_exclusive"]))


def _coefficients(spark, sf, fit):
    """One fit on all rows: (term, coefficient), the intercept as term -1."""
    from quayside.operators.models import Encoder

    df = features(spark, sf).cache()
    encoder = Encoder.fit(df, True)
    rows = df.select("changed", "magnitude", encoder.features().alias("features"))
    model = fit(rows.coalesce(1 + df.count() // 50_000).persist())  # iterations over few rows are all overhead
    rows = [(-1, float(model.intercept)), *enumerate(float(x) for x in model.coefficients)]
    return rounds(spark.createDataFrame(rows, "term long, coefficient double"))


@query("glm_logistic")
def _(spark, sf):
    from quayside.operators.models import fit_logistic

    return _coefficients(spark, sf, fit_logistic)


@query("glm_poisson")
def _(spark, sf):
    from quayside.operators.models import fit_poisson

    return _coefficients(spark, sf, fit_poisson)


@query("ridge_marks")
def _(spark, sf):
    from quayside.operators.models import fit_marks

    return _coefficients(spark, sf, fit_marks)


@query("boosted")
def _(spark, sf):
    from quayside.operators.models import fit_boosted, score_boosted

    df = _stored_features(spark, sf)
    return rounds(score_boosted(df, *fit_boosted(df, True, CFG.seed)).select(*ROW, "probability"))


@query("nowcast")
def _(spark, sf):
    from quayside.operators.nowcast import evaluate_nowcast
    from quayside.sources.generators import monthly_rows

    f, t = monthly_rows()
    out = evaluate_nowcast(spark.createDataFrame(f, "month date, available_at timestamp, index_change double, diffusion_signal double"), spark.createDataFrame(t, "month date, released_at timestamp, value double"))
    return rounds(spark.createDataFrame([(k, v["n"], v["mae"], v["rmse"]) for k, v in out["models"].items()], "model string, n long, mae double, rmse double"))


@query("grocery_targets")
def _(spark, sf):
    """Exposures from all categories, models on the targets of some alone."""
    from quayside.operators.models import metrics, walk_forward

    rows = features(spark, sf).filter(F.col("category_id").isin("k0", "k1")).cache()
    return rounds(metrics(walk_forward(rows, CFG, False), ["model", "train_end_exclusive"]))


@query("focused_excitation")
def _(spark, sf):
    from quayside.operators.models import focused_walk_forward, metrics

    df = features(spark, sf)
    chosen = A.excitation_products(X.targets(base(spark, sf)))
    rows = df.join(chosen, "canonical_product_id", "left_semi").cache()
    return rounds(metrics(focused_walk_forward(rows, CFG), ["model", "train_end_exclusive"]))


@query("block_bootstrap")
def _(spark, sf):
    from quayside.operators.models import block_bootstrap, daily_scores

    difference, (low, high) = block_bootstrap(daily_scores(_predictions(spark, sf), "hazard_baseline", "hazard_diffusion"))
    return rounds(spark.createDataFrame([(difference, low, high)], "difference double, low double, high double"))

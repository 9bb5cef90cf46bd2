"""Basket, price index, retailer network, promotion follow-up, response timing, excitation selection."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quayside.functions.columns import changed, finite
from quayside.operators.features import ROW
from quayside.settings import Settings
from quayside.sources.contract import OFFER


def basket_candidates(panel: DataFrame, cfg: Settings) -> DataFrame:
    rows = panel.filter(F.col("state_eligible") & (F.col("date") == F.lit(cfg.start)))
    return rows.filter(F.col("category_id").isin(cfg.grocery_categories)) if cfg.grocery_categories else rows


def basket(candidates: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Offers with an opening price and a weight; weights sum to 1. By default a product's offers share its weight."""
    own = candidates.select(*OFFER, "canonical_product_id", F.col("price").alias("base_price"))
    if weights is None:
        product = F.coalesce("canonical_product_id", F.concat_ws("|", *OFFER))
        raw = own.withColumn("weight", F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy(product)))
    else:
        bad = ~(finite(F.col("weight")) & (F.col("weight") > 0))
        if not weights.filter(bad).isEmpty() or not weights.groupBy(*OFFER).count().filter("count > 1").isEmpty():
            raise ValueError("weights must be finite, positive and unique per offer")
        if not weights.join(own, OFFER, "left_anti").isEmpty():
            raise ValueError("a weight has no eligible opening price")
        raw = own.join(weights.select(*OFFER, "weight"), OFFER)
    total = raw.agg(F.sum("weight").alias("total"))  # one row
    return raw.crossJoin(F.broadcast(total)).select(*OFFER, "base_price", (F.col("weight") / F.col("total")).alias("weight"))


def price_index(panel: DataFrame, chosen: DataFrame, cfg: Settings) -> DataFrame:
    """Weighted geometric mean of price relatives by day, published where enough weight is observed."""
    df = panel.join(chosen, OFFER)
    ok = F.col("state_eligible")
    weight = F.when(ok, F.col("weight"))
    daily = df.groupBy("date").agg(
        F.count(F.lit(1)).alias("basket_quotes"), F.coalesce(F.sum(weight), F.lit(0.0)).alias("weight_coverage"),
        F.sum(weight * F.log(F.when(ok, F.col("price") / F.col("base_price")))).alias("weighted_log_relative"),
        F.count_if(ok).alias("eligible_quotes"), F.coalesce(F.sum(F.when(ok & F.col("is_promotion"), F.col("weight"))), F.lit(0.0)).alias("promotion_weight"),
    )
    return daily.withColumn("index_value", F.when(F.col("weight_coverage") >= cfg.min_index_weight_coverage, 100 * F.exp(F.col("weighted_log_relative") / F.col("weight_coverage"))))


def network(features: DataFrame, exposures: DataFrame) -> DataFrame:
    base = features.groupBy("retailer_id").agg(F.avg("changed").alias("baseline_rate"), F.count(F.lit(1)).alias("risk_rows"))
    edges = exposures.join(features.select(*ROW, "changed", "magnitude"), ROW).groupBy("source_retailer", F.col("retailer_id").alias("target_retailer")).agg(
        F.count(F.lit(1)).alias("exposed_risk_rows"), F.avg("changed").alias("exposed_change_rate"), F.avg(F.when(F.col("changed") == 1, F.col("magnitude"))).alias("mean_target_mark"),
        F.avg("mean_mark").alias("mean_source_mark"), F.avg("active_days").alias("mean_source_active_days"), F.avg("mean_lag_days").alias("mean_exposure_lag_days"),
    )
    df = edges.join(base.withColumnRenamed("retailer_id", "target_retailer"), "target_retailer")
    return df.withColumn("rate_difference", F.col("exposed_change_rate") - F.col("baseline_rate"))


def promotion_followup(panel: DataFrame, horizon: int = 7) -> DataFrame:
    """What became of price changes after ``horizon`` days; a window over the offer's days replaces the self join."""
    if type(horizon) is not int or horizon < 1:
        raise ValueError("horizon must be positive")
    w = Window.partitionBy(*OFFER).orderBy(F.unix_date("date"))
    later = w.rangeBetween(1, horizon)
    df = panel.withColumn("days", F.sum(F.col("state_eligible").cast("int")).over(later)).withColumn("later_price", F.max("price").over(w.rangeBetween(horizon, horizon)))
    df = df.filter(F.col("outcome_eligible") & changed(F.col("log_return")))
    complete = F.coalesce("days", F.lit(0)) == horizon
    same = (F.signum(F.col("later_price") - F.col("previous_price")) == F.signum(F.col("price") - F.col("previous_price"))).cast("int")
    return df.groupBy("retailer_id", "is_promotion", "promotion_transition").agg(F.count(F.lit(1)).alias("changes"), F.count_if(complete).alias("complete_followups"), F.avg(F.when(complete, same)).alias("fraction_same_direction"))


def timestamp_audit(obs: DataFrame) -> DataFrame:
    """Whether the times of price changes can carry continuous-time claims."""
    w = Window.partitionBy(*OFFER).orderBy("observed_at", "observation_id")
    rows = obs.filter("price > 0 and is_available").withColumn("prior", F.lag("price").over(w)).filter("prior > 0 and price <> prior")
    time = F.date_format("observed_at", "HH:mm:ss.SSSSSS")
    out = rows.agg(F.count(F.lit(1)).alias("price_change_events"), F.count_distinct(time).alias("distinct_times_of_day"), F.count_distinct(F.date_trunc("minute", "observed_at")).alias("distinct_event_minutes"), F.avg((time == "00:00:00.000000").cast("double")).alias("midnight_share"))
    return out.withColumn("supports_continuous_time", (F.col("price_change_events") > 0) & (F.col("distinct_times_of_day") >= F.least(F.lit(100.0), F.col("price_change_events") * 0.05)))


def response_rows(peers: DataFrame, t: DataFrame) -> DataFrame:
    """Targets by days since a peer's change, against the mean of their retailer, category and date."""
    linked = peers.filter("lag_days <= 14").groupBy(*ROW, "lag_days").agg(F.count(F.lit(1)).alias("source_events"), F.avg("mark").alias("peer_mark"))
    df = linked.join(t.select(*ROW, "category_id", "log_return"), ROW).withColumn("changed", changed(F.col("log_return")).cast("int"))
    rate = F.avg(F.col("changed").cast("double")).over(Window.partitionBy("date", "retailer_id", "category_id"))
    agrees = ((F.col("changed") == 1) & (F.signum("log_return") == F.signum("peer_mark"))).cast("int")
    return df.withColumn("residual", F.col("changed") - rate).withColumn("direction_agrees", agrees)


def response_overall(rows: DataFrame) -> DataFrame:
    return rows.groupBy("lag_days").agg(
        F.count(F.lit(1)).alias("target_days"), F.sum("changed").alias("changes"), F.avg("changed").alias("response_rate"), F.avg("residual").alias("adjusted_rate_difference"),
        F.avg(F.when((F.col("changed") == 1) & (F.col("peer_mark") != 0), F.col("direction_agrees"))).alias("directional_agreement"), F.count_if(F.col("source_events") > 1).alias("overlapping_target_days"),
    )


def response_isolated(rows: DataFrame) -> DataFrame:
    return rows.filter("source_events = 1").groupBy("lag_days").agg(F.count(F.lit(1)).alias("target_days"), F.avg("changed").alias("response_rate"), F.avg("residual").alias("adjusted_rate_difference"))


def response_heterogeneity(rows: DataFrame, least: int = 30, top: int = 500) -> DataFrame:
    df = rows.groupBy("retailer_id", "category_id", "lag_days").agg(F.count(F.lit(1)).alias("target_days"), F.avg("changed").alias("response_rate"), F.avg("residual").alias("adjusted_rate_difference"))
    order = [F.desc("target_days"), F.asc("retailer_id"), F.asc_nulls_last("category_id"), F.asc("lag_days")]
    return df.filter(F.col("target_days") >= least).orderBy(*order).limit(top)


def time_to_change(peers: DataFrame, t: DataFrame) -> DataFrame:
    """Share of targets that changed within h days of a peer's change, among those observed for h days on end."""
    df = peers.join(t.select(*ROW, "category_id", "log_return"), ROW)
    episodes = df.groupBy("source_retailer", "source_date", *OFFER, "category_id").agg(
        F.signum(F.avg("mark")).alias("direction"), F.min("lag_days").alias("first"), F.max("lag_days").alias("last"), F.count_distinct("lag_days").alias("n"),
        F.min(F.when(changed(F.col("log_return")), F.col("lag_days"))).alias("next_change"),
    )
    through = F.when((F.col("first") == 1) & (F.col("n") == F.col("last")), F.least("last", F.lit(14)))
    spread = episodes.withColumn("horizon", F.explode(F.when(through >= 1, F.sequence(F.lit(1), through))))
    hit = F.coalesce(F.col("next_change") <= F.col("horizon"), F.lit(False)).cast("double")
    return spread.groupBy("horizon", "direction").agg(F.count(F.lit(1)).alias("observable_episodes"), F.avg(hit).alias("cumulative_change_probability"))


def excitation_products(t: DataFrame, top: int = 100) -> DataFrame:
    df = t.groupBy("canonical_product_id").agg(F.count(F.lit(1)).alias("risk_days"), F.count_if(changed(F.col("log_return"))).alias("changes"), F.count_distinct("retailer_id").alias("retailers"))
    return df.filter("retailers >= 2 and changes >= 10").orderBy(F.desc("changes"), "canonical_product_id").limit(top)


def monthly_signal(index: DataFrame, features: DataFrame) -> DataFrame:
    """Monthly index means with their completeness, and the mean diffusion signal."""
    month = lambda c: F.trunc(c, "month")
    by = index.groupBy(month("date").alias("month")).agg(F.avg("index_value").alias("index_mean"), F.count("index_value").alias("valid_days"), F.max("date").alias("last"))
    by = by.withColumn("days", F.dayofmonth(F.last_day("month"))).withColumn("complete", F.col("last") == F.last_day("month"))
    signal = features.groupBy(month("date").alias("month")).agg(F.avg("peer_decay").alias("diffusion_signal"))
    return by.join(signal, "month", "left")


def monthly_vintage(index: DataFrame, features: DataFrame, share: float = 0.8) -> DataFrame:
    """The latest month with a change against the month right before, both valid on enough days."""
    m = monthly_signal(index, features).withColumn("usable", F.col("complete") & (F.col("valid_days") >= share * F.col("days")))
    before = m.filter("usable").select(F.add_months("month", 1).alias("month"), F.col("index_mean").alias("previous"))
    found = m.filter("usable").join(before, "month")
    return found.select("month", (100 * (F.col("index_mean") / F.col("previous") - 1)).alias("index_change"), "diffusion_signal").orderBy(F.desc("month")).limit(1)


def as_of(releases: DataFrame, origins: DataFrame, key: str = "month") -> DataFrame:
    """For each origin the latest release of each key at or before it: one range join, reduced by its maximum."""
    pairs = origins.join(releases, F.col("released_at") <= F.col("origin"))
    return pairs.groupBy("origin", key).agg(F.max_by("value", F.struct("released_at", "value")).alias("value"), F.max("released_at").alias("released_at"))


def next_day(date: dt.date, n: int = 1) -> dt.date:
    return date + dt.timedelta(days=n)

"""Profiles of a raw export: clean price changes, quality counters, store activity, lead and lag between retailers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quayside.functions.columns import days, finite, flag
from quayside.operators.panel import last_of_day, numeric_id, with_ties
from quayside.sources.contract import OFFER


def build_events(obs: DataFrame, currency: str = "KZT", confidence: float = 0.9) -> DataFrame:
    """Adds what came before each event, and whether it is a clean price change."""
    w = Window.partitionBy(*OFFER).orderBy("observed_at", numeric_id().asc_nulls_last(), "observation_id")
    previous = {"price": "price", "available": "is_available", "observed_at": "observed_at", "promotion": "is_promotion", "currency": "currency", "canonical_product_id": "canonical_product_id", "multiplicity": "timestamp_multiplicity"}
    df = with_ties(obs)
    df = df.withColumns({f"previous_{k}": F.lag(c).over(w) for k, c in previous.items()})
    clean = (F.col("previous_price") > 0) & (F.col("price") > 0) & (F.col("price") != F.col("previous_price")) & F.col("is_available") & F.col("previous_available")
    clean = clean & (F.col("currency") == currency) & (F.col("previous_currency") == F.col("currency")) & (F.col("timestamp_multiplicity") == 1) & (F.col("previous_multiplicity") == 1)
    trusted = F.col("canonical_product_id").isNotNull() & (flag(F.col("match_method") == "manual") | flag(F.col("match_confidence") >= confidence))
    return df.withColumns({
        "price_change": F.col("price") - F.col("previous_price"),
        "price_return": F.when(F.col("previous_price") > 0, F.col("price") / F.col("previous_price") - 1),
        "clean_price_change": flag(clean), "high_confidence_link": trusted,
    })


def pilot_panel(events: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    last = last_of_day(events)
    following = F.lead("event_date").over(Window.partitionBy(*OFFER).orderBy("event_date"))
    until = F.date_sub(F.least(F.coalesce(following, F.lit(end)), F.lit(end)), 1)
    df = last.withColumn("__until", until).withColumn("date", F.explode(days(F.greatest("event_date", F.lit(start)), F.col("__until"))))
    today = F.col("event_date") == F.col("date")
    return df.select(
        "date", *OFFER, "city_id", "canonical_product_id", "price", "regular_price", "is_promotion", "is_available", "currency", F.col("observed_at").alias("last_observed_at"),
        F.datediff("date", "event_date").alias("state_age_days"), today.alias("event_recorded_today"), F.when(today, "event_recorded").otherwise("carried_forward_unverified").alias("observation_status"),
        F.lit(None).cast("boolean").alias("crawl_success_known"), (F.col("timestamp_multiplicity") > 1).alias("last_event_timestamp_ambiguous"),
    )


def totals_profile(obs: DataFrame) -> DataFrame:
    c = F.col
    missing = c("observation_id").isNull() | c("observed_at").isNull() | c("retailer_id").isNull() | c("store_id").isNull() | c("retailer_product_id").isNull() | c("city_id").isNull() | c("currency").isNull() | c("is_available").isNull() | c("is_promotion").isNull()
    created = c("link_record_created_at") > c("observed_at") if "link_record_created_at" in obs.columns else F.lit(False)
    return obs.agg(
        F.count(F.lit(1)).alias("observations"), (F.count(F.lit(1)) - F.count_distinct("observation_id")).alias("duplicate_ids"), F.count_distinct("retailer_id").alias("retailers"),
        F.count_distinct(F.struct("retailer_id", "store_id")).alias("stores"), F.count_distinct(F.struct(*OFFER)).alias("offers"), F.count_distinct("city_id").alias("cities"),
        F.count_if(c("canonical_product_id").isNull()).alias("unlinked"), F.count_if(c("price").isNull() | (c("price") <= 0)).alias("invalid_prices"),
        F.count_if(c("quantity").isNull() | c("unit").isNull()).alias("missing_unit_metadata"), F.count_if((c("pack_count") <= 0) | (c("quantity") <= 0)).alias("invalid_pack_metadata"),
        F.count_if(~c("is_promotion").eqNullSafe(c("regular_price").isNotNull())).alias("promotion_flag_inconsistencies"), F.count_if(c("regular_price") < c("price")).alias("reference_below_price"),
        F.count_if(created).alias("links_created_after_event"), F.count_if(missing).alias("missing_required_fields"),
    )


def retailer_profile(events: DataFrame) -> DataFrame:
    gap = (F.unix_micros("observed_at") - F.unix_micros("previous_observed_at")) / 3.6e9
    return events.groupBy("retailer_id").agg(
        F.count(F.lit(1)).alias("observations"), F.count_distinct("store_id").alias("stores"), F.count_distinct(F.struct("store_id", "retailer_product_id")).alias("offers"),
        F.count_if("is_promotion").alias("promotions"), F.count_if(~F.col("is_available")).alias("unavailable"), F.count_if("clean_price_change").alias("clean_changes"),
        F.median(gap).alias("median_gap_hours"), F.percentile(gap, 0.95).alias("p95_gap_hours"),
    )


def event_totals(events: DataFrame) -> DataFrame:
    """What the events of the whole export are: first ones, clean changes, ties, gaps between them."""
    c = F.col
    clean = c("clean_price_change")
    gap = (F.unix_micros("observed_at") - F.unix_micros("previous_observed_at")) / 3.6e9
    return events.agg(
        F.count_if(c("previous_price").isNull()).alias("initial_events"), F.count_if(clean).alias("clean_changes"), F.count_if(clean & c("high_confidence_link")).alias("high_confidence_changes"),
        F.count_if(clean & (c("previous_promotion") == c("is_promotion"))).alias("changes_without_promotion_transition"), F.count_if(c("timestamp_multiplicity") > 1).alias("tied_timestamp_rows"),
        F.count_if(c("previous_price") == c("price")).alias("unchanged_price_events"), F.median(gap).alias("median_gap_hours"), F.percentile(gap, 0.95).alias("p95_gap_hours"),
        F.count_if(clean & (F.abs("price_return") > 1)).alias("changes_over_100pct"),
    )


def panel_profile(panel: DataFrame) -> DataFrame:
    today = F.col("event_recorded_today")
    return panel.agg(F.count(F.lit(1)).alias("rows"), F.count_if(today).alias("event_days"), F.count_if(~today).alias("carried_days"), F.max("state_age_days").alias("max_state_age_days"))


def mapping_profile(links: DataFrame) -> DataFrame:
    dated = F.col("valid_from").isNotNull() | F.col("valid_to").isNotNull()
    return links.agg(F.count(F.lit(1)).alias("rows"), F.count_if("selected_for_observation_export").alias("selected_rows"), F.count_if("barcode_overlap").alias("barcode_overlap_rows"), F.count_if(dated).alias("historical_validity_rows"))


def matching_profile(obs: DataFrame) -> DataFrame:
    return obs.groupBy("match_method", "match_status").agg(F.count(F.lit(1)).alias("observations"), F.min("match_confidence").alias("min_confidence"), F.avg("match_confidence").alias("mean_confidence"), F.max("match_confidence").alias("max_confidence"))


def mapping_consistency(obs: DataFrame, links: DataFrame) -> DataFrame:
    """Linked observations without a selected link of the same product."""
    chosen = links.filter("selected_for_observation_export")
    return obs.filter("canonical_product_id is not null").join(chosen, [*OFFER, "canonical_product_id"], "left_anti").agg(F.count(F.lit(1)).alias("unmatched_observations"))


def canonical_overlap(events: DataFrame) -> DataFrame:
    good = F.col("clean_price_change") & F.col("high_confidence_link")
    products = events.filter("canonical_product_id is not null").groupBy("canonical_product_id").agg(
        F.count_distinct("retailer_id").alias("retailers"), F.count_distinct(F.when(good, F.col("retailer_id"))).alias("changers"), F.count_distinct(F.struct("unit", "quantity", "pack_count")).alias("packs")
    )
    return products.agg(F.count(F.lit(1)).alias("canonical_products"), F.count_if(F.expr("retailers >= 2")).alias("multi_retailer"), F.count_if(F.expr("changers >= 2")).alias("multi_retailer_changers"), F.count_if(F.expr("packs > 1")).alias("inconsistent_packs"))


def store_activity(obs: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Events by store and day, days without any included."""
    day = F.explode(F.sequence(F.lit(start), F.lit(end - dt.timedelta(days=1)), F.expr("interval 1 day"))).alias("date")
    grid = obs.select("retailer_id", "store_id").distinct().select("retailer_id", "store_id", day)
    active = obs.groupBy("retailer_id", "store_id", F.to_date("observed_at").alias("date")).agg(F.count(F.lit(1)).alias("events"))
    df = grid.join(active, ["retailer_id", "store_id", "date"], "left")
    return df.select("retailer_id", "store_id", "date", F.coalesce("events", F.lit(0)).alias("events"), F.when(F.col("events") > 0, "some_events_recorded").otherwise("unknown").alias("activity_status"))


def lead_lag(events: DataFrame, hours: int = 72) -> DataFrame:
    """Median hours to the first later change of the same direction at each other retailer.

    The range becomes an equality on buckets of ``hours``: a source reaches its own bucket and the next.
    """
    good = events.filter("clean_price_change and high_confidence_link").withColumn("way", F.signum("price_change"))
    seconds = F.unix_seconds("observed_at")
    pack = [F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(f"__{c}") for c in ("unit", "quantity", "pack_count")]
    keys = ["canonical_product_id", "city_id", "way", "__unit", "__quantity", "__pack_count", "bucket"]
    span = hours * 3600
    own = good.select("*", *pack, F.floor(seconds / span).alias("b"))
    a = own.select(*keys[:-1], "observation_id", F.col("retailer_id").alias("source_retailer"), F.col("observed_at").alias("from"), F.explode(F.array("b", F.col("b") + 1)).alias("bucket"))
    b = own.select(*keys[:-1], F.col("retailer_id").alias("target_retailer"), F.col("observed_at").alias("to"), F.col("b").alias("bucket"))
    pairs = a.join(b, keys).filter("source_retailer <> target_retailer and `to` > `from`").filter(F.unix_micros("to") - F.unix_micros("from") <= span * 1_000_000)
    first = pairs.groupBy("observation_id", "source_retailer", "target_retailer").agg((F.min(F.unix_seconds("to") - F.unix_seconds("from")) / 3600.0).alias("lag_hours"))
    return first.groupBy("source_retailer", "target_retailer").agg(F.count(F.lit(1)).alias("paired_source_changes"), F.median("lag_hours").alias("median_lag_hours"))


def persistence(events: DataFrame) -> DataFrame:
    known = F.col("previous_price").isNotNull()
    return events.groupBy("retailer_id").agg(F.count_if(known).alias("observed_transitions"), F.avg(F.when(known, (F.col("price") == F.col("previous_price")).cast("int"))).alias("exact_accuracy"), F.avg(F.abs(F.col("price") - F.col("previous_price"))).alias("mean_absolute_error"))


def event_regimes(obs: DataFrame) -> DataFrame:
    """By month and retailer: what each event changed against the one before."""
    w = Window.partitionBy(*OFFER).orderBy("observed_at", numeric_id().asc_nulls_last(), "observation_id")
    df = with_ties(obs).withColumn("has", F.lag("observation_id").over(w).isNotNull())
    for c in ("price", "is_available", "regular_price", "is_promotion"):
        df = df.withColumn(f"new_{c}", ~F.col(c).eqNullSafe(F.lag(c).over(w)))
    seen = F.col("has")
    nothing = ~F.col("new_price") & ~F.col("new_is_available") & ~F.col("new_regular_price") & ~F.col("new_is_promotion")
    only = F.col("new_is_available") & ~F.col("new_price") & ~F.col("new_regular_price") & ~F.col("new_is_promotion")
    return df.groupBy(F.date_format("observed_at", "yyyy-MM").alias("month"), "retailer_id").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(seen & nothing).alias("repeated_states"), F.count_if(seen & F.col("new_price")).alias("price_changes"), F.count_if(seen & F.col("new_is_available")).alias("availability_changes"),
        F.count_if(seen & F.col("new_regular_price")).alias("reference_changes"), F.count_if(seen & only).alias("availability_only"), F.count_if(F.col("timestamp_multiplicity") > 1).alias("tied_events"),
    )


def export_scope(obs: DataFrame, by: list[str]) -> DataFrame:
    return obs.withColumn("month", F.date_format("observed_at", "yyyy-MM")).groupBy(*by).agg(F.count(F.lit(1)).alias("observations"), F.count_distinct(F.struct(*OFFER)).alias("offers"), F.count_if(F.col("price") <= 0).alias("invalid_prices"))


def export_totals(obs: DataFrame) -> DataFrame:
    """The scope of a whole export in one row."""
    c = F.col
    return obs.agg(
        F.count(F.lit(1)).alias("observations"), F.min("observed_at").alias("first_observation"), F.max("observed_at").alias("last_observation"), F.count_distinct("retailer_id").alias("retailers"),
        F.count_distinct("city_id").alias("cities"), F.count_distinct("category_id").alias("categories"), F.count_if(c("link_valid_from").isNotNull()).alias("dated_links"),
        F.count_if(c("canonical_product_id").isNull()).alias("unlinked"), F.count_if((c("price") <= 0) | ~finite(c("price"))).alias("invalid_prices"),
    )


def export_retailers(obs: DataFrame) -> DataFrame:
    return obs.groupBy("retailer_id").agg(F.count(F.lit(1)).alias("observations"), F.min("observed_at").alias("first_observation"), F.max("observed_at").alias("last_observation"), F.count_distinct("city_id").alias("cities"))

"""Daily states from an event log: last event of a day, carried forward, with evidence and transitions.

All steps share the offer as key, so one exchange and sort serves the whole chain.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quayside.functions.columns import days, finite, flag
from quayside.settings import Settings
from quayside.sources.contract import OFFER

def numeric_id() -> Column:
    """The id as a number, null if it is none; breaks ties of time."""
    return F.col("observation_id").try_cast("decimal(38,0)")



def with_ties(obs: DataFrame) -> DataFrame:
    """Adds how many events an offer has at the same instant."""
    return obs.withColumn("timestamp_multiplicity", F.count(F.lit(1)).over(Window.partitionBy(*OFFER, "observed_at")))


def last_of_day(events: DataFrame) -> DataFrame:
    """The last event of each offer and UTC day: by time, then numeric id, then id."""
    day = Window.partitionBy(*OFFER, "event_date").orderBy(F.col("observed_at").desc(), numeric_id().desc_nulls_last(), F.col("observation_id").desc())
    dated = events.withColumn("event_date", F.to_date("observed_at"))
    return dated.withColumn("__n", F.row_number().over(day)).filter("__n = 1").drop("__n")


def daily_states(obs: DataFrame, cfg: Settings) -> DataFrame:
    """One row per offer and day from its first event on; the day before the start is kept to seed lags."""
    last = last_of_day(with_ties(obs.filter(F.col("observed_at") < F.lit(cfg.end).cast("timestamp")).repartition(*OFFER)))  # all windows find their offers together
    following = F.lead("event_date").over(Window.partitionBy(*OFFER).orderBy("event_date"))
    first = F.greatest("event_date", F.lit(cfg.start - dt.timedelta(days=1)))
    spans = last.withColumn("__until", F.date_sub(F.coalesce(following, F.lit(cfg.end)), 1))
    out = spans.withColumn("date", F.explode(days(first, F.col("__until")))).drop("__until")
    return out.withColumn("state_age_days", F.datediff("date", "event_date")).withColumn("event_recorded_today", F.col("date") == F.col("event_date"))


def with_evidence(states: DataFrame, coverage: DataFrame, cfg: Settings) -> DataFrame:
    """Adds the flags that say whether a state counts, and on what evidence."""
    cov = coverage.select("retailer_id", "store_id", "date", "crawl_status", "is_complete_utc_day")
    df = states.join(cov, ["retailer_id", "store_id", "date"], "left")
    at = F.col("date").cast("timestamp")
    success = flag((F.col("crawl_status") == "successful") & F.col("is_complete_utc_day"))
    problem = flag(F.col("crawl_status").isin("failed", "partial", "not_attempted")) | flag(~F.col("is_complete_utc_day"))
    valid = flag((F.col("link_valid_from") <= at) & (F.col("link_valid_to").isNull() | (F.col("link_valid_to") > at)))
    trusted = flag(F.col("match_method") == "manual") | flag(F.col("match_confidence") >= cfg.min_match_confidence)
    linked = trusted & ~F.coalesce("match_status", F.lit("legacy_unspecified")).isin("rejected", "disabled", "unmatched")
    df = df.withColumns({"store_day_success": success, "known_collection_problem": problem, "historical_link_valid": valid, "high_confidence_link": linked})
    observed = F.col("event_recorded_today")
    if cfg.assume_store_success_confirms_state:
        observed = observed | F.col("store_day_success")
    usable = finite(F.col("price")) & (F.col("price") > 0) & (F.col("currency") == cfg.currency) & F.col("is_available") & (F.col("timestamp_multiplicity") == 1) & ~F.col("known_collection_problem")
    if not cfg.assume_continuous_observation:
        usable = usable & (F.col("state_age_days") <= cfg.max_state_age_days) & observed
    match = F.col("canonical_product_id").isNotNull() & F.col("high_confidence_link")
    if not cfg.retrospective_mapping:
        match = match & F.col("historical_link_valid")
    kind = F.when(F.col("known_collection_problem"), "collection_problem").when(F.col("event_recorded_today"), "event_evidence")
    if cfg.assume_continuous_observation:
        kind = kind.otherwise("assumed_continuous_observation")
    else:
        kind = kind.when(F.col("store_day_success"), "store_success_only").otherwise("unknown")
    return df.withColumns({"state_eligible": flag(usable), "match_eligible": flag(match), "evidence_type": kind})


def transitions(panel: DataFrame, cfg: Settings) -> DataFrame:
    """Adds the previous day's values and the outcome; days before the start are dropped afterwards."""
    w = Window.partitionBy(*OFFER).orderBy("date")
    previous = {"price": "price", "date": "date", "state_eligible": "state_eligible", "promotion": "is_promotion", "canonical": "canonical_product_id", "match_eligible": "match_eligible"}
    df = panel.withColumns({f"previous_{k}": F.lag(c).over(w) for k, c in previous.items()})
    eligible = flag(F.col("state_eligible") & F.col("previous_state_eligible") & (F.col("previous_date") == F.date_sub("date", 1)))
    df = df.withColumn("outcome_eligible", eligible)
    df = df.withColumn("log_return", F.when(F.col("outcome_eligible"), F.log(F.col("price") / F.col("previous_price"))))
    df = df.withColumn("promotion_transition", ~F.col("is_promotion").eqNullSafe(F.col("previous_promotion")))
    # the same window serves the sparse prior-day lookup of the features
    prior = flag(F.lag("match_eligible").over(w)) & (F.lag("date").over(w) == F.date_sub("date", 1)) & (F.lag("date").over(w) >= F.lit(cfg.start))
    df = df.withColumns({f"lag_{k}": F.when(prior, F.lag(c).over(w)) for k, c in {"promotion": "is_promotion", "return": "log_return", "state_age": "state_age_days", "date": "date"}.items()})
    return df.filter(F.col("date") >= F.lit(cfg.start))


def build_panel(obs: DataFrame, coverage: DataFrame, cfg: Settings) -> DataFrame:
    opening = obs.filter("false") if "export_id" not in obs.columns else obs.filter(F.col("export_id").startswith("opening:") & (F.col("observed_at") >= F.lit(cfg.start).cast("timestamp")))
    if "export_id" in obs.columns and not opening.isEmpty():
        raise ValueError("opening states must be before the start")
    return transitions(with_evidence(daily_states(obs, cfg), coverage, cfg), cfg)


def summary(panel: DataFrame) -> DataFrame:
    return panel.agg(
        F.count(F.lit(1)).alias("states"), F.count_if("event_recorded_today").alias("event_days"), F.count_if("state_eligible").alias("eligible_states"),
        F.count_if("match_eligible").alias("matched_states"), F.count_if("outcome_eligible").alias("eligible_outcomes"),
        F.count_if(F.abs("log_return") > 1e-10).alias("changes"), F.count_if("known_collection_problem").alias("problem_days"),
    )

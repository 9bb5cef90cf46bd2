"""Release-aware nowcasts of a monthly target from the index and the diffusion signal."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.functions.columns import finite
from quayside.sources.contract import latest


def origins(features: DataFrame) -> DataFrame:
    """Earliest valid feature row of each month and the moment its forecast is made."""
    at = F.coalesce("forecast_at", F.add_months("month", 1).cast("timestamp")) if "forecast_at" in features.columns else F.add_months("month", 1).cast("timestamp")
    rows = features.withColumn("origin", at).filter(F.col("available_at") <= F.col("origin"))
    return latest(rows, ["month"], [F.col("origin").asc(), F.col("available_at").desc()])


def training_vintages(features: DataFrame, targets: DataFrame) -> DataFrame:
    """For each origin, earlier months with their latest target release by then: one range join for all origins."""
    own = origins(features)
    past = own.select(F.col("month").alias("past"), F.col("index_change").alias("x"), F.col("diffusion_signal").alias("d"), F.col("available_at").alias("seen"))
    pairs = own.select("month", "origin").join(past, (F.col("past") < F.col("month")) & (F.col("seen") <= F.col("origin")))
    known = targets.select(F.col("month").alias("past"), "released_at", "value")
    rows = pairs.join(known, "past").filter("released_at <= origin")
    return rows.groupBy("month", "origin", "past", "x", "d").agg(F.max_by("value", F.struct("released_at", "value")).alias("value"))


def checked(features: DataFrame, targets: DataFrame) -> None:
    """Raises on missing or repeated months and instants and on values that are not finite."""
    key = ["month", "available_at", *(["forecast_at"] if "forecast_at" in features.columns else [])]
    for what, df, keys, values in (("feature", origins(features), [], ["index_change", "diffusion_signal"]), ("feature", features, key, []), ("target", targets, ["month", "released_at"], ["value"])):
        null = functools.reduce(operator.or_, [F.col(c).isNull() for c in keys], F.lit(False))
        wild = functools.reduce(operator.or_, [~finite(F.col(c).cast("double")) for c in values], F.lit(False))
        found = df.agg(F.count_if(null).alias("null"), F.count_if(wild).alias("wild")).first()
        if found.null or found.wild:
            raise ValueError(f"{what} rows have {'no month or instant' if found.null else 'values that are not finite'}")
        if keys and not df.groupBy(*keys).count().filter("count > 1").isEmpty():
            raise ValueError(f"{what} rows repeat {', '.join(keys)}")


def forecasts(features: DataFrame, targets: DataFrame, min_train_months: int = 12) -> DataFrame:
    """One row per month that is forecast: its first release and the guesses of three models.

    The ridge (penalty 1 on standardised inputs, none on the level) is solved from the moments of each origin's training
    months, which one aggregation gives for all origins. Rows go by month in order of time, so results repeat exactly.
    """
    rows = training_vintages(features, targets).repartition("month").sortWithinPartitions("month", "past")
    n, spread = F.col("n"), lambda c: F.when(F.col(f"s_{c}") <= 1e-8, 1.0).otherwise(F.col(f"s_{c}"))
    moments = rows.groupBy("month").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("level"), F.covar_pop("x", "d").alias("c_xd"),
        *[f(c).alias(f"{name}_{c}") for c in "xd" for name, f in (("m", F.avg), ("s", F.stddev_pop), ("c", lambda c: F.covar_pop(c, "value")))],
    )
    diagonal = {c: n * F.col(f"s_{c}") ** 2 / spread(c) ** 2 + 1 for c in "xd"}
    across = n * F.col("c_xd") / (spread("x") * spread("d"))
    toward = {c: n * F.col(f"c_{c}") / spread(c) for c in "xd"}
    at = {"x": (F.col("index_change") - F.col("m_x")) / spread("x"), "d": (F.col("diffusion_signal") - F.col("m_d")) / spread("d")}
    both = ((toward["x"] * diagonal["d"] - toward["d"] * across) * at["x"] + (toward["d"] * diagonal["x"] - toward["x"] * across) * at["d"]) / (diagonal["x"] * diagonal["d"] - across * across)
    first = latest(targets, ["month"], [F.col("released_at").asc()]).select("month", "released_at", F.col("value").alias("first_value"))
    ready = origins(features).join(moments, "month").join(first, "month").filter((n >= min_train_months) & (F.col("released_at") > F.col("origin")))
    return ready.select("month", "origin", "first_value", F.col("level").alias("historical_mean"), (F.col("level") + toward["x"] / diagonal["x"] * at["x"]).alias("index_only"), (F.col("level") + both).alias("index_and_diffusion"))


def evaluate_nowcast(features: DataFrame, targets: DataFrame, min_train_months: int = 12) -> dict:
    """Errors of three models on first releases."""
    if type(min_train_months) is not int or min_train_months < 1:
        raise ValueError("min_train_months must be a whole number from 1")
    checked(features, targets)
    error = {m: F.col(m) - F.col("first_value") for m in ("historical_mean", "index_only", "index_and_diffusion")}
    rows = forecasts(features, targets, min_train_months).repartition(1).sortWithinPartitions("month")  # a row a month
    found = rows.agg(F.count(F.lit(1)).alias("n"), *[f.alias(f"{k}_{m}") for m, e in error.items() for k, f in (("mae", F.avg(F.abs(e))), ("rmse", F.sqrt(F.avg(e * e))))]).first()
    if not found.n:
        return {"status": "insufficient_history"}
    return {"status": "complete", "models": {m: {"n": found.n, "mae": found[f"mae_{m}"], "rmse": found[f"rmse_{m}"]} for m in error}}

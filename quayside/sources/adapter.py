"""The driver's event table as price events: who observes what, where, at what price."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.settings import Settings

SETTINGS = Settings(dt.date(2024, 1, 3), dt.date(2024, 1, 31), assume_continuous_observation=True, min_train_days=14, test_days=7)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    product, city = F.floor(F.col("user_id") / 3).cast("string"), (F.col("user_id") % 3).cast("string")
    p = F.floor(F.col("user_id") / 3)
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    promoted = k.between(3, 17)
    extra = F.when(p % 2 == 1, F.array(F.concat(F.lit("b"), product), F.concat(F.lit("x"), F.col("event_type"))))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").cast("string").alias("observation_id"),
        F.col("ts").cast("timestamp").alias("observed_at"),
        F.col("event_type").alias("retailer_id"),
        F.concat("event_type", F.lit("_c"), city).alias("store_id"),
        F.concat(F.lit("c"), city).alias("city_id"),
        F.concat("event_type", F.lit(":"), product).alias("retailer_product_id"),
        F.lit("KZT").alias("currency"),
        F.col("value").alias("price"),
        (k >= 3).alias("is_available"),
        promoted.alias("is_promotion"),
        F.concat(F.lit("p"), product).alias("canonical_product_id"),
        F.when(p % 5 != 4, F.concat(F.lit("k"), (p % 5).cast("string"))).alias("category_id"),
        F.when(promoted, F.col("value") * 1.1).alias("regular_price"),
        F.lit("g").alias("unit"),
        F.lit(1000.0).alias("quantity"),
        F.lit(1).alias("pack_count"),
        F.coalesce(extra, F.array(F.concat(F.lit("b"), product))).alias("barcodes"),
        F.when(p % 4 == 0, "manual").otherwise("auto").alias("match_method"),
        F.when(p % 7 == 0, 0.5).otherwise(0.95).alias("match_confidence"),
        F.lit("approved").alias("match_status"),
        F.lit("2023-12-22").cast("timestamp").alias("link_valid_from"),
        F.when(p % 11 == 0, F.lit("2024-01-20").cast("timestamp")).alias("link_valid_to"),
    )


def coverage(spark: SparkSession, cfg: Settings = SETTINGS) -> DataFrame:
    """Stores by days: one retailer's crawls fail on each eleventh day of the month."""
    retailers = spark.range(1).select(F.explode(F.array(*[F.lit(r) for r in ("click", "view", "purchase", "signup", "error")])).alias("retailer_id"))  # known to be small: no exchange of the panel
    day = F.explode(F.sequence(F.lit(cfg.start), F.lit(cfg.end - dt.timedelta(days=1)), F.expr("interval 1 day"))).alias("date")
    grid = retailers.select("retailer_id", F.explode(F.array(*[F.lit(f"c{i}") for i in range(3)])).alias("c")).select("retailer_id", "c", day)
    failed = (F.col("retailer_id") == "error") & (F.dayofmonth("date") % 11 == 0)
    return grid.select("retailer_id", F.concat("retailer_id", F.lit("_"), "c").alias("store_id"), "date", F.when(failed, "failed").otherwise("successful").alias("crawl_status"), F.lit(True).alias("is_complete_utc_day"))

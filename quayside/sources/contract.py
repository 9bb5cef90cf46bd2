"""The event contract: required and optional columns, validation, revisions."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

OFFER = ["retailer_id", "store_id", "retailer_product_id"]
REQUIRED = {
    "observation_id": "string", "observed_at": "timestamp", "retailer_id": "string", "store_id": "string", "city_id": "string",
    "retailer_product_id": "string", "currency": "string", "price": "double", "is_available": "boolean", "is_promotion": "boolean",
}
OPTIONAL = {
    "canonical_product_id": "string", "category_id": "string", "brand": "string", "regular_price": "double", "unit_price": "double",
    "quantity": "double", "unit": "string", "pack_count": "int", "barcodes": "array<string>", "match_method": "string",
    "match_confidence": "double", "match_status": "string", "link_record_created_at": "timestamp", "link_valid_from": "timestamp", "link_valid_to": "timestamp",
}
#: Compared when an observation_id repeats.
CORE = ["observed_at", "retailer_id", "store_id", "retailer_product_id", "currency", "price", "regular_price", "is_available", "is_promotion"]
IDS = ["observation_id", "retailer_id", "store_id", "city_id", "retailer_product_id", "currency"]
STATUSES = ["successful", "partial", "failed", "not_attempted"]


class ContractError(ValueError):
    """Input that breaks the contract."""


def normalize(raw: DataFrame, export_id: str, snapshot_at) -> DataFrame:
    """Casts to the contract; unknown columns go, missing optional ones are null."""
    if missing := set(REQUIRED) - set(raw.columns):
        raise ContractError(f"missing columns: {sorted(missing)}")
    kinds = {f.name: f.dataType for f in raw.schema}
    if not isinstance(kinds["observed_at"], T.TimestampType):
        raise ContractError("observed_at must be a timezone-aware timestamp")
    for name in ("is_available", "is_promotion"):
        if not isinstance(kinds[name], T.BooleanType):
            raise ContractError(f"{name} must be boolean")
    columns = [F.col(c).cast(t).alias(c) if c in kinds else F.lit(None).cast(t).alias(c) for c, t in (REQUIRED | OPTIONAL).items()]
    return raw.select(*columns, F.lit(export_id).alias("export_id"), F.lit(snapshot_at).cast("timestamp").alias("snapshot_at"))


def required_nulls(obs: DataFrame) -> DataFrame:
    """One row: rows with a null in a required column, and with a blank id."""
    null = functools.reduce(operator.or_, (F.col(c).isNull() for c in REQUIRED))
    blank = functools.reduce(operator.or_, (F.trim(c) == "" for c in IDS))
    return obs.agg(F.count_if(null).alias("null_rows"), F.count_if(F.coalesce(blank, F.lit(False))).alias("blank_rows"))


def conflicts(obs: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys with more than one distinct tuple of ``columns``; nulls are values of the tuple."""
    distinct = F.count_distinct(F.struct(*columns))
    return obs.groupBy(*keys).agg(distinct.alias("versions")).filter("versions > 1")


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of each key in ``order``."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def deduplicate(obs: DataFrame) -> DataFrame:
    """Latest snapshot of each observation; ties by export."""
    return latest(obs, ["observation_id"], [F.col("snapshot_at").desc(), F.col("export_id").asc()])


def checked(obs: DataFrame) -> DataFrame:
    """Raises on contract violations, else the latest revisions."""
    bad = required_nulls(obs).first()
    if bad.null_rows or bad.blank_rows:
        raise ContractError("required values are null or blank")
    if not conflicts(obs, ["observation_id"], CORE).isEmpty():
        raise ContractError("Conflicting market data for an observation")
    if not conflicts(obs, ["observation_id", "snapshot_at"], [*OPTIONAL, "city_id"]).isEmpty():
        raise ContractError("Conflicting metadata within a snapshot")
    return deduplicate(obs)


def normalize_coverage(raw: DataFrame, obs: DataFrame, snapshot_at) -> DataFrame:
    """Store-days of crawls; the retailer is inferred where a store has one retailer only."""
    if missing := {"store_id", "date", "crawl_status", "is_complete_utc_day"} - set(raw.columns):
        raise ContractError(f"missing coverage columns: {sorted(missing)}")
    if "retailer_id" not in raw.columns:
        stores = obs.select("store_id", "retailer_id").distinct()
        if not stores.groupBy("store_id").count().filter("count > 1").isEmpty():
            raise ContractError("a store has several retailers")
        raw = raw.join(stores, "store_id", "left")
    return raw.select("retailer_id", "store_id", F.col("date").cast("date").alias("date"), "crawl_status", "is_complete_utc_day", F.lit(snapshot_at).cast("timestamp").alias("snapshot_at"))


def checked_coverage(cov: DataFrame) -> DataFrame:
    key = ["retailer_id", "store_id", "date"]
    bad = functools.reduce(operator.or_, (F.col(c).isNull() for c in [*key, "crawl_status", "is_complete_utc_day"])) | ~F.col("crawl_status").isin(STATUSES)
    if not cov.filter(bad).isEmpty():
        raise ContractError("invalid coverage rows")
    if not conflicts(cov, [*key, "snapshot_at"], ["crawl_status", "is_complete_utc_day"]).isEmpty():
        raise ContractError("Conflicting coverage within a snapshot")
    return latest(cov, key, [F.col("snapshot_at").desc(), F.col("crawl_status").asc()])

"""Landing of newline-delimited JSON: row contract, Parquet, manifest."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.sources import contract
from quayside.sources.manifest import sha256_file

#: As the feed writes it: prices are text, times have an offset.
RAW = "observation_id string, observed_at string, retailer_id string, store_id string, city_id string, retailer_product_id string, currency string, price string, regular_price string, is_available boolean, is_promotion boolean, canonical_product_id string, category_id string, brand string, unit_price string, quantity string, unit string, pack_count int, barcodes array<string>, match_method string, match_confidence double, match_status string, link_record_created_at string, link_valid_from string, link_valid_to string, _bad string"
OFFSET = r"(Z|[+-][0-9]{2}:?[0-9]{2})$"


def problems(c: str = "") -> Column:
    """What breaks the row contract, as an array of names; empty if nothing does."""
    price, regular = F.col("price").try_cast("decimal(18,4)"), F.col("regular_price").try_cast("decimal(18,4)")
    checks = {
        "json": F.col("_bad").isNotNull(),
        "price": F.coalesce(price <= 0, F.lit(True)),
        "regular_price": F.col("regular_price").isNotNull() & F.coalesce(regular <= 0, F.lit(True)),
        "observed_at": ~F.coalesce(F.col("observed_at").rlike(OFFSET), F.lit(False)) | F.col("observed_at").try_cast("timestamp").isNull(),
        "flags": F.col("is_available").isNull() | F.col("is_promotion").isNull(),
        "canonical_product_id": F.coalesce(F.trim("canonical_product_id") == "", F.lit(False)),
    } | {k: F.coalesce(F.trim(k) == "", F.lit(True)) for k in contract.IDS}
    return F.array_compact(F.array(*[F.when(bad, name) for name, bad in checks.items()]))


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the contract; fails on the first row that breaks it. Gzip is read as it is."""
    raw = spark.read.schema(RAW).option("columnNameOfCorruptRecord", "_bad").json(path)
    checked = raw.withColumn("problems", problems())
    if bad := checked.filter("size(problems) > 0").select("observation_id", "problems").take(1):
        raise contract.ContractError(f"row {bad[0].observation_id}: {', '.join(bad[0].problems)}")
    return raw.select(*[F.trim(c).alias(c) if c in contract.IDS else F.col(c).cast(t).alias(c) for c, t in (contract.REQUIRED | contract.OPTIONAL).items()])


def package_landing(spark: SparkSession, source: str, target: str, export_id: str, cutoff: str) -> Path:
    """Writes the rows as zstd Parquet with a manifest; an existing target is an error."""
    root = Path(target)
    root.mkdir(parents=True, exist_ok=False)
    part = root / "price_observations"
    read_ndjson(spark, source).write.mode("errorifexists").option("compression", "zstd").option("maxRecordsPerFile", 5_000_000).parquet(str(part))
    files = []
    for f in sorted(part.glob("*.parquet")):
        files.append({"path": f"price_observations/{f.name}", "row_count": spark.read.parquet(str(f)).count(), "size_bytes": f.stat().st_size, "sha256": sha256_file(f)})
    manifest = {"format_version": 1, "schema_version": "1", "export_id": export_id, "status": "complete", "cutoff_exclusive": cutoff, "totals": {"price_observations": sum(f["row_count"] for f in files)}, "files": files}
    staged = root / ".manifest.json"
    staged.write_text(json.dumps(manifest, indent=1))
    return staged.rename(root / "manifest.json")

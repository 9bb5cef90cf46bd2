"""Manifest-described exports: verification, routing by path, union by name."""

from __future__ import annotations

import functools
import hashlib
import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.sources import contract

VERSIONS = {"1", "1.0", "v1"}


class ManifestError(ValueError):
    """An export that is not what its manifest says."""


@dataclass(frozen=True)
class Verified:
    path: Path
    rows: int | None
    sha256: str


def sha256_file(path: Path, chunk: int = 1 << 20) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(chunk):
            digest.update(block)
    return digest.hexdigest()


def inside(root: Path, name: str) -> Path:
    path = (root / name).resolve()
    if Path(name).is_absolute() or not path.is_relative_to(root.resolve()):
        raise ManifestError(f"path leaves the export: {name}")
    return path


def verify_manifest(path: str | Path) -> tuple[dict, list[Verified]]:
    """The manifest, and its files after size and hash checks."""
    path = Path(path)
    manifest = json.loads(path.read_text())
    files = manifest.get("files")
    if not isinstance(files, list) or not files:
        raise ManifestError("the manifest lists no files")
    found = []
    for entry in files:
        own = inside(path.parent, entry["path"])
        if not own.is_file():
            raise ManifestError(f"missing file: {entry['path']}")
        if own.stat().st_size != entry.get("size_bytes", entry.get("bytes")):
            raise ManifestError(f"size differs: {entry['path']}")
        if (digest := sha256_file(own)) != entry["sha256"].lower():
            raise ManifestError(f"hash differs: {entry['path']}")
        found.append(Verified(own, entry.get("row_count"), digest))
    return manifest, found


def verify_checksums(path: str | Path) -> list[Verified]:
    """Files of a SHA256SUMS list."""
    path, out = Path(path), []
    for line in path.read_text().splitlines():
        digest, _, name = line.strip().partition(" ")
        own = inside(path.parent, name.strip(" *"))
        if sha256_file(own) != digest.lower():
            raise ManifestError(f"hash differs: {name}")
        out.append(Verified(own, None, digest.lower()))
    return out


def read_union(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Parquet files united by name; missing columns are null, directory names are no columns."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (spark.read.parquet(p) for p in paths))


def load_export(spark: SparkSession, path: str | Path) -> tuple[DataFrame, DataFrame | None, dict]:
    """Observations and coverage of one export in contract form, with the manifest."""
    manifest, files = verify_manifest(path)
    if str(manifest.get("schema_version")) not in VERSIONS:
        raise ManifestError("unknown schema version")
    root = Path(path).parent.resolve()
    routed: dict[str, list[Verified]] = {}
    for f in files:
        routed.setdefault(f.path.relative_to(root).parts[0], []).append(f)
    observed = [str(f.path) for f in routed.get("price_observations", [])]
    if not observed:
        raise ManifestError("the export has no observations")
    # one scan counts all files
    counts = {r.p: r.n for part in routed.values() for r in spark.read.option("mergeSchema", True).parquet(*[str(f.path) for f in part]).groupBy(F.col("_metadata.file_path").alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    by_path = {p.split("file:", 1)[-1].replace("///", "/"): n for p, n in counts.items()}
    for f in files:
        if f.rows is not None and by_path.get(str(f.path), 0) != f.rows:
            raise ManifestError(f"row count differs: {f.path.name}")
    total = manifest.get("totals", {}).get("price_observations")
    if total is not None and total != sum(by_path.get(p, 0) for p in observed):
        raise ManifestError("totals differ from the files")
    snapshot = manifest.get("mapping_snapshot_at") or manifest["cutoff_exclusive"]
    obs = contract.normalize(read_union(spark, observed), manifest["export_id"], snapshot)
    if not obs.filter(F.col("observed_at") >= F.lit(manifest["cutoff_exclusive"]).cast("timestamp")).isEmpty():
        raise ManifestError("an event is at or after the cutoff")
    cov = [str(f.path) for f in routed.get("crawl_coverage", [])]
    return obs, contract.normalize_coverage(read_union(spark, cov), obs, snapshot) if cov else None, manifest


def load_exports(spark: SparkSession, paths: list, opening: str | None = None) -> tuple[DataFrame, DataFrame | None, list[dict]]:
    """All exports united, checked and reduced to the latest revisions; opening states rank below every export."""
    loaded = [load_export(spark, p) for p in paths]
    obs = [o for o, _, _ in loaded]
    if opening:
        obs.append(contract.normalize(spark.read.parquet(opening), "opening:" + sha256_file(Path(opening)), "1970-01-01"))
    cov = [c for _, c, _ in loaded if c is not None]
    united = contract.checked(functools.reduce(DataFrame.unionByName, obs))
    return united, contract.checked_coverage(functools.reduce(DataFrame.unionByName, cov)) if cov else None, [m for *_, m in loaded]

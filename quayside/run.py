"""One research run: panel, features, analyses and models written to a run directory with provenance."""

from __future__ import annotations

import argparse
import dataclasses
import datetime as dt
import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.operators import analytics as A
from quayside.operators import features as X
from quayside.operators import models as M
from quayside.operators import panel as P
from quayside.settings import Settings
from quayside.sources import contract, landing, manifest, rest

VARIANTS = {"source_barcode": X.Variant("barcode"), "no_promotions": X.Variant(exclude_promotions=True), "recent_state_only": X.Variant(max_age_days=1)}


def _table(df: DataFrame, run: Path, name: str) -> DataFrame:
    path = str(run / name)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def run_research(spark: SparkSession, exports: list[str], cfg: Settings, target: str, opening: str | None = None, variants: bool = True) -> dict:
    """Runs everything; ``run.json`` records inputs, settings, status and, on failure, the error."""
    run = Path(target)
    run.mkdir(parents=True, exist_ok=False)
    record = {"status": "running", "settings": dataclasses.asdict(cfg), "exports": {str(p): manifest.sha256_file(Path(p)) for p in exports}}
    save = lambda: (run / "run.json").write_text(json.dumps(record, default=str, indent=1, allow_nan=False))
    save()
    try:
        obs, cov, _ = manifest.load_exports(spark, exports, opening)
        if cov is None:
            cov = spark.createDataFrame([], "retailer_id string, store_id string, date date, crawl_status string, is_complete_utc_day boolean")
        panel = _table(P.build_panel(obs, cov, cfg), run, "panel")
        base = _table(X.feature_base(panel, cfg), run, "feature_base")
        t, s = X.targets(base), X.shocks(base)
        peers = _table(X.peer_daily_source(t, s, cfg), run, "peer_daily_source")
        features = _table(X.build_features(panel, cfg), run, "features")
        predictions = M.walk_forward(features, cfg)
        predictions.write.partitionBy("train_end_exclusive", "model").parquet(str(run / "predictions"))
        predictions = spark.read.parquet(str(run / "predictions"))
        response = A.response_rows(peers, t)
        index = A.price_index(panel, A.basket(A.basket_candidates(panel, cfg)), cfg)
        results = {
            "panel": P.summary(panel), "metrics": M.metrics(predictions, ["model"]), "calibration": M.calibration(predictions, ["model"]), "network": A.network(features, X.retailer_exposures(peers, cfg)),
            "promotions": A.promotion_followup(panel), "timestamps": A.timestamp_audit(obs), "response": A.response_overall(response), "isolated": A.response_isolated(response), "heterogeneity": A.response_heterogeneity(response),
            "time_to_change": A.time_to_change(peers, t), "index": index.orderBy("date"), "excitation_products": A.excitation_products(t),
        }
        out = {k: [r.asDict() for r in df.collect()] for k, df in results.items()}  # reports: aggregates of bounded size
        for name, v in VARIANTS.items() if variants else ():
            rows = _table(X.build_features(panel, cfg, v), run, f"features-{name}")
            out[f"metrics_{name}"] = [r.asDict() for r in M.metrics(M.walk_forward(rows, cfg, False), ["model"]).collect()]
        (run / "results.json").write_text(json.dumps(out, default=str, indent=1))
        (run / "report.md").write_text(report(out))
        record["status"] = "complete"
        record["artefacts"] = {f.name: manifest.sha256_file(f) for f in (run / "results.json", run / "report.md")}
        return out
    except BaseException as e:
        record |= {"status": "failed", "error": f"{type(e).__name__}: {str(e)[:500]}"}
        raise
    finally:
        save()


def report(out: dict) -> str:
    lines = ["# Research run", ""]
    for name, rows in out.items():
        if rows:
            head = list(rows[0])
            lines += [f"## {name}", "", "| " + " | ".join(head) + " |", "|" + " - |" * len(head), *("| " + " | ".join(str(r[c]) for c in head) + " |" for r in rows[:50]), ""]
    return "\n".join(lines)


def write_vintage(index: DataFrame, features: DataFrame, available_at: dt.datetime, target: str) -> None:
    """The latest complete month as one row that is never overwritten."""
    A.monthly_vintage(index, features).withColumn("available_at", F.lit(available_at).cast("timestamp")).coalesce(1).write.mode("errorifexists").parquet(target)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quayside")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, args in {"verify-manifest": ["manifest"], "package-landing": ["source", "target", "export_id", "cutoff"], "ingest-api": ["endpoint", "start", "end", "target"]}.items():
        p = sub.add_parser(name)
        for a in args:
            p.add_argument(a)
    p = sub.add_parser("run-research")
    p.add_argument("--export", action="append", required=True)
    p.add_argument("--settings", required=True)
    p.add_argument("--opening")
    p.add_argument("--target", required=True)
    a = parser.parse_args(argv)
    if a.command == "verify-manifest":
        print(len(manifest.verify_manifest(a.manifest)[1]), "files verified")
    else:
        spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
        if a.command == "ingest-api":
            items = rest.iter_items(rest.fetch_from(os.environ), a.endpoint, {"from": a.start, "to": a.end})
            print(rest.ingest(spark, items, a.target, dt.datetime.fromisoformat(a.start), dt.datetime.fromisoformat(a.end)), "rows")
        elif a.command == "package-landing":
            print(landing.package_landing(spark, a.source, a.target, a.export_id, a.cutoff))
        else:
            run_research(spark, a.export, Settings.load(a.settings), a.target, a.opening)


if __name__ == "__main__":
    main()

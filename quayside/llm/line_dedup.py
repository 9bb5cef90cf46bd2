"""Line deduplication over levelled sorted runs of line hashes.

Documents come in batches of descending doc_id. A batch is reduced to a run: (line hash, documents, largest doc_id),
bucketed and sorted by hash. It is merge-anti-joined with each run so far: hashes that none of them has are fresh, and the
largest doc_id of a fresh hash is the largest of all, as later batches only have smaller ones. Where two runs share a level
they are merged into one of the next level: counts add up, and the fresh row's doc_id stays. Runs are bucketed alike, so
neither the anti-join nor the merge shuffles a run again.

Lines are hashed with 128 bits. A line that every document has leaves each task once per batch of rows, and the last
join, on (hash), is one which adaptive execution splits where a hash is hot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from quayside.llm.common import added_schema, batches, cut, delete, fresh_names, new_path, text_bytes

LINES = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("key", pa.binary())])
LINES_DDL = "row long, doc_id long, key binary"


def line_key(line: bytes, least: int) -> bytes | None:
    """Hash of the stripped, ASCII-lower-cased line; None under ``least`` code points."""
    key = line.strip().lower()
    if len(key) < least or (len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least):
        return None
    return xxhash.xxh3_128_digest(key)


def _line_rows(least: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lines():
            for b in rows:
                for row, doc, text in zip(b.column("row").to_pylist(), b.column("doc_id").to_pylist(), text_bytes(b.column("text"))):
                    for key in {k for line in text.split(b"\n") if len(line) >= least and (k := line_key(line, least))}:
                        yield row, doc, key

        return batches(lines(), LINES)

    return run


class LevelledRuns:
    """Sorted runs of line hashes in the shared folder: (key, n, fresh, top), bucketed by key; at most one run a level."""

    def __init__(self, spark: SparkSession):
        self.spark, self.buckets = spark, int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[tuple[str, str] | None] = []

    def _write(self, run: DataFrame) -> tuple[str, str]:
        path = new_path(self.spark, "line-run")
        name = path.rsplit("/", 1)[1].replace("-", "_")
        run.select("key", "n", "fresh", "top").write.bucketBy(self.buckets, "key").sortBy("key").option("path", path).saveAsTable(name)
        return name, path

    def _drop(self, run: tuple[str, str]) -> None:
        self.spark.sql(f"DROP TABLE {run[0]}")
        delete(self.spark, run[1])

    def add(self, lines: DataFrame) -> None:
        """Adds a batch of (key, doc_id), a row a document; its doc_ids are not above those of earlier batches."""
        own = lines.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top"))
        own = self._write(own.repartition(self.buckets, "key").select("key", "n", F.lit(False).alias("fresh"), "top"))
        fresh = self.spark.table(own[0])
        for run in filter(None, self.levels):
            fresh = fresh.hint("merge").join(self.spark.table(run[0]).select("key"), "key", "left_anti")
        new = self.spark.table(own[0]).drop("top", "fresh").hint("merge").join(fresh.select("key", F.lit(True).alias("fresh"), "top"), "key", "left")
        run = self._write(new.withColumn("fresh", F.coalesce("fresh", F.lit(False))))
        self._drop(own)
        level = 0
        while level < len(self.levels) and self.levels[level]:
            older, self.levels[level] = self.levels[level], None
            merged = self._write(self.merged(self.spark.table(older[0]), self.spark.table(run[0])))
            self._drop(older)
            self._drop(run)
            run, level = merged, level + 1
        self.levels += [None] * (level + 1 - len(self.levels))
        self.levels[level] = run

    @staticmethod
    def merged(x: DataFrame, y: DataFrame) -> DataFrame:
        """Merge join of two runs: documents add up; a hash is fresh in one of them at most, and its doc_id is of that one."""
        x, y = (run.select("key", *[F.col(c).alias(f"{s}_{c}") for c in ("n", "fresh", "top")]) for run, s in ((x, "x"), (y, "y")))
        both = x.hint("merge").join(y, "key", "full")
        n = F.coalesce("x_n", F.lit(0)) + F.coalesce("y_n", F.lit(0))
        first = F.coalesce("x_fresh", F.lit(False))
        return both.select("key", n.alias("n"), (first | F.coalesce("y_fresh", F.lit(False))).alias("fresh"), F.when(first, F.col("x_top")).otherwise(F.col("y_top")).alias("top"))

    def all(self) -> DataFrame | None:
        """One row a hash over all runs."""
        out = None
        for run in filter(None, reversed(self.levels)):  # older runs first
            out = self.spark.table(run[0]) if out is None else self.merged(out, self.spark.table(run[0]))
        return out

    def close(self) -> None:
        for run in filter(None, self.levels):
            self._drop(run)
        self.levels = []


def line_dedup(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, n_batches: int = 4) -> DataFrame:
    """Drops repeated lines; adds ``n_lines, n_dropped, kept_sha256`` and replaces ``text`` by what stays.

    A line's key is the line stripped of ASCII white space, with A-Z lower-cased. Keys of at least ``least_chars`` code
    points that at least ``least_docs`` rows hold lose all their lines, except in the rows with the largest doc_id that
    holds it. Each row counts as a document, also where a doc_id repeats; a null doc_id is below all others. A null
    text counts as empty: one empty line, kept; its text becomes empty. Added names are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped", "kept_sha256")
    spark = docs.sparkSession
    row = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    ends = rows.agg(F.percentile_approx("doc_id", [k / n_batches for k in range(1, n_batches)]).alias("p")).first().p or []
    batch = F.lit(0)
    for end in sorted(set(ends)):
        batch = batch + (F.coalesce(F.col("doc_id") <= end, F.lit(True))).cast("int")  # the largest ids come first, null last
    path = new_path(spark, "lines")
    rows.mapInArrow(_line_rows(least_chars), LINES_DDL).withColumn("batch", batch).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(f"{LINES_DDL}, batch int").parquet(path)
    store = LevelledRuns(spark)
    for i in range(len(set(ends)) + 1):
        store.add(lines.filter(F.col("batch") == i))
    hot = store.all().filter(F.col("n") >= least_docs).select("key", "top")
    loses = lines.select("row", "doc_id", "key").distinct().join(hot, "key").filter(~F.col("doc_id").eqNullSafe(F.col("top")))
    mine, other, drop = fresh_names(docs, "id", "row", "drop")
    keys = loses.groupBy(F.col("doc_id").alias(mine), F.col("row").alias(other)).agg(F.collect_list("key").alias(drop))  # a document's own lines at most
    keys = cut(keys, "lines-lost")
    store.close()
    delete(spark, path)
    joined = docs.join(keys, F.col("doc_id").cast("long").eqNullSafe(F.col(mine)) & (row == F.col(other)), "left").drop(mine, other)
    names = [c for c in docs.columns if c != "text"]
    text = docs.schema["text"]
    added = [StructField("n_lines", LongType()), StructField("n_dropped", LongType()), StructField("kept_sha256", StringType()), StructField("text", text.dataType)]
    out = joined.mapInArrow(_drop_lines(least_chars, names, drop), added_schema(docs, *added, but=("text",)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], "n_lines", "n_dropped", "kept_sha256")


def _drop_lines(least: int, names: list[str], drop_name: str):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            n_lines, dropped, shas, texts = [], [], [], []
            for text, drop in zip(text_bytes(b.column("text")), b.column(drop_name).to_pylist()):
                lines = text.split(b"\n")
                kept = lines
                if drop:
                    gone = set(drop)
                    kept = [x for x in lines if len(x) < least or line_key(x, least) not in gone]
                    text = b"\n".join(kept)
                n_lines.append(len(lines))
                dropped.append(len(lines) - len(kept))
                shas.append(hashlib.sha256(text).hexdigest())
                texts.append(text)
            added = [pa.array(n_lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(shas), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *added], names=[*names, "n_lines", "n_dropped", "kept_sha256", "text"])

    return run

"""Exact deduplication through an extendible-hash index on shared files.

The key of a text is a 64-bit hash. A directory of 2**depth slots maps the leading bits of a key to a bucket; a bucket
that holds more than ``capacity`` distinct keys is split, doubling the directory where its own depth is the global
one. Neighbouring buckets form key ranges of about as many keys each; the owner task of a range takes all its entries,
chains the texts that share a key, and compares their bytes. The buckets are written to shared files by key range, so
that an executor's loss only repeats the tasks it ran, and a later batch is looked up in them: the directory names
bucket and range of a key, and the bytes of the texts found there are compared.

Copies collapse before the shuffle: each task sends one entry per distinct text of a batch, so a text that a third
of all rows hold reaches its owner as a few entries a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import batches, cut, drop_cut, fresh_names, text_bytes

ENTRY = pa.schema([("key", pa.int64()), ("text", pa.binary()), ("n", pa.int64()), ("top", pa.int64())])
ENTRY_DDL = "key long, text binary, n long, top long"
OWNED = pa.schema([("key", pa.int64()), ("link", pa.int32()), ("text_sha256", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("text", pa.binary())])
OWNED_DDL = "key long, link int, text_sha256 string, keep_id long, group_size long, text binary"
#: Buckets of a key range, on average.
RANGE_BUCKETS = 4


@dataclass(frozen=True)
class Directory:
    """Extendible-hash directory: ``slots[leading bits]`` is the number of a bucket, ``owner[leading bits]`` its key range."""

    depth: int
    slots: tuple[int, ...]
    local_depth: tuple[int, ...]
    owner: tuple[int, ...]

    @classmethod
    def build(cls, histogram: dict[int, int], bits: int, capacity: int) -> Directory:
        """Splits from a single bucket until none is overfull or ``bits`` leading bits are used.

        ``histogram`` has the distinct keys by their ``bits`` leading bits.
        """
        total = [0] * (2**bits + 1)
        for k, n in histogram.items():
            total[k + 1] = n
        for i in range(1, len(total)):
            total[i] += total[i - 1]
        depth, slots, local = 0, [0], [0]
        overfull = [(0, 0)] if total[-1] > capacity else []  # (prefix, local depth)
        while overfull:
            prefix, d = overfull.pop()
            if d == bits:
                continue  # longer chains take the rest
            if d == depth:
                slots = [s for s in slots for _ in (0, 1)]
                depth += 1
            old, new = slots[prefix << (depth - d)], len(local)
            local[old] = d + 1
            local.append(d + 1)
            width = 1 << (depth - d - 1)
            first = ((prefix << 1) | 1) << (depth - d - 1)
            slots[first : first + width] = [new] * width
            for half in (prefix << 1, (prefix << 1) | 1):
                step = 1 << (bits - d - 1)
                if total[(half + 1) * step] - total[half * step] > capacity:
                    overfull.append((half, d + 1))
        # key ranges: whole buckets in the order of their keys, until a range has its share of the keys
        owner, share, held, width = [0], max(1, RANGE_BUCKETS * capacity), 0, 1 << (bits - depth)
        for i, bucket in enumerate(slots):
            full = held >= share and i and bucket != slots[i - 1]
            owner.append(owner[-1] + bool(full))
            held = (0 if full else held) + total[(i + 1) * width] - total[i * width]
        return cls(depth, tuple(slots), tuple(local), tuple(owner[1:]))

    def _at(self, numbers: tuple[int, ...], key: Column) -> Column:
        if self.depth == 0:
            return F.lit(0)
        text = ",".join(map(str, numbers))  # 2**bits numbers at most
        return F.element_at(F.split(F.lit(text), ",").cast("array<int>"), F.shiftrightunsigned(key, 64 - self.depth).cast("int") + 1)

    def bucket_of(self, key: Column) -> Column:
        return self._at(self.slots, key)

    def owner_of(self, key: Column) -> Column:
        return self._at(self.owner, key)


def _combine(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One entry for each distinct text of a batch."""

    def entries():
        for b in rows:
            found: dict[bytes, list] = {}
            for key, text, doc in zip(b.column("key").to_pylist(), text_bytes(b.column("text")), b.column("doc_id").to_pylist()):
                if (x := found.get(text)) is None:
                    found[text] = [key, 1, doc]
                else:
                    x[1] += 1
                    x[2] = doc if x[2] is None else x[2] if doc is None else max(x[2], doc)
            for text, (key, n, top) in found.items():
                yield key, text, n, top

    return batches(entries(), ENTRY, 1024)


def _own(rows: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    """Entries sorted by key: the texts of a key are chained, each compared by its bytes with the links so far."""

    def links():
        at, chain = None, []
        for b in rows:
            for key, text, n, top in zip(b.column("key").to_pylist(), text_bytes(b.column("text")), b.column("n").to_pylist(), b.column("top").to_pylist()):
                if key != at:
                    yield from finish(at, chain)
                    at, chain = key, []
                for link in chain:
                    if link[0] == text:
                        link[1] += n
                        link[2] = top if link[2] is None else link[2] if top is None else max(link[2], top)
                        break
                else:
                    chain.append([text, n, top])
        yield from finish(at, chain)

    def finish(key, chain):
        for i, (text, n, top) in enumerate(sorted(chain, key=lambda x: x[0])):
            yield key, i, hashlib.sha256(text).hexdigest(), top, n, text if with_text else None

    return batches(links(), OWNED, 1024)


def build_index(docs: DataFrame, capacity: int = 512, bits: int = 16, key_of: Callable[[Column], Column] = F.xxhash64, with_text: bool = True) -> tuple[Directory, DataFrame]:
    """The directory, and the written index: owner, bucket, key, link, text_sha256, keep_id, group_size, text; one row a text.

    The directory has ``2**bits`` slots at most. With more distinct keys than they can hold at ``capacity``, buckets hold
    proportionally more, so none stays overfull. ``key_of`` gives a text's 64-bit key; keys may collide.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    keyed = keyed.withColumn("key", key_of(F.col("text")).cast("long"))
    lead = F.shiftrightunsigned("key", 64 - bits).cast("int")
    counts = keyed.select("key").distinct().groupBy(lead.alias("lead")).agg(F.count(F.lit(1)).alias("n"))
    histogram = {r.lead: r.n for r in counts.collect()}  # 2**bits rows at most
    capacity = max(capacity, 4 * sum(histogram.values()) // 2**bits)
    directory = Directory.build(histogram, bits, capacity)
    placed = keyed.mapInArrow(_combine, ENTRY_DDL).withColumn("owner", directory.owner_of(F.col("key")))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    owned = placed.repartition(n, "owner").sortWithinPartitions("key").select("key", "text", "n", "top").mapInArrow(lambda rows: _own(rows, with_text), OWNED_DDL)
    return directory, cut(owned.withColumns({"owner": directory.owner_of(F.col("key")), "bucket": directory.bucket_of(F.col("key"))}), "exact-index")


def exact_dedup(docs: DataFrame, capacity: int = 512, bits: int = 16, key_of: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """Adds ``text_sha256, keep_id, group_size, kept`` to each row.

    Texts are equal when their bytes are. A null text counts as empty. Of equal texts the row with the largest doc_id
    stays; a null doc_id is the smallest, and among rows that repeat the largest doc_id all are kept. Columns of
    ``docs`` with the added names are replaced. No rows give no rows.
    """
    added = ["text_sha256", "keep_id", "group_size", "kept"]
    docs = docs.drop(*added)
    key, sha = fresh_names(docs, "key", "sha")
    _, index = build_index(docs, capacity, bits, key_of, with_text=False)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.withColumn(key, key_of(text).cast("long")).withColumn("text_sha256", F.sha2(text.cast("binary"), 256))
    several = cut(index.filter("group_size > 1").select(F.col("key").alias(key), "text_sha256", "keep_id", "group_size"), "exact-groups")
    drop_cut(index)
    joined = rows.join(several, [key, "text_sha256"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id").cast("long")).otherwise(F.col("keep_id"))
    return joined.select(
        *[joined[f"`{c}`"] for c in docs.columns],
        "text_sha256",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("doc_id").cast("long")).alias("kept"),
    )


def look_up(directory: Directory, index: DataFrame, docs: DataFrame, key_of: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """Rows of another batch with ``indexed``: whether the index, built with texts and the same ``key_of``, holds their text.

    The directory gives a row's key range and bucket; the texts chained under its key there are compared byte by byte.
    """
    docs = docs.drop("indexed")
    owner, bucket, key, text = fresh_names(docs, "owner", "bucket", "key", "text")
    held = index.select(F.col("owner").alias(owner), F.col("bucket").alias(bucket), F.col("key").alias(key), F.col("text").alias(text), F.lit(True).alias("indexed"))
    rows = docs.withColumn(key, key_of(F.coalesce(F.col("text"), F.lit(""))).cast("long"))
    rows = rows.withColumns({owner: directory.owner_of(F.col(key)), bucket: directory.bucket_of(F.col(key))})
    same = F.coalesce(rows["text"], F.lit("")).cast("binary") == held[text]
    on = [rows[c] == held[c] for c in (owner, bucket, key)]
    joined = rows.join(held, on[0] & on[1] & on[2] & same, "left")
    return joined.select(*[rows[f"`{c}`"] for c in docs.columns], F.coalesce(held["indexed"], F.lit(False)).alias("indexed"))

"""Similarity join on sets of word n-grams: rare-first prefix filtering, each pair verified once.

Three steps get each document's shingles in rare-first order without a row per shingle:

1. Chunks of documents are hashed. A chunk's shingles, sorted by hash, go to the parts of the hash space as packed
   arrays. A shingle that several documents of a chunk hold goes as one entry with a count, however many there are.
2. A part adds up document frequencies and answers each chunk with those of two or more. What only one document
   holds cannot intersect with anything, so it is counted but never sent again.
3. A chunk puts its documents' shared shingles in order of (frequency, hash). The prefix of a set of n begins with its
   unshared ones; if these fill it, the document has no partner and leaves the join.

Equal sets collapse to one node. Nodes join on prefix shingles: the smaller set's index prefix with the larger one's probe
prefix, under the length filter, the positional filter and the suffix filter (images of the sets in 512 bits bound their
difference from below). A pair that survives is deduplicated, and its sets are intersected once.

A large group of near copies would make all its pairs once for each token they share. So blocks first link their nodes
to a leader; after connecting those, only pairs across components are joined. Components come out the same as from
all pairs.

No link leaves a component. So the links are then counted within components alone: the nodes of each are salted into
slots of a bounded size, and each pair of slots compares its sets once, by a product of 0/1 matrices.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import bucketed_cut, cut, drop_cut, fresh_names, give_back, shuffles_released, text_bytes
from quayside.llm.components import components

MIX = np.uint64(0x9E3779B97F4A7C15)
CHUNK_SHINGLES = 1_000_000
PART_SHINGLES = 1_000_000
#: 64-bit words of the images of sets in the suffix filter; each shared shingle sets a bit.
IMAGE = 8
#: Nodes and shingles of a slot, and shingles of a matrix, where links are counted.
SLOT_NODES = 512
SLOT_WEIGHT = 500_000
SLOT_SHINGLES = 4096
CELL = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())])
CELL_DDL = "part int, chunk long, kind int, blob binary"
NODE = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_shingles", pa.int64()), ("sig", pa.binary()), ("unshared", pa.int64()), ("shared", pa.list_(pa.int64())), ("image", pa.list_(pa.int64()))])
NODE_DDL = "doc_id long, key long, n_shingles long, sig binary, unshared long, shared array<long>, image array<long>"


class WordHashes(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_hashes(text: bytes, words: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; with fewer words the whole sequence is one, without any there is none."""
    tokens = text.lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    n = min(words, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        h = (h ^ w[i : len(w) - n + 1 + i]) * MIX
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.unique(h)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes, which compress where leading bytes repeat."""
    head = np.array([len(arrays), *(x for a in arrays for x in (len(a), a.itemsize))], "<u4").tobytes()
    return head + b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes() for a in arrays)


def _unpack(blob: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, "<u4", 1)[0])
    sizes, at, out = np.frombuffer(blob, "<u4", 2 * n, 4).reshape(n, 2).tolist(), 4 + 8 * n, []
    for length, width in sizes:
        planes = np.frombuffer(blob, np.uint8, length * width, at).reshape(width, length)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(-1))
        at += length * width
    return out


def _part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _row(part: int, chunk: int, kind: int, blob: bytes) -> tuple:
    return part, chunk, kind, blob


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _send(words: int, parts: int):
    """Step 1: documents to packed cells by part; kind 0 is the chunk's own record, kind 1 its shingles."""

    def flush(docs: list, seq: int) -> Iterator[pa.RecordBatch]:
        n = np.array([len(s) for _, _, s, _ in docs], np.uint32)
        sigs = b"".join(g for *_, g in docs)
        h = np.concatenate([s for _, _, s, _ in docs])
        ref = np.repeat(np.arange(len(docs), dtype=np.uint32), n)
        order = np.argsort(h, kind="stable")
        h, ref = h[order], ref[order]
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        starts = np.flatnonzero(first)
        counts = np.diff(np.append(starts, len(h)))
        single = counts == 1
        h1, r1 = h[starts[single]], ref[starts[single]]
        hm, cm = h[starts[~single]], counts[~single].astype(np.uint32)
        many = np.repeat(~single, counts)
        known = np.array([-1 if d is None else d for d, *_ in docs], np.int64).view(np.uint64)
        keys = np.array([k for _, k, *_ in docs], np.int64).view(np.uint64)
        null = np.array([d is None for d, *_ in docs], np.uint8)
        pid = TaskContext.get().partitionId() if TaskContext.get() else 0
        # the id also depends on what is in the chunk: rows dealt otherwise in a repeated task can't be mixed up
        chunk = xxhash.xxh3_64_intdigest(sigs + known.tobytes(), pid << 20 | seq) >> 1
        own = _pack(known, keys, null, n, np.frombuffer(sigs, np.uint64), h[many], ref[many])
        rows = [_row(chunk % parts, chunk, 0, own)]
        edges1 = np.searchsorted(_part_of(h1, parts), np.arange(parts + 1))
        edgesm = np.searchsorted(_part_of(hm, parts), np.arange(parts + 1))
        narrow = np.uint16 if len(docs) < 65536 else np.uint32
        r1 = r1.astype(narrow)
        held = (np.diff(edges1) > 0) | (np.diff(edgesm) > 0)
        for p in np.flatnonzero(held).tolist():  # no more cells than shingles, however many parts there are
            a, b, c, d = edges1[p], edges1[p + 1], edgesm[p], edgesm[p + 1]
            rows.append(_row(p, chunk, 1, _pack(h1[a:b], r1[a:b], hm[c:d], cm[c:d])))
            if len(rows) >= 256:
                yield _rows(rows, CELL)
                rows = []
        if rows:
            yield _rows(rows, CELL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, docs, size, seq = WordHashes(), [], 0, 0
        for b in batches:
            for doc, key, text in zip(b.column("doc_id").to_pylist(), b.column("key").to_pylist(), text_bytes(b.column("text"))):
                s = shingle_hashes(text, words, known)
                docs.append((doc, key, s, xxhash.xxh3_128_digest(s.tobytes())))
                size += len(s)
                if size >= CHUNK_SHINGLES or len(docs) >= 60_000:
                    yield from flush(docs, seq)
                    docs, size, seq = [], 0, seq + 1
        if docs:
            yield from flush(docs, seq)
        known, docs = {}, []
        give_back()

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2: rows come sorted by part; each part answers its chunks with the shingles of two documents or more."""

    def answer(part: int, cells: list) -> Iterator[pa.RecordBatch]:
        found = [_unpack(blob) for _, blob in cells]
        h = np.concatenate([x for f in found for x in (f[0], f[2])])
        weight = np.concatenate([x for f in found for x in (np.ones(len(f[0]), np.uint32), f[3])])
        order = np.argsort(h, kind="stable")
        s = h[order]
        first = np.ones(len(s), bool)
        first[1:] = s[1:] != s[:-1]
        starts = np.flatnonzero(first)
        total = np.add.reduceat(weight[order].astype(np.int64), starts) if len(s) else np.empty(0, np.int64)
        df = np.empty(len(h), np.uint32)
        df[order] = np.repeat(total, np.diff(np.append(starts, len(s)))).astype(np.uint32)
        at, rows = 0, []
        for (chunk, _), (h1, r1, hm, _) in zip(cells, found):
            d1, dm = df[at : at + len(h1)], df[at + len(h1) : at + len(h1) + len(hm)]
            at += len(h1) + len(hm)
            more = d1 > 1
            if more.any() or len(hm):
                rows.append(_row(part, chunk, 1, _pack(h1[more], r1[more], d1[more], hm, dm)))
        if rows:
            yield _rows(rows, CELL)

    at, cells = None, []
    for b in batches:
        for part, chunk, kind, blob in zip(*(b.column(c).to_pylist() for c in ("part", "chunk", "kind", "blob"))):
            if kind == 0:
                yield _rows([_row(part, chunk, 0, blob)], CELL)
                continue
            if part != at and cells:
                yield from answer(at, cells)
                cells = []
            at = part
            cells.append((chunk, blob))
    if cells:
        yield from answer(at, cells)
    cells = []
    give_back()


def prefix_sizes(n: int, percent: int) -> tuple[int, int]:
    """Probe and index prefix of a set of n: n - ceil(t n) + 1, and n - ceil(2 t / (1 + t) n) + 1."""
    return n - -(-percent * n // 100) + 1, n - -(-2 * percent * n // (100 + percent)) + 1


def _order(percent: int):
    """Step 3: rows come sorted by (chunk, kind): documents with their shared shingles, rare ones first."""

    def finish(chunk: int, own: list | None, answers: list) -> Iterator[pa.RecordBatch]:
        if own is None:
            raise RuntimeError("a chunk was dealt otherwise in a repeated task: write the input table first")
        known, keys, null, n, sigs, hm, rm = own
        h, ref, df = [], [], []
        for h1, r1, d1, hs, ds in answers:
            h.append(h1)
            ref.append(r1.astype(np.uint32))
            df.append(d1)
            if len(hs):
                a, b = np.searchsorted(hm, hs, "left"), np.searchsorted(hm, hs, "right")
                k = b - a
                take = np.repeat(a - np.append(0, np.cumsum(k)[:-1]), k) + np.arange(k.sum())
                h.append(hm[take])
                ref.append(rm[take])
                df.append(np.repeat(ds, k))
        h = np.concatenate(h) if h else np.empty(0, np.uint64)
        ref = np.concatenate(ref) if ref else np.empty(0, np.uint32)
        df = np.concatenate(df) if df else np.empty(0, np.uint32)
        order = np.lexsort((h, df, ref))
        h, ref = h[order].view(np.int64), ref[order]
        edges = np.searchsorted(ref, np.arange(len(n) + 1))
        bits = np.zeros((len(n), 64 * IMAGE), bool)
        bits[ref, h.view(np.uint64) % np.uint64(64 * IMAGE)] = True
        images = np.packbits(bits, axis=1).view(np.int64)
        sig = sigs.tobytes()
        rows = []
        for i in range(len(n)):
            size, m = int(n[i]), int(edges[i + 1] - edges[i])
            probes = size > 0 and size - m < prefix_sizes(size, percent)[0]
            doc, key = (int(x[i : i + 1].view(np.int64)[0]) for x in (known, keys))
            rows.append((None if null[i] else doc, key, size, sig[16 * i : 16 * i + 16], size - m, h[edges[i] : edges[i + 1]] if probes else None, images[i] if probes else None))
            if len(rows) >= 2048:
                yield _rows(rows, NODE)
                rows = []
        if rows:
            yield _rows(rows, NODE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, answers = None, None, []
        for b in batches:
            for chunk, kind, cell in zip(b.column("chunk").to_pylist(), b.column("kind").to_pylist(), b.column("blob")):
                blob = cell.as_buffer()
                if chunk != at:
                    if at is not None:
                        yield from finish(at, own, answers)
                    at, own, answers = chunk, None, []
                if kind == 0:
                    own = _unpack(blob)
                else:
                    answers.append(_unpack(blob))
        if at is not None:
            yield from finish(at, own, answers)
        own, answers = None, []
        give_back()

    return run


def ordered_sets(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """Written, one row a document: doc_id, key (of its text), n_shingles, sig, unshared; ``shared`` (rare first) and ``image`` unless its prefix is unshared."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), "text")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = n * max(1, math.ceil(chars / 6 / PART_SHINGLES / n))
    cells = rows.mapInArrow(_send(words, parts), CELL_DDL)
    counted = cells.repartitionById(n, F.col("part") % n).sortWithinPartitions("part").mapInArrow(_count, CELL_DDL)
    counted = cut(counted, "shingle-counts")  # the cells, the largest shuffle, need not outlast this
    back = counted.repartition(n, "chunk").sortWithinPartitions("chunk", "kind").select("chunk", "kind", "blob")
    out = cut(back.mapInArrow(_order(percent), NODE_DDL), "shingle-sets")
    drop_cut(counted)
    return out


def text_key() -> Column:
    """Tells rows that repeat a doc_id apart."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _can_link(x: dict[str, Column], y: dict[str, Column], percent: int) -> Column:
    """Length, positional and suffix filter of two prefix rows; each only drops pairs that can't link, or meet on an earlier token too."""
    total = x["n"] + y["n"]
    lengths = 100 * F.least(x["n"], y["n"]) >= percent * F.greatest(x["n"], y["n"])
    positions = (100 + percent) * F.least(x["n"] - x["pos"], y["n"] - y["pos"]) >= percent * total  # 100 I >= percent (total - I)
    differ = x["unshared"] + y["unshared"]
    for i in range(IMAGE):
        differ = differ + F.bit_count(x["image"][i].bitwiseXOR(y["image"][i]))
    return lengths & positions & ((100 + percent) * differ <= (100 - percent) * total)


def _verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Links among (a, b), by the intersection of both sets."""
    side = lambda s: nodes.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("shared").alias(f"s{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.filter((100 + percent) * F.size(F.array_intersect("sa", "sb")) >= percent * (F.col("na") + F.col("nb"))).select("a", "b")


def set_classes(sets: DataFrame) -> DataFrame:
    """Written, one row a class of equal sets that takes part: node, n, unshared, copies (its rows), shared, image; bucketed by node, so that no join moves the sets."""
    groups = sets.filter("shared is not null").groupBy(F.col("sig").alias("node"))
    one = lambda c: F.first(c).alias(c)  # noqa: E731  equal in the class
    return bucketed_cut(groups.agg(F.first("n_shingles").alias("n"), one("unshared"), F.count(F.lit(1)).alias("copies"), one("shared"), one("image")), "shingle-nodes", "node")


def _prefixes(nodes: DataFrame, percent: int) -> DataFrame:
    """Written, bucketed by token: token, node, n, unshared, image, pos, indexed, for the prefix tokens on which some pair can meet."""
    n = F.col("n")
    probe = n - F.ceil(percent * n / 100) + 1
    index = n - F.ceil(2 * percent * n / (100 + percent)) + 1
    rows = nodes.select("node", "n", "unshared", probe.cast("int").alias("probe"), index.cast("int").alias("index"), "shared", "image")
    own = F.slice("shared", F.lit(1), F.greatest(F.lit(0), F.least(F.size("shared"), F.col("probe") - F.col("unshared")).cast("int")))
    rows = rows.select("node", "n", "unshared", "index", "image", F.posexplode(own).alias("k", "token"))
    pos = F.col("unshared") + F.col("k")
    rows = rows.select("token", "node", "n", "unshared", "image", pos.alias("pos"), (pos < F.col("index")).alias("indexed"))
    block = rows.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.max("indexed").alias("any"))
    return bucketed_cut(rows.join(block.filter("size > 1 and any").select("token"), "token"), "shingle-prefixes", "token")


def similar_components(nodes: DataFrame, percent: int = 75, leader_rounds: int = 3) -> DataFrame:
    """Written, (sig, root): the classes that link with others, with their component's smallest class.

    ``leader_rounds`` only bounds the shortcut: the pairs across components that are left are all joined.
    """
    prefix = _prefixes(nodes, percent)
    fields = ["node", "n", "unshared", "image", "pos", "root"]
    links, tried, done = [], [], []
    rows, labels = prefix.withColumn("root", F.col("node")), None
    for k in range(leader_rounds + 1):
        # pairs across components that the rest of the join would meet; a root counts within its token
        by_root = rows.groupBy("token", "root").agg(F.count(F.lit(1)).alias("c"))
        by_token = by_root.groupBy("token").agg(F.sum("c").alias("c"), ((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("cross"))
        many = by_token.agg(F.sum("c"), F.sum("cross")).first()
        if k == leader_rounds or (many[1] or 0) <= 4 * (many[0] or 0):
            break
        # 4**k families of leaders: blocks of a family that have the same nodes have the same leader
        rank = F.xxhash64("node", F.pmod("token", F.lit(4**k)), F.lit(k))
        leaders = rows.groupBy("token").agg(F.min_by(F.struct(*fields), F.struct(rank, "node")).alias("lead"))
        fits = _can_link({c: F.col(c) for c in fields}, {c: F.col(f"lead.{c}") for c in fields}, percent)
        pairs = rows.join(leaders, "token").filter((F.col("root") != F.col("lead.root")) & fits)
        pairs = pairs.select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b")).distinct()
        for old in tried:
            pairs = pairs.join(old, ["a", "b"], "left_anti")
        tried.append(cut(pairs, "shingle-pairs"))
        links.append(cut(_verified(tried[-1], nodes, percent), "shingle-links"))
        labels = written_components(_all(links), labels)
        done.append(rows)
        # blocks that still hold several components; images move for these alone
        rooted = lambda df: df.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))  # noqa: B023, E731  used at once
        open_ = rooted(prefix.select("token", "node")).groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("token")
        rows = cut(rooted(prefix.join(open_, "token")), "shingle-open")
        if k:
            drop_cut(done[-1])
    x, y = rows.filter("indexed").select("token", F.struct(*fields).alias("x")), rows.select("token", F.struct(*fields).alias("y"))
    ahead = (F.col("x.root") != F.col("y.root")) & (F.struct("x.n", "x.node") < F.struct("y.n", "y.node"))
    cross = x.join(y, "token").filter(ahead & _can_link({c: F.col(f"x.{c}") for c in fields}, {c: F.col(f"y.{c}") for c in fields}, percent))
    pairs = cross.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    for old in tried:
        pairs = pairs.join(old, ["a", "b"], "left_anti")
    pairs = cut(pairs, "shingle-pairs")
    if done:
        drop_cut(rows)
    drop_cut(prefix)
    last = cut(_verified(pairs, nodes, percent), "shingle-links")
    if labels is None or not last.isEmpty():
        labels = written_components(_all([*links, last]), labels)
    for old in (*tried, *links, pairs, last):
        drop_cut(old)
    return labels.select(F.col("node").alias("sig"), "root")


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def written_components(links: DataFrame, before: DataFrame | None) -> DataFrame:
    """Written (node, root) of all ``links``; ``before``, of fewer links, is deleted."""
    labels = cut(components(links), "shingle-roots")
    if before is not None:
        drop_cut(before)
    return labels


def _intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many shingles each of the sets ``a`` has in common with each of ``b``."""
    own = [(np.concatenate(x), np.repeat(np.arange(len(x)), [len(t) for t in x])) for x in (a, b)]
    common = np.intersect1d(own[0][0], own[1][0])
    out = np.zeros((len(a), len(b)), np.float32)
    if not len(common):
        return out
    sides = []
    for tokens, owner in own:
        at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
        found = common[at] == tokens
        at, owner = at[found], owner[found]
        order = np.argsort(at, kind="stable")
        sides.append((at[order], owner[order]))
    for k in range(0, len(common), SLOT_SHINGLES):
        parts = []
        for (at, owner), n in zip(sides, (len(a), len(b))):
            lo, hi = np.searchsorted(at, (k, k + SLOT_SHINGLES))
            m = np.zeros((n, SLOT_SHINGLES), np.float32)
            m[owner[lo:hi], at[lo:hi] - k] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


SLOTTED = pa.schema([("node", pa.binary()), ("links", pa.int64())])


def _slot_links(percent: int):
    """Rows sorted by (root, i, j): for each pair of slots, each node's links with rows of the other slot, or with other nodes of the same one."""

    def compared(i: int, j: int, rows: list[tuple]) -> pa.RecordBatch:
        slot, nodes, n, copies, sets = zip(*rows)
        slot, n, copies = np.array(slot), np.array(n, np.int64), np.array(copies, np.int64)
        same = i == j
        x = np.flatnonzero(slot == i)
        y = x if same else np.flatnonzero(slot == j)
        links = np.zeros(len(n), np.int64)
        if len(x) and len(y):
            both = _intersections([sets[k] for k in x], [sets[k] for k in y]).astype(np.int64)
            hit = (100 + percent) * both >= percent * (n[x][:, None] + n[y][None, :])  # 100 I >= percent (nx + ny - I)
            if same:
                np.fill_diagonal(hit, False)
            links[x] = hit @ copies[y]
            if not same:
                links[y] = hit.T @ copies[x]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(links, pa.int64())], schema=SLOTTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for b in batches:
            flat = b.column("shared")
            bounds, values = flat.offsets.to_numpy(), flat.values.to_numpy()
            for k, row in enumerate(zip(*(b.column(c).to_pylist() for c in ("root", "i", "j", "slot", "node", "n", "copies")))):
                if row[:3] != at:
                    if rows:
                        yield compared(at[1], at[2], rows)
                    at, rows = row[:3], []
                rows.append((*row[3:], values[bounds[k] : bounds[k + 1]].copy()))
        if rows:
            yield compared(at[1], at[2], rows)

    return run


def class_links(nodes: DataFrame, roots: DataFrame, percent: int = 75) -> DataFrame:
    """(sig, links) of the nodes of ``roots``: the rows of other classes that each links with, every pair compared once."""
    own = nodes.join(roots, nodes["node"] == roots["sig"]).select("root", "node", "n", "copies", "shared")
    slots = F.greatest(F.ceil(F.count(F.lit(1)) / SLOT_NODES), F.ceil(F.sum(F.size("shared")) / SLOT_WEIGHT)).cast("int")
    own = own.join(own.groupBy("root").agg(slots.alias("slots")), "root")
    own = own.withColumn("slot", F.pmod(F.xxhash64("node"), F.col("slots")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
    dealt = own.select("root", F.least("slot", "other").alias("i"), F.greatest("slot", "other").alias("j"), "slot", "node", "n", "copies", "shared")
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = dealt.repartition(n, "root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(_slot_links(percent), "node binary, links long")
    return found.groupBy(F.col("node").alias("sig")).agg(F.sum("links").alias("links"))


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """Written, one row a document: doc_id, key, n_shingles, component_id, sig; see ``jaccard_links``, whose counts are left out.

    ``key`` is of the text, ``sig`` of the set's component (null for a document that can have no partner).
    """
    with shuffles_released(docs.sparkSession):
        sets = ordered_sets(docs, words, percent)
        nodes = set_classes(sets)
        roots = similar_components(nodes, percent)
        out = cut(_all(_by_document(sets, roots)).select("doc_id", "key", "n_shingles", "component_id", F.col("root").alias("sig")), "shingle-components")
        for old in (sets, nodes, roots):
            drop_cut(old)
    return out


def jaccard_links(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """Written, one row a document: doc_id, n_shingles, component_id, n_links (the other rows that it links with).

    Words are what ASCII white space separates, with A-Z lower-cased. Two documents link when
    ``100 * intersection >= percent * union`` of their distinct word n-grams; fewer words are one shingle. Null and
    empty texts have no shingles and link with nothing. ``component_id`` is the smallest doc_id reachable by links; a
    null doc_id takes part but is never the smallest. Repeated rows are equal sets, one component. Other columns are
    left out. No rows give no rows.
    """
    with shuffles_released(docs.sparkSession):
        sets = ordered_sets(docs, words, percent)
        nodes = set_classes(sets)
        roots = similar_components(nodes, percent)
        counts = nodes.select(F.col("node").alias("sig"), "copies").join(class_links(nodes, roots, percent), "sig", "left")
        counts = counts.select("sig", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
        alone, linked = _by_document(sets, roots)  # those without a partner don't all meet under one null
        rows = alone.withColumn("n_links", F.lit(0).cast("long")).unionByName(linked.join(counts, "sig", "left"))
        out = cut(rows.select("doc_id", "n_shingles", "component_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "shingle-links")
        for old in (sets, nodes, roots):
            drop_cut(old)
    return out


def _by_document(sets: DataFrame, roots: DataFrame) -> list[DataFrame]:
    """One row a document: doc_id, key, n_shingles, component_id, sig, root; first those that can have no partner (null sig and root), then the others."""
    members = sets.filter("shared is not null").groupBy("sig").agg(F.min("doc_id").alias("least"))
    rooted = members.join(roots, "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    by_sig = rooted.join(least, "root").select("sig", "root", "component")
    rows = sets.select("doc_id", "key", "n_shingles", F.when(F.col("shared").isNotNull(), F.col("sig")).alias("sig"))
    alone = rows.filter("sig is null").select("doc_id", "key", "n_shingles", F.col("doc_id").alias("component_id"), "sig", F.col("sig").alias("root"))
    linked = rows.filter("sig is not null").join(by_sig, "sig")
    return [alone, linked.select("doc_id", "key", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), "sig", "root")]


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """One row of each component stays: the one with the smallest doc_id (a null id is the largest), then the smallest text hash.

    Rows without shingles link with nothing and all stay. Of equal rows, which have equal ids and texts, one stays.
    """
    found = jaccard_components(docs, words, percent)
    linked = found.filter("sig is not null")
    first = linked.groupBy("sig").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "key")).alias("row"), F.count(F.lit(1)).alias("rows"))
    keep = found.filter("sig is null").select("doc_id", "key").unionByName(first.select("row.doc_id", "row.key")).distinct()
    mine, other = fresh_names(docs, "id", "key")
    keep = keep.select(F.col("doc_id").alias(mine), F.col("key").alias(other))
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(mine)) & (text_key() == F.col(other))
    kept = docs.join(keep, same, "left_semi")
    # rows with shingles whose id and text repeat are equal sets: only then is a look at the rows themselves needed
    repeats = linked.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if repeats.isEmpty():
        return kept
    again = repeats.select(F.col("doc_id").alias(mine), F.col("key").alias(other))
    return kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))

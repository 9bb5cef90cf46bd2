"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text.

Two dictionaries are built from labelled text: one of ordinary words, and one that continues it with the word stems that
toxic documents have and ordinary ones lack. A text is cut into windows of a few words, and each window is compressed
with either dictionary. Where the toxic dictionary saves bytes over the ordinary one, the window holds toxic material.
A logistic map of the largest saving, the mean of the three largest and the number of windows over a threshold, cut
where it tells the classes best, gives the score.

Windows of a few words are too short for zstandard's entropy coder: a match of a whole word costs about what its
literals cost. Each character is therefore written as a 4-byte code of its word up to that character; a match then
begins at a word's start, is as long as the shared stem, and costs a fraction of its bytes.

The dictionaries are raw content that is chosen by document counts, not by zstandard's own trainer (COVER): trained
apart for each class, on plain windows or on these codes, with copies taken out or only on what the ordinary
dictionary leaves over, its dictionaries found 45 to 75 % of held-out toxic documents (see the README).

Labelled texts never reach the driver: tasks count stems, which the driver selects from, and cross-fitted tasks give a
few numbers for each labelled document, on which the contrasts and the map are calibrated.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField

from quayside.llm.common import added_schema, batches, cut, drop_cut, text_bytes

#: At most so many code bytes in each half of a dictionary.
DICTIONARY_BYTES = 60_000
STEM_CHARS = (4, 5, 6, 7, 8)
#: Contrasts tried: how much more frequent a stem is in toxic documents, and in how many of them it is at least.
CONTRASTS = ((25.0, 2), (12.0, 5), (12.0, 8), (15.0, 16))
#: How many times a share of ordinary documents counts against one of toxic documents in the choice of the cut.
CLEAN = 4.0
#: Parts of the cross-fit.
PARTS = 3
#: Bytes saved from which on a window counts as toxic.
SAVED = 12


@dataclass(frozen=True)
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]
    saved: int
    window_words: int


def word_code(word: str) -> bytes:
    """4 bytes per character: a hash of the word up to it; a last code marks the word's end."""
    out, h = [], 0
    for ch in word:
        h = ((h ^ ord(ch)) * 0x01000193 + 0x9E3779B1) & 0xFFFFFFFF
        out.append(h)
    out.append(((h ^ 32) * 0x01000193 + 0x9E3779B1) & 0xFFFFFFFF)
    return np.array(out, "<u4").tobytes()


#: Runs of letters and digits, so that marks before or after a word change nothing.
_words_of = re.compile(r"[^\W_]+").findall


def _words(text: str) -> list[str]:
    return _words_of(text.lower())


def _compressor(content: bytes):
    params = zstandard.ZstdCompressionParameters(
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0,
        window_log=18, chain_log=17, hash_log=17, search_log=6, min_match=5, target_length=32, strategy=zstandard.STRATEGY_DFAST,
    )
    trained = zstandard.ZstdCompressionDict(content or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    trained.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=trained, compression_params=params).compress


class Scorer:
    """Compares window compression lengths; keeps the codes of words it has met, up to a bound."""

    def __init__(self, ordinary: bytes, toxic: bytes, window_words: int, saved: int, kept_words: int = 200_000):
        self.ordinary, self.toxic = _compressor(ordinary), _compressor(ordinary + toxic)
        self.window_words, self.saved, self.kept_words = window_words, saved, kept_words
        self.codes: dict[str, bytes] = {}

    def savings(self, text: str) -> list[int]:
        """Bytes that the toxic dictionary saves, by window."""
        codes, out, n = self.codes, [], self.window_words
        if len(codes) > self.kept_words:
            codes.clear()
        words = _words(text)
        for i in range(0, len(words), n):
            parts = []
            for w in words[i : i + n]:
                if (c := codes.get(w)) is None:
                    c = word_code(w)
                    if len(w) < 64:
                        codes[w] = c
                parts.append(c)
            window = b"".join(parts)
            out.append(len(self.ordinary(window)) - len(self.toxic(window)))
        return out

    def features(self, text: str) -> tuple[float, ...]:
        saved = self.savings(text)
        if not saved:
            return 1.0, 0.0, 0.0, 0.0, 0.0
        top = sorted(saved, reverse=True)[:3]
        over = sum(s >= self.saved for s in saved)
        return 1.0, max(0, top[0]) / 10, max(0, sum(top)) / 30, math.log1p(over), over / len(saved)


def _stems(text: str) -> set[str]:
    out = set()
    for w in set(_words(text)):
        w += " "
        out.update(w[:n] for n in STEM_CHARS if len(w) >= n)
    return out


def _part(doc_id) -> int:
    return zlib.crc32(f"part {doc_id}".encode()) % PARTS


def _marks(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The smallest hashes of a document's word pairs, by which copies and near copies are known."""

    def found():
        for b in rows:
            for row, text in zip(b.column("row").to_pylist(), text_bytes(b.column("text"))):
                words = _words(text.decode("utf-8", "replace"))
                for m in sorted({zlib.crc32(f"{x} {y}".encode()) for x, y in zip(words, words[1:])})[:3] or [-1 - zlib.crc32(text)]:
                    yield row, m

    return batches(found(), pa.schema([("row", pa.int64()), ("mark", pa.int64())]))


def _stem_counts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold a stem, by class and part."""

    def found():
        counts: Counter = Counter()
        for b in rows:
            for doc, y, text in zip(b.column("doc_id").to_pylist(), b.column("toxic").to_pylist(), text_bytes(b.column("text"))):
                k = y * PARTS + _part(doc)
                counts.update((w, k) for w in _stems(text.decode("utf-8", "replace")))
                if len(counts) > 400_000:
                    yield from ((w, k, n) for (w, k), n in counts.items())
                    counts.clear()
        yield from ((w, k, n) for (w, k), n in counts.items())

    return batches(found(), pa.schema([("stem", pa.string()), ("k", pa.int32()), ("n", pa.int64())]))


class StemCounts:
    """Documents by class and part, and for each stem that matters how many of them hold it."""

    def __init__(self, sizes: np.ndarray, stems: list[str], counts: np.ndarray):
        self.sizes, self.stems, self.counts = sizes, stems, counts

    def dictionaries(self, ratio: float, least: int, without: int | None = None) -> tuple[bytes, bytes]:
        """Content of the ordinary and of the toxic dictionary, ``without`` the documents of a part."""
        use = np.array([k % PARTS != without for k in range(2 * PARTS)])
        n0, n1 = (max(1, self.sizes[:PARTS][use[:PARTS]].sum()), max(1, self.sizes[PARTS:][use[PARTS:]].sum()))
        c0, c1 = self.counts[:, :PARTS][:, use[:PARTS]].sum(axis=1), self.counts[:, PARTS:][:, use[PARTS:]].sum(axis=1)
        contrast = (c1 / n1) / ((c0 + 0.5) / n0)
        least = least if without is None else max(2, round(least * (PARTS - 1) / PARTS))
        code = lambda w: word_code(w[:-1]) if w.endswith(" ") else word_code(w)[:-4]
        chosen = sorted((contrast[i], self.stems[i]) for i in np.flatnonzero((c1 >= least) & (contrast >= ratio)))
        common = sorted(((c0[i], self.stems[i]) for i in np.flatnonzero(c0 > 0) if self.stems[i].endswith(" ")), reverse=True)[:3000]
        return b"".join(code(w) for _, w in reversed(common))[-DICTIONARY_BYTES:], b"".join(code(w) for _, w in chosen)[-DICTIONARY_BYTES:]


def _counted(kept: DataFrame) -> StemCounts:
    """From documents (doc_id, toxic, text). The stems that reach the driver are those of enough toxic documents, and the most common words."""
    sizes = np.zeros(2 * PARTS)
    for r in kept.select("toxic", "doc_id").mapInArrow(_sizes, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        sizes[r.k] = r.n
    counts = kept.mapInArrow(_stem_counts, "stem string, k int, n long").groupBy("stem").agg(*[F.sum(F.when(F.col("k") == k, F.col("n")).otherwise(0)).alias(f"c{k}") for k in range(2 * PARTS)])
    c0, c1 = (F.expr("+".join(f"c{k}" for k in range(y * PARTS, (y + 1) * PARTS))) for y in (0, 1))
    counts = cut(counts.select("stem", *[f"c{k}" for k in range(2 * PARTS)], c0.alias("ordinary"), c1.alias("toxic")), "toxic-stems")
    # a contrast within the parts is at most that of all times the share that a part takes
    enough = (F.col("toxic") >= min(n for _, n in CONTRASTS)) & (F.col("toxic") / max(1.0, sizes[PARTS:].sum()) >= 0.5 * min(r for r, _ in CONTRASTS) * (F.col("ordinary") * 0.5 + 0.5) / max(1.0, sizes[:PARTS].sum()))
    common = counts.filter(F.col("stem").endswith(" ") & (F.col("ordinary") > 0)).orderBy(F.desc("ordinary"), "stem").limit(3500)
    rows = {r.stem: r for r in counts.filter(enough).collect()} | {r.stem: r for r in common.collect()}
    drop_cut(counts)
    return StemCounts(sizes, sorted(rows), np.array([[rows[w][f"c{k}"] for k in range(2 * PARTS)] for w in sorted(rows)], float).reshape(-1, 2 * PARTS))


def _sizes(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def found():
        for b in rows:
            yield from Counter(y * PARTS + _part(d) for d, y in zip(b.column("doc_id").to_pylist(), b.column("toxic").to_pylist())).items()

    return batches(found(), pa.schema([("k", pa.int32()), ("n", pa.int64())]))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _best_cut(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The largest sum of the shares told right in each class, the ordinary one counting ``CLEAN`` times, and the cut of ``z`` that gives it."""
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    right = CLEAN * np.append(0, np.cumsum(1 - y)) / (1 - y).sum() + np.append(y.sum(), y.sum() - np.cumsum(y)) / y.sum()  # below i: label 0
    edges = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    free = np.concatenate([[True], z[1:] > z[:-1], [True]])
    i = max(np.flatnonzero(free), key=lambda i: (round(right[i], 9), i))
    return float(right[i]), float(edges[i])


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_docs: int = 4000, window_words: int = 6) -> ToxicityModel:
    """Fits on at most ``max_docs`` documents a class, those of the smallest id hashes; the bound is this parameter.

    ``labels`` has doc_id and toxic; of contradicting rows the larger counts; null labels and ids don't. Of copies and
    near copies one counts. Each document is measured with dictionaries of the other parts; the contrast, the map and the
    cut are those that tell the classes best so, and the dictionaries are then built of all parts. Without both classes
    every score is the share of label 1 (0.5 without any label).
    """
    clean = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = None
    for y in (0, 1):
        own = clean.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
        chosen = own if chosen is None else chosen.unionByName(own)
    # 2 * max_docs short rows at most: a broadcast of proven size
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = cut(sample.select("doc_id", "toxic", "text", F.xxhash64("doc_id", "text").alias("row")).dropDuplicates(["doc_id", "row"]), "toxic-sample")
    marks = sample.select("row", "text").mapInArrow(_marks, "row long, mark long")
    copies = marks.join(marks.groupBy("mark").agg(F.min("row").alias("first")), "mark").filter("first < row").select("row").distinct()
    kept = cut(sample.join(copies, "row", "left_anti").select("doc_id", "toxic", "text"), "toxic-kept")
    counts = _counted(kept)
    n0, n1 = counts.sizes[:PARTS].sum(), counts.sizes[PARTS:].sum()
    if not n0 or not n1:
        drop_cut(sample)
        drop_cut(kept)
        rate = (n1 + 0.5) / (n0 + n1 + 1)
        return ToxicityModel(b"", b"", (math.log(rate / (1 - rate)), 0.0, 0.0, 0.0, 0.0), SAVED, window_words)

    parts = {(k, c): counts.dictionaries(*CONTRASTS[c], without=k) for k in range(PARTS) for c in range(len(CONTRASTS))}

    def measured(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers: dict[tuple[int, int], Scorer] = {}

        def found():
            for b in rows:
                for doc, y, text in zip(b.column("doc_id").to_pylist(), b.column("toxic").to_pylist(), text_bytes(b.column("text"))):
                    for c in range(len(CONTRASTS)):
                        at = _part(doc), c
                        if at not in scorers:
                            scorers[at] = Scorer(*parts[at], window_words, SAVED, 20_000)
                        yield c, y, doc, list(scorers[at].features(text.decode("utf-8", "replace")))

        return batches(found(), pa.schema([("c", pa.int32()), ("y", pa.int32()), ("doc_id", pa.string()), ("x", pa.list_(pa.float64()))]), 512)

    ids = kept.withColumn("doc_id", F.col("doc_id").cast("string"))
    found = sorted((r.c, r.doc_id, r.y, r.x) for r in ids.mapInArrow(measured, "c int, y int, doc_id string, x array<double>").collect())  # a few numbers a document
    best = None
    for c in range(len(CONTRASTS)):
        x, y = (np.array([r[i] for r in found if r[0] == c], float) for i in (3, 2))
        weights = _logistic(x, y)
        told, at = _best_cut(x @ weights, y)
        if best is None or told > best[0] + 1e-9:
            best = told, c, (weights[0] - at, *weights[1:])
    drop_cut(sample)
    drop_cut(kept)
    return ToxicityModel(*counts.dictionaries(*CONTRASTS[best[1]]), tuple(float(w) for w in best[2]), SAVED, window_words)


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (score >= 0.5) from the whole text.

    A null or empty text has no windows and gets the score of no finding. Columns of these names are replaced.
    """
    docs = docs.drop("score", "predicted")
    names = docs.columns

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.ordinary, model.toxic, model.window_words, model.saved)
        for b in rows:
            scores = []
            for text in text_bytes(b.column("text")):
                z = sum(w * f for w, f in zip(model.weights, scorer.features(text.decode("utf-8", "replace"))))
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=[*names, "score", "predicted"])

    return docs.mapInArrow(run, added_schema(docs, StructField("score", DoubleType()), StructField("predicted", IntegerType())))

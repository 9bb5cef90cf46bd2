"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

The most frequent words form classes of equal size; all others fall in rare classes by a hash of their ending. A token's
probability is P(class | context) times P(word | class, context) for frequent words, or times a smoothed unigram within
the rare class. Both softmaxes add weights of hashed features: bias, previous word, previous two words, and skips to the
second and third word back. Features of one context word tell all words apart; in pairs a rare word stands for its class.

Counts cover all training tokens and stay distributed; the ``known_words`` most frequent go to the executors, the
others are looked up by a join. Arrow splits the texts and finds the distinct tokens of about ``TEXT_BYTES`` at a time, and
only these are looked up in Python. Training is one pass of distributed gradient updates: each task makes AdaGrad steps
over its documents from zero, and the tasks' weights are averaged row by row, weighted by the tokens that used the row.
Scoring runs in sparse numpy batches. Classes, modelled words, rows of weights and trainers grow with the training
tokens (``sizes_for``).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import batches, cut, give_back

CLASS_WORDS = 64
BATCH_BITS = 13
BATCH = 1 << BATCH_BITS
CACHED = BATCH // 4  # tokens whose scores stay in a core's cache
BLOCK = 64  # rows of weights sent together
RATE = 0.3
FAR = 1 << 32  # identities of words beyond the known ones, and of the start, begin here
SPAN = 60  # weights of a token within +-SPAN need no shift: their exponentials and sums are normal float32
PART = 12  # rows of a sum added side by side with those of other sums
TEXT_BYTES = 1 << 20  # texts are split together up to this


@dataclass(frozen=True)
class Sizes:
    """Classes of frequent words, classes of rare words, rows of weights, tasks that train."""

    word_classes: int
    rare_classes: int
    rows: int
    trainers: int

    @property
    def top(self) -> int:
        return self.word_classes * CLASS_WORDS

    @property
    def classes(self) -> int:
        return self.word_classes + self.rare_classes

    @property
    def start(self) -> int:
        """Context before the first word."""
        return self.top + self.rare_classes


def sizes_for(tokens: int) -> Sizes:
    """Rows and trainers grow with the root of the tokens, so that what trainers send grows with the tokens; modelled
    words and their classes with the tenth root, as each token's cost grows with the classes. Rare classes stay 16."""
    g = 1 + tokens / (1 << 24)
    return Sizes(round(16 * g**0.1), 16, BLOCK * round(512 * g**0.5), round(8 * g**0.5))


@dataclass(frozen=True)
class Vocabulary:
    """Most frequent words by rank, with log10(count + 1), and each rare class's log10(tokens + words + 1)."""

    rank: dict[bytes, int]
    log_count: np.ndarray
    symbol: np.ndarray
    sizes: Sizes
    rare_total: np.ndarray
    tokens: int
    words: int


def rare_class(word: bytes, classes: int) -> int:
    return zlib.crc32(word[-3:]) % classes


def split_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The tokens of all texts as places among the distinct ones, each text's number of tokens, the distinct ones (binary).

    Tokens are lower-cased words and an end, which is empty. One blank behind a trimmed text splits off that end.
    """
    text = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.binary()), b"").view(pa.string())))
    found = pc.ascii_split_whitespace(pc.if_else(pc.equal(pc.binary_length(text), 0), text, pc.binary_join_element_wise(text, "", " ")))
    coded = found.flatten().dictionary_encode()
    return coded.indices.to_numpy(), np.diff(found.offsets.to_numpy()), coded.dictionary.cast(pa.binary())


def _slices(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in slices of about ``TEXT_BYTES`` of text, at least one row."""
    for b in rows:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            before = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, before + TEXT_BYTES, "right")))
            yield b.slice(at, end - at)
            at = end


def _summed(counts: list[pa.Table]) -> pa.Table:
    found = pa.concat_tables(counts).group_by("word", use_threads=False).aggregate([("n", "sum")])
    return found.select(["word", "n_sum"]).rename_columns(["word", "n"])


def count_tokens(docs: DataFrame) -> DataFrame:
    """Written: word (binary; the end is empty) and n, over all documents."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in _slices(rows):
            codes, _, words = split_texts(b.column("text"))
            held.append(pa.table([words, np.bincount(codes, minlength=len(words))], schema=schema))
            size += max(len(words), held[-1].nbytes // 32)  # long words count more
            if size > 1_000_000:
                held = [_summed(held)]
                size = max(held[0].num_rows, held[0].nbytes // 32)
                if size > 400_000:
                    yield from held[0].to_batches(20_000)
                    held, size = [], 0
        if held:
            yield from _summed(held).to_batches(20_000)
        held.clear()
        give_back()

    return cut(docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-counts")


def build_vocabulary(counts: DataFrame, known_words: int) -> Vocabulary:
    """At most ``known_words`` rows reach the driver: those of the highest count levels that fit, and a few sums."""
    level = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    left, least = known_words, 1 << 30
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("v")).collect(), key=lambda r: -r.level):  # 16 an octave
        if r.v > left:
            break
        left, least = left - r.v, r.level
    top = sorted(((bytes(r.word), r.n) for r in counts.filter(level >= least).collect()), key=lambda x: (-x[1], x[0]))
    total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    z = sizes_for(total.n or 0)
    ending: Column = F.substring("word", -3, 3)
    cls = F.pmod(F.crc32(F.when(F.length("word") <= 3, F.col("word")).otherwise(ending)), F.lit(z.rare_classes)).cast("int")
    sums = np.zeros(z.rare_classes)
    for r in counts.groupBy(cls.alias("c")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        sums[r.c] += r.n + r.v
    for word, n in top[: z.top]:
        sums[rare_class(word, z.rare_classes)] -= n + 1
    symbol = np.array([i if i < z.top else z.top + rare_class(w, z.rare_classes) for i, (w, _) in enumerate(top)], np.int64)
    return Vocabulary({w: i for i, (w, _) in enumerate(top)}, np.log10(np.array([n for _, n in top], float) + 1), symbol, z, np.log10(sums + 1), total.n or 0, total.v)


def _mix(rows: int, *parts: np.ndarray | int) -> np.ndarray:
    h = np.array([0x243F6A8885A308D3], np.uint64)  # arrays wrap around silently
    for p in parts:
        h = (h ^ np.asarray(p, np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h = h ^ (h >> np.uint64(31))
    return (((h >> np.uint64(32)) * np.uint64(rows - 1)) >> np.uint64(32)).astype(np.int64) + 1


def sums_by_row(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows in any order, the sums of their values and their numbers of values; at most ``BATCH`` rows.

    Most rows occur a few times and ``reduceat`` takes as long for each of them as for a long one. So a row's values are
    cut into parts of ``PART``, the k-th values of all parts are added at once, and ``reduceat`` adds what parts remain.
    """
    s = np.sort(rows << BATCH_BITS | np.arange(len(rows)))  # faster than a stable argsort
    order, s = s & (BATCH - 1), s >> BATCH_BITS
    starts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    found, used = s[starts], np.diff(starts, append=len(s))
    parts = -(-used // PART)
    first = np.cumsum(parts) - parts
    skipped = PART * (np.arange(first[-1] + parts[-1]) - np.repeat(first, parts))
    size = np.minimum(np.repeat(used, parts) - skipped, PART)
    by = np.argsort((-size).astype(np.int8), kind="stable")  # longest first
    begin = (np.repeat(starts, parts) + skipped)[by]
    longer = len(size) - np.cumsum(np.bincount(size, minlength=PART + 1))
    total = values.take(order.take(begin), axis=0)
    for k in range(1, PART):
        if not longer[k]:
            break
        total[: longer[k]] += values.take(order.take(begin[: longer[k]] + k), axis=0)
    if len(size) == len(starts):
        return found[by], total, used[by]
    place = np.empty_like(by)
    place[by] = np.arange(len(by))
    sums = total.take(place.take(first), axis=0)
    many = np.flatnonzero(parts > 1)
    n = parts[many]
    at = np.cumsum(n) - n
    sums[many] = np.add.reduceat(total.take(place.take(np.arange(n.sum()) + np.repeat(first[many] - at, n)), axis=0), at, axis=0)
    return found, sums, used


class Model:
    """Weights of classes and of words in a class; row 0 is the bias of the classes."""

    def __init__(self, sizes: Sizes, by_class: np.ndarray | None = None, by_word: np.ndarray | None = None):
        self.sizes = sizes
        self.by_class = np.zeros((sizes.rows, sizes.classes), np.float32) if by_class is None else by_class
        self.by_word = np.zeros((sizes.rows, CLASS_WORDS), np.float32) if by_word is None else by_word

    @staticmethod
    def contexts(symbols: np.ndarray, first: np.ndarray, start: int) -> tuple[np.ndarray, ...]:
        """Words one, two and three back; ``start`` before a document's first (``first``: each token's place in it)."""
        out = []
        for k in (1, 2, 3):
            back = np.full(len(symbols), start, np.int64)
            back[k:] = symbols[:-k]
            out.append(np.where(first >= k, back, start))
        return tuple(out)

    def batches(self, symbols: np.ndarray, words: np.ndarray, first: np.ndarray, size: int) -> Iterator[tuple]:
        """Of each batch: its slice, classes and class rows; of its modelled words: places, word rows and place in the class."""
        z, n = self.sizes, self.sizes.rows
        coarse, fine = self.contexts(symbols, first, z.start), self.contexts(words, first, FAR - 1)
        for at in range(0, len(symbols), size):
            part = slice(at, at + size)
            s = symbols[part]
            (a, b, _), (x, y, w) = (tuple(c[part] for c in found) for found in (coarse, fine))
            cls = np.where(s < z.top, s // CLASS_WORDS, s - z.top + z.word_classes)
            rows = [np.zeros(len(s), np.int64), _mix(n, 1, x), _mix(n, 2, a, b), _mix(n, 3, y), _mix(n, 4, w)]
            top = np.flatnonzero(s < z.top)
            own = cls[top]
            yield part, cls, rows, top, [_mix(n, 5, own), _mix(n, 6, own, x[top]), _mix(n, 7, own, y[top])], s[top] % CLASS_WORDS

    @staticmethod
    def scores(table: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
        """Sums of the features' weights by outcome, one row a token; where some leave ``SPAN``, the largest of a row is 0."""
        z = table.take(rows[0], axis=0)
        added = np.empty_like(z)
        for r in rows[1:]:
            z += table.take(r, axis=0, out=added, mode="clip")  # rows are in range; without the mode it copies once more
        if not (-SPAN < z.min() and z.max() < SPAN):
            z -= z.max(axis=1, keepdims=True)
        return z

    @classmethod
    def log_of(cls, table: np.ndarray, rows: list[np.ndarray], outcome: np.ndarray) -> np.ndarray:
        """Log probability of each token's outcome."""
        z = cls.scores(table, rows)
        own = z[np.arange(len(z)), outcome].astype(float)
        return own - np.log(np.einsum("ij->i", np.exp(z, out=z)))

    def log_probability(self, symbols: np.ndarray, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 of P(class | context), times P(word | class, context) for frequent words, by token."""
        out = np.empty(len(symbols))
        for part, cls, class_rows, top, word_rows, place in self.batches(symbols, words, first, CACHED):
            own = self.log_of(self.by_class, class_rows, cls)
            if len(top):
                own[top] += self.log_of(self.by_word, word_rows, place)
            out[part] = own / np.log(10)
        return out


class Trainer(Model):
    """AdaGrad steps over batches of tokens; counts the tokens that use each row."""

    def __init__(self, sizes: Sizes):
        super().__init__(sizes)
        self.squares = [np.full(sizes.rows, 1e-4, np.float32) for _ in range(2)]
        self.used = [np.zeros(sizes.rows, np.float32) for _ in range(2)]

    def _step(self, which: int, table: np.ndarray, rows: list[np.ndarray], wanted: np.ndarray) -> None:
        g = np.empty((len(wanted), table.shape[1]), np.float32)
        for k in range(0, len(g), CACHED):
            z = self.scores(table, [r[k : k + CACHED] for r in rows])
            np.exp(z, out=z)
            np.multiply(z, np.reciprocal(np.einsum("ij->i", z))[:, None], out=g[k : k + CACHED])
        g.reshape(-1)[np.arange(len(g)) * g.shape[1] + wanted] -= 1
        squares = self.squares[which]
        for r in rows:
            if r is rows[0] and which == 0:  # the bias
                at, total, used = r[:1], np.einsum("ij->j", g)[None], len(r)
            else:
                at, total, used = sums_by_row(g, r)
            own = squares.take(at) + np.einsum("ij,ij->i", total, total) / total.shape[1]
            squares[at] = own
            total *= (RATE / np.sqrt(own))[:, None]
            table[at] = table.take(at, axis=0) - total
            self.used[which][at] += used

    def train(self, symbols: np.ndarray, words: np.ndarray, first: np.ndarray) -> None:
        for _, cls, class_rows, top, word_rows, place in self.batches(symbols, words, first, BATCH):
            self._step(0, self.by_class, class_rows, cls)
            if len(top):
                self._step(1, self.by_word, word_rows, place)


@dataclass(frozen=True)
class Tokens:
    """Tokens of some documents: ranks (-1 beyond the known words), symbols, identities, tokens by document."""

    ranks: np.ndarray
    symbols: np.ndarray
    ids: np.ndarray
    lengths: np.ndarray


def _known(texts: pa.Array, words: Vocabulary) -> tuple[Tokens, np.ndarray, pa.Array]:
    """The tokens, their places among the distinct ones, the distinct ones; each distinct one is looked up once."""
    codes, lengths, distinct = split_texts(texts)
    found, top, rare = distinct.to_numpy(zero_copy_only=False).tolist(), words.sizes.top, words.sizes.rare_classes
    r = np.fromiter(map(words.rank.get, found, repeat(-1)), np.int64, len(found))
    s = words.symbol[r] if len(words.symbol) else np.zeros(len(r), np.int64)
    identity = r.copy()
    missing = np.flatnonzero(r < 0)
    unknown = [found[i] for i in missing.tolist()]
    s[missing] = [top + rare_class(t, rare) for t in unknown]
    identity[missing] = [FAR + zlib.crc32(t) for t in unknown]
    return Tokens(r.take(codes), s.take(codes), identity.take(codes), lengths), codes, distinct


def _gathered(rows: Iterator[pa.RecordBatch], words: Vocabulary, least: int) -> Iterator[Tokens]:
    """Documents in groups of ``least`` tokens or more."""
    held: list[Tokens] = []

    def joined() -> Tokens:
        return Tokens(*(np.concatenate([getattr(t, x) for t in held]) for x in ("ranks", "symbols", "ids", "lengths")))

    for b in _slices(rows):
        held.append(_known(b.column("text"), words)[0])
        if sum(len(t.ids) for t in held) >= least:
            yield joined()
            held = []
    if held:
        yield joined()


def _far(codes: np.ndarray, ranks: np.ndarray, lengths: np.ndarray, distinct: pa.Array) -> pa.ListArray:
    """Of each document, the words beyond the known ones with their counts."""
    missing = np.flatnonzero(ranks < 0)
    key, n = np.unique(np.repeat(np.arange(len(lengths)), lengths)[missing] * len(distinct) + codes[missing], return_counts=True)
    offsets = np.searchsorted(key, np.arange(len(lengths) + 1) * len(distinct)).astype(np.int32)
    words = pa.StructArray.from_arrays([distinct.take(pa.array(key % len(distinct))), pa.array(n, pa.int32())], names=["word", "n"])
    return pa.ListArray.from_arrays(offsets, words)


def _places(n: np.ndarray) -> np.ndarray:
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def train(docs: DataFrame, words) -> Model:
    """One pass over the documents; the averaged tables (see ``sizes_for``) come to the driver. ``words``: a broadcast."""
    z = words.value.sizes
    n_rows = z.rows

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Trainer(z)
        for t in _gathered(rows, words.value, 16 * BATCH):
            own.train(t.symbols, t.ids, _places(t.lengths))
        pid = TaskContext.get().partitionId()

        def blocks():
            for which, table in enumerate((own.by_class, own.by_word)):
                for k in range(0, n_rows, BLOCK):
                    used = own.used[which][k : k + BLOCK]
                    at = np.flatnonzero(used)
                    if len(at):
                        yield which * n_rows + k, pid, at.astype(np.uint8).tobytes(), used[at].tobytes(), table[k + at].astype(np.float16).tobytes()

        return batches(blocks(), pa.schema([("block", pa.int32()), ("task", pa.int32()), ("at", pa.binary()), ("used", pa.binary()), ("w", pa.binary())]), 256)

    def average(group: pa.Table) -> pa.Table:
        group = group.sort_by("task")
        block = group.column("block")[0].as_py()
        width = z.classes if block < n_rows else CLASS_WORDS
        total, n = np.zeros((BLOCK, width)), np.zeros(BLOCK)
        for at, used, w in zip(*(group.column(c).to_pylist() for c in ("at", "used", "w"))):
            i, u = np.frombuffer(at, np.uint8), np.frombuffer(used, np.float32).astype(float)
            total[i] += np.frombuffer(w, np.float16).reshape(-1, width).astype(float) * u[:, None]
            n[i] += u
        mean = (total / np.maximum(n, 1)[:, None]).astype(np.float16)
        return pa.table({"block": pa.array([block], pa.int32()), "w": pa.array([mean.tobytes()], pa.binary())})

    sent = docs.select("text").coalesce(z.trainers).mapInArrow(run, "block int, task int, at binary, used binary, w binary")
    model = Model(z, *(np.zeros((n_rows, w), np.float16) for w in (z.classes, CLASS_WORDS)))
    for r in sent.groupBy("block").applyInArrow(average, "block int, w binary").collect():
        table, k = (model.by_class, r.block) if r.block < n_rows else (model.by_word, r.block - n_rows)
        table[k : k + BLOCK] = np.frombuffer(bytes(r.w), np.float16).reshape(BLOCK, -1)
    return model


SCORED = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("model", pa.float64()),
                    ("far", pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())])))])
SCORED_DDL = "rid long, doc_id long, n_tokens long, n_known long, base double, model double, far array<struct<word:binary,n:int>>"


def score_lm(docs: DataFrame, training: Column, known_words: int = 200_000) -> DataFrame:
    """One row a document: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    ``training`` is a boolean column over ``docs``; null counts as no. Tokens are what ASCII white space separates, with
    A-Z lower-cased, and an end. A null or empty text is one end token. ``base_score`` is the add-one unigram's log10
    probability, ``score`` the model's; both give unseen words a share (in the model one in each rare class).
    Repeated rows are scored each; other columns are left out. Without training rows the counts are zero:
    ``base_score`` is 0, ``score`` that of a uniform start.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(training, F.lit(False)).alias("__train"))
    counts = count_tokens(rows.filter("__train"))
    vocabulary = build_vocabulary(counts, known_words)
    words = spark.sparkContext.broadcast(vocabulary)
    weights = spark.sparkContext.broadcast(train(rows.filter("__train"), words))

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, sent, pid = words.value, weights.value, TaskContext.get().partitionId()
        m = Model(v.sizes, sent.by_class.astype(np.float32), sent.by_word.astype(np.float32))

        i = 0
        for b in _slices(found):
            t, codes, distinct = _known(b.column("text"), v)
            logs = m.log_probability(t.symbols, t.ids, _places(t.lengths))
            near = t.ranks >= 0
            own = np.where(near, v.log_count[t.ranks], 0.0) if len(v.log_count) else np.zeros(len(t.ranks))
            rare = t.symbols >= v.sizes.top
            logs[rare] += own[rare] - v.rare_total[t.symbols[rare] - v.sizes.top]
            starts = np.cumsum(t.lengths) - t.lengths
            known, base, model = (np.add.reduceat(x, starts) for x in (near.astype(np.int64), own, logs))
            rid = (pid << 40) + i + np.arange(b.num_rows)
            i += b.num_rows
            columns = [rid, b.column("doc_id"), t.lengths.astype(np.int64), known, base, model, _far(codes, t.ranks, t.lengths, distinct)]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], schema=SCORED)

    near = cut(rows.select("doc_id", "text").mapInArrow(run, SCORED_DDL), "lm-scored")
    far = near.select("rid", F.explode("far").alias("f")).select("rid", F.col("f.word").alias("word"), F.col("f.n").alias("tf"))
    rest = counts if vocabulary.words > len(vocabulary.rank) else counts.limit(0)
    sums = far.join(rest, "word").groupBy("rid").agg(F.sum("tf").alias("known"), F.sum(F.col("tf") * F.log10(F.col("n") + F.lit(1.0))).alias("logs"))
    share = float(np.log10(vocabulary.tokens + vocabulary.words + 1))
    logs = F.coalesce("logs", F.lit(0.0))
    return near.drop("far").join(sums, "rid", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * F.lit(share)).alias("base_score"), (F.col("model") + logs).alias("score"),
    )

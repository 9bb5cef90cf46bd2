"""SentencePiece encoding and decoding by a weighted finite-state transducer.

A model compiles to three machines: the normaliser (a transducer of the model's character map that takes the longest
match, blank removal, dummy prefix, space to U+2581), a trie transducer of the pieces whose final states emit a piece with
its weight, and byte fallback arcs for characters that no piece holds. An input is composed with them as it is read, and
the shortest path in the tropical semiring (min, +) is its encoding. User-defined pieces are not normalised; in BPE models
they are forced (the text around them is encoded apart), in unigram models they weigh next to nothing.

- Unigram models: a piece weighs its negative log probability.
- BPE models: the weight sits on pairs of neighbouring pieces: 0 if merging their joined text gives this pair again,
  infinite otherwise. A sequence of pieces is the BPE encoding exactly if all neighbouring pairs are of this kind, so
  one path of finite weight exists, also for every prefix of the input: the state is (position, last piece), and each
  position has a single finite one.

Text is cut where no piece can cross (before a blank after a non-blank, around characters that only occur alone);
encodings of such chunks are kept up to a bound. Whole texts are encoded.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField

from quayside.llm.common import added_schema, text_bytes

BLANK = "▁"
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Kinds of models.
UNIGRAM, BPE = 1, 2
INFINITE = float("inf")


def read_model(data: bytes) -> dict:
    """Pieces, kinds and scores of a serialised model, with the settings that matter here."""
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    m.ParseFromString(data)
    spec = m.normalizer_spec
    if not spec.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("only escaped blanks before words are compiled")
    if m.trainer_spec.model_type not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are compiled")
    return {"pieces": [(p.piece, p.score, p.type or NORMAL) for p in m.pieces], "kind": m.trainer_spec.model_type, "dummy_prefix": spec.add_dummy_prefix, "trim": spec.remove_extra_whitespaces, "map": read_map(spec.precompiled_charsmap)}


def read_map(blob: bytes) -> dict:
    """The character map as a trie of bytes; "" holds what a key is replaced by.

    The blob is a length, a double-array trie of 32-bit units (label in the low byte, offset above bit 10, bit 8 for a
    leaf, bit 9 for offsets times 256) and the replacements, each ended by a zero byte.
    """
    trie: dict = {}
    if not blob:
        return trie
    size = int(np.frombuffer(blob, "<u4", 1)[0])
    units, texts = np.frombuffer(blob, "<u4", size // 4, 4).tolist(), blob[4 + size :]
    offset = lambda u: (u >> 10) << (8 if u & 512 else 0)
    open_ = [(offset(units[0]), trie)]
    while open_:
        at, node = open_.pop()
        for label in range(1, 256):
            if at ^ label < len(units) and (u := units[at ^ label]) & 0x800000FF == label:
                below = node[label] = {}
                to = (at ^ label) ^ offset(u)
                if u & 256:
                    start = units[to] & 0x7FFFFFFF
                    below[""] = texts[start : texts.index(b"\0", start)]
                open_.append((to, below))
    return trie


class Transducer:
    """The compiled model; ``encode`` and ``decode`` take and give whole texts."""

    def __init__(self, data: bytes, kept_chunks: int = 600_000):
        model = read_model(data)
        self.kind, self.dummy, self.trim, self.map, self.kept = model["kind"], model["dummy_prefix"], model["trim"], model["map"], kept_chunks
        self.text: list[bytes] = []
        self.ids: dict[str, int] = {}
        self.score: list[float] = []
        self.bytes: dict[int, int] = {}
        self.unknown = 0
        trie: dict = {}
        forced: dict[str, int] = {}
        kept_raw: list[str] = []
        top = max([0.0, *(x for _, x, k in model["pieces"] if k == NORMAL)])  # not below 0, as the library has it
        for i, (piece, score, kind) in enumerate(model["pieces"]):
            self.score.append(score)
            self.text.append(piece.replace(BLANK, " ").encode() if kind in (NORMAL, USER_DEFINED, UNUSED) else b"")
            if kind == BYTE:
                self.bytes[int(piece[3:-1], 16)] = i
                self.text[i] = bytes([int(piece[3:-1], 16)])
            elif kind == UNKNOWN:
                self.unknown, self.text[i] = i, " ⁇ ".encode()
            elif kind in (NORMAL, USER_DEFINED):
                if kind == USER_DEFINED:
                    kept_raw.append(piece)
                    if self.kind == BPE:
                        forced[piece] = i
                        continue
                    self.score[i] = len(piece.encode()) * top - 0.1
                self.ids[piece] = i
                at = trie
                for ch in piece:
                    at = at.setdefault(ch, {})
                at[""] = i
        self.trie = trie
        self.forced = forced
        longest = lambda ps: re.compile(f"({'|'.join(re.escape(p) for p in sorted(ps, key=lambda p: (-len(p), p)))})").split if ps else None
        self.around = longest(forced)
        self.kept_raw = longest(kept_raw)  # user-defined pieces are not normalised
        self.least = min(self.score, default=0.0) - 10.0  # an unknown character's weight, as the library has it
        long = [p for p in self.ids if len(p) > 1]
        joined = {ch for p in long for ch in p}
        # chunks: a run of blanks with what follows, if no piece has a blank after another character
        free = not any(BLANK in p.lstrip(BLANK) for p in long)
        alone = "".join(re.escape(c) for c in "\n\t\r" if c not in joined)
        # and before punctuation that no piece has after a character of another kind
        marks = set("!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~")
        while wrong := {b for p in long for a, b in zip(p, p[1:]) if b in marks and a != BLANK and a not in marks}:
            marks -= wrong
        if free:
            mark, other = "".join(map(re.escape, sorted(marks))), BLANK + alone
            forms = [f"{BLANK}*[{mark}]+[^{other}{mark}]*"] * bool(mark) + [f"{BLANK}*[^{other}{mark}]+", f"{BLANK}+"] + [f"[{alone}]"] * bool(alone)
            self.split = re.compile("|".join(forms)).findall
        else:
            self.split = lambda s: [s]
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}

    def _mapped(self, text: str) -> str:
        """Longest matches of the character map, left to right."""
        out, data, i = [], text.encode("utf-8", "replace"), 0
        while i < len(data):
            node, j, end, to = self.map, i, i, b""
            while j < len(data) and (node := node.get(data[j])) is not None:
                j += 1
                if "" in node:
                    end, to = j, node[""]
            if end == i:  # a character as it is
                lead = data[i]
                end = i + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
                to = data[i:end]
            out.append(to)
            i = end
        return b"".join(out).decode("utf-8", "replace")

    def normalise(self, text: str) -> str:
        if self.map:
            parts = self.kept_raw(text) if self.kept_raw else [text]
            text = "".join(x if k % 2 else self._mapped(x) for k, x in enumerate(parts))
        if self.trim:
            text = _runs_of_blanks(" ", text.strip(" "))
        out = text.replace(" ", BLANK)
        return BLANK + out if self.dummy and out else out

    def _fallback(self, ch: str) -> list[int]:
        return [self.bytes[b] for b in ch.encode("utf-8", "replace")] if self.bytes else [self.unknown]

    def merge(self, text: str) -> list[str]:
        """BPE by its definition: joins the best-scored pair, the leftmost of equals, until none is left."""
        ids, score, parts = self.ids, self.score, list(text)
        while True:
            best, at = -INFINITE, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and score[i] > best:
                    best, at = score[i], k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _pair_weight(self, a: str, b: str) -> float:
        return 0.0 if self.merge(a + b) == [a, b] else INFINITE

    def _follows(self, a: int, b: int, left: str, right: str) -> bool:
        key = a << 32 | b
        if (x := self.pairs.get(key)) is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            x = self.pairs[key] = self._pair_weight(left, right) == 0.0
        return x

    def _shortest(self, chunk: str) -> list[int]:
        """Tropical shortest path through the composition of ``chunk`` with pieces and byte fallback."""
        n, trie = len(chunk), self.trie
        back: list[tuple[int, int] | None] = [None] * (n + 1)  # (from, piece or -1 for a fallback character)
        if self.kind == BPE:
            whole = self.ids.get(chunk)
            if whole is not None and n == 1:
                return [whole]
            last: list[str | None] = [None] * (n + 1)
            for i in range(n):
                if i and back[i] is None:
                    raise AssertionError("each prefix has an encoding")
                left, a = last[i], back[i][1] if i else -1
                at, j, found = trie, i, False
                while j < n and (at := at.get(chunk[j])) is not None:
                    j += 1
                    piece = at.get("")
                    found = found or (piece is not None and j == i + 1)
                    if piece is None or back[j] is not None:
                        continue
                    right = chunk[i:j]
                    if i == 0:
                        ok = self._alone(piece, right)
                    elif a < 0:
                        ok = self._alone(piece, right)
                    else:
                        ok = self._follows(a, piece, left, right)
                    if ok:
                        back[j], last[j] = (i, piece), right
                if not found and back[i + 1] is None:
                    back[i + 1], last[i + 1] = (i, -1), chunk[i]
        else:
            best = [INFINITE] * (n + 1)
            best[0] = 0.0
            for i in range(n):
                at, j, found, cost = trie, i, False, best[i]
                while j < n and (at := at.get(chunk[j])) is not None:
                    j += 1
                    piece = at.get("")
                    if piece is not None:
                        found = found or j == i + 1
                        if cost - self.score[piece] < best[j]:
                            best[j], back[j] = cost - self.score[piece], (i, piece)
                if not found and cost - self.least < best[i + 1]:
                    best[i + 1], back[i + 1] = cost - self.least, (i, -1)
        out: list[int] = []
        j = n
        while j:
            i, piece = back[j]
            out.extend([piece] if piece >= 0 else reversed(self._fallback(chunk[i:j])))
            j = i
        return out[::-1]

    def _alone(self, piece: int, text: str) -> bool:
        """Whether merging the piece's own text gives the piece."""
        key = -1 - piece
        if (x := self.pairs.get(key)) is None:
            x = self.pairs[key] = self.merge(text) == [text]
        return x

    def _chunks(self, text: str) -> list[str]:
        if self.around is None:
            return self.split(text)
        return [c for k, x in enumerate(self.around(text)) for c in ([x] if k % 2 else self.split(x))]

    def encode_bytes(self, text: str) -> bytes:
        """Piece ids as little-endian 32-bit integers."""
        known = self.known
        if len(known) > self.kept:
            known.clear()
        out = []
        for chunk in self._chunks(self.normalise(text)):
            if (x := known.get(chunk)) is None:
                x = np.array([self.forced[chunk]] if chunk in self.forced else self._shortest(chunk), "<i4").tobytes()
                if len(chunk) <= 48:
                    known[chunk] = x
            out.append(x)
        if self.bytes:
            return b"".join(out)
        ids = np.frombuffer(b"".join(out), "<i4")  # without byte fallback a run of unknown characters is one piece
        unknown = ids == self.unknown
        return ids[~(unknown & np.append(False, unknown)[: len(ids)])].tobytes()

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<i4").tolist()

    def decode_bytes(self, ids: list[int]) -> bytes:
        text = self.text
        out = b"".join([text[i] for i in ids])
        return out[1:] if self.dummy and out.startswith(b" ") else out

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_runs_of_blanks = re.compile(" +").sub
_compiled: dict[bytes, Transducer] = {}


def compiled(data: bytes) -> Transducer:
    """The transducer of a model; a Python worker compiles it once."""
    key = hashlib.sha256(data).digest()
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = Transducer(data)
    return _compiled[key]


def default_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_pieces(docs: DataFrame, model_path: str | None = None, with_ids: bool = True) -> DataFrame:
    """Adds ``n_pieces, ids_sha256, round_trip`` and, with ``with_ids``, ``piece_ids`` to each document.

    ``ids_sha256`` is over the ids as little-endian 32-bit integers; ``round_trip`` says that decoding gives the text
    again. A null or empty text has no pieces and round-trips to empty text. The model's file is read on the driver.
    Added names are replaced.
    """
    added = ["n_pieces", "ids_sha256", "round_trip", "piece_ids"]
    docs = docs.drop(*added)
    with open(model_path or default_model_path(), "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    names = docs.columns

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = compiled(model.value)
        for big in rows:
            for at in range(0, big.num_rows, 256):  # ids of few documents are held at a time
                b = big.slice(at, 256)
                counts, shas, same, ids = [], [], [], []
                for text in text_bytes(b.column("text")):
                    own = fst.encode_bytes(text.decode("utf-8", "replace"))
                    found = np.frombuffer(own, "<i4")
                    counts.append(len(found))
                    shas.append(hashlib.sha256(own).hexdigest())
                    same.append(fst.decode_bytes(found.tolist()) == text)
                    if with_ids:
                        ids.append(found)
                columns = [*b.columns, pa.array(counts, pa.int64()), pa.array(shas), pa.array(same)]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *added[: len(columns) - len(names)]])

    kinds = [LongType(), StringType(), BooleanType(), ArrayType(IntegerType())]
    return docs.mapInArrow(run, added_schema(docs, *[StructField(c, k) for c, k in zip(added[: 3 + with_ids], kinds)]))


def decode_pieces(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """Adds ``text``, decoded from ``piece_ids`` (an array of int); null without ids, bytes that are no text as U+FFFD.

    An id that the model lacks raises. A column named text is replaced.
    """
    docs = docs.drop("text")
    with open(model_path or default_model_path(), "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    names = docs.columns

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = compiled(model.value)
        for b in rows:
            texts = [None if ids is None else fst.decode(ids) for ids in b.column("piece_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*names, "text"])

    return docs.mapInArrow(run, added_schema(docs, StructField("text", StringType())))

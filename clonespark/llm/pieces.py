"""SentencePiece BPE encoding by vectorised merge rounds, and decoding.

A model becomes numpy tables: symbols, and for every pair of symbols that joins to a piece the
rank of that piece (equal scores share a rank). All words of a batch are encoded at once:
flat symbol arrays, the smallest pair rank of each word by a segmented minimum, all leftmost
occurrences of it merged together, compaction, until no pair of any word remains.

Merging all occurrences of a pair at once equals merging one by one as long as the new piece
cannot take part in a merge of the same or a better rank. The few pieces for which that is
not so are found when the model is read; of them only the leftmost is merged in a round.
"""

from __future__ import annotations

import codecs
import heapq
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from .kernels import slices

SPACE = "▁"
NONE = np.iinfo(np.int32).max
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Longer words (no space in thousands of characters) are merged one pair at a time from a heap.
LONG_WORD = 4096
#: Words kept with their ids in a Python worker.
CACHE = 300_000
#: Bytes of text taken up at once.
PIECE = 1 << 20

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


@dataclass(frozen=True)
class Model:
    """What is kept of a model file: pieces, scores, kinds, and the switches of its normaliser."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    dummy_prefix: bool
    unknown_surface: str


def read_model(path: str) -> Model:
    """Read a BPE model with identity normalisation; other kinds are refused."""
    from sentencepiece import sentencepiece_model_pb2

    with open(path, "rb") as file:
        proto = sentencepiece_model_pb2.ModelProto.FromString(file.read())
    spec = proto.normalizer_spec
    if proto.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
        raise ValueError("Only BPE models with identity normalisation are supported.")
    if {p.type for p in proto.pieces} & {USER, UNUSED} or proto.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("User-defined and unused pieces and space suffixes are not supported.")
    return Model(
        tuple(p.piece for p in proto.pieces), tuple(p.score for p in proto.pieces), tuple(p.type for p in proto.pieces),
        spec.add_dummy_prefix, proto.trainer_spec.unk_surface,
    )


class Codec:
    """Tables of a model; built once in each Python worker."""

    def __init__(self, model: Model):
        self.model = model
        normal = {p: i for i, (p, kind) in enumerate(zip(model.pieces, model.kinds, strict=True)) if kind == NORMAL}
        self.size = len(model.pieces)
        self.symbol = dict(normal)  # a piece or a single character of a piece
        for piece in normal:
            for char in piece:
                self.symbol.setdefault(char, len(self.symbol) + self.size)
        levels = {s: k for k, s in enumerate(sorted({model.scores[i] for i in normal.values()}, reverse=True))}
        rank_of = np.full(self.size + len(self.symbol) + 1, -1, np.int64)
        for i in normal.values():
            rank_of[i] = levels[model.scores[i]]
        self.width = self.size + len(self.symbol) + 1  # the last number stands for characters of no piece
        left, right, whole = [], [], []
        for piece, i in normal.items():
            for cut in range(1, len(piece)):
                a, b = self.symbol.get(piece[:cut]), self.symbol.get(piece[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    whole.append(i)
        left, right, whole = (np.array(x, np.int64) for x in (left, right, whole))
        self.index = pd.Index(left * self.width + right)
        self.joined = np.append(whole, 0).astype(np.int32)
        self.rank = np.append(rank_of[whole], NONE).astype(np.int32)
        risky = np.zeros(self.width, bool)
        risky[left[rank_of[whole] <= rank_of[left]]] = True
        risky[right[rank_of[whole] <= rank_of[right]]] = True
        shared = np.bincount(rank_of[list(normal.values())]) > 1  # one rank, several pieces
        self.single = np.zeros(len(levels) + 1, bool)
        self.single[:-1] = shared
        for i in np.flatnonzero(risky[: self.size]):
            if rank_of[i] >= 0:
                self.single[rank_of[i]] = True
        self.pairs = dict(zip(self.index.tolist(), zip(self.rank[:-1].tolist(), whole.tolist(), strict=True), strict=True))
        # a word may begin at a space after something else if no piece reaches over that place
        self.unit = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in normal) else "(?s).+")
        self.byte = {int(p[3:5], 16): i for i, (p, kind) in enumerate(zip(model.pieces, model.kinds, strict=True)) if kind == BYTE}
        self.unknown = model.kinds.index(UNKNOWN)
        self.raw = [self._bytes(i) for i in range(self.size)]
        self.lengths = np.array([len(x) for x in self.raw])
        self.heads = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.flat = np.frombuffer(b"".join(self.raw), np.uint8)
        self.control = np.array([kind == CONTROL for kind in model.kinds])
        self._reset()
        self.of_char = np.full(0x110000, self.width - 1, np.int64)
        for symbol, number in self.symbol.items():
            if len(symbol) == 1:
                self.of_char[ord(symbol)] = number

    def _bytes(self, i: int) -> bytes:
        kind, piece = self.model.kinds[i], self.model.pieces[i]
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == CONTROL:
            return b""
        return (self.model.unknown_surface if kind == UNKNOWN else piece.replace(SPACE, " ")).encode()

    def fallback(self, char: str) -> list[int]:
        return [self.byte[b] for b in char.encode()] if len(self.byte) == 256 else [self.unknown]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one behind the other, and the number of ids of each."""
        units: list[str] = []
        first = [0]
        for text in texts:
            if text:
                units += self.unit.findall((SPACE if self.model.dummy_prefix else "") + text.replace(" ", SPACE))
            first.append(len(units))
        new = set(units).difference(self.cache)
        if len(self.cache) + len(new) > CACHE:
            self._reset()
            new = set(units)
        if new:
            self._learn(list(new))
        at = np.fromiter(map(self.cache.__getitem__, units), np.int64, len(units))
        sizes = self.counts[at]
        total = np.concatenate([[0], np.cumsum(sizes)])
        within = np.arange(int(total[-1])) - np.repeat(total[:-1], sizes)
        return self.pool[np.repeat(self.begins[at], sizes) + within], np.diff(total[first])

    def _reset(self) -> None:
        self.cache: dict[str, int] = {}
        self.pool = np.zeros(0, np.int32)
        self.counts = self.begins = np.zeros(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        ids, counts = self.merge(words)
        self.cache.update(zip(words, range(len(self.cache), len(self.cache) + len(words)), strict=True))
        self.begins = np.concatenate([self.begins, len(self.pool) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.pool = np.concatenate([self.pool, ids])

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one behind the other, and the number of ids of each."""
        long = [k for k, w in enumerate(words) if len(w) > LONG_WORD]
        if not long:
            return self._finish(words, *self._rounds(words))
        parts, done = [], 0
        for k in [*long, len(words)]:
            if k > done:
                parts.append(self._finish(words[done:k], *self._rounds(words[done:k])))
            if k < len(words):
                parts.append(self._finish([words[k]], *self._heap(words[k])))
            done = k + 1
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _symbols(self, text: str) -> np.ndarray:
        return self.of_char[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]

    def _rounds(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols left over, their words, and the place of the first character of each."""
        text = "".join(words)
        symbol = self._symbols(text)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        place = np.arange(len(text))
        done = []
        at = self._lookup(symbol, word, np.arange(len(symbol)))
        while len(symbol):
            rank = self.rank[at]
            heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            sizes = np.diff(np.append(heads, len(word)))
            least = np.minimum.reduceat(rank, heads)
            over = np.repeat(least == NONE, sizes)
            if over.any():
                done.append((symbol[over], word[over], place[over]))
                symbol, word, place, at, rank = symbol[~over], word[~over], place[~over], at[~over], rank[~over]
                if not len(symbol):
                    break
                alive = least != NONE
                least, sizes = least[alive], sizes[alive]
                heads = np.cumsum(sizes) - sizes
            best = rank == np.repeat(least, sizes)
            winners = np.flatnonzero(best)
            # leftmost first: in a run of overlapping winners every other one
            fresh = np.append(True, np.diff(winners) > 1)
            run = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            winners = winners[(np.arange(len(winners)) - run) % 2 == 0]
            owner = word[winners]
            first = np.append(True, owner[1:] != owner[:-1])
            winners = winners[first | ~self.single[rank[winners]]]
            symbol[winners] = self.joined[at[winners]]
            keep = np.ones(len(symbol), bool)
            keep[winners + 1] = False
            moved = np.cumsum(keep) - 1
            symbol, word, place, at = symbol[keep], word[keep], place[keep], at[keep]
            changed = np.zeros(len(symbol), bool)
            changed[moved[winners]] = True
            changed[:-1] |= changed[1:]
            changed = np.flatnonzero(changed)
            at[changed] = self._lookup(symbol, word, changed)
        symbol, word, place = (np.concatenate([d[k] for d in done]) for k in range(3))
        order = np.argsort(place)
        return symbol[order], word[order], place[order]

    def _lookup(self, symbol: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Entry of the pair table for the pairs that begin at ``at`` (the last entry: no pair)."""
        follow = np.minimum(at + 1, len(symbol) - 1)
        found = self.index.get_indexer(symbol[at] * self.width + symbol[follow])
        found[(at == follow) | (word[at] != word[follow])] = -1
        return np.where(found < 0, len(self.joined) - 1, found)

    def _heap(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        symbol = self._symbols(text).tolist()
        n = len(symbol)
        before, after, size = list(range(-1, n - 1)), list(range(1, n + 1)), [1] * n
        queue: list[tuple[int, int, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            pair = self.pairs.get(symbol[a] * self.width + symbol[b])
            if pair is not None:
                heapq.heappush(queue, (pair[0], a, size[a] + size[b], b, pair[1]))

        for k in range(n - 1):
            offer(k, k + 1)
        while queue:
            _, a, length, b, piece = heapq.heappop(queue)
            if not size[a] or not size[b] or size[a] + size[b] != length or after[a] != b:
                continue
            symbol[a], size[a], size[b] = piece, length, 0
            after[a] = after[b]
            if after[b] < n:
                before[after[b]] = a
                offer(a, after[b])
            if before[a] >= 0:
                offer(before[a], a)
        left = np.array([k for k in range(n) if size[k]])
        return np.array(symbol)[left], np.zeros(len(left), np.int64), left

    def _finish(self, words: list[str], symbol: np.ndarray, word: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters that are no piece become bytes (or the unknown id); ids, and their number by word."""
        foreign = np.flatnonzero(symbol >= self.size)
        counts = np.ones(len(symbol), np.int64)
        if len(foreign):
            text = "".join(words)
            replaced = [self.fallback(text[p]) for p in place[foreign].tolist()]
            counts[foreign] = [len(r) for r in replaced]
            ids = np.repeat(symbol, counts)
            begins = (np.cumsum(counts) - counts)[foreign]
            for begin, r in zip(begins.tolist(), replaced, strict=True):
                ids[begin : begin + len(r)] = r
        else:
            ids = symbol
        return ids.astype(np.int32), np.bincount(word, counts, len(words)).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of rows of ids; bytes that are no UTF-8 become one replacement character each."""
        sizes = self.lengths[ids]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        out = np.empty(int(bounds[-1]), np.uint8)
        for begin in range(0, len(ids), 1 << 18):
            stop = min(len(ids), begin + (1 << 18))
            own = sizes[begin:stop]
            within = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
            out[bounds[begin] : bounds[stop]] = self.flat[np.repeat(self.heads[ids[begin:stop]], own) + within]
        raw = out.tobytes()
        first = np.concatenate([[0], np.cumsum(counts)])
        texts = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            cuts = np.flatnonzero(self.control[ids[a:b]]).tolist()  # bytes do not join across control pieces
            edges = [a, *(a + k for k in cuts), b]
            text = "".join(raw[bounds[x] : bounds[y]].decode("utf-8", "each_byte") for x, y in zip(edges[:-1], edges[1:], strict=True))
            lead = next((i for i in ids[a:b] if not self.control[i]), None) if self.model.dummy_prefix else None
            begins = lead is not None and self.model.kinds[lead] == NORMAL and self.model.pieces[lead].startswith(SPACE)
            texts.append(text[1:] if begins else text)
        return texts


_CODECS: dict[Model, Codec] = {}


def codec(model: Model) -> Codec:
    if model not in _CODECS:
        _CODECS[model] = Codec(model)
    return _CODECS[model]


def encode_texts(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``ids`` (array), ``n_tokens`` and ``decoded`` of every whole text.

    No begin or end ids, no sampling; equal to the library that the model file is made for. Null and
    empty texts have no ids and decode to the empty text. Columns with the names of the results are
    replaced; other columns are kept. The model (a fixed vocabulary) is broadcast.
    """
    kept = docs.drop("ids", "n_tokens", "decoded")
    schema = StructType([*kept.schema.fields])
    schema = schema.add("ids", ArrayType(IntegerType())).add("n_tokens", LongType()).add("decoded", StringType())
    shared = docs.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches):
        own = codec(shared.value)
        for batch in batches:
            for piece in slices(batch, text, PIECE):
                texts = [t or "" for t in piece.column(text).to_pylist()]
                ids, counts = own.encode(texts)
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                arrays = [*piece.columns, pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())), pa.array(counts, pa.int64()), pa.array(own.decode(ids, counts), pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*piece.schema.names, "ids", "n_tokens", "decoded"])

    return kept.mapInArrow(run, schema)

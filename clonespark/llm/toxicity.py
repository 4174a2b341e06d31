"""Toxicity of deobfuscated text.

Tokens that look disguised (digits and signs between letters, signs that imitate letters before or behind
them, letters drawn out, single letters and signs spaced apart) become a lattice of what each character may stand for: itself, the
letters that a sign imitates, one or two of a repeated letter, nothing or a word break for a separator. Signs before the first
and behind the last letter may also be mere punctuation or numbers; the model decides.
Viterbi decoding under a character trigram model, learnt from the corpus, takes the most
likely path. The restored words, together with the plain ones, are scored by a logistic model over
words and word beginnings.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .kernels import BLANKS, byte_set, distinct_keys, segment_hashes, slices, text_bytes, words_in
from .storage import stored

LETTERS = byte_set((97, 122), (128, 255))
#: What signs and digits imitate.
IMITATES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": "aeiou",
}
SIGNS = np.zeros(256, bool)
SIGNS[[ord(c) for c in IMITATES]] = True
CLASSES = 28  # a-z, any other letter, word break
OTHER, BREAK = 26, 27
FEATURE_BITS = 20
#: Bytes of text taken up at once; a dozen arrays of eight bytes a character exist at a time.
PIECE = 1 << 20
PREFIXES = (4, 5, 6)
SIGN_COST, DROP_COST, JOIN_COST, BREAK_COST = 0.5, 12.0, 1.0, 0.5
#: Of dropping a run of signs before or behind all letters: one that may well be a letter, and mere punctuation.
EDGE_COST, NOISE_COST = 8.0, 2.5


def char_counts(docs: DataFrame) -> np.ndarray:
    """Counts of letter class trigrams over the plain words of ``docs`` (28 x 28 x 28, added up by Spark)."""

    def run(batches):
        total = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            for piece in slices(batch, "text", PIECE):
                data, offsets = text_bytes(pc.utf8_lower(piece.column("text").cast(pa.large_string())))
                kind = np.where(LETTERS[data], np.where(data < 128, data - 97, OTHER), BREAK).astype(np.int64)
                lead = np.append((data & 0xC0) != 0x80, True)[:-1]  # a letter of several bytes counts once
                kind[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = BREAK
                kind = np.concatenate([[BREAK, BREAK], kind[lead], [BREAK]])
                total += np.bincount((kind[:-2] * CLASSES + kind[1:-1]) * CLASSES + kind[2:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"code": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    rows = docs.select("text").mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(CLASSES**3)
    for row in rows:
        counts[row["code"]] = row["n"]
    return counts.reshape(CLASSES, CLASSES, CLASSES)


def char_model(counts: np.ndarray) -> np.ndarray:
    """Costs (negative logarithms) of a class after two others; trigrams backed by bigrams."""
    pair = counts.sum(axis=0)
    lower = (pair + 0.5) / (pair.sum(axis=1, keepdims=True) + 0.5 * CLASSES)
    return -np.log((counts + 5 * lower[None]) / (counts.sum(axis=2, keepdims=True) + 5))


def class_of(char: str) -> int:
    return ord(char) - 97 if "a" <= char <= "z" else OTHER if char.isalpha() else BREAK


def edge_cost(char: str, n: int, leading: bool) -> float:
    """What it costs to drop ``n`` equal signs at an edge; three and more, and signs at their usual place, are noise."""
    usual = char == "*" or char == ("(" if leading else "!")
    return NOISE_COST if n > 2 or usual else EDGE_COST


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Slots of a token: the strings that each may stand for, with their costs."""
    slots: list[list[tuple[str, float]]] = []
    place = [k for k, char in enumerate(token) if char.isalpha()] or [0]
    for run in re.finditer(r"(.)\1*", token, re.S):
        char, n = run[1], len(run[0])
        if char.isalpha():
            # a drawn out letter is one or two
            slots.append([(char, 0.0 if n != 2 else 1.5), (char * 2, 0.0)] if n > 1 else [(char, 0.0)])
        elif char in IMITATES:
            options = [(letter * size, SIGN_COST) for letter in IMITATES[char] for size in ((1, 2) if n > 1 else (1,))]
            inside = place[0] < run.start() < place[-1]
            slots.append([*options, ("", DROP_COST * n if inside else edge_cost(char, n, run.start() < place[0])), (" ", DROP_COST * n)])
        else:
            slots.append([("", JOIN_COST), (" ", BREAK_COST)])
    return slots


def decode(token: str, cost: np.ndarray) -> str:
    """The most likely reading of a disguised token."""
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(BREAK, BREAK): (0.0, None)}
    for slot in lattice(token):
        following: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (total, path) in states.items():
            for out, price in slot:
                x, y, sum_ = a, b, total + price
                for char in out:
                    z = class_of(char)
                    if z == BREAK and y == BREAK:
                        continue
                    sum_ += cost[x, y, z]
                    x, y = y, z
                if (x, y) not in following or sum_ < following[x, y][0]:
                    following[x, y] = (sum_, (path, out))
        states = following
    _, _, path = min((total + (cost[a, b, BREAK] if b != BREAK else 0.0), (a, b), path) for (a, b), (total, path) in states.items())
    parts = []
    while path is not None:
        path, out = path
        parts.append(out)
    return "".join(reversed(parts))


class Restorer:
    """Disguised tokens of a batch and their readings; readings are kept in a Python worker."""

    def __init__(self, cost: np.ndarray):
        self.cost = cost
        self.known: dict[str, str] = {}

    def read(self, token: str) -> str:
        if token not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[token] = decode(token, self.cost)
        return self.known[token]

    def words(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(data, starts, ends, rows)`` of the plain and the restored words of all texts."""
        data, offsets = text_bytes(pc.utf8_lower(column.cast(pa.large_string())))
        words = words_in(data, offsets, BLANKS)
        rows = words.rows
        letters = LETTERS[data]
        total = np.concatenate([[0], np.cumsum(letters)])
        place = np.arange(len(data))
        last = np.maximum.accumulate(np.where(letters, place, -1)) if len(data) else place
        first = np.minimum.accumulate(np.where(letters, place, len(data))[::-1])[::-1] if len(data) else place
        signs = SIGNS[data]
        marks = np.concatenate([[0], np.cumsum(signs)])
        lead = np.concatenate([[0], np.cumsum(letters & ((data & 0xC0) != 0x80))])
        other = np.where(letters | signs, -1, place)
        before = np.maximum.accumulate(other) if len(data) else place
        after = np.minimum.accumulate(np.where(other < 0, len(data), place)[::-1])[::-1] if len(data) else place
        lettered = total[words.ends] > total[words.starts]
        # without a letter, a token counts only as a single sign among spaced letters
        some = lettered | (marks[words.ends] - marks[words.starts] == 1)
        starts, ends, rows, lettered = words.starts[some], words.ends[some], rows[some], lettered[some]
        at = np.minimum.accumulate(np.where(signs, place, len(data))[::-1])[::-1] if len(data) else place
        begin = np.where(lettered, first[starts], at[starts])
        end = np.where(lettered, last[ends - 1], at[starts]) + 1
        count = total[end] - total[begin]
        # the letters with all signs that touch them
        left, right = np.maximum(starts, before[begin] + 1), np.minimum(ends, after[end - 1])
        disguised = lettered & ((count < end - begin) | (left < begin) | (right > end))
        triple = np.zeros(len(data) + 1, np.int64)
        if len(data) > 2:
            triple[3:] = np.cumsum((data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & letters[2:])
        disguised |= lettered & (end - begin > 2) & (triple[end] > triple[np.minimum(begin + 2, len(data))])
        alone = ~lettered | ((count == end - begin) & (lead[end] - lead[begin] == 1))
        for k in np.flatnonzero(lettered & alone & (data[begin] > 127)).tolist():
            alone[k] = data[begin[k] : end[k]].tobytes().decode("utf-8", "replace").isalpha()
        same = np.append(False, (rows[1:] == rows[:-1]) & alone[1:] & alone[:-1]) if len(rows) else np.zeros(0, bool)
        head = np.flatnonzero(alone & ~same)
        groups = np.cumsum(~same) - 1
        width = int(groups[-1]) + 1 if len(groups) else 0
        size = np.bincount(groups, minlength=width)
        named = np.bincount(groups, lettered, minlength=width)
        spaced = alone & (size[groups] >= 3) & (named[groups] >= 1) if len(groups) else alone
        disguised &= ~spaced

        def cut(k: int) -> str:
            return data[left[k] : right[k]].tobytes().decode("utf-8", "replace")

        texts, owner = [], []
        for k in np.flatnonzero(disguised).tolist():
            texts.append(self.read(cut(k)))
            owner.append(int(rows[k]))
        for k in head.tolist():
            if spaced[k]:
                texts.append(self.read("-".join(map(cut, range(k, k + int(size[groups[k]]))))))
                owner.append(int(rows[k]))
        plain = lettered & ~disguised & ~spaced
        extra, bounds = text_bytes(pa.array(texts, pa.string()))
        restored = words_in(extra, bounds, BLANKS)
        return (
            np.concatenate([data, extra]),
            np.concatenate([begin[plain], restored.starts + len(data)]), np.concatenate([end[plain], restored.ends + len(data)]),
            np.concatenate([rows[plain], np.array(owner, np.int64)[restored.rows]]),
        )

    def features(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(row, slot)`` of all words and word beginnings."""
        data, starts, ends, rows = self.words(column)
        shift = np.uint64(64 - FEATURE_BITS)
        out = [(rows, (segment_hashes(data, starts, ends, 900) >> shift).astype(np.int64))]
        for size in PREFIXES:
            long = ends - starts >= size
            out.append((rows[long], (segment_hashes(data, starts[long], starts[long] + size, 900 + size) >> shift).astype(np.int64)))
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def fit_logistic(rows: np.ndarray, columns: np.ndarray, y: np.ndarray, width: int, steps: int = 400, penalty: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias of an L2-penalised logistic model over binary features, by accelerated gradient steps."""
    weights, bias = np.zeros(width + 1), 0.0
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return weights[:width], float(np.log(share / (1 - share)))
    rows = np.concatenate([rows, np.arange(len(y))])
    columns = np.concatenate([columns, np.full(len(y), width)])
    ridge = np.append(np.full(width, penalty), 0.0)
    # a quarter of the row sizes, added up by feature, bounds the curvature (diagonal dominance)
    rate = 1 / (np.bincount(columns, np.bincount(rows)[rows] / 4, width + 1) + ridge + 1e-9)
    ahead, before, t = weights.copy(), weights.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.bincount(rows, ahead[columns], len(y))))
        gradient = np.bincount(columns, (p - y)[rows], width + 1) + ridge * ahead
        weights = ahead - rate * gradient
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = weights + (t - 1) / after * (weights - before)
        before, t = weights, after
    return weights[:width], float(weights[width])


def fit_toxicity(docs: DataFrame, labels: DataFrame, cost: np.ndarray, sample: int = 20_000, features: int = 4_000, least: int = 5) -> tuple[np.ndarray, float]:
    """Weights by feature slot, and the bias, from at most ``sample`` labelled rows (lowest hash of the id).

    Features occur in at least ``least`` toxic rows; the ``features`` with the
    strongest association stay. All bounds are parameters, so what reaches the driver is bounded.
    """
    chosen = (
        labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label")

    def measure(batches):
        restorer = Restorer(cost)
        for batch in batches:
            for piece in slices(batch, "text", PIECE):
                row, slot = restorer.features(piece.column("text"))
                keys = np.unique(row * (1 << FEATURE_BITS) + slot)
                bounds = np.searchsorted(keys >> FEATURE_BITS, np.arange(piece.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(keys & ((1 << FEATURE_BITS) - 1), pa.int32()))
                yield pa.RecordBatch.from_pydict({"slots": lists, "label": piece.column("label").cast(pa.int32())})

    measured = stored(rows.mapInArrow(measure, "slots array<int>, label int"), "toxic-sample")
    sizes = measured.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("toxic")).first()
    n, toxic = sizes["n"], sizes["toxic"]
    expected = F.col("n") * F.lit(toxic / max(n, 1))
    strength = (F.col("toxic") - expected) / F.sqrt(expected + 1)
    table = (
        measured.select(F.explode("slots").alias("slot"), "label").groupBy("slot").agg(F.count("*").alias("n"), F.sum("label").alias("toxic"))
        .filter((F.col("toxic") >= least) | (F.col("n") >= 20 * least)).orderBy(F.abs(strength).desc(), "slot").limit(features).collect()
    )
    slots = np.sort(np.array([r["slot"] for r in table], np.int64))

    def select(batches):
        for batch in batches:
            lists = batch.column("slots")
            values, bounds = lists.values.to_numpy(), lists.offsets.to_numpy()
            keep = np.isin(values, slots)
            total = np.concatenate([[0], np.cumsum(keep)])
            yield pa.RecordBatch.from_pydict({"slots": pa.ListArray.from_arrays(pa.array(total[bounds], pa.int32()), pa.array(values[keep], pa.int32())), "label": batch.column("label")})

    collected = measured.mapInArrow(select, "slots array<int>, label int").collect()
    collected.sort(key=lambda r: (r["slots"], r["label"]))  # not the order of arrival
    y = np.array([r["label"] for r in collected], float)
    row = np.repeat(np.arange(len(collected)), [len(r["slots"]) for r in collected])
    column = np.searchsorted(slots, np.array([s for r in collected for s in r["slots"]], np.int64))
    weights, bias = fit_logistic(row, column, y, len(slots))
    full = np.zeros(1 << FEATURE_BITS, np.float32)
    full[slots] = weights
    return full, bias


def toxicity(docs: DataFrame, train: DataFrame, labels: DataFrame, sample: int = 20_000) -> DataFrame:
    """All columns of ``docs`` with ``score``, the probability that the whole text is toxic.

    Labels (``doc_id``, ``toxic`` 0 or 1) are used for rows of ``train`` only, and the character model is
    learnt from ``train``. Null and empty texts have the score of no words at all. Without labels
    every score is one half. Rows are judged one by one, whatever their id; rows of ``train`` that share
    an id share its label. A column named ``score`` is replaced.
    """
    known = train.filter("doc_id is not null")
    cost = char_model(char_counts(known))
    weights, bias = fit_toxicity(known, labels, cost, sample)
    kept = docs.drop("score")
    schema = StructType([*kept.schema.fields, StructField("score", DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast((cost, weights, bias))

    def run(batches):
        cost, weights, bias = shared.value
        restorer = Restorer(cost)
        for batch in batches:
            for piece in slices(batch, "text", PIECE):
                row, slot = restorer.features(piece.column("text"))
                used = weights[slot] != 0
                keys = distinct_keys(row[used] * (1 << FEATURE_BITS) + slot[used])[0]
                margin = bias + np.bincount(keys >> FEATURE_BITS, weights[keys & ((1 << FEATURE_BITS) - 1)], piece.num_rows)
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(1 / (1 + np.exp(-margin)))], names=[*piece.schema.names, "score"])

    return kept.mapInArrow(run, schema)

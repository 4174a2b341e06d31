"""Quality rules: boosted trees over document statistics, behind two fixed rules."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .boosting import Forest, fit_forest
from .kernels import BLANKS, U, byte_set, covered, distinct_keys, mix, ngram_hashes, row_sums, runs, segment_hashes, slices, text_bytes, window_starts, words_in

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER, DIGIT = byte_set((65, 90)), byte_set((48, 57))
STOPS = np.zeros(256, bool)
STOPS[list(b".,;:!?")] = True
LOUD = np.zeros(256, bool)
LOUD[list(b"!?")] = True
NEWLINE = np.zeros(256, bool)
NEWLINE[10] = True

#: Bytes of text taken up at once.
PIECE = 1 << 20
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features and their constraints: more of a thing with -1 never makes a text better.
FEATURES = {
    "words": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeats": -1, "upper": -1, "digits": 0,
    "stops": 0, "loud": -1, "other_script": 0, "line_words": 0, "distinct": 0, "longest": 0,
}


def statistics(column: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The counts of the fixed rules and the feature matrix, one row per text."""
    data, offsets = text_bytes(column)
    words = words_in(data, offsets)
    n = words.counts
    inside = ~BLANKS[data]
    point = (data & 0xC0) != 0x80

    def chars(flags: np.ndarray) -> np.ndarray:
        return row_sums(flags.astype(np.int64), offsets)

    hashes = words.hashes()
    rows = words.rows
    salt = mix(np.arange(len(n), dtype=U) + U(1))
    at = np.flatnonzero(window_starts(words.first, 3))
    keys = ngram_hashes(hashes, 3)[at] ^ salt[rows[at]]
    inverse = distinct_keys(keys)[2]
    repeat = covered(at[np.bincount(inverse)[inverse] > 1], 3, len(hashes))
    starts, ends = runs(~NEWLINE[data], offsets)  # empty lines have no word and need no place
    line_row = np.searchsorted(offsets, starts, "right") - 1
    filled = np.concatenate([[0], np.cumsum(inside)])
    held = filled[ends] > filled[starts]
    lines = segment_hashes(data, starts, ends, seed=3) ^ salt[line_row]
    first = distinct_keys(lines)[1]
    again = np.ones(len(lines), bool)
    again[first] = False
    n_lines = np.bincount(line_row[held], minlength=len(n))
    n_dup = np.bincount(line_row[held & again], minlength=len(n))
    distinct = np.bincount(rows[distinct_keys(hashes ^ salt[rows])[1]], minlength=len(n))
    counts = {
        "n_words": n, "word_chars": chars(inside & point), "n_symbols": chars(SYMBOLS[data]), "n_dup_lines": n_dup,
        "n_repeat_words": row_sums(repeat.astype(np.int64), words.first),
    }
    size = np.maximum(counts["word_chars"], 1)
    some = np.maximum(n, 1)
    longest = np.zeros(len(n))
    if len(hashes):
        np.maximum.at(longest, rows, words.ends - words.starts)
    features = np.stack([
        np.log1p(n), counts["word_chars"] / some, counts["n_symbols"] / size, n_dup / np.maximum(n_lines, 1),
        counts["n_repeat_words"] / some, chars(UPPER[data]) / size, chars(DIGIT[data]) / size, chars(STOPS[data]) / size, chars(LOUD[data]) / size,
        chars((data >= 0x80) & point) / size, np.log1p(n / np.maximum(n_lines, 1)), distinct / np.sqrt(some), np.log1p(longest),
    ], axis=1)
    return counts, features


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = 20_000, **options: float) -> Forest:
    """Fit on at most ``sample`` labelled documents, chosen by a hash of their ids.

    The bound keeps the training set on the driver at ``sample`` rows of thirteen numbers.
    ``labels`` has ``doc_id`` and ``quality`` (0 or 1); null labels are left out.
    """
    chosen = (
        labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    joined = docs.select(F.col("doc_id"), F.col("text")).join(F.broadcast(chosen), "doc_id").select("text", "label")  # at most ``sample`` rows

    def measure(batches):
        for batch in batches:
            for piece in slices(batch, "text", PIECE):
                features = statistics(piece.column("text"))[1]
                yield pa.RecordBatch.from_pydict({"x": pa.array(list(features), pa.list_(pa.float64())), "label": piece.column("label").cast(pa.int32())})

    rows = joined.mapInArrow(measure, "x array<double>, label int").toPandas()
    order = sorted(range(len(rows)), key=lambda k: (tuple(rows.x[k]), rows.label[k]))  # not the order of arrival
    x = np.array([rows.x[k] for k in order], float).reshape(len(rows), len(FEATURES))
    y = rows.label.to_numpy(float)[order]
    return fit_forest(x, y, np.array(list(FEATURES.values())), **options)


def quality(docs: DataFrame, labels: DataFrame, sample: int = 20_000, threshold: float = 0.5) -> DataFrame:
    """All columns of ``docs`` but clashing ones, with counts, ``base_failed``, ``score`` and ``kept``.

    Words are ``[^\\x20\\x09-\\x0D]+``. ``base_failed``: fewer than 50 words, or more than
    half of them in 3-word windows that occur twice in the text. ``kept``: not failed and
    ``score >= threshold``, the probability of good quality under the trees.

    Null and empty texts have no words and fail. Every row is judged for itself, rows without
    an id and equal rows too. Without labels the score is one half for all. Columns of
    ``docs`` whose names are those of results are replaced. An empty table stays empty.
    """
    forest = fit_quality(docs, labels, sample)
    results = [*COUNTS, "base_failed", "score", "kept"]
    kept_columns = docs.drop(*results)
    schema = StructType(list(kept_columns.schema.fields))
    for name in COUNTS:
        schema = schema.add(name, "long")
    schema = schema.add("base_failed", "boolean").add("score", "double").add("kept", "boolean")

    def judge(batches):
        for batch in batches:
            for piece in slices(batch, "text", PIECE):
                counts, features = statistics(piece.column("text"))
                failed = (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])
                score = forest.probability(features)
                arrays = [*piece.columns, *(pa.array(counts[c], pa.int64()) for c in COUNTS), pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*piece.schema.names, *results])

    return kept_columns.mapInArrow(judge, schema)

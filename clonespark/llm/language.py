"""Language mixtures by expectation-maximisation over word likelihoods.

Every language is a smoothed distribution over character trigrams (hashed to a fixed number of
slots). A text is a mixture of languages over its words; the proportions come from
expectation-maximisation. The set of languages starts with the single most likely one
and takes in another as long as the likelihood, less a penalty of ``penalty * ln(words)``
for each language, grows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from .kernels import U, byte_set, runs, slices, text_bytes

SLOT_BITS = 17
#: More languages than this are refused: their tables are sent to every task (1 MB each).
MOST_LANGUAGES = 200
LETTERS = byte_set((97, 122), (128, 255))
NO_LANGUAGE = "und"


def trigram_slots(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigram slots of all letters of lower-cased texts, word heads in them, row of each word, letters per row."""
    data, offsets = text_bytes(pc.utf8_lower(column.cast(pa.large_string())))
    inside = LETTERS[data]
    starts, ends = runs(inside, offsets)
    left, right = np.empty_like(data), np.empty_like(data)
    left[1:], right[:-1] = data[:-1], data[1:]
    left[starts], right[ends - 1] = 32, 32
    at = np.flatnonzero(inside)
    codes = (left[at].astype(U) << U(16)) | (data[at].astype(U) << U(8)) | right[at].astype(U)
    slots = ((codes * U(0x9E3779B97F4A7C15)) >> U(64 - SLOT_BITS)).astype(np.int64)
    heads = np.concatenate([[0], np.cumsum(ends - starts)])[:-1]
    return slots, heads, np.searchsorted(offsets, starts, "right") - 1, ends - starts


def trigram_counts(docs: DataFrame) -> DataFrame:
    """``lang, slot, n`` over ``docs(text, lang)``; counted in each task, then added up."""

    def run(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for piece in slices(batch, "text"):
                slots, heads, rows, sizes = trigram_slots(piece.column("text"))
                langs = piece.column("lang").dictionary_encode()
                of = np.repeat(langs.indices.to_numpy()[rows], sizes) if len(rows) else np.zeros(0, int)
                for k, lang in enumerate(langs.dictionary.to_pylist()):
                    totals[lang] = totals.get(lang, 0) + np.bincount(slots[of == k], minlength=1 << SLOT_BITS)
        for lang, counts in totals.items():
            slot = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(slot), pa.string()), "slot": pa.array(slot, pa.int32()), "n": pa.array(counts[slot], pa.int64())})

    return docs.select("text", "lang").mapInArrow(run, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))


def fit_languages(docs: DataFrame, smooth: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Names, and log probabilities (slots x languages), learnt from the rows with a language."""
    counts = trigram_counts(docs.filter("lang is not null")).toPandas()
    names = sorted(counts["lang"].unique().tolist())
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"{len(names)} languages; their tables would be sent to every task, which is bounded at {MOST_LANGUAGES}.")
    table = np.zeros((1 << SLOT_BITS, len(names)))
    for k, name in enumerate(names):
        own = counts[counts["lang"] == name]
        table[own["slot"].to_numpy(), k] = own["n"].to_numpy()
    used = max(1, int((table.sum(axis=1) > 0).sum()))
    return names, np.log((table + smooth) / (table.sum(axis=0) + smooth * used)).astype(np.float32)


def mixtures(words: np.ndarray, rows: np.ndarray, n_rows: int, penalty: float = 1.0, rounds: int = 10) -> np.ndarray:
    """Language proportions (rows x languages) from log likelihoods of words; rows ascend."""
    n_lang = words.shape[1]
    share = np.zeros((n_rows, n_lang))
    if not len(words) or not n_lang:
        return share
    counts = np.bincount(rows, minlength=n_rows)
    filled = np.flatnonzero(counts)
    heads = np.searchsorted(rows, filled)
    top = words.max(axis=1, keepdims=True)
    like = np.exp(words - top).astype(np.float64)
    single = np.add.reduceat(words - top, heads, axis=0)
    best = single.argmax(axis=1)
    value = single[np.arange(len(filled)), best]
    share[filled, best] = 1.0
    open_docs = np.arange(len(filled))  # numbers in ``filled``
    chosen = np.zeros((len(filled), n_lang), bool)
    chosen[np.arange(len(filled)), best] = True
    for _ in range(n_lang - 1):
        if not len(open_docs):
            break
        sizes = counts[filled[open_docs]]
        index = np.repeat(heads[open_docs] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum()))
        own = like[index]
        starts = np.cumsum(sizes) - sizes
        of = np.repeat(np.arange(len(open_docs)), sizes)
        mixed = np.maximum((own * share[filled[open_docs]][of]).sum(axis=1), 1e-300)
        pull = np.add.reduceat(own / mixed[:, None], starts, axis=0) / sizes[:, None]
        pull[chosen[open_docs]] = 0
        added = pull.argmax(axis=1)
        useful = pull[np.arange(len(open_docs)), added] > 1  # else the likelihood only falls
        if not useful.any():
            break
        words_of = useful[of]
        open_docs, added, sizes = open_docs[useful], added[useful], sizes[useful]
        own = own[words_of]
        starts = np.cumsum(sizes) - sizes
        of = np.repeat(np.arange(len(open_docs)), sizes)
        trial = share[filled[open_docs]] * 0.8
        trial[np.arange(len(open_docs)), added] = 0.2
        for _ in range(rounds):
            part = own * trial[of]
            part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-300)
            trial = np.add.reduceat(part, starts, axis=0) / sizes[:, None]
        reached = np.add.reduceat(np.log(np.maximum((own * trial[of]).sum(axis=1), 1e-300)), starts)
        better = reached - penalty * np.log(np.maximum(sizes, 2)) > value[open_docs]
        open_docs, added = open_docs[better], added[better]
        value[open_docs] = reached[better] - penalty * np.log(np.maximum(sizes[better], 2))
        share[filled[open_docs]] = trial[better]
        chosen[open_docs, added] = True
    return share


def identify(docs: DataFrame, train: DataFrame, penalty: float = 1.0) -> DataFrame:
    """All columns of ``docs`` with ``lang_pred``, ``score`` and ``languages`` of every whole text.

    ``train`` gives ``text`` and ``lang``; rows with a null language or text teach nothing.
    ``lang_pred`` is the language of the largest proportion (the first by name of equal ones),
    ``score`` that proportion, ``languages`` all that were selected, by name. Null and
    empty texts and texts without a letter are ``und`` with score 0, and so is everything
    if nothing can be learnt. Rows are judged one by one, whatever their id. Columns with the
    names of the results are replaced.
    """
    names, table = fit_languages(train)
    kept = docs.drop("lang_pred", "score", "languages")
    part = StructType([StructField("lang", StringType()), StructField("share", DoubleType())])
    schema = StructType([*kept.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("languages", ArrayType(part))])
    shared = docs.sparkSession.sparkContext.broadcast((names, table))

    def run(batches):
        names, table = shared.value
        for batch in batches:
            for piece in slices(batch, "text", 1 << 20 if len(names) > 16 else 4 << 20):
                n = piece.num_rows
                share = np.zeros((n, len(names)))
                if names:
                    slots, heads, rows, _ = trigram_slots(piece.column("text"))
                    words = np.add.reduceat(table[slots], heads, axis=0) if len(heads) else np.zeros((0, len(names)))
                    share = mixtures(words, rows, n, penalty)
                    plain = np.zeros(n, bool)
                    plain[rows] = True
                    for k in np.flatnonzero(plain).tolist():
                        text = piece.column("text")[k].as_py()
                        if not any(c.isalpha() for c in (text if len(text) < 200 else text[:200])) and not any(map(str.isalpha, text)):
                            share[k] = 0  # marks and signs beyond ASCII only
                best = share.argmax(axis=1) if names else np.zeros(n, int)
                score = share[np.arange(n), best] if names else np.zeros(n)
                label = [names[b] if s > 0 else NO_LANGUAGE for b, s in zip(best.tolist(), score.tolist(), strict=True)]
                found = [[{"lang": names[k], "share": float(row[k])} for k in np.flatnonzero(row > 0)] for row in share]
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns, pa.array(label, pa.string()), pa.array(np.minimum(score, 1.0)), pa.array(found, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))],
                    names=[*piece.schema.names, "lang_pred", "score", "languages"],
                )

    return kept.mapInArrow(run, schema)

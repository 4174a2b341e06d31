"""Katz backoff language model over words: bigrams, unigrams, unknown words.

Counts are kept in tables partitioned by n-gram hash (see ``exchange``) and never meet in
one place. Every document chunk asks for the counts of its own distinct n-grams, and the
owner of an n-gram (the first chunk that trains on it) reports it to the table of its
history, which yields exactly normalised backoff weights:

    p(w | h) = c*(h w) / c(h)            if h w occurs in training
             = alpha(h) p(w)             otherwise
    alpha(h) = (1 - sum c*(h w) / c(h)) / (1 - sum p(w)),  both sums over words seen after h
    p(w)     = c*(w) / N, and an unknown word has what is left of 1

``c*`` is the Good-Turing discounted count for counts of at most ``top``. Larger counts give
up the same absolute amount as count ``top``, so that a history with frequent
continuations only keeps some backoff weight. Where the raw counts of counts give a discount
outside 0 to 1, as they do in corpora with many copies, they are smoothed by a straight
line in logarithms (simple Good-Turing); if that is not usable either, all counts of
that order give up ``n1 / (n1 + 2 n2)``, or a half if there is no such number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import ROWS, bucket_of, chunked, groups_of, in_order, pack, pack_keys, read_keys, rows_table, spread, unpack
from .kernels import U, distinct_keys, mix, ngram_hashes, row_sums, words_of

#: Kinds of packed rows: words, bigrams, what a chunk keeps for itself, reports and questions about histories.
WORD, BIGRAM, OWN, REPORT, QUESTION = range(5)
START, END = (mix(np.array([k], U))[0] for k in (0x5354415254, 0x454E44))
TOP = 5
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def discounts(counts: list[int], top: int = TOP) -> np.ndarray:
    """What counts 1..top give up, from the numbers of n-grams seen 1..top+1 times.

    The last entry also holds for all larger counts.
    """
    n = np.asarray(counts[: top + 1], float)
    r = np.arange(1, top + 2)
    raw = _turing(n, top) if (n > 0).all() else None
    if raw is None and (n > 0).sum() > 1:
        slope, level = np.polyfit(np.log(r[n > 0]), np.log(n[n > 0]), 1)
        raw = _turing(np.exp(level + slope * np.log(r)), top)
    if raw is not None:
        return r[:-1] * (1 - raw)
    return np.full(top, n[0] / (n[0] + 2 * n[1]) if n[0] > 0 and n[1] > 0 else 0.5)


def _turing(n: np.ndarray, top: int) -> np.ndarray | None:
    """Katz's discount ratios of counts 1..top, or None unless all lie between 0 and 1."""
    r = np.arange(1, top + 1)
    cut = (top + 1) * n[top] / n[0]
    if cut >= 1:
        return None
    kept = ((r + 1) * n[1:] / n[:-1] / r - cut) / (1 - cut)
    return kept if ((kept > 0) & (kept < 1)).all() else None


def starred(counts: np.ndarray, lost: np.ndarray) -> np.ndarray:
    return counts - lost[np.minimum(counts, len(lost)).astype(np.int64) - 1]


def _read(table: pa.Table):
    """Token stream of a chunk: per row START, words, END. Returns per-token arrays."""
    table = in_order(table)
    words = words_of(table["text"], lower=True)
    n = words.counts
    bounds = np.concatenate([[0], np.cumsum(n + 2)])
    tokens = np.empty(int(bounds[-1]), U)
    tokens[bounds[:-1]] = START
    tokens[bounds[1:] - 1] = END
    rows = words.rows
    tokens[words.positions + bounds[rows] + 1] = words.hashes()
    train = np.repeat(~table["held_out"].to_numpy().astype(bool), n + 2)
    first = np.ones(len(tokens), bool)
    first[bounds[:-1]] = False  # START is no token, only a history
    after = np.flatnonzero(first)  # the tokens; the history of each is the one before
    pairs = ngram_hashes(tokens, 2)[after - 1]
    return table, tokens, train, after, pairs, bounds


def _distinct(keys: np.ndarray, train: np.ndarray):
    distinct, _, inverse = distinct_keys(keys)
    return distinct, inverse, np.bincount(inverse, train, len(distinct)).astype(np.uint32)


def katz_scores(docs: DataFrame, held_out: str = "false", key: str = "doc_id", text: str = "text", top: int = TOP) -> DataFrame:
    """log10 probability of every text under a Katz model trained on the rows not held out.

    ``held_out`` is an SQL condition on ``docs``. Letters A-Z are lower-cased; the tokens
    are the words ``[^\\x20\\x09-\\x0D]+`` and one end token. ``base_score`` is the
    add-0.1 unigram score. Null and empty texts consist of the end token. Rows without
    an id, rows that share one and equal rows are scored and counted each for itself. With
    no training rows every word is unknown with probability 1 (``score`` 0). Other
    columns are ignored.
    """
    chunks, buckets = spread(docs, text)
    texts = chunked(docs, chunks, key, text, held_out=F.coalesce(F.expr(held_out), F.lit(False)))

    def count(table: pa.Table) -> pa.Table:
        chunk = table["chunk"][0].as_py()
        _, tokens, train, after, pairs, _ = _read(table)
        rows = []
        for kind, keys, flags in ((WORD, tokens, train), (BIGRAM, pairs, train[after])):
            distinct, _, counts = _distinct(keys, flags)
            for b, part in groups_of(bucket_of(distinct, buckets), buckets):
                rows.append((b, chunk, kind, pack(*pack_keys(distinct[part]), _narrow(counts[part]))))
        return rows_table(rows)

    def total(table: pa.Table) -> pa.Table:
        """Corpus counts of the keys of a bucket, with the owner of each bigram; and the counts of counts."""
        rows, summary = [], np.zeros(2 * (top + 1) + 3, np.int64)
        for kind in (WORD, BIGRAM):
            own = table.filter(pc.equal(table["kind"], kind)).sort_by("chunk")
            sent = [unpack(p) for p in own["payload"].to_pylist()]
            if not sent:
                continue
            keys = np.concatenate([read_keys(*s[:3]) for s in sent])
            counts = np.concatenate([s[3].astype(np.int64) for s in sent])
            distinct, _, inverse = distinct_keys(keys)
            totals = np.bincount(inverse, counts, len(distinct)).astype(np.int64)
            bucket = own["bucket"][0].as_py()
            real = np.ones(len(distinct), bool)
            if kind == WORD and bucket_of(np.array([START], U), buckets)[0] == bucket:
                real = distinct != START >> U(8)
                summary[-1] += totals[~real].sum()
            at = kind * (top + 1)
            summary[at : at + top + 1] += np.bincount(np.minimum(totals[real], top + 2), minlength=top + 3)[1 : top + 2]
            if kind == WORD:
                summary[-3] += totals[real].sum()
                summary[-2] += (totals[real] > 0).sum()
            owner = np.zeros(len(keys), bool)
            trained = np.flatnonzero(counts > 0)
            owner[trained[distinct_keys(inverse[trained])[1]]] = True
            at = 0
            for chunk, s in zip(own["chunk"].to_pylist(), sent, strict=True):
                part = slice(at, at + len(s[3]))
                rows.append((bucket, chunk, kind, pack(_narrow(totals[inverse[part]]), np.packbits(owner[part]))))
                at = part.stop
        rows.append((table["bucket"][0].as_py(), -1, OWN, b""))
        out = rows_table(rows)
        sums = [None] * (len(rows) - 1) + [summary.tolist()]
        return out.append_column("summary", pa.array(sums, pa.list_(pa.int64())))

    def weigh(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return rows_table([])
        chunk = table["chunk"][0].as_py()
        summary = answers["summary"][0].as_py()
        n_train, n_types = summary[-3], summary[-2]
        lost1, lost2 = discounts(summary[: top + 1], top), discounts(summary[top + 1 : 2 * top + 2], top)
        table, tokens, train, after, pairs, bounds = _read(table)
        words, word_of, _ = _distinct(tokens, train)
        bigrams, example, bigram_of = distinct_keys(pairs)
        c1, _ = _counts(answers, WORD, words, buckets)
        c2, owner = _counts(answers, BIGRAM, bigrams, buckets)
        p1, _ = unigrams(c1, summary, lost1, top)
        history, token = word_of[after - 1], word_of[after]
        # reports: what each owned bigram takes from its history
        seen = np.flatnonzero(owner)
        h, w = history[example[seen]], token[example[seen]]
        taken = np.bincount(h, starred(c2[seen], lost2), len(words)) if len(seen) else np.zeros(len(words))
        lower = np.bincount(h, p1[w], len(words)) if len(seen) else np.zeros(len(words))
        reported = np.flatnonzero(taken > 0)
        # scores that need no backoff weight, and the questions of those that do
        found = c2[bigram_of]
        value = np.log10(p1[token])
        hit = found > 0
        value[hit] = np.log10(starred(found[hit], lost2) / c1[history[hit]])
        backs = np.flatnonzero(~hit & (c1[history] > 0))
        asked, asked_of = np.unique(history[backs], return_inverse=True)
        row_of = np.repeat(np.arange(table.num_rows), np.diff(bounds) - 1)
        ends = np.concatenate([[0], np.cumsum(np.diff(bounds) - 1)])
        known = c1[token] > 0
        base = np.log10((np.where(known, c1[token], 0) + 0.1) / (n_train + 0.1 * (n_types + 1)))
        own = pack(
            table["doc_id"].is_null().to_numpy(),
            table["doc_id"].fill_null(0).to_numpy().astype(np.int64), table["held_out"].to_numpy().astype(bool),
            np.diff(ends), row_sums(known.astype(np.int64), ends), row_sums(base, ends), row_sums(value, ends),
            row_of[backs].astype(np.uint32), asked_of.astype(np.uint32), c1[asked].astype(np.int64), words[asked], np.array([n_train]),
        )
        rows = [(chunk % buckets, chunk, OWN, own)]
        for b, part in groups_of(bucket_of(words[reported], buckets), buckets):
            mine = reported[part]
            rows.append((b, chunk, REPORT, pack(*pack_keys(words[mine]), taken[mine], lower[mine])))
        for b, part in groups_of(bucket_of(words[asked], buckets), buckets):
            rows.append((b, chunk, QUESTION, pack(*pack_keys(words[asked[part]]))))
        return rows_table(rows)

    def answer(table: pa.Table) -> pa.Table:
        own = table.filter(pc.equal(table["kind"], OWN))
        reports = table.filter(pc.equal(table["kind"], REPORT)).sort_by("chunk")  # one order of adding: equal results each time
        questions = table.filter(pc.equal(table["kind"], QUESTION))
        sent = [unpack(p) for p in reports["payload"].to_pylist()]
        keys = np.concatenate([read_keys(*s[:3]) for s in sent]) if sent else np.zeros(0, U)
        distinct, inverse = np.unique(keys, return_inverse=True)
        taken, lower = (np.bincount(inverse, np.concatenate([s[k] for s in sent]), len(distinct)) if sent else np.zeros(0) for k in (3, 4))
        rows = []
        for chunk, bucket, payload in zip(questions["chunk"].to_pylist(), questions["bucket"].to_pylist(), questions["payload"].to_pylist(), strict=True):
            at = np.searchsorted(distinct, read_keys(*unpack(payload)))
            rows.append((bucket, chunk, QUESTION, pack(taken[at], lower[at])))
        return pa.concat_tables([own, rows_table(rows)])

    def finish(table: pa.Table) -> pa.Table:
        own = unpack(table.filter(pc.equal(table["kind"], OWN))["payload"][0].as_py())
        null, ids, held, n, known, base, value, rows, asked_of, totals, words, n_train = own
        answers = table.filter(pc.equal(table["kind"], QUESTION))
        by = {b: unpack(p) for b, p in zip(answers["bucket"].to_pylist(), answers["payload"].to_pylist(), strict=True)}
        weight = np.zeros(len(words))
        for b, part in groups_of(bucket_of(words, buckets), buckets):
            taken, lower = by[b]
            weight[part] = np.log10((1 - taken / totals[part]) / (1 - lower))
        score = value + (np.bincount(rows, weight[asked_of], len(ids)) if len(rows) else 0)
        return pa.table({
            "doc_id": pa.array(ids, pa.int64(), mask=null.astype(bool)), "held_out": pa.array(held.astype(bool)), "n_tokens": pa.array(n, pa.int64()),
            "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array(np.full(len(ids), n_train[0]), pa.int64()),
            "base_score": pa.array(base), "score": pa.array(score),
        })

    counted = texts.groupBy("chunk").applyInArrow(count, ROWS).groupBy("bucket").applyInArrow(total, ROWS + ", summary array<long>")
    size = 2 * (top + 1) + 3
    corpus = counted.filter("chunk = -1").agg(F.array(*[F.coalesce(F.sum(F.col("summary")[k]), F.lit(0)) for k in range(size)]).alias("s"))
    answers = counted.filter("chunk >= 0").select("bucket", "chunk", "kind", "payload", corpus.scalar().alias("summary"))
    asked = texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(weigh, ROWS)
    return asked.groupBy("bucket").applyInArrow(answer, ROWS).groupBy("chunk").applyInArrow(finish, RESULT)


def unigrams(counts: np.ndarray, summary: list[int], lost: np.ndarray, top: int) -> tuple[np.ndarray, float]:
    """Probabilities of words with the given corpus counts, and that of an unknown word."""
    n, types = summary[-3], summary[-2]
    if n == 0:
        return np.ones(len(counts)), 1.0
    small = np.asarray(summary[:top], float)
    unknown = float((small @ lost + (types - small.sum()) * lost[-1]) / n)
    out = np.full(len(counts), unknown)
    seen = counts > 0
    out[seen] = starred(counts[seen], lost) / n
    return out, unknown


def _narrow(counts: np.ndarray) -> np.ndarray:
    most = int(counts.max()) if len(counts) else 0
    return counts.astype(np.uint8 if most < 256 else np.uint32 if most < 1 << 32 else np.int64)


def _counts(answers: pa.Table, kind: int, keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    own = answers.filter(pc.equal(answers["kind"], kind))
    by = {b: unpack(p) for b, p in zip(own["bucket"].to_pylist(), own["payload"].to_pylist(), strict=True)}
    counts, owner = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    for b, part in groups_of(bucket_of(keys, buckets), buckets):
        c, o = by[b]
        counts[part] = c
        owner[part] = np.unpackbits(o, count=len(c))
    return counts, owner

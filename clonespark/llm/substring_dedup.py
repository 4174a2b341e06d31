"""Substring dedup with fixed-block anchors.

Reference blocks are the non-overlapping blocks of ``block`` words of every document.
Every rolling window of ``block`` words probes them. A repeat of ``2 * block`` words or
more contains a whole reference block of its earlier occurrence wherever that begins, so
only words near a hit can belong to a repeat: windows of ``window`` words around hits are
compared exactly (by a 64-bit hash next to the bucket number), the earliest one is found
over the corpus, and consecutive later ones are joined to maximal exact repeats.

Blocks, probes and windows travel as packed rows (see ``exchange``): a chunk names each
distinct key once, so no group of copies meets in one task and no pairs are made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame

from .exchange import ROWS, bucket_of, chunked, groups_of, in_order, pack, rows_table, spread, unpack
from .kernels import covered, distinct_keys, ngram_hashes, row_sums, window_starts, words_of

#: A document without an id counts as the last one.
LAST = np.iinfo(np.int64).max

RESULT = "doc_id long, n_words long, n_removed long, repeats array<struct<start:long,end:long>>, kept_text string"


def _read(table: pa.Table, block: int):
    """Sorted rows, their words, and the distinct rolling windows of ``block`` words with their places."""
    table = in_order(table)
    words = words_of(table["text"])
    hashes = words.hashes()
    at = np.flatnonzero(window_starts(words.first, block))
    keys, _, which = distinct_keys(ngram_hashes(hashes, block)[at])
    return table, words, hashes, at, keys, which


def _ids(table: pa.Table) -> np.ndarray:
    return table["doc_id"].fill_null(LAST).to_numpy().astype(np.int64)


def _windows(words, hashes: np.ndarray, at: np.ndarray, hits: np.ndarray, block: int, window: int):
    """Windows that hold a hit: their starts, the keys, and per distinct key its first window."""
    found = np.zeros(len(hashes) + 1, np.int32)
    found[at + 1] = hits
    total = np.cumsum(found)
    starts = np.flatnonzero(window_starts(words.first, window))
    starts = starts[total[starts + window - block + 1] > total[starts]]
    keys = ngram_hashes(hashes, window, seed=5)[starts]
    return starts, *distinct_keys(keys)


def substring_dedup(docs: DataFrame, window: int = 20, block: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Remove every word covered by a window of ``window`` words that also starts earlier.

    Earlier means a smaller id, or the same id and an earlier start; windows are judged
    on the input. Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. One row per input row:
    ``doc_id, n_words, n_removed, repeats`` (maximal runs of removed words, end
    exclusive) and ``kept_text`` (kept words joined by one space).

    Null and empty texts have no words, no repeats and an empty kept text. Rows without
    an id count as the last document. Rows that share an id are one document for the
    order: equal windows at the same place do not remove each other. Other columns of
    ``docs`` are ignored. Needs ``2 * block - 1 <= window``.
    """
    if 2 * block - 1 > window:
        raise ValueError("a window must hold a whole reference block wherever it begins")
    chunks, buckets = spread(docs, text)
    texts = chunked(docs, chunks, key, text)

    def probe(table: pa.Table) -> pa.Table:
        chunk = table["chunk"][0].as_py()
        _, words, _, at, keys, which = _read(table, block)
        counts = np.bincount(which, minlength=len(keys))
        reference = np.zeros(len(keys), bool)
        reference[which[words.positions[at] % block == 0]] = True
        rows = []
        for b, part in groups_of(bucket_of(keys, buckets), buckets):
            rows.append((b, chunk, 0, pack(keys[part].astype(np.uint32), np.packbits(counts[part] > 1), np.packbits(reference[part]))))
        return rows_table(rows)

    def anchors(table: pa.Table) -> pa.Table:
        """A window is an anchor hit if its words are a reference block and occur at another place."""
        sent = [unpack(p) for p in table["payload"].to_pylist()]
        sizes = [len(s[0]) for s in sent]
        keys = np.concatenate([s[0] for s in sent])
        twice = np.concatenate([np.unpackbits(s[1], count=n) for s, n in zip(sent, sizes, strict=True)])
        block_here = np.concatenate([np.unpackbits(s[2], count=n) for s, n in zip(sent, sizes, strict=True)])
        distinct, _, inverse = distinct_keys(keys)
        times = np.bincount(inverse, 1.0 + twice, len(distinct))
        hit = ((times > 1) & (np.bincount(inverse, block_here, len(distinct)) > 0))[inverse]
        return _answers(table, hit, sizes)

    def candidates(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return rows_table([])
        chunk = table["chunk"][0].as_py()
        table, words, hashes, at, keys, which = _read(table, block)
        hits = _bits(answers, keys, buckets)[which]
        starts, distinct, first, _ = _windows(words, hashes, at, hits, block, window)
        order = np.argsort(first, kind="stable")  # by document and place, which compresses best
        order = order[np.argsort(bucket_of(distinct[order], buckets), kind="stable")]
        places = starts[first[order]]
        ids, positions = _ids(table)[words.rows[places]], words.positions[places].astype(np.uint32)
        rows = [(chunk % buckets, chunk, 1, pack(np.packbits(hits), np.array([len(hits)])))]
        for b, part in groups_of(bucket_of(distinct[order], buckets), buckets):
            rows.append((b, chunk, 0, pack(distinct[order[part]], ids[part], positions[part])))
        return rows_table(rows)

    def earliest(table: pa.Table) -> pa.Table:
        """For each key of each chunk: does it start at an earlier place of another chunk?"""
        own = table.filter(pa.compute.equal(table["kind"], 1))
        table = table.filter(pa.compute.equal(table["kind"], 0))
        sent = [unpack(p) for p in table["payload"].to_pylist()]
        if not sent:
            return own
        keys, ids, positions = (np.concatenate([s[k] for s in sent]) for k in range(3))
        order = np.lexsort((positions, ids, keys))
        new = np.ones(len(keys), bool)
        new[1:] = keys[order[1:]] != keys[order[:-1]]
        lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        later = np.zeros(len(keys), bool)
        later[order] = (ids[lead] != ids[order]) | (positions[lead] != positions[order])
        return pa.concat_tables([own, _answers(table, later, [len(s[0]) for s in sent])])

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _result([], [], [], [], [])
        table = in_order(table)
        words = words_of(table["text"])
        hashes = words.hashes()
        at = np.flatnonzero(window_starts(words.first, block))
        own = answers.filter(pa.compute.equal(answers["kind"], 1))
        packed, n = unpack(own["payload"][0].as_py())
        hits = np.unpackbits(packed, count=int(n[0])).astype(bool)
        starts, distinct, first, inverse = _windows(words, hashes, at, hits, block, window)
        order = np.argsort(first, kind="stable")
        order = order[np.argsort(bucket_of(distinct[order], buckets), kind="stable")]
        later = np.zeros(len(distinct), bool)
        later[order] = _bits(answers.filter(pa.compute.equal(answers["kind"], 0)), distinct[order], buckets)
        ids = _ids(table)[words.rows[starts]] if len(starts) else np.zeros(0, np.int64)
        places = words.positions[starts] if len(starts) else np.zeros(0, np.int64)
        lead = first[inverse]
        repeat = later[inverse] | (ids[lead] != ids) | (places[lead] != places)
        gone = covered(starts[repeat], window, len(hashes))
        texts, spans = _kept(words, gone)
        return _result(table["doc_id"], words.counts, row_sums(gone.astype(np.int64), words.first), spans, texts)

    questions = texts.groupBy("chunk").applyInArrow(probe, ROWS)
    hits = questions.groupBy("bucket").applyInArrow(anchors, ROWS)
    asked = texts.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(candidates, ROWS)
    judged = asked.groupBy("bucket").applyInArrow(earliest, ROWS)
    return texts.groupBy("chunk").cogroup(judged.groupBy("chunk")).applyInArrow(remove, RESULT)


def _answers(table: pa.Table, flags: np.ndarray, sizes: list[int]) -> pa.Table:
    rows, at = [], 0
    for bucket, chunk, n in zip(table["bucket"].to_pylist(), table["chunk"].to_pylist(), sizes, strict=True):
        rows.append((bucket, chunk, 0, pack(np.packbits(flags[at : at + n]))))
        at += n
    return rows_table(rows)


def _bits(answers: pa.Table, keys: np.ndarray, buckets: int) -> np.ndarray:
    """The answered flags of ``keys`` (sorted by bucket, as they were sent)."""
    by = dict(zip(answers["bucket"].to_pylist(), answers["payload"].to_pylist(), strict=True))
    out = np.zeros(len(keys), bool)
    for b, part in groups_of(bucket_of(keys, buckets), buckets):
        out[part] = np.unpackbits(unpack(by[b])[0], count=part.stop - part.start)
    return out


def _kept(words, gone: np.ndarray) -> tuple[list[str], list[list[dict]]]:
    """Kept words of each row joined by a space, and the runs of removed words."""
    keep = np.flatnonzero(~gone)
    lengths = words.ends[keep] - words.starts[keep] + 1
    heads = np.concatenate([[0], np.cumsum(lengths)])
    out = np.full(int(heads[-1]), 32, np.uint8)
    for a in range(0, len(keep), 1 << 18):  # some words at a time: the index arrays are eight times the text
        b = min(len(keep), a + (1 << 18))
        size = lengths[a:b] - 1
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(heads[a:b], size) + within] = words.data[np.repeat(words.starts[keep[a:b]], size) + within]
    bounds = heads[np.searchsorted(keep, words.first)]
    flat = out.tobytes()
    texts = [flat[a : max(a, b - 1)].decode() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    spans: list[list[dict]] = [[] for _ in texts]
    edges = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    for begin, end in zip(begins.tolist(), ends.tolist(), strict=True):
        row = int(np.searchsorted(words.first, begin, "right")) - 1
        while begin < end:  # a run may go on into the next row
            stop = min(end, int(words.first[row + 1]))
            if stop > begin:
                spans[row].append({"start": begin - int(words.first[row]), "end": stop - int(words.first[row])})
            begin, row = max(begin, stop), row + 1
    return texts, spans


def _result(ids, n_words, n_removed, spans, texts) -> pa.Table:
    run = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else pa.array(ids, pa.int64())
    return pa.table({
        "doc_id": ids, "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
        "repeats": pa.array(spans, pa.list_(run)), "kept_text": pa.array(texts, pa.string()),
    })

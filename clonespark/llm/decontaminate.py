"""Benchmark decontamination over a distributed positional inverted index.

The index is partitioned by documents. A shard is a bounded number of words: its
distinct terms (hashes, sorted), the posting list of each (ascending places in the
shard), and a table of its rows. Places of different rows are apart by a gap, so a phrase
never runs over the end of a row. Shards are written to a table in the shared folder.

A test phrase is searched from its rarest term in the shard: that list, moved back by
the term's offset in the phrase, holds the only starts that can match, and the lists
of the other terms, moved by their offsets, are intersected from rare to frequent. All
phrases of a block of test items are intersected at once. Test items are read in blocks
of bounded size; the number of blocks grows with the benchmark, the size of one does not.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import NOT_ALNUM, U, slices, words_of
from .storage import stored

SHARD_TEXT = 1 << 20
#: Bytes of item text in one block, which is sent to every task.
BLOCK_TEXT = 8 << 20
INDEX = "shard string, rows array<long>, ids array<long>, counts array<long>, terms binary, bounds binary, places binary"
HITS = "row_id long, item string, starts array<long>, ends array<long>"


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shards of the positional index over all words of all rows.

    Rows are numbered here, so the numbers are only fixed once the index is written.
    """

    def index(batches):
        for batch in batches:
            for piece in slices(batch, "text", SHARD_TEXT):
                words = words_of(piece.column("text"), NOT_ALNUM, lower=True)
                hashes = words.hashes()
                places = (np.arange(len(hashes)) + words.rows).astype(np.uint32)  # one place between rows stays empty
                order = np.argsort(hashes, kind="stable")
                terms, bounds = np.unique(hashes[order], return_index=True)
                whole = pa.list_(pa.int64())
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array([uuid.uuid4().hex]),
                    "rows": pa.array([piece.column("row_id").to_pylist()], whole),
                    "ids": pa.array([piece.column("doc_id").to_pylist()], whole),
                    "counts": pa.array([words.counts], whole),
                    "terms": pa.array([terms.tobytes()]),
                    "bounds": pa.array([np.append(bounds, len(hashes)).astype(np.uint32).tobytes()]),
                    "places": pa.array([places[order].tobytes()]),
                })

    return docs.select(
        F.monotonically_increasing_id().alias("row_id"), F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")
    ).mapInArrow(index, INDEX)


class Shard:
    """One shard in memory: posting lists of terms, and where each row begins."""

    def __init__(self, record: dict):
        self.rows = record["rows"]
        self.counts = np.array(record["counts"], np.int64)
        self.terms = np.frombuffer(record["terms"], U)
        self.bounds = np.frombuffer(record["bounds"], np.uint32).astype(np.int64)
        self.places = np.frombuffer(record["places"], np.uint32).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts + 1)])
        self.span = int(self.first[-1]) + 1
        self.keys = np.repeat(np.arange(len(self.terms)), np.diff(self.bounds)) * self.span + self.places

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each term in this shard, -1 if it does not occur."""
        if not len(self.terms):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def frequency(self, numbers: np.ndarray) -> np.ndarray:
        return np.diff(self.bounds)[numbers]

    def postings(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(query, place)`` for all postings of the given terms."""
        sizes = self.frequency(numbers)
        query = np.repeat(np.arange(len(numbers)), sizes)
        within = np.arange(len(query)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return query, self.places[np.repeat(self.bounds[numbers], sizes) + within]

    def holds(self, numbers: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Does the term have a posting in ``low .. high``?"""
        base = numbers * self.span
        return np.searchsorted(self.keys, base + high, "right") > np.searchsorted(self.keys, base + low)


def phrase_hits(shard: Shard, phrases: np.ndarray, slop: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(phrase, first place, end place)`` of all matches of equally long phrases (one row of term hashes each).

    With ``slop`` a term may stand up to that many places beside its own, all within one row.
    """
    n, length = phrases.shape
    numbers = shard.numbers(phrases.ravel()).reshape(n, length)
    alive = np.flatnonzero((numbers >= 0).all(axis=1))
    if not len(alive):
        return (np.zeros(0, np.int64),) * 3
    numbers = numbers[alive]
    rare = np.argsort(shard.frequency(numbers), axis=1, kind="stable")
    query, place = shard.postings(numbers[np.arange(len(alive)), rare[:, 0]])
    start = place - rare[query, 0]
    row = np.searchsorted(shard.first, place, "right") - 1
    begin, end = shard.first[row], shard.first[row] + shard.counts[row] - 1
    for k in range(1, length):
        offset = rare[query, k]
        low, high = np.maximum(start + offset - slop, begin), np.minimum(start + offset + slop, end)
        keep = low <= high
        keep[keep] = shard.holds(numbers[query[keep], offset[keep]], low[keep], high[keep])
        query, start, begin, end = query[keep], start[keep], begin[keep], end[keep]
    return alive[query], np.clip(start, begin, end), np.clip(start + length - 1, begin, end) + 1


def search(index: DataFrame, items: list[tuple[str, np.ndarray]], window: int = 10, slop: int = 0) -> DataFrame:
    """Rows of an index that match a window of one of ``items`` (id, term hashes).

    One row per document row and item: ``row_id, item``, and the bounds ``starts, ends`` of
    the merged matches in words, ends exclusive.
    """
    queries: dict[int, tuple[list[np.ndarray], list[int]]] = {}
    for number, (_, terms) in enumerate(items):
        size = min(window, len(terms))
        if size:
            held, owner = queries.setdefault(size, ([], []))
            held.append(np.lib.stride_tricks.sliding_window_view(terms, size))
            owner.extend([number] * (len(terms) - size + 1))
    ready = {size: (np.concatenate(held), np.array(owner)) for size, (held, owner) in queries.items()}
    shared = index.sparkSession.sparkContext.broadcast((ready, [name for name, _ in items]))

    def match(batches):
        ready, names = shared.value
        for batch in batches:
            columns = [batch.column(k) for k in range(5)]
            for number in range(batch.num_rows):  # one shard at a time, over the batch's own buffers
                rows, counts, *lists = (column[number] for column in columns)
                shard = Shard(dict(zip(("rows", "counts", "terms", "bounds", "places"), (rows.values.to_numpy(), counts.values.to_numpy(), *(x.as_buffer() for x in lists)), strict=True)))
                parts = [(owner[p], a, b) for owner, (p, a, b) in ((owner, phrase_hits(shard, phrases, slop)) for phrases, owner in ready.values())]
                item, start, end = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(3))
                row = np.searchsorted(shard.first, start, "right") - 1
                order = np.lexsort((start, item, row))
                item, start, end, row = item[order], start[order], end[order], row[order]
                new = np.ones(len(item), bool)
                new[1:] = (item[1:] != item[:-1]) | (row[1:] != row[:-1])
                bounds = np.append(np.flatnonzero(new), len(item))
                out = {"row_id": [], "item": [], "starts": [], "ends": []}
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    base = shard.first[row[a]]
                    reach = np.maximum.accumulate(end[a:b])
                    fresh = np.append(True, start[a + 1 : b] > reach[:-1])
                    out["row_id"].append(shard.rows[row[a]])
                    out["item"].append(names[item[a]])
                    out["starts"].append(start[a:b][fresh] - base)
                    out["ends"].append(reach[np.append(np.flatnonzero(fresh)[1:] - 1, b - a - 1)] - base)
                whole = pa.list_(pa.int64())
                yield pa.RecordBatch.from_pydict({
                    "row_id": pa.array(out["row_id"], pa.int64()), "item": pa.array(out["item"], pa.string()),
                    "starts": pa.array(out["starts"], whole), "ends": pa.array(out["ends"], whole),
                })

    return index.select("rows", "counts", "terms", "bounds", "places").mapInArrow(match, HITS)


def item_blocks(benchmark: DataFrame, key: str = "item_id", text: str = "text", limit: int = BLOCK_TEXT):
    """Test items as ``(id, term hashes)``, some bytes of text at a time."""
    block, size = [], 0
    named = benchmark.select(F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("item"), F.col(text).alias("text"))
    for row in named.toLocalIterator(prefetchPartitions=False):
        block.append((row["item"], words_of(pa.array([row["text"]], pa.string()), NOT_ALNUM, lower=True).hashes()))
        size += len(row["text"] or "")
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, slop: int = 0) -> DataFrame:
    """Mark the words of ``docs`` inside an occurrence of a window of a benchmark item.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; a window is
    ``window`` consecutive words of one item, or the whole item if that has fewer words but
    at least one. With ``slop`` a word of the window may stand up to that many places
    beside its own, within the same text (proximity matches).

    Returns ``doc_id, n_words, n_hit`` (words inside matches), ``n_items``, ``items`` (ids of
    the matching items, sorted as strings), ``hits`` (merged spans of words, ends
    exclusive) and ``contaminated``; one row per input row, rows that share an id or have
    none included. Null and empty texts have no words; items without words match nothing;
    an item without an id is named ``null``; items of equal text all match, and rows that
    share an item id are one item. An empty benchmark marks nothing. Other columns are ignored.
    """
    index = stored(build_index(docs), "positional-index")
    found = index.sparkSession.createDataFrame([], HITS)
    for block in item_blocks(benchmark):
        found = found.unionByName(search(index, block, window, slop))
    spans = F.arrays_zip(F.flatten(F.collect_list("starts")).alias("start"), F.flatten(F.collect_list("ends")).alias("end"))
    grouped = found.groupBy("row_id").agg(F.array_sort(F.collect_set("item")).alias("items"), F.array_sort(spans).alias("spans"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach"), F.array().cast("array<struct<start:long,end:long>>").alias("hits"))

    def add(state, span):
        """Spans ascend; what lies before ``reach`` has been counted."""
        begin = F.greatest(span["start"], state["reach"])
        last = F.element_at(state["hits"], -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(span["end"], state["reach"]).alias("end"))
        touches = (F.size(state["hits"]) > 0) & (span["start"] <= state["reach"])
        hits = F.when(touches, F.concat(F.slice(state["hits"], 1, F.size(state["hits"]) - 1), F.array(joined))).otherwise(
            F.concat(state["hits"], F.array(F.struct(span["start"].alias("start"), span["end"].alias("end"))))
        )
        return F.struct(
            (state["n"] + F.greatest(span["end"] - begin, F.lit(0).cast("long"))).alias("n"),
            F.greatest(state["reach"], span["end"]).alias("reach"), hits.alias("hits"),
        )

    merged = grouped.select("row_id", "items", F.aggregate("spans", start, add).alias("m"))
    rows = index.select(F.explode(F.arrays_zip("rows", "ids", "counts")).alias("r")).select(
        F.col("r.rows").alias("row_id"), F.col("r.ids").alias("doc_id"), F.col("r.counts").alias("n_words")
    )
    none = F.array().cast("array<string>")
    return rows.join(merged, "row_id", "left").select(
        "doc_id", "n_words", F.coalesce(F.col("m.n"), F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"), F.coalesce("items", none).alias("items"),
        F.coalesce("m.hits", F.array().cast("array<struct<start:long,end:long>>")).alias("hits"),
        (F.coalesce(F.col("m.n"), F.lit(0)) > 0).alias("contaminated"),
    )

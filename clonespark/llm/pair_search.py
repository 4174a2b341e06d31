"""Ranked lexical search: MaxScore over bounds of term pairs.

The index is partitioned by documents. A shard holds a bounded number of bytes of text: its
terms (64-bit hashes, sorted), their posting lists and the length of each document. Queries
are searched in blocks of bounded size. For a block, one pass over the index writes its *pair index*:

* the posting lists of the block's terms with impacts, which are final since the document
  counts of all terms are known by then, and the largest impact of each list;
* for each pair of terms that belong together in a query the intersection of their lists, with
  the joint impact of each document and the largest of them.

A query's terms are paired by falling weight, so its pairs are disjoint. In a shard no document
can gain more from a pair than ``max(joint maximum, maximum of a, maximum of b)``, which is
less than the sum of both maxima wherever the two best documents differ and only one maximum
where the lists do not meet. Sums of these bounds decide which pairs are essential: a document
that has terms of the others alone cannot reach the result and is never looked at. Documents of
essential pairs are scored, and leave as soon as their score and the bounds still open stay below the
threshold.

Sums of joint impacts are lower bounds of scores, and those of the best documents of the
pair lists are the first threshold, known before any document is scored. All arithmetic of scores is in 64-bit integers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .exchange import pack, unpack
from .kernels import NOT_ALNUM, U, slices, words_of
from .storage import stored

SHARD_TEXT = 2 << 20
#: Distinct terms of all queries of one block (a query with more is a block by itself).
BLOCK_TERMS = 100_000
INDEX = "ids array<long>, vocabulary binary, postings binary, n_docs long, n_words long"
PAIRS = "ids array<long>, lists binary, pairs binary, query int, seeds array<long>"
FOUND = "nth int, doc_id long, score long"


def _narrow(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint16 if not len(values) or int(values.max()) < 1 << 16 else np.uint32)


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shards of the inverted index over all terms of all rows."""

    def index(batches):
        for batch in batches:
            for piece in slices(batch, "text", SHARD_TEXT):
                words = words_of(piece.column("text"), NOT_ALNUM, lower=True)
                hashes = words.hashes()
                order = np.argsort(hashes, kind="stable")
                hashes, rows = hashes[order], words.rows[order]
                new = np.ones(len(hashes), bool)
                new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
                heads = np.flatnonzero(new)
                times = np.diff(np.append(heads, len(hashes)))
                terms, bounds = np.unique(hashes[heads], return_index=True)
                sizes = words.counts
                yield pa.RecordBatch.from_pydict({
                    "ids": pa.array([piece.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    "vocabulary": pa.array([pack(terms, np.append(bounds, len(heads)).astype(np.uint32))], pa.binary()),
                    "postings": pa.array([pack(_narrow(rows[heads]), _narrow(times), sizes.astype(np.uint32))], pa.binary()),
                    "n_docs": pa.array([int((sizes > 0).sum())]), "n_words": pa.array([int(sizes.sum())]),
                })

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(index, INDEX)


def _payloads(batch: pa.RecordBatch, name: str):
    """The binary values of a column as arrays over the batch's own buffers."""
    for value in batch.column(name):
        yield unpack(value.as_buffer())


def _places(vocabulary: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``terms`` the shard has, and their places in its vocabulary."""
    if not len(vocabulary):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(vocabulary, terms), len(vocabulary) - 1)
    own = np.flatnonzero(vocabulary[at] == terms)
    return own, at[own]


def document_counts(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """Number of documents that hold each of the ascending ``terms``."""
    shared = index.sparkSession.sparkContext.broadcast(terms)

    def count(batches):
        total = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for vocabulary, bounds in _payloads(batch, "vocabulary"):
                own, at = _places(vocabulary, shared.value)
                total[own] += np.diff(bounds.astype(np.int64))[at]
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(found.astype(np.int32)), "n": pa.array(total[found])})

    out = np.zeros(len(terms), np.int64)
    for r in index.select("vocabulary").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    shared.destroy()
    return out


class Queries:
    """The queries of a block: terms, integer weights per query, and the pairs they form.

    ``terms`` ascend. Query ``q`` has the entries ``first[q]`` to ``first[q + 1]`` of ``pair``; a pair is two places in ``sides``,
    each a term with a weight, the second -1 where a term is left without a partner.
    """

    def __init__(self, terms: np.ndarray, queries: list[tuple[np.ndarray, np.ndarray]]):
        """``queries``: places in ``terms`` and the weight of each, repeats included."""
        self.terms = terms
        sides: dict[tuple[int, int], int] = {}
        pairs: dict[tuple[int, int], int] = {}
        pair, first = [], [0]
        for places, weights in queries:
            order = np.lexsort((places, -weights))
            order = order[weights[order] > 0]
            own = [sides.setdefault((int(places[k]), int(weights[k])), len(sides)) for k in order]
            for a, b in zip(own[::2], [*own[1::2], -1], strict=False):
                pair.append(pairs.setdefault((a, b), len(pairs)))
            first.append(len(pair))
        self.first, self.pair = np.array(first), np.array(pair, np.int64)
        self.term, self.weight = (np.array([s[k] for s in sides], np.int64) for k in (0, 1))
        self.a, self.b = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))

    def of(self, q: int) -> np.ndarray:
        return self.pair[self.first[q] : self.first[q + 1]]

    def __len__(self) -> int:
        return len(self.first) - 1


class Lists:
    """Posting lists with impacts of one shard, by place of the term in the block."""

    def __init__(self, own: np.ndarray, bounds: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_docs: int, n_terms: int):
        self.own, self.bounds, self.docs, self.impacts, self.n_docs = own, bounds.astype(np.int64), docs.astype(np.int64), impacts, n_docs
        self.at = np.full(n_terms + 1, len(own), np.int64)
        self.at[own] = np.arange(len(own))
        self.sizes = np.append(np.diff(self.bounds), 0)
        self.keys = np.repeat(np.arange(len(own)), self.sizes[:-1]) * n_docs + self.docs
        self.most = np.append(np.maximum.reduceat(impacts, self.bounds[:-1]) if len(own) else np.zeros(0), 0).astype(np.int64)

    def slice(self, term: int) -> slice:
        k = self.at[term]
        return slice(self.bounds[k], self.bounds[k] + self.sizes[k]) if k < len(self.own) else slice(0, 0)

    def find(self, lists: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Place of the posting of each document in the list with that number, -1 without one."""
        if not len(self.keys):
            return np.full(len(docs), -1)
        wanted = lists * self.n_docs + docs
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where((self.keys[at] == wanted) & (lists < len(self.own)), at, -1)


def intersections(lists: Lists, queries: Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(pair, bounds, document, joint impact)`` of the pairs whose lists meet in the shard."""
    both = np.flatnonzero(queries.b >= 0)
    a, b = queries.a[both], queries.b[both]
    at_a, at_b = lists.at[queries.term[a]], lists.at[queries.term[b]]
    present = (at_a < len(lists.own)) & (at_b < len(lists.own))
    both, a, b, at_a, at_b = both[present], a[present], b[present], at_a[present], at_b[present]
    swap = lists.sizes[at_a] > lists.sizes[at_b]  # the shorter list is looked up in the longer one
    a, b, at_a, at_b = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, at_b, at_a), np.where(swap, at_a, at_b)
    sizes = lists.sizes[at_a]
    pair = np.repeat(np.arange(len(both)), sizes)
    place = np.repeat(lists.bounds[at_a], sizes) + np.arange(len(pair)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    other = lists.find(at_b[pair], lists.docs[place])
    met = other >= 0
    pair, place, other = pair[met], place[met], other[met]
    joint = queries.weight[a][pair] * lists.impacts[place].astype(np.int64) + queries.weight[b][pair] * lists.impacts[other].astype(np.int64)
    held, begin = np.unique(pair, return_index=True)
    return both[held], np.append(begin, len(pair)), lists.docs[place], joint


def _runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places ``begin .. begin + size`` of all runs, behind one another."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def pair_index(index: DataFrame, shared, n: int, words: int, k: int) -> DataFrame:
    """One row per shard, and at the end of each task one per query with its ``k`` largest lower bounds of scores."""

    def build(batches):
        queries: Queries = shared.value
        best: list[np.ndarray] = [np.zeros(0, np.int64)] * len(queries)
        for batch in batches:
            ids = batch.column("ids")
            for row, ((vocabulary, bounds), (docs, times, sizes)) in enumerate(zip(_payloads(batch, "vocabulary"), _payloads(batch, "postings"), strict=True)):
                own, at = _places(vocabulary, queries.terms)
                bounds = bounds.astype(np.int64)
                count = bounds[at + 1] - bounds[at]
                place = _runs(bounds[at], count)
                docs, tf = docs[place].astype(np.int64), times[place].astype(np.int64)
                length = 75 + (25 * sizes.astype(np.int64) * n) // max(words, 1)
                impacts = ((1_000_000_000 * tf) // (1000 * tf + 12 * length[docs])).astype(np.uint32)
                lists = Lists(own, np.concatenate([[0], np.cumsum(count)]), docs, impacts, len(sizes), len(queries.terms))
                held, begin, met, joint = intersections(lists, queries)
                most = np.maximum.reduceat(joint, begin[:-1]) if len(held) else joint
                at_pair = np.full(len(queries.a) + 1, -1)
                at_pair[held] = np.arange(len(held))
                for q in range(len(queries)):
                    mine = at_pair[queries.of(q)]
                    mine = mine[mine >= 0]
                    if len(mine):
                        got = _runs(begin[mine], begin[mine + 1] - begin[mine])
                        low = np.zeros(len(sizes), np.int64)
                        np.add.at(low, met[got], joint[got])
                        low = np.concatenate([best[q], low[low > 0]])
                        best[q] = np.partition(low, len(low) - k)[-k:] if len(low) > k else low
                yield pa.RecordBatch.from_pydict({
                    "ids": ids.slice(row, 1),
                    "lists": pa.array([pack(own.astype(np.int32), lists.bounds.astype(np.uint32), _narrow(docs), impacts, np.array([len(sizes)]))], pa.binary()),
                    "pairs": pa.array([pack(held.astype(np.int32), most)], pa.binary()),
                    "query": pa.array([None], pa.int32()), "seeds": pa.array([None], pa.list_(pa.int64())),
                })
        some = [q for q in range(len(queries)) if len(best[q])]
        yield pa.RecordBatch.from_pydict({
            "ids": pa.array([None] * len(some), pa.list_(pa.int64())), "lists": pa.array([None] * len(some), pa.binary()), "pairs": pa.array([None] * len(some), pa.binary()),
            "query": pa.array(some, pa.int32()), "seeds": pa.array([best[q].tolist() for q in some], pa.list_(pa.int64())),
        })

    return index.select("ids", "vocabulary", "postings").mapInArrow(build, PAIRS)


def _first_thresholds(built: DataFrame, n_queries: int, k: int) -> np.ndarray:
    """The ``k``-th largest lower bound of each query over all documents, or 1."""
    rows = built.filter("query is not null").select("query", F.explode("seeds").alias("low"))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("low")))).filter(F.col("nth") <= k)
    out = np.ones(n_queries, np.int64)
    for r in rows.filter(F.col("nth") == k).collect():
        out[r["query"]] = max(r["low"], 1)
    return out


def reach(lists: Lists, queries: Queries, pairs: np.ndarray, joint: np.ndarray) -> np.ndarray:
    """The most a document can gain from each pair: from both terms together, or from one alone."""
    a, b = queries.a[pairs], queries.b[pairs]
    alone_a = queries.weight[a] * lists.most[lists.at[queries.term[a]]]
    alone_b = np.where(b >= 0, queries.weight[b] * lists.most[lists.at[queries.term[b]]], 0)
    return np.maximum(np.maximum(alone_a, alone_b), joint[pairs])


def evaluate(lists: Lists, queries: Queries, q: int, joint: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of the shard that score ``threshold`` or more, and their scores.

    ``joint`` has the joint maximum of every pair, 0 where the lists do not meet.
    """
    none = np.zeros(0, np.int64)
    pairs = queries.of(q)
    bound = reach(lists, queries, pairs, joint)
    order = np.argsort(bound, kind="stable")
    pairs, bound = pairs[order], bound[order]
    open_to = np.cumsum(bound)
    if not len(pairs) or open_to[-1] < threshold:
        return none, none
    essential = int(np.searchsorted(open_to, threshold))  # pairs before it cannot reach the threshold together
    score = np.zeros(lists.n_docs, np.int64)
    for p in pairs[essential:]:
        for side in (queries.a[p], queries.b[p]):
            if side >= 0:
                part = lists.slice(queries.term[side])
                score[lists.docs[part]] += queries.weight[side] * lists.impacts[part].astype(np.int64)
    alive = np.flatnonzero(score)
    score = score[alive]
    for nth in range(essential - 1, -1, -1):
        keep = score + open_to[nth] >= threshold
        alive, score = alive[keep], score[keep]
        if not len(alive):
            return none, none
        for side in (queries.a[pairs[nth]], queries.b[pairs[nth]]):
            if side >= 0:
                at = lists.find(np.full(len(alive), lists.at[queries.term[side]]), alive)
                score = score + np.where(at >= 0, queries.weight[side] * lists.impacts[np.maximum(at, 0)].astype(np.int64), 0)
    keep = score >= threshold
    return alive[keep], score[keep]


def best_of(built: DataFrame, shared, thresholds: np.ndarray, k: int) -> DataFrame:
    """The best ``k`` documents of each task for each query, none of them below the first threshold."""

    def find(batches):
        queries: Queries = shared.value
        floor = thresholds.copy()
        best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 3] * len(queries)
        for batch in batches:
            ids = batch.column("ids")
            rows = zip(_payloads(batch, "lists"), _payloads(batch, "pairs"), strict=True)
            for row, ((own, bounds, docs, impacts, n_docs), (held, most)) in enumerate(rows):
                lists = Lists(own, bounds, docs, impacts, int(n_docs[0]), len(queries.terms))
                joint = np.zeros(len(queries.a), np.int64)
                joint[held] = most
                named = ids[row].values
                missing = named.is_null().to_numpy(zero_copy_only=False)
                named = named.fill_null(0).to_numpy(zero_copy_only=False)
                for q in range(len(queries)):
                    docs_q, score = evaluate(lists, queries, q, joint, int(floor[q]))
                    if not len(docs_q):
                        continue
                    score, doc, lost = (np.concatenate(x) for x in zip(best[q], (score, named[docs_q], missing[docs_q].astype(np.int64)), strict=True))
                    order = np.lexsort((doc, lost, -score))[:k]
                    best[q] = score[order], doc[order], lost[order]
                    if len(order) == k:
                        floor[q] = max(floor[q], score[order[-1]])
        for q, (score, doc, lost) in enumerate(best):
            if len(score):
                yield pa.RecordBatch.from_pydict({
                    "nth": pa.array(np.full(len(score), q, np.int32)), "doc_id": pa.array(doc, mask=lost > 0), "score": pa.array(score),
                })

    return built.filter("lists is not null").select("ids", "lists", "pairs").mapInArrow(find, FOUND)


def query_terms(items: DataFrame, key: str, text: str) -> tuple[DataFrame, int]:
    """``(item_id, block, nth, terms, times)``: the distinct terms of each query and how often it has them.

    Rows that share an id, those without one included, are one query. Blocks hold whole
    queries; their number comes with them.
    """

    def split(batches):
        for batch in batches:
            for piece in slices(batch, "text"):
                words = words_of(piece.column("text"), NOT_ALNUM, lower=True)
                yield pa.RecordBatch.from_arrays([piece.column("item_id").take(pa.array(words.rows)), pa.array(words.hashes().view(np.int64))], names=["item_id", "term"])

    kind = items.schema[key].dataType.simpleString()
    words = items.select(F.col(key).alias("item_id"), F.col(text).cast("string").alias("text")).mapInArrow(split, f"item_id {kind}, term long")
    each = words.groupBy("item_id", "term").count().groupBy("item_id").agg(F.collect_list(F.struct("term", "count")).alias("t"))
    each = each.select("item_id", F.col("t.term").alias("terms"), F.col("t.count").alias("times"))
    each = stored(each, "query-terms")
    total = each.agg(F.sum(F.size("terms")).alias("n")).first()["n"] or 0
    blocks = -(-total // BLOCK_TERMS)
    each = each.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(max(1, blocks))).cast("int"))
    nth = F.row_number().over(Window.partitionBy("block").orderBy("item_id")) - 1
    return stored(each.withColumn("nth", nth.cast("int")), "query-blocks"), blocks


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """The ``k`` documents that score highest for each item: ``item_id, rank, doc_id, score``.

    Terms are the maximal runs of letters, digits and characters beyond ASCII, with A-Z lower-cased. N documents have a term, L terms
    with repeats in all, ``n`` in one document. A term that ``df`` documents hold has the weight
    ``floor(1000 ln((2 N + 2) / (2 df + 1)))``; a document that holds it ``tf`` times gains the weight times
    ``(10^9 tf) div (1000 tf + 12 m)`` with ``m = 75 + (25 n N) div L``, for each time that the item has the term.

    Only scores above 0 are returned; equal scores stand by ascending ``doc_id``, those without an id last. Each row of
    ``docs`` is a document of its own, also where rows repeat or share an id. Rows of ``items`` that share an id, or
    have none, are one query of all their terms. Null and empty texts have no terms, and items without terms or
    without a match no rows; an empty table on either side gives none. Other columns are ignored.
    """
    spark = docs.sparkSession
    index = stored(build_index(docs, doc_key, text), "search-index")
    size = index.agg(F.sum("n_docs").alias("n"), F.sum("n_words").alias("words")).first()
    queries, blocks = query_terms(items, item_key, text)
    found = spark.createDataFrame([], f"block int, {FOUND}")
    for block in range(blocks if size["words"] else 0):
        rows = queries.filter(F.col("block") == block).select("nth", "terms", "times").orderBy("nth").collect()
        if not rows:
            continue
        terms = np.unique(np.concatenate([np.array(r["terms"], np.int64).view(U) for r in rows]))
        df = document_counts(index, terms).tolist()
        weight = np.array([math.floor(1000 * math.log((2 * size["n"] + 2) / (2 * f + 1))) if f else 0 for f in df], np.int64)
        places = [np.searchsorted(terms, np.array(r["terms"], np.int64).view(U)) for r in rows]
        shared = spark.sparkContext.broadcast(Queries(terms, [(p, weight[p] * np.array(r["times"], np.int64)) for p, r in zip(places, rows, strict=True)]))
        built = stored(pair_index(index, shared, size["n"], size["words"], k), "pair-index")
        best = stored(best_of(built, shared, _first_thresholds(built, len(rows), k), k), "search-best")
        shared.destroy()
        found = found.unionByName(best.withColumn("block", F.lit(block)))
    order = Window.partitionBy("block", "nth").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    top = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return top.join(queries.select("block", "nth", "item_id"), ["block", "nth"]).select("item_id", "rank", "doc_id", "score")

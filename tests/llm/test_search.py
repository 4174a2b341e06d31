import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from clonespark.llm import pair_search
from clonespark.llm.pair_search import Lists, Queries, build_index, document_counts, evaluate, intersections, ranked_search, reach

from . import brute


def words(text):
    return re.findall(brute.ALNUM, brute.lower(text))


def ranking(docs, items, k=20):
    """``{(item, rank): (doc_id, score)}`` by scoring everything."""
    bags = [(i, Counter(words(t))) for i, t in docs]
    n, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    asked = {}
    for item, text in items:
        asked.setdefault(item, Counter()).update(words(text))
    out = {}
    for item, terms in asked.items():
        scores = []
        for doc_id, bag in bags:
            if bag:
                m = 75 + (25 * sum(bag.values()) * n) // total
                s = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * bag[w]) // (1000 * bag[w] + 12 * m)) for w, c in terms.items() if w in bag)
                if s > 0:
                    scores.append((-s, doc_id is None, doc_id))
        for rank, (s, _, doc_id) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1):
            out[item, rank] = (doc_id, -s)
    return out


def found(frame):
    rows = frame.collect()
    out = {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.fixture(scope="module")
def benchmark(spark, sf):
    return spark.read.parquet(f"{sf}/benchmark.parquet")


def test_equals_brute_force_and_sql(spark, sf, documents, benchmark):
    from clonespark.llm.queries import ORACLES, QUERIES

    got = found(QUERIES["op11_ranked_search"](spark, sf))
    assert got == ranking([(r.doc_id, r.text) for r in documents.collect()], [(r.item_id, r.text) for r in benchmark.collect()])
    with duckdb.connect() as db:
        for name in ("documents", "benchmark"):
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
        assert got == {(item, rank): (doc, score) for item, rank, doc, score in db.execute(ORACLES["op11_ranked_search"]).fetchall()}


def test_small_shards_and_blocks_change_nothing(spark, documents, benchmark, monkeypatch):
    want = found(ranked_search(documents, benchmark, k=7))
    monkeypatch.setattr(pair_search, "SHARD_TEXT", 3000)
    monkeypatch.setattr(pair_search, "BLOCK_TERMS", 60)
    assert found(ranked_search(documents.repartition(9), benchmark, k=7)) == want


def test_odd_rows(spark, odd, nothing):
    items = spark.createDataFrame(
        [("a", "one two three NO nothing", 1), ("b", None, 1), ("c", " !! ", 1), ("d", "w1 w1 w2 w976 zzzz", 1), (None, "none at", 1), (None, "all x", 1), ("e", "seven", 1), ("e", "seven six", 1)],
        "item_id string, text string, score int",
    )
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for k in (1, 2, 20):
        got = ranked_search(odd, items, k=k).collect()
        want = ranking(rows, [(r.item_id, r.text) for r in items.collect()], k)
        assert sorted(((r.item_id or "", r["rank"], r.doc_id or 0, r.score) for r in got)) == sorted((i or "", n, d or 0, s) for (i, n), (d, s) in want.items())
    assert ranked_search(nothing, items).collect() == [] and ranked_search(odd, items.limit(0)).collect() == []
    assert dict(ranked_search(odd, items).dtypes) == {"item_id": "string", "rank": "int", "doc_id": "bigint", "score": "bigint"}


def test_ties_go_to_the_smaller_id(spark):
    docs = spark.createDataFrame([(k, "same text here") for k in range(500, 0, -1)] + [(1000, "other words"), (1001, "more other")], "doc_id long, text string").repartition(6)
    got = found(ranked_search(docs, spark.createDataFrame([(1, "text here")], "item_id long, text string")))
    assert [got[1, n][0] for n in range(1, 21)] == list(range(1, 21))


def shard(rng, n_docs, n_terms):
    """Random lists: skewed impacts, some terms in few documents."""
    own, bounds, docs, impacts = [], [0], [], []
    for t in range(n_terms):
        some = np.flatnonzero(rng.random(n_docs) < rng.random() ** 3)
        if len(some):
            own.append(t)
            docs.append(some)
            impacts.append((rng.random(len(some)) ** 4 * 1e6).astype(np.uint32) + 1)
            bounds.append(bounds[-1] + len(some))
    return Lists(np.array(own), np.array(bounds), np.concatenate(docs), np.concatenate(impacts), n_docs, n_terms)


def test_pair_bounds_are_tight_and_safe():
    rng = np.random.default_rng(5)
    tighter = 0
    for _ in range(30):
        lists = shard(rng, 60, 12)
        asked = [rng.permutation(12)[: rng.integers(1, 12)] for _ in range(4)]
        queries = Queries(np.arange(12, dtype=np.uint64), [(places, rng.integers(0, 9000, len(places))) for places in asked])
        held, begin, met, value = intersections(lists, queries)
        joint = np.zeros(len(queries.a), np.int64)
        joint[held] = np.maximum.reduceat(value, begin[:-1]) if len(held) else value
        dense = np.zeros((len(queries.term), 60), np.int64)
        for s, (term, weight) in enumerate(zip(queries.term, queries.weight, strict=True)):
            dense[s, lists.docs[lists.slice(term)]] = weight * lists.impacts[lists.slice(term)].astype(np.int64)
        for q in range(len(queries)):
            pairs = queries.of(q)
            gains = np.array([dense[queries.a[p]] + (dense[queries.b[p]] if queries.b[p] >= 0 else 0) for p in pairs])
            bound = reach(lists, queries, pairs, joint)
            if not len(pairs):
                continue
            assert np.array_equal(bound, gains.max(axis=1))  # no document reaches less than the best one does
            alone = sum(int(dense[s].max()) for p in pairs for s in (queries.a[p], queries.b[p]) if s >= 0)
            tighter += int(bound.sum()) < alone
            score = gains.sum(axis=0)
            for threshold in (1, int(np.median(score)) + 1, max(1, int(score.max())), int(score.max()) + 1):
                docs, got = evaluate(lists, queries, q, joint, threshold)
                want = np.flatnonzero(score >= threshold)
                assert np.array_equal(np.sort(docs), want) and np.array_equal(got[np.argsort(docs)], score[want])
    assert tighter > 20


def test_document_counts(spark, documents, texts):
    df = Counter(w for t in texts.values() for w in set(words(t)))
    some = sorted(df)[:300]
    from clonespark.llm.kernels import segment_hashes

    hashes = {w: segment_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())]))[0] for w in some}
    terms = np.unique(np.array(list(hashes.values())))
    counted = dict(zip(terms.tolist(), document_counts(build_index(documents), terms).tolist(), strict=True))
    assert all(counted[int(hashes[w])] == df[w] for w in some)

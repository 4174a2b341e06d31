import random
from pathlib import Path

import numpy as np

from clonespark.llm import dartminhash
from clonespark.llm.dartminhash import near_duplicates, signatures, weighted
from clonespark.llm.substring_dedup import substring_dedup
from clonespark.session import checkpoint_folder

from . import brute


def removed(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in df.collect()}


def test_repeats_equal_brute_force(documents, texts):
    assert removed(substring_dedup(documents)) == brute.substring_dedup(texts)


def test_repeats_inside_a_text_and_across_row_order(spark):
    random.seed(2)
    passage = [f"p{k}" for k in range(60)]
    texts = {}
    for k in range(40):
        own = [f"d{k}w{j}" for j in range(random.randint(0, 30))]
        cut = random.randint(0, 25)
        texts[k] = " ".join(own + passage[cut : cut + random.randint(15, 35)] + own[: random.randint(0, 30)])
    texts[99] = " ".join(passage + passage + ["a"] * 50)
    rows = spark.createDataFrame(list(texts.items())[::-1], "doc_id long, text string").repartition(7)
    assert removed(substring_dedup(rows)) == brute.substring_dedup(texts)


def test_repeats_report_maximal_runs(spark):
    text = " ".join(f"w{k}" for k in range(30))
    out = substring_dedup(spark.createDataFrame([(1, text), (2, f"x {text} y")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(s.start, s.end) for s in out[1].repeats] == [(1, 31)] and out[1].kept_text == "x y" and out[0].n_removed == 0


def test_repeats_of_odd_rows(odd, nothing):
    rows = substring_dedup(odd).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.n_words for r in by[1] + by[2] + by[3]] == [0, 0, 0]
    assert all(r.n_removed == 0 for r in by[4]) and by[6][0].kept_text == "" and by[7][0].n_words == 1
    first = by[5][0]
    assert first.n_words == 20_000 and first.n_removed == 20_000 - 977 - 19 + 19
    assert substring_dedup(nothing).count() == 0


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    elements = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = rng.gamma(1.0, 2.0, 300), rng.gamma(1.0, 2.0, 300)
    b[:200] = a[:200]
    k = 2048
    out = signatures(2, np.repeat([0, 1], 300), np.tile(elements, 2), np.concatenate([a, b]), k)
    truth = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((out[0] == out[1]).mean() - truth) < 0.04
    alone = signatures(1, np.zeros(300, int), elements, a, k)
    assert (alone[0] == out[0]).all()  # other rows of a batch play no part


def test_weights_are_counts():
    rows, keys, weights = weighted(np.array([1, 0, 1, 1]), np.array([5, 7, 5, 6], np.uint64))
    assert list(zip(rows.tolist(), keys.tolist(), weights.tolist(), strict=True)) == [(0, 7, 1.0), (1, 5, 2.0), (1, 6, 1.0)]


def test_classes_equal_brute_force(documents, texts):
    assert {r.doc_id: r.class_id for r in near_duplicates(documents).collect()} == brute.near_classes(texts)


def variants(seed=5, n=70, length=120):
    random.seed(seed)
    base = [f"b{k}" for k in range(length)]
    texts = {}
    for k in range(n):
        own = list(base)
        for _ in range(random.randint(0, 6)):
            own[random.randrange(length)] = random.choice(["s1", "s2", f"u{k}"])
        if k % 5 == 0:
            own = own[: random.randint(90, length)]
        texts[k + 10] = " ".join(own)
    return texts


def test_hot_group_of_near_copies(spark):
    texts = variants()
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    expected = brute.near_classes(texts)
    assert 1 < len(set(expected.values())) < len(texts)
    assert {r.doc_id: r.class_id for r in near_duplicates(rows).collect()} == expected


def test_size_of_small_buckets_plays_no_part(spark, monkeypatch):
    texts = variants(seed=8, n=30)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(dartminhash, "SMALL", 2)
    monkeypatch.setattr(dartminhash, "MEDIUM", 3)
    assert {r.doc_id: r.class_id for r in near_duplicates(rows).collect()} == brute.near_classes(texts)


def test_few_rows_are_written_by_few_tasks(spark):
    folder = Path(checkpoint_folder(spark).removeprefix("file:"))
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    known = {p.name for p in folder.iterdir()}
    texts = variants()
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        assert {r.doc_id: r.class_id for r in near_duplicates(rows).collect()} == brute.near_classes(texts)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files = {p.name: len(list(p.glob("part-*"))) for p in folder.iterdir() if p.name not in known}
    small = {k: n for k, n in files.items() if k.startswith(("dart-leads", "dart-members", "dart-sets", "dart-links", "dart-classes"))}
    assert len(small) > 4 and max(small.values()) <= 2, small


def test_classes_of_odd_rows(odd, nothing):
    rows = near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    classes = {r.doc_id: r.class_id for r in rows}
    assert classes[None] is None and classes[6] == 5 and [classes[k] for k in (1, 2, 3, 4)] == [1, 2, 3, 4]
    assert near_duplicates(nothing).count() == 0

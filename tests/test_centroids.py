"""Nearest centroids and k-mer distances against plain counting."""

import random
from collections import Counter

import pandas as pd

from clonespark.operators import centroids as CE


def profile(s):
    return Counter(s[i : i + 6] for i in range(len(s) - 5))


def squared(a, b):
    a, b = profile(a), profile(b)
    return sum((a[k] - b[k]) ** 2 for k in a.keys() | b.keys())


def mutated(rng, s, n):
    for _ in range(n):
        i = rng.randrange(len(s))
        s = s[:i] + rng.choice(["", "A", "C", "G", "T"]) + s[i + 1 :]
    return s


def test_distance_function(spark):
    rng = random.Random(1)
    texts = ["", "ACGTA", "ACGTAC", "AAAAAAAAAAAA"] + ["".join(rng.choice("ACGT") for _ in range(rng.randint(6, 90))) for _ in range(30)]
    pairs = pd.DataFrame([(a, b) for a in texts for b in rng.sample(texts, 6)], columns=["a", "b"])
    got = spark.createDataFrame(pairs).repartition(3).withColumn("d", CE.squared_profile_distance()("a", "b")).collect()
    assert all(r.d == squared(r.a, r.b) for r in got)


def test_nearest_of_families_and_of_noise(spark, monkeypatch):
    """Families of near sequences, one partition with half of all rows, unrelated sequences and ties."""
    monkeypatch.setattr(CE, "BLOCK", 40)
    rng = random.Random(2)
    roots = {p: ["".join(rng.choice("ACGT") for _ in range(120)) for _ in range(8)] for p in ("a", "b", "c")}
    near = [(i, p, mutated(rng, rng.choice(roots[p]), rng.randint(0, 3)), rng.randint(1, 4)) for i, p in enumerate(["a"] * 300 + ["b"] * 30 + ["c"] * 1)]
    near.append((900, "a", near[5][2], near[5][3]))  # an equal centroid with an equal count
    asked = [(1000 + i, p, mutated(rng, rng.choice(roots[p]), rng.randint(0, 9)), ) for i, p in enumerate(["a"] * 200 + ["b"] * 20 + ["c"] * 20)]
    asked += [(2000 + i, "a", "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 130)))) for i in range(20)] + [(3000, "none", "ACGTACGT")]
    rows = CE.nearest_centroids(spark.createDataFrame(asked, "id long, part string, seq string"), spark.createDataFrame(near, "id long, part string, seq string, count int")).collect()
    got = {r.id: r for r in rows}
    assert set(got) == {i for i, p, _ in asked if p != "none"} and len(got) == len(rows)
    for i, p, s in asked:
        if p != "none":
            want = min((squared(s, t), -n, j) for j, q, t, n in near if q == p)
            assert (got[i].squared, got[i].target) == (want[0], want[2])
    family = [r.compared for r in rows if 1000 <= r.id < 1200]
    assert sum(family) / len(family) < 200  # of 301 centroids, pivots included


def test_nothing_to_do(spark):
    no = spark.createDataFrame([], "id long, part string, seq string")
    some = spark.createDataFrame([(1, "a", "ACGTACG", 2)], "id long, part string, seq string, count int")
    assert CE.nearest_centroids(no, some).collect() == [] and CE.nearest_centroids(some.drop("count"), some.limit(0)).collect() == []

"""Similarity joins, components and denoising against sequential brute force."""

import random

import pytest
from pyspark.sql import functions as F

from clonespark.functions.kernels import EMPTY_SLOT, edit_profile_of
from clonespark.functions.statistics import poisson_tail
from clonespark.operators.components import connected_components
from clonespark.operators.consensus import germline_sketches
from clonespark.operators.denoise import DenoiseOptions, denoise
from clonespark.operators.lineages import LineageOptions, assign_lineages
from clonespark.operators.simjoin import edit_pairs, hamming_pairs
from clonespark.operators.study import scope_value
from clonespark.plans import catalog


def _hamming(a, b):
    return sum(x != y for x, y in zip(a, b, strict=True))


def _variants(seed, count, length, centres=3):
    rng = random.Random(seed)
    roots = ["".join(rng.choice("ACGT") for _ in range(length)) for _ in range(centres)]
    out = set(roots)
    while len(out) < count:
        s = list(rng.choice(roots))
        for _ in range(rng.randrange(1, 4)):
            s[rng.randrange(length)] = rng.choice("ACGTN")
        out.add("".join(s))
    return sorted(out)


@pytest.mark.parametrize("hot_group", [2048, 3])
def test_hamming_join_is_complete(spark, hot_group):
    texts = _variants(1, 90, 24)
    nodes = spark.createDataFrame([(i, "p", s, 3) for i, s in enumerate(texts)], "id long, part string, seq string, lim int")
    found = {(r.left_id, r.right_id, r.distance) for r in hamming_pairs(nodes, hot_group=hot_group).collect()}
    expected = {(i, j, _hamming(texts[i], texts[j])) for i in range(len(texts)) for j in range(i + 1, len(texts)) if _hamming(texts[i], texts[j]) <= 3}
    assert found == expected
    links = hamming_pairs(nodes, hot_group=hot_group, links_only=True)
    parts = {r.id: r.component for r in connected_components(nodes, links).collect()}
    whole = {r.id: r.component for r in connected_components(nodes, spark.createDataFrame([(a, b) for a, b, _ in expected], "left_id long, right_id long")).collect()}
    assert parts == whole


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("hot_group", [2048, 4])
def test_edit_join_is_complete(spark, hot_group):
    rng = random.Random(4)
    texts = _variants(2, 30, 18)
    texts += [t[: rng.randrange(18)] + t[rng.randrange(1, 18) :] for t in texts[:15]] + ["A", "AC"]
    texts = sorted({t for t in texts if t})
    rows = [(i, "p", s) for i, s in enumerate(texts)]
    nodes = spark.createDataFrame(rows, "id long, part string, seq string")
    found = {(r.left_id, r.right_id) for r in edit_pairs(nodes, nodes, limit=2, hot_group=hot_group).collect()}
    assert found == {(i, j) for i, _, a in rows for j, _, b in rows if _levenshtein(a, b) <= 2}


def test_components_of_a_long_chain(spark):
    ids = list(range(300))
    random.Random(1).shuffle(ids)
    edges = spark.createDataFrame(list(zip(ids[:-1], ids[1:], strict=True)) + [(1000, 1001)], "left_id long, right_id long")
    vertices = spark.createDataFrame([(i,) for i in [*ids, 1000, 1001, 5000]], "id long")
    got = {r.id: r.component for r in connected_components(vertices, edges).collect()}
    assert {got[i] for i in ids} == {0} and got[1001] == 1000 and got[5000] == 5000


RECORD = "ordinal long, sample_id string, subject_id string, dataset_id string, cohort string, locus string, v_call string, j_call string, c_call string, cdr3_nt string, productive boolean, denoise_nt string, weight long"


def _records(spark, rows):
    """rows of (sequence, weight[, v_call])"""
    data = [(i, "s", "d", "l", "c", "IGH", r[2] if len(r) > 2 else "V1*01", "J1*01", "", r[0], True, r[0], r[1]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, RECORD)


def _sequential(variants, mode, o):
    """Visit by count, merge into the best earlier unmerged parent; returns {id: target}."""
    order = sorted(variants, key=lambda v: (-v[2], v[0]))
    parents, target = [], {}
    for vid, seq, count in order:
        best = None
        for pid, pseq, pcount in parents:
            if mode == "conservative":
                if len(pseq) != len(seq) or not 1 <= (d := _hamming(seq, pseq)) <= o.max_hamming:
                    continue
                rate = pcount * (o.error_rate / 3) ** d * (1 - o.error_rate) ** (len(seq) - d)
                alternatives = len(seq) * 3
                if min(1, poisson_tail([count], [rate])[0] * alternatives) >= o.alpha:
                    key = (-rate, d, pid)
                    best = min(best or (key, pid), (key, pid))
            else:
                profile = edit_profile_of(pseq, seq, o.max_edit)
                if pcount <= count or not profile or profile[0] < 1:
                    continue
                d, subs, ins, dels = profile
                if ins + dels:
                    good = pcount / count >= o.min_indel_ratio
                else:
                    rate = pcount * (o.error_rate / 3) ** subs * (1 - o.error_rate) ** (len(seq) - subs)
                    n = 1
                    for i in range(1, subs + 1):
                        n = n * (len(seq) - subs + i) / i
                    good = min(1, poisson_tail([count], [rate])[0] * n * 3**subs) >= o.alpha
                if good:
                    key = (d, subs, -pcount, pid)
                    best = min(best or (key, pid), (key, pid))
        if best:
            target[vid] = best[1]
        elif count >= o.min_parent_count:
            parents.append((vid, seq, count))
    return target


@pytest.mark.parametrize("mode", ["conservative", "indel"])
def test_denoise_equals_the_sequential_scan(spark, mode):
    rng = random.Random(9)
    root = "".join(rng.choice("ACGT") for _ in range(60))
    texts = {root: 400}
    for _ in range(40):
        s = list(rng.choice(sorted(texts)))
        k = rng.randrange(len(s))
        s[k : k + 1] = rng.choice([["A"], ["C"], ["G"]] + ([[], ["T", "T"]] if mode == "indel" else []))
        texts.setdefault("".join(s), rng.choice([1, 1, 2, 3, 8, 30]))
    rows = list(texts.items())
    o = DenoiseOptions(mode=mode, hot_group=5)
    groups, members = denoise(_records(spark, rows), o)
    expected = _sequential([(i, s, c) for i, (s, c) in enumerate(rows)], mode, o)
    assert {r.ordinal: r.representative for r in members.collect()} == {i: expected.get(i, i) for i in range(len(rows))}
    counts = {}
    for i, (_, c) in enumerate(rows):
        counts[expected.get(i, i)] = counts.get(expected.get(i, i), 0) + c
    assert {r.representative: r["count"] for r in groups.collect()} == counts


def test_denoise_literals(spark):
    rng = random.Random(1)
    parent = "".join(rng.choice("ACGT") for _ in range(90))
    child = ("C" if parent[0] != "C" else "G") + parent[1:]
    rows = [(parent, 100), (child, 1), ("T" * 90, 1)]
    groups, _ = denoise(_records(spark, rows), DenoiseOptions(mode="conservative"))
    assert {r.representative: r["count"] for r in groups.collect()} == {0: 101, 2: 1}
    groups, _ = denoise(_records(spark, rows[:2]), DenoiseOptions(mode="abundance"))
    assert {r.representative: r["count"] for r in groups.collect()} == {0: 101}
    # an unassigned read and one with N
    extra = [*rows, ("ACGT", 5, ""), ("ACGN", 3)]
    _, members = denoise(_records(spark, extra), DenoiseOptions(ambiguous="retain", unresolved="retain"))
    found = {r.ordinal: r.representative for r in members.collect()}
    assert found[3] == 3 and found[4] == 4
    _, members = denoise(_records(spark, extra), DenoiseOptions())
    found = {r.ordinal: r.representative for r in members.collect()}
    assert found[3] is None and found[4] is None


@pytest.mark.parametrize("ambiguity", ["overlap", "top", "strict"])
def test_lineages_equal_brute_force(spark, ambiguity):
    rng = random.Random(6)
    texts = [t.replace("N", "A") for t in _variants(5, 40, 20)]
    calls = ["V1*01", "V1*02,V2*01", "V2*01", "V2*01,V3*01", "V3*01"]
    rows = [(t, 1, rng.choice(calls)) for t in texts]
    options = LineageOptions(identity=0.85, ambiguity=ambiguity)
    got = {r.ordinal: r.lineage_id for r in assign_lineages(_records(spark, rows).repartition(7), options).collect()}

    def genes(call):
        values = [c.split("*")[0] for c in call.split(",")]
        return values[:1] if ambiguity == "top" else sorted(set(values))

    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, (a, _, va) in enumerate(rows):
            for j, (b, _, vb) in enumerate(rows):
                ok = genes(va) == genes(vb) if ambiguity == "strict" else set(genes(va)) & set(genes(vb))
                if ok and _hamming(a, b) <= 3 and label[j] < label[i]:
                    label[i], changed = label[j], True
    assert got == dict(enumerate(label))
    assert F is not None


def test_annotation_keeps_ties_common_seeds_and_seedless_reads(spark):
    from pyspark.sql import functions as F

    from clonespark.operators.annotate import seed_candidates

    body = "ACGTTGCAAGGCTTACCATGACCGGTTAACCTGAGTCCATGGAACTTGCAGGATCCA"
    germlines = spark.createDataFrame([(f"V{k:03d}*01", "IGH", body) for k in range(200)], "name string, locus string, sequence string")
    queries = spark.createDataFrame([(1, False, "", body), (2, False, "", "T" * 40), (2, True, "", "A" * 40)], "rid long, rev boolean, want_locus string, query string")
    found = {(r.rid, r.rev): r.n for r in seed_candidates(queries, germlines, "V", 3).groupBy("rid", "rev").agg(F.count_distinct("gene").alias("n")).collect()}
    assert found == {(1, False): 200, (2, False): 200, (2, True): 200}


def test_germline_neighbours_are_searched_for_a_source_set_that_grows(spark):
    d = "/root/testdata/sf0.001"
    _, assigned = catalog._assigned(spark, d)
    t = catalog.table(spark, d).join(assigned, "ordinal").withColumn("study_group", scope_value("subject"))
    index = [(r.lineage_id, r.locus, r.study_group, {(k, h) for k, h in enumerate(r.sketch) if h != EMPTY_SLOT}) for r in germline_sketches(t).collect()]
    sources = {r.lineage_id for r in assigned.collect() if r.ordinal % 100 == 0}
    expected = {(a[0], b[0]) for a in index for b in index if a[0] in sources and a[0] != b[0] and a[1:3] == b[1:3] and a[3] & b[3]}
    found = [(r.source_lineage_id, r.lineage_id) for r in catalog.QUERIES["germline_neighbours"](spark, d).collect()]
    assert set(found) == expected and len(found) == len(expected) and len({a for a, _ in found}) > 5


def test_stars_take_few_rounds(spark):
    hubs = {500: range(1, 1000), 2500: range(2001, 3000)}
    pairs = [(hub, leaf) for hub, leaves in hubs.items() for leaf in leaves if leaf != hub]
    edges = spark.createDataFrame(pairs, "left_id long, right_id long")
    vertices = spark.createDataFrame([(k,) for k in [*range(1, 1000), *range(2001, 3001)]], "id long")
    context = spark.sparkContext
    context.setLocalProperty("spark.jobGroup.id", "stars")
    try:
        found = {r.id: r.component for r in connected_components(vertices, edges).collect()}
        jobs = len(context.statusTracker().getJobIdsForGroup("stars"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert found == {k: 1 if k < 1000 else 2001 if k < 3000 else 3000 for k in [*range(1, 1000), *range(2001, 3001)]}
    assert jobs <= 30, jobs

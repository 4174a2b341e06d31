"""The usage models against plain loops over the same evidence."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from clonespark.operators import allele_models
from clonespark.operators import refinement as RE

FASTA = [("IGHV1*01", "AAAAAAAAAA"), ("IGHV1*01_same", "AAAAAAAAAA"), ("IGHV1*02", "AAAAAAAACA"), ("IGHV1*03", "AAAAAAACCA"), ("IGHV9*01", "CCCCCGGGGG"), ("IGKV1*01", "AAAAAAAAAA")]


def table(spark, rows):
    """``rows``: call, alternatives, subject, identity, number of copies."""
    out, n = [], 0
    for call, alternatives, subject, identity, copies in rows:
        for _ in range(copies):
            n += 1
            out.append((n, "IGH", call, alternatives, 100.0, identity, subject, "s1", "lib", "1"))
    return spark.createDataFrame(out, "ordinal long, locus string, v_call string, v_alternatives string, v_score double, v_identity double, subject_id string, sample_id string, dataset_id string, duplicate_count string")


def pools_of(fit):
    pools = defaultdict(dict)
    for r in fit.rows.collect():
        key = tuple((e.node, round(math.log(e.weight), 6)) for e in r.entries)
        old = pools[r.pool].get(key, (r.entries, 0.0))
        pools[r.pool][key] = (min(old[0], r.entries), old[1] + r.read_weight)
    return {pool: [({e.node: e.weight for e in entries}, w) for entries, w in patterns.values()] for pool, patterns in pools.items()}


def digamma(x):
    total = 0.0
    while x < 12:
        total -= 1 / x
        x += 1
    return total + math.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)


def plain_dirichlet(patterns, database, alpha=0.1, tolerance=1e-11, most=20_000):
    gamma = defaultdict(lambda: alpha)
    for entries, w in patterns:
        for node, e in entries.items():
            gamma[node] += w * e
    silent = max(0, database - len(gamma)) * alpha
    for _ in range(most):
        base = digamma(sum(gamma.values()) + silent)
        expected = {k: digamma(g) - base for k, g in gamma.items()}
        new = {k: alpha for k in gamma}
        for entries, w in patterns:
            x = {k: e * math.exp(expected[k]) for k, e in entries.items()}
            z = sum(x.values())
            for k in x:
                new[k] += w * x[k] / z
        change = max(abs(new[k] - gamma[k]) / max(1, gamma[k]) for k in new)
        gamma = new
        if change <= tolerance:
            break
    mass = sum(gamma.values()) + silent
    return {k: g / mass for k, g in gamma.items()}


def plain_frequencies(patterns, active, theta, most=50_000, tolerance=1e-10):
    theta = {k: theta[k] for k in active}
    z = sum(theta.values())
    theta = {k: t / z for k, t in theta.items()}
    for _ in range(most):
        counts = dict.fromkeys(active, 0.0)
        for entries, w in patterns:
            x = {k: theta[k] * e for k, e in entries.items() if k in active}
            z = sum(x.values())
            for k in x:
                counts[k] += w * x[k] / z
        total = sum(counts.values())
        new = {k: c / total for k, c in counts.items()}
        change = max(abs(new[k] - theta[k]) for k in new)
        theta = new
        if change <= tolerance:
            break
    return theta


def plain_inclusion(node, patterns, active, theta, total, database, o):
    low, points = o.frequency_floor, o.quadrature_points
    scale = min(0.5, 1 / max(2, database * o.active_fraction)) / o.tail_shape
    grid = []
    for i in range(points):
        a, b = (math.exp(math.log(low) + (math.log(0.95) - math.log(low)) * k / points) for k in (i, i + 1))
        f = math.sqrt(a * b)
        grid.append((f, math.exp((o.tail_shape - 1) * math.log(f) - f / scale) * (b - a)))
    z = sum(g for _, g in grid)
    own, rest = 0.0, 1 - theta[node]
    if rest <= 1e-12:
        return 1.0
    logs = [math.log(g / z) for _, g in grid]
    for entries, w in patterns:
        if node not in entries:
            continue
        own += w
        baseline = sum(theta[k] * e for k, e in entries.items() if k in active and k != node) / rest
        if not baseline > 1e-300:
            return 1.0
        for i, (f, _) in enumerate(grid):
            logs[i] += w * math.log(1 - f + f * entries[node] / baseline)
    logs = [x + (total - own) * math.log1p(-f) for x, (f, _) in zip(logs, grid, strict=True)]
    top = max(logs)
    odds = math.log(o.active_fraction / (1 - o.active_fraction)) + top + math.log(sum(math.exp(x - top) for x in logs))
    return 1 / (1 + math.exp(-odds)) if odds > -700 else 0.0


def plain_active_set(patterns, database, o):
    local = defaultdict(float)
    for entries, w in patterns:
        for k, e in entries.items():
            local[k] += w * e
    active, total = set(local), sum(w for _, w in patterns)
    theta = plain_frequencies(patterns, active, local)
    inclusion = {}
    for _ in range(o.max_sweeps):
        inclusion |= {k: plain_inclusion(k, patterns, active, theta, total, database, o) for k in active}
        removed = 0
        for k in sorted((k for k in active if inclusion[k] < o.inclusion_threshold), key=lambda k: (inclusion[k], theta[k], k)):
            if all(len(active & set(entries)) > 1 for entries, _ in patterns if k in entries):
                active.discard(k)
                removed += 1
        if not removed:
            break
        theta = plain_frequencies(patterns, active, theta)
    inclusion |= {k: plain_inclusion(k, patterns, active, theta, total, database, o) for k in active}
    return active, theta, inclusion


def given(spark, sf):
    from clonespark.plans.catalog import _alleles
    from clonespark.plans.catalog import table as repertoire

    return repertoire(spark, sf), _alleles(spark, sf)


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("model", ["dirichlet", "active-set"])
def test_models_equal_plain_loops(spark, model):
    options = RE.RefinementOptions(model=model, tolerance=1e-10)
    fit = RE.refine(*given(spark, SF), options)
    usage = defaultdict(dict)
    for r in fit.usage.collect():
        usage[r.pool][r.node] = r
    assert fit.usage.filter("NOT converged").isEmpty()
    for pool, patterns in pools_of(fit).items():
        database = next(iter(usage[pool].values())).database_nodes
        if model == "dirichlet":
            mean = plain_dirichlet(patterns, database)
            assert set(mean) == set(usage[pool])
            assert all(abs(usage[pool][k].posterior_mean - m) < 1e-6 for k, m in mean.items())
        else:
            active, theta, inclusion = plain_active_set(patterns, database, options)
            assert {k for k, r in usage[pool].items() if r.active} == active
            assert all(abs(usage[pool][k].posterior_mean - theta.get(k, 0.0)) < 1e-5 for k in usage[pool])
            assert all(abs(usage[pool][k].inclusion - p) < 1e-3 for k, p in inclusion.items())


@pytest.mark.parametrize("model", ["dirichlet", "active-set"])
def test_blocks_of_large_pools_change_nothing(spark, model):
    """Pools of many small blocks run in rounds over the cluster."""
    options = RE.RefinementOptions(model=model, scope="global", tolerance=1e-9)
    fit = RE.refine(*given(spark, SF), options)
    want = {(r.pool, r.node): r for r in fit.usage.collect()}
    packed = allele_models.pack(fit.rows, fit.nodes, block=5)
    assert packed.blocks.filter("n_blocks > 1").count() > 10
    rows = allele_models.fit_pools(packed, options).collect()
    assert {(r.pool, r.node) for r in rows} == set(want)
    for r in rows:
        one = want[r.pool, r.node]
        assert r.converged and r.active == one.active and abs(r.posterior_mean - one.posterior_mean) < 1e-6 and abs(r.effective_rows - one.effective_rows) < 1e-9


def reads(spark, *more):
    return table(spark, [("IGHV1*01", "", "d1", 0.98, 80), ("IGHV1*02", "", "d1", 0.98, 60), ("IGHV1*03", "IGHV1*02|99.5|0.97", "d1", 0.95, 1), *more])


def reference(spark):
    return spark.createDataFrame(FASTA, "name string, sequence string")


def test_active_set_drops_leakage_only(spark):
    fit = RE.refine(reads(spark), reference(spark), RE.RefinementOptions(model="active-set", active_fraction=0.2))
    usage = {r.node: r for r in fit.usage.collect()}
    assert usage["IGHV1*01"].active and usage["IGHV1*02"].active and not usage["IGHV1*03"].active
    assert usage["IGHV1*03"].posterior_mean == 0.0 and usage["IGHV1*03"].expected is None and usage["IGHV1*03"].inclusion < 0.5
    last = fit.calls.filter(F.col("ordinal") == 141).first()
    assert last.local_top == "IGHV1*03" and last.map_node == "IGHV1*02"
    rows = RE.posterior_rows(reads(spark), fit).filter(F.col("ordinal") == 141).collect()
    assert {r.node: r.source for r in rows} == {"IGHV1*03": "reported", "IGHV1*02": "retained_alternative", "IGHV1*01": "reference_neighbour"}
    assert {r.node: r.repertoire_posterior == 0 for r in rows}["IGHV1*03"] and abs(sum(r.repertoire_posterior for r in rows) - 1) < 1e-9
    top = RE.pool_summary(fit).orderBy("rank").collect()
    assert [r.node for r in top] == ["IGHV1*01", "IGHV1*02", "IGHV1*03"] and {r.active_alleles for r in top} == {2} and top[0].labels == "IGHV1*01,IGHV1*01_same"
    assert {(r.database_nodes, r.silent_nodes) for r in top} == {(4, 1)}


def test_only_allele_of_a_read_stays(spark):
    """An allele that alone explains a read is not removed, however unlikely it is."""
    rows = reads(spark, ("IGHV9*01", "", "d1", 0.99, 1))
    usage = {r.node: r.active for r in RE.refine(rows, reference(spark), RE.RefinementOptions(model="active-set", active_fraction=1e-6, inclusion_threshold=1.0)).usage.collect()}
    assert usage["IGHV9*01"]


def test_shift_is_weighted_and_keeps_unsure_calls(spark):
    fit = RE.refine(reads(spark), reference(spark), RE.RefinementOptions(model="active-set", active_fraction=0.2))
    calls = fit.calls.withColumn("read_weight", F.when(F.col("ordinal") == 141, 7.0).otherwise(1.0))
    moved = {r.node: (r.before, r.after, r.vanishes) for r in RE.assignment_shift(calls, "best").collect()}
    assert moved["IGHV1*03"] == (7.0, 0.0, True) and moved["IGHV1*02"] == (60.0, 67.0, False)
    kept = {r.node: r.after for r in RE.assignment_shift(calls.withColumn("map_probability", F.lit(0.5)), "confidence", 0.8).collect()}
    assert kept["IGHV1*03"] == 7.0


def test_no_rows(spark):
    fit = RE.refine(reads(spark).limit(0), reference(spark))
    assert fit.calls.collect() == [] and fit.usage.collect() == [] and RE.pool_summary(fit).collect() == []


def test_limit_is_an_error_or_a_flag(spark):
    with pytest.raises(RuntimeError, match="not converged"):
        RE.refine(reads(spark), reference(spark), RE.RefinementOptions(max_iterations=1))
    fit = RE.refine(reads(spark), reference(spark), RE.RefinementOptions(max_iterations=1, at_limit="flag"))
    assert not fit.calls.filter("converged").count()

"""Literal expectations and brute force for the small helpers; no Spark job needed."""

import math
import random

import numpy as np
import pytest

from clonespark.functions.alignment import Scoring, align_chunk
from clonespark.functions.kernels import EMPTY_SLOT, edit_profile_of, sketch_of
from clonespark.functions.statistics import binomial_tail, gamma_p, log_gamma, poisson_tail
from clonespark.operators.chimera import ChimeraOptions, chimera_probability, chimera_probability_grid, estimate_mutation
from clonespark.sources.fastq import parse_records
from clonespark.sources.trees import newick_edges


def test_poisson_tail_literals():
    assert np.allclose(poisson_tail([0, 1], [0.1, 0.1]), [0.095162581964, 0.00467884016044])
    direct = [1 - sum(math.exp(-3.5) * 3.5**k / math.factorial(k) for k in range(n + 1)) for n in range(9)]
    assert np.allclose(poisson_tail(np.arange(9), 3.5), direct)
    assert poisson_tail([3], [0.0])[0] == 0


def test_binomial_tail_matches_sum():
    for n, p in ((10, 0.2), (40, 0.03), (25, 0.7)):
        for s in range(n + 2):
            exact = sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(max(s, 0), n + 1))
            assert binomial_tail([s], [n], [p])[0] == pytest.approx(min(1, exact), rel=1e-8, abs=1e-12)


def test_log_gamma_matches_math():
    x = np.array([0.2, 0.5, 1, 2.5, 10, 171.3])
    assert np.allclose(log_gamma(x), [math.lgamma(v) for v in x])
    assert gamma_p(np.array([2.0]), np.array([0.0]))[0] == 0


@pytest.mark.parametrize(
    "parent,child,maximum,expected",
    [
        ("ACGT", "AGGT", 1, (1, 1, 0, 0)),
        ("ACGT", "ACGGT", 1, (1, 0, 1, 0)),
        ("ACGGT", "ACGT", 1, (1, 0, 0, 1)),
        ("ACGT", "ATGGT", 2, (2, 1, 1, 0)),
        ("ACGT", "ATGGGT", 1, None),
    ],
)
def test_edit_profile_literals(parent, child, maximum, expected):
    assert edit_profile_of(parent, child, maximum) == expected


def test_every_single_indel_is_one_edit():
    rng = random.Random(3)
    parent = "".join(rng.choice("ACGT") for _ in range(72))
    for i in range(len(parent)):
        assert edit_profile_of(parent, parent[:i] + parent[i + 1 :], 2)[0] == 1
        assert edit_profile_of(parent, parent[:i] + "A" + parent[i:], 2)[0] == 1


def _plain_hash(text, seed):
    h = seed
    for ch in text:
        h = ((h ^ ord(ch)) * 0x01000193) & 0xFFFFFFFF
    h ^= h >> 16
    h = (h * 0x7FEB352D) & 0xFFFFFFFF
    h ^= h >> 15
    h = (h * 0x846CA68B) & 0xFFFFFFFF
    return h ^ (h >> 16)


def test_sketch_matches_scalar_hash():
    rng = random.Random(5)
    text = "".join(rng.choice("ACGTN") for _ in range(60))
    clean = text.replace("N", "")
    expected = min(_plain_hash(clean[i : i + 7], 0x9E3779B9) for i in range(len(clean) - 6))
    assert sketch_of(text)[1] == expected
    assert sketch_of("NNN") == [EMPTY_SLOT] * 8


def _smith_waterman(a, b, s):
    best, h, e = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)], [[-(10**9)] * (len(b) + 1) for _ in range(len(a) + 1)]
    f = [[-(10**9)] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            e[i][j] = max(h[i - 1][j] + s.gap_open, e[i - 1][j] + s.gap_extend)
            f[i][j] = max(h[i][j - 1] + s.gap_open, f[i][j - 1] + s.gap_extend)
            h[i][j] = max(0, h[i - 1][j - 1] + (s.match if a[i - 1] == b[j - 1] else s.mismatch), e[i][j], f[i][j])
            best = max(best, h[i][j])
    return best


def test_local_alignment_matches_full_table():
    rng = random.Random(11)
    queries, references = [], []
    for _ in range(30):
        b = "".join(rng.choice("ACGT") for _ in range(40))
        a = list(b)
        for _ in range(rng.randrange(5)):
            k = rng.randrange(len(a))
            a[k : k + 1] = rng.choice([["A"], [], ["C", "G"]])
        queries.append("".join(a))
        references.append(b)
    rows = align_chunk(queries, references, [0] * 30, 80, Scoring())
    for a, b, row in zip(queries, references, rows, strict=True):
        assert row[0] == _smith_waterman(a, b, Scoring())
        score, qs, qe, rs, re_, x, y = row[:7]
        assert x.replace("-", "") == a[qs:qe] and y.replace("-", "") == b[rs:re_]


def test_chimera_model_prefers_mosaics():
    rng = random.Random(2)
    panel = np.array([[rng.choice(b"ACGT") for _ in range(120)] for _ in range(4)], dtype=np.uint8)
    clean, mosaic = panel[0].copy(), np.concatenate([panel[1][:60], panel[2][60:]])
    observed = np.stack([clean, mosaic])
    mutation = estimate_mutation(panel, observed, 0.05, 0.05)
    p = chimera_probability(panel, observed, 0.05, mutation)
    assert p[0] < 0.05 and p[1] > 0.95
    grid = chimera_probability_grid(panel, observed, ChimeraOptions(method="DB"))
    assert grid[0] < 0.05 and grid[1] > 0.95


def test_fastq_parser_rejects_bad_records():
    assert list(parse_records(iter(["@a b\n", "AC\n", "GT\n", "+\n", "@@II\n"]))) == [("a", "b", "ACGT", "@@II")]
    for bad in (["ACGT\n"], ["@a\n", "+\n"], ["@a\n", "AC\n", "+\n", "III\n"], ["@a\n", "AC\n", "+\n", "I\n"], ["@a\n", "AC\n"]):
        with pytest.raises(ValueError):
            list(parse_records(iter(bad)))


def test_newick_edges():
    rows = newick_edges("((a:1,b:2)x:0.5,'c d':3);")
    assert {r[3] for r in rows} == {"", "x", "a", "b", "c d"}
    assert [r[2] for r in rows if r[3] == "b"] == [2.0]
    with pytest.raises(ValueError):
        newick_edges("((a,b);")

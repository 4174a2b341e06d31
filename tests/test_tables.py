"""Table functions in SQL, and what must not pass silently."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clonespark.functions import statistics as ST
from clonespark.functions.register import register_functions
from clonespark.operators.annotate import seed_candidates
from clonespark.operators.lineages import LineageOptions
from clonespark.operators.search import expand_linkage
from clonespark.sources import writers


def test_kmers_and_columns_with_lateral(spark):
    register_functions(spark)
    spark.createDataFrame([(1, "ACGTA"), (2, "AC"), (3, None), (4, "")], "n int, s string").createOrReplaceTempView("short_reads")
    got = spark.sql("SELECT n, kmer, position FROM short_reads, LATERAL kmers(s, 3)").collect()
    assert sorted(map(tuple, got)) == [(1, "ACG", 1), (1, "CGT", 2), (1, "GTA", 3)]
    assert spark.sql("SELECT * FROM kmers('ACGT', 0)").collect() == [] and spark.sql("SELECT * FROM kmers('ACGT', CAST(NULL AS INT))").collect() == []
    pairs = [tuple(r) for r in spark.sql("SELECT * FROM alignment_columns('A-GT', 'AC-')").collect()]
    assert pairs == [(1, "A", "A", 1, 1), (2, "-", "C", None, 2), (3, "G", "-", 2, None), (4, "T", None, 3, None)]
    assert spark.sql("SELECT * FROM alignment_columns(CAST(NULL AS STRING), '')").collect() == []


def test_seedless_reads_meet_the_whole_panel_in_many_parts(spark):
    germlines = spark.createDataFrame([(f"V{k:03d}*01", "IGH" if k % 2 else "IGK", "ACGTTGCAAGGCTTACCATGACCGG") for k in range(40)], "name string, locus string, sequence string")
    queries = spark.createDataFrame([(k, False, "IGH" if k % 3 else "", "T" * 30) for k in range(50)], "rid long, rev boolean, want_locus string, query string")
    found = seed_candidates(queries, germlines, "V", 3)
    counts = {r.rid: r.n for r in found.groupBy("rid").agg(F.count_distinct("gene").alias("n")).collect()}
    assert counts == {k: 20 if k % 3 else 40 for k in range(50)} and found.count() == sum(counts.values())


def test_reachability_follows_a_long_chain(spark):
    """Each CDR3 is near the next one only; the seed is the last."""
    bases, rows = list("A" * 60), []
    for k in range(240):
        rows.append((k, "".join(bases), "IGHV1*01", "IGHJ1*01", True, "IGH", "d", "s", "l", 1))
        bases[(7 * k) % 60] = "CGTA"[(k // 60) % 4]
    rows.append((999, "G" * 57 + "CCC", "IGHV1*01", "IGHJ1*01", True, "IGH", "d", "s", "l", 1))
    frame = spark.createDataFrame(rows, "ordinal long, cdr3_nt string, v_call string, j_call string, productive boolean, locus string, subject_id string, sample_id string, dataset_id string, weight long")
    seeds = spark.createDataFrame([(239,)], "ordinal long")
    options = LineageOptions(identity=0.983)
    assert {r.ordinal for r in expand_linkage(frame, seeds, options).collect()} == set(range(240))


def test_series_that_do_not_converge_raise(monkeypatch):
    with pytest.raises(ArithmeticError, match="has not converged"):
        ST.gamma_p(np.array([1e13]), np.array([1e13]))
    assert abs(float(ST.regularized_beta(np.array([0.5]), np.array([1e5]), np.array([1e5]))[0]) - 0.5) < 1e-6


def test_clustal_names_have_to_differ(spark):
    name = "n" * 45
    rows = spark.createDataFrame([("x", k, f"{name}{k}", "ACGT") for k in range(2)], "alignment_id string, row_no int, name string, sequence string")
    with pytest.raises(Exception, match="CLUSTAL keeps"):
        writers.alignment_text(rows, "clustal").collect()

"""Operators on small fixtures with known answers."""

import json

import pytest
from pyspark.sql import functions as F

from clonespark.functions import sequences as S
from clonespark.functions.register import register_functions
from clonespark.operators import chimera as CH
from clonespark.operators import collapse as CO
from clonespark.operators import selection as SL
from clonespark.operators import shm as SH
from clonespark.operators.annotate import AnnotateOptions, annotate
from clonespark.operators.double_d import DoubleDOptions, screen_double_d
from clonespark.operators.quality import QualityOptions, filter_reads
from clonespark.operators.reference import parse_germline
from clonespark.plans.config import StudyConfig, dump_config, load_config


def _one(spark, expression, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(expression.alias("x")).first()[0]


def test_sequence_functions(spark):
    assert _one(spark, S.normalize_nt("s"), s="ac-gu.nx") == "ACGTN"
    assert _one(spark, S.call_set("s", "gene", "overlap"), s=" ighv2*01,IGHV1*03, ighv2*02") == ["IGHV1", "IGHV2"]
    assert _one(spark, S.call_set("s", "allele", "top"), s="a*02,b*01") == ["A*02"]
    assert _one(spark, S.translate_nt("s"), s="GCCTAANNNA") == "A*X"
    assert _one(spark, S.reverse_complement("s"), s="ACGTN") == "NACGT"
    assert _one(spark, S.isotype_label("s"), s="IGHG1*01") == "IgG1"
    assert _one(spark, S.longest_match_run("a", "b"), a="ACG-TACG", b="ACGTTACC") == 3
    assert _one(spark, S.hotspot("s", F.lit(3)), s="AACC") and not _one(spark, S.hotspot("s", F.lit(3)), s="CCCC")
    assert _one(spark, S.multiplicity("s"), s="2.9") == 2 and _one(spark, S.multiplicity("s"), s="") == 1
    words = S.packed_words("a", 2), S.packed_words("b", 2)
    a, b = "ACGTN" * 8, "ACGTA" * 8
    assert _one(spark, S.packed_hamming(*words), a=a, b=b) == 8


def test_registered_sql_functions(spark):
    register_functions(spark)
    row = spark.sql("SELECT hamming_within('ACGT', 'ACGA', 1) AS h, normalize_nt('acu-') AS n, poisson_upper_tail(0D, 0.1D) AS p").first()
    assert row.h and row.n == "ACT" and row.p == pytest.approx(0.0951625819)


COLLAPSE = "ordinal long, weight long, sequence_nt string, trimmed_nt string, cdr3_nt string, locus string, v_call string, j_call string, c_call string, dataset_id string, sample_id string, subject_id string, cohort string"


def _rows(spark, rows):
    return spark.createDataFrame([(i, w, s, s, s, "IGH", "V1", "J1", c, "", "", "", "") for i, (s, w, c) in enumerate(rows)], COLLAPSE)


def test_collapse_literals(spark):
    groups = CO.collapse(_rows(spark, [("A", 7, ""), ("A", 3, ""), ("B", 1, "")]), "sequence")
    assert {(r.representative, r["count"]) for r in groups.collect()} == {(0, 10), (2, 1)}
    isotypes = _rows(spark, [("A", 1, "IGHM*01"), ("A", 1, "IGHG1*03"), ("A", 1, "IGHM*02")])
    assert CO.collapse(isotypes, "trimmed").count() == 2
    assert CO.collapse(isotypes, "trimmed", respect_constant=False).count() == 1
    empty = _rows(spark, [("", 9, "")])
    assert CO.collapse(empty, "trimmed").count() == 0
    assert CO.collapse(empty, "trimmed", unresolved="retain").first()["count"] == 9
    assert CO.collapse_members(empty, "trimmed").first().representative is None


def test_hypermutation_literals(spark):
    columns = ["ordinal", "v_call", "j_call", "v_sequence_alignment", "v_germline_alignment", "duplicate_count"]
    rows = [
        (0, "V1*01", "J1", "GCCGATGCT", "GCTGCTGCT", "3"),
        (1, "V1*01", "J1", "GC-GATGCT", "GCTGCTGCT", ""),
        (2, "V1*01", "J1", "NNN", "ACG", "1"),
    ]
    found = {r.ordinal: r for r in SH.shm_metrics(spark.createDataFrame(rows, columns)).collect()}
    assert (found[0].v_nt_mutations, found[0].synonymous, found[0].v_aa_replacements, found[0].weight) == (2, 1, 1, 3)
    # the gap breaks its codon and delays the frame by one read base
    assert found[1].compared_nt == 8 and found[1].compared_codons == 1 and found[1].v_nt_mutations == 1
    assert 2 not in found


def test_weighted_quantile_is_a_step(spark):
    rows = spark.createDataFrame([("a", 0.1, 1), ("a", 0.2, 1), ("a", 0.9, 8)], "g string, x double, weight long")
    got = SH.weighted_distribution(rows, "x", ["g"]).first()
    assert (got.median, got.p95, got.abundance, got.maximum) == (0.9, 0.9, 10, 0.9)


def test_selection_validation():
    assert SL.validate_selection(SL.Selection(min_cdr3_aa_length=5, max_cdr3_aa_length=3))
    assert SL.validate_selection(SL.Selection(motif="(", motif_syntax="regex"))
    assert not SL.validate_selection(SL.Selection(motif="(", motif_syntax="substring"))


def test_quality_filter(spark):
    reads = spark.createDataFrame([("a", "ACGTACGT", "IIIIII##"), ("b", "ACGT", "####"), ("c", "ACGT", "++++")], "id string, sequence string, quality string")
    kept = {r.id: r.sequence for r in filter_reads(reads, QualityOptions(window=2, min_mean_phred=20, max_expected_errors=1.0)).collect()}
    assert kept == {"a": "ACGTACG"}
    with pytest.raises(ValueError):
        QualityOptions(max_expected_errors=-1)


def test_chimera_statuses(spark):
    import random

    rng = random.Random(8)
    a, b = ("".join(rng.choice("ACGT") for _ in range(150)) for _ in range(2))
    panel = spark.createDataFrame([("V1*01", a), ("V2*01", b)], "name string, sequence string")
    mosaic = a[:75] + b[75:]
    rows = [
        (0, "V1*01", a, a), (1, "V1*01", mosaic, a), (2, "", a, a), (3, "V9*01", mosaic, a), (4, "V1*02", mosaic[10:], a[10:]),
    ]
    table = spark.createDataFrame(rows, "ordinal long, v_call string, v_sequence_alignment string, v_germline_alignment string")
    options = CH.ChimeraOptions(detailed=True)
    got = {r.ordinal: r for r in CH.score_chimeras(table, panel, options).collect()}
    assert [got[i].status for i in range(5)] == ["low_dfr", "evaluated", "missing_alignment", "missing_reference", "evaluated"]
    assert got[1].flagged and got[4].flagged and got[1].starting_reference == "V1*01"
    assert [x.right for x in got[1].recombinations] == ["V2*01"]
    assert {r.ordinal for r in CH.retained(CH.score_chimeras(table, panel, options), options).collect()} == {0, 2, 3}


def test_annotation_recovers_the_truth(spark):
    import random

    rng = random.Random(21)
    genes = [("V", f"IGHV{i}*01", "".join(rng.choice("ACGT") for _ in range(117)) + "TGT" + "".join(rng.choice("ACG") for _ in range(6))) for i in range(3)]
    genes += [("D", "IGHD1*01", "GGTACAACGATTAC"), ("J", "IGHJ1*01", "ACTACTGGGGCCAGGGAACCCTGGTCACC"), ("J", "IGHJ2*01", "TTCGATCTTTGGGGCCGTGGCACCATGGT")]
    rows = [(s, n, "IGH", q, 0, 4 if n == "IGHJ1*01" else -1, 120 if s == "V" else -1) for s, n, q in genes]
    germlines = spark.createDataFrame(rows, "segment string, name string, locus string, sequence string, frame int, cdr3_stop int, fwr3_end int")
    v, d, j = genes[1][2], "GGTACAACGATTAC", "ACTACTGGGGCCAGGGAACCCTGGTCACC"
    read = v[:40] + ("A" if v[40] != "A" else "C") + v[41:] + "AC" + d + "TTG" + j
    turned = read[::-1].translate(str.maketrans("ACGT", "TGCA"))
    reads = spark.createDataFrame([(0, read), (1, turned), (2, read), (3, "ACGT")], "ordinal long, sequence string")
    got = {r.ordinal: r for r in annotate(reads, germlines, AnnotateOptions()).collect()}
    for i in (0, 1, 2):
        assert (got[i].v_call, got[i].d_call, got[i].j_call) == ("IGHV1*01", "IGHD1*01", "IGHJ1*01")
        assert got[i].rev_comp == ("T" if i == 1 else "F")
        assert got[i].junction.startswith("TGT") and got[i].junction.endswith("TGG")
        assert got[i].cdr3 == got[i].junction[3:-3] and got[i].v_identity < 1
    assert got[3].v_call is None


def test_second_d(spark):
    genes = spark.createDataFrame([("D1", "IGH", "GGTACAACGATTACGT"), ("D2", "IGH", "CCATGGCTAAGCCTAT")], "name string, locus string, sequence string")
    window = "AA" + "GGTACAACGATTACGT" + "TTT" + "CCATGGCTAAGCCTAT" + "CC"
    rows = [(0, window, "IGH"), (1, "AA" + "GGTACAACGATTACGT" + "TTTTTTTT", "IGH"), (2, window, "IGK")]
    got = screen_double_d(spark.createDataFrame(rows, "ordinal long, window string, locus string"), genes, DoubleDOptions()).collect()
    assert [(r.ordinal, r.d_call, r.d2_call, r.inter_d_length) for r in got] == [(0, "D1", "D2", 3)]


def test_germline_metadata(spark):
    good = ("IGHV1*01", "XMETA=0,-1,0,10,10,20,20,30,30,40,40,50,1", "acgu")
    fasta = spark.createDataFrame([good, ("IGHV2*01", "", "AC")], "id string, description string, sequence string")
    rows = {r.name: r for r in parse_germline(fasta).collect()}
    assert rows["IGHV1*01"].fwr3_end == 50 and rows["IGHV1*01"].sequence == "ACGT" and rows["IGHV2*01"].frame is None
    bad = spark.createDataFrame([("IGHV1*01", "XMETA=0,1", "AC")], "id string, description string, sequence string")
    with pytest.raises(Exception, match="Malformed"):
        parse_germline(bad).collect()


def test_config_round_trip():
    config = load_config(json.dumps({"collapse": {"mode": "indel", "denoise": {"alpha": 0.05}}, "refinement": {"segments": ["V"]}}))
    assert config.collapse.denoise.alpha == 0.05 and config.refinement.segments == ("V",)
    assert load_config(dump_config(config)) == config and load_config("{}") == StudyConfig()
    with pytest.raises(ValueError):
        load_config('{"collapse": {"colour": 1}}')


def test_dashboards_count_productive_rows_of_typed_tables(spark):
    from clonespark.operators.facets import gene_usage, summary_counts
    from clonespark.sources.readers import typed

    rows = [("a", "T", "IGHV1-1*01", "IGHJ1*01", "TGT", "IGH"), ("b", "F", "IGHV1-1*01", "IGHJ1*01", "TGT", "IGH")]
    table = spark.createDataFrame(rows, "sequence_id string, productive string, v_call string, j_call string, cdr3 string, locus string")
    for view in (table, typed(table)):
        assert summary_counts(view).first()["productive"] == 1
        usage = {(r.status, r.locus_bucket): r.records for r in gene_usage(view).collect()}
        assert usage["productive", "*"] == 1 and usage["all", "IGH"] == 2


def test_a_lineage_numbered_zero_is_observed(spark):
    from clonespark.operators.missing import observations

    rows = [(k, k, "IGHV1*01", "IGHJ1*01", "s", "TGTGCA", "ACGTAC", "ACGTAG", "1") for k in range(3)] + [(9, None, "IGHV1*01", "IGHJ1*01", "s", "TGT", "ACG", "ACG", "1")]
    table = spark.createDataFrame(
        rows, "ordinal long, lineage_id long, v_call string, j_call string, subject_id string, cdr3 string, v_sequence_alignment string, v_germline_alignment string, v_germline_start string"
    )
    assert sorted(r.lineage_id for r in observations(table).collect()) == [0, 1, 2]


def test_consensus_of_columns_without_votes(spark):
    from clonespark.operators.consensus import anchored_rows, consensus_germline

    rows = [(0, 0, "a", "T", "NNAC", "NNAC", "ACAC", "1"), (1, 0, "b", "T", "NN-C", "NN-C", "NC", "20001")]
    table = spark.createDataFrame(rows, "ordinal long, lineage_id long, sequence_id string, productive string, sequence_alignment string, germline_alignment string, sequence string, v_germline_start string")
    first = consensus_germline(anchored_rows(table.filter("ordinal = 0"))).first()
    assert first.template == "NNAC" and first.uca == "NNAC"
    assert consensus_germline(anchored_rows(table)).first().end_column == 20_004  # a distant start is honoured

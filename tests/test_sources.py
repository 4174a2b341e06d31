"""Readers, writers, the stream and the whole study on files."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from clonespark.plans.config import load_config
from clonespark.plans.workflow import run_study
from clonespark.sources import readers, trees, writers
from clonespark.streaming.ingest import commit_batches, running_facets, stream_rearrangements


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">r1 first\nACGT\nAC\n\n>r2\nGG\n")
    (tmp_path / "b.fasta").write_text(">r3\r\nTT\r\n")
    got = {r.id: (r.description, r.sequence) for r in readers.read_fasta(spark, str(tmp_path)).collect()}
    assert got == {"r1": ("first", "ACGTAC"), "r2": ("", "GG"), "r3": ("", "TT")}
    (tmp_path / "c.fasta").write_text(">empty\n")
    with pytest.raises(Exception, match="without bases"):
        readers.read_fasta(spark, str(tmp_path / "c.fasta")).collect()


def test_fastq_ranges_lose_nothing(spark, tmp_path):
    rng = random.Random(3)
    records = []
    for i in range(400):
        n = rng.randrange(5, 40)
        records.append((f"r{i}", "".join(rng.choice("ACGT") for _ in range(n)), "".join(rng.choice("@+I#A") for _ in range(n))))
    text = "".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in records)
    (tmp_path / "x.fastq").write_text(text)
    with gzip.open(tmp_path / "y.fastq.gz", "wt") as f:
        f.write(text)
    readers.read_fastq(spark, str(tmp_path / "x.fastq"))  # registers the source
    for name, layout in (("x.fastq", "four-line"), ("y.fastq.gz", "four-line"), ("x.fastq", "wrapped")):
        df = spark.read.format("fastq_reads").option("layout", layout).option("rangeBytes", 700).load(str(tmp_path / name))
        assert sorted((r.id, r.sequence, r.quality) for r in df.collect()) == sorted(records)


def test_airr_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("read,1", 'a "quote"', "ACGT", True, 0.5), ("x\ty", None, "GG", None, None)], "sequence_id string, note string, sequence string, productive boolean, v_identity double")
    for kind in ("tsv", "csv", "jsonl"):
        writers.write_table(rows, str(tmp_path / kind), kind)
    back = {r.sequence: r for r in readers.read_airr(spark, str(tmp_path / "csv")).collect()}
    assert back["ACGT"].note == 'a "quote"' and back["ACGT"].productive == "T" and back["GG"].note == ""
    typed = {r.sequence: r for r in readers.typed(readers.read_airr(spark, str(tmp_path / "tsv"))).collect()}
    assert typed["ACGT"].v_identity == 0.5 and typed["GG"].productive is None and typed["GG"].sequence_id == "x y"
    with pytest.raises(ValueError):
        readers.read_airr(spark, str(tmp_path / "jsonl"), "\t")


def test_ordinals_are_dense(spark):
    df = spark.range(1000).select(F.format_string("%04d", F.col("id")).alias("k")).repartition(7)
    got = readers.with_ordinals(df, ["k"]).collect()
    assert all(int(r.k) == r.ordinal for r in got) and len(got) == 1000


def test_alignment_formats(spark):
    rows = spark.createDataFrame([("m", 0, "a b", "AC-T"), ("m", 1, "c", "ACGT")], "alignment_id string, row_no int, name string, sequence string")
    text = {k: writers.alignment_text(rows, k).first().value for k in ("fasta", "phylip", "clustal", "stockholm", "nexus")}
    assert text["fasta"] == ">a b\nAC-T\n>c\nACGT" and text["phylip"].startswith("2 4\na_b AC-T")
    assert "datatype=DNA" in text["nexus"] and text["stockholm"].endswith("//") and "ACGT" in text["clustal"]


def test_trees(spark):
    edges = trees.parse_newick(spark.createDataFrame([("t", "((a:1,b:2)x:0.1,c:3);")], "tree_id string, newick string")).cache()
    depth = {r.name: r.depth for r in trees.node_depths(edges).join(edges.select("tree_id", "node", "name"), ["tree_id", "node"]).collect()}
    assert depth["b"] == pytest.approx(2.1) and depth["c"] == 3
    flat = trees.collapse_short_branches(edges, 0.5).collect()
    assert {r.name: r.parent for r in flat if r.name} == {"a": 0, "b": 0, "c": 0}


def _study(spark):
    rng = random.Random(7)
    v, j = ("".join(rng.choice("ACGT") for _ in range(n)) for n in (60, 20))
    rows = []
    for i in range(12):
        cdr3 = "TGTGCAAGAGACTACTGG" if i < 8 else "TGTACCCCCTTTAAATGG"
        if i % 4 == 3:
            cdr3 = cdr3[:9] + "T" + cdr3[10:]
        rows.append((i, f"r{i}", "l", f"s{i % 2}", "d", "c", "t", "", "IGH", "IGHV1*01", "", "IGHJ1*01", "", cdr3, "", "T", v + cdr3 + j, v + cdr3 + j, v, v, 1, 1, 60, 78 + 20, "1"))
    columns = "ordinal long, sequence_id string, dataset_id string, sample_id string, subject_id string, cohort string, timepoint string, compartment string, locus string, v_call string, d_call string, j_call string, c_call string, cdr3 string, cdr3_aa string, productive string, sequence string, sequence_alignment string, v_sequence_alignment string, v_germline_alignment string, v_sequence_start int, v_germline_start int, v_sequence_end int, j_sequence_end int, duplicate_count string"
    return spark.createDataFrame(rows, columns)


def test_study_and_lineage_files(spark, tmp_path):
    table = _study(spark)
    result = run_study(table, load_config('{"selection": {"enabled": true, "options": {"locus": "IGH"}}}'))
    counts = result.counts()
    # two CDR3s in each sample, and one variant that falls in the odd sample
    assert counts["groups"] == counts["working_set"] == 5 and counts["lineages"] == 2
    summary = {r.representative_cdr3_nt: r.abundance for r in result.frames["lineages"].collect()}
    assert summary == {"TGTGCAAGAGACTACTGG": 8, "TGTACCCCCTTTAAATGG": 4}
    assert sum(r.abundance for r in result.frames["sample_counts"].collect()) == 12
    path = str(tmp_path / "study")
    writers.write_lineage_study(writers.lineage_export(table, result.frames["members"]).withColumnRenamed("clone_id", "lineage_id"), result.frames["lineages"], path, buckets=4)
    ids = sorted(r.lineage_id for r in result.frames["lineages"].collect())
    assert [writers.read_lineage(spark, path, i, verify=True).count() for i in ids] == [8, 4]


def test_partitioning_does_not_matter(spark):
    one = run_study(_study(spark).coalesce(1)).frames["members"].collect()
    many = run_study(_study(spark).orderBy(F.desc("ordinal")).repartition(9)).frames["members"].collect()
    assert sorted(one) == sorted(many)


def test_stream_commits_once(spark, tmp_path):
    table = _study(spark)
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = stream_rearrangements(spark, str(tmp_path / "in"), table.schema, files_per_batch=1)
    commit_batches(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 12
    facets = running_facets(stream_rearrangements(spark, str(tmp_path / "in"), table.schema), ("sample_id", "locus"))
    query = facets.writeStream.outputMode("complete").format("memory").queryName("facets").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r.value, r.records) for r in spark.sql("SELECT * FROM facets").collect()} == {("s0", 6), ("s1", 6), ("IGH", 12)}


def test_fasta_has_to_begin_with_a_header(spark, tmp_path):
    import pytest

    from clonespark.sources.readers import read_fasta

    (tmp_path / "good.fa").write_text("\n\n>a x\nAC\nGT\n>b\nTT\n")
    assert sorted((r.id, r.sequence) for r in read_fasta(spark, str(tmp_path / "good.fa")).collect()) == [("a", "ACGT"), ("b", "TT")]
    for k, text in enumerate(["ACGT\nTTTT\n>b\nACGT\n", "ACGT\nTTTT\n>\n>b\nACGT", "\n\nACGT\n>b\nAC\n", "  >a\nAC\n"]):
        (tmp_path / f"bad{k}.fa").write_text(text)
        with pytest.raises(Exception, match="no header"):
            read_fasta(spark, str(tmp_path / f"bad{k}.fa")).collect()
    (tmp_path / "hollow.fa").write_text(">a\nAC\n>\n>b\nACGT\n")
    with pytest.raises(Exception, match="without bases"):
        read_fasta(spark, str(tmp_path / "hollow.fa")).collect()


def test_fasta_splits_without_a_shuffle(spark, tmp_path):
    from clonespark.sources.readers import read_fasta

    rng = random.Random(5)
    want = {}
    for name in ("x.fa", "y.fa"):
        lines = []
        for k in range(3000):
            bases = "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 90)))
            want[f"{name}_{k}"] = bases
            lines += [f">{name}_{k} some words", *(bases[i : i + 60] for i in range(0, len(bases), 60))]
        (tmp_path / name).write_text("\n" + "\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        frame = read_fasta(spark, str(tmp_path))
        assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()
        assert {r.id: r.sequence for r in frame.collect()} == want and frame.rdd.getNumPartitions() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_compressed_fastq(spark, tmp_path):
    import bz2
    import gzip

    import zstandard

    from clonespark.sources.readers import read_fastq

    text = b"@r1 one\nACGT\n+\nIIII\n@r2\nTT\n+\n@@\n"
    for suffix, pack in ((".gz", gzip.compress), (".bz2", bz2.compress), (".zst", zstandard.ZstdCompressor().compress)):
        path = tmp_path / f"reads.fastq{suffix}"
        path.write_bytes(pack(text))
        assert sorted((r.id, r.sequence, r.quality) for r in read_fastq(spark, str(path)).collect()) == [("r1", "ACGT", "IIII"), ("r2", "TT", "@@")]

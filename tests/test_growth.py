"""Steps whose cost must follow the number of reads."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clonespark.functions import letters
from clonespark.functions.kernels import edit_distances, edit_profile_of, edit_profiles, sketch_of, sketches_of
from clonespark.functions.register import register_functions
from clonespark.operators import alignment_columns, annotate, consensus, double_d, refinement, search, simjoin
from clonespark.plans import catalog as C

SMALL = "/root/testdata/sf0.001"


def _plan(frame, capsys):
    capsys.readouterr()
    frame.explain()
    return capsys.readouterr().out


def test_alleles_are_derived_once(spark, capsys):
    alleles = C._alleles(spark, SMALL)
    assert alleles.count() > 16 and "md5" not in _plan(alleles, capsys)


def test_evidence_does_not_shuffle_reads(spark, capsys):
    rows = C.QUERIES["evidence_rows"](spark, SMALL)
    assert "Exchange" not in _plan(rows, capsys)
    assert rows.groupBy("ordinal").agg(F.sum("weight").alias("w")).filter("abs(w - 1) > 1e-5").isEmpty()


def test_kmer_occurrences(spark):
    register_functions(spark)
    got = spark.sql("SELECT * FROM kmers('ACACA', 2)").collect()
    assert [tuple(r) for r in got] == [("AC", 1, 1), ("CA", 2, 1), ("AC", 3, 2), ("CA", 4, 2)]


def test_edit_join_probes_few_places_and_measures_wanted_pairs_only(spark):
    texts = spark.createDataFrame([(i, "p", "ACGT" * 10 + "AC" * i, i) for i in range(1, 4)], "id long, part string, seq string, count long")
    frame = texts.select("id", "part", "seq", F.col("seq").alias("rest"), F.explode(F.array(*[F.length("seq") + d for d in range(-2, 3)])).alias("rlen"), F.lit(2).alias("lim"), F.lit("").alias("path"))
    assert {r["count"] for r in simjoin._probing_segments(frame).groupBy("id").count().collect()} == {19}  # 75 with every shift by two
    found = simjoin.edit_pairs(texts, texts, limit=2, above="count").collect()
    assert {tuple(r) for r in found} == {(1, 2, 2), (2, 3, 2)}


def test_edit_kernels_equal_the_plain_rules():
    pick = random.Random(5)
    for limit in (0, 1, 2, 4):
        pairs = []
        for _ in range(400):
            letters = pick.choice(["ACGT", "AC", "Aé"])
            parent = "".join(pick.choices(letters, k=pick.choice([0, 1, 2, 5, 30])))
            child = list(parent)
            for _ in range(pick.randint(0, limit + 1)):
                at = pick.randint(0, len(child))
                child[at : at + pick.randint(0, 1)] = pick.choices(letters, k=pick.randint(0, 1))
            pairs.append((parent, "".join(child)))
        parents, children = (pa.array(x, pa.string()) for x in zip(*pairs, strict=True))
        wanted = [list(edit_profile_of(*p, limit) or [-1] * 4) for p in pairs]
        assert edit_profiles(parents, children, limit).tolist() == wanted
        assert edit_distances(parents.slice(7), children.slice(7), np.full(len(pairs) - 7, limit)).tolist() == [w[0] for w in wanted[7:]]


def test_reads_are_not_dealt_by_pool_and_posteriors_are_worked_out_once(spark, capsys):
    rows = spark.createDataFrame([(1, "p", [("a", 0.5), ("b", 0.5)])], "ordinal long, pool string, entries array<struct<node:string,weight:double>>")
    usage = spark.createDataFrame([("p", "a", -1.0, 3, True), ("p", "b", -2.0, 3, True)], "pool string, node string, expected double, iterations int, converged boolean")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scored = refinement._scored(rows, usage)
        plan = _plan(scored, capsys)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and plan.count("ln(") + plan.count("LOG(") == 1
    share = {e["node"]: e["probability"] for e in scored.first()["posterior"]}
    assert abs(share["a"] - 1 / (1 + math.exp(-1))) < 1e-12


def test_region_labels_send_ends_of_runs_only(spark, capsys):
    reads = [(1, "-ACG--TA", 1, 1, 2, 3, 5), (1, "AACGTTTA", 1, 1, 4, 3, 8), (1, "AACGT", 3, 1, 4, None, 8), (2, "", 1, 1, 4, 5, 8), (2, "--é", 1, 0, 4, 1, 1)]
    anchored = spark.createDataFrame(reads, "lineage_id long, aligned_read string, v_sequence_start int, fwr1_start int, fwr1_end int, cdr1_start int, cdr1_end int")
    found = consensus.region_labels(anchored)
    assert "posexplode" not in _plan(found, capsys)
    votes = {}
    for lineage, text, start, *bounds in reads:
        for rank, i in enumerate(i for i, c in enumerate(text) if c != "-"):
            inside = [r for r, (a, b) in zip(("fwr1", "cdr1"), (bounds[:2], bounds[2:]), strict=True) if a and b and a <= start + rank <= b]
            if inside:
                count = votes.setdefault((lineage, i + 1), {})
                count[inside[0]] = count.get(inside[0], 0) + 1
    assert {tuple(r) for r in found.collect()} == {(*at, min(count, key=lambda r: (-count[r], r))) for at, count in votes.items()}


def test_hamming_query_searches_each_distinct_target_once(spark, capsys):
    texts = ["ACGTACGTAC", "ACGTACGTAG", "ACNTACGTAG", "TTTTTTTTTT"]
    targets = spark.createDataFrame([(i, texts[i % 4]) for i in range(40)], "ordinal long, target string")
    queries = spark.createDataFrame([(7, "ACGTACGTAC")], "query_index long, query string")
    hits = search._hamming(targets, queries, 0.9, True)
    assert "Scan ExistingRDD[target#" in _plan(hits, capsys)  # blocks are cut from these
    assert {(r.ordinal, r.query_index, r.distance) for r in hits.collect()} == {(i, 7, min(i % 4, 1)) for i in range(40) if i % 4 < 3}
    assert hits.count() == 30


def _best_prefix(a: str, b: str) -> tuple[int, int]:
    run = best = at = 0
    for i, (x, y) in enumerate(zip(a, b, strict=False), 1):
        run += 2 if x == y else -2
        if run > best:
            best, at = run, i
    return at, sum(x == y for x, y in zip(a[:at], b[:at], strict=True))


def test_seeds_grow_as_by_the_plain_rule():
    pick = random.Random(3)
    pairs = [tuple("".join(pick.choices("ACé", k=pick.randint(0, 12))) for _ in "ab") for _ in range(500)]
    (a, a0), (b, b0) = (letters.flat([p[side] for p in pairs]) for side in (0, 1))
    counts = np.minimum(np.diff(a0), np.diff(b0))
    forward = double_d.best_prefixes(a, a0[:-1], b, b0[:-1], counts, 1)
    backward = double_d.best_prefixes(a, a0[1:] - 1, b, b0[1:] - 1, counts, -1)
    assert list(zip(*map(np.ndarray.tolist, forward), strict=True)) == [_best_prefix(x, y) for x, y in pairs]
    assert list(zip(*map(np.ndarray.tolist, backward), strict=True)) == [_best_prefix(x[::-1], y[::-1]) for x, y in pairs]


def test_equal_windows_are_screened_once(spark, monkeypatch):
    screened, plain = [], double_d.d_hits
    monkeypatch.setattr(double_d, "d_hits", lambda windows, *rest: screened.append(windows.count()) or plain(windows, *rest))
    genes = spark.createDataFrame([("D1", "IGH", "GGTACAACGATTACGT"), ("D2", "IGH", "CCATGGCTAAGCCTAT")], "name string, locus string, sequence string")
    window = "AAGGTACAACGATTACGTTTTCCATGGCTAAGCCTATCC"
    rows = spark.createDataFrame([(i, window, "IGH") for i in range(5)] + [(9, window, "TRB")], "ordinal long, window string, locus string")
    found = double_d.screen_double_d(rows, genes)
    assert sorted(r.ordinal for r in found.collect()) == [0, 1, 2, 3, 4] and screened == [2]


@pytest.mark.parametrize("name", ["chimera_scores", "shm_lowest_member", "query_sketch"])
def test_texts_are_not_worked_out_again_for_a_filter(spark, capsys, name):
    plan = _plan(C.QUERIES[name](spark, SMALL), capsys)
    derived = [line for line in plan.splitlines() if "Filter" in line and "v_donor" in line]
    assert not derived


def test_sketches_of_many_texts():
    pick = random.Random(7)
    texts = ["".join(pick.choices("ACGTN", k=pick.choice([0, 1, 3, 6, 7, 8, 40, 300]))) for _ in range(400)] + ["NNN", "", "ACGT" * 20_000]
    assert sketches_of(texts).tolist() == [sketch_of(t) for t in texts]
    assert sketches_of([]).shape == (0, 8)


def test_sketch_hits_are_one_row_a_pair(spark):
    text = "ACGTTGCAACGGTTACCAGTAGGCATTA"
    rows = spark.createDataFrame([(1, "", "", "", text), (2, "", "", "", ""), (3, "", "", "", "NNN")], "ordinal long, locus string, v_call string, j_call string, trimmed_nt string")
    queries = spark.createDataFrame([(7, text), (8, "")], "query_index long, sequence string")
    got = search.query_records(rows, queries, search.QueryOptions(target="trimmed", metric="sketch", identity=0.75)).collect()
    assert [(r.ordinal, r.query_index, r.score) for r in got] == [(1, 7, 1.0)]


def test_votes_of_numbered_windows(spark):
    pick = random.Random(9)
    reads = ["".join(pick.choices("ACGTN", [9, 9, 9, 9, 1], k=n)) for n in (0, 3, 4, 50, 200)] + [None]
    genes = ["ACGTACGTTGCA", "ACRTNACGTT", "AC"]
    queries = spark.createDataFrame([(i, False, "", r) for i, r in enumerate(reads)], "rid long, rev boolean, want_locus string, query string")
    germlines = spark.createDataFrame([(f"g{i}", "", g) for i, g in enumerate(genes)], "name string, locus string, sequence string")
    want: dict = {}
    for i, r in enumerate(reads):
        for j, g in enumerate(genes):
            for a in range(len(r or "") - 3):
                for b in range(len(g) - 3):
                    if r[a : a + 4] == g[b : b + 4] and set(r[a : a + 4]) <= set("ACGT"):
                        key = (i, f"g{j}", (a - b) // 4 * 4)
                        want[key] = want.get(key, 0) + 4
    votes = annotate._votes(queries, germlines, 4, 4)
    assert {(v.rid, v.gene, v.diagonal): v.votes for v in votes.collect()} == want and want


def test_taken_columns(spark):
    rows = spark.createDataFrame([(1, "ACé-T", [5, 3, 9, 0, 1]), (2, "", [1]), (3, None, [1]), (4, "AC", None), (5, "AC", [])], "id int, aligned string, columns array<int>")
    got = {r.id: r.t for r in rows.select("id", letters.taken(F.coalesce("aligned", F.lit("")), "columns").alias("t")).collect()}
    assert got == {1: "TéA", 2: "", 3: "", 4: "", 5: ""}
    chosen = spark.createDataFrame([(1, 2), (1, 1)], "id int, column int")
    assert {r.id: r.aligned for r in alignment_columns.take_columns(rows.drop("columns"), chosen, ["id"]).collect()} == {1: "AC", 2: "", 3: "", 4: "", 5: ""}


def test_column_tallies_equal_plain_counts(spark):
    pick = random.Random(11)
    rows = [(pick.choice([1, 2, 40]), *["".join(pick.choices("ACGTN-", k=pick.choice([0, 3, 9]))) for _ in "qg"]) for _ in range(200)] + [(9, None, "ACGT")]
    frame = spark.createDataFrame(rows, "lineage_id long, aligned_read string, aligned_germline string").repartition(3)
    want: dict = {}
    for lineage, q, g in rows:
        for i in range(max(len(q), len(g)) if q is not None else 0):
            a, b = q[i : i + 1], g[i : i + 1]
            cell = want.setdefault((lineage, i + 1), [0] * 9)
            for k, base in enumerate("ACGT"):
                cell[k] += b == base
                cell[4 + k] += a == base
            cell[8] += a not in ("", "-") or b not in ("", "-")
    got = {(r.lineage_id, r.column): [r[v] for v in (*consensus.VOTES, "coverage")] for r in consensus.column_votes(frame).collect()}
    assert got == want
    members = {r.lineage_id: r.coverage for r in consensus._tallies(frame).filter("column = 0").collect()}
    assert members == {k: sum(r[0] == k for r in rows) for k in (1, 2, 40, 9)}


def test_identity_counts_and_unequal_columns(spark):
    rows = spark.createDataFrame([(1, "ACGU-N", "ACCT--ACGT"), (2, "", "A"), (3, None, "A"), (4, "RA.", "RAA")], "id int, q string, g string")
    counts = rows.select("id", consensus.identity_counts("q", "g").alias("c")).collect()
    assert {r.id: tuple(r.c) for r in counts} == {1: (3, 4), 2: (0, 0), 3: (0, 0), 4: (1, 1)}
    unequal = rows.filter("q IS NOT NULL").select("id", letters.unequal_columns("q", "g").alias("n")).collect()
    assert {r.id: r.n for r in unequal} == {1: 3, 2: 0, 4: 1}


def test_alignment_columns_are_made_by_a_generator(spark, capsys):
    register_functions(spark)
    pick = random.Random(13)
    pairs = [(i, *(pick.choice([None, "", *["".join(pick.choices(letters, k=pick.randint(1, 9))) for letters in ("AC-", "-", "A-é𝄞")]]) for _ in "qr")) for i in range(300)]
    spark.createDataFrame(pairs, "id long, q string, r string").createOrReplaceTempView("column_pairs")
    found = spark.sql("SELECT * FROM column_pairs, LATERAL alignment_columns(q, r)")
    plan = _plan(found, capsys)
    assert "Generate posexplode" in plan and "EvalPythonUDTF" not in plan and "Join" not in plan
    want = []
    for pair in pairs:
        texts = [t or "" for t in pair[1:]]
        for i in range(max(map(len, texts))):
            letter = [t[i] if i < len(t) else None for t in texts]
            at = [None if c in (None, "-") else len(t[: i + 1].replace("-", "")) for c, t in zip(letter, texts, strict=True)]
            want.append((*pair, i + 1, *letter, *at))
    assert sorted(map(tuple, found.collect()), key=lambda r: (r[0], r[3])) == want

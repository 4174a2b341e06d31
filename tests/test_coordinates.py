"""Coordinate tools, reading frames, column choices and bounded samples against plain Python."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from clonespark.functions import coordinates as CD
from clonespark.functions.sequences import CODON_TABLE
from clonespark.operators import alignment_columns as AC
from clonespark.operators import sampling as SA

ALIGNED = ["", "-", "---", "ACGT", "-AC--G-T-", "A-C-G-T", "acgu-nN", "AC.GT", "--AC", "AC--", "ATGNNNTAA---TAG", "A" * 300 + "-" * 5 + "C" * 7, None]


@pytest.fixture(scope="module")
def aligned(spark):
    return spark.createDataFrame(list(enumerate(ALIGNED)), "n int, s string")


def by_n(frame, *columns):
    return {r["n"]: r for r in frame.select("n", *columns).collect()}


def test_rank_and_select(aligned):
    got = by_n(aligned, CD.residue_columns("s").alias("c"), CD.residue_ranks("s").alias("r"))
    for n, s in enumerate(ALIGNED):
        s = s or ""
        assert got[n].c == [i for i, c in enumerate(s, 1) if c != "-"]
        assert got[n].r == [i - s[:i].count("-") for i in range(1, len(s) + 1)]


def fill(s):
    return s + "-" * (3 - len(s)) if 0 < len(s) < 3 else s


def project(dna, residues, frame):
    clean = dna.replace("-", "").upper().replace("U", "T")
    offset = max(0, min(2, frame or 0))
    out, at = fill(clean[:offset]), offset
    for c in residues:
        if c == "-":
            out += "---"
        else:
            out += (clean[at : at + 3] + "---")[:3]
            at += 3
    return out + fill(clean[at:])


def test_projection(spark):
    rows = [(d, p, f) for d in ("", "A", "ACGTACGTA", "ac-gu-ACGTAC-", "ACGTACGTAC") for p in ("", "-", "TYV", "-T--YV-", "TYVTYV") for f in (-1, 0, 1, 2, 7, None)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, d string, p string, f int")
    got = by_n(frame, CD.project_codons("d", "p", F.col("f")).alias("x"))
    assert {i: got[i].x for i in got} == {i: project(*r) for i, r in enumerate(rows)}


def test_three_translations(aligned):
    got = by_n(aligned, *[e.alias(k) for k, e in {"u0": CD.translate_ungapped("s"), "u1": CD.translate_ungapped("s", 1), "g": CD.translate_segment("s"), "c0": CD.translate_columns("s"), "c2": CD.translate_columns("s", 2)}.items()])
    for n, s in enumerate(ALIGNED):
        s = s or ""
        clean, upper = s.replace("-", "").upper().replace("U", "T"), s.upper()
        for frame in (0, 1):
            assert got[n][f"u{frame}"] == "".join(CODON_TABLE.get(clean[i : i + 3], "X") for i in range(frame, len(clean) - 2, 3))
        assert got[n].g == "".join("-" if "-" in upper[i : i + 3] else CODON_TABLE.get(upper[i : i + 3], "X") for i in range(0, len(upper) - 2, 3))
        for frame in (0, 2):
            codons = [upper[i : i + 3] for i in range(frame, len(upper), 3)]
            assert got[n][f"c{frame}"] == "".join("-" if c == "---" else CODON_TABLE.get(c, "X") for c in codons)


def test_segment_residues(spark):
    rows = [(0, "ATG-AAA", "ATGCAAA", 1, 1), (1, "A-TGAAA", "ACTGAAA", 3, 1), (2, "", "A", 1, 1), (3, "ATG", "ATG", 0, 1), (4, "ATG", "ATG", None, 2), (5, "-", "A", 2, 1), (6, "CCATG", "CCATG", 2, 1)]
    got = by_n(spark.createDataFrame(rows, "n int, q string, g string, s int, f int"), CD.segment_residues("q", "g", "s", "f").alias("p"), CD.frame_offset("s", "f").alias("k"))
    assert [got[n].k for n in range(7)] == [0, 1, 0, 0, 0, 2, 2]
    # row 1 begins one base before a codon: columns from the second on, "-TGAAA" and "CTGAAA"
    assert {n: tuple(got[n].p) if got[n].p else None for n in got} == {0: ("M-", "MQ"), 1: ("-K", "LK"), 2: None, 3: None, 4: None, 5: None, 6: ("M", "M")}


def cells(s, motifs, alphabet):
    out = [0] * len(s)
    columns = [i for i, c in enumerate(s) if c != "-"]
    query = s.upper().replace("-", "")
    for k, motif in enumerate(motifs, 1):
        motif = "".join(motif.upper().split()).replace("-", "")
        for a in range(len(query) - len(motif) + 1 if motif else 0):
            pairs = list(zip(motif, query[a:], strict=False))
            if all((q in CD.MOTIF_CODES.get(m, m)) if alphabet == "nt" else m in "X." or m == q for m, q in pairs):
                for i in range(a, a + len(motif)):
                    out[columns[i]] = out[columns[i]] or k
    return out


@pytest.mark.parametrize("alphabet", ["nt", "aa"])
def test_motif_cells(aligned, alphabet):
    motifs = ["W-R C", "N.", "", "GT", "a", "X"] if alphabet == "nt" else ["A.", "XG", "T", ""]
    for chosen in (motifs, motifs[::-1], []):
        got = by_n(aligned, CD.motif_cells("s", chosen, alphabet).alias("x"))
        assert {n: r.x for n, r in got.items()} == {n: cells(s or "", chosen, alphabet) for n, s in enumerate(ALIGNED)}
    with pytest.raises(ValueError, match="holds"):
        CD.motif_cells("s", ["A("])


def test_masses(spark):
    rows = [[], [0.0, 0.0, 0.0], [1.0, 2.0, 3.0], [float("nan"), 1.0, None], [-1.0, float("inf"), 5.0], [0.1] * 7]
    got = by_n(spark.createDataFrame(list(enumerate(rows)), "n int, v array<double>"), CD.normalized_masses("v").alias("x"))
    assert got[0].x == [] and got[3].x == [0.0, 1.0, 0.0] and got[4].x == [0.0, 0.0, 1.0]
    assert all(abs(a - 1 / 3) < 1e-15 for a in got[1].x) and all(math.isclose(sum(r.x), 1.0, abs_tol=1e-16) for n, r in got.items() if n)


def test_reading_frame(spark):
    rng = random.Random(4)
    rows = []
    for group in range(6):
        for _ in range(5):
            body = "".join(rng.choice("ACGTN") if rng.random() < 0.9 else "-" for _ in range(rng.randint(0, 40)))
            rows.append((group, "ACG"[: group % 3] + "---" * (group // 3) + body.lower().replace("n", "."), ))
    rows.append((9, "")), rows.append((10, "AC"))
    for preferred in (0, 2):
        got = {r.g: r for r in AC.reading_frame(spark.createDataFrame(rows, "g int, aligned string"), ["g"], preferred=preferred).collect()}
        assert set(got) == {g for g, _ in rows}
        for g in got:
            best = []
            for offset in range(3):
                n = Counter()
                for s in (s.upper().replace(".", "-") for h, s in rows if h == g):
                    for i in range(offset, len(s) - 2, 3):
                        c = s[i : i + 3]
                        n["whole" if c == "---" else "mixed" if "-" in c else "unclear" if set(c) - set("ACGT") else "stop" if CODON_TABLE[c] == "*" else ""] += 1
                best.append((n["mixed"], n["stop"], -n["whole"], n["unclear"], offset != preferred, offset))
            r, b = got[g], min(best)
            assert (r.mixed_gap_codons, r.stop_codons, -r.complete_gap_codons, r.ambiguous_codons, r.frame) == (*b[:4], b[5])


def test_column_choices(spark):
    labels = ["31", "31A", "32", "33", "4"]
    assert AC.parse_columns("31A", labels, 5) == [2] and AC.parse_columns("33-31a;4", labels, 5) == [2, 3, 4, 5]
    assert AC.parse_columns(" 2, 4-5\n99 x 0 3-99", [], 5) == [2, 4, 5] and AC.parse_columns("4", labels, 5) == [5] and AC.parse_columns("", [], 5) == []
    rows = spark.createDataFrame([(1, "ABCDE"), (1, "AB"), (2, "VWXYZ"), (3, None)], "g int, aligned string")
    region = spark.createDataFrame([(1, 1, "fwr1"), (1, 2, "cdr1"), (1, 3, None), (1, 4, "cdr2"), (2, 5, "cdr1"), (2, 1, "fwr1")], "g int, column int, region string")

    def taken(preset):
        return sorted(r.aligned for r in AC.take_columns(rows, AC.preset_columns(region, preset, ["g"]), ["g"]).collect())

    assert taken("cdrs") == ["", "B", "BD", "Z"] and taken("fwr1") == ["", "A", "A", "V"] and taken("custom") == ["", "", "", ""]
    assert taken("variable") == ["", "AB", "ABD", "VZ"] and taken("full") == ["", "AB", "ABCD", "VZ"]
    assert sorted(r.aligned for r in AC.take_columns(rows, [5, 1], []).collect()) == ["", "A", "EA", "ZV"]
    assert sorted(r.aligned for r in AC.take_columns(rows, [], []).collect()) == [""] * 4


def test_retained_rows(spark):
    alignment = spark.createDataFrame([("read_a__3",), ("read_b__3",), ("x__1",), ("consensus",), ("__",), (None,), ("y__99999999999999999999",)], "name string")
    rows = spark.createDataFrame([(k,) for k in range(6)], "ordinal long")
    assert sorted(r.ordinal for r in AC.retained_rows(alignment, rows).collect()) == [0, 2]


def test_samples_with_one_group_of_a_third(spark):
    rng = random.Random(7)
    rows = [(k, 1 if k % 3 == 0 else rng.randint(2, 60), f"s{rng.randint(0, 2)}") for k in range(6000)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "ordinal long, lineage_id long, sample_id string").repartition(7)
    groups = defaultdict(list)
    for ordinal, lineage, sample in rows:
        groups[lineage, sample].append(ordinal)
    for limit in (1, 13, 5000):
        got = defaultdict(list)
        for r in SA.capped_sample(frame, limit).collect():
            got[r.lineage_id, r.sample_id].append(r.ordinal)
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v)[:limit] for k, v in groups.items()}
    members = Counter(lineage for _, lineage, _ in rows)
    one, two = ([tuple(r) for r in SA.member_sample(frame.repartition(n), 25).orderBy("lineage_id", "ordinal").collect()] for n in (2, 9))
    assert one == two and Counter(r[0] for r in one) == {k: min(25, n) for k, n in members.items()} and all(r[2] == members[r[0]] for r in one)
    assert len({r[1] // 600 for r in one if r[0] == 1}) > 4  # spread over the dominant lineage
    some = SA.member_sample(frame, 3, spark.createDataFrame([(1,), (1,), (777,)], "lineage_id long")).collect()
    assert {r.lineage_id for r in some} == {1} and len(some) == 3
    assert SA.first_per_group(frame, ["lineage_id"], [F.col("ordinal")], 0).count() == 0

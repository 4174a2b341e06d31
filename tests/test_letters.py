"""Column tools on long texts: their cost follows the number of letters."""

import random
import time
from collections import Counter

from clonespark.functions import coordinates as CD
from clonespark.functions import letters as LT
from clonespark.operators import alignment_columns as AC


def _long(n, seed=1):
    rng = random.Random(seed)
    return "".join(rng.choices("ACGT-N", [9, 9, 9, 9, 2, 1], k=n))


def _timed(action):
    begin = time.monotonic()
    return action(), time.monotonic() - begin


def test_reading_frame_of_long_rows(spark):
    s = _long(60_000)
    (row,), seconds = _timed(lambda: AC.reading_frame(spark.createDataFrame([(1, s)] * 4, "g int, aligned string"), ["g"]).collect())
    cut = [s[i : i + 3] for i in range(row.frame, len(s) - 2, 3)]
    assert row.mixed_gap_codons == 4 * sum("-" in c and c != "---" for c in cut)
    assert row.stop_codons == 4 * sum(c in ("TAA", "TAG", "TGA") for c in cut)
    assert seconds < 20  # every codon used to clean the whole text again


def test_pieces_of_a_batch(monkeypatch):
    monkeypatch.setattr(LT, "PIECE", 7)
    texts = ["", "ACG", "-" * 30, "AC", "TTTTTTTTT", ""]
    parts = [texts[p] for p in LT.pieces(LT.np.array([len(t) for t in texts]))]
    assert len(parts) > 2 and [t for p in parts for t in p] == texts


def test_motifs_of_long_rows(spark):
    s = _long(60_000, 2)
    frame = spark.createDataFrame([(s,), ("",), ("é" + s[:50],)], "s string")
    rows, seconds = _timed(lambda: frame.select(CD.motif_cells("s", ["WRCY", "TCN"]).alias("x")).collect())
    assert [len(r.x) for r in rows] == [len(s), 0, 51] and set(Counter(rows[0].x)) == {0, 1, 2}
    assert rows[2].x[1:40] == rows[0].x[:39]
    assert seconds < 20  # every column used to look through all covered columns


def test_projection_walks_no_lambdas(spark, capsys):
    frame = spark.createDataFrame([("ACGTACGTA", "TY-V", 1)], "d string, p string, f int").select(CD.project_codons("d", "p", 1).alias("x"))
    assert frame.first().x == "A--CGTACG---TA-"
    frame.explain()
    assert "lambdafunction" not in capsys.readouterr().out

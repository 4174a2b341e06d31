import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from clonespark.llm.boosting import fit_forest
from clonespark.llm.katz import discounts, katz_scores, starred
from clonespark.llm.language import identify, mixtures
from clonespark.llm.quality import COUNTS, quality
from clonespark.llm.toxicity import Restorer, char_counts, char_model, decode, fit_logistic, toxicity

from . import brute


def test_quality_counts_and_rules(documents, labels, texts):
    for r in quality(documents, labels).collect():
        counts = brute.quality_counts(texts[r.doc_id])
        assert tuple(r[c] for c in COUNTS) == counts
        assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert r.kept == (not r.base_failed and r.score >= 0.5)


def test_quality_agrees_with_labels(documents, labels):
    judged = quality(documents, labels).join(labels, "doc_id").filter("not base_failed")
    right = judged.agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("double"))).first()[0]
    assert right > 0.95


def test_quality_of_odd_rows(odd, nothing, labels):
    rows = quality(odd, labels).collect()
    assert len(rows) == odd.count() and {r.lang_pred for r in rows} == {"clash"}
    assert all(r.base_failed and not r.kept for r in rows if r.n_words < 50)
    assert quality(nothing, labels).count() == 0
    assert all(r.score == 0.5 for r in quality(odd, labels.filter("false")).collect())


def test_forest_keeps_constraints():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = (x[:, 0] + 0.3 * np.sin(9 * x[:, 0]) - x[:, 1] + 0.3 * rng.normal(size=2000) > 0).astype(float)
    forest = fit_forest(x, y, np.array([1, -1, 0]))
    grid = np.tile(rng.random((50, 1, 3)), (1, 40, 1))
    for k, sign in ((0, 1), (1, -1)):
        line = grid.copy()
        line[:, :, k] = np.linspace(0, 1, 40)
        margin = forest.margin(line.reshape(-1, 3)).reshape(50, 40)
        assert (sign * np.diff(margin, axis=1) >= -1e-12).all()
    assert ((forest.probability(x) > 0.5) == (y == 1)).mean() > 0.8


def katz(texts, held):
    tokens = {i: [*brute.words(brute.lower(t)), "</s>\n"] for i, t in texts.items()}
    one, two, history = Counter(), Counter(), Counter()
    for i, ws in tokens.items():
        if not held(i):
            one.update(ws)
            two.update(zip(["<s>\n", *ws], ws, strict=False))
            history.update(["<s>\n", *ws[:-1]])
    n, v = sum(one.values()), len(one)
    lost = [discounts([Counter(c.values())[r] for r in range(1, 7)]) for c in (one, two)]

    def star(c, order):
        return float(starred(np.array([c]), lost[order])[0])

    unknown = 1 - sum(star(c, 0) for c in one.values()) / n if n else 1.0
    low = defaultdict(lambda: unknown, {w: star(c, 0) / n for w, c in one.items()})
    taken, lower = defaultdict(float), defaultdict(float)
    for (h, w), c in two.items():
        taken[h] += star(c, 1)
        lower[h] += low[w]
    alpha = {h: (1 - taken[h] / history[h]) / (1 - lower[h]) for h in history}

    def p(h, w):
        return star(two[h, w], 1) / history[h] if (h, w) in two else alpha.get(h, 1.0) * low[w]

    out = {}
    for i, ws in tokens.items():
        base = sum(math.log10((one[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        out[i] = (len(ws), sum(w in one for w in ws), n, base, sum(math.log10(p(h, w)) for h, w in zip(["<s>\n", *ws], ws, strict=False)))
    return out, p, one, history, unknown


def test_katz_equals_brute_force(documents, texts):
    expected, *_ = katz(texts, lambda i: brute.fold(i, 10) == 0)
    for r in katz_scores(documents, "pmod(crc32(cast(doc_id as string)), 10) = 0").collect():
        own = expected[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (*own[:3], brute.fold(r.doc_id, 10) == 0)
        assert math.isclose(r.base_score, own[3], rel_tol=1e-9) and math.isclose(r.score, own[4], rel_tol=1e-9)


def test_katz_probabilities_add_up_to_one(texts):
    small = dict(list(texts.items())[:30])
    _, p, one, history, unknown = katz(small, lambda i: i % 7 == 0)
    for h in list(history)[:40]:
        assert math.isclose(sum(p(h, w) for w in one) + p(h, "\nunseen"), 1.0, rel_tol=1e-9)
    assert unknown > 0


def test_katz_beats_the_base_on_held_out_texts(documents):
    total = katz_scores(documents, "pmod(crc32(cast(doc_id as string)), 10) = 0").filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert total[0] > total[1]


def test_discounts():
    kept = 1 - discounts([1000, 400, 220, 140, 95, 70]) / np.arange(1, 6)
    assert (kept > 0).all() and (kept < 1).all()
    assert (discounts([0, 0, 0, 0, 0, 0]) == 0.5).all()


def test_katz_of_odd_rows(odd, nothing):
    rows = katz_scores(odd, "doc_id = 6").collect()
    assert len(rows) == odd.count() and all(math.isfinite(r.score) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert {(r.score, r.train_tokens) for r in katz_scores(odd, "true").collect()} == {(0.0, 0)}
    assert katz_scores(nothing).count() == 0


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    out = identify(docs, docs.filter(~held)).filter(held)
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


def test_mixture_of_two_languages(documents, spark):
    sample = {r.lang: r.text for r in documents.filter("n_chars between 800 and 3000").orderBy("doc_id").collect()}
    mixed = spark.createDataFrame([(1, sample["fr"] + "\n" + sample["de"]), (2, sample["fr"])], "doc_id long, text string")
    out = {r.doc_id: {x.lang: x.share for x in r.languages} for r in identify(mixed, documents).collect()}
    assert {"fr", "de"} <= set(out[1]) and min(out[1]["fr"], out[1]["de"]) > 0.2 and set(out[2]) == {"fr"}


def test_mixtures_find_the_likeliest_share():
    rng = np.random.default_rng(3)
    like = np.log(np.array([[0.9, 0.1, 0.05], [0.1, 0.9, 0.05]]))
    words = like[(rng.random(4000) < 0.3).astype(int)]
    share = mixtures(words, np.zeros(4000, int), 2)
    assert abs(share[0, 1] - 0.25) < 0.08 and share[0, 2] == 0 and share[1].sum() == 0  # (0.34 - 0.1) / 0.8 is about 0.3


def test_language_of_odd_rows(odd, documents, nothing):
    rows = identify(odd, documents).collect()
    assert len(rows) == odd.count()
    none = [r for r in rows if r.doc_id in (1, 2, 3, 9)]
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in none) and all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in identify(odd, documents.filter("false")).collect()} == {"und"}
    assert identify(nothing, documents).count() == 0


def test_disguised_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    cost = char_model(char_counts(docs))
    for disguised in ("i-d-i-o-t", "id1ot", "idi0t", "idiooot"):
        assert decode(disguised, cost) == "idiot"
    assert decode("$tupid", cost) == "stupid" and decode("x" * 3000 + "1", cost)


def test_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    out = toxicity(docs, docs.filter(~held), labels).filter(held).join(labels, "doc_id").select("toxic", "score").collect()
    toxic, clean = ([r.score for r in out if r.toxic == k] for k in (1, 0))
    ranked = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / (len(toxic) * len(clean))
    assert ranked > 0.9 and sum(s >= 0.5 for s in clean) < 0.01 * len(clean)


def test_disguise_does_not_hide_toxicity(spark, documents, labels):
    docs = spark.createDataFrame([(k, f"this is quite {'an awful' if k % 2 else 'a good'} text number {k}") for k in range(200)], "doc_id long, text string")
    marks = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, toxic int")
    probe = spark.createDataFrame([(1, "so aw4ul"), (2, "a w f u l"), (3, "awwwful"), (4, "so good")], "doc_id long, text string")
    score = {r.doc_id: r.score for r in toxicity(probe, docs, marks).collect()}
    assert min(score[2], score[3]) > 0.5 > score[4]


def test_signs_at_the_edges_and_spaced_signs_do_not_hide_toxicity(spark):
    words = ["stupid", "useless", "idiot", "hate", "asshole", "shit"]
    docs = [(k, f"this is quite {words[k // 4 % 6] if k % 4 == 1 else 'a good'} text number {'one two three four great'.split()[k % 5]}") for k in range(900)]
    marks = spark.createDataFrame([(k, int(k % 4 == 1)) for k in range(900)], "doc_id long, toxic int")
    hidden = ["57up1d", "57up1d!!", "u53l355", "1d107", "h473", "@$$hole", "(@$$hole,", "sh!+", "!diot", "!diot***", "stupid!!", "stupid$$$", "1 d 1 0 t", "1 d ! 0 t !", "s h ! t", "i - d - i - o - t"]
    clean = ["great", "great!!", "great$$$", "(great)", "great ***", "one 2 3 4", "two!", "nothing"]
    probe = spark.createDataFrame([(k, f"so {word}") for k, word in enumerate([*hidden, *clean])], "doc_id long, text string")
    train = spark.createDataFrame(docs, "doc_id long, text string")
    score = {r.text[3:]: r.score for r in toxicity(probe, train, marks).collect()}
    least = score["great"] + 0.1
    assert {w: score[w] for w in hidden if score[w] < least} == {} and {w: score[w] for w in clean if score[w] > least} == {}, least
    assert score["great!!"] == score["great$$$"] == score["great"] and score["57up1d"] == score["57up1d!!"] == score["stupid!!"] == score["stupid$$$"]


def test_single_letters_of_any_script_join_spaced_runs():
    restorer = Restorer(np.zeros((28, 28, 28)))
    data, starts, ends, _ = restorer.words(pa.array(["é t é", "a — b"]))
    assert [data[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)][-1:] in (["été"], ["é"]) and len(restorer.known) == 1


def test_logistic_reaches_its_optimum():
    rng = np.random.default_rng(2)
    x = rng.random((400, 6)) < 0.3
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ np.array([2.0, -1, 0, 1, 0, 0]) - 0.5)))).astype(float)
    rows, columns = np.nonzero(x)
    weights, bias = fit_logistic(rows, columns, y, 6, steps=2000)
    p = 1 / (1 + np.exp(-(x @ weights + bias)))
    assert np.abs(x.T @ (p - y) + 0.1 * weights).max() < 1e-3 and abs((p - y).sum()) < 1e-3


def test_toxicity_of_odd_rows(odd, documents, labels, nothing):
    rows = toxicity(odd, documents, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows) and len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1
    assert {round(r.score, 6) for r in toxicity(odd, documents, labels.filter("false")).collect()} == {0.5}
    assert toxicity(nothing, documents, labels).count() == 0

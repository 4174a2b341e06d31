import importlib

import duckdb
import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from clonespark.llm.pii import find, fit_spans, mask
from clonespark.llm.quality import quality
from clonespark.llm.queries import ORACLES, QUERIES

from . import brute


def test_pipeline_equals_brute_force(spark, sf, documents, labels, texts):
    kept = {r.doc_id for r in quality(documents, labels).filter("kept").collect()}
    own = {i: t for i, t in texts.items() if i in kept}
    assert 0 < len(own) < len(texts)
    own = {i: own[i] for i, lead in brute.near_classes(own).items() if i == lead}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    own = {i: t for i, t in own.items() if not brute.decontaminate(t, items)[1]}
    weights = fit_spans(spark.createDataFrame(list(own.items()), "doc_id long, text string"))
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    expected = {i: library.encode(mask(t, find(t, weights))) for i, t in own.items()}
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id: r.ids for r in rows} == expected and all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)


def test_stages_keep_columns_and_pass_odd_rows(spark, sf, odd, nothing, documents):
    columns = documents.columns
    strange = odd.selectExpr("doc_id", "text", "'xx' as lang", "'s' as source", "cast(null as bigint) as n_chars", "score", "kept")
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, strange, sf), stage(spark, nothing, sf)
        assert none.count() == 0
        if name != "piece-encoding":
            assert out.columns == strange.columns and none.columns == columns
        n = out.count()
        assert n == {"quality": n, "near-dedup": strange.count() - 2}.get(name, strange.count())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, sf, name):
    connection = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    result = connection.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    frame = QUERIES[name](spark, sf)
    assert sorted(frame.columns) == sorted(columns)
    assert sorted(tuple(r[c] for c in columns) for r in frame.collect()) == sorted(result.fetchall())


CONTRACT = {
    "op1_substring_dedup": {"doc_id", "n_words", "n_removed", "kept_sha256"},
    "op2_quality_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op3_piece_encoding": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op4_chat_format": {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"},
    "op5_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op6_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op7_katz_scores": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op8_decontamination": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"},
    "op9_near_duplicates": {"doc_id", "class_id"},
    "op10_personal_data": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op11_ranked_search": {"item_id", "rank", "doc_id", "score"},
    "op12_token_files": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op13_embedding_whitening": {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"},
}


def test_registered_queries_have_their_columns(spark, sf):
    entry = importlib.import_module("__spark_entry__")
    registered = entry.queries()
    assert "pipeline" in registered and set(CONTRACT) <= set(registered)
    for name, columns in CONTRACT.items():
        frame = registered[name](spark, sf)
        assert columns <= set(frame.columns), name
        if name != "op4_chat_format":
            assert frame.count() == {"op11_ranked_search": 800, "op13_embedding_whitening": 8000}.get(name, 200), name

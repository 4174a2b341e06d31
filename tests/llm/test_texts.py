import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from clonespark.llm.chat import align, escape, format_chats, parse, read_back, render, token_spans, unescape
from clonespark.llm.decontaminate import decontaminate
from clonespark.llm.pieces import Codec, encode_texts, read_model
from clonespark.llm.pii import KINDS, SPOKEN, base_spans, candidates, find, find_personal_data, fit_spans, luhn, mask, reliabilities

from . import brute

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def codec():
    return Codec(read_model(MODEL))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" ▁\n\tabething<>0x"))), max_size=6))
def test_encoding_equals_the_library(texts):
    own = Codec.shared if hasattr(Codec, "shared") else Codec(read_model(MODEL))
    Codec.shared = own
    ids, counts = own.encode(texts)
    expected = LIBRARY.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])][: len(texts)] == expected
    assert own.decode(ids, counts) == [LIBRARY.decode(e) for e in expected]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 31_999), min_size=1, max_size=12), st.lists(st.integers(0, 300), max_size=12))
def test_decoding_any_ids_equals_the_library(ids, low):
    own = Codec.shared if hasattr(Codec, "shared") else Codec(read_model(MODEL))
    Codec.shared = own
    ids = ids + low
    assert own.decode(np.array(ids), np.array([len(ids)])) == [LIBRARY.decode(ids)]


def test_long_words_and_runs(codec):
    texts = ["a" * 6000, " " * 5000, "é" * 4500, "ab" * 3000 + "  x", " " * 40 + "the" + " " * 17]
    ids, counts = codec.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == LIBRARY.encode(texts)


def test_encoding_a_table(documents, texts, odd, nothing):
    for r in encode_texts(documents.select("doc_id", "text"), MODEL).collect():
        ids = LIBRARY.encode(texts[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == LIBRARY.decode(ids)
    rows = encode_texts(odd, MODEL).collect()
    assert len(rows) == odd.count() and all(r.ids == [] and r.decoded == "" for r in rows if r.text is None)
    assert encode_texts(nothing, MODEL).count() == 0


def test_contamination_equals_brute_force(spark, sf, documents, texts):
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    for r in decontaminate(documents, benchmark).collect():
        assert (r.n_words, r.n_hit, r.items) == brute.decontaminate(texts[r.doc_id], items)
        assert sum(h.end - h.start for h in r.hits) == r.n_hit and r.contaminated == (r.n_hit > 0)


def test_contamination_by_short_items_ties_and_proximity(spark, nothing, odd):
    docs = spark.createDataFrame([(1, "x Alpha, beta gamma y alpha beta gamma"), (2, "beta gamma"), (3, None), (3, "alpha z beta gamma")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "alpha beta gamma"), (10, "ALPHA beta gamma"), (9, ""), (None, "gamma y"), (8, None)], "item_id long, text string")
    out = {(r.doc_id, r.n_words): (r.n_hit, r.items) for r in decontaminate(docs, items).collect()}
    assert out == {(1, 8): (7, ["10", "7", "null"]), (2, 2): (0, []), (3, 0): (0, []), (3, 4): (0, [])}
    near = {(r.doc_id, r.n_words): r.items for r in decontaminate(docs, items, slop=1).collect()}
    assert near[3, 4] == ["10", "7"]
    assert decontaminate(nothing, items).count() == 0 and decontaminate(docs, items.filter("false")).filter("contaminated").count() == 0
    assert decontaminate(odd, items).count() == odd.count()


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for k, kind in enumerate(KINDS):
        for m in re.finditer(PATTERNS[kind], text):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(p) < 256 for p in m[0].split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]:
                out.append((k, m.start(), m.end()))
    return out


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from([*"a.@-_%+ ()1234567890", "a@b.c", "1.2.3.4", "+1 (555) 123-4567", "4111111111111111", "é", "\n", "255."]), max_size=30).map("".join))
def test_base_spans_equal_the_patterns(text):
    assert base_spans(text) == plain_spans(text)


def test_personal_data_in_a_table(documents, texts):
    for r in find_personal_data(documents).collect():
        spans = [(KINDS.index(s.kind), s.start, s.end) for s in r.spans]
        assert [s for s, own in zip(spans, (x.base for x in r.spans), strict=True) if own] == plain_spans(texts[r.doc_id]) and spans == sorted(spans)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from([*"aZ1.@- (\n", " at ", " At", "at", "(AT)", "[at]", " dot ", "(dot)", "[DOT]", "\u0130", "\u212a", "é", "john", "x.org"]), max_size=25).map("".join))
def test_spoken_addresses_equal_the_pattern(text):
    assert [(a, b) for kind, a, b in candidates(text) if kind == 0] == [m.span() for m in SPOKEN.finditer(text)]


def test_spoken_addresses_are_found_whatever_else_the_text_has():
    weights = np.zeros((len(KINDS), 11))
    weights[0, -1] = 9.0
    long = "n" * 200
    for address in ("john @ example.com", "john (at) example.com", "john[at]example.org", f"{long} at example dot com", f"{long}(AT)example.com"):
        for text in (f"write to {address}", f"İ write to {address}", f"write to {address}, room 7", f"no dot here: {address}"):
            assert [text[a:b] for kind, a, b, own in find(text, weights) if kind == 0 and not own] == [address]


def test_candidates_that_the_votes_carry(spark):
    docs = [(k, f"Please call +1 (555) 201-{1000 + k} or mail name{k} (at) example dot com, batch 20{k % 10} 77 items") for k in range(200)]
    docs += [(500, "phone +1 (784) 555-8120 4111111111111111 today"), (501, "number 4111111111111112 and 300.1.2.3")]
    weights = fit_spans(spark.createDataFrame(docs, "doc_id long, text string"))
    found = {(KINDS[k], docs[-2][1][a:b], own) for k, a, b, own in find(docs[-2][1], weights)}
    assert found == {("card", "4111111111111111", True), ("phone", "+1 (784) 555-8120", False)} or ("card", "4111111111111111", False) in found
    assert find(docs[-1][1], weights) == []  # a failed checksum or range is final


def test_reliable_labelers_outweigh_noise():
    rng = np.random.default_rng(4)
    truth = rng.random(3000) < 0.4
    votes = np.stack([np.where(rng.random(3000) < a, truth, ~truth) * 2 - 1 for a in (0.95, 0.9, 0.9, 0.55)], axis=1)
    posterior, table = reliabilities(votes, np.ones(3000))
    assert ((posterior > 0.5) == truth).mean() > 0.94 and table[0, 1, 2] > table[3, 1, 2]


def test_redaction(spark, odd, nothing):
    docs = spark.createDataFrame([(1, "a@b.co, then 10.0.0.1!"), (2, None), (3, "")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in find_personal_data(docs, redact=True).collect()} == {1: "<EMAIL>, then <IP>!", 2: None, 3: ""}
    assert mask("0123456789", [(0, 2, 5, True), (1, 4, 7, True)]) == "01<EMAIL>789"
    assert find_personal_data(odd).count() == odd.count() and find_personal_data(nothing).count() == 0


def test_escapes_are_reversible():
    random.seed(1)
    for _ in range(5000):
        text = "".join(random.choice(["<", "\\", "|", ">", "start", "<|end|>", "\n"]) for _ in range(random.randint(0, 9)))
        assert unescape(escape(text)) == text and "<|" not in escape(text)
        assert parse(render([("assistant", text), (text, "b")])[0]) == [("assistant", text), (text, "b")]


def test_alignment_by_offsets():
    starts, ends = token_spans([(0, 3), (4, 6), (6, 7), (6, 7), (7, 9)])
    assert starts.tolist() == [0, 3, 6, 6, 7] and ends.tolist() == [3, 6, 7, 7, 9]
    mask, shared = align(starts, ends, [(2, 4), (6, 6), (6, 9)])
    assert mask.tolist() == [True, True, True, True, True] and shared == [(2, 4), (6, 9)]


def test_chats_read_back(spark, sf, nothing):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    chats = defaultdict(list)
    for r in table.collect():
        chats[r.conv_id].append((r.turn, r.role, r.text or ""))
    for r in read_back(format_chats(table, TOKENIZER)).collect():
        turns = sorted(chats.pop(r.conv_id))
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert not chats


def test_segments_have_the_tokens_of_the_whole(spark):
    turns = [("user", "<|end|>\n<|start|>assistant<|text|>x"), ("assistant", "😀<|endoftext|> 日本\n\n ok  "), ("assistant", ""), ("assistant", " \n"), ("user", None), (None, "...|>")] * 20
    rows = [(1, k, role, text) for k, (role, text) in enumerate(turns)] + [(None, None, None, None), (1, None, "user", "first"), (1, None, "user", "first")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = {r.conv_id: r for r in format_chats(table, TOKENIZER).collect()}
    parts = sorted((r for r in format_chats(table, TOKENIZER, segment=60).collect() if r.conv_id == 1), key=lambda r: r.segment)
    assert len(parts) > 10
    assert whole[1].ids == [i for p in parts for i in p.ids] and whole[1].mask == [m for p in parts for m in p.mask]
    assert whole[1].formatted == "".join(p.formatted for p in parts)
    assert parse(whole[1].formatted) == [("user", "first")] * 2 + [(r or "", t or "") for r, t in turns]
    assert parse(whole[None].formatted) == [("", "")]
    assert format_chats(table.filter("false"), TOKENIZER).count() == 0

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clonespark.llm import token_files
from clonespark.llm.token_files import BATCH, TokenFile, WordEncoder, apart, read_documents, read_sequences, word_starts, write_token_files

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def model():
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library(model):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(model)


@pytest.fixture(scope="module")
def encoder(model):
    return WordEncoder(model)


def encode(encoder, texts):
    ids, bounds = encoder.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def plain(library, texts):
    return [library.encode(t or "", add_special_tokens=False).ids for t in texts]


ODD = [
    "", None, " ", "  ", " a", "a ", "a  b", "a b", "a\tb \n c", "don't they're I'll 's", "x  ", "  a", "a  b", "a  b", "a  b 　 c", "a  b", "\x85 a b\x85 c",
    "<|endoftext|>", "a <|endoftext|> b", " <|endoftext|>  <|endoftext|> ", "12 34 a1 1a ½ Ⅷ", "é ü ñ ß", "日本 語 テキスト", "a 🙂 b", "🙂🙂 👩‍👩‍👧", "é á b", "a\x00 b \x1c c \x7f d", "߿ a ࠀ b", "!!! ??? ...", "a" * 3000,
    " ".join(["word"] * 500), "\n\n\n a\n b", "﻿ a b",
]


def test_equals_library(encoder, library, texts):
    assert encode(encoder, ODD) == plain(library, ODD)
    some = list(texts.values())
    assert encode(encoder, some) == plain(library, some)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list(" \t\n \u0085 ab'sS1!é日🙂<|>\x7f")) | st.characters(exclude_categories=["Cs"]), max_size=30), max_size=5))
def test_equals_library_on_any_text(encoder, library, some):
    assert encode(encoder, some) == plain(library, some)


def test_words_of_equal_hash_are_kept_apart():
    data = np.frombuffer(b"ab cd ab ce", np.uint8)
    starts = word_starts(data, np.array([0, len(data)]))
    ends = np.append(starts[1:], len(data))
    heads, of = apart(data, starts, ends, np.array([0]), np.zeros(len(starts), np.int64))
    got = [bytes(data[starts[heads[k]] : ends[heads[k]]]) for k in of]
    assert got == [b"ab", b" cd", b" ab", b" ce"]


def test_forgetting_changes_nothing(model, library, texts, monkeypatch):
    monkeypatch.setattr(token_files, "CACHE", 2000)
    small = WordEncoder(model)
    some = list(texts.values())[:40]
    for begin in range(0, 40, 5):
        assert encode(small, some[begin : begin + 5]) == plain(library, some[begin : begin + 5])


def expected(library, rows):
    """Rows of the query, in order: by id, rows without one last."""
    at, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_given_documents(spark, documents, model, library, texts, tmp_path):
    manifest = write_token_files(documents, model, folder=f"file://{tmp_path}", sequence=128)
    got = sorted(tuple(r) for r in read_documents(manifest).collect())
    assert got == sorted(expected(library, texts.items()))
    stream = np.concatenate([[*library.encode(texts[i], add_special_tokens=False).ids, 2] for i in sorted(texts)])
    sequences = read_sequences(manifest).orderBy("sequence").collect()
    assert [r.sequence for r in sequences] == list(range(len(sequences)))
    assert all(len(r.ids) == len(r.mask) == 128 for r in sequences)
    assert np.array_equal(stream, np.concatenate([np.array(r.ids)[np.array(r.mask)] for r in sequences]))
    assert spark.read.parquet(re.sub("/part-[^/]*$", "/manifest", manifest.first().tokens_file)).count() == manifest.count()


def test_random_access_is_a_view(documents, model, tmp_path):
    row = write_token_files(documents, model, folder=str(tmp_path), sequence=64).orderBy(F.desc("n_tokens")).first()
    file = TokenFile(row.tokens_file)
    ids, mask = file[BATCH + 1]
    assert ids.dtype == np.uint16 and ids.shape == mask.shape == (64,) and not ids.flags.owndata
    assert file.source.size() > ids.nbytes and np.array_equal(ids, file.tokens((BATCH + 1) * 64, (BATCH + 2) * 64))
    last, mask = file[row.n_sequences - 1]
    assert mask.sum() == row.n_tokens - 64 * (row.n_sequences - 1) and mask[: mask.sum()].all() and not last[~mask].any()


def test_odd_rows(spark, model, library, odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = read_documents(write_token_files(odd, model)).collect()
    assert len(got) == len(rows)
    want = expected(library, [r for r in rows if r[0] is not None])
    assert sorted((r.doc_id, r.start, r.n_tokens) for r in got if r.doc_id is not None) == sorted(w[:3] for w in want)
    assert sorted(r.n_tokens for r in got if r.doc_id is None) == sorted(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in rows if i is None)
    assert min(r.start for r in got if r.doc_id is None) == max(r.start + r.n_tokens for r in got if r.doc_id is not None)
    assert read_documents(write_token_files(nothing, model)).collect() == []


def test_one_id_for_all(spark, model, library):
    """One id, and one text, of all rows: still several files, and no gap in the stream."""
    frame = spark.range(4000).select(F.lit(7).alias("doc_id"), F.lit("same words again and again " * 20).alias("text")).repartition(8)
    manifest = write_token_files(frame, model)
    got = sorted((r.start, r.n_tokens) for r in read_documents(manifest).collect())
    assert len(got) == 4000 and len({n for _, n in got}) == 1
    assert [s for s, _ in got] == [k * got[0][1] for k in range(4000)]
    assert manifest.count() > 1

"""Elias-Fano structures and token files against plain lists and the library."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lantern.llm import elias_fano, token_files
from lantern.llm.queries import END_ID, vocabulary


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 3000), max_size=700), st.integers(0, 1 << 40))
def test_select_by_force(steps, first):
    values = np.cumsum([first, *steps])
    found = elias_fano.EliasFano(elias_fano.encode(values))
    assert found.all().tolist() == values.tolist()
    some = np.arange(0, len(values), 7)[::-1]
    assert found.select(some).tolist() == values[some].tolist()


def test_space_and_limits():
    values = np.cumsum(np.random.default_rng(1).integers(0, 1000, 50_000))
    assert 8 * len(elias_fano.encode(values)) < 50_000 * (2.6 + np.log2(values[-1] / 50_000))
    none = elias_fano.EliasFano(elias_fano.encode(np.zeros(0, np.int64)))
    assert none.n == 0 and none.all().tolist() == []
    with pytest.raises(IndexError):
        none.select(np.array([0]))
    with pytest.raises(ValueError):
        elias_fano.encode(np.array([3, 2]))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary("word_bpe_49k.json"))


TEXTS = ["", None, "Plain words, plain WORDS.", "tabs\tand\x0bfeeds\x0c\x1c\x1d end", "Ünïcode é ́x ΑΣ ΑΣΑ no break", "<|endoftext|> in<|startoftext|>side", "it's 12 o'clock 😀😀", "x" * 5000, "a b " * 40_000, "﻿", " \n "]


@pytest.mark.parametrize("apart", [True, False])
def test_files_by_force(spark, library, apart):
    rows = [(k, t, "extra") for k, t in zip([5, 3, 3, None, 9, 8, 7, 1, 2, 0, 0], TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    segments = token_files.write_ids(docs, vocabulary("word_bpe_49k.json"), END_ID, apart=apart)
    found = token_files.read_spans(segments).orderBy("start").collect()
    assert [r["doc_id"] for r in found] == [None, 0, 0, 1, 2, 3, 3, 5, 7, 8, 9]
    assert found[0]["start"] == 0 and all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(found, found[1:]))
    wanted = sorted((k is not None, k or 0, [*library.encode(t or "", add_special_tokens=False).ids, END_ID]) for k, t, _ in rows)
    sums = sorted((k, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for _, k, ids in wanted)
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in found) == sums
    some = {tuple(r["ids"]) for r in token_files.documents_by_key(segments, [3, 9, 77]).collect()}
    assert some == {tuple(ids) for has, k, ids in wanted if has and k in (3, 9)}
    stored = segments.orderBy("part", "segment").collect()
    assert all(r["n_docs"] == len(r["keys"]) and len(r["ids"]) == 2 * r["n_ids"] for r in stored)


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id string, text string")
    assert token_files.read_spans(token_files.write_ids(docs, vocabulary("word_bpe_49k.json"), END_ID)).count() == 0


def test_part_starts(spark, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 4)
    sizes = [3, 0, 7, 1, 1, 9, 2, 2, 5, 4, 8]
    rows = [(p, s, n) for p, n in enumerate(sizes) for s in range(2)]
    found = {r["part"]: r["start"] for r in token_files.part_starts(spark.createDataFrame(rows, "part int, segment int, n_ids long")).collect()}
    assert found == {p: 2 * sum(sizes[:p]) for p in range(len(sizes))}


@settings(deadline=None, max_examples=150)
@given(st.lists(st.text(st.sampled_from("aZ' \t19.<|>endoftxsré́\u0331HÅ\u0085\x1cΣß")), max_size=5))
def test_encoder_by_library(library, texts):
    texts = [*texts, "".join(texts), "it's<|endoftext|>H\u0331 H'Re 'LL 12a3"]
    coder = token_files.encoder(vocabulary("word_bpe_49k.json"), True)
    for places, counts, ids in coder.encode([t.encode() for t in texts]):
        own = np.split(ids, np.cumsum(counts)[:-1])
        assert [x.tolist() for x in own] == [library.encode(texts[i], add_special_tokens=False).ids for i in places]


def test_other_files_see_whole_texts():
    coder = token_files.encoder(vocabulary("byte_bpe_50k.json"), True)
    from tokenizers import Tokenizer

    library, texts = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")), ["Two  words\n", "", " 12 é"]
    ((places, counts, ids),) = coder.encode([t.encode() for t in texts])
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_forgotten(library, monkeypatch):
    monkeypatch.setattr(token_files, "KEPT_PIECES", 3)
    coder = token_files.Encoder(vocabulary("word_bpe_49k.json"), True)
    for _ in range(3):
        texts = ["one two two " + "z" * 100, "", "three four five six seven"]
        for places, counts, ids in coder.encode([t.encode() for t in texts]):
            own = np.split(ids, np.cumsum(counts)[:-1])
            assert [x.tolist() for x in own] == [library.encode(texts[i], add_special_tokens=False).ids for i in places]

"""Hashes of words and n-grams against plain Python."""

import random

import numpy as np
import pyarrow as pa

from lantern.llm import _words as W


def test_words_are_split_at_six_bytes(monkeypatch):
    r = random.Random(3)
    texts = ["", "  ", "a", "A\tb\x0bc\x0cd\re\nf g", "é\xa0b\x1cc", "x" * 300] + ["".join(r.choice("aB é\n\t ") for _ in range(r.randint(0, 90))) for _ in range(80)]
    data = [t.encode() for t in texts]
    monkeypatch.setattr(W, "CHUNK_BYTES", 200)
    seen, grams = {}, {}
    for c in W.word_chunks(data, lower=True):
        text = c.data.tobytes()
        at, h = c.grams(3)
        words = [text[s:e] for s, e in zip(c.start, c.end)]
        for i, d in enumerate(c.docs):
            assert words[c.first[i] : c.first[i + 1]] == data[d].lower().split()
        for w, x in zip(words, c.hash.tolist()):
            assert seen.setdefault(w, x) == x
        for i, x in zip(at.tolist(), h.tolist()):
            assert grams.setdefault(tuple(words[i : i + 3]), x) == x
    assert len(set(seen.values())) == len(seen) and len(set(grams.values())) == len(grams)


def test_spans_hash_alike_anywhere():
    v = np.arange(50, dtype=np.uint64) % np.uint64(10)
    s = W.prefix_sums(v)
    a, b = W.span_hash(s, np.array([3, 4]), np.array([9, 10])), W.span_hash(s, np.array([23, 5]), np.array([29, 11]))
    assert a[0] == b[0] and a[1] != b[1]


def test_pieces_hold_every_row_once(monkeypatch):
    monkeypatch.setattr(W, "PIECE_BYTES", 200)
    texts = ["x" * 90, None, "", "y" * 1000, "z", "z"] * 3
    batches = [pa.record_batch({"t": pa.array(texts, pa.string())}), pa.record_batch({"t": pa.array([], pa.string())})]
    found = list(W.pieces(iter(batches), 0))
    assert sum([x.column(0).to_pylist() for x in found], []) == texts
    assert len(found) > 6 and all(x.num_rows for x in found)

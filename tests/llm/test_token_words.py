"""Ids of words, and how few steps they take."""

import random

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from latchkey.llm import tokens
from latchkey.llm.queries import tokenizer_path


def test_words_of_all_shapes_match_the_library():
    """Words of letters, with one sign behind them, and others have the library's ids."""
    r, whole = random.Random(4), Tokenizer.from_file(tokenizer_path())
    letters, signs = "abcXYZ\u00e9\u00c0\u00df\u00d7", ".,!?'-_<|>0123456789sS\u00bf\u00f7"
    words = ["".join(r.choice(letters) for _ in range(r.randint(0, 6))) + "".join(r.choice(letters + signs) for _ in range(r.randint(0, 3))) for _ in range(4000)]
    encode = tokens.WordEncoder(tokenizer_path())
    for w in words:
        assert np.frombuffer(encode(w), encode.width).tolist() == whole.encode(w, add_special_tokens=False).ids, w


def test_ids_are_counted_by_batches(spark, monkeypatch):
    """One count as long as the vocabulary for a batch, not for each document."""
    rows = [(np.array([k % 7, 40_000], "<u2").tobytes(), 2) for k in range(500)] + [(b"", 2), (np.array([70_000], "<u4").tobytes(), 4)]
    encoded = spark.createDataFrame(rows, "ids binary, width int").coalesce(1)
    calls = spark.sparkContext.accumulator(0)

    class Counting:
        def __getattr__(self, name):
            if name == "bincount":
                calls.add(1)
            return getattr(np, name)

    monkeypatch.setattr(tokens, "np", Counting())
    mapped, real = [], type(encoded).mapInArrow
    monkeypatch.setattr(type(encoded), "mapInArrow", lambda self, f, schema: mapped.append(f) or real(self, f, schema))
    counts = tokens.id_counts(encoded)
    import pyarrow as pa

    list(mapped[0]([pa.record_batch([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int32())], ["ids", "width"])]))
    assert counts[40_000] == 500 and counts[70_000] == 1 and counts[:7].sum() == 500
    assert calls.value <= 4


def test_words_of_a_batch_are_looked_up_once(monkeypatch):
    """Whatever the number of places of a word; texts keep their own ids, also of odd white space."""
    texts = ["", " \n", "alpha beta, alpha\tbeta,", "\x1calpha\x1f beta,\u00a0alpha\u2003\x85x ", "Alpha"] + ["alpha beta, "] * 500
    encoder, whole = tokens.WordEncoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    asked, real = [], encoder._word
    monkeypatch.setattr(encoder, "_word", lambda w: asked.append(w) or real(w))
    tail = np.asarray([2], encoder.width).tobytes()
    for _ in range(2):
        got = encoder.batch(pa.array(texts), tail).to_pylist()
        assert [np.frombuffer(g, encoder.width).tolist() for g in got] == [[*whole.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert len(asked) <= 2 * 8
    assert encoder.batch(pa.array([], pa.string())).to_pylist() == []


def test_pieces_are_remembered_by_halves(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 4)
    encoder, whole = tokens.WordEncoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    for text in ["a b c d", "c d e f", "a g\u0301 h", "a b", "<|x|> \u4e2d"] * 2:
        assert np.frombuffer(encoder(text), encoder.width).tolist() == whole.encode(text, add_special_tokens=False).ids
        assert len(encoder.known) + len(encoder.older) <= 10

"""Packing: exact pieces, full sequences, least squares and the cached encoder."""

from __future__ import annotations

import zlib
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
import pytest

from gridpanel.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def ids(tokenizer, text) -> np.ndarray:
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID], "<u4")


ODD = [
    "", " ", "it's they'RE don't 'tis x'", "Hello, WORLD... (yes) .,;:!? end.", "a b c\x1cd\x0be", "éä Å ΑΣ ΟΔΟΣ.", "x1y22z 3.14",
    "日本語 text混ざる", "<|endoftext|> <|startoftext|>", "ﬁ İstanbul ẞ", "q" * 5000, "ends.\n\nline\tTab", "a.b,c!d", "'s.'s 's", "....", "‍👩‍👧",
    "ÉTÉ*** ÀÞ!?) x(y) Ā<|b|>c [d] e'f' g'", "a\x85b\xa0c\u2003d\u3000e", "a\x1fb\xa0c \x1d.", "Été, ÇA... Œuvre! Straße; ŉ ſ ǅ", "e\u0301te a\u0308", "Ωμέγα ΣΑΣ привіт Їжак",
]


@pytest.mark.parametrize("text", ODD)
def test_encoder(tokenizer, text):
    with open(VOCABULARY, encoding="utf-8") as file:
        encoder = packing.Encoder(file.read())
    for _ in range(2):  # the second time from the cache
        assert np.frombuffer(encoder.ids(pa.array([text]))[0], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_generations(tokenizer, monkeypatch):
    """Nothing changes when parts are forgotten, return from the older generation or are too long to keep."""
    monkeypatch.setattr(packing, "_KEPT", 20)
    monkeypatch.setattr(packing, "_SHORT", 6)
    with open(VOCABULARY, encoding="utf-8") as file:
        encoder = packing.Encoder(file.read())
    r = np.random.default_rng(4)
    vocabulary = [*" ".join(ODD).split(), "Straße", "ÉTÉ!", "naïve,", "ŒUVRE", "ſet", "x" * 70, *(f"Wort{chr(97 + i)}" for i in range(26))]
    for _ in range(300):
        text = " ".join(r.choice(vocabulary, int(r.integers(0, 12))))
        assert np.frombuffer(encoder.ids(pa.array([text]))[0], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert len(encoder.known) <= 60 and max(map(len, encoder.known), default=0) <= 70
    texts = [" ".join(r.choice(vocabulary, 9)) for _ in range(50)]
    whole = pa.array([*texts, "", " x ", *texts[:5]])
    for column in (whole, whole[3:40], whole[:0]):
        assert encoder.ids(column) == [encoder.ids(pa.array([t.as_py()]))[0] for t in column]


def check(spark, tokenizer, texts, window, **more):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in texts], "doc_id long, text string, start long, task int").repartition(3)
    got = packing.pack(docs, VOCABULARY, window=window, **more).toPandas()
    sizes = []
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum()[:-1]]
        sizes.append(int(g.length.sum()))
    assert all(s == window or s < window and s & (s - 1) == 0 for s in sizes)
    total = sum(len(ids(tokenizer, t)) for _, t in texts)
    assert sum(sizes) == total
    assert len(sizes) <= -(-total // window) + window.bit_length()
    return got


@pytest.mark.parametrize("window", [64, 256, 2048])
def test_pack(spark, tokenizer, window):
    r = np.random.default_rng(3)
    texts = [(i, " ".join(f"w{x}" for x in r.integers(0, 50, int(n)))) for i, n in enumerate(r.gamma(0.7, 60, 300))]
    texts += [(1000 + i, t) for i, t in enumerate([*ODD, None, "long word " * 3000])]
    got = check(spark, tokenizer, texts, window, grain=8)
    for i, text in texts:
        own, at = ids(tokenizer, text), 0
        for p in got[got.doc_id == i].sort_values("start").itertuples():
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(own), zlib.crc32(own[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(own)


def test_repeats_and_nulls(spark, tokenizer):
    got = check(spark, tokenizer, [(7, "same text")] * 40 + [(None, "x")] * 3 + [(8, None)] * 5, 64)
    assert got[got.doc_id == 7].length.sum() == 40 * len(ids(tokenizer, "same text"))
    assert got[got.doc_id.isna()].length.sum() == 3 * len(ids(tokenizer, "x"))


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY).collect() == []


def test_combinations():
    want = {tuple(sorted(c, reverse=True)) for d in range(1, 5) for c in combinations_with_replacement(range(1, 13), d) if sum(c) == 12}
    assert set(packing.combinations(12, 4)) == want and len(packing.combinations(12, 4)) == len(want)


def test_nonnegative():
    """The optimality conditions: no negative value, no descent direction left."""
    r = np.random.default_rng(1)
    for _ in range(30):
        a, b = r.normal(size=(8, 20)), r.normal(size=8)
        x = packing.nonnegative(a, b)
        slope = a.T @ (b - a @ x)
        assert (x >= 0).all() and slope.max() < 1e-6 and np.abs(slope[x > 0]).max(initial=0) < 1e-6


def test_plan():
    """Planned pieces exist, every planned sequence fits, and what is left can fill the room."""
    r = np.random.default_rng(2)
    for _ in range(20):
        lengths = r.integers(1, 257, int(r.integers(1, 400)))
        steps = -(-lengths // 8)
        histogram = np.bincount(steps, minlength=33)
        planned = packing.plan(histogram.tolist(), int(lengths.sum()), grain=8)
        used, load = np.zeros(33, int), np.zeros(planned.sequences, int)
        for step, start, stop, first, each, _ in planned.ranges:
            assert start == used[step] and (stop - start) % each == 0
            used[step] = stop
            load[first : first + (stop - start) // each] += step * each
        assert (used <= histogram).all() and (load == 32).all()
        assert planned.sequences * 256 <= lengths.sum()

"""Brute-force checks of the corpus operators on small fixtures."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from gridpanel.llm import chat, decontaminate, sharding, simhash, sketches, suffixes, token_counts
from gridpanel.llm.suffixes import suffix_array

SCHEMA = "doc_id long, text string, source string, kind string"


@pytest.fixture(scope="module")
def docs(spark):
    base = " ".join(f"word{i % 37} item{i * i % 101}" for i in range(90))
    texts = [base, base, base + " tail", "", None, "a", "Z z", "x" * 3000, base.replace("word5", "other"), "lone text with few words"]
    return spark.createDataFrame([(i, t, "s", "k") for i, t in enumerate(texts)], SCHEMA)


def fingerprint(text: str) -> int:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs):
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    prints = {i: fingerprint(t) for i, t in texts.items()}
    root = {i: i for i in texts}
    for _ in texts:
        for a in texts:
            for b in texts:
                if (prints[a] ^ prints[b]).bit_count() <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (prints[i], root[i]) for i in texts}


def test_keep_one_by_row(spark):
    """Texts that share an id are decided one by one; copies of one text leave one row."""
    text, other = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i * i}" for i in range(50))
    rows = [(3, text, "s", "k"), (5, text, "s", "k"), (5, other, "s", "k"), (5, other, "s", "k"), (None, other, "s", "k")]
    rows += [(None, "lone text", "s", "k"), (None, "lone text", "t", "k"), (9, None, "s", "k"), (8, "", "s", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.doc_id, r.text) for r in simhash.keep_one(docs).collect()), key=str)
    assert got == sorted([(3, text), (5, other), (None, "lone text"), (8, "")], key=str)
    assert simhash.keep_one(docs).columns == docs.columns
    assert simhash.keep_one(docs.where("false")).count() == 0


def test_suffix_array():
    r = np.random.default_rng(0)
    for _ in range(100):
        s = r.integers(1, r.integers(2, 6), r.integers(1, 60))
        assert suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


@pytest.mark.parametrize("crowd", [500, 1])
def test_repeats(docs, monkeypatch, crowd):
    monkeypatch.setattr(suffixes, "_CROWD", crowd)
    length, texts = 400, {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    seen = Counter(b[p : p + length] for b in texts.values() for p in range(len(b) - length + 1))
    want = {}
    for i, b in texts.items():
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        want[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    rows = suffixes.remove_repeats(docs, texts=False).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == want


def test_sharding(docs):
    rows = sharding.shard(docs, 3).collect()
    assert sorted(r.doc_id for r in rows) == list(range(10))
    where = {}
    for r in rows:
        assert where.setdefault(r.text_crc32, r.shard) == r.shard
    for s in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))


def test_edited_pairs(docs):
    texts = [r.text or "" for r in docs.orderBy("doc_id").collect()]
    for r in sketches.edited_pairs(docs.select("doc_id", "text")).collect():
        t, following = texts[r.doc_id], texts[(r.doc_id + 1) % len(texts)]
        half = len(t) // 2
        assert r.edited == t[: len(t) - half] + following[:half]


def test_contamination(spark, docs):
    words = [f"q{i}" for i in range(20)]
    more = spark.createDataFrame([(20, "start " + " ".join(words[:15]).upper() + " end", "s", "k"), (21, " ".join(words[:12]), "s", "k")], SCHEMA)
    items = spark.createDataFrame([("b1", " ".join(words)), ("b2", ""), ("b3", None)], "item_id string, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs.union(more), items).collect()}
    assert (got[20].n_words, list(got[20].items), got[20].contaminated) == (17, ["b1"], True)
    assert got[20].n_hit == 15 and not got[21].contaminated and not got[4].contaminated


def test_chat(spark):
    rows = [("a", 0, "user", "hi"), ("b", 0, "user", "hi"), ("b", 1, "bot", None), ("c", 0, None, "")]
    convs = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    got = {r.conv_id: r.chat for r in chat.render(convs).collect()}
    assert got == {"b": "<|user|>\nhi<|end|>\n<|bot|>\n<|end|>\n", "c": "<|unknown|>\n<|end|>\n"}


def test_empty(spark, docs):
    none = docs.limit(0)
    assert simhash.near_duplicates(none).count() == 0
    assert suffixes.remove_repeats(none, texts=False).count() == 0
    assert sharding.shard(none).count() == 0
    assert token_counts.histogram(token_counts.lengths(none)).count() == 0

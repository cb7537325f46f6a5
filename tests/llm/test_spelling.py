"""Spelling variants against brute force."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gridpanel.llm import spelling

SCHEMA = "doc_id long, text string, word string, n long"


def words_of(rows, every: int | None, shortest: int = 5, least: int = 3) -> dict[str, int]:
    found: Counter = Counter()
    for i, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= shortest and n >= least}


def near(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(words: dict[str, int], ratio: int = 2) -> set[tuple]:
    forms, out = {}, set()
    for w, n in words.items():
        around = sorted((-m, v) for v, m in words.items() if near(w, v))
        best = around[0] if around and -around[0][0] >= ratio * n else None
        forms[w] = (best[1] if best else None, -best[0] if best else None, len(around))
    for w, n in words.items():
        root = w
        while forms[root][0]:
            root = forms[root][0]
        out.add((w, forms[w][0], root, n, forms[w][2], forms[w][1]))
    return out


def corpus():
    r = np.random.default_rng(5)
    base = ["".join(r.choice(list("abé÷Zx"), int(n))) for n in r.integers(4, 9, 60)]
    texts = [" ".join(base[min(int(x), 59)] for x in r.gamma(1.0, 12, 80)) + ("." if i % 2 else "1\n") for i in range(60)]
    rows = list(enumerate(texts))
    return rows + [rows[3]] * 4 + [(None, texts[0]), (None, None), (90, ""), (91, None), (92, "a b"), (93, "Wörter" * 50)]


@pytest.mark.parametrize("every", [None, 7, 97])
def test_variants(spark, monkeypatch, every):
    monkeypatch.setattr(spelling, "_PIECE", 50)  # in the tasks, too, where workers are forked from here
    rows = corpus()
    docs = spark.createDataFrame([(*r, "w", 1) for r in rows], SCHEMA).repartition(3)
    got = spelling.variants(docs, typo_every=every).collect()
    assert len(got) == len({r.word for r in got})
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == expected(words_of(rows, every))


def test_pieces(monkeypatch):
    monkeypatch.setattr(spelling, "_PIECE", 3)
    text = "abcdefgh i jklm, nopqrstuvw xyz--ab"
    assert "".join(spelling._pieces(text)) == text
    assert sum((re.findall("[a-z]+", p) for p in spelling._pieces(text)), []) == re.findall("[a-z]+", text)


def test_near_words(spark):
    """Every pair one edit apart, once, also with repeated letters and the shortest words."""
    r = np.random.default_rng(9)
    words = {"".join(r.choice(list("abà"), int(n))): int(r.integers(1, 50)) for n in r.integers(2, 8, 400)}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    got = [(tuple(sorted((p.a, p.b))), {p.a: p.a_n, p.b: p.b_n}) for p in spelling.near_words(table).collect()]
    want = {(a, b) for a in words for b in words if a < b and near(a, b)}
    assert len(got) == len(want) and {p for p, _ in got} == want
    assert all(n == {w: words[w] for w in p} for p, n in got)


def test_chain(spark):
    """Roots at the end of long chains of forms."""
    words = {"a" * 5 + "b" * k: 2**k for k in range(12)}
    got = {r.word: r.root for r in spelling.roots(spelling.forms(spark.createDataFrame(list(words.items()), "word string, n long"))).collect()}
    last = max(words, key=words.get)
    assert got == {w: last for w in words if w != last}


def test_empty(spark):
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).collect() == []
    assert spelling.variants(spark.createDataFrame([(1, None, None, 1), (2, "", "", 2)], SCHEMA)).collect() == []

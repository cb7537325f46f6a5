"""The manifest against a plain recursive construction."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from gridpanel.llm import merkle

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, path string, root string, grp string, at long"


def H(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes: list[str], fanout: int) -> tuple[str, list[list[str]]]:
    """(top, siblings of each node, nearest level first)."""
    proofs, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for own, at in zip(proofs, places, strict=True):
            low = at // fanout * fanout
            own += [x for i, x in enumerate(nodes[low : low + fanout], low) if i != at]
        nodes = [H(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        places = [at // fanout for at in places]
    return nodes[0], proofs


def expected(rows, fanout: int) -> list[tuple]:
    groups: dict = {}
    for r in rows:
        leaf = H(*[enc(r[f]) for f in merkle.FIELDS])
        groups.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf, r["doc_id"]))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs = {s: tree([x[2] for x in sorted(groups[s])], fanout) for s in order}
    root, tops = tree([subs[s][0] for s in order], fanout)
    return sorted(
        (str(s), str(x[3]), x[2], subs[s][0], root, H(*own, *top))
        for s, top in zip(order, tops, strict=True)
        for x, own in zip(sorted(groups[s]), subs[s][1], strict=True)
    )


def rows(n: int):
    source = lambda i: None if i % 11 == 0 else "hot" if i % 3 else f"sé{i % 7}"
    out = [(i, None if i % 13 == 0 else f"Text {i}" * (i % 5), source(i), None if i % 17 == 0 else "fr", i, "p", "r", "g", 1) for i in range(n)]
    if n == 1:
        return out
    return out + [(None, "no id", "hot", "en", 1, "p", "r", "g", 1), out[1], out[1], (5, "other", "hot", "en", 2, "p", "r", "g", 1)]


@pytest.mark.parametrize(("n", "fanout"), [(1, 16), (2, 16), (40, 16), (700, 16), (60, 2), (90, 3)])
def test_manifest(spark, n, fanout):
    docs = spark.createDataFrame(rows(n), SCHEMA)
    changed = F.when(F.col("doc_id") % 4 == 0, merkle.leaf(F.lit("tampered"))).alias("changed")
    found = merkle.manifest(docs, extra=[changed], fanout=fanout)
    found = found.withColumns(
        {"proof": merkle.siblings(F.col("path")), "up": merkle.folded(F.col("leaf"), F.col("path")),
         "other": merkle.folded(F.coalesce("changed", "leaf"), F.col("path"))}
    ).collect()
    got = sorted((str(r.source), str(r.doc_id), r.leaf, r.subroot, r.root, r.proof) for r in found)
    assert got == expected([r.asDict() for r in docs.collect()], fanout)
    assert all(r.up == r.root for r in found)
    assert all((r.other == r.root) == (r.changed is None) for r in found)


def test_empty(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_field_bounds(spark):
    """Contents that move between fields, null and the empty text give different leaves."""
    table = spark.createDataFrame([("ab", "c"), ("a", "bc"), ("", "abc"), (None, "abc"), ("-", "abc"), ("1:a", "")], "x string, y string")
    assert table.select(merkle.leaf(F.col("x"), F.col("y")).alias("h")).distinct().count() == 6

"""Suffix-array deduplication of byte strings that start in more than one place."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridpanel.llm.common import utf8
from gridpanel.llm.words import prefix_sums, span_hash
from gridpanel.session import materialize

LENGTH = 400
_ANCHOR = 64  # bytes hashed at an anchor
_LOW = np.uint64((1 << 24) - 1)
_PIECE = 1 << 23  # window starts of one text handled at once
_BATCH = 1 << 19  # bytes of contexts in one suffix array
_CROWD = 500  # different contexts of one anchor that are still sorted in one array
_PART = 16  # window starts in a part of a crowded anchor's context


def anchors(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first, last): runs of window starts and the anchor inside all windows of a run.

    The anchor of a window of ``length`` bytes is the place in it with the smallest hash
    of ``_ANCHOR`` bytes (the rightmost of equal ones). It depends on the window's bytes
    only, so equal windows have equal anchors at equal offsets: a sample of positions
    that meets every pair of matches, as a difference cover does, but a sparse one.
    """
    width = min(_ANCHOR, length)
    reach = length - width + 1
    found = [[], [], []]
    for base in range(0, max(len(text) - length + 1, 0), _PIECE):
        part = text[base : base + _PIECE + length - 1]
        at = np.arange(len(part) - width + 1)
        key = (span_hash(*prefix_sums(part), at, at + width) & ~_LOW) | (_LOW - at.astype(np.uint64))
        blocks = -(-len(key) // reach)
        full = np.full(blocks * reach, ~np.uint64(0))
        full[: len(key)] = key
        grid = full.reshape(blocks, reach)
        upto = np.minimum.accumulate(grid, axis=1).ravel()
        onward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        count = len(part) - length + 1
        least = np.minimum(onward[:count], upto[reach - 1 : reach - 1 + count])
        place = (_LOW - (least & _LOW)).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        found[0].append(place[first] + base)
        found[1].append(first + base)
        found[2].append(np.append(first[1:], count) - 1 + base)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ``s`` (integers from 1) by the difference cover {1, 2} mod 3.

    The triples at sampled positions are sorted and named; names that repeat are ordered
    by recursion on the string of names; the other suffixes are sorted by their first
    symbol and the rank after it, and merged in. ``s`` has at most 2**20 symbols.
    """
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    padded = np.concatenate([s, np.zeros(4, np.int64)])
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sampled = np.concatenate([ones, twos])
    triples = (padded[sampled] << 42) | (padded[sampled + 1] << 21) | padded[sampled + 2]
    _, name = np.unique(triples, return_inverse=True)
    if int(name.max()) + 1 < len(sampled):
        order = suffix_array(name.astype(np.int64) + 1)
    else:
        order = np.argsort(name)
    sorted12 = sampled[order]
    rank = np.zeros(n + 4, np.int64)
    rank[sorted12] = np.arange(1, len(sorted12) + 1)
    sorted12 = sorted12[sorted12 < n]
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort((padded[rest] << 21) | rank[rest + 1])]
    by_one = sorted12[sorted12 % 3 == 1]
    by_two = sorted12[sorted12 % 3 == 2]
    pair = lambda i: (padded[i] << 21) | rank[i + 1]
    triple = lambda i: (padded[i] << 42) | (padded[i + 1] << 21) | rank[i + 2]
    before = np.searchsorted(pair(by_one), pair(rest)) + np.searchsorted(triple(by_two), triple(rest))
    out = np.full(n, -1)
    out[before + np.arange(len(rest))] = rest
    out[out < 0] = sorted12
    return out


def repeated(contexts: list[bytes], copied: list[bool], length: int) -> list[np.ndarray]:
    """For each context, its window starts whose ``length`` bytes also start elsewhere.

    A context is followed by a symbol of its own, so nothing matches across contexts'
    ends. Suffixes that share a prefix are neighbours in the array: each is compared with
    the next one. All windows of a ``copied`` context repeat.
    """
    sizes = np.array([len(c) for c in contexts], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    symbols = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8).astype(np.int64) + 1
    symbols[begin[1:] - 1] = 257 + np.arange(len(contexts))
    left = np.repeat(begin[1:] - 1, sizes + 1) - np.arange(len(symbols))  # bytes to the end
    order = suffix_array(symbols)
    order = order[left[order] >= length]
    sums, powers = prefix_sums(np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8))
    prefix = span_hash(sums, powers, order, order + length)
    same = prefix[1:] == prefix[:-1]
    hit = np.zeros(len(symbols), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    out = []
    for k, copy in enumerate(copied):
        starts = np.arange(max(int(sizes[k]) - length + 1, 0))
        out.append(starts if copy else starts[hit[begin[k] : begin[k] + len(starts)]])
    return out


def _merged(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """[start, stop) ranges covered by windows at ascending ``starts``."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length) + 1
    return [(int(p[0]), int(p[-1]) + length) for p in np.split(starts, cut)]


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({"_t1": F.xxhash64(text), "_t2": F.xxhash64(F.lit(7), text), "_bytes": F.octet_length(text)})


def _runs(docs: DataFrame, length: int) -> DataFrame:
    """(t1, t2, first, last, at, anchor, context): every run of windows of every row."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            t1, t2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_t1", "_t2"))
            parts: list[list[np.ndarray]] = [[] for _ in range(6)]
            for i in range(batch.num_rows):
                text = data[offsets[i] : offsets[i + 1]]
                at, first, last = anchors(text, length)
                sums, powers = prefix_sums(text)
                name = span_hash(sums, powers, at, at + min(_ANCHOR, length))
                context = span_hash(sums, powers, first, last + length) ^ (at - first).astype(np.uint64)
                for part, x in zip(parts, (np.full(len(at), i), first, last, at, name, context), strict=True):
                    part.append(x)
            row, first, last, at, name, context = (np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts)
            arrays = [t1[row], t2[row], first.astype(np.int32), last.astype(np.int32), at.astype(np.int32), name.view(np.int64), context.view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["t1", "t2", "first", "last", "at", "anchor", "context"])

    schema = "t1 bigint, t2 bigint, first int, last int, at int, anchor bigint, context bigint"
    long = docs.where(F.col("_bytes") >= length).select("_t1", "_t2", "text")
    return long.mapInArrow(run, schema)


def _cut_out(chosen: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """(anchor, t1, t2, first, copied, bytes, at): the text of the chosen runs."""
    wanted = chosen.groupBy("t1", "t2").agg(F.collect_list(F.struct("anchor", "first", "last", "at", "copied")).alias("runs"))
    # copies of a text meet before the shuffle, so a group of copies isn't one task
    texts = docs.where(F.col("_bytes") >= length).groupBy("_t1", "_t2").agg(F.first("text").alias("text"))
    met = texts.join(wanted, (F.col("_t1") == F.col("t1")) & (F.col("_t2") == F.col("t2")))
    one = F.explode("runs").alias("run")
    rows = met.select("t1", "t2", F.encode("text", "UTF-8").alias("raw"), one)
    body = F.substring("raw", F.col("run.first") + 1, F.col("run.last") - F.col("run.first") + F.lit(length))
    return rows.select("run.anchor", "t1", "t2", "run.first", "run.copied", body.alias("bytes"), "run.at")


def _sorted_matches(contexts: DataFrame, length: int) -> DataFrame:
    """(t1, t2, start, stop) found by suffix arrays over the contexts of whole anchors."""

    def found(rows: list[tuple]) -> pa.RecordBatch:
        hits = repeated([r[5] for r in rows], [r[4] for r in rows], length)
        spans = [(r[1], r[2], r[3] + a, r[3] + b) for r, h in zip(rows, hits, strict=True) if not r[4] for a, b in _merged(h, length)]
        columns = list(zip(*spans, strict=True)) or [(), (), (), ()]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["t1", "t2", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]):
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > _BATCH and row[0] != held[-1][0]:  # an anchor stays in one array
                    yield found(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5]) + 1
        if held:
            yield found(held)

    dealt = contexts.repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, "t1 bigint, t2 bigint, start int, stop int")


def _parted(contexts: DataFrame, length: int) -> DataFrame:
    """Contexts cut into parts of at most ``_PART`` window starts, keyed by what these windows share.

    Equal windows have their anchor at the same offset, so they fall into the same part and
    share its core, the bytes that all windows of a part have in common. The core is the
    part's anchor, which splits a crowd by content.
    """
    part = max(1, min(_PART, length // 4))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = []
            for _, t1, t2, first, copied, raw, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums, powers = prefix_sums(np.frombuffer(raw, np.uint8))
                offset = at - first - np.arange(len(raw) - length + 1)  # of the anchor, from each window start
                lows = np.flatnonzero(np.diff(offset // part, prepend=-(1 << 40)))
                highs = np.append(lows[1:], len(offset)) - 1
                where = (offset[lows] // part).astype(np.uint64)
                final = lows + offset[lows] % part  # the last start that a whole part would have
                core = span_hash(sums, powers, final, final - part + 1 + length)
                whole = span_hash(sums, powers, lows, highs + length) ^ (offset[lows] % part).astype(np.uint64)
                for lo, hi, c, w, k in zip(lows.tolist(), highs.tolist(), core.view(np.int64).tolist(), whole.view(np.int64).tolist(), where.tolist(), strict=True):
                    rows.append((c ^ k, w, t1, t2, first + lo, copied, raw[lo : hi + length]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
            columns = list(zip(*rows, strict=True)) or [()] * 7
            names = ["anchor", "context", "t1", "t2", "first", "copied", "bytes"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return contexts.mapInArrow(
        run, "anchor bigint, context bigint, t1 bigint, t2 bigint, first int, copied boolean, bytes binary"
    )


def _crowd_matches(contexts: DataFrame, length: int) -> DataFrame:
    """(t1, t2, start, stop) for anchors with very many different contexts.

    Their parts are treated as whole contexts are: equal ones repeat, single ones are
    sorted together by core; only a core that is crowded itself has its windows counted.
    """
    parts = materialize(_parted(contexts, length), "parts")
    kinds = parts.groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("n"), F.max("copied").alias("c"))
    kinds = materialize(kinds.select("anchor", "context", ((F.col("n") > 1) | F.col("c")).alias("known")), "part_kinds")
    groups = kinds.groupBy(F.col("anchor").alias("name")).agg(
        F.count(F.lit(1)).alias("kinds"), F.sum((~F.col("known")).cast("int")).alias("single")
    )
    live = kinds.join(groups, F.col("anchor") == F.col("name")).where("known or kinds > 1")
    live = live.select("anchor", "context", "known", F.expr("kinds > 1 and single > 0").alias("open"), (F.col("kinds") > _CROWD).alias("crowd"))
    marked = materialize(parts.join(live, ["anchor", "context"]), "marked_parts")
    stop = F.col("first") + F.octet_length("bytes")
    same = marked.where("known and not copied").select("t1", "t2", F.col("first").alias("start"), stop.alias("stop"))
    one = F.min(F.struct("t1", "t2", "first", "bytes")).alias("x")
    single = marked.where("open").groupBy("anchor", "context", "known", "crowd").agg(one)
    single = single.select("anchor", "x.t1", "x.t2", "x.first", F.col("known").alias("copied"), "x.bytes", "crowd")
    sorted_ = _sorted_matches(single.where("not crowd").drop("crowd"), length)
    counted = _counted_matches(single.where("crowd").drop("crowd"), length)
    return same.union(sorted_).union(counted)


def _counted_matches(contexts: DataFrame, length: int) -> DataFrame:
    """The same for cores with very many different parts: their windows are counted.

    Such a group could be any size. Equal windows are combined before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            raws = batch.column("bytes").to_pylist()
            sizes = [max(len(b) - length + 1, 0) for b in raws]
            names = []
            for raw in raws:
                starts = np.arange(max(len(raw) - length + 1, 0))
                names.append(span_hash(*prefix_sums(np.frombuffer(raw, np.uint8)), starts, starts + length))
            row = np.repeat(np.arange(len(raws)), sizes)
            start = np.concatenate([np.arange(n) for n in sizes] or [np.zeros(0, np.int64)])
            first = batch.column("first").to_numpy()[row] + start
            arrays = [batch.column(c).take(pa.array(row)) for c in ("t1", "t2", "copied")]
            name = np.concatenate(names or [np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(first.astype(np.int32)), pa.array(name)], ["t1", "t2", "copied", "start", "window"])

    every = materialize(contexts.mapInArrow(run, "t1 bigint, t2 bigint, copied boolean, start int, window bigint"), "windows")
    seen = every.groupBy("window").agg(F.count(F.lit(1)).alias("n"), F.max("copied").alias("c")).where("n > 1 or c")
    hit = every.where("not copied").join(seen.select("window"), "window", "left_semi")
    return hit.select("t1", "t2", "start", (F.col("start") + F.lit(length)).alias("stop"))


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(t1, t2, spans): byte ranges, by text, covered by strings of ``length`` that start elsewhere.

    ``docs`` is ``_keyed``. Runs whose whole context is the same are collapsed and known
    to repeat; contexts left single are sorted together with one of each collapsed kind
    that has the same anchor, which is everything they can match.
    """
    runs = materialize(_runs(docs, length), "runs")
    kinds = materialize(runs.groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("n")), "kinds")
    groups = kinds.groupBy(F.col("anchor").alias("name")).agg(
        F.count(F.lit(1)).alias("kinds"), F.sum((F.col("n") == 1).cast("int")).alias("single")
    )
    groups = groups.where("kinds > 1 and single > 0").select("name", (F.col("kinds") > _CROWD).alias("crowd"))
    # contexts that occur once under an anchor that occurs once can't repeat
    live = kinds.join(groups, F.col("anchor") == F.col("name"), "left").where("n > 1 or name is not null")
    live = live.select("anchor", "context", (F.col("n") > 1).alias("copied"), F.col("name").isNotNull().alias("open"), "crowd")
    marked = materialize(runs.join(live, ["anchor", "context"]), "marked")
    same = marked.where("copied").select("t1", "t2", F.col("first").alias("start"), (F.col("last") + F.lit(length)).alias("stop"))
    one = F.min(F.struct("t1", "t2", "first", "last", "at")).alias("x")
    chosen = marked.where("open").groupBy("anchor", "context", "copied", "crowd").agg(one)
    chosen = chosen.select("anchor", "copied", "crowd", "x.*")
    spans = same.groupBy("t1", "t2").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    matches = []
    for crowd, find in ((False, _sorted_matches), (True, _crowd_matches)):
        matches.append(find(_cut_out(chosen.where(F.col("crowd") == crowd), docs, length), length))
    edges = materialize(matches[0].union(matches[1]), "edges")
    more = edges.groupBy("t1", "t2").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    both = spans.unionByName(more).groupBy("t1", "t2").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return materialize(both, "spans")


def _keep(text: bytes, spans: list | None) -> tuple[bytes, int, int]:
    """(remaining bytes, removed bytes, maximal removed runs)."""
    kept, at, removed, count = [], 0, 0, 0
    reach = -1
    for span in sorted((s["start"], s["stop"]) for s in spans or []):
        if span[0] > reach:
            count += 1
            kept.append(text[max(reach, 0) : span[0]])
        removed += max(0, span[1] - max(span[0], reach))
        reach = max(reach, span[1])
    kept.append(text[max(reach, at) :])
    return b"".join(kept), removed, count


def remove_repeats(docs: DataFrame, length: int = LENGTH, texts: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for every row of ``docs``.

    Every byte covered by a string of ``length`` bytes that also starts anywhere else, in
    the same document or another, is removed; strings are judged on the input. ``kept`` are
    the remaining bytes. Null and empty texts have no bytes; texts shorter than ``length``
    keep all. Copies, also repeated rows, are places of their own, so long ones are removed
    whole. Null ids are carried along; an empty table gives an empty result; other columns
    are ignored.
    """
    keyed = _keyed(docs.select("doc_id", "text"))
    found = repeats(keyed, length)
    copies = keyed.where(F.col("_bytes") >= length).groupBy("_t1", "_t2").agg(F.count(F.lit(1)).alias("n"))
    copies = materialize(copies, "copies")
    total = copies.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(copies.where(F.col("n") > total // 1000 + 1).select("_t1", "_t2"))  # at most 1000 rows
    long, short = keyed.where(F.col("_bytes") >= length), keyed.where(F.col("_bytes") < length)
    kind = "array<struct<start:int,stop:int>>"
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("_bytes").cast("int").alias("stop"))).cast(kind)
    crowded = long.join(hot, ["_t1", "_t2"]).select("doc_id", "text", whole.alias("spans"))
    single = long.join(hot, ["_t1", "_t2"], "left_anti").join(
        found, (F.col("_t1") == F.col("t1")) & (F.col("_t2") == F.col("t2")), "left"
    )
    rows = single.select("doc_id", "text", F.col("spans").cast(kind).alias("spans"))
    rows = rows.unionByName(crowded).unionByName(short.select("doc_id", "text", F.lit(None).cast(kind).alias("spans")))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            raws = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            done = [_keep(raw, spans) for raw, spans in zip(raws, batch.column("spans").to_pylist(), strict=True)]
            arrays = [
                batch.column("doc_id"), pa.array([len(r) for r in raws], pa.int64()), pa.array([d[1] for d in done], pa.int64()),
                pa.array([d[2] for d in done], pa.int64()), pa.array([hashlib.sha256(d[0]).hexdigest() for d in done], pa.string()),
            ]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if texts:
                arrays, names = [*arrays, pa.array([d[0] for d in done], pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    fields = [docs.schema["doc_id"], *[T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")]]
    fields += [T.StructField("kept_sha256", T.StringType())] + [T.StructField("kept", T.BinaryType())] * texts
    return rows.mapInArrow(run, T.StructType(fields))

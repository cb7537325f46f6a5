"""Benchmark decontamination over a positional inverted index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridpanel.llm.common import runs, utf8
from gridpanel.llm.words import ALNUM, LOWER, prefix_sums, span_hash, words
from gridpanel.session import materialize

WINDOW = 13
RATIO = 20  # contaminated: at least one word in RATIO is hit
_SEGMENT_BYTES = 4 << 20  # text of one index segment
_SLICE_BYTES = 32 << 20  # benchmark text searched for at once
_ROW = np.int64(1) << np.int64(32)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, term): words of 0-9, a-z (A-Z lower-cased) and non-ASCII characters."""
    data = LOWER[data[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    row, starts, ends = words(data, offsets, ALNUM)
    term = span_hash(*prefix_sums(data), starts, ends)
    position = np.arange(len(row)) - np.searchsorted(row, row)
    return row, position, term


def vocabulary(items: DataFrame) -> np.ndarray:
    """Sorted distinct terms of the benchmark: the terms whose postings are stored."""

    def run(batches):
        for batch in batches:
            _, _, term = tokens(*utf8(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(term).view(np.int64))], ["term"])

    found = items.select("text").mapInArrow(run, "term bigint").distinct().toPandas()["term"]
    return np.sort(found.to_numpy(np.int64).view(np.uint64))


_SEGMENT = (
    "segment string, doc_ids array<{id}>, n_words array<int>, terms array<bigint>, sizes array<int>, "
    "rows array<int>, positions array<int>"
)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array([values], pa.list_(kind))


def build_index(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """The stored index: one row per segment of documents.

    A segment holds the postings (row, position) of each of ``terms`` in its documents,
    term after term, ascending. Other terms can't be part of a match and aren't stored.
    A document lies in one segment, so lists are intersected without a shuffle, and a
    frequent term is spread over all segments.
    """
    known = docs.sparkSession.sparkContext.broadcast(terms)
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]):
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for lo, hi in runs(offsets, _SEGMENT_BYTES):
                row, position, term = tokens(data, offsets[lo : hi + 1])
                counts = np.bincount(row, minlength=hi - lo)
                at = np.searchsorted(known.value, term)
                hit = (at < len(known.value)) & (known.value[np.minimum(at, len(known.value) - 1)] == term) if len(known.value) else np.zeros(len(term), bool)
                at, row, position = at[hit], row[hit], position[hit]
                order = np.argsort(at, kind="stable")
                kept, sizes = np.unique(at, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([f"{task}-{number}"]),
                        pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), batch.column("doc_id").slice(lo, hi - lo)),
                        _lists(counts, pa.int32()),
                        _lists(known.value[kept].view(np.int64), pa.int64()),
                        _lists(sizes, pa.int32()),
                        _lists(row[order], pa.int32()),
                        _lists(position[order], pa.int32()),
                    ],
                    ["segment", "doc_ids", "n_words", "terms", "sizes", "rows", "positions"],
                )
                number += 1

    index = docs.select("doc_id", "text").mapInArrow(run, _SEGMENT.format(id=kind.simpleString()))
    return materialize(index, "index")


def frequencies(index: DataFrame) -> dict[int, int]:
    """Postings of each indexed term over the whole corpus (one entry per benchmark term)."""
    pairs = index.select(F.explode(F.arrays_zip("terms", "sizes")).alias("x"))
    counted = pairs.groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.sizes").alias("n")).toPandas()
    return dict(zip(counted["term"].to_numpy(np.int64).view(np.uint64).tolist(), counted["n"].tolist(), strict=True))


def windows(items: list[tuple[str, str]], size: int) -> list[tuple[str, np.ndarray]]:
    """(item, terms) of every run of ``size`` words; a shorter item is one window."""
    data, offsets = utf8(pa.array([text for _, text in items], pa.string()))
    row, _, term = tokens(data, offsets)
    ends = np.searchsorted(row, np.arange(len(items)), "right")
    out, start = [], 0
    for (item, _), end in zip(items, ends.tolist(), strict=True):
        own = term[start:end]
        out += [(item, own[i : i + size]) for i in range(max(len(own) - size + 1, min(len(own), 1)))]
        start = end
    return out


def search(index: DataFrame, wanted: list[tuple[str, np.ndarray]], rarity: dict[int, int], slop: int = 0) -> DataFrame:
    """(segment, row, item_id, start, stop): word ranges that match a window.

    Lists are taken from the rarest term on: its positions less its offset are the
    candidate starts, and each further term keeps those whose offset-adjusted position
    it also has. With ``slop`` a term may stand up to that many words off its place
    (proximity); with 0 the match is the exact phrase.
    """
    plan = []
    for item, terms in wanted:
        order = sorted(range(len(terms)), key=lambda i: (rarity.get(int(terms[i]), 0), i))
        if rarity.get(int(terms[order[0]]), 0):  # else a term never occurs
            plan.append((item, [(int(terms[i]), i) for i in order]))
    shared = index.sparkSession.sparkContext.broadcast(plan)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for at in range(batch.num_rows):
                name, *values = (batch.column(c)[at] for c in range(5))
                terms_here, sizes_here, rows, positions = (v.values.to_numpy(zero_copy_only=False) for v in values)
                key = rows.astype(np.int64) * _ROW + positions
                ends = np.cumsum(sizes_here)
                names = terms_here.view(np.uint64).tolist()
                lists = {t: key[e - s : e] for t, e, s in zip(names, ends.tolist(), sizes_here.tolist(), strict=True)}
                found: list[tuple[str, np.ndarray, int]] = []
                for item, terms in shared.value:
                    first = lists.get(terms[0][0])
                    if first is None:
                        continue
                    starts = first - terms[0][1]
                    for term, offset in terms[1:]:
                        own = lists.get(term)
                        if own is None:
                            starts = starts[:0]
                        else:
                            look = starts + offset
                            at = np.minimum(np.searchsorted(own, look - slop), len(own) - 1)
                            starts = starts[(own[at] >= look - slop) & (own[at] <= look + slop)]
                        if not len(starts):
                            break
                    if len(starts):
                        found.append((item, starts, len(terms)))
                if found:
                    sizes = [len(s) for _, s, _ in found]
                    begin = np.concatenate([s for _, s, _ in found])
                    stop = begin + np.repeat([n for _, _, n in found], sizes)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([name.as_py()] * len(begin)),
                            pa.array((begin // _ROW).astype(np.int32)),
                            pa.array(np.repeat([i for i, _, _ in found], sizes).tolist(), pa.string()),
                            pa.array((begin % _ROW).astype(np.int32)),
                            pa.array((stop - begin // _ROW * _ROW).astype(np.int32)),
                        ],
                        ["segment", "row", "item_id", "start", "stop"],
                    )

    columns = index.select("segment", "terms", "sizes", "rows", "positions")
    return columns.mapInArrow(run, "segment string, row int, item_id string, start int, stop int")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0) -> tuple[DataFrame, DataFrame]:
    """The index of ``docs`` and all matched word ranges of ``benchmark`` items in it.

    The benchmark reaches tasks in slices of about ``_SLICE_BYTES``; a larger one takes
    more searches of the same index.
    """
    items = benchmark.where("text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = size // _SLICE_BYTES + 1
    index = build_index(docs, vocabulary(items))
    rarity = frequencies(index)
    spans = None
    for k in range(slices):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(slices)) == k).collect()  # about _SLICE_BYTES
        hits = search(index, windows([(r["item_id"], r["text"]) for r in part], window), rarity, slop)
        spans = hits if spans is None else spans.union(hits)
    return index, materialize(spans, "spans")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, items, contaminated) for every row of ``docs``.

    ``n_hit``: words inside an occurrence of a window of ``window`` consecutive item words
    (a shorter item is one window); ``items``: sorted ids of items with occurring windows;
    contaminated if n_hit > 0 and at least a ``RATIO``-th of the words. Null and empty
    texts have no words. Items without words match nothing; repeated items count once.
    Repeated rows are judged each; null ids are carried along; empty tables give no
    rows, or rows without hits. Other columns are ignored.
    """
    index, spans = matches(docs, benchmark, window)
    rows = index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "n_words"))).select(
        "segment", F.col("pos").alias("row"), F.col("col.doc_ids").alias("doc_id"), F.col("col.n_words").cast("long").alias("n_words")
    )
    distinct = spans.select("segment", "row", "start", "stop").distinct()
    ordered = Window.partitionBy("segment", "row").orderBy("start", "stop")
    reached = F.coalesce(F.max("stop").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fresh = distinct.select("segment", "row", F.greatest(F.col("stop") - F.greatest("start", reached), F.lit(0)).alias("n"))
    hit = fresh.groupBy("segment", "row").agg(F.sum("n").alias("n_hit"))
    named = spans.groupBy("segment", "row").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    found = rows.join(hit.join(named, ["segment", "row"]), ["segment", "row"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (n_hit * RATIO >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` whose doc_id isn't contaminated; rows without doc_id stay."""
    bad = contamination(docs, benchmark, window).where("contaminated").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti")

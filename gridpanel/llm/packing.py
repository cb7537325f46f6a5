"""Packing: non-negative least squares over length combinations that fill a window."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridpanel.llm.common import runs, utf8
from gridpanel.session import materialize

WINDOW = 2048
GRAIN = 32  # lengths are planned in steps of so many tokens
DEPTH = 4  # pieces in a planned sequence
END_ID = 1
_KEPT = 300_000  # parts remembered in each of two generations
_TOGETHER = 4 << 20  # bytes of texts encoded together
_SHORT = 64  # longer parts aren't remembered
# letters that stay single letters when normalised and lower-cased, then signs that stay together
_WORD = re.compile(r"([a-zA-ZÀ-ÖØ-öø-ÿ\u0100-\u012f\u0131-\u0148\u014a-\u017f]+)([!-&(-/:-@\[-`{-~]*)")
_WORD_END = "</w>"


class Encoder:
    """Ids of a text put together from those of its blank-separated parts.

    The vocabulary's pre-tokenizer never joins over blanks, and a run of letters is one
    word to it, apart from stops after it. So a part seen before is looked up, words that
    are new are encoded in one call for many texts and told apart by the mark of a word's last
    piece, and only other parts are encoded one by one. Parts are remembered in two
    generations: when the newer is full the older is forgotten, so frequent ones stay.
    """

    def __init__(self, vocabulary: str):  # contents of the file
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallel part
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        names = self.tokenizer.get_vocab()
        self.last = np.zeros(max(names.values()) + 1, bool)
        self.last[[i for name, i in names.items() if name.endswith(_WORD_END)]] = True

    def encoded(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of several runs of letters, from one call."""
        ids = self.encoded(" ".join(words))
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words):
            return [self.encoded(w).tobytes() for w in words]
        raw, bounds = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [raw[i:j] for i, j in zip(bounds, bounds[1:], strict=False)]

    def learn(self, parts: Sequence[str]) -> None:
        """Add parts, and the words they begin with, to ``known``."""
        older, known, plain, split = self.older, self.known, [], []
        for part in parts:
            if part in older:
                known[part] = older[part]
            elif part.isascii() and part.isalpha():
                if part.islower():
                    plain.append(part)
                else:
                    split.append((part, part.lower(), ""))
            elif word := _WORD.fullmatch(part):
                split.append((part, word[1].lower(), word[2]))
            else:
                known[part] = self.encoded(part).tobytes()
        stops = {stop: self.encoded(stop).tobytes() if stop else b"" for stop in {x[2] for x in split}}
        new = [*plain, *{x[1] for x in split}.difference(plain).difference(known)]
        known.update(zip(new, self.words(new), strict=True) if new else ())
        known.update([(part, known[stem] + stops[stop]) for part, stem, stop in split])

    def ids(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text as unsigned 32-bit little-endian numbers.

        Equal parts of the texts are looked up once; the ids are then put together as arrays.
        """
        if len(self.known) > _KEPT:
            self.older, self.known = self.known, {}
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        coded = split.flatten().dictionary_encode()
        parts = coded.dictionary.to_pylist()
        missing = [p for p in parts if p not in self.known]
        if missing:
            self.learn(missing)
        found = [self.known[p] for p in parts]
        for part in missing:
            if len(part) > _SHORT:
                del self.known[part]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        which = coded.indices.to_numpy(zero_copy_only=False)
        lengths = sizes[which]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        begins = np.cumsum(sizes) - sizes
        places = np.repeat(begins[which] - ends[:-1], lengths) + np.arange(ends[-1])
        ids = np.frombuffer(b"".join(found), "<u4")[places]
        bounds = ends[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return [ids[i:j].tobytes() for i, j in zip(bounds, bounds[1:], strict=False)]


@lru_cache(maxsize=1)
def _encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)  # once per Python worker


def tokens(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID, grain: int = GRAIN) -> DataFrame:
    """One row per row of ``docs``: its length and, of each window and of the rest, the crc32 of its ids.

    (doc_id, task, at, n, before, crcs, rest, step, k, rest_crc, rest_ids): ``n`` ids with the
    closing ``end_id``; the document's ids are cut into n // window full windows and a rest, whose
    length rounded up is ``step`` times ``grain``. ``before`` counts the task's full windows of
    earlier rows, ``k`` its earlier rests of the same step, so that numbers over all tasks need
    only sums per task. The ids themselves are kept for the rest only, as bytes. Written once; a
    lost executor can't change a number. The vocabulary is read by the driver and broadcast.
    """
    with open(vocabulary, encoding="utf-8") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches):
        encoder, task, at, before = _encoder(model.value), TaskContext.get().partitionId(), 0, 0
        seen, closing = np.zeros(window // grain + 1, np.int64), np.uint32(end_id).astype("<u4").tobytes()
        for batch in batches:
            rows = []
            texts = pc.fill_null(batch.column("text"), "")
            _, offsets = utf8(texts)
            encoded = chain.from_iterable(encoder.ids(texts[i:j]) for i, j in runs(offsets, _TOGETHER))
            for ids in encoded:
                raw = ids + closing
                size = len(raw) // 4
                full, rest = divmod(size, window)
                crcs = [zlib.crc32(raw[4 * window * i : 4 * window * (i + 1)]) for i in range(full)]
                tail, step = raw[4 * window * full :], -(-rest // grain)
                rows.append((task, at, size, before, crcs, rest, step, int(seen[step]), zlib.crc32(tail), tail))
                at, before = at + 1, before + full
                seen[step] += 1
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            columns = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *_COLUMNS])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *T._parse_datatype_string(_KINDS).fields])
    return materialize(docs.select("doc_id", "text").mapInArrow(run, schema), "tokens")


_KINDS = "task int, at bigint, n bigint, before bigint, crcs array<bigint>, rest int, step int, k bigint, rest_crc bigint, rest_ids binary"
_COLUMNS = [c.split()[0] for c in _KINDS.split(", ")]


def combinations(total: int, depth: int) -> list[tuple[int, ...]]:
    """All non-increasing tuples of at most ``depth`` positive whole numbers with sum ``total``."""

    def parts(left: int, most: int, room: int):
        if left == 0:
            yield ()
        elif room:
            for x in range(min(left, most), (left - 1) // room, -1):
                for more in parts(left - x, x, room - 1):
                    yield (x, *more)

    return list(parts(total, total, depth))


def nonnegative(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by the active-set method.

    One variable at a time enters where the residual's gradient is largest; variables that
    would turn negative leave again. At most as many as ``a`` has rows are above zero.
    """
    x, held = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    small = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds or 10 * a.shape[0]):
        slope = a.T @ (b - a @ x)
        slope[held] = -np.inf
        enter = int(np.argmax(slope))
        if slope[enter] <= small:
            break
        held[enter] = True
        while True:
            now = np.flatnonzero(held)
            best = np.linalg.lstsq(a[:, now], b, rcond=None)[0]
            if best.min() > 0:
                x[:] = 0
                x[now] = best
                break
            falling = best <= 0
            with np.errstate(divide="ignore", invalid="ignore"):
                part = np.where(falling, x[now] / (x[now] - best), np.inf)
            step = float(np.nanmin(part))
            x[now] += step * (best - x[now])
            leave = now[falling & (x[now] <= small)]
            held[leave] = False
            x[leave] = 0
            if not held.any():
                break
    return x


@dataclass(frozen=True)
class Plan:
    """Planned sequences, of bounded size whatever the corpus.

    ``ranges``: (step, start, stop, first, each, slot): the pieces ranked [start, stop) within
    their length step go to the sequences from ``first`` on, ``each`` to a sequence, from
    position ``slot`` on.
    """

    sequences: int
    ranges: list[tuple[int, int, int, int, int, int]]


def plan(histogram: Sequence[int], total: int, depth: int = DEPTH, grain: int = GRAIN) -> Plan:
    """Which pieces share a sequence, from the number of pieces of each length step.

    ``histogram[s]``: pieces of (s - 1) * grain + 1 to s * grain tokens, the last step being a
    whole window; ``total`` tokens altogether. The repeats of each combination of at most
    ``depth`` steps that fills the window are solved against the histogram and rounded down
    to what there is; what is left is packed greedily into further such combinations.
    As lengths were rounded up, sequences have room, which the pieces left over are to
    fill: so there are at most total // window sequences, and repeats are scaled down to that.
    """
    steps, count = len(histogram) - 1, np.asarray(histogram, np.int64)
    combos = combinations(steps, depth)
    a = np.zeros((steps + 1, len(combos)), np.int64)
    for j, combo in enumerate(combos):
        np.add.at(a[:, j], list(combo), 1)
    solved = nonnegative(a.astype(float), count.astype(float)).astype(np.int64)
    repeats, left = np.zeros(len(combos), np.int64), count.copy()

    def fill(j: int, most: int | None = None) -> None:
        used = a[:, j] > 0
        n = int((left[used] // a[used, j]).min())
        n = n if most is None else min(n, most)
        repeats[j] += n
        left[used] -= n * a[used, j]

    for j in np.argsort(-solved, kind="stable"):
        fill(j, int(solved[j]))
    for j in np.argsort(a.sum(axis=0), kind="stable"):  # fewest pieces first
        fill(j)
    most, now = total // (steps * grain), int(repeats.sum())
    if now > most:
        repeats = repeats * most // now
    ranges, first, at = [], 0, np.zeros(steps + 1, np.int64)
    for j in np.flatnonzero(repeats):
        slot = 0
        for step in sorted(set(combos[j]), reverse=True):
            each = combos[j].count(step)
            n = int(repeats[j]) * each
            ranges.append((step, int(at[step]), int(at[step]) + n, first, each, slot))
            at[step] += n
            slot += each
        first += int(repeats[j])
    return Plan(first, ranges)


def _earlier(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., task, earlier): the sum of ``value`` over all tasks before, from sums per task."""
    sums = rows.groupBy(*by, "task").agg(F.sum(value).alias("v"))
    before = Window.partitionBy(*by).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*by, F.col("task"), F.coalesce(F.sum("v").over(before), F.lit(0)).alias("earlier"))


def _laid_out(rows: DataFrame, value: str, name: str) -> DataFrame:
    """``rows`` with ``start``, the sum of ``value`` over the rows before, in a fixed order."""
    kept = rows.columns

    def run(batches):
        task, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = batch.column(value).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = at + np.cumsum(sizes)
            at = int(ends[-1]) if len(ends) else at
            fields = [*batch.columns, pa.array([task] * len(sizes), pa.int32()), pa.array(ends - sizes)]
            yield pa.RecordBatch.from_arrays(fields, [*kept, "task", "start"])

    schema = T.StructType([*rows.schema.fields, T.StructField("task", T.IntegerType()), T.StructField("start", T.LongType())])
    placed = materialize(rows.mapInArrow(run, schema), name)
    moved = placed.join(_earlier(placed, value), "task").withColumn("start", F.col("start") + F.col("earlier"))
    return moved.select(*kept, "start")


def _slices(met: DataFrame) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of pieces cut from rests.

    ``met``: a rest (doc_id, n, rest, ids, start in the stream) and a gap (sequence_id, offset,
    g_start, g_stop) that overlap.
    """

    def run(batches):
        for batch in batches:
            c = {k: batch.column(k).to_pylist() for k in ("n", "rest", "rest_ids", "start", "offset", "g_start", "g_stop")}
            rows = []
            for n, rest, ids, start, offset, g0, g1 in zip(*c.values(), strict=True):
                low, high = max(start, g0), min(start + rest, g1)
                part = ids[4 * (low - start) : 4 * (high - start)]
                rows.append((n - rest + low - start, high - low, zlib.crc32(part), n, offset + low - g0))
            first, length, crc, n, offset = [pa.array(list(x), pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * 5)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), first, length, crc, n, batch.column("sequence_id"), offset], [f.name for f in schema]
            )

    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([met.schema["doc_id"], *[T.StructField(x, T.LongType()) for x in names]])
    return met.select("doc_id", "n", "rest", "rest_ids", "start", "sequence_id", "offset", "g_start", "g_stop").mapInArrow(run, schema)


def pack(
    docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID, grain: int = GRAIN, depth: int = DEPTH
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): pieces of every row of ``docs``.

    A document's ids are those of its text (null: none) and ``end_id``. Full windows are cut
    off its front and fill a sequence each. The rests are put together by ``plan``; its
    histogram has ``window`` / ``grain`` rows, all that the driver sees. Rests that the plan
    leaves over form one stream, which first fills the room in planned sequences, in order, and
    then whole windows; the last tokens go to sequences of descending powers of two. Every
    sequence is therefore full or a power of two, none is padded, and each id lies in exactly
    one piece.

    Numbers come from sums per task, so nothing is sorted and no length is hot; ids are moved
    only for rests of the stream. Repeated rows and null ids are documents like any other. An
    empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    if window % grain:
        raise ValueError("the window must be a multiple of the grain")
    found = tokens(docs, vocabulary, window, end_id, grain)
    rests = found.where("rest > 0")
    counts = materialize(rests.groupBy("task", "step").agg(F.count(F.lit(1)).alias("c"), F.sum("rest").alias("t")), "counts")
    histogram, total = [0] * (window // grain + 1), 0
    for r in counts.groupBy("step").agg(F.sum("c").alias("c"), F.sum("t").alias("t")).collect():  # one row per step
        histogram[r["step"]], total = r["c"], total + r["t"]
    planned = plan(histogram, total, depth, grain)

    full = found.where(F.size("crcs") > 0).join(_earlier(found.withColumn("f", F.size("crcs")), "f"), "task")
    whole = full.select("doc_id", "n", (F.col("before") + F.col("earlier") + planned.sequences).alias("first"), F.posexplode("crcs").alias("i", "crc"))
    whole = whole.select(
        "doc_id", (F.col("i") * F.lit(window)).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), F.col("crc").alias("ids_crc32"),
        F.col("n").alias("doc_tokens"), (F.col("first") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    n_full = found.agg(F.coalesce(F.sum(F.size("crcs")), F.lit(0))).first()[0]

    # rank of each rest within its step
    ranked = rests.select("doc_id", "task", "at", "n", "rest", "step", "k", "rest_crc").join(_earlier(counts, "c", ["step"]), ["task", "step"])
    ranked = ranked.withColumn("rank", F.col("k") + F.col("earlier")).drop("k", "earlier")
    kind = "r_step int, r_start bigint, r_stop bigint, first bigint, each bigint, slot bigint"
    ranges = F.broadcast(spark.createDataFrame(planned.ranges, kind))  # at most depth rows for each of window / grain combinations
    here = (F.col("step") == F.col("r_step")) & (F.col("rank") >= F.col("r_start")) & (F.col("rank") < F.col("r_stop"))
    ranked = materialize(ranked.join(ranges, here, "left"), "ranked")

    place = F.col("rank") - F.col("r_start")
    members = ranked.where("first is not null").select(
        (F.col("first") + F.floor(place / F.col("each"))).alias("sequence_id"), (F.col("slot") + place % F.col("each")).alias("slot"),
        "doc_id", "n", "rest", "rest_crc",
    )
    sequence = members.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("slot", "rest", "doc_id", "n", "rest_crc"))).alias("m"))
    sequence = materialize(sequence.withColumn("used", F.aggregate("m", F.lit(0).cast("long"), lambda s, x: s + x["rest"])), "sequences")
    ahead = F.aggregate(F.slice("m", 1, F.col("i")), F.lit(0).cast("long"), lambda s, x: s + x["rest"])
    together = sequence.select("sequence_id", "m", F.posexplode("m").alias("i", "x")).select(
        F.col("x.doc_id").alias("doc_id"), (F.col("x.n") - F.col("x.rest")).alias("start"), F.col("x.rest").cast("long").alias("length"),
        F.col("x.rest_crc").alias("ids_crc32"), F.col("x.n").alias("doc_tokens"), "sequence_id", ahead.alias("offset"),
    )

    # the stream of rests that are left over, and the gaps it fills
    left = ranked.where("first is null").select("task", "at")
    stream = rests.select("doc_id", "task", "at", "n", "rest", "rest_ids").join(left, ["task", "at"]).drop("task", "at")
    stream = materialize(_laid_out(stream, "rest", "stream"), "stream")
    amount = stream.agg(F.coalesce(F.sum("rest"), F.lit(0))).first()[0]
    gaps = sequence.where(F.col("used") < window).select("sequence_id", F.col("used").alias("offset"), (F.lit(window) - F.col("used")).alias("room"))
    gaps = _laid_out(gaps, "room", "gaps").select("sequence_id", "offset", F.col("start").alias("g_start"), (F.col("start") + F.col("room")).alias("g_stop"))
    gaps = materialize(gaps, "gaps")
    room = gaps.agg(F.coalesce(F.max("g_stop"), F.lit(0))).first()[0]
    more, last = divmod(max(amount - room, 0), window)
    next_id = planned.sequences + n_full
    fresh = spark.range(more).select(
        (F.col("id") + next_id).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        (F.col("id") * window + room).alias("g_start"), (F.col("id") * window + room + window).alias("g_stop"),
    )
    tails, at = [], room + more * window
    for bit in reversed(range(max(window, 1).bit_length())):
        if last >> bit & 1:
            tails.append((next_id + more + len(tails), 0, at, at + (1 << bit)))
            at += 1 << bit
    gaps = gaps.unionByName(fresh).unionByName(spark.createDataFrame(tails, "sequence_id bigint, offset bigint, g_start bigint, g_stop bigint"))

    def blocks(start: str, stop: Column) -> Column:
        return F.explode(F.sequence(F.floor(F.col(start) / window), F.floor((stop - 1) / window)))

    rows = stream.withColumn("block", blocks("start", F.col("start") + F.col("rest")))
    spans = gaps.withColumn("g_block", blocks("g_start", F.col("g_stop")))
    begin = F.greatest("start", "g_start")
    met = rows.join(spans, F.col("block") == F.col("g_block")).where(
        (begin < F.least(F.col("start") + F.col("rest"), F.col("g_stop"))) & (F.floor(begin / window) == F.col("block"))
    )
    return whole.unionByName(together).unionByName(_slices(met))

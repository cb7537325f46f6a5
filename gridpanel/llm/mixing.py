"""Mixing sources to target weights: Pfair windows served earliest deadline first."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpanel.llm.common import dense_index
from gridpanel.session import materialize

BLOCK_ROWS = 16
PERIOD = 1 << 14  # slots that one task serves at once
EXACT = 1 << 16  # whole weights up to this sum have a period of their own
TEMPER = 0.5  # default targets: documents of the source to this power
ON_TARGET = 0.9  # the mix is on target while sources with this much of the weight last
MAX_SOURCES = 1000  # bound of every table built on the driver


def serve(parts: Mapping[str, int]) -> list[tuple[str, int, int, int, int]]:
    """One period: (source, k, slot, release, deadline), one row per slot.

    With Q slots and a parts, block k of a source may be served from slot floor(kQ/a) and
    must be served before slot ceil((k+1)Q/a). The parts add up to Q, so earliest deadline
    first fills every slot and meets every window; no source is a whole block off its
    weight at any slot. Ties go to the smaller name.
    """
    period = sum(parts.values())
    jobs = sorted((k * period // a, -(-(k + 1) * period // a), source, k) for source, a in parts.items() for k in range(a))
    ready: list[tuple[int, str, int, int]] = []
    out, at = [], 0
    for slot in range(period):
        while at < len(jobs) and jobs[at][0] <= slot:
            release, deadline, source, k = jobs[at]
            heapq.heappush(ready, (deadline, source, k, release))
            at += 1
        deadline, source, k, release = heapq.heappop(ready)
        out.append((source, k, slot, release, deadline))
    return out


def whole_weights(weights: Mapping[str, float | Fraction]) -> dict[str, int]:
    """The weights as whole numbers in exactly their ratios; a float counts as the decimal that it prints."""
    exact = {s: Fraction(str(w)) for s, w in weights.items()}
    common = math.lcm(*[w.denominator for w in exact.values()])
    whole = {s: int(w * common) for s, w in exact.items()}
    return {s: w // math.gcd(*whole.values()) for s, w in whole.items()}


def quotas(weights: Mapping[str, int], upto: int, done: Mapping[str, int]) -> dict[str, int]:
    """Blocks of each source in the first ``upto`` slots, ``done`` at least.

    Each gets its weight's share rounded down, the largest remainders one more. Sources
    that had their extra block early may take too many: the smallest remainders wait.
    """
    total = sum(weights.values())
    got = {s: max(done[s], upto * w // total) for s, w in weights.items()}
    lag = {s: upto * w - got[s] * total for s, w in weights.items()}
    over = upto - sum(got.values())
    step = 1 if over > 0 else -1
    able = [s for s in got if step > 0 or got[s] > done[s]]
    for s in sorted(able, key=lambda s: (-step * lag[s], s))[: abs(over)]:
        got[s] += step
    return got


def phases(
    blocks: Mapping[str, int], weights: Mapping[str, int], period: int = PERIOD
) -> Iterator[tuple[int, dict[str, int], dict[str, int], int]]:
    """(first slot, parts, first block of each source, weight of the lasting sources) of every period.

    Whole weights that add up to at most ``EXACT`` have a period of that sum, or a
    multiple near ``period``, in which every source has its exact parts: at no slot is a
    source a whole block off its weight. Other weights get their parts by ``quotas`` over
    all slots so far, so what one period rounds off the next ones make good: a source is
    less than two blocks off, however many slots there are. Periods end where a source
    runs out (the one before that may be cut); the others then start anew with their
    relative weights.
    """
    left, first, slot = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0
    while left:
        factor = math.gcd(*[weights[s] for s in left])
        now = {s: weights[s] // factor for s in left}
        total, lasting = sum(now.values()), sum(weights[s] for s in left)
        length = total * max(1, period // total) if total <= EXACT else period
        done = dict.fromkeys(now, 0)
        while len(left) == len(now):
            step = min(length, min(left[s] * total // w for s, w in now.items()))
            step = step // total * total or step  # whole rounds of the weights
            then = quotas(now, sum(done.values()) + step, done)
            parts = {s: min(n - done[s], left[s]) for s, n in then.items()}
            parts = {s: n for s, n in parts.items() if n}
            yield slot, parts, {s: first[s] for s in parts}, lasting
            slot += sum(parts.values())
            for s, n in parts.items():
                left[s] -= n
                first[s] += n
                done[s] += n
            left = {s: n for s, n in left.items() if n}


def _serve_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The slots of whole periods, one period after another."""
    for batch in batches:
        for row in batch.to_pylist():
            first, base = dict(zip(row["sources"], row["first"], strict=True)), row["slot"]
            served = serve(dict(zip(row["sources"], row["parts"], strict=True)))
            source, k, slot, release, deadline = zip(*served, strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(source, pa.string()),
                    pa.array([first[s] + n for s, n in zip(source, k, strict=True)], pa.int64()),
                    *[pa.array(np.array(x, np.int64) + base) for x in (slot, release, deadline)],
                    pa.array([row["on_target"]] * len(source), pa.bool_()),
                ],
                ["_s", "_b", "slot", "release_slot", "deadline_slot", "on_target"],
            )


def mix(
    docs: DataFrame,
    weights: Mapping[str | None, float | Fraction] | None = None,
    block_rows: int = BLOCK_ROWS,
    period: int = PERIOD,
    on_target: float = ON_TARGET,
) -> DataFrame:
    """Every row of ``docs`` with block, slot, release_slot, deadline_slot and on_target.

    A source's rows, in an order drawn from doc_id, form blocks of ``block_rows`` (the last
    may be smaller). ``weights`` are the targets by source (null is a source of its own;
    every source needs a positive one); by default a source's size to the power ``TEMPER``.
    Slots count blocks. A source that runs out leaves and the others go on, so all rows
    get a slot; ``on_target`` is false from where sources with more than 1 - ``on_target``
    of the weight have run out. Sources are bounded by ``MAX_SOURCES`` (else ValueError).
    The driver plans counts, one row per ``period`` slots; tasks serve a period each. A
    source with a third of all rows is spread over its blocks. Repeated rows each get a place; an empty table gives an
    empty result; columns named like a result column are replaced.
    """
    spark = docs.sparkSession
    made = ("block", "slot", "release_slot", "deadline_slot", "on_target", "_source", "_at", "_draw")
    own = [c for c in docs.columns if c not in made]
    name = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    drawn = docs.select(*own, name.alias("_source"), F.xxhash64(F.lit("mix"), "doc_id").alias("_draw"))
    order = [F.col("_draw"), F.col("doc_id").asc_nulls_first(), F.xxhash64(*own)]  # the last tells many null ids apart
    placed = dense_index(drawn, ["_source"], order, "_at")
    placed = placed.withColumn("block", F.floor(F.col("_at") / F.lit(block_rows)))
    counted = placed.groupBy("_source").agg(F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(counted) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: pool the small ones first")
    rows = {r["_source"]: r["n"] for r in counted}
    if weights is None:
        target = {s: n**TEMPER for s, n in rows.items()}
    else:
        named = {"" if s is None else f"={s}": w for s, w in weights.items()}
        if missing := [s for s in rows if named.get(s, 0) <= 0]:
            raise ValueError(f"no positive weight for {missing[:5]}")
        target = {s: named[s] for s in rows}
    whole = whole_weights(target) if rows else {}
    horizon = on_target * sum(whole.values())
    plan = [
        (slot, list(parts), list(parts.values()), list(first.values()), lasting >= horizon)
        for slot, parts, first, lasting in phases({s: -(-n // block_rows) for s, n in rows.items()}, whole, period)
    ]
    periods = spark.createDataFrame(
        plan, "slot long, sources array<string>, parts array<long>, first array<long>, on_target boolean"
    ).repartition(max(1, len(plan) // 4))
    schedule = periods.mapInArrow(
        _serve_all, "_s string, _b long, slot long, release_slot long, deadline_slot long, on_target boolean"
    )
    # a (source, block) has block_rows rows, so no key is hot
    joined = placed.join(schedule, (F.col("_source") == F.col("_s")) & (F.col("block") == F.col("_b")))
    return joined.select(*own, "block", "slot", "release_slot", "deadline_slot", "on_target")


def to_targets(docs: DataFrame, only_on_target: bool = False, **options) -> DataFrame:
    """The rows of ``docs`` in serving order: the mix at its weights, then what outlasts them.

    All rows stay. With ``only_on_target`` the rows after the mix has left its targets
    (see ``mix``, which takes ``options``) go: the weights have no use for them. The order
    is found from ids and sources alone; other columns are written once under a row
    number and meet their slot in one join on it, so no key is hot there.
    """
    packed = docs.select(F.struct(*docs.columns).alias("_doc"), F.monotonically_increasing_id().alias("_row"))
    packed = materialize(packed, "packed")  # fixes the row numbers; own columns keep their names
    mixed = mix(packed.select("_row", "_doc.doc_id", "_doc.source"), **options)
    places = mixed.where("on_target") if only_on_target else mixed
    joined = packed.join(places.select(F.col("_row").alias("_r"), "slot"), F.col("_row") == F.col("_r"))
    ordered = joined.repartitionByRange("slot", "_row").sortWithinPartitions("slot", "_row")
    return ordered.select("_doc.*")

"""Merkle dataset manifest: a slot pivot turns each parent's children into columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpanel.llm.common import dense_index
from gridpanel.session import materialize

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts, concatenated; null parts count as empty."""
    return F.sha2(F.concat_ws("", *parts).cast("binary"), 256)


def encoded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*fields: Column) -> Column:
    """Digest of a row's fields; the byte counts keep shifted contents apart."""
    return digest(*[encoded(f) for f in fields])


def siblings(path: Column) -> Column:
    """Digest of all sibling digests on ``path``, nearest level first, left to right."""
    return digest(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""))


def folded(node: Column, path: Column) -> Column:
    """The root that ``node`` leads to: each step hashes it between its siblings."""
    return F.aggregate(path, node, lambda below, step: digest(step["left"], below, step["right"]))


@dataclass(frozen=True)
class Tree:
    """Trees of several groups: runs of each level, lowest first, and every group's last node.

    ``levels[k]``: (grp, run, n, s0...): the children of each node of level k + 1 in the columns
    of their slots, n the group's nodes on level k; the lowest level also has their rows (r0...).
    ``tops``: (grp, node). ``single``: (grp, node, row) of groups that are one leaf.
    """

    levels: list[DataFrame]
    tops: DataFrame
    single: DataFrame
    fanout: int


def _pivot(nodes: DataFrame, fanout: int) -> DataFrame:
    """The slot pivot of (grp, at, n, node[, row]): one row per ``fanout`` consecutive nodes.

    A run never has more than ``fanout`` rows, so no group is hot; consecutive nodes mostly
    share a task, so partial aggregation shrinks them before they are shuffled.
    """
    slot = F.pmod(F.col("at"), F.lit(fanout))
    run = F.floor(F.col("at") / F.lit(fanout)).alias("run")
    carried = [(p, c) for p, c in (("s", "node"), ("r", "row")) if c in nodes.columns]
    spread = [F.first(F.when(slot == i, F.col(c)), ignorenulls=True).alias(f"{p}{i}") for p, c in carried for i in range(fanout)]
    return nodes.groupBy("grp", run, "n").agg(*spread)


def _slots(fanout: int, prefix: str = "s") -> list[Column]:
    return [F.col(f"{prefix}{i}") for i in range(fanout)]


def grow(nodes: DataFrame, fanout: int = FANOUT) -> Tree:
    """Trees over leaves (grp struct, at 0-based place, n leaves of the group, node digest, row struct).

    Levels are added until every group is down to one node; each is written once and has
    1/``fanout`` of the rows of the one below.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    single = nodes.where("n = 1").select("grp", "node", "row")
    levels, tops, level = [], single.select("grp", "node"), nodes.where("n > 1")
    while most > 1:
        runs = materialize(_pivot(level, fanout), "runs")
        levels.append(runs)
        parents = runs.select(
            "grp", F.col("run").alias("at"), F.ceil(F.col("n") / F.lit(fanout)).cast("long").alias("n"), digest(*_slots(fanout)).alias("node")
        )
        tops = tops.unionByName(parents.where("n = 1").select("grp", "node"))
        level = parents.where("n > 1")
        most = -(-most // fanout)
    return Tree(levels, tops, single, fanout)


def _step(own: Column, fanout: int, prefix: str = "s") -> Column:
    """What stands left and right of slot ``own``: the run's concatenation without its own column."""
    slots = _slots(fanout, prefix)
    left = F.concat_ws("", *[F.when(own > i, s) for i, s in enumerate(slots)])
    right = F.concat_ws("", *[F.when(own < i, s) for i, s in enumerate(slots)])
    return F.struct(left.alias("left"), right.alias("right"))


def proofs(tree: Tree, tops: DataFrame) -> DataFrame:
    """(grp, node, row, path, and what else ``tops`` has) for every leaf of ``tree``.

    ``tops`` (grp, path, ...): what lies above each group's last node. From the highest level
    down every run takes its parent run's path and the parent's other slots, one join per
    level on (group, place) of runs, not of leaves; the lowest runs' slots are then
    exploded to leaves. A path has two texts for each level: (fanout - 1) digests.
    """
    fanout = tree.fanout
    more = [c for c in tops.columns if c != "grp"]
    own = tree.single.join(tops, "grp").select("grp", "node", "row", *more)
    above = None
    for runs in reversed(tree.levels):
        found = runs.where(F.col("n") <= fanout).join(tops, "grp")
        if above is not None:
            up = above.select(
                F.col("grp"), F.col("run").alias("up"), *[F.col(f"s{i}").alias(f"u{i}") for i in range(fanout)], *[F.col(c) for c in more]
            )
            inner = runs.where(F.col("n") > fanout).withColumn("up", F.floor(F.col("run") / F.lit(fanout))).join(up, ["grp", "up"])
            step = _step(F.pmod(F.col("run"), F.lit(fanout)), fanout, "u")
            inner = inner.withColumn("path", F.concat(F.array(step), F.col("path")).cast(PATH))
            found = found.unionByName(inner.select(*found.columns))
        above = found
    if above is None:
        return own
    leaves = above.select(
        "grp", *more, *_slots(fanout), F.posexplode(F.array(*_slots(fanout, "r"))).alias("own", "row")
    ).where(F.col("row").isNotNull())
    node = F.array(*_slots(fanout))[F.col("own")]
    path = F.concat(F.array(_step(F.col("own"), fanout)), F.col("path")).cast(PATH)
    return own.unionByName(leaves.withColumns({"node": node, "path": path}).select(*own.columns))


def manifest(
    docs: DataFrame,
    fields: Sequence[str] = FIELDS,
    by: str = "source",
    order: str = "doc_id",
    extra: Sequence[Column] = (),
    fanout: int = FANOUT,
) -> DataFrame:
    """(``by``, ``order``, extra..., leaf, subroot, root, path) for every row of ``docs``.

    Leaves are digests of ``fields``. Within each value of ``by`` they ascend by ``order``
    (null first; equal values by their leaf, so repeated rows give one result in any order);
    every ``fanout`` consecutive ones become their digest until one is left, the subroot.
    Subroots, ordered by ``by`` (null first, bytewise), become the root in the same way.
    ``path`` holds the digests left and right of the leaf and of each of its ancestors;
    ``folded(leaf, path)`` gives the root and ``siblings(path)`` a digest of the proof.

    Null fields are encoded apart from empty ones; a null ``by`` is a group like any other.
    Texts are hashed where they are read; only ids and digests are moved. A group with a
    third of all rows is spread by range partitions and then by runs. An empty table gives
    an empty result. Columns of ``docs`` outside ``fields`` and ``extra`` are ignored, so
    names like ``path`` may clash.
    """
    rows = docs.select(
        F.struct(F.col(by).alias("by")).alias("grp"),
        F.struct(F.col(order).alias("order"), *[c.alias(f"x{i}") for i, c in enumerate(extra)]).alias("row"),
        leaf(*[F.col(f) for f in fields]).alias("node"),
    )
    rows = materialize(rows, "leaves")
    placed = dense_index(rows, ["grp"], [F.col("row.order").asc_nulls_first(), F.col("node")], "at", total="n")
    tree = grow(materialize(placed, "placed"), fanout)
    subroots = materialize(tree.tops, "subroots")
    ordered = dense_index(subroots, [], [F.col("grp.by").asc_nulls_first()], "at", total="n")
    whole = F.struct(F.lit(0).alias("by"))
    ordered = ordered.select(whole.alias("grp"), "at", "n", "node", F.struct(F.col("grp").alias("own")).alias("row"))
    top = grow(materialize(ordered, "ordered"), fanout)
    root = top.tops.select("grp", F.col("node").alias("root"), F.array().cast(PATH).alias("path"))
    tops = proofs(top, root).select(F.col("row.own").alias("grp"), F.col("node").alias("subroot"), "root", "path")
    found = proofs(tree, materialize(tops, "tops"))
    names = [f.name for f in docs.select(*extra).schema] if extra else []
    return found.select(
        F.col("grp.by").alias(by), F.col("row.order").alias(order), *[F.col(f"row.x{i}").alias(n) for i, n in enumerate(names)],
        F.col("node").alias("leaf"), "subroot", "root", "path",
    )

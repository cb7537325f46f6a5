"""Token counts: an exact length histogram answers every context limit."""

from __future__ import annotations

import base64
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridpanel.session import materialize

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the pre-tokenisation pattern of the byte-level vocabulary
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BLOCK = 1024  # lengths per block of the two-level suffix sums


def load_vocabulary(path: str = VOCABULARY) -> dict[bytes, int]:
    """Ranks of a byte-level vocabulary file (one base64 token and its rank per line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


_ENCODERS: dict[tuple[str, str], object] = {}


def _encoder(name: str, ranks: dict[bytes, int], pattern: str):
    import tiktoken

    key = (name, pattern)
    if key not in _ENCODERS:  # once per Python worker
        _ENCODERS[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


def lengths(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(n_tokens): encoded length of every text; null and empty texts have 0 tokens.

    The vocabulary file is read by the driver (its size is that of the vocabulary,
    whatever the corpus) and broadcast; executors need no copy of it.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))

    def run(batches):
        encoder = _encoder(vocabulary, ranks.value, pattern)
        for batch in batches:
            found = [len(encoder.encode_ordinary(t)) if t else 0 for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(found, np.int64))], ["n_tokens"])

    return docs.select("text").mapInArrow(run, "n_tokens bigint")


def histogram(counted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n_tokens, docs): documents of each encoded length, combined before the shuffle."""
    return counted.groupBy(*by, "n_tokens").agg(F.count(F.lit(1)).alias("docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """One row per occurring length L: what a context limit of L means for the corpus.

    ``docs`` of that length; ``docs_at_least`` and ``tokens_at_least`` (suffix sums over
    lengths >= L); ``docs_total`` and ``tokens_total``; ``truncated_tokens`` (sum of
    min(length, L)); ``lost_tokens`` (the rest); ``share_within`` (part of the documents
    that fit). Limits between two lengths: see ``truncated``. Sums are taken inside
    blocks of lengths and over blocks, so no task sees all lengths.
    """
    block = F.floor(F.col("n_tokens") / F.lit(_BLOCK))
    rows = materialize(hist.where("n_tokens is not null").withColumn("block", block), "histogram")
    blocks = rows.groupBy("block").agg(F.sum("docs").alias("d"), F.sum(F.col("docs") * F.col("n_tokens")).alias("t"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # one row per 1024 lengths
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    beyond = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_later"),
        F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_later"),
        F.sum("d").over(everything).alias("docs_total"),
        F.sum("t").over(everything).alias("tokens_total"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    summed = rows.join(beyond, "block").select(
        "n_tokens",
        "docs",
        (F.sum("docs").over(inside) + F.col("d_later")).alias("docs_at_least"),
        (F.sum(F.col("docs") * F.col("n_tokens")).over(inside) + F.col("t_later")).alias("tokens_at_least"),
        "docs_total",
        "tokens_total",
    )
    lost = F.col("tokens_at_least") - F.col("n_tokens") * F.col("docs_at_least")
    return summed.withColumn("lost_tokens", lost).withColumns(
        {
            "truncated_tokens": F.col("tokens_total") - lost,
            "share_within": (F.col("docs_total") - F.col("docs_at_least") + F.col("docs")) / F.col("docs_total"),
        }
    )


def quantiles(sums: DataFrame, probs: Sequence[float]) -> DataFrame:
    """(q, n_tokens): the smallest length that at least a share q of the documents doesn't exceed."""
    wanted = sums.sparkSession.createDataFrame([(float(p),) for p in probs], "q double")
    return (
        sums.join(F.broadcast(wanted), F.col("share_within") >= F.col("q"))  # as many rows as probs
        .groupBy("q")
        .agg(F.min("n_tokens").alias("n_tokens"))
    )


def truncated(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """(context, kept_tokens, cut_docs): totals if every document is cut at ``context`` tokens.

    The shortest length above a limit has the suffix sums of everything that is cut.
    """
    wanted = sums.sparkSession.createDataFrame([(int(x),) for x in limits], "context bigint")
    above = F.struct("n_tokens", "docs_at_least", "tokens_at_least")
    first = (
        sums.join(F.broadcast(wanted), F.col("n_tokens") > F.col("context"))  # as many rows as limits
        .groupBy("context")
        .agg(F.min(above).alias("cut"))
    )
    total = sums.agg(F.coalesce(F.max("tokens_total"), F.lit(0)).alias("total"))
    cut = F.coalesce(F.col("cut.docs_at_least"), F.lit(0))
    kept = F.col("total") - F.coalesce(F.col("cut.tokens_at_least"), F.lit(0)) + cut * F.col("context")
    joined = wanted.join(first, "context", "left").join(F.broadcast(total))  # one row
    return joined.select("context", kept.alias("kept_tokens"), cut.alias("cut_docs"))


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``suffix_sums`` of all texts of ``docs``; an empty table gives no rows."""
    return suffix_sums(histogram(lengths(docs, vocabulary)))

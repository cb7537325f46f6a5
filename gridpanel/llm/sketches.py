"""Document fingerprints: threshold-scaled sketches, from DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpanel.llm.common import dense_index

WORDS = 5
SCALE = 8  # one shingle hash in SCALE is retained


def _bound(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once per row, however often it is used."""
    return F.transform(F.array(value), then)[0]


def _shingle_hashes(tokens: Column, words: int) -> Column:
    """63-bit hashes of all runs of ``words`` tokens; of all tokens where there are fewer."""
    count = F.greatest(F.size(tokens) - F.lit(words - 1), F.least(F.size(tokens), F.lit(1)))

    def one(i: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(*[F.get(tokens, i + j) for j in range(words)]), 1)

    empty = F.array().cast("array<bigint>")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), one)).otherwise(empty)


def sketch(text: Column, words: int = WORDS, scale: int = SCALE) -> Column:
    """Sorted distinct shingle hashes below 1/``scale`` of their range, or else the smallest.

    The bound doesn't depend on the document, so the sketch of a collection is the union
    of its sketches (see ``merge``) and a short text is estimated inside a long one. Words
    are lower-cased and cut at ASCII white space; a text without words has an empty sketch.
    """
    limit = (1 << 63) // scale

    def retained(hashes: Column) -> Column:
        low = F.filter(hashes, lambda h: h < F.lit(limit))
        least = F.filter(F.array(F.array_min(hashes)), lambda h: h.isNotNull())
        return _bound(low, lambda x: F.when(F.size(x) > 0, F.array_sort(F.array_distinct(x))).otherwise(least))

    tokens = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t\n\x0B\f\r]+"), "")
    return _bound(tokens, lambda t: _bound(_shingle_hashes(t, words), retained))


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Sketch of both texts' shingles together."""
    both = F.array_sort(F.array_union(a, b))
    low = F.filter(both, lambda h: h < F.lit((1 << 63) // scale))
    return F.when(F.size(low) > 0, low).otherwise(F.slice(both, 1, 1))


def containment(part: Column, whole: Column) -> Column:
    """Estimated share of ``part``'s shingles that ``whole`` holds; an empty one is in any."""
    return F.when(F.size(part) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(part, whole)) / F.size(part))


def likeness(a: Column, b: Column) -> Column:
    """Containment of the smaller sketch in the larger: 0 to 1, 1 for equal texts.

    A text without words is like another such text and unlike any other.
    """
    least = F.least(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b)) / least
    return F.when(least > 0, shared).otherwise(F.when(F.size(a) == F.size(b), F.lit(1.0)).otherwise(F.lit(0.0)))


def encoded(hashes: Column) -> Column:
    """A sketch as text: its hashes in hexadecimal, comma-separated."""
    return F.array_join(F.transform(hashes, lambda h: F.lower(F.hex(h))), ",")


def sketches(docs: DataFrame, words: int = WORDS, scale: int = SCALE) -> DataFrame:
    """All columns of ``docs`` with ``sketch``, an array of longs; null texts count as empty."""
    return docs.withColumn("sketch", sketch(F.col("text"), words, scale))


def _followers(docs: DataFrame) -> DataFrame:
    """(id, follows, half): each distinct doc_id, the one before it and half of that one's length.

    Ascending, null first; the first follows the last. Only ids and lengths are ordered,
    by range partitions. Of repeated ids the longest text counts.
    """
    sizes = docs.groupBy("doc_id").agg(F.max(F.char_length(F.coalesce("text", F.lit("")))).alias("n"))
    placed = dense_index(sizes, [], [F.col("doc_id").asc_nulls_first()], "at")
    total = placed.count()
    before = placed.select(
        F.col("doc_id").alias("follows"), F.shiftright("n", 1).alias("half"), F.pmod(F.col("at") + 1, F.lit(max(total, 1))).alias("next")
    )
    return before.join(placed, F.col("next") == F.col("at")).select(F.col("doc_id").alias("id"), "follows", "half")


def edited_pairs(docs: DataFrame, words: int = WORDS, scale: int = SCALE) -> DataFrame:
    """(doc_id, text, sketch, edited, edited_sketch, next_sketch) of every row of ``docs``.

    ``edited``: the last floor(n/2) characters replaced by the first as many (or all) of
    the next document by ascending doc_id (after the last: the first; null ids come
    first). A doc_id with several rows is followed by the next other doc_id; where that
    one has several rows, by its smallest text. Texts move once by their own id and half
    of each once by the id before; a hot doc_id doesn't exist unless rows are repeated.
    Null texts count as empty; an empty table gives an empty result; other columns are
    ignored.
    """
    text = F.coalesce("text", F.lit("")).alias("text")
    key = F.struct("doc_id")  # never null itself, so joins match null ids, too
    base = docs.select(key.alias("key"), text, sketch(F.col("text"), words, scale).alias("sketch"))
    links = _followers(docs).select(F.struct(F.col("id").alias("doc_id")).alias("key"), "follows", "half")
    # dealt by key already: one row per id without another exchange
    first = base.join(links, "key").groupBy("key", "follows", "half").agg(F.min(F.struct("text", "sketch")).alias("x"))
    nexts = first.select(
        F.struct(F.col("follows").alias("doc_id")).alias("key"), F.expr("left(x.text, half)").alias("head"), F.col("x.sketch").alias("next_sketch")
    )
    joined = base.join(nexts, "key").withColumn("doc_id", F.col("key.doc_id"))
    half = F.shiftright(F.char_length("text"), 1)
    edited = F.concat(F.left("text", F.char_length("text") - half), F.left("head", half))
    return joined.select("doc_id", "text", "sketch", edited.alias("edited"), "next_sketch").withColumn(
        "edited_sketch", sketch(F.col("edited"), words, scale)
    )

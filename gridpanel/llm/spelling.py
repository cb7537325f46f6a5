"""Spelling variant grouping: asymmetric q-chunks join words one edit apart."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpanel.session import materialize

MIN_LENGTH = 5
MIN_COUNT = 3
RATIO = 2  # a form occurs at least so many times as often as the word
TYPO_EVERY = 97
_LETTERS = "a-zÀ-ÿ"  # after lower-casing A-Z
_PIECE = 1 << 20  # code points looked at together
_HELD = 200_000  # distinct words a task holds before it passes them on


def _pieces(text: str) -> Iterator[str]:
    """``text`` in parts of about ``_PIECE`` code points, never cut inside a run of letters."""
    other, start = re.compile(f"[^{_LETTERS}]"), 0
    while len(text) - start > _PIECE:
        gap = other.search(text, start + _PIECE)
        stop = gap.start() if gap else len(text)
        yield text[start:stop]
        start = stop
    yield text[start:]


def document_words(text: str, key: str, typo_every: int | None, shortest: int) -> Counter:
    """Occurrences of the words of one text; see ``word_counts``."""
    runs, found = re.compile(f"[{_LETTERS}]{{{shortest},}}"), Counter()
    for piece in _pieces(text):
        found.update(runs.findall(piece))
    if not typo_every:
        return found
    base = zlib.crc32(f"{key}:".encode())
    out = Counter()
    for run, n in found.items():
        h = zlib.crc32(run.encode(), base)
        if h % typo_every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= shortest:
            out[run] += n
    return out


def word_counts(
    docs: DataFrame, typo_every: int | None = TYPO_EVERY, shortest: int = MIN_LENGTH, least: int = MIN_COUNT
) -> DataFrame:
    """(word, n): words of at least ``shortest`` letters that occur ``least`` times in ``docs``.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased. With
    ``typo_every`` a run whose crc32 (with its doc_id, ``id:run``; a null id is empty) is
    divisible by it loses the letter at crc32 modulo its length, so that a corpus has known
    misspellings. Every run of every text is counted; a task adds up its documents' words
    and passes them on whenever it holds ``_HELD``, so a word of a third of all rows is a
    few rows per task. Null texts have no words.
    """

    def run(batches):
        held: Counter = Counter()

        def full():
            words = list(held)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([held[w] for w in words], pa.int64())], ["word", "n"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                raw = text.as_py()
                if raw:  # bytes.lower() changes A-Z only
                    held.update(document_words(raw.lower().decode(), key, typo_every, shortest))
                if len(held) > _HELD:
                    yield full()
                    held.clear()
        yield full()

    keyed = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")
    return keyed.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _letters_of(word: Column) -> Column:
    """A word's letters as bits (several letters may share one): one edit changes at most two."""
    codes = F.transform(F.split(word, ""), lambda x: F.pmod(F.ascii(x), F.lit(64)))
    return F.aggregate(codes, F.lit(0).cast("bigint"), lambda bits, x: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), x)))


def _chunks(words: DataFrame) -> DataFrame:
    """The two disjoint chunks of each word: its first half and the rest."""
    size, half = F.char_length("word"), F.shiftright(F.char_length("word"), 1)
    both = F.array(
        F.struct(F.lit(1).alias("part"), F.left("word", half).alias("gram")),
        F.struct(F.lit(2).alias("part"), F.right("word", size - half).alias("gram")),
    )
    return words.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("bits").alias("a_bits"), size.alias("size"), F.inline(both))


def _grams(words: DataFrame) -> DataFrame:
    """The positional grams of each word that a chunk of a word as long, or one shorter, can equal.

    An edit leaves what stands before it in place and moves what follows by the
    difference in length. So a first chunk is looked for at shift 0 and a second one at
    shift 0 (as long) or 1 (one shorter); grams at other places can't match.
    """
    at = []
    for shift in (0, 1):
        size = F.char_length("word") - shift
        half = F.shiftright(size, 1)
        at += [
            F.struct(size.alias("size"), F.lit(1).alias("part"), F.left("word", half).alias("gram")),
            F.struct(size.alias("size"), F.lit(2).alias("part"), F.right("word", size - half).alias("gram")),
        ]
    return words.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("bits").alias("b_bits"), F.inline(F.array(*at)))


def near_words(words: DataFrame) -> DataFrame:
    """(a, b, a_n, b_n): all pairs of distinct ``words`` (word, n) that differ by one edit, once each.

    One inserted, deleted or replaced code point leaves one of the shorter word's two
    chunks whole (of the smaller one's, if equally long), and the longer word has it as a
    gram within shift one. Chunks meet grams in one join on (length, part, gram), whose
    large keys AQE splits; a pair that shares both chunks counts with the first. Pairs whose
    sets of letters differ by more than an edit can change are dropped unread, the others
    verified.
    """
    words = materialize(words.withColumn("bits", _letters_of(F.col("word"))), "lettered")
    half = F.shiftright(F.char_length("a"), 1)
    first = F.left("a", half) == F.left("b", half)
    once = (F.col("part") == 1) | ~first
    longer = (F.char_length("b") > F.col("size")) | (F.col("a") < F.col("b"))
    like = F.bit_count(F.col("a_bits").bitwiseXOR(F.col("b_bits"))) <= 2
    met = _chunks(words).join(_grams(words), ["size", "part", "gram"]).where(like & longer & once)
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "b", "a_n", "b_n")


def forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, form, form_n, n_near) of every row of ``words`` (word, n).

    ``form``: the near word of largest n (ties: the smallest in code-point order) if that n
    is at least ``ratio`` times the word's, else null. A word has at most a few hundred
    near words per letter, so no group is hot.
    """
    pairs = near_words(words)
    kind = "word string, n bigint, near string, near_n bigint"
    names = [c.split()[0] for c in kind.split(", ")]
    sides = F.array(
        F.struct(*[F.col(c).alias(n) for c, n in zip(("a", "a_n", "b", "b_n"), names, strict=True)]),
        F.struct(*[F.col(c).alias(n) for c, n in zip(("b", "b_n", "a", "a_n"), names, strict=True)]),
    )
    none = F.lit(None)
    all_rows = pairs.select(F.inline(sides)).unionByName(
        words.select("word", "n", none.cast("string").alias("near"), none.cast("bigint").alias("near_n"))
    )
    best: Column = F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w")))
    found = all_rows.groupBy("word", "n").agg(F.count("near").alias("n_near"), F.min(best).alias("best"))
    enough = -F.col("best.m") >= F.col("n") * ratio
    return found.select(
        "word", "n", F.when(enough, F.col("best.w")).alias("form"), F.when(enough, -F.col("best.m")).alias("form_n"), "n_near"
    )


def roots(found: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: the last word that their forms lead to.

    n grows by the ratio with every step, so there are no circles and a chain has at most
    log(n) words; each round doubles the steps taken.
    """
    links = materialize(found.where("form is not null").select("word", F.col("form").alias("root")), "links")
    while True:
        on = links.select(F.col("word").alias("at"), F.col("root").alias("next"))
        moved = links.join(on, F.col("root") == F.col("at"), "left")
        moved = materialize(moved.select("word", F.coalesce("next", "root").alias("root"), F.col("at").isNotNull().alias("moved")), "links")
        links = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return links


def variants(docs: DataFrame, typo_every: int | None = TYPO_EVERY, shortest: int = MIN_LENGTH, least: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n): the words of ``docs`` grouped by spelling.

    ``root`` follows forms to the last word, the word itself if it has none. Repeated rows
    count as often as they occur; null ids and texts, empty texts and an empty table are
    allowed; other columns are ignored. ``shortest`` must be at least 2.
    """
    words = materialize(word_counts(docs, typo_every, shortest, least), "words")
    found = materialize(forms(words, ratio), "forms")
    ends = roots(found).select(F.col("word").alias("own"), "root")
    joined = found.join(ends, F.col("word") == F.col("own"), "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

"""Toxicity: a factorization machine over hashed terms of short windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridpanel.llm.common import runs, utf8
from gridpanel.llm.labels import fold, prior_shift, sample
from gridpanel.llm.words import ALPHA, LOWER, prefix_sums, span_hash, words

FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
PER_CLASS = 1500  # labelled documents learnt from, of each label
MAX_BYTES = 8_000  # longer documents aren't learnt from
RANK = 4
STEMS = (4, 5, 6)  # a word's first bytes are terms, too: inflected forms share them
PIECE = 32  # words; a window is two neighbouring pieces
LEAST_DOCS = 4  # a term is learnt if it occurs in so many sampled documents
_SLICE_BYTES = 1 << 20
_SHRINK = 1e-3  # gradient that a term needs to move away from zero

Params = dict[str, np.ndarray]


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(term hash, piece, first piece of each row, row of each term).

    Words (letters, A-Z lower-cased) and their stems are hashed to 64 bits; pieces are
    runs of ``PIECE`` words of one row. A row has at least one piece.
    """
    data = LOWER[data]
    row, starts, ends = words(data, offsets, ALPHA)
    sums, powers = prefix_sums(data)
    position = np.arange(len(row)) - np.searchsorted(row, row)
    per_row = np.bincount(row, minlength=len(offsets) - 1)
    first = np.concatenate([[0], np.cumsum(np.maximum(1, -(-per_row // PIECE)))])
    piece = first[row] + position // PIECE
    hashes, pieces, rows = [span_hash(sums, powers, starts, ends)], [piece], [row]
    for size in STEMS:
        longer = ends - starts > size
        hashes.append(span_hash(sums, powers, starts[longer], starts[longer] + size) ^ np.uint64(size))
        pieces.append(piece[longer])
        rows.append(row[longer])
    return np.concatenate(hashes), np.concatenate(pieces), first, np.concatenate(rows)


def _known(vocabulary: np.ndarray, table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Index of each hash in ``vocabulary`` or -1; ``table`` finds nearly all others at once."""
    bits = np.uint64(len(table) - 1)
    out = np.full(len(hashes), -1)
    maybe = np.flatnonzero(table[(hashes & bits).astype(np.int64)])
    at = np.minimum(np.searchsorted(vocabulary, hashes[maybe]), len(vocabulary) - 1)
    hit = vocabulary[at] == hashes[maybe]
    out[maybe[hit]] = at[hit]
    return out


def _table(vocabulary: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << 22, bool)
    table[(vocabulary & np.uint64(len(table) - 1)).astype(np.int64)] = True
    return table


def _window_logits(weights: np.ndarray, factors: np.ndarray, bias: float, term: np.ndarray, piece: np.ndarray, first: np.ndarray):
    """Logit of the window that starts at each piece (the last one of a row stands alone)."""
    size = int(first[-1])
    linear = np.bincount(piece, weights[term], size)
    sums = np.stack([np.bincount(piece, factors[term, f], size) for f in range(factors.shape[1])], 1)
    own = np.bincount(piece, (factors**2).sum(1)[term], size)
    joined = np.ones(size, bool)
    joined[first[1:] - 1] = False  # a row's last piece has no neighbour
    pair = np.where(joined, np.append(np.arange(1, size), 0), 0)
    both = lambda x: x + (x[pair].T * joined).T
    v = both(sums)
    return bias + both(linear) + 0.5 * ((v**2).sum(1) - both(own)), v, joined


def _best(logits: np.ndarray, first: np.ndarray) -> np.ndarray:
    """First window with the highest logit of each row."""
    top = np.maximum.reduceat(logits, first[:-1])
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(logits == top[row])
    return at[np.searchsorted(row[at], np.arange(len(first) - 1))]


def _once(term: np.ndarray, piece: np.ndarray, row: np.ndarray | None = None):
    """Each term of a piece once: a page of one repeated word says no more than the word."""
    if not len(term):
        return (term, piece) if row is None else (term, piece, row)
    code = piece * (int(term.max()) + 1) + term
    _, at = np.unique(code, return_index=True)
    return (term[at], piece[at]) if row is None else (term[at], piece[at], row[at])


def _shrunk(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Towards zero by ``by``, along each row if ``x`` has two dimensions."""
    size = np.abs(x) if x.ndim == 1 else np.sqrt((x**2).sum(1))
    factor = np.maximum(size - by, 0) / np.maximum(size, 1e-12)
    return x * (factor if x.ndim == 1 else factor[:, None])


def train(texts: list[bytes], y: np.ndarray, share: float, epochs: int = 40, rate: float = 0.3) -> Params:
    """Linear weights and factors of the log loss; a document is as toxic as its worst window.

    Weights start from the log odds of clearly one-sided terms. Each epoch takes every
    sampled document's highest window and moves its terms, each in proportion to how
    often it occurs; a term that only few documents speak for shrinks to nothing. Terms in
    fewer than ``LEAST_DOCS`` sampled documents aren't learnt.
    """
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    hashes, piece, first, row = terms(np.frombuffer(b"".join(texts), np.uint8), offsets)
    unique, term = np.unique(hashes, return_inverse=True)
    term, piece, row = _once(term, piece, row)
    pairs = np.unique(term * max(len(texts), 1) + row)
    of_term, of_row = np.divmod(pairs, max(len(texts), 1))
    docs = np.bincount(of_term, minlength=len(unique))
    kept = docs >= LEAST_DOCS
    vocabulary, docs = unique[kept], docs[kept].astype(float)
    rng = np.random.default_rng(5)
    weights, factors, bias = np.zeros(len(vocabulary)), rng.normal(0, 0.02, (len(vocabulary), RANK)), -2.0
    if len(np.unique(y)) == 2 and len(vocabulary):
        toxic = np.bincount(of_term, y[of_row], len(unique))[kept]
        clean = docs - toxic
        odds = np.log((toxic + 1) / (y.sum() + 1)) - np.log((clean + 1) / (len(y) - y.sum() + 1))
        weights = np.where(np.abs(toxic - docs * y.mean()) > 3.5 * np.sqrt(docs) / 2, np.clip(odds, -2, 4), 0.0)
        place = np.cumsum(kept) - 1
        known = kept[term]
        term, piece = place[term[known]], piece[known]
        pace = rate / np.maximum(0.25 * docs / len(texts), 2e-3)
        for _ in range(epochs):
            logits, v, joined = _window_logits(weights, factors, bias, term, piece, first)
            best = _best(logits, first)
            dz = (1 / (1 + np.exp(-logits[best])) - y) / len(y)
            slope, seen = np.zeros(int(first[-1])), np.zeros((int(first[-1]), RANK))
            slope[best], seen[best] = dz, v[best]
            tail = best[joined[best]]  # the second piece of a window of two
            slope[tail + 1], seen[tail + 1] = slope[tail], seen[tail]
            moving = slope[piece] != 0
            t, p = term[moving], piece[moving]
            down = np.bincount(t, slope[p], len(weights))
            aside = np.stack([np.bincount(t, slope[p] * (seen[p, f] - factors[t, f]), len(weights)) for f in range(RANK)], 1)
            weights = _shrunk(weights - np.clip(pace * down, -0.5, 0.5), pace * _SHRINK)
            factors = _shrunk(factors - 0.2 * np.clip(pace[:, None] * aside, -0.5, 0.5), 0.2 * pace * _SHRINK)
            bias -= rate * 4 * float(dz.sum())
    strong = np.abs(weights) + np.abs(factors).sum(1) > 0.02
    return {
        "vocabulary": vocabulary[strong], "weights": weights[strong].astype(np.float32),
        "factors": factors[strong].astype(np.float32), "bias": np.float64(bias + prior_shift(y, share)),
    }


def probability(params: Params, table: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability of label 1 of every row: that of its worst window, over the whole text."""
    out = np.empty(len(offsets) - 1)
    for lo, hi in runs(offsets, _SLICE_BYTES):
        hashes, piece, first, _ = terms(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        if len(params["vocabulary"]):
            at = _known(params["vocabulary"], table, hashes)
            term, piece = _once(at[at >= 0], piece[at >= 0])
        else:
            term, piece = np.zeros(0, np.int64), np.zeros(0, np.int64)
        logits, _, _ = _window_logits(params["weights"], params["factors"], float(params["bias"]), term, piece, first)
        out[lo:hi] = 1 / (1 + np.exp(-np.maximum.reduceat(logits, first[:-1])))
    return out


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES) -> Params:
    """Parameters learnt from a bounded sample of the labelled rows outside the held-out fold."""
    return train(*sample(docs, labels, "toxic", lambda: fold(FOLDS) != HELD_OUT, per_class, max_bytes))


def score(docs: DataFrame, params: Params, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` with score (probability of label 1) and predicted.

    The whole text is scored, window by window. Null, empty and wordless texts have only
    the bias. Repeated rows get equal scores; an empty table gives an empty result; columns
    of ``docs`` named score or predicted are replaced.
    """
    own = [c for c in docs.columns if c not in ("score", "predicted")]
    place = own.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(params)  # terms of the bounded sample

    def run(batches: Iterator[pa.RecordBatch]):
        table = _table(shared.value["vocabulary"])
        for batch in batches:
            found = probability(shared.value, table, *utf8(batch.column(place)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*own, "score"])

    kept = docs.select(*own)
    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType())])
    return kept.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``score`` with parameters fitted on ``labels`` (doc_id, toxic)."""
    return score(docs, fit(docs, labels), threshold)

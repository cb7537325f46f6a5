"""Quality classifier: a byte-level convolutional network over overlapping chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridpanel.llm.common import runs, utf8
from gridpanel.llm.labels import fold, prior_shift, sample

FOLDS = 5
THRESHOLD = 0.3
PER_CLASS = 900  # labelled documents learnt from, of each label
MAX_BYTES = 12_000  # longer documents aren't learnt from
CHUNK, STRIDE = 512, 448  # bytes; neighbours overlap
STEP, WIDE = 4, 8  # a filter looks at 8 bytes, every 4 bytes
EMBED, FILTERS, HIDDEN = 8, 32, 16
_SLICE_BYTES = 1 << 20  # scored at once

Params = dict[str, np.ndarray]


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chunk bytes, first chunk of each row): chunks cover every byte; short ones end in zeros."""
    sizes = np.diff(offsets)
    count = np.maximum(1, -(-(sizes - (CHUNK - STRIDE)) // STRIDE))
    first = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(sizes)), count)
    start = offsets[row] + (np.arange(first[-1]) - first[row]) * STRIDE
    at = start[:, None] + np.arange(CHUNK)
    inside = at < offsets[row + 1][:, None]
    padded = np.append(data, np.uint8(0))
    return np.where(inside, padded[np.minimum(at, len(data))], np.uint8(0)), first


def _pooled(params: Params, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest response of every filter in each chunk, and where it was."""
    pieces = params["embed"][block].reshape(len(block), CHUNK // STEP, STEP * EMBED)
    half = STEP * EMBED
    response = pieces[:, :-1] @ params["filters"][:half] + pieces[:, 1:] @ params["filters"][half:]
    where = response.argmax(axis=1)
    best = np.take_along_axis(response, where[:, None, :], axis=1)[:, 0]
    return np.maximum(best + params["filter_bias"], 0), where


def _logits(params: Params, block: np.ndarray, first: np.ndarray):
    pooled, where = _pooled(params, block)
    hidden = np.tanh(pooled @ params["dense"] + params["dense_bias"])
    each = hidden @ params["out"] + params["out_bias"]
    mean = np.add.reduceat(each, first[:-1]) / np.diff(first)
    low = np.minimum.reduceat(each, first[:-1])
    return params["join"][0] * mean + params["join"][1] * low, (pooled, where, hidden, each, mean, low)


def _gradients(params: Params, block: np.ndarray, first: np.ndarray, y: np.ndarray) -> tuple[float, Params]:
    z, (pooled, where, hidden, each, mean, low) = _logits(params, block, first)
    p = 1 / (1 + np.exp(-z))
    loss = float(np.mean(np.logaddexp(0, np.where(y > 0, -z, z))))
    dz = (p - y) / len(y)
    count = np.diff(first)
    row = np.repeat(np.arange(len(y)), count)
    lowest = each == low[row]
    ties = np.add.reduceat(lowest.astype(np.float32), first[:-1])
    deach = dz[row] * (params["join"][0] / count[row] + params["join"][1] * lowest / ties[row])
    dhidden = np.outer(deach, params["out"]) * (1 - hidden**2)
    dpooled = (dhidden @ params["dense"].T) * (pooled > 0)
    at = (where * STEP)[:, :, None] + np.arange(WIDE)  # bytes under each filter's best place
    seen = np.take_along_axis(block[:, None, :], at, axis=2)
    windows = params["embed"][seen].reshape(len(block), FILTERS, WIDE * EMBED)
    dfilters = np.einsum("cfw,cf->wf", windows, dpooled)
    back = dpooled[:, :, None] * params["filters"].T[None]
    dembed = np.zeros_like(params["embed"])
    flat, grad = seen.reshape(-1), back.reshape(-1, EMBED)
    for e in range(EMBED):
        dembed[:, e] = np.bincount(flat, grad[:, e], 256)
    return loss, {
        "embed": dembed, "filters": dfilters, "filter_bias": dpooled.sum(0), "dense": pooled.T @ dhidden,
        "dense_bias": dhidden.sum(0), "out": hidden.T @ deach, "out_bias": np.array(deach.sum()),
        "join": np.array([dz @ mean, dz @ low]),
    }


def train(texts: list[bytes], y: np.ndarray, share: float, epochs: int = 8, batch: int = 48, rate: float = 4e-3) -> Params:
    """Filters and weights by Adam on the log loss; without both labels, the prior alone."""
    rng = np.random.default_rng(11)

    def normal(*shape: int, scale: float) -> np.ndarray:
        return rng.normal(0, scale, shape).astype(np.float32)

    params: Params = {
        "embed": normal(256, EMBED, scale=0.5), "filters": normal(WIDE * EMBED, FILTERS, scale=0.15),
        "filter_bias": np.zeros(FILTERS, np.float32), "dense": normal(FILTERS, HIDDEN, scale=0.2),
        "dense_bias": np.zeros(HIDDEN, np.float32), "out": normal(HIDDEN, scale=0.3),
        "out_bias": np.zeros((), np.float32), "join": np.array([0.5, 0.5], np.float32), "shift": np.zeros((), np.float32),
    }
    if len(np.unique(y)) == 2:
        moment = {k: np.zeros_like(v) for k, v in params.items()}
        square = {k: np.zeros_like(v) for k, v in params.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), batch):
                chosen = order[at : at + batch]
                offsets = np.concatenate([[0], np.cumsum([len(texts[i]) for i in chosen])])
                block, first = chunks(np.frombuffer(b"".join(texts[i] for i in chosen), np.uint8), offsets)
                _, grads = _gradients(params, block, first, y[chosen])
                step += 1
                pace = rate * (1 - epoch / epochs)
                for k, g in grads.items():
                    moment[k] = 0.9 * moment[k] + 0.1 * g
                    square[k] = 0.99 * square[k] + 0.01 * g * g
                    update = moment[k] / (1 - 0.9**step) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-7)
                    params[k] = (params[k] - pace * update).astype(np.float32)
    params["shift"] = np.float32(prior_shift(y, share))
    return params


def probability(params: Params, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability of label 1 of every row data[offsets[i]:offsets[i + 1]], all bytes seen."""
    out = np.empty(len(offsets) - 1)
    for lo, hi in runs(offsets, _SLICE_BYTES):
        if offsets[hi] - offsets[lo] > 4 * _SLICE_BYTES:  # one very long text, chunk by chunk
            z = _long(params, data[offsets[lo] : offsets[hi]])
        else:
            z, _ = _logits(params, *chunks(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
        out[lo:hi] = 1 / (1 + np.exp(-(z + params["shift"]).astype(np.float64)))
    return out


def _long(params: Params, text: np.ndarray) -> np.ndarray:
    total, low, count = 0.0, np.inf, 0
    span = STRIDE * (_SLICE_BYTES // STRIDE)
    for at in range(0, max(len(text) - (CHUNK - STRIDE), 1), span):
        piece = text[at : at + span + CHUNK - STRIDE]
        _, (_, _, _, each, _, _) = _logits(params, *chunks(piece, np.array([0, len(piece)])))
        total, low, count = total + float(each.sum()), min(low, float(each.min())), count + len(each)
    return np.array([params["join"][0] * total / count + params["join"][1] * low])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES) -> Params:
    """Parameters learnt from a bounded sample of the labelled rows outside the held-out fold.

    The sample (at most 2 x ``per_class`` texts of ``max_bytes``) and the few thousand
    parameters are all that the driver holds.
    """
    return train(*sample(docs, labels, "quality", lambda: fold(FOLDS) != 0, per_class, max_bytes))


def score(docs: DataFrame, params: Params, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` with score (probability of label 1) and predicted.

    Every byte of every text is seen. Null and empty texts are one chunk of zeros. Repeated
    rows get equal scores; an empty table gives an empty result; columns of ``docs`` named
    score or predicted are replaced.
    """
    own = [c for c in docs.columns if c not in ("score", "predicted")]
    place = own.index("text")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = probability(params, *utf8(batch.column(place)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*own, "score"])

    kept = docs.select(*own)
    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType())])
    return kept.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``score`` with parameters fitted on ``labels`` (doc_id, quality)."""
    return score(docs, fit(docs, labels), threshold)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with all their own columns."""
    hidden = {c: f"_own_{c}" for c in ("score", "predicted") if c in docs.columns}
    found = classify(docs.withColumnsRenamed(hidden), labels, threshold).where("predicted = 1")
    return found.select(*[F.col(hidden.get(c, c)).alias(c) for c in docs.columns])

"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeframe.llm.common import LOWER, body, flat, slices, small_batches, word_bounds, word_hashes

BITS = 18
FACTORS = 4
TRAIN_ROWS = 16384
# Bytes that do not belong to a term: everything but ASCII letters and the bytes of other scripts.
BETWEEN = np.ones(256, bool)
BETWEEN[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


class Model(NamedTuple):
    """Bias, a weight and a factor row per hashed term; all zero for a term not seen often enough."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed terms of every text in a row, and the n + 1 offsets."""
    data = LOWER[data]
    starts, ends, row = word_bounds(data, offsets, BETWEEN)
    bucket = (word_hashes(data, starts, ends) >> np.uint64(64 - BITS)).astype(np.int64)
    key = np.unique(row.astype(np.int64) << BITS | bucket)
    return key & ((1 << BITS) - 1), np.searchsorted(key, np.arange(len(offsets), dtype=np.int64) << BITS)


def _row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def logits(model: Model, index: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """bias + sum of the weights + sum over all pairs of the product of their factors."""
    rows = model.factors[index]
    summed = _row_sums(rows, offsets)
    pairs = 0.5 * ((summed**2).sum(1) - _row_sums((rows.astype(np.float64) ** 2).sum(1), offsets))
    return model.bias + _row_sums(model.weights[index], offsets) + pairs


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _lead(led: np.ndarray, past: np.ndarray, value: np.ndarray, used: np.ndarray, g: np.ndarray, rate: float, penalty: float) -> None:
    """A step of the regularized leader for the ``used`` entries, in place; they are zero up to the ``penalty``."""
    grown = past[used] + g**2
    led[used] += g - (np.sqrt(grown) - np.sqrt(past[used])) / rate * value[used]
    past[used] = grown
    pull = np.sign(led[used]) * penalty - led[used]
    value[used] = np.where(np.abs(led[used]) <= penalty, 0, pull / ((1 + np.sqrt(grown)) / rate))


def fit(
    index: np.ndarray,
    offsets: np.ndarray,
    label: np.ndarray,
    epochs: int = 8,
    least: int = 8,
    sparse: float = 0.35,
    shrink: float = 1.0,
    share: float = 0.01,
    rate: float = 1.0,
    rare_rate: float = 0.1,
    seed: int = 1,
) -> Model:
    """Logistic loss over shuffled blocks of rows.

    Weights follow the regularized leader with an absolute penalty of ``sparse`` times the
    root of the rows, so that terms without clear effect stay at zero, as the gradient
    that chance adds to a term grows like that root. Factors of terms in at least a
    ``share`` of the rows start at random, take AdaGrad steps and shrink by ``shrink`` over
    that root. Those of rarer terms start at zero and follow the leader under the same
    penalty as weights, at ``rare_rate``: by AdaGrad they learn single rows by heart.
    Terms in fewer than ``least`` rows are left out. Without rows the score is 0; with one
    class it is near that class's share.
    """
    size = 1 << BITS
    rng = np.random.default_rng(seed)
    weights = np.zeros(size)
    if not len(label):
        return Model(-40.0, weights, np.zeros((size, FACTORS)))
    sparse, shrink = sparse * len(label) ** 0.5, shrink / len(label) ** 0.5
    seen = np.bincount(index, minlength=size)
    often, common = seen >= least, seen >= max(least, share * len(label))
    keep = often[index]
    offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
    index = index[keep]
    factors = np.where(common[:, None], rng.normal(0, 0.1, (size, FACTORS)), 0)
    bias = float(np.log((label.sum() + 0.5) / ((1 - label).sum() + 0.5)))
    led, past_w, past_v, past_b = np.zeros(size), np.zeros(size), np.full((size, FACTORS), 1e-2), 1e-2
    led_v, past_r = np.zeros((size, FACTORS)), np.zeros((size, FACTORS))
    for _ in range(epochs):
        order = rng.permutation(len(label))
        for block in np.array_split(order, max(1, len(label) // 256)):
            count = offsets[block + 1] - offsets[block]
            row = np.repeat(np.arange(len(block)), count)
            own = index[np.repeat(offsets[block] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))]
            bounds = np.concatenate([[0], np.cumsum(count)])
            error = sigmoid(logits(Model(bias, weights, factors), own, bounds)) - label[block]
            used, at = np.unique(own, return_inverse=True)
            g = np.bincount(at, error[row], len(used))
            _lead(led, past_w, weights, used, g, rate, sparse)
            summed = _row_sums(factors[own], bounds)
            pulls = [np.bincount(at, error[row] * (summed[row, f] - factors[own, f]), len(used)) for f in range(FACTORS)]
            g, usual = np.stack(pulls, 1), common[used]
            _lead(led_v, past_r, factors, used[~usual], g[~usual], rare_rate, sparse)
            used = used[usual]
            h = g[usual] / len(block) + shrink * factors[used]
            past_v[used] += h**2
            factors[used] -= 0.05 * h / np.sqrt(past_v[used])
            slope = float(error.mean())
            past_b += slope**2
            bias -= 0.05 * slope / past_b**0.5
    return Model(bias, weights.astype(np.float32), factors.astype(np.float32))


def held_out(id_col: str) -> Column:
    """Every fifth row by the checksum of its id, never learnt from; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        index, offsets = terms(*flat(batch.column("text")))
        raw = index.astype("<i4").tobytes()
        parts = [raw[4 * a : 4 * b] for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(parts, pa.binary())], names=["label", "terms"])


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``rows`` labelled rows outside the held-out fold, those with the lowest hash of the id.

    Only this sample, as hashed terms, reaches the driver. Rows without label are not used.
    """
    small_batches(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    marked = known.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    chosen = marked.orderBy(F.xxhash64("id"), "id", "label").limit(rows)
    texts = docs.select(F.col(id_col).alias("id"), body(text_col).cast("binary").alias("text"))
    found = texts.join(chosen, "id").select("label", "text").mapInArrow(_features, "label int, terms binary")
    sample = sorted((r.label, bytes(r.terms)) for r in found.collect())
    index = np.frombuffer(b"".join(t for _, t in sample), "<i4").astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(t) // 4 for _, t in sample])]).astype(np.int64)
    return fit(index, offsets, np.array([float(v > 0) for v, _ in sample]))


def _scorer(model: Model, spark):
    shared = spark.sparkContext.broadcast(tuple(model))  # 2^BITS weights and factors, whatever the input

    def scores(column: pa.Array) -> np.ndarray:
        return sigmoid(logits(Model(*shared.value), *terms(*flat(column))))

    return scores


def score(docs: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    """Id and ``score`` (0 to 1, higher is likelier toxic) of every row, from the text alone.

    Null counts as an empty text, whose score is that of the bias; null ids and
    repeated rows come out as they are; other columns are not read.
    """
    small_batches(docs.sparkSession)
    scores = _scorer(model, docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores(batch.column("text")))], names=[id_col, "score"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    return docs.select(F.col(id_col).alias("id"), body(text_col).cast("binary").alias("text")).mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, model: Model, text_col: str, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, as they are, whose score is below the threshold."""
    small_batches(docs.sparkSession)
    scores = _scorer(model, docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            texts = batch.column(text_col).fill_null("")
            yield batch.filter(pa.array(scores(texts) < threshold))

    return docs.mapInArrow(run, docs.schema)

"""Text quality by a factorisation machine.

Inputs: hashed words (log counts), statistics of the structure of the text, and
metadata (the stated length).  Pairs of inputs interact through low-rank
factors; sum over pairs <v_i, v_j> x_i x_j is computed in linear time as half of
(sum v_i x_i)^2 - sum (v_i x_i)^2.  Fitted by adaptive gradient steps on at most
``MAX_TRAINING_TEXTS`` labelled rows, about half of each label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm import wordhash
from factloom.llm.sampling import bounded_sample

MAX_TRAINING_TEXTS = 6_000
BITS = 11
RANK = 8
THRESHOLD = 0.3
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
STATISTICS = (
    "length", "stated_length", "length_gap", "capitals", "digits", "spaces", "lines", "symbols", "stops", "bars",
    "symbol_runs", "other_bytes", "word_length", "words_per_line", "distinct_words", "next_word_equal",
    "top_word", "no_words",
)
WIDTH = (1 << BITS) + len(STATISTICS)


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_CAPITAL = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = _class("0123456789")
_STOP = _class(".,;:?")
_BAR = _class("|<>{}[]\\")
_SYMBOL = _class("!\"#$%&'()*+-/=@^_`~") | _BAR
_HIGH = np.arange(256) >= 128


def _statistics(raw: wordhash.Texts, words: wordhash.Words, stated: np.ndarray, counts: np.ndarray) -> np.ndarray:
    data, at = raw
    size = np.diff(at).astype(float)
    n = np.maximum(size, 1)
    total = np.diff(words.first).astype(float)
    m = np.maximum(total, 1)

    def share(member: np.ndarray) -> np.ndarray:
        return wordhash.sums(member, at) / n

    symbol = _SYMBOL[data]
    run = np.zeros(len(data), bool)
    if len(data) > 1:
        run[1:] = symbol[1:] & (data[1:] == data[:-1])
    lines = wordhash.sums(data == 10, at)
    h = words.hashes
    again = np.zeros(len(h), bool)
    if len(h) > 1:
        again[1:] = h[1:] == h[:-1]
    order = np.lexsort((h, wordhash.owners(words.first)))
    fresh = np.ones(len(h), bool)
    if len(h) > 1:
        own = wordhash.owners(words.first)[order]
        fresh[1:] = (h[order][1:] != h[order][:-1]) | (own[1:] != own[:-1])
    distinct = wordhash.sums(fresh, words.first)
    columns = [
        np.log1p(size) / 10, np.log1p(np.maximum(stated, 0)) / 10, np.abs(np.log1p(size) - np.log1p(np.maximum(stated, 0))) / 5,
        share(_CAPITAL[data]), share(_DIGIT[data]), share(data == 32), lines * 20 / n, share(symbol) * 2, share(_STOP[data]) * 5,
        share(_BAR[data]) * 5, share(run) * 5, share(_HIGH[data]), np.minimum(n / m / 20, 2), np.minimum(np.log1p(m / (lines + 1)) / 5, 2),
        distinct / m, wordhash.sums(again, words.first) / m, counts.max(axis=1) / m, (total == 0).astype(float),
    ]
    return np.stack(columns, axis=1).astype(np.float32)


def inputs(text: pa.Array, stated: np.ndarray) -> np.ndarray:
    """texts x WIDTH."""
    text = text.fill_null("")
    raw = wordhash.texts_of(text)
    words = wordhash.words(wordhash.texts_of(wordhash.lowered(text)))
    n = len(text)
    bucket = (words.hashes >> np.uint64(64 - BITS)).astype(np.int64) + (wordhash.owners(words.first) << BITS)
    counts = np.bincount(bucket, minlength=n << BITS).reshape(n, 1 << BITS).astype(np.float32)
    stats = _statistics(raw, words, stated, counts)
    hashed = np.log1p(counts)
    hashed /= np.maximum(np.sqrt(np.square(hashed).sum(axis=1, keepdims=True)), 1e-6)
    return np.hstack([hashed, stats])


@dataclass
class FactorisationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        pair = np.square(x @ self.factors) - np.square(x) @ np.square(self.factors)
        return self.bias + x @ self.linear + 0.5 * pair.sum(axis=1)


def fit_machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = 30, rate: float = 0.1, ridge: float = 1e-4):
    """Adaptive gradient on the logistic loss, mini-batches of 64 rows."""
    random = np.random.default_rng(11)
    model = FactorisationMachine(
        0.0, np.zeros(x.shape[1], np.float32), random.normal(0, 0.02, (x.shape[1], RANK)).astype(np.float32)
    )
    past_w, past_v, past_b = np.full_like(model.linear, 1e-6), np.full_like(model.factors, 1e-6), 1e-6
    for _ in range(epochs):
        order = random.permutation(len(y))
        for k in range(0, len(y), 64):
            pick = order[k : k + 64]
            rows = x[pick]
            slope = ((wordhash.sigmoid(model.margin(rows)) - y[pick]) * weight[pick]).astype(np.float32) / len(pick)
            inner = rows @ model.factors
            dw = rows.T @ slope + ridge * model.linear
            dv = rows.T @ (slope[:, None] * inner) - (np.square(rows).T @ slope)[:, None] * model.factors
            dv += ridge * model.factors
            db = float(slope.sum())
            past_w += dw * dw
            past_v += dv * dv
            past_b += db * db
            model.linear -= rate * dw / np.sqrt(past_w)
            model.factors -= rate * dv / np.sqrt(past_v)
            model.bias -= rate * db / past_b**0.5
    return model


def _rows(docs: DataFrame, *more: Column) -> DataFrame:
    stated = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.length("text").cast("long")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.coalesce(stated, F.lit(0)).alias("stated"), *more,
    )


def fit_quality(docs: DataFrame, labels: DataFrame, train: Column, bound: int = MAX_TRAINING_TEXTS) -> FactorisationMachine:
    """Fit on labelled rows where ``train`` holds.

    ``labels`` has doc_id and quality; of several labels the largest counts.
    The driver gets the input rows of at most ``bound`` texts; the two labels
    are weighted back to their shares.  Without labelled rows every score is
    that of the empty machine, 0.5.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where(train & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    share = known.groupBy("quality").count().toPandas().set_index("quality")["count"]
    empty = FactorisationMachine(0.0, np.zeros(WIDTH, np.float32), np.zeros((WIDTH, RANK), np.float32))
    if share.empty:
        return empty
    chosen = bounded_sample(known, "quality", "doc_id", bound // 2, bound)
    rows = _rows(docs).where(train).join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                x = inputs(part.column("text"), part.column("stated").to_numpy())
                lists = [row.tobytes() for row in x.astype(np.float16)]
                yield pa.record_batch(
                    [part.column("doc_id"), part.column("quality"), pa.array(lists, pa.binary())],
                    names=["doc_id", "quality", "x"],
                )

    got = rows.mapInArrow(run, "doc_id long, quality int, x binary").toPandas().sort_values("doc_id")
    if got.empty:
        return empty
    x = np.stack([np.frombuffer(v, np.float16) for v in got["x"]]).astype(np.float32)
    y = (got["quality"].to_numpy() > 0).astype(np.float32)
    whole = np.array([share[q] for q in got["quality"]], float)
    here = got["quality"].map(got["quality"].value_counts()).to_numpy(float)
    weight = whole / here
    return fit_machine(x, y, (weight / weight.mean()).astype(np.float32))


def score_quality(docs: DataFrame, model: FactorisationMachine, held_out: Column | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row.

    NULL text is the empty text (no words, length 0), a NULL or missing stated
    length is 0 or the true length; repeated rows and NULL ids are kept.
    """
    flag = F.coalesce(held_out, F.lit(False)) if held_out is not None else F.lit(False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in wordhash.pieces(batch.column("text"), 1 << 20):
                part = batch.slice(a, b - a)
                for c in range(0, len(part), 256):
                    some = part.slice(c, 256)
                    score = wordhash.sigmoid(model.margin(inputs(some.column("text"), some.column("stated").to_numpy())))
                    yield pa.record_batch(
                        [some.column("doc_id"), some.column("held_out"), pa.array(score.astype(np.float64)),
                         pa.array((score >= THRESHOLD).astype(np.int32))],
                        names=["doc_id", "held_out", "score", "predicted"],
                    )

    return _rows(docs, flag.alias("held_out")).mapInArrow(run, SCHEMA)

"""Language identification in two steps: the family, then the language in it.

Linear support vector machines over hashed byte n-grams (2 to 4 bytes of the
lower-cased text, everything but letters read as a space).  One-versus-one
machines choose the family; one-versus-one machines of that family choose the
language.  A pass over a batch adds up, for every machine, the weights of all
n-grams of all whole texts.

The machines are fitted on at most ``MAX_TRAINING_TEXTS`` labelled texts,
about ``TEXTS_PER_LANGUAGE`` of each language; the rate of each language comes
from the count of all its rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm import wordhash
from factloom.llm.sampling import bounded_sample

TEXTS_PER_LANGUAGE = 600
MAX_TRAINING_TEXTS = 12_000
BITS = 13
ORDERS = (2, 3, 4)
SCALE = 20.0
PIECE_BYTES = 1 << 20  # texts whose n-grams are in memory at once
UNDETERMINED = "und"
# Below this no language fits: four equal guesses would score as much.
MIN_SCORE = 0.25
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
MODEL_SCHEMA = "languages array<string>, first array<string>, second array<string>, weights binary, bias array<double>"

# Families of ISO 639-1 codes; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl".split(),
    "baltic": "lt lv".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz ky tk".split(),
    "indic": "hi bn mr ne pa gu ur".split(),
    "semitic": "ar he mt".split(),
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTERS[128:] = np.arange(128, 256)
_any_letter = regex.compile(r"\p{L}").search


def family_of(code: str) -> str:
    return _FAMILY_OF.get(code, code)


def grams(data: np.ndarray, order: int) -> np.ndarray:
    """Hashed n-grams; place i covers the bytes i .. i + order - 1."""
    n = len(data) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    wide = data.astype(np.uint32)
    code = wide[:n].copy()
    for k in range(1, order):
        code |= wide[k : k + n] << np.uint32(8 * k)
    code = (code + np.uint32(order)) * np.uint32(2654435761)
    code ^= code >> np.uint32(15)
    return ((code * np.uint32(2246822519)) >> np.uint32(32 - BITS)).astype(np.int64)


def _ranges(offsets: np.ndarray, order: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    begin = np.minimum(offsets[:-1], n)
    return begin, np.maximum(begin, np.minimum(offsets[1:] - order + 1, n))


@dataclass
class LanguageModel:
    """One weight vector (with bias) for each pair of families or languages."""

    languages: list[str]
    pairs: list[tuple[str, str]]
    weights: np.ndarray  # pairs x buckets
    bias: np.ndarray

    def margins(self, texts: wordhash.Texts) -> np.ndarray:
        """texts x pairs."""
        data = _LETTERS[texts.data]
        out = np.zeros((len(texts.offsets) - 1, len(self.pairs)))
        for order in ORDERS:
            code = grams(data, order)
            begin, end = _ranges(texts.offsets, order, len(code))
            total = np.maximum(end - begin, 1) * len(ORDERS)
            for k, w in enumerate(self.weights):
                run = np.concatenate([[0.0], np.cumsum(w[code], dtype=np.float64)])
                out[:, k] += SCALE * (run[end] - run[begin]) / total
        return out + self.bias

    def predict(self, texts: wordhash.Texts) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and a score between 0 and 1 for every text."""
        wins = wordhash.sigmoid(3.0 * self.margins(texts))
        column = {pair: wins[:, k] for k, pair in enumerate(self.pairs)}
        families = sorted({family_of(x) for x in self.languages})

        def share(name: str, rivals: list[str]) -> np.ndarray:
            others = [x for x in rivals if x != name]
            if not others:
                return np.ones(len(wins))
            return np.mean([column[name, x] if (name, x) in column else 1 - column[x, name] for x in others], axis=0)

        family = np.stack([share(f, families) for f in families], axis=1)
        chosen = family.argmax(axis=1)
        score = np.full((len(wins), len(self.languages)), -1.0)
        for i, code in enumerate(self.languages):
            f = families.index(family_of(code))
            inside = share(code, [x for x in self.languages if family_of(x) == families[f]])
            score[:, i] = np.where(chosen == f, family[:, f] * inside, -1.0)
        best = score.argmax(axis=1)
        return best, score[np.arange(len(best)), best]


def _features(texts: wordhash.Texts) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sparse relative frequencies, as ``margins`` weighs them."""
    data = _LETTERS[texts.data]
    code = {order: grams(data, order) for order in ORDERS}
    out = []
    for i in range(len(texts.offsets) - 1):
        x = np.zeros(1 << BITS)
        for order in ORDERS:
            (begin,), (end,) = _ranges(texts.offsets[i : i + 2], order, len(code[order]))
            if end > begin:
                x += np.bincount(code[order][begin:end], minlength=1 << BITS) / (end - begin)
        places = np.flatnonzero(x)
        out.append((places, SCALE * x[places] / len(ORDERS)))
    return out


def linear_svm(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, cost: float = 10.0, epochs: int = 8):
    """Soft-margin machine by dual coordinate descent; the last weight is the bias."""
    w = np.zeros((1 << BITS) + 1)
    alpha = np.zeros(len(rows))
    norms = np.array([v @ v + 1.0 for _, v in rows])
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            places, values = rows[i]
            slope = labels[i] * (w[places] @ values + w[-1]) - 1.0
            step = min(max(alpha[i] - slope / norms[i], 0.0), cost) - alpha[i]
            if step:
                alpha[i] += step
                w[places] += step * labels[i] * values
                w[-1] += step * labels[i]
    return w


def fit_language_model(
    docs: DataFrame,
    train: Column,
    per_language: int = TEXTS_PER_LANGUAGE,
    bound: int = MAX_TRAINING_TEXTS,
) -> LanguageModel:
    """Fit on rows where ``train`` holds and doc_id, lang and text are not NULL.

    The features are made in tasks, and one task fits the machines to the sparse vectors
    of at most ``bound`` texts; the driver gets their weights.  Without labelled rows the
    model knows no language.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("lang"), F.col("text").alias("text"),
    ).where(train & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sample = bounded_sample(rows, "lang", "doc_id", per_language, bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in wordhash.pieces(batch.column("text"), PIECE_BYTES):
                part = batch.slice(a, b - a)
                found = _features(wordhash.texts_of(wordhash.lowered(part.column("text"))))
                yield pa.record_batch(
                    [part.column("doc_id"), part.column("lang"),
                     pa.array([x.astype(np.int32) for x, _ in found], pa.list_(pa.int32())),
                     pa.array([v for _, v in found], pa.list_(pa.float64()))],
                    names=["doc_id", "lang", "places", "values"],
                )

    made = sample.mapInArrow(run, "doc_id long, lang string, places array<int>, values array<double>")
    rows = made.groupBy(F.lit(0).alias("all")).applyInArrow(_fitted, MODEL_SCHEMA).collect()
    if not rows:
        return LanguageModel([], [], np.zeros((0, 1 << BITS), np.float32), np.zeros(0))
    found = rows[0]
    weights = np.frombuffer(found.weights, np.float32).reshape(len(found.first), 1 << BITS)
    return LanguageModel(list(found.languages), list(zip(found.first, found.second)), weights, np.array(found.bias, float))


def _fitted(got: pa.Table) -> pa.Table:
    """The machines for the sparse vectors of a bounded sample, in one row."""
    ids = got.column("doc_id").to_numpy()
    codes = got.column("lang").to_pylist()
    places, values = got.column("places").combine_chunks(), got.column("values").combine_chunks()
    order = sorted(range(len(codes)), key=lambda i: (ids[i], codes[i]))
    data = [(places[i].values.to_numpy(), values[i].values.to_numpy()) for i in order]
    codes = [codes[i] for i in order]
    languages = sorted(set(codes))
    families = sorted({family_of(x) for x in languages})
    pairs = [(a, b) for a, b in itertools.combinations(families, 2)]
    groups = [family_of(x) for x in codes]
    tasks = [(pair, groups) for pair in pairs]
    for family in families:
        inside = [x for x in languages if family_of(x) == family]
        tasks += [(pair, codes) for pair in itertools.combinations(inside, 2)]
    weights, bias = [], []
    for (a, b), names in tasks:
        chosen = [i for i, x in enumerate(names) if x in (a, b)]
        w = linear_svm([data[i] for i in chosen], np.array([1.0 if names[i] == a else -1.0 for i in chosen]))
        weights.append(w[:-1].astype(np.float32))
        bias.append(float(w[-1]))
    return pa.table({
        "languages": pa.array([languages], pa.list_(pa.string())),
        "first": pa.array([[pair[0] for pair, _ in tasks]], pa.list_(pa.string())),
        "second": pa.array([[pair[1] for pair, _ in tasks]], pa.list_(pa.string())),
        "weights": pa.array([np.array(weights, np.float32).tobytes()], pa.binary()),
        "bias": pa.array([bias], pa.list_(pa.float64())),
    })


def predict_language(docs: DataFrame, model: LanguageModel, held_out: Column | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per input row.

    A text that is NULL or has no letter gets ``und`` with score 0, and so
    does every text when the model knows no language.  Ties go to the first
    language in alphabetical order; repeated rows and NULL ids are kept.
    """
    flag = F.coalesce(held_out, F.lit(False)) if held_out is not None else F.lit(False)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), flag.alias("held_out"), F.col("text").cast("string").alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            names, score = _predictions(model, part.column("text"))
            yield pa.record_batch(
                [part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(score)],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return rows.mapInArrow(run, SCHEMA)


def identified(docs: DataFrame, model: LanguageModel, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` whose language is told, in one narrow pass.

    Rows go whose text is NULL or has no letter, or whose best language scores
    less than ``min_score``.  A model without languages rejects every row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            names, score = _predictions(model, part.column("text"))
            yield part.filter(pa.array((names != UNDETERMINED) & (score >= min_score)))

    return docs.mapInArrow(run, docs.schema)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in wordhash.pieces(batch.column("text"), PIECE_BYTES):
            yield batch.slice(a, b - a)


def _predictions(model: LanguageModel, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Language names and scores of one piece."""
    text = wordhash.lowered(text)
    texts, n = wordhash.texts_of(text), len(text)
    best, score = model.predict(texts) if model.languages else (np.zeros(n, np.int64), np.zeros(n))
    letter = wordhash.sums((texts.data >= ord("a")) & (texts.data <= ord("z")), texts.offsets) > 0
    for i in np.flatnonzero(~letter):
        letter[i] = bool(_any_letter(text[i].as_py()))
    known = letter & bool(model.languages)
    names = np.array([*model.languages, UNDETERMINED], dtype=object)
    return np.where(known, names[np.where(known, best, -1)], UNDETERMINED), np.where(known, np.clip(score, 0.0, 1.0), 0.0)

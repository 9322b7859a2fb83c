"""Toxicity by weak supervision.

1. Voters: lexicons and patterns over the words of a whole text, and groups of
   word stems that mark the toxic texts of a bounded labelled sample (insults
   of languages the lexicons do not know).  A voter says "toxic" or abstains;
   the last one says "clean".
2. Generative label model: the vote patterns of all training rows are counted
   in Spark, together with the labels where there are any.  Expectation
   maximisation estimates each voter's accuracies; voters whose votes still
   depend on each other given the class are joined, and a joined group has one
   table of pattern probabilities for each class, so that correlated voters
   are not counted twice.
3. A linear classifier on hashed words and votes is trained on the posterior
   labels of at most ``MAX_TRAINING_TEXTS`` rows.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm import wordhash
from factloom.llm.sampling import bounded_sample

MAX_TRAINING_TEXTS = 6_000
BITS = 12
THRESHOLD = 0.7
CORRELATED = 0.15
MAX_GROUP = 8
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"

# Lexicons: single lower-case words, by kind of abuse.
LEXICONS = {
    "intellect": "idiot idiots moron morons stupid dumb dumbass imbecile cretin dunce retard retarded fool halfwit brainless",
    "worth": "loser losers pathetic worthless useless failure nobody pitiful",
    "dehumanising": "scum trash vermin filth garbage maggot maggots parasite parasites subhuman rat pig pigs cockroach",
    "ridicule": "clown clowns buffoon freak freaks weirdo creep joke laughingstock",
    "disgust": "disgusting disgusted repulsive nasty revolting sickening hideous ugly",
    "profanity": "fuck fucking fucked shit shitty bitch bastard asshole crap damn cunt dick prick whore slut",
    "threat": "kill murder hang shoot beat destroy stab burn",
    "hate": "hate hates despise loathe detest exterminate deport",
    "german": "idioten dumm dummkopf blödmann arschloch scheiße scheisse abschaum versager hurensohn wichser müll ekelhaft trottel",
    "french": "connard connasse salaud merde idiote débile abruti ordure putain minable nul dégoûtant crétin bouffon",
    "spanish": "idiota idiotas estúpido estúpida imbécil mierda puta cabrón gilipollas basura escoria inútil asqueroso payaso",
}
_ADDRESS = "you your youre u du dein tu tú te eres vous votre"
_PATTERNS = ("repeated", "dense", "mixed", "addressed")
STEM_BYTES = (4, 6, 8)
# A stem is a sign of toxicity when it occurs in this share of the toxic
# training texts at least, and this many times as often as in clean ones; each
# pair of voters has the stems from one of these lifts to the next.
STEM_SHARE, STEM_LIFTS = 0.01, (15.0, 40.0)
STEM_VOTERS = 2 * len(STEM_LIFTS)
MANY_STEMS = (2, 4)  # different stems of the highest lift
DENSE_STEMS = (0.003, 0.01)  # words with such stems, as a share of all words
VOTERS = (
    *LEXICONS, *_PATTERNS, *(f"stems_{k}" for k in range(STEM_VOTERS)), *(f"stems_over_{k}" for k in MANY_STEMS),
    *(f"stems_share_{k}" for k in DENSE_STEMS), "clean",
)
CLEAN = len(VOTERS) - 1

_LEXICON_BIT = {w: 0 for text in (*LEXICONS.values(), _ADDRESS) for w in text.split()}
for _k, _text in enumerate((*LEXICONS.values(), _ADDRESS)):
    for _w in _text.split():
        _LEXICON_BIT[_w] |= 1 << _k
_KNOWN = np.array([wordhash.hash_of(w) for w in _LEXICON_BIT], np.uint64)
_MASKS = np.array(list(_LEXICON_BIT.values()))[np.argsort(_KNOWN)]
_KNOWN.sort()
_ADDRESS_BIT = 1 << len(LEXICONS)
# Words that insult by themselves; threats and dislikes are too common alone.
_PLAIN_BITS = sum(1 << k for k, name in enumerate(LEXICONS) if name not in ("threat", "hate"))
_MAYBE = np.zeros(1 << 16, bool)
_MAYBE[(_KNOWN >> np.uint64(48)).astype(np.int64)] = True


@dataclass
class Stems:
    """Telling stems (sorted) and the voter of each."""

    codes: np.ndarray
    voter: np.ndarray


def votes(words: wordhash.Words, heads: np.ndarray, stems: Stems) -> np.ndarray:
    """texts x voters, True where the voter speaks; ``heads`` are the words' stems."""
    hashes, first = words.hashes, words.first
    n = len(first) - 1
    out = np.zeros((n, len(VOTERS)), bool)
    size = np.maximum(np.diff(first), 1)
    at = np.flatnonzero(_MAYBE[(hashes >> np.uint64(48)).astype(np.int64)])
    place = np.minimum(np.searchsorted(_KNOWN, hashes[at]), len(_KNOWN) - 1)
    same = _KNOWN[place] == hashes[at]
    at, mask = at[same], _MASKS[place[same]]
    owner = np.searchsorted(first, at, side="right") - 1
    for k in range(len(LEXICONS)):
        out[owner[(mask >> k) & 1 > 0], k] = True
    plain = mask & _PLAIN_BITS > 0
    hits = np.bincount(owner[plain], minlength=n)
    k = len(LEXICONS)
    out[:, k] = hits >= 2
    out[:, k + 1] = hits / size >= 0.005
    out[:, k + 2] = out[:, : len(LEXICONS)].sum(axis=1) >= 2
    spoken = np.flatnonzero(mask & _ADDRESS_BIT > 0)
    insult, insulted = at[plain], owner[plain]
    follow = np.searchsorted(insult, at[spoken], side="right")
    ok = follow < len(insult)
    spoken, follow = spoken[ok], follow[ok]
    near = (insult[follow] - at[spoken] <= 3) & (insulted[follow] == owner[spoken])
    out[owner[spoken[near]], k + 3] = True
    k += len(_PATTERNS)
    kinds, strong = np.zeros(n), np.zeros(n)
    if len(stems.codes):
        maybe = np.zeros(1 << 16, bool)
        maybe[stems.codes >> np.uint32(16)] = True
        pairs, told = [], []
        for row in heads:
            found = np.flatnonzero(maybe[row >> np.uint32(16)])
            known = np.minimum(np.searchsorted(stems.codes, row[found]), len(stems.codes) - 1)
            same = stems.codes[known] == row[found]
            found, known = found[same], known[same]
            pairs.append((np.searchsorted(first, found, side="right") - 1) * len(stems.codes) + known)
            told.append(found[stems.voter[known] >= STEM_VOTERS - 2])
        pairs, told = np.unique(np.concatenate(pairs)), np.unique(np.concatenate(told))
        whose, which = pairs // len(stems.codes), stems.voter[pairs % len(stems.codes)]
        kinds = np.bincount(whose[which >= STEM_VOTERS - 2], minlength=n)
        strong = np.bincount(np.searchsorted(first, told, side="right") - 1, minlength=n)
        for v in range(STEM_VOTERS):
            out[whose[which == v], k + v] = True
    k += STEM_VOTERS
    for v, many in enumerate(MANY_STEMS):
        out[:, k + v] = kinds >= many
    k += len(MANY_STEMS)
    for v, share in enumerate(DENSE_STEMS):
        out[:, k + v] = strong / size >= share
    out[:, CLEAN] = (hits == 0) & (kinds == 0)
    return out


def _words(text: pa.Array) -> tuple[wordhash.Words, np.ndarray]:
    texts = wordhash.texts_of(wordhash.lowered(text))
    words = wordhash.words(texts)
    return words, wordhash.stems(texts, words, STEM_BYTES)


_CODE = 1 << np.arange(len(VOTERS), dtype=np.int64)
_NO_STEMS = Stems(np.zeros(0, np.uint32), np.zeros(0, np.int64))


def vote_patterns(docs: DataFrame, stems: Stems) -> DataFrame:
    """(doc_id, pattern): the votes as bits of an int."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in wordhash.pieces(batch.column("text")):
                part = batch.slice(a, b - a)
                code = votes(*_words(part.column("text")), stems).astype(np.int64) @ _CODE
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array(code.astype(np.int32))], names=["doc_id", "pattern"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, pattern int")


@dataclass
class LabelModel:
    """Posterior of the toxic class for a vote pattern."""

    prior: float
    groups: list[list[int]]
    tables: list[dict[int, tuple[float, float]]]  # pattern of a group -> log p(toxic), log p(clean)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        logit = np.full(len(patterns), np.log(self.prior) - np.log1p(-self.prior))
        for group, found in zip(self.groups, self.tables):
            for value, (toxic, clean) in found.items():
                logit[_bits(patterns, group) == value] += toxic - clean
        return wordhash.sigmoid(logit)


def _bits(patterns: np.ndarray, group: list[int]) -> np.ndarray:
    return sum(((patterns >> j) & 1) << i for i, j in enumerate(group))


def fit_label_model(patterns: np.ndarray, labels: np.ndarray, counts: np.ndarray, rounds: int = 50) -> LabelModel:
    """Expectation maximisation over counted patterns.

    ``labels`` is 1, 0 or -1 (not labelled); labelled rows keep their class,
    the others share in both by their posterior.
    """
    known = labels >= 0
    on = ((patterns[:, None] >> np.arange(len(VOTERS))) & 1).astype(float)
    vote_share = np.where(on[:, :CLEAN].any(axis=1), 0.9, 0.02)
    belief = np.where(known, labels, vote_share).astype(float)

    def fit(groups: list[list[int]]) -> LabelModel:
        nonlocal belief
        model = LabelModel(0.5, groups, [])
        for _ in range(rounds):
            toxic, clean = counts * belief, counts * (1 - belief)
            tables = []
            for group in groups:
                values = _bits(patterns, group)
                size = 1 << len(group)
                a = np.bincount(values, toxic, size) + 0.5 / size
                b = np.bincount(values, clean, size) + 0.5 / size
                a, b = np.log(a / a.sum()), np.log(b / b.sum())
                tables.append({int(v): (a[v], b[v]) for v in np.unique(values)})
            prior = float(np.clip(toxic.sum() / max(counts.sum(), 1), 1e-6, 1 - 1e-6))
            model = LabelModel(prior, groups, tables)
            fresh = np.where(known, belief, model.posterior(patterns))
            if np.abs(fresh - belief).max() < 1e-6:
                break
            belief = fresh
        return model

    fit([[j] for j in range(len(VOTERS))])
    # what two voters still share once the class is known
    groups = [{j} for j in range(len(VOTERS))]
    strength = np.zeros((len(VOTERS), len(VOTERS)))
    for share in (belief, 1 - belief):
        w = counts * share
        if w.sum() > 0:
            centred = on - w @ on / w.sum()
            cov = (centred * w[:, None]).T @ centred / w.sum()
            spread = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            strength = np.maximum(strength, np.abs(cov / np.outer(spread, spread)) * (w.sum() >= 20))
    pairs = sorted(itertools.combinations(range(len(VOTERS)), 2), key=lambda p: -strength[p])
    for a, b in pairs:
        left, right = (next(g for g in groups if x in g) for x in (a, b))
        if strength[a, b] >= CORRELATED and left is not right and len(left) + len(right) <= MAX_GROUP:
            groups.remove(right)
            left |= right
    return fit([sorted(g) for g in groups])


def _inputs(words: wordhash.Words, heads: np.ndarray, stems: Stems) -> tuple[np.ndarray, np.ndarray]:
    """Presence of hashed words, scaled by the text, and votes."""
    n = len(words.first) - 1
    seen = np.zeros((n, 1 << BITS), np.float32)
    seen[wordhash.owners(words.first), _buckets(words)] = 1
    seen /= np.sqrt(10.0 + seen.sum(axis=1, keepdims=True))
    return seen, votes(words, heads, stems).astype(np.float32)


def _buckets(words: wordhash.Words) -> np.ndarray:
    return (words.hashes >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class ToxicityModel:
    stems: Stems
    words: np.ndarray
    votes: np.ndarray
    bias: float

    def score(self, words: wordhash.Words, heads: np.ndarray) -> np.ndarray:
        seen, spoken = _inputs(words, heads, self.stems)
        return wordhash.sigmoid(seen @ self.words + spoken @ self.votes + self.bias)


def logistic(seen: np.ndarray, spoken: np.ndarray, target: np.ndarray, weight: np.ndarray, steps: int = 300):
    """Regularised logistic regression on soft targets, accelerated gradient."""
    weight = (weight / weight.sum()).astype(np.float32)
    x = np.hstack([seen, spoken, np.ones((len(target), 1), np.float32)])
    ridge = np.r_[np.full(seen.shape[1], 3e-3), np.full(spoken.shape[1], 1e-4), 0.0].astype(np.float32)
    w = np.zeros(x.shape[1], np.float32)
    ahead, rate = w.copy(), np.float32(4.0 / max(weight @ np.square(x).sum(axis=1), 1e-6))
    for k in range(steps):
        slope = x.T @ ((wordhash.sigmoid(x @ ahead) - target).astype(np.float32) * weight) + ridge * ahead
        step = ahead - rate * slope
        ahead, w = step + np.float32(k / (k + 3)) * (step - w), step
    m = seen.shape[1]
    return w[:m], w[m:-1], float(w[-1])


def telling_stems(texts: list[np.ndarray], toxic: np.ndarray) -> Stems:
    """Stems that mark the toxic training texts; each text lists its own once."""
    n = max(int(toxic.sum()), 1), max(int((~toxic).sum()), 1)
    count = []
    for flag in (toxic, ~toxic):
        chosen = [t for t, f in zip(texts, flag) if f]
        count.append(np.unique(np.concatenate(chosen or [np.zeros(0, np.uint32)]), return_counts=True))
    (stems, a), (others, c) = count
    at = np.minimum(np.searchsorted(others, stems), max(len(others) - 1, 0))
    b = np.where(others[at] == stems, c[at], 0) if len(others) else np.zeros(len(stems))
    share, rest = a / n[0], (b + 0.5) / n[1]
    tier = np.searchsorted(STEM_LIFTS, share / rest, side="right") - 1
    told = (a >= 5) & (share >= STEM_SHARE) & (tier >= 0)
    return Stems(stems[told], 2 * tier[told] + np.arange(int(told.sum())) % 2)


def _distinct(heads: np.ndarray) -> np.ndarray:
    found = np.unique(heads)
    return found[found > 0]


def fit_toxicity(docs: DataFrame, labels: DataFrame, train: Column, bound: int = MAX_TRAINING_TEXTS) -> ToxicityModel:
    """Stems and classifier from a bounded sample, label model from all rows.

    ``labels`` has doc_id and toxic; a doc_id with several labels is toxic if
    any says so.  Rows outside ``train`` are never looked at.  Without any
    labelled training row every score is that of the empty model, 0.5.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(train & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.where(train)

    chosen = bounded_sample(known, "toxic", "doc_id", bound // 2, bound)  # ids, at most ``bound``
    sample = rows.join(F.broadcast(chosen), "doc_id")
    got = sample.mapInArrow(_stem_lists, "toxic int, words binary, stems array<int>").toPandas()
    if got.empty:
        return ToxicityModel(_NO_STEMS, np.zeros(1 << BITS, np.float32), np.zeros(len(VOTERS), np.float32), 0.0)
    got = got.drop_duplicates("words")  # copies count once
    stems = telling_stems([np.asarray(x, np.int32).view(np.uint32) for x in got["stems"]], got["toxic"].to_numpy() > 0)

    counted = (
        vote_patterns(rows, stems)
        .join(known, "doc_id", "left")
        .groupBy("pattern", F.coalesce("toxic", F.lit(-1)).alias("label"))
        .count()  # at most 3 rows for each of the 2^voters patterns
        .toPandas()
        .sort_values(["pattern", "label"])
    )
    model = fit_label_model(
        counted["pattern"].to_numpy(np.int64), counted["label"].to_numpy(), counted["count"].to_numpy(float)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _slices(batches):
            words, heads = _words(some.column("text"))
            bucket = _buckets(words).astype(np.int32)
            lists = [np.unique(bucket[i:j]) for i, j in itertools.pairwise(words.first)]
            code = votes(words, heads, stems).astype(np.int64) @ _CODE
            yield pa.record_batch(
                [some.column("doc_id"), pa.array(code.astype(np.int32)), pa.array(lists, pa.list_(pa.int32()))],
                names=["doc_id", "pattern", "buckets"],
            )

    got = sample.mapInArrow(run, "doc_id long, pattern int, buckets array<int>").toPandas()
    got = got.sort_values(["doc_id", "pattern"])
    code = got["pattern"].to_numpy(np.int64)
    x = np.zeros((len(got), 1 << BITS), np.float32)
    for i, buckets in enumerate(got["buckets"]):
        x[i, buckets] = 1
    x /= np.sqrt(10.0 + x.sum(axis=1, keepdims=True))
    spoken = ((code[:, None] >> np.arange(len(VOTERS))) & 1).astype(np.float32)
    target = model.posterior(code)
    # the sample holds more toxic texts than the table: weigh back to the prior
    share = float(np.clip(target.mean(), 1e-6, 1 - 1e-6))
    weight = target * model.prior / share + (1 - target) * (1 - model.prior) / (1 - share)
    return ToxicityModel(stems, *logistic(x, spoken, target, weight))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of at most 256 texts and about 1 MB."""
    for batch in batches:
        for a, b in wordhash.pieces(batch.column("text"), 1 << 20):
            for c in range(a, b, 256):
                yield batch.slice(c, min(256, b - c))


def _stem_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for some in _slices(batches):
        words, heads = _words(some.column("text"))
        spans = list(itertools.pairwise(words.first))
        yield pa.record_batch(
            [some.column("toxic"),
             pa.array([hashlib.sha256(words.hashes[i:j].tobytes()).digest() for i, j in spans], pa.binary()),
             pa.array([_distinct(heads[:, i:j]).view(np.int32) for i, j in spans], pa.list_(pa.int32()))],
            names=["toxic", "words", "stems"],
        )


def score_toxicity(docs: DataFrame, model: ToxicityModel, held_out: Column | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row.

    NULL text is the empty text, whose score is that of no word at all;
    repeated rows and NULL ids are kept; other columns are ignored.
    """
    flag = F.coalesce(held_out, F.lit(False)) if held_out is not None else F.lit(False)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), flag.alias("held_out"), F.col("text").cast("string").alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _slices(batches):
            score = model.score(*_words(some.column("text")))
            yield pa.record_batch(
                [some.column("doc_id"), some.column("held_out"), pa.array(score.astype(np.float64)),
                 pa.array((score >= THRESHOLD).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return rows.mapInArrow(run, SCHEMA)

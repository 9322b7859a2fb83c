"""How filters interact: what each removes, and in vain, in every order they may run in.

A document is reduced to its mask, the set of filters it fails; documents of one part
(a language) with equal masks and labels are one class with a count, so what follows is
the same work for any number of documents.  A mask row holds 0 for a failed filter and
infinity for a passed one, and a position row holds the step of each filter in one order
(the inverse of the permutation).  The min-plus product of the two matrices, the smallest
``mask + position`` over the filters, is the step at which a class goes in an order.
Weighted counts of these steps give what is removed and kept; a filter that a class fails
at a later step than that is redundant there.

Texts are compared by SHA-256.  A NULL text is an empty text, and a NULL language is the
empty part.  Repeated rows with one id and text are separate documents, none earlier
than the other; a row without an id fails the filter on repeats never, but makes no other
row fail it either.  Several label rows of one id count as one, with the larger value.  An
empty table gives no parts and so no rows.  Other columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.tables import saved

MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, MARKS = 100, 80, 10, "#$%&*|"
LETTERS = "ABCDE"
SALTS = 256
SCHEMA = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails; A is bit 0."""
    words = F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [
        n < MIN_WORDS,
        distinct * 100 < n * DISTINCT_PERCENT,
        upper.cast("long") * 100 > F.length(text).cast("long") * UPPER_PERCENT,
        F.length(F.translate(text, MARKS, "")) < F.length(text),
    ]
    bits = [F.when(fail, F.lit(1 << k)).otherwise(F.lit(0)) for k, fail in enumerate(fails)]
    return bits[0] + bits[1] + bits[2] + bits[3]


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, n): the filters that documents fail, E (bit 4) included.

    One row stands for ``n`` rows with the same id, text and part.  The first id of a
    text is found by a minimum that is combined before the shuffle and joined on text and
    id, so copies of one text never meet in one task.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("content"), text_mask(text).alias("mask"),
    )
    rows = saved(rows.groupBy("doc_id", "part", "content", "mask").agg(F.count("*").alias("n")), "masks")
    first = rows.where("doc_id IS NOT NULL").groupBy("content").agg(F.min("doc_id").alias("first_id"))
    first = first.select(F.col("content").alias("first_content"), "first_id")
    # ids without a value match nothing; the content spreads them
    met = rows.join(first, (rows["content"] == first["first_content"]) & (rows["doc_id"] == first["first_id"]), "left")
    repeated = F.col("doc_id").isNotNull() & F.col("first_id").isNull()
    return met.select("doc_id", "part", (F.col("mask") + F.when(repeated, 16).otherwise(0)).alias("mask"), "n")


def mask_classes(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): documents of one class, counted.

    ``masks`` has doc_id, part, mask and n.
    """
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"),
    )
    # rows without an id are dealt by their mask and part, not to one task
    spread = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("part", "mask", "n"), F.lit(SALTS))).otherwise(0)
    left, right = masks.withColumn("spread", spread), marks.withColumn("label_spread", F.lit(0).cast("long"))
    met = left.join(right, (F.col("doc_id") == F.col("label_id")) & (F.col("spread") == F.col("label_spread")), "left")
    return met.groupBy("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")).agg(
        F.sum("n").alias("n")
    )


def removal_steps(masks: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The min-plus product: for each mask and order the step of removal, infinity if kept.

    ``masks`` (classes x filters) has 0 where a filter is failed and infinity elsewhere;
    ``positions`` (orders x filters) has the step of each filter in each order.
    """
    steps = np.full((len(masks), len(positions)), np.inf)
    for k in range(masks.shape[1]):
        np.minimum(steps, masks[:, k, None] + positions[None, :, k], out=steps)
    return steps


def interactions(classes: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part, order of the filters and step, with counts of documents.

    ``classes`` has part, mask, good, toxic and n; filter k is bit k of the mask and named
    ``letters[k]``.  A part holds at most 4 * 2 ** len(letters) classes, all of which meet
    in one group.
    """
    size = len(letters)
    orders = np.array(list(itertools.permutations(range(size))))
    positions = np.argsort(orders, axis=1) + 1.0
    names = ["".join(letters[k] for k in order) for order in orders]

    def audit(rows: pa.Table) -> pa.Table:
        fails = (rows.column("mask").to_numpy()[:, None] >> np.arange(size) & 1).astype(bool)
        weights = {
            "removed": rows.column("n").to_numpy(),
            "good_lost": rows.column("n").to_numpy() * rows.column("good").to_numpy(),
            "toxic_lost": rows.column("n").to_numpy() * rows.column("toxic").to_numpy(),
        }
        steps = removal_steps(np.where(fails, 0.0, np.inf), positions)
        out = {k: np.zeros((len(orders), size), np.int64) for k in ("kept", "redundant", "unique_fails", *weights)}
        gone = np.isfinite(steps)
        at, order = np.nonzero(gone)
        for name, w in weights.items():
            np.add.at(out[name], (order, steps[gone].astype(int) - 1), w[at])
        n = weights["removed"]
        alone = [n[fails[:, k] & (fails.sum(axis=1) == 1)].sum() for k in range(size)]
        for s in range(size):
            late = fails[:, orders[:, s]] & (steps < s + 1)
            out["redundant"][:, s] = (n[:, None] * late).sum(axis=0)
            out["unique_fails"][:, s] = np.array(alone)[orders[:, s]]
            out["kept"][:, s] = (n[:, None] * (steps > s + 1)).sum(axis=0)
        shares = np.bincount(orders.ravel(), out["removed"].ravel(), size).astype(np.int64)
        return pa.table({
            "part": pa.array(rows.column("part").to_pylist()[:1] * orders.size, pa.string()),
            "filter_order": pa.array(np.repeat(names, size).tolist(), pa.string()),
            "step": pa.array(np.tile(np.arange(1, size + 1), len(orders)), pa.int32()),
            **{k: pa.array(out[k].ravel()) for k in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")},
            "shapley": pa.array(shares[orders].ravel()),
        })

    return classes.groupBy("part").applyInArrow(audit, SCHEMA)


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters over all documents, in all 120 orders, per language."""
    return interactions(mask_classes(failures(docs), labels))


def audit_sql() -> str:
    """The same rows in SQL."""
    steps = ", ".join(f"CASE WHEN fails[{k + 1}] THEN instr(filter_order, '{x}') ELSE 6 END" for k, x in enumerate(LETTERS))
    joined = " || ".join(f"{x}.f" for x in LETTERS.lower())
    different = " AND ".join(f"{x}.f <> {y}.f" for x, y in itertools.combinations(LETTERS.lower(), 2))
    sources = ", ".join(f"letters {x}" for x in LETTERS.lower())
    return rf"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
listed AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, false) AS repeated FROM texts),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
    max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
failed AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    [len(words) < {MIN_WORDS}, 100 * len(list_distinct(words)) < {DISTINCT_PERCENT} * len(words),
     100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {UPPER_PERCENT} * length(text),
     regexp_matches(text, '[#$%&*|]'), repeated] AS fails
    FROM listed LEFT JOIN marks ON listed.doc_id = marks.doc_id),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (SELECT {joined} AS filter_order FROM {sources} WHERE {different}),
gone AS (SELECT part, good, toxic, fails, filter_order, least({steps}) AS gone_at FROM failed, orders),
counted AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS f,
    count(*) FILTER (gone_at > step) AS kept, count(*) FILTER (gone_at = step) AS removed,
    count(*) FILTER (gone_at < step AND fails[ascii(substr(filter_order, step, 1)) - 64]) AS redundant,
    count(*) FILTER (fails[ascii(substr(filter_order, step, 1)) - 64] AND len(list_filter(fails, lambda x: x)) = 1) AS unique_fails,
    count(*) FILTER (gone_at = step AND good = 1) AS good_lost,
    count(*) FILTER (gone_at = step AND toxic = 1) AS toxic_lost
    FROM gone, (SELECT unnest([1, 2, 3, 4, 5]) AS step) GROUP BY part, filter_order, step)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM counted"""

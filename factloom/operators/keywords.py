"""Keyword normalisation, dictionary check and fuzzy repair."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.defaults import FUZZY_CUTOFF
from factloom.functions import kernels
from factloom.functions.text import normalize_keyword, table_compare_form, table_key
from factloom.operators.skew import costly_tasks, salted_lookup

# Pairs of letters say something about similar words above this ratio.
PAIRS_ABOVE = 0.7

REQUEST_KEYS = ("run_id", "tbl_pos", "pos")


def canonical_tables(
    names: DataFrame, canon: DataFrame, name_col: str, row_id: Sequence[str]
) -> DataFrame:
    """Adds ``canonical`` (an unknown name stays as it is), ``known`` and
    ``compare_form``.  ``canon`` is (key, canonical); of several entries for a
    key the smallest counts."""
    keyed = names.withColumn("key", table_key(F.col(name_col)))
    joined = salted_lookup(keyed, _one_for_each(canon, "key"), ["key"], row_id)
    return (
        joined.withColumn("known", F.col("canonical").isNotNull())
        .withColumn("canonical", F.coalesce("canonical", name_col))
        .withColumn("compare_form", table_compare_form(F.col("canonical")))
        .drop("key")
    )


def _one_for_each(mapping: DataFrame, key: str) -> DataFrame:
    return mapping.groupBy(key).agg(F.min("canonical").alias("canonical"))


def normalized_keywords(
    requests: DataFrame,
    aliases: DataFrame,
    keyword_col: str = "raw",
    row_id: Sequence[str] = REQUEST_KEYS,
) -> DataFrame:
    """Adds ``normalized``: tidied and with variants replaced by canonicals (of
    several for a variant the smallest)."""
    tidy = requests.withColumn("variant", normalize_keyword(F.col(keyword_col)))
    joined = salted_lookup(tidy, _one_for_each(aliases, "variant"), ["variant"], row_id)
    return joined.withColumn("normalized", F.coalesce("canonical", "variant")).drop(
        "variant", "canonical"
    )


def _numbered(grams: Column) -> Column:
    """Grams as a set: the second of equal ones is another than the first."""
    ordered = F.array_sort(grams)
    return F.transform(ordered, lambda g, i: F.concat(g, F.lit("\0"), (i - F.array_position(ordered, g)).cast("string")))


def _least_total(n: Column, cutoff: float) -> Column:
    """The fewest letters that a word of ``n`` letters and one like it have together."""
    return n * (2 / (2 - cutoff))


def _least_shared(total: Column, grams: Column, cutoff: float) -> Column:
    """Grams that two words of ``total`` letters share if their ratio reaches the cutoff.

    They match in at least ``cutoff * total / 2`` letters.  Matches come in runs with
    unmatched letters between them, so there is at most one run more than there are
    unmatched letters, and each run of pairs is one shorter than its letters.
    """
    letters = total * (cutoff / 2)
    pairs = letters * 3 - total - 1
    return F.greatest(F.ceil(F.when(grams == 1, letters).otherwise(pairs) - 1e-9), F.lit(1)).cast("int")


def _gram_lists(texts: DataFrame, cutoff: float, grams: int | None) -> DataFrame:
    """(tbl, text, n, short, letters, grams, tokens): pairs of letters of every text, and the letters of
    those texts that are so short that words like them need not share a pair."""
    letters = F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0))
    read = texts.withColumn("letters", letters).withColumn("n", F.size("letters")).where("n > 0")
    ahead, behind = F.slice("letters", F.lit(2), F.col("n") - 1), F.slice("letters", F.lit(1), F.col("n") - 1)
    short = _least_total(F.col("n"), cutoff) * (1.5 * cutoff - 1) - 1 < 1
    if grams is not None:
        short = F.lit(grams == 1)
    lists = F.array(
        F.struct(F.lit(2).alias("grams"), F.zip_with(behind, ahead, lambda a, b: F.concat(a, b)).alias("list")),
        F.when(short, F.struct(F.lit(1).alias("grams"), F.col("letters").alias("list"))),
    )
    listed = read.withColumn("short", short).select(
        "tbl", "text", "n", "short", _numbered(F.col("letters")).alias("letters"), F.inline(F.filter(lists, lambda x: x.isNotNull()))
    )
    return listed.select("tbl", "text", "n", "short", "letters", "grams", _numbered(F.col("list")).alias("tokens"))


def _prefixes(lists: DataFrame, counts: DataFrame, cutoff: float) -> DataFrame:
    """One row per token of a prefix: rare ones first, as many as two texts can miss and one.

    Texts that share enough tokens share one of these.
    """
    tokens = lists.select("tbl", "text", "n", "short", "letters", "grams", F.explode("tokens").alias("token"))
    ranked = tokens.join(counts, ["tbl", "grams", "token"], "left").groupBy("tbl", "text", "n", "short", "grams").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("entries", F.lit(0)).alias("entries"), "token"))).alias("ranked"),
        F.first("letters").alias("letters"),
    )
    least = _least_shared(_least_total(F.col("n"), cutoff), F.col("grams"), cutoff)
    # a short text may meet a longer one, of which it shares a single pair
    least = F.when(F.col("short") & (F.col("grams") == 2), 1).otherwise(least)
    ranked = ranked.withColumn("tokens", F.transform("ranked", lambda x: x["token"]))
    head = F.slice("ranked", F.lit(1), F.greatest(F.size("ranked") - least + 1, F.lit(0)))
    return ranked.select("tbl", "text", "n", "letters", "grams", "tokens", F.explode(head).alias("r")).where("r.entries > 0").select(
        "tbl", "text", "n", "letters", "grams", "tokens", "r.token"
    )


def candidate_keywords(words: DataFrame, dictionary: DataFrame, cutoff: float, grams: int | None = None) -> DataFrame:
    """(tbl, normalized, keyword): the pairs that can reach the cutoff, by an inverted
    index of the grams of the dictionary.

    No pair is lost: length and number of shared grams follow from the ratio.  ``grams``
    forces letters (1) in place of pairs of letters, which need a cutoff above 2/3 to tell anything.
    """
    # a word or keyword without a table or text is close to nothing
    wanted = words.select("tbl", F.col("normalized").alias("text")).distinct().dropna()
    entries = dictionary.select("tbl", F.col("keyword").alias("text")).distinct().dropna()
    if grams is None and cutoff <= PAIRS_ABOVE:
        grams = 1
    asked, listed = (_gram_lists(t, cutoff, grams) for t in (wanted, entries))
    if grams == 1:
        asked, listed = asked.where("grams = 1"), listed.where("grams = 1")
    counts = listed.select("tbl", "grams", F.explode("tokens").alias("token")).groupBy("tbl", "grams", "token").agg(
        F.count(F.lit(1)).alias("entries")
    )
    left = _prefixes(asked, counts, cutoff)
    right = _prefixes(listed, counts, cutoff).select(
        "tbl", "grams", "token", F.col("text").alias("keyword"), F.col("n").alias("n_right"),
        F.col("letters").alias("letters_right"), F.col("tokens").alias("tokens_right"),
    )
    total = F.col("n") + F.col("n_right")
    met = left.join(right, ["tbl", "grams", "token"]).where(F.least("n", "n_right") * 2 >= total * cutoff - 1e-9)
    shared, letters = F.size(F.array_intersect("tokens", "tokens_right")), F.size(F.array_intersect("letters", "letters_right"))
    met = met.where(shared >= _least_shared(total, F.col("grams"), cutoff)).where(letters >= _least_shared(total, F.lit(1), cutoff))
    return met.select("tbl", F.col("text").alias("normalized"), "keyword")


def closest_keywords(
    words: DataFrame, dictionary: DataFrame, cutoff: float = FUZZY_CUTOFF, grams: int | None = None
) -> DataFrame:
    """(tbl, normalized, suggested, ratio) for each distinct word that has a
    keyword of its table with a similarity ratio of at least ``cutoff``; among
    equals the largest keyword counts.

    Only the pairs that :func:`candidate_keywords` leaves are compared letter by letter.
    """
    measure = kernels.ratios

    @F.pandas_udf("double")
    def ratio(word: pd.Series, entry: pd.Series) -> pd.Series:
        return pd.Series(measure(word, entry), dtype="float64")

    pairs = candidate_keywords(words, dictionary, cutoff, grams)
    # few bytes that cost much work; what follows is by word and needs no other exchange
    pairs = pairs.repartition(costly_tasks(words.sparkSession), "tbl", "normalized").distinct()
    close = pairs.withColumn("ratio", ratio("normalized", "keyword")).where(F.col("ratio") >= cutoff)
    best = F.max(F.struct("ratio", "keyword")).alias("b")
    return close.groupBy("tbl", "normalized").agg(best).select(
        "tbl", "normalized", F.col("b.keyword").alias("suggested"), "b.ratio"
    )


def validated_keywords(
    requests: DataFrame,
    dictionary: DataFrame,
    aliases: DataFrame,
    fuzzy: bool = True,
    cutoff: float = FUZZY_CUTOFF,
    row_id: Sequence[str] = REQUEST_KEYS,
) -> DataFrame:
    """Requests(*row_id, tbl, raw) with ``normalized``, ``status`` and
    ``suggested``; ``resolved`` is the keyword to use, if any.

    status: ``valid`` (in the dictionary), ``repaired`` (close enough to an
    entry), ``invalid``, ``unknown_table`` or ``empty``.  Each distinct word is
    checked once, whatever the number of requests for it.
    """
    tables = dictionary.select(F.col("tbl"), F.lit(True).alias("known_table")).distinct()
    entries = dictionary.select(
        "tbl", F.col("keyword").alias("normalized"), F.lit(True).alias("listed")
    ).distinct()
    asked = requests.select("tbl", "raw").distinct()
    tagged = normalized_keywords(asked, aliases, "raw", ["tbl", "raw"])
    tagged = tagged.join(tables, "tbl", "left").join(entries, ["tbl", "normalized"], "left")

    known = F.coalesce("known_table", F.lit(False))
    listed = F.coalesce("listed", F.lit(False))
    if fuzzy:
        doubtful = tagged.where(known & ~listed & (F.col("normalized") != ""))
        repairs = closest_keywords(doubtful, dictionary, cutoff).drop("ratio")
        tagged = tagged.join(repairs, ["tbl", "normalized"], "left")
    else:
        tagged = tagged.withColumn("suggested", F.lit(None).cast("string"))
    status = (
        F.when(~known, "unknown_table")
        .when(F.col("normalized") == "", "empty")
        .when(listed, "valid")
        .when(F.col("suggested").isNotNull(), "repaired")
        .otherwise("invalid")
    )
    checked = tagged.withColumn("status", status).select(
        F.struct("tbl", "raw").alias("asked"), "normalized", "status",
        F.when(F.col("status") == "repaired", F.col("suggested")).alias("suggested"),
        F.when(F.col("status") == "valid", F.col("normalized")).otherwise(F.col("suggested")).alias("resolved"),
    )
    # a pair that holds a NULL is a key like any other
    found = salted_lookup(requests.withColumn("asked", F.struct("tbl", "raw")), checked, ["asked"], row_id)
    return found.drop("asked")


def invalid_report(validated: DataFrame, row_id: Sequence[str] = REQUEST_KEYS) -> DataFrame:
    """(*row_id, tbl, raw, normalized, suggested): every keyword that was not
    in the dictionary as asked, repaired ones with their suggestion.

    Told by what it is not, so that the requests keep a left join to their status: an inner
    join may send the requests to the driver, whose number Spark takes for that of the plans.
    """
    return validated.where(
        ~F.coalesce("status", F.lit("invalid")).isin("valid", "empty")
    ).select(*row_id, "tbl", "raw", "normalized", "suggested")

"""License detection by ordered signature rules, on DataFrame functions only.

A text is read as its words, each between two spaces of its own, so that a
rule (a regular expression over words) needs no look-around and matches cannot
share a space.  A rule is tried only on texts that hold one of the words of which
every match has one (``implied_words``) and the characters that every match has
(``implied_text``), so no match is lost; these words are looked for in the text as it
is, and texts without any of them are not cut into words.  A match
is an interval of words; it is dropped when it lies inside the interval of a
match of the same or a higher priority.

``phrase`` rules (label and plain words) are the base: their places are counted
as they are, and their labels always stay.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# every character is named by itself: such classes are looked up as bits, ranges are tried in turn
_GAP = "".join(f"\\x{c:02x}" for c in range(128) if not chr(c).isalnum())
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}


class Rule(NamedTuple):
    order: int
    label: str
    priority: int
    keyword: str
    pattern: str
    base: bool


# label: (keyword, words of the name, versions, SPDX ids, words of its address)
_NAMES = {
    "mit": ("mit", "(mit|expat)", [], "mit", "opensource org licenses mit"),
    "mit-0": ("mit", "mit (0|no attribution)", [], "mit 0", "opensource org licenses mit 0"),
    "x11": ("x11", "x11", [], "x11", "xfree86 org legal licenses"),
    "apache": ("apache", "apache( software)?", ["1 0", "1 1", "2 0"], "apache", "apache org licenses"),
    "gpl": ("general", "(gnu )?general public", ["1", "2", "3"], "gpl", "gnu org licenses gpl"),
    "gpl-short": ("gpl", "(gnu )?gpl", ["1", "2", "3"], "gpl", "gnu org copyleft gpl"),
    "lgpl": ("lesser", "(gnu )?(lesser|library) general public", ["2", "2 1", "3"], "lgpl", "gnu org licenses lgpl"),
    "lgpl-short": ("lgpl", "(gnu )?lgpl", ["2", "2 1", "3"], "lgpl", "gnu org copyleft lgpl"),
    "agpl": ("affero", "(gnu )?affero general public", ["1", "3"], "agpl", "gnu org licenses agpl"),
    "agpl-short": ("agpl", "(gnu )?agpl", ["1", "3"], "agpl", "gnu org copyleft agpl"),
    "gfdl": ("documentation", "(gnu )?free documentation", ["1 1", "1 2", "1 3"], "gfdl", "gnu org licenses fdl"),
    "bsd": ("bsd", "bsd", ["0 clause", "1 clause", "2 clause", "3 clause", "4 clause"], "bsd", "opensource org licenses bsd"),
    "freebsd": ("freebsd", "freebsd", [], "bsd 2 clause freebsd", "freebsd org copyright"),
    "mpl": ("mozilla", "mozilla public", ["1 0", "1 1", "2 0"], "mpl", "mozilla org mpl"),
    "mpl-short": ("mpl", "mpl", ["1 0", "1 1", "2 0"], "mpl", "mozilla org en us mpl"),
    "epl": ("eclipse", "eclipse public", ["1 0", "2 0"], "epl", "eclipse org legal epl"),
    "eupl": ("eupl", "(european union public|eupl)", ["1 0", "1 1", "1 2"], "eupl", "joinup ec europa eu"),
    "cddl": ("cddl", "(common development and distribution|cddl)", ["1 0", "1 1"], "cddl", "opensource org licenses cddl"),
    "cpl": ("common", "common public", ["1 0"], "cpl", "opensource org licenses cpl"),
    "isc": ("isc", "isc", [], "isc", "opensource org licenses isc"),
    "zlib": ("zlib", "zlib( libpng)?", [], "zlib", "zlib net zlib license"),
    "boost": ("boost", "boost software", ["1 0"], "bsl", "boost org license 1 0"),
    "artistic": ("artistic", "(perl )?artistic", ["1 0", "2 0"], "artistic", "perlfoundation org artistic license"),
    "unlicense": ("unlicense", "(the )?unlicense", [], "unlicense", "unlicense org"),
    "wtfpl": ("wtfpl", "(do what the fuck you want to public|wtfpl)", ["1", "2"], "wtfpl", "wtfpl net"),
    "python": ("python", "python( software foundation)?", ["2", "2 0"], "psf", "python org psf license"),
    "php": ("php", "php", ["3 0", "3 01"], "php", "php net license"),
    "ruby": ("ruby", "ruby", [], "ruby", "ruby lang org en about license"),
    "openssl": ("openssl", "openssl", [], "openssl", "openssl org source license"),
    "ofl": ("font", "(sil )?open font", ["1 0", "1 1"], "ofl", "scripts sil org ofl"),
    "odbl": ("database", "open database", ["1 0"], "odbl", "opendatacommons org licenses odbl"),
    "postgresql": ("postgresql", "postgresql", [], "postgresql", "postgresql org about licence"),
    "upl": ("permissive", "universal permissive", ["1 0"], "upl", "oss oracle com licenses upl"),
    "ms-pl": ("microsoft", "microsoft public", [], "ms pl", "opensource org licenses ms pl"),
    "ms-rl": ("reciprocal", "microsoft reciprocal", [], "ms rl", "opensource org licenses ms rl"),
    "qpl": ("qpl", "(q public|qpl)", ["1 0"], "qpl", "opensource org licenses qpl"),
    "sleepycat": ("sleepycat", "sleepycat", [], "sleepycat", "opensource org licenses sleepycat"),
    "afl": ("academic", "academic free", ["1 1", "2 1", "3 0"], "afl", "opensource org licenses afl"),
    "osl": ("osl", "(open software|osl)", ["1 0", "2 1", "3 0"], "osl", "opensource org licenses osl"),
    "ncsa": ("ncsa", "(university of illinois )?ncsa( open source)?", [], "ncsa", "opensource org licenses ncsa"),
    "elastic": ("elastic", "elastic", ["1 0", "2 0"], "elastic", "elastic co licensing elastic license"),
    "busl": ("business", "business source", ["1 0", "1 1"], "busl", "mariadb com bsl11"),
    "sspl": ("server", "server side public", ["1"], "sspl", "mongodb com licensing server side public license"),
}
_PARTS = {"by": "attribution", "by sa": "attribution share ?alike", "by nd": "attribution no ?derivatives",
          "by nc": "attribution non ?commercial", "by nc sa": "attribution non ?commercial share ?alike",
          "by nc nd": "attribution non ?commercial no ?derivatives"}
# label: (keyword, a sentence that only this license has)
_SENTENCES = [
    ("mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "noninfringement", "merchantability fitness for a particular purpose and noninfringement"),
    ("isc", "permission", "permission to use copy modify and (or )?distribute this software for any purpose with or without fee"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification"),
    ("bsd", "endorse", "may be used to endorse or promote products derived from this software"),
    ("apache", "apache", "you may not use this file except in compliance with the license"),
    ("gpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public license"),
    ("agpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("mpl", "mozilla", "this source code form is subject to the terms of the mozilla public license"),
    ("zlib", "altered", "altered source versions must be plainly marked as such"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("boost", "boost", "boost software license version 1 0 17 august 2003"),
    ("ofl", "font", "this license is copied below and is also available with a faq"),
    ("public-domain", "domain", "(dedicated|released|placed) (to|into|in) the public domain"),
    ("cc0", "cc0", "(cc0|cc zero|creative commons zero)( 1 0)?( universal)?"),
    ("proprietary", "reserved", "all rights reserved"),
]
_VERB = "(licensed|released|distributed|available|published|provided|covered|redistribute|made available)"
_NOTICE = _VERB + " (to you )?under (the )?(terms of )?(the )?(conditions of )?(the )?"
CONFIDENCE = {1: 1.0, 2: 0.95, 3: 0.9, 4: 0.8, 5: 0.7, 6: 0.6}


def _versioned(label: str, version: str) -> str:
    return f"{label}-{version.replace(' clause', '-clause').replace(' ', '.')}"


def rules() -> list[Rule]:
    """All rules in order: 522, from the names above and six templates."""
    found: list[tuple[str, int, str, str, bool]] = []
    for label, keyword, sentence in _SENTENCES:
        found.append((label, 2, keyword, sentence, False))
    for full, (keyword, name, versions, spdx, url) in _NAMES.items():
        label = full.removesuffix("-short")
        found.append((label, 1, "spdx", f"spdx license identifier {spdx}", False))
        found.append((label, 2, keyword if keyword in url.split() else url.split()[0], url, False))
        for version in versions:
            number = version.replace(" 0", "( 0)?") if version.endswith(" 0") else version
            own = _versioned(label, version)
            found.append((own, 1, "spdx", f"spdx license identifier {spdx} {number}( only| or later)?", False))
            found.append((own, 3, keyword, f"{_NOTICE}{name}( licen[cs]e)?( agreement)?( (version|v))? v?{number}( licen[cs]e)?", False))
            found.append((own, 4, keyword, f"{name}( licen[cs]e)?( agreement)?( (version|v))? v?{number}( licen[cs]e)?", False))
        found.append((label, 4, keyword, f"{_NOTICE}{name}( licen[cs]e)?", False))
        found.append((label, 5, keyword, f"{name} licen[cs]e", False))
    for code, words in _PARTS.items():
        label = "cc-" + code.replace(" ", "-")
        for version in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            found.append((_versioned(label, version), 1, "spdx", f"spdx license identifier cc {code} {version}", False))
            found.append((_versioned(label, version), 2, "creativecommons", f"creativecommons org licenses {code} {version}", False))
            found.append((_versioned(label, version), 3, "cc", f"({_NOTICE})?(a )?cc {code}( licen[cs]e)? (version )?{version}", False))
            found.append((_versioned(label, version), 3, "commons", f"creative commons {words}( licen[cs]e)? (version )?{version}", False))
        found.append((label, 4, "cc", f"{_NOTICE}(a )?cc {code}", False))
        found.append((label, 5, "commons", f"creative commons {words}", False))
    for label, phrase in BASE.items():
        found.append((label, 6, phrase.split()[0], phrase, True))
    return [
        Rule(k, label, priority, keyword, f" {pattern.replace(' ?', '~').replace(' ', '  ').replace('~', '(  )?')} ", base)
        for k, (label, priority, keyword, pattern, base) in enumerate(found)
    ]


_OPTIONAL = re.compile(r"\((?:[^()]|\([^()]*\))*\)\?")
_GROUP = re.compile(r"\(([^()]*)\)(?!\?)")


def implied_words(rule: Rule) -> list[str]:
    """Words of which every match of the rule holds at least one.

    That is the keyword if the pattern cannot match without it; else, if it
    stands in one of several alternatives, a word of each of them; else the
    longest word that the pattern cannot match without.
    """
    pattern = rule.pattern.replace("(  )?", "?").replace("  ", " ").strip()
    needed = _OPTIONAL.sub(" ", pattern)

    def plain(part: str) -> list[str]:
        return [w for w in part.split() if re.fullmatch("[a-z0-9]+", w)]

    fixed = plain(_GROUP.sub(" ", needed))
    if rule.keyword in fixed:
        return [rule.keyword]
    for group in _GROUP.findall(needed):
        words = [plain(part) for part in group.split("|")]
        if any(rule.keyword in w for w in words) and all(words):
            return sorted({rule.keyword if rule.keyword in w else max(w, key=len) for w in words})
    return [max(fixed, key=len)]


def implied_text(rule: Rule) -> str:
    """The longest run of characters that every match of the rule has."""
    needed = re.sub(r"\[[^]]*\]|[^()]\?", "|", _GROUP.sub("|", _OPTIONAL.sub("|", rule.pattern)))
    return max(needed.split("|"), key=len)


def _any_of(words: list[str]) -> str:
    """A pattern for any of the words, letter by letter, so that a text is compared with few of them."""
    if words == [""]:
        return ""
    heads = sorted({w[:1] for w in words} - {""})
    parts = [head + _any_of([w[1:] for w in words if w[:1] == head]) for head in heads]
    joined = parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"
    return f"(?:{joined})?+" if "" in words else joined


def _rule_table(spark: SparkSession) -> DataFrame:
    """The rules, once for each implied word in place of the keyword, with ``needed``."""
    tried = [(rule._replace(keyword=word), implied_text(rule)) for rule in rules() for word in implied_words(rule)]
    rows = F.array(
        *(F.struct(*(F.lit(v).alias(n) for n, v in (*rule._asdict().items(), ("needed", text)))) for rule, text in tried)
    )
    return spark.range(1).select(F.inline(rows))


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def spaced_words(text: Column) -> Column:
    """The words of a text with A-Z lower-cased, each between two spaces of its own."""
    low = F.translate(text, _UPPER, _LOWER)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(low, f"[{_GAP}]++", "  ")), F.lit(" "))


def word_count(text: Column) -> Column:
    """The number of words: each becomes one character with what follows it, and so does one put in front."""
    counted = F.regexp_replace(F.concat(F.lit("0 "), text), f"[^{_GAP}]++[{_GAP}]*+", "1")
    return (F.octet_length(counted) - 1).cast("long")


def detect(docs: DataFrame) -> DataFrame:
    """One row per match of a rule: doc_id, text_hash, rule columns, first and
    last word of the match, and ``suppressed``.

    NULL texts have no match.  Rows that repeat (same id and text) are looked
    at once.  Only matches are shuffled, never texts.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    words = sorted({w for rule in rules() for w in implied_words(rule)})
    # the words of the rules that stand in the text; upper case does not matter, of ASCII alone
    named = F.regexp_extract_all(text, F.lit(f"(?i)(?<![^{_GAP}]){_any_of(words)}(?![^{_GAP}])"), F.lit(0))
    # both inside one generator, so that a text is searched once and cut into words if some stand there
    found = F.transform(
        F.filter(F.array(F.array_distinct(F.transform(named, F.lower))), lambda keywords: F.size(keywords) > 0),
        lambda keywords: F.struct(spaced_words(text).alias("words"), keywords.alias("keywords")),
    )
    spaced = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.inline(found))
    tried = spaced.withColumn("keyword", F.explode("keywords")).join(
        F.broadcast(_rule_table(spark)), "keyword"  # the rules above, some 80 KB
    ).where(F.contains("words", "needed"))
    hits = tried.where(F.regexp_like("words", F.col("pattern"))).select(
        "doc_id", "text_hash", "order", "label", "priority", "base",
        F.posexplode(
            F.arrays_zip(
                F.split("words", F.col("pattern")).alias("gap"),
                F.regexp_extract_all("words", F.col("pattern"), F.lit(0)).alias("match"),
            )
        ).alias("place", "hit"),
    )
    sized = hits.where(F.col("hit.match").isNotNull()).select(
        "doc_id", "text_hash", "order", "label", "priority", "base", "place",
        (_spaces(F.col("hit.gap")) / 2).cast("long").alias("gap"), (_spaces(F.col("hit.match")) / 2).cast("long").alias("size"),
    ).distinct()
    before = Window.partitionBy("doc_id", "text_hash", "order").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    placed = sized.withColumn("first", F.sum(F.col("gap") + F.col("size")).over(before) - F.col("size"))
    placed = placed.withColumn("last", F.col("first") + F.col("size") - 1)
    earlier = (
        Window.partitionBy("doc_id", "text_hash")
        .orderBy("first", F.desc("last"), "priority", "order")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = F.lit(False)
    for level in sorted(CONFIDENCE):
        reach = F.max(F.when(F.col("priority") <= level, F.col("last"))).over(earlier)
        inside = inside | ((F.col("priority") == level) & F.coalesce(reach >= F.col("last"), F.lit(False)))
    return placed.withColumn("suppressed", inside)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per input row: words, base places, labels and a score.

    NULL and empty texts have no words and no labels (empty strings, score 0);
    repeated rows and NULL ids are kept; other columns are ignored.  The score
    is the confidence of the strongest match that was not suppressed.
    """
    base, kept = F.col("base"), ~F.col("suppressed") | F.col("base")
    sure = F.element_at(F.create_map(*(F.lit(x) for kv in CONFIDENCE.items() for x in kv)), F.col("priority"))

    def joined(label: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(label)), ",")

    found = detect(docs).groupBy("doc_id", "text_hash").agg(
        F.sum(base.cast("long")).alias("n_base"),
        F.min(F.when(base, F.col("first"))).alias("first_word"),
        F.max(F.when(base, F.col("first"))).alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined(F.when(kept, F.col("label"))).alias("labels"),
        F.max(F.when(kept, sure)).alias("score"),
    )
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.col("text").cast("string")).alias("text_hash"),
        word_count(text).alias("n_words"),
    )
    joined_rows = rows.alias("r").join(
        found.alias("f"), F.col("r.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("r.text_hash") == F.col("f.text_hash")), "left"
    )
    return joined_rows.select(
        "r.doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def scan_sql() -> str:
    """The same scan for DuckDB."""
    values = ",\n  ".join(
        f"({r.order}, '{r.label}', {r.priority}, '{r.keyword}', '{r.pattern}', {str(r.base).lower()})" for r in rules()
    )
    levels = " OR ".join(
        f"(priority = {p} AND coalesce(max(CASE WHEN priority <= {p} THEN last END) OVER earlier >= last, false))"
        for p in sorted(CONFIDENCE)
    )
    sure = "CASE priority " + " ".join(f"WHEN {p} THEN CAST({c} AS DOUBLE)" for p, c in CONFIDENCE.items()) + " END"
    return f"""
WITH rules("order", label, priority, keyword, pattern, base) AS (VALUES
  {values}),
listed AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') AS w
  FROM documents),
spaced AS (
  SELECT doc_id, ' ' || array_to_string(w, '  ') || ' ' AS words FROM listed),
hits AS (
  SELECT doc_id, "order", label, priority, base,
         string_split_regex(words, pattern) AS gaps, regexp_extract_all(words, pattern) AS matches
  FROM spaced JOIN rules ON regexp_matches(words, pattern)),
places AS (
  SELECT *, unnest(gaps[1:len(matches)]) AS gap, unnest(matches) AS hit, unnest(range(len(matches))) AS place FROM hits),
sized AS (
  SELECT DISTINCT doc_id, "order", label, priority, base, place,
         (length(gap) - length(replace(gap, ' ', ''))) // 2 AS gap, (length(hit) - length(replace(hit, ' ', ''))) // 2 AS size
  FROM places),
placed AS (
  SELECT *, first + size - 1 AS last FROM (
    SELECT *, sum(gap + size) OVER (PARTITION BY doc_id, "order" ORDER BY place) - size AS first FROM sized)),
judged AS (
  SELECT *, {levels} AS suppressed FROM placed
  WINDOW earlier AS (PARTITION BY doc_id ORDER BY first, last DESC, priority, "order"
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
found AS (
  SELECT doc_id, sum(base::INT) AS n_base, min(CASE WHEN base THEN first END) AS first_word,
         max(CASE WHEN base THEN first END) AS last_word,
         array_to_string(list_sort(list_distinct(list(label) FILTER (base))), ',') AS base_labels,
         array_to_string(list_sort(list_distinct(list(label) FILTER (base OR NOT suppressed))), ',') AS labels,
         max(CASE WHEN base OR NOT suppressed THEN {sure} END) AS score
  FROM judged GROUP BY doc_id)
SELECT l.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM listed l LEFT JOIN found f ON l.doc_id = f.doc_id"""

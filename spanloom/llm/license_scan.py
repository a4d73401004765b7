"""License scans: an exact set-similarity join of text blocks with notice templates.

A block is a line of the text, or what stands around a line break: as many words
before it and after it, over further breaks, as the longest template has, less one,
so a notice wrapped over lines lies in one block whole. A block's set is its distinct
words. A template is found in a block that holds at least ``threshold`` of the
template's distinct words.
Words are ordered globally by rising document frequency, counted over all
documents. In that order:

* prefix filter - a block that meets the threshold must hold one of the first
  ``|T| - need + 1`` words of template T, so an inverted index of these prefixes
  gives all candidates;
* length filter - the block must have at least ``need`` template words;
* positional filter - from the first common word on, both sides must still have
  ``need`` words left.

Candidates are verified by the exact overlap. Beside this, base phrases are
looked up word by word. Everything is DataFrame expressions within the row: the
only exchange carries one count per template word. Templates are laid into the plan
in groups of about ``most_words`` words, so any number of them can be looked up.

Defined cases: a null text is empty; a text without words has 0 words, null
positions, empty labels and score 0; rows with repeated or null ids are scanned
each for itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textops import SQL_LOWER, WORD_RE, ascii_lower

#: Phrase and label; fixed values.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

#: Notice sentences of public licenses and their labels; fixed values.
TEMPLATES = [
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("licensed under cc by nc 4 0", "cc-by"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]
THRESHOLD = 0.8
#: Template words that one look-up lays into the plan; larger template sets are looked up in groups.
MOST_TEMPLATE_WORDS = 500


def _need(n: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * n - 1e-9))


def _array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _phrase_starts(words: Column, phrase: str) -> Column:
    """All starts at which the phrase's words stand one after another."""
    parts = phrase.split()
    last = F.size(words) - len(parts)

    def here(i: Column) -> Column:
        hit = F.get(words, i) == parts[0]
        for j, p in enumerate(parts[1:], 1):
            hit = hit & (F.get(words, i + j) == p)
        return hit

    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), here)).otherwise(F.array().cast("array<int>"))


def template_groups(templates, most: int) -> list[list[tuple[list[str], str]]]:
    """The templates' word sets with labels, in groups of about ``most`` different words; a larger one is a group of its own."""
    groups: list[list[tuple[list[str], str]]] = []
    held: set[str] = set()
    for text, label in templates:
        words = sorted(set(text.split()))
        if not groups or len(held | set(words)) > most:
            groups.append([])
            held = set()
        groups[-1].append((words, label))
        held |= set(words)
    return groups


def _blocks(with_words: DataFrame, reach: int) -> Column:
    """The blocks' words: lines, and what stands around the line breaks."""
    lines = F.transform(F.split("low", "\n"), lambda line: F.regexp_extract_all(line, F.lit(WORD_RE), F.lit(0)))
    # a break's place among words and breaks, less the breaks before it, is the number of words before it
    tokens = F.regexp_extract_all("low", F.lit(WORD_RE + r"|\n"), F.lit(0))
    places = F.filter(F.transform(tokens, lambda x, i: F.when(x == "\n", i)), lambda i: i.isNotNull())
    before = F.array_distinct(F.transform(places, lambda i, k: i - k))
    around = F.transform(before, lambda p: F.slice("words", F.greatest(p - reach, F.lit(0)) + 1, F.least(p, F.lit(reach)) + reach))
    return F.concat(lines, around)


def _frequencies(with_words: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many documents each template word stands; a row for each at most."""
    counted = with_words.select(F.explode(F.array_intersect("words", _array(vocabulary))).alias("word")).groupBy("word").count()
    return {r["word"]: r["count"] for r in counted.collect()}


def _look_up(joined: DataFrame, with_words: DataFrame, group: list[tuple[list[str], str]], threshold: float, reach: int, out: str) -> DataFrame:
    """joined with ``out``: label and share of every template of the group that a block contains."""
    vocabulary = sorted({w for words, _ in group for w in words})
    frequency = _frequencies(with_words, vocabulary)
    order = sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}

    # per template: its ranks in global order, what it needs, and the index of prefixes
    ranked = [(sorted(rank[w] for w in words), label, _need(len(words), threshold)) for words, label in group]
    index: dict[int, list[int]] = {}
    for t, (ranks, _, need) in enumerate(ranked):
        for r in ranks[: len(ranks) - need + 1]:
            index.setdefault(r, []).append(t)
    prefix_words = [order[r] for r in sorted(index)]

    rank_map = F.create_map(*[x for w in order for x in (F.lit(w), F.lit(rank[w]))])
    entries = [F.struct(F.lit(label).alias("label"), F.array(*[F.lit(r) for r in ranks]).alias("ranks"), F.lit(need).alias("need")) for ranks, label, need in ranked]
    index_map = F.create_map(*[x for r, ts in sorted(index.items()) for x in (F.lit(r), F.array(*[F.lit(t) for t in ts]))])
    least = min(need for _, _, need in ranked)
    ranks_of = lambda words: F.array_sort(F.transform(F.array_intersect(words, _array(order)), lambda w: rank_map[w]))
    own = F.array_distinct(F.filter(F.transform(_blocks(with_words, reach), ranks_of), lambda b: F.size(b) >= least))

    def candidates(b: Column) -> Column:
        """Templates with a prefix word in the block."""
        known = F.filter(b, lambda r: F.array_contains(F.map_keys(index_map), r))
        return F.array_distinct(F.flatten(F.transform(known, lambda r: index_map[r])))

    def verified(b: Column, t: Column) -> Column:
        """Containment of template t in block b, or null below the threshold."""
        entry = F.get(F.col("templates"), t)
        shared = F.array_intersect(b, entry["ranks"])
        first = F.array_min(shared)
        behind = lambda x: F.size(x) - F.array_position(x, first).cast("int") + 1
        left = F.least(behind(b), behind(entry["ranks"]))
        fits = (F.size(b) >= entry["need"]) & (left >= entry["need"]) & (F.size(shared) >= entry["need"])
        return F.when(fits, F.struct(entry["label"].alias("label"), (F.size(shared) / F.size(entry["ranks"])).alias("share")))

    found = F.transform("blocks", lambda b: F.filter(F.transform(candidates(b), lambda t: verified(b, t)), lambda x: x.isNotNull()))
    maybe = F.arrays_overlap("words", _array(prefix_words))
    return (
        joined.withColumn("maybe", maybe)
        .withColumn("blocks", F.when(F.col("maybe"), own).otherwise(F.array().cast("array<array<int>>")))
        .withColumn("templates", F.array(*entries))
        .withColumn(out, F.when(F.size("blocks") > 0, F.flatten(found)).otherwise(F.array().cast(_HITS)))
        .drop("maybe", "blocks", "templates")
    )


_HITS = "array<struct<label:string,share:double>>"


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", most_words: int = MOST_TEMPLATE_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    base = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(F.col(text_col)).alias("low"))
    with_words = base.select("doc_id", "low", F.regexp_extract_all("low", F.lit(WORD_RE), F.lit(0)).alias("words"))
    reach = max((len(t.split()) for t, _ in templates), default=1) - 1
    joined, columns = with_words, []
    for i, group in enumerate(template_groups(templates, most_words)):
        columns.append(f"hits{i}")
        joined = _look_up(joined, with_words, group, threshold, reach, columns[-1])
    joined = joined.withColumn("hits", F.concat(*columns) if columns else F.array().cast(_HITS))
    none = F.array().cast("array<int>")
    starts = [F.when(F.array_contains("words", phrase.split()[0]), _phrase_starts(F.col("words"), phrase)).otherwise(none) for phrase, _ in phrases]
    with_base = joined.withColumn("places", F.array(*starts))
    n_base = F.aggregate("places", F.lit(0).cast("long"), lambda a, x: a + F.size(x))
    every = F.flatten("places")
    labels = [F.when(F.size(F.get("places", F.lit(i))) > 0, F.lit(label)) for i, (_, label) in enumerate(phrases)]
    base_labels = F.filter(F.array(*labels), lambda x: x.isNotNull())
    joined_up = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    share = F.coalesce(F.array_max(F.transform("hits", lambda h: h["share"])), F.lit(0.0))
    return with_base.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        n_base.alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        joined_up(base_labels).alias("base_labels"),
        joined_up(F.concat(base_labels, F.transform("hits", lambda h: h["label"]))).alias("labels"),
        F.when(n_base > 0, F.lit(1.0)).otherwise(share).alias("score"),
    )


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    phrase_rows = ", ".join(f"({i}, {p.split()!r}, '{label}')" for i, (p, label) in enumerate(PHRASES))
    template_rows = ", ".join(f"({i}, {sorted(set(t.split()))!r}, '{label}')" for i, (t, label) in enumerate(TEMPLATES))
    reach = max(len(t.split()) for t, _ in TEMPLATES) - 1
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {SQL_LOWER} AS low FROM documents),
w AS (SELECT rid, doc_id, low, regexp_extract_all(low, '{WORD_RE}') AS words FROM d),
phrases(p, parts, label) AS (VALUES {phrase_rows}),
templates(t, parts, label) AS (VALUES {template_rows}),
places AS (
  SELECT rid, label, unnest(list_filter(range(0, len(words) - len(parts) + 1), lambda i: words[i + 1 : i + len(parts)] = parts)) AS i
  FROM w, phrases WHERE list_contains(words, parts[1])
),
base AS (SELECT rid, count(*) AS n, min(i) AS lo, max(i) AS hi, list(DISTINCT label) AS labels FROM places GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(low, chr(10))) AS line FROM d),
tokens AS (SELECT rid, regexp_extract_all(low, '{WORD_RE}|\\n') AS t FROM d),
breaks AS (
  SELECT rid, unnest(list_distinct(list_transform(list_filter(range(1, len(t) + 1), lambda i: t[i] = chr(10)), lambda i, k: i - k))) AS p
  FROM tokens WHERE list_contains(t, chr(10))
),
sets AS (
  SELECT rid, list_distinct(regexp_extract_all(line, '{WORD_RE}')) AS b FROM lines
  UNION ALL SELECT rid, list_distinct(words[greatest(p - {reach}, 0) + 1 : greatest(p - {reach}, 0) + least(p, {reach}) + {reach}]) FROM breaks JOIN w USING (rid)
),
found AS (
  SELECT rid, label, len(list_intersect(b, parts)) AS shared, len(parts) AS size FROM sets, templates
  WHERE len(list_intersect(b, parts)) >= greatest(1, ceil({THRESHOLD} * len(parts) - 1e-9))
),
method AS (SELECT rid, list(DISTINCT label) AS labels, max(CAST(shared AS DOUBLE) / size) AS share FROM found GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base,
  CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(method.labels, [])))), ','), '') AS labels,
  CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM w LEFT JOIN base USING (rid) LEFT JOIN method USING (rid)
"""


OP3_SQL = _sql()

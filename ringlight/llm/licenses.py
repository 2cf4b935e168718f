"""Operator 4: license scans by an exact set-similarity join, in DataFrame operations alone.

A block is a run of 2 * ``half`` words of the whole text, one every ``half`` words, whatever the lines; the last ones
end with the text. So any ``half`` + 1 words in a row lie whole in a block, in a long line as over several lines. A
block meets a template if it holds at least ``CONTAINMENT`` of the template's distinct words; nothing else is asked
of it. The templates' words are ordered by their frequency in the corpus (one count over all documents), rarest
first. Prefix filter: a block that meets a template of n words, k of them needed, holds one of its n - k + 1 rarest
words; only blocks with such a word are made, and each asks the inverted prefix index for the templates of its words.
Length filter: it has k distinct words or more. Positional filter: the prefix words that it holds and all words past
the prefix make k together. What is left is verified by counting all shared words.

The index of prefixes is a literal of the plan, as templates are few and given by the caller (``MOST_TEMPLATES``, else
ValueError). So the join takes place within each row: no text, block or candidate is ever shuffled, and a lost task
repeats its own rows. ``half`` is 32, or the words of the longest template if these are more.

Null and empty texts have no words, no labels and score 0. Repeated rows and repeated or null ids each give a row;
other columns are not read, whatever their names; an empty table gives an empty one. Ties in frequency go by the
word. Texts of any length go through the same steps."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

CONTAINMENT, HALF, MOST_TEMPLATES = 0.8, 32, 1000
#: What separates words of lower-cased text.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Base phrases and their labels; places are counted by their first word, so no two phrases may begin alike.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: A word of each phrase that a text must hold for a closer look.
TELLING = ("cc", "public", "reserved")

#: Notices in common use and their labels.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "Copyright. All rights reserved"),
)


def template_list(text: str) -> list[str]:
    return [w for w in re.split(SEPARATORS, text.translate(str.maketrans(UPPER, LOWER))) if w]


def template_words(text: str) -> list[str]:
    return sorted(set(template_list(text)))


def needed(n: int) -> int:
    """Words of n that a block must hold: the least k with k / n >= CONTAINMENT."""
    return next(k for k in range(1, n + 1) if k / n >= CONTAINMENT)


def words_of(text: Column) -> Column:
    """Words with A-Z in lower case. ``lower`` does the same for ASCII texts, in a fraction of the time."""
    plain = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.split(plain, SEPARATORS), lambda w: w != "")


def literal(words: list[str]) -> Column:
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def frequencies(words: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Documents with each word of the templates: a row for each word at most."""
    return {r[0]: r[1] for r in words.select(F.explode(F.array_intersect("words", literal(vocabulary))).alias("w")).groupBy("w").count().collect()}


def _matches(words: Column, sets: list[tuple[str, list[str]]], often: dict[str, int], half: int) -> Column:
    """Array of (label, template, containment) of the templates that blocks of ``words`` meet, sorted."""
    templates, postings = [], {}
    for i, (label, s) in enumerate(sets):
        ordered, k = sorted(s, key=lambda w: (often.get(w, 0), w)), needed(len(s))
        prefix = ordered[: len(s) - k + 1]
        templates.append(F.struct(F.lit(label).alias("label"), F.lit(i).alias("template"), literal(prefix).alias("prefix"), literal(ordered).alias("ordered"), F.lit(len(s)).alias("n"), F.lit(k).alias("k")))
        for w in prefix:
            postings.setdefault(w, []).append(i)
    rare = literal(sorted(postings))
    index = F.create_map(*[x for w in sorted(postings) for x in (F.lit(w), F.array(*map(F.lit, postings[w])))])
    # Blocks are named by their first word's place / half; a prefix word lies in the block that begins in its half and the one before.
    places = F.array_distinct(F.array_compact(F.transform(words, lambda w, i: F.when(F.array_contains(rare, w), F.floor(i / half).cast("int")))))
    starts = F.filter(F.array_distinct(F.flatten(F.transform(places, lambda j: F.array(j - 1, j)))), lambda j: j >= 0)
    blocks = F.transform(starts, lambda j: F.array_distinct(F.slice(words, j * half + 1, 2 * half)))

    def met(block: Column) -> Column:
        candidates = F.array_distinct(F.flatten(F.transform(F.array_intersect(block, rare), lambda w: F.try_element_at(index, w))))
        named = F.transform(candidates, lambda i: F.get(F.array(*templates), i))
        possible = F.filter(named, lambda t: (F.size(block) >= t["k"]) & (F.size(F.array_intersect(t["prefix"], block)) + t["n"] - F.size(t["prefix"]) >= t["k"]))
        counted = F.transform(possible, lambda t: F.struct(t["label"].alias("label"), t["template"].alias("template"), (F.size(F.array_intersect(t["ordered"], block)) / t["n"]).alias("containment"), t["k"].alias("k"), t["n"].alias("n")))
        return F.transform(F.filter(counted, lambda t: t["containment"] >= t["k"] / t["n"]), lambda t: F.struct(t["label"].alias("label"), t["template"].alias("template"), t["containment"].alias("containment")))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(blocks, met))))


def _best(found: Column) -> Column:
    """Of sorted matches, whose containments ascend within a template, the last of each template."""
    return F.filter(found, lambda m, i: F.coalesce(F.get(found, i + 1)["template"] != m["template"], F.lit(True)))


def scan(documents: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and ``matches``: an array of
    (label, template, containment) of every template that a block meets, with the best containment."""
    sets = [(label, template_words(t)) for label, t in templates if template_words(t)]
    if not sets:
        raise ValueError("no template has a word")
    if len(sets) > MOST_TEMPLATES:
        raise ValueError(f"{len(sets)} templates; the plan holds {MOST_TEMPLATES} at most")
    half = max([HALF, *(len(template_list(t)) for _, t in templates)])
    docs = documents.select(F.col(doc_id).alias("doc_id"), words_of(F.coalesce(F.col(text), F.lit(""))).alias("words"))
    often = frequencies(docs, sorted({w for _, s in sets for w in s}))
    rare = sorted({w for _, s in sets for w in sorted(s, key=lambda w: (often.get(w, 0), w))[: len(s) - needed(len(s)) + 1]})

    w = F.col("words")
    def base_at(x: Column, i: Column) -> Column:
        out = F.lit(None).cast("string")
        for phrase, label in PHRASES.items():
            first, *rest = phrase.split()
            out = F.when(reduce(lambda a, b: a & b, [F.get(w, i + k + 1) == y for k, y in enumerate(rest)], x == first), label).otherwise(out)
        return F.when(out.isNotNull(), F.struct(i.cast("long").alias("at"), out.alias("label")))

    nothing = F.array()
    held = docs.select("doc_id", w, F.arrays_overlap(w, literal(list(TELLING))).alias("telling"), F.arrays_overlap(w, literal(rare)).alias("rare"))
    looked = held.select(
        "doc_id", F.size(w).cast("long").alias("n_words"),
        F.when(F.col("telling"), F.array_compact(F.transform(w, base_at))).otherwise(nothing.cast("array<struct<at:bigint,label:string>>")).alias("base"),
        F.when(F.col("rare"), _matches(w, sets, often, half)).otherwise(nothing.cast("array<struct<label:string,template:int,containment:double>>")).alias("found"),
    )
    looked = looked.withColumn("matches", _best(F.col("found")))
    base = F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"])))
    n_base = F.size("base").cast("long")
    labels = F.array_sort(F.array_union(base, F.transform("matches", lambda m: m["label"])))
    score = F.greatest(F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)), F.when(n_base > 0, 1.0).otherwise(0.0))
    first, last = F.get("base", F.lit(0))["at"], F.get("base", F.size("base") - 1)["at"]
    return looked.select("doc_id", "n_words", n_base.alias("n_base"), first.alias("first_word"), last.alias("last_word"), F.array_join(base, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"), "matches")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents")).drop("matches")


def _values() -> str:
    rows = [f"({i}, '{label}', ['{"','".join(template_words(t))}'], {needed(len(template_words(t)))})" for i, (label, t) in enumerate(TEMPLATES)]
    return ", ".join(rows)


SQL = rf"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM d),
e AS (SELECT doc_id, unnest(words) AS a, generate_subscripts(words, 1) - 1 AS i FROM w),
s AS (SELECT doc_id, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM e WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h AS (SELECT doc_id, i, CASE WHEN a = 'cc' AND b = 'by' THEN 'cc-by' WHEN a = 'general' AND b = 'public' AND c = 'license' THEN 'gpl'
             WHEN a = 'all' AND b = 'rights' AND c = 'reserved' THEN 'reserved' END AS label FROM s),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list(DISTINCT label)) AS labels
         FROM h WHERE label IS NOT NULL GROUP BY doc_id),
blocks AS (SELECT doc_id, list_distinct(words[j + 1 : j + {2 * HALF}]) AS block
           FROM (SELECT doc_id, words, unnest(range(0, len(words), {HALF})) AS j FROM w)),
templates(template, label, words, k) AS (VALUES {_values()}),
m AS (SELECT doc_id, label, len(list_intersect(block, words)) AS shared, len(words) AS n, k
      FROM blocks JOIN templates ON len(block) >= k),
met AS (SELECT doc_id, list(DISTINCT label) AS labels, max(shared / n) AS containment FROM m WHERE shared >= k GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(array_to_string(base.labels, ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(met.labels, [])))), ',') AS labels,
       greatest(CASE WHEN n_base > 0 THEN 1e0 ELSE 0e0 END, coalesce(containment, 0e0)) AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN met USING (doc_id)
"""

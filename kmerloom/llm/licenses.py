"""Operator 6: license scans by an exact set-similarity join of text blocks with license templates.

A template is the set of the words of a license notice. A block is any run of consecutive words of a text, over lines and
comment marks, that is ``SPAN`` times as long as the notice; it matches if it holds at least ``threshold`` of the
template's words. So a notice is found however it is wrapped, and words scattered over a long text are none.

A text holds its blocks, so only texts that hold enough of a template's words can have a block that does. These are found
without comparing every text with every template: template words get one global order, rarest first by the number of
texts that hold them. A match shares a word within the first ``|t| - need + 1`` words of the template and the
first ``|b| - need + 1`` words of the text (prefix filter), the text has at least ``need`` template words
(length filter), and what is left after the shared word on either side must reach ``need`` (positional
filter). Candidates are counted exactly, and then the blocks of those that are left.

Beside it stand the base phrases: places where a phrase's words follow one another.

All of it is DataFrame and SQL work; each text is scanned once. The joined side with the templates is a fixed
list of this module, so its broadcast has a fixed size.

Defined results: a null text is the empty text and has no words, no labels and score 0. Rows with equal ids
are kept apart. Other columns are not read.
"""

from __future__ import annotations

import re
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import written

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# The notices that licenses ask for, by label.
TEMPLATES = {
    "agpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "apache": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "boost": "Distributed under the Boost Software License, Version 1.0.",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "all-rights-reserved": "Copyright. All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
    "ofl": "This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is available with a FAQ at http://scripts.sil.org/OFL",
    "gfdl": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License",
    "epl": "This program and the accompanying materials are made available under the terms of the Eclipse Public License",
    "zlib": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "cc-by-nd": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
}
#: The share of a template's words that a block holds, and a block's words for each word of the notice.
THRESHOLD, SPAN = 0.8, 1.5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The letters beyond ASCII whose lower case begins with an ASCII letter, and one that stands for them.
TO_ASCII, OTHER = ("\u0130", "\u212a"), "\ue000"


def words_of(text: str) -> list[str]:
    """The words of a text of this module."""
    return [w for w in re.split(SEPARATORS, text.translate(str.maketrans(UPPER, LOWER))) if w]


def template_sets(templates: dict[str, str]) -> dict[str, list[str]]:
    return {label: list(dict.fromkeys(words_of(text))) for label, text in templates.items()}


def template_spans(templates: dict[str, str]) -> dict[str, int]:
    """The words of a block for each template."""
    return {label: ceil(SPAN * len(words_of(text))) for label, text in templates.items()}


def _strings(words: list[str]) -> Column:
    return F.array(*map(F.lit, words)).cast("array<string>")


def _count(haystack: Column, needle: str) -> Column:
    return ((F.length(haystack) - F.length(F.replace(haystack, F.lit(needle), F.lit("")))) / len(needle)).cast("long")


def lowered(text: Column) -> Column:
    """The text with A-Z in lower case. Other letters may change too, but only to letters that stand for none of
    ASCII, so the words' limits and all ASCII words are as if A-Z alone had changed. translate() would do only
    that, at several times the cost."""
    out = F.coalesce(text, F.lit(""))
    for x in TO_ASCII:
        out = F.replace(out, F.lit(x), F.lit(OTHER))
    return F.lower(out)


def scanned(documents: DataFrame, vocabulary: list[str], doc_id: str, text: str, phrases: dict[str, str]) -> DataFrame:
    """One pass over the texts: word counts, phrase places, and the places of words that any template has, with the words."""
    # Each word gets a space on either side of its own, so phrases that follow one another share none.
    d = documents.select(F.col(doc_id).alias("doc_id"), lowered(F.col(text)).alias("lower")).select("*", F.trim(F.regexp_replace("lower", SEPARATORS, "  ")).alias("joined"))
    d = d.select("*", F.when(F.col("joined") == "", F.lit("")).otherwise(F.concat(F.lit(" "), F.col("joined"), F.lit(" "))).alias("padded"))
    padded, spaces = F.col("padded"), lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    n_words = (spaces(padded) / 2).cast("long")
    counts, firsts, lasts = [], [], []
    for phrase in phrases:
        needle = f" {'  '.join(phrase.split())} "
        here = padded.contains(needle)
        counts.append(F.when(here, _count(padded, needle)).otherwise(F.lit(0).cast("long")))
        firsts.append(F.when(here, (spaces(F.substring_index(padded, needle, 1)) / 2).cast("long")))
        lasts.append(F.when(here, n_words - (spaces(F.substring_index(padded, needle, -1)) / 2).cast("long") - len(phrase.split())))
    words = F.split(F.col("joined"), "  ")
    held = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda x: x["word"].isin(vocabulary))
    labels = F.array_compact(F.array(*(F.when(n > 0, F.lit(label)) for n, label in zip(counts, phrases.values(), strict=True))))
    return d.select(
        F.monotonically_increasing_id().alias("row_"), "doc_id", n_words.alias("n_words"), sum(counts[1:], counts[0]).alias("n_base"), F.least(*firsts).alias("first_word") if len(firsts) > 1 else firsts[0].alias("first_word"),
        (F.greatest(*lasts) if len(lasts) > 1 else lasts[0]).alias("last_word"), F.array_sort(F.array_distinct(labels)).alias("base"), held.alias("held"))


def _values(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    text = lambda x: str(x) if isinstance(x, int) else f"'{x}'" if isinstance(x, str) else f"array({', '.join(map(text, x))})"
    return spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)} AS t({names})")


def containment_join(blocks: DataFrame, templates: dict[str, str], threshold: float = THRESHOLD) -> DataFrame:
    """(keys of blocks, label, containment) of every block and template that match.

    ``blocks`` has key columns and ``words``, the block's distinct words that any template has.
    """
    spark, sets, keys = blocks.sparkSession, template_sets(templates), [c for c in blocks.columns if c != "words"]
    needs = {label: max(1, ceil(round(threshold * len(t), 9))) for label, t in sets.items()}
    least = min(needs.values())
    blocks = blocks.where(F.size("words") >= least)
    # One row for each template word at most.
    held = {r["word"]: r["n"] for r in blocks.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    order = sorted({w for t in sets.values() for w in t}, key=lambda w: (held.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    ordered = {label: sorted(t, key=rank.__getitem__) for label, t in sets.items()}
    prefixes = [(w, label, k + 1, len(t), needs[label]) for label, t in ordered.items() for k, w in enumerate(t[: len(t) - needs[label] + 1])]
    whole = _values(spark, [(label, t) for label, t in ordered.items()], "label, template")
    probes = _values(spark, prefixes, "word, label, t_at, t_size, need")
    first_words = [w for w in order if any(w == p[0] for p in prefixes)]
    b = blocks.withColumn("words", F.array_intersect(_strings(order), F.col("words")))  # now in the global order
    probed = b.withColumn("word", F.explode(F.array_intersect(_strings(first_words), F.col("words"))))
    candidates = probed.join(F.broadcast(probes), "word")
    b_at, b_size = F.array_position("words", F.col("word")), F.size("words")
    candidates = candidates.where((b_size >= F.col("need")) & (b_at <= b_size - F.col("need") + 1) & (1 + F.least(F.col("t_size") - F.col("t_at"), b_size - b_at) >= F.col("need")))
    overlap = F.size(F.array_intersect("words", "template"))
    found = candidates.join(F.broadcast(whole), "label").where(overlap >= F.col("need"))
    return found.select(*keys, "label", (overlap / F.col("t_size")).alias("containment")).distinct()


def holding_blocks(candidates: DataFrame, held: DataFrame, templates: dict[str, str], threshold: float = THRESHOLD) -> DataFrame:
    """(row_, label, containment): of candidates (row_, label) those that have a matching block, with the largest containment of any.

    ``held`` has (row_, held), the places of template words in each text. A block begins at one of its template's words; from there
    on it is looked at over as many places as it has words, so the work grows with the length of a candidate's text.
    """
    sets, spans = template_sets(templates), template_spans(templates)
    known = _values(candidates.sparkSession, [(label, t, len(t), max(1, ceil(round(threshold * len(t), 9))), spans[label]) for label, t in sets.items()], "label, template, t_size, need, span")
    rows = held.join(candidates.select("row_", "label"), "row_").join(F.broadcast(known), "label")
    own = rows.select("row_", "label", "t_size", "need", "span", F.explode(F.filter("held", lambda x: F.array_contains("template", x["word"]))).alias("x"))
    ahead = F.collect_list("x").over(Window.partitionBy("row_", "label").orderBy("x.at").rowsBetween(0, max(spans.values()) - 1))
    blocks = own.withColumn("ahead", ahead).withColumn("n", F.size(F.array_distinct(F.transform(F.filter("ahead", lambda y: y["at"] < F.col("x.at") + F.col("span")), lambda y: y["word"]))))
    return blocks.where("n >= need").groupBy("row_", "label").agg(F.max(F.col("n") / F.col("t_size")).alias("containment"))


def scan_licenses(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    The score is the largest containment found, and 1 where a base phrase stands.
    """
    vocabulary = list(dict.fromkeys(w for t in template_sets(templates).values() for w in t))
    docs = written(scanned(documents, vocabulary, doc_id, text, phrases), "scanned")
    texts = docs.select("row_", F.array_distinct(F.transform("held", lambda x: x["word"])).alias("words"))
    blocks = holding_blocks(containment_join(texts, templates, threshold), docs.select("row_", "held"), templates, threshold)
    found = blocks.groupBy("row_").agg(F.collect_set("label").alias("found"), F.max("containment").alias("most"))
    joined = docs.drop("held").join(found, "row_", "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("most", F.lit(0.0))).alias("score"))


def scan_licenses_sql(templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD) -> str:
    """The same in DuckDB SQL, every text against every template."""
    words = r"list_filter(regexp_split_to_array({}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
    lower = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    rows = ", ".join(f"('{label}', {quoted(t)}, {len(t)}, {max(1, ceil(round(threshold * len(t), 9)))}, {template_spans(templates)[label]})" for label, t in template_sets(templates).items())
    places = " UNION ALL ".join(f"SELECT rid, i - 1 AS word_at, '{label}' AS label FROM places WHERE ws[i:i + {len(p.split()) - 1}] = {quoted(p.split())}" for p, label in phrases.items())
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {lower} AS low FROM documents),
worded AS (SELECT rid, doc_id, low, {words.format('low')} AS ws FROM docs),
places AS (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS i FROM worded WHERE contains(low, 'license') OR contains(low, 'cc')),
base AS ({places}),
bases AS (SELECT rid, count(*) AS n_base, min(word_at) AS first_word, max(word_at) AS last_word, list_sort(list_distinct(list(label))) AS labels FROM base GROUP BY rid),
templates(label, t, size, need, span) AS (VALUES {rows}),
distinct_words AS (SELECT rid, list_distinct(ws) AS b FROM worded),
able AS (SELECT rid, label, t, size, need, span FROM distinct_words, templates WHERE len(b) >= need AND len(list_intersect(b, t)) >= need),
starts AS (SELECT rid, label, t, size, need, span, ws, unnest(list_filter(range(1, len(ws) + 1), lambda i: list_contains(t, ws[i]))) AS i FROM able JOIN worded USING (rid)),
blocks AS (SELECT rid, label, size, need, len(list_intersect(list_distinct(ws[i:i + span - 1]), t)) AS n FROM starts),
matched AS (SELECT rid, label, n / size AS containment FROM blocks WHERE n >= need),
found AS (SELECT rid, list(DISTINCT label) AS labels, max(containment) AS most FROM matched GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, array_to_string(coalesce(bases.labels, []), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(bases.labels, []), coalesce(found.labels, [])))), ',') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(most, 0)::DOUBLE END AS score
FROM worded LEFT JOIN bases USING (rid) LEFT JOIN found USING (rid)"""

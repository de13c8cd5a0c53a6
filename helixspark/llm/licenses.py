"""Licence scans by a positional rare-token index. DataFrame operations only.

A template is a passage of a licence (some words in a row) with mandatory key phrases at fixed places of it. The words of
all passages are the licence words. How rare each is (IDF) is counted over every text of the corpus, and decides in what
order a template's words are looked up.

A text's licence words, with their places, are its postings. For every template, the place of its rarest mandatory word
says where the passage would have to start; a text without that word is done with the template there. The starts that the
next words imply, rarest first, are intersected with what is left, by relative position. What outlives the last word of the
mandatory phrases is an occurrence: the phrases stand there, word for word. The other words of the passage, looked up the
same way, tell what share of the passage (by IDF) stands around the occurrences: the score.

A text takes part only if it holds one of the marks, a word of each template that no occurrence can lack. Postings are
arrays of places and intersections are by hash, so a text's work grows with its length and not with its repeats. All of it
happens within a row; only the words' document counts (a bounded table) are shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialize, table

#: The phrases of the base labels; all their words are mandatory.
BASE = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
#: Labels that the method adds: a passage of the licence, and its mandatory phrases.
OWN = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["hereby granted free of charge", "person obtaining a copy"]),
    ("mit", "the software is provided as is without warranty of any kind express or implied", ["software is provided as is", "without warranty of any kind"]),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["licensed under the apache license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use", "source and binary forms"]),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license"]),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license version 2 0", ["mozilla public license version 2 0"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-nc", "licensed under cc by nc sa 4 0", ["cc by nc sa"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify", "for any purpose"]),
    ("proprietary", "copyright the authors all rights reserved", ["all rights reserved"]),
]
#: A word: what is no ASCII character but a digit or a small letter.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _templates() -> list[tuple[str, list[str], list[int], bool]]:
    """(label, words of the passage, places of the mandatory ones, whether it is a base phrase)."""
    out = [(label, phrase.split(), list(range(len(phrase.split()))), True) for label, phrase in BASE]
    for label, passage, phrases in OWN:
        words, must = passage.split(), []
        for phrase in phrases:
            part = phrase.split()
            at = next(i for i in range(len(words)) if words[i : i + len(part)] == part)
            must += range(at, at + len(part))
        out.append((label, words, must, False))
    return out


def _vocabulary() -> list[str]:
    return sorted({w for _, words, _, _ in _templates() for w in words})


def _marks() -> list[str]:
    """Of each template's mandatory words the longest: ordinary prose mostly lacks it."""
    return sorted({max((words[i] for i in must), key=len) for _, words, must, _ in _templates()})


def _index(idf: dict[str, float]) -> Column:
    """The templates: slots (word's code, place in the passage, IDF) of the mandatory words, rarest first, and of all words."""
    code = {w: i + 1 for i, w in enumerate(_vocabulary())}
    slot = lambda words, i: F.struct(F.lit(code[words[i]]).alias("code"), F.lit(i).alias("offset"), F.lit(idf[words[i]]).alias("idf"))
    each = []
    for t, (label, words, must, base) in enumerate(_templates()):
        order = sorted(must, key=lambda i: (-idf[words[i]], i))
        each.append(F.struct(F.lit(t).alias("template"), F.lit(label).alias("label"), F.lit(" ".join(words[min(must) : max(must) + 1])).alias("phrase"), F.lit(min(must)).alias("lead"), F.lit(base).alias("base"), F.array(*(slot(words, i) for i in order)).alias("must"), F.array(*(slot(words, i) for i in range(len(words)))).alias("all"), F.lit(sum(idf[w] for w in words)).alias("total")))
    return F.array(*each)


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches.

    n_base: all places where a base phrase's words stand consecutively; first_word and last_word: the least and the
    greatest start of those, null if there is none. matches: (label, phrase, start) of all occurrences, base and own; start
    is that of the first mandatory phrase. score: of the templates that occur, the greatest share of a passage's IDF that
    stands around the occurrences; 1 where a base phrase occurs, 0 without an occurrence.
    A null or empty text has no words, no labels and score 0. Null ids stay; repeated rows are scanned one by one. Other
    columns are left out. An empty table gives an empty table.
    """
    known, marks = F.array(*map(F.lit, _vocabulary())), F.array(*map(F.lit, _marks()))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))
    present = F.array_intersect(known, words)
    hits = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("at"), F.array_position(known, w).cast("int").alias("code"))), lambda x: x["code"] > 0)
    held = materialize(df.select(F.col(id_col).alias("_id"), F.size(words).cast("long").alias("_n"), present.alias("_present"), F.when(F.arrays_overlap(present, marks), hits).alias("_hits")))
    starts = lambda s: F.transform(F.filter("_hits", lambda h: h["code"] == s["code"]), lambda h: h["at"] - s["offset"])
    # the rarest word's postings, then those of the others, as long as something is left
    occur = lambda t: F.aggregate(F.slice(t["must"], 2, F.size(t["must"])), starts(F.get(t["must"], 0)), lambda left, s: F.when(F.size(left) == 0, left).otherwise(F.array_intersect(left, starts(s))))
    each = F.filter(F.transform(_index(_idf(held)), lambda t: F.struct(t.alias("t"), occur(t).alias("starts"))), lambda x: F.size(x["starts"]) > 0)
    share = lambda x: F.aggregate(x["t"]["all"], F.lit(0.0), lambda a, s: a + F.when(F.size(F.array_intersect(x["starts"], starts(s))) > 0, s["idf"]).otherwise(0.0)) / x["t"]["total"]
    found = held.select("_id", "_n", F.when(F.col("_hits").isNotNull(), F.transform(each, lambda x: F.struct(x["t"]["label"].alias("label"), x["t"]["phrase"].alias("phrase"), x["t"]["base"].alias("base"), F.transform(x["starts"], lambda s: (s + x["t"]["lead"]).cast("long")).alias("starts"), share(x).alias("share")))).alias("_found"))
    base = F.filter("_found", lambda m: m["base"])
    places = F.flatten(F.transform(base, lambda m: m["starts"]))
    joined = lambda ms: F.coalesce(F.array_join(F.sort_array(F.array_distinct(F.transform(ms, lambda m: m["label"]))), ","), F.lit(""))
    matches = F.flatten(F.transform("_found", lambda m: F.transform(m["starts"], lambda s: F.struct(m["label"].alias("label"), m["phrase"].alias("phrase"), s.alias("start")))))
    return found.select(
        F.col("_id").alias(id_col),
        F.col("_n").alias("n_words"),
        F.greatest(F.size(F.coalesce(places, F.array().cast("array<bigint>"))), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("_found")).alias("labels"),
        F.round(F.least(F.lit(1.0), F.coalesce(F.array_max(F.transform("_found", lambda m: m["share"])), F.lit(0.0))), 6).alias("score"),
        F.coalesce(matches, F.array().cast("array<struct<label: string, phrase: string, start: bigint>>")).alias("matches"),
    )


def _idf(held: DataFrame) -> dict[str, float]:
    """Each licence word's IDF over all texts: as many entries as the templates have words."""
    counts = {r["word"]: r["n"] for r in held.select(F.explode("_present").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    total = held.count()
    return {w: math.log((total + 1) / (counts.get(w, 0) + 0.5)) for w in _vocabulary()}


def op3_sql() -> str:
    """The same result by plain search of every mandatory phrase, in DuckDB."""
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    templates, slots = [], []
    for t, (label, words, must, base) in enumerate(_templates()):
        lead = min(must)
        templates.append(f"({t}, '{label}', {lead}, [{', '.join(str(i - lead) for i in must)}], {quoted([words[i] for i in must])}, {str(base).lower()})")
        slots += [f"({t}, {i - lead}, '{w}')" for i, w in enumerate(words)]
    return f"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM documents),
tm(template, label, lead, offs, must, base) AS (VALUES {", ".join(templates)}),
sl(template, rel, word) AS (VALUES {", ".join(slots)}),
cnt AS (SELECT word, count(*) AS n FROM (SELECT unnest(list_distinct(list_filter(ws, lambda x: list_contains({quoted(_vocabulary())}, x)))) AS word FROM w) GROUP BY word),
idf AS (SELECT word, ln(((SELECT count(*) FROM w) + 1) / (coalesce(n, 0) + 0.5)) AS idf FROM (SELECT DISTINCT word FROM sl) LEFT JOIN cnt USING (word)),
weight AS (SELECT template, sum(idf) AS total FROM sl JOIN idf USING (word) GROUP BY template),
found AS (SELECT rid, template, label, base, ws, unnest(list_filter(range(0, len(ws)), lambda i: list_transform(offs, lambda o: ws[i + o + 1]) = must)) AS start FROM w, tm WHERE list_has_all(ws, must)),
stand AS (SELECT rid, template, sum(idf) AS got FROM (SELECT DISTINCT rid, template, rel, word FROM found JOIN sl USING (template) WHERE start + rel >= 0 AND ws[start + rel + 1] = word) JOIN idf USING (word) GROUP BY rid, template),
best AS (SELECT rid, max(got / total) AS score FROM stand JOIN weight USING (template) GROUP BY rid),
agg AS (SELECT rid, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
               string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
        FROM found GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(least(1.0, coalesce(score, 0.0)), 6)::DOUBLE AS score
FROM w LEFT JOIN agg USING (rid) LEFT JOIN best USING (rid)
"""


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document."""
    return scan_licenses(table(spark, sf_dir)).drop("matches")

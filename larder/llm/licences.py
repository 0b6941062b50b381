"""Licence scan: a positional index of rare licence words, relative positions and mandatory phrases.

Templates are short licence texts. A template is posted under its words of the highest inverse document
frequency among the templates, with their positions. In a file every occurrence of a posted word is looked
up; postings vote for (template, file position - template position). A template is a candidate where enough of its
posted words agree on one relative position, and it is reported if its mandatory phrases occur in the file.
All of it happens inside the row, so nothing is shuffled, and work is n log n in the words of a file.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import array_of, ascii_lower

# Base phrases and their labels.
BASE_PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

# Label, template text, mandatory phrases. Words are separated by one blank.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
     ["free of charge to any person", "this software"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     ["source and binary forms", "with or without modification"]),
    ("gpl", "licensed under the gnu general public license version 3", ["gnu general public license"]),
    ("lgpl", "under the terms of the gnu lesser general public license", ["lesser general public license"]),
    ("agpl", "under the terms of the gnu affero general public license", ["affero general public license"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license",
     ["mozilla public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee",
     ["distribute this software", "with or without fee"]),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     ["unencumbered software", "public domain"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc0", "cc0 1 0 universal public domain dedication", ["cc0", "public domain"]),
]

#: The posted words of a template, and the part of them that has to agree on one relative position.
POSTED, AGREEING = 5, 0.6
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SHIFT = 1 << 32
_BACK = 1000  # keeps relative positions above zero; longer than any template


@dataclass(frozen=True)
class Index:
    """postings: word -> (template, position); need, total: votes asked for and possible; anchors: the rarest mandatory words."""

    postings: dict[str, list[tuple[int, int]]]
    need: list[int]
    total: list[int]
    anchors: list[str]


def build_index(templates=TEMPLATES, posted: int = POSTED, agreeing: float = AGREEING) -> Index:
    texts = [t[1].split() for t in templates]
    counts: dict[str, int] = {}
    for word in (w for words in texts for w in set(words)):
        counts[word] = counts.get(word, 0) + 1
    idf = {w: math.log((1 + len(texts)) / (1 + n)) for w, n in counts.items()}
    postings: dict[str, list[tuple[int, int]]] = {}
    need, total = [], []
    for number, words in enumerate(texts):
        rare = sorted(set(words), key=lambda w: (-idf[w], w))[:posted]
        places = [(w, i) for i, w in enumerate(words) if w in rare]
        for word, place in places:
            postings.setdefault(word, []).append((number, place))
        total.append(len(places))
        need.append(max(1, math.ceil(agreeing * len(places))))
    rarest = lambda phrases: max((w for p in phrases for w in p.split()), key=lambda w: (idf.get(w, 9.0), w))
    return Index(postings, need, total, sorted({rarest(t[2]) for t in templates}))


def _starts(words: Column, phrase: str) -> Column:
    """Places where the words of the phrase stand consecutively."""
    first, *rest = phrase.split()

    def place(word, i):
        here = word == first
        for step, following in enumerate(rest, 1):
            here = here & (F.get(words, i + step) == following)
        return F.when(here, i.cast("long"))

    return F.array_compact(F.transform(words, place))


def _labelled(starts: Column, label: str) -> Column:
    return F.transform(starts, lambda start: F.struct(F.lit(label).alias("label"), start.alias("start")))


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """One row per row of docs: the id, n_words, base (array of label and start), found (array of label and score).

    Null text counts as empty: no words, nothing found. Repeated rows give repeated rows, a null id stays null, an
    empty table gives an empty result, other columns of docs are left out. Labels of several templates (ties) are all given.
    """
    index = build_index(templates)
    vocabulary = sorted(index.postings)
    postings = F.create_map(*[
        x for w in vocabulary
        for x in (F.lit(w), F.array(*[F.lit(t * _SHIFT + _BACK - p).cast("long") for t, p in index.postings[w]]))
    ])
    need, total = array_of(index.need, "int"), array_of(index.total, "int")
    labels = array_of([t[0] for t in templates], "string")
    phrases = F.array(*[array_of([f" {p} " for p in t[2]], "string") for t in templates])
    anchors = sorted(set(index.anchors) | {max(p.split(), key=len) for p, _ in BASE_PHRASES})

    lowered = docs.select(F.col(id_col).alias("id"), ascii_lower(F.col(text_col)).alias("lowered"))
    any_anchor = F.lit(False)
    for word in anchors:
        any_anchor = any_anchor | F.contains("lowered", F.lit(word))
    split = lowered.select("id", any_anchor.alias("anchored"), F.array_remove(F.split("lowered", WORD_BREAK), "").alias("words"))

    # files without an anchor word can hold neither a base phrase nor the phrases of a template
    words = F.col("words")
    base = F.concat(*[_labelled(_starts(words, phrase), label) for phrase, label in BASE_PHRASES])
    votes = F.sort_array(F.flatten(F.array_compact(F.transform(words, lambda w, i: F.when(
        F.array_contains(array_of(vocabulary, "string"), w), F.transform(F.try_element_at(postings, w), lambda p: p + i)
    )))))
    looked = split.select(
        "id", F.size("words").cast("long").alias("n_words"),
        F.when(F.col("anchored"), base).alias("base"),
        F.when(F.col("anchored"), votes).alias("votes"),
        F.when(F.col("anchored"), F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))).alias("joined"),
    )
    # runs of equal votes: their first places, then their lengths
    firsts = looked.withColumn("firsts", F.array_compact(F.transform(
        "votes", lambda v, i: F.when((i == 0) | (F.get("votes", i - 1) != v), i)
    )))
    runs = firsts.withColumn("runs", F.transform("firsts", lambda first, i: F.struct(
        F.shiftright(F.get("votes", first), 32).cast("int").alias("template"),
        (F.coalesce(F.get("firsts", i + 1), F.size("votes")) - first).alias("votes"),
    )))
    agreed = runs.withColumn("agreed", F.filter("runs", lambda r: r["votes"] >= F.get(need, r["template"])))
    known = F.filter(
        F.array_distinct(F.transform("agreed", lambda r: r["template"])),
        lambda t: F.forall(F.get(phrases, t), lambda p: F.contains(F.col("joined"), p)),
    )
    found = F.transform(known, lambda t: F.struct(
        F.get(labels, t).alias("label"),
        F.least(F.lit(1.0), F.array_max(F.transform(F.filter("agreed", lambda r: r["template"] == t), lambda r: r["votes"])) / F.get(total, t)).alias("score"),
    ))
    nothing_base, nothing_found = "array<struct<label:string,start:bigint>>", "array<struct<label:string,score:double>>"
    return agreed.select(
        F.col("id").alias(id_col), "n_words",
        F.coalesce("base", F.array().cast(nothing_base)).alias("base"),
        F.coalesce(found, F.array().cast(nothing_found)).alias("found"),
    )


def summary(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, first and last base place, label lists and the best score of each scanned row."""
    starts = F.transform("base", lambda b: b["start"])
    base_labels = F.transform("base", lambda b: b["label"])
    every = F.concat(base_labels, F.transform("found", lambda f: f["label"]))
    joined = lambda labels: F.array_join(F.sort_array(F.array_distinct(labels)), ",")
    return scanned.select(
        id_col, "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base_labels).alias("base_labels"), joined(every).alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("found", lambda f: f["score"])), F.lit(0.0))).alias("score"),
    )


def oracle() -> str:
    """The same answer by votes counted per (row, template, relative position)."""
    index = build_index()
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    postings = ", ".join(f"({quoted(w)}, {t}, {p})" for w, places in sorted(index.postings.items()) for t, p in places)
    templates = ", ".join(
        f"({i}, {quoted(label)}, {index.need[i]}, {index.total[i]}, [{', '.join(quoted(f' {p} ') for p in phrases)}])"
        for i, (label, _, phrases) in enumerate(TEMPLATES)
    )
    base = " UNION ALL ".join(
        f"SELECT rid, {quoted(label)} AS label, i AS start FROM words WHERE "
        + " AND ".join(f"w[i + {k + 1}] = {quoted(word)}" for k, word in enumerate(phrase.split()))
        for phrase, label in BASE_PHRASES
    )
    return f"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
words AS (SELECT rid, w, unnest(range(len(w))) AS i FROM texts),
base AS ({base}),
postings(word, template, place) AS (VALUES {postings}),
templates(template, label, need, total, phrases) AS (VALUES {templates}),
votes AS (
  SELECT rid, template, i - place AS shift, count(*) AS n
  FROM words JOIN postings ON w[i + 1] = word GROUP BY ALL),
found AS (
  SELECT rid, label, least(1.0, max(n) / total) AS score
  FROM votes JOIN templates USING (template) JOIN texts USING (rid)
  WHERE n >= need AND len(list_filter(phrases, lambda p: NOT contains(' ' || array_to_string(w, ' ') || ' ', p))) = 0
  GROUP BY rid, template, label, total),
b AS (SELECT rid, count(*) AS n, min(start) AS lo, max(start) AS hi FROM base GROUP BY rid),
bl AS (SELECT rid, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT DISTINCT rid, label FROM base) GROUP BY rid),
al AS (SELECT rid, string_agg(label, ',' ORDER BY label) AS labels
       FROM (SELECT rid, label FROM base UNION SELECT rid, label FROM found) GROUP BY rid),
s AS (SELECT rid, max(score) AS score FROM found GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.lo::BIGINT AS first_word, b.hi::BIGINT AS last_word,
       coalesce(bl.labels, '') AS base_labels, coalesce(al.labels, '') AS labels,
       CASE WHEN b.n > 0 THEN 1.0 ELSE coalesce(s.score, 0.0) END::DOUBLE AS score
FROM texts LEFT JOIN b USING (rid) LEFT JOIN bl USING (rid) LEFT JOIN al USING (rid) LEFT JOIN s USING (rid)"""

"""Licence scan over a positional index of rare words, as expressions within a row.

The index holds the words of licence templates with their positions; a word's weight is its inverse document
frequency among the templates. A file is looked up template by template, through the template's anchors: those words of its mandatory key
phrases that weigh most. Of these the one that occurs least often in the file is taken, and a template of which one does not occur is
passed over. Every place of that word names a diagonal, the difference of its positions in file and template. On each diagonal the template's
other rare words are intersected: those that stand where the template has them add their weights. A template is found where the
mandatory key phrases stand word for word and, in long passages, enough of the weight of its rarest words meets.

A regular expression first passes over files that lack, for every template, one word of its key phrases. It is derived from the templates: as
key phrases are mandatory, no template can be found in such a file. All is done inside the row: nothing is shuffled or broadcast, no Python
runs, and the index is a literal of fixed size.

The score is 1 where a base phrase is found, else the largest share of weight among the passages that are found, else 0.

Defined results: a null text is empty, with no words, null places, empty labels and score 0. Only ASCII
capitals are folded. Repeated rows each get their row. Texts are scanned whole. An empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.llm.common import let, table

#: A word after folding; before folding the capitals are in it too.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Base phrases and their labels; every place where the words stand consecutively counts.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Longer passages: label, passage, key phrases that must stand in it.
PASSAGES = (
    ("gpl-2", "gnu general public license version 2", ("version 2",)),
    ("gpl-3", "gnu general public license version 3", ("version 3",)),
    ("gpl-notice", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("redistribute it and or modify it", "gnu general public license")),
    ("lgpl", "gnu lesser general public license", ("gnu lesser general",)),
    ("agpl", "gnu affero general public license", ("gnu affero general",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("apache-2.0-notice", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ("except in compliance with the license",)),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "obtaining a copy of this software")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "following conditions are met")),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
    ("cc-by-nc", "cc by nc", ("cc by nc",)),
    ("cc-by-sa", "cc by sa", ("cc by sa",)),
    ("cc-by-nd", "cc by nd", ("cc by nd",)),
    ("cc-by-notice", "licensed under a creative commons attribution", ("creative commons attribution",)),
)
RARE_WORDS = 8
MIN_SHARE = 0.6


@dataclass(frozen=True)
class Template:
    """A phrase or passage: its words, the places (position, word) of its rarest and of its mandatory words, and its anchors."""

    label: str
    base: bool
    words: tuple[str, ...]
    rare: tuple[tuple[int, str], ...]
    keys: tuple[tuple[int, str], ...]
    anchors: tuple[tuple[int, str], ...]

    @property
    def total(self) -> float:
        return sum(WEIGHTS[w] for _, w in self.rare)


def _weights() -> dict[str, float]:
    texts = [set(p.split()) for p in (*PHRASES, *(p for _, p, _ in PASSAGES))]
    seen = Counter(chain.from_iterable(texts))
    return {w: math.log((1 + len(texts)) / (1 + n)) + 1 for w, n in seen.items()}


WEIGHTS = _weights()


def _template(label: str, base: bool, text: str, phrases: tuple[str, ...]) -> Template:
    words = tuple(text.split())
    places = list(enumerate(words))
    rarest = set(words if base else sorted(set(words), key=lambda w: (-WEIGHTS[w], w))[:RARE_WORDS])
    keys: set[tuple[int, str]] = set()
    for phrase in map(str.split, phrases):
        at = next(i for i in range(len(words)) if list(words[i : i + len(phrase)]) == phrase)
        keys |= set(places[at : at + len(phrase)])
    named = {w for _, w in keys if len(w) > 1} or {w for _, w in keys}
    most = max(WEIGHTS[w] for w in named)
    anchors = {w: i for i, w in sorted(keys, reverse=True) if w in named and WEIGHTS[w] == most}
    return Template(label, base, words, tuple(x for x in places if x[1] in rarest), tuple(sorted(keys)), tuple(sorted((i, w) for w, i in anchors.items())))


TEMPLATES = [_template(label, True, p, (p,)) for p, label in PHRASES.items()] + [_template(label, False, p, keys) for label, p, keys in PASSAGES]


def _gate() -> str:
    """Words of which every template has one among its mandatory ones, few of them: a file without any has no template.

    The word that is mandatory in most of the templates left, of equals the longest, is taken first.
    """
    left, words = [{w for _, w in t.keys if len(w) > 1} for t in TEMPLATES], []
    while left:
        words.append(max(set().union(*left), key=lambda w: (sum(w in keys for keys in left), len(w), w)))
        left = [keys for keys in left if words[-1] not in keys]
    return rf"(?i)(?<![a-z0-9])({'|'.join(words)})(?![a-z0-9])"


GATE = _gate()


def _known(words: Column) -> Column:
    """(word, place) of every anchor in the file."""
    anchors = sorted({w for t in TEMPLATES for _, w in t.anchors})
    return F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x.getField("w").isin(anchors))


def _starts(known: Column, word: str, at: int) -> Column:
    return F.transform(F.filter(known, lambda x: x.getField("w") == word), lambda x: x.getField("i") - at)


def _diagonals(known: Column, template: Template) -> Column:
    """Where the template would start, for every place of that anchor which the file has least often."""
    places = [_starts(known, word, at) for at, word in template.anchors]
    if len(places) == 1:
        return places[0]
    counted = F.array(*[F.struct(F.size(p).alias("n"), F.lit(k).alias("k"), p.alias("d")) for k, p in enumerate(places)])
    return F.array_min(counted).getField("d")


def _at(words: Column, start: Column, place: tuple[int, str]) -> Column:
    return F.coalesce(F.get(words, start + place[0]) == place[1], F.lit(False))


def _found(words: Column, known: Column, template: Template) -> Column:
    """(d, share) of every diagonal on which the template is found."""

    def stands(d: Column) -> Column:
        test = F.lit(True)
        for place in template.keys:
            test = test & _at(words, d, place)
        return test

    def share(d: Column) -> Column:
        if template.base:
            return F.lit(1.0)
        met = sum((F.when(_at(words, d, p), WEIGHTS[p[1]]).otherwise(0.0) for p in template.rare), F.lit(0.0))
        return F.least(F.lit(1.0), met / template.total)

    passed = F.transform(F.filter(_diagonals(known, template), stands), lambda d: F.struct(d.alias("d"), share(d).alias("share")))
    return passed if template.base else F.filter(passed, lambda m: m.getField("share") >= MIN_SHARE - 1e-9)


def _labelled(found: Column, label: str) -> Column:
    return F.transform(found, lambda m: F.struct(m.getField("d").alias("d"), F.lit(label).alias("label")))


def _judge(words: Column, known: Column) -> Column:
    base, labels = [], []
    for t in TEMPLATES:
        found = _found(words, known, t)
        if t.base:
            base.append(_labelled(found, t.label))
        else:
            best = F.array_max(F.transform(found, lambda m: m.getField("share")))
            labels.append(F.struct(best.alias("share"), F.lit(t.label).alias("label")))

    def result(places: Column, passages: Column) -> Column:
        base_labels = F.array_sort(F.array_distinct(F.transform(places, lambda m: m.getField("label"))))
        starts = F.transform(places, lambda m: m.getField("d"))
        found = F.filter(passages, lambda m: m.getField("share").isNotNull())
        all_labels = F.array_sort(F.array_distinct(F.concat(base_labels, F.transform(found, lambda m: m.getField("label")))))
        best = F.coalesce(F.array_max(F.transform(found, lambda m: m.getField("share"))), F.lit(0.0))
        return F.struct(
            F.size(places).cast("long").alias("n_base"),
            F.array_min(starts).cast("long").alias("first_word"),
            F.array_max(starts).cast("long").alias("last_word"),
            F.array_join(base_labels, ",").alias("base_labels"),
            F.array_join(all_labels, ",").alias("labels"),
            F.when(F.size(places) > 0, F.lit(1.0)).otherwise(F.round(best, 9)).alias("score"),
        )

    return let(F.concat(*base), lambda places: let(F.array(*labels), lambda passages: result(places, passages)))


RESULTS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the columns of ``RESULTS``, in place of any of these names."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    folded = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(folded, F.lit(WORD), F.lit(0))
    none = F.struct(F.lit(0).cast("long").alias("n_base"), F.lit(None).cast("long").alias("first_word"), F.lit(None).cast("long").alias("last_word"), F.lit("").alias("base_labels"), F.lit("").alias("labels"), F.lit(0.0).alias("score"))
    found = F.when(text.rlike(GATE), let(words, lambda w: let(_known(w), lambda known: _judge(w, known)))).otherwise(none)
    n_words = F.regexp_count(text, F.lit(ANY_CASE_WORD)).cast("long")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in RESULTS]
    return docs.withColumns({"n_words": n_words, "__found": found}).select(*others, "n_words", "__found.*")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def brute_force(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word and base_labels of a text, by trying every place."""
    words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for phrase, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def _sql() -> str:
    """The whole index as a table, without a gate or anchors: every place of every template's words meets by (template, difference of positions)."""
    rare, keys, heads = [], [], []
    for k, t in enumerate(TEMPLATES):
        rare += [f"('{w}', {k}, {i}, {WEIGHTS[w]!r}::DOUBLE, 0)" for i, w in t.rare]
        keys += [f"('{w}', {k}, {i}, 0::DOUBLE, 1)" for i, w in t.keys]
        heads.append(f"({k}, '{t.label}', {t.base}, {t.total!r}::DOUBLE, {len(t.keys)})")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
x AS (SELECT r, unnest(w) AS w, unnest(range(0, len(w))) AS i FROM d),
p(w, t, pos, weight, is_key) AS (VALUES {", ".join(rare + keys)}),
h(t, label, base, total, n_keys) AS (VALUES {", ".join(heads)}),
m AS (SELECT r, t, i - pos AS d, sum(weight) AS weight, sum(is_key) AS n_keys FROM x JOIN p USING (w) GROUP BY ALL),
f AS (SELECT m.r, m.d, h.label, h.base, least(1.0::DOUBLE, m.weight / h.total) AS share FROM m JOIN h USING (t)
      WHERE m.n_keys = h.n_keys AND (h.base OR m.weight / h.total >= {MIN_SHARE} - 1e-9)),
g AS (SELECT r, count(*) FILTER (base) AS n_base, min(d) FILTER (base) AS first_word, max(d) FILTER (base) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) FILTER (NOT base) AS share FROM f GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE round(coalesce(share, 0), 9) END AS score
FROM d LEFT JOIN g USING (r)
"""


SQL = _sql()

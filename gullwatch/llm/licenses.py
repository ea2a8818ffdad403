"""License scans over a positional rare-token index, in DataFrame functions only.

A template is a notice of a licence and, inside it, the key phrase that it must hold. The
index has for each template the ``RARE`` words of its key phrase with the highest IDF over
all documents, each with its place in the phrase. A file looks up those of its words that
are in the index; each occurrence at place p of a word that stands at place q of a phrase
votes for a start p - q. The starts that all rare words of a template agree on are kept
(postings intersected by relative position), and the whole key phrase is verified there.
A place's score is the share of the notice's words, weighted by IDF, that stand where the
notice has them. As every occurrence of a phrase holds its rare words, none is missed.

Everything happens within a row: the only shuffle counts the documents of each licence word,
so hot sources, copies or words cannot gather in a task. Rows without a rare word stop at the
lookup.

Defined results: null or empty text has no words, no label and score 0; places may overlap
and each counts, also for copies and repeated rows, which are judged one by one; rows without
a doc_id are judged like others; an empty table gives an empty result; extra columns are not
read. IDF counts rows, repeated ones each.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    label: str
    notice: str
    phrase: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.phrase.split()

    @property
    def context(self) -> list[tuple[int, str]]:
        """The notice's words, each with its place relative to the key phrase."""
        notice, key = self.notice.split(), self.words
        at = next(i for i in range(len(notice)) if notice[i : i + len(key)] == key)
        return [(i - at, word) for i, word in enumerate(notice)]


# The base phrases and their labels.
BASE = (
    Template("cc-by", "licensed under cc by", "cc by", True),
    Template("gpl", "this work is licensed under the gnu general public license version", "general public license", True),
    Template("reserved", "all rights reserved", "all rights reserved", True),
)
#: Labels beside the base.
ADDED = (
    Template("agpl", "under the gnu affero general public license version 3", "affero general public license"),
    Template("apache", "licensed under the apache license version 2 0", "apache license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("lgpl", "under the gnu lesser general public license version", "lesser general public license"),
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted free of charge"),
    Template("mpl", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
)
TEMPLATES = BASE + ADDED
#: Words of a key phrase that are looked up.
RARE = 2

_UPPER = "".join(map(chr, range(65, 91)))
_BREAKS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
_FOUND = "array<struct<label:string,base:boolean,start:int,matched:bigint,total:bigint>>"


def words(text: Column) -> Column:
    """Words of ASCII letters, digits and characters from U+0080, A-Z lower-cased."""
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER + _BREAKS, _UPPER.lower() + " " * len(_BREAKS))
    return F.array_remove(F.split(plain, " ", -1), "")


def _literals(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def word_weights(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, int]:
    """floor(1000 ln((2N + 2) / (2 df + 1))) of every word of the templates, over all rows."""
    vocabulary = sorted({word for t in templates for word in t.notice.split()})
    held = docs.select(F.explode(F.concat(F.array_intersect(words(F.col("text")), _literals(vocabulary)), F.array(F.lit("")))).alias("word"))
    df = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most one row a template word
    n = df.get("", 0)
    return {word: math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(word, 0) + 1))) for word in vocabulary}


def rare_index(templates: tuple[Template, ...], weights: dict[str, int], rare: int = RARE) -> list[list[tuple[str, int]]]:
    """For each template the words with the highest IDF of its key phrase, and their places in it."""
    index = []
    for t in templates:
        ranked = sorted(set(t.words), key=lambda word: (-weights[word], word))
        index.append([(word, t.words.index(word)) for word in ranked[:rare]])
    return index


def _search_table(templates: tuple[Template, ...], index: list[list[tuple[str, int]]], weights: dict[str, int]) -> Column:
    """All templates as one array, so that the expressions over a row are as few for many templates as for one."""

    def placed(words: list[tuple[int, str]]) -> Column:
        return F.array(*(F.struct(F.lit(at).alias("at"), F.lit(word).alias("word"), F.lit(weights[word]).cast("long").alias("weight")) for at, word in words))

    return F.array(
        *(
            F.struct(
                F.lit(t.label).alias("label"),
                F.lit(t.base).alias("base"),
                _literals(t.words).alias("key"),
                placed([(place, word) for word, place in entry]).alias("rare"),
                placed(t.context).alias("context"),
                F.lit(sum(weights[word] for _, word in t.context)).cast("long").alias("total"),
            )
            for t, entry in zip(templates, index)
        )
    )


def _starts(hits: Column, rare: Column) -> Column:
    return F.transform(F.filter(hits, lambda h: h["word"] == rare["word"]), lambda h: h["at"] - rare["at"])


def _places(w: Column, hits: Column, t: Column) -> Column:
    others = F.slice(t["rare"], F.lit(2), F.size(t["rare"]))
    starts = F.aggregate(others, _starts(hits, F.get(t["rare"], F.lit(0))), lambda agreed, rare: F.array_intersect(agreed, _starts(hits, rare)))
    verified = F.filter(starts, lambda s: (s >= 0) & (F.slice(w, F.greatest(s, F.lit(0)) + 1, F.size(t["key"])) == t["key"]))

    def found(s: Column) -> Column:
        matched = F.aggregate(t["context"], F.lit(0).cast("long"), lambda sum_, c: sum_ + F.when(F.get(w, s + c["at"]) == c["word"], c["weight"]).otherwise(F.lit(0)))
        return F.struct(t["label"].alias("label"), t["base"].alias("base"), s.alias("start"), matched.alias("matched"), t["total"].alias("total"))

    return F.transform(verified, found)


def find(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, rare: int = RARE) -> DataFrame:
    """doc_id, n_words and ``found``: label, base, first word, matched and total weight of every place."""
    weights = word_weights(docs, templates)
    index = rare_index(templates, weights, rare)
    looked_up = sorted({word for entry in index for word, _ in entry})
    # each generator makes its input once for all expressions above it
    worded = docs.select("doc_id", F.explode(F.array(words(F.col("text")))).alias("w"))
    w = F.col("w")
    placed = F.transform(w, lambda word, i: F.struct(word.alias("word"), i.alias("at")))
    # rows without a looked-up word leave their words behind
    hits = F.when(F.arrays_overlap(w, _literals(looked_up)), F.struct(w.alias("w"), F.filter(placed, lambda h: h["word"].isin(looked_up)).alias("hits")))
    looked = worded.select("doc_id", F.size("w").cast("long").alias("n_words"), F.explode(F.array(hits)).alias("looked"))
    places = F.flatten(F.transform(_search_table(templates, index, weights), lambda t: _places(F.col("looked.w"), F.col("looked.hits"), t)))
    found = F.when(F.col("looked").isNotNull(), places).otherwise(F.array()).cast(_FOUND)
    return looked.select("doc_id", "n_words", F.explode(F.array(found)).alias("found"))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Counts, bounds and labels of the places of every row; the score is that of the best place."""
    found = find(docs, templates)
    base = F.filter("found", lambda x: x["base"])
    starts = F.transform(base, lambda x: x["start"].cast("long"))

    def labels(places: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda x: x["label"]))), ",")

    share = F.transform("found", lambda x: F.when(x["total"] > 0, x["matched"].cast("double") / x["total"]).otherwise(F.lit(1.0)))
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(share), F.lit(0.0)).alias("score"),
    )

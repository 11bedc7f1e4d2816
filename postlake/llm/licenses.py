"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a line together with the one below it, or a window of words twice as long as the longest
template, so a notice is whole however it is wrapped, even with a blank line or a marker that is a word
before each of its words. Windows count where what is found in them runs over three lines or more;
they start at a template's word, and of those with most of its words the shortest is its place.
A template is found in a block if the block holds at least ``threshold`` of the template's distinct
words. Words are ordered by how often they occur in all texts, rare first. With a = ceil(threshold *
size of the template), a template and a block that reach the threshold share a word among the first
``size - a + 1`` words of either (prefix filter); the block needs at least a words that templates know
(length filter); and from the places of the shared word at least a words must still be possible
(positional filter). What passes is verified on the sets, so the join is exact.

Where two templates are found in one block and one has all words of the other and more, the smaller
one gives way; so does one whose place lies inside the place of the larger one.

Base: the places where the words of a phrase stand consecutively.

Cases: a NULL text is an empty one; a text without words has no places, labels or score; a NULL
doc_id is carried along; repeated rows each get their own row; other columns are ignored; equal
templates and ties in frequency are ordered by the word itself; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions.once import with_once
from postlake.llm.common import whole

#: What separates words, and what a word consists of, once A-Z are lower-cased.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "you may not use this file except in compliance with the License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "either version 3 of the License, or (at your option) any later version"),
    ("lgpl", "Licensed under the GNU Lesser General Public License"),
    ("agpl", "Licensed under the GNU Affero General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    least: int


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())


def words(folded: Column) -> Column:
    return F.filter(F.split(folded, SEPARATOR), lambda w: w != "")


def frequencies(docs: DataFrame, vocabulary: set[str]) -> dict[str, int]:
    """How often each word of the templates occurs in all texts; one row per template word at most."""
    found = docs.select(F.explode(F.split(F.lower(whole("text")), SEPARATOR)).alias("word"))
    rows = found.where(F.col("word").isin(*sorted(vocabulary))).groupBy("word").count().collect()
    return {r["word"]: r["count"] for r in rows}


def ordered_templates(templates, order: list[str], threshold: float) -> list[Template]:
    """Templates as sets of words in the global order."""
    place = {w: n for n, w in enumerate(order)}
    out = []
    for label, text in templates:
        distinct = sorted(set(words_of(text)), key=place.__getitem__)
        out.append(Template(label, tuple(distinct), max(1, math.ceil(threshold * len(distinct) - 1e-9))))
    return out


def blocks_of(docs: DataFrame, prefixes: set[str]) -> DataFrame:
    """(key, block, folded): the blocks of texts in which a word of some template's prefix stands."""
    near = docs.where(F.col("folded").rlike("|".join(re.escape(w) for w in sorted(prefixes))))
    lines = near.select("key", F.split("folded", "\n").alias("lines"))
    return lines.select("key", F.posexplode("lines").alias("block", "line"), "lines").select(
        "key", "block", F.concat_ws(" ", "line", F.get("lines", F.col("block") + 1)).alias("folded")
    )


@dataclass(frozen=True)
class Prepared:
    """What both kinds of blocks are joined with: the templates in the order of their words."""

    order: list[str]
    ordered: list[Template]
    prefixes: set[str]
    table: DataFrame


def prepared(docs: DataFrame, templates=TEMPLATES, threshold: float = 0.9) -> Prepared:
    vocabulary = {w for _, text in templates for w in words_of(text)}
    counts = frequencies(docs, vocabulary)
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    ordered = ordered_templates(templates, order, threshold)
    prefix = [
        (w, n, t.label, list(t.words), len(t.words), t.least, at, [k for k, o in enumerate(ordered) if set(o.words) > set(t.words)])
        for n, t in enumerate(ordered)
        for at, w in enumerate(t.words[: len(t.words) - t.least + 1])
    ]
    table = docs.sparkSession.createDataFrame(
        prefix, "word string, template int, label string, words array<string>, size int, least int, at int, within array<int>"
    )
    return Prepared(order, ordered, {w for w, *_ in prefix}, table)


def matches(docs: DataFrame, templates=TEMPLATES, threshold: float = 0.9, ready: Prepared | None = None) -> DataFrame:
    """(key, block, template, label, within, score) for each block and template that reach the threshold.

    ``within`` lists the templates that have all words of this one and more.

    ``docs`` has (key, text); equal keys must mean equal texts. Templates are a constant of a few
    hundred words, so their side of the join is broadcast.
    """
    ready = ready or prepared(docs, templates, threshold)
    order, ordered, table = ready.order, ready.ordered, ready.table
    known = F.create_map(*[x for n, w in enumerate(order) for x in (F.lit(w), F.lit(n))])
    shortest = min(t.least for t in ordered)
    folded = docs.select("key", F.lower(whole("text")).alias("folded"))
    blocks = blocks_of(folded, ready.prefixes)
    ranked = F.array_sort(
        F.transform(
            F.filter(F.array_distinct(words(F.col("folded"))), lambda w: w.isin(*order)),
            lambda w: F.struct(F.element_at(known, w).alias("rank"), w.alias("word")),
        )
    )
    sets = with_once(blocks.select("key", "block", "folded"), "words", ranked).where(F.size("words") >= shortest)
    probe = sets.select(
        "key", "block", F.transform("words", lambda x: x["word"]).alias("have"), F.posexplode("words").alias("place", "one")
    ).withColumn("word", F.col("one.word"))
    left = F.col("size") - F.col("at")
    right = F.size("have") - F.col("place")
    pairs = (
        probe.join(F.broadcast(table), "word")
        .where(F.size("have") >= F.col("least"))
        .where(F.col("place") < F.size("have") - F.col("least") + 1)
        .where(F.least(left, right) >= F.col("least") - F.least("at", "place"))
    )
    shared = F.size(F.array_intersect("have", "words"))
    return (
        pairs.withColumn("shared", shared)
        .where(F.col("shared") >= F.col("least"))
        .groupBy("key", "block", "template", "label", "within")
        .agg(F.max(F.col("shared") / F.col("size")).alias("score"))
    )


def wrapped(docs: DataFrame, templates=TEMPLATES, threshold: float = 0.9, ready: Prepared | None = None) -> DataFrame:
    """(key, template, label, within, score, first, last, start, end) for each place of three lines or
    more in which a template reaches the threshold: its first and last line and word.
    """
    ready = ready or prepared(docs, templates, threshold)
    reach = 2 * max((len(words_of(text)) for _, text in templates), default=1)
    either = "|".join(re.escape(w) for w in sorted(ready.prefixes))
    folded = docs.select("key", F.lower(whole("text")).alias("folded"))
    near = folded.where(F.col("folded").rlike(f"(?:^|{SEPARATOR})(?:{either})(?:{SEPARATOR}|$)") & F.col("folded").rlike(r"(?s)\n.*\n"))
    each = F.flatten(
        F.transform(F.split("folded", "\n"), lambda x, n: F.transform(words(x), lambda w: F.struct(n.alias("line"), w.alias("word"))))
    )
    placed = F.transform(each, lambda x, n: F.struct(n.alias("at"), x["line"].alias("line"), x["word"].alias("word")))
    tokens = with_once(near.select("key", "folded"), "tokens", F.filter(placed, lambda x: x["word"].isin(*ready.order)))
    around = F.transform(
        "tokens",
        lambda x, n: F.when(
            x["word"].isin(*sorted(ready.prefixes)),
            F.struct(x["at"].alias("at"), x["word"].alias("word"), F.slice("tokens", F.greatest(n - reach + 2, F.lit(1)), 2 * reach).alias("near")),
        ),
    )
    probe = tokens.select("key", F.explode(F.filter(around, lambda x: x.isNotNull())).alias("one"))
    probe = probe.select("key", "one.at", "one.word", "one.near").withColumnRenamed("at", "place")
    pairs = probe.join(F.broadcast(ready.table), "word")
    own = F.filter("near", lambda x: (F.abs(x["at"] - F.col("place")) < reach) & F.array_contains("words", x["word"]))
    pairs = with_once(pairs, "own", own)
    lines = F.transform("own", lambda x: x["line"])
    pairs = pairs.where(F.size(F.array_distinct(F.transform("own", lambda x: x["word"]))) >= F.col("least"))
    pairs = pairs.where(F.array_max(lines) - F.array_min(lines) > 1)

    def window(a: Column) -> Column:
        """The words in reach of ``a``, each where it stands first, as (shared, -length, start, end, lines)."""
        inside = F.filter("own", lambda x: (x["at"] >= a["at"]) & (x["at"] < a["at"] + reach))
        held = F.array_distinct(F.transform(inside, lambda x: x["word"]))
        ends = F.transform(held, lambda w: F.get(F.filter(inside, lambda x: x["word"] == w), F.lit(0)))
        end = F.array_max(F.transform(ends, lambda x: F.struct(x["at"].alias("at"), x["line"].alias("line"))))
        return F.struct(
            F.size(held).alias("shared"), (a["at"] - end["at"]).alias("short"), a["at"].alias("start"), end["at"].alias("end"), a["line"].alias("first"), end["line"].alias("last")
        )

    starts = F.filter("own", lambda x: x["at"] <= F.col("place"))
    best = with_once(pairs, "best", F.array_max(F.transform(starts, window)))
    best = best.where((F.col("best.shared") >= F.col("least")) & (F.col("best.last") - F.col("best.first") > 1))
    return best.select(
        "key", "template", "label", "within", (F.col("best.shared") / F.col("size")).alias("score"), "best.first", "best.last", "best.start", "best.end"
    ).distinct()


def find_licenses(docs: DataFrame, templates=TEMPLATES, threshold: float = 0.9) -> DataFrame:
    """For each row its words, the places of the base phrases and the labels of both searches.

    (doc_id, n_words, places array of (at, label), base_labels, labels, score). The score is the
    largest share of a template's words found in one block, or 1 where a base phrase stands.
    """
    base = docs.select("doc_id", whole("text").alias("text")).withColumn("key", F.md5("text"))
    ready = prepared(base, templates, threshold)
    found = matches(base.select("key", "text"), templates, threshold, ready)
    found = found.groupBy("key", "block").agg(  # no more than there are templates
        F.collect_set("template").alias("all"), F.collect_set(F.struct("template", "within", "label", "score")).alias("each")
    )
    found = found.select("key", "block", F.explode(F.filter("each", lambda x: ~F.arrays_overlap(x["within"], "all"))).alias("one"))
    wide = wrapped(base.select("key", "text"), templates, threshold, ready)
    found = found.select(
        "key", "one.*", F.col("block").alias("first"), (F.col("block") + 1).alias("last"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.lit(False).alias("wide")
    ).unionByName(wide.withColumn("wide", F.lit(True)))
    larger = {k for t in ready.ordered for k, o in enumerate(ready.ordered) if set(o.words) > set(t.words)}
    tied = (F.size("within") > 0) | F.col("template").isin(*larger)  # for the others one row for each score is enough
    found = found.withColumns({c: F.when(tied, F.col(c)) for c in ("first", "last", "start", "end")})
    found = found.groupBy("key").agg(F.collect_set(F.struct("template", "within", "label", "score", "first", "last", "start", "end", "wide")).alias("each"))

    def inside(x: Column, y: Column) -> Column:
        lines = (y["first"] <= x["first"]) & (y["last"] >= x["last"])
        words_ = (y["start"] <= x["start"]) & (y["end"] >= x["end"])
        return y["wide"] & F.array_contains(x["within"], y["template"]) & F.when(x["wide"], words_).otherwise(lines)

    held = F.filter("each", lambda x: (F.size(x["within"]) == 0) | ~F.exists("each", lambda y: inside(x, y)))
    found = found.select("key", F.explode(held).alias("one"))
    found = found.groupBy("key").agg(F.collect_set("one.label").alias("found"), F.max("one.score").alias("best"))
    folded = F.lower("text")
    counted = base.select(
        "doc_id",
        "key",
        F.regexp_count("text", F.lit(_WORD)).cast("long").alias("n_words"),
        F.explode(F.array(F.when(folded.contains("license"), words(folded)))).alias("words"),
    )
    placed = F.flatten(F.array(*[_starts(phrase.split(), label) for phrase, label in PHRASES]))
    none = F.array().cast("array<struct<at:bigint,label:string>>")
    counted = with_once(counted, "places", F.when(F.size("words") > 0, F.array_sort(placed)).otherwise(none))
    joined = counted.join(found, "key", "left")
    base_labels = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    labels = F.array_sort(F.array_union(base_labels, F.coalesce("found", F.array().cast("array<string>"))))
    return joined.select(
        "doc_id",
        "n_words",
        "places",
        base_labels.alias("base_labels"),
        labels.alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def _starts(phrase: list[str], label: str) -> Column:
    def stands(at: Column) -> Column:
        out = F.get("words", at) == phrase[0]
        for k in range(1, len(phrase)):
            out = out & (F.get("words", at + k) == phrase[k])
        return out

    starts = F.filter(F.sequence(F.lit(0), F.size("words") - 1), stands)
    return F.transform(starts, lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of `find_licenses`."""
    places = F.transform("places", lambda p: p["at"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )

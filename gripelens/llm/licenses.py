"""License notices by an exact set-similarity join, in DataFrame functions only.

A text is cut into blocks of 64 words, one every 32 words, and a block meets a template
if it holds at least nine tenths of the template's distinct words.  A template of up to
33 words that stands in a text lies within one block as a whole.

Words of no template cannot count, so a block is the set of its template words.  These
words are ordered by how many blocks of the corpus hold them, rarest first.  Of a
template of t words that needs o common ones, one of the rarest t - o + 1 must be in the
block, and likewise for the block (prefix filter): only these are joined.  A block of
fewer words than any template needs is dropped at once (length filter), and a pair whose
words behind the common one cannot make up the need is dropped as well (positional
filter).  What is left is counted exactly.  The order decides how much is joined, never
the result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gripelens.llm.columns import let, plain_words
from gripelens.session import materialise

#: Phrases that name a license.
PHRASES = {
    "gpl": "gnu general public license",
    "apache": "apache license",
    "cc-by": "cc by",
    "mit": "mit license",
}

#: Notices by which works are put under a license.
TEMPLATES = (
    ("agpl-notice", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0-notice", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("boost", "to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-notice", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl-notice", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable"),
)

BLOCK = 64
STRIDE = 32
CONTAINED = 0.9
#: So many prefix words of templates are sent to all tasks; more are joined by shuffling.
SENT_ROWS = 50_000

Templates = Sequence[tuple[str, str]]


def words_of(text: str) -> list[str]:
    """Words as ``plain_words`` cuts them."""
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _need(size: int, share: float) -> int:
    return math.ceil(share * size - 1e-9)


def _sets(templates: Templates) -> list[tuple[str, list[str]]]:
    found = [(label, words_of(text)) for label, text in templates]
    for label, words in found:
        if not 0 < len(words) <= BLOCK - STRIDE + 1:
            raise ValueError(f"a template has 1 to {BLOCK - STRIDE + 1} words, {label} has {len(words)}")
    return [(label, list(dict.fromkeys(words))) for label, words in found]


def _phrase_places(words: Column, label: str, phrase: list[str]) -> Column:
    """(at, label) of each place where the words of a phrase stand in a row."""

    def stands(i: Column) -> Column:
        same = F.lit(True)
        for k, word in enumerate(phrase):
            same = same & (F.get(words, i + k) == word)
        return F.coalesce(same, F.lit(False))

    at = F.filter(F.sequence(F.lit(0), F.size(words) - 1), stands)
    all_there = F.lit(True)
    for word in phrase:
        all_there = all_there & F.array_contains(words, word)
    found = F.transform(at, lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))
    return F.when(all_there, found).otherwise(F.array().cast("array<struct<at:int,label:string>>"))


def _places(words: Column, phrases: Mapping[str, str]) -> Column:
    return F.concat(*[_phrase_places(words, label, words_of(phrase)) for label, phrase in phrases.items()])


def _blocks(words: Column, known: Sequence[str], least: int) -> Column:
    """(block, words) of the blocks with at least ``least`` of the known words."""
    known_words = _strings(known)

    def cut(i: Column) -> Column:
        return F.struct(i.alias("block"), F.array_intersect(F.slice(words, i * STRIDE + 1, BLOCK), known_words).alias("words"))

    last = F.greatest(F.ceil((F.size(words) - F.lit(BLOCK)) / F.lit(STRIDE)).cast("int"), F.lit(0))
    cuts = F.filter(F.transform(F.sequence(F.lit(0), last), cut), lambda b: F.size(b["words"]) >= least)
    enough = F.size(F.array_intersect(words, known_words)) >= least
    return F.when(enough, cuts).otherwise(F.array().cast("array<struct<block:int,words:array<string>>>"))


def cut_rows(
    docs: DataFrame,
    phrases: Mapping[str, str] = PHRASES,
    templates: Templates = TEMPLATES,
    share: float = CONTAINED,
    text: str = "text",
) -> DataFrame:
    """(row, doc_id, n_words, places, blocks) of each row of ``docs``, written once.

    A null or empty text has no words; repeated rows are rows of their own.
    """
    sets = _sets(templates)
    known = sorted({w for _, words in sets for w in words})
    least = min((_need(len(words), share) for _, words in sets), default=BLOCK + 1)

    def facts(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n"),
            _places(words, phrases).alias("places"),
            _blocks(words, known, least).alias("blocks"),
        )

    source = docs.select(
        F.monotonically_increasing_id().alias("row"),
        docs["doc_id"].alias("doc_id"),
        let(plain_words(docs[text]), facts).alias("found"),
    )
    return materialise(
        source.select("row", "doc_id", F.col("found.n").alias("n_words"), "found.places", "found.blocks"), "blocks"
    )


def joined_blocks(rows: DataFrame, templates: Templates = TEMPLATES, share: float = CONTAINED) -> DataFrame:
    """(row, block, label, contained) of every block that meets a template.

    ``rows`` are those of ``cut_rows`` for the same templates; ``contained`` is the share
    of the template's words that the block holds.
    """
    spark = rows.sparkSession
    sets = _sets(templates)
    least = min((_need(len(words), share) for _, words in sets), default=BLOCK + 1)
    blocks = rows.select("row", F.explode("blocks").alias("b")).select("row", "b.block", "b.words")
    counts = blocks.select(F.explode("words").alias("word")).groupBy("word").count()
    seen = {r["word"]: r["count"] for r in counts.collect()}  # one row for each word of the templates
    order = sorted({w for _, words in sets for w in words}, key=lambda w: (seen.get(w, 0), w))
    rank = {w: n for n, w in enumerate(order)}
    index = []
    for label, words in sets:
        words, need = sorted(words, key=rank.__getitem__), _need(len(words), share)
        for at, word in enumerate(words[: len(words) - need + 1]):
            index.append((word, label, at, need, words))
    kind = "word string, label string, t_at int, need int, t_words array<string>"
    prefixes = spark.createDataFrame(index, kind)
    if len(index) <= SENT_ROWS:
        prefixes = F.broadcast(prefixes)
    ordered = blocks.withColumn("words", F.array_intersect(_strings(order), F.col("words")))
    prefix = F.slice("words", F.lit(1), F.size("words") - F.lit(least - 1))
    found = ordered.select("row", "block", "words", F.posexplode(prefix).alias("at", "word")).join(prefixes, "word")
    behind = F.least(F.size("t_words") - F.col("t_at"), F.size("words") - F.col("at"))
    both = F.size(F.array_intersect("words", "t_words"))
    return (
        found.filter(behind >= F.col("need"))
        .withColumn("both", both)
        .filter("both >= need")
        .select("row", "block", "label", (F.col("both") / F.size("t_words")).alias("contained"))
        .distinct()
    )


def scanned(
    docs: DataFrame,
    phrases: Mapping[str, str] = PHRASES,
    templates: Templates = TEMPLATES,
    share: float = CONTAINED,
    text: str = "text",
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, places, blocks, score.

    ``places`` are (at, label) of the phrases, in order; ``blocks`` are (first_word, label,
    contained) of the blocks that meet a template.  ``score`` is 1 with a phrase, else the
    largest share of a template that was met, else 0.  Other columns are not read.
    """
    rows = cut_rows(docs, phrases, templates, share, text)
    met = joined_blocks(rows, templates, share)
    met = met.groupBy("row").agg(
        F.sort_array(
            F.collect_list(F.struct((F.col("block") * STRIDE).cast("long").alias("first_word"), "label", "contained"))
        ).alias("met"),
        F.max("contained").alias("best"),
    )
    none = F.array().cast("array<struct<first_word:bigint,label:string,contained:double>>")
    score = F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return rows.drop("blocks").join(met, "row", "left").select(
        "doc_id",
        "n_words",
        F.sort_array("places").alias("places"),
        F.coalesce("met", none).alias("blocks"),
        score.alias("score"),
    )

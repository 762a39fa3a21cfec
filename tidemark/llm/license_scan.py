"""License scan: phrases, and an exact set-similarity join of text blocks with notice templates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import written

# The phrases that give a label where their words stand one after the other.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Public license notices, and the label that each gives.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", (
        'you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        'http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software '
        'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations"
    )),
    ("bsd", (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice"
    )),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("creative-commons", "licensed under a Creative Commons Attribution International License"),
    ("gpl", (
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either "
        "version of the License, or (at your option) any later version"
    )),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("isc", (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies"
    )),
    ("mit", (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction, including without limitation the rights to "
        "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    )),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]

PERCENT = 90
SMALLEST_BLOCK = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]++"


def words_of(text: Column) -> Column:
    """Runs of a-z, 0-9 and characters outside ASCII, after A-Z became a-z."""
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(lower, _GAP), "")


def plain_words(text: str) -> list[str]:
    """The same words of a template, outside Spark."""
    text = text.translate(str.maketrans(_UPPER, _LOWER))
    cut = "".join(c if c > "\x7f" or "a" <= c <= "z" or "0" <= c <= "9" else " " for c in text)
    return [w for w in cut.split(" ") if w]


def step_of(n_words: int) -> int:
    """Words from one block to the next for a template of so many: 16, 64, 256, ...

    A block holds two steps, so each passage as long as the template lies whole in one.
    """
    step = SMALLEST_BLOCK
    while step < n_words:
        step *= 4
    return step


def needed(size: int, percent: int) -> int:
    """The words of a template of ``size`` distinct ones that a block must hold."""
    return max(1, -(-percent * size // 100))


def _literal(items: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in items])


def vocabulary(templates: list[tuple[str, str]]) -> list[str]:
    return sorted({w for _, text in templates for w in plain_words(text)})


def ranked_vocabulary(docs: DataFrame, text_col: str, templates: list[tuple[str, str]]) -> list[str]:
    """The templates' words, those of fewest documents first, equal ones by name.

    Counted over all documents; the result is as long as the templates' vocabulary,
    however large the corpus is. No other word can be shared by a block and a template.
    """
    known = vocabulary(templates)
    if not known:
        return []
    met = docs.select(F.explode(F.array_intersect(_literal(known), words_of(docs[text_col]))).alias("word"))
    counts = {r["word"]: r["docs"] for r in met.groupBy("word").agg(F.count("*").alias("docs")).collect()}
    return sorted(known, key=lambda w: (counts.get(w, 0), w))


def prefix_index(templates: list[tuple[str, str]], order: list[str], percent: int) -> list[tuple]:
    """(step, word, template, at, size, needed) of each template's prefix: of its words in ``order`` the
    first ``size - needed + 1``, one of which every block that holds ``needed`` of them has."""
    place = {w: k for k, w in enumerate(order)}
    rows = []
    for number, (_, text) in enumerate(templates):
        words = plain_words(text)
        ordered = sorted(set(words), key=place.__getitem__)
        need = needed(len(ordered), percent)
        for at, word in enumerate(ordered[: len(ordered) - need + 1]):
            rows.append((step_of(len(words)), word, number, at, len(ordered), need))
    return rows


def _blocks(words: Column, step: int, order: list[str], first_words: list[str], least: int) -> Column:
    """The blocks of ``step`` that may match: (block, tokens), tokens in global order.

    Each block keeps its words of ``order``; a block with fewer than ``least`` of them
    (length filter) or none of the templates' prefix words is left out.
    """
    last = F.floor((F.size(words) - 1) / step)
    blocks = F.transform(
        F.sequence(F.lit(0).cast("long"), F.greatest(last, F.lit(0).cast("long"))),
        lambda b: F.struct(
            F.lit(step).alias("step"), b.alias("block"),
            F.array_intersect(_literal(order), F.slice(words, (b * step + 1).cast("int"), F.lit(2 * step))).alias("tokens"),
        ),
    )
    return F.filter(blocks, lambda b: (F.size(b["tokens"]) >= least) & F.arrays_overlap(b["tokens"], _literal(first_words)))


def _starts(words: Column, phrases: dict[str, str]) -> Column:
    """(at, label) of every place where a phrase's words stand one after the other."""
    if not phrases:
        return F.array().cast("array<struct<at: int, label: string>>")

    def here(word: Column, at: Column) -> Column:
        found = F.lit(None).cast("string")
        for phrase, label in phrases.items():
            first, *rest = plain_words(phrase)
            fits = reduce(
                lambda a, b: a & b, [F.get(words, at + k + 1) == w for k, w in enumerate(rest)], word == F.lit(first)
            )
            found = F.when(fits, F.lit(label)).otherwise(found)
        return F.when(found.isNotNull(), F.struct(at.alias("at"), found.alias("label")))

    return F.filter(F.transform(words, here), lambda x: x.isNotNull())


def parsed(
    docs: DataFrame, id_col: str, text_col: str, phrases: dict[str, str], index: list[tuple], order: list[str]
) -> DataFrame:
    """(file, row, id, n_words, places, blocks) of every row of ``docs``, written; texts are read once more."""
    words = docs.select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
        docs[id_col].alias("id"), words_of(docs[text_col]).alias("words"),
    )
    per_step = [
        _blocks(F.col("words"), step, order, sorted({r[1] for r in index if r[0] == step}), min(r[5] for r in index if r[0] == step))
        for step in sorted({r[0] for r in index})
    ]
    blocks = F.concat(*per_step) if per_step else F.array().cast("array<struct<step:int,block:long,tokens:array<string>>>")
    return written(
        words.select(
            "file", "row", "id", F.size("words").cast("long").alias("n_words"),
            _starts(F.col("words"), phrases).alias("places"), blocks.alias("blocks"),
        ),
        "scanned",
    )


def matches(scanned: DataFrame, templates: list[tuple[str, str]], index: list[tuple], order: list[str]) -> DataFrame:
    """(file, row, step, block, template, containment) of the blocks that hold enough of a template's words.

    Candidates share a word of both prefixes at places that leave room for the words
    still needed; the overlap of each is then counted whole. The index has a few rows
    per template, so it is broadcast.
    """
    spark = scanned.sparkSession
    place = {w: k for k, w in enumerate(order)}
    prefixes = spark.createDataFrame(index, "step int, token string, template int, at int, size int, needed int")
    sets = spark.createDataFrame(
        [(n, sorted(set(plain_words(t)), key=place.__getitem__)) for n, (_, t) in enumerate(templates)],
        "template int, words array<string>",
    )
    found = scanned.select("file", "row", F.explode("blocks").alias("b")).select("file", "row", "b.*")
    tokens = found.select("file", "row", "step", "block", "tokens", F.posexplode("tokens").alias("place", "token"))
    room = F.least(F.col("size") - F.col("at"), F.size("tokens") - F.col("place"))
    candidates = (
        tokens.join(F.broadcast(prefixes), ["step", "token"])
        .where((F.size("tokens") >= F.col("needed")) & (F.col("place") <= F.size("tokens") - F.col("needed")) & (room >= F.col("needed")))
        .dropDuplicates(["file", "row", "step", "block", "template"])
    )
    held = F.size(F.array_intersect("words", "tokens"))
    return (
        candidates.join(F.broadcast(sets), "template")
        .where(held >= F.col("needed"))
        .select("file", "row", "step", "block", "template", (held / F.col("size")).alias("containment"))
    )


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None,
    phrases: dict[str, str] | None = None, percent: int = PERCENT,
) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row of ``docs``.

    ``docs`` reads files. ``base_labels`` come from the phrases, ``labels`` from them and
    from the templates of whose distinct words a block holds ``percent`` per cent; both
    sorted and joined by commas, empty where there is none. ``score`` is 1 where a phrase
    stands, else the greatest containment of a template that matched, else 0. Null
    counts as empty; rows are told apart by their place in the files, so null and repeated
    ids do no harm; other columns play no part; an empty table gives no rows.
    """
    templates = TEMPLATES if templates is None else templates
    templates = [t for t in templates if plain_words(t[1])]
    phrases = PHRASES if phrases is None else phrases
    order = ranked_vocabulary(docs, text_col, templates)
    index = prefix_index(templates, order, percent)
    scanned = parsed(docs, id_col, text_col, phrases, index, order)
    base = scanned.select(
        "file", "row", "id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places.at").cast("long").alias("first_word"), F.array_max("places.at").cast("long").alias("last_word"),
        F.array_sort(F.array_distinct("places.label")).alias("_base"),
    )
    if not templates:
        result = base.withColumns({"_more": F.array().cast("array<string>"), "_best": F.lit(None).cast("double")})
    else:
        labels = F.element_at(_literal([label for label, _ in templates]), F.col("template") + 1)
        # At most as many labels per row as there are templates.
        hits = matches(scanned, templates, index, order).groupBy("file", "row").agg(
            F.collect_set(labels).alias("_more"), F.max("containment").alias("_best")
        )
        result = base.join(hits, ["file", "row"], "left")
    every = F.array_sort(F.array_union("_base", F.coalesce("_more", F.array().cast("array<string>"))))
    return result.select(
        "id", "n_words", "n_base", "first_word", "last_word", F.array_join("_base", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"),
    )

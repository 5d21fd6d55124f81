"""License scan: an exact set-similarity join of text blocks with license templates.

Tokens are pairs of neighbouring words.  A template of at most c words (c a power of two, CLASS at
least) is looked for in the blocks of class c: words i*c up to (i+2)*c of a text, for every i, so each
run of c words lies whole in a block.  A block matches a template if it contains PERCENT % of the template's different
tokens or more.

One pass over the texts cuts the blocks, keeps of each the tokens that a fixed-size bitmap of template tokens may hold, and
drops blocks with fewer of them than any template of their class needs (length filter).  What is left is counted: tokens are
ordered by their frequency over all blocks, rarest first.  A block and a template with enough tokens in common share one of
the first (prefix filter): a template's rarest tokens are looked up by a block's rarest.  Where the first shared
tokens leave too few after them, the pair goes (positional filter); the rest are verified by intersection.  Templates are
broadcast in groups of about GROUP_TOKENS tokens, so neither a broadcast nor a task grows with their number, and blocks never
meet each other: a notice that stands in a third of all documents is no hot key.

Fixed phrases are found beside this, with the place of each.

Null and empty texts have no words.  Null ids are kept.  Repeated rows of documents are scanned each.  Repeated (template, label, text) rows
count once; templates under two words match nothing.  An empty table gives no rows.  Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridlore.llm.common import (
    arrow_map,
    bitmap_of,
    in_bitmap,
    lane_words,
    lanes_of,
    materialise,
    ngram_hashes,
    read_table,
    slices,
    span_hashes,
    span_strings,
    text_bytes,
    word_spans,
)
from gridlore.llm.decontaminate import ALNUM, LOWER

PERCENT = 80
CLASS = 8
GROUP_TOKENS = 1 << 17

#: Phrases and their labels.
PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)

#: Notices of public licenses (name, label, text).
TEMPLATES = (
    ("mit-notice", "mit-notice", "Released under the MIT License."),
    (
        "mit-permission",
        "mit-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ),
    (
        "mit-warranty",
        "mit-text",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ),
    ("apache-notice", "apache-notice", "Licensed under the Apache License, Version 2.0."),
    (
        "apache-header",
        "apache-text",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "apache-warranty",
        "apache-text",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ),
    ("gpl-notice", "gpl-notice", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl-header",
        "gpl-text",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "gpl-warranty",
        "gpl-text",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ),
    (
        "bsd-conditions",
        "bsd-text",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    (
        "isc-permission",
        "isc-text",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "mpl-notice",
        "mpl-notice",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at",
    ),
    ("cc-by-notice", "cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-notice", "cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("unlicense", "unlicense", "This is free and unencumbered software released into the public domain."),
)


def needed(size: int, percent: int) -> int:
    """Tokens in common from which a template with so many matches."""
    return max(1, -(-size * percent // 100))


def block_class(n_words: int) -> int:
    return max(CLASS, 1 << max(n_words - 1, 0).bit_length())


def hashed_pairs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, rows) of the words, and (first word, hash) of each pair of neighbours in a row."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, rows = word_spans(data, offsets, ALNUM)
    at = np.flatnonzero(rows[:-1] == rows[1:]) if len(rows) else np.zeros(0, np.int64)
    return data, starts, ends, rows, at, ngram_hashes(span_hashes(data, starts, ends), 2)[at]


def tokens_at(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The two words from each place on, with a space between them."""
    first = span_strings(data, starts[at], ends[at]).to_pylist()
    second = span_strings(data, starts[at + 1], ends[at + 1]).to_pylist()
    return np.array([f"{a} {b}" for a, b in zip(first, second, strict=True)], object)


def template_tokens(templates: DataFrame) -> DataFrame:
    """(template, label, class, tokens, hashes) of each template with a token."""
    narrow = templates.select(*[F.col(c).cast("string").alias(c) for c in ("template", "label", "text")]).distinct()

    def run(part: pa.RecordBatch) -> dict:
        data, starts, ends, rows, at, hashes = hashed_pairs(part.column("text"))
        words = np.bincount(rows, minlength=part.num_rows)
        token = tokens_at(data, starts, ends, at)
        own = [np.flatnonzero(rows[at] == r) for r in range(part.num_rows)]
        return {
            "template": part.column("template"),
            "label": part.column("label"),
            "class": np.array([block_class(int(n)) for n in words], np.int32),
            "tokens": pa.array([sorted(set(token[o].tolist())) for o in own], pa.list_(pa.string())),
            "hashes": pa.array([np.unique(hashes[o]).view(np.int64).tolist() for o in own], pa.list_(pa.int64())),
        }

    return arrow_map(narrow, run, "template string, label string, class int, tokens array<string>, hashes array<long>", "text").where("size(tokens) > 0")


def phrase_places(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, phrase: str) -> np.ndarray:
    """First words of the places where the phrase's words stand one after the other.  Its words have eight bytes at most."""
    words = phrase.encode().split()
    count = max(0, len(starts) - len(words) + 1)
    on = rows[:count] == rows[len(words) - 1 :] if count else np.zeros(0, bool)
    lanes, sizes = lanes_of(data), ends - starts
    for k, word in enumerate(words):
        if len(word) > 8:
            raise ValueError(f"a word of more than eight bytes in {phrase!r}")
        own = slice(k, k + count)
        on = on & (sizes[own] == len(word)) & (lane_words(lanes, starts[own], sizes[own]) == int.from_bytes(word, "little"))
    return np.flatnonzero(on)


def blocks_of(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(index into at, block) for the word places of tokens, counted from the start of their text."""
    whole = np.arange(len(at))
    both = whole[(at % size != size - 1) & (at >= size)]
    return np.concatenate([whole, both]), np.concatenate([at // size, at[both] // size - 1])


SCAN = "row_id long, doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, class int, block long, tokens array<string>"


def scan(docs: DataFrame, bitmap: np.ndarray, least: dict[int, int], id_col: str, text_col: str, phrases: tuple) -> DataFrame:
    """A row for each document (class null), and one for each block that may match (row_id, class, block, tokens).

    row_id tells rows apart; it holds only within what this returns.  ``least`` has the tokens that a block of a class needs.
    """
    shared = docs.sparkSession.sparkContext.broadcast((bitmap, least))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kinds = {"class": pa.int32(), "tokens": pa.list_(pa.string()), "base_labels": pa.list_(pa.string())}
    names = [c.split()[0] for c in SCAN.split(", ")]

    def rows_with(count: int, given: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([given[c] if c in given else pa.nulls(count, kinds.get(c, pa.int64())) for c in names], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        some, fewest = shared.value
        next_id = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "text"):
                n = part.num_rows
                data, starts, ends, rows, at, hashes = hashed_pairs(part.column("text"))
                counts = np.bincount(rows, minlength=n)
                before = np.cumsum(counts) - counts
                n_base, low, high = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                labels: list[set[str]] = [set() for _ in range(n)]
                for phrase, label in phrases:
                    places = phrase_places(data, starts, ends, rows, phrase)
                    of = rows[places]
                    n_base += np.bincount(of, minlength=n)
                    np.minimum.at(low, of, places - before[of])
                    np.maximum.at(high, of, places - before[of])
                    for r in np.unique(of).tolist():
                        labels[r].add(label)
                yield rows_with(
                    n,
                    {
                        "row_id": pa.array(np.arange(next_id, next_id + n)),
                        "doc_id": part.column("doc_id"),
                        "n_words": pa.array(counts.astype(np.int64)),
                        "n_base": pa.array(n_base),
                        "first_word": pa.array(low, mask=n_base == 0),
                        "last_word": pa.array(high, mask=n_base == 0),
                        "base_labels": pa.array([sorted(x) for x in labels], kinds["base_labels"]),
                    },
                )
                on = in_bitmap(some, hashes)
                at, hashes = at[on], hashes[on]
                of, place = rows[at], at - before[rows[at]]
                for size, fewest_here in fewest.items():
                    index, block = blocks_of(place, size)
                    order = np.lexsort((hashes[index], block, of[index]))
                    index, block = index[order], block[order]
                    row, token = of[index], hashes[index]
                    new_block = np.ones(len(index), bool)
                    new_block[1:] = (row[1:] != row[:-1]) | (block[1:] != block[:-1])
                    new = new_block.copy()
                    new[1:] |= token[1:] != token[:-1]
                    first = np.flatnonzero(new_block)
                    different = np.add.reduceat(new.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
                    good = np.flatnonzero(different >= fewest_here)
                    stops = np.append(first, len(index))
                    if len(good):
                        own = [index[stops[k] : stops[k + 1]][new[stops[k] : stops[k + 1]]] for k in good.tolist()]
                        lists = [tokens_at(data, starts, ends, at[o]).tolist() for o in own]
                        yield rows_with(
                            len(good),
                            {
                                "row_id": pa.array(next_id + row[first[good]]),
                                "class": pa.array(np.full(len(good), size, np.int32)),
                                "block": pa.array(block[first[good]]),
                                "tokens": pa.array(lists, kinds["tokens"]),
                            },
                        )
                next_id += n

    return narrow.mapInArrow(run, SCAN)


@dataclass
class Group:
    """Templates that are looked for together, with their tokens as ranks in the global order."""

    rank: dict[str, int]
    #: (name, label, ranks in order, tokens needed) of each.
    templates: list[tuple[str, str, list[int], int]]
    #: For each class, where a rank stands in the prefixes of its templates: (template, place).
    prefixes: dict[int, dict[int, list[tuple[int, int]]]] = field(default_factory=dict)
    least: dict[int, int] = field(default_factory=dict)

    @staticmethod
    def of(rows: list, frequency: dict[str, int], percent: int) -> Group:
        tokens = sorted({t for r in rows for t in r.tokens}, key=lambda t: (frequency.get(t, 0), t))
        made = Group({t: n for n, t in enumerate(tokens)}, [])
        for n, r in enumerate(rows):
            ranks = sorted(made.rank[t] for t in r.tokens)
            enough = needed(len(ranks), percent)
            made.templates.append((r.template, r.label, ranks, enough))
            index = made.prefixes.setdefault(r["class"], {})
            for place, rank in enumerate(ranks[: len(ranks) - enough + 1]):
                index.setdefault(rank, []).append((n, place))
            made.least[r["class"]] = min(enough, made.least.get(r["class"], enough))
        return made

    def matches(self, size: int, tokens: list[str]) -> list[tuple[int, int]]:
        """(template, tokens in common) of all templates of the class that a block contains enough of."""
        if size not in self.least:
            return []
        own = sorted(self.rank[t] for t in tokens if t in self.rank)
        index = self.prefixes[size]
        seen: set[int] = set()
        found = []
        for place, rank in enumerate(own[: max(0, len(own) - self.least[size] + 1)]):
            for n, there in index.get(rank, ()):
                if n in seen:
                    continue
                seen.add(n)
                _, _, ranks, enough = self.templates[n]
                if len(own) >= enough and min(len(own) - place, len(ranks) - there) >= enough:
                    common = len(set(own).intersection(ranks))
                    if common >= enough:
                        found.append((n, common))
        return found


FOUND = "row_id long, template string, label string, first long, last long, containment double"


def contained(blocks: DataFrame, group: Group) -> DataFrame:
    """A row for each block and template it contains enough of: the words of the block, and the share of the template's tokens."""
    shared = blocks.sparkSession.sparkContext.broadcast(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for batch in batches:
            rows = []
            columns = [batch.column(c).to_pylist() for c in ("row_id", "class", "block", "tokens")]
            for row_id, size, block, tokens in zip(*columns, strict=True):
                for n, common in g.matches(size, tokens):
                    name, label, ranks, _ = g.templates[n]
                    rows.append((row_id, name, label, block * size, (block + 2) * size, common / len(ranks)))
            if rows:
                names = [c.split()[0] for c in FOUND.split(", ")]
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))

    return blocks.select("row_id", "class", "block", "tokens").mapInArrow(run, FOUND)


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES), "template string, label string, text string")


def scan_licenses(
    docs: DataFrame,
    templates: DataFrame | None = None,
    percent: int = PERCENT,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: tuple = PHRASES,
    group_tokens: int = GROUP_TOKENS,
) -> tuple[DataFrame, DataFrame]:
    """(a row for each document, a row for each match); both have row_id.

    Documents: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the largest share of a
    template's tokens in a block that matches, else 0).  Matches are as ``contained`` gives them.
    """
    spark = docs.sparkSession
    wanted = materialise(template_tokens(default_templates(spark) if templates is None else templates))
    bitmap = bitmap_of(wanted.select(F.explode("hashes").alias("hash")), "hash")
    sizes = wanted.groupBy("class").agg(F.min(F.size("tokens")).alias("least"), F.sum(F.size("tokens")).alias("n")).collect()  # one row a power of two
    rows = materialise(scan(docs, bitmap, {r["class"]: needed(r.least, percent) for r in sizes}, id_col, text_col, phrases))
    blocks = rows.where("class is not null")
    often = materialise(
        blocks.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).join(wanted.select(F.explode("tokens").alias("token")).distinct(), "token")
    )
    n_groups = -(-sum(r.n for r in sizes) // group_tokens)
    group_of = F.pmod(F.xxhash64("template", "label", "tokens"), F.lit(max(n_groups, 1)))
    found = spark.createDataFrame([], FOUND)
    for k in range(n_groups):
        own = wanted.where(group_of == k)
        chosen = own.select("template", "label", "class", "tokens").collect()  # about group_tokens tokens
        frequency = {r.token: r.n for r in often.join(own.select(F.explode("tokens").alias("token")).distinct(), "token").collect()}
        if chosen:
            found = found.unionByName(contained(blocks, Group.of(chosen, frequency, percent)))
    found = materialise(found)
    best = found.groupBy("row_id").agg(F.collect_set("label").alias("found"), F.max("containment").alias("score"))
    documents = (
        rows.where("class is null")
        .select("row_id", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
        .join(best, "row_id", "left")
        .select(
            "row_id",
            "doc_id",
            "n_words",
            "n_base",
            "first_word",
            "last_word",
            "base_labels",
            F.array_sort(F.array_union("base_labels", F.coalesce("found", F.array().cast("array<string>")))).alias("labels"),
            F.coalesce("score", F.lit(0.0)).alias("score"),
        )
    )
    return documents, found


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in documents; one row a document."""
    documents, _ = scan_licenses(read_table(spark, sf_dir, "documents"))
    joined = [F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")]
    return documents.select("doc_id", "n_words", "n_base", "first_word", "last_word", *joined, "score")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)


def _places(table: str, keys: str) -> str:
    """Words of a table with a column words, their places from 0, and each with the next one."""
    words = f"SELECT {keys}, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS p FROM {table}"
    return f"SELECT *, word || ' ' || lead(word) OVER (PARTITION BY {keys} ORDER BY p) AS token FROM ({words})"


def _phrase_at(phrase: str) -> str:
    words = phrase.split()
    return " AND ".join(f"{f'lead(word, {k}) OVER w' if k else 'word'} = {_quoted(word)}" for k, word in enumerate(words))


OP13_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS d, doc_id, {_WORDS} AS words FROM documents
), places AS MATERIALIZED (
  {_places("docs", "d")}
), phrases AS (
  SELECT d, p, unnest([{", ".join(f"CASE WHEN {_phrase_at(p)} THEN {_quoted(n)} END" for p, n in PHRASES)}]) AS label
  FROM places WINDOW w AS (PARTITION BY d ORDER BY p)
), base AS (
  SELECT d, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, list(DISTINCT label) AS labels
  FROM phrases WHERE label IS NOT NULL GROUP BY d
), templates(template, label, text) AS (
  VALUES {", ".join(f"({_quoted(n)}, {_quoted(x)}, {_quoted(t)})" for n, x, t in TEMPLATES)}
), template_words AS (
  SELECT template, label, CAST(greatest({CLASS}, power(2, ceil(log2(len(words))))) AS BIGINT) AS c, words
  FROM (SELECT template, label, {_WORDS} AS words FROM templates)
), tokens AS (
  SELECT DISTINCT template, label, c, token FROM ({_places("template_words", "template, label, c")}) WHERE token IS NOT NULL
), sizes AS (
  SELECT template, count(*) AS size FROM tokens GROUP BY template
), shared AS (
  SELECT d, p, token FROM places WHERE token IN (SELECT token FROM tokens)
), blocks AS (
  SELECT d, c, p // c AS block, token FROM shared, (SELECT DISTINCT c FROM tokens)
  UNION ALL
  SELECT d, c, p // c - 1, token FROM shared, (SELECT DISTINCT c FROM tokens) WHERE p >= c AND p % c <> c - 1
), matches AS (
  SELECT d, template, any_value(label) AS label, block, count(DISTINCT token) AS n
  FROM blocks JOIN tokens USING (c, token) GROUP BY d, template, block
), found AS (
  SELECT d, list(DISTINCT label) AS labels, max(CAST(n AS DOUBLE) / size) AS score
  FROM matches JOIN sizes USING (template) WHERE 100 * n >= {PERCENT} * size GROUP BY d
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ',') AS labels,
  coalesce(score, 0.0) AS score
FROM docs LEFT JOIN base USING (d) LEFT JOIN found USING (d)
"""

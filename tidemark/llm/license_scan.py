"""License scans as an exact set-similarity join of text blocks and license templates.

A template of k distinct tokens matches a block when the block holds at least
``o = ceil(threshold * k)`` of them. Tokens are ordered by their frequency in the whole
corpus, rarest first. A block that reaches o must hold one of the first k - o + 1 tokens of a
template (prefix filter) and must have o distinct template tokens at all (length filter). Its
tokens are ordered as well: if the first common token has place p in the template and place q
among the m tokens of the block, they share at most min(k - p, m - q) (positional filter). What
passes is verified by counting.

Blocks are windows of the words of a text: for templates of up to B/2 words, windows of B
words that start at every multiple of B/2, so that each run of B/2 words lies inside one.
Templates marked ``exact`` must have their words stand in a row; each place counts once.

The frequencies are counts of template tokens over all documents; templates and counts are the
only things sent to the executors, and their size is fixed by the templates.

Defined results: a null or empty text has no words and no matches; repeated rows give repeated
rows; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
import string
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import slices

_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
THRESHOLD = 0.8


@dataclass(frozen=True)
class Template:
    name: str
    label: str
    text: str
    exact: bool = False
    #: Least containment; None: that of the scan. Short notices differ in a word or two, so they need all of theirs.
    threshold: float | None = None


#: The base phrases and their labels.
PHRASES = (
    Template("mit phrase", "mit", "mit license", True),
    Template("apache phrase", "apache", "apache license", True),
    Template("gpl phrase", "gpl", "general public license", True),
)

#: Opening statements of well-known public licenses.
NOTICES = (
    Template("mit grant", "mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    Template("mit release", "mit", "released under the MIT license", threshold=1.0),
    Template("apache grant", "apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    Template("apache notice", "apache", "licensed under the Apache License, Version 2.0", threshold=1.0),
    Template("gpl grant", "gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("gpl notice", "gpl", "licensed under the GNU General Public License, version 3", threshold=1.0),
    Template("bsd grant", "bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("cc by-nc", "cc-by-nc", "licensed under CC BY-NC 4.0", threshold=1.0),
    Template("cc by-sa", "cc-by-sa", "licensed under CC BY-SA 4.0", threshold=1.0),
    Template("cc attribution", "cc-by", "licensed under a Creative Commons Attribution 4.0 International License", threshold=1.0),
    Template("isc grant", "isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    Template("mpl notice", "mpl", "subject to the terms of the Mozilla Public License, v. 2.0", threshold=1.0),
)
TEMPLATES = PHRASES + NOTICES

MATCH = T.ArrayType(
    T.StructType(
        [
            T.StructField("template", T.StringType()),
            T.StructField("label", T.StringType()),
            T.StructField("exact", T.BooleanType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
            T.StructField("containment", T.DoubleType()),
        ]
    )
)


def words(text: str | None) -> list[str]:
    return _WORDS((text or "").translate(_LOWER))


def _texts(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key), F.col(text).cast("string").alias("text"))


def frequencies(df: DataFrame, tokens: set[str], text: str = "text") -> dict[str, int]:
    """How often each of ``tokens`` occurs in all texts; one row for each token reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in slices(batches):
            for value in batch.column(0):
                total.update(filter(tokens.__contains__, words(value.as_py())))
        yield pa.RecordBatch.from_pydict({"token": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})

    counts = df.select(F.col(text)).mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {row["token"]: row["n"] for row in counts.collect()}


class Index:
    """Templates with their tokens in global order, by the tokens of their prefixes."""

    def __init__(self, templates: Sequence[Template], counts: dict[str, int], threshold: float):
        self.templates = templates
        self.by_token: dict[str, list[tuple[int, int]]] = {}
        self.tokens: list[frozenset[str]] = []
        self.order: list[list[str]] = []
        self.sequence: list[list[str]] = []
        self.need: list[int] = []
        self.block: list[int] = []
        vocabulary = {word for template in templates for word in words(template.text)}
        #: Global order: rarest tokens first. Words of no template share nothing with any and have no place.
        self.rank = {word: i for i, word in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
        for t, template in enumerate(templates):
            sequence = words(template.text)
            order = sorted(set(sequence), key=self.rank.__getitem__)
            need = len(order) if template.exact else ceil((template.threshold or threshold) * len(order) - 1e-9)
            self.tokens.append(frozenset(order))
            self.order.append(order)
            self.sequence.append(sequence)
            self.need.append(need)
            self.block.append(2 << (len(sequence) - 1).bit_length())
            for place, token in enumerate(order[: len(order) - need + 1]):
                self.by_token.setdefault(token, []).append((t, place))

    def candidates(self, found: list[str]) -> list[tuple[int, int]]:
        """(template, block) of a text of these words that pass the prefix, length and positional filters."""
        first: dict[tuple[int, int], int] = {}
        for at in [i for i, word in enumerate(found) if word in self.by_token]:
            for t, place in self.by_token[found[at]]:
                half = self.block[t] // 2
                for block in (at // half, at // half - 1):
                    if block >= 0 and place < first.get((t, block), 1 << 30):
                        first[t, block] = place
        ordered: dict[tuple[int, int], list[int]] = {}
        out = []
        for (t, block), place in sorted(first.items()):
            need, half = self.need[t], self.block[t] // 2
            if (half, block) not in ordered:
                inside = set(found[block * half : block * half + 2 * half])
                ordered[half, block] = sorted(self.rank[word] for word in inside if word in self.rank)
            ranks = ordered[half, block]
            if len(ranks) < need:
                continue
            behind = len(ranks) - bisect_left(ranks, self.rank[self.order[t][place]])
            if min(len(self.order[t]) - place, behind) >= need:
                out.append((t, block))
        return out

    def matches(self, found: list[str]) -> list[tuple[int, int, int, float]]:
        """(template, start, end, containment) in a text of these words."""
        out = []
        for t, block in self.candidates(found):
            tokens, need, half = self.tokens[t], self.need[t], self.block[t] // 2
            inside = found[block * half : block * half + 2 * half]
            overlap = len(tokens.intersection(inside))
            if overlap < need:
                continue
            if not self.templates[t].exact:
                out.append((t, block * half, block * half + len(inside), overlap / len(tokens)))
                continue
            sequence = self.sequence[t]
            for i in range(half):  # places that start in the second half belong to the next block
                if inside[i : i + len(sequence)] == sequence:
                    start = block * half + i
                    out.append((t, start, start + len(sequence), 1.0))
        return out


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", templates: Sequence[Template] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(key, n_words, matches) of every row; a match has its template, label, word span and containment."""
    vocabulary = {word for template in templates for word in words(template.text)}
    index = df.sparkSession.sparkContext.broadcast(Index(templates, frequencies(df, vocabulary, text), threshold))
    read = _texts(df, key, text)
    schema = T.StructType([read.schema.fields[0], T.StructField("n_words", T.LongType()), T.StructField("matches", MATCH)])
    names = ("template", "label", "exact", "start", "end", "containment")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = index.value
        arrow = pa.list_(pa.struct(list(zip(names, (pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.float64())))))
        for batch in slices(batches):
            sizes, rows = [], []
            for value in batch.column(1):
                found = words(value.as_py())
                sizes.append(len(found))
                row = []
                for t, start, end, part in held.matches(found):
                    template = held.templates[t]
                    row.append(dict(zip(names, (template.name, template.label, template.exact, start, end, part))))
                rows.append(row)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(rows, arrow)], names=[key, "n_words", "matches"])

    return read.mapInArrow(run, schema)


def report(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, places, labels and score of each row of :func:`scan`."""
    base = F.filter("matches", lambda m: m["exact"])
    labels = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda m: m["label"]))), ",")
    return scanned.select(
        key,
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda m: m["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda m: m["start"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)).alias("score"),
    )

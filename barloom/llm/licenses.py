"""License scans by an exact set-similarity join.

Text blocks (lines) are joined with license templates: a block matches a template when it holds
at least ``CONTAINED`` of the template's distinct words. The join is exact:

* the words of all templates are counted over all texts, and every template's words are ordered
  by rarity;
* prefix filter: a block that reaches the overlap k of a template of n words holds one of its
  n - k + 1 rarest words, so only blocks with such a word are candidates;
* length filter: a block needs k words; positional filter: at the first common word there must
  be enough words left in the template;
* candidates are verified by counting.

The base finds fixed phrases of consecutive words anywhere in the text, also across lines.
Words are runs of ASCII letters and digits and of any other non-ASCII bytes, A-Z in lower
case. Null texts are empty; rows are independent, so repeated rows are reported alike.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.tokens import hash_words, table, texts

CONTAINED = 0.9

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Characteristic wording of public licenses and their labels.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under a creative commons attribution license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
)

_BREAKS = np.ones(256, bool)
_BREAKS[48:58] = _BREAKS[65:91] = _BREAKS[97:123] = _BREAKS[128:] = False


def _hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return hash_words(data, np.array([0, len(data)]), _BREAKS)[0]


def vocabulary(templates=TEMPLATES) -> np.ndarray:
    return np.unique(np.concatenate([_hashes(t) for _, t in templates]))


def _places(values: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``words`` holds one of the sorted ``values``, and which."""
    at = np.minimum(np.searchsorted(values, words), len(values) - 1)
    where = np.flatnonzero(values[at] == words)
    return where, at[where]


def word_counts(docs: DataFrame, templates=TEMPLATES) -> dict:
    """How often each template word occurs in all texts, by its hash."""
    values = vocabulary(templates)

    def run(batches):
        total = np.zeros(len(values), np.int64)
        for batch in batches:
            for _, data, bounds in texts(batch.column(0)):
                words, _ = hash_words(data, bounds, _BREAKS)
                total += np.bincount(_places(values, words)[1], minlength=len(values))
        yield table({"word": values.view(np.int64), "n": total}, {"word": pa.int64(), "n": pa.int64()})

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word long, n long")
    return {r.word: r.n for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def ordered(counts: dict, contained: float = CONTAINED, templates=TEMPLATES) -> list:
    """Templates as (label, words from the rarest on, overlap they need, prefix length)."""
    out = []
    for label, text in templates:
        words = sorted({int(h) for h in _hashes(text).view(np.int64)}, key=lambda h: (counts.get(h, 0), h))
        need = math.ceil(contained * len(words) - 1e-9)
        out.append((label, np.array(words, np.int64).view(np.uint64), need, len(words) - need + 1))
    return out


class Scanner:
    """Phrases and templates found in slices of texts."""

    def __init__(self, templates: list):
        self.templates = templates
        self.phrases = [(_hashes(phrase), label) for phrase, label in BASE.items()]
        self.values = np.unique(np.concatenate([words for _, words, _, _ in templates]))
        self.members = [np.searchsorted(self.values, words) for _, words, _, _ in templates]
        self.prefixes: dict[int, list] = {}
        for number, (_, _, need, length) in enumerate(templates):
            for position, token in enumerate(self.members[number][:length].tolist()):
                self.prefixes.setdefault(token, []).append((number, position))
        self.first = np.zeros(len(self.values), bool)
        self.first[list(self.prefixes)] = True

    def phrase_places(self, words, first):
        """``place, label`` of every base phrase; one that would run over the end of a text is none."""
        for hashes, label in self.phrases:
            n = len(hashes)
            if len(words) < n:
                continue
            hit = np.ones(len(words) - n + 1, bool)
            for k in range(n):
                hit &= words[k:len(words) - n + 1 + k] == hashes[k]
            where = np.flatnonzero(hit)
            text = np.searchsorted(first, where, side="right") - 1
            inside = where + n <= first[text + 1]
            yield where[inside], text[inside], label

    def template_matches(self, words, lines):
        """``line, template, containment`` of the matches; ``lines``: first word of each line."""
        where, token = _places(self.values, words)
        line = np.searchsorted(lines, where, side="right") - 1
        both = np.unique(line * len(self.values) + token)
        line, token = both // len(self.values), both % len(self.values)
        starts = np.searchsorted(line, np.arange(len(lines)))
        lengths = np.diff(lines)
        seen = set()
        for i in np.flatnonzero(self.first[token]).tolist():
            at = int(line[i])
            own = None
            for number, position in self.prefixes[int(token[i])]:
                if (at, number) in seen:
                    continue
                _, all_words, need, _ = self.templates[number]
                if lengths[at] < need or len(all_words) - position < need:
                    continue
                if own is None:
                    own = token[starts[at]:starts[at + 1]]
                seen.add((at, number))
                both_ = int(np.isin(self.members[number], own).sum())
                if both_ >= need:
                    yield at, number, both_ / len(all_words)


_RESULT = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(),
           "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}
_RESULT_SQL = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scanned(docs: DataFrame, contained: float = CONTAINED, templates=TEMPLATES) -> DataFrame:
    """A row for each document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``score`` is 1 with a base phrase, else the greatest containment of a matched template, else 0."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rules = docs.sparkSession.sparkContext.broadcast(ordered(word_counts(docs, templates), contained, templates))

    def run(batches):
        scanner = Scanner(rules.value)
        for batch in batches:
            for row, data, bounds in texts(batch.column(1)):
                count = len(bounds) - 1
                ends = np.flatnonzero(data == 10) + 1
                cuts = np.union1d(bounds[:-1], ends[ends < len(data)])
                cuts = np.append(cuts[cuts < len(data)], len(data))
                words, lines = hash_words(data, cuts, _BREAKS)
                owner = np.searchsorted(bounds, cuts[:-1], side="right") - 1
                first = np.append(lines[np.searchsorted(cuts, bounds[:-1])], len(words))
                n_base = np.zeros(count, np.int64)
                low, high = np.full(count, -1), np.full(count, -1)
                base, more, score = {}, {}, np.zeros(count)
                for where, text, label in scanner.phrase_places(words, first):
                    place = where - first[text]
                    n_base += np.bincount(text, minlength=count)
                    for t, p in zip(text.tolist(), place.tolist()):
                        base.setdefault(t, set()).add(label)
                        low[t] = p if low[t] < 0 else min(low[t], p)
                        high[t] = max(high[t], p)
                for line, number, share in scanner.template_matches(words, lines):
                    t = int(owner[line])
                    more.setdefault(t, set()).add(scanner.templates[number][0])
                    score[t] = max(score[t], share)
                score[list(base)] = 1.0
                none = low < 0
                yield table({
                    "doc_id": batch.column(0).slice(row, count), "n_words": np.diff(first), "n_base": n_base,
                    "first_word": pa.array(low, pa.int64(), mask=none), "last_word": pa.array(high, pa.int64(), mask=none),
                    "base_labels": [",".join(sorted(base.get(t, ()))) for t in range(count)],
                    "labels": [",".join(sorted(base.get(t, set()) | more.get(t, set()))) for t in range(count)], "score": score}, _RESULT)

    return docs.mapInArrow(run, _RESULT_SQL)

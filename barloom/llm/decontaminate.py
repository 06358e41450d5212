"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared as lower-case words joined by single spaces. An item of m
characters may differ by k = floor(rate * m) edits from a stretch of a document. It is split
into k + 1 pieces: k edits leave at least one of them whole, so every match contains an exact
piece. A multi-pattern automaton finds the pieces in the whole text in one pass; around each
hit Myers' bit-parallel recurrence computes the least edit distance of the item to any
stretch of the text there, and hits above the budget are dropped.

Items are the stated query set: they are compared with all rows in blocks of ``BLOCK`` items,
so what a task holds is bounded however many items there are. No text is shuffled.

Null or empty texts match nothing. Items of fewer than ``LEAST`` characters say too little to
be recognised and are left out. Repeated items with other ids are reported one by one; a
repeated document row is reported once.
"""

from __future__ import annotations

import math
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.tokens import rows

RATE = 0.08
LEAST = 24
BLOCK = 20_000

_WORDS = re.compile(r"[^\W_]+")


def normalised(text: str | None) -> str:
    return " ".join(_WORDS.findall((text or "").lower()))


def budget(length: int, rate: float = RATE) -> int:
    return int(rate * length + 1e-9)


def pieces(item: str, rate: float = RATE) -> list[tuple[int, str]]:
    """``offset, piece`` of budget + 1 pieces that cover the item."""
    parts = budget(len(item), rate) + 1
    cuts = [len(item) * i // parts for i in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def best_stretch(item: str, text: str) -> tuple[int, int]:
    """``distance, end``: the least edit distance of the item to any stretch of the text (Myers), and its first end."""
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << len(item)) - 1, 1 << (len(item) - 1)
    plus, minus, distance = full, 0, len(item)
    best, end = distance, 0
    for at, c in enumerate(text, 1):
        match = masks.get(c, 0)
        vertical = match | minus
        carry = (((match & plus) + plus) ^ plus) | match
        up = minus | (full & ~(carry | plus))
        down = plus & carry
        if up & top:
            distance += 1
        elif down & top:
            distance -= 1
        up = (up << 1) & full
        down = (down << 1) & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
        if distance < best:
            best, end = distance, at
    return best, end


def _automaton(items, rate):
    found: dict[str, list] = {}
    for number, item in enumerate(items):
        for offset, piece in pieces(item, rate):
            found.setdefault(piece, []).append((number, offset))
    tree = ahocorasick.Automaton()
    for piece, places in found.items():
        tree.add_word(piece, (len(piece), places))
    tree.make_automaton()
    return tree


def _matches(text, tree, items, rate):
    """``item number -> (distance, start, end)`` for the items that the text contains within their budget."""
    windows: dict[int, list] = {}
    for end, (length, places) in tree.iter(text):
        for number, offset in places:
            k = budget(len(items[number]), rate)
            start = end + 1 - length - offset
            windows.setdefault(number, []).append((max(0, start - k), min(len(text), start + len(items[number]) + k)))
    out = {}
    for number, spans in windows.items():
        item = items[number]
        k, best = budget(len(item), rate), None
        spans.sort()
        merged = [list(spans[0])]
        for a, b in spans[1:]:
            if a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        for a, b in merged:
            exact = text.find(item, a, b)
            if exact >= 0:
                best = (0, exact, exact + len(item))
                break
            if b - a < len(item) - k:
                continue
            distance, end = best_stretch(item, text[a:b])
            if distance <= k and (best is None or distance < best[0]):
                back, length = best_stretch(item[::-1], text[a:a + end][::-1])
                best = (distance, a + end - length, a + end)
        if best:
            out[number] = best
    return out


_SCHEMA = "doc_id long, item_id long, distance int, start int, stop int"
_ARROW = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]


def leaks(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """``doc_id, item_id, distance, start, stop``: the items found in each document, with their nearest
    stretch in characters of the normalised text."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    blocks = max(1, math.ceil(items.count() / BLOCK))
    found = None
    for block in range(blocks):
        asked = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).distinct().collect()
        asked = sorted((r.item_id, n) for r in asked if len(n := normalised(r.text)) >= LEAST)
        if not asked:
            continue
        shared = spark.sparkContext.broadcast(asked)

        def run(batches, shared=shared):
            ids, texts = [i for i, _ in shared.value], [t for _, t in shared.value]
            tree = _automaton(texts, rate)
            for batch in batches:
                for part in rows(batch):
                    out = []
                    for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                        if text:
                            for number, (distance, start, stop) in _matches(normalised(text), tree, texts, rate).items():
                                out.append((doc_id, ids[number], distance, start, stop))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _ARROW)],
                                                         names=["doc_id", "item_id", "distance", "start", "stop"])

        part = docs.mapInArrow(run, _SCHEMA)
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], _SCHEMA)
    return found.groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "start", "stop")).alias("m")).select(
        "doc_id", "item_id", "m.distance", "m.start", "m.stop")


def clean_documents(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """The documents that contain no item."""
    return docs.join(leaks(docs, items, rate).select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)

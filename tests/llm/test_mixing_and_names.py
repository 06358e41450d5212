"""The mix against its own arithmetic, and stages that keep columns of any name."""

import math
import re

import pytest
from pyspark.sql import functions as F

from barloom.llm import mixing, quality

SCHEMA = "doc_id long, text string, source string"


def plain_targets(sizes):
    """Targets by raising sources to their limit one after the other until none is above."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if weight[s] * level >= 2 * sizes[s]}
        if not above:
            return out | {s: weight[s] * level for s in open_}
        for s in above:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= above
    return out


def rows_of(counts):
    rows, doc = [], 0
    for source, (docs, words) in counts.items():
        for i in range(docs):
            rows.append((doc, " ".join(["w"] * (words + i % 3)), source))
            doc += 1
    return rows


CASES = [
    {"a": (300, 9), "b": (300, 9), "c": (300, 9)},
    {"a": (3, 2), "b": (2_000, 4), None: (40, 30), "é": (70, 1)},
    {"x": (5, 0), "y": (50, 3)},
    {"only": (60, 5)},
]


@pytest.mark.parametrize("counts", CASES)
def test_targets_and_taken_words(spark, counts):
    rows = rows_of(counts) + [(-1, None, next(iter(counts)))]
    found = mixing.mixture(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows)
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _ in rows}
    source = {d: s for d, _, s in rows}
    totals = {s: sum(size[d] for d in size if source[d] == s) for s in counts}
    targets = plain_targets(totals)
    taken = dict.fromkeys(counts, 0)
    for r in found:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], totals[s])
        assert math.isclose(r.target, targets[s], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in counts:
        fraction = targets[s] / totals[s] % 1 if totals[s] else 0
        spread = math.sqrt(fraction * (1 - fraction) * sum(size[d] ** 2 for d in size if source[d] == s))
        assert abs(taken[s] - targets[s]) <= 5 * spread + 1e-6


def test_mix_emits_what_the_mixture_says_with_columns_of_any_name(spark):
    rows = [r + (7, 8, 9) for r in rows_of(CASES[1])] + [(5_000, "a b c", "b", 1, 2, 3)] * 2
    docs = spark.createDataFrame(rows, SCHEMA + ", rate int, copy int, `_source` int")
    out = mixing.mixed(docs)
    assert out.dtypes == docs.dtypes
    emitted = {(r.doc_id, r.source): r["n"] for r in out.groupBy("doc_id", "source").agg(F.count("*").alias("n")).collect()}
    wanted = mixing.mixture(docs).where("taken > 0").groupBy("doc_id").agg(F.sum(F.col("taken") / F.col("size")).alias("n")).collect()
    assert {k[0]: v for k, v in emitted.items()} == {r.doc_id: round(r.n) for r in wanted}
    assert out.where("rate = 8 or copy = 7 or _source is null").count() == 0


def test_empty_mix(spark):
    assert mixing.mixture(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mixing.mixed(spark.createDataFrame([], SCHEMA)).count() == 0


def test_classifier_keeps_a_column_with_the_name_of_its_score(spark):
    good, bad = "the careful report explains every result in plain words", "buy now cheap cheap click click win win"
    rows = [(i, f"{good if i % 2 else bad} {i}", -7.0) for i in range(120)] + [(500, None, -7.0), (501, "", -7.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality_score double")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(120)], "doc_id long, quality int, toxic int")
    out = quality.good_documents(docs, labels).collect()
    assert {r.doc_id for r in out} >= {i for i in range(120) if i % 2}
    assert not {r.doc_id for r in out} & {i for i in range(120) if not i % 2}
    assert all(r.quality_score == -7.0 for r in out)

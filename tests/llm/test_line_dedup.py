"""Repeated lines against a comparison of all pairs, and the awkward inputs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from barloom.llm import line_dedup

SCHEMA = "doc_id long, text string"
SPACE = re.compile(r"[ \t\n\x0b\x0c\r]+")


def words(line):
    return frozenset(re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in SPACE.split(line) if w)


def plain_repeats(rows):
    """``(doc_id, line number)`` of every line with an equal or similar one before it, and the set of each place."""
    lines = sorted(((d, i, words(x)) for d, t in rows if t is not None for i, x in enumerate(t.split("\n"))), key=lambda x: x[:2])
    lines = [x for x in lines if x[2]]
    out = {}
    for k, (d, i, own) in enumerate(lines):
        for d0, i0, other in lines[:k]:
            if (d, i) != (d0, i0) and 100 * len(own & other) >= 80 * len(own | other):
                out[d, i] = True
                break
    return set(out), {(d, i): s for d, i, s in lines}


def found_in(spark, rows):
    return line_dedup.repeats(spark.createDataFrame(rows, SCHEMA)).collect()


def mixed_rows(seed, n_docs=60):
    rng = random.Random(seed)
    rare = [f"w{i}" for i in range(400)]
    often = ["the", "of", "and", "to", "in", "Page", "é", "中文"]
    pool = []
    for _ in range(60):
        size = rng.choice([1, 2, 3, 4, 5, 6, 9, 10, 14, 30, 45, 60, 85, 120])
        pool.append([rng.choice(rare if rng.random() < 0.7 else often) for _ in range(size)])
    rows = []
    for d in range(n_docs):
        lines = []
        for _ in range(rng.randint(0, 8)):
            line = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 2, len(line) // 8, len(line) // 5])):
                line[rng.randrange(len(line))] = rng.choice(rare)
            lines.append((rng.choice([" ", "  ", "\t"])).join(line).upper() if rng.random() < 0.1 else " ".join(line))
        lines += [""] * rng.randint(0, 2)
        rng.shuffle(lines)
        rows.append((d * 3 - 20, "\n".join(lines)))
    return rows + [(7_000, None), (7_001, ""), (7_002, "\n \n\t")]


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_equal_a_comparison_of_all_pairs(spark, seed):
    rows = mixed_rows(seed)
    expected, sets = plain_repeats(rows)
    found = found_in(spark, rows)
    assert {(r.doc_id, r.line_no) for r in found} == expected and len(found) == len(expected) > 50
    for r in found:
        a, b = sets[r.doc_id, r.line_no], sets[r.first_doc_id, r.first_line_no]
        assert (r.first_doc_id, r.first_line_no) < (r.doc_id, r.line_no)
        assert abs(r.jaccard - len(a & b) / len(a | b)) < 1e-12 and r.jaccard >= 0.8


def test_lines_with_more_false_candidates_than_they_propose(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "KEPT", 1)
    monkeypatch.setattr(line_dedup, "MANY", 2)
    monkeypatch.setattr(line_dedup, "ROUNDS", (1, 2))
    rng = random.Random(5)
    base = [f"c{i}" for i in range(56)]
    rows = []
    for d in range(120):
        line = list(base)
        for at in rng.sample(range(56), rng.choice([4, 6, 7, 8, 9])):
            line[at] = f"v{rng.randrange(900)}"
        rows.append((d, " ".join(line)))
    expected, _ = plain_repeats(rows)
    assert {(r.doc_id, r.line_no) for r in found_in(spark, rows)} == expected


def test_short_lines_and_many_lines_in_one_document(spark):
    rows = [(1, "subscribe to our newsletter"), (2, "Subscribe to  our newsletter\nx"), (3, "subscribe to our newsletter\ny\nx")]
    assert {(r.doc_id, r.line_no) for r in found_in(spark, rows)} == {(2, 0), (3, 0), (3, 2)}
    long = "\n".join(f"line number {i // 2} of a very long text and nothing else" for i in range(6_000))
    assert len(found_in(spark, [(1, long)])) >= 3_000


def test_rows_that_repeat_an_id_share_their_fate(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, "a b c d e")]
    assert {(r.doc_id, r.line_no) for r in found_in(spark, rows)} == {(2, 0)}


def test_documents_lose_their_repeats_and_nothing_else(spark):
    rows = [(1, "one two three four five six\nown line", 5, "a", "b", 99), (2, "one two three four five six\n\nother words here", 6, "c", "d", 98),
            (3, "one two three four five six\n", 7, "e", "f", 97), (4, None, 8, "g", "h", 96), (None, "own line", 9, "i", "j", 95)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone int, key string, line_no string, n_chars int")
    out = line_dedup.without_repeats(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got = {r.doc_id: tuple(r) for r in out.collect()}
    assert got == {1: rows[0], 2: (2, "\nother words here", 6, "c", "d", 17), 4: rows[3], None: rows[4]}


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert line_dedup.repeats(empty).count() == 0
    assert line_dedup.without_repeats(empty.withColumn("x", F.lit(1))).collect() == []


def test_a_worker_gives_freed_memory_back():
    import numpy as np

    from barloom.llm.tokens import released

    def held():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    parts = [np.ones(12_000) for _ in range(1500)]   # 144 MB in pieces that the C library keeps
    last = parts[-1]
    del parts
    before = held()
    released()
    assert held() < before - 50_000_000 and len(last)


def test_keys_of_a_bitmap_are_made_once_and_apart_from_its_own_step(spark):
    import numpy as np

    from barloom.llm.components import bitmap, in_bitmap

    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    words = bitmap(spark.range(1000).mapInArrow(passed, "id long"), "id")
    assert seen.value == 1000
    assert in_bitmap(words, np.arange(1000)).all() and in_bitmap(words, np.arange(1000, 3000)).sum() < 400


def test_texts_lose_their_lines_in_one_python_step(spark):
    docs = spark.createDataFrame([(1, "a b c\nd e", 9), (2, "a b c\nnew line", 14), (3, "d e", 3)], SCHEMA + ", n_chars int")
    kept = line_dedup.without_repeats(docs)
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted(map(tuple, kept.collect())) == [(1, "a b c\nd e", 9), (2, "new line", 8)]

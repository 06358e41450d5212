"""Runs against a search of every lag, the digests against plain Python, and the awkward inputs."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import periodic


def plain_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        j = q
        while j < n:
            if w[j] != w[j - q]:
                j += 1
                continue
            k = j
            while k < n and w[k] == w[k - q]:
                k += 1
            stretch = w[j - q:k]
            size = len(stretch)
            if size >= max(6, 4 * q) and not any(all(stretch[x] == stretch[x - d] for x in range(d, size)) for d in range(1, q)):
                out.append((j - q, size, q))
            j = k
    return sorted(out, key=lambda r: (r[0], r[2]))


def _random_words(rng, most):
    n, kinds = rng.randint(0, most), rng.choice([1, 2, 2, 3, 5])
    w = [rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        if n > 8:
            a, p, m = rng.randrange(n), rng.randint(1, 12), rng.randint(1, 80)
            for i in range(a + p, min(n, a + m)):
                w[i] = w[i - p]
    return w


@pytest.mark.parametrize("block, long", [(1 << 14, 256), (16, 10), (7, 1)])
def test_runs_equal_a_search_of_every_lag(monkeypatch, block, long):
    monkeypatch.setattr(periodic, "_BLOCK", block)
    monkeypatch.setattr(periodic, "_LONG", long)
    periodic._first_places.cache_clear()
    rng = random.Random(3)
    for _ in range(1500):
        w = _random_words(rng, 110)
        assert periodic.runs_of(np.array(w, np.int64)) == plain_runs(w), w
    periodic._first_places.cache_clear()


def test_words_of_strings_with_two_letters_exhaustively():
    for n in range(6, 13):
        for bits in range(1 << n):
            w = [bits >> i & 1 for i in range(n)]
            assert periodic.runs_of(np.array(w, np.int64)) == plain_runs(w), w


def test_long_texts_stay_near_linear():
    for w in (np.zeros(300_000, np.int64), np.arange(300_000) % 1000, np.arange(300_000) % 75_000):
        q = int(w.max()) + 1
        assert periodic.runs_of(w) == [(0, 300_000, q)]


def plain_digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(runs), best[0], best[1], best[2], None if best[2] is None else 1000 * best[1] // best[2], sha(listed), sha(kept))


COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_digest_equals_plain_python(spark):
    rng = random.Random(8)
    spaces = [" ", "\n", "\t", "  ", "\x0b", "\r\n"]
    texts = [None, "", "   ", "one", "a " * 6, "a " * 5, "é ü " * 5, "a\xa0b " * 8, "a b " * 3, "a\x85a a a a a a"]
    texts += ["".join(f"w{x}" + rng.choice(spaces) for x in _random_words(rng, 90)) for _ in range(400)]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs string, n_words int").withColumn("longest", F.lit("mine"))
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in periodic.digest(docs).collect()}
    assert got == {i: plain_digest(i, t) for i, t in enumerate(texts)}
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 and v[0] for i, v in got.items())


def test_whole_table_equals_plain_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r["doc_id"]: plain_digest(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()}
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in periodic.digest(docs).collect()} == want


def test_empty_table_repeated_rows_and_null_ids(spark):
    schema = "doc_id bigint, text string"
    assert periodic.digest(spark.createDataFrame([], schema)).count() == 0
    docs = spark.createDataFrame([(1, "a " * 9), (1, "a " * 9), (None, "b c " * 6), (None, None)], schema)
    rows = sorted((r["doc_id"] or 0, r["n_runs"], r["period"] or 0) for r in periodic.digest(docs).collect())
    assert rows == [(0, 0, 0), (0, 1, 2), (1, 1, 1), (1, 1, 1)]


def test_collapsed_text_and_runs_of_the_operator(spark):
    docs = spark.createDataFrame([(5, "x go on go on go on go on y")], "doc_id bigint, text string")
    row = periodic.periodic_runs(docs).first()
    assert [tuple(r) for r in row["runs"]] == [(1, 8, 2)] and bytes(row["collapsed"]) == b"x go on y" and row["n_words"] == 10

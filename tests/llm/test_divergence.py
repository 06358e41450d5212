"""The audit against its SQL and against plain Python, its perfect hash, blocks and tiles, and the awkward inputs."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from barloom.llm import divergence


def plain_audit(rows, least, top):
    terms = lambda t: [m.translate({c: c + 32 for c in range(65, 91)}) for m in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    seen, counts, groups = Counter(), Counter(), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = terms(text)
        seen.update({(lang, t) for t in found})
        counts.update((lang, source, t) for t in found)
    kept = defaultdict(list)
    for (lang, t), n in seen.items():
        if n >= least:
            kept[lang].append(t)

    def shares(lang, count):
        total = sum(count(t) for t in kept[lang])
        return {t: 1 + 10 ** 9 * (count(t) + 5) // (total + 5 * len(kept[lang])) for t in kept[lang]}

    out = set()
    for lang in {g[0] for g in groups}:
        sources = sorted(s for g, s in groups if g == lang)
        p = {s: shares(lang, lambda t, s=s: counts[lang, s, t]) for s in sources}
        q = shares(lang, lambda t: sum(counts[lang, s, t] for s in sources))
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept[lang])) for o in sources if o != s]
            over = [(t, p[s][t] - q[t]) for t in kept[lang] if counts[lang, s, t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", over)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked) if part == "pair" or i < top}
    return out


def audited(docs, **settings):
    rows = divergence.audit(docs, **settings).collect()
    got = {(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in rows}
    assert len(got) == len(rows)
    return got


SCHEMA = "lang string, source string, text string"


def _rows(seed, documents, langs=("en", "fr", None), sources=("a", "B", "", None, "é", "z")):
    rng = random.Random(seed)
    words = ["the", "The", "THE", "été", "ÉTÉ", "x1y", "don't", "日本", "a", "b", "c\x7fd", "e_f", "ſ", "\xa0"] + [f"w{chr(97 + i)}" for i in range(20)]
    return [(rng.choice(langs), rng.choice(sources), rng.choice([None, "", "123 ."]) if rng.random() < 0.1 else
             " ".join(rng.choices(words, k=rng.randint(1, 30)))) for _ in range(documents)]


@pytest.mark.parametrize("seed, least, top", [(1, 3, 50), (2, 30, 2), (3, 1, 5)])
def test_audit_equals_plain_python(spark, seed, least, top):
    rows = _rows(seed, 200)
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"term": F.lit("x"), "shard": F.lit(1), "p": F.lit(2), "doc_id": F.lit(3)})
    assert audited(docs, least=least, top=top) == plain_audit(rows, least, top)


def test_small_blocks_shards_tiles_and_vectors_change_nothing(spark, monkeypatch):
    rows = _rows(5, 250, sources=[f"s{i}" for i in range(23)])
    for name, value in {"SHARD_KEYS": 4, "BLOCK_KEYS": 9, "DENSE_BYTES": 64, "COUNTED_TERMS": 7, "WIDTH": 3, "SOURCES": 4}.items():
        monkeypatch.setattr(divergence, name, value)
    assert audited(spark.createDataFrame(rows, SCHEMA), least=4, top=6) == plain_audit(rows, 4, 6)


def test_statement_equals_the_audit(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    rel = con.sql(divergence.AUDIT_SQL)
    order = [rel.columns.index(c) for c in ("lang", "source", "part", "item", "value", "rank")]
    want = {tuple(r[i] for i in order) for r in rel.fetchall()}
    assert audited(spark.read.parquet(f"{sf_dir}/documents.parquet")) == want and want


def test_no_kept_terms_and_empty_table(spark):
    rows = [("en", "a", "x"), ("en", "b", None), ("fr", None, "y"), ("en", "a", "x")]
    assert audited(spark.createDataFrame(rows, SCHEMA)) == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}
    assert audited(spark.createDataFrame([], SCHEMA)) == set()


def test_one_language_without_kept_terms_beside_another(spark):
    rows = [("en", s, "the cat") for s in "ab"] * 3 + [("fr", s, f"mot{s}") for s in "ab"]
    assert audited(spark.createDataFrame(rows, SCHEMA), least=3) == plain_audit(rows, 3, 50)


def test_repeated_rows_and_very_long_texts_and_terms(spark):
    long = "日" * 50_000
    rows = [("en", "a", "the " * 60_000 + long)] * 3 + [("en", "b", "cat " + long)] * 3
    assert audited(spark.createDataFrame(rows, SCHEMA), least=3) == plain_audit(rows, 3, 50)


def test_perfect_hash_is_minimal_and_verified():
    keys = [f"k{i}".encode() for i in range(5000)] + [b"\xff\xfe"]
    hash_ = divergence.PerfectHash.of(keys)
    slots = hash_.slots(divergence.hashed(keys), keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))
    assert [hash_.keys[s] for s in slots.tolist()] == keys
    strangers = [f"x{i}".encode() for i in range(20000)]
    assert (hash_.slots(divergence.hashed(strangers), strangers) == -1).all()
    assert divergence.PerfectHash.of([]).slots(divergence.hashed([b"a"]), [b"a"]).tolist() == [-1]


def test_keys_that_hash_alike_still_have_their_own_slots(monkeypatch):
    monkeypatch.setattr(divergence.xxhash, "xxh3_128_digest", lambda k: b"\0" * 15 + bytes([k[0] % 3]))
    keys = [bytes([i]) for i in range(9)]
    hash_ = divergence.PerfectHash.of(keys)
    assert sorted(hash_.slots(divergence.hashed(keys), keys).tolist()) == list(range(9))
    assert hash_.slots(divergence.hashed([b"z"]), [b"z"]).tolist() == [-1]

"""Benchmark leaks, near-duplicate groups and fingerprints against plain definitions on small tables."""

import hashlib
import random
import re

import numpy as np

from barloom.llm import decontaminate, fingerprints, line_dedup, ngram_jaccard

SCHEMA = "doc_id long, text string"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def least_distance(item, text):
    """Edit distance of the item to the nearest stretch of the text, by the full table."""
    above = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        row = [i]
        for j, t in enumerate(text, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (c != t)))
        above = row
    return min(above)


def test_myers_distance_equals_the_full_table():
    rng = random.Random(5)
    for _ in range(150):
        item = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 80)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 120)))
        assert decontaminate.best_stretch(item, text)[0] == least_distance(item, text)


def test_leaks_equal_a_comparison_of_all_pairs(spark):
    rng = random.Random(8)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "té", "zu") for b in ("ra", "ne", "x", "ston")]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(8, 16)))) for i in range(12)]
    docs = []
    for d in range(40):
        inner = list(items[d % 12][1])
        for _ in range(rng.randint(0, 8)):
            inner[rng.randrange(len(inner))] = rng.choice(["", "q", " ", "ab"])
        around = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 15))) for _ in range(2)]
        docs.append((d, f"{around[0]}\n{''.join(inner).upper()}!  {around[1]}"))
    docs += [(100, None), (101, ""), (102, "x"), docs[0]]
    found = decontaminate.leaks(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([*items, (99, None), (98, "")], "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r.distance for r in found.collect()}
    wanted = {}
    for d, text in docs:
        for i, item in items:
            item = decontaminate.normalised(item)
            distance = least_distance(item, decontaminate.normalised(text))
            if distance <= decontaminate.budget(len(item)):
                wanted[d, i] = distance
    assert len(wanted) > 20
    assert got == wanted


def shingles(text):
    words = [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in SPACE.split(text or "") if w]
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def near_rows(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows, ids = [], rng.sample(range(-10_000, 10_000), 100)
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([1, 3, 5, 8, 40, 90, 300]))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((ids.pop(), rng.choice([" ", "\n", "\t "]).join(copy).upper()))
    return rows + [(90_001, None), (90_002, ""), (90_003, " \n"), (90_004, rows[0][1]), (90_005, "Ein Wort"), (90_006, "ein WORT")]


def test_components_equal_a_comparison_of_all_pairs(spark):
    rows = near_rows(3)
    sets = {d: shingles(t) for d, t in rows}
    least = {d: d for d in sets}

    def root(d):
        while least[d] != d:
            d = least[d]
        return d

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                least[y] = x
    wanted = {(d, len(sets[d]), root(d)) for d in ids}
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", component_id int, a string")
    found = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard.jaccard_components(docs).collect()]
    assert len(found) == len(rows) and set(found) == wanted
    assert len({c for _, _, c in wanted}) < len(wanted) - 5


def test_pairs_of_few_and_of_many_classes_are_the_same(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(1, 1 << 62, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: 400 - 3 * k], rng.integers(1, 1 << 62, k).astype(np.uint64)])) for k in range(40)]
    classes = spark.createDataFrame(
        [(100 + k, k, len(s), bytearray(ngram_jaccard._bitmap(s)), k // 4) for k, s in enumerate(sets)],
        "s1 long, rep long, n long, bits binary, comp long")
    members = spark.createDataFrame([(g, 100 + k) for g in range(6) for k in range(40) if (k + g) % 3], "gid long, sid long")
    found = []
    for few in (0, 1000):
        monkeypatch.setattr(ngram_jaccard, "FEW", few)
        found.append({(r.a, r.b) for r in ngram_jaccard._crossing_pairs(members, classes, 80).collect()})
    assert found[0] == found[1]
    linked = {(i, j) for j in range(40) for i in range(j) if i // 4 != j // 4
              and 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))}
    assert linked and linked <= found[0]


def test_a_signature_has_about_as_many_bits_as_the_set_members():
    sizes = {n: 8 * len(ngram_jaccard._bitmap(np.arange(n, dtype=np.uint64))) for n in (1, 256, 300, 1000, 3000)}
    assert sizes == {1: 256, 256: 256, 300: 512, 1000: 1024, 3000: 4096}


def test_edited_texts_and_fingerprints_by_definition(spark):
    rows = near_rows(4)
    found = {r.doc_id: r for r in fingerprints.edited_likeness(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(found) == len(rows)
    order = sorted(rows, reverse=True)
    by_text, errors = {}, []
    for k, (d, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        row = found[d]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(text, row.fingerprint) == row.fingerprint
        a, b = shingles(text), shingles(edited)
        if a and b:
            errors.append(abs(row.near_edited - len(a & b) / len(a | b)))
    assert np.mean(errors) < 0.04 and max(errors) < 0.2


def test_no_documents(spark):
    docs = spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame([(1, "an item that is long enough to be looked for")], "item_id long, text string")
    assert decontaminate.leaks(docs, items).count() == 0
    assert ngram_jaccard.jaccard_components(docs).count() == 0
    assert fingerprints.edited_likeness(docs).count() == 0


def test_copies_within_a_slice_name_the_first_one():
    rng = np.random.default_rng(2)
    n, check = rng.integers(0, 3, 400), rng.integers(0, 2, 400).astype(np.uint32)
    wide = rng.integers(0, 2, (400, 4)).astype(np.uint64)
    doc, number = rng.integers(-9, 9, 400), rng.integers(0, 40, 400)
    again, leader = line_dedup._copies(n, check, wide, doc, number)
    groups = {}
    for i in range(400):
        if n[i]:
            groups.setdefault((n[i], check[i], *wide[i]), []).append((doc[i], number[i]))
    assert len(again) == sum(len(g) - 1 for g in groups.values())
    for a, b in zip(again, leader):
        own = groups[n[a], check[a], *wide[a]]
        assert (doc[b], number[b]) == min(own) and (doc[a], number[a]) in own

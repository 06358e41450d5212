"""Base spans against a plain scan, what the trees add, and the awkward inputs."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from barloom.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (2 * d > 9)
    return total % 10 == 0


def plain_spans(text):
    found = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                    "card": lambda: 14 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 10 <= len(digits) <= 15}[kind]()
            if good:
                found.append((m.start(), k, m.end(), kind))
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found)]


def results(spark, texts, **extra):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    for name, value in extra.items():
        docs = docs.withColumn(name, F.lit(value))
    return {r["doc_id"]: r for r in pii.digest(docs).collect()}


def check_base(texts, got):
    for i, text in enumerate(texts):
        want = plain_spans(text)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (text or "")[:200]
        kinds = [w.split(":")[0] for w in want]
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [kinds.count(k) for k in PATTERNS]
        assert set(want) <= set(got[i]["spans"].split(",") if got[i]["spans"] else [])


AWKWARD = [
    None, "", " ", "no data here", "a@b", "a@b.c_x@d.e", "a.b@c.d.e.@f.g", "x@y.z@w.v", "é@b.c ñ.1@b.c", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.02.3.255",
    "1.2.3.999 1.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111  1111 1111 1111", "+1 (269) 555-3296 4539578763621486", "+1 (269) 555-3296",
    "+12345678901234567", "+1 2", "1@2.3.4.5", "\U0001f600 a@b.co \U0001f600 10.0.0.1", "+1 (017) 555-7713 190.137.223.204 x", "10.0.0.1\n10.0.0.1 a@b.c,a@b.c",
]


def test_base_spans_of_awkward_texts(spark):
    check_base(AWKWARD, results(spark, AWKWARD, spans="mine", base=1, proposed="x", any=True))


def test_base_spans_of_random_texts(spark):
    rng = random.Random(4)
    pieces = ["a", "Z", "9", "0", "12", "255", "256", ".", "@", "-", " ", "+", "(", ")", "%", "_", "é", "\n", "4111111111111111", "+1 (269) 555-3296", "a@b.cd", "1.2.3.4"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    check_base(texts, results(spark, texts))


def test_long_texts(spark):
    # The plain scan is quadratic in some of these, so what they hold is stated instead.
    texts = {"9" * 200_000: (0, 0), "a" * 200_000: (0, 0), "a@b.cd " * 30_000: (30_000, 0), "1 " * 100_000: (0, 0), "1.2.3.4 " * 20_000: (0, 20_000),
             "(" * 50_000 + "+1" + "(" * 50_000: (0, 0), "a.b-" * 60_000 + "@": (0, 0), "x" * 100_000 + "@b.cd": (1, 0)}
    got = results(spark, list(texts))
    for i, (text, (emails, ips)) in enumerate(texts.items()):
        assert (got[i]["n_email"], got[i]["n_ip"], got[i]["n_card"], got[i]["n_phone"]) == (emails, ips, 0, 0), text[:20]
        base = [f"email:{7 * k}:{7 * k + 6}" for k in range(emails)] if emails > 1 else [f"ip:{8 * k}:{8 * k + 7}" for k in range(ips)]
        if base:
            assert got[i]["spans"].split(",") == base


def _corpus():
    rng = random.Random(2)

    def card():
        while True:
            digits = "4" + "".join(rng.choice("0123456789") for _ in range(15))
            if luhn(digits):
                return digits

    def phone():
        return f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"

    texts = []
    for _ in range(150):
        texts += [f"the card {card()} is", f"call {phone()} now", 'token = "' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '" is',
                  f"version {rng.randint(1, 9)}.0 of the text", f"page {rng.randint(10, 999)} of {rng.randint(1000, 9999)}"]
    return texts, card(), phone()


def test_trees_add_what_the_base_cannot_part(spark):
    texts, card, phone = _corpus()
    secret = "9a" * 20
    extra = [f"call {phone} {card} and on", f"pass {secret} on", "version 3.0 of page 12"]
    got = results(spark, texts + extra)
    n = len(texts)
    assert got[n]["n_phone"] == got[n]["n_card"] == 0
    a, b = extra[0].index(phone), extra[0].index(card)
    assert {f"phone:{a}:{a + len(phone)}", f"card:{b}:{b + 16}"} <= set(got[n]["spans"].split(","))
    assert got[n + 1]["spans"] == f"secret:5:{5 + len(secret)}"
    assert got[n + 2]["spans"] == ""
    assert all(got[i]["spans"] == "" for i, t in enumerate(texts) if t.startswith(("version", "page")))
    assert results(spark, texts + extra) == got  # reruns agree


def test_without_the_trees_nothing_is_added(spark, monkeypatch):
    texts, card, phone = _corpus()
    monkeypatch.setattr(pii, "fitted", lambda found: None)
    got = results(spark, [*texts, f"call {phone} {card} and on"])
    assert got[len(texts)]["spans"] == ""


def test_empty_table_repeated_rows_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert pii.digest(empty).count() == 0
    docs = spark.createDataFrame([(1, "a@b.cd"), (1, "a@b.cd"), (None, "a@b.cd"), (2, None)], "doc_id bigint, text string")
    rows = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["spans"]) for r in pii.digest(docs).collect())
    assert rows == [(False, 1, "email:0:6"), (False, 1, "email:0:6"), (False, 2, ""), (True, 0, "email:0:6")]


@pytest.mark.parametrize("text, want", [
    ("a@b.cd and 10.0.0.1!", "[email] and [ip]!"), ("nothing", "nothing"), ("10.0.0.1", "[ip]"), ("x 1@2.3.4.5 é", "x [email] é")])
def test_redaction(spark, text, want):
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(pii.redacted(F.col("text"), pii.base_spans(F.col("text")))).first()[0] == want


def test_no_python_on_the_path(spark, sf_dir):
    plan = pii.candidates(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan

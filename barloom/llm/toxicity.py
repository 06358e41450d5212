"""Toxicity by a weighted finite-state pattern grammar.

A lexicon transducer maps every word to a class with a weight: insults and threats (seeds and
stems learned from labels), targets, negations and words of reported speech. Clauses (split at
.!?; and line ends) are then read by the composed machine, whose state is the distance to the
last negation, whether a target was named and whether the clause reports speech:

* an insult scores its weight; within three words after a negation a quarter of it,
  in reported speech half of it, and with a target in the clause a quarter more;
* a threat scores only with a target in the clause.

A text is the whole of its clauses: the sum and the largest of their scores and the number of
matched clauses enter a logistic calibration.

Learned from labels are the stems and the calibration, on a bounded sample. A stem is a word
beginning or a whole word; it counts when it is in toxic texts so much more often than in
others that chance is excluded for all stems together (likelihood ratio, equal texts once).
Only the text is an input of a score. Null and empty texts have no clause and take the
calibration's base; without labels of both kinds the calibration is a fixed one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.splits import labelled_texts, logistic, remainder

SAMPLE = 6_000
LEAST_TEXTS = 3
STEMS_MOST = 5_000
SHORTEST, LONGEST = 3, 10
CACHE_WORDS = 300_000
MODULUS, HELD_OUT = 5, 0

# Seed lexicons; weights of learned stems are log odds on the same scale.
SEED_WEIGHT = 3.0
INSULTS = ("idiot idiots moron morons stupid scum loser losers trash pathetic worthless disgusting clown imbecile dumbass vermin "
           "dummkopf abschaum trottel versager imbécile ordure minable idiota basura escoria imbécil inútil").split()
THREATS = ("kill kills hurt destroy beat stab shoot burn strangle töten umbringen verprügeln tuer frapper brûler matar golpear "
           "quemar").split()
TARGETS = "you your yours yourself he she they them him her du dich dir euch ihr sie tu toi vous te ti usted ustedes".split()
NEGATIONS = "not no never nobody isn aren wasn don doesn didn nicht kein keine nie pas jamais aucun nunca jamás ningún".split()
REPORTS = ("said says say told tells claimed claims wrote writes called calls quoted allegedly sagte sagt schrieb behauptete dit écrit "
           "affirme dijo dice escribió").split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, STOP = range(7)
_TOKENS = re.compile(r"[^\W\d_]+|[.!?;\n]")
NEGATION_REACH = 3


class Lexicon(dict):
    """Word -> its class; ``weight`` has the weight of insults and threats. Forgets everything when it is full."""

    def __init__(self, stems: dict):
        super().__init__()
        self.words = {w: (INSULT, SEED_WEIGHT) for w in INSULTS} | {w: (THREAT, SEED_WEIGHT) for w in THREATS}
        for kind, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
            self.words |= {w: (kind, 0.0) for w in words}
        self.whole = {s[1:]: w for s, w in stems.items() if s[0] == "="}
        self.begins = {s: w for s, w in stems.items() if s[0] != "="}
        self.spans = sorted({len(s) for s in self.begins})
        self.weight: dict = {}

    def __missing__(self, word):
        if len(self) >= CACHE_WORDS:
            self.clear()
            self.weight.clear()
        kind, weight = self.words.get(word, (OTHER, 0.0))
        if word in ".!?;\n":
            kind = STOP
        learned = max([self.whole.get(word, 0.0), *(self.begins.get(word[:n], 0.0) for n in self.spans if n <= len(word))])
        if learned > 0 and kind in (OTHER, INSULT):
            kind, weight = INSULT, max(weight, learned)
        if weight:
            self.weight[word] = weight
        self[word] = kind
        return kind


def clause_score(kinds: list, weights: list) -> float:
    """The machine's output for one clause, given the classes of its words and their weights."""
    targeted, reported = TARGET in kinds, REPORT in kinds
    since_negation, total = NEGATION_REACH + 1, 0.0
    for kind, weight in zip(kinds, weights):
        since_negation += 1
        if kind == NEGATION:
            since_negation = 0
        elif kind == INSULT or (kind == THREAT and targeted):
            value = weight * (1.25 if targeted and kind == INSULT else 1.0)
            if since_negation <= NEGATION_REACH:
                value *= 0.25
            total += value * (0.5 if reported else 1.0)
    return total


def features(text: str | None, lexicon: Lexicon) -> tuple[float, float, float]:
    """Sum and maximum of the clause scores, and the logarithm of one more than the matched clauses."""
    words = _TOKENS.findall((text or "").lower())
    kinds = np.fromiter(map(lexicon.__getitem__, words), np.int8, len(words))
    marks = np.flatnonzero((kinds == INSULT) | (kinds == THREAT))
    if not len(marks):
        return 0.0, 0.0, 0.0
    stops = np.flatnonzero(kinds == STOP)
    which = np.unique(np.searchsorted(stops, marks))
    scores = []
    for c in which.tolist():
        a = int(stops[c - 1]) + 1 if c else 0
        b = int(stops[c]) if c < len(stops) else len(words)
        part = words[a:b]
        own = [lexicon[w] for w in part]
        scores.append(clause_score(own, [lexicon.weight.get(w, 0.0) for w in part]))
    matched = [s for s in scores if s > 0]
    return (sum(matched), max(matched), math.log1p(len(matched))) if matched else (0.0, 0.0, 0.0)


def _stems_of(text):
    words = set(_TOKENS.findall(text.lower()))
    out = {"=" + w for w in words if len(w) >= SHORTEST}
    for w in words:
        out.update(w[:n] for n in range(SHORTEST, min(LONGEST, len(w)) + 1))
    return out


def _stem_counts(frames):
    """Per batch how many toxic and other texts hold each stem; equal texts of a batch count once."""
    for pdf in frames:
        pdf = pdf.drop_duplicates(["text", "label"])
        toxic: Counter = Counter()
        for text in pdf.loc[pdf["label"] == 1, "text"]:
            toxic.update(_stems_of(text))
        clean: Counter = Counter()
        for text in pdf.loc[pdf["label"] == 0, "text"]:
            clean.update(_stems_of(text))
        names = sorted(toxic.keys() | {s for s, n in clean.items() if n > 1})
        texts = Counter(pdf["label"])
        yield pd.DataFrame({"stem": ["", *names], "toxic": [texts[1], *(toxic[s] for s in names)], "clean": [texts[0], *(clean[s] for s in names)]})


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> dict:
    """Stems with their weights, and the calibration, from about ``bound`` labelled rows (twice as many at most)."""
    spark = docs.sparkSession
    sample = labelled_texts(docs, labels, "toxic", MODULUS, HELD_OUT, bound)
    counts = sample.select("text", "label").mapInPandas(_stem_counts, "stem string, toxic long, clean long").groupBy("stem").agg(
        F.sum("toxic").alias("t"), F.sum("clean").alias("c")).where(f"t >= {LEAST_TEXTS} or stem = ''")
    total = counts.where("stem = ''").select("t", "c").first()
    toxic, clean = (total.t, total.c) if total else (0, 0)
    stems = {}
    if toxic and clean:
        share = toxic / (toxic + clean)
        rare = counts.where("stem != ''").where(F.col("t") / (F.col("t") + F.col("c")) > max(0.5, share))
        n = F.col("t") + F.col("c")
        other = F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / (n * (1 - share)))).otherwise(0.0)
        rare = rare.withColumn("ratio", 2 * (F.col("t") * F.log(F.col("t") / (n * share)) + other))
        threshold = 2 * (math.log(max(counts.count(), 2)) + 1)
        found = rare.where(F.col("ratio") > threshold).orderBy(F.desc("ratio"), "stem").limit(STEMS_MOST).toPandas()
        for stem, t, c in zip(found["stem"], found["t"], found["c"]):
            stems[stem] = min(6.0, math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1)))
    shared = spark.sparkContext.broadcast(stems)

    def measure(frames):
        lexicon = Lexicon(shared.value)
        for pdf in frames:
            yield pd.DataFrame([(int(y), *features(t, lexicon)) for y, t in zip(pdf["label"], pdf["text"])], columns=["label", "a", "b", "c"])

    got = sample.select("label", "text").mapInPandas(measure, "label int, a double, b double, c double").toPandas()
    return {"stems": stems, "weights": _calibration(got)}


def _calibration(got) -> np.ndarray:
    """Weights of (1, log sum, log maximum, log count) by damped Newton steps. What would lower the score
    with more evidence is left out, so the score grows with each matched clause."""
    fixed = np.array([-3.0, 0.5, 1.0, 0.5])
    y = got["label"].to_numpy(float)
    if not 0 < y.sum() < len(y):
        return fixed
    x = np.column_stack([np.ones(len(y)), np.log1p(got["a"]), np.log1p(got["b"]), got["c"]])
    used = [0, 1, 2, 3]
    while True:
        z, w = x[:, used], np.zeros(len(used))
        ridge = np.diag([1e-3] + [0.1] * (len(used) - 1))
        for _ in range(60):
            p = logistic(z @ w)
            hessian = (z * (p * (1 - p))[:, None]).T @ z + ridge
            w = w - np.clip(np.linalg.solve(hessian, z.T @ (p - y) + ridge @ w), -1, 1)
        falling = [i for i, v in zip(used[1:], w[1:]) if v < 0]
        if not falling:
            break
        used.remove(min(falling, key=lambda i: w[used.index(i)]))
    out = np.zeros(4)
    out[used] = w
    return out


def score(docs: DataFrame, model: dict, name: str = "toxicity") -> DataFrame:
    """All columns of ``docs`` with the probability of label 1 of the whole text as column ``name``; a column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxicity(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon, w = Lexicon(shared.value["stems"]), shared.value["weights"]
        for texts in parts:
            x = np.array([features(t, lexicon) for t in texts]).reshape(-1, 3)
            yield pd.Series(logistic(np.column_stack([np.ones(len(x)), np.log1p(x[:, 0]), np.log1p(x[:, 1]), x[:, 2]]) @ w))

    return docs.withColumn(name, toxicity(F.col("text").cast("string")))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", (remainder("doc_id", MODULUS) == HELD_OUT).alias("held_out"), F.col("toxicity").alias("score"),
                         (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))

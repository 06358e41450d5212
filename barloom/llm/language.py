"""Language identification by segmentation-marginalised unigrams.

The pieces are those entries of a fixed public vocabulary that are made of letters, in lower
case, with the mark of a word's beginning. A language is a probability for each piece. The
likelihood of a word is the sum over all its segmentations into pieces of the product of their
probabilities, by the forward algorithm; a character outside all pieces counts as an unknown
piece. A text is the product of its words (runs of letters), whole and in lower case, and its
score is the posterior of the likeliest language, tempered by the square root of its words.

The probabilities are learned by expectation maximisation (forward-backward over all
segmentations) from a bounded sample of texts per language. The vocabulary's path is a
parameter; the tokenizer itself is not trained.

Null texts, and texts without letters, are ``und`` with the score 0. Without labelled texts
everything is ``und``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.splits import remainder

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLE = 400            # documents per language that the pieces are learned from, about
ROUNDS = 4
LONGEST = 12
STRETCH = 60            # letters of a word that are segmented together
UNKNOWN = "�"
BEGIN = "▁"
CACHE_WORDS = 300_000
MODULUS, HELD_OUT = 4, 2
_GRAIN = 1_000_000
_WORDS = re.compile(r"[^\W\d_]+")


def vocabulary(path: str = VOCABULARY) -> list[str]:
    """The pieces of letters of a sentencepiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {UNKNOWN, BEGIN}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i).lower()
        letters = piece.removeprefix(BEGIN)
        if len(piece) <= LONGEST and letters.isalpha():
            found.add(piece)
    return sorted(found)


def _arcs(word: str, pieces) -> list[list]:
    """For each position of the marked word, the pieces that begin there as (end, piece)."""
    text = BEGIN + word
    out = []
    for i in range(len(text)):
        here = [(j, text[i:j]) for j in range(i + 1, min(len(text), i + LONGEST) + 1) if text[i:j] in pieces]
        out.append(here if any(j == i + 1 for j, _ in here) else [*here, (i + 1, UNKNOWN)])
    return out


def _expected(words: dict, chance: dict) -> dict:
    """Expected piece counts of the words under ``chance``, over all segmentations."""
    counts = dict.fromkeys(chance, 0.0)
    for word, times in words.items():
        arcs = _arcs(word, chance)
        n = len(arcs)
        front, back = [1.0] + [0.0] * n, [0.0] * n + [1.0]
        for i, here in enumerate(arcs):
            for j, piece in here:
                front[j] += front[i] * chance[piece]
        if not front[n] > 1e-280:
            continue
        for i in range(n - 1, -1, -1):
            back[i] = sum(chance[piece] * back[j] for j, piece in arcs[i])
        for i, here in enumerate(arcs):
            for j, piece in here:
                counts[piece] += times * front[i] * chance[piece] * back[j] / front[n]
    return counts


def _learned(pieces):
    """Of a language's word counts the log probability of every piece."""

    def run(pdf):
        words = dict(zip(pdf["word"], pdf["n"]))
        chance = dict.fromkeys(pieces.value, 0.0)
        chance = {p: (0.02 if len(p) == 1 else 0.001) / len(chance) for p in chance}
        for _ in range(ROUNDS):
            counts = _expected(words, chance)
            smooth = 0.05
            total = sum(counts.values()) + smooth * len(counts)
            chance = {p: (c + smooth) / total for p, c in counts.items()}
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "piece": list(chance), "chance": list(chance.values())})

    return run


def _word_counts(frames):
    for pdf in frames:
        counts: dict = {}
        for lang, text in zip(pdf["lang"], pdf["text"]):
            own = counts.setdefault(lang, {})
            for word in _WORDS.findall(text.lower()):
                own[word] = own.get(word, 0) + 1
        for lang, own in counts.items():
            yield pd.DataFrame({"lang": lang, "word": list(own), "n": list(own.values())})


def fit(docs: DataFrame, bound: int = SAMPLE, path: str = VOCABULARY) -> dict:
    """``languages`` and, for each piece, its probability in each of them.

    Each language's texts are chosen by a hash of the doc_id at a rate of ``bound`` by their
    number, so the languages' word counts are bounded; all texts of a smaller language count."""
    spark = docs.sparkSession
    usable = docs.where("lang is not null and text is not null").where(remainder("doc_id", MODULUS) != HELD_OUT)
    sizes = usable.groupBy("lang").agg(F.count("*").alias("n")).toPandas()
    if not len(sizes):
        return {"languages": [], "pieces": {}, "chance": None}
    rates = F.create_map(*[x for lang, n in zip(sizes["lang"], sizes["n"]) for x in (F.lit(lang), F.lit(int(min(1, bound / n) * _GRAIN) + 1))])
    sample = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(_GRAIN)) < rates[F.col("lang")])
    counts = sample.select("lang", F.col("text").cast("string").alias("text")).mapInPandas(_word_counts, "lang string, word string, n long")
    counts = counts.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    pieces = spark.sparkContext.broadcast(vocabulary(path))
    learned = counts.groupBy("lang").applyInPandas(_learned(pieces), "lang string, piece string, chance double").toPandas()
    names = sorted(learned["lang"].unique())
    column = {lang: i for i, lang in enumerate(names)}
    index = {piece: i for i, piece in enumerate(pieces.value)}
    chance = np.full((len(index), len(names)), 1e-12)
    chance[learned["piece"].map(index), learned["lang"].map(column)] = learned["chance"]
    return {"languages": names, "pieces": index, "chance": chance}


class Likelihoods(dict):
    """Word -> row of ``matrix``, its log likelihood in every language; forgets everything when it is full."""

    def __init__(self, model):
        super().__init__()
        self.chance = model["chance"]
        self.unknown = model["pieces"][UNKNOWN]
        # Every beginning of a piece leads to the piece's number, or to -1 if it is none itself.
        self.begins = {piece[:k]: -1 for piece in model["pieces"] for k in range(1, len(piece))} | model["pieces"]
        self.matrix = np.zeros((CACHE_WORDS, self.chance.shape[1]))

    def add(self, words: list):
        """Scores new words together: one step for each position, over the pieces that begin there in any word."""
        at, get = [], self.begins.get
        for w, word in enumerate(words):
            text = BEGIN + word
            n = len(text)
            for i in range(n):
                single = False
                for j in range(i + 1, n + 1):
                    p = get(text[i:j])
                    if p is None:
                        break
                    if p >= 0:
                        at += i, w, j, p
                        single = single or j == i + 1
                if not single:
                    at += i, w, i + 1, self.unknown
        arcs = np.fromiter(at, np.int64, len(at)).reshape(-1, 4)
        arcs = arcs[np.argsort(arcs[:, 0], kind="stable")]
        lengths = np.array([len(w) + 1 for w in words])
        longest = int(lengths.max())
        front = np.zeros((len(words), longest + 1, self.chance.shape[1]))
        front[:, 0] = 1.0
        cuts = np.searchsorted(arcs[:, 0], np.arange(longest + 1))
        for i in range(longest):
            _, w, j, p = arcs[cuts[i]:cuts[i + 1]].T
            front[w, j] += front[w, i] * self.chance[p]   # the ends of a word's pieces from here differ
        row = len(self)
        self.matrix[row:row + len(words)] = np.log(np.maximum(front[np.arange(len(words)), lengths], 1e-300))
        self.update(zip(words, range(row, row + len(words))))

    def prepare(self, texts: list):
        """Scores the words of several texts at once, if they fit."""
        fresh = {w for t in texts if t for w in _WORDS.findall(t.lower()) if len(w) <= STRETCH}
        if len(self) + len(fresh) > CACHE_WORDS:
            self.clear()
        fresh = sorted(fresh.difference(self))[:CACHE_WORDS - len(self)]
        for k in range(0, len(fresh), 4_000):
            self.add(fresh[k:k + 4_000])

    def of(self, texts: list):
        """For each text the log likelihoods of its words together, and how many there are."""
        out = []
        for text in texts:
            # A run of letters beyond any word's length is scored in stretches.
            words = [w[k:k + STRETCH] for w in _WORDS.findall((text or "").lower()) for k in range(0, len(w), STRETCH)]
            total = np.zeros(self.chance.shape[1])
            for start in range(0, len(words), CACHE_WORDS // 4):
                part = words[start:start + CACHE_WORDS // 4]
                if len(self) + len(part) > CACHE_WORDS:
                    self.clear()
                fresh = [w for w in dict.fromkeys(part) if w not in self]
                for k in range(0, len(fresh), 4_000):
                    self.add(fresh[k:k + 4_000])
                ids = np.fromiter(map(self.__getitem__, part), np.int64, len(part))
                total += self.matrix[ids].sum(axis=0)
            out.append((total, len(words)))
        return out


def _groups(texts, letters=400_000):
    """Lists of texts of about so many characters together."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text or "")
        if size > letters:
            yield group
            group, size = [], 0
    if group:
        yield group


def languages(docs: DataFrame, model: dict, name: str = "found") -> DataFrame:
    """All columns of ``docs`` with a struct of the language and its score as column ``name``; a column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = shared.value["languages"]
        cache = Likelihoods(shared.value) if names else None
        for texts in parts:
            out = []
            for group in _groups(texts):
                if names:
                    cache.prepare(group)
                for total, n in cache.of(group) if names else [(None, 0)] * len(group):
                    if not n:
                        out.append(("und", 0.0))
                        continue
                    weight = np.exp((total - total.max()) / math.sqrt(n))
                    best = int(total.argmax())
                    out.append((names[best], float(weight[best] / weight.sum())))
            yield pd.DataFrame(out, columns=["lang", "score"])

    return docs.withColumn(name, found(F.col("text").cast("string")))


def language_of_documents(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row."""
    model = fit(docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")), path=path)
    scored = languages(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (remainder("doc_id", MODULUS) == HELD_OUT).alias("held_out"), F.col("found.lang").alias("lang_pred"),
                         F.col("found.score").alias("score"))

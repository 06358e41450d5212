"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

* Every word and every shape of a token (capitals, small letters, digits, marks) has a sparse
  random *index vector* that follows from its hash.
* Random indexing: the *context vector* of a frequent token is the sum of the index vectors
  around it, gathered over a bounded sample of labelled texts.
* A token is the index vectors of its shape and, if it is known, its word, with the word's
  context vector; a document is the mean of its tokens, with its length and rates of repetition.
* A two-layer numpy network is trained on the sample, and a temperature fitted on a fifth of
  it that training does not see turns its output into a calibrated probability.

Only the text is ever an input. The sample is bounded by ``SAMPLE`` rows; scoring takes every
whole text. Null and blank texts are scored as texts without tokens. Without labelled rows of
both kinds every score is the smoothed share of label 1.
"""

from collections.abc import Iterator


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from barloom.llm.components import fresh_names
from barloom.llm.splits import labelled_texts, logistic, remainder

DIM = 48
NONZERO = 6
WINDOW = 2
SAMPLE = 5_000         # labelled rows the model is fitted on
VOCABULARY = 20_000    # tokens with a context vector, the most frequent of the sample
LEAST_COUNT = 5
HIDDEN = 24
SHRINK = 5
CACHE_TOKENS = 400_000  # tokens that a task remembers
CACHE_ROWS = 100_000
MODULUS, HELD_OUT = 3, 1


def _index_vector(name: str) -> np.ndarray:
    vector, state = np.zeros(DIM, np.float32), xxh64_intdigest(name)
    for _ in range(NONZERO):
        state = (state * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        vector[(state >> 33) % DIM] += 1.0 if state >> 63 else -1.0
    return vector / NONZERO ** 0.5


def _shape(token: str) -> str:
    if token.isalpha():
        return "a" if token.islower() else "A" if len(token) > 1 and token.isupper() else "Aa"
    upper = sum(map(str.isupper, token))
    kind = ("A" if upper > 1 else "Aa" if upper else "a") if token.upper() != token.lower() else ""
    return f"{kind}{'9' if any(map(str.isdigit, token)) else ''}{''.join(sorted({c for c in token if not c.isalnum()}))}"


class Vectors(dict):
    """Token -> row of ``matrix``: one row for each shape and known word together, one for each shape of all other words.

    Tokens are forgotten when there are too many, rows when they would outgrow the matrix."""

    def __init__(self, contexts: dict):
        super().__init__()
        self.contexts = contexts
        self.rows: dict = {}
        self.matrix = np.zeros((CACHE_ROWS, 2 * DIM), np.float32)

    def __missing__(self, token):
        letters = token.strip(".,;:!?").lower()
        known = self.contexts.get(letters)
        name = (_shape(token), letters if known is not None else "")
        row = self.rows.get(name)
        if row is None:
            row = self.rows[name] = len(self.rows)
            self.matrix[row, :DIM] = _index_vector("shape " + name[0])
            self.matrix[row, DIM:] = 0
            if known is not None:
                self.matrix[row, :DIM] += 0.2 * _index_vector("word " + letters)
                self.matrix[row, DIM:] = known
        self[token] = row
        return row

    def pooled(self, text: str | None) -> np.ndarray:
        tokens = (text or "").split()
        out = np.zeros(2 * DIM + 4, np.float32)
        total, n, repeats = np.zeros(2 * DIM), len(tokens), 0
        for start in range(0, n, CACHE_ROWS // 4):
            part = tokens[start:start + CACHE_ROWS // 4]
            if len(self) > CACHE_TOKENS or len(self.rows) + len(part) > CACHE_ROWS:
                self.clear()
                self.rows.clear()
            ids = np.fromiter(map(self.__getitem__, part), np.int32, len(part))
            total += self.matrix[ids].sum(axis=0, dtype=np.float64)
            repeats += sum(map(str.__eq__, part, part[1:]))
        if n:
            out[:2 * DIM] = total / n
            out[2 * DIM:] = np.log1p(n), repeats / n, len(set(tokens)) / n, min(1.0, sum(map(len, tokens)) / n / 20)
        return out


def _contexts(frames):
    """Per batch: token, count, sum of the index vectors around it."""
    for pdf in frames:
        index, vectors, counts, sums = {}, [], [], {}
        for text in pdf["text"]:
            words = [t.strip(".,;:!?").lower() for t in text.split()]
            for w in words:
                if w not in index:
                    index[w] = len(vectors)
                    vectors.append(_index_vector("word " + w))
        if not vectors:
            continue
        matrix = np.stack(vectors)
        sums, counts = np.zeros_like(matrix), np.zeros(len(vectors), np.int64)
        for text in pdf["text"]:
            ids = np.array([index[t.strip(".,;:!?").lower()] for t in text.split()], np.int64)
            np.add.at(counts, ids, 1)
            for gap in range(1, WINDOW + 1):
                np.add.at(sums, ids[gap:], matrix[ids[:-gap]])
                np.add.at(sums, ids[:-gap], matrix[ids[gap:]])
        names = list(index)
        keep = np.flatnonzero(counts > 1)
        yield pd.DataFrame({"token": [names[i] for i in keep], "n": counts[keep], "vector": [sums[i].tolist() for i in keep]})


def _merged(pdf):
    groups = pdf.groupby("token", sort=True)
    out = [(token, int(g["n"].sum()), np.sum(np.stack(g["vector"].to_list()), axis=0)) for token, g in groups]
    out = [(t, n, (v / (np.linalg.norm(v) + 1e-9)).tolist()) for t, n, v in out if n >= LEAST_COUNT]
    return pd.DataFrame(out, columns=["token", "n", "vector"])


def _standard(x, mean, scale):
    """Standardised features, drawn to the mean where a text has few tokens: so little of it says little."""
    n = np.expm1(x[:, 2 * DIM])
    return (x - mean) / scale * (n / (n + SHRINK))[:, None]


def _train(x, y, seed=11, epochs=150):
    """Weights of a network x -> tanh layer -> logit, and the temperature of its logits."""
    rng = np.random.default_rng(seed)
    shuffled = rng.permutation(len(y))
    cut = max(1, len(y) // 5)
    check, train = shuffled[:cut], shuffled[cut:]
    mean, scale = x[train].mean(0), x[train].std(0) + 1e-3
    z = _standard(x, mean, scale)
    w = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(epochs):
        rng.shuffle(train)
        for start in range(0, len(train), 128):
            rows_ = train[start:start + 128]
            h = np.tanh(z[rows_] @ w[0] + w[1])
            d = (logistic(h @ w[2] + w[3]) - y[rows_]) / len(rows_)
            back = np.outer(d, w[2]) * (1 - h * h)
            grads = [z[rows_].T @ back + 1e-3 * w[0], back.sum(0), h.T @ d + 1e-3 * w[2], np.array([d.sum()])]
            step += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] = w[i] - 0.003 * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)
    logits = np.tanh(z[check] @ w[0] + w[1]) @ w[2] + w[3]
    losses = {t: -np.mean(np.log(np.clip(np.where(y[check] == 1, logistic(logits / t), logistic(-logits / t)), 1e-12, 1)))
              for t in np.geomspace(0.25, 8, 41)}
    return {"mean": mean, "scale": scale, "w": w, "temperature": min(losses, key=losses.get)}


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> dict:
    """Context vectors and network weights from at most ``bound`` labelled rows (twice as many at worst)."""
    sample = labelled_texts(docs, labels, "quality", MODULUS, HELD_OUT, bound)
    merged = sample.select("text").mapInPandas(_contexts, "token string, n long, vector array<float>").groupBy(
        F.pmod(F.xxhash64("token"), F.lit(16))).applyInPandas(_merged, "token string, n long, vector array<float>")
    known = merged.orderBy(F.desc("n"), "token").limit(VOCABULARY).toPandas()
    contexts = {t: np.array(v, np.float32) for t, v in zip(known["token"], known["vector"])}
    shared = docs.sparkSession.sparkContext.broadcast(contexts)

    def pool(frames):
        vectors = Vectors(shared.value)
        for pdf in frames:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "x": [vectors.pooled(t).tolist() for t in pdf["text"]]})

    pooled = sample.mapInPandas(pool, "doc_id long, label int, x array<float>").toPandas().sort_values("doc_id")
    y = pooled["label"].to_numpy(np.float64)
    model = {"contexts": contexts, "prior": (y.sum() + 1) / (len(y) + 2), "net": None}
    if 0 < y.sum() < len(y) and len(y) >= 10:
        model["net"] = _train(np.stack(pooled["x"].to_list()).astype(np.float64), y)
    return model


def _probabilities(net, prior, x):
    if net is None:
        return np.full(len(x), prior)
    w = net["w"]
    hidden = np.tanh(_standard(x, net["mean"], net["scale"]) @ w[0] + w[1])
    return logistic((hidden @ w[2] + w[3]) / net["temperature"])


def score(docs: DataFrame, model: dict, name: str = "quality_score") -> DataFrame:
    """All columns of ``docs`` with the probability of label 1 of the whole text, as column ``name``; a column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def quality_score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        vectors = Vectors(m["contexts"])
        for texts in parts:
            x = np.stack([vectors.pooled(t) for t in texts]) if len(texts) else np.zeros((0, 2 * DIM + 4))
            yield pd.Series(_probabilities(m["net"], m["prior"], x.astype(np.float64)))

    return docs.withColumn(name, quality_score(F.col("text").cast("string")))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", (remainder("doc_id", MODULUS) == HELD_OUT).alias("held_out"), F.col("quality_score").alias("score"),
                         (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that the classifier predicts to be good, with the columns that they have, whatever their names."""
    name, = fresh_names(docs, "quality_score")
    return score(docs, fit(docs, labels), name).where(F.col(name) >= 0.5).select(*[f"`{c}`" for c in docs.columns])

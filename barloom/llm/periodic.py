"""Periodic runs of words: stretches that repeat one short sequence at least four times.

A run is a maximal stretch of words with smallest period q (words q apart are identical) and at
least max(6, 4 q) words. Words are runs of anything but ASCII white space, compared as bytes.

The method is an online sparse dynamic program over diagonals. The diagonal of lag q holds the
positions whose word equals the word q before. For the word at position i its earlier
occurrences at the lags q that divide i are looked at; three of them in a row, at i-q, i-2q and
i-3q, carry the diagonal's match length to three periods. A run of four periods holds four
consecutive multiples of its period, so no run is missed, while a document of n words has about
n ln n such positions instead of one per pair of equal words. A diagonal that got so far is
followed densely to where it ends on both sides and emitted at once if it is long enough.

A stretch of period q whose smallest period is less has one of the periods q / prime: it is
then left out, as the run of the smaller period was emitted before. Candidates within a run of
a smaller period are skipped unseen, so a text of one repeated word costs no more than others.

Null, blank and short texts have no runs and collapse to their words joined by one space.
Rows that repeat, and rows with a null doc_id, are treated one by one; nothing is shuffled. Ties
for the greatest length go to the smallest start, then the smallest period. Only ``doc_id`` and
``text`` are read, so other columns cannot clash. Very long texts are handled in blocks of positions.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_WORDS = 6
LEAST_PERIODS = 4
_BLOCK = 1 << 14
_LONG = 256
_OUT_BYTES = 16 << 20


@lru_cache(maxsize=2)
def _first_places() -> tuple[np.ndarray, np.ndarray]:
    return _places(0, _BLOCK)


def _places(low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions i in [low, high) with every lag q that divides i and has 3 q <= i, in order of (i, q)."""
    lags = np.arange(1, (high - 1) // 3 + 1, dtype=np.int64)
    first = np.maximum(3 * lags, -(-low // lags) * lags)
    count = np.maximum(0, -(-(high - first) // lags))
    lag = np.repeat(lags, count)
    step = np.arange(lag.size, dtype=np.int64) - np.repeat(np.cumsum(count) - count, count)
    place = np.repeat(first, count) + step * lag
    order = np.argsort(place, kind="stable")
    return place[order], lag[order]


def _matching(words: np.ndarray, place: int, lag: int, step: int) -> int:
    """How many positions from ``place`` on, going by ``step``, equal the word ``lag`` before."""
    n, size, done = len(words), 32, 0
    while True:
        if step > 0:
            low, high = place + done, min(n, place + done + size)
            if low >= high:
                return done
            differ = np.flatnonzero(words[low:high] != words[low - lag:high - lag])
            if differ.size:
                return done + int(differ[0])
        else:
            high = place - done + 1
            low = max(lag, high - size)
            if low >= high:
                return done
            differ = np.flatnonzero(words[low:high] != words[low - lag:high - lag])
            if differ.size:
                return done + (high - low - 1 - int(differ[-1]))
        done += high - low
        size *= 4


def _primes_of(q: int) -> list[int]:
    found, p = [], 2
    while p * p <= q:
        if q % p == 0:
            found.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return found + [q] if q > 1 else found


def _smallest(words: np.ndarray, start: int, q: int) -> bool:
    """Whether no proper divisor of ``q`` is a period too; the stretch has at least 2 q words."""
    two = words[start:start + 2 * q]
    return not any(np.array_equal(two[q // p:], two[:2 * q - q // p]) for p in _primes_of(q))


def runs_of(words: np.ndarray) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run, by start, then period."""
    n = len(words)
    if n < LEAST_WORDS:
        return []
    found: list[tuple[int, int, int]] = []
    ended: dict[int, int] = {}
    owner_period = owner_start = None
    for low in range(0, n, _BLOCK):
        high = min(n, low + _BLOCK)
        place, lag = _first_places() if low == 0 else _places(low, high)
        if low == 0:
            size = np.searchsorted(place, high)
            place, lag = place[:size], lag[:size]
        hit = words[place] == words[place - lag]
        place, lag = place[hit], lag[hit]
        hit = (words[place - lag] == words[place - 2 * lag]) & (words[place - lag] == words[place - 3 * lag])
        place, lag = place[hit], lag[hit]
        while place.size:
            if owner_period is not None:
                inside = (owner_period[place] < lag) & (owner_start[place] <= place - 3 * lag)
                place, lag = place[~inside], lag[~inside]
            again = False
            for k, (i, q) in enumerate(zip(place.tolist(), lag.tolist())):
                if ended.get(q, 0) > i:
                    continue
                left = _matching(words, i, q, -1)
                if left < 2 * q + 1:
                    continue
                end = i + 1 + _matching(words, i + 1, q, 1)
                ended[q] = end
                start = i - left + 1 - q
                length = end - start
                if length < max(LEAST_WORDS, LEAST_PERIODS * q) or not _smallest(words, start, q):
                    continue
                found.append((start, length, q))
                if length >= _LONG:
                    if owner_period is None:
                        owner_period, owner_start = np.full(n, n + 1, np.int64), np.zeros(n, np.int64)
                    nearer = owner_period[start:end] > q
                    owner_period[start:end][nearer] = q
                    owner_start[start:end][nearer] = start
                    place, lag, again = place[k + 1:], lag[k + 1:], True
                    break
            if not again:
                break
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay: those that no run holds after its first period."""
    keep = np.ones(n, bool)
    for start, length, q in runs:
        keep[start + q:start + length] = False
    return keep


def planted(doc_id: int, n: int) -> np.ndarray | None:
    """The order of words that the query gives a tenth of the documents: from word a on, the first p over and over."""
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 or not n:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    order = np.arange(n)
    order[a:] = a + (order[a:] - a) % p
    return order


_SCHEMA = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, order=None) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row.

    ``order(doc_id, n)`` may give the places of the words to read instead of all in turn; a null
    doc_id has none. ``collapsed`` are the words that stay, joined by one space.
    """
    def rows(batches):
        out: list = [[], [], [], []]
        held = 0

        def batch():
            return pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(_RUN)), pa.array(out[3], pa.binary())],
                names=["doc_id", "n_words", "runs", "collapsed"])

        for source in batches:
            for doc_id, text in zip(source.column(0).to_pylist(), source.column(1)):
                words = (text.as_py() or b"").split()
                n, codes = len(words), {}
                numbered = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, n)
                places = order(doc_id, n) if order is not None and doc_id is not None else None
                if places is not None:
                    numbered = numbered[places]
                runs = runs_of(numbered)
                if runs:
                    kept = np.flatnonzero(kept_words(len(numbered), runs))
                    if places is not None:
                        kept = places[kept]
                    collapsed = b" ".join([words[j] for j in kept.tolist()])
                else:
                    collapsed = b" ".join(words if places is None else [words[j] for j in places.tolist()])
                out[0].append(doc_id)
                out[1].append(len(numbered))
                out[2].append([{"start": s, "length": m, "period": q} for s, m, q in runs])
                out[3].append(collapsed)
                held += len(collapsed) + 64 * len(runs)
                if held >= _OUT_BYTES:
                    yield batch()
                    out, held = [[], [], [], []], 0
        if out[0]:
            yield batch()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return texts.mapInArrow(rows, _SCHEMA)


def digest(docs: DataFrame) -> DataFrame:
    """The runs of every row counted, the longest of them, and hashes of all runs and of the collapsed text."""
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    found = periodic_runs(docs, planted).withColumn("longest", longest)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("longest.start").alias("start"), (-F.col("longest.less")).alias("length"),
        F.col("longest.period").alias("period"), F.expr("(-1000 * longest.less) div longest.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))

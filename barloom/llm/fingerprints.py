"""Document fingerprints: MinHash signatures of word shingles.

A fingerprint has ``HASHES`` numbers of 16 bits in hexadecimal: for each of as many universal
hash functions (a * x + b modulo 2^32, a odd: a permutation), the shingle that it puts first.
The share of equal numbers estimates the Jaccard similarity of two texts' sets of five-word
shingles (words as runs of anything but ASCII white space, A-Z in lower case; a shorter text is
one shingle). Equal texts have equal fingerprints; texts without words have the fingerprint
of the empty set, which is like no other.

``near_duplicates`` cuts signatures into bands, joins documents on equal bands in Spark and
verifies the Jaccard similarity of what meets; each document of a band meets the smallest one
there, so no group is expanded into its pairs.

``edited_likeness`` compares every document with an edited form of it, which takes the
beginning of the next document by descending doc_id. Documents are dealt by ranges of doc_id,
and the first of a range is also handed to the range above, whose last document needs it; no
task sees more than its range, as a stream. Rows with a null doc_id are left out; rows equal in
doc_id and text count once; different texts of one doc_id follow each other by a hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.components import saved
from barloom.llm.ngram_jaccard import verified
from barloom.llm.tokens import joined, mix, set_ids, shingle_sets, table

HASHES = 128
BANDS = 32
RANGE_ROWS = 4_000
RANGES_MOST = 8_192
CHUNK_CHARS = 1_000_000

_A = (mix(np.arange(1, HASHES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (mix(np.arange(1001, 1001 + HASHES, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
EMPTY = np.full(HASHES, 0xFFFF, np.uint16)


def signatures(sets: list) -> np.ndarray:
    """One row of ``HASHES`` numbers of 16 bits for each shingle set."""
    out = np.tile(EMPTY, (len(sets), 1))
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        values, starts, _ = joined([sets[i] for i in full])
        values = (values >> np.uint64(32)).astype(np.uint32)
        least = np.empty((len(full), HASHES), np.uint32)
        for k in range(HASHES):
            least[:, k] = np.minimum.reduceat(values * _A[k] + _B[k], starts)
        out[full] = (mix(least.astype(np.uint64)) >> np.uint64(40)).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal numbers, row by row; the empty set is like itself only."""
    return (a == b).mean(axis=1)


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the beginning of the following one."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


_RESULT = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(),
           "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}
_RESULT_SQL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _fingerprinted(rows: list) -> pa.RecordBatch | None:
    """Results for all rows but the last, each with the one behind it; ranges do not mix."""
    pairs = [i for i in range(len(rows) - 1) if rows[i][0] == rows[i + 1][0] and not rows[i][1]]
    if not pairs:
        return None
    own = [r[3] for r in rows]
    changed = [edited(own[i], own[i + 1]) for i in pairs]
    marks = signatures([s for _, sets in shingle_sets(pa.array(own + changed, pa.large_string())) for s in sets])
    mine, after, new = marks[pairs], marks[[i + 1 for i in pairs]], marks[len(own):]
    return table({
        "doc_id": [rows[i][2] for i in pairs], "n_chars": [len(own[i]) for i in pairs],
        "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
        "fingerprint": [m.astype(">u2").tobytes().hex() for m in mine], "edited_fingerprint": [m.astype(">u2").tobytes().hex() for m in new],
        "near_edited": likeness(mine, new), "near_next": likeness(mine, after)}, _RESULT)


def _stream(batches):
    rows, size, last = [], 0, None
    for batch in batches:
        for bucket, guest, doc_id, tie, text in zip(*(c.to_pylist() for c in batch.columns)):
            name = (bucket, guest, doc_id, tie)
            if name == last and rows and rows[-1][3] == text:
                continue
            last = name
            rows.append((bucket, guest, doc_id, text))
            size += len(text)
            if size > CHUNK_CHARS and len(rows) > 1:
                if (found := _fingerprinted(rows)) is not None:
                    yield found
                rows = rows[-1:]
                size = len(rows[0][3])
    if (found := _fingerprinted(rows)) is not None:
        yield found


def _range_of(column, bounds: list):
    """How many of the ascending bounds lie below the column, by binary search."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
    name = "`" + column + "`"
    fixed = "array(" + ",".join(f"{b}L" for b in bounds) + ")"
    return F.expr(f"aggregate(array({','.join(map(str, steps))}), 0, (at, step) -> "
                  f"if(at + step <= {len(bounds)} and get({fixed}, at + step - 1) < {name}, at + step, at))")


def edited_likeness(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every document."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(
        "doc_id is not null")
    count = docs.count()
    ranges = min(RANGES_MOST, max(1, count // RANGE_ROWS))
    bounds = []
    if ranges > 1:
        found = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0]
        bounds = sorted({b for b in found if b < (1 << 63) - 1 and b > -(1 << 63)})
    dealt = docs.select(_range_of("doc_id", bounds).alias("range"), F.lit(0).alias("guest"), "doc_id", F.xxhash64("text").alias("tie"), "text")
    firsts = dealt.groupBy("range").agg(F.max(F.struct("doc_id", "tie")).alias("m")).select("range", "m.*").orderBy("range").collect()
    if not firsts:
        return spark.createDataFrame([], _RESULT_SQL)
    to = [firsts[(i + 1) % len(firsts)]["range"] for i in range(len(firsts))]
    guests = spark.createDataFrame([(t, r["doc_id"], r["tie"]) for t, r in zip(to, firsts)], "range int, doc_id long, tie long")
    guests = dealt.drop("range", "guest").join(F.broadcast(guests), ["doc_id", "tie"]).select("range", F.lit(1).alias("guest"), "doc_id", "tie", "text")
    met = dealt.union(guests).repartition(len(firsts), "range").sortWithinPartitions("range", "guest", F.desc("doc_id"), F.desc("tie"))
    return met.mapInArrow(_stream, _RESULT_SQL)


_BANDED = {"doc_id": pa.int64(), "s1": pa.int64(), "s2": pa.int64(), "bands": pa.list_(pa.int64())}


def _banded(batches):
    width = HASHES // BANDS
    for batch in batches:
        for row, sets in shingle_sets(batch.column(1)):
            full = [i for i, s in enumerate(sets) if len(s)]
            if not full:
                continue
            values, starts, _ = joined([sets[i] for i in full])
            s1, s2 = set_ids(values, starts)
            marks = signatures([sets[i] for i in full]).astype(np.uint64).reshape(len(full), BANDS, width)
            folded = np.zeros((len(full), BANDS), np.uint64)
            for k in range(width):
                folded = mix(folded + marks[:, :, k] + np.uint64(1))
            yield table({"doc_id": batch.column(0).slice(row, len(sets)).take(pa.array(full)), "s1": s1, "s2": s2,
                         "bands": folded.view(np.int64).tolist()}, _BANDED)


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``doc_id, near_id``: documents with a smaller one that shares a band and whose Jaccard similarity is at least ``percent``.

    Documents of equal sets are linked with the smallest of them; of the rest each meets the smallest class of each of its bands."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    marks = saved(docs.mapInArrow(_banded, "doc_id long, s1 long, s2 long, bands array<long>"), "bands")
    classes = saved(marks.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "band-classes")
    banded = classes.select("rep", F.posexplode("bands").alias("k", "band"))
    first = banded.groupBy("k", "band").agg(F.min("rep").alias("a"), F.count("*").alias("n")).where("n > 1")
    pairs = saved(banded.join(first, ["k", "band"]).where("rep != a").select("a", F.col("rep").alias("b")).distinct(), "band-pairs")
    near = verified(pairs, classes, docs, percent).select(F.col("b").alias("doc_id"), F.col("a").alias("near_id"))
    same = marks.join(classes.select("s1", "s2", "rep"), ["s1", "s2"]).where("doc_id != rep").select("doc_id", F.col("rep").alias("near_id"))
    return near.union(same).distinct()

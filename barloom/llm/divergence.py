"""How far the sources of a language differ in their use of words: an exact two-pass recount.

A term is a run of ASCII letters and non-ASCII characters; only A-Z are lower-cased. Pass one counts
in how many documents of its language every term occurs (counted per task, then summed by Spark)
and keeps those in at least ``LEAST_DOCUMENTS``. The kept terms of a language are cut into
shards by a hash, and for each shard a task builds a minimal perfect hash: levels of bits in
which a key owns the bit that no other key of the level claims; its slot is the rank of the bit.

Pass two reads the texts again with the hashes broadcast. A term finds its slot, the key stored
there is compared, and the slot of the document's (language, source) group is incremented in
a dense vector. Shards are broadcast in blocks of at most ``BLOCK_KEYS`` keys and ``BLOCK_BYTES``
bytes, one pass over the texts a block, so a broadcast has a fixed bound and nothing is dropped.
A task hands its vectors on whenever they reach ``DENSE_BYTES``; Spark sums them by slot.

The share of a term is p = 1 + floor(10^9 (count + 5) / (N + 5 V)), N the group's count over the V kept
terms of its language. Two sources are compared over all kept terms, those that neither uses
too: tiles of at most two blocks of sources and ``WIDTH`` slots are summed in numpy and the sums added by
Spark, so no task holds a whole language. All arithmetic is on whole numbers.

Null text, lang and source count as ''. Texts without terms still give their group. Rows that
repeat count as often as they occur. Equal values are ranked by the item's UTF-8 bytes. A
language without kept terms has pairs of value 0 and no terms; an empty table has no rows. Only the
three columns are read, so others cannot clash. Long texts and long terms are taken whole.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.components import saved

LEAST_DOCUMENTS = 30
TOP = 50
SHARD_KEYS = 1 << 15
SHARD_BYTES = 1 << 20
BLOCK_KEYS = 1 << 20
BLOCK_BYTES = 32 << 20
DENSE_BYTES = 64 << 20
COUNTED_TERMS = 300_000
WIDTH = 1024
SOURCES = 128

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_LETTERS).split() if text else []


# --- minimal perfect hash ----------------------------------------------------------------

def hashed(keys: list[bytes]) -> np.ndarray:
    """Two 64-bit numbers a key."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(k) for k in keys]), np.uint64).reshape(-1, 2)


def _place(h: np.ndarray, level: int, size: int) -> np.ndarray:
    x = h[:, 0] + np.uint64(level) * h[:, 1]
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    return (x % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """A slot in [0, n) for each of n keys, and the keys in order of their slots."""

    LEVELS = 48

    def __init__(self, sizes: list[int], bits: np.ndarray, keys: list[bytes]):
        self.sizes, self.keys = sizes, keys
        self.bits = bits
        self.rank = np.cumsum(bits, dtype=np.int64) - 1
        owned = int(bits.sum())
        # Keys that no level could tell apart (equal 128-bit hashes) follow the others.
        self.rest = {k: owned + i for i, k in enumerate(keys[owned:])}

    @classmethod
    def of(cls, keys: list[bytes]) -> PerfectHash:
        h, left = hashed(keys), np.arange(len(keys))
        sizes, levels, order = [], [], []
        while left.size and len(sizes) < cls.LEVELS:
            size = max(8, int(1.6 * left.size))
            place = _place(h[left], len(sizes), size)
            alone = np.bincount(place, minlength=size)[place] == 1
            bits = np.zeros(size, np.uint8)
            bits[place[alone]] = 1
            order.append(left[alone][np.argsort(place[alone])])
            sizes.append(size)
            levels.append(bits)
            left = left[~alone]
        order.append(left)
        slots = np.concatenate(order)
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, np.uint8), [keys[i] for i in slots.tolist()])

    def slots(self, h: np.ndarray, keys: list[bytes]) -> np.ndarray:
        """The slot of every key, -1 for one that is not stored."""
        found = np.full(len(keys), -1, np.int64)
        open_, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not open_.size:
                break
            place = base + _place(h[open_], level, size)
            hit = self.bits[place] == 1
            found[open_[hit]] = self.rank[place[hit]]
            open_, base = open_[~hit], base + size
        for i in np.flatnonzero(found >= 0).tolist():
            if self.keys[found[i]] != keys[i]:
                found[i] = -1
        if self.rest:
            for i in np.flatnonzero(found < 0).tolist():
                found[i] = self.rest.get(keys[i], -1)
        return found


# --- pass one: the kept terms ------------------------------------------------------------

def _read(docs: DataFrame) -> DataFrame:
    def plain(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    return docs.select(plain("lang").alias("lang"), plain("source").alias("source"), plain("text").cast("binary").alias("text"))


def kept_terms(texts: DataFrame, least: int) -> DataFrame:
    """``lang, term`` (bytes) of the terms in at least ``least`` documents of their language."""
    def counted(batches):
        counts: dict = {}
        size = 0

        def handed_on():
            for lang, terms in counts.items():
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(terms)), pa.array(list(terms), pa.binary()),
                                                  pa.array(list(terms.values()), pa.int64())], names=["lang", "term", "n"])

        for source in batches:
            for lang, text in zip(source.column(0).to_pylist(), source.column(1)):
                seen = counts.setdefault(lang, {})
                before = len(seen)
                for term in set(terms_of(text.as_py())):
                    seen[term] = seen.get(term, 0) + 1
                size += len(seen) - before
                if size >= COUNTED_TERMS:
                    yield from handed_on()
                    counts, size = {}, 0
        yield from handed_on()

    found = texts.select("lang", "text").mapInArrow(counted, "lang string, term binary, n bigint")
    return found.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("lang", "term")


def shards_of(kept: DataFrame) -> DataFrame:
    """``lang, shards, shard, n, bytes, sizes, bits, keys``: a perfect hash for each shard of a language's kept terms."""
    sizes = kept.groupBy("lang").agg(F.greatest(F.ceil(F.count(F.lit(1)) / SHARD_KEYS), F.ceil(F.sum(F.length("term")) / SHARD_BYTES)).cast("int").alias("shards"))
    dealt = kept.join(sizes, "lang").withColumn("shard", (F.crc32("term") % F.col("shards")).cast("int"))

    def build(table):
        hash_ = PerfectHash.of(sorted(table.column("term").to_pylist()))
        return pa.table({
            "lang": [table.column("lang")[0].as_py()], "shards": pa.array([table.column("shards")[0].as_py()], pa.int32()),
            "shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "n": pa.array([len(hash_.keys)], pa.int64()),
            "bytes": pa.array([sum(map(len, hash_.keys))], pa.int64()), "sizes": pa.array([hash_.sizes], pa.list_(pa.int64())),
            "bits": pa.array([hash_.bits.tobytes()], pa.binary()), "keys": pa.array([hash_.keys], pa.list_(pa.binary()))})

    return dealt.groupBy("lang", "shard").applyInArrow(
        build, "lang string, shards int, shard int, n bigint, bytes bigint, sizes array<bigint>, bits binary, keys array<binary>")


# --- pass two: the recount -----------------------------------------------------------------

def _blocks(shards: DataFrame) -> list[list[tuple[str, int]]]:
    """Shards in blocks of bounded size; one small row a shard reaches the driver."""
    blocks, keys, size = [[]], 0, 0
    for r in shards.select("lang", "shard", "n", "bytes").orderBy("lang", "shard").collect():
        if blocks[-1] and (keys + r["n"] > BLOCK_KEYS or size + r["bytes"] > BLOCK_BYTES):
            blocks.append([])
            keys, size = 0, 0
        blocks[-1].append((r["lang"], r["shard"]))
        keys, size = keys + r["n"], size + r["bytes"]
    return blocks if blocks[0] else []


class _Language:
    """The block's shards of one language, slot after slot."""

    def __init__(self, rows):
        self.shards = rows[0][1]
        self.hashes = {shard: PerfectHash(list(sizes), np.frombuffer(bits, np.uint8), keys) for _, _, shard, sizes, bits, keys in rows}
        self.order = sorted(self.hashes)
        self.starts = np.concatenate([[0], np.cumsum([len(self.hashes[s].keys) for s in self.order])])

    def slots(self, terms: list[bytes]) -> np.ndarray:
        found = np.full(len(terms), -1, np.int64)
        if not terms:
            return found
        shard = np.fromiter((zlib.crc32(t) % self.shards for t in terms), np.int64, len(terms)) if self.shards > 1 else np.zeros(len(terms), np.int64)
        for k, s in enumerate(self.order):
            own = np.flatnonzero(shard == s)
            if own.size:
                chosen = [terms[i] for i in own.tolist()]
                slots = self.hashes[s].slots(hashed(chosen), chosen)
                found[own] = np.where(slots >= 0, slots + self.starts[k], -1)
        return found


def _recount(texts: DataFrame, rows: list[tuple]) -> DataFrame:
    """``lang, source, shard, slot, n``: how often the block's terms occur in each group, as far as a task has read."""
    shared = texts.sparkSession.sparkContext.broadcast(rows)

    def counted(batches):
        by_lang: dict = {}
        for row in shared.value:
            by_lang.setdefault(row[0], []).append(row)
        languages = {lang: _Language(of_lang) for lang, of_lang in by_lang.items()}
        dense: dict = {}
        held = 0

        def handed_on():
            for (lang, source), counts in dense.items():
                here = languages[lang]
                slot = np.flatnonzero(counts)
                k = np.searchsorted(here.starts, slot, side="right") - 1
                yield pa.RecordBatch.from_arrays([
                    pa.repeat(pa.scalar(lang, pa.string()), slot.size), pa.repeat(pa.scalar(source, pa.string()), slot.size),
                    pa.array(np.asarray(here.order)[k], pa.int32()), pa.array(slot - here.starts[k], pa.int64()), pa.array(counts[slot], pa.int64())],
                    names=["lang", "source", "shard", "slot", "n"])

        for batch in batches:
            codes: dict = {}
            groups: dict = {}
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if lang in languages:
                    known = codes.setdefault(lang, {})
                    terms = terms_of(text.as_py())
                    groups.setdefault((lang, source), []).append(np.fromiter((known.setdefault(t, len(known)) for t in terms), np.int32, len(terms)))
            slots = {lang: languages[lang].slots(list(known)) for lang, known in codes.items()}
            for (lang, source), parts in groups.items():
                size = int(languages[lang].starts[-1])
                if (lang, source) not in dense:
                    if dense and held + 8 * size > DENSE_BYTES:
                        yield from handed_on()
                        dense, held = {}, 0
                    dense[lang, source] = np.zeros(size, np.int64)
                    held += 8 * size
                found = slots[lang][np.concatenate(parts)]
                at, n = np.unique(found[found >= 0], return_counts=True)
                dense[lang, source][at] += n
        yield from handed_on()

    return texts.select("lang", "source", "text").mapInArrow(counted, "lang string, source string, shard int, slot bigint, n bigint")


def recount(texts: DataFrame, shards: DataFrame) -> DataFrame | None:
    """``lang, source, shard, slot, n`` over all documents, rows of n > 0 only; None without kept terms."""
    total = None
    for block in _blocks(shards):
        wanted = texts.sparkSession.createDataFrame(block, "lang string, shard int")
        rows = shards.join(F.broadcast(wanted), ["lang", "shard"]).select("lang", "shards", "shard", "sizes", "bits", "keys").collect()
        part = _recount(texts, [(r[0], r[1], r[2], list(r[3]), bytes(r[4]), [bytes(k) for k in r[5]]) for r in rows])
        part = saved(part.groupBy("lang", "source", "shard", "slot").agg(F.sum("n").alias("n")), "recount")
        total = part if total is None else total.union(part)
    return total


# --- shares and differences ----------------------------------------------------------------

def share(count: str, n: str, v: str) -> Column:
    """1 + floor(10^9 (count + 5) / (n + 5 v)) of long columns, without overflow."""
    return F.expr(f"1 + ((cast({count} as decimal(25,0)) + 5) * cast(1000000000 as decimal(10,0))) div (cast({n} as decimal(25,0)) + 5 * cast({v} as decimal(25,0)))")


def _tile_sums(key, table):
    """Sums of absolute differences between the sources of a tile over its slots."""
    a, b = key[3].as_py(), key[4].as_py()
    width = table.column("width")[0].as_py()
    source, side = table.column("source").to_pylist(), np.array(table.column("part").to_pylist())
    p = np.repeat(np.array(table.column("p0").to_pylist(), np.int64)[:, None], width, axis=1)
    for i, found in enumerate(table.column("found").to_pylist()):
        for one in found or ():
            p[i, one["at"]] = one["p"]
    left, right, value = [], [], []
    first = np.flatnonzero(side == a)
    for k, i in enumerate(first.tolist()):
        others = first[k + 1:] if a == b else np.flatnonzero(side == b)
        left += [source[i]] * others.size
        right += [source[j] for j in others.tolist()]
        value.append(np.abs(p[others] - p[i]).sum(axis=1))
    return pa.table({"lang": pa.array([key[0].as_py()] * len(left), pa.string()), "a": pa.array(left, pa.string()), "b": pa.array(right, pa.string()),
                     "value": pa.array(np.concatenate(value) if value else np.zeros(0, np.int64), pa.int64())})


def _pairs(groups: DataFrame, shards: DataFrame, shares: DataFrame | None) -> DataFrame:
    """``lang, source, item, value`` of every two sources of a language."""
    parts = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / SOURCES).cast("int").alias("parts"))
    chunks = shards.select("lang", "shard", "n").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / WIDTH))))
    chunks = chunks.withColumn("width", F.least(F.lit(WIDTH).cast("long"), F.col("n") - F.col("chunk") * WIDTH).cast("int"))
    grid = groups.join(parts, "lang").join(chunks.drop("n"), "lang", "left").select(
        "lang", "source", "p0", "parts", F.coalesce("shard", F.lit(0)).alias("shard"), F.coalesce("chunk", F.lit(0).cast("long")).alias("chunk"),
        F.coalesce("width", F.lit(0)).alias("width"), (F.crc32(F.col("source").cast("binary")) % F.col("parts")).cast("int").alias("part"))
    if shares is None:
        placed = grid.withColumn("found", F.expr("cast(array() as array<struct<at:int,p:bigint>>)"))
    else:
        # At most WIDTH entries a list.
        found = shares.withColumn("chunk", F.floor(F.col("slot") / WIDTH)).groupBy("lang", "source", "shard", "chunk").agg(
            F.collect_list(F.struct((F.col("slot") % WIDTH).cast("int").alias("at"), "p")).alias("found"))
        placed = grid.join(found, ["lang", "source", "shard", "chunk"], "left")
    # A tile is a pair of source blocks; with up to SOURCES sources there is one and no row is copied.
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    tiled = placed.withColumn("other", other).withColumns({"left": F.least("part", "other"), "right": F.greatest("part", "other")})
    sums = tiled.select("lang", "shard", "chunk", "left", "right", "source", "part", "p0", "width", "found").groupBy(
        "lang", "shard", "chunk", "left", "right").applyInArrow(_tile_sums, "lang string, a string, b string, value bigint")
    summed = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    way = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return summed.withColumn("way", way).select("lang", "way.source", "way.item", "value")


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: how every source differs from the others (``pair``) and its most overused terms (``term``)."""
    texts = _read(docs)
    kept = saved(kept_terms(texts, least), "kept")
    shards = saved(shards_of(kept), "shards")
    counts = recount(texts, shards)
    v = shards.groupBy("lang").agg(F.sum("n").alias("v"))
    zero = F.lit(0).cast("long")
    groups = texts.select("lang", "source").distinct().join(v, "lang", "left")
    if counts is None:
        groups = saved(groups.select("lang", "source", F.lit(0).cast("long").alias("p0")), "groups")
        return _ranked(_pairs(groups, shards, None), "pair")
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(sums, ["lang", "source"], "left").select(
        "lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce("v", zero).alias("v"))
    groups = saved(groups.withColumn("p0", F.when(F.col("v") > 0, share("0", "total", "v")).otherwise(zero)), "groups")
    shares = saved(counts.join(groups, ["lang", "source"]).select("lang", "source", "shard", "slot", "n", share("n", "total", "v").alias("p")), "shares")
    pairs = _ranked(_pairs(groups.select("lang", "source", "p0"), shards, shares), "pair")

    whole = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("v").alias("v"))
    terms = shards.select("lang", "shard", F.posexplode("keys").alias("at", "key")).select(
        "lang", "shard", F.col("at").cast("long").alias("slot"), F.col("key").cast("string").alias("item"))
    used = counts.groupBy("lang", "shard", "slot").agg(F.sum("n").alias("n")).join(whole, "lang").select(
        "lang", "shard", "slot", share("n", "total", "v").alias("q"))
    used = used.join(terms, ["lang", "shard", "slot"])
    over = shares.join(used, ["lang", "shard", "slot"]).where("p > q").select("lang", "source", "item", (F.col("p") - F.col("q")).alias("value"))
    return pairs.union(_ranked(over, "term").where(F.col("rank") <= top))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: The same by DuckDB, over a grid of all groups and kept terms.
AUDIT_SQL = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
tok AS MATERIALIZED (
  SELECT id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), '{_UPPER}', '{_UPPER.lower()}') AS term FROM d),
kept AS MATERIALIZED (
  SELECT lang, term FROM (SELECT DISTINCT id, lang, term FROM tok) GROUP BY ALL HAVING count(*) >= {LEAST_DOCUMENTS}),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM tok JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
grid AS MATERIALIZED (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0)::HUGEINT AS n
  FROM g JOIN kept ON g.lang = kept.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
shares AS MATERIALIZED (
  SELECT lang, source, term, n, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM grid JOIN v USING (lang)),
whole AS MATERIALIZED (
  SELECT lang, term, 1 + (1000000000 * (sum(n) + 5)) // (any_value(total) + 5 * any_value(v)) AS q
  FROM grid JOIN v USING (lang) JOIN (SELECT lang, sum(n) AS total FROM grid GROUP BY lang) USING (lang) GROUP BY lang, term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
             FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
    ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
over AS (SELECT lang, source, term AS item, p - q AS value FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM over)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""

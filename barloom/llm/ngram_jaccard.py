"""N-gram Jaccard join: near-duplicate documents by exact similarity of their word shingles.

Two documents link when the Jaccard similarity of their sets of five-word shingles reaches the
threshold. The join is exact and runs in these steps:

1. One pass over the texts gives every document its set size, a 128-bit set id, a bitmap
   signature (each shingle flips one of about n bits, 256 at least), a few minimum hashes
   and, per batch, the shingles that several of its documents share.
2. Documents of equal sets are one class, represented by the smallest doc_id.
3. Each class is verified against the class of smallest doc_id with which it shares most
   minimum hashes. This only saves work: it joins most copies before the exhaustive search.
4. Prefix filter: a set of n shingles in a global order (frequent ones last) can only link
   with sets that share one of its first n - ceil(t n) + 1 shingles. These entries travel
   packed by hash range; shingles held by one class alone end there.
5. Classes that share an entry but are not joined yet meet. An entry of few classes lists its
   pairs, which are made distinct before they meet their signatures; those of an entry of many
   meet in tiles of adjacent size bands, split into blocks of bounded size. The bit count of two
   signatures' difference bounds the overlap from above; the pairs it leaves are intersected
   exactly from their texts.
6. Connected components over all verified links.

Nothing is capped or sampled: the list of frequent shingles only chooses the order, for which
any choice gives the same links. Rows without words are linked with nothing. Rows that repeat
a doc_id are compared by their own text and share the component.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.components import components, maybe_in, saved
from barloom.llm.tokens import common, joined, mix, released, set_ids, shingle_sets, table

BITS = 256
ANCHORS = 6
FREQUENT = 50          # a shingle in this many documents goes to the end of the order ...
FREQUENT_MOST = 200_000  # ... and so many of them at most, the most frequent
BUCKET_ENTRIES = 400_000
FEW = 32               # classes of an entry that are paired where the entry is, without tiles
BLOCK = 1_000          # classes of one size band that meet in a tile
LEADER_ROWS = 400      # members verified against one leader in one group

_SALTS = mix(np.arange(1, ANCHORS + 1, dtype=np.uint64)) | np.uint64(1)
_LONGS = pa.list_(pa.int64())
_SKETCH = {"doc_id": pa.int64(), "n": pa.int64(), "s1": pa.int64(), "s2": pa.int64(), "anchors": _LONGS, "bits": pa.binary(),
           "shared": _LONGS, "held": _LONGS}
_PAIR = {"a": pa.int64(), "b": pa.int64()}


def _bitmap(values):
    """Parities of the members that hash to each bit; as many bits as members, in powers of two from ``BITS``."""
    width = max(BITS, 1 << (len(values) - 1).bit_length())
    counts = np.bincount(((values >> np.uint64(20)) % np.uint64(width)).astype(np.int64), minlength=width)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def folded(bitmaps: list) -> np.ndarray:
    """Bitmaps of one tile at the width of the shortest: a longer one is folded by xor, which keeps parities."""
    width = min(map(len, bitmaps)) // 8
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(b, np.uint64).reshape(-1, width), axis=0) for b in bitmaps])


def _sketch(batches):
    """A row for each text, and now and then one with the shingles that several texts of a batch share."""
    for batch in batches:
        seen, pool, size = set(), [], 0
        for row, sets in shingle_sets(batch.column(1)):
            ids = batch.column(0).slice(row, len(sets))
            full = [i for i, s in enumerate(sets) if len(s)]
            n = np.array([len(s) for s in sets], np.int64)
            s1, s2 = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
            anchors, bits = [None] * len(sets), [None] * len(sets)
            if full:
                values, starts, _ = joined([sets[i] for i in full])
                s1[full], s2[full] = set_ids(values, starts)
                least = np.stack([np.minimum.reduceat(values * salt, starts) for salt in _SALTS], axis=1).view(np.int64).tolist()
                for i, x in zip(full, least):
                    anchors[i], bits[i] = x, _bitmap(sets[i])
            none = [None] * len(sets)
            yield table({"doc_id": ids, "n": n, "s1": s1, "s2": s2, "anchors": anchors, "bits": bits, "shared": none, "held": none}, _SKETCH)
            for i in full:
                if (key := (s1[i], s2[i])) not in seen:
                    seen.add(key)
                    pool.append(sets[i])
                    size += len(sets[i])
            if size > 2_000_000:
                yield _held(pool)
                pool, size = [], 0
        if pool:
            yield _held(pool)


def _held(sets):
    values = np.sort(np.concatenate(sets))
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    counts = np.diff(np.append(starts, len(values)))
    keep = counts >= 3
    row = dict.fromkeys(_SKETCH, [None])
    return table(row | {"shared": [values[starts[keep]].view(np.int64)], "held": [counts[keep]]}, _SKETCH)


def prefix_length(n: int, percent: int) -> int:
    """How many first shingles a set of n must offer so that no link at ``percent`` is missed."""
    return n - -(-percent * n // 100) + 1


_PACK = np.dtype([("h", "<u4"), ("s", "<i8")])
_LATE = np.dtype([("h", "<i8"), ("s", "<i8")])
_PACKS = {"bucket": pa.int64(), "pack": pa.binary()}
LATE_GROUPS = 64


def _entries(frequent, buckets, percent):
    """Per slice and bucket one packed list of (hash, set id). Frequent shingles need no grouping
    by a bucket: they go to extra buckets dealt by hash and set."""

    def run(batches):
        last = frequent.value
        for batch in batches:
            seen, chosen, late, owners, size = set(), [], [], [], 0
            for _, sets in shingle_sets(batch.column(0)):
                sets = [s for s in sets if len(s)]
                if not sets:
                    continue
                values, starts, lengths = joined(sets)
                names, _ = set_ids(values, starts)
                at = np.minimum(np.searchsorted(last, values), max(len(last) - 1, 0))
                slow = last[at] == values if len(last) else np.zeros(len(values), bool)
                for name, own, first, n in zip(names.tolist(), sets, starts.tolist(), lengths.tolist()):
                    if name in seen:
                        continue
                    seen.add(name)
                    mask = slow[first:first + n]
                    length = prefix_length(n, percent)
                    cold = own[~mask][:length]
                    hot = own[mask][:length - len(cold)]
                    chosen.append(cold)
                    late.append(hot)
                    owners.append((name, len(cold), len(hot)))
                    size += length
                if size > 500_000:
                    yield from _packed(chosen, late, owners, buckets)
                    chosen, late, owners, size = [], [], [], 0
            if owners:
                yield from _packed(chosen, late, owners, buckets)

    return run


def _packed(chosen, late, owners, buckets):
    names, cold, hot = (np.array(x, np.int64) for x in zip(*owners))
    for values, counts, kind in ((np.concatenate(chosen), cold, _PACK), (np.concatenate(late), hot, _LATE)):
        if not len(values):
            continue
        packs = np.empty(len(values), kind)
        packs["s"] = np.repeat(names, counts)
        if kind is _PACK:
            packs["h"] = values >> np.uint64(32)
            bucket = (values % np.uint64(buckets)).astype(np.int64)
        else:
            packs["h"] = values.view(np.int64)
            bucket = buckets + (mix(values ^ packs["s"].view(np.uint64)) % np.uint64(LATE_GROUPS)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, packs = bucket[order], packs[order]
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        yield table({"bucket": bucket[cut], "pack": [packs[a:b].tobytes() for a, b in zip(cut, [*cut[1:], len(bucket)])]}, _PACKS)


def _shared_entries(buckets):
    """Of a bucket's entries those of hashes that at least two classes hold; frequent ones pass as they are."""

    def run(key, packs):
        released()
        bucket = key[0].as_py()
        data = np.concatenate([np.frombuffer(b, _PACK if bucket < buckets else _LATE) for b in packs.column("pack").to_pylist()])
        if bucket >= buckets:
            data = np.unique(data)
            return pa.table({"gid": data["h"].copy(), "sid": data["s"].copy()})
        data = data[np.lexsort((data["s"], data["h"]))]
        data = data[np.concatenate([[True], (data["h"][1:] != data["h"][:-1]) | (data["s"][1:] != data["s"][:-1])])]
        group = np.cumsum(np.concatenate([[True], data["h"][1:] != data["h"][:-1]])) - 1
        data = data[np.bincount(group)[group] > 1]
        return pa.table({"gid": (data["h"].astype(np.int64) << 31) ^ np.int64(bucket), "sid": data["s"].copy()})

    return run


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """``a, b`` of those pairs of class representatives whose exact Jaccard reaches ``percent``.

    Only texts that occur in a pair are shuffled. They meet by ``a``; members of an ``a`` with
    many are split into groups of bounded size.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / LEADER_ROWS).alias("groups"))
    pairs = pairs.join(sizes, "a").withColumn("salt", F.pmod(F.xxhash64("b"), "groups"))
    needed = pairs.select("a", "salt", F.col("b").alias("rep")).union(
        pairs.select("a", "salt", F.col("a").alias("rep")).distinct())
    needed = saved(needed.join(classes.select("rep", "s1"), "rep"), "pair-texts")
    texts = maybe_in(docs.select(F.col("doc_id").alias("rep"), "text"), needed.select("rep"), "rep")
    met = needed.join(texts, "rep").repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("rep") != F.col("a"))
    met = met.select("a", "salt", "rep", "s1", "text")

    def run(batches):
        at, leader = None, None
        for batch in batches:
            for row, sets in shingle_sets(batch.column(4)):
                found = []
                a, salt, rep, s1 = (batch.column(i).slice(row, len(sets)).to_pylist() for i in range(4))
                values, starts, _ = joined([s if len(s) else np.zeros(1, np.uint64) for s in sets])
                names = set_ids(values, starts)[0].tolist()
                for i, own in enumerate(sets):
                    if at != (a[i], salt[i]):
                        at, leader = (a[i], salt[i]), None
                    if names[i] != s1[i]:
                        continue
                    if rep[i] == a[i]:
                        leader = own
                    elif leader is not None:
                        both = common(leader, own)
                        if 100 * both >= percent * (len(leader) + len(own) - both):
                            found.append((a[i], rep[i]))
                if found:
                    yield table(dict(zip(_PAIR, zip(*found))), _PAIR)

    return met.mapInArrow(run, "a long, b long").distinct()


def _tile_pairs(percent):
    """Pairs of one tile that belong to different components and whose bit counts allow a link."""

    def pairs_of(block, n, comp, rep, bits, role):
        out = []
        order = np.argsort(n, kind="stable")
        block, n, comp, rep, bits, role = (x[order] for x in (block, n, comp, rep, bits, role))
        low, high = block[:, 0], block[:, 1]
        own = block[:, 2]
        for i in np.flatnonzero(role == 1):
            last = np.searchsorted(n, n[i] * 100 // percent, side="right")
            first = np.searchsorted(n, -(-n[i] * percent // 100), side="left")
            js = np.arange(first, last)
            keep = (comp[js] != comp[i]) & ((role[js] == 0) | (js < i))
            if low[i] != high[i]:
                keep &= own[js] != own[i]
            js = js[keep]
            if len(js):
                apart = np.bitwise_count(bits[js] ^ bits[i]).sum(axis=1, dtype=np.int64)
                total = n[js] + n[i]
                js = js[(100 + percent) * ((total - apart) // 2) >= percent * total]
                out += [(int(min(rep[i], rep[j])), int(max(rep[i], rep[j]))) for j in js]
        return out

    def run(batches):
        key, held = None, []

        def flush():
            tile = np.concatenate([x for x, _ in held])
            bits = folded([y for _, part in held for y in part])
            block = tile[:, [2, 3, 7]]
            return pairs_of(block, tile[:, 4], tile[:, 5], tile[:, 6], bits, tile[:, 8])

        for batch in batches:
            ints = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(9)], axis=1)
            bits = batch.column(9).to_pylist()
            cut = np.flatnonzero(np.concatenate([[True], (ints[1:, :4] != ints[:-1, :4]).any(axis=1)]))
            found = []
            for a, b in zip(cut, [*cut[1:], len(ints)]):
                this = tuple(ints[a, :4])
                if key is not None and this != key:
                    found += flush()
                    held = []
                key = this
                held.append((ints[a:b], bits[a:b]))
            if found:
                yield table(dict(zip(_PAIR, zip(*set(found)))), _PAIR)
        if held and (found := flush()):
            yield table(dict(zip(_PAIR, zip(*set(found)))), _PAIR)

    return run


def _likely(percent):
    """Pairs whose bit counts allow a link."""

    def run(batches):
        for batch in batches:
            a, b, m, n = (batch.column(i).to_numpy() for i in range(4))
            apart = np.zeros(batch.num_rows, np.int64)
            for i, both in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())):
                x, y = folded(both)
                apart[i] = np.bitwise_count(x ^ y).sum(dtype=np.int64)
            keep = (100 + percent) * ((m + n - apart) // 2) >= percent * (m + n)
            yield table({"a": a[keep], "b": b[keep]}, _PAIR)

    return run


def _few_pairs(named: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of the entries of at most ``FEW`` classes: a pair of many entries meets its signatures once."""
    held = named.groupBy("gid").agg(F.collect_list(F.struct("rep", "n", "comp")).alias("held"))
    pairs = held.select(F.explode(F.expr(
        "flatten(transform(held, x -> transform(filter(held, y -> x.rep < y.rep and x.comp != y.comp and "
        f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)), y -> struct(x.rep as a, y.rep as b, x.n as m, y.n as n))))")).alias("p"))
    pairs = pairs.select("p.*").distinct()
    pairs = pairs.join(classes.select(F.col("rep").alias("a"), F.col("bits").alias("own")), "a").join(
        classes.select(F.col("rep").alias("b"), F.col("bits").alias("other")), "b")
    return pairs.select("a", "b", "m", "n", "own", "other").mapInArrow(_likely(percent), "a long, b long")


def _many_pairs(named: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of the entries of more classes, in tiles."""
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) - 1e-9)
    named = named.withColumn("own", band)
    spread = named.select("gid", "n", "rep", "comp", F.explode(F.array(
        F.struct(F.col("own").alias("band"), F.lit(1).cast("long").alias("role")),
        F.struct((F.col("own") + 1).alias("band"), F.lit(0).cast("long").alias("role")))).alias("s")).select(
        "gid", "n", "rep", "comp", "s.band", "s.role")
    counts = spread.groupBy("gid", "band").agg(F.count("*").alias("rows"), F.sum("role").alias("upper"), F.min("comp").alias("x"),
                                               F.max("comp").alias("y")).where("x != y and upper > 0")
    spread = spread.join(counts.select("gid", "band", F.ceil(F.col("rows") / BLOCK).alias("blocks")), ["gid", "band"])
    spread = spread.withColumn("block", F.pmod(F.xxhash64("rep"), "blocks"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tiles = spread.select("gid", "band", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
                          "n", "comp", "rep", "block", "role")
    tiles = tiles.join(classes.select("rep", "bits"), "rep").select(
        "gid", "band", "low", "high", "n", "comp", "rep", "block", "role", "bits")
    tiles = tiles.repartition("gid", "band", "low", "high").sortWithinPartitions("gid", "band", "low", "high")
    return tiles.mapInArrow(_tile_pairs(percent), "a long, b long")


def _crossing_pairs(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of classes that share a prefix entry but no component."""
    named = members.join(classes.select(F.col("s1").alias("sid"), "rep", "n", "comp"), "sid").select("gid", "n", "rep", "comp")
    crossing = named.groupBy("gid").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("held")).where("x != y")
    named = saved(named.join(crossing.select("gid", "held"), "gid"), "crossing-entries")
    few, many = named.where(F.col("held") <= FEW), named.where(F.col("held") > FEW)
    return _few_pairs(few, classes, percent).union(_many_pairs(many, classes, percent)).distinct()


def jaccard_components(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row; see the module text.

    Null or blank texts have no shingles and are their own component. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = saved(docs.mapInArrow(_sketch, "doc_id long, n long, s1 long, s2 long, anchors array<long>, bits binary, shared array<long>, held array<long>"), "shingle-sketch")

    shared = sketch.where("shared is not null").select(F.explode(F.arrays_zip("shared", "held")).alias("e")).groupBy(
        F.col("e.shared").alias("h")).agg(F.sum("e.held").alias("held")).where(f"held >= {FREQUENT}")
    shared = shared.orderBy(F.desc("held"), "h").limit(FREQUENT_MOST).select("h").toPandas()["h"]
    frequent = spark.sparkContext.broadcast(np.sort(shared.to_numpy(np.int64).view(np.uint64)))

    filled = sketch.where("n > 0")
    classes = filled.groupBy("s1", "s2").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("anchors").alias("anchors"), F.first("bits").alias("bits"))
    classes = saved(classes.where("rep is not null"), "shingle-classes")

    total = classes.agg(F.sum("n")).first()[0] or 0
    anchored = classes.select("rep", "n", F.posexplode("anchors").alias("k", "anchor"))
    leaders = anchored.groupBy("k", "anchor").agg(F.min(F.struct("rep", "n")).alias("lead"), F.count("*").alias("members")).where("members > 1")
    near = anchored.join(leaders, ["k", "anchor"]).where("rep != lead.rep").where(
        f"100 * least(n, lead.n) >= {percent} * greatest(n, lead.n)").groupBy(F.col("rep").alias("b"), F.col("lead.rep").alias("a")).agg(
        F.count("*").alias("equal")).where("equal > 1")
    near = near.groupBy("b").agg(F.max_by("a", F.struct("equal", -F.col("a"))).alias("a")).select("a", "b")
    links = saved(verified(saved(near, "near-pairs"), classes, docs, percent), "near-links")
    joined = components(links)
    classes = saved(classes.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select(
        "rep", "s1", "s2", "n", "bits", F.coalesce("component", "rep").alias("comp")), "near-classes")

    buckets = max(1, math.ceil(total * (100 - percent) / 100 / BUCKET_ENTRIES))
    entries = docs.select("text").mapInArrow(_entries(frequent, buckets, percent), "bucket long, pack binary")
    members = saved(entries.groupBy("bucket").applyInArrow(_shared_entries(buckets), "gid long, sid long"), "prefix-members")
    pairs = saved(_crossing_pairs(members, classes, percent), "crossing-pairs")
    more = saved(verified(pairs, classes, docs, percent), "crossing-links")
    if more.take(1):
        of = classes.select("rep", "comp")
        across = more.join(of.select(F.col("rep").alias("a"), F.col("comp").alias("x")), "a").join(
            of.select(F.col("rep").alias("b"), F.col("comp").alias("y")), "b")
        merged = components(across, "x", "y")
        classes = classes.join(merged.withColumnRenamed("node", "comp"), "comp", "left").withColumn(
            "comp", F.coalesce("component", "comp"))

    ids = sketch.where("n is not null").select("doc_id", F.col("n").alias("n_shingles"), "s1", "s2")
    linked = ids.where("n_shingles > 0 and doc_id is not null").join(
        classes.select("s1", "s2", "comp"), ["s1", "s2"], "left").select("doc_id", "n_shingles", F.col("comp").alias("component_id"))
    alone = ids.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone)


def one_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The documents without those that a smaller doc_id of their component stands for.

    Rows without words stay; of rows with one doc_id all that are equal in it stay.
    """
    keep = jaccard_components(docs, percent).where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(keep, "doc_id", "left_anti").select(docs.columns)

"""Line deduplication by an exact set-similarity join.

A line is the set of its words (lower case). A line is a repeat when an earlier line of the
corpus, by (doc_id, line number), has a Jaccard similarity of at least the threshold with it;
every repeat is removed, however short it is. Lines without words stay.

1. Word counts over all texts give the order: rare words first. Words counted fewer than
   ``LOCAL`` times in a slice are all rare and ordered by hash. The order only decides how
   many candidates there are, never which lines match.
2. Prefix filter: a line of n words can only match lines that share one of its first
   n - ceil(t n) + 1 words. An entry carries the line's place, size and a signature of
   parities: 64 bits, 128 from ``MIDDLE`` words and 256 from ``LONG``.
3. Entries meet by word. Lines of equal sets (by size, signature and a check sum of the words)
   are repeats of the first of them at once. Those that equal an earlier line of the same slice of
   texts leave before the entries meet: they travel in spread groups with the line they repeat, so
   a word's group holds one entry per slice of a line that is repeated without end.
   Of the others, length filter, positional filter and the signatures' bit counts bound the
   overlap from above; each line proposes its ``KEPT`` most similar earlier ones, or ``MANY``.
4. Proposals are verified exactly in rounds, the most similar first; a line that matched leaves.
   A line with more candidates than it could propose, none of which held, is compared with all
   of them: entries of the words that such lines hold meet once more, with the widest signatures.

Null texts have no lines; an empty table has no repeats. Rows that repeat a doc_id share their places
and their fate, rows of a null doc_id are left alone. Of earlier lines that match equally well the
first one found is named; which lines are repeats does not depend on it. Other columns, whatever their names,
pass through ``without_repeats`` untouched. A very long text is read in parts.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from barloom.llm.components import bitmap, fresh_names, in_bitmap, maybe_in, saved
from barloom.llm.tokens import SLICE_BYTES, common, distinct, hash_words, mix, released, table, texts

PERCENT = 80
LOCAL = 8               # counts of a slice below this are not gathered
FREQUENT_MOST = 65_536  # words with a rank, the most frequent
BUCKET_ENTRIES = 300_000
HELD_ENTRIES = 200_000  # entries that are packed together
HELD_PAIRS = 500_000    # pairs between two selections of the nearest
KEPT, MANY = 4, 64      # candidates that a line proposes in a word's group
ROUNDS = (1, 4, 16)     # candidates verified by the end of each round; the last round takes the rest
EQUAL = -1              # stands for the difference of lines with equal check sums and signatures
MIDDLE, LONG = 40, 80   # distinct words from which a signature has two columns of 64 bits, and four

_NEWLINE = 10
_RANKED = np.uint64(1) << np.uint64(40)
_PLAIN = {"h": np.uint32, "doc": np.int64, "check": np.uint32, "bits": np.uint64}
_SMALL = ("n", "at", "line")   # two bytes each where they fit, four elsewhere
_PACKS = {"bucket": pa.int64()} | {k: pa.binary() for k in (*_PLAIN, *_SMALL)}
_PACKS_SQL = "bucket long, " + ", ".join(f"`{k}` binary" for k in list(_PACKS)[1:])


def _parts(column):
    """``first row, data, bounds of texts, starts of lines``; a very long text comes in parts, each with its first line's number."""
    for row, data, bounds in texts(column):
        breaks = np.flatnonzero(data == _NEWLINE) + 1
        cuts = np.union1d(bounds[:-1], breaks)
        cuts = cuts[cuts < len(data)]
        if not len(cuts):
            continue
        if len(data) <= 4 * SLICE_BYTES:
            yield row, data, bounds, cuts, 0
            continue
        at = 0
        while at < len(cuts):
            last = max(at + 1, int(np.searchsorted(cuts, cuts[at] + SLICE_BYTES)))
            stop = cuts[last] if last < len(cuts) else len(data)
            yield row, data[cuts[at]:stop], np.array([0, stop - cuts[at]]), cuts[at:last] - cuts[at], at
            at = last


def _lines(column):
    """``first row, words, first word of each line, row of each line, number of each line`` slice by slice."""
    for row, data, bounds, cuts, number in _parts(column):
        words, first = hash_words(data, np.append(cuts, len(data)))
        owner = np.searchsorted(bounds, cuts, side="right") - 1
        yield row, words, first, owner, number + np.arange(len(cuts)) - np.searchsorted(cuts, bounds[owner])


def _counts(batches):
    for batch in batches:
        for _, words, _, _, _ in _lines(batch.column(0)):
            values = np.sort(words)
            starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
            counts = np.diff(np.append(starts, len(values)))
            keep = counts >= LOCAL
            yield table({"word": values[starts[keep]].view(np.int64), "n": counts[keep]}, {"word": pa.int64(), "n": pa.int64()})


_KEY = np.uint64(41)   # bits of a word's place in the order; a slice has fewer than 2 ** 23 lines
_KEY_MASK = (np.uint64(1) << _KEY) - np.uint64(1)
_SLOT = np.uint64(44)  # the leading bits of a word are its slot


class _Ranks:
    """Keys of words in the order of lines: rare words by hash, 40 bits; the frequent ones above them by rank."""

    def __init__(self, frequent, place):
        self.frequent, self.place = frequent, place
        slot = frequent >> _SLOT
        self.slots = np.zeros(1 << 20, np.uint32)   # of words in one slot the most frequent
        by_rank = np.argsort(place)
        self.slots[slot[by_rank]] = by_rank
        self.crowded = np.bincount(slot.astype(np.int64), minlength=1 << 20) > 1

    def keys(self, words):
        keys = mix(words) >> np.uint64(24)
        if len(self.frequent):
            slot = words >> _SLOT
            at = self.slots[slot]
            known = self.frequent[at] == words
            left = np.flatnonzero(~known & self.crowded[slot])
            at[left] = np.minimum(np.searchsorted(self.frequent, words[left]), len(self.frequent) - 1)
            known[left] = self.frequent[at[left]] == words[left]
            keys[known] = _RANKED | self.place[at[known]]
        return keys


def _line_keys(first, keys):
    """``line, key`` of the distinct words of every line, in the order of line and key."""
    line = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
    both = distinct((line << _KEY) | keys)
    return (both >> _KEY).astype(np.int64), both & _KEY_MASK


def _columns(n):
    """How many columns the signatures of lines of ``n`` words have."""
    return np.where(n >= LONG, 4, np.where(n >= MIDDLE, 2, 1))


def _entries(ranks, buckets, percent, words_met=None):
    """Packed prefix entries per bucket of word hashes; with ``words_met``, a bitmap, those of the words in it, with the widest signatures."""

    def run(batches):
        order = _Ranks(*ranks.value)
        for batch in batches:
            held, copies, size = [], [], 0
            for row, words, first, owner, number in _lines(batch.column(1)):
                docs = batch.column(0).slice(row, int(owner[-1]) + 1).to_numpy(zero_copy_only=False)
                keys = order.keys(words)
                if words_met is not None:   # lines without such a word have no entry
                    hit = np.append(0, np.cumsum(in_bitmap(words_met.value, (mix(keys) >> np.uint64(32)).astype(np.uint32))))
                    some = hit[first[1:]] > hit[first[:-1]]
                    of_some = np.repeat(some, np.diff(first))
                    first = np.append(0, np.cumsum(np.diff(first)[some]))
                    keys, owner, number = keys[of_some], owner[some], number[some]
                line, keys = _line_keys(first, keys)
                n = np.bincount(line, minlength=len(number))
                starts = np.cumsum(n) - n
                spread = mix(keys)
                full = n > 0
                check, wide = np.zeros(len(n), np.uint32), np.zeros((len(n), 4), np.uint64)
                if not full.any():
                    continue
                check[full] = np.add.reduceat(spread, starts[full]).astype(np.uint32)
                flips = np.uint64(1) << (spread >> np.uint64(58))
                column = (spread >> np.uint64(56)) & np.uint64(3)
                for c in range(4):
                    wide[full, c] = np.bitwise_xor.reduceat(np.where(column == c, flips, np.uint64(0)), starts[full])
                doc = docs[owner]
                position = np.arange(len(line)) - starts[line]
                prefix = n - -(-percent * n // 100) + 1
                chosen = position < prefix[line]
                if words_met is not None:
                    chosen &= in_bitmap(words_met.value, (spread >> np.uint64(32)).astype(np.uint32))
                else:
                    again, leader = _copies(n, check, wide, doc, number)
                    repeated = np.zeros(len(n), bool)
                    repeated[again] = True
                    chosen &= ~repeated[line]
                    apart = (doc[again] != doc[leader]) | (number[again] != number[leader])
                    again, leader = again[apart], leader[apart]
                    if len(again):
                        copies.append({"doc": doc[again], "line": number[again], "bits": doc[leader], "at": number[leader]})
                        size += len(again)
                line, spread, position = line[chosen], spread[chosen], position[chosen]
                if len(line):
                    held.append({"bucket": (spread % np.uint64(buckets)).astype(np.int64), "h": spread >> np.uint64(32), "n": n[line], "at": position,
                                 "line": number[line], "doc": doc[line], "check": check[line], "bits": wide[line]})
                    size += len(line)
                if size > HELD_ENTRIES:
                    yield from _flushed(held, copies, buckets, words_met is not None)
                    held, copies, size = [], [], 0
            yield from _flushed(held, copies, buckets, words_met is not None)

    return run


def _copies(n, check, wide, doc, number):
    """Lines of a slice whose set equals that of one before it by (doc, number), and the first such one."""
    rows = np.flatnonzero(n)
    name = mix(n[rows].astype(np.uint64) + (check[rows].astype(np.uint64) << np.uint64(20)))
    for c in range(4):
        name = mix(name + wide[rows, c])
    order = np.lexsort((number[rows], doc[rows], name))
    rows, name = rows[order], name[order]
    same = np.zeros(len(rows), bool)
    same[1:] = name[1:] == name[:-1]
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(rows))))
    return rows[same], rows[first[same]]


def _flushed(held, copies, buckets, widest):
    if held:
        yield _packed(held, widest)
    if copies:
        yield _packed_copies(copies, buckets)


def _packed_copies(copies, buckets):
    """Copies with their first ones, in a group below zero: these are spread, whatever line they repeat."""
    whole = {k: np.concatenate([x[k] for x in copies]).astype(np.int64) for k in copies[0]}
    salt = int(mix(whole["doc"][:1].view(np.uint64))[0] % np.uint64(buckets))
    return table({"bucket": [-1 - salt]} | {k: [whole[k].tobytes() if k in whole else b""] for k in list(_PACKS)[1:]}, _PACKS)


def _copies_proposed(packs):
    doc, line, to_doc, to_line = (np.concatenate([np.frombuffer(b, np.int64) for b in packs.column(k).to_pylist()]) for k in ("doc", "line", "bits", "at"))
    return pa.table({"doc": doc, "line": line, "to_doc": to_doc, "to_line": to_line, "apart": np.full(len(doc), EQUAL, np.int32), "more": np.zeros(len(doc), bool)})


def _packed(held, widest):
    """Entries by bucket, packed; ``held`` is used up column by column, so no two whole copies are kept."""
    bucket = np.concatenate([x.pop("bucket") for x in held])
    order = np.argsort(bucket.astype(np.uint16) if bucket.max() < 1 << 16 else bucket, kind="stable")
    bucket = bucket[order]
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist()
    spans = list(zip(cut, [*cut[1:], len(bucket)]))
    out = {"bucket": bucket[cut]}
    whole = np.concatenate([x["n"] for x in held])[order]
    width = np.full(len(whole), 4) if widest else _columns(whole)
    for k in ("h", "doc", "check", *_SMALL):
        whole = np.concatenate([x.pop(k) for x in held])[order]
        if k in _PLAIN:
            whole = whole.astype(_PLAIN[k])
            values = [whole[a:b].tobytes() for a, b in spans]
        else:
            values = [whole[a:b].astype(np.uint16 if whole[a:b].max() < 1 << 16 else np.uint32).tobytes() for a, b in spans]
        out[k] = pa.array(values, _PACKS[k])
    del whole, values
    wide = np.concatenate([x.pop("bits") for x in held])[order]
    two, one = width == 2, width == 1
    wide[two, :2] ^= wide[two, 2:]
    wide[one, 0] = np.bitwise_xor.reduce(wide[one], axis=1)
    used = np.arange(4) < width[:, None]
    out["bits"] = pa.array([wide[a:b][used[a:b]].tobytes() for a, b in spans], _PACKS["bits"])
    del wide
    return table(out, _PACKS)


_PROPOSAL = "doc long, line long, to_doc long, to_line long, apart int, more boolean"


def _unpacked(packs, widest=False):
    data = {k: np.concatenate([np.frombuffer(b, _PLAIN[k]) for b in packs.column(k).to_pylist()]) for k in ("h", "doc", "check")}
    counts = [len(b) // 4 for b in packs.column("h").to_pylist()]
    for k in _SMALL:
        data[k] = np.concatenate([np.frombuffer(b, np.uint16 if len(b) == 2 * c else np.uint32).astype(np.int64)
                                  for b, c in zip(packs.column(k).to_pylist(), counts)])
    width = np.full(len(data["h"]), 4) if widest else _columns(data["n"])
    wide = np.zeros((len(width), 4), np.uint64)
    wide[np.arange(4) < width[:, None]] = np.concatenate([np.frombuffer(b, np.uint64) for b in packs.column("bits").to_pylist()])
    return data | {"bits": wide, "width": width, "fold": np.bitwise_xor.reduce(wide, axis=1)}


def _apart(data, i, j):
    """The difference of signatures at the width of the narrower one; folding by xor keeps parities."""
    width = np.minimum(data["width"][i], data["width"][j])
    out = np.empty(len(i), np.int64)
    for columns in (1, 2, 4):
        rows = np.flatnonzero(width == columns)
        if len(rows):
            differ = data["bits"][i[rows]] ^ data["bits"][j[rows]]   # a narrower one has its fold in front and zeros behind
            if columns < 4:
                differ = np.bitwise_xor.reduce(differ.reshape(len(rows), 4 // columns, columns), axis=1)
            out[rows] = np.bitwise_count(differ).sum(axis=1, dtype=np.int64)
    return out


def _taken(data, rows):
    return {k: v[rows] for k, v in data.items()}


def _pairs(data, percent, wanted=None):
    """``later, earlier, apart`` arrays of the pairs that all bounds allow, distance by distance in the order by word and size.

    ``wanted``: only pairs whose later line is marked."""
    h, n = data["h"], data["n"]
    rank = np.empty(len(h), np.int64)
    rank[np.lexsort((data["line"], data["doc"]))] = np.arange(len(h))
    i = np.arange(1, len(h))
    gap = 0
    while len(i):
        gap += 1
        i = i[i >= gap]
        j = i - gap
        near = (h[i] == h[j]) & (100 * n[j] >= percent * n[i])
        i, j = i[near], j[near]
        need = -(-percent * (n[i] + n[j]) // (100 + percent))
        room = np.minimum(data["at"][i], data["at"][j]) + np.minimum(n[i] - data["at"][i], n[j] - data["at"][j])
        # The fold of a signature costs least and leaves few pairs for the columns.
        fits = (room >= need) & ((n[i] + n[j] - np.bitwise_count(data["fold"][i] ^ data["fold"][j])) // 2 >= need)
        i_, j_, need = i[fits], j[fits], need[fits]
        apart = _apart(data, i_, j_)
        ok = (n[i_] + n[j_] - apart) // 2 >= need
        a, b, apart = i_[ok], j_[ok], apart[ok]
        swap = rank[a] < rank[b]
        later, earlier = np.where(swap, b, a), np.where(swap, a, b)
        keep = (data["doc"][a] != data["doc"][b]) | (data["line"][a] != data["line"][b])
        if wanted is not None:
            keep &= wanted[later]
        yield later[keep], earlier[keep], apart[keep]


def _proposed(data, later, earlier, apart, more):
    return pa.table({"doc": data["doc"][later], "line": data["line"][later], "to_doc": data["doc"][earlier], "to_line": data["line"][earlier],
                     "apart": apart.astype(np.int32), "more": more})


def _equal_classes(data):
    """Entries in the order by word and size with equal sets together, the earliest first; and which repeat the one before."""
    rank = np.empty(len(data["h"]), np.int64)
    rank[np.lexsort((data["line"], data["doc"]))] = np.arange(len(rank))
    sizes = (data["h"].astype(np.uint64) << np.uint64(32)) | data["n"].astype(np.uint64)
    name = mix(data["fold"] + (data["check"].astype(np.uint64) << np.uint64(20)) + data["at"].astype(np.uint64))
    order = np.lexsort((rank, name, sizes))
    sizes, name = sizes[order], name[order]
    same = np.zeros(len(order), bool)
    same[1:] = (sizes[1:] == sizes[:-1]) & (name[1:] == name[:-1])
    return _taken(data, order), same


def _nearest(later, earlier, apart, sure):
    """The nearest ``KEPT`` of each line's candidates, or ``MANY`` if even the nearest is not surely a match; and if there were more."""
    order = np.lexsort((earlier, apart, later))
    later, earlier, apart = later[order], earlier[order], apart[order]
    starts = np.flatnonzero(np.concatenate([[True], later[1:] != later[:-1]]))
    counts = np.diff(np.append(starts, len(later)))
    place = np.arange(len(later)) - np.repeat(starts, counts)
    most = np.where(apart[starts] <= sure[later[starts]], KEPT, MANY)
    keep = place < np.repeat(most, counts)
    return later[keep], earlier[keep], apart[keep], np.repeat(counts > most, counts)[keep]


def _proposals(percent):
    def run(packs):
        released()
        if packs.column("bucket")[0].as_py() < 0:
            return _copies_proposed(packs)
        data, same = _equal_classes(_unpacked(packs))
        first = np.flatnonzero(~same)
        leader = first[np.cumsum(~same) - 1]
        copies = np.flatnonzero(same & (data["at"] == 0) & ((data["doc"] != data["doc"][leader]) | (data["line"] != data["line"][leader])))
        out = [_proposed(data, copies, leader[copies], np.full(len(copies), EQUAL), np.zeros(len(copies), bool))]
        heads = _taken(data, first)
        # Below half of the difference that a match may have, the signatures leave little doubt; they say little of very long lines.
        sure = np.where(heads["n"] < 4 * LONG, (100 - percent) * heads["n"] // (100 + percent), -1)
        del data
        held, size, most, over = [], 0, HELD_PAIRS, np.zeros(len(first), bool)

        def compact():
            *pairs, more = _nearest(*(np.concatenate(x) for x in zip(*held)), sure)
            over[pairs[0][more]] = True
            return [tuple(pairs)]

        for pairs in _pairs(heads, percent):
            if len(pairs[0]):
                held.append(pairs)
                size += len(pairs[0])
            if size > most:
                held = compact()
                size = len(held[0][0])
                most = 2 * size + HELD_PAIRS
        if held:
            later, earlier, apart = compact()[0]
            out.append(_proposed(heads, later, earlier, apart, over[later]))
        return pa.concat_tables(out)

    return run


def _all_candidates(percent, wanted):
    """All earlier candidates of the lines in the bitmap ``wanted``, of equal lines the first."""

    def run(packs):
        released()
        data, same = _equal_classes(_unpacked(packs, widest=True))
        heads = _taken(data, np.flatnonzero(~same))
        marked = in_bitmap(wanted.value, _place(heads["doc"], heads["line"]))
        empty = np.zeros(0, np.int64)
        out = [_proposed(heads, a, b, c, np.zeros(len(a), bool)) for a, b, c in _pairs(heads, percent, marked) if len(a)]
        return pa.concat_tables(out or [_proposed(heads, empty, empty, empty, np.zeros(0, bool))])

    return run


def _place(doc, line):
    return mix(mix(np.asarray(doc).astype(np.int64).view(np.uint64)) + np.asarray(line).astype(np.uint64))


def _placed(batches):
    for batch in batches:
        places = _place(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        yield table({"place": places.view(np.int64)}, {"place": pa.int64()})


def _prefix_words(ranks, percent):
    """The spread hashes, 32 bits, of the prefix words of given lines, from their sorted word sets."""

    def run(batches):
        order = _Ranks(*ranks.value)
        for batch in batches:
            found = []
            for own in batch.column(0).to_pylist():
                words = np.frombuffer(own, np.uint64)
                keys = distinct(order.keys(words) & _KEY_MASK)
                found.append(mix(keys[:len(keys) - -(-percent * len(keys) // 100) + 1]) >> np.uint64(32))
            yield table({"h": np.unique(np.concatenate(found)).astype(np.int64) if found else []}, {"h": pa.int64()})

    return run


def _word_sets(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``doc, line, words`` of the given places: the sorted 64-bit members of the line's set."""
    wanted = places.distinct().groupBy("doc").agg(F.collect_list("line").alias("lines"))
    wanted = saved(wanted, "line-places")
    candidates = maybe_in(docs.select(F.col("doc_id").alias("doc"), "text"), wanted.select("doc"), "doc")
    schema = {"doc": pa.int64(), "line": pa.int64(), "words": pa.binary()}

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            lists = lists.slice(0)
            lengths = np.diff(np.asarray(lists.offsets))
            asked = (np.repeat(np.arange(len(lists)), lengths) << 32) | np.asarray(lists.flatten())
            for row, words, first, owner, number in _lines(batch.column(1)):
                chosen = np.flatnonzero(np.isin((owner + row << 32) | number, asked))
                sets = [distinct(words[first[i]:first[i + 1]]) for i in chosen]
                if sets:
                    yield table({"doc": batch.column(0).take(pa.array(owner[chosen] + row)), "line": number[chosen],
                                 "words": [own.tobytes() for own in sets]}, schema)

    met = candidates.join(wanted, "doc").select("doc", "text", "lines")
    return saved(met.mapInArrow(run, "doc long, line long, words binary"), "line-words")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs whose exact Jaccard reaches ``percent``, with it."""
    names = ["doc", "line", "to_doc", "to_line"]
    met = pairs.select(names).join(sets.select("doc", "line", "words"), ["doc", "line"]).join(
        sets.select(F.col("doc").alias("to_doc"), F.col("line").alias("to_line"), F.col("words").alias("to_words")), ["to_doc", "to_line"])
    schema = {n: pa.int64() for n in names} | {"jaccard": pa.float64()}

    def run(batches):
        for batch in batches:
            value = np.zeros(batch.num_rows)
            for i, (a, b) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = common(a, b)
                union = len(a) + len(b) - both
                value[i] = both / union if 100 * both >= percent * union else -1
            keep = np.flatnonzero(value >= 0)
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(keep)) for i in range(4)] + [pa.array(value[keep])], names=list(schema))

    return met.select(*names, "words", "to_words").mapInArrow(run, ", ".join(f"{n} long" for n in names) + ", jaccard double")


def repeats(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, line_no, first_doc_id, first_line_no, jaccard``: one row for each line to remove, with an earlier line that it matches."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(
        "doc_id is not null and text is not null")
    counts = docs.select("text").mapInArrow(_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = saved(counts, "word-counts")
    top = counts.orderBy(F.desc("n"), "word").limit(FREQUENT_MOST).toPandas()
    frequent = top["word"].to_numpy(np.int64).view(np.uint64)
    place = np.arange(len(frequent), 0, -1).astype(np.uint64)
    order = np.argsort(frequent)
    ranks = spark.sparkContext.broadcast((frequent[order], place[order]))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(size / 6 * (100 - percent) / 100 / BUCKET_ENTRIES))

    packs = docs.mapInArrow(_entries(ranks, buckets, percent), _PACKS_SQL)
    found = saved(packs.groupBy("bucket").applyInArrow(_proposals(percent), _PROPOSAL), "line-proposals")
    places = ["doc", "line", "to_doc", "to_line"]
    equal = found.where(f"apart = {EQUAL}").select(*places, F.lit(1.0).alias("jaccard"))
    near = found.where(f"apart != {EQUAL}").join(equal.select("doc", "line"), ["doc", "line"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("doc", "line").orderBy("apart", "to_doc", "to_line"))
    near = near.groupBy(places).agg(F.min("apart").alias("apart"), F.max("more").alias("more")).withColumn("nth", nth)
    near = saved(near, "line-candidates")
    sets = _word_sets(docs, near.select("doc", "line").union(near.select("to_doc", "to_line")))
    held = None
    for above, most in zip((0, *ROUNDS), (*ROUNDS, None)):
        asked = near.where(f"nth > {above}" + (f" and nth <= {most}" if most else ""))
        if held is not None:
            asked = asked.join(held.select("doc", "line"), ["doc", "line"], "left_anti")
        found = saved(_verified(asked, sets, percent), "line-repeats")
        held = found if held is None else held.union(found)

    open_ = saved(near.where("more").select("doc", "line").distinct().join(held.select("doc", "line"), ["doc", "line"], "left_anti"), "open-lines")
    if open_.take(1):
        prefixes = open_.join(sets, ["doc", "line"]).select("words").mapInArrow(_prefix_words(ranks, percent), "h long")
        words_met = spark.sparkContext.broadcast(bitmap(prefixes, "h"))
        marks = open_.select("doc", "line").mapInArrow(_placed, "place long")
        wanted = spark.sparkContext.broadcast(bitmap(marks, "place"))
        packs = docs.mapInArrow(_entries(ranks, buckets, percent, words_met), _PACKS_SQL)
        every = packs.groupBy("bucket").applyInArrow(_all_candidates(percent, wanted), _PROPOSAL).select(*places).distinct()
        every = saved(every.join(near.select(places), places, "left_anti"), "line-candidates")
        own = _word_sets(docs, every.select("doc", "line").union(every.select("to_doc", "to_line")))
        held = held.union(saved(_verified(every, own, percent), "line-repeats"))
    held = held.union(equal)
    best = held.groupBy("doc", "line").agg(F.max_by(F.struct("to_doc", "to_line", "jaccard"), F.struct("jaccard", -F.col("to_doc"), -F.col("to_line"))).alias("m"))
    return best.select(F.col("doc").alias("doc_id"), F.col("line").alias("line_no"), F.col("m.to_doc").alias("first_doc_id"),
                       F.col("m.to_line").alias("first_line_no"), F.col("m.jaccard").alias("jaccard"))


def without_repeats(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents without their repeated lines. A document that loses lines and has no word left goes;
    ``n_chars``, where there is one, counts the code points that are left."""
    names = docs.columns
    gone_name, = fresh_names(docs, "gone")
    gone = repeats(docs, percent).groupBy(F.col("doc_id").alias("key")).agg(F.collect_set("line_no").alias(gone_name))
    joined = docs.join(gone, docs["doc_id"] == gone["key"], "left")
    changed = F.col(gone_name).isNotNull()
    # Nondeterministic only by name: else Spark repeats the function in the filter and for n_chars, in workers of its own.
    kept = _without.asNondeterministic()(F.when(changed, docs["text"].cast("string")), F.col(gone_name))
    out = joined.select(*[docs[f"`{n}`"] for n in names if n != "text"], F.when(changed, kept).otherwise(docs["text"]).alias("text"), F.col(gone_name))
    out = out.where(F.col(gone_name).isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col(gone_name).isNull(), F.col("n_chars")).otherwise(
            F.length("text").cast(dict(docs.dtypes)["n_chars"])))
    return out.select(*[f"`{n}`" for n in names])


@F.pandas_udf(StringType())
def _without(text: pd.Series, gone: pd.Series) -> pd.Series:
    """The text without the lines of the given numbers."""
    out = []
    for t, lines in zip(text, gone):
        if t is None or lines is None:
            out.append(t)
            continue
        lines = set(lines)
        out.append("\n".join(x for i, x in enumerate(t.split("\n")) if i not in lines))
    return pd.Series(out, dtype=object)

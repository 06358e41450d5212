"""Tolerant reading of bar CSV folders, with everything that was not taken as a table of its own.

Files are read by Spark's own text reader, so any store that Spark reaches will do. A file's header is its
first line that names a date column and one more bar column; further layout lines (ticker names, an empty
date line) may follow it. Cells are found by name, whatever their case, order or number.

A file of up to ``WHOLE_BYTES`` is one row, judged where it is read: nothing is shuffled. Larger and compressed
files are read as lines and split by ranges like any other; headers return to their lines by a join on the
file, one short row a file, which the optimizer broadcasts only below its own limit.

``scan`` gives three frames over the same lines:

* ``bars``: typed rows with ``seq``, their place in the file;
* ``rejects``: every other line with its cell-level ``reason`` (the first that applies);
* ``files``: one row per file with its counts, and a ``reason`` if the whole file was left out.

Every non-blank line after the header is in exactly one of ``bars``, ``rejects`` and the layout lines
counted in ``files``. Lines of a file without a header, or with a bar column missing, are counted but not
listed one by one. Empty folders give empty frames; empty files have no line and are not seen.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.schema import PRICE_COLUMNS

# The bar columns, and the names that stand for the date in known layouts.
WANTED = ["date", *PRICE_COLUMNS, "volume"]
DATE_NAMES = ["date", "datetime", "timestamp"]
DATE_FALLBACK = "price"
LAYOUT_CELLS = ["", "ticker", "date"]
# Files up to this size are judged whole, unless their name says that they are compressed.
WHOLE_BYTES = 2**20
COMPRESSED = r"(?i)\.(gz|gzip|bz2|deflate|lz4|snappy|zst|zstd|passc)$"


@dataclass
class BarFiles:
    bars: DataFrame
    rejects: DataFrame
    files: DataFrame


def cells_of(line: Column) -> Column:
    """The cells of a CSV line, trimmed; quoted cells may hold commas and doubled quotes."""
    quoted = F.regexp_extract_all(line, F.lit(r'(?:^|(?<=,))(?:\s*"(?:[^"]|"")*+"\s*|[^,]*)(?=,|$)'), F.lit(0))
    plain = F.transform(quoted, lambda c: F.regexp_replace(F.regexp_replace(F.trim(c), r'^"([\s\S]*)"$', "$1"), '""', '"'))
    return F.transform(F.when(F.contains(line, F.lit('"')), plain).otherwise(F.split(line, ",", -1)), lambda c: F.trim(c))


def _place(names: Column, wanted: str) -> Column:
    """1-based place of a bar column among lower-case header names, 0 if it is not there.

    The exact name goes before a name that contains it. An adjusted price stands for nothing.
    """
    def first(test):
        return F.array_position(F.transform(names, lambda n: test(n)), True)

    exact = [DATE_NAMES] if wanted == "date" else [[wanted]]
    options = [first(lambda n: n.isin(exact[0])), first(lambda n: F.contains(n, F.lit(wanted)) & ~F.contains(n, F.lit("adj")))]
    if wanted == "date":
        options.append(first(lambda n: n == DATE_FALLBACK))
    return reduce(lambda a, b: F.when(a > 0, a).otherwise(b), options)


def symbol_of(path: Column) -> Column:
    """The symbol of a file: of its ``symbol=`` folder if it has one, else the file's name without ending."""
    def decoded(text):
        return F.url_decode(F.regexp_replace(text, r"\+", "%2B"))

    # The path is a URI, and a folder's value is escaped once more within it.
    folder = F.regexp_extract(path, r"/symbol=([^/]+)/[^/]*$", 1)
    name = F.regexp_extract(path, r"([^/]+?)(?:\.(?:csv|txt))?(?:\.gz)?$", 1)
    return F.when(folder != "", decoded(decoded(folder))).otherwise(decoded(name))


def _read(spark: SparkSession, path: str, glob: str, source: str) -> DataFrame:
    return spark.read.format(source).option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)


def _small() -> Column:
    return (F.col("_metadata.file_size") <= WHOLE_BYTES) & ~F.col("_metadata.file_name").rlike(COMPRESSED)


def _unmarked(line: Column) -> Column:
    return F.regexp_replace(line, "^\ufeff", "")


def _lines(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return _read(spark, path, glob, "text").where(~_small()).select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("seq"),
        _unmarked(F.col("value")).alias("line"),
    ).where(F.trim("line") != "").withColumn("cells", cells_of(F.col("line")))


def _likely(line: Column) -> Column:
    text = F.lower(line)
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in ("date", "timestamp", DATE_FALLBACK)])


def _places(cells: Column) -> Column:
    names = F.transform(cells, F.lower)
    return F.array(*[_place(names, c) for c in WANTED])


def _named(places: Column) -> Column:
    """Whether a line names a date and another bar column."""
    return (F.get(places, F.lit(0)) > 0) & (F.array_max(F.slice(places, 2, len(WANTED) - 1)) > 0)


def _headers(lines: DataFrame) -> DataFrame:
    """``file, header_seq, places`` of the first line of a file that names a date and another bar column."""
    placed = lines.where(_likely(F.col("line"))).select("file", "seq", _places(F.col("cells")).alias("places"))
    return placed.where(_named(F.col("places"))).groupBy("file").agg(F.min(F.struct("seq", "places")).alias("h")).select(
        "file", F.col("h.seq").alias("header_seq"), F.col("h.places").alias("places"))


def _whole_files(files: DataFrame) -> DataFrame:
    """``file, header_seq, places, lines`` of every small file that has a line; ``lines`` as structs of seq, line and cells."""
    def numbered(line, i):
        return F.struct(F.struct(F.lit(0).cast("long").alias("block"), i.cast("long").alias("row")).alias("seq"), line.alias("line"))

    def celled(x):
        return F.struct(x["seq"].alias("seq"), x["line"].alias("line"), cells_of(x["line"]).alias("cells"))

    def placed(x):
        return F.struct(x["seq"].alias("seq"), _places(x["cells"]).alias("places"))

    text = F.col("content").cast("string")
    texts = files.where(_small() & text.rlike("[^ \\r\\n\ufeff]"))
    parts = F.transform(F.transform(F.split(text, "\r\n|\r|\n", -1), _unmarked), numbered)
    split = texts.select(F.col("_metadata.file_path").alias("file"), F.filter(parts, lambda x: F.trim(x["line"]) != "").alias("parts"))
    cells = split.select("file", F.transform("parts", celled).alias("lines"))
    headers = F.filter(F.transform(F.filter("lines", lambda x: _likely(x["line"])), placed), lambda x: _named(x["places"]))
    headed = cells.select("file", "lines", F.get(headers, F.lit(0)).alias("h"))
    return headed.select("file", F.col("h.seq").alias("header_seq"), F.col("h.places").alias("places"), "lines")


def _numbers(texts: Column) -> Column:
    """The finite doubles of an array of cells, null for others; thousands may be parted by commas."""
    def plain(t):
        return F.when(F.contains(t, F.lit(",")), F.regexp_replace(t, r"(?<=[0-9]),(?=[0-9]{3})", "")).otherwise(t)

    values = F.transform(texts, lambda t: plain(t).try_cast("double"))
    return F.transform(values, lambda v: F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v))


def _judged(files: DataFrame) -> DataFrame:
    """``file, symbol, header_seq, file_reason, judged``: the ``lines`` of every row, typed, each with its kind and reason.

    The steps are arrays of their own, so that no cell is read twice.
    """
    places = F.col("places")
    missing = F.array_join(F.array_compact(F.array(*[F.when(places[i] == 0, F.lit(c)) for i, c in enumerate(WANTED)])), ", ")
    file_reason = F.when(F.col("header_seq").isNull(), "no header").when(missing != "", F.concat(F.lit("missing columns: "), missing))

    def picked(x):
        cells = F.array(*[F.get(x["cells"], (places[i] - 1).cast("int")) for i in range(len(WANTED))])
        return F.struct(x["seq"].alias("seq"), x["line"].alias("line"), F.lower(x["cells"][0]).alias("first"), cells.alias("cells"))

    def typed(x):
        return F.struct(
            x["seq"].alias("seq"), x["line"].alias("line"), x["first"].alias("first"), x["cells"].alias("cells"),
            F.try_to_timestamp(x["cells"][0]).cast("date").alias("day"), _numbers(F.slice(x["cells"], 2, len(WANTED) - 1)).alias("numbers"))

    def reason(x):
        def unusable(i, value):
            empty = F.coalesce(x["cells"][i], F.lit("")) == ""
            return F.when(value.isNull(), F.concat(F.when(empty, F.lit("no ")).otherwise(F.lit("unreadable ")), F.lit(WANTED[i])))

        values = [x["day"], *[x["numbers"][i] for i in range(len(PRICE_COLUMNS))], x["numbers"][len(PRICE_COLUMNS)].try_cast("long")]
        return F.coalesce(*[unusable(i, v) for i, v in enumerate(values)])

    def reasoned(x):
        return F.struct(*[x[c].alias(c) for c in ("seq", "line", "first", "day", "numbers")], reason(x).alias("reason"))

    def kinded(x):
        after = x["seq"] > F.col("header_seq")
        layout = after & x["day"].isNull() & x["first"].isin(*LAYOUT_CELLS)
        kind = (F.when(F.col("file_reason").isNotNull(), "file").when(~after, "header").when(layout, "layout")
                .when(x["reason"].isNotNull(), "reject").otherwise("bar"))
        return F.struct(*[x[c].alias(c) for c in ("seq", "line", "day", "numbers", "reason")], kind.alias("kind"))

    known = files.select("file", symbol_of(F.col("file")).alias("symbol"), "header_seq", "places", file_reason.alias("file_reason"), "lines")
    rows = F.transform(F.transform(F.transform("lines", picked), typed), reasoned)
    return known.select("file", "symbol", "header_seq", "file_reason", F.transform(rows, kinded).alias("judged"))


def _counted(judged: DataFrame) -> DataFrame:
    """The judged rows with the counts of their lines."""
    def count(test):
        return F.size(F.filter("judged", test)).cast("long")

    header = F.col("header_seq")
    return judged.select(
        "file", "symbol", count(lambda x: header.isNull() | (x["seq"] > header)).alias("lines"), count(lambda x: x["kind"] == "bar").alias("bars"),
        count(lambda x: x["kind"] == "reject").alias("rejected"), count(lambda x: x["kind"] == "layout").alias("layout"),
        F.col("file_reason").alias("reason"), "judged")


def _of_kind(judged: DataFrame, kind: str, taken: Column | None = None) -> DataFrame:
    """One row per line of a kind, of the rows that are taken."""
    lines = F.filter("judged", lambda x: x["kind"] == kind)
    return judged.select("file", "symbol", F.explode(lines if taken is None else F.when(taken, lines)).alias("x"))


def scan(spark: SparkSession, path: str, glob: str = "*.csv", min_rows: int | None = None) -> BarFiles:
    """The bars, rejected lines and file report of a folder; files of fewer than ``min_rows`` usable rows are left out."""
    few = F.when(F.col("bars") < (min_rows or 0), F.lit(f"fewer than {min_rows} rows"))
    listed = _read(spark, path, glob, "binaryFile")
    small = _counted(_judged(_whole_files(listed))).withColumn("reason", F.coalesce("reason", few))
    bars, rejects, files = _of_kind(small, "bar", F.col("reason").isNull()), _of_kind(small, "reject"), small.drop("judged")
    # Known from the listing alone; the folder is listed again only for files that need it.
    if not listed.where(~_small()).select("length").isEmpty():
        lines = _lines(spark, path, glob)
        single = lines.select("file", F.array(F.struct("seq", "line", "cells")).alias("lines"))
        large = _counted(_judged(single.join(_headers(lines), "file", "left")))
        counts = [F.sum(c).alias(c) for c in ("lines", "bars", "rejected", "layout")]
        totals = large.groupBy("file", "symbol").agg(*counts, F.max("reason").alias("reason")).withColumn("reason", F.coalesce("reason", few))
        taken = _of_kind(large, "bar")
        if min_rows is not None:
            taken = taken.join(totals.where("reason is null").select("file"), "file", "left_semi")
        bars, rejects, files = bars.unionByName(taken), rejects.unionByName(_of_kind(large, "reject")), files.unionByName(totals)
    values = [F.col("x.numbers")[i].alias(c) for i, c in enumerate(PRICE_COLUMNS)]
    volume = F.col("x.numbers")[len(PRICE_COLUMNS)].try_cast("long").alias("volume")
    return BarFiles(
        bars.select("symbol", F.col("x.day").alias("date"), *values, volume, F.col("x.seq").alias("seq")),
        rejects.select("file", "symbol", F.col("x.seq").alias("seq"), F.col("x.line").alias("line"), F.col("x.reason").alias("reason")),
        files)

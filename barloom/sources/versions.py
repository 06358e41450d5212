"""A bar table that changes by small commits: data files, a manifest, and metadata kept with them.

A commit writes its rows as new Parquet files and then one manifest file that lists every live
file with the least and greatest symbol and date in it. The manifest is one file, so it appears whole
or not at all, and data and metadata change together; readers take the newest. Nothing is rewritten
in place. One writer at a time, as with the embedded database this stands for.

Three kinds of data files:

* ``base``: one row per key. Appended bars are newer than their symbol's series, so they are base too;
* ``delta``: corrections; the newest version of a key goes before older ones and before the base;
* ``gone``: symbols whose older rows no longer count.

A commit of more than ``FILES`` files of the asked size takes larger ones, up to ``ROWS_PER_FILE``: the range
bounds, the file list and its paths pass through the driver, which small files would make as large as the bars.

A read keeps the files whose bounds can hold what is asked for. Without corrections it is a plain
scan; with them the base is anti-joined with the corrected keys, which the optimizer broadcasts while
they are few. ``compact`` rewrites only base files that hold a corrected symbol, and small files.

``state`` is the per-symbol metadata (count, last date, last close, last sync): a commit writes the rows of
the symbols it touched, so an append reads that state and never the bars.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.series import all_of
from barloom.operators.grain import dedupe
from barloom.operators.upkeep import retain

VERSION = "__version"
ROWS_PER_FILE = 2_000_000
FILES = 256
FEW = 1000


class VersionedBars:
    """Bars keyed by (symbol, ``date``) below ``path``; ``close`` names the value kept as the last one."""

    def __init__(self, spark: SparkSession, path: str, date: str = "date", close: str = "close", rows_per_file: int = ROWS_PER_FILE):
        self.spark, self.path = spark, path.rstrip("/")
        self.date, self.close, self.rows_per_file = date, close, rows_per_file
        self.keys = ("symbol", date)

    # --- manifest ------------------------------------------------------------------

    def _commits(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/commits")

    def version(self) -> int:
        """Number of the newest commit."""
        return int(self._commits().agg(F.max("commit")).first()[0])

    def _latest(self) -> tuple[int, DataFrame]:
        version = self.version()
        return version, self.spark.read.parquet(f"{self.path}/commits/commit={version}")

    def files(self) -> DataFrame:
        """The live files of the newest commit, one row each."""
        return self._latest()[1]

    def _next(self) -> tuple[int, DataFrame]:
        """The number of the commit to make and the files it starts from."""
        version, files = self._latest()
        return version + 1, files

    def _described(self, folder: str, kind: str, version: int) -> DataFrame:
        rows = self.spark.read.parquet(folder)
        day = F.col(self.date) if self.date in rows.columns else F.lit(None).cast("date")
        return rows.groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).agg(
            F.lit(kind).alias("kind"), F.lit(version).alias("version"), F.min("symbol").alias("min_symbol"), F.max("symbol").alias("max_symbol"),
            F.min(day).alias("min_date"), F.max(day).alias("max_date"), F.count(F.lit(1)).alias("rows"))

    def _write(self, rows: DataFrame, kind: str, version: int, count: int | None = None) -> DataFrame | None:
        """New files of narrow symbol ranges and their manifest rows; None without rows."""
        folder = f"{self.path}/{kind}/{version:08d}-{uuid.uuid4().hex[:8]}"
        count = rows.count() if count is None else count
        if not count:
            return None
        order = [c for c in self.keys if c in rows.columns]
        parts = -(-count // self.rows_per_file)
        if parts > FILES:
            parts = min(parts, max(FILES, -(-count // ROWS_PER_FILE)))
        rows.withColumn(VERSION, F.lit(version)).repartitionByRange(parts, *order).sortWithinPartitions(*order).write.parquet(folder)
        return self._described(folder, kind, version)

    def _commit(self, version: int, *parts: DataFrame | None) -> None:
        present = [p for p in parts if p is not None]
        columns = ["file", "bytes", "kind", "version", "min_symbol", "max_symbol", "min_date", "max_date", "rows"]
        listed = reduce(lambda a, b: a.unionByName(b), [p.select(*columns) for p in present])
        listed.coalesce(1).write.parquet(f"{self.path}/commits/commit={version}")

    # --- reading ------------------------------------------------------------------

    def _rows(self, files: DataFrame, kind: str) -> DataFrame | None:
        # A scan's file list is held by the driver in any case.
        paths = [r[0] for r in files.where(F.col("kind") == kind).select("file").orderBy("file").collect()]
        return self.spark.read.parquet(*paths) if paths else None

    def _pruned(self, files: DataFrame, symbols, start, end) -> DataFrame:
        tests = [F.lit(True)]
        if symbols is not None:
            tests.append(reduce(lambda a, b: a | b, [F.lit(s).between(F.col("min_symbol"), F.col("max_symbol")) for s in symbols]))
        undated = F.col("min_date").isNull()
        if start is not None:
            tests.append(undated | (F.col("max_date") >= F.lit(start).cast("date")))
        if end is not None:
            tests.append(undated | (F.col("min_date") <= F.lit(end).cast("date")))
        return files.where(all_of(tests))

    def _wanted(self, rows: DataFrame, symbols, start, end) -> DataFrame:
        if symbols is not None:
            rows = rows.where(F.col("symbol").isin(*symbols))
        if start is not None and self.date in rows.columns:
            rows = rows.where(F.col(self.date) >= F.lit(start).cast("date"))
        if end is not None and self.date in rows.columns:
            rows = rows.where(F.col(self.date) <= F.lit(end).cast("date"))
        return rows

    def read(self, symbols=None, start=None, end=None) -> DataFrame:
        """The current rows, of some symbols or of a closed date range if asked for."""
        return self._current(self._pruned(self.files(), symbols, start, end), symbols, start, end)

    def _current(self, files: DataFrame, symbols=None, start=None, end=None) -> DataFrame:
        found = {k: self._rows(files, k) for k in ("base", "delta", "gone")}
        found = {k: self._wanted(v, symbols, start, end) for k, v in found.items() if v is not None}
        columns = [c for c in found.get("base", found.get("delta", self._empty())).columns if c != VERSION]
        if "gone" in found:
            last = found["gone"].groupBy("symbol").agg(F.max(VERSION).alias("__gone"))
            for k in ("base", "delta"):
                if k in found:
                    found[k] = found[k].join(last, "symbol", "left").where(F.col("__gone").isNull() | (F.col(VERSION) >= F.col("__gone"))).drop("__gone")
        base = found["base"].select(*columns) if "base" in found else self._empty().select(*columns)
        if "delta" not in found:
            return base
        newest = dedupe(found["delta"], self.keys, VERSION, "last").select(*columns)
        return base.join(newest.select(*self.keys), list(self.keys), "left_anti").unionByName(newest)

    def _empty(self) -> DataFrame:
        """No rows, with the table's columns."""
        one = self._commits().where("kind in ('base', 'delta')").select("file").first()
        return self.spark.read.parquet(one[0]).limit(0)

    # --- metadata ------------------------------------------------------------------

    def state(self) -> DataFrame:
        """``symbol, record_count, last_date, last_close, last_sync`` as of the newest commit."""
        return self._state(self.files())

    def _state(self, files: DataFrame) -> DataFrame:
        return dedupe(self._rows(files, "meta"), ("symbol",), VERSION, "last")

    def _summed(self, rows: DataFrame, synced_at) -> DataFrame:
        return rows.groupBy("symbol").agg(
            F.count(F.lit(1)).alias("record_count"), F.max(self.date).alias("last_date"), F.max_by(self.close, self.date).alias("last_close")
        ).withColumn("last_sync", F.lit(synced_at).cast("timestamp"))

    # --- changes ------------------------------------------------------------------

    def _distinct(self, rows: DataFrame, seq: str | None) -> DataFrame:
        """One row per key, the last in ``seq``; without one, the last in the order of the rows."""
        if seq is None:
            rows, seq = rows.withColumn("__seq", F.monotonically_increasing_id()), "__seq"
        return dedupe(rows, self.keys, seq, "last")

    def _kept(self, rows: DataFrame, purpose: str) -> DataFrame:
        """A batch read back from the shared folder, since a commit passes over it several times."""
        path = f"{self.path}/batches/{purpose}-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.parquet(path)

    def create(self, rows: DataFrame, seq: str | None = None, synced_at=None) -> None:
        """The first commit."""
        rows = self._kept(self._distinct(rows, seq), "create")
        if rows.isEmpty():
            raise ValueError("a table starts with at least one row")
        self._commit(1, self._write(rows, "base", 1), self._write(self._summed(rows, synced_at), "meta", 1))

    def append(self, rows: DataFrame, seq: str | None = None, synced_at=None) -> int:
        """Add what is newer than the stored series of its symbol, the last copy of a key; returns the number of rows added.

        Reads the metadata, not the bars. A batch that comes again adds nothing and commits nothing.
        """
        version, files = self._next()
        before = self._state(files)
        last = before.select("symbol", F.col("last_date").alias("__last"))
        newer = self._distinct(rows, seq).join(last, "symbol", "left").where(F.col("__last").isNull() | (F.col(self.date) > F.col("__last"))).drop("__last")
        newer = self._kept(newer, "append")
        count = newer.count()
        if not count:
            return 0
        added = self._summed(newer, synced_at)
        old = before.select("symbol", F.col("record_count").alias("__count"))
        meta = added.join(old, "symbol", "left").withColumn("record_count", F.col("record_count") + F.coalesce("__count", F.lit(0))).drop("__count")
        self._commit(version, files, self._write(newer, "base", version, count), self._write(meta, "meta", version))
        return count

    def replace(self, rows: DataFrame, seq: str | None = None, synced_at=None) -> None:
        """Replace the whole series of every symbol in ``rows``."""
        version, files = self._next()
        rows = self._kept(self._distinct(rows, seq), "replace")
        if rows.isEmpty():
            return
        self._commit(version, files, self._write(rows, "delta", version), self._write(rows.select("symbol").distinct(), "gone", version),
                     self._write(self._summed(rows, synced_at), "meta", version))

    def merge(self, rows: DataFrame, seq: str | None = None, synced_at=None) -> None:
        """Insert or correct single keys; only the given rows are written."""
        version, files = self._next()
        rows = self._kept(self._distinct(rows, seq), "merge")
        if rows.isEmpty():
            return
        delta = self._write(rows, "delta", version)
        after = files.unionByName(delta.select(*files.columns))
        few = [r[0] for r in rows.select("symbol").distinct().limit(FEW + 1).collect()]
        if len(few) <= FEW:
            touched = self._current(self._pruned(after, few, None, None), few)
        else:
            touched = self._current(after).join(rows.select("symbol").distinct(), "symbol", "left_semi")
        self._commit(version, after, self._write(self._summed(touched, synced_at), "meta", version))

    def compact(self, small: int = 0) -> int:
        """Fold corrections into the base; returns the number of base files rewritten.

        Rewritten are base files that hold a corrected symbol, and those of fewer than ``small`` rows.
        """
        version, files = self._next()
        base, delta, gone = (self._rows(files, k) for k in ("base", "delta", "gone"))
        corrected = [d.select("symbol") for d in (delta, gone) if d is not None]
        listed = files.where("kind = 'base'")
        hit = listed.where(F.col("rows") < small).select("file")
        if corrected and base is not None:
            symbols = reduce(lambda a, b: a.union(b), corrected).distinct()
            holding = base.select("symbol", F.col("_metadata.file_path").alias("file")).join(symbols, "symbol", "left_semi")
            hit = hit.union(holding.select("file")).distinct()
        hit = self._kept(hit, "compact")
        rewritten = hit.count()
        if not rewritten and not corrected:
            return 0
        folded = files.where("kind <> 'base'").unionByName(listed.join(hit, "file", "left_semi"))
        fresh = self._write(self._current(folded), "base", version)
        meta = self._write(self._state(files), "meta", version)
        self._commit(version, listed.join(hit, "file", "left_anti"), fresh, meta)
        return rewritten

    def retain(self, days: int, as_of=None, synced_at=None) -> int:
        """Drop rows older than ``days`` before ``as_of``; whole files by the manifest alone. Returns how many files went whole."""
        self.compact()
        version, files = self._next()
        newest = as_of if as_of is not None else self.state().agg(F.max("last_date")).first()[0]
        limit = F.date_sub(F.lit(newest).cast("date"), days)
        base = files.where("kind = 'base'")
        old, whole = base.where(F.col("max_date") < limit), base.where(F.col("min_date") >= limit)
        straddling = base.where((F.col("max_date") >= limit) & (F.col("min_date") < limit))
        dropped = old.count()
        part = self._rows(straddling, "base")
        fresh = self._write(retain(part.drop(VERSION), days, F.lit(newest).cast("date"), self.date), "base", version) if part is not None else None
        left = whole if fresh is None else whole.unionByName(fresh.select(*whole.columns))
        sync = self._state(files).select("symbol", F.col("last_sync").alias("__sync"))
        summed = self._summed(self._current(left), synced_at).join(sync, "symbol", "left")
        meta = summed.withColumn("last_sync", F.coalesce("last_sync", "__sync")).drop("__sync")
        self._commit(version, left, self._write(meta, "meta", version))
        return dropped

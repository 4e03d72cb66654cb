"""A table with one row per key: hash buckets, a Bloom filter per bucket and commit, snapshots.

Layout of a store's folder::

    data/commit=<id>/bucket=<n>/*.parquet     rows, written once and never changed
    filters/commit=<id>/*.parquet             (bucket, pages, page, bits): Bloom filters, 32,768 bits a row
    manifest/<version>.json                   the commits that make up a version, with their rows

A reader takes the highest manifest that is whole, so a job that is killed leaves the old version
readable and nothing but unnamed folders behind. Writers claim the next version by creating its
manifest, which fails where the file is there already; the loser looks at the winner's rows and
tries again.

Inserting tests the new keys against the filters, which takes some ``BITS_PER_KEY`` bits per stored
key, and reads the key column of only those buckets of those commits where a filter hits. A key
that no filter hits is new for certain. Filters are built and tested by built-in bitmap functions.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmurlens.operators.skew import first_wins
from murmurlens.runtime import stage

BUCKETS, ROWS_PER_FILE = 64, 5_000_000
PAGE_BITS, BITS_PER_KEY, PROBES = 32_768, 16, 4
MERGE_FROM = 8


@dataclass(frozen=True)
class Snapshot:
    """A version: its commits, oldest first, as ``(id, rows)``."""

    version: int
    buckets: int
    commits: tuple[tuple[str, int], ...]

    @property
    def rows(self) -> int:
        return sum(rows for _, rows in self.commits)


@dataclass(frozen=True)
class Inserted:
    """What an insert did: distinct new keys offered and stored, and the (commit, bucket) parts that
    were read for it out of all there were."""

    snapshot: Snapshot
    offered: int
    stored: int
    parts_read: int
    parts: int


class KeyedStore:
    """``schema`` are the columns of a row, ``key`` the one that is unique. ``buckets`` counts for a store
    that is not there yet; some million rows per bucket are a good size."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.key, self._buckets = spark, path.rstrip("/"), schema, key, buckets
        self._jvm = spark.sparkContext._jvm
        root = self._file("")
        self._files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- manifest ------------------------------------------------------------------------------

    def _file(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        """Numbers of all manifests, unfinished ones included."""
        folder = self._file("manifest")
        if not self._files.exists(folder):
            return []
        names = [status.getPath().getName() for status in self._files.listStatus(folder)]
        return sorted(int(name[:-5]) for name in names if name.endswith(".json") and name[:-5].isdigit())

    def _manifest(self, version: int) -> Snapshot | None:
        stream = self._files.open(self._file(f"manifest/{version:010d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            found = json.loads(text)
        except ValueError:
            return None  # its writer was killed while it wrote
        return Snapshot(version, found["buckets"], tuple((name, rows) for name, rows in found["commits"]))

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The newest whole version, or the one asked for."""
        for number in reversed(self.versions() if version is None else [version]):
            found = self._manifest(number)
            if found is not None:
                return found
        if version is not None:
            raise ValueError(f"version {version} is not whole")
        return Snapshot(-1, self._buckets, ())

    def _switch(self, commits: list[tuple[str, int]], buckets: int, seen: Snapshot) -> Snapshot | None:
        """Make ``commits`` the version after all there are, unless one came after ``seen``."""
        if self.snapshot() != seen:
            return None
        version = max([*self.versions(), -1]) + 1
        target = self._file(f"manifest/{version:010d}.json")
        self._files.mkdirs(self._file("manifest"))
        try:
            stream = self._files.create(target, False)
        except Py4JJavaError as error:
            if "AlreadyExists" in error.java_exception.getClass().getName():
                return None
            raise
        stream.write(bytearray(json.dumps({"buckets": buckets, "commits": commits}).encode()))
        stream.close()
        return Snapshot(version, buckets, tuple(commits))

    # -- reading -------------------------------------------------------------------------------

    def _read(self, snapshot: Snapshot) -> DataFrame:
        """All rows with ``commit`` and ``bucket``, the folders that filters on them prune."""
        fields = T.StructType([*self.schema.fields, T.StructField("commit", T.StringType()), T.StructField("bucket", T.IntegerType())])
        if not snapshot.commits:
            return self.spark.createDataFrame([], fields)
        paths = [f"{self.path}/data/commit={name}" for name, _ in snapshot.commits]
        return self.spark.read.option("basePath", f"{self.path}/data").schema(fields).parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self.snapshot(version)).select(*self.schema.fieldNames())

    # -- filters -------------------------------------------------------------------------------

    def _filters(self, names: list[str]) -> DataFrame:
        paths = [f"{self.path}/filters/commit={name}" for name in names]
        fields = "bucket int, pages long, page long, bits binary, commit string"
        return self.spark.read.option("basePath", f"{self.path}/filters").schema(fields).parquet(*paths)

    def _probes(self, rows: DataFrame, *kept: str) -> DataFrame:
        """The ``PROBES`` bits of every key in a filter of ``pages`` pages."""
        at = [F.pmod(F.xxhash64(F.lit(n), F.col(self.key)), F.col("pages") * PAGE_BITS) for n in range(PROBES)]
        spread = rows.select(*kept, "pages", F.explode(F.array(*at)).alias("at"))
        return spread.select(*kept, "pages", F.floor(F.col("at") / PAGE_BITS).alias("page"), (F.col("at") % PAGE_BITS).alias("bit"))

    def _build_filters(self, rows: DataFrame, name: str) -> int:
        """Write the filters of a commit from its stored keys; returns its number of rows."""
        keys = rows.select(self.key, "bucket")
        sizes = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
        pages = sizes.select("bucket", "n", F.greatest(F.lit(1), F.ceil(F.col("n") * BITS_PER_KEY / PAGE_BITS)).cast("long").alias("pages"))
        pages = stage(pages, "bucket-sizes")
        bits = self._probes(keys.join(pages.drop("n"), "bucket"), "bucket").groupBy("bucket", "pages", "page")
        bits.agg(F.bitmap_construct_agg("bit").alias("bits")).write.parquet(f"{self.path}/filters/commit={name}")
        return pages.agg(F.sum("n")).first()[0] or 0

    def _hits(self, snapshot: Snapshot, rows: DataFrame) -> DataFrame:
        """``(key, commit, bucket)`` wherever all bits of a key are set: where it may be stored."""
        filters = self._filters([name for name, _ in snapshot.commits])
        heads = filters.select("commit", "bucket", "pages").distinct()  # one row per commit and bucket
        asked = self._probes(rows.select(self.key, "bucket").join(heads, "bucket"), self.key, "commit", "bucket")
        byte = F.expr("cast(conv(hex(substring(bits, cast(bit div 8 as int) + 1, 1)), 16, 10) as int)")
        set_ = asked.join(filters.drop("pages"), ["commit", "bucket", "page"]).filter(F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1)
        counted = set_.groupBy(self.key, "commit", "bucket").agg(F.count(F.lit(1)).alias("set"))
        return counted.filter(F.col("set") == PROBES).drop("set")

    # -- writing -------------------------------------------------------------------------------

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int")

    def _write(self, rows: DataFrame, most: int, buckets: int) -> tuple[str, int]:
        """Write a commit of at most ``most`` rows with their ``bucket``; returns its name and rows."""
        name = uuid.uuid4().hex
        files = -(-most // (buckets * ROWS_PER_FILE))
        dealt = rows.select(*self.schema.fieldNames(), "bucket").repartition("bucket", F.pmod(F.xxhash64(F.lit(-1), self.key), F.lit(max(1, files))))
        dealt.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/data/commit={name}")
        return name, self._build_filters(self._read(Snapshot(-1, buckets, ((name, 0),))), name) if most else 0

    def _known(self, snapshot: Snapshot, rows: DataFrame) -> tuple[DataFrame, int]:
        """Keys of ``rows`` that are stored, and the number of parts that had to be read."""
        hits = stage(self._hits(snapshot, rows), "filter-hits")
        # At most a row per commit and bucket.
        parts: dict[str, list[int]] = {}
        for row in hits.select("commit", "bucket").distinct().collect():
            parts.setdefault(row["commit"], []).append(row["bucket"])
        wanted = F.lit(False)
        for commit, buckets in parts.items():
            wanted = wanted | ((F.col("commit") == commit) & F.col("bucket").isin(buckets))
        stored = self._read(snapshot).filter(wanted).select(self.key, "commit", "bucket")
        known = hits.join(stored, [self.key, "commit", "bucket"], "left_semi").select(self.key)
        return known, sum(map(len, parts.values()))

    def absent(self, rows: DataFrame) -> tuple[DataFrame, int]:
        """The ``rows`` whose key is not stored, and the number of parts that were read to know."""
        seen = self.snapshot()
        if not seen.commits:
            return rows, 0
        known, read = self._known(seen, rows.withColumn("bucket", self._bucket(seen.buckets)))
        return rows.join(known, self.key, "left_anti"), read

    def replace(self, rows: DataFrame) -> Snapshot:
        """A new version of these rows alone, keys taken as unique. Older versions stay until
        :meth:`vacuum`, so ``rows`` may read from the store itself."""
        while True:
            seen = self.snapshot()
            named = rows.withColumn("bucket", self._bucket(self._buckets))
            name, count = self._write(named, max(1, rows.count()), self._buckets)
            done = self._switch([(name, count)] if count else [], self._buckets, seen)
            if done is not None:
                return done

    def insert(self, incoming: DataFrame, position: str) -> Inserted:
        """Insert or ignore: of rows with one key the one with the smallest ``position`` is stored, unless
        the key is. Rows without a key are all stored. Nothing new makes no new version."""
        unique = stage(first_wins(incoming, self.key, position).select(*self.schema.fieldNames()), "offered", compression="zstd")
        offered = unique.count()
        while True:
            seen = self.snapshot()
            named = unique.withColumn("bucket", self._bucket(seen.buckets))
            fresh, read = named, 0
            if seen.commits:
                known, read = self._known(seen, named)
                fresh = named.join(known, self.key, "left_anti")
            parts = seen.buckets * len(seen.commits)
            name, count = self._write(fresh, offered, seen.buckets) if offered else ("", 0)
            if not count:
                return Inserted(seen, offered, 0, read, parts)
            done = self._switch([*seen.commits, (name, count)], seen.buckets, seen)
            if done is not None:
                return Inserted(done, offered, count, read, parts)

    def merge_commits(self, most: int = MERGE_FROM) -> Snapshot:
        """Rewrite the commits after the largest one as a single one, where there are more than ``most``;
        all of them once those after it have half its rows. Keeps the filters to test few."""
        while True:
            seen = self.snapshot()
            if len(seen.commits) <= most:
                return seen
            largest = max(range(len(seen.commits)), key=lambda i: seen.commits[i][1])
            rest = [c for i, c in enumerate(seen.commits) if i != largest]
            if 2 * sum(rows for _, rows in rest) >= seen.commits[largest][1]:
                rest = list(seen.commits)
            kept = [c for c in seen.commits if c not in rest]
            part = Snapshot(seen.version, seen.buckets, tuple(rest))
            name, count = self._write(self._read(part).drop("commit"), part.rows, seen.buckets)
            done = self._switch([*kept, (name, count)], seen.buckets, seen)
            if done is not None:
                return done

    def vacuum(self, keep: int = 1) -> None:
        """Forget all but the newest ``keep`` whole versions and delete what none of them names. Run it
        while nobody writes or reads an older version."""
        whole = [s for s in map(self._manifest, self.versions()) if s is not None]
        kept = whole[-keep:]
        named = {name for s in kept for name, _ in s.commits}
        for number in self.versions():
            if number not in {s.version for s in kept}:
                self._files.delete(self._file(f"manifest/{number:010d}.json"), False)
        for folder in ("data", "filters"):
            if self._files.exists(self._file(folder)):
                for status in self._files.listStatus(self._file(folder)):
                    if status.getPath().getName().removeprefix("commit=") not in named:
                        self._files.delete(status.getPath(), True)

"""Numbered snapshots of an index, on any file system that Spark reaches.

A table is cut into `BUCKETS` by the hash of its key. A snapshot is one small
file that names, for every bucket of every table, the folder it lies in, with a
count and two hash sums of its rows, and the log files that are folded in. A new
snapshot writes the buckets whose rows changed and names the old folders for
the rest; it counts from the moment its file is there, which is created last
and at once, so readers see the old tables or the new ones and a failed run
leaves the old ones. Two writers can't both create one number. The last `KEEP`
snapshots, and the folders they name, are kept for readers that are still at work.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
KEEP = 2
#: Key column of each table; its buckets are cut by it.
KEYS = {"symbols": "symbol_id", "edges": "symbol_id", "tag_index": "tag", "aliases": "raw", "categories": "tag", "meta": "rel_path", "extracted": "rel_path"}


@dataclass
class Snapshot:
    """What a snapshot's file says."""

    number: int = 0
    version: int = 1
    schemas: dict[str, dict] = field(default_factory=dict)
    #: table, bucket: (folder, rows, sum, xor)
    parts: dict[str, dict[str, list]] = field(default_factory=dict)
    folded: dict[str, list[str]] = field(default_factory=dict)


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        path = self._path("")
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def numbers(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.names("snapshots") if n.endswith(".json")]

    def snapshot(self, number: int | None = None) -> Snapshot | None:
        """A snapshot by its number, the newest by default; None where there is none."""
        known = self.numbers()
        if not known:
            return None
        stream = self.fs.open(self._path(f"snapshots/{max(known) if number is None else number:010d}.json"))
        try:
            return Snapshot(**json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def read(self, snapshot: Snapshot, table: str, buckets: Sequence[int] | None = None) -> DataFrame:
        """The rows of a table, or of some of its buckets."""
        schema = StructType.fromJson(snapshot.schemas[table])
        folders = [p[0] for b, p in snapshot.parts[table].items() if buckets is None or int(b) in set(buckets)]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{f}" for f in folders))

    def next(self, before: Snapshot | None, version: int) -> Draft:
        return Draft(self, before or Snapshot(), version)

    def sweep(self) -> None:
        """Delete what no kept snapshot names."""
        kept = sorted(self.numbers())[-KEEP:]
        named = {p[0] for n in kept for parts in self.snapshot(n).parts.values() for p in parts.values()}
        roots = {f.rpartition("/")[0] for f in named}
        for n in self.numbers():
            if n not in kept:
                self.fs.delete(self._path(f"snapshots/{n:010d}.json"), False)
        for run in self.names("data"):
            for table in self.names(f"data/{run}"):
                folder = f"data/{run}/{table}"
                if folder not in roots:
                    self.fs.delete(self._path(folder), True)
                    continue
                for bucket in self.names(folder):
                    if bucket.startswith("bucket=") and f"{folder}/{bucket}" not in named:
                        self.fs.delete(self._path(f"{folder}/{bucket}"), True)
            if not self.names(f"data/{run}"):
                self.fs.delete(self._path(f"data/{run}"), True)


def bucket_of(column: str):
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int")


def row_hash(df: DataFrame):
    """A hash of all columns that tells nulls from other values and their places."""
    return F.xxhash64(*[x for c in df.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())])


class Draft:
    """A snapshot that is being written."""

    def __init__(self, store: Store, before: Snapshot, version: int) -> None:
        self.store, self.before = store, before
        self.now = Snapshot(before.number + 1, version, dict(before.schemas), {t: dict(p) for t, p in before.parts.items()}, {k: list(v) for k, v in before.folded.items()})
        self.folder = f"data/{self.now.number:010d}"

    def put(self, table: str, df: DataFrame, buckets: Sequence[int] | None = None) -> list[int]:
        """Take df as the new rows of a table, or of some of its buckets; the buckets that had to be written are returned.

        df is read twice, for the sums and for the write, so it should be a written table or cheap to make.
        """
        rows = df.withColumn("bucket", bucket_of(KEYS[table]))
        if buckets is not None:
            rows = rows.filter(F.col("bucket").isin([int(b) for b in buckets]))
        h = row_hash(df)
        sums = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("total"), F.bit_xor(h).alias("x")).collect()  # BUCKETS rows
        held = self.now.parts.get(table, {}) if self.now.schemas.get(table) == df.schema.jsonValue() else {}
        parts = {b: p for b, p in held.items() if buckets is not None and int(b) not in set(buckets)}
        stale = []
        for r in sums:
            old = held.get(str(r.bucket))
            if old and old[1:] == [r.n, r.total, str(r.x)]:
                parts[str(r.bucket)] = old
            else:
                stale.append(r.bucket)
                parts[str(r.bucket)] = [f"{self.folder}/{table}/bucket={r.bucket}", r.n, r.total, str(r.x)]
        if stale:
            order = [c for c in ("tag_type", KEYS[table]) if c in df.columns]
            chosen = rows.filter(F.col("bucket").isin(stale)).repartition("bucket").sortWithinPartitions("bucket", *order)
            chosen.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.store.root}/{self.folder}/{table}")
        self.now.parts[table], self.now.schemas[table] = parts, df.schema.jsonValue()
        return sorted(stale)

    def commit(self, folded: dict[str, list[str]] | None = None) -> Snapshot:
        """Create the snapshot's file; an error if another writer did so first."""
        self.now.folded.update(folded or {})
        stream = self.store.fs.create(self.store._path(f"snapshots/{self.now.number:010d}.json"), False)
        try:
            stream.write(bytearray(json.dumps(self.now.__dict__).encode()))
        finally:
            stream.close()
        self.store.sweep()
        return self.now


def new_rows(log: DataFrame, folded: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The rows of a log (a DataFrame over files) in files that aren't folded yet, and all its files by name."""
    spark = log.sparkSession
    where = F.col("_metadata.file_path")
    names = sorted(r.f for r in log.select(where.alias("f")).distinct().collect())
    fresh = [n for n in names if n not in set(folded)]
    if len(fresh) == len(names):
        return log, names
    known = spark.createDataFrame([(n,) for n in fresh], "__file string")
    return log.withColumn("__file", where).join(known, "__file", "left_semi").drop("__file"), names


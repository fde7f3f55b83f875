"""What the operators of this subpackage share: written intermediate tables and Arrow helpers."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_open: list[list[str]] = []  # tables of the scopes that are open, the innermost last
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(sf_dir: str, name: str, spark: SparkSession) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _drop(path: str) -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session is going down; the folder is a scratch folder
            return


def scratch_dir(spark: SparkSession) -> str:
    """A folder of this run below spark.checkpoint.dir.

    Where that is unset, a temporary folder is taken with a local master, as in tests; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = _own.setdefault("root", tempfile.mkdtemp(prefix="tagweave-"))
    if root not in _own:
        _own[root] = f"{root.rstrip('/')}/tagweave-{uuid.uuid4().hex}"
        atexit.register(_drop, _own[root])
    return _own[root]


def stored(df: DataFrame) -> DataFrame:
    """Write `df` to the scratch folder and read it back: later steps reuse it and lost executors lose nothing.

    Shuffle files of the write go when it is done, since the table stands for them from then on.
    """
    spark = df.sparkSession
    path, was = f"{scratch_dir(spark)}/{uuid.uuid4().hex}", spark.conf.get(_SHUFFLE_CLEANUP, "false")
    if _open:
        _open[-1].append(path)
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_SHUFFLE_CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that `stored` writes inside are deleted at the end; what is to be used after it goes through the function given, which writes it.

    `with scratch() as kept: ... return kept(result)`
    """
    own: list[str] = []
    _open.append(own)

    def kept(df: DataFrame) -> DataFrame:
        inner = _open.pop()
        try:
            return stored(df)  # belongs to the scope around this one, if there is one
        finally:
            _open.append(inner)

    try:
        yield kept
    finally:
        _open.pop()
        for path in own:
            _drop(path)


def text_key(text: Column) -> Column:
    """Identity of a text: two hashes and its length; a null is the empty text."""
    body = F.coalesce(text, F.lit(""))
    return F.concat_ws("-", F.xxhash64(body), F.crc32(body.cast("binary")), F.octet_length(body))


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop columns that an operator is about to add; its own columns win over clashing ones."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def _return_memory() -> None:
    """Give what this Python worker has freed back to the system: workers are reused, and idle ones would keep their peak."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # of the GNU C library
        trim(0)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            _return_memory()

    return df.mapInArrow(run, schema)

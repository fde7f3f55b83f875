"""Source trees as tables.

Paths are listed on the driver, because Spark's own file sources skip names
that start with `_` or `.`; contents are read by the executors.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extract.registry import EXTENSIONS
from ..functions import text as X
from .ignore import is_ignored

READ_CHARS = 8_000_000  # characters of the files that are read into one batch, but one file at least
INDEX_DIRS = (".ai_context", "llm_index")


def ignore_rules(root: str, extra: Sequence[str] = ()) -> list[str]:
    """Lines of .gitignore, if there is one, and the caller's patterns."""
    path = os.path.join(root, ".gitignore")
    lines = []
    if os.path.exists(path):
        with open(path, encoding="utf-8", errors="replace") as f:
            lines = f.read().splitlines()
    return lines + [e.strip() for e in extra if e.strip()]


def list_files(root: str, extensions: Sequence[str] | None = None, extra_ignore: Sequence[str] = ()) -> list[str]:
    """Sorted relative paths with one of the extensions, without hidden entries and ignored paths."""
    wanted = set(EXTENSIONS if extensions is None else extensions)
    rules = ignore_rules(root, extra_ignore)
    found = []
    for folder, dirs, names in os.walk(root):
        rel = os.path.relpath(folder, root).replace(os.sep, "/")
        lead = "" if rel == "." else f"{rel}/"
        dirs[:] = sorted(d for d in dirs if not d.startswith(".") and not is_ignored(f"{lead}{d}/", rules))
        found += [f"{lead}{n}" for n in names if not n.startswith(".") and n.rpartition(".")[2].lower() in wanted and "." in n and not is_ignored(f"{lead}{n}", rules)]
    return sorted(found)


def scanner(extensions: Sequence[str]):
    """A lister for some extensions."""
    return lambda root, extra_ignore=(): list_files(root, extensions, extra_ignore)


def read_files(spark: SparkSession, root: str, paths: Sequence[str]) -> DataFrame:
    """(rel_path, ext, lang, content, hash, scan_seq); the root must be visible to the executors. A file that can't be read has null content."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, size, begin = [], 0, 0
            for i, p in enumerate(batch.rel_path):
                try:
                    with open(os.path.join(root, p), encoding="utf-8", errors="replace") as f:
                        texts.append(f.read())
                except OSError:
                    texts.append(None)
                size += len(texts[-1] or "")
                if size > READ_CHARS or i + 1 == len(batch):
                    yield batch.iloc[begin : i + 1].assign(content=texts)
                    texts, size, begin = [], 0, i + 1

    n = max(1, min(len(paths), spark.sparkContext.defaultParallelism * 4))
    listed = spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "rel_path string, scan_seq long").repartition(n)
    rows = listed.mapInPandas(load, "rel_path string, scan_seq long, content string")
    lang = F.element_at(F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair]), X.extension_of(F.col("rel_path")))
    return rows.select("rel_path", X.extension_of(F.col("rel_path")).alias("ext"), lang.alias("lang"), "content", X.file_hash(F.col("content")).alias("hash"), "scan_seq")


def index_root(root: str) -> str:
    """The first existing index folder of a project, else the default one."""
    return next((os.path.join(root, d) for d in INDEX_DIRS if os.access(os.path.join(root, d), os.R_OK)), os.path.join(root, INDEX_DIRS[0]))


def markdown_docs(spark: SparkSession, root: str) -> DataFrame:
    return read_files(spark, root, list_files(root, ["md"])).select(F.col("rel_path").alias("path"), "content", "scan_seq")

"""Deduplication, merging of declarations, change detection and reuse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dedup_candidates(rows: DataFrame, key: str = "symbol_key", *seq: str) -> DataFrame:
    """One row for each key: least priority, then deepest qualification, then first seen."""
    order = [F.col("priority"), F.desc("qualifier_depth"), *(seq or ("scan_seq",))]
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter("__r = 1").drop("__r")


def first_of(rows: DataFrame, key: str, seq: str, *ties: str) -> DataFrame:
    """The row of each key with the least seq; of several such rows the first by `ties`, so that the choice is open only without them."""
    order = W.partitionBy(key).orderBy(F.asc_nulls_last(seq), *ties)
    return rows.withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r")


def last_of(rows: DataFrame, key: str, seq: str, *ties: str) -> DataFrame:
    """The last row of each key at the place of the first; of several rows with the largest seq the first by `ties`."""
    w = W.partitionBy(key)
    return rows.withColumn("__r", F.row_number().over(w.orderBy(F.desc(seq), *ties))).withColumn(seq, F.min(seq).over(w)).filter("__r = 1").drop("__r")


def changed_files(now: DataFrame, before: DataFrame, path: str = "rel_path") -> DataFrame:
    """(rel_path, change): added, changed or deleted, by content hash."""
    both = now.select(path, F.col("hash").alias("__now")).join(before.select(path, F.col("hash").alias("__was")), path, "full")
    kind = F.when(F.col("__was").isNull(), "added").when(F.col("__now").isNull(), "deleted").otherwise("changed")
    return both.filter(~F.col("__now").eqNullSafe(F.col("__was"))).select(F.col(path).alias("rel_path"), kind.alias("change"))


def split_reuse(candidates: DataFrame, previous: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """candidates with `reuse`: an unchanged declaration, in an unchanged file or with an unchanged body.

    Rows whose brief came from a fallback (brief_status) are worked on again.
    """
    prev = previous.select("symbol_id", F.col("decl_hash").alias("__decl"), F.col("impl_hash").alias("__impl"), *([F.col("brief_status").alias("__status")] if "brief_status" in previous.columns else [F.lit("done").alias("__status")]))
    out = candidates.join(prev, "symbol_id", "left")
    if changed is None:
        touched = F.lit(True)
    else:
        out = out.join(changed.select(F.col("rel_path").alias("file_path"), F.lit(True).alias("__touched")).distinct(), "file_path", "left")
        touched = F.coalesce("__touched", F.lit(False))
    reuse = (F.col("decl_hash") == F.col("__decl")) & (~touched | F.col("impl_hash").eqNullSafe(F.col("__impl"))) & (F.col("__status") != "fallback")
    return out.withColumn("reuse", F.coalesce(reuse, F.lit(False))).drop("__decl", "__impl", "__status", "__touched")


def merge_declarations(rows: DataFrame) -> DataFrame:
    """One row for each (module, raw_id): first known lines; the signature of the first row with a declaration line."""
    first = lambda c, cond=None: F.min_by(c, F.when(F.col(c).isNotNull() if cond is None else cond, F.col("seq"))).alias(c)
    return rows.groupBy("module", "raw_id").agg(first("decl_line"), first("impl_line"), F.coalesce(F.min_by("signature", F.when(F.col("decl_line").isNotNull(), F.col("seq"))), F.min_by("signature", "seq")).alias("signature"))


def impacted_modules(symbols: DataFrame, changed: DataFrame) -> DataFrame:
    return symbols.join(changed.select(F.col("rel_path").alias("file_path")), "file_path", "left_semi").select("module").distinct()

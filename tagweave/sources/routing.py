"""JSON documents of the index: read into tables, migrated, and written back."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import tags as T
from ..schema import ALIASES, CATEGORIES, FILE_META, META, ROUTING, ROUTING_FLAT, SCHEMA_VERSION, SYMBOL_TAGS, SYMBOLS, TAG_INDEX, TAG_TYPES
from .store import Store


@dataclass
class Index:
    """The tables of one index."""

    symbols: DataFrame
    edges: DataFrame
    tag_index: DataFrame
    aliases: DataFrame
    categories: DataFrame
    version: int = 1


def empty_index(spark: SparkSession) -> Index:
    return Index(*(spark.createDataFrame([], s) for s in (SYMBOLS, SYMBOL_TAGS, TAG_INDEX, ALIASES, CATEGORIES)))


def _document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def load_routing(spark: SparkSession, path: str) -> Index:
    """Tables of a routing document. A missing file is an empty index; versions above the known one are an error.

    Documents before version 4 are migrated: flat scores are carried to every type that has the tag, legacy
    arrays give the types of edges, and counts are taken anew. Unified `tags` of a symbol get the type that the
    tag index has for them (base, semantic, custom), semantic by default.
    """
    try:
        doc = _document(spark, path).first()
    except Exception as e:  # Spark reports a missing path as an analysis error
        if "PATH_NOT_FOUND" in str(e):
            return empty_index(spark)
        raise
    if doc is None:
        return empty_index(spark)
    raw = _document(spark, path).select(F.from_json("value", ROUTING).alias("d"), F.from_json("value", ROUTING_FLAT).alias("f"), F.get_json_object("value", "$.tagIndex.base").isNull().alias("flat"))
    head = raw.select(F.coalesce("d.schemaVersion", F.lit(1)).alias("v"), "flat", F.coalesce("d.tagMetadata.version", F.lit(1)).alias("m")).first()
    if head.v > SCHEMA_VERSION:
        raise ValueError(f"schema version {head.v} is newer than {SCHEMA_VERSION}")
    rows = raw.select(F.posexplode(F.map_entries(F.coalesce("d.symbols", "f.symbols"))).alias("seq", "e")).select("seq", F.col("e.key").alias("symbol_id"), "e.value.*")
    symbols = rows.select(
        "symbol_id", "module", F.when(F.col("signature").rlike(r"\b(class|struct|interface|enum|trait|module)\b"), "class").otherwise("function").alias("kind"), "signature", F.col("declHash").alias("decl_hash"), F.col("implHash").alias("impl_hash"),
        F.col("filePath").alias("file_path"), F.col("declLine").alias("decl_line"), F.col("implLine").alias("impl_line"), "brief", F.col("seq").cast("long").alias("seq"),
    )
    scores = None
    if not head.flat:
        parts = [raw.select(F.explode_outer(F.col(f"d.tagIndex.{t}")).alias("tag", "x")).filter("tag is not null").select(F.lit(t).alias("tag_type"), "tag", F.coalesce("x.count", F.lit(0)).alias("count"), F.coalesce("x.score", F.lit(0)).alias("score")) for t in TAG_TYPES]
        scores = parts[0].unionByName(parts[1]).unionByName(parts[2])
    legacy = rows.select("symbol_id", *[F.coalesce(c, X.strings()).alias(c) for c in ("tags", "tagsBase", "tagsSemantic", "tagsCustom")])
    typed = T.edges_of(legacy, base="tagsBase", semantic="tagsSemantic", custom="tagsCustom")
    plain = legacy.filter("size(tags) > 0 and size(tagsBase) + size(tagsSemantic) + size(tagsCustom) = 0").select("symbol_id", F.posexplode("tags").alias("pos", "tag"))
    kinds = T.type_of_tags(scores) if scores is not None else spark.createDataFrame([], "tag string, tag_type string")
    plain = plain.join(kinds, "tag", "left").select("symbol_id", "tag", F.coalesce("tag_type", F.lit("semantic")).alias("tag_type"), "pos")
    edges = typed.unionByName(plain).withColumn("tag", X.clean_tag(F.col("tag"))).filter("tag <> ''").dropDuplicates(["symbol_id", "tag", "tag_type"])
    if head.v < SCHEMA_VERSION or scores is None:
        flat = raw.select(F.explode_outer("f.tagIndex").alias("tag", "x")).filter("tag is not null").select("tag", F.coalesce("x.score", F.lit(0)).alias("score")) if head.flat else scores.groupBy("tag").agg(F.max("score").alias("score"))
        tag_index = T.index_counts(edges).join(flat, "tag", "left").select("tag_type", "tag", "count", F.coalesce("score", F.lit(0)).alias("score"))
    else:
        tag_index = scores
    aliases = raw.select(F.explode_outer("d.tagMetadata.aliases").alias("raw", "canonical")).filter("raw is not null")
    categories = raw.select(F.explode_outer("d.tagMetadata.categories").alias("tag", "x")).filter("tag is not null").select("tag", F.coalesce("x.count", F.lit(0)).alias("count"))
    return Index(symbols, edges, tag_index, aliases, categories, head.m)


def routing_json(index: Index) -> str:
    """The whole index as one JSON document, for tools that read that; it must fit the driver, as the format implies."""
    tags = index.edges.groupBy("symbol_id").agg(F.array_sort(F.collect_list(F.struct(F.expr(T.TYPE_RANK).alias("r"), "pos", "tag"))).alias("t")).select("symbol_id", F.array_distinct(F.col("t.tag")).alias("tags"))
    body = F.struct("module", F.col("decl_hash").alias("declHash"), F.col("impl_hash").alias("implHash"), F.col("decl_line").alias("declLine"), F.col("impl_line").alias("implLine"), F.col("file_path").alias("filePath"), "signature", "brief", F.coalesce("tags", X.strings()).alias("tags"))
    rows = index.symbols.join(tags, "symbol_id", "left").select("seq", "symbol_id", F.to_json(body).alias("body")).orderBy("seq")
    doc = {"schemaVersion": SCHEMA_VERSION, "tagIndex": {t: {} for t in TAG_TYPES}, "tagMetadata": {"aliases": {}, "categories": {}, "version": index.version}, "symbols": {r.symbol_id: json.loads(r.body) for r in rows.toLocalIterator()}}
    for r in index.tag_index.orderBy("tag_type", "tag").toLocalIterator():
        doc["tagIndex"][r.tag_type][r.tag] = {"count": r["count"], "score": r.score}
    doc["tagMetadata"]["aliases"] = {r.raw: r.canonical for r in index.aliases.orderBy("raw").toLocalIterator()}
    doc["tagMetadata"]["categories"] = {r.tag: {"count": r["count"]} for r in index.categories.orderBy("tag").toLocalIterator()}
    return json.dumps(doc, ensure_ascii=False, indent=2)


def save_routing(index: Index, path: str) -> None:
    """Write the document next to its place, then rename it."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        f.write(routing_json(index))
    os.replace(f"{path}.tmp", path)


TABLES = ("symbols", "edges", "tag_index", "aliases", "categories")


def save_tables(index: Index, path: str) -> None:
    """The index as Parquet tables; edges by tag type, so that a search on one type reads that alone."""
    for name in TABLES:
        writer = getattr(index, name).write.mode("overwrite")
        (writer.partitionBy("tag_type") if name in ("edges", "tag_index") else writer).parquet(f"{path}/{name}")


def load_tables(spark: SparkSession, path: str) -> Index:
    """The tables that `save_tables` wrote to `path`, or those of the newest snapshot of an index (its folder, or `tables` below it)."""
    for root in (path, path.rstrip("/").removesuffix("/tables")):
        store = Store(spark, root)
        now = store.snapshot()
        if now is not None:
            return Index(*(store.read(now, name) for name in TABLES), now.version)
    return Index(*(spark.read.parquet(f"{path}/{name}") for name in TABLES))


def load_meta(spark: SparkSession, path: str) -> DataFrame:
    """(rel_path, hash, skill_doc, last_updated) of a change cache; empty if there is none."""
    if not os.path.exists(path):
        return spark.createDataFrame([], FILE_META)
    rows = _document(spark, path).select(F.explode(F.from_json("value", META)).alias("rel_path", "m"))
    return rows.select("rel_path", F.col("m.hash").alias("hash"), F.col("m.skillDoc").alias("skill_doc"), F.col("m.lastUpdated").alias("last_updated"))


def build_meta(files: DataFrame) -> DataFrame:
    return files.select("rel_path", "hash", F.lit("").alias("skill_doc"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("last_updated"))


def save_meta(meta: DataFrame, path: str) -> None:
    doc = {r.rel_path: {"hash": r.hash, "skillDoc": r.skill_doc, "lastUpdated": r.last_updated} for r in meta.orderBy("rel_path").toLocalIterator()}
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(doc, f, ensure_ascii=False, indent=2)

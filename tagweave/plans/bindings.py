"""How the driver's tables stand for symbols, tags, files and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import tags as T

COLOURS = ("blue", "new", "cold", "red", "large", "small", "hot", "old")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as symbols: words of the name are base tags, the type is the semantic tag."""
    part = read(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("symbol_id"),
        F.col("p_brand").alias("module"),
        F.concat(F.col("p_brand"), F.lit("/"), F.col("p_type")).alias("file_path"),
        F.col("p_name").alias("signature"),
        F.concat_ws(" ", "p_name", "p_type").alias("brief"),
        F.col("p_brand").alias("hint"),
        F.split(F.lower("p_name"), " ").alias("base"),
        F.array(F.lower("p_type")).alias("semantic"),
        X.strings().alias("custom"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.edges_of(symbols(spark, sf_dir), base="base", semantic="semantic")


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of tags that were asked for: the user picks the colour."""
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.element_at(X.strings(*COLOURS), (F.col("user_id") % 8 + 1).cast("int")).alias("tag"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct lower-case ASCII words of all documents, as tags."""
    docs = read(spark, sf_dir, "documents")
    return docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z0-9_\-]+)"), F.lit(1))).alias("tag")).distinct()


def files_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("rel_path"), X.file_hash(F.coalesce("text", F.lit(""))).alias("hash"), "doc_id")


def files_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier state: every tenth file wasn't there, every seventh had other content, and one file is gone since."""
    now = files_now(spark, sf_dir)
    then = now.filter("doc_id % 10 <> 0").withColumn("hash", F.when(F.col("doc_id") % 7 == 0, F.sha1(F.lit("old"))).otherwise(F.col("hash")))
    return then.unionByName(spark.createDataFrame([("gone/1", "0", -1)], "rel_path string, hash string, doc_id long"))

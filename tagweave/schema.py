"""Schemas of the engine's tables; JSON documents are read with them, never by inference."""

from __future__ import annotations

from pyspark.sql import types as T

FILES = "rel_path string, ext string, lang string, content string, hash string, scan_seq long"
SYMBOLS = "symbol_id string, module string, kind string, signature string, decl_hash string, impl_hash string, file_path string, decl_line int, impl_line int, brief string, seq long"
SYMBOL_TAGS = "symbol_id string, tag string, tag_type string, pos int"
TAG_INDEX = "tag_type string, tag string, count long, score long"
ALIASES = "raw string, canonical string"
CATEGORIES = "tag string, count long"
FILE_META = "rel_path string, hash string, skill_doc string, last_updated string"
USAGE_LOG = "seq long, tag string"
EDIT_LOG = "seq long, symbol_id string, op string, value string, tag_type string"

TAG_TYPES = ("base", "semantic", "custom")
SCHEMA_VERSION = 4

_TAG = T.StructType([T.StructField("count", T.LongType()), T.StructField("score", T.LongType())])
_TAGS = T.MapType(T.StringType(), _TAG)
_SYMBOL = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("module", "declHash", "implHash")]
    + [T.StructField(n, T.IntegerType()) for n in ("declLine", "implLine")]
    + [T.StructField(n, T.StringType()) for n in ("filePath", "signature", "brief")]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("tags", "tagsBase", "tagsSemantic", "tagsCustom")]
)
#: Categorised routing document; the flat tag index of old documents is read with ROUTING_FLAT.
ROUTING = T.StructType(
    [
        T.StructField("schemaVersion", T.IntegerType()),
        T.StructField("tagIndex", T.StructType([T.StructField(t, _TAGS) for t in TAG_TYPES])),
        T.StructField("tagMetadata", T.StructType([T.StructField("aliases", T.MapType(T.StringType(), T.StringType())), T.StructField("categories", T.MapType(T.StringType(), T.StructType([T.StructField("count", T.LongType())]))), T.StructField("version", T.IntegerType())])),
        T.StructField("symbols", T.MapType(T.StringType(), _SYMBOL)),
    ]
)
ROUTING_FLAT = T.StructType([T.StructField("schemaVersion", T.IntegerType()), T.StructField("tagIndex", _TAGS), T.StructField("symbols", T.MapType(T.StringType(), _SYMBOL))])
META = T.MapType(T.StringType(), T.StructType([T.StructField(n, T.StringType()) for n in ("hash", "skillDoc", "lastUpdated")]))

"""Markdown module documents: parsed into rows and rendered from them, with native expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

ENTRY = r"^- `(.+)` <!-- id: (.+?) \| hash: ([0-9a-f]+)(?: \| impl: ([0-9a-f]+))?(?: \| file: (.+?))?(?: \| tags_base: \[(.*?)\])?(?: \| tags_sem: \[(.*?)\])? -->\s*$"


def parse_entries(docs: DataFrame, brief: str = "last") -> DataFrame:
    """(path, pos, section, signature, id, hash, impl, file, tags_base, tags_sem, brief) of docs (path, content).

    The brief is the last (or first) non-blank line before the next entry or heading.
    """
    packed = docs.select("path", F.split("content", r"\r?\n").alias("lines"))
    entry = F.col("line").rlike(ENTRY)
    numbered = packed.select("path", "lines", F.posexplode("lines").alias("pos", "line")).filter(entry)
    rest = F.slice("lines", F.col("pos") + 2, F.greatest(F.size("lines") - F.col("pos") - 1, F.lit(0)))
    stop = F.array_position(F.transform(rest, lambda x: x.rlike(r"^- `.*<!-- id:|^##? ")), F.lit(True)).cast("int")
    own = F.filter(F.when(stop > 0, F.slice(rest, F.lit(1), stop - 1)).otherwise(rest), lambda x: F.trim(x) != "")
    before = F.filter(F.slice("lines", F.lit(1), F.col("pos") + 1), lambda x: x.rlike("^## "))
    group = lambda i: F.regexp_extract("line", ENTRY, i)
    listed = lambda i: F.filter(F.transform(F.split(group(i), ","), lambda t: F.trim(t)), lambda t: t != "")
    return numbered.select(
        "path", "pos", F.regexp_replace(F.coalesce(F.try_element_at(before, F.lit(-1)), F.lit("")), "^## ", "").alias("section"), group(1).alias("signature"), group(2).alias("id"), group(3).alias("hash"),
        F.nullif(group(4), F.lit("")).alias("impl"), F.nullif(group(5), F.lit("")).alias("file"), listed(6).alias("tags_base"), listed(7).alias("tags_sem"),
        F.trim(F.coalesce(F.try_element_at(own, F.lit(-1 if brief == "last" else 1)), F.lit(""))).alias("brief"),
    )


def render_modules(symbols: DataFrame) -> DataFrame:
    """(module, content): one document for each module, entries by signature in dictionary order."""
    tags = lambda c: F.array_join(F.coalesce(c, X.strings()), ", ")
    line = F.concat(
        F.lit("- `"), "signature", F.lit("` <!-- id: "), "symbol_id", F.lit(" | hash: "), "decl_hash", F.when(F.col("impl_hash").isNotNull(), F.concat(F.lit(" | impl: "), "impl_hash")).otherwise(""), F.when(F.col("file_path").isNotNull(), F.concat(F.lit(" | file: "), "file_path")).otherwise(""),
        F.lit(" | tags_base: ["), tags("base"), F.lit("] | tags_sem: ["), tags("semantic"), F.lit("] -->\n  "), F.coalesce("brief", F.lit("")),
    )
    entry = F.struct(F.collate("signature", "UNICODE").alias("k"), line.alias("line"))
    part = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, entry))), lambda x: x.line), "\n")
    docs = symbols.groupBy("module").agg(part("function").alias("f"), part("class").alias("c"))
    return docs.select("module", F.concat(F.lit("# "), X.title_from_id(F.col("module")), F.lit("\n\n## Functions\n"), "f", F.lit("\n\n## Classes\n"), "c", F.lit("\n")).alias("content"))


def merge_entries(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fresh entries (id, hash, signature, brief) with the brief of an existing entry of that id whose hash is the same."""
    old = existing.dropDuplicates(["id"]).select("id", F.col("hash").alias("__hash"), F.col("brief").alias("__brief"))
    return fresh.join(old, "id", "left").withColumn("brief", F.when(F.col("hash") == F.col("__hash"), F.col("__brief")).otherwise(F.col("brief"))).drop("__hash", "__brief")


def skill_docs(files: DataFrame, summary=None) -> DataFrame:
    """(doc_path, content): one document for each source file, with a fixed outline unless `summary` gives a column."""
    folder, name = F.regexp_replace("rel_path", r"/?[^/]*$", ""), X._stem(F.regexp_extract("rel_path", r"([^/]*)$", 1))
    outline = F.concat(F.lit("# "), name, F.lit("\n\n## Summary\nTODO\n\n## API\nTODO\n"))
    return files.select(F.concat(F.lit("domains/"), folder, F.when(folder == "", "").otherwise("/"), name, F.lit("_api.md")).alias("doc_path"), (outline if summary is None else summary).alias("content"))

"""Briefs and tags of symbols, and aliases for unknown tags, by an injectable model.

Bodies that need no model are answered by native expressions; only the others
reach the Python function. Without a client the offline answer is used, which
is the signature, and its status is `fallback`.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import tags as T
from .client import in_flight
from .config import EnrichConfig

#: (module, signature, snippet) -> answer of the model, which holds {"brief": ..., "tags": ...}.
Client = Callable[[str, str, str], str]


def answer_of(raw: str) -> tuple[str | None, str | None]:
    """Brief, and tags as one comma-joined string, of a model's answer; None where there is none."""
    start, end = raw.find("{"), raw.rfind("}")
    try:
        body = json.loads(raw[start : end + 1])
    except ValueError:
        return None, None
    if not isinstance(body, dict):
        return None, None
    tags = body.get("tags")
    brief = body.get("brief")
    return brief if isinstance(brief, str) and brief.strip() else None, ",".join(t for t in tags if isinstance(t, str)) if isinstance(tags, list) else tags if isinstance(tags, str) else ""


def with_briefs(tasks: DataFrame, client: Client | None = None, config: EnrichConfig | None = None) -> DataFrame:
    """tasks (module, signature, snippet, ...) with brief, semantic_raw and brief_status (trivial, model or fallback)."""
    config = config or EnrichConfig()
    marked = tasks.withColumn("brief", X.trivial_brief(F.col("snippet")))
    easy = marked.filter("brief is not null").withColumn("semantic_raw", X.trivial_tags(F.col("brief"))).withColumn("brief_status", F.lit("trivial"))
    hard = marked.filter("brief is null").drop("brief")
    if client is None:
        asked = hard.withColumns({"brief": F.col("signature"), "semantic_raw": X.strings(), "brief_status": F.lit("fallback")})
        return easy.unionByName(asked)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            asked = list(zip(batch.module, batch.signature, batch["__prompt"], strict=True))
            calls = (lambda m=m, s=s, b=b: client(m, s, b or "") for m, s, b in asked)
            out = []
            for (_, signature, _), raw in zip(asked, in_flight(calls, config.concurrency, config.retries, config.pause), strict=True):
                brief, tags = (None, None) if raw is None else answer_of(raw)  # a row without an answer is asked again next time
                out.append((brief or signature, tags or "", "model" if brief else "fallback"))
            brief, tags, status = zip(*out, strict=True) if out else ((), (), ())
            yield batch.drop(columns="__prompt").assign(brief=brief, __tags=tags, brief_status=status)

    prompts = hard.withColumn("__prompt", X.truncated(F.col("snippet"), config.max_lines, config.max_chars))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in hard.schema), "brief string, __tags string, brief_status string"])
    asked = prompts.mapInPandas(ask, schema).withColumn("semantic_raw", X.adjusted_tags(F.col("snippet"), X.model_tags(F.col("__tags")))).drop("__tags")
    return easy.unionByName(asked, allowMissingColumns=False)


def aggregation_prompt(categories: list[str], unknown: list[str]) -> str:
    return "Existing categories: " + ", ".join(categories) + "\nNew tags: " + ", ".join(unknown) + '\nAnswer with JSON {"groups": {"category": ["tag"]}}.'


def enabled() -> bool:
    return os.environ.get("TAGWEAVE_TAG_AGGREGATION", "1").strip().lower() not in ("0", "false", "off", "no")


def aggregate_unknown(unknown: DataFrame, categories: DataFrame, client: Callable[[str], str] | None, size: int = 100, config: EnrichConfig | None = None) -> DataFrame:
    """(raw, canonical) aliases that a model gives for unknown tags, a batch of `size` tags a call.

    Groups that only name placeholders are rejected, and so are tags that weren't in the batch.
    """
    spark, limits = unknown.sparkSession, config or EnrichConfig()
    if client is None or not enabled():
        return spark.createDataFrame([], "raw string, canonical string")
    sample = [r.tag for r in T.category_sample(categories).collect()]
    listed = T.batches(unknown, size).groupBy("batch").agg(F.array_sort(F.collect_list("tag")).alias("tags"))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            calls = (lambda t=t: client(aggregation_prompt(sample, list(t))) for t in batch.tags)
            yield batch.assign(answer=list(in_flight(calls, limits.concurrency, limits.retries, limits.pause)))

    groups = listed.mapInPandas(ask, "batch long, tags array<string>, answer string").withColumn("groups", X.aggregation_groups(F.col("answer")))
    good = groups.filter("groups is not null").filter(~X.is_placeholder(F.col("groups")))
    pairs = good.select("tags", F.explode("groups").alias("canonical", "raws")).select("tags", "canonical", F.explode("raws").alias("raw"))
    return pairs.filter("array_contains(tags, raw) and raw <> canonical").groupBy("raw").agg(F.min("canonical").alias("canonical"))

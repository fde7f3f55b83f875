"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed per cell (source, language, topic). Raking scales the cells
until the sums over each dimension have their target shares; the cells stay a
distributed table, and only one number a round (the largest deviation) comes to
the driver. The ratio of a cell's weight to its tokens, divided by the largest
ratio, is the probability with which each of its documents is sampled: the
largest mixture of these shares in which no document is used twice. Cells of the
largest ratios that hold `TRIM` of the weight at most are taken whole instead, so
that a few odd documents (say one with a source of its own) don't cut the sample of
all others; by so much, at most, the shares may then be missed.

Rounds end when no share is off by more than `TOLERANCE`, or when the deviation
has stopped falling: targets that contradict each other can't be met together.
Then the last dimension has its shares, the others come as near as they do,
`Raked.converged` is false and a warning with the deviation is logged; `report`
lists target and reached share of every value.

Topics are coarse patterns (legal notices, contact data, prose): they stand for a
topic column that a corpus brings along.

Defined cases: a null source, language or topic is the value ``''``; a null or
empty text, or one without words, has no weight and is never sampled; texts of any
length count whole; a target for a value that no document has is left out and the
other shares are scaled up; a value without a target gets none of the weight;
documents with equal ids are sampled alike; an empty table gives an empty result;
input columns named like an added column are replaced, and names that begin with
two underscores are reserved.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored, table, without

DIMS = ("source", "lang", "topic")
TEMPERATURE = 0.7
TOLERANCE = 1e-6
PATIENCE = 5  # rounds in which the deviation must fall by a twentieth
TRIM = 0.01
SEED = 20260


def words_in(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic by pattern: legal notices, contact data, or prose."""
    body = F.coalesce(text, F.lit(""))
    return F.when(body.rlike(r"(?i)licen[cs]e|copyright|rights reserved"), "legal").when(body.rlike(r"\S@\S|\d{7,}"), "contact").otherwise("prose")


def cells_of(docs: DataFrame, dims: tuple[str, ...] = DIMS) -> DataFrame:
    return docs.groupBy(*dims).agg(F.sum("tokens").cast("double").alias("tokens"))


def flattened(cells: DataFrame, dim: str, power: float = TEMPERATURE) -> DataFrame:
    """Target shares proportional to a power of the natural ones: (value, share), not yet scaled to 1."""
    return cells.groupBy(F.col(dim).alias("value")).agg(F.pow(F.sum("tokens"), power).alias("share"))


@dataclass
class Raked:
    """Cells with `weight`, the largest deviation from a target share at the start of the last round, and whether it was small enough."""

    weights: DataFrame
    deviation: float
    converged: bool


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = TOLERANCE) -> Raked:
    """Weights whose sums over each dimension of `targets` are in the target shares; they add up to 1."""
    present = cells.filter("tokens > 0").withColumn("weight", F.col("tokens"))
    weights = present
    for dim, target in targets.items():
        seen = target.join(present.select(F.col(dim).alias("value")).distinct(), "value", "left_semi")
        whole = seen.agg(F.sum("share")).first()[0]
        goal = seen.select(F.col("value").alias(dim), (F.col("share") / F.lit(float(whole or 1.0))).alias(f"__share_{dim}"))
        weights = weights.join(goal.hint("shuffle_hash"), dim, "left").fillna(0.0, f"__share_{dim}")
    weights, offs = stored(weights), []
    while True:
        weights = weights.withColumn("__off", F.lit(0.0))
        for dim in targets:
            share = F.col(f"__share_{dim}")
            # the sums are few here and may be many elsewhere: a shuffle join, so that nothing goes through the driver
            sums = weights.groupBy(dim).agg(F.sum("weight").alias("__sum"))
            scaled = F.when(F.col("__sum") > 0, F.col("weight") * share / F.col("__sum")).otherwise(0.0)
            off = F.greatest("__off", F.abs(F.col("__sum") - share))
            weights = weights.join(sums.hint("shuffle_hash"), dim).withColumns({"__off": off, "weight": scaled}).drop("__sum")
        weights = stored(weights)  # once a round: the plan of the next one reads it 2 ** len(targets) times
        offs.append(weights.agg(F.max("__off")).first()[0] or 0.0)  # how far the sums were off before this round
        weights = weights.drop("__off")
        # the first round starts from token counts, whose deviation is no measure
        stuck = len(offs) > PATIENCE + 1 and offs[-1] > 0.95 * offs[-1 - PATIENCE]
        if offs[-1] < tolerance or stuck:
            break
    if offs[-1] >= tolerance:
        logging.getLogger(__name__).warning("the target shares can't be met together: one is off by %.3g", offs[-1])
    return Raked(weights.drop(*[f"__share_{dim}" for dim in targets]), offs[-1], offs[-1] < tolerance)


def report(raked: Raked, targets: dict[str, DataFrame]) -> DataFrame:
    """(dimension, value, target, reached): shares asked for and shares of the weights, for values that some cell has."""
    parts = []
    for dim, target in targets.items():
        reached = raked.weights.groupBy(F.col(dim).alias("value")).agg(F.sum("weight").alias("reached"))
        met = reached.join(target, "value", "left").select("value", F.coalesce("share", F.lit(0.0)).alias("share"), "reached")
        whole = met.agg(F.sum("share").alias("whole"))
        parts.append(met.join(F.broadcast(whole)).select(F.lit(dim).alias("dimension"), "value", (F.col("share") / F.col("whole")).alias("target"), "reached"))
    return reduce(DataFrame.unionByName, parts)


def probabilities(weights: DataFrame, trim: float = TRIM) -> DataFrame:
    """weights with `probability`: weight per token, divided by the largest that isn't trimmed, 1 at most.

    Ratios are looked at by eighths of a power of two, so a few thousand sums at most come to the driver.
    """
    ratio = F.col("weight") / F.col("tokens")
    levels = weights.filter("weight > 0").groupBy(F.floor(F.log2(ratio) * 8).alias("level")).agg(F.sum("weight").alias("weight"), F.max(ratio).alias("top")).collect()
    top, cut = 1.0, 0.0
    for row in sorted(levels, key=lambda r: -r.level):
        top, cut = row.top, cut + row.weight
        if cut > trim:
            break
    return weights.withColumn("probability", F.least(F.lit(1.0), ratio / F.lit(float(top))))


def draw(ident: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) that an id and a seed decide."""
    return F.shiftrightunsigned(F.xxhash64(ident, F.lit(seed)), 11) / F.lit(float(1 << 53))


def mixed(docs: DataFrame, targets: dict[str, DataFrame] | None = None, ident: str = "doc_id", text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with topic, tokens, probability and sampled; targets default to flattened natural shares.

    Texts are read once: what is kept is written with topic and tokens, and cells and result come from that table.
    """
    body = F.col(f"`{text}`")
    kept = without(docs, ["topic", "tokens", "probability", "sampled"]).columns
    own = [F.col(f"`{c}`") for c in kept if keep is None or c in keep]
    base = stored(docs.select(*own, topic_of(body).alias("topic"), words_in(body).alias("tokens")))
    keys = {d: F.coalesce(F.col(d).cast("string"), F.lit("")) for d in DIMS}
    cells = stored(cells_of(base.select(*[keys[d].alias(d) for d in DIMS], "tokens")))
    goals = targets or {d: flattened(cells, d) for d in DIMS}
    chance = stored(probabilities(rake(cells, goals).weights).select(*[F.col(d).alias(f"__{d}") for d in DIMS], "probability"))
    on = reduce(lambda a, b: a & b, [keys[d] == F.col(f"__{d}") for d in DIMS])
    out = base.join(chance, on, "left").drop(*[f"__{d}" for d in DIMS])
    out = out.withColumn("probability", F.when(F.col("tokens") > 0, F.coalesce("probability", F.lit(0.0))).otherwise(0.0))
    return out.withColumn("sampled", draw(F.col(f"`{ident}`")) < F.col("probability"))


def sample_mixture(docs: DataFrame) -> DataFrame:
    """The sampled documents, with the columns of docs, those that are named like an added column included."""
    added = {"topic", "tokens", "probability", "sampled"}
    clash = [c for c in docs.columns if c.lower() in added]
    own = docs.withColumnsRenamed({c: f"__own_{c}" for c in clash})
    return mixed(own).filter("sampled").select(*[F.col(f"`__own_{c}`").alias(c) if c in clash else F.col(f"`{c}`") for c in docs.columns])


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixed(table(sf_dir, "documents", spark), keep=["doc_id", "lang", "source"])
    return rows.select("doc_id", "source", "lang", "topic", "tokens", "probability", "sampled")


QUERIES = {"op5_source_mixing": op5_source_mixing}
SQL: dict[str, str] = {}

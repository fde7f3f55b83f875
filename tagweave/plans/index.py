"""Build and update jobs: source tree to index tables, published as snapshots (see `store`).

An update extracts changed files only, and works on the symbols whose key a changed
file has or had; all others keep their rows, and counts move by the edges that went and
came. Buckets of tables that a run leaves as they were keep their files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..extract import registry as R
from ..functions import text as X
from ..functions.basetags import with_base_tags
from ..operators import changes as C
from ..operators import tags as T
from ..settle import settled
from ..sources import files as S
from ..sources import routing as J
from ..sources.store import Draft, Snapshot, Store, bucket_of, new_rows
from .config import BuildConfig
from .enrich import Client, aggregate_unknown, with_briefs


def hint_of(lang: str, path: str) -> Column:
    return F.when(F.col(lang) == "cpp", X.module_hint_cpp(F.col(path))).otherwise(X.module_hint(F.col(path)))


def keys_of(extracted: DataFrame) -> DataFrame:
    """(symbol_key) of extracted rows; rows of one key compete for one symbol."""
    return extracted.select(X.symbol_key(hint_of("lang", "rel_path"), F.col("raw_id")).alias("symbol_key")).distinct()


def candidates(extracted: DataFrame) -> DataFrame:
    """One row for each symbol of extracted rows (see `extract.registry.extract`), after normalization, hashing and deduplication."""
    rows = extracted
    sig = F.when(F.col("lang") == "python", F.col("signature")).otherwise(X.normalize_signature(F.col("signature")))
    rows = rows.withColumns({"hint": hint_of("lang", "rel_path"), "norm": X.normalize_signature(sig)}).filter("norm <> ''").filter((F.col("lang") != "cpp") | ~X.invalid_signature(F.col("norm")))
    rows = rows.withColumns(
        {
            "symbol_key": X.symbol_key(F.col("hint"), F.col("raw_id")),
            "symbol_id": X.symbol_id(F.col("hint"), F.col("raw_id")),
            "priority": X.extension_priority(F.col("rel_path")),
            "qualifier_depth": X.qualifier_depth(F.col("raw_id")),
        }
    )
    kept = settled(C.dedup_candidates(rows, "symbol_key", "scan_seq", "pos"))
    kept = with_base_tags(kept, "base_raw", "symbol_id", "norm", "rel_path", "hint")
    return kept.select(
        "symbol_id", "kind", F.col("norm").alias("signature"), F.sha1("norm").alias("decl_hash"), X.impl_hash(F.col("norm"), F.col("snippet")).alias("impl_hash"), F.col("rel_path").alias("file_path"), "decl_line", "impl_line", "snippet", "hint", F.col("hint").alias("module"), "raw_id", "lang",
        "base_raw", "symbol_key", (F.col("scan_seq") * 1_000_000 + F.col("pos")).alias("seq"),
    )


def assemble(rows: DataFrame, previous: J.Index, client: Client | None, aggregator: Callable[[str], str] | None, config: BuildConfig, changed: DataFrame | None = None, rest: DataFrame | None = None) -> J.Index:
    """Index tables from candidate rows; unchanged symbols keep brief and semantic tags of the previous index.

    `changed` are the files that changed, if they are known: symbols of other files need no comparison of their bodies.
    `rest` are symbols of the previous index that no change concerns and that stay as they are, but for their module;
    `rows` are the others then, and counts are the previous ones less the edges that went and plus those that came.
    """
    old = previous.edges.filter("tag_type = 'semantic'").groupBy("symbol_id").agg(F.array_sort(F.collect_list(F.struct("pos", "tag"))).alias("t")).select("symbol_id", F.col("t.tag").alias("__sem"))
    prev = previous.symbols.select("symbol_id", F.col("brief").alias("__brief"))
    split = C.split_reuse(rows, previous.symbols, changed).join(prev, "symbol_id", "left").join(old, "symbol_id", "left")
    split = settled(split)
    reused = split.filter("reuse").withColumns({"brief": F.col("__brief"), "semantic": F.coalesce("__sem", X.strings()), "brief_status": F.lit("done")})
    fresh = with_briefs(split.filter("not reuse"), client, config.enrich)
    low = X.low_info_tags(F.col("base_raw"), F.col("file_path"), F.col("raw_id"))
    fresh = fresh.withColumn("semantic", X.index_tags(X.semantic_tags(F.col("semantic_raw"), low))).drop("semantic_raw")
    symbols = settled(fresh.unionByName(reused.select(fresh.columns)).withColumn("base", X.index_tags(F.col("base_raw"))).drop("reuse", "__brief", "__sem", "base_raw"))

    semantic = symbols.select(F.explode("semantic").alias("tag"))
    known = previous.categories
    new_aliases = aggregate_unknown(T.unknown_tags(semantic, previous.aliases, known), known, aggregator, config.batch_size, config.enrich)
    merged = settled(T.merge_maps(previous.aliases, new_aliases, "raw", "canonical"))
    aliases = settled(T.without_cycles(merged))
    canon = settled(T.resolve_aliases(semantic, aliases))
    resolved = symbols.select("symbol_id", F.posexplode("semantic").alias("pos", "tag")).join(canon, "tag").groupBy("symbol_id", F.col("canonical").alias("tag")).agg(F.min("pos").alias("pos"))
    base = symbols.select("symbol_id", F.posexplode("base").alias("pos", "tag"))
    typed = base.withColumn("tag_type", F.lit("base")).unionByName(resolved.withColumn("tag_type", F.lit("semantic")))
    custom = previous.edges.filter("tag_type = 'custom'").join(symbols.select("symbol_id"), "symbol_id", "left_semi").join(typed.select("symbol_id", "tag"), ["symbol_id", "tag"], "left_anti")
    new_edges = settled(typed.select("symbol_id", "tag", "tag_type", "pos").unionByName(custom.select("symbol_id", "tag", "tag_type", "pos")))
    edges, names = new_edges, ["symbol_id", "kind", "signature", "decl_hash", "impl_hash", "file_path", "decl_line", "impl_line", "brief", "seq", "brief_status", "symbol_key", "hint"]
    every = symbols.select(*names)
    if rest is not None:
        edges = settled(new_edges.unionByName(previous.edges.join(rest.select("symbol_id"), "symbol_id", "left_semi").select(new_edges.columns)))
        every = every.unionByName(rest.select(*names))

    arrays = edges.groupBy("symbol_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("tag_type") == t, F.struct("pos", "tag")))).alias(t) for t in ("base", "semantic")])
    tags_of = lambda t: F.coalesce(F.transform(t, lambda x: x.tag), X.strings()).alias(t)
    named = every.select("symbol_id", "hint").join(arrays, "symbol_id", "left").select("symbol_id", "hint", tags_of("base"), tags_of("semantic"))
    module = T.clusters(named, config.min_cluster, config.cluster_by_path_from).select("symbol_id", F.col("cluster_id").alias("module"))
    final = every.join(module, "symbol_id").select("symbol_id", "module", *names[1:])
    canonical = new_edges.filter("tag_type = 'semantic'").select("tag")
    categories = T.with_categories(known, canonical)
    if rest is None:
        categories, counts = T.category_counts(categories, canonical), T.index_counts(edges)
    else:
        gone = previous.edges.join(rest.select("symbol_id"), "symbol_id", "left_anti")
        counts = T.shifted_counts(previous.tag_index, gone, new_edges)
        uses = counts.filter("tag_type = 'semantic'").select("tag", F.col("count").alias("n"))
        categories = categories.select("tag").join(uses, "tag", "left").select("tag", F.coalesce("n", F.lit(0)).alias("count"))
    categories, aliases = T.used_only(categories, aliases)
    index = T.index_scores(counts, previous.tag_index)
    return J.Index(final, edges, index.select("tag_type", "tag", "count", "score"), aliases.select("raw", "canonical"), categories, previous.version + 1)


def scan(spark: SparkSession, root: str, config: BuildConfig) -> DataFrame:
    return S.read_files(spark, root, S.list_files(root, extra_ignore=config.extra_ignore)).filter("content is not null")


def _publish(store: Store, draft: Draft, index: J.Index, config: BuildConfig, folded: dict[str, list[str]] | None = None) -> None:
    """Write the tables of an index into a draft that has the others already, and make it the newest snapshot."""
    for name in J.TABLES:
        draft.put(name, settled(getattr(index, name)))
    now = draft.commit(folded)
    document = f"{store.root}/routing.json"
    if config.export_json:
        J.save_routing(J.Index(*(store.read(now, name) for name in J.TABLES), now.version), document)
    else:  # a document of tables that are no longer so
        store.fs.delete(store._path("routing.json"), False)


def _previous(spark: SparkSession, out: str) -> tuple[J.Index, Snapshot | None]:
    """The index so far: the newest snapshot, or a JSON document, or an empty one."""
    store = Store(spark, out)
    now = store.snapshot()
    return (J.load_routing(spark, f"{out}/routing.json"), None) if now is None else (J.Index(*(store.read(now, name) for name in J.TABLES), now.version), now)


def _extracted(files: DataFrame) -> DataFrame:
    return R.extract(files.select("rel_path", "lang", "content")).select("rel_path", "lang", *R.SYMBOL_COLUMNS, "snippet")


Progress = Callable[[str, dict], None]


def _counted(df: DataFrame, stage: str, progress: Progress | None, **metrics: Column) -> DataFrame:
    """df as a checkpoint, whose write also counts; the counts are reported when it is done, without another action."""
    if progress is None:
        return settled(df)
    seen = Observation()
    out = settled(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[m.alias(n) for n, m in metrics.items()]))
    progress(stage, dict(seen.get))
    return out


def build(spark: SparkSession, root: str, out: str, client: Client | None = None, aggregator=None, config: BuildConfig | None = None, progress: Progress | None = None) -> None:
    """Build the index of a source tree anew; scores, aliases and custom tags of the index before are kept.

    `progress` is called with a stage (extracted, candidates, symbols, edges) and what was counted in it.
    """
    config = config or BuildConfig()
    files = scan(spark, root, config).persist()
    previous, now = _previous(spark, out)
    store = Store(spark, out)
    draft = store.next(now, previous.version + 1)
    nothing = J.Index(previous.symbols.limit(0), previous.edges.filter("tag_type = 'custom'"), previous.tag_index, previous.aliases, previous.categories, previous.version)
    extracted = _counted(_extracted(files), "extracted", progress, files=F.approx_count_distinct("rel_path"))
    draft.put("extracted", extracted)
    draft.put("meta", _dated(files, store, now))
    rows = _counted(candidates(_placed(extracted, files)), "candidates", progress)
    index = assemble(rows, nothing, client, aggregator, config)
    if progress is not None:
        index.symbols = _counted(index.symbols, "symbols", progress, fallback=F.count_if(F.col("brief_status") == "fallback"))
        index.edges = _counted(index.edges, "edges", progress, semantic=F.count_if(F.col("tag_type") == "semantic"))
    _publish(store, draft, index, config)
    files.unpersist()


def _dated(files: DataFrame, store: Store, now: Snapshot | None) -> DataFrame:
    """The change table of files; a file whose hash is as before keeps its date."""
    meta = J.build_meta(files)
    if now is not None and "meta" in now.parts:
        old = store.read(now, "meta").select("rel_path", "hash", F.col("last_updated").alias("__old"))
        meta = meta.join(old, ["rel_path", "hash"], "left").withColumn("last_updated", F.coalesce("__old", "last_updated")).drop("__old")
    return settled(meta)


def _placed(extracted: DataFrame, files: DataFrame) -> DataFrame:
    """Extracted rows with the place of their file in the tree's order."""
    return extracted.join(files.select("rel_path", "scan_seq"), "rel_path")


def update(spark: SparkSession, root: str, out: str, client: Client | None = None, aggregator=None, config: BuildConfig | None = None) -> bool:
    """Bring the index up to date; False if no file changed. Only changed files are extracted, and only their symbols are worked on."""
    config = config or BuildConfig()
    previous, now = _previous(spark, out)
    if now is None or "extracted" not in now.parts:  # an index from elsewhere
        build(spark, root, out, client, aggregator, config)
        return True
    store = Store(spark, out)
    files = scan(spark, root, config).persist()
    changed = settled(C.changed_files(files, store.read(now, "meta")))
    any_change = not changed.isEmpty()
    if any_change:
        draft = store.next(now, previous.version + 1)
        touched = [r.b for r in changed.select(bucket_of("rel_path").alias("b")).distinct().collect()]  # buckets at most
        before = store.read(now, "extracted", touched)
        fresh = settled(_extracted(files.join(changed.select("rel_path"), "rel_path", "left_semi")))
        gone = before.join(changed.select("rel_path"), "rel_path", "left_semi")
        part = settled(fresh.unionByName(before.join(changed.select("rel_path"), "rel_path", "left_anti")))
        draft.put("extracted", part, touched)
        draft.put("meta", _dated(files, store, now))
        keys = keys_of(fresh.unionByName(gone))
        if client is not None:  # briefs that a model owes
            keys = keys.union(previous.symbols.filter("brief_status = 'fallback'").select("symbol_key")).distinct()
        keys = settled(keys)
        # rows of untouched buckets compete for the same keys
        pool = part.unionByName(store.read(now, "extracted", [b for b in map(int, now.parts["extracted"]) if b not in set(touched)]))
        same_key = X.symbol_key(hint_of("lang", "rel_path"), F.col("raw_id"))
        rows = candidates(_placed(pool.withColumn("symbol_key", same_key).join(keys, "symbol_key", "left_semi").drop("symbol_key"), files))
        rest = previous.symbols.join(keys, "symbol_key", "left_anti")
        if not changed.filter("change <> 'changed'").isEmpty():  # places of files moved
            moved = files.select(F.col("rel_path").alias("file_path"), "scan_seq")
            rest = rest.join(moved, "file_path").withColumn("seq", F.col("scan_seq") * 1_000_000 + F.col("seq") % 1_000_000).drop("scan_seq")
        _publish(store, draft, assemble(rows, previous, client, aggregator, config, changed, settled(rest)), config)
    files.unpersist()
    return any_change


def apply_logs(spark: SparkSession, out: str, edits: DataFrame | str | None = None, usage: DataFrame | str | None = None, config: BuildConfig | None = None) -> None:
    """Fold logs of edits and of usage into the index and publish it; every file of a log is folded once, however often this runs.

    edits: (symbol_id, op, value, tag_type, seq), op one of add, remove, brief; usage: (tag). A log is a folder of files, as
    `append_log` writes it, or a DataFrame over one; rows without a file have no name to be known by and are an error. The
    names of folded files are part of the snapshot, so tables and names change together or not at all.
    """
    config = config or BuildConfig()
    before, now = _previous(spark, out)
    store = Store(spark, out)
    draft = store.next(now, before.version + 1)
    folded = {"edits": draft.now.folded.get("edits", []), "usage": draft.now.folded.get("usage", [])}
    logs: dict[str, DataFrame] = {}
    for name, log in (("edits", edits), ("usage", usage)):
        if log is not None:
            rows, names = new_rows(spark.read.parquet(log) if isinstance(log, str) else log, folded[name])
            if set(names) - set(folded[name]):
                logs[name] = rows
                folded[name] = sorted({*folded[name], *names})
    if not logs:
        return
    symbols, edges, index = before.symbols, before.edges, before.tag_index
    if "edits" in logs:
        rows = settled(logs["edits"])
        symbols, edges = T.folded_briefs(symbols, rows), settled(T.folded_edits(edges, rows))
        index = T.folded_index(before.edges, edges, index)
    if "usage" in logs:
        index = T.bumped_index(settled(index), logs["usage"])
    after = J.Index(symbols, edges, index.select("tag_type", "tag", "count", "score"), before.aliases, before.categories, before.version + 1)
    _publish(store, draft, after, config, folded)


def append_log(log: DataFrame, path: str) -> None:
    """Append rows to a log of usage or edits, as Parquet files that later runs fold."""
    log.write.mode("append").parquet(path)

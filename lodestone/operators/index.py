"""Index states as functions of old and new tables: change detection, upserts, replacement, deletion with cascade, publishing.

Tables are immutable: each function returns the next state, and publish() swaps a written one in."""

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def detect_changes(disk: DataFrame, old: DataFrame, incremental: bool = True, force: bool = False) -> DataFrame:
    """disk (path, hash, mtime) with status: fresh (mtime not newer), same (equal hash) or changed.

    force makes all changed; without incremental, times are not looked at."""
    both = disk.join(old.select("path", F.col("hash").alias("_hash"), F.col("mtime").alias("_mtime")), "path", "left")
    status = F.lit("changed") if force else F.when(F.lit(incremental) & F.coalesce(F.col("mtime") <= F.col("_mtime"), F.lit(False)), "fresh").when(F.col("hash").eqNullSafe(F.col("_hash")), "same").otherwise("changed")
    return both.select(*disk.columns, status.alias("status"))


def upsert_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """old (path, hash, mtime, summary) with new (path, hash, mtime) put in; texts about a file go when its hash changes."""
    n = new.select("path", F.col("hash").alias("_h"), F.col("mtime").alias("_m"))
    both = old.join(n, "path", "full")
    keep = F.when(F.col("_h").isNull() | (F.col("_h") == F.col("hash")), F.col("summary"))
    return both.select("path", F.coalesce("_h", "hash").alias("hash"), F.coalesce("_m", "mtime").alias("mtime"), keep.alias("summary"))


def delete_stale(files: DataFrame, known: DataFrame) -> DataFrame:
    """The files whose paths are known; none if no path is."""
    return files.join(known.select("path").distinct(), "path", "left_semi")


def cascade(files: DataFrame, symbols: DataFrame, edges: DataFrame):
    """Symbols and edges without those of files that are gone, at either end."""
    ids = files.select("id")
    s = symbols.join(ids.withColumnRenamed("id", "file_id"), "file_id", "left_semi")
    e = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return s, e


def replace_rows(old: DataFrame, new: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """old without the rows of changed keys, and new: symbols by file_id, edges by source_id."""
    return old.join(changed.select(key).distinct(), key, "left_anti").unionByName(new)


def update_ranks(files: DataFrame, ranks: DataFrame) -> DataFrame:
    """files with the ranks of (id, rank); files without one keep theirs."""
    r = ranks.select("id", F.col("rank").alias("_r"))
    return files.join(r, "id", "left").withColumn("rank", F.coalesce("_r", "rank")).drop("_r")


def update_mtimes(files: DataFrame, times: DataFrame) -> DataFrame:
    t = times.select("path", F.col("mtime").alias("_t"))
    return files.join(t, "path", "left").withColumn("mtime", F.coalesce("_t", "mtime")).drop("_t")


def set_texts(files: DataFrame, texts: DataFrame, strict: bool = True) -> DataFrame:
    """files with summary and when_to_use of texts (path, summary, when_to_use). With strict, an unknown path is an error."""
    if strict and not texts.join(files.select("path"), "path", "left_anti").isEmpty():
        raise LookupError("path not in index")
    t = texts.select("path", F.col("summary").alias("_s"), F.col("when_to_use").alias("_w"), F.lit(True).alias("_set"))
    out = files.join(t, "path", "left")
    return out.withColumns({"summary": F.when(F.col("_set"), F.col("_s")).otherwise(F.col("summary")), "when_to_use": F.when(F.col("_set"), F.col("_w")).otherwise(F.col("when_to_use"))}).drop("_s", "_w", "_set")


def clear_texts(files: DataFrame, path: str | None = None) -> DataFrame:
    """files without the texts of one path (an unknown one is an error), or of all."""
    if path is not None and files.where(F.col("path") == path).isEmpty():
        raise LookupError(f"path not in index: {path}")
    hit = F.lit(True) if path is None else F.col("path") == path
    return files.withColumns({c: F.when(~hit, F.col(c)) for c in ("summary", "when_to_use")})


def graph_edges(fresh: DataFrame, stored: DataFrame, changed: DataFrame) -> DataFrame:
    """New edges of changed files and the stored ones of all others."""
    return fresh.unionByName(stored.join(changed.select("source_id").distinct(), "source_id", "left_anti"))


def same_content(files: DataFrame) -> DataFrame:
    """(hash, copies, first_path) of the hashes that several files share."""
    return files.groupBy("hash").agg(F.count("*").alias("copies"), F.min("path").alias("first_path")).where("copies > 1")


def next_times(files: DataFrame, marked: DataFrame, incremental: bool) -> DataFrame:
    """files with the times of marked (path, mtime, status): changed files take theirs as it is, older or newer; files of the same content only in incremental mode."""
    taken = marked.where(F.col("status").isin(["changed", "same"] if incremental else ["changed"]))
    return update_mtimes(files, taken)


def reindex(old: dict, disk: DataFrame, parse, incremental: bool = True, force: bool = False, compat: bool = True) -> dict:
    """The next state of {"files", "symbols", "edges"} after a scan of disk (path, content, hash, mtime).

    Rows without content are files that can't be read now: they keep what is stored of them. parse(changed) gives (symbols,
    imports) with paths, and as a third, if it has one, the paths that failed: these keep their symbols and edges. compat keeps
    the edges of unchanged importers as they are, otherwise all files are parsed again, so that new targets gain edges from
    them. Ranks are computed afresh if anything changed."""
    from lodestone.operators.graph import boosted_ranks
    from lodestone.tables import cut

    marked = cut(detect_changes(disk.where("content is not null"), old["files"], incremental, force))
    kept = delete_stale(old["files"], disk)
    changed = marked.where("status = 'changed'")
    if changed.isEmpty():
        symbols, edges = cascade(kept, old["symbols"], old["edges"])
        return {"files": next_times(kept, marked, incremental), "symbols": symbols, "edges": edges}
    todo = changed if compat else marked
    symbols, imports, *failed = parse(todo)
    text_free = F.when(F.col("_h").isNull() | F.col("_h").eqNullSafe(F.col("hash")), F.col("summary"))
    n = changed.select("path", F.col("hash").alias("_h"))  # a file that is skipped for its time keeps its hash
    files = kept.join(n, "path", "full")
    files = files.select(F.coalesce("id", F.xxhash64("path")).alias("id"), "path", F.coalesce("_h", "hash").alias("hash"), F.coalesce("rank", F.lit(0.0)).alias("rank"), "mtime", text_free.alias("summary"), F.when(text_free.isNotNull() | F.col("_h").eqNullSafe(F.col("hash")), F.col("when_to_use")).alias("when_to_use"))
    files = cut(next_times(files, marked, incremental))
    ids = files.select("id", "path")
    done = todo.select("path").join(failed[0].select("path"), "path", "left_anti") if failed else todo.select("path")
    done_ids = ids.join(done, "path", "left_semi").select("id")
    new_symbols = symbols.join(ids, "path").select(F.col("id").alias("file_id"), "name", "kind", "is_exported", "ref_count")
    by = lambda c: ids.select(F.col("id").alias(f"{c}_id"), F.col("path").alias(c))
    new_edges = imports.join(by("source"), "source").join(by("target"), "target").select("source_id", "target_id", "edge_type", "specifier")
    old_symbols, old_edges = cascade(files, old["symbols"], old["edges"])
    symbols = replace_rows(old_symbols, new_symbols, done_ids.withColumnRenamed("id", "file_id"), "file_id")
    edges = cut(graph_edges(new_edges, old_edges, done_ids.withColumnRenamed("id", "source_id")))
    return {"files": update_ranks(files, boosted_ranks(files, edges)), "symbols": symbols, "edges": edges}


def publish(tables: dict, root: str) -> str:
    """Writes a whole state below root and points `current` at it with one small write; readers see the old or the new state."""
    spark = next(iter(tables.values())).sparkSession
    version = f"v{time.time_ns()}"
    for name, df in tables.items():
        df.write.parquet(f"{root}/{version}/{name}")
    mark = spark.createDataFrame([(version, json.dumps(sorted(tables)))], "version string, tables string")
    mark.coalesce(1).write.mode("append").json(f"{root}/versions")
    return version


def open_index(spark: SparkSession, root: str) -> dict:
    """The tables of the latest published state; a missing index is an error."""
    from pyspark.errors import AnalysisException

    try:
        row = spark.read.schema("version string, tables string").json(f"{root}/versions").orderBy(F.desc("version")).first()
    except AnalysisException as e:
        raise FileNotFoundError(f"no index at {root}") from e
    if row is None:
        raise FileNotFoundError(f"no index at {root}")
    return {n: spark.read.parquet(f"{root}/{row['version']}/{n}") for n in json.loads(row["tables"])}

"""Symbol lookup: definitions by name, with the files that import the defining ones."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import like_anywhere

SHOWN = 5


def symbol_search(files: DataFrame, symbols: DataFrame, pattern: str, limit: int | None = 10, exact: bool = False, exported_only: bool = False) -> DataFrame:
    """(name, kind, is_exported, ref_count, file_id, path) of matching symbols, exported and often used ones first."""
    match = F.col("name") == pattern if exact else like_anywhere(F.col("name"), pattern)
    found = symbols.where(match & F.col("is_exported") if exported_only else match)
    named = found.join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    order = [F.desc("is_exported"), F.desc("ref_count"), "path", "name", "kind"]
    named = named.orderBy(*order) if limit is None else named.orderBy(*order).limit(limit)
    return named.select("name", "kind", "is_exported", "ref_count", "file_id", "path")


def symbol_detail(files: DataFrame, symbols: DataFrame, edges: DataFrame, pattern: str, limit: int | None = 10, exact: bool = False, signatures: DataFrame | None = None) -> DataFrame:
    """One row per name: definitions, the first SHOWN importers of the defining files by path, and how many importers there are.

    The limit holds for definitions, before they are grouped. signatures (id, signatures): a definition gets the first that
    holds its name."""
    found = symbol_search(files, symbols, pattern, limit, exact)
    if signatures is not None:
        found = found.join(signatures.select(F.col("id").alias("file_id"), "signatures"), "file_id", "left").withColumn("signature", F.get(F.filter("signatures", lambda s: F.contains(s, F.col("name"))), F.lit(0)))
    else:
        found = found.withColumn("signature", F.lit(None).cast("string"))
    places = found.groupBy("name").agg(F.sort_array(F.collect_list(F.struct(F.col("path").alias("file"), "kind", F.col("is_exported").alias("exported"), "ref_count", "signature"))).alias("definitions"))
    users = found.select("name", F.col("file_id").alias("target_id")).distinct().join(edges.select("source_id", "target_id").distinct(), "target_id")
    users = users.join(files.select(F.col("id").alias("source_id"), "path"), "source_id").select("name", "path").distinct()
    by_name = users.groupBy("name").agg(F.sort_array(F.collect_set("path")).alias("all"))
    empty = F.array().cast("array<string>")
    return places.join(by_name, "name", "left").select("name", "definitions", F.slice(F.coalesce("all", empty), 1, SHOWN).alias("referenced_in"), F.size(F.coalesce("all", empty)).alias("total_references"))

"""Relevance of files to keywords, expansion to neighbours, and the map of top files in a byte budget."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.functions.text import keywords

PATH, EXPORT, SUMMARY, WHEN = 3, 2, 3, 4
LEAST_RANK, SPREAD = 0.01, 0.3
TOP_FILES, SHOWN = 500, 5


def file_exports(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """files with exports: sorted names of the exported symbols, empty where there are none."""
    names = symbols.where("is_exported").groupBy(F.col("file_id").alias("id")).agg(F.sort_array(F.collect_list("name")).alias("exports"))
    return files.join(names, "id", "left").withColumn("exports", F.coalesce("exports", F.array().cast("array<string>")))


def keyword_weights(described: DataFrame, words: DataFrame) -> DataFrame:
    """(id, path, rank, kw, w) of files and words (kw) that match: weights of what matched, by place.

    Words are sent to every executor after a check of their number; a file meets each of them once."""
    words = F.broadcast(words) if words.count() <= 10_000 else words
    f = described.select("id", "path", "rank", F.split(F.lower("path"), "[/.]").alias("_parts"), F.transform("exports", F.lower).alias("_exports"), F.lower("summary").alias("_s"), F.lower("when_to_use").alias("_w"))
    k = F.col("kw")
    tests = ((PATH, F.exists("_parts", lambda c: F.contains(c, k))), (EXPORT, F.exists("_exports", lambda c: F.contains(c, k))), (SUMMARY, F.contains("_s", k)), (WHEN, F.contains("_w", k)))
    return f.join(words, F.lit(True)).select("id", "path", "rank", "kw", F.array(*[F.when(t, w).otherwise(0) for w, t in tests]).alias("w")).where(F.exists("w", lambda x: x > 0))


def direct_scores(described: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id, path, raw, score, rank, reasons) of files with a match.

    described: files with exports; queries: (query_id, query), few, sent to every executor after a check of their number."""
    asked = queries.select("query_id", F.posexplode(keywords(F.col("query"))).alias("at", "kw"))
    met = keyword_weights(described, asked.select("kw").distinct())
    k = F.col("kw")
    per = met.join(F.broadcast(asked) if asked.count() <= 100_000 else asked, "kw").groupBy("query_id", "id", "path", "rank")
    why = F.flatten(F.collect_list(F.filter(F.transform("w", lambda x, i: F.struct(F.when(x > 0, i).alias("i"), F.col("at").alias("at"), k.alias("kw"))), lambda x: x["i"].isNotNull())))
    scored = per.agg(F.sum(F.aggregate("w", F.lit(0), lambda x, y: x + y)).alias("raw"), F.array_distinct(F.transform(F.array_sort(why), lambda x: x["kw"])).alias("reasons"))
    return scored.withColumn("score", F.col("raw") * F.greatest("rank", F.lit(LEAST_RANK)))


def expanded_scores(files: DataFrame, edges: DataFrame, direct: DataFrame) -> DataFrame:
    """Direct hits and their neighbours in either direction: max(own score, SPREAD x best neighbour's direct score).

    A file found by a neighbour only has the reason `neighbor of P`, P having the best score, then the least path."""
    both = edges.select("source_id", "target_id").distinct()
    both = both.union(both.select("target_id", "source_id")).toDF("id", "to").distinct()
    best = direct.join(both, "id").groupBy("query_id", F.col("to").alias("id")).agg(F.max("score").alias("near"), F.min_by("path", F.struct((-F.col("score")).alias("s"), "path")).alias("parent"))
    all_ = direct.select("query_id", "id", "score", "reasons").join(best, ["query_id", "id"], "full")
    out = all_.select("query_id", "id", F.greatest(F.coalesce("score", F.lit(0.0)), SPREAD * F.coalesce("near", F.lit(0.0))).alias("score"), F.coalesce("reasons", F.array(F.concat(F.lit("neighbor of "), "parent"))).alias("reasons"))
    return out.join(files.select("id", "path", "rank"), "id").select("query_id", "id", "path", "score", "rank", "reasons")


def context(files, symbols, edges, query: str, limit: int = 10, sources: DataFrame | None = None) -> DataFrame:
    """The files most relevant to a query; with sources (path, content), their texts. A query without keywords is an error."""
    spark = files.sparkSession
    queries = spark.createDataFrame([(0, query)], "query_id long, query string")
    if not queries.select(F.size(keywords(F.col("query"))).alias("n")).first()["n"]:
        raise ValueError("no keywords in query")
    found = expanded_scores(files, edges, direct_scores(file_exports(files, symbols), queries))
    top = found.orderBy(F.desc("score"), "path").limit(limit).drop("query_id", "id")
    return top if sources is None else top.join(sources.select("path", F.coalesce("content", F.lit("")).alias("content")), "path", "left")


def map_entries(files, edges, signatures: DataFrame, top: int = TOP_FILES) -> DataFrame:
    """(position, path, entry): the text of each of the top files that have signatures (id, signatures array)."""
    ranked = files.orderBy(F.desc("rank"), "path").limit(top)
    ids = ranked.select("id")
    importers = edges.join(F.broadcast(ids.withColumnRenamed("id", "target_id")), "target_id").groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("importers"))
    out = edges.join(F.broadcast(ids.withColumnRenamed("id", "source_id")), "source_id").join(files.select(F.col("id").alias("target_id"), F.col("path").alias("_t")), "target_id")
    # the first SHOWN imports of each top file, by path; repeats stay
    w = W.partitionBy("source_id").orderBy("_t", "specifier", "edge_type")
    shown = out.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= SHOWN).groupBy(F.col("source_id").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "_t"))), lambda x: x["_t"]), ", ").alias("imports"))
    f = ranked.join(signatures, "id").where("size(signatures) > 0").join(importers, "id", "left").join(shown, "id", "left")
    line = lambda c, before="": F.when(c.isNotNull(), F.concat(F.lit("  " + before), c, F.lit("\n"))).otherwise("")
    entry = F.concat(
        F.format_string("%s [rank: %.2f | %d importers]\n", "path", "rank", F.coalesce("importers", F.lit(0))),
        line(F.col("summary")),
        line(F.col("when_to_use"), "Use when: "),
        F.array_join(F.transform("signatures", lambda s: F.concat(F.lit("  "), s, F.lit("\n"))), ""),
        line(F.col("imports"), "→ imports: "),
        F.lit("\n"),
    )
    return f.select(F.row_number().over(W.orderBy(F.desc("rank"), "path")).alias("position"), "path", entry.alias("entry"))  # at most `top` rows


def within_budget(entries: DataFrame, tokens: int, header_bytes: int = 0, footer_bytes: int = 0) -> DataFrame:
    """The entries before the first that would take header, entries and footer over tokens x 4 bytes, with the bytes used so far."""
    w = W.orderBy("position").rowsBetween(W.unboundedPreceding, 0)
    used = entries.withColumn("bytes", F.octet_length("entry").cast("long")).withColumn("used", F.sum("bytes").over(w) + header_bytes)
    return used.where((F.col("used") + footer_bytes <= 4 * tokens) & (F.col("used") - F.col("bytes") + footer_bytes < 4 * tokens))


def map_text(files, symbols, edges, signatures, tokens: int = 1500, footer: str = "") -> str:
    """The map as one string: header, the entries that fit, footer."""
    stats = index_stats(files, symbols, edges).first()
    head = f"## Code map\n{stats['files']} files, {stats['exports']} exports, {stats['edges']} import edges; by structural importance:\n\n"
    rows = within_budget(map_entries(files, edges, signatures), tokens, len(head.encode()), len(footer.encode())).orderBy("position").collect()
    return head + "".join(r["entry"] for r in rows) + footer


def index_stats(files, symbols, edges) -> DataFrame:
    """One row: numbers of files, exported symbols and edges."""
    return files.agg(F.count("*").alias("files")).join(symbols.agg(F.count_if("is_exported").alias("exports")), F.lit(True)).join(edges.agg(F.count("*").alias("edges")), F.lit(True))

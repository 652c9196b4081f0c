"""The driver's tables as files, symbols, edges, cases, sessions and runs, so that each operator runs on data of any scale."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    path = F.concat(F.lower("p_type"), F.lit("/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("."), F.col("p_partkey").cast("string"))
    return p.select(
        F.col("p_partkey").alias("id"),
        path.alias("path"),
        F.sha2(path, 256).alias("hash"),
        (F.col("p_retailprice") / 1000).alias("rank"),
        F.col("p_size").cast("long").alias("mtime"),
        F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("Handles "), "p_name")).alias("summary"),
        F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("Modify when changing "), F.lower("p_type"))).alias("when_to_use"),
    )


def edges(spark, sf_dir):
    """An edge from each part of an order to the order's next; order keys are many, so the window is dealt evenly."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_extendedprice")
    kind = F.when(F.col("l_returnflag") == "N", "Import").when(F.col("l_returnflag") == "R", "ReExport").otherwise("TypeImport")
    return read(spark, sf_dir, "lineitem").withColumn("target_id", F.lead("l_partkey").over(w)).where("target_id is not null").select(F.col("l_partkey").alias("source_id"), "target_id", kind.alias("edge_type"), F.col("l_orderkey").cast("string").alias("specifier"))


def symbols(spark, sf_dir):
    per = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("file_id"), "l_suppkey").agg(F.bool_or(F.col("l_linestatus") == "O").alias("is_exported"), F.min("l_returnflag").alias("flag"), F.count("*").alias("ref_count"))
    kind = F.when(F.col("flag") == "A", "Function").when(F.col("flag") == "N", "Class").otherwise("Variable")
    return per.join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("file_id", F.col("s_name").alias("name"), kind.alias("kind"), "is_exported", "ref_count")


def sources(spark, sf_dir):
    """Whole texts by path."""
    return read(spark, sf_dir, "documents").select(F.concat(F.lit("docs/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"), F.col("doc_id").alias("id"))


def code(spark, sf_dir):
    """(path, content): a module of TypeScript per file, made of its import edges and symbols.

    An edge becomes an import or re-export of one name by its type, a symbol a declaration by its kind."""
    target = F.concat(F.lit("./m"), F.col("target_id").cast("string"))
    name = F.concat(F.lit("n"), F.col("specifier"))
    line = F.when(F.col("edge_type") == "Import", F.concat(F.lit("import { "), name, F.lit(" } from '"), target, F.lit("' // import x from 'y'"))).when(F.col("edge_type") == "ReExport", F.concat(F.lit("export { a as "), name, F.lit(" } from \""), target, F.lit('"'))).otherwise(F.concat(F.lit("import * as "), name, F.lit(" from '"), target, F.lit("';")))
    imports = edges(spark, sf_dir).select(F.col("source_id").alias("id"), line.alias("line"))
    n = F.replace("name", F.lit("#"), F.lit("_"))
    declared = F.when(F.col("kind") == "Function", F.concat(F.lit("function "), n, F.lit("(a: string, b = `x${1}`) { return /[{]/ }"))).when(F.col("kind") == "Class", F.concat(F.lit("class "), n, F.lit(" { run() { } }"))).otherwise(F.concat(F.lit("const "), n, F.lit(" = { k: 'export const no = 1' }")))
    body = symbols(spark, sf_dir).select(F.col("file_id").alias("id"), F.concat(F.when(F.col("is_exported"), "export ").otherwise(""), declared).alias("line"))
    lines = imports.unionByName(body).groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("line"), asc=False), "\n").alias("content"))
    return lines.select(F.concat(F.lit("m"), F.col("id").cast("string"), F.lit(".ts")).alias("path"), "content")


def snapshots(spark, sf_dir):
    """(old, new) states of a corpus: some files gone, some new, some changed."""
    d = read(spark, sf_dir, "documents").select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string")).alias("path"), "text", "doc_id")
    old = d.where("doc_id % 10 < 8").select("path", F.sha2("text", 256).alias("hash"), (F.col("doc_id") % 50).alias("mtime"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("about "), F.col("doc_id").cast("string"))).alias("summary"))
    changed = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = d.where("doc_id % 10 > 0").select("path", F.sha2(changed, 256).alias("hash"), (F.col("doc_id") % 50 + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)).alias("mtime"))
    return old, new


def ranked_results(spark, sf_dir):
    """(case_id, path, score, relevance) of a retrieval run: orders ranked within customers, by price, graded by priority."""
    o = read(spark, sf_dir, "orders")
    rel = F.when(F.col("o_orderpriority").startswith("1"), 3).when(F.col("o_orderpriority").startswith("2"), 2).when(F.col("o_orderpriority").startswith("3"), 1).otherwise(0)
    return o.select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").cast("string").alias("path"), F.col("o_totalprice").alias("score"), rel.cast("long").alias("relevance"))


def sessions(spark, sf_dir):
    """(session, line, tool, arg) from events: one session a user, a tool call an event."""
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("line"), F.col("event_type").alias("tool"), F.get_json_object("props", "$.k").cast("long").alias("arg"), "value")


def runs(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 7).alias("git_commit"), F.lit("relevance").alias("layer"), F.col("event_type").alias("dataset"), F.col("value").alias("ndcg"), F.col("props").alias("metrics"))


def variants(spark, sf_dir):
    """(case_id, variant, f1, tools) of paired sessions, one of each variant a case."""
    e = read(spark, sf_dir, "events")
    variant = F.element_at(F.array(F.lit("control"), F.lit("treatment"), F.lit("enriched")), (F.col("event_id") % 3 + 1).cast("int"))
    return e.select(F.floor(F.col("event_id") / 3).cast("long").alias("case_id"), variant.alias("variant"), (F.pmod(F.floor("value"), F.lit(100)) / 100.0).alias("f1"), (F.get_json_object("props", "$.k").cast("long")).alias("tools"))

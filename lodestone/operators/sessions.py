"""Agent-session logs: lines of JSON with tool calls, texts and a result."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

BLOCK = "array<struct<type:string,name:string,text:string,input:struct<file_path:string,command:string>>>"
EVENT = f"type string, result string, usage struct<input_tokens:long,output_tokens:long>, message struct<content:{BLOCK}>, content {BLOCK}"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(session, line, text) of the lines of log files that begin with {; session is the file's path."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("session"), F.posexplode(F.split("value", "\n")).alias("line", "text"))
    return lines.where(F.ltrim("text").startswith("{"))


def blocks(lines: DataFrame) -> DataFrame:
    """(session, line, block, type, name, text, file, turn): content blocks of assistant lines in order; turn counts the tool calls up to each. Lines that are no JSON are left out."""
    e = lines.withColumn("e", F.from_json("text", EVENT)).where("e.type = 'assistant'")
    b = e.select("session", "line", F.posexplode(F.coalesce("e.message.content", "e.content")).alias("block", "b"))
    b = b.select("session", "line", "block", "b.type", "b.name", "b.text", F.col("b.input.file_path").alias("file"), F.col("b.input.command").alias("command"))
    w = W.partitionBy("session").orderBy("line", "block").rowsBetween(W.unboundedPreceding, 0)
    return b.withColumn("turn", F.sum((F.col("type") == "tool_use").cast("int")).over(w))


def tool_counts(calls: DataFrame) -> DataFrame:
    """(session, total, by_tool) from (session, tool): numbers of calls, and a map of them by tool."""
    per = calls.groupBy("session", "tool").agg(F.count("*").alias("n"))
    return per.groupBy("session").agg(F.sum("n").alias("total"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("tool", "n")))).alias("by_tool"))


def first_turn(calls: DataFrame, relevant: Column) -> DataFrame:
    """(session, first_relevant_turn): place of the first relevant call among a session's calls, null if there is none."""
    turned = calls.withColumn("turn", F.row_number().over(W.partitionBy("session").orderBy("line")))
    return turned.groupBy("session").agg(F.min(F.when(relevant, F.col("turn"))).alias("first_relevant_turn"))


def metrics(calls: DataFrame, relevant: Column, hook: Column) -> DataFrame:
    """(session, calls, by_tool, files, first_relevant_turn, hooked) from (session, line, tool, file): one row a session, with its different files in order and whether any call is the hook's."""
    read = calls.groupBy("session").agg(F.sort_array(F.collect_set("file")).alias("files"), F.bool_or(hook).alias("hooked"))
    return tool_counts(calls).withColumnRenamed("total", "calls").join(read, "session").join(first_turn(calls, relevant), "session").select("session", "calls", "by_tool", "files", "first_relevant_turn", "hooked")


#: Names looked for at once, and blocks of names up to which all are sent to every executor.
NAMES, BLOCKS = 10_000, 100


def mentions(texts: DataFrame, names: DataFrame, key: str = "id") -> DataFrame:
    """(key, name) of the names that occur in each text. Names go in blocks of about NAMES; a text meets each block once, not each name."""
    blocks = -(-max(1, names.count()) // NAMES)
    known = names.distinct().groupBy(F.pmod(F.xxhash64("name"), F.lit(blocks)).alias("_b")).agg(F.collect_list("name").alias("_names"))
    known = F.broadcast(known) if blocks <= BLOCKS else known
    return texts.join(known, F.lit(True)).select(key, F.explode(F.filter("_names", lambda n: F.contains(F.col("text"), n))).alias("name"))


def usage(lines: DataFrame) -> DataFrame:
    """(session, input_tokens, output_tokens, result) of the last result line."""
    e = lines.withColumn("e", F.from_json("text", EVENT)).where("e.type = 'result'")
    return e.groupBy("session").agg(F.max_by(F.struct("e.usage.input_tokens", "e.usage.output_tokens", "e.result"), "line").alias("r")).select("session", "r.input_tokens", "r.output_tokens", "r.result")

"""Source trees, datasets, logs and run archives as DataFrames."""

import fnmatch
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.tables import CASES, RUNS, with_missing

GLOB = "*.{ts,tsx,js,jsx,mts,cts,mjs,cjs}"
#: Ignore files that a folder may hold; rules of the later ones, and of deeper folders, win.
IGNORE_FILES = (".gitignore", ".lodestoneignore")


def ignore_rules(text: str) -> list[tuple[str, bool]]:
    """(regular expression over relative paths, is a negation) for the lines of an ignore file, in order."""
    out = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[negated:].removeprefix("\\")
        folder = line.endswith("/")
        body = line.rstrip("/")
        anchored = "/" in body
        parts = body.lstrip("/").split("/")
        regex = ""
        for i, p in enumerate(parts):
            if p == "**":
                regex += "(?:.*/)?" if i < len(parts) - 1 else ".*"
            else:
                regex += fnmatch.translate(p)[4:-3].replace(".*", "[^/]*").replace("(?<![^/]*)", "") + ("/" if i < len(parts) - 1 else "")
        out.append(("^" + ("" if anchored else "(?:.*/)?") + regex + ("/.*" if folder else "(?:/.*)?") + "$", negated))
    return out


def not_ignored(path, rules):
    """Column: the last rule that fits a path decides."""
    keep = F.lit(True)
    for regex, negated in rules:
        keep = F.when(path.rlike(regex), F.lit(negated)).otherwise(keep)
    return keep


def rules_below(root: str, folder: str = "", rules=()) -> list[tuple[str, bool]]:
    """The rules of the ignore files below root, those of deeper folders later. Hidden and ignored folders are not entered; only folders and ignore files are looked at, one listing a folder."""
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(root if "://" in root else f"file://{os.path.abspath(root)}")
    found, own = {i.base_name: i for i in system.get_file_info(fs.FileSelector(f"{base.rstrip('/')}/{folder}".rstrip("/")))}, []
    for name in IGNORE_FILES:
        if name in found and found[name].type == fs.FileType.File:
            with system.open_input_file(found[name].path) as f:
                own += [("^" + re.escape(folder) + regex.removeprefix("^"), negated) for regex, negated in ignore_rules(f.read().decode("utf-8", "replace"))]
    out = [*own]
    for name, info in sorted(found.items()):
        path = f"{folder}{name}"
        last = [negated for regex, negated in [*rules, *own] if re.match(regex, f"{path}/x")]
        if info.type == fs.FileType.Directory and not name.startswith(".") and (not last or last[-1]):
            out += rules_below(root, f"{path}/", [*rules, *own])
    return out


def scan(spark: SparkSession, root: str, ignore: str = "", extra_ignore: str = "", rules=(), unreadable: bool = False) -> DataFrame:
    """(path, content, hash, mtime, length) of the sources below root: hidden and ignored ones are left out, and those that are no UTF-8, unless unreadable asks for them without content.

    ignore is looked at after rules, and extra_ignore after that. Only rows that pass by path and time have their content decoded."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", GLOB).load(root)
    base = root.rstrip("/")
    full = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    path = F.regexp_replace(full, "^" + re.escape(re.sub(r"^[a-z]+:/+", "/", base)) + "/", "")
    kept = files.withColumn("path", path).where(~F.col("path").rlike(r"(^|/)\.") & not_ignored(F.col("path"), [*rules, *ignore_rules(ignore), *ignore_rules(extra_ignore)]))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    rows = kept.select("path", text.alias("content"), F.sha2("content", 256).alias("hash"), F.unix_seconds("modificationTime").alias("mtime"), "length")
    return rows if unreadable else rows.where("content is not null")


def is_ignored(text: str, folder: str) -> bool:
    """Whether an ignore file lists a folder in one of its four spellings."""
    return any(line.strip() in (folder, f"{folder}/", f"/{folder}", f"/{folder}/") for line in text.splitlines())


def fixture(spark: SparkSession, root: str):
    """The tables of an index, or None where there is none."""
    from lodestone.operators.index import open_index

    try:
        return open_index(spark, root)
    except FileNotFoundError:
        return None


def datasets(spark: SparkSession, path: str) -> DataFrame:
    """Graded cases, one row an expected path: (repo, language, case_id, query, path, relevance)."""
    d = spark.read.schema(CASES).json(path, multiLine=True)
    c = d.select("repo", F.coalesce("repo_url", F.lit("")).alias("repo_url"), F.coalesce("language", F.lit("typescript")).alias("language"), F.explode("cases").alias("c"))
    return c.select("repo", "repo_url", "language", F.col("c.id").alias("case_id"), F.col("c.query").alias("query"), F.explode_outer("c.expected_files").alias("e")).select("repo", "repo_url", "language", "case_id", "query", "e.path", "e.relevance")


def save_run(runs: DataFrame, path: str) -> None:
    """Appends runs to an archive."""
    with_missing(runs, RUNS).write.mode("append").parquet(path)


def load_runs(spark: SparkSession, path: str) -> DataFrame:
    return with_missing(spark.read.option("mergeSchema", True).parquet(path), RUNS)

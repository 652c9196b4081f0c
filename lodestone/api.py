"""The engine's commands over an index folder: index, map, symbol, context, deps, enrich and the evaluation ones."""

import datetime
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import enrich, evaluate, extract, graph, index, lookup, relevance, report, resolve
from lodestone.sources import corpus
from lodestone.tables import cut

FOLDER = ".lodestone"


class Engine:
    """An index of the sources below root, kept in `at` (a folder in root by default)."""

    def __init__(self, spark: SparkSession, root: str, at: str | None = None, ignore: str = "", rules=None):
        self.spark, self.root, self.at, self.ignore, self.rules = spark, root, at or f"{root.rstrip('/')}/{FOLDER}/index", ignore, rules

    def tables(self) -> dict:
        return index.open_index(self.spark, self.at)

    def sources(self, unreadable: bool = False) -> DataFrame:
        """The source files that no ignore file below the root leaves out, nor the engine's own rules."""
        return corpus.scan(self.spark, self.root, self.ignore, rules=corpus.rules_below(self.root), unreadable=unreadable)

    def _parse(self, changed: DataFrame):
        parsed = cut(extract.parse_sources(changed.select("path", "content")))
        paths = self.sources().select("path")
        good = parsed.where("not failed")
        return extract.symbol_rows(good), resolve.import_edges(extract.import_rows(good), extract.reexport_rows(good), paths, self.rules), parsed.where("failed").select("path")

    def index(self, force: bool = False, incremental: bool = False, compat: bool = True) -> dict:
        """Brings the index up to date; returns its figures."""
        try:
            old = self.tables()
        except FileNotFoundError:
            old = {
                "files": self.spark.createDataFrame([], "id long, path string, hash string, rank double, mtime long, summary string, when_to_use string"),
                "symbols": self.spark.createDataFrame([], "file_id long, name string, kind string, is_exported boolean, ref_count long"),
                "edges": self.spark.createDataFrame([], "source_id long, target_id long, edge_type string, specifier string"),
            }
        disk = self.sources(unreadable=True)
        if not disk.isEmpty():
            index.publish(index.reindex(old, disk, self._parse, incremental, force, compat), self.at)
        t = self.tables()
        return relevance.index_stats(t["files"], t["symbols"], t["edges"]).first().asDict()

    def signatures(self) -> DataFrame:
        """(id, signatures) of the files as they are now."""
        ids = self.tables()["files"].select("id", "path")
        return extract.parse_sources(self.sources().select("path", "content")).join(ids, "path").select("id", F.coalesce("signatures", F.array().cast("array<string>")).alias("signatures"))

    def map(self, tokens: int = 1500, footer: str = "") -> str:
        t = self.tables()
        return relevance.map_text(t["files"], t["symbols"], t["edges"], self.signatures(), tokens, footer)

    def symbol(self, pattern: str, limit: int = 10, all_: bool = False, exact: bool = False) -> list[dict]:
        t = self.tables()
        return report.symbol_documents(lookup.symbol_detail(t["files"], t["symbols"], t["edges"], pattern, None if all_ else limit, exact, self.signatures()))

    def context(self, query: str, limit: int = 10, content: bool = False) -> dict:
        t = self.tables()
        top = relevance.context(t["files"], t["symbols"], t["edges"], query, limit, self.sources() if content else None)
        return report.context_document(query, top)

    def deps(self, file: str, direction: str = "both", depth: int = 1) -> dict:
        from lodestone.functions.text import query_path

        t = self.tables()
        path = self.spark.range(1).select(query_path(F.lit(file), self.root).alias("p")).first()["p"]
        return report.deps_document(graph.deps(t["files"], t["edges"], path, direction, depth), path)

    def described(self) -> DataFrame:
        t = self.tables()
        return relevance.file_exports(t["files"], t["symbols"])

    def enrich_stats(self) -> dict:
        return enrich.coverage(self.tables()["files"]).first().asDict()

    def enrich_list(self, top: int | None = None) -> list[dict]:
        return [{"path": r["path"], "rank": r["rank"], "exports": r["exports"]} for r in enrich.unenriched(self.described(), top).collect()]

    def enrich_cost(self, provider: str = "gemini", batch: bool = False, top: int | None = None, force: bool = False) -> dict:
        return enrich.cost(enrich.unenriched(self.described(), top, force), provider, batch).first().asDict()

    def _put(self, files: DataFrame):
        t = self.tables()
        index.publish({"files": files.select(*t["files"].columns), "symbols": t["symbols"], "edges": t["edges"]}, self.at)

    def enrich_set(self, path: str, summary: str | None, when_to_use: str | None) -> None:
        if not summary and not when_to_use:
            raise ValueError("a summary or a use is needed")
        self._put(index.set_texts(self.tables()["files"], self.spark.createDataFrame([(path, summary, when_to_use)], "path string, summary string, when_to_use string")))

    def enrich_clear(self, path: str | None = None) -> int:
        files = self.tables()["files"]
        n = files.where("summary is not null" if path is None else F.col("path") == path).count()
        self._put(index.clear_texts(files, path))
        return n

    def enrich(self, provider: enrich.Provider, top: int | None = None, force: bool = False, concurrency: int = 4) -> dict:
        """Asks a provider about the files without texts and keeps its replies."""
        replies = cut(enrich.describe(enrich.prompts(enrich.unenriched(self.described(), top, force)), provider, concurrency))
        files, counts = enrich.apply_replies(self.tables()["files"], replies)
        self._put(files)
        return counts.first().asDict()

    def evaluate(self, dataset: str, archive: str | None = None, commit: str = "") -> dict:
        """Metrics of ranking for each case of a dataset file, with their means; kept in an archive if one is named."""
        t = self.tables()
        cases = corpus.datasets(self.spark, dataset)
        per = cut(evaluate.score_dataset(t["files"], t["symbols"], t["edges"], cases.withColumn("relevance", F.col("relevance").cast("long"))))
        means = evaluate.macro(per).first().asDict()
        name = cases.select("repo", "language").first()
        if archive:
            now = datetime.datetime.now(datetime.UTC)
            row = (int(now.timestamp() * 1e6), commit, None, now.isoformat(timespec="seconds"), "relevance", name["repo"], name["language"], json.dumps(means), None)
            corpus.save_run(self.spark.createDataFrame([row], "id long, git_commit string, git_dirty boolean, timestamp string, layer string, dataset string, language string, metrics string, config string"), archive)
        return {"dataset": name["repo"], "language": name["language"], "git_commit": commit, "aggregate": means, "cases": [r.asDict() for r in per.orderBy("case_id").collect()]}

    def history(self, archive: str, limit: int = 20, dataset: str | None = None) -> DataFrame:
        runs = corpus.load_runs(self.spark, archive)
        runs = runs if dataset is None else runs.where(F.col("dataset") == dataset)
        return runs.orderBy(F.desc("id")).limit(limit).select("id", "git_commit", F.substring("timestamp", 1, 10).alias("date"), "dataset", evaluate.json_number("metrics", "$.ndcg_at_10").alias("ndcg"), evaluate.json_number("metrics", "$.mrr").alias("mrr"))

    def compare(self, archive: str, dataset: str, against: str) -> DataFrame:
        """The dataset's metrics now against those of the latest run of a commit."""
        now = self.evaluate(dataset)
        before = evaluate.latest_runs(corpus.load_runs(self.spark, archive), against).select("dataset", evaluate.json_number("metrics", "$.ndcg_at_10").alias("ndcg"))
        return evaluate.compare_runs(before, self.spark.createDataFrame([(now["dataset"], now["aggregate"]["ndcg_at_10"])], "dataset string, ndcg double"))

import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import extract, index, lookup, relevance, resolve
from lodestone.sources import corpus
from lodestone.streaming import incremental


def write(root, files):
    for name, text in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())


TREE = {
    "index.ts": "import {help} from './utils'\nimport {User} from './types'\nexport function main() { help() }\nexport const VERSION = '1'\n",
    "utils.ts": "import type {User} from './types'\nexport function help() {}\nexport function other() {}\n",
    "types.ts": "export interface User { id: string }\nexport type Id = string\nexport enum Role { Admin }\n",
    "node_modules/x/y.ts": "export const no = 1",
    ".hidden/z.ts": "export const no = 1",
    "notes.md": "no",
    "bad.ts": b"\xff\xfe\xff",
}


def parse(changed):
    from lodestone.tables import cut

    p = cut(extract.parse_sources(changed.select("path", "content")))
    edges = resolve.import_edges(extract.import_rows(p), extract.reexport_rows(p), changed.select("path").union(p.select("path")))
    return extract.symbol_rows(p), edges


def empty_state(spark):
    return {
        "files": spark.createDataFrame([], "id long, path string, hash string, rank double, mtime long, summary string, when_to_use string"),
        "symbols": spark.createDataFrame([], "file_id long, name string, kind string, is_exported boolean, ref_count long"),
        "edges": spark.createDataFrame([], "source_id long, target_id long, edge_type string, specifier string"),
    }


def test_scan(spark, tmp_path):
    write(tmp_path, TREE)
    got = corpus.scan(spark, str(tmp_path), "node_modules/\n")
    assert {r["path"] for r in got.collect()} == {"index.ts", "utils.ts", "types.ts"}


@pytest.mark.parametrize(
    "rules, path, kept",
    [("*.log", "a/b.log", False), ("/top.ts", "a/top.ts", True), ("/top.ts", "top.ts", False), ("dist/", "dist/a.ts", False), ("a/**/c.ts", "a/b/x/c.ts", False), ("*.ts\n!keep.ts", "x/keep.ts", True), ("# no\n\n", "no", True), ("gen?.ts", "gen1.ts", False)],
)
def test_ignore_rules(spark, rules, path, kept):
    df = spark.createDataFrame([(path,)], "path string")
    assert df.select(corpus.not_ignored(F.col("path"), corpus.ignore_rules(rules)).alias("k")).first()["k"] is kept


def test_index_end_to_end(spark, tmp_path):
    write(tmp_path / "src", TREE)
    disk = corpus.scan(spark, str(tmp_path / "src"), "node_modules/")
    state = index.reindex(empty_state(spark), disk, parse)
    root = str(tmp_path / "index")
    index.publish(state, root)
    got = index.open_index(spark, root)
    stats = relevance.index_stats(got["files"], got["symbols"], got["edges"]).first()
    assert (stats["files"], stats["exports"], stats["edges"]) == (3, 7, 3)
    rank = {r["path"]: r["rank"] for r in got["files"].collect()}
    assert [rank[p] for p in ("index.ts", "utils.ts", "types.ts")] == pytest.approx([0.585095, 1.319196, 3.165169], abs=1e-5)
    names = lookup.symbol_detail(got["files"], got["symbols"], got["edges"], "User", exact=True).collect()
    assert names[0]["total_references"] == 2
    top = relevance.context(got["files"], got["symbols"], got["edges"], "where is help").collect()
    assert top[0]["path"] == "index.ts" or top[0]["path"] == "utils.ts"
    with pytest.raises(ValueError):
        relevance.context(got["files"], got["symbols"], got["edges"], "the of and")
    # nothing changed: the state stays; a file goes: its rows go at either end
    again = index.reindex(got, disk, parse)
    assert again["edges"].count() == 3
    (tmp_path / "src/types.ts").unlink()
    less = index.reindex(got, corpus.scan(spark, str(tmp_path / "src"), "node_modules/"), parse)
    assert {r["path"] for r in less["files"].collect()} == {"index.ts", "utils.ts"} and less["edges"].count() == 1


def test_missing_index(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        index.open_index(spark, str(tmp_path / "none"))


def test_map_fits_its_budget(spark, tmp_path):
    files = spark.createDataFrame([(i, f"f{i}.ts", 1.0 / (i + 1), None, "é" * i) for i in range(40)], "id long, path string, rank double, summary string, when_to_use string")
    edges = spark.createDataFrame([(i, 0, "Import", "x") for i in range(1, 8)], "source_id long, target_id long, edge_type string, specifier string")
    symbols = spark.createDataFrame([], "file_id long, name string, kind string, is_exported boolean, ref_count long")
    signs = files.select("id", F.array(F.lit("function f()")).alias("signatures"))
    text = relevance.map_text(files, symbols, edges, signs, tokens=200, footer="end\n")
    assert len(text.encode()) <= 800 and "f0.ts [rank: 1.00 | 7 importers]" in text and text.endswith("end\n")


def test_upsert_rules(spark):
    old = spark.createDataFrame([("a", "1", 1, "s"), ("b", "1", 1, "s"), ("c", "1", 1, "s")], "path string, hash string, mtime long, summary string")
    new = spark.createDataFrame([("a", "1", 2), ("b", "2", 2), ("d", "3", 2)], "path string, hash string, mtime long")
    got = {r["path"]: (r["hash"], r["mtime"], r["summary"]) for r in index.upsert_files(old, new).collect()}
    assert got == {"a": ("1", 2, "s"), "b": ("2", 2, None), "c": ("1", 1, "s"), "d": ("3", 2, None)}
    assert index.delete_stale(old, new.where("false")).count() == 0
    status = {r["path"]: r["status"] for r in index.detect_changes(new, old, force=True).collect()}
    assert set(status.values()) == {"changed"}


def test_unknown_paths_are_errors(spark):
    f = spark.createDataFrame([("a", None, None)], "path string, summary string, when_to_use string")
    with pytest.raises(LookupError):
        index.clear_texts(f, "b")
    with pytest.raises(LookupError):
        index.set_texts(f, f.withColumn("path", F.lit("b")))


def test_resolution_order(spark):
    paths = spark.createDataFrame([("src/a.ts",), ("src/a/index.ts",), ("src/b/index.js",), ("lib/c.tsx",), ("src/d.ts",), ("src/d.js",)], "path string")
    asked = [("src/m.ts", "./a"), ("src/m.ts", "./b"), ("src/m.ts", "./d.js"), ("src/x/m.ts", "../a"), ("src/m.ts", "react"), ("src/m.ts", "@lib/c"), ("src/m.ts", "../../up")]
    got = resolve.resolve(spark.createDataFrame(asked, "path string, specifier string"), paths, [("@lib/", "lib")])
    assert {(r["path"], r["specifier"]): r["target"] for r in got.collect()} == {("src/m.ts", "./a"): "src/a.ts", ("src/m.ts", "./b"): "src/b/index.js", ("src/m.ts", "./d.js"): "src/d.ts", ("src/x/m.ts", "../a"): "src/a.ts", ("src/m.ts", "@lib/c"): "lib/c.tsx"}


def test_datasets_and_runs(spark, tmp_path):
    doc = {"repo": "r", "cases": [{"id": "1", "query": "q", "expected_files": [{"path": "a", "relevance": 3}]}, {"id": "2", "query": "z", "expected_files": []}]}
    (tmp_path / "d.json").write_text(json.dumps(doc))
    rows = corpus.datasets(spark, str(tmp_path / "d.json")).collect()
    assert len(rows) == 2 and rows[0]["language"] == "typescript"
    runs = spark.createDataFrame([(1, "abc", "relevance", "d", "{}")], "id long, git_commit string, layer string, dataset string, metrics string")
    corpus.save_run(runs, str(tmp_path / "runs"))
    corpus.save_run(runs.withColumn("id", F.lit(2).cast("long")), str(tmp_path / "runs"))
    assert corpus.load_runs(spark, str(tmp_path / "runs")).count() == 2


def test_stream_of_versions(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("a", "1", 1), ("b", "1", 1)], "path string, hash string, mtime long").write.mode("append").parquet(str(src))
    stream = lambda: spark.readStream.schema("path string, hash string, mtime long").parquet(str(src))
    run = lambda: incremental.index_stream(stream(), str(tmp_path / "out"), str(tmp_path / "cp")).start().awaitTermination()
    run()
    spark.createDataFrame([("a", "2", 5), ("a", "0", 0), ("b", "9", 0)], "path string, hash string, mtime long").write.mode("append").parquet(str(src))
    run()
    last = max(p.name for p in (tmp_path / "out").iterdir() if p.name.isdigit())
    assert {(r["path"], r["hash"]) for r in spark.read.parquet(str(tmp_path / "out" / last)).collect()} == {("a", "2"), ("b", "1")}


def test_windows_over_events(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.limit(200).coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    for i, df in enumerate((incremental.windowed_counts(stream), incremental.sessions(stream))):
        q = df.writeStream.format("memory").queryName(f"w{i}").outputMode("append" if i else "append").start()
        q.processAllAvailable()
        q.stop()
        assert spark.table(f"w{i}").count() > 0


def _disk(spark, *rows):
    """Rows of (path, content, mtime); the content is its own hash."""
    return spark.createDataFrame([(p, c, c, t) for p, c, t in rows], "path string, content string, hash string, mtime long")


def _parse(todo):
    """A symbol a file, named as its content; each imports a.ts; contents with ! fail."""
    good = todo.where("content not like '%!%'")
    symbols = good.select("path", F.col("content").alias("name"), F.lit("Function").alias("kind"), F.lit(True).alias("is_exported"), F.lit(1).cast("long").alias("ref_count"))
    edges = good.where("path <> 'a.ts'").select(F.col("path").alias("source"), F.lit("a.ts").alias("target"), F.lit("Import").alias("edge_type"), F.col("content").alias("specifier"))
    return symbols, edges, todo.where("content like '%!%'").select("path")


def test_reindex_keeps_real_times(spark):
    times = lambda t: {r["path"]: (r["hash"], r["mtime"]) for r in t["files"].collect()}
    one = index.reindex(empty_state(spark), _disk(spark, ("a.ts", "h1", 100), ("b.ts", "k1", 100)), _parse)
    two = index.reindex(one, _disk(spark, ("a.ts", "h2", 50), ("b.ts", "k1", 100)), _parse, incremental=False)
    assert times(two) == {"a.ts": ("h2", 50), "b.ts": ("k1", 100)}  # an older time of other content is stored as it is
    three = index.reindex(two, _disk(spark, ("a.ts", "h3", 80), ("b.ts", "k1", 120)), _parse)
    assert times(three) == {"a.ts": ("h3", 80), "b.ts": ("k1", 120)}
    # nothing changed: touched files take their new times in incremental mode only
    touched = _disk(spark, ("a.ts", "h3", 90), ("b.ts", "k1", 130))
    assert times(index.reindex(three, touched, _parse, incremental=False)) == times(three)
    assert times(index.reindex(three, touched, _parse)) == {"a.ts": ("h3", 90), "b.ts": ("k1", 130)}


def test_reindex_keeps_what_can_not_be_read_or_parsed(spark):
    one = index.reindex(empty_state(spark), _disk(spark, ("a.ts", "h1", 1), ("b.ts", "k1", 1), ("c.ts", "c1", 1)), _parse)
    names = lambda t: sorted(r["name"] for r in t["symbols"].collect())
    marks = lambda t: sorted(r["specifier"] for r in t["edges"].collect())
    two = index.reindex(one, _disk(spark, ("a.ts", "h2", 2), ("b.ts", None, 2), ("c.ts", "c!", 2)), _parse)
    assert names(two) == ["c1", "h2", "k1"] and marks(two) == ["c1", "k1"]
    got = {r["path"]: (r["hash"], r["mtime"]) for r in two["files"].collect()}
    assert got == {"a.ts": ("h2", 2), "b.ts": ("k1", 1), "c.ts": ("c!", 2)}
    three = index.reindex(two, _disk(spark, ("a.ts", "h2", 2), ("c.ts", "c!", 2)), _parse)  # gone from the disk
    assert names(three) == ["c1", "h2"] and marks(three) == ["c1"]


def test_ignore_files_of_folders(spark, tmp_path):
    files = {".gitignore": "node_modules/\n*.gen.ts\n", ".lodestoneignore": "old\n", "a.ts": "export const a = 1", "x.gen.ts": "", "node_modules/p/i.js": "", "node_modules/.gitignore": "!*", "sub/.gitignore": "!keep.gen.ts\n/only.ts\n", "sub/keep.gen.ts": "", "sub/only.ts": "", "sub/deep/only.ts": "", "old/o.ts": "", ".hidden/h.ts": ""}
    for name, text in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text or "export const z = 1")
    from lodestone.api import Engine

    e = Engine(spark, str(tmp_path))
    assert sorted(r["path"] for r in e.sources().select("path").collect()) == ["a.ts", "sub/deep/only.ts", "sub/keep.gen.ts"]
    e.index()
    assert e.tables()["files"].count() == 3


def test_resolution_by_forms(spark):
    """All forms of all bases tried one by one, as the definition says; the paths are expanded, not the imports."""
    import itertools
    import posixpath

    stems = ["a", "a/b", "index", "a/index", "a.js", "a/b.mjs", "a/index.js"]
    paths = [s + e for s in stems for e in ["", *resolve.EXTENSIONS, ".mts"]] + ["a/index.tsx", ".ts", "a/.js"]
    specifiers = ["./" + s + e for s in stems for e in ("", ".js", ".mjs", ".ts")] + [".", "..", "../a", "../..", "./", "a", "/a", None]

    def target(path, spec, there):
        if spec is None or not (spec in (".", "..") or spec.startswith(("./", "../"))):
            return None
        whole = posixpath.normpath(posixpath.join("/x/y/z", posixpath.dirname(path), spec))
        depth = posixpath.dirname(path).count("/") + bool(posixpath.dirname(path))
        if spec.split("/").count("..") > depth:
            return None
        base = whole.removeprefix("/x/y/z").lstrip("/")
        forms = [base[: -len(o)] + n for o, ns in resolve.ALIASES.items() for n in ns if base.endswith(o)]
        forms += [base, *(base + e for e in resolve.EXTENSIONS), *(base + ("/" if base else "") + "index" + e for e in resolve.EXTENSIONS)]
        return next((f for f in forms if f in there), None)

    for some in (paths, paths[1::2], paths[::3]):
        asked = list(itertools.product(["m.ts", "a/n.ts"], specifiers))
        got = resolve.resolve(spark.createDataFrame([(*x, 1) for x in asked] * 2, "path string, specifier string, n int"), spark.createDataFrame([(p,) for p in some], "path string"))
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Generate") == 1 and plan.count("Join") == 1
        want = [(p, s, t) for p, s in asked if (t := target(p, s, set(some))) is not None]
        assert sorted((r["path"], r["specifier"], r["target"]) for r in got.collect()) == sorted(want * 2)

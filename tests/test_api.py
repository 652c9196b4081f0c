import json

import pytest

from lodestone import __main__ as cli
from lodestone.api import Engine
from lodestone.operators import enrich, report
from tests.test_states import TREE, write


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    write(root, TREE)
    e = Engine(spark, str(root), ignore="node_modules/")
    with pytest.raises(FileNotFoundError):
        e.map()
    assert e.index() == {"files": 3, "exports": 7, "edges": 3}
    return e


def say(engine, *argv):
    return cli.run(engine, cli.parser().parse_args(list(argv)))


def test_index_again(engine):
    assert engine.index(incremental=True)["edges"] == 3 and engine.index(force=True)["edges"] == 3


def test_map(engine):
    text = engine.map(400)
    assert "types.ts [rank: 3.17 | 2 importers]" in text and "  export interface User" in text and "→ imports: types.ts, utils.ts" in text
    assert len(engine.map(60).encode()) <= 240


def test_symbol(engine):
    doc = json.loads(say(engine, "symbol", "help", "--json"))
    assert doc[0]["definitions"][0]["file"] == "index.ts" or doc[0]["total_references"] >= 0
    by_file = {d["file"]: d for d in doc[0]["definitions"]}
    assert by_file["utils.ts"]["signature"] == "export function help()" and by_file["utils.ts"]["exported"]
    assert doc[0]["referenced_in"] == ["index.ts"]
    assert json.loads(say(engine, "symbol", "nothing", "--json")) == [] and say(engine, "symbol", "nothing") == "no symbol found"


def test_deps(engine):
    doc = json.loads(say(engine, "deps", "./index.ts", "--depth", "2", "--json"))
    assert sorted((x["file"], x["depth"]) for x in doc["imports"]) == [("types.ts", 1), ("types.ts", 2), ("utils.ts", 1)] and doc["total_importers"] == 0
    assert "importers (2)" in say(engine, "deps", "types.ts")
    with pytest.raises(LookupError):
        say(engine, "deps", "none.ts")


def test_context(engine):
    doc = json.loads(say(engine, "context", "the help function", "--json", "--include-content"))
    assert doc["results"][0]["path"] in ("index.ts", "utils.ts") and "content" in doc["results"][0]
    assert say(engine, "context", "zzz") == "no file found"
    with pytest.raises(ValueError):
        say(engine, "context", "of the")


def test_enrichment_commands(engine):
    assert json.loads(say(engine, "enrich"))["unenriched_files"] == 3
    say(engine, "enrich", "--set", "utils.ts", "--summary", "Helps")
    assert [r["path"] for r in json.loads(say(engine, "enrich", "--list"))] == ["types.ts", "index.ts"]
    assert json.loads(say(engine, "enrich", "--offline")) == {"enriched": 2, "failed": 0}
    assert engine.enrich_stats()["pct"] == 100
    engine.index(force=True)
    assert engine.enrich_stats()["pct"] == 100  # equal content keeps its texts
    assert json.loads(say(engine, "enrich", "--clear", "utils.ts")) == {"cleared": 1}
    assert json.loads(say(engine, "enrich", "--clear-all")) == {"cleared": 2}
    assert engine.enrich_cost()["files"] == 3
    with pytest.raises(ValueError):
        engine.enrich_set("utils.ts", None, None)
    with pytest.raises(LookupError):
        engine.enrich_set("none.ts", "s", None)


def test_evaluation_commands(engine, tmp_path):
    doc = {"repo": "tree", "language": "ts", "cases": [{"id": "1", "query": "types of a user", "expected_files": [{"path": "types.ts", "relevance": 3}]}, {"id": "2", "query": "the of", "expected_files": [{"path": "types.ts", "relevance": 1}]}]}
    (tmp_path / "d.json").write_text(json.dumps(doc))
    got = engine.evaluate(str(tmp_path / "d.json"), str(tmp_path / "runs"), "abc123")
    assert got["aggregate"]["cases"] == 1 and got["aggregate"]["mrr"] == 1
    assert engine.history(str(tmp_path / "runs")).first()["ndcg"] == 1
    assert engine.compare(str(tmp_path / "runs"), str(tmp_path / "d.json"), "ABC").first()["delta"] == 0


def test_reports(spark):
    pairs = spark.createDataFrame([(1, "control", 0.5, 10), (1, "treatment", 0.9, 10), (2, "control", 0.5, 3), (2, "treatment", 0.5, 2)], "case_id long, variant string, f1 double, tools long")
    text = report.comparison_markdown(pairs)
    assert "| 2 | 0 | 0 | 0.500 |" in text and "| treatment | 2 |" in text
    assert report.more(list("abcdefg")) == "a, b, c, d, e (+2 more)"
    assert enrich.Offline().describe([{"path": "p", "prompt": ""}])[0]["summary"] == "File p"

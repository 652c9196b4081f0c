import json
import math

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.functions.text import keywords
from lodestone.operators import enrich, evaluate, sessions


def case(spark, relevances):
    return spark.createDataFrame([(1, f"p{i:02}", float(-i), r) for i, r in enumerate(relevances)], "case_id long, path string, score double, relevance long")


def test_metrics(spark):
    m = evaluate.case_metrics(case(spark, [0, 3, 0, 1])).first()
    assert (m["p_at_5"], m["r_at_5"], m["mrr"]) == (0.5, 1.0, 0.5)
    assert evaluate.case_metrics(case(spark, [3, 2, 1])).first()["ndcg_at_10"] == pytest.approx(1)
    assert evaluate.case_metrics(case(spark, [1, 2, 3])).first()["ndcg_at_10"] < 1
    expected = spark.createDataFrame([(1, "p00", 2), (1, "zz", 3), (2, "q", 1)], "case_id long, path string, relevance long")
    got = {r["case_id"]: r for r in evaluate.case_metrics(case(spark, [0, 0]).drop("relevance"), expected).collect()}
    assert got[1]["r_at_5"] == 0.5 and got[2]["mrr"] == 0


def test_macro_of_nothing(spark):
    m = evaluate.macro(evaluate.case_metrics(case(spark, [1])).where("false")).first()
    assert m["cases"] == 0 and m["mrr"] == 0


@pytest.mark.parametrize("a, b", [(0, 0), (1, 0), (10, 8), (9, 11), (14, 11), (200, 150), (3, 0)])
def test_sign_test(spark, a, b):
    n, m = a + b, min(a, b)
    want = 1.0 if not n else min(1.0, 2 * sum(math.comb(n, i) for i in range(m + 1)) / 2**n)
    got = spark.range(1).select(evaluate.sign_test(F.lit(a).cast("long"), F.lit(b).cast("long")).alias("p")).first()["p"]
    assert got == pytest.approx(want, rel=1e-9)


def test_winner_rules(spark):
    rows = [(1, "a", 0.5, 10), (1, "b", 0.505, 12), (2, "a", 0.9, 9), (2, "b", 0.1, 1), (3, "a", 0.2, 1), (4, "a", 0.5, 3), (4, "b", 0.5, 4)]
    w = {r["case_id"]: r["winner"] for r in evaluate.winners(spark.createDataFrame(rows, "case_id long, variant string, f1 double, tools long")).collect()}
    assert w == {1: "tie", 2: "a", 3: "a", 4: "a"}


def test_lists(spark):
    df = spark.createDataFrame([('x {"relevant_files": ["a", "a", "b"]} y',), ("none",)], "t string")
    got = [r["l"] for r in df.select(evaluate.identified(F.col("t")).alias("l")).collect()]
    assert got[0] == ["a", "a", "b"] and not got[1]


def test_keywords(spark):
    q = lambda s: spark.range(1).select(text.keywords(s).alias("k")).first()["k"]
    assert q("the of AND") == [] and q("Fix fix, (the) Parser!  ünï-code") == ["fix", "parser", "ünï-code"] and q("") == []


@pytest.mark.parametrize("s", ["", "abc", "é" * 80, "a" + "😀" * 40, "x" * 99 + "é", "x" * 98 + "中中"])
def test_truncation(spark, s):
    got = spark.createDataFrame([(s,)], "s string").select(text.truncated(F.col("s"), 100).alias("t")).first()["t"]
    assert got == s.encode()[:100].decode(errors="ignore")


def test_like(spark):
    df = spark.createDataFrame([("useState",), ("use_state",), ("a\\b",)], "n string")
    names = lambda p: {r["n"] for r in df.where(text.like_anywhere(F.col("n"), p)).collect()}
    assert names("STATE") == {"useState", "use_state"} and names("e_s") == {"use_state"} and names("\\") == {"a\\b"}


def test_session_log(spark, tmp_path):
    lines = [
        {"type": "system"},
        {"type": "assistant", "message": {"content": [{"type": "text", "text": "see a.ts"}, {"type": "tool_use", "name": "Read", "input": {"file_path": "/r/a.ts"}}]}},
        {"type": "assistant", "content": [{"type": "tool_use", "name": "Bash", "input": {"command": "ls"}}]},
        {"type": "result", "result": "done", "usage": {"input_tokens": 5, "output_tokens": 7}},
    ]
    (tmp_path / "s.log").write_text("noise\n{broken\n" + "\n".join(map(json.dumps, lines)))
    log = sessions.read_log(spark, str(tmp_path / "s.log"))
    b = sessions.blocks(log).orderBy("line", "block").collect()
    assert [(r["type"], r["turn"]) for r in b] == [("text", 0), ("tool_use", 1), ("tool_use", 2)]
    u = sessions.usage(log).first()
    assert (u["input_tokens"], u["output_tokens"], u["result"]) == (5, 7, "done")


def test_enrichment(spark):
    files = spark.createDataFrame([("a.ts", 1.0, None, None, ["x", "yy"]), ("b.js", 2.0, "s", "w", [])], "path string, rank double, summary string, when_to_use string, exports array<string>")
    c = enrich.coverage(files).first()
    assert (c["total_files"], c["enriched_files"], c["pct"]) == (2, 1, 50.0)
    assert enrich.coverage(files.where("false")).first()["pct"] == 0
    assert enrich.cost(files.where("path = 'a.ts'")).first()["chars"] == 200 + 4 + 1 + 4 + 2 + 4
    p = {r["path"]: r["prompt"] for r in enrich.prompts(files).collect()}
    assert "TypeScript" in p["a.ts"] and "Exports: x, yy" in p["a.ts"] and "Exports" not in p["b.js"]

    class Half:
        def describe(self, requests):
            return [{"error": "no"} if r["path"] == "b.js" else {"summary": "S", "when_to_use": "W"} for r in requests]

    done, counts = enrich.apply_replies(files, enrich.describe(enrich.prompts(files), Half()))
    assert counts.first()["failed"] == 1 and done.where("path = 'a.ts'").first()["summary"] == "S" and done.where("path = 'b.js'").first()["summary"] == "s"


def test_replies():
    good = '{"summary": "a", "when_to_use": "b"}'
    assert enrich.parse_reply(good) == {"summary": "a", "when_to_use": "b"}
    wrapped = lambda why: json.dumps({"candidates": [{"finishReason": why, "content": {"parts": [{"text": good}]}}]})
    assert enrich.parse_reply(wrapped("STOP"))["summary"] == "a"
    for bad in (wrapped("MAX_TOKENS"), '{"summary": 1}', "[]"):
        with pytest.raises(ValueError):
            enrich.parse_reply(bad)


def test_retries_and_pace():
    waits, answers = [], [(429, 100.0, None), (503, None, None), (200, None, "ok")]
    assert enrich.retrying(lambda: answers.pop(0), sleep=waits.append) == "ok" and waits == [60.0, 1.0]
    with pytest.raises(RuntimeError):
        enrich.retrying(lambda: (404, None, None), sleep=waits.append)
    now, slept = [0.0], []
    limiter = enrich.Limiter(0.2, clock=lambda: now[0], sleep=slept.append)
    limiter.wait()
    limiter.wait()
    assert slept == [0.2]
    with pytest.raises(ValueError):
        enrich.provider_name("other", None, {})
    ticks, left = [0.0], [None, None, "done"]
    pause = lambda t: ticks.__setitem__(0, ticks[0] + t)
    assert enrich.poll(lambda: left.pop(0), clock=lambda: ticks[0], sleep=pause) == "done" and ticks == [12.5]
    with pytest.raises(TimeoutError):
        enrich.poll(lambda: None, clock=lambda: ticks[0], sleep=pause)
    assert [json.loads(t)["a"] for t in enrich.batch_texts({"response": {"inlinedResponses": [{"response": {"a": 1}}, {"a": 2}]}})] == [1, 2]
    assert enrich.provider_name(None, "k", {}) == ("gemini", "k")


def test_score_dataset_finds_places_without_lists_of_results(spark, monkeypatch):
    import random

    from lodestone.operators import relevance

    rng = random.Random(7)
    words = ["red", "ring", "bolt", "old", "hot", "lock"]
    name = lambda i: f"{rng.choice(words)}/{rng.choice(words)}_{i:02d}.ts"
    rows = [(i, name(i), rng.choice([0.0, 0.5, 0.5, 1.0, 9.0, None]), rng.choice([None, "Handles red", "hot ring"]), rng.choice([None, "lock it"])) for i in range(60)]
    files = spark.createDataFrame(rows, "id long, path string, rank double, summary string, when_to_use string")
    symbols = spark.createDataFrame([(rng.randrange(60), rng.choice(words) + "X", True) for _ in range(30)], "file_id long, name string, is_exported boolean")
    edges = spark.createDataFrame([(rng.randrange(64), rng.randrange(60)) for _ in range(70)], "source_id long, target_id long")
    asked = []
    for case in range(25):
        q = " ".join(rng.sample(words, rng.randrange(0, 3))) + rng.choice(["", " the", " zinc"])
        asked += [(case, q, rng.choice([rows[rng.randrange(60)][1], "gone.ts", None]), rng.choice([0, 1, 3])) for _ in range(rng.randrange(1, 5))]
    asked = list({(c, p): (c, q, p, g) for c, q, p, g in asked}.values()) + [(24, "bolt", "gone.ts", 1)]
    cases = spark.createDataFrame(asked, "case_id long, query string, path string, relevance long").dropDuplicates(["case_id", "path", "query"])

    queries = cases.select(F.col("case_id").alias("query_id"), "query").distinct().where(F.size(keywords(F.col("query"))) > 0)
    found = relevance.expanded_scores(files, edges, relevance.direct_scores(relevance.file_exports(files, symbols), queries)).select(F.col("query_id").alias("case_id"), "path", "score")
    expected = cases.join(queries.select(F.col("query_id").alias("case_id")), "case_id", "left_semi").where("path is not null").select("case_id", "path", "relevance")
    want = sorted(tuple(r) for r in evaluate.case_metrics(found, expected).collect())

    def lists(*_):
        raise AssertionError("a row for each query and file")

    monkeypatch.setattr(relevance, "expanded_scores", lists)
    got = sorted(tuple(r) for r in evaluate.score_dataset(files, symbols, edges, cases).collect())
    assert [r[0] for r in got] == [r[0] for r in want]
    for g, w in zip(got, want, strict=True):
        assert g == pytest.approx(w, abs=1e-12)

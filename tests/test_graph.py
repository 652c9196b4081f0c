import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph


def tables(spark, n, pairs):
    files = spark.createDataFrame([(i, f"f{i}") for i in range(n)], "id long, path string")
    edges = spark.createDataFrame([(a, b, "Import", "./x") for a, b in pairs], "source_id long, target_id long, edge_type string, specifier string")
    return files, edges


def dense(n, pairs, variant, d=0.85, steps=100):
    """The library's definition node by node: every node gives every other something."""
    out, linked = defaultdict(int), set(pairs)
    for a, _ in pairs:
        out[a] += 1
    r = [1 / n] * n
    for _ in range(steps):
        new = []
        for v in range(n):
            x = 0.0
            for w in range(n):
                if (w, v) in linked:
                    x += d * r[w] / out[w]
                elif not out[w]:
                    x += d * r[w] / n
                elif variant == "library":
                    x += (1 - d) * r[w] / n
            new.append(x if variant == "library" else x + (1 - d) / n)
        s = sum(new)
        r = [x / s for x in new]
    return r


def ranks(df):
    return {r["id"]: r["pr"] for r in df.collect()}


@pytest.mark.parametrize(
    "n, pairs, library, standard",
    [
        (1, [], [1.0], [1.0]),
        (2, [], [0.5, 0.5], [0.5, 0.5]),
        (6, [(i, 0) for i in range(1, 6)], [0.525453] + [0.094909] * 5, [0.512195] + [0.097561] * 5),
        (3, [(0, 1), (1, 2)], [0.179831, 0.339342, 0.480827], [0.184417, 0.341171, 0.474412]),
        (3, [(0, 1), (0, 2), (1, 2)], [0.195032, 0.277440, 0.527528], [0.197580, 0.281551, 0.520869]),
    ],
)
def test_pagerank_goldens(spark, n, pairs, library, standard):
    files, edges = tables(spark, n, pairs)
    for variant, want in (("library", library), ("standard", standard)):
        got = ranks(graph.pagerank(files, edges, variant=variant))
        assert [got[i] for i in range(n)] == pytest.approx(want, abs=1e-6)


def test_pagerank_forms_agree(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(30), rng.randrange(25)) for _ in range(120)]
    files, edges = tables(spark, 30, pairs)
    for variant in ("library", "standard"):
        a = ranks(graph.pagerank(files, edges, variant=variant, iterations=12))
        b = ranks(graph.pagerank(files, edges, variant=variant, iterations=12, one_task=0))
        assert a == pytest.approx(b, abs=1e-12)
        assert sum(a.values()) == pytest.approx(1)


def test_pagerank_library_against_definition(spark):
    pairs = [(0, 1), (0, 1), (0, 2), (1, 2), (2, 0), (3, 2)]
    files, edges = tables(spark, 5, pairs)
    got = ranks(graph.pagerank(files, edges))
    want = dense(5, pairs, "library")
    assert [got[i] for i in range(5)] == pytest.approx(want, abs=1e-9)


def test_personal_jumps(spark):
    files, edges = tables(spark, 3, [(0, 1), (1, 0)])
    to = spark.createDataFrame([(2, 1.0)], "id long, weight double")
    got = ranks(graph.pagerank(files, edges, variant="standard", personal=to))
    assert got[2] > 0.9
    with pytest.raises(ValueError):
        graph.pagerank(files, edges, personal=to)


def test_boost_counts_parallel_edges(spark):
    files, edges = tables(spark, 2, [(0, 1), (0, 1)])
    pr = ranks(graph.pagerank(files, edges))
    got = {r["id"]: r["rank"] for r in graph.boosted_ranks(files, edges).collect()}
    assert got[1] == pytest.approx(pr[1] * 2 * math.log2(4))
    assert got[0] == pytest.approx(pr[0] * 2)


def test_empty_graph(spark):
    files, edges = tables(spark, 0, [])
    assert graph.pagerank(files, edges).count() == 0


def breadth_first(pairs, start, depth):
    level, front = {start: 0}, [start]
    for k in range(1, depth):
        front = sorted({b for a, b in pairs if a in front} - set(level))
        level |= {x: k for x in front}
    return sorted((b, level[a] + 1) for a, b in pairs if a in level and depth > 0)


@pytest.mark.parametrize("depth", [0, 1, 2, 3, 6])
def test_bounded_search(spark, depth):
    rng = random.Random(depth)
    pairs = [(rng.randrange(15), rng.randrange(15)) for _ in range(25)]
    files, edges = tables(spark, 15, pairs)
    got = graph.bounded_deps(files, edges, "f3", "imports", depth).select("file", "depth").collect()
    assert sorted((int(r["file"][1:]), r["depth"]) for r in got) == breadth_first(pairs, 3, depth)


def test_search_keeps_cycles_and_repeats(spark):
    files, edges = tables(spark, 2, [(0, 1), (0, 1), (1, 0)])
    got = graph.bounded_deps(files, edges, "f0", "imports", 5).groupBy("file", "depth").count().collect()
    assert {(r["file"], r["depth"], r["count"]) for r in got} == {("f1", 1, 2), ("f0", 2, 1)}


def test_unknown_file(spark):
    files, edges = tables(spark, 2, [(0, 1)])
    with pytest.raises(LookupError):
        graph.deps(files, edges, "nope")
    assert graph.neighbours(files, edges, "nope").count() == 0
    assert {r["direction"] for r in graph.deps(files, edges, "f0", "sideways").select(F.col("direction")).collect()} == {"imports"}


def no_checkpoint(df):
    raise AssertionError("a step cuts its lineage by a checkpoint of all nodes and edges")


def scattered(spark):
    """A graph with a hub, repeated edges, loops, edges to unknown nodes and ids far apart, and its plain pairs."""
    rng = random.Random(5)
    pairs = [(rng.randrange(20), rng.randrange(20)) for _ in range(60)] + [(i, 3) for i in range(25)] + [(4, 4)] * 3
    far = lambda i: i * i * 1_000_003 - 7
    files = spark.createDataFrame([(far(i), f"f{i}") for i in range(25)], "id long, path string")
    edges = spark.createDataFrame([(far(a), far(b), "Import", "./x") for a, b in pairs] + [(far(1), 5, "Import", "./x"), (6, far(1), "Import", "./x"), (None, far(1), "Import", "./x")], "source_id long, target_id long, edge_type string, specifier string")
    return files, edges, pairs, far


def test_library_steps_need_no_checkpoint(spark, monkeypatch):
    monkeypatch.setattr(graph, "cut", no_checkpoint)
    files, edges, pairs, far = scattered(spark)
    got = ranks(graph.pagerank(files, edges, one_task=0, iterations=15))
    assert [got[far(i)] for i in range(25)] == pytest.approx(dense(25, pairs, "library", steps=15), abs=1e-12)


def test_standard_steps_need_no_checkpoint(spark, monkeypatch):
    monkeypatch.setattr(graph, "cut", no_checkpoint)
    files, edges, pairs, far = scattered(spark)
    got = ranks(graph.pagerank(files, edges, variant="standard", one_task=0, iterations=15))
    assert [got[far(i)] for i in range(25)] == pytest.approx(dense(25, pairs, "standard", steps=15), abs=1e-12)
    to = spark.createDataFrame([(far(2), 1.0), (far(9), 3.0)], "id long, weight double")
    one, many = (ranks(graph.pagerank(files, edges, variant="standard", personal=to, one_task=m, iterations=15)) for m in (10**6, 0))
    assert one == pytest.approx(many, abs=1e-12) and sum(one.values()) == pytest.approx(1)


def test_boosted_ranks_need_no_checkpoint(spark, monkeypatch):
    monkeypatch.setattr(graph, "cut", no_checkpoint)
    files, edges, pairs, far = scattered(spark)
    got = {r["id"]: r["rank"] for r in graph.boosted_ranks(files, edges, one_task=0, iterations=15).collect()}
    want = dense(25, pairs, "library", steps=15)
    degree = [sum(b == i for _, b in pairs) + 2 * (i == 1) for i in range(25)]  # edges from unknown files count in the degree
    assert [got[far(i)] for i in range(25)] == pytest.approx([want[i] * 25 * math.log2(degree[i] + 2) for i in range(25)], abs=1e-9)

"""Operators over the import multigraph: degrees, neighbours, bounded breadth-first search, PageRank."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import blocks
from lodestone.tables import cut, read_array, shared_dir, write_array

#: Distinct edges and nodes up to which PageRank runs in one task; beyond, its blocks are dealt over tasks.
ONE_TASK = 5_000_000


def importer_counts(edges: DataFrame) -> DataFrame:
    """Edge rows by target; parallel edges count each."""
    return edges.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("importers"))


def degrees(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree) with parallel edges counted; one pass over the edges, combined before the shuffle."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    sums = ends.groupBy("e.id").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))
    return files.select("id").join(sums, "id", "left").na.fill(0, ["in_degree", "out_degree"])


def edges_with_paths(files: DataFrame, edges: DataFrame) -> DataFrame:
    s = files.select(F.col("id").alias("source_id"), F.col("path").alias("source_path"))
    t = files.select(F.col("id").alias("target_id"), F.col("path").alias("target_path"))
    return edges.join(s, "source_id").join(t, "target_id").select("source_path", "target_path", "edge_type")


def neighbours(files: DataFrame, edges: DataFrame, path: str, direction: str = "imports") -> DataFrame:
    """(file_path, edge_type, specifier) of a file's imports, or of its importers; an unknown path has none."""
    here, there = ("target_id", "source_id") if direction == "importers" else ("source_id", "target_id")
    start = files.where(F.col("path") == path).select(F.col("id").alias(here))
    near = edges.join(F.broadcast(start), here)  # at most one file has a path
    return near.join(files.select(F.col("id").alias(there), F.col("path").alias("file_path")), there).select("file_path", "edge_type", "specifier")


def reach(edges: DataFrame, start: DataFrame, depth: int, direction: str = "imports") -> DataFrame:
    """(id, level) of the nodes within depth - 1 steps of start (id): those whose edges a search of that depth follows.

    The frontier of a level is what its predecessor's edges lead to and no earlier level holds."""
    here, there = ("target_id", "source_id") if direction == "importers" else ("source_id", "target_id")
    steps = edges.select(F.col(here).alias("id"), F.col(there).alias("to")).distinct()
    seen = start.select("id").distinct().withColumn("level", F.lit(0))
    front = seen
    for level in range(1, depth):
        front = front.join(steps, "id").select(F.col("to").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("level", F.lit(level))
        if level % 4 == 0 or level == 1:
            front = cut(front)
            if front.isEmpty():
                break
        seen = seen.unionByName(front)
    return seen


def bounded_deps(files: DataFrame, edges: DataFrame, path: str, direction: str = "imports", depth: int = 1) -> DataFrame:
    """(direction, file, edge_type, specifier, depth): every edge that leaves a file less than depth steps away, at its level + 1."""
    here, there = ("target_id", "source_id") if direction == "importers" else ("source_id", "target_id")
    if depth <= 0:
        empty = edges.where("false").withColumn("level", F.lit(0))
        return empty.select(F.lit(direction).alias("direction"), F.lit("").alias("file"), "edge_type", "specifier", F.col("level").alias("depth"))
    found = reach(edges, files.where(F.col("path") == path).select("id"), depth, direction)
    out = edges.join(found.withColumnRenamed("id", here), here)
    named = out.join(files.select(F.col("id").alias(there), F.col("path").alias("file")), there)
    return named.select(F.lit(direction).alias("direction"), "file", "edge_type", "specifier", (F.col("level") + 1).alias("depth"))


def deps(files: DataFrame, edges: DataFrame, path: str, direction: str = "both", depth: int = 1) -> DataFrame:
    """Imports, importers or, by any other direction, both. An unknown file is an error."""
    if files.where(F.col("path") == path).isEmpty():
        raise LookupError(f"file not in index: {path}")
    ways = [direction] if direction in ("imports", "importers") else ["imports", "importers"]
    out = bounded_deps(files, edges, path, ways[0], depth)
    return out.unionByName(bounded_deps(files, edges, path, ways[1], depth)) if len(ways) > 1 else out


def mutual(edges: DataFrame) -> DataFrame:
    """(a, b) with a < b of files that import each other."""
    e = edges.select("source_id", "target_id").where("source_id <> target_id").distinct()
    return e.join(e.select(F.col("source_id").alias("target_id"), F.col("target_id").alias("source_id")), ["source_id", "target_id"]).where("source_id < target_id").select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))


def _ranked(x, base, jump, out, damping, back):
    """A block's ranks from what flows to it, what it sends to each node it links to, and the sums of all ranks and of those that link to none."""
    pr = x + (base if jump is None else base * jump)
    with np.errstate(divide="ignore"):
        sent = np.where(out > 0, damping * pr / out, 0.0) - back * pr
    return pr, sent, pr.sum(), pr[out == 0].sum()


def _flow(block, size, sent):
    """The sums over each row's columns, 0 for rows that aren't there."""
    x = np.zeros(size)
    if block is not None:
        rows, start, cols = block
        x[rows] = np.add.reduceat(sent[cols], start)
    return x


def _base(variant, damping, lost, n):
    """What each node gets beside its links; times its share of the jumps in the standard form."""
    return damping * lost / n + (1 - damping) * (1 - lost) / n if variant == "library" else damping * lost + 1 - damping


def pagerank(files: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 100, variant: str = "library", personal: DataFrame | None = None, one_task: int = ONE_TASK) -> DataFrame:
    """(id, pr), summing to 1.

    variant "library": a target gets (1 - damping) / n only from nodes that neither link to it nor dangle, repeated edges
    lower a source's share but count once; "standard": the textbook form with the mass of dangling nodes spread evenly.
    personal (id, weight): where the standard variant's jumps lead. The edges are shuffled once, into blocks in the shared
    folder; a graph of up to one_task edges and nodes is then iterated by one task, beyond by a job a step whose tasks read
    the blocks and what each node sends (8 bytes a node) and write what it sends next."""
    if personal is not None and variant != "standard":
        raise ValueError("personal weights need the standard variant")
    spark = files.sparkSession
    nodes = files.select("id").distinct()
    nodes = nodes.withColumn("w", F.lit(1.0)) if personal is None else nodes.join(personal.select("id", F.col("weight").alias("w")), "id", "left").na.fill(0.0, ["w"])
    folder = shared_dir(spark)
    n = blocks.write_nodes(nodes, folder)
    if not n:
        return nodes.select("id", F.lit(0.0).alias("pr"))
    parts = blocks.parts_for(spark, n)
    m = blocks.write_adjacency(edges, folder, n, parts)
    filled = blocks.there(folder, "rows")
    back = (1 - damping) / n if variant == "library" else 0.0

    def jumps(b):
        if variant == "library":
            return None
        w = read_array(f"{folder}/w", "f8")
        return w[b::parts] / w.sum()

    def ranks(ids, pr):
        import pyarrow as pa

        for i in range(0, len(ids), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 100_000]), pa.array(pr[i : i + 100_000])], names=["id", "pr"])

    def alone(batches):
        if not sum(b.num_rows for b in batches):
            return
        have = [(blocks.block(folder, b) if b in filled else None, blocks.out_degrees(folder, n, parts, b, filled), jumps(b)) for b in range(parts)]
        pr, sent, lost, total = np.full(n, 1.0 / n), np.empty(n), 0.0, 1.0
        for b, (_, out, jump) in enumerate(have):
            _, sent[b::parts], _, x = _ranked(np.full(len(out), 1.0 / n), 0.0, None, out, damping, back)
            lost += x
        for _ in range(iterations):
            base, then, next_lost, next_total = _base(variant, damping, lost / total, n), np.empty(n), 0.0, 0.0
            for b, (block, out, jump) in enumerate(have):
                pr[b::parts], then[b::parts], s, x = _ranked(_flow(block, len(out), sent) / total, base, jump, out, damping, back)
                next_total, next_lost = next_total + s, next_lost + x
            sent, lost, total = then, next_lost, next_total
        yield from ranks(read_array(f"{folder}/id", "i8"), pr / total)

    if max(n, m) <= one_task:
        return spark.range(0, 1, 1, 1).mapInArrow(alone, "id long, pr double")

    def step(at, lost, total):
        base = _base(variant, damping, lost / total, n)

        def run(batches):
            import pyarrow as pa

            sent = None
            for b in (x for batch in batches for x in batch.column(0).to_pylist()):
                if not at:
                    out = blocks.out_degrees(folder, n, parts, b, filled)
                    write_array(f"{folder}/out/{b}", out)
                    pr, then, s, x = _ranked(np.full(len(out), 1.0 / n), 0.0, None, out, damping, back)
                else:
                    sent = blocks.gathered(folder, f"sent{at - 1}", n, parts) if sent is None else sent
                    out = read_array(f"{folder}/out/{b}", "f8")
                    flow = _flow(blocks.block(folder, b) if b in filled else None, len(out), sent)
                    pr, then, s, x = _ranked(flow / total, base, jumps(b), out, damping, back)
                if at < iterations:
                    write_array(f"{folder}/sent{at}/{b}", then)
                else:
                    write_array(f"{folder}/pr/{b}", pr)
                yield pa.RecordBatch.from_pydict({"b": [b], "s": [s], "x": [x]})

        rows = sorted(blocks.over(spark, parts).mapInArrow(run, "b long, s double, x double").collect())  # a row a block
        return sum(r["x"] for r in rows), sum(r["s"] for r in rows)

    lost, total = 0.0, 1.0
    for at in range(iterations + 1):
        lost, total = step(at, lost, total)
        if at:
            blocks.drop(folder, f"sent{at - 1}")

    def last(batches):
        ids = read_array(f"{folder}/id", "i8")
        for b in (x for batch in batches for x in batch.column(0).to_pylist()):
            yield from ranks(ids[b::parts], read_array(f"{folder}/pr/{b}", "f8") / total)

    return blocks.over(spark, parts).mapInArrow(last, "id long, pr double")


def boosted_ranks(files: DataFrame, edges: DataFrame, **options) -> DataFrame:
    """(id, rank): PageRank x number of files x log2(in-degree + 2), parallel edges counted in the degree."""
    n = files.select("id").distinct().count()
    pr = pagerank(files, edges, **options)
    return pr.join(importer_counts(edges), "id", "left").select("id", (F.col("pr") * n * F.log2(F.coalesce("importers", F.lit(0)) + 2)).alias("rank"))

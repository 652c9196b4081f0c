"""Results as nested rows, JSON, text and Markdown. Reports are small: top lists and one row a case or variant."""

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHOWN = 5


def deps_document(found: DataFrame, path: str) -> dict:
    """{file, imports, importers (the first SHOWN), total_importers} from the rows of graph.deps()."""
    entry = F.struct("depth", "file", "edge_type", "specifier")
    r = found.agg(F.sort_array(F.collect_list(F.when(F.col("direction") == "imports", entry))).alias("imports"), F.slice(F.sort_array(F.collect_list(F.when(F.col("direction") == "importers", entry))), 1, SHOWN).alias("importers"), F.count_if(F.col("direction") == "importers").alias("n")).first()
    rows = lambda xs: [{"file": x["file"], "edge_type": x["edge_type"], "specifier": x["specifier"], "depth": x["depth"]} for x in xs]
    return {"file": path, "imports": rows(r["imports"]), "importers": rows(r["importers"]), "total_importers": r["n"]}


def symbol_documents(detail: DataFrame) -> list[dict]:
    """[{name, definitions, referenced_in, total_references}] by name; definitions have no line, as none is stored."""
    out = []
    for r in detail.orderBy("name").collect():
        places = [{"file": x["file"], "line": None, "kind": x["kind"], "exported": x["exported"], "signature": x["signature"]} for x in r["definitions"]]
        out.append({"name": r["name"], "definitions": places, "referenced_in": r["referenced_in"], "total_references": r["total_references"]})
    return out


def context_document(query: str, top: DataFrame) -> dict:
    cols = ["path", "score", "rank", *(["content"] if "content" in top.columns else [])]
    rows = top.orderBy(F.desc("score"), "path").collect()
    return {"query": query, "results": [{c: r[c] for c in cols} | {"match_reasons": r["reasons"]} for r in rows]}


def more(items: list[str], shown: int = SHOWN) -> str:
    """The first items and how many more there are."""
    return ", ".join(items[:shown]) + (f" (+{len(items) - shown} more)" if len(items) > shown else "")


def deps_text(doc: dict) -> str:
    lines = [doc["file"], f"imports ({len(doc['imports'])}):"]
    lines += [f"{'  ' * x['depth']}{x['file']} [{x['edge_type']}] {x['specifier'] or ''}".rstrip() for x in doc["imports"]]
    lines.append(f"importers ({doc['total_importers']}):")
    lines += [f"{'  ' * x['depth']}{x['file']} [{x['edge_type']}]" for x in doc["importers"]]
    left = doc["total_importers"] - len(doc["importers"])
    return "\n".join([*lines, *([f"  +{left} more"] if left > 0 else [])])


def symbol_text(docs: list[dict]) -> str:
    out = []
    for d in docs:
        out.append(d["name"])
        out += [f"  {x['file']} {x['kind']}{' exported' if x['exported'] else ''}" + (f"\n    {x['signature']}" if x["signature"] else "") for x in d["definitions"]]
        out.append(f"  used in {d['total_references']}: {', '.join(d['referenced_in'])}" if d["referenced_in"] else "  not used by other files")
    return "\n".join(out) or "no symbol found"


def context_text(doc: dict) -> str:
    wide = max((len(r["path"]) for r in doc["results"]), default=0)
    lines = [f"{r['path'].ljust(wide)}  {r['score']:8.2f}  {', '.join(r['match_reasons'])}" + (f"\n{r['content']}\n" if "content" in r else "") for r in doc["results"]]
    return "\n".join(lines) or "no file found"


def markdown_table(df: DataFrame, digits: int = 3) -> str:
    """A frame of few rows as a Markdown table, in the order of its rows."""
    cell = lambda x: "–" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else json.dumps(x) if isinstance(x, list | dict) else str(x).replace("|", "\\|")
    rows = [[cell(x) for x in r] for r in df.collect()]
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(r) + " |" for r in rows)])


def comparison_markdown(pairs: DataFrame, a: str = "treatment", b: str = "control") -> str:
    """Means by variant, winners, and the paired comparison with its sign test, from (case_id, variant, f1, tools)."""
    from lodestone.operators import evaluate

    duel = evaluate.pairwise(pairs, a, b).withColumn("p", evaluate.sign_test(F.col("wins_a"), F.col("wins_b")))
    wins = evaluate.winners(pairs).groupBy("winner").agg(F.count("*").alias("cases")).orderBy("winner")
    return "\n\n".join(["## Means", markdown_table(evaluate.variant_means(pairs).orderBy("variant")), "## Winners", markdown_table(wins), f"## {a} against {b}", markdown_table(duel)])

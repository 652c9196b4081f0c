"""Named queries over the driver's tables, each with the SQL that gives the same rows."""

from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import enrich, evaluate, extract, graph, index, lookup, relevance, resolve, sessions
from lodestone.sources import adapters as a
from lodestone.tables import stored

QUERIES, ORACLES = {}, {}

# The adapters' tables in SQL.
_FILES = """files AS (SELECT p_partkey AS id, lower(p_type) || '/' || lower(replace(p_brand, '#', '')) || '/' || replace(p_name, ' ', '_') || '.' || p_partkey::VARCHAR AS path,
    sha256(lower(p_type) || '/' || lower(replace(p_brand, '#', '')) || '/' || replace(p_name, ' ', '_') || '.' || p_partkey::VARCHAR) AS hash,
    p_retailprice / 1000 AS rank, p_size::BIGINT AS mtime, CASE WHEN p_size % 3 = 0 THEN 'Handles ' || p_name END AS summary,
    CASE WHEN p_size % 4 = 0 THEN 'Modify when changing ' || lower(p_type) END AS when_to_use FROM part)"""
_EDGES = """edges AS (SELECT * FROM (SELECT l_partkey AS source_id, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_extendedprice) AS target_id,
    CASE l_returnflag WHEN 'N' THEN 'Import' WHEN 'R' THEN 'ReExport' ELSE 'TypeImport' END AS edge_type, l_orderkey::VARCHAR AS specifier FROM lineitem) WHERE target_id IS NOT NULL)"""
_SYMBOLS = """symbols AS (SELECT l_partkey AS file_id, s_name AS name, CASE min(l_returnflag) WHEN 'A' THEN 'Function' WHEN 'N' THEN 'Class' ELSE 'Variable' END AS kind,
    bool_or(l_linestatus = 'O') AS is_exported, count(*)::BIGINT AS ref_count FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_partkey, l_suppkey, s_name)"""
_DESCRIBED = "described AS (SELECT f.*, coalesce(e.exports, []) AS exports FROM files f LEFT JOIN (SELECT file_id, list_sort(list(name)) AS exports FROM symbols WHERE is_exported GROUP BY file_id) e ON e.file_id = f.id)"
_SNAP = """old AS (SELECT 'docs/' || doc_id AS path, sha256(text) AS hash, doc_id % 50 AS mtime, CASE WHEN doc_id % 2 = 0 THEN 'about ' || doc_id END AS summary FROM documents WHERE doc_id % 10 < 8),
    new AS (SELECT 'docs/' || doc_id AS path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS hash, doc_id % 50 + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS mtime FROM documents WHERE doc_id % 10 > 0)"""
_RESULTS = """results AS (SELECT o_custkey AS case_id, o_orderkey::VARCHAR AS path, o_totalprice AS score, CASE WHEN o_orderpriority LIKE '1%' THEN 3 WHEN o_orderpriority LIKE '2%' THEN 2 WHEN o_orderpriority LIKE '3%' THEN 1 ELSE 0 END AS relevance FROM orders),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, path) AS pos, row_number() OVER (PARTITION BY case_id ORDER BY relevance DESC) AS ideal FROM results),
    cases AS (SELECT case_id, count(*) AS n, count(*) FILTER (relevance > 0) AS rel, count(*) FILTER (relevance > 0 AND pos <= 5) AS h5, count(*) FILTER (relevance > 0 AND pos <= 10) AS h10, min(pos) FILTER (relevance > 0) AS first,
      sum(CASE WHEN pos <= 10 THEN (pow(2, relevance) - 1) / log2(pos + 1) ELSE 0 END) AS dcg, sum(CASE WHEN ideal <= 10 THEN (pow(2, relevance) - 1) / log2(ideal + 1) ELSE 0 END) AS idcg FROM ranked GROUP BY case_id),
    metrics AS (SELECT case_id, h5 / least(n, 5) AS p_at_5, h10 / least(n, 10) AS p_at_10, CASE WHEN rel > 0 THEN h5 / rel ELSE 0 END AS r_at_5, CASE WHEN rel > 0 THEN h10 / rel ELSE 0 END AS r_at_10, coalesce(1.0 / first, 0) AS mrr, CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END AS ndcg_at_10 FROM cases)"""
_SESSIONS = "sessions AS (SELECT user_id AS session, event_id AS line, event_type AS tool, CAST(json_extract_string(props, '$.k') AS BIGINT) AS arg, value FROM events)"
_RUNS = "runs AS (SELECT event_id AS id, substr(sha256(event_id::VARCHAR), 1, 7) AS git_commit, 'relevance' AS layer, event_type AS dataset, value AS ndcg, props AS metrics FROM events)"
_VARIANTS = """variants AS (SELECT event_id // 3 AS case_id, (['control', 'treatment', 'enriched'])[event_id % 3 + 1] AS variant, ((floor(value)::BIGINT % 100 + 100) % 100) / 100.0 AS f1, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tools FROM events)"""
QUESTION = "Where is the large PROMO widget, handled by Brand12?"
_STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
_R = 6


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _model(spark, d):
    return a.files(spark, d), a.symbols(spark, d), a.edges(spark, d)


def _described(spark, d):
    return relevance.file_exports(a.files(spark, d), a.symbols(spark, d))


def _path(files, number: int = 5) -> str:
    return files.where(F.col("id") == number).select("path").first()["path"]


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, _R) for c in cols})


# --- storage ---


@query("index_stats", f"WITH {_FILES}, {_SYMBOLS}, {_EDGES} SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM symbols WHERE is_exported) AS exports, (SELECT count(*) FROM edges) AS edges")
def index_stats(spark, d):
    return relevance.index_stats(*_model(spark, d))


@query("importer_counts", f"WITH {_EDGES} SELECT target_id AS id, count(*) AS importers FROM edges GROUP BY target_id")
def importer_counts(spark, d):
    return graph.importer_counts(a.edges(spark, d))


@query("file_exports", f"WITH {_FILES}, {_SYMBOLS}, {_DESCRIBED} SELECT path, array_to_string(exports, ',') AS exports, len(exports) AS n FROM described")
def file_exports(spark, d):
    return _described(spark, d).select("path", F.array_join("exports", ",").alias("exports"), F.size("exports").cast("long").alias("n"))


@query("unenriched_files", f"WITH {_FILES}, {_SYMBOLS}, {_DESCRIBED} SELECT path, round(rank, 6) AS rank, len(exports) AS n FROM described WHERE summary IS NULL ORDER BY rank DESC, path LIMIT 100")
def unenriched_files(spark, d):
    return _rounded(enrich.unenriched(_described(spark, d), 100).select("path", "rank", F.size("exports").cast("long").alias("n")), "rank")


@query("enrichment_coverage", f"WITH {_FILES} SELECT count(*) AS total_files, count(summary) AS enriched_files, count(*) - count(summary) AS unenriched_files, round(100.0 * count(summary) / count(*), 6) AS pct FROM files")
def enrichment_coverage(spark, d):
    return _rounded(enrich.coverage(a.files(spark, d)), "pct")


_SEARCH = "SELECT name, kind, is_exported, ref_count, file_id, path FROM symbols JOIN files ON file_id = id WHERE {} ORDER BY is_exported DESC, ref_count DESC, path, name, kind LIMIT {}"


@query("symbol_exact", f"WITH {_FILES}, {_SYMBOLS} " + _SEARCH.format("name = 'Supplier#000000003'", 50))
def symbol_exact(spark, d):
    return lookup.symbol_search(a.files(spark, d), a.symbols(spark, d), "Supplier#000000003", 50, exact=True)


@query("symbol_substring", f"WITH {_FILES}, {_SYMBOLS} " + _SEARCH.format("name ILIKE '%SUPPLIER#00000_00%'", 50))
def symbol_substring(spark, d):
    return lookup.symbol_search(a.files(spark, d), a.symbols(spark, d), "SUPPLIER#00000_00", 50)


@query(
    "symbol_detail",
    f"""WITH {_FILES}, {_SYMBOLS}, {_EDGES}, found AS ({_SEARCH.format("name ILIKE '%000000%'", 20)}),
users AS (SELECT DISTINCT f.name, s.path FROM found f JOIN edges e ON e.target_id = f.file_id JOIN files s ON s.id = e.source_id),
u AS (SELECT name, list_sort(list(path)) AS p FROM users GROUP BY name)
SELECT name, string_agg(path || ':' || kind, ',' ORDER BY path, kind) AS definitions, coalesce(array_to_string(any_value(p)[1:5], ','), '') AS referenced_in, coalesce(len(any_value(p)), 0) AS total_references FROM found LEFT JOIN u USING (name) GROUP BY name""",
)
def symbol_detail(spark, d):
    r = lookup.symbol_detail(*_model(spark, d), "000000", 20)
    places = F.array_join(F.transform(F.array_sort(F.transform("definitions", lambda x: F.struct(x["file"].alias("f"), x["kind"].alias("k")))), lambda x: F.concat(x["f"], F.lit(":"), x["k"])), ",")
    return r.select("name", places.alias("definitions"), F.array_join("referenced_in", ",").alias("referenced_in"), F.col("total_references").cast("long").alias("total_references"))


@query("edges_with_paths", f"WITH {_FILES}, {_EDGES} SELECT s.path AS source_path, t.path AS target_path, edge_type FROM edges JOIN files s ON s.id = source_id JOIN files t ON t.id = target_id")
def edges_with_paths(spark, d):
    return graph.edges_with_paths(a.files(spark, d), a.edges(spark, d))


@query("ranked_files", f"WITH {_FILES} SELECT path, round(rank, 6) AS rank, summary, when_to_use FROM files ORDER BY rank DESC, path LIMIT 500")
def ranked_files(spark, d):
    return _rounded(a.files(spark, d).orderBy(F.desc("rank"), "path").limit(500).select("path", "rank", "summary", "when_to_use"), "rank")


@query("file_by_path", f"WITH {_FILES} SELECT id, path, hash, mtime FROM files WHERE id = 5")
def file_by_path(spark, d):
    f = a.files(spark, d)
    return f.where(F.col("path") == _path(f)).select("id", "path", "hash", "mtime")


# --- graph ---


@query("degree", f"WITH {_FILES}, {_EDGES} SELECT id, (SELECT count(*) FROM edges WHERE target_id = id) AS in_degree, (SELECT count(*) FROM edges WHERE source_id = id) AS out_degree FROM files")
def degree(spark, d):
    return graph.degrees(a.files(spark, d), a.edges(spark, d))


@query("deps_imports", f"WITH {_FILES}, {_EDGES} SELECT t.path AS file_path, edge_type, specifier FROM edges JOIN files t ON t.id = target_id WHERE source_id = 5")
def deps_imports(spark, d):
    f = a.files(spark, d)
    return graph.neighbours(f, a.edges(spark, d), _path(f), "imports")


@query("deps_importers", f"WITH {_FILES}, {_EDGES} SELECT s.path AS file_path, edge_type, specifier FROM edges JOIN files s ON s.id = source_id WHERE target_id = 5")
def deps_importers(spark, d):
    f = a.files(spark, d)
    return graph.neighbours(f, a.edges(spark, d), _path(f), "importers")


_REACH = """imports_level AS (SELECT id, min(l) AS level FROM (SELECT 5 AS id, 0 AS l UNION ALL SELECT target_id, 1 FROM edges WHERE source_id = 5) GROUP BY id),
importers_level AS (SELECT id, min(l) AS level FROM (SELECT 5 AS id, 0 AS l UNION ALL SELECT source_id, 1 FROM edges WHERE target_id = 5) GROUP BY id)"""


@query(
    "deps_bfs",
    f"""WITH {_FILES}, {_EDGES}, {_REACH}
SELECT 'imports' AS direction, t.path AS file, edge_type, specifier, level + 1 AS depth FROM edges e JOIN imports_level l ON l.id = e.source_id JOIN files t ON t.id = e.target_id
UNION ALL SELECT 'importers', s.path, edge_type, specifier, level + 1 FROM edges e JOIN importers_level l ON l.id = e.target_id JOIN files s ON s.id = e.source_id""",
)
def deps_bfs(spark, d):
    f = a.files(spark, d)
    return graph.deps(f, a.edges(spark, d), _path(f), "both", 2)


@query("mutual_imports", f"WITH {_EDGES}, e AS (SELECT DISTINCT source_id, target_id FROM edges) SELECT x.source_id AS a, x.target_id AS b FROM e x JOIN e y ON x.source_id = y.target_id AND x.target_id = y.source_id WHERE x.source_id < x.target_id")
def mutual_imports(spark, d):
    return graph.mutual(a.edges(spark, d))


def _pagerank_sql(step: str, select: str) -> str:
    return f"""WITH RECURSIVE {_FILES}, {_EDGES}, e AS (SELECT DISTINCT source_id AS s, target_id AS t FROM edges), de AS (SELECT source_id AS s, target_id AS t, count(*) AS m FROM edges GROUP BY ALL), od AS (SELECT source_id AS s, count(*) AS c FROM edges GROUP BY 1), nn AS (SELECT count(*)::DOUBLE AS n FROM files),
indeg AS (SELECT target_id AS id, count(*) AS c FROM edges GROUP BY 1),
r(it, id, pr) AS (SELECT 0, id, 1.0::DOUBLE / (SELECT n FROM nn) FROM files UNION ALL
 (WITH cur AS (SELECT * FROM r WHERE it < 100), dm AS (SELECT coalesce(sum(pr), 0) AS d FROM cur WHERE id NOT IN (SELECT s FROM od)),
  c AS (SELECT t, sum({step}) AS x FROM cur JOIN e ON e.s = cur.id JOIN od ON od.s = cur.id, nn GROUP BY t),
  u AS (SELECT cur.it + 1 AS it, cur.id, coalesce(c.x, 0) + {{base}} AS x FROM cur LEFT JOIN c ON c.t = cur.id, dm, nn)
  SELECT it, id, x / sum(x) OVER () FROM u))
{select}"""


_LIBRARY = _pagerank_sql("0.85 * cur.pr / od.c - 0.15 * cur.pr / nn.n", "{select}").replace("{base}", "0.85 * dm.d / nn.n + 0.15 * (1 - dm.d) / nn.n")
_STANDARD = _pagerank_sql("0.85 * cur.pr / od.c", "{select}").replace("{base}", "(0.85 * dm.d + 0.15) / nn.n")


@query("pagerank_library", _LIBRARY.replace("{select}", "SELECT id, round(pr, 9) AS pr FROM r WHERE it = 100"))
def pagerank_library(spark, d):
    return graph.pagerank(a.files(spark, d), a.edges(spark, d)).withColumn("pr", F.round("pr", 9))


@query("pagerank_standard", _STANDARD.replace("FROM cur JOIN e ON", "FROM cur JOIN (SELECT s, t, m FROM de) e ON").replace("{select}", "SELECT id, round(pr, 9) AS pr FROM r WHERE it = 100"))
def pagerank_standard(spark, d):
    return graph.pagerank(a.files(spark, d), a.edges(spark, d), variant="standard").withColumn("pr", F.round("pr", 9))


@query("boosted_rank", _LIBRARY.replace("{select}", "SELECT r.id, round(pr * nn.n * log2(coalesce(c, 0) + 2), 6) AS rank FROM r LEFT JOIN indeg ON indeg.id = r.id, nn WHERE it = 100"))
def boosted_rank(spark, d):
    return _rounded(graph.boosted_ranks(a.files(spark, d), a.edges(spark, d)), "rank")


# --- relevance ---


def _kw_sql(text: str) -> str:
    return f"""list_filter(list_transform(regexp_split_to_array(lower({text}), '\\s+'), lambda w: regexp_replace(w, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')), lambda w: w <> '' AND w NOT IN ({_STOP}))"""


_DIRECT = f"""k AS (SELECT DISTINCT unnest({_kw_sql("'" + QUESTION + "'")}) AS k),
direct AS (SELECT id, path, rank, sum(3 * p::INT + 2 * e::INT + 3 * s::INT + 4 * w::INT) AS raw FROM (SELECT id, path, rank, k, len(list_filter(regexp_split_to_array(lower(path), '[/.]'), lambda c: contains(c, k))) > 0 AS p,
   len(list_filter(exports, lambda c: contains(lower(c), k))) > 0 AS e, coalesce(contains(lower(summary), k), false) AS s, coalesce(contains(lower(when_to_use), k), false) AS w FROM described, k) GROUP BY ALL),
hits AS (SELECT id, path, rank, raw, raw * greatest(rank, 0.01) AS score FROM direct WHERE raw > 0)"""


def _direct(spark, d):
    q = spark.createDataFrame([(0, QUESTION)], "query_id long, query string")
    return relevance.direct_scores(_described(spark, d), q)


@query("keyword_tokens", f"SELECT item_id, array_to_string(list_sort(list_distinct(list_filter({_kw_sql('text')}, lambda w: true))), ' ') AS keywords FROM benchmark")
def keyword_tokens(spark, d):
    return a.read(spark, d, "benchmark").select("item_id", F.array_join(F.sort_array(tx.keywords(F.col("text"))), " ").alias("keywords"))


@query("score_direct", f"WITH {_FILES}, {_SYMBOLS}, {_DESCRIBED}, {_DIRECT} SELECT path, raw::BIGINT AS raw, round(score, 6) AS score FROM hits")
def score_direct(spark, d):
    return _direct(spark, d).select("path", F.col("raw").cast("long").alias("raw"), F.round("score", _R).alias("score"))


_EXPAND = """both_ AS (SELECT source_id AS id, target_id AS o FROM edges UNION SELECT target_id, source_id FROM edges), near AS (SELECT o AS id, max(score) AS best, arg_min(path, (-score, path)) AS parent FROM hits JOIN both_ USING (id) GROUP BY o),
scored AS (SELECT f.path, greatest(coalesce(h.score, 0), 0.3 * coalesce(n.best, 0)) AS score, f.rank, CASE WHEN h.id IS NULL THEN 'neighbor of ' || n.parent END AS via FROM files f LEFT JOIN hits h ON h.id = f.id LEFT JOIN near n ON n.id = f.id WHERE h.id IS NOT NULL OR n.id IS NOT NULL)"""


@query("score_expanded", f"WITH {_FILES}, {_SYMBOLS}, {_EDGES}, {_DESCRIBED}, {_DIRECT}, {_EXPAND} SELECT path, round(score, 6) AS score, via FROM scored")
def score_expanded(spark, d):
    files = a.files(spark, d)
    r = relevance.expanded_scores(files, a.edges(spark, d), _direct(spark, d))
    first = F.get("reasons", F.lit(0))
    return r.select("path", F.round("score", _R).alias("score"), F.when(first.startswith("neighbor of "), first).alias("via"))


@query("context_topk", f"WITH {_FILES}, {_SYMBOLS}, {_EDGES}, {_DESCRIBED}, {_DIRECT}, {_EXPAND} SELECT path, round(score, 6) AS score, round(rank, 6) AS rank FROM scored ORDER BY scored.score DESC, path LIMIT 10")
def context_topk(spark, d):
    return relevance.context(*_model(spark, d), QUESTION).select("path", F.round("score", _R).alias("score"), F.round("rank", _R).alias("rank"))


@query(
    "map_budget",
    f"""WITH {_FILES}, {_SYMBOLS}, {_EDGES}, {_DESCRIBED}, top AS (SELECT *, row_number() OVER (ORDER BY rank DESC, path) AS pos FROM files ORDER BY rank DESC, path LIMIT 500), ic AS (SELECT target_id AS id, count(*) AS c FROM edges GROUP BY 1),
sh AS (SELECT id, string_agg(path, ', ' ORDER BY n) AS imports FROM (SELECT e.source_id AS id, t.path, row_number() OVER (PARTITION BY e.source_id ORDER BY t.path, e.specifier, e.edge_type) AS n FROM edges e JOIN files t ON t.id = e.target_id) WHERE n <= 5 GROUP BY id),
ent AS (SELECT row_number() OVER (ORDER BY t.rank DESC, t.path) AS position, t.path, printf('%s [rank: %.2f | %d importers]', t.path, t.rank, coalesce(ic.c, 0)) || chr(10) || coalesce('  ' || t.summary || chr(10), '') || coalesce('  Use when: ' || t.when_to_use || chr(10), '')
  || array_to_string(list_transform(d.exports, lambda s: '  ' || s || chr(10)), '') || coalesce('  → imports: ' || sh.imports || chr(10), '') || chr(10) AS entry FROM top t JOIN described d ON d.id = t.id LEFT JOIN ic ON ic.id = t.id LEFT JOIN sh ON sh.id = t.id WHERE len(d.exports) > 0),
u AS (SELECT *, strlen(entry) AS bytes, sum(strlen(entry)) OVER (ORDER BY position) + 100 AS used FROM ent)
SELECT position, path, bytes::BIGINT AS bytes, used::BIGINT AS used FROM u WHERE used <= 6000 AND used - bytes < 6000""",
)
def map_budget(spark, d):
    files, symbols, edges = _model(spark, d)
    signs = relevance.file_exports(files, symbols).select("id", F.col("exports").alias("signatures"))
    return relevance.within_budget(relevance.map_entries(files, edges, signs), 1500, 100).select(F.col("position").cast("long").alias("position"), "path", "bytes", "used")


# --- states ---


@query("change_detection", f"WITH {_SNAP} SELECT n.path, CASE WHEN coalesce(n.mtime <= o.mtime, false) THEN 'fresh' WHEN n.hash = o.hash THEN 'same' ELSE 'changed' END AS status FROM new n LEFT JOIN old o USING (path)")
def change_detection(spark, d):
    old, new = a.snapshots(spark, d)
    return index.detect_changes(new, old).select("path", "status")


@query("change_detection_hash", f"WITH {_SNAP} SELECT CASE WHEN n.hash = o.hash THEN 'same' ELSE 'changed' END AS status, count(*) AS n FROM new n LEFT JOIN old o USING (path) GROUP BY 1")
def change_detection_hash(spark, d):
    old, new = a.snapshots(spark, d)
    return index.detect_changes(new, old, incremental=False).groupBy("status").agg(F.count("*").alias("n"))


_NEXT = "CASE WHEN coalesce(n.mtime <= o.mtime, false) THEN o.mtime ELSE n.mtime END"


@query(
    "reindex_times",
    f"""WITH {_SNAP} SELECT 'incremental' AS mode, o.path, CASE WHEN n.path IS NULL THEN o.mtime ELSE {_NEXT} END AS mtime FROM old o LEFT JOIN new n USING (path)
UNION ALL SELECT 'by hash', o.path, CASE WHEN n.hash <> o.hash THEN n.mtime ELSE o.mtime END FROM old o LEFT JOIN new n USING (path)""",
)
def reindex_times(spark, d):
    old, new = a.snapshots(spark, d)
    times = lambda mode, incremental: index.next_times(old, index.detect_changes(new, old, incremental), incremental).select(F.lit(mode).alias("mode"), "path", "mtime")
    return times("incremental", True).unionAll(times("by hash", False))


@query("reindex_files", f"WITH {_SNAP} SELECT n.path, n.hash, {_NEXT} AS mtime, CASE WHEN n.hash = o.hash THEN o.summary END AS summary FROM new n LEFT JOIN old o USING (path)")
def reindex_files(spark, d):
    old, new = a.snapshots(spark, d)
    files = old.select(F.xxhash64("path").alias("id"), "path", "hash", F.lit(0.0).alias("rank"), "mtime", "summary", F.lit(None).cast("string").alias("when_to_use"))
    none = lambda schema: spark.createDataFrame([], schema)
    state = {"files": files, "symbols": none("file_id long, name string, kind string, is_exported boolean, ref_count long"), "edges": none("source_id long, target_id long, edge_type string, specifier string")}
    parsed = none("path string, name string, kind string, is_exported boolean, ref_count long"), none("source string, target string, edge_type string, specifier string")
    return index.reindex(state, new.withColumn("content", F.lit("")), lambda _: parsed)["files"].select("path", "hash", "mtime", "summary")


@query("upsert_files", f"WITH {_SNAP} SELECT coalesce(n.path, o.path) AS path, coalesce(n.hash, o.hash) AS hash, coalesce(n.mtime, o.mtime) AS mtime, CASE WHEN n.hash IS NULL OR n.hash = o.hash THEN o.summary END AS summary FROM old o FULL JOIN new n ON n.path = o.path")
def upsert_files(spark, d):
    return index.upsert_files(*a.snapshots(spark, d))


@query("stale_delete", f"WITH {_SNAP} SELECT * FROM old WHERE path IN (SELECT path FROM new)")
def stale_delete(spark, d):
    old, new = a.snapshots(spark, d)
    return index.delete_stale(old, new)


@query("stale_paths", f"WITH {_SNAP} SELECT path FROM old EXCEPT SELECT path FROM new")
def stale_paths(spark, d):
    old, new = a.snapshots(spark, d)
    return old.select("path").exceptAll(new.select("path"))


@query("cascade_delete", f"WITH {_FILES}, {_SYMBOLS}, {_EDGES}, kept AS (SELECT id FROM files WHERE id % 4 <> 0) SELECT 'symbols' AS kind, count(*) AS n FROM symbols WHERE file_id IN (FROM kept) UNION ALL SELECT 'edges', count(*) FROM edges WHERE source_id IN (FROM kept) AND target_id IN (FROM kept)")
def cascade_delete(spark, d):
    files, symbols, edges = _model(spark, d)
    s, e = index.cascade(files.where("id % 4 <> 0"), symbols, edges)
    return s.agg(F.count("*").alias("n")).select(F.lit("symbols").alias("kind"), "n").unionAll(e.agg(F.count("*").alias("n")).select(F.lit("edges"), "n"))


@query("symbol_replace", f"WITH {_SYMBOLS} SELECT file_id, name, ref_count FROM symbols WHERE file_id % 5 <> 0 UNION ALL SELECT file_id, 'new_' || name, ref_count + 1 FROM symbols WHERE file_id % 5 = 0")
def symbol_replace(spark, d):
    s = a.symbols(spark, d).select("file_id", "name", "ref_count")
    changed = s.where("file_id % 5 = 0")
    return index.replace_rows(s, changed.select("file_id", F.concat(F.lit("new_"), "name").alias("name"), (F.col("ref_count") + 1).alias("ref_count")), changed, "file_id")


@query("edge_replace", f"WITH {_EDGES} SELECT source_id, target_id, edge_type FROM edges WHERE source_id % 5 <> 0 UNION ALL SELECT source_id, target_id, 'Import' FROM edges WHERE source_id % 5 = 0 AND edge_type = 'ReExport'")
def edge_replace(spark, d):
    e = a.edges(spark, d).select("source_id", "target_id", "edge_type")
    changed = e.where("source_id % 5 = 0")
    return index.graph_edges(changed.where("edge_type = 'ReExport'").withColumn("edge_type", F.lit("Import")), e, changed)


@query("rank_update", f"WITH {_FILES} SELECT id, path, round(CASE WHEN id % 3 = 0 THEN id / 100.0 ELSE rank END, 6) AS rank FROM files")
def rank_update(spark, d):
    f = a.files(spark, d)
    return _rounded(index.update_ranks(f, f.where("id % 3 = 0").select("id", (F.col("id") / 100.0).alias("rank"))).select("id", "path", "rank"), "rank")


@query("mtime_update", f"WITH {_FILES} SELECT path, CASE WHEN id % 3 = 0 THEN mtime + 1 ELSE mtime END AS mtime FROM files")
def mtime_update(spark, d):
    f = a.files(spark, d)
    return index.update_mtimes(f, f.where("id % 3 = 0").select("path", (F.col("mtime") + 1).alias("mtime"))).select("path", "mtime")


@query("set_texts", f"WITH {_FILES} SELECT path, CASE WHEN id % 6 = 0 THEN 'set ' || path ELSE summary END AS summary, CASE WHEN id % 6 = 0 THEN 'when ' || id ELSE when_to_use END AS when_to_use FROM files")
def set_texts(spark, d):
    f = a.files(spark, d)
    new = f.where("id % 6 = 0").select("path", F.concat(F.lit("set "), "path").alias("summary"), F.concat(F.lit("when "), F.col("id").cast("string")).alias("when_to_use"))
    return index.set_texts(f, new).select("path", "summary", "when_to_use")


@query("clear_texts", f"WITH {_FILES} SELECT path, CASE WHEN id <> 5 THEN summary END AS summary, CASE WHEN id <> 5 THEN when_to_use END AS when_to_use FROM files")
def clear_texts(spark, d):
    f = a.files(spark, d)
    return index.clear_texts(f, _path(f)).select("path", "summary", "when_to_use")


@query("clear_all_texts", f"WITH {_FILES} SELECT count(*) AS cleared FROM files WHERE summary IS NOT NULL")
def clear_all_texts(spark, d):
    f = a.files(spark, d)
    gone = index.clear_texts(f).where("summary is null and when_to_use is null").select("path")
    return f.where("summary is not null").join(gone, "path", "left_semi").agg(F.count("*").alias("cleared"))


@query("copies_by_hash", "SELECT sha256(text) AS hash, count(*) AS copies, min('docs/' || source || '/' || doc_id) AS first_path FROM documents GROUP BY 1 HAVING count(*) > 1")
def copies_by_hash(spark, d):
    return index.same_content(a.sources(spark, d).select("path", F.sha2("content", 256).alias("hash")))


# --- enrichment ---


@query("prompt_cost", f"WITH {_FILES}, {_SYMBOLS}, {_DESCRIBED}, t AS (SELECT count(*) AS files, sum(200 + strlen(path) + coalesce(list_sum(list_transform(exports, lambda x: strlen(x) + 4)), 0))::BIGINT AS chars FROM described WHERE summary IS NULL) SELECT files, chars, round(chars / 3.5, 6) AS input_tokens, (150 * files)::DOUBLE AS output_tokens, round((0.10 * chars / 3.5 + 0.40 * 150 * files) / 1e6 * 0.5, 6) AS dollars FROM t")
def prompt_cost(spark, d):
    return _rounded(enrich.cost(enrich.unenriched(_described(spark, d)), "gemini", batch=True), "input_tokens", "dollars")


@query("prompts", f"""WITH {_FILES}, {_SYMBOLS}, {_DESCRIBED} SELECT path, md5('Describe a JavaScript file in one sentence, and say when to change it.' || chr(10) || 'Path: ' || path || CASE WHEN len(exports) > 0 THEN chr(10) || 'Exports: ' || array_to_string(exports, ', ') ELSE '' END || chr(10) || 'Answer as JSON: {{"summary": "...", "when_to_use": "..."}}') AS prompt FROM described""")
def prompts(spark, d):
    return enrich.prompts(_described(spark, d)).select("path", F.md5(F.col("prompt").cast("binary")).alias("prompt"))


@query("enrich_offline", f"WITH {_FILES} SELECT path, coalesce(summary, 'File ' || path) AS summary FROM files")
def enrich_offline(spark, d):
    described = _described(spark, d)
    replies = enrich.describe(enrich.prompts(enrich.unenriched(described)), enrich.Offline())
    return enrich.apply_replies(described, replies)[0].select("path", "summary")


# --- text forms ---


@query("truncated_texts", "SELECT doc_id, left(text, list_max(list_filter(range(0, 101), lambda n: strlen(left(text, n)) <= 100))::BIGINT) AS head FROM documents")
def truncated_texts(spark, d):
    return a.read(spark, d, "documents").select("doc_id", tx.truncated(F.col("text"), 100).alias("head"))


@query("languages", "SELECT url, CASE WHEN ends_with(url, '.ts') OR ends_with(url, '.tsx') THEN 'TypeScript' ELSE 'JavaScript' END AS language FROM pages")
def languages(spark, d):
    return a.read(spark, d, "pages").select("url", tx.language(F.col("url")).alias("language"))


@query("query_paths", "SELECT page_id, CASE WHEN starts_with(p, './') THEN substr(p, 3) ELSE p END AS path FROM (SELECT page_id, CASE WHEN starts_with(url, 'https:/') THEN substr(url, 8) ELSE url END AS p FROM pages)")
def query_paths(spark, d):
    return a.read(spark, d, "pages").select("page_id", tx.query_path(F.col("url"), "https:/").alias("path"))


@query(
    "resolve_imports",
    f"""WITH {_FILES}, {_EDGES}, paths AS (SELECT CASE WHEN id % 3 = 0 THEN 'src/m' || id || '.ts' WHEN id % 3 = 1 THEN 'src/m' || id || '/index.tsx' ELSE 'src/m' || id || '.jsx' END AS path, id FROM files WHERE id % 7 <> 0)
SELECT 'src/a/f' || source_id || '.ts' AS path, '../m' || target_id || CASE WHEN target_id % 3 = 0 THEN '.js' ELSE '' END AS specifier, p.path AS target FROM (SELECT DISTINCT source_id, target_id FROM edges) e JOIN paths p ON p.id = e.target_id""",
)
def resolve_imports(spark, d):
    n = F.col("id").cast("string")
    paths = a.files(spark, d).where("id % 7 <> 0").select(F.when(F.col("id") % 3 == 0, F.concat(F.lit("src/m"), n, F.lit(".ts"))).when(F.col("id") % 3 == 1, F.concat(F.lit("src/m"), n, F.lit("/index.tsx"))).otherwise(F.concat(F.lit("src/m"), n, F.lit(".jsx"))).alias("path"))
    t = F.col("target_id").cast("string")
    imports = a.edges(spark, d).select("source_id", "target_id").distinct().select(F.concat(F.lit("src/a/f"), F.col("source_id").cast("string"), F.lit(".ts")).alias("path"), F.concat(F.lit("../m"), t, F.when(F.col("target_id") % 3 == 0, ".js").otherwise("")).alias("specifier"))
    return resolve.resolve(imports, paths)


# --- parsing ---

_MODULE = "'m' || {} || '.ts'"


@query("parsed_imports", f"WITH {_EDGES} SELECT {_MODULE.format('source_id')} AS path, './m' || target_id AS source, CASE edge_type WHEN 'Import' THEN 'n' || specifier ELSE '*' END AS name, CASE edge_type WHEN 'Import' THEN 'Named' ELSE 'Namespace' END AS kind FROM edges WHERE edge_type <> 'ReExport'")
def parsed_imports(spark, d):
    return extract.import_rows(extract.parse_sources(a.code(spark, d), ("imports",)))


@query("parsed_reexports", f"WITH {_EDGES} SELECT {_MODULE.format('source_id')} AS path, './m' || target_id AS source, 'a' AS local, 'n' || specifier AS exported FROM edges WHERE edge_type = 'ReExport'")
def parsed_reexports(spark, d):
    return extract.reexport_rows(extract.parse_sources(a.code(spark, d), ("reexports",)))


@query("parsed_symbols", f"WITH {_SYMBOLS} SELECT {_MODULE.format('file_id')} AS path, replace(name, '#', '_') AS name, CASE WHEN is_exported THEN kind ELSE 'Variable' END AS kind, is_exported FROM symbols")
def parsed_symbols(spark, d):
    rows = extract.symbol_rows(extract.parse_sources(a.code(spark, d), ("exports", "symbols")))
    return rows.where("name like 'Supplier%'").select("path", "name", "kind", "is_exported")


@query("parsed_signatures", f"""WITH {_SYMBOLS} SELECT {_MODULE.format('file_id')} AS path, CASE WHEN is_exported THEN 'export ' ELSE '' END || CASE kind WHEN 'Function' THEN 'function ' || replace(name, '#', '_') || '(a: string, b = `x$' WHEN 'Class' THEN 'class ' || replace(name, '#', '_') ELSE 'const ' || replace(name, '#', '_') END AS signature FROM symbols""")
def parsed_signatures(spark, d):
    return extract.parse_sources(a.code(spark, d), ("signatures",)).select("path", F.explode("signatures").alias("signature"))


@query("parsed_edges", f"WITH {_EDGES}, known AS (SELECT source_id AS id FROM edges UNION SELECT l_partkey FROM lineitem) SELECT {_MODULE.format('source_id')} AS source, {_MODULE.format('target_id')} AS target, edge_type, './m' || target_id AS specifier FROM edges WHERE target_id IN (FROM known)")
def parsed_edges(spark, d):
    parsed = stored(extract.parse_sources(a.code(spark, d), ("imports", "reexports")))  # three branches read it
    return resolve.import_edges(extract.import_rows(parsed), extract.reexport_rows(parsed), parsed.select("path"))


@query("node_set", f"WITH {_FILES}, {_EDGES} SELECT id FROM files UNION SELECT source_id FROM edges UNION SELECT target_id FROM edges")
def node_set(spark, d):
    e = a.edges(spark, d)
    return a.files(spark, d).select("id").union(e.select("source_id")).union(e.select("target_id")).distinct()


# --- evaluation ---


@query("case_metrics", f"WITH {_RESULTS} SELECT case_id, round(p_at_5, 6) AS p_at_5, round(p_at_10, 6) AS p_at_10, round(r_at_5, 6) AS r_at_5, round(r_at_10, 6) AS r_at_10, round(mrr, 6) AS mrr, round(ndcg_at_10, 6) AS ndcg_at_10 FROM metrics")
def case_metrics(spark, d):
    m = evaluate.case_metrics(a.ranked_results(spark, d))
    return _rounded(m, *[c for c in m.columns if c != "case_id"])


@query("macro_metrics", f"WITH {_RESULTS} SELECT count(*) AS cases, round(avg(p_at_5), 6) AS p_at_5, round(avg(p_at_10), 6) AS p_at_10, round(avg(r_at_5), 6) AS r_at_5, round(avg(r_at_10), 6) AS r_at_10, round(avg(mrr), 6) AS mrr, round(avg(ndcg_at_10), 6) AS ndcg_at_10 FROM metrics")
def macro_metrics(spark, d):
    m = evaluate.macro(evaluate.case_metrics(a.ranked_results(spark, d)))
    return _rounded(m, *[c for c in m.columns if c != "cases"])


_CASES = """qs AS (SELECT item_id AS qid, query, unnest(list_filter(list_transform(regexp_split_to_array(lower(query), '\\s+'), lambda w: w), lambda w: w <> '' AND w NOT IN (""" + _STOP + """))) AS k FROM (SELECT id AS item_id, lower(p_name) || ' ' || lower(p_type) AS query FROM files JOIN part ON id = p_partkey WHERE id % 100 = 0)),
direct AS (SELECT qid, id, path, rank, sum(3 * p::INT + 2 * e::INT + 3 * s::INT + 4 * w::INT) AS raw FROM (SELECT DISTINCT qid, id, path, rank, k, len(list_filter(regexp_split_to_array(lower(path), '[/.]'), lambda c: contains(c, k))) > 0 AS p,
   len(list_filter(exports, lambda c: contains(lower(c), k))) > 0 AS e, coalesce(contains(lower(summary), k), false) AS s, coalesce(contains(lower(when_to_use), k), false) AS w FROM described, qs) GROUP BY ALL),
hits AS (SELECT qid, id, path, rank, raw * greatest(rank, 0.01) AS score FROM direct WHERE raw > 0),
both_ AS (SELECT source_id AS id, target_id AS o FROM edges UNION SELECT target_id, source_id FROM edges), near AS (SELECT qid, o AS id, max(score) AS best FROM hits JOIN both_ USING (id) GROUP BY qid, o),
res AS (SELECT qid, f.path, greatest(coalesce(h.score, 0), 0.3 * coalesce(n.best, 0)) AS score FROM hits h FULL JOIN near n USING (qid, id) JOIN files f USING (id)),
want AS (SELECT id AS qid, path FROM files WHERE id % 100 = 0),
pos AS (SELECT r.qid, w.path IS NOT NULL AS hit, row_number() OVER (PARTITION BY r.qid ORDER BY score DESC, r.path) AS pos FROM res r LEFT JOIN want w ON w.qid = r.qid AND w.path = r.path)"""


@query("score_dataset", f"WITH {_FILES}, {_SYMBOLS}, {_EDGES}, {_DESCRIBED}, {_CASES} SELECT qid AS case_id, round(coalesce(max(1.0 / pos) FILTER (hit), 0), 6) AS mrr, round(coalesce(sum(1.0 / log2(pos + 1)) FILTER (hit AND pos <= 10), 0), 6) AS ndcg_at_10 FROM pos GROUP BY qid")
def score_dataset(spark, d):
    files, symbols, edges = _model(spark, d)
    part = a.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lower("p_name"), F.lit(" "), F.lower("p_type")).alias("query"))
    cases = files.where("id % 100 = 0").join(part, "id").select(F.col("id").alias("case_id"), "query", "path", F.lit(1).cast("long").alias("relevance"))
    return _rounded(evaluate.score_dataset(files, symbols, edges, cases).select("case_id", "mrr", "ndcg_at_10"), "mrr", "ndcg_at_10")


@query("latest_run", f"WITH {_RUNS} SELECT dataset, id, git_commit, round(ndcg, 6) AS ndcg FROM runs QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY id DESC) = 1")
def latest_run(spark, d):
    return _rounded(evaluate.latest_runs(a.runs(spark, d)).select("dataset", "id", "git_commit", "ndcg"), "ndcg")


@query("latest_run_of_commit", f"WITH {_RUNS} SELECT dataset, id, git_commit FROM runs WHERE git_commit ILIKE 'A%' AND layer = 'relevance' QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY id DESC) = 1")
def latest_run_of_commit(spark, d):
    return evaluate.latest_runs(a.runs(spark, d), "A").select("dataset", "id", "git_commit")


@query("compare_runs", f"WITH {_RUNS}, b AS (SELECT dataset, ndcg FROM runs WHERE id < 100 QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY id DESC) = 1), n AS (SELECT dataset, ndcg FROM runs QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY id DESC) = 1) SELECT dataset, round(b.ndcg, 6) AS before, round(n.ndcg, 6) AS after, round(n.ndcg - b.ndcg, 6) AS delta, round(CASE WHEN b.ndcg > 0 THEN 100.0 * (n.ndcg - b.ndcg) / b.ndcg ELSE 0 END, 6) AS pct FROM b JOIN n USING (dataset)")
def compare_runs(spark, d):
    r = a.runs(spark, d)
    return _rounded(evaluate.compare_runs(evaluate.latest_runs(r.where("id < 100")), evaluate.latest_runs(r)), "before", "after", "delta", "pct")


@query("run_history", f"WITH {_RUNS} SELECT id, git_commit, dataset, CAST(json_extract_string(metrics, '$.k') AS DOUBLE) AS k FROM runs ORDER BY id DESC LIMIT 20")
def run_history(spark, d):
    return a.runs(spark, d).orderBy(F.desc("id")).limit(20).select("id", "git_commit", "dataset", evaluate.json_number("metrics", "$.k").alias("k"))


@query("session_tools", f"WITH {_SESSIONS}, c AS (SELECT session, tool, count(*) AS n FROM sessions GROUP BY ALL) SELECT session, sum(n)::BIGINT AS total, string_agg(tool || '=' || n, ',' ORDER BY tool) AS by_tool FROM c GROUP BY session")
def session_tools(spark, d):
    r = sessions.tool_counts(a.sessions(spark, d))
    pairs = F.array_sort(F.transform(F.map_entries("by_tool"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))
    return r.select("session", "total", F.array_join(pairs, ",").alias("by_tool"))


@query("session_first_relevant", f"WITH {_SESSIONS}, t AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY line) AS turn FROM sessions) SELECT session, (min(turn) FILTER (arg >= 90))::BIGINT AS first_relevant_turn FROM t GROUP BY session")
def session_first_relevant(spark, d):
    r = sessions.first_turn(a.sessions(spark, d), F.col("arg") >= 90)
    return r.select("session", F.col("first_relevant_turn").cast("long").alias("first_relevant_turn"))


@query("session_mentions", "SELECT DISTINCT c.conv_id, c.turn, n.name FROM conversations c, (SELECT DISTINCT lower(split_part(text, ' ', 2)) AS name FROM benchmark) n WHERE contains(c.text, n.name)")
def session_mentions(spark, d):
    names = a.read(spark, d, "benchmark").select(F.lower(F.split_part("text", F.lit(" "), F.lit(2))).alias("name"))
    texts = a.read(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("id"), "text")
    return sessions.mentions(texts, names).select("id.conv_id", "id.turn", "name").distinct()


@query("json_file_list", "SELECT item_id, len(list_filter(string_split(text, ' '), lambda x: true))::BIGINT AS n FROM benchmark")
def json_file_list(spark, d):
    words = F.split("text", " ")
    said = F.concat(F.lit("So: "), F.to_json(F.struct(words.alias("relevant_files"))), F.lit(" Done."))
    return a.read(spark, d, "benchmark").select("item_id", F.size(evaluate.identified(said)).cast("long").alias("n"))


@query("list_scores", f"""WITH b AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark), s AS (SELECT item_id, w[1:10] AS found, w[6:20] AS want FROM b),
h AS (SELECT item_id, len(list_intersect(found, want)) / len(list_distinct(want)) AS r, len(list_filter(found, lambda x: list_contains(want, x))) / len(found) AS p FROM s)
SELECT item_id, round(r, 6) AS recall, round(p, 6) AS "precision", round(CASE WHEN r + p > 0 THEN 2 * r * p / (r + p) ELSE 0 END, 6) AS f1 FROM h""")
def list_scores(spark, d):
    w = F.split("text", " ")
    recall, precision, f1 = evaluate.list_scores(F.slice(w, 1, 10), F.slice(w, 6, 15))
    return _rounded(a.read(spark, d, "benchmark").select("item_id", recall.alias("recall"), precision.alias("precision"), f1.alias("f1")), "recall", "precision", "f1")


@query("chosen_cases", f"WITH {_RESULTS} SELECT case_id, round(mrr, 6) AS mrr FROM metrics WHERE case_id IN (1, 5, 7)")
def chosen_cases(spark, d):
    return _rounded(evaluate.case_metrics(evaluate.only_cases(a.ranked_results(spark, d), "1, 5,7")).select("case_id", "mrr"), "mrr")


@query("session_flags", f"WITH {_SESSIONS} SELECT session, bool_or(tool = 'error') AS failed, count(DISTINCT arg) AS args, max(value) AS most FROM sessions GROUP BY session")
def session_flags(spark, d):
    return a.sessions(spark, d).groupBy("session").agg(F.bool_or(F.col("tool") == "error").alias("failed"), F.count_distinct("arg").alias("args"), F.max("value").alias("most"))


@query(
    "session_metrics",
    f"""WITH {_SESSIONS}, t AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY line) AS turn FROM sessions)
SELECT session, count(*) AS calls, count(DISTINCT tool) AS tools, array_to_string(list_sort(list(DISTINCT arg::VARCHAR)), ' ') AS files, min(turn) FILTER (arg >= 90) AS first_relevant_turn, bool_or(tool = 'error') AS hooked FROM t GROUP BY session""",
)
def session_metrics(spark, d):
    calls = a.sessions(spark, d).withColumn("file", F.col("arg").cast("string"))
    m = sessions.metrics(calls, F.col("arg") >= 90, F.col("tool") == "error")
    return m.select("session", "calls", F.size("by_tool").cast("long").alias("tools"), F.array_join("files", " ").alias("files"), F.col("first_relevant_turn").cast("long").alias("first_relevant_turn"), "hooked")


@query("paths_below", "SELECT page_id, regexp_replace(CASE WHEN starts_with(url, 'https://') THEN substr(url, 9) ELSE url END, '^(\\./)+', '') AS path FROM pages")
def paths_below(spark, d):
    return a.read(spark, d, "pages").select("page_id", tx.below(F.col("url"), "https://").alias("path"))


_WIN = "w AS (SELECT *, row_number() OVER k AS n, lead(f1) OVER k AS f2, lead(tools) OVER k AS t2 FROM variants WINDOW k AS (PARTITION BY case_id ORDER BY f1 DESC, tools, variant)), win AS (SELECT case_id, CASE WHEN f2 IS NULL OR f1 > f2 + 0.01 OR tools < t2 THEN variant ELSE 'tie' END AS winner FROM w WHERE n = 1)"


@query("f1_winners", f"WITH {_VARIANTS}, {_WIN} SELECT winner, count(*) AS n FROM win GROUP BY winner")
def f1_winners(spark, d):
    return evaluate.winners(a.variants(spark, d)).groupBy("winner").agg(F.count("*").alias("n"))


_PAIR = "p AS (SELECT max(f1) FILTER (variant = 'treatment') AS fa, max(f1) FILTER (variant = 'control') AS fb, max(tools) FILTER (variant = 'treatment') AS ta, max(tools) FILTER (variant = 'control') AS tb FROM variants GROUP BY case_id), s AS (SELECT CASE WHEN fa - fb > 0.01 THEN 1 WHEN fa - fb < -0.01 THEN -1 WHEN ta < tb THEN 1 WHEN ta > tb THEN -1 ELSE 0 END AS s FROM p WHERE fa IS NOT NULL AND fb IS NOT NULL)"


@query("pairwise", f"WITH {_VARIANTS}, {_PAIR} SELECT count(*) FILTER (s > 0) AS wins_a, count(*) FILTER (s < 0) AS wins_b, count(*) FILTER (s = 0) AS ties FROM s")
def pairwise(spark, d):
    return evaluate.pairwise(a.variants(spark, d), "treatment", "control")


@query(
    "sign_test",
    f"""WITH {_SESSIONS}, c AS (SELECT session, count(*) FILTER (arg >= 50) AS a, count(*) FILTER (arg < 50) AS b FROM sessions GROUP BY session)
SELECT session, a, b, round(CASE WHEN a + b = 0 THEN 1 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(a + b + 1) - lgamma(i + 1) - lgamma(a + b - i + 1) - (a + b) * ln(2))) FROM range(0, least(a, b) + 1) t(i))) END, 6) AS p FROM c""",
)
def sign_test(spark, d):
    c = a.sessions(spark, d).groupBy("session").agg(F.count_if(F.col("arg") >= 50).alias("a"), F.count_if(F.col("arg") < 50).alias("b"))
    return _rounded(c.withColumn("p", evaluate.sign_test(F.col("a"), F.col("b"))), "p")


@query("variant_means", f"WITH {_VARIANTS}, b AS (SELECT *, count(*) OVER (PARTITION BY case_id) AS m FROM variants), n AS (SELECT count(DISTINCT case_id) AS n FROM b WHERE m >= 2) SELECT variant, n, round(sum(f1) / n, 6) AS f1, round(sum(tools) / n, 6) AS tools FROM b, n WHERE m >= 2 GROUP BY variant, n")
def variant_means(spark, d):
    return _rounded(evaluate.variant_means(a.variants(spark, d)), "f1", "tools")

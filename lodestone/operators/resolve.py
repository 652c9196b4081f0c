"""Import resolution: every base that a path could be meant by, with its priority, met with the bases of the specifiers."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Endings tried in order, and what a compiled ending stands for.
EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".json"]
ALIASES = {".js": [".ts", ".tsx", ".js"], ".mjs": [".mts", ".mjs"]}


def joined(base, specifier):
    """base / specifier with . and .. taken out; null if it leads above the root."""
    start = F.struct(F.array().cast("array<string>").alias("p"), F.lit(True).alias("ok"))

    def step(s, part):
        up = F.struct(F.slice(s["p"], 1, F.greatest(F.size(s["p"]) - 1, F.lit(0))).alias("p"), (s["ok"] & (F.size(s["p"]) > 0)).alias("ok"))
        down = F.struct(F.concat(s["p"], F.array(part)).alias("p"), s["ok"].alias("ok"))
        return F.when(part.isin("", "."), s).when(part == "..", up).otherwise(down)

    steps = F.aggregate(F.concat(F.split(base, "/"), F.split(specifier, "/")), start, step, lambda s: F.when(s["ok"], F.array_join(s["p"], "/")))
    # the common case, ./ and ../ before plain names below a plain folder, is cut from the texts, which takes a small part of the time
    plain = specifier.rlike(r"^(\./)?(\.\./)*[^/.][^/]*(/[^/.][^/]*)*$") & base.rlike(r"^([^/.][^/]*(/[^/.][^/]*)*)?$")
    ups = F.length(F.regexp_extract(specifier, r"^(?:\./)?((?:\.\./)*)", 1)) / 3
    deep = F.when(base == "", 0).otherwise(F.length(base) - F.length(F.replace(base, F.lit("/"), F.lit(""))) + 1)
    left, rest = (deep - ups).cast("int"), F.regexp_replace(specifier, r"^(\./)?(\.\./)*", "")
    cut = F.when(left == 0, rest).when(left > 0, F.concat(F.call_function("substring_index", base, F.lit("/"), left), F.lit("/"), rest))
    return F.when(plain, cut).otherwise(steps)


def named(paths: DataFrame) -> DataFrame:
    """(base, target): for each base that a specifier can lead to, the path among paths (path) that it means.

    The forms of a base are, least priority first: those of ALIASES if it has such an ending, itself, with each of EXTENSIONS,
    and an index file in it with each of them. They are undone here from the paths, of which there are fewer than imports."""
    path = F.col("path")
    less = lambda ending: F.substring(path, F.lit(1), F.length(path) - len(ending))
    forms = [F.when(path.endswith(new), F.concat(less(new), F.lit(old))) for old, news in ALIASES.items() for new in news]
    forms += [path, *(F.when(path.endswith(e), less(e)) for e in EXTENSIONS)]
    forms += [F.when(path == f"index{e}", "").when(path.endswith(f"/index{e}") & (path != f"/index{e}"), less(f"/index{e}")) for e in EXTENSIONS]
    found = paths.select("path").where("path is not null").distinct().select(path.alias("target"), F.posexplode(F.array(*forms)).alias("priority", "base"))
    return found.where("base is not null").groupBy("base").agg(F.min_by("target", "priority").alias("target"))


def resolve(imports: DataFrame, paths: DataFrame, rules=None) -> DataFrame:
    """imports (path, specifier, ...) with target: the path of least priority among paths (path) that the specifier could mean;
    imports without one are left out.

    Relative specifiers are taken from the file's folder. rules: (prefix, folder) pairs for others, in order, as in a
    project's path mapping; specifiers that fit none lead nowhere."""
    folder = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit(""))
    relative = F.col("specifier").rlike(r"^\.{1,2}(/|$)")
    base = F.when(relative, joined(F.col("_folder"), F.col("specifier")))
    known = imports.where("path is not null and specifier is not null").withColumn("_folder", folder)
    if not rules:
        # never null, so that no filter on the join's key works it out once more; no path has this character
        return known.withColumn("_base", F.coalesce(base, F.lit("\0"))).join(named(paths).withColumnRenamed("base", "_base"), "_base").select(*imports.columns, "target")
    bases = [base]
    for prefix, target in rules:
        rest = F.substring("specifier", F.lit(len(prefix) + 1), F.length("specifier"))
        bases.append(F.when(~relative & F.startswith("specifier", F.lit(prefix)), joined(F.lit(target), rest)))
    wanted = known.select("path", "specifier", "_folder").distinct().select("path", "specifier", F.posexplode(F.array(*bases)).alias("at", "base")).where("base is not null")
    first = wanted.join(named(paths), "base").groupBy("path", "specifier").agg(F.min_by("target", "at").alias("target"))
    return imports.join(first, ["path", "specifier"]).select(*imports.columns, "target")


def import_edges(imports: DataFrame, reexports: DataFrame, paths: DataFrame, rules=None) -> DataFrame:
    """(source, target, edge_type, specifier): one edge per imported name; namespace imports are TypeImport, re-exports ReExport."""
    i = imports.select("path", F.col("source").alias("specifier"), F.when(F.col("kind") == "Namespace", "TypeImport").otherwise("Import").alias("edge_type"))
    r = reexports.select("path", F.col("source").alias("specifier"), F.lit("ReExport").alias("edge_type"))
    return resolve(i.unionByName(r), paths, rules).select(F.col("path").alias("source"), "target", "edge_type", "specifier")

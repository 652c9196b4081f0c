"""Query words, byte-exact cuts, path forms, languages and prompt sizes as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a query does not search for.
STOP_WORDS = """
a an the is are was were be been being to for and or of in on with at by from as it its this that do does did has have had
will would could should can may might shall not no but if then so than too very just about into over after before between
through during each every all both some any most other new old
""".split()


def keywords(query) -> Column:
    """Lower-case words of a query without marks at their ends, stop words and repeats, in order of first appearance."""
    q = F.lit(query) if isinstance(query, str) else query
    words = F.transform(F.split(F.lower(q), r"(?U)\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.array_distinct(F.filter(words, lambda w: (w != "") & ~w.isin(STOP_WORDS)))


def truncated(text: Column, limit: int) -> Column:
    """The longest prefix of whole characters that fits limit bytes."""
    raw = F.encode(text, "UTF-8")
    # a byte 10xxxxxx goes on with a character: step back from the cut while the next byte is one
    code = lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("int")
    inside = lambda i: code(i).between(128, 191)
    cut = F.when(~inside(F.lit(limit + 1)), limit)
    for back in range(1, 4):
        cut = cut.when(~inside(F.lit(max(1, limit + 1 - back))), max(0, limit - back))
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.decode(F.substring(raw, F.lit(1), cut.otherwise(0)), "UTF-8"))


def like_anywhere(column: Column, pattern: str) -> Column:
    """Substring match in which letters match in either case and % and _ are wildcards; a backslash is itself."""
    return column.ilike("%" + pattern.replace("\\", "\\\\") + "%")


def query_path(path: Column, root: str) -> Column:
    """A path as the index has it: slashes forward, below root or relative without ./"""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    base = root.replace("\\", "/").rstrip("/") + "/"
    p = F.when(p.startswith(base), F.substring(p, F.lit(len(base) + 1), F.length(p))).otherwise(p)
    return F.when(p.startswith("./"), F.substring(p, F.lit(3), F.length(p))).otherwise(p)


def language(path: Column) -> Column:
    return F.when(path.endswith(".ts") | path.endswith(".tsx"), "TypeScript").otherwise("JavaScript")


def prompt_chars(path: Column, exports: Column) -> Column:
    """Estimated length of the prompt that describes a file: 200, its path, and each export with 4 more."""
    return (F.lit(200) + F.octet_length(path) + F.aggregate(exports, F.lit(0), lambda a, x: a + F.octet_length(x) + 4)).cast("long")


def below(path, root: str):
    """path as seen from root: without it if it lies below, and without a leading "./"; others as they are."""
    base = root if root.endswith("/") else f"{root}/"
    cut = F.when(path.startswith(base), F.substring(path, len(base) + 1, 1_000_000)).otherwise(path)
    return F.regexp_replace(cut, r"^(\./)+", "")

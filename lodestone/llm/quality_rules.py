"""Quality rules: a threshold table compiled into one projection of built-in expressions.

Every figure of a text (lengths, symbols, stop words, lines, repeated windows) is a column expression, and every rule is a
row (name, ratio, least, most) of RULES; compiling the table gives one boolean expression. No shuffle, no user function.

Edge cases: a null or empty text has no words, so base_failed is true and kept false; whole texts of any length are
measured; repeated rows each get their row; other columns pass through and may have any name that is not one of the added."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import BLANKS, let, table, words_of

# The commonest function words of the languages that the rules know, in lower case.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "on", "with", "as", "was", "at", "by", "be", "this", "from", "or", "are", "an"],
    "fr": ["le", "la", "les", "de", "des", "du", "et", "un", "une", "est", "que", "qui", "en", "pour", "dans", "au", "par", "sur", "il", "elle"],
    "de": ["der", "die", "das", "und", "ist", "ein", "eine", "zu", "den", "mit", "von", "im", "sich", "nicht", "auf", "dem", "des", "für"],
    "es": ["el", "la", "los", "las", "de", "que", "y", "un", "una", "es", "en", "por", "con", "para", "del", "se", "lo", "al", "su", "como"],
}
SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """Keep a text while least <= top / bottom <= most; a ratio over nothing counts as 0."""

    name: str
    top: str
    bottom: str
    least: float = float("-inf")
    most: float = float("inf")


RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 20.0),
    Rule("symbols_to_words", "n_symbols", "n_words", most=0.1),
    Rule("stop_words", "n_stop_words", "n_words", least=0.02),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", most=0.4),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", most=0.3),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", most=0.9),
    Rule("repeated_words", "n_repeat_words", "n_words", most=0.3),
)


def _repeat_words(hashes: Column) -> Column:
    """Words inside windows whose hash comes twice or more: sort (hash, place), keep equal neighbours, add up the union of [place, place + 8)."""
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda s, i, d: F.coalesce(F.get(s, i + d)["h"] == F.get(s, i)["h"], F.lit(False))
    twice = let(placed, lambda s: F.array_sort(F.transform(F.filter(s, lambda x, i: same(s, i, -1) | same(s, i, 1)), lambda x: x["i"])))
    covered = let(twice, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), covered).otherwise(F.lit(0).cast("long"))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_ellipsis_lines, n_bullet_lines, n_stop_words and n_repeat_words (long).

    Windows are compared by 64-bit hash: two different windows of one text count as equal with a chance of about 1e-11 for 20,000 words."""
    t, stop = F.coalesce(F.col(text), F.lit("")), sorted({w for ws in STOP_WORDS.values() for w in ws})
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    n = F.size("_words")
    count = lambda c: c.cast("long")
    return (
        docs.withColumns({"_words": words_of(F.col(text)), "_lines": lines})
        .withColumn("_windows", F.when(n > WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>")))
        .withColumns(
            {
                "n_words": count(n),
                "word_chars": count(F.length(F.translate(t, BLANKS, ""))),
                "n_symbols": count(F.length(t) - F.length(F.translate(t, SYMBOLS, ""))),
                "n_lines": count(F.size("_lines")),
                "n_dup_lines": count(F.size("_lines") - F.size(F.array_distinct("_lines"))),
                "n_ellipsis_lines": count(F.size(F.filter("_lines", lambda x: x.endswith("...") | x.endswith("…")))),
                "n_bullet_lines": count(F.size(F.filter("_lines", lambda x: x.startswith("- ") | x.startswith("* ") | x.startswith("•")))),
                "n_stop_words": count(F.size(F.filter("_words", lambda w: w.isin(stop)))),
                "n_repeat_words": _repeat_words(F.col("_windows")),
            }
        )
        .drop("_words", "_lines", "_windows")
    )


def verdict(rules=RULES) -> Column:
    """The rules as one expression over the columns of measure()."""
    ok = F.lit(True)
    for r in rules:
        ratio = F.when(F.col(r.bottom) > 0, F.col(r.top) / F.col(r.bottom)).otherwise(F.lit(0.0))
        for bound, test in ((r.least, ratio >= r.least), (r.most, ratio <= r.most)):
            ok = ok & test if abs(bound) != float("inf") else ok
    return ok


def apply_rules(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """docs with the figures of measure(), base_failed and kept."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return measure(docs, text).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op4_quality_rules(spark, sf_dir):
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*cols)


def _sql() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))
    tests = []
    for r in RULES:
        ratio = f"(CASE WHEN {r.bottom} > 0 THEN {r.top}::DOUBLE / {r.bottom} ELSE 0.0 END)"
        tests += [f"{ratio} >= {r.least}"] * (r.least > float("-inf")) + [f"{ratio} <= {r.most}"] * (r.most < float("inf"))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS k FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
twice AS (SELECT rid, k FROM g GROUP BY rid, k HAVING count(*) > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT g.rid, unnest(range(g.i, g.i + 8)) AS p FROM g JOIN twice USING (rid, k)) GROUP BY rid),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
             len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             len(list_filter(ls, lambda x: ends_with(x, '...') OR ends_with(x, '…')))::BIGINT AS n_ellipsis_lines,
             len(list_filter(ls, lambda x: starts_with(x, '- ') OR starts_with(x, '* ') OR starts_with(x, '•')))::BIGINT AS n_bullet_lines,
             len(list_filter(ws, lambda x: x IN ({stop})))::BIGINT AS n_stop_words,
             coalesce(rep.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN rep USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(tests)} AS kept FROM b
"""


QUERIES = {"op4_quality_rules": op4_quality_rules}
ORACLES = {"op4_quality_rules": _sql()}

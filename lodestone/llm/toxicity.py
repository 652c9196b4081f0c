"""Toxicity as severity grades: cumulative-link ordinal regression over sparse word features.

Features are the presence of words (runs of letters, lower case) of the whole text and of word beginnings of some lengths
(marked by a final "~"), which catch stems under many endings. On a bounded sample of labelled rows, features are screened
by the likelihood ratio of their presence in toxic and other texts. The ratio asked for grows with the sample, as chance finds do with the number of features looked at. Labels say toxic or not; how
severe a toxic text is, models that have not seen it say: the sample is cut into FOLDS parts by a hash of the id, each part is
scored by a regression fitted on the others, and the toxic texts are graded 1 to GRADES by thirds of these scores. The regression
then has one weight a word, shared by all grades, and ordered thresholds: P(grade <= k) = sigmoid(threshold_k - w . x). Its output is the expected grade. A text is toxic if w . x reaches the cut that
gives the best F0.5 on the sample, looked for from half the first threshold up (the middle of the gap there).

Edge cases: null and empty texts have no features; a sample without toxic or without other rows gives severity 0 to all;
repeated rows count as often as they come in the sample and each has its row; other columns pass through, but for those of
its own names."""

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import table, tidy
from lodestone.llm.labelled import labelled_sample, scored

#: Labelled rows that the model is fitted on, at most.
BOUND = 30_000
#: Features that the model has, at most, and the likelihood ratio that each needs: so much for each factor of e in the number of labelled texts.
WORDS, RATIO = 2000, 2.0
#: Lengths of word beginnings.
STEMS = (4, 5, 6)
GRADES = 3
#: Parts of the sample that grade each other.
FOLDS = 4
PENALTY = 1e-3


def features_of(text: str) -> set:
    """The words of a text and the beginnings of its longer words."""
    import re

    words = set(re.findall(r"[^\W\d_]+", text.lower()))
    return words.union(*({w[:k] + "~" for w in words if len(w) > k} for k in STEMS))


@dataclass
class Model:
    weights: dict
    thresholds: list
    cut: float = 0.0

    def score(self, texts):
        """Expected grade, most likely side of the first threshold, grade for each text."""
        import re

        found, weights = re.compile(r"[^\W\d_]+").findall, self.weights
        known = {k for k in weights if k[-1:] != "~"}
        begun = {k: {w[:-1] for w in weights if w[-1:] == "~" and len(w) == k + 1} for k in STEMS}

        def total(text):  # as features_of(), without making what has no weight
            words = set(found(text.lower()))
            s = sum(map(weights.__getitem__, sorted(known & words)))
            for k, stems in begun.items():
                if stems:
                    s += sum(weights[w + "~"] for w in sorted(stems & {w[:k] for w in words if len(w) > k}))
            return s

        s = np.array([total(t) for t in texts], float)
        if not self.thresholds:
            return {"severity": np.zeros(len(texts)), "p_toxic": np.zeros(len(texts)), "grade": np.zeros(len(texts), np.int32), "toxic": np.zeros(len(texts), bool)}
        above = 1 / (1 + np.exp(np.clip(np.array(self.thresholds)[None, :] - s[:, None], -500, 500)))
        return {"severity": above.sum(1), "p_toxic": above[:, 0], "grade": (above >= 0.5).sum(1).astype(np.int32), "toxic": s >= self.cut}


def screened(sample: DataFrame) -> list:
    """(word, texts with it, toxic texts with it) of the words kept, best first; and the numbers of texts and of toxic ones."""

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        all_, bad, n = Counter(), Counter(), [0, 0]
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = features_of(t)
                all_.update(words)
                n[0] += 1
                if y:
                    bad.update(words)
                    n[1] += 1
            if len(all_) > 500_000:
                yield pa.RecordBatch.from_pydict({"word": list(all_), "n": list(all_.values()), "bad": [bad[w] for w in all_]})
                all_, bad = Counter(), Counter()
        yield pa.RecordBatch.from_pydict({"word": ["", *all_], "n": [n[0], *all_.values()], "bad": [n[1], *(bad[w] for w in all_)]})

    counts = sample.select("text", "label").mapInArrow(tidy(run), "word string, n long, bad long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = labelled_totals(sample)
    if not total[0] or not total[1] or total[0] == total[1]:
        return [], total
    a, b, n, m = F.col("bad").cast("double"), (F.col("n") - F.col("bad")).cast("double"), float(total[0]), float(total[1])
    term = lambda seen, expected: F.when(seen > 0, seen * F.ln(seen / expected)).otherwise(0.0)
    ratio = 2 * (term(a, F.col("n") * m / n) + term(b, F.col("n") * (n - m) / n) + term(m - a, (n - F.col("n")) * m / n) + term(n - m - b, (n - F.col("n")) * (n - m) / n))
    rows = counts.where((F.col("word") != "") & (F.col("n") >= 3) & (F.col("n") < n)).withColumn("r", ratio).where(F.col("r") >= RATIO * math.log(n)).orderBy(F.desc("r"), "word").limit(WORDS)
    return [(r["word"], r["n"], r["bad"]) for r in rows.collect()], total


def labelled_totals(sample: DataFrame):
    r = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("label") > 0).cast("long")), F.lit(0)).alias("bad")).first()
    return r["n"], r["bad"]


def fit_ordinal(rows, grades, n_features: int, levels: int, penalty: float = PENALTY, steps: int = 600):
    """(weights, thresholds) of the cumulative-link model for sparse 0/1 rows (lists of feature numbers), by Adam on the mean log-likelihood.

    Thresholds are t0, t0 + exp(d1), ...: always in order."""
    size = np.array([len(r) for r in rows])
    col = np.concatenate([np.array(r, np.int64) for r in rows]) if size.sum() else np.empty(0, np.int64)
    row = np.repeat(np.arange(len(rows)), size)
    y = np.asarray(grades)
    share = np.clip([(y > k).mean() for k in range(levels)], 1e-4, 1 - 1e-4)
    t = np.maximum.accumulate(-np.log(share / (1 - share)))
    p = np.concatenate((np.zeros(n_features), [t[0]], np.log(np.maximum(np.diff(t), 1e-2))))
    m, v = np.zeros_like(p), np.zeros_like(p)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, steps + 1):
        w, gaps = p[:n_features], np.exp(p[n_features + 1 :])
        th = p[n_features] + np.concatenate(([0], np.cumsum(gaps)))
        s = np.bincount(row, w[col], len(rows))
        c = np.concatenate((np.zeros((len(rows), 1)), sig(th[None, :] - s[:, None]), np.ones((len(rows), 1))), 1)  # P(grade < k)
        i = np.arange(len(rows))
        lik = np.maximum(c[i, y + 1] - c[i, y], 1e-12)
        d = c * (1 - c)
        g_th = np.zeros((len(rows), levels))
        up, low = y < levels, y > 0
        g_th[i[up], y[up]] -= (d[i, y + 1] / lik)[up]
        g_th[i[low], y[low] - 1] += (d[i, y] / lik)[low]
        g_s = -g_th.sum(1)
        g_t = g_th.mean(0)
        tail = np.cumsum(g_t[::-1])[::-1]
        grad = np.concatenate((np.bincount(col, g_s[row], n_features) / len(rows) + penalty * w / 10, [tail[0]], tail[1:] * gaps))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        p = p - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return p[:n_features], p[n_features] + np.concatenate(([0], np.cumsum(np.exp(p[n_features + 1 :]))))


def graded(rows, y, folds, n_features: int, levels: int):
    """Grades from 0 (y is 0) to at most `levels`, without gaps: toxic rows by quantiles of the scores of models fitted on the other folds."""
    scores = np.zeros(len(rows))
    for k in np.unique(folds):
        mine, others = np.flatnonzero(folds == k), np.flatnonzero(folds != k)
        if 0 < y[others].sum() < len(others):
            w, _ = fit_ordinal([rows[i] for i in others], y[others], n_features, 1, steps=200)
            scores[mine] = [w[rows[i]].sum() for i in mine]
    cuts = np.unique(np.quantile(scores[y > 0], [k / levels for k in range(1, levels)], method="higher"))
    out = np.where(y > 0, 1 + np.searchsorted(cuts, scores, "left"), 0)
    return np.where(out > 0, np.unique(out, return_inverse=True)[1].reshape(-1) + (0 if (out == 0).any() else 1), 0)


def best_cut(s, y, least: float) -> float:
    """The cut of s, at least `least`, with the best F-measure for y (precision counts twice as much as recall): the middle between the scores on its sides."""
    order = np.argsort(-s, kind="stable")
    s, hits = s[order], np.cumsum(y[order])
    n = np.arange(1, len(s) + 1)
    below = np.append(s[1:], -np.inf)
    cuts = np.where(np.isfinite(below), (s + below) / 2, s)
    f = np.where((s > below) & (cuts >= least), 1.25 * hits / (n + 0.25 * y.sum()), -1.0)
    i = int(np.argmax(f))
    return float(cuts[i]) if f[i] > 0 else max(least, 0.0)


def fit(docs: DataFrame, labels: DataFrame, bound: int = BOUND, levels: int = GRADES) -> Model:
    sample = labelled_sample(docs, labels, "toxic", bound)
    words, (n, bad) = screened(sample)
    if not words:
        return Model({}, [])
    number = {w: i for i, (w, _, _) in enumerate(words)}
    def present(batches):
        import pyarrow as pa

        for b in batches:
            rows = [sorted(map(number.__getitem__, number.keys() & features_of(t))) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), *b.columns[1:]], names=["x", "y", "fold"])

    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    got = sample.select("text", "label", fold).mapInArrow(tidy(present), "x array<int>, y int, fold int").collect()  # at most `bound` short lists
    got = sorted(got, key=lambda r: (r["fold"], r["y"], r["x"]))  # the model does not depend on the order of the rows
    rows, y = [r["x"] for r in got], np.array([int(r["y"] > 0) for r in got])
    grades = graded(rows, y, np.array([r["fold"] for r in got]), len(words), levels)
    w, th = fit_ordinal(rows, grades, len(words), int(grades.max()))
    s = np.array([w[r].sum() for r in rows])
    return Model({x: float(w[i]) for x, i in number.items() if math.fabs(w[i]) > 1e-6}, th.tolist(), best_cut(s, y, float(th[0]) / 2))


def grade(docs: DataFrame, model: Model, text: str = "text", keep=None) -> DataFrame:
    """docs with severity (expected grade), p_toxic, grade and toxic."""
    return scored(docs, "severity double, p_toxic double, grade int, toxic boolean", model.score, text, keep)


def op2_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return grade(docs, fit(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLES = {}

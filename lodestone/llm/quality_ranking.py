"""Quality classifier: Bradley-Terry ranking from preference pairs, then a threshold at a score quantile.

Each text is described by shares of characters and of repeated words and lines. In a pair, a text labelled 1 is preferred to
one labelled 0; the weights maximise the logistic likelihood of the pairs' feature differences (Newton steps, ridge). The
threshold is the quantile of the training scores at the share of label 0; scores are mapped to (0, 1) by a logistic curve
fitted to the labels and moved so that the threshold lies at CUT.

Edge cases: null and empty texts have the features of no characters and get a score like any other; labels of kind 1
only, or none at all, give score 1 to all, labels of kind 0 only give score 0; repeated rows each have their row; other columns pass through, but for those of its own names."""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import table, tidy
from lodestone.llm.labelled import labelled_sample, scored

#: Labelled rows that the model is fitted on, and pairs, at most.
BOUND, PAIRS = 20_000, 100_000
CUT = 0.7
RIDGE = 1e-2
SEED = 11
#: Characters that have a feature of their own, besides classes of them.
MARKS = "!?.,;:|#$%&*@<>{}[]()_-+=/\\\"'~^`"
_CLASSES = ["upper", "lower", "digit", "blank", "line", "control", "other"]


def _classes():
    kind = np.full(256, len(MARKS) + 6, np.int64)
    for lo, hi, k in ((0, 31, 5), (65, 90, 0), (97, 122, 1), (48, 57, 2), (32, 32, 3), (10, 10, 4)):
        kind[lo : hi + 1] = len(MARKS) + k
    for i, c in enumerate(MARKS):
        kind[ord(c)] = i
    return kind


NAMES = [*(f"mark {c}" for c in MARKS), *_CLASSES, "characters", "words", "word length", "different words", "same neighbours", "commonest word", "repeated lines", "repeated threes", "line length", "title words", "short words"]


def features(texts) -> np.ndarray:
    """One row of figures per text."""
    kind, out = _classes(), np.zeros((len(texts), len(NAMES)))
    n_kinds = len(MARKS) + len(_CLASSES)
    for i, t in enumerate(texts):
        raw = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
        n = max(1, len(raw))
        share = np.bincount(kind, np.bincount(raw, minlength=256), n_kinds) / n
        words = t.split()
        w = max(1, len(words))
        seen: dict = {}
        for x in words:
            seen[x] = seen.get(x, 0) + 1
        lines = [x for x in t.split("\n") if x.strip()]
        threes = set(zip(words, words[1:], words[2:]))
        out[i, :n_kinds] = np.log1p(1000 * share)
        out[i, n_kinds:] = (
            np.log1p(len(t)),
            np.log1p(len(words)),
            np.log1p(len(t) / w),
            len(seen) / w,
            sum(map(str.__eq__, words, words[1:])) / w,
            max(seen.values(), default=0) / w,
            1 - len(set(lines)) / max(1, len(lines)),
            1 - len(threes) / max(1, len(words) - 2),
            np.log1p(len(t) / max(1, len(lines))),
            sum(map(str.istitle, words)) / w,
            sum(len(x) <= 3 for x in words) / w,
        )
    return out


@dataclass
class Model:
    """weights of the standardised features, and the cut between predictions; without weights, the cut is every text's score."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float
    cut: float

    def raw(self, x):
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, texts):
        if self.weights is None:
            s = np.full(len(texts), self.cut)
        else:
            z = self.slope * (self.raw(features(texts)) - self.cut) + np.log(CUT / (1 - CUT))
            s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return {"score": s, "predicted": (s >= CUT).astype(np.int32)}


def _newton(x, y, ridge, steps=25):
    """Logistic regression of y on x, ridge on all weights."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) / len(y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_ranking(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = RIDGE) -> Model:
    """The model from features and 0/1 labels: every text is in some pair if there are as many pairs as texts."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Model(None, None, None, 1.0, 1.0 if len(good) or not len(bad) else 0.0)
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(SEED)
    n = min(pairs, 20 * max(len(good), len(bad)))
    a = np.concatenate([rng.permutation(good) for _ in range(-(-n // len(good)))])[:n]
    b = np.concatenate([rng.permutation(bad) for _ in range(-(-n // len(bad)))])[:n]
    w = _newton(z[a] - z[b], np.ones(n), ridge)
    s = z @ w
    cut = float(np.quantile(s, len(bad) / len(y)))
    slope = float(max(_newton(np.stack([s - cut, np.ones(len(s))], 1), y.astype(float), 1e-3)[0], 1e-3))
    return Model(mean, scale, w, slope, cut)


def left_out(column: str = "doc_id"):
    """Rows that are never learnt from."""
    return F.crc32(F.col(column).cast("string")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> Model:
    sample = labelled_sample(docs, labels, "quality", bound, unless=left_out())

    def run(batches):
        import pyarrow as pa

        for b in batches:
            x = features(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), b.column(1)], names=["x", "y"])

    got = sample.select("text", "label").mapInArrow(tidy(run), "x array<double>, y int").toPandas()  # at most `bound` rows of len(NAMES) figures
    if not len(got):
        return Model(None, None, None, 1.0, 1.0)
    order = np.lexsort(np.stack(got.x.to_numpy()).T)  # the model does not depend on the order of the rows
    return fit_ranking(np.stack(got.x.to_numpy())[order], (got.y.to_numpy()[order] > 0).astype(int))


def rank(docs: DataFrame, model: Model, text: str = "text", keep=None) -> DataFrame:
    """docs with score and predicted."""
    return scored(docs, "score double, predicted int", model.score, text, keep)


def op10_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rank(docs, fit(docs, table(spark, sf_dir, "labels")), keep=["doc_id"]).select("doc_id", F.coalesce(left_out(), F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES = {"op10_quality": op10_quality}
ORACLES = {}

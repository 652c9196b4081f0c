"""Operators that gather from the corpus, against brute force."""

import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations, count

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import lm_scoring, mixing, near_dedup, quality_ranking, toxicity
from lodestone.llm.common import spread_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- mixing ---


def water_filled(sizes, weights=(5, 2, 1)):
    """Targets by resharing what is above the cap until nothing is."""
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    cap, total = {s: 3 * sizes[s] for s in names}, sum(sizes.values())
    full: set = set()
    while True:
        rest, free = total - sum(cap[s] for s in full), [s for s in names if s not in full]
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap[s]]
        if not over:
            return {s: float(cap[s]) if s in full else share[s] for s in names}
        full |= set(over)


def check_mix(df, got):
    sizes, source = defaultdict(int), {}
    for r in df.collect():
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
        source[r["doc_id"], len(WORD.findall(r["text"] or ""))] = r["source"]
    want, taken, largest = water_filled(sizes), defaultdict(int), defaultdict(int)
    for r in got:
        s = source[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    return {s: (taken[s], want[s], largest[s]) for s in sizes}


def test_mix_targets(spark, data):
    got = mixing.op1_mixing(spark, data).collect()
    sums = check_mix(spark.read.parquet(f"{data}/documents.parquet"), got)
    assert all(abs(t - w) <= max(big / 2 + 1, 0.01 * w) for t, w, big in sums.values())
    assert sorted(map(str, mixing.op1_mixing(spark, data).collect())) == sorted(map(str, got))


def test_shards_decide_what_is_taken(spark, data, monkeypatch):
    """What the tree deals is what is drawn: another tree gives other shards, and blocks that it withholds aren't taken."""
    got = {r["doc_id"]: r for r in mixing.op1_mixing(spark, data).collect()}
    assert all(r["taken"] == r["size"] * len(r["shards"]) for r in got.values())
    assert len({x for r in got.values() for x in r["shards"]}) > 16
    tree = mixing.split_quotas
    monkeypatch.setattr(mixing, "split_quotas", lambda root, shards, seed: tree(root, shards, seed + 1))
    other = {r["doc_id"]: r for r in mixing.op1_mixing(spark, data).collect()}
    assert sum(got[i]["shards"] != other[i]["shards"] for i in got) > len(got) / 4
    monkeypatch.setattr(mixing, "split_quotas", lambda root, shards, seed: tree(root, shards, seed).withColumn("quotas", F.transform("quotas", lambda q: F.floor(q / 2))))
    half = mixing.op1_mixing(spark, data).collect()
    assert sum(r["taken"] for r in half) < 0.6 * sum(r["taken"] for r in got.values())


def test_mixed_rows_are_the_plan(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    plan = Counter((r["doc_id"], x) for r in mixing.op1_mixing(spark, data).collect() for x in r["shards"])
    assert Counter((r["doc_id"], r["shard"]) for r in mixing.mix(docs).select("doc_id", "shard").collect()) == plan


def test_mix_with_many_documents(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 37 + 1).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 100 < 97, F.concat(F.lit("s"), (F.col("id") % 5).cast("string"))).alias("source"))
    sums = check_mix(df, mixing.mix_plan(df).select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("places")).alias("taken")).collect())
    assert all(abs(t - w) <= big / 2 + 1 for t, w, big in sums.values())


def test_mix_odd_rows(spark, odd, none, folder):
    got = mixing.op1_mixing(spark, folder()).collect()
    assert len(got) == odd.count()
    check_mix(odd, got)
    assert all(r["taken"] == 0 for r in got if not r["size"])
    assert mixing.op1_mixing(spark, folder(none)).count() == 0
    assert mixing.mix(odd, shards=4).columns.count("shard") == 1


def test_tree_keeps_sums(spark):
    root = spark.sql("select array(100L, 37L, 0L, 1L, 862L) as quotas")
    for shards in (1, 2, 7, 16):
        rows = mixing.split_quotas(root, shards, 5).collect()
        assert sorted(r["shard"] for r in rows) == list(range(shards))
        q = np.array([r["quotas"] for r in rows])
        assert q.sum(0).tolist() == [100, 37, 0, 1, 862] and (q >= 0).all()
        assert q.sum(1).max() - q.sum(1).min() <= 1 + math.ceil(math.log2(max(shards, 2)))


def test_hypergeometric_draws(spark):
    n, k, m = 60, 20, 30
    u = (F.col("id") + 0.5) / 2000
    got = Counter(r["x"] for r in spark.range(2000).select(mixing._hypergeometric(F.lit(n).cast("long"), F.lit(k).cast("long"), F.lit(m).cast("long"), u).alias("x")).collect())
    for x in range(5, 16):
        p = math.comb(k, x) * math.comb(n - k, m - x) / math.comb(n, m)
        assert got[x] / 2000 == pytest.approx(p, abs=0.001)


def test_mix_uses_no_python(spark, data):
    plan = mixing.op1_mixing(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan


# --- near duplicates ---


def bags_of(texts):
    """Shingles of five words with how often they come, from the words themselves."""
    out = []
    for t in texts:
        w = WORD.findall(t or "")
        out.append(Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 0))) or Counter([tuple(w)] if w else []))
    return out


def brute_classes(rows, similarity=0.8):
    bags, at = bags_of([t for _, t in rows]), list(range(len(rows)))

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    where, total = defaultdict(list), [sum(b.values()) for b in bags]
    for i, b in enumerate(bags):
        shared: Counter = Counter()
        for e, n in b.items():
            for j in where[e]:
                shared[j] += min(n, bags[j][e])
        for j, n in shared.items():
            if n >= similarity * (total[i] + total[j] - n):
                x, y = sorted((root(i), root(j)))
                at[y] = x
        for e in b:
            where[e].append(i)
    empty = [i for i, b in enumerate(bags) if not b]
    for i in empty:
        if (rows[i][1] or "") == (rows[empty[0]][1] or ""):
            at[root(i)] = root(empty[0])
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[root(i)].append(d)
    return {d: min(least[root(i)]) for i, (d, _) in enumerate(rows)}


def test_classes_equal_brute_force(spark, data):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect()]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.op7_near_dedup(spark, data).collect()}
    assert got == brute_classes(rows)


def test_chains_and_large_groups(spark):
    rng = np.random.default_rng(4)
    base = [f"w{x}" for x in rng.integers(0, 10_000, 200)]
    rows = []
    for i in range(120):  # one group of near copies, each a change or two from the base
        w = list(base)
        for p in rng.integers(0, 200, 2):
            w[p] = f"c{rng.integers(0, 10_000)}"
        rows.append((i, " ".join(w)))
    step = list(base[::-1])
    for i in range(120, 160):  # a chain: neighbours alike, ends not
        step = list(step)
        p = (i - 120) * 5
        step[p] = f"n{i}"
        rows.append((i, " ".join(step)))
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(i, passage + " " + " ".join(f"u{x}" for x in rng.integers(0, 10**6, 150))) for i in range(160, 260)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(df).collect()}
    assert got == brute_classes(rows)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    a = [f"a{x}" for x in range(400)]
    for share in (0.3, 0.6, 0.9):
        b = a[: int(400 * share)] + [f"b{x}" for x in rng.integers(0, 10**6, 400 - int(400 * share))]
        h, n = near_dedup.shingles([" ".join(a), " ".join(b)])
        s = near_dedup.darts(h, n, 2048)
        x, y = (set(p.tolist()) for p in np.split(h, [n[0]]))
        assert (s[0] == s[1]).mean() == pytest.approx(len(x & y) / len(x | y), abs=0.05)


def test_weighted_signatures():
    h = np.array([1, 1, 1, 2, 1, 2, 2, 2], np.uint64)
    s = near_dedup.darts(near_dedup.mix(h), np.array([4, 4]), 4096, weights="count")
    assert (s[0] == s[1]).mean() == pytest.approx(2 / 6, abs=0.04)  # min sums 1 + 1, max sums 3 + 3


def _family(rng, pairs=40, alone=160):
    """Texts that share a passage, at about 0.74 of each other, and pairs among them at about 0.85; and the pairs' ids."""
    passage, fresh = [f"p{i}" for i in range(300)], count()
    new = lambda n: [f"n{next(fresh)}" for _ in range(n)]
    texts = []
    for i in range(alone + pairs):
        own = new(52)
        texts.append(passage + own)
        if i < pairs:
            texts.append(passage + own[:24] + new(28))
    order = rng.permutation(len(texts)).tolist()
    return [(i, " ".join(texts[j])) for i, j in enumerate(order)]


@pytest.mark.parametrize("part", [2_000_000, 20_000])
def test_pairs_inside_a_family_below_the_threshold(spark, monkeypatch, part):
    monkeypatch.setattr(near_dedup, "REST", part, raising=False)
    rows = _family(np.random.default_rng(7))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    want = {i: i for i, _ in rows}
    for i, j in combinations(range(len(rows)), 2):
        same = len(sets[i] & sets[j])
        if same >= 0.8 * (len(sets[i]) + len(sets[j]) - same):
            want[j] = want[i]
    assert sum(i != c for i, c in want.items()) == 40
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_repeats_weigh_in_the_similarity(spark):
    """Texts alike as sets of shingles, and not as multisets, stay apart; repeats that both hold bring them together."""
    line = " ".join(f"l{i}" for i in range(6))
    own = lambda n, k: " ".join(f"{n}{i}" for i in range(k))
    body = own("b", 60)
    rows = [(1, f"{body} {line}"), (2, f"{body} " + " ".join([line] * 30)), (3, f"{own('c', 12)} " + " ".join([line] * 40)), (4, f"{own('d', 12)} " + " ".join([line] * 40)), (5, own("e", 20))]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows) == {1: 1, 2: 2, 3: 3, 4: 3, 5: 5}


def test_joins_deal_frequent_keys(spark):
    left = spark.range(9000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 100).alias("k"), "id")
    right = spark.range(-1, 60).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left", "left_semi"):
        got = spread_join(left, right, ["k"], ["id"], how)
        assert got.exceptAll(left.join(right, ["k"], how)).count() == 0 and got.count() == left.join(right, ["k"], how).count()
    plan = spread_join(left, right, ["k"], ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "_part" in plan


def test_dedup_keeps_one_of_each(spark, odd, none):
    kept = near_dedup.dedup(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sorted(ids, key=str) == [1, 3, 4, 5, 6, None]
    found = near_dedup.classes(odd)
    assert found.count() == odd.count()
    assert near_dedup.dedup(none).count() == 0 and near_dedup.classes(none).count() == 0


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 80, (60, 2))] + [(100 + i, 101 + i) for i in range(25)]
    name = lambda c: F.encode(F.lpad(F.col(c).cast("string"), 5, "0"), "UTF-8").alias(c)
    got = {int(bytes(r["node"])): int(bytes(r["root"])) for r in near_dedup.components(spark.createDataFrame(pairs, "x long, y long").select(name("x"), name("y"))).collect()}
    near = defaultdict(set)
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    for node in near:
        seen, todo = {node}, [node]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert got[node] == min(seen)
    assert set(got) == set(near)


# --- classifiers ---


def labelled(spark, texts, toxic=None, quality=None):
    n = len(texts)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, (quality or [1] * n)[i], (toxic or [0] * n)[i]) for i in range(n)], "doc_id long, quality int, toxic int")
    return docs, labels


def prose(rng, n):
    return " ".join(f"{rng.choice(['ka', 'lo', 'mi', 'tu'])}{rng.choice(['rin', 'sol', 'dem'])}{rng.integers(0, 40)}" for _ in range(n))


def test_toxic_stems_are_learnt(spark):
    rng = np.random.default_rng(1)
    texts, toxic = [], []
    for i in range(600):
        t, bad = prose(rng, 60), i % 6 == 0
        texts.append(t + (" " + " ".join(f"vilword{x}" for x in rng.choice(["s", "en", "ing", "ly", "er", "ed"], rng.integers(1, 4))) if bad else ""))
        toxic.append(int(bad))
    docs, labels = labelled(spark, texts, toxic=toxic)
    model = toxicity.fit(docs, labels.where("doc_id < 400"))
    got = {r["doc_id"]: r for r in toxicity.grade(docs, model).collect()}
    assert np.mean([got[i]["toxic"] == bool(toxic[i]) for i in range(400, 600)]) > 0.97
    assert model.thresholds == sorted(model.thresholds)
    assert all(0 <= r["severity"] <= toxicity.GRADES and 0 <= r["p_toxic"] <= 1 for r in got.values())


def test_severity_ranks_held_out_texts(spark):
    """Texts with more vile words are graded higher though labels say no more than toxic; those fitted on are others."""
    rng = np.random.default_rng(9)
    texts, toxic, many = [], [], []
    for i in range(1200):
        n = int(rng.integers(1, 9)) if i % 4 == 0 else 0
        words = [f"vil{rng.choice(['mur', 'gor', 'zod', 'kra', 'bex', 'dru'])}{rng.choice(['s', 'en', 'ing'])}" for _ in range(n)]
        texts.append(prose(rng, 50) + " " + " ".join(words))
        toxic.append(int(n > 0))
        many.append(n)
    docs, labels = labelled(spark, texts, toxic=toxic)
    got = {r["doc_id"]: r["severity"] for r in toxicity.grade(docs, toxicity.fit(docs, labels.where("doc_id < 800"))).collect()}
    held = [i for i in range(800, 1200) if many[i]]
    few, lots = [got[i] for i in held if many[i] <= 2], [got[i] for i in held if many[i] >= 6]
    assert np.mean([a < b for a in few for b in lots]) > 0.8
    assert max(got[i] for i in range(800, 1200) if not many[i]) < np.median(few)


def test_toxicity_query_by_definition(spark):
    """The query's rows from the fitted weights and thresholds, a text at a time, over all rows."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    m = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.op2_toxicity(spark, sf).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows[:300]:
        s = sum(m.weights.get(f, 0.0) for f in toxicity.features_of(r["text"] or ""))
        above = [1 / (1 + math.exp(t - s)) for t in m.thresholds]
        assert got[r["doc_id"]]["severity"] == pytest.approx(sum(above)) and got[r["doc_id"]]["grade"] == sum(a >= 0.5 for a in above) and got[r["doc_id"]]["toxic"] == (s >= m.cut)
    mark = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert not any(got[i]["toxic"] for i, y in mark.items() if not y)
    assert sum(got[i]["toxic"] for i, y in mark.items() if y) >= 0.9 * sum(mark.values())


def test_quality_query_by_definition(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    m = quality_ranking.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    got = {r["doc_id"]: r for r in quality_ranking.op10_quality(spark, sf).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows[:200]:
        x = np.clip((quality_ranking.features([r["text"] or ""])[0] - m.mean) / m.scale, -8, 8)
        z = m.slope * (sum(float(a) * float(b) for a, b in zip(x, m.weights)) - m.cut) + math.log(0.7 / 0.3)
        assert got[r["doc_id"]]["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(0)
    rows, grades = [], []
    for _ in range(800):
        r = [j for j in range(4) if rng.random() < 0.5]
        rows.append(r)
        grades.append(int(np.clip(sum(r) / 2 + rng.normal(0, 0.3), 0, 3)))
    w, th = toxicity.fit_ordinal(rows, np.array(grades), 4, 3)
    assert (np.diff(w) > 0).all() and (np.diff(th) > 0).all()


def test_classifiers_on_odd_rows(spark, odd, none, data):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    t, q = toxicity.fit(docs, labels), quality_ranking.fit(docs, labels)
    for got, col in ((toxicity.grade(odd, t), "severity"), (quality_ranking.rank(odd, q), "score")):
        rows = got.collect()
        assert len(rows) == odd.count() and all(r[col] is not None for r in rows)
        assert len(set(got.columns)) == len(got.columns)
    assert toxicity.grade(none, t).count() == quality_ranking.rank(none, q).count() == 0
    one = labels.where("toxic = 0 and quality = 1")
    assert not any(r["toxic"] for r in toxicity.grade(odd, toxicity.fit(docs, one)).collect())
    assert all(r["score"] == r["predicted"] == 1 for r in quality_ranking.rank(odd, quality_ranking.fit(docs, one)).collect())
    zero = labels.where("quality = 0")
    assert all(r["score"] == r["predicted"] == 0 for r in quality_ranking.rank(odd, quality_ranking.fit(docs, zero)).collect())
    assert all(r["score"] == 1 for r in quality_ranking.rank(odd, quality_ranking.fit(docs, labels.where("false"))).collect())
    assert toxicity.fit(docs, labels.where("false")).thresholds == []


def test_quality_on_held_out_rows(spark):
    d = quality_ranking.op10_quality(spark, "/root/testdata/sf0.01").toPandas().merge(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas(), on="doc_id")
    assert (d.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in d.doc_id]).all()
    held = d[d.held_out]
    a, b = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    assert (a[:, None] > b[None, :]).mean() > 0.97 and (held.predicted == held.quality).mean() > 0.9
    assert d.score.between(0, 1).all() and (d.predicted == (d.score >= 0.7)).all()


# --- LM scoring ---


def check_base(rows, got):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    toks = [[*WORD.findall((t or "").translate(low)), None] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    c = Counter(w for t, h in zip(toks, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    want = Counter((i, h, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 5)) for (i, _), t, h in zip(rows, toks, held))
    assert want == Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got)


@pytest.fixture
def quick(monkeypatch):
    monkeypatch.setattr(lm_scoring, "BATCH", 64)
    monkeypatch.setattr(lm_scoring.Trainer.run, "__defaults__", (64, 1e-2))


def test_lm_query(spark, data, quick):
    got = lm_scoring.op8_lm_scoring(spark, data).collect()
    check_base([(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()], got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_lm_shares_words_between_ways(spark, data, quick, monkeypatch):
    """Scores do not depend on which words are sent and which meet their counts in the join."""
    a = {r["doc_id"]: r for r in lm_scoring.op8_lm_scoring(spark, data).collect()}
    monkeypatch.setattr(lm_scoring, "HEAD", 50)
    b = {r["doc_id"]: r for r in lm_scoring.op8_lm_scoring(spark, data).collect()}
    for i in a:
        assert a[i]["base_score"] == pytest.approx(b[i]["base_score"]) and a[i]["n_known"] == b[i]["n_known"]
        assert a[i]["score"] == pytest.approx(b[i]["score"], rel=1e-4)


def test_lm_odd_rows(spark, odd, none, quick):
    check_base([(r["doc_id"], r["text"]) for r in odd.collect()], lm_scoring.score(odd).collect())
    assert lm_scoring.score(none).count() == 0
    held = odd.where("false").unionByName(odd.where("doc_id = 5"))  # crc32('5') mod 7 may be anything: base must agree
    check_base([(r["doc_id"], r["text"]) for r in held.collect()], lm_scoring.score(held).collect())


def small_model(ids, doc, size=60, steps=5):
    """A trained model over few ids, the last two of which are BEGIN and END."""
    counts = np.bincount(ids, minlength=size) + 1

    def follow(a, b, shape):
        ok = (doc[1:] == doc[:-1]) & (b[ids[1:]] >= 0)
        return np.bincount(a[ids[:-1]][ok] * shape[1] + b[ids[1:]][ok], minlength=shape[0] * shape[1]).reshape(shape).astype(float)

    m = lm_scoring.untrained(counts, np.arange(size) % 2 == 0, follow)
    t = lm_scoring.Trainer(m, 3)
    t.run(ids, doc, steps, 32)
    m.tables = t.p
    return m, t


def by_definition(m, ids, doc, i):
    """(log probability of ids[i] given the ids before it, log of the opening classes' share), one window at a time."""
    t, half, q = m.tables, m.window // 2, i - 1
    keys = [j for j in range(max(0, (q // half - 1) * half), q + 1) if doc[j] == doc[q]]
    s = np.array([t["q"][m.row[ids[q]]] @ t["k"][m.row[ids[j]]] / np.sqrt(lm_scoring.DIM) + t["bias"][q - j] for j in keys], float)
    a = np.exp(s - s.max())
    h = (a / a.sum()) @ t["v"][m.row[ids[keys]]]
    p = np.exp(h @ t["out"] + t["last"][m.row[ids[q]]])
    c = m.cls[ids[i]]
    first, last = m.first_of[c], m.first_of[c + 1]
    z = np.exp(t["inner"][first:last] @ h + t["inner_bias"][first:last])
    return np.log(p[c] / p.sum()) + np.log(z[m.slot[ids[i]] - first] / z.sum()) + m.share[ids[i]], np.log(p[: lm_scoring.OPENING].sum() / p.sum())


def test_windows_score_each_id_once():
    """Batched windows give what a window of its own gives each id."""
    rng = np.random.default_rng(0)
    ids, doc = rng.integers(0, 50, 300), np.repeat([0, 1, 2], [5, 150, 145])
    m, _ = small_model(ids, doc)
    lp, more = m.predict(ids, doc, block=3, blocks_within=2)
    for i in (1, 4, 6, 40, 154, 156, 299):
        if doc[i] != doc[i - 1]:
            assert lp[i] == more[i] == 0
        else:
            want, opening = by_definition(m, ids, doc, i)
            assert lp[i] == pytest.approx(want, abs=1e-3) and more[i] == pytest.approx(-opening, abs=1e-3)


def test_probabilities_of_the_next_id_sum_to_one(monkeypatch):
    monkeypatch.setattr(lm_scoring, "LIVE", 25)  # others share a vector
    rng = np.random.default_rng(1)
    m, _ = small_model(rng.integers(0, 50, 3000), np.repeat(np.arange(30), 100))
    for n in (1, 7, 40):
        before = rng.integers(0, 50, n)
        ids = np.concatenate([np.append(before, x) for x in range(60)])
        lp, _ = m.predict(ids, np.repeat(np.arange(60), n + 1))
        # where a window begins depends on the place in the sequence, and so does how far back a long text's context goes
        each = np.array([m.predict(np.append(before, x), np.zeros(n + 1, int))[0][n] for x in range(60)])
        assert np.exp(each).sum() == pytest.approx(1, abs=1e-5)
        assert n > 16 or lp[n :: n + 1] == pytest.approx(each, abs=1e-4)


def test_training_lowers_the_loss():
    rng = np.random.default_rng(2)
    ids = (np.cumsum(rng.integers(1, 3, 6000)) % 40).astype(np.int64)  # each id is one or two above the last
    _, t = small_model(ids, np.zeros(len(ids), int), steps=150)
    assert np.mean(t.log[-10:]) < np.mean(t.log[:3]) - 0.08 and np.mean(t.log[-10:]) == pytest.approx(math.log(2), abs=0.05)


def test_scores_by_definition(spark, monkeypatch):
    """Whole scores, from counts and the model's tables, one word at a time."""
    from tokenizers import Tokenizer

    rng = np.random.default_rng(6)
    words = np.array("The of and run running house houses LIGHT lighter river stone walk <|endoftext|> zzyzx naïve".split())
    rows = [(i, " ".join(words[np.minimum(rng.geometric(0.2, rng.integers(0, 30)) - 1, len(words) - 1)])) for i in range(60)]
    models = []
    trained = lm_scoring.trained
    monkeypatch.setattr(lm_scoring, "trained", lambda *a, **k: models.append(trained(*a, **k, steps=5)) or models[-1])
    monkeypatch.setattr(lm_scoring, "HEAD", 6)  # some words meet their counts in the join
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    library, m = Tokenizer.from_file(lm_scoring.TOKENIZER), models[0]
    begin, end = len(m.cls) - 2, len(m.cls) - 1
    spelt = {w: library.encode(f" {w}", add_special_tokens=False).ids for _, t in rows for w in t.lower().split()}
    known = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in t.lower().split())
    ends = sum(zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows)
    mass = Counter({end: ends})
    for w, n in known.items():
        mass[spelt[w][0]] += n + 1
    for d, t in rows[:12]:
        tokens = [([*spelt[w]], known[w]) for w in t.lower().split()] + [([end], ends)]
        ids = np.array([begin, *(x for s, _ in tokens for x in s)])
        at, total = 1, 0.0
        steps = [by_definition(m, ids, np.zeros(len(ids), int), i) for i in range(1, len(ids))]
        for k, (s, c) in enumerate(tokens):
            lp = sum(steps[at - 1 + j][0] for j in range(len(s))) - steps[at - 1][1]
            first = steps[at - 1][0] - steps[at - 1][1]
            if k + 1 < len(tokens):
                lp += steps[at - 1 + len(s)][1]  # the word's ending
            counts = np.exp(first) * (c + 1) / (mass[s[0]] + 1)
            total += math.log10(lm_scoring.MIX * counts + (1 - lm_scoring.MIX) * np.exp(lp))
            at += len(s)
        assert got[d] == pytest.approx(total, abs=1e-3)


def test_all_training_texts_are_trained_on(spark, monkeypatch):
    """Every task trains, and the averaged tables do better on texts of all of them."""
    rng = np.random.default_rng(4)
    words = np.array("the of and run running house houses light lighter river stone walk".split())
    rows = [(i, " ".join(words[(np.arange(60) * (1 + i % 3) + rng.integers(0, 2)) % len(words)])) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(lm_scoring, "tasks_for", lambda *_: 5)
    monkeypatch.setattr(lm_scoring, "ADDED", 2)
    trained, means = lm_scoring.trained, []
    for steps in (0, 40):
        monkeypatch.setattr(lm_scoring, "trained", lambda *a, n=steps, **k: trained(*a, **k, steps=n))
        means.append(sum(r["score"] for r in lm_scoring.score(df).collect()))
    assert means[1] > means[0] * 0.7


def test_a_pass_predicts_each_id_once(monkeypatch):
    """Every id after the first of its document is predicted once, whatever the lengths, and steps drawn at random are besides."""
    sizes = [1, 2, 5, 150, 1, 333, 16, 32]
    ids, doc = np.arange(sum(sizes)) % 50, np.repeat(np.arange(len(sizes)), sizes)
    met, once, half = [], lm_scoring.Trainer.once, lm_scoring.WINDOW // 2

    def watched(self, i, d, starts, rate):
        q = (starts[:, None] + half + np.arange(half)).ravel()
        met.extend((q - half)[(d[q] >= 0) & (d[q + 1] == d[q])].tolist())  # half a window is put before the first id
        once(self, i, d, starts, rate)

    m, _ = small_model(ids, doc)
    monkeypatch.setattr(lm_scoring.Trainer, "once", watched)
    t = lm_scoring.Trainer(m, 1)
    t.run(ids, doc, None, 7)
    assert sorted(met) == np.flatnonzero(doc[1:] == doc[:-1]).tolist() and t.seen == len(met)
    t.run(ids[:0], doc[:0], None)
    assert t.seen == len(met)


def test_a_step_calls_once_for_all_classes(monkeypatch):
    """A training step's calls do not grow with the classes: one exponential for attention, one for classes, one for the ids within all of them."""
    rng, calls, exp = np.random.default_rng(9), [], np.exp
    ids, doc = rng.integers(0, 50, 2000), np.repeat(np.arange(10), 200)
    _, t = small_model(ids, doc, steps=1)
    monkeypatch.setattr(np, "exp", lambda *a, **k: calls.append(len(a[0])) or exp(*a, **k))
    t.run(ids, doc, 1, 64)
    assert len(calls) == 3


def test_gradients_by_definition():
    """The gradients of a step are the slopes of the loss that predict() tells of all ids."""
    rng = np.random.default_rng(10)
    ids, doc = rng.integers(0, 50, 400), np.repeat([0, 1, 2, 3], [90, 1, 200, 109])
    m, _ = small_model(ids, doc)
    t = lm_scoring.Trainer(m, 2)
    t.run(ids, doc, None, 1000)  # one step
    slopes = lm_scoring._parted(t.mom, m.tables)
    live = np.append(False, doc[1:] == doc[:-1])

    def loss():
        return -(m.predict(ids, doc)[0] - m.share[ids])[live].mean()

    assert t.step == 1 and t.seen == live.sum() and t.log[0] == pytest.approx(loss(), abs=1e-5)
    for name, table in m.tables.items():
        flat, want = table.ravel(), slopes[name].ravel()
        for i in np.argsort(-np.abs(want), kind="stable")[[0, 1, 5]]:
            was, each = flat[i], []
            for by in (-0.02, 0.02):
                flat[i] = was + np.float32(by)
                each.append(loss())
            flat[i] = was
            assert want[i] == pytest.approx((each[1] - each[0]) / 0.04, rel=0.02, abs=1e-5), name


def test_words_are_found_among_known_ones():
    rng = np.random.default_rng(11)
    for n in (0, 1, 2, 1000):
        keys = np.unique(np.concatenate((rng.integers(-(2**63), 2**63 - 1, n), np.array([-(2**63), 2**63 - 1, 5, 6, 7] if n > 2 else [], np.int64))))
        asked = np.concatenate((keys, keys[:-1] + 1, rng.integers(-(2**63), 2**63 - 1, 500), np.array([-(2**63), 2**63 - 1, 0, -1])))
        at, there = lm_scoring.Sorted(keys).find(asked)
        assert there.tolist() == np.isin(asked, keys).tolist() and keys[at[there]].tolist() == asked[there].tolist()
    assert not len(lm_scoring.Sorted(keys).find(keys[:0])[0])


@pytest.mark.parametrize("tasks", [1, 3])
def test_training_takes_every_text(spark, monkeypatch, tasks):
    """The rounds together predict all ids of the training texts, not a share of them."""
    monkeypatch.setattr(lm_scoring, "tasks_for", lambda *_: tasks)
    monkeypatch.setattr(lm_scoring, "BATCH", 4)
    k, rng = lm_scoring.load_tokenizer(), np.random.default_rng(8)
    words = np.array("the of and run running house houses light lighter river stone walk".split())
    rows = [(i, " ".join(words[rng.integers(0, len(words), 40)])) for i in range(400)]
    coded = lm_scoring.settled(lm_scoring.encoded(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), k.size))
    learnt = coded.where("not held_out")
    per_text = [len(r["ids"]) // 2 for r in learnt.select("ids").collect()]  # 50,000 ids fit 16 bits
    counts = np.append(lm_scoring.by_id(coded.selectExpr("inline(seen)").groupBy("id").agg({"n": "sum"}).toDF("id", "n"), k.size), [0, len(per_text)])
    m = lm_scoring.untrained(counts, np.append(k.opens, [True, True]), lambda a, b, shape: lm_scoring.successions(learnt, k.size, a, b, shape))
    after = lm_scoring.trained(learnt, m, k.size, int(counts.sum()), steps=1)
    assert after.seen == sum(per_text) + len(per_text)  # BEGIN predicts the first id, the last one END
    assert all(np.abs(after.tables[n] - m.tables[n]).max() > 0 for n in ("q", "k", "v", "bias", "out", "last"))


def test_stored_ids_and_words(spark):
    """Ids, words and their sizes come back as they are, words of many ids among them."""
    import pyarrow as pa

    k = lm_scoring.load_tokenizer()
    texts = ["", "one two  three\tfour", "#-" * 700 + " x", " \n", "ünï \x85y \xa0 z", "a" * 3000]
    speller = lm_scoring.Speller(k)
    for _ in range(2):  # the second time from what is kept
        which, words = speller.words(pa.array(texts))
        ids, sizes = speller.ids(which)
        assert words.tolist() == [len(WORD.findall(t)) for t in texts]
        want = [k.inner.encode(f" {w}", add_special_tokens=False).ids for t in texts for w in WORD.findall(t)]
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = pa.Table.from_pandas(lm_scoring.encoded(df, k.size).drop("words", "seen").orderBy("doc_id").toPandas()).combine_chunks().to_batches()[0]
    back, per_text = lm_scoring.read_ids(got.column("ids"), k.size)
    again, per = lm_scoring.read_sizes(got.column("sizes"))
    assert back.tolist() == ids.tolist() and again.tolist() == sizes.tolist() and per.tolist() == words.tolist() and per_text.sum() == len(ids)
    keys = lm_scoring.word_keys(ids, sizes)
    assert len(set(keys.tolist())) == len({tuple(x) for x in want})


def test_marks_do_not_spell_a_word_again():
    """A word reaches the library once, whatever marks follow it; its ids with them are the library's."""
    import pyarrow as pa

    k, sent = lm_scoring.load_tokenizer(), []
    encode = k.encode_batch_fast
    k.encode_batch_fast = lambda strings, **a: sent.extend(strings) or encode(strings, **a)
    speller, words = lm_scoring.Speller(k), "lodestone lodestone. lodestone, lodestone!! \x85lodestone \xa0. x".split(" ")
    for some in (words[:3], words):
        ids, sizes = speller.ids(speller.words(pa.array([" ".join(some)]))[0])
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [k.inner.encode(f" {w}", add_special_tokens=False).ids for w in some]
    assert "".join(sent).count(" lodestone") == 1


# --- pipeline ---


def test_stages_on_odd_and_no_rows(spark, odd, none, data, folder):
    import corpus_pipeline

    rows = odd.collect()
    labels = spark.read.parquet(f"{data}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in stages.items():
        assert stage(spark, none, data).count() == 0
        if name != "byte-level BPE":
            assert stage(spark, odd, data).columns == odd.columns
    # one kind of labels, or none
    poor = spark.createDataFrame([(i, 0, 0) for i in range(1, 8)], "doc_id long, quality int, toxic int")
    for some, kept in ((poor.withColumn("quality", F.lit(1)), len(rows)), (labels.where("false"), len(rows)), (poor, 0)):
        sf = folder(some, "labels")
        if kept:
            assert sorted(map(str, stages["toxicity"](spark, odd, sf).collect())) == sorted(map(str, rows))
        assert stages["quality classifier"](spark, odd, sf).count() == kept
    least = stages["near duplicates"](spark, odd, data).collect()
    assert sorted((r["doc_id"] for r in least), key=str) == [1, 3, 4, 5, 6, None]
    mixed = Counter(r["doc_id"] for r in stages["mixing"](spark, odd, data).collect())
    assert not {1, 2, 3} & set(mixed) and mixed
    coded = stages["byte-level BPE"](spark, odd, data).collect()
    assert len(coded) == len(rows) and {r["n_tokens"] for r in coded if r["doc_id"] in (1, 2)} == {0}


def test_pipeline(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality classifier", "near duplicates", "mixing", "byte-level BPE"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns
        docs = corpus_pipeline.settled(out)
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()
    assert len(rows) == docs.count()
    whole = corpus_pipeline.run(spark, data).collect()
    key = lambda r: (r["doc_id"], r["ids_sha256"])
    assert Counter(map(key, whole)) == Counter(map(key, rows))
    assert max(Counter(r["doc_id"] for r in rows).values()) <= 3

"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree over source blocks.

1. One pass sums the sizes by (source, bucket), buckets being equal ranges of a row hash; that is a random permutation of
   each source cut into at most BUCKETS parts, whose prefix sums place every document on its source's axis of words. The one
   bucket of a source in which its target ends is cut into BUCKETS parts again, and the one of these again, so that places near
   the end are exact but for a 2^30th of a source.
2. Targets are the weights' shares of all words, capped at REPEATS passes over the source.
3. A source's target is cut into equal blocks. The tree starts with all block quotas at its root; each node deals half of
   its blocks to the left child, drawn from the sources without replacement (multivariate hypergeometric, by sequential
   inversion), and keeps exact sums down to the output shards.
4. Each shard draws as many of a source's permuted blocks as the tree gave it, disjoint from all others' draws. A document is
   taken by the shard that has drawn the block where its middle word lies, once for each pass; what no shard has drawn isn't
   taken. Each shard is then shuffled on its own.

Only the (source, bucket) sums and the quotas are gathered: sources x 3 x BUCKETS and sources x shards numbers, however many
documents there are. Documents meet them in a map-side join while those are few (checked), and in a shuffle join beyond.

Edge cases: null texts have size 0; rows of size 0 are never taken; null is a source of its own, last in order; repeated
rows (same id, source and size) share a place and are taken together or apart like any others of their bucket; an empty
table gives an empty mix; other columns pass through, but columns named as the added ones are replaced."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.llm.common import GAP, let, settled, table, tasks_for

BUCKETS = 1024
#: How often the bucket in which a source's target ends is cut again, and once more.
LEVELS = 3
REPEATS = 3
WEIGHTS = (5.0, 2.0, 1.0)
SHARDS = 64
#: Blocks of all sources together; there should be several for each shard.
BLOCKS = 8192
#: Stored bytes for each task that writes part of a shard.
PART_BYTES = 32_000_000
#: Rows of (source, bucket) sums of a level up to which they are sent to every executor; each has under 100 bytes.
SENT = 200_000


def size_of(text: str = "text") -> Column:
    """Number of words of a text; null has none."""
    t = F.coalesce(F.col(text), F.lit(""))
    parts = F.split(t, GAP)
    # split leaves an empty part before a leading and after a trailing gap
    return let(parts, lambda p: F.size(p) - (F.get(p, F.lit(0)) == "").cast("int") - ((F.size(p) > 1) & (F.element_at(p, -1) == "")).cast("int")).cast("long")


def _unit(*keys) -> Column:
    """A number in [0, 1) that depends on the keys only."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") * F.lit(2.0**-53)


def _placed(docs: DataFrame, seed: int, key: str, size: Column) -> DataFrame:
    placed = docs.withColumns({"size": size, "_skey": F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))})
    return placed.withColumn("_u", _unit(F.lit(seed), F.col(key), F.col("_skey")))


def _fine(level: int) -> Column:
    """Bucket of a row at a level: level 0 cuts the hash's range into BUCKETS, each further one a bucket of the level before."""
    return F.floor(F.col("_u") * float(BUCKETS) ** (level + 1)).cast("long")


def _sums(rows: DataFrame, level: int) -> DataFrame:
    return rows.groupBy("_skey", _fine(level).alias("_cut")).agg(F.sum("size").alias("_n"), F.count("*").alias("_rows"))


def _marked(sums: DataFrame, base: DataFrame | None) -> DataFrame:
    """sums with _at, the words of the source before each bucket; base (_skey, _base): the words before the first of them."""
    marks = sums.withColumn("_at", F.coalesce(F.sum("_n").over(W.partitionBy("_skey").orderBy("_cut").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return marks if base is None else marks.join(base, "_skey").withColumn("_at", F.col("_at") + F.col("_base")).drop("_base")


def _ending(marks: DataFrame, aims: DataFrame) -> DataFrame:
    """(_skey, _cut, _at) of the bucket of each source in which its last, partial pass ends."""
    end = F.col("target") - F.floor(F.col("target") / F.col("source_size")) * F.col("source_size")
    inside = marks.join(aims.where("target > 0").select("_skey", end.alias("_end")), "_skey").where((F.col("_at") <= F.col("_end")) & (F.col("_end") < F.col("_at") + F.col("_n")) & (F.col("_rows") > 1))
    return inside.select("_skey", "_cut", "_at")


def targets(sources: DataFrame, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """sources (_skey, source_size) with idx, weight and target.

    Water filling in closed form: in the order of cap / weight, a source is capped while its cap is at most its share of what the earlier ones left."""
    order = W.orderBy((F.col("_skey") == "").cast("int"), "_skey")
    all_ = W.partitionBy()
    n = len(weights)
    ws = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn("idx", F.row_number().over(order) - 1).withColumn("weight", F.get(ws, F.col("idx") % n)).withColumn("_cap", (repeats * F.col("source_size")).cast("double")).withColumn("_total", F.sum("source_size").over(all_).cast("double"))
    before = W.orderBy(F.col("_cap") / F.col("weight"), "idx").rowsBetween(W.unboundedPreceding, -1)
    after = W.orderBy(F.col("_cap") / F.col("weight"), "idx").rowsBetween(0, W.unboundedFollowing)
    level = (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    free = ranked.withColumn("_level", level).withColumn("_free", F.col("_cap") > F.col("_level") * F.col("weight"))
    first = F.min(F.when(F.col("_free"), F.struct(F.col("_cap") / F.col("weight"), F.col("idx"), F.col("_level")))).over(all_)
    return free.withColumn("_first", first["_level"]).withColumn("target", F.when(F.col("_first").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_first") * F.col("weight")))).select("_skey", "source_size", "idx", "weight", "target")


def _hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` balls out of `total` are among the `marked`: inversion of the exact distribution at u.

    Weights follow from the ratio of neighbours, in logarithms, from the least possible count on."""
    low = F.greatest(F.lit(0), drawn - (total - marked))
    high = F.least(marked, drawn)

    def pick(ks: Column) -> Column:
        step = lambda k: F.ln((marked - k + 1) * (drawn - k + 1)) - F.ln(k * (total - marked - drawn + k).cast("double"))
        logs = F.aggregate(F.slice(ks, 2, F.greatest(F.size(ks) - 1, F.lit(0))), F.array(F.lit(0.0)), lambda a, k: F.concat(a, F.array(F.element_at(a, -1) + step(k))))
        return let(
            logs,
            lambda a: let(
                F.transform(a, lambda x: F.exp(x - F.array_max(a))),
                lambda p: let(
                    F.aggregate(p, F.lit(0.0), lambda s, x: s + x) * u,
                    lambda goal: F.aggregate(p, F.struct(F.lit(0.0).alias("s"), F.lit(-1).alias("n")), lambda s, x: F.when((s["s"] > goal) & (s["n"] >= 0), s).otherwise(F.struct((s["s"] + x).alias("s"), (s["n"] + 1).alias("n"))), lambda s: low + s["n"]),
                ),
            ),
        )

    return F.when(high <= low, low).otherwise(let(F.sequence(low, high), pick))


def split_quotas(root: DataFrame, shards: int, seed: int) -> DataFrame:
    """root: one row with quotas array<long>. Returns (shard, quotas) whose quotas add up to the root's, source by source.

    A node with m blocks for c shards gives its left child round(m * left / c) of them."""
    nodes = root.select(F.lit(0).alias("shard"), F.lit(shards).alias("span"), "quotas")
    for depth in range(max(0, (shards - 1).bit_length())):
        total = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, b: a + b)
        half = (F.col("span") / 2).cast("int")
        start = F.struct(total.alias("rest"), F.round(total * half / F.col("span")).cast("long").alias("draw"), F.array().cast("array<bigint>").alias("left"))

        key = F.concat_ws("/", F.lit(depth), F.col("shard"))

        def deal(s, q):
            taken = _hypergeometric(s["rest"], q, s["draw"], _unit(F.lit(seed), key, F.size(s["left"]))).cast("long")  # noqa: B023
            return let(taken, lambda k: F.struct((s["rest"] - q).alias("rest"), (s["draw"] - k).alias("draw"), F.concat(s["left"], F.array(k)).alias("left")))

        left = F.aggregate("quotas", start, deal, lambda s: s["left"])
        both = let(left, lambda a: F.array(F.struct(F.col("shard").alias("shard"), half.alias("span"), a.alias("quotas")), F.struct((F.col("shard") + half).alias("shard"), (F.col("span") - half).alias("span"), F.zip_with("quotas", a, lambda q, x: q - x).alias("quotas"))))
        one = F.array(F.struct("shard", "span", "quotas"))
        nodes = nodes.select(F.explode(F.when(F.col("span") > 1, both).otherwise(one)).alias("n")).select("n.*")
    return nodes.select("shard", "quotas")


def mix_plan(docs: DataFrame, key: str = "doc_id", text: str = "text", weights=WEIGHTS, repeats: int = REPEATS, shards: int = SHARDS, blocks: int = BLOCKS, seed: int = 7, size: Column | None = None) -> DataFrame:
    """docs with size, source_size, target and places: array of (pass, block, shard), one for each time that a shard of the mix takes the row. size: the words of a row, counted in its text by default."""
    placed = _placed(docs, seed, key, size_of(text) if size is None else size)
    sums = settled(_sums(placed, 0))
    by_source = settled(sums.groupBy("_skey").agg(F.sum("_n").alias("source_size")))
    n_sources = by_source.count()
    few = n_sources * BUCKETS <= SENT
    sent = F.broadcast if few else (lambda x: x)
    aims = targets(by_source, weights, repeats)
    total = F.sum("target").over(W.partitionBy())
    aims = settled(aims.withColumn("_blocks", F.when(F.col("target") > 0, F.greatest(F.lit(1), F.round(F.col("target") * blocks / total))).otherwise(F.lit(0)).cast("long")))
    root = aims.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "_blocks"))), lambda x: x["_blocks"]).alias("quotas"))
    dealt = split_quotas(root, shards, seed).select("shard", F.posexplode("quotas").alias("idx", "_q"))
    # the blocks that each shard draws: runs of the source's permuted blocks, as long as the shards' quotas
    shard_of = dealt.groupBy("idx").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("shard", "_q"))), lambda x: F.array_repeat(x["shard"], x["_q"].cast("int")))).alias("_shard_of"))
    spots, base, joined = sums, None, placed.drop("source_size", "target", "idx", "_at", "_rows", "_n", "_place")
    for level in range(LEVELS):
        marks = settled(_marked(spots, base))
        of_level = marks.select("_skey", F.col("_cut").alias(f"_cut{level}"), F.struct("_at", "_n", "_rows", F.lit(level).alias("level")).alias(f"_spot{level}"))
        joined = joined.withColumn(f"_cut{level}", _fine(level)).join(sent(of_level), ["_skey", f"_cut{level}"], "left")
        if level + 1 < LEVELS:
            ending = settled(_ending(marks, aims))
            if ending.isEmpty():
                break
            base = ending.select("_skey", F.col("_at").alias("_base"))
            rows = placed.withColumn("_cut", _fine(level)).join(sent(ending.select("_skey", "_cut")), ["_skey", "_cut"], "left_semi")
            spots = settled(_sums(rows, level + 1))
    spot = F.coalesce(*[F.col(f"_spot{i}") for i in reversed(range(level + 1))])
    inside = F.when(spot["_rows"] == 1, F.lit(0.5)).otherwise(F.col("_u") * F.pow(F.lit(float(BUCKETS)), spot["level"] + 1) - F.floor(F.col("_u") * F.pow(F.lit(float(BUCKETS)), spot["level"] + 1)))
    joined = joined.withColumn("_mid", spot["_at"] + inside * spot["_n"]).join(sent(aims.drop("weight")), "_skey", "left").join(sent(shard_of), "idx", "left")
    place = lambda p: F.floor((F.col("_mid") + p * F.col("source_size")) * F.col("_blocks") / F.col("target")).cast("int")
    passes = F.transform(F.array(*[F.lit(p) for p in range(repeats)]), lambda p: F.struct(p.alias("pass"), place(p).cast("long").alias("block"), F.get("_shard_of", place(p)).alias("shard")))
    drawn = F.filter(passes, lambda x: x["shard"].isNotNull())
    places = F.when((F.col("size") > 0) & (F.col("target") > 0), drawn)
    return joined.withColumn("places", F.coalesce(places, F.array().cast("array<struct<pass:int,block:bigint,shard:int>>"))).drop("_skey", "_u", "_mid", "_shard_of", "_blocks", "idx", *[f"_{c}{i}" for c in ("cut", "spot") for i in range(LEVELS)])


def mix(docs: DataFrame, shards: int = SHARDS, seed: int = 7, key: str = "doc_id", **options) -> DataFrame:
    """The mixed rows: docs' columns, shard and pass; a row comes once for each pass that takes it.

    A shard is one partition, or several for a large input; each is shuffled on its own."""
    cols = [c for c in docs.columns if c not in ("shard", "pass")]
    plan = mix_plan(docs, key=key, shards=shards, seed=seed, **options)
    out = plan.select(*cols, F.explode("places").alias("_p")).select(*cols, F.col("_p.shard").alias("shard"), F.col("_p.pass").alias("pass"))
    parts = -(-tasks_for(docs, PART_BYTES) // shards)
    chance = F.xxhash64(F.lit(seed + 1), F.col(key), F.col("pass"))
    return out.repartition(shards * parts, F.col("shard"), F.pmod(chance, F.lit(parts))).sortWithinPartitions("shard", chance)


def op1_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    sized = settled(docs.select("doc_id", "source", size_of().alias("size")))  # texts are read once
    plan = mix_plan(sized, size=F.col("size"))
    taken = (F.col("size") * F.size("places")).cast("long").alias("taken")
    return plan.select("doc_id", "size", F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"), taken, F.transform("places", lambda p: p["shard"]).alias("shards"))


QUERIES = {"op1_mixing": op1_mixing}
ORACLES = {}

"""Near-duplicate classes by DartMinHash signatures, banded buckets and exact verification.

Signatures. A text is the multiset (or, with weights="set", the set) of its shingles of SHINGLE words, a shingle's weight being
how often it comes; a text of fewer words is one shingle. Darts are thrown at the plane of (element and unit of weight) x rank: a hash of element, unit and rank cell
says how many darts lie in that cell (Poisson), and a hash of each dart gives its rank and its coordinate. A text sees the
darts inside its weights up to a rank at which about k ln k + 2k of them are expected, and keeps the earliest for each of its
k coordinates; texts that miss a coordinate look twice as far. Two texts agree in a coordinate with the probability of
their (weighted) Jaccard similarity.

Candidates. Each band of ROWS coordinates is hashed to a bucket. A bucket links its members to its least and to its greatest
member (grouped minimum and maximum, combined before the shuffle), never to all others: two edges a member, however large a
bucket is. At similarity 0.8 a pair shares a bucket with probability 1 - (1 - 0.8^6)^24 = 0.9993.

Verification. Edges are kept whose exact similarity (sum of the lesser weights over sum of the greater ones, over shingle hashes of
64 bits) reaches the threshold: first one edge to
the least and one to the greatest member a text, then those of the other edges that lead from one class to another, which
alone can change classes. Classes are connected components by alternating large and small stars; nothing is collected. Joins on a
bucket, a hub or a class deal frequent keys over tasks.

Rest. Buckets whose other members (neither least nor greatest) are still of several classes are gone through in full: each
such member's overlap with all others is counted from an inverted index of the bucket's shingles. A bucket of more than
REST bytes of shingles is dealt into parts, and every two parts meet. So each two members of a bucket are in one class or
have been compared. The work grows with the square of a bucket only where its texts are alike but below the threshold.

Scope. Equal texts share a node.

Edge cases: null and empty texts are equal to each other; whole texts are read; repeated rows and ties belong to one class;
the class id is the least doc_id of the class (null only if all are); an empty table gives no rows; other columns pass
through dedup() and are left out of classes()."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import pieces_of, settled, spread_join, table, tidy

SHINGLE, SIMILARITY = 5, 0.8
#: Weight of a shingle: how often it comes ("count") or 1 ("set").
WEIGHTS = "count"
BANDS, ROWS = 24, 6
#: Rows of narrow columns up to which a side of a join is sent to every executor; beyond, the join shuffles.
SENT = 250_000
CHUNK = 4_000_000
#: Bytes of shingles of a part of a bucket.
REST = 2_000_000
#: Rank cells: their ends double up to 1 and go on in steps of 1, so no cell of unit weight expects more than one dart.
_FIRST = (0.0625, 0.125, 0.25, 0.5, 1.0)
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _times(a: int, b: int):
    return np.uint64(a * b % 2**64)


def mix(x):
    """A bijection of 64-bit numbers that scatters its input's bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _cell(c: int):
    """(start, end, thresholds) of a rank cell; a 64-bit hash u means as many darts as there are thresholds <= u."""
    end = _FIRST[c] if c < len(_FIRST) else float(c - len(_FIRST) + 2)
    start = 0.0 if c == 0 else (_FIRST[c - 1] if c <= len(_FIRST) else end - 1.0)
    rate, p, total, cuts = end - start, np.exp(start - end), 0.0, []
    for k in range(1, 24):
        total += p
        if total >= 1 - 1e-15:
            break
        cuts.append(np.uint64(min(total, 1 - 2.0**-53) * 2.0**64))
        p *= rate / k
    return start, end, cuts


def _cells_for(rank):
    """Number of cells that reach up to rank."""
    return np.where(rank <= 1, np.searchsorted(_FIRST, np.minimum(rank, 1.0), "left") + 1, len(_FIRST) + np.ceil(np.maximum(rank - 1, 0)).astype(np.int64))


def shingles(texts, size: int = SHINGLE):
    """(hashes, sizes): the 64-bit hashes of every text's shingles, repeats included, one text after the other, and how many each has."""
    import xxhash

    class Hashes(dict):
        def __missing__(self, word):
            h = self[word] = xxhash.xxh64_intdigest(word)
            return h

    number, counts, words = Hashes().__getitem__, [], []
    for t in texts:
        w = t.encode("utf-8", "surrogatepass").split()  # of bytes: at space and the controls 9 to 13
        counts.append(len(w))
        words.append(np.fromiter(map(number, w), np.uint64, len(w)))
    n = np.array(counts, np.int64)
    sizes = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    if not n.sum():
        return np.empty(0, np.uint64), sizes
    flat = np.concatenate([*words, np.zeros(size, np.uint64)])
    starts = np.cumsum(n) - n
    ends = np.cumsum(sizes)
    at = np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]))
    h = np.zeros(len(at), np.uint64)
    left = np.repeat(np.where(n >= size, size, n), sizes)  # words of the shingle
    for i in range(size):
        w = flat[at + i]
        h = np.where(left > i, mix(h * _MUL + w), h)
    return h, sizes


def darts(hashes, sizes, k: int, weights: str = WEIGHTS):
    """Signatures: a row of k 64-bit darts for every text; texts without shingles have zeros.

    A dart is its rank in fixed point (16 bits before the point, 24 after) above 24 bits of its hash, so the least number is the earliest dart."""
    n = len(sizes)
    doc = np.repeat(np.arange(n), sizes)
    order = np.lexsort((hashes, doc)) if len(doc) else np.empty(0, np.int64)
    h, d = hashes[order], doc[order]
    if weights == "set":
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        h, d = h[first], d[first]
    else:  # the i-th repeat of a shingle is its i-th unit of weight
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        i = np.arange(len(h))
        unit = i - np.maximum.accumulate(np.where(new, i, 0))
        h = np.where(unit > 0, mix(h + _MUL * unit.astype(np.uint64)), h)
    mass = np.bincount(d, minlength=n)
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    sig = np.full(n * k, none)
    reach = (k * np.log(k) + 2 * k) / np.maximum(mass, 1)
    todo = mass > 0
    while todo.any():
        cells = np.where(todo, _cells_for(reach), 0)
        at = np.flatnonzero(cells[d] > 0)
        c = 0
        while len(at):
            start, end, cuts = _cell(c)
            hh, dd = h[at], d[at]
            u = mix(hh + _times(0x9E3779B97F4A7C15, c + 1))
            for j, cut in enumerate(cuts):
                hit = u >= cut
                if not hit.any():
                    break
                u, dd = u[hit], dd[hit]
                x = mix(u + _times(0xD1B54A32D192ED03, j + 1))
                rank = start + (end - start) * ((x >> np.uint64(32)).astype(np.float64) * 2.0**-32)
                inside = rank < reach[dd]
                x, rank, ds = x[inside], rank[inside], dd[inside]
                y = mix(x)
                coordinate = ((y >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
                value = ((rank * 2.0**24).astype(np.uint64) << np.uint64(24)) | (y & np.uint64(0xFFFFFF))
                np.minimum.at(sig, ds * k + coordinate.astype(np.int64), value)
            c += 1
            at = at[cells[d[at]] > c]
        missing = (sig.reshape(n, k) == none).any(1) & (mass > 0)
        reach = np.where(missing, reach * 2, reach)
        todo = missing
    sig = sig.reshape(n, k)
    sig[mass == 0] = 0
    return sig


def band_keys(sig, bands: int, rows: int):
    """A 64-bit key for every band of every signature."""
    x = sig.reshape(len(sig), bands, rows)
    key = np.zeros(x.shape[:2], np.uint64)
    for i in range(rows):
        key = mix(key * _MUL + x[:, :, i])
    return key.view(np.int64)


def text_key(text: str = "text"):
    """16 bytes that stand for a text; null is like empty."""
    return F.unhex(F.md5(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")))


def signatures(docs: DataFrame, text: str = "text", key: str = "doc_id", bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE, weights: str = WEIGHTS) -> DataFrame:
    """(doc_id, node, bands): the id of each row, its text's key and its bands' keys; texts without words have no bands."""
    id_type = docs.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for b in pieces_of(batches, CHUNK):
            h, sizes = shingles(b.column(2).to_pylist(), size)
            keys = band_keys(darts(h, sizes, bands * rows, weights), bands, rows)
            offsets = np.concatenate(([0], np.cumsum(np.where(sizes > 0, bands, 0)))).astype(np.int32)
            values = keys[sizes > 0].ravel()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["doc_id", "node", "bands"])

    rows_ = docs.select(docs[key].alias("doc_id"), text_key(text).alias("node"), F.coalesce(docs[text], F.lit("")).alias("text"))
    return rows_.mapInArrow(tidy(run), f"doc_id {id_type}, node binary, bands array<bigint>")


def shingle_sets(texts: DataFrame, size: int = SHINGLE, weights: str = WEIGHTS) -> DataFrame:
    """(node, shingles) from (node, text): the sorted different shingle hashes, 64 bits each; with weights="count", repeats are numbered."""

    def run(batches):
        import pyarrow as pa

        for b in pieces_of(batches, CHUNK):
            h, sizes = shingles(b.column(1).to_pylist(), size)
            out = []
            for part in np.split(h, np.cumsum(sizes)[:-1]):
                if weights == "count":
                    part = np.sort(part)
                    i = np.arange(len(part))
                    new = np.ones(len(part), bool)
                    new[1:] = part[1:] != part[:-1]
                    part = mix(part + _MUL * (i - np.maximum.accumulate(np.where(new, i, 0))).astype(np.uint64))
                out.append(np.unique(part).astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["node", "shingles"])

    return texts.select("node", "text").mapInArrow(tidy(run), "node binary, shingles binary")


def buckets(nodes: DataFrame) -> DataFrame:
    """(band, h, a, b, n) from (node, bands): the least and the greatest member of every bucket of several, and how many it has."""
    flat = nodes.select("node", F.posexplode("bands").alias("band", "h"))
    return flat.groupBy("band", "h").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count("*").alias("n")).where("a < b")


def members(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """(band, h, node, a, b) of the members of the buckets in ends."""
    flat = nodes.select("node", F.posexplode("bands").alias("band", "h"))
    return spread_join(flat, ends.select("band", "h", "a", "b"), ["band", "h"], ["node"], counts=ends.select("band", "h", "n"))


def candidates(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """(x, y) with x < y: each member of a bucket with the bucket's least and greatest, each pair once."""
    pairs = members(nodes, ends).select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("node").alias("y")), F.struct(F.col("node").alias("x"), F.col("b").alias("y")))).alias("p")).select("p.*")
    return pairs.where("x < y").distinct()


def verified(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs whose sets' Jaccard similarity is at least `similarity`."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            keep = []
            for s, t in zip(b.column(2), b.column(3), strict=True):
                p, q = np.frombuffer(s.as_buffer(), "<u8"), np.frombuffer(t.as_buffer(), "<u8")
                if min(len(p), len(q)) < similarity * max(len(p), len(q)):
                    keep.append(False)
                    continue
                same = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(same >= similarity * (len(p) + len(q) - same) - 1e-9)
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    # a hub is the x or the y of many pairs; its set goes to all tasks that hold some of them
    with_x = spread_join(pairs, sets.select(F.col("node").alias("x"), F.col("shingles").alias("s")), ["x"], ["y"])
    both = spread_join(with_x, sets.select(F.col("node").alias("y"), F.col("shingles").alias("t")), ["y"], ["x"], counts=pairs.groupBy("y").agg(F.count("*").alias("n")))
    return both.select("x", "y", "s", "t").mapInArrow(tidy(run), "x binary, y binary")


def rest_of(nodes: DataFrame, ends: DataFrame, rooted: DataFrame) -> DataFrame:
    """(band, h, root, node) of the members that are neither least nor greatest of their bucket, where these are of several classes."""
    inner = members(nodes, ends.where("n > 3")).where("node <> a and node <> b").select("band", "h", "node")
    inner = settled(inner.join(rooted, "node", "left").select("band", "h", "node", F.coalesce("root", "node").alias("root")))
    several = inner.groupBy("band", "h").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("n")).where("a < b")
    return spread_join(inner, several.select("band", "h"), ["band", "h"], ["node"], "left_semi", several.select("band", "h", "n"))


def linked(rest: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(x, y) that join the classes of a bucket's members: all pairs of different classes are compared, and one link is given for each two classes that become one."""

    def run(t):
        import pyarrow as pa

        names, roots_ = t.column("node").to_pylist(), t.column("root").to_pylist()
        codes = {r: i for i, r in enumerate(dict.fromkeys(roots_))}
        cls = np.array([codes[r] for r in roots_])
        x, y = [], []
        if len(codes) > 1:
            held = [np.frombuffer(s.as_buffer(), "<u8") for s in t.column("shingles")]
            size = np.array([len(s) for s in held])
            doc = np.repeat(np.arange(len(held)), size)
            number = np.unique(np.concatenate(held), return_inverse=True)[1]
            post, first = doc[np.argsort(number, kind="stable")], np.concatenate(([0], np.cumsum(np.bincount(number))))
            ends = np.cumsum(size)
            for i in range(1, len(held)):
                if (cls[:i] == cls[i]).all():
                    continue
                mine = number[ends[i] - size[i] : ends[i]]
                many = first[mine + 1] - first[mine]
                until = np.cumsum(many)
                same = np.bincount(post[np.repeat(first[mine] - (until - many), many) + np.arange(int(until[-1]))], minlength=len(held))[:i]
                for j in np.flatnonzero(same >= similarity * (size[:i] + size[i] - same) - 1e-9):
                    if cls[j] != cls[i]:
                        x.append(min(names[i], names[j]))
                        y.append(max(names[i], names[j]))
                        cls[cls == cls[j]] = cls[i]
        return pa.table([pa.array(x, pa.binary()), pa.array(y, pa.binary())], names=["x", "y"])

    full = settled(rest.join(sets, "node"))
    parts = full.groupBy("band", "h").agg(F.ceil(F.sum(F.octet_length("shingles")) / REST).cast("int").alias("parts"))
    own, other = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"), F.col("other")
    dealt = spread_join(full, parts, ["band", "h"], ["node"]).select("band", "h", "node", "root", "shingles", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    met = dealt.select("band", "h", F.least("own", other).alias("i"), F.greatest("own", other).alias("j"), "node", "root", "shingles")
    return met.groupBy("band", "h", "i", "j").applyInArrow(run, "x binary, y binary").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes that have an edge: root is the least node of the connected component. Alternating large and small stars, a table a step."""
    edges = settled(edges.select("x", "y").where("x <> y"))
    mark = None
    while True:
        both = edges.union(edges.select("y", "x")).toDF("u", "v")
        least = settled(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        # large star: the greater neighbours of u go to the least of u and its neighbours
        large = spread_join(both.where("v > u"), least.select("u", "m"), ["u"], ["v"], counts=least.select("u", "n"))
        large = settled(large.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u > v").distinct())
        # small star: u and its lesser neighbours go to the least of them
        low = settled(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = spread_join(large, low.select("u", "m"), ["u"], ["v"], counts=low.select("u", "n")).select(F.explode(F.array(F.struct(F.col("u").alias("y"), F.col("m").alias("x")), F.struct(F.col("v").alias("y"), F.col("m").alias("x")))).alias("p")).select("p.x", "p.y").where("x < y").distinct()
        edges = settled(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("y").alias("node"), F.col("x").alias("root")).union(edges.select(F.col("x"), F.col("x")).distinct())


def _sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SENT else df


def roots(docs: DataFrame, signed: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY, size: int = SHINGLE, weights: str = WEIGHTS) -> DataFrame:
    """(node, root) of the texts that are linked to others."""
    nodes = signed.groupBy("node").agg(F.min(F.struct("doc_id", "bands")).alias("r")).select("node", "r.doc_id", "r.bands").where("size(bands) > 0")
    ends = settled(buckets(nodes))
    pairs = settled(candidates(nodes, ends))
    near = settled(pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct().join(nodes.select("node", "doc_id"), "node"))
    n = near.count()
    # of equal texts one row is read again; repeated rows are as one
    named = docs.select(text_key(text).alias("node"), docs[key].alias("_id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    same_row = [named["node"] == F.col("_near.node"), F.col("_id").eqNullSafe(F.col("_near.doc_id"))]
    named = named.join(_sent(near, n).alias("_near"), same_row, "left_semi")
    sets = settled(shingle_sets(named, size, weights).dropDuplicates(["node"]))
    best = settled(pairs.groupBy("y").agg(F.min("x").alias("x")).select("x", "y").union(pairs.groupBy("x").agg(F.max("y").alias("y")).select("x", "y")).distinct())
    links = settled(verified(best, sets, similarity))
    rooted = settled(components(links))
    r = rooted.count()
    end = lambda c: F.coalesce(F.col(f"_{c}"), F.col(c))
    side = lambda c: _sent(rooted.select(F.col("node").alias(c), F.col("root").alias(f"_{c}")), r)
    across = settled(pairs.join(best, ["x", "y"], "left_anti").join(side("x"), "x", "left").join(side("y"), "y", "left").where(end("x") != end("y")).select("x", "y"))
    more = settled(verified(across, sets, similarity))
    if not more.isEmpty():
        links = links.union(more)
        rooted = settled(components(links))
    rest = settled(rest_of(nodes, ends, rooted))
    if rest.isEmpty():
        return rooted
    found = settled(linked(rest, sets, similarity))
    return rooted if found.isEmpty() else components(links.union(found))


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE, weights: str = WEIGHTS) -> DataFrame:
    """(doc_id, node, class_id): a row for each of docs, with its text's key and the least id of its class."""
    signed = settled(signatures(docs, text, key, bands, rows, size, weights))
    rooted = settled(roots(docs, signed, text, key, similarity, size, weights))
    n = rooted.count()
    least = signed.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    rooted = settled(least.join(_sent(rooted, n), "node", "left").select("node", "least", "n", F.coalesce("root", "node").alias("root")))
    named = settled(rooted.groupBy("root").agg(F.min("least").alias("class_id"), F.count("*").alias("n")))
    by_node = spread_join(rooted.select("node", "root"), named.select("root", "class_id"), ["root"], ["node"], counts=named.select("root", "n")).select("node", "class_id")
    return spread_join(signed.select("doc_id", "node"), by_node, ["node"], ["doc_id"], counts=rooted.select("node", "n")).select("doc_id", "node", "class_id")


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that stand for their class: one row of each. Of repeated rows one stays."""
    found = settled(classes(docs, text, key, **options))
    gone = settled(found.where(~F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("_id"), F.col("node").alias("_node")).distinct())
    keyed = docs.withColumn("_key", text_key(text))
    same = F.col(key).eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_node"))
    kept = keyed.join(_sent(gone, gone.count()), same, "left_anti")
    # ids of which more than one row is left: repeated rows, or one id with several texts of a class
    again = settled(found.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("class_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("class_id").alias("_id")))
    n = again.count()
    if not n:
        return kept.drop("_key")
    which = found.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("class_id").agg(F.min("node").alias("_node")).select(F.col("class_id").alias("_id"), "_node")
    twice = _sent(again, n)
    alone = kept.join(twice, F.col(key).eqNullSafe(F.col("_id")), "left_anti")
    several = kept.join(twice, F.col(key).eqNullSafe(F.col("_id")), "left_semi").join(which, same, "left_semi").dropDuplicates([key, "_key"])
    return alone.unionByName(several).drop("_key")


def op7_near_dedup(spark, sf_dir):
    found = classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", (~F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("duplicate"))


QUERIES = {"op7_near_dedup": op7_near_dedup}
ORACLES = {}

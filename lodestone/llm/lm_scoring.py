"""LM scoring with a causal self-attention model over subword ids.

Words (ASCII letters in lower case) become subword ids of a public byte-level vocabulary; a text is BEGIN, its ids, END. One
attention layer with tables for queries, keys and values of ids and a bias by distance predicts the next id in two factors,
both from what attention has gathered: its class, added to what the last id alone predicts, and the id among those of its
class. Windows of WINDOW ids overlap by half: the second half of each is scored with the first as context, so every id is
scored once, all windows of a block in one batched product under a causal mask that also parts documents.

Each word's probability mixes two ways from the attention model to the word:
P = MIX * P(its first id | context) * (c + 1) / M + (1 - MIX) * product over its ids of P(id | context),
c being the word's count in training texts and M the sum of c + 1 over the known words that begin with that id and one unknown
one. Classes are of ids that open a word (END among them) or of ids that go on with one; where a word is known to have ended,
its successor's class is taken among the former, and the second way counts the ending of the word in turn.

What is gathered from the corpus covers all training rows: the counts of words and of ids, what precedes the common ids,
which forms the classes, and how often each class follows each last id. The tables of the layer are trained in numpy on all
training texts, in ROUNDS rounds that part the texts by hash: each task goes on from the same tables over its own texts of the
round, predicting each id after the first of every text once, and the tables are averaged by ids, block by block. Where that
would be under STEPS steps a task, windows drawn at random are added.

Texts are encoded once and stored as ids; words are told apart by 64-bit hashes of their ids. The counts of the HEAD commonest
words (at most) are sent to every executor; other words of a text meet their counts in a shuffle join, and sums by row join
the parts.

Edge cases: null and empty texts have the end token only; whole texts of any length; words of any length; repeated rows and
ties each have their row and count each time; null ids are held in (their remainder is not 2); an empty training part leaves
counts of 0 and an untrained model; an empty table gives no rows; other columns are left out."""

from dataclasses import dataclass

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bpe import gather
from lodestone.llm.common import gathered, one_thread, pieces_of, settled, table, tasks_for, tidy
from lodestone.llm.near_dedup import mix as scatter
from lodestone.llm.token_files import Coder, load_tokenizer

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
HEAD = 400_000
#: The least number of steps for each task of a round, and the rounds that training texts are parted over.
STEPS, ROUNDS = 20, 2
#: Stored bytes of ids for each task of a round, and tasks whose tables are added at once.
TASK_BYTES, ADDED = 24_000_000, 64
MIX = 0.9
#: Ids of each kind whose predecessors are counted.
COMMON = 1500
#: Ids that have a vector of their own within their class; the others of a class share one and are parted by their counts.
LIVE = 1000
WINDOW, DIM, CLASSES, ROWS = 32, 16, 64, 1024
#: Classes of ids that open a word: by clusters, by count, and END's; the others are of ids that go on with one.
CLUSTERS, BY_COUNT, OPENING = (36, 20), (4, 3), 41
BATCH, RATE = 256, 4e-2
#: Bytes of texts that are encoded at once, and of ids that are worked on at once.
TEXT_CHUNK, CHUNK = 4_000_000, 2_000_000
#: Blocks that the tables are averaged in.
BLOCKS = 64


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 7 == 2, F.lit(False))


class Speller(Coder):
    """Ids and keys of words, kept from chunk to chunk."""

    MOST = 500_000

    def forget(self):
        super().forget()
        self.keys, self.first = np.empty(0, np.int64), np.empty(0, np.int32)

    def _learn(self, parts):
        """The ids of a space and the word, for each word. No id crosses such a space unless white space follows it; those words go alone."""
        import pyarrow as pa
        import pyarrow.compute as pc

        flags = self._leads(parts)
        loose = [f" {w}" for w in parts.filter(pa.array(flags)).to_pylist()]
        ids, sizes = self._spell(pc.if_else(pa.array(flags), ".", parts) if loose else parts)
        if loose:
            each = np.split(ids, np.cumsum(sizes)[:-1])
            for j, got in zip(np.flatnonzero(flags).tolist(), self._ids(loose), strict=True):
                each[j] = got
            ids, sizes = np.concatenate(each), np.array([len(x) for x in each], np.int64)
        self.flat, self.sizes = np.concatenate((self.flat, ids)), np.concatenate((self.sizes, sizes))
        self.keys = np.concatenate((self.keys, word_keys(ids, sizes)))
        self.first = np.concatenate((self.first, ids[np.cumsum(sizes) - sizes].astype(np.int32)))

    def words(self, texts):
        """(numbers of the words, words per text) of an Arrow array of texts without nulls."""
        import pyarrow.compute as pc

        parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        is_word = pc.not_equal(parts.values, "")  # blanks at the ends of a text leave empty parts
        until = np.concatenate(([0], np.cumsum(is_word.to_numpy(zero_copy_only=False))))
        return self._numbers(parts.values.filter(is_word)), np.diff(until[parts.offsets.to_numpy()])

    def ids(self, which):
        """(ids, ids per word) of numbered words."""
        return gather(self.flat, np.concatenate(([0], np.cumsum(self.sizes))), which)


def _binary(data, sizes):
    """Arrow array of binary values that lie in data one after the other."""
    import pyarrow as pa

    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _bytes(column):
    """(data, sizes) of an Arrow array of binary values."""
    if not len(column):
        return np.empty(0, np.uint8), np.empty(0, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    return data, np.diff(offsets).astype(np.int64)


def _width(most: int) -> str:
    return "<u2" if most < 1 << 16 else "<u4"


def _first_row(n: int, columns: dict):
    """Arrow array of n lists of structs, of which the first holds the columns' values and the others none."""
    import pyarrow as pa

    values = pa.StructArray.from_arrays([pa.array(v) for v in columns.values()], names=list(columns))
    return pa.ListArray.from_arrays(pa.array(np.append([0], np.full(n, len(values))).astype(np.int32)), values)


def encoded(docs: DataFrame, vocabulary: int, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, held_out, ids, sizes, words, seen) of docs (doc_id, text): the ids of the words (unsigned little-endian integers of 16 bits if the vocabulary fits them, of 32 else) and ids per word (bytes; 255 goes on in the next one).

    words and seen are not of their row: the first row of each chunk holds how often each word and each id comes in the chunk's rows that are not held out."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, ids binary, sizes binary, words array<struct<key:bigint,first:int,n:bigint>>, seen array<struct<id:int,n:bigint>>"

    def run(batches):
        import pyarrow as pa

        speller, kind = Speller(load_tokenizer(tokenizer)), np.dtype(_width(vocabulary + 1))
        for held in gathered(batches, TEXT_CHUNK):
            out = pa.concat_arrays([b.column(1) for b in held])
            which, words = speller.words(pa.concat_arrays([b.column(2) for b in held]))
            ids, sizes = speller.ids(which)
            ends = np.concatenate(([0], np.cumsum(words)))
            long = sizes // 255
            stored = np.full(len(sizes) + int(long.sum()), 255, np.uint8)
            stored[np.cumsum(long + 1) - 1] = sizes % 255
            per_text = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[ends])  # noqa: E731, B023
            learnt = np.repeat(~out.to_numpy(zero_copy_only=False).astype(bool), words)
            n_words = np.bincount(which[learnt], minlength=len(speller.sizes))
            n_ids = np.bincount(ids[np.repeat(learnt, sizes)], minlength=vocabulary)
            w, i = np.flatnonzero(n_words), np.flatnonzero(n_ids)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([b.column(0) for b in held]),
                    out,
                    _binary(ids.astype(kind), per_text(sizes) * kind.itemsize),
                    _binary(stored, per_text(long + 1)),
                    _first_row(len(out), {"key": speller.keys[w], "first": speller.first[w], "n": n_words[w]}),
                    _first_row(len(out), {"id": i.astype(np.int32), "n": n_ids[i]}),
                ],
                names=["doc_id", "held_out", "ids", "sizes", "words", "seen"],
            )

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(tidy(run), schema)


def read_ids(column, vocabulary: int):
    """(ids, ids per text) of a column of encoded()."""
    data, sizes = _bytes(column)
    kind = np.dtype(_width(vocabulary + 1))
    return data.view(kind), sizes // kind.itemsize


def read_sizes(column):
    """(ids per word, words per text) of a column of encoded()."""
    data, sizes = _bytes(column)
    last = data < 255
    cum = np.cumsum(data, dtype=np.int64)[last]
    until = np.concatenate(([0], np.cumsum(last)))[np.concatenate(([0], np.cumsum(sizes)))]
    return np.diff(cum, prepend=0), np.diff(until)


def word_keys(ids, sizes):
    """A 64-bit number for every word: the sum of scattered (id, place in the word), scattered again with its length."""
    if not len(sizes):
        return np.empty(0, np.int64)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(ids)) - np.repeat(starts, sizes)
    x = scatter(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(1))
    return scatter(np.add.reduceat(x, starts) + sizes.astype(np.uint64)).view(np.int64)


class Sorted:
    """Where word keys lie among the sorted keys of known words: by their leading bits first, as they are scattered evenly, then step by step."""

    def __init__(self, keys):
        bits = max(1, len(keys).bit_length())
        self.n, self.shift = len(keys), np.uint64(64 - bits)
        self.keys = np.append(keys, np.int64(2**63 - 1))
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(self._lead(keys), minlength=1 << bits))))

    def _lead(self, keys):
        return ((keys.view(np.uint64) ^ np.uint64(1 << 63)) >> self.shift).astype(np.int64)

    def find(self, keys):
        """(place, whether it is there) of each key; the place of others is not theirs."""
        at = self.starts.take(self._lead(keys))
        later = np.flatnonzero(self.keys.take(at) < keys)
        while len(later):
            at[later] += 1
            later = later[self.keys.take(at.take(later)) < keys.take(later)]
        return at, (at < self.n) & (self.keys.take(at) == keys)


def by_id(rows: DataFrame, vocabulary: int):
    """Array of n by id from (id, n): one row an id of the vocabulary at most."""
    got, out = rows.toPandas(), np.zeros(vocabulary, np.int64)
    out[got["id"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


def with_ends(ids, per_text, begin: int, end: int):
    """(ids, text numbers) with begin before and end after each text."""
    ends = np.cumsum(per_text)
    full = np.insert(ids.astype(np.int32), np.stack((ends - per_text, ends), 1).ravel(), np.tile(np.array([begin, end], np.int32), len(per_text)))
    return full, np.repeat(np.arange(len(per_text), dtype=np.int32), per_text + 2)


@dataclass
class Model:
    """row: table row of each id; cls: class of each; slot: place of each among the vectors within classes, which lie class after class from first_of on; share: log probability of each within its slot. tables: the layer's. seen: ids that training has predicted."""

    row: np.ndarray
    cls: np.ndarray
    slot: np.ndarray
    share: np.ndarray
    first_of: np.ndarray
    tables: dict
    window: int = WINDOW
    seen: int = 0

    def mask(self):
        """Bias of each (query, key) of a window: queries are its second half; keys after the query count as never."""
        half = self.window // 2
        away = (half + np.arange(half))[:, None] - np.arange(self.window)[None, :]
        return np.where(away >= 0, self.tables["bias"][np.clip(away, 0, self.window - 1)], -1e4).astype(np.float32)

    def within(self, h, cls, slot):
        """Log probability of each slot among those of its class, from what attention has gathered; the last column of h is 1."""
        out = np.zeros(len(h), np.float32)
        vectors = np.concatenate((self.tables["inner"], self.tables["inner_bias"][:, None]), 1)
        safe = np.abs(vectors).max(0) @ np.append(np.abs(self.tables["v"]).max(0), 1) < 60  # no exponential overflows
        order = np.argsort(cls.astype(np.uint8), kind="stable")
        h, slot = h.take(order, 0), slot.take(order)
        until = np.cumsum(np.bincount(cls, minlength=CLASSES))
        for c, (a, e) in enumerate(zip(np.concatenate(([0], until[:-1])), until, strict=True)):
            first, last = self.first_of[c], self.first_of[c + 1]
            if a == e or last - first < 2:
                continue
            z = h[a:e] @ vectors[first:last].T
            if not safe:
                np.clip(z, np.float32(-60), np.float32(60), out=z)
            right = z[np.arange(e - a), slot[a:e] - first]
            np.exp(z, out=z)
            out[order[a:e]] = right - np.log(z @ np.ones(last - first, np.float32))
        return out

    def predict(self, ids, doc, block: int = 128, blocks_within: int = 64):
        """Log probability of each id after the first of its document, given the ids before it, and what to add to that if a word is known to have ended; both 0 for the first. doc: document number of each id, ascending."""
        n, half, t = len(ids), self.window // 2, self.tables
        blocks = -(-n // half)
        row = np.zeros((blocks + 1) * half, np.int32)
        row[half : half + n] = self.row[ids]
        of = np.full((blocks + 1) * half, -1, np.int32)
        of[half : half + n] = doc
        nxt, slot = np.zeros((2, blocks * half), np.int32)
        nxt[: n - 1], slot[: n - 1], slot[n - 1 :] = self.cls[ids[1:]], self.slot[ids[1:]], self.first_of[0]
        got, open_ = np.empty(blocks * half, np.float32), np.empty(blocks * half, np.float32)
        mask, row2, of2 = self.mask(), row.reshape(-1, half), of.reshape(-1, half)
        sums = np.ones((CLASSES, 2), np.float32)  # of all classes, and of those that open a word
        sums[OPENING:, 1] = 0
        ones = np.concatenate((t["v"], np.ones((len(t["v"]), 1), np.float32)), 1)
        q, dim = t["q"] * np.float32(1 / np.sqrt(t["q"].shape[1])), t["v"].shape[1]
        widest = lambda x: float(np.sqrt(np.einsum("ij,ij->i", x, x).max(initial=0)))
        low = widest(q) * widest(t["k"]) < 40  # neither scores nor logits leave the range in which no exponential overflows
        safe = float(np.abs(t["last"]).max()) + widest(t["v"]) * widest(t["out"].T) < 60
        windows = lambda x: np.lib.stride_tricks.as_strided(x, (len(x) // half - 1, 2 * half, x.shape[1]), (half * x.strides[0], *x.strides))  # noqa: E731  # each with the half before it
        for start in range(0, blocks, block * blocks_within):
            stop = min(start + block * blocks_within, blocks)
            gathered_ = np.ones(((stop - start) * half, dim + 1), np.float32)
            for a in range(start, stop, block):
                e = min(a + block, stop)
                here, keys = row2[a + 1 : e + 1], row[a * half : (e + 1) * half]
                s = q.take(here, 0) @ windows(t["k"].take(keys, 0)).transpose(0, 2, 1)
                if not low:
                    np.clip(s, np.float32(-40), np.float32(40), out=s)
                s += mask
                mixed = np.flatnonzero((of2[a:e, 0] != of2[a + 1 : e + 1, -1]) | (of2[a:e, 0] < 0))  # windows that hold several documents, or begin before the first
                if len(mixed):
                    qs, ks = of2[a + 1 + mixed], np.concatenate((of2[a + mixed], of2[a + 1 + mixed]), 1)
                    s[mixed] = np.where(qs[:, :, None] == ks[:, None, :], s[mixed], np.float32(-1e4))
                np.exp(s, out=s)
                h = s @ windows(ones.take(keys, 0))
                h = (h[:, :, :-1] / h[:, :, -1:]).reshape(-1, dim)
                gathered_[(a - start) * half : (e - start) * half, :-1] = h
                logits = h @ t["out"]
                logits += t["last"].take(here.ravel(), 0)
                if not safe:
                    np.clip(logits, np.float32(-60), np.float32(60), out=logits)
                right = logits[np.arange(len(logits)), nxt[a * half : e * half]]
                np.exp(logits, out=logits)
                all_, opening = np.log(logits @ sums + np.float32(1e-30)).T
                got[a * half : e * half], open_[a * half : e * half] = right - all_, all_ - opening
            got[start * half : stop * half] += self.within(gathered_, nxt[start * half : stop * half], slot[start * half : stop * half])
        lp, more = np.zeros((2, n))
        lp[1:], more[1:] = got[: n - 1], open_[: n - 1]
        lp += self.share[ids]
        first = np.ones(n, bool)
        first[1:] = doc[1:] != doc[:-1]
        lp[first] = more[first] = 0.0
        return lp, more


def successions(learnt: DataFrame, vocabulary: int, a, b, shape):
    """Table of how often an id of code a is followed by one of code b in a text, over all texts of learnt; b of -1 doesn't count. One dense table a task, summed by place."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros(shape[0] * shape[1], np.int64)
        for batch in pieces_of(batches, CHUNK):
            ids, doc = with_ends(*read_ids(batch.column(0), vocabulary), vocabulary, vocabulary + 1)
            to = b[ids[1:]]
            ok = (to >= 0) & (doc[1:] == doc[:-1])
            total += np.bincount(a[ids[:-1]][ok].astype(np.int64) * shape[1] + to[ok], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["at", "n"])

    rows = learnt.select("ids").mapInArrow(tidy(run), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()  # a row a place of the table at most
    out = np.zeros(shape[0] * shape[1])
    out[rows["at"].to_numpy(np.int64)] = rows["n"].to_numpy(float)
    return out.reshape(shape)


def codes(counts, opens):
    """(before, place): codes from 0 to 256 of ids as predecessors, and the places of the common ids of both kinds, -1 for others."""
    order = np.argsort(-counts, kind="stable")
    before, place = np.full(len(counts), 256), np.full(len(counts), -1)
    before[order[:256]] = np.arange(min(256, len(order)))
    for kind, at in ((True, 0), (False, COMMON)):
        common = order[opens[order] == kind][:COMMON]
        place[common] = at + np.arange(len(common))
    return before, place


def _classes(preceded, counts, opens, rng):
    """Class of each id, for those that open a word and the others apart: the common ones by what precedes them (k-means of smoothed shares), the rest by count."""
    order = np.argsort(-counts, kind="stable")
    cls = np.full(len(counts), CLASSES - 1, np.int32)
    for kind, start, at, k, extra in ((True, 0, 0, CLUSTERS[0], BY_COUNT[0]), (False, COMMON, OPENING, CLUSTERS[1], BY_COUNT[1])):
        mine = order[opens[order] == kind]
        common, rest = mine[:COMMON], mine[COMMON:]
        if not len(common):
            continue
        m = preceded[:, start : start + len(common)].T
        share = np.sqrt((m + 0.02) / (m + 0.02).sum(1, keepdims=True))
        mass = m.sum(1)
        centre = share[np.argsort(-mass, kind="stable")[:k]].copy()
        if len(centre) < k:
            centre = np.concatenate((centre, rng.random((k - len(centre), 257))))
        for _ in range(12):
            near = np.argmin(((centre**2).sum(1)[None, :] - 2 * share @ centre.T), 1)
            for c in range(k):
                w = mass[near == c] + 1e-3
                if len(w):
                    centre[c] = (share[near == c] * w[:, None]).sum(0) / w.sum()
        cls[common] = at + near
        cum = np.cumsum(counts[rest] + 1.0)
        cls[rest] = at + k + np.minimum((cum * extra / cum[-1]).astype(int), extra - 1) if len(rest) else at
    cls[-1] = OPENING - 1
    return cls


def untrained(counts, opens, follow_counts, seed: int = 5) -> Model:
    """The model before training, from the corpus counts of all ids (with BEGIN and END last), whether each opens a word, and follow_counts(a, b, shape), the successions of the corpus."""
    rng, n_ids, f = np.random.default_rng(seed), len(counts), np.float32
    some = counts.any()
    cls = _classes(follow_counts(*codes(counts, opens), (257, 2 * COMMON)), counts, opens, rng) if some else np.zeros(n_ids, np.int32)
    order = np.argsort(-counts, kind="stable")
    row = (ROWS + np.arange(n_ids) % 256).astype(np.int32)
    row[order[:ROWS]] = np.arange(min(ROWS, n_ids))
    row[n_ids - 2 :] = ROWS + 256, ROWS + 257
    rows = ROWS + 258
    # the vectors within classes: one for each common id, and one for all others of a class
    live = np.zeros(n_ids, bool)
    live[order[:LIVE]] = True
    code = np.where(live, cls.astype(np.int64) * (n_ids + 1) + np.arange(n_ids), cls.astype(np.int64) * (n_ids + 1) + n_ids)
    places, slot = np.unique(code, return_inverse=True)
    weight = np.bincount(slot, counts + 1.0)
    share = np.log((counts + 1.0) / weight[slot]).astype(f)
    first_of = np.searchsorted(places, np.arange(CLASSES + 1) * (n_ids + 1))
    shape = {"q": (rows, DIM), "k": (rows, DIM), "v": (rows, DIM), "bias": (WINDOW,), "out": (DIM, CLASSES), "inner": (len(places), DIM)}
    scale = {"bias": 0.01, "inner": 0.0}
    p = {n: rng.normal(0, scale.get(n, 0.3), s).astype(f) for n, s in shape.items()}
    p["bias"] -= (0.05 * np.arange(WINDOW)).astype(f)
    of_class = np.bincount(cls, counts + 1.0, CLASSES)
    p["inner_bias"] = np.log(weight / of_class[places // (n_ids + 1)]).astype(f)
    follow = np.maximum(of_class, 1) / of_class.sum()
    pairs = follow_counts(row, cls, (rows, CLASSES)) if some else np.zeros((rows, CLASSES))
    prior = 20 * follow
    p["last"] = np.log((pairs + prior) / (pairs.sum(1, keepdims=True) + prior.sum())).astype(f)
    p["last"][:, of_class == 0], p["out"][:, of_class == 0] = -40, 0  # classes without ids
    return Model(row, cls, slot.astype(np.int32), share, first_of, p)


class _Rows:
    """Sums by row number of values whose columns are an even number of 32-bit floats."""

    def __init__(self, rows):
        self.order = np.argsort(rows.astype(np.uint16), kind="stable")
        rows = rows.take(self.order)
        self.first = np.flatnonzero(np.diff(rows, prepend=-1))
        self.met = rows.take(self.first)

    def sums(self, values, out):
        out.fill(0)
        if len(self.first):
            pairs = values.take(self.order, 0).view(np.complex64)  # two columns are added at once
            out[self.met] = np.add.reduceat(pairs, self.first, axis=0).view(np.float32)


class Trainer:
    """Adam steps on a model's tables over windows of ids; its own copy of the tables. seen: ids predicted in all steps."""

    #: Values of the tables that are worked on at once.
    BLOCK = 1 << 15

    def __init__(self, model: Model, seed: int):
        self.m, self.rng, self.step, self.seen, self.log = model, np.random.default_rng(seed), 0, 0, []
        self.all = _joined(model.tables)
        self.mom, self.var, self.grad = (np.zeros_like(self.all) for _ in range(3))
        self.p, self.g = _parted(self.all, model.tables), _parted(self.grad, model.tables)  # views
        half = WINDOW // 2
        self.away = (half + np.arange(half))[:, None] - np.arange(WINDOW)[None, :]
        self.near, self.wide = np.clip(self.away, 0, WINDOW - 1), np.diff(model.first_of)
        self.row = model.row.astype(np.intp)

    def run(self, ids, doc, steps: int | None, batch: int = BATCH, rate: float = RATE):
        """So many steps over windows drawn at random; with None as many as take every id after the first of its document once, from the blocks of 16 that predict() works on, in random order."""
        half = WINDOW // 2
        if steps is None:
            blocks = -(-len(ids) // half)
            pad = half, blocks * half + 1 - len(ids)
            ids, doc = np.pad(ids, pad), np.pad(doc, pad, constant_values=-1)
            starts = self.rng.permutation(blocks) * half
            for some in np.array_split(starts, -(-blocks // batch)) if blocks else ():
                self.once(ids, doc, some, rate)
        else:
            for _ in range(steps if len(ids) > WINDOW + 1 else 0):
                self.once(ids, doc, self.rng.integers(0, len(ids) - WINDOW, batch), rate)

    def once(self, ids, doc, starts, rate: float):
        """A step over the windows that begin at starts; ids of documents below 0 are not predicted."""
        m, p, g, f, half = self.m, self.p, self.g, np.float32, WINDOW // 2
        scale, w = f(1 / np.sqrt(DIM)), starts[:, None] + np.arange(WINDOW + 1)
        of, at = doc.take(w), ids.take(w)
        x = self.row.take(at[:, :-1])
        xq, nxt = x[:, half:].ravel(), at[:, half + 1 :].ravel()
        live = ((of[:, half + 1 :] == of[:, half:-1]) & (of[:, half:-1] >= 0)).ravel()
        y, slot, count = m.cls.take(nxt), m.slot.take(nxt), int(live.sum())
        i = np.flatnonzero(live)
        self.step += 1
        self.seen += count
        q, k, v = p["q"].take(xq, 0).reshape(-1, half, DIM), p["k"].take(x, 0), p["v"].take(x, 0)
        q *= scale
        a = q @ k.transpose(0, 2, 1)
        np.clip(a, f(-40), f(40), out=a)
        a += np.where(self.away >= 0, p["bias"][self.near], f(-1e4))
        mixed = np.flatnonzero(of[:, 0] != of[:, -2])
        if len(mixed):
            a[mixed] = np.where(of[mixed, half:-1, None] == of[mixed, None, :-1], a[mixed], f(-1e4))
        np.exp(a, out=a)
        a *= f(1) / (a @ np.ones((WINDOW, 1), f))
        flat = np.ones((len(xq), DIM + 1), f)  # the last column is the biases'
        np.matmul(a, v, out=flat.reshape(-1, half, DIM + 1)[:, :, :-1])
        e = flat[:, :-1] @ p["out"]
        e += p["last"].take(xq, 0)
        np.clip(e, f(-60), f(60), out=e)
        np.exp(e, out=e)
        e *= f(1) / (e @ np.ones((CLASSES, 1), f))
        if count < len(live):
            e[~live] = 0
        y = y.take(i)
        right_at = i * CLASSES + y
        right = e.take(right_at)
        loss = -np.log(right + f(1e-12)).sum(dtype=float)
        e.ravel()[right_at] = right - f(1)
        dh = e @ p["out"].T
        g["out"][:] = flat[:, :-1].T @ e
        # the id within its class: the logits of all classes lie in one array, class after class, so that one call serves what is done to each of them
        vectors = np.concatenate((p["inner"], p["inner_bias"][:, None]), 1)
        g_inner = np.zeros_like(vectors)
        sort = np.argsort(y.astype(np.uint8), kind="stable")
        order, y = i.take(sort), y.take(sort)
        until = np.cumsum(np.bincount(y, minlength=CLASSES))
        h, wide = flat.take(order, 0), self.wide.take(y)
        z = np.empty(int(wide.sum()), f)
        row_at = np.cumsum(wide) - wide
        several, b, at_z = [], 0, 0
        for first, last, t in zip(m.first_of[:-1].tolist(), m.first_of[1:].tolist(), until.tolist(), strict=True):
            if b < t:
                own = z[at_z : at_z + (t - b) * (last - first)].reshape(t - b, last - first)
                if last - first > 1:
                    np.matmul(h[b:t], vectors[first:last].T, out=own)
                    several.append((own, b, t, first, last))
                else:
                    own[:] = 0  # the only id
                at_z += own.size
            b = t
        if len(order):
            np.clip(z, f(-60), f(60), out=z)
            np.exp(z, out=z)
            sums = np.add.reduceat(z, row_at)
            right_at = row_at + slot.take(order) - m.first_of.take(y)
            right = z.take(right_at)
            z[right_at] = right - sums
            loss -= np.log(right / sums + f(1e-12)).sum(dtype=float)
            by_sum = (f(1) / sums)[:, None]
            h *= by_sum
            dh_inner = np.zeros((len(order), DIM), f)
            for own, b, t, first, last in several:
                np.matmul(own.T, h[b:t], out=g_inner[first:last])
                np.matmul(own, vectors[first:last, :-1], out=dh_inner[b:t])
            dh_inner *= by_sum
            back = np.empty(len(order), np.intp)
            back[sort] = np.arange(len(order))
            if len(order) == len(dh):
                dh += dh_inner.take(back, 0)
            else:
                dh[i] += dh_inner.take(back, 0)
        self.log.append(float(loss / max(1, count)))
        g["inner"][:], g["inner_bias"][:] = g_inner[:, :-1], g_inner[:, -1]
        to_h, dh = np.einsum("ij,ij->i", dh, flat[:, :-1]), dh.reshape(-1, half, DIM)
        ds = dh @ v.transpose(0, 2, 1)
        ds -= to_h.reshape(-1, half, 1)
        ds *= a
        g["bias"][:] = np.bincount(self.near.ravel(), (ds.sum(0) * (self.away >= 0)).ravel(), WINDOW)
        keys, queries = _Rows(x.ravel()), _Rows(xq)
        keys.sums((ds.transpose(0, 2, 1) @ q).reshape(-1, DIM), g["k"])
        keys.sums((a.transpose(0, 2, 1) @ dh).reshape(-1, DIM), g["v"])
        queries.sums((ds @ k).reshape(-1, DIM), g["q"])
        g["q"] *= scale
        queries.sums(e, g["last"])
        # ten times the mean of gradients and a hundred times that of their squares, block by block so that the blocks stay in the cache
        c, size = f(1 / max(1, count)), f(np.sqrt(0.01 / (1 - 0.99**self.step)))
        down, least = f(0.1 * rate / (1 - 0.9**self.step) / size), f(1e-7 / size)
        for at in range(0, len(self.all), self.BLOCK):
            mom, var, grad = (x[at : at + self.BLOCK] for x in (self.mom, self.var, self.grad))
            grad *= c
            mom *= f(0.9)
            mom += grad
            grad *= grad
            var *= f(0.99)
            var += grad
            np.sqrt(var, out=grad)
            grad += least
            np.divide(mom, grad, out=grad)
            grad *= down
            self.all[at : at + self.BLOCK] -= grad


def _joined(tables: dict):
    return np.concatenate([tables[n].ravel() for n in sorted(tables)])


def _parted(flat, like: dict):
    out, at = {}, 0
    for n in sorted(like):
        out[n] = flat[at : at + like[n].size].reshape(like[n].shape).astype(np.float32, copy=False)
        at += like[n].size
    return out


def trained(learnt: DataFrame, model: Model, vocabulary: int, total: int, rounds: int = ROUNDS, steps: int = STEPS) -> Model:
    """The model after training on all of learnt, whose texts hold `total` ids; as it is without steps. Each text belongs to one of the rounds: its task predicts all its ids from the round's tables on, and the averages of the tables, weighted by ids, are the next round's."""
    spark, tasks = learnt.sparkSession, max(1, tasks_for(learnt, TASK_BYTES))
    a_step = BATCH * WINDOW // 2
    more = max(0.0, rounds * steps * tasks * a_step / max(1, total) - 1)  # windows drawn besides, as a share of the round's
    for round_ in range(rounds if total and steps else 0):
        sent = spark.sparkContext.broadcast(model)

        def run(batches, sent=sent, round_=round_):
            import pyarrow as pa
            from pyspark import TaskContext

            one_thread()
            task, due = TaskContext.get().partitionId(), 0.0
            trainer = Trainer(sent.value, 1000 * round_ + task)
            for b in pieces_of(batches, CHUNK):
                ids, doc = with_ends(*read_ids(b.column(0), vocabulary), vocabulary, vocabulary + 1)
                trainer.run(ids, doc, None)
                due += len(ids) / a_step * more
                trainer.run(ids, doc, int(due))
                due -= int(due)
            if trainer.seen:
                vectors = np.array_split(trainer.all.astype(np.float64) * trainer.seen, BLOCKS)
                yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([task] * BLOCKS, pa.int64()), pa.array([trainer.seen] * BLOCKS, pa.int64()), pa.array([v.astype(np.float32).tobytes() for v in vectors], pa.binary())], names=["block", "task", "n", "v"])

        def add(t):
            import pyarrow as pa

            t = t.sort_by("task")
            v = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in t.column("v").to_pylist())
            return pa.table({"block": t.column("block").slice(0, 1), "task": pa.array([t.column("task")[0].as_py() // ADDED], pa.int64()), "n": pa.array([sum(t.column("n").to_pylist())], pa.int64()), "v": pa.array([v.astype(np.float32).tobytes()], pa.binary())})

        parts = learnt.where(F.pmod(F.xxhash64("ids"), F.lit(rounds)) == round_).select("ids").coalesce(tasks)
        rows, left, schema = parts.mapInArrow(tidy(run), "block int, task long, n long, v binary"), tasks, "block int, task long, n long, v binary"
        while left > 1:  # sums of sums: no task holds more than ADDED vectors of a block
            rows, left = rows.groupBy("block", F.floor(F.col("task") / ADDED)).applyInArrow(add, schema), -(-left // ADDED)
        got = sorted(rows.collect(), key=lambda r: r["block"])  # one vector a block
        if got:
            model = Model(model.row, model.cls, model.slot, model.share, model.first_of, _parted(np.concatenate([np.frombuffer(r["v"], np.float32) / r["n"] for r in got]), model.tables), model.window, model.seen + got[0]["n"])
        sent.destroy()
    return model


def score(docs: DataFrame, text: str = "text", key: str = "doc_id", tokenizer: str = TOKENIZER, mix: float = MIX) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs, learning from those that are not held out."""
    spark = docs.sparkSession
    loaded = load_tokenizer(tokenizer)
    size = loaded.size
    opens = np.append(loaded.opens, [True, True])
    begin, end = size, size + 1
    coded = settled(encoded(docs.select(docs[key].alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text")), size, tokenizer))
    learnt = coded.where("not held_out")
    counts = settled(coded.select(F.inline("words")).groupBy("key").agg(F.min("first").alias("first"), F.sum("n").alias("n")))
    ends = learnt.count()
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_all, v_all = total["n"] + ends, total["v"] + (1 if ends else 0)
    floor = float(n_all + v_all + 1)
    # the least count of the words sent: counts in bins of an eighth of a power of 2, commonest first, while they fit
    level = F.floor(F.log2("n") * 8).cast("int")
    bins = sorted(counts.groupBy(level.alias("b")).agg(F.count("*").alias("c")).collect(), key=lambda r: -r["b"])
    least, room = None, HEAD
    for r in bins:
        if r["c"] > room:
            break
        least, room = r["b"], room - r["c"]
    head = counts.where(level >= least if least is not None else F.lit(False)).select("key", "n").toPandas().sort_values("key")
    per_id = np.append(by_id(coded.select(F.inline("seen")).groupBy("id").agg(F.sum("n").alias("n")), size), [0, ends])
    per_first = np.append(by_id(counts.groupBy(F.col("first").alias("id")).agg(F.sum(F.col("n") + 1).alias("n")), size), [0, ends])
    model = untrained(per_id, opens, lambda a, b, shape: successions(learnt, size, a, b, shape))
    model = trained(learnt, model, size, int(per_id.sum()))
    ln10, base_floor = np.log(10), np.log10(floor)
    sent = spark.sparkContext.broadcast((head.key.to_numpy(np.int64), head.n.to_numpy(np.int64), model, np.log10(per_first + 1.0)))
    end_base = np.log10(ends + 1) - base_floor

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        one_thread()
        keys_, counts_, lm, mass_ = sent.value
        head_ = Sorted(keys_)
        uid = TaskContext.get().partitionId() << 40
        for b in pieces_of(batches, CHUNK):
            plain, _ = read_ids(b.column(2), size)
            sizes, words = read_sizes(b.column(3))
            word = word_keys(plain, sizes)
            n = len(words)
            # BEGIN and END of each text are two more words of one id
            ends_ = np.cumsum(words)
            edges = np.stack((ends_ - words, ends_), 1).ravel()
            size_of = np.insert(sizes, edges, 1)
            text_of = np.repeat(np.arange(n), words + 2)
            ids = np.insert(plain.astype(np.int32), np.concatenate(([0], np.cumsum(sizes)))[edges], np.tile(np.array([begin, end], np.int32), n))
            lp, more = lm.predict(ids, np.repeat(text_of.astype(np.int32), size_of))
            until = np.cumsum(size_of)
            from_ = until - size_of
            spelling = (np.add.reduceat(lp, from_) + more[from_] - np.append(more, 0.0)[until]) / ln10
            opening = (lp[from_] + more[from_]) / ln10 - mass_[ids[from_]]  # with log10(c + 1), the way by counts
            is_end = np.zeros(len(size_of), bool)
            is_end[np.cumsum(words + 2) - 1] = True
            is_word = ~is_end
            is_word[np.cumsum(words + 2) - words - 2] = False
            at, in_head = head_.find(word)
            count_ = np.zeros(len(size_of))
            count_[is_end] = ends
            of_words = np.flatnonzero(is_word)
            known = of_words[in_head]
            count_[known] = counts_[at[in_head]]
            sure = is_end.copy()
            sure[known] = True
            base = np.where(sure, np.log10(count_ + 1) - base_floor, 0.0)
            base[is_end] = end_base
            mixed = np.zeros(len(size_of))
            mixed[sure] = np.logaddexp((opening[sure] + np.log10(count_[sure] + 1)) * ln10 + np.log(mix), spelling[sure] * ln10 + np.log1p(-mix)) / ln10
            rest, rest_word = of_words[~in_head], word[~in_head]
            offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(text_of[rest], minlength=n)))).astype(np.int32))
            sums = lambda x: pa.array(np.bincount(text_of, x, n))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(uid + np.arange(n), pa.int64()),
                    b.column(0),
                    b.column(1),
                    pa.array(words + 1, pa.int64()),
                    pa.array(np.bincount(text_of, sure & (count_ > 0), n).astype(np.int64)),
                    sums(base),
                    sums(mixed),
                    pa.ListArray.from_arrays(offsets, pa.array(rest_word, pa.int64())),
                    pa.ListArray.from_arrays(offsets, pa.array(opening[rest], pa.float32())),
                    pa.ListArray.from_arrays(offsets, pa.array(spelling[rest], pa.float32())),
                ],
                names=["uid", "doc_id", "held_out", "n_tokens", "known", "base", "mixed", "words", "opening", "spelling"],
            )
            uid += n

    id_type = docs.schema[key].dataType.simpleString()
    parts = settled(coded.select("doc_id", "held_out", "ids", "sizes").mapInArrow(tidy(run), f"uid long, doc_id {id_type}, held_out boolean, n_tokens long, known long, base double, mixed double, words array<bigint>, opening array<float>, spelling array<float>"))
    tail = parts.select("uid", F.explode(F.arrays_zip("words", "opening", "spelling")).alias("t")).select("uid", F.col("t.words").alias("key"), F.col("t.opening").cast("double").alias("o"), F.col("t.spelling").cast("double").alias("s"))
    tail = tail.join(counts.select("key", "n"), "key", "left")
    c = F.coalesce("n", F.lit(0))
    base = F.log10(c + 1.0) - float(base_floor)
    by_count = F.col("o") + F.log10(c + 1.0)
    top = F.greatest(by_count, F.col("s"))
    both = top + F.log10(mix * F.pow(F.lit(10.0), by_count - top) + (1 - mix) * F.pow(F.lit(10.0), F.col("s") - top))
    added = tail.groupBy("uid").agg(F.sum((c > 0).cast("long")).alias("k"), F.sum(base).alias("b"), F.sum(both).alias("m"))
    done = parts.drop("words", "opening", "spelling").join(added, "uid", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return done.select("doc_id", "held_out", "n_tokens", (F.col("known") + zero("k")).cast("long").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), (F.col("base") + zero("b")).alias("base_score"), (F.col("mixed") + zero("m")).alias("score"))


def op8_lm_scoring(spark, sf_dir):
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op8_lm_scoring": op8_lm_scoring}
ORACLES = {}

"""Token-ID files under Re-Pair grammar compression.

Documents are range-partitioned and sorted by key; a task encodes them and writes a file of shards of about CHUNK bytes of text. In a
shard, frequent pairs of neighbouring ids are replaced by nonterminals again and again: each round counts pairs by hash,
takes as many rules as there are pairs met LEAST times or more, settles overlaps in favour of the more frequent pair and
rewrites the sequence, until no pair is met LEAST times. A shard stores the rules by round, their expansion lengths, the symbols (24 bits each) and the
expanded position of every STEP-th symbol, so a span of ids is decoded from its symbols alone.

The first ids of shards follow from prefix sums over the manifest, in two levels of blocks.

Encoding: a text is cut before every space that precedes a non-space character; no token crosses such a place, so each
distinct part is encoded once a shard by the tokenizers library and the parts' ids are joined. New parts are cut once more
where the tokenizer's own pre-tokenizer always cuts, before marks that end a word or a line and before a line's first word, and
each distinct piece goes to the library once. Texts that hold a space before other white space, or at their end, go to the library whole.

Edge cases: null and empty texts have the end id only; whole texts of any length; rows with equal keys are ordered by the
hash of their texts and each has its row, and such rows are dealt over tasks like any others; null keys come first; an empty table has no shards; other columns are not stored."""

import io
import json
import zlib
from collections import defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from lodestone.llm.bpe import gather
from lodestone.llm.common import NewFile, gathered, opened, settled, shared_dir, table, tasks_for, tidy

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
CHUNK = 6_000_000
#: Bytes of stored input for each task.
TASK_BYTES = 30_000_000
#: Shards that a task reads.
SHARDS_A_TASK = 4
END = 0
LEAST = 16
STEP = 1024
HASH_BITS = 20
MAGIC = b"LSREPAIR1\n"


@dataclass
class Grammar:
    """base: the first nonterminal; rules: one (left, right) array a round; symbols: what is left; lengths: expansion length of each rule."""

    base: int
    rules: list
    symbols: np.ndarray

    def lengths(self):
        """Expansion length of every rule, in order."""
        out = np.empty(sum(len(r) for r in self.rules), np.int64)
        done = 0
        for r in self.rules:
            side = [np.where(x < self.base, 1, out[np.maximum(x.astype(np.int64) - self.base, 0)] if done else 1) for x in (r[:, 0], r[:, 1])]
            out[done : done + len(r)] = side[0] + side[1]
            done += len(r)
        return out


def compress(ids, base: int, least: int = LEAST, rounds: int | None = None) -> Grammar:
    """Re-Pair in rounds, until no pair is met `least` times or for so many rounds. A round looks at one pair for each of at most 2**HASH_BITS hashes; those it passes over wait for the next. Where all that it looks at are rare, it looks at the commonest pair of each hash.

    A pair of old symbols is never newly made, so a place is looked at again only while its pair may be frequent or once a neighbour is replaced."""
    s, rules, first = ids.astype(np.uint32), [], base
    at = None  # places of the pairs to look at; None is all
    while len(s) > least and first < 1 << 24 and (rounds is None or len(rules) < rounds):
        left, right = (s[:-1], s[1:]) if at is None else (s.take(at), s.take(at + 1))
        bits = min(HASH_BITS, 2 + len(left).bit_length())  # tables no larger than what is counted in them
        h = ((left * np.uint32(0x9E3779B1)) ^ (right * np.uint32(0x85EBCA77))) >> np.uint32(32 - bits)
        heavy = np.flatnonzero((np.bincount(h, minlength=1 << bits) >= least).take(h))
        if not len(heavy):
            break
        g = h.take(heavy)
        pair = left.take(heavy).astype(np.uint64)
        pair <<= np.uint64(32)
        pair |= right.take(heavy)
        at = heavy.astype(np.int32) if at is None else at.take(heavy)
        del h, left, right, heavy
        shown = np.zeros(1 << bits, np.uint64)
        shown[g] = pair
        same = shown.take(g) == pair
        count_ = np.bincount(g[same], minlength=1 << bits)
        if count_.max() < least:
            _, some, times = np.unique(pair, return_index=True, return_counts=True)
            some = some[np.argsort(times, kind="stable")]  # the commonest is written last
            shown[g[some]] = pair[some]
            same = shown.take(g) == pair
            count_ = np.bincount(g[same], minlength=1 << bits)
        del pair
        chosen = np.flatnonzero(count_ >= least)
        chosen = chosen[np.argsort(-count_[chosen], kind="stable")][: (1 << 24) - first]
        if not len(chosen):
            break
        place = np.full(1 << bits, len(chosen), np.uint32)
        place[chosen] = np.arange(len(chosen), dtype=np.uint32)
        rank = place[g]
        keep = same & (rank < len(chosen))
        to, rank = at[keep], rank[keep]
        # of overlapping pairs the more frequent wins; in a run of equal ones every second from its left end
        near = to[1:] == to[:-1] + 1
        later = np.flatnonzero(near & (rank[1:] == rank[:-1])) + 1  # those with an equal pair to their left; few
        ok = np.ones(len(to), bool)
        if len(later):
            i = np.arange(len(later))
            head = np.ones(len(later), bool)
            head[1:] = later[1:] != later[:-1] + 1
            ok[later[(i - np.maximum.accumulate(np.where(head, i, 0))) % 2 == 0]] = False
        ok[1:] &= ~near | (rank[1:] <= rank[:-1])
        ok[:-1] &= ~near | (rank[:-1] <= rank[1:])
        to, rank = to[ok], rank[ok]
        used = np.bincount(rank, minlength=len(chosen)) > 0  # others have lost all their places
        chosen, rank = chosen[used], (np.cumsum(used) - 1)[rank].astype(np.uint32)
        rules.append(np.stack([shown[chosen] >> np.uint64(32), shown[chosen] & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32))
        s[to] = first + rank
        stays, look = np.ones(len(s), bool), np.zeros(len(s), bool)
        stays[to + 1] = False
        look[at] = True
        look[to] = True
        before = to[to > 0] - 1
        look[before] = True
        look[before[~stays[before]] - 1] = True  # the left neighbour is itself a replaced pair
        look = look[stays]
        look[-1:] = False
        s = s[stays]
        at = np.flatnonzero(look).astype(np.int32)
        first += len(chosen)
    return Grammar(base, rules, s)


def expand(g: Grammar, symbols=None):
    """The ids that symbols (all of g's by default) stand for: each rule's ids once, then one gathering."""
    s = g.symbols if symbols is None else symbols
    flat, starts = np.arange(g.base, dtype=np.uint32), np.arange(g.base + 1)
    for r in g.rules:
        ids, sizes = gather(flat, starts, r.ravel())
        flat, starts = np.concatenate((flat, ids)), np.concatenate((starts, starts[-1] + np.cumsum(sizes.reshape(-1, 2).sum(1))))
    return gather(flat, starts, s)[0]


def pack(g: Grammar, keys: bytes, sizes) -> bytes:
    """A shard: header, keys (Arrow stream), ids per document, rules, expansion lengths, positions, symbols."""
    rules = np.concatenate(g.rules) if g.rules else np.empty((0, 2), np.uint32)
    lengths = g.lengths()
    each = np.ones(len(g.symbols), np.int64)
    big = g.symbols >= g.base
    each[big] = lengths[g.symbols[big] - g.base]
    places = np.concatenate(([0], np.cumsum(each)))[::STEP]
    parts = [keys, np.asarray(sizes, "<i8").tobytes(), rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), places.astype("<i8").tobytes(), g.symbols.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()]
    head = json.dumps({"base": g.base, "rounds": [len(r) for r in g.rules], "symbols": len(g.symbols), "sizes": [len(p) for p in parts]}).encode()
    return MAGIC + len(head).to_bytes(4, "little") + head + b"".join(parts)


class Shard:
    """The shard at an offset of a file; ids(start, n) decodes a span from its symbols, all() everything."""

    def __init__(self, file, offset: int = 0):
        self.file = file
        first = len(MAGIC) + 4
        magic = file.read_at(first, offset)
        if magic[:-4] != MAGIC:
            raise ValueError("no shard here")
        size = int.from_bytes(magic[-4:], "little")
        self.head = json.loads(file.read_at(size, offset + first))
        self.at = (offset + np.cumsum([first + size, *self.head["sizes"]])).tolist()
        rules = np.frombuffer(self._part(2), "<u4").reshape(-1, 2)
        cut = np.cumsum(self.head["rounds"])[:-1] if self.head["rounds"] else []
        self.grammar = Grammar(self.head["base"], np.split(rules, cut) if len(rules) else [], np.empty(0, np.uint32))
        self.lengths = np.frombuffer(self._part(3), "<u4").astype(np.int64)

    def _part(self, i: int) -> bytes:
        return self.file.read_at(self.head["sizes"][i], self.at[i])

    def keys(self):
        import pyarrow as pa

        return pa.ipc.open_stream(self._part(0)).read_all().column(0)

    def sizes(self):
        return np.frombuffer(self._part(1), "<i8")

    def _symbols(self, a: int, b: int):
        raw = np.frombuffer(self.file.read_at(3 * (b - a), self.at[5] + 3 * a), np.uint8).reshape(-1, 3)
        out = np.zeros((len(raw), 4), np.uint8)
        out[:, :3] = raw
        return out.view("<u4").ravel()

    def all(self):
        return expand(self.grammar, self._symbols(0, self.head["symbols"]))

    def ids(self, start: int, n: int):
        """n ids from place start of the shard on."""
        places = np.frombuffer(self._part(4), "<i8")
        block = int(np.searchsorted(places, start, "right")) - 1
        to = int(np.searchsorted(places, start + n, "left"))
        got = expand(self.grammar, self._symbols(block * STEP, min(to * STEP, self.head["symbols"])))
        return got[start - int(places[block]) :][:n]


def load_tokenizer(path: str = TOKENIZER):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    class Loaded:
        def __init__(self):
            self.inner = Tokenizer.from_file(path)  # as it comes: the string of an added token in a text is that token
            self.encode_batch_fast = self.inner.encode_batch_fast
            self.size = self.inner.get_vocab_size()
            # marks that close a word, none of which may be within an added token; where the pre-tokenizer doesn't part them and lines from words, there are none
            added = "".join(t.content for t in self.inner.get_added_tokens_decoder().values())
            found = [x for x, _ in self.inner.pre_tokenizer.pre_tokenize_str(" ab!!\nCd1%") if x] if self.inner.pre_tokenizer else []
            parted = found == ["\u0120ab", "!!", "\u010a", "Cd", "1", "%"] and "\n" not in added and self.inner.normalizer is None
            self.marks = "".join(c for c in ".,;:!?*%&$#)]}\"" if c not in added) if parted else ""
            # in a byte-level vocabulary a token has a character for each byte
            self.bytes_of, self.opens = np.zeros(self.size, np.int64), np.zeros(self.size, bool)
            for t, i in self.inner.get_vocab().items():
                self.bytes_of[i] = len(t)
                self.opens[i] = t[0] == "\u0120"  # stands for a space

    return Loaded()


class Coder:
    """Encodes chunks of texts. Parts that follow a space are kept with their ids, up to MOST of them, and so are the pieces
    that new ones are made of; no token crosses their start, so many new pieces are encoded in one string and told apart by their bytes."""

    MOST, JOINED, CALL = 1_000_000, 200, 20_000
    #: Letters and digits beside which a part may be cut; others are left to the library.
    PLAIN = r"[0-9A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]"

    def __init__(self, tokenizer, end: int = END):
        import re

        self.tokenizer, self.end = tokenizer, end
        self.marks = f"[{re.escape(tokenizer.marks)}]+" if tokenizer.marks else None
        self.forget()

    def forget(self):
        self.parts = self.pieces = None  # Arrow arrays in order of appearance
        self.flat, self.sizes, self.loose = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, bool)
        self.piece_flat, self.piece_sizes = np.empty(0, np.uint32), np.empty(0, np.int64)

    def _ids(self, strings):
        got = self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in got]

    def _leads(self, parts):
        """Which parts are empty or begin with white space: no token need start at the space before these."""
        import pyarrow.compute as pc

        first = pc.utf8_slice_codeunits(parts, 0, 1).dictionary_encode()
        blank = np.array([not c or c.isspace() for c in first.dictionary.to_pylist()], bool)
        return blank[first.indices.to_numpy()]

    def _cut(self, parts):
        """(pieces, first piece of each part, and one past the last) of parts, a space put before each."""
        import pyarrow as pa
        import pyarrow.compute as pc

        whole = pc.binary_join_element_wise("", parts, " ")
        if self.marks is None or pc.any(pc.match_substring(whole, "\x01")).as_py():
            return whole, np.arange(len(whole) + 1)
        lines = pc.match_substring(whole, "\n")
        if pc.any(lines).as_py():
            whole = pc.replace_with_mask(whole, lines, pc.replace_substring_regex(whole.filter(lines), rf"(\S)\n({self.PLAIN})", "\\1\x01\n\\2"))
        got = pc.split_pattern(pc.replace_substring_regex(whole, rf"({self.PLAIN})({self.marks})(\x01|$)", "\\1\x01\\2\\3"), "\x01")
        return got.values, got.offsets.to_numpy()

    def _learn_pieces(self, pieces):
        """Encodes new pieces. Those that begin with a space or a line's end are encoded side by side; others, the marks, alone."""
        import pyarrow as pa
        import pyarrow.compute as pc

        joined = pc.match_substring_regex(pieces, r"\A[ \n]").to_numpy(zero_copy_only=False)
        side, alone = pieces.filter(pa.array(joined)), pieces.filter(pa.array(~joined))
        flats, sizes = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        at = np.concatenate(([0], np.cumsum(pc.binary_length(side).to_numpy(), dtype=np.int64)))
        data = side.buffers()[2]  # filter() has made it anew: strings lie one after the other from its beginning
        for i in range(0, len(side), self.CALL):
            ends = at[i : i + self.CALL + 1]
            cuts = np.append(ends[: -1 : self.JOINED], ends[-1]).tolist()
            ids = np.concatenate(self._ids([data[a:e].to_pybytes().decode() for a, e in zip(cuts, cuts[1:])]))
            flats.append(ids)
            sizes.append(np.diff(np.searchsorted(np.cumsum(self.tokenizer.bytes_of[ids]), ends[1:] - ends[0], "left") + 1, prepend=0))
        lone = self._ids(alone.to_pylist())
        flat = np.concatenate([*flats, *lone])
        size = np.concatenate([*sizes, np.array([len(x) for x in lone], np.int64)])
        if len(lone):  # in the order of pieces
            order = np.empty(len(pieces), np.int64)
            order[np.concatenate((np.flatnonzero(joined), np.flatnonzero(~joined)))] = np.arange(len(pieces))
            flat, size = gather(flat, np.concatenate(([0], np.cumsum(size))), order)
        self.piece_flat, self.piece_sizes = np.concatenate((self.piece_flat, flat)), np.concatenate((self.piece_sizes, size))

    def _spell(self, parts):
        """(ids, ids per part) of parts with a space before each."""
        pieces, first = self._cut(parts)
        which, self.pieces = self._known(pieces, self.pieces, self._learn_pieces)
        ids, sizes = gather(self.piece_flat, np.concatenate(([0], np.cumsum(self.piece_sizes))), which)
        return ids, np.diff(np.concatenate(([0], np.cumsum(sizes)))[first])

    def _learn(self, parts):
        import pyarrow as pa
        import pyarrow.compute as pc

        flags = self._leads(parts)
        if flags.any():  # texts that have them are encoded whole
            parts = pc.if_else(pa.array(flags), ".", parts)
        ids, sizes = self._spell(parts)
        self.flat, self.sizes = np.concatenate((self.flat, ids)), np.concatenate((self.sizes, sizes))
        self.loose = np.concatenate((self.loose, flags))

    @staticmethod
    def _known(strings, known, learn):
        """(number of each string, known strings and the new ones after them); learn gets the new ones."""
        import pyarrow as pa
        import pyarrow.compute as pc

        coded = strings.dictionary_encode()
        if known is None:
            known = new = coded.dictionary
            number = np.arange(len(new), dtype=np.int32)
        else:
            at = pc.index_in(coded.dictionary, value_set=known)
            new = coded.dictionary.filter(at.is_null())
            number = at.fill_null(-1).to_numpy(zero_copy_only=False).copy()
            number[number < 0] = len(known) + np.arange(len(new), dtype=np.int32)
            known = pa.concat_arrays([known, new])
        learn(new)
        return number[coded.indices.to_numpy(zero_copy_only=False)], known

    def _numbers(self, parts):
        """Number of each part; new ones are learnt."""
        if self.parts is not None and len(self.parts) > self.MOST:
            self.forget()
        which, self.parts = self._known(parts, self.parts, self._learn)
        return which

    def encode(self, texts):
        """(ids of all texts with the end id after each, ids per text); texts is a list or an Arrow array."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        parts = pc.split_pattern(texts, " ")
        ends, n = parts.offsets.to_numpy().astype(np.int64), len(texts)
        which, first, whole = self._numbers(parts.values), ends[:-1], defaultdict(count().__next__)
        loose = self.loose[which]
        loose[first] = False
        known = len(self.sizes)
        # after the known parts come one without ids, the end id, and what is encoded whole
        lead = [known + 2 + whole[x] if x else known for x in parts.values.take(pa.array(first)).to_pylist()]
        which[first] = lead
        for d in np.unique(np.searchsorted(ends, np.flatnonzero(loose), "right") - 1):
            which[ends[d] : ends[d + 1]] = known
            which[ends[d]] = known + 2 + whole[texts[int(d)].as_py()]
        lone = self._ids(list(whole))
        flat = np.concatenate([self.flat, np.array([self.end], np.uint32), *lone])
        starts = np.concatenate(([0], np.cumsum(np.concatenate((self.sizes, np.array([0, 1, *map(len, lone)], np.int64))))))
        ids, sizes = gather(flat, starts, np.insert(which, ends[1:], known + 1))
        return ids, np.add.reduceat(sizes, first + np.arange(n))


def write_ids(docs: DataFrame, folder: str | None = None, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, chunk: int = CHUNK) -> DataFrame:
    """Writes the shards below folder (a new one in the shared folder by default). Returns the manifest: shard's task, seq, path and offset, n_docs, n_ids and start, its first id's place among all."""
    spark = docs.sparkSession
    folder = folder or shared_dir(spark)
    # one id, or no id, may be that of a third of all rows: the hash of the text parts such rows, and their places those that are equal in both
    ends = ["_key", F.xxhash64("_text"), F.monotonically_increasing_id()]
    rows = docs.select(docs[key].alias("_key"), docs[text].alias("_text")).repartitionByRange(tasks_for(docs, TASK_BYTES), *ends).sortWithinPartitions("_key", F.xxhash64("_text"), "_text")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        loaded, task = load_tokenizer(tokenizer), TaskContext.get().partitionId()
        coder, rows = Coder(loaded), []
        uri = f"{folder}/ids-{task:06d}.repair"
        with NewFile(uri) as file:
            for seq, held in enumerate(gathered(batches, chunk)):
                t = pa.Table.from_batches(held)
                ids, sizes = coder.encode(pa.concat_arrays([b.column(1) for b in held]))
                keys = io.BytesIO()
                with pa.ipc.new_stream(keys, t.select([0]).schema) as w:
                    w.write_table(t.select([0]).combine_chunks())
                rows.append((task, seq, uri, file.write(pack(compress(ids, loaded.size), keys.getvalue(), sizes)), len(sizes), len(ids)))
                del held, t
        names = ["task", "seq", "path", "offset", "n_docs", "n_ids"]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "path" else pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)

    manifest = settled(rows.mapInArrow(tidy(run), "task long, seq long, path string, offset long, n_docs long, n_ids long").withColumn("block", F.floor(F.col("task") / 1024)))
    blocks = manifest.groupBy("block").agg(F.sum("n_ids").alias("_n"))
    before = lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("block", before("_n", W.orderBy("block")).alias("_before"))
    return manifest.withColumn("_in", before("n_ids", W.partitionBy("block").orderBy("task", "seq"))).join(blocks, "block").withColumn("start", F.col("_in") + F.col("_before")).drop("_in", "_before", "block")


def read_ids(manifest: DataFrame, key_type: T.DataType, key: str = "doc_id", outputs=("start", "n_tokens", "ids")) -> DataFrame:
    """One row per document from the stored shards: key, start, n_tokens, ids (little-endian unsigned 32-bit integers), ids_crc32, as outputs asks."""
    types = {"start": T.LongType(), "n_tokens": T.LongType(), "ids": T.BinaryType(), "ids_crc32": T.LongType()}
    schema = T.StructType([T.StructField(key, key_type), *[T.StructField(o, types[o]) for o in outputs]])
    n = max(1, manifest.count())

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for uri, offset, first in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                fs, path = opened(uri)
                shard = Shard(fs.open_input_file(path), offset)
                sizes = shard.sizes()
                view = memoryview(np.ascontiguousarray(shard.all(), "<u4")).cast("B")
                ends = np.cumsum(sizes)
                starts = ends - sizes
                cols = {"start": lambda starts=starts, first=first: starts + first, "n_tokens": lambda sizes=sizes: sizes}
                cut = [view[4 * a : 4 * e] for a, e in zip(starts.tolist(), ends.tolist(), strict=True)] if {"ids", "ids_crc32"} & set(outputs) else []
                cols |= {"ids": lambda cut=cut: [bytes(x) for x in cut], "ids_crc32": lambda cut=cut: [zlib.crc32(x) for x in cut]}
                yield from pa.table([shard.keys(), *[pa.array(cols[o](), pa.binary() if o == "ids" else pa.int64()) for o in outputs]], names=[key, *outputs]).combine_chunks().to_batches()

    return manifest.select("path", "offset", "start").repartition(min(-(-n // SHARDS_A_TASK), 100_000)).mapInArrow(tidy(run), schema)


def op9_token_files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_ids(write_ids(docs), docs.schema["doc_id"].dataType, outputs=("start", "n_tokens", "ids_crc32"))


QUERIES = {"op9_token_files": op9_token_files}
ORACLES = {}

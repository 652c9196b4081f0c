"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A task gathers texts up to CHUNK characters and cuts them by the tokenizer's pattern; the distinct pieces are that chunk's
corpus, laid out as one array of symbols. An inverted index leads from each mergeable pair's rank to the places that hold
it. Merges are applied to the whole corpus in rank order; each touches only the places in its list and files their new
neighbours. A text's ids are its pieces' ids in order. Memory is bounded by CHUNK and the longest text.

The replay equals merging piece by piece unless a merge makes a neighbour of lower rank than its own; such pieces are
noticed and merged one by one.

Edge cases: null and empty texts give no ids; whole texts of any length are encoded; repeated rows each get their row; other
columns pass through, but for those named as an added one."""

import base64
import hashlib
import heapq

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestone.llm.common import table, tidy

CHUNK = 6_000_000
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
NONE = np.iinfo(np.int32).max


class Merges:
    """The rank file as tables: token bytes by id, and the merged id of every mergeable pair."""

    def __init__(self, path: str = RANKS):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.tokens = [b""] * self.size
        for t, r in ranks.items():
            self.tokens[r] = t
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = {}
        for t, r in ranks.items():
            for i in range(1, len(t)):
                a, b = ranks.get(t[:i]), ranks.get(t[i:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = r
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int32)

    def lookup(self, a, b):
        """Merged id of each pair, NONE where there is none."""
        k = a.astype(np.int64) * self.size + b
        at = np.searchsorted(self.keys, k)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == k, self.merged[at], NONE)

    def one(self, piece: bytes) -> list[int]:
        """Ids of one piece, merging the leftmost pair of least rank again and again."""
        import heapq

        parts: list = [bytes([b]) for b in piece]
        after, before = [*range(1, len(parts) + 1)], [*range(-1, len(parts) - 1)]
        rank = lambda i, j: self.ranks.get(parts[i] + parts[j], NONE)
        heap = [(r, i, i + 1) for i in range(len(parts) - 1) if (r := rank(i, i + 1)) != NONE]
        heapq.heapify(heap)
        while heap:
            r, i, j = heapq.heappop(heap)
            if parts[i] is None or after[i] != j or rank(i, j) != r:
                continue  # one of the two has been merged meanwhile
            parts[i], parts[j], after[i] = parts[i] + parts[j], None, after[j]
            k, h = after[i], before[i]
            if k < len(parts):
                before[k] = i
                if rank(i, k) != NONE:
                    heapq.heappush(heap, (rank(i, k), i, k))
            if h >= 0 and rank(h, i) != NONE:
                heapq.heappush(heap, (rank(h, i), h, i))
        return [self.ranks[p] for p in parts if p is not None]

    def replay(self, pieces: list[bytes]):
        """(ids, starts): the ids of pieces[i] are ids[starts[i] : starts[i + 1]]."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes)
        n = int(ends[-1]) if len(ends) else 0
        sym = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        word = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[ends[sizes > 0] - 1] = -1
        before[(ends - sizes)[sizes > 0]] = -1
        rank = np.full(n, NONE, np.int32)
        has = np.flatnonzero(after >= 0)
        rank[has] = self.lookup(sym[has], sym[has + 1])
        odd: set[int] = set()
        index: dict[int, list] = {}
        waiting: list[int] = []

        def file(at):
            """Puts places into the index by the rank of their pair."""
            at = at[rank[at] != NONE]
            if not len(at):
                return
            r = rank[at]
            if len(at) > 1:
                order = np.argsort(r, kind="stable")
                at, r = at[order], r[order]
                cut = np.flatnonzero(r[1:] != r[:-1]) + 1
                firsts, groups = r[np.concatenate(([0], cut))].tolist(), np.split(at, cut)
            else:
                firsts, groups = r.tolist(), [at]
            for k, g in zip(firsts, groups, strict=True):
                if k in index:
                    index[k].append(g)
                else:
                    index[k] = [g]
                    heapq.heappush(waiting, k)

        file(has)
        while waiting:
            r = heapq.heappop(waiting)
            lists = index.pop(r)
            at = np.concatenate(lists) if len(lists) > 1 else lists[0]
            at = at[rank[at] == r]
            if not len(at):
                continue
            if len(at) > 1:
                at.sort()
                clash = after[at[:-1]] == at[1:]
                if clash.any():  # in a run of overlapping pairs, every second one from its left end
                    i = np.arange(len(at))
                    start = np.maximum.accumulate(np.where(np.concatenate(([True], ~clash)), i, 0))
                    at = at[(i - start) % 2 == 0]
            gone = after[at]
            beyond = after[gone]
            sym[at] = r
            sym[gone] = -1
            rank[gone] = NONE
            after[at] = beyond
            tied = beyond >= 0
            before[beyond[tied]] = at[tied]
            left = before[at]
            left = left[left >= 0]
            # a left neighbour may itself have just merged, so the pairs are looked up once all links stand
            touched = np.concatenate((left, at))
            if len(touched) > 1:
                touched = np.unique(touched)
            right = after[touched]
            ends_here = right < 0
            rank[touched[ends_here]] = NONE
            touched, right = touched[~ends_here], right[~ends_here]
            if len(touched):
                new = self.lookup(sym[touched], sym[right])
                if (new < r).any():
                    odd.update(word[touched[new < r]].tolist())
                rank[touched] = new
                file(touched)
        left = sym >= 0
        ids, counts = sym[left], np.bincount(word[left], minlength=len(pieces))
        if odd:
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for i in odd:
                parts[i] = np.array(self.one(pieces[i]), np.int32)
            counts = np.fromiter(map(len, parts), np.int64, len(parts))
            ids = np.concatenate(parts)
        return ids, np.concatenate(([0], np.cumsum(counts)))


class Pieces(dict):
    """Numbers the pieces of a chunk in order of appearance."""

    def __missing__(self, piece):
        n = self[piece] = len(self)
        return n


def gather(flat, starts, which):
    """flat[starts[w] : starts[w + 1]] for every w of which, one after the other, and the length of each."""
    sizes = (starts[1:] - starts[:-1])[which]
    ends = np.cumsum(sizes)
    n = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(n, len(flat)) < 2**31 else np.int64  # half the memory to go through
    at = np.repeat((starts[:-1][which] - (ends - sizes)).astype(kind), sizes)
    at += np.arange(n, dtype=kind)
    return flat.take(at), sizes


def encode_texts(texts, merges, pattern):
    """Arrays of ids, one for each text, in their order."""
    pieces = Pieces()
    number = pieces.__getitem__
    docs = [np.array(list(map(number, pattern.findall(t))), np.int32) if t else np.empty(0, np.int32) for t in texts]
    if not pieces:
        return [np.empty(0, np.uint32)] * len(docs)
    flat, starts = merges.replay([p.encode("utf-8", "surrogatepass") for p in pieces])
    flat = flat.astype(np.uint32)
    out, i = [], 0
    while i < len(docs):  # some documents at a time: their places take more room than their ids
        j, n = i, 0
        while j < len(docs) and (j == i or n + len(docs[j]) < 1_000_000):
            n += len(docs[j])
            j += 1
        ids, sizes = gather(flat, starts, np.concatenate(docs[i:j]))
        ends = np.cumsum([0, *map(len, docs[i:j])])
        cum = np.concatenate(([0], np.cumsum(sizes)))
        out += [ids[cum[a] : cum[b]].copy() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        i = j
    return out


def decode_ids(ids, tokens) -> bytes:
    return b"".join(map(tokens.__getitem__, ids.tolist()))


#: Columns that encode() can add, and their types.
OUTPUTS = {"ids": T.BinaryType(), "n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded": T.BinaryType(), "decoded_sha256": T.StringType()}


def encode(docs: DataFrame, outputs=("ids", "n_tokens"), text: str = "text", ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN, keep=None, chunk: int = CHUNK) -> DataFrame:
    """docs (its columns in keep, all by default) with the outputs: ids as little-endian unsigned 32-bit integers, their number and digest, and what they decode to."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in outputs]
    source = docs.select(*keep, docs[text].alias("_text"))
    schema = T.StructType([*docs.select(*keep).schema.fields, *[T.StructField(o, OUTPUTS[o]) for o in outputs]])

    def run(batches):
        import pyarrow as pa
        import regex

        merges, cut = Merges(ranks), regex.compile(pattern)
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)

        def flush(held):
            texts = [t for b in held for t in b.column(len(keep)).to_pylist()]
            ids = encode_texts(texts, merges, cut)
            cols = {}
            if "n_tokens" in outputs:
                cols["n_tokens"] = [len(x) for x in ids]
            if "ids" in outputs:
                cols["ids"] = [x.tobytes() for x in ids]
            if "ids_sha256" in outputs:
                cols["ids_sha256"] = [hashlib.sha256(x.tobytes()).hexdigest() for x in ids]
            if "decoded" in outputs:
                cols["decoded"] = [decode_ids(x, merges.tokens) for x in ids]
            if "decoded_sha256" in outputs:
                cols["decoded_sha256"] = [hashlib.sha256(decode_ids(x, merges.tokens)).hexdigest() for x in ids]
            done = 0
            for b in held:
                new = [pa.array(cols[o][done : done + b.num_rows], arrow.field(o).type) for o in outputs]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *new], schema=arrow)
                done += b.num_rows

        held, size = [], 0
        for batch in batches:
            step = max(1, int(batch.num_rows * chunk // max(1, batch.nbytes)))
            for i in range(0, batch.num_rows, step):  # a batch of many long texts is cut
                part = batch.slice(i, step)
                held.append(part)
                size += part.nbytes
                if size >= chunk:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return source.mapInArrow(tidy(run), schema)


def decode(df: DataFrame, ids: str = "ids", ranks: str = RANKS) -> DataFrame:
    """df with decoded: the bytes that ids stand for; null ids give null."""
    keep = [c for c in df.columns if c != "decoded"]
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches):
        import pyarrow as pa

        tokens = Merges(ranks).tokens
        for b in batches:
            at = b.schema.get_field_index(ids)
            new = [None if x is None else decode_ids(np.frombuffer(x, np.uint32), tokens) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(new, pa.binary())], names=[*b.schema.names, "decoded"])

    return df.select(*keep).mapInArrow(tidy(run), schema)


def op6_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, ("n_tokens", "ids_sha256", "decoded_sha256"), keep=["doc_id"])


QUERIES = {"op6_bpe": op6_bpe}
ORACLES = {}

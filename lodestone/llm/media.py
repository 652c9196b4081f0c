"""Media columns: content-addressed payloads in tar shards.

A payload is stored as a grey picture of 192 columns, one sample a byte, in a PNG file: lossless, and its first 33 bytes
hold all metadata. Files are members of tar shards under the digest of their bytes; a payload is stored once a shard at
most. Rows carry digest, shard, offset and length. Where several shards hold a payload, all rows refer to the first.

Metadata columns are filled by range reads of the header alone; features come from a full read of each stored payload, once
for each different payload, and reach the rows in a join of narrow columns.

Edge cases: null and empty texts are 192 spaces; whole texts of any length; equal texts have equal values; an empty table has
no shards; other columns are left out of the stored form and pass through media_columns(), but for those of its own names."""

import hashlib
import io
import tarfile
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import opened, pieces_of, settled, shared_dir, table, tidy, write_file

WIDTH = 192
SHARD = 32_000_000
#: Stored bytes that a task reads.
READ_BYTES = 16_000_000
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER = 33


def chunk(kind: bytes, data: bytes) -> bytes:
    return len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")


def png(payload: bytes) -> bytes:
    """An 8-bit grey PNG of WIDTH columns; len(payload) is a positive multiple of WIDTH."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line begins with its filter, 0 for none
    lines[:, 1:] = rows
    head = WIDTH.to_bytes(4, "big") + len(rows).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def header(data: bytes) -> dict:
    """Metadata from the first HEADER bytes of a PNG."""
    if data[:8] != SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return {"width": int.from_bytes(data[16:20], "big"), "height": int.from_bytes(data[20:24], "big"), "bits": data[24]}


def samples(data: bytes) -> bytes:
    """The payload in a PNG written by png()."""
    at, parts, meta = 8, [], header(data)
    while at < len(data):
        n, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        if kind == b"IDAT":
            parts.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(meta["height"], meta["width"] + 1)
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean and deviation of the samples, and the average hash of the picture: 64 cells, a bit for each above their mean."""
    x = np.frombuffer(payload, np.uint8)
    sums = np.add.reduceat(np.cumsum(np.concatenate((np.zeros(1, np.int64), x)))[[i * len(x) // 64 for i in range(65)]], np.arange(65))
    cells = np.diff(sums) / (len(x) / 64)
    bits = np.packbits(cells > cells.mean()).tobytes().hex()
    return f"mean={x.mean():.3f};std={x.std():.3f};ahash={bits}"


def payload_of(text: str = "text"):
    """The text in UTF-8, with spaces up to a positive multiple of WIDTH."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.octet_length(t)
    return F.encode(F.concat(t, F.repeat(F.lit(" "), F.when(n == 0, F.lit(WIDTH)).otherwise((WIDTH - n % WIDTH) % WIDTH).cast("int"))), "UTF-8")


def store(docs: DataFrame, text: str = "text", folder: str | None = None, shard_bytes: int = SHARD) -> DataFrame:
    """Writes the payloads into tar shards below folder. Returns one row per different payload: key (SHA-256 of the payload), digest (of the stored file), shard, offset, length."""
    folder = folder or shared_dir(docs.sparkSession)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, seq, seen, tar, rows = TaskContext.get().partitionId(), 0, set(), io.BytesIO(), []

        def flush():
            uri = f"{folder}/media-{task:06d}-{seq:04d}.tar"
            tar.write(bytes(1024))
            write_file(uri, tar.getvalue())
            return pa.RecordBatch.from_pydict({"key": [r[0] for r in rows], "digest": [r[1] for r in rows], "shard": [uri] * len(rows), "offset": pa.array([r[2] for r in rows], pa.int64()), "length": pa.array([r[3] for r in rows], pa.int64())})

        for part in pieces_of(batches, 8_000_000):
            for payload in part.column(0).to_pylist():
                key = hashlib.sha256(payload).digest()
                if key in seen:
                    continue
                seen.add(key)
                data = png(payload)
                name = hashlib.sha256(data).hexdigest()
                info = tarfile.TarInfo(f"{name}.png")
                info.size = len(data)
                tar.write(info.tobuf(tarfile.USTAR_FORMAT))
                rows.append((key.hex(), name, tar.tell(), len(data)))
                tar.write(data)
                tar.write(bytes(-len(data) % 512))
                if tar.tell() >= shard_bytes:
                    yield flush()
                    tar, rows, seq, seen = io.BytesIO(), [], seq + 1, set()
        if rows:
            yield flush()

    stored = settled(docs.select(payload_of(text).alias("payload")).mapInArrow(tidy(run), "key string, digest string, shard string, offset long, length long"))
    first = F.min(F.struct("shard", "offset", "length", "digest")).alias("at")
    return settled(stored.groupBy("key").agg(first).select("key", "at.digest", "at.shard", "at.offset", "at.length"))


def probe(manifest: DataFrame, full: bool = True) -> DataFrame:
    """manifest with metadata columns width, height and bits from header-only range reads; with full, also what the whole payload gives: payload_bytes, payload_sha256, tail_crc32, media_sha256 and feature."""
    more = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_sha256 string, feature string" if full else ""
    schema = "key string, digest string, shard string, offset long, length long, width int, height int, bits int" + (", " + more if full else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        import pyarrow as pa

        held, file = None, None
        for b in batches:
            out = {n: [] for n in names[5:]}
            for uri, offset, length in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                if uri != held:
                    fs, path = opened(uri)
                    held, file = uri, fs.open_input_file(path)
                for k, v in header(file.read_at(HEADER, offset)).items():
                    out[k].append(v)
                if full:
                    data = file.read_at(length, offset)
                    payload = samples(data)
                    for k, v in (("payload_bytes", len(payload)), ("payload_sha256", hashlib.sha256(payload).hexdigest()), ("tail_crc32", zlib.crc32(payload[-16:])), ("media_sha256", hashlib.sha256(data).hexdigest()), ("feature", feature(payload))):
                        out[k].append(v)
            kinds = {"width": pa.int32(), "height": pa.int32(), "bits": pa.int32(), "payload_bytes": pa.int64(), "tail_crc32": pa.int64()}
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(v, kinds.get(k, pa.string())) for k, v in out.items()]], names=names)

    # a shard's members are spread over tasks by runs of its bytes, and read in their order
    # the number of tasks follows the stored bytes, as the rows that are shuffled are small beside what they point to
    stored = manifest.agg(F.sum("length")).first()[0] or 0
    spread = manifest.withColumn("_run", F.floor(F.col("offset") / 4_000_000)).repartition(max(1, min(1_000_000, -(-stored // READ_BYTES))), "shard", "_run").sortWithinPartitions("shard", "offset").drop("_run")
    return spread.mapInArrow(tidy(run), schema)


def media_columns(docs: DataFrame, manifest: DataFrame, text: str = "text", full: bool = True) -> DataFrame:
    """docs with n_bytes, digest, shard, offset, length (of the stored file, also media_bytes) and the columns of probe()."""
    probed = probe(manifest, full).withColumn("media_bytes", F.col("length"))
    keyed = docs.withColumns({"n_bytes": F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long"), "_key": F.sha2(payload_of(text), 256)}).drop(*[c for c in probed.columns if c in docs.columns])
    return keyed.join(probed.withColumnRenamed("key", "_key"), "_key").drop("_key")


def op3_media(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return media_columns(docs, store(docs)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "digest", "shard", "offset", "length", "width", "height", "bits")


QUERIES = {"op3_media": op3_media}
ORACLES = {}

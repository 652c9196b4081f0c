"""WARC archives, each record compressed on its own against a dictionary that the archive carries.

An archive is a file of Zstandard frames: a leading skippable frame (magic 0x184D2A5D) that holds a dictionary built from
the archive's own records, then one frame for each record. Too few records for a dictionary leave that frame empty.

Which records are full follows from the payloads: of equal payloads of LEAST bytes or more the one with the largest page_id
is the response and the others are revisits that refer to it. The largest ids come from a grouped maximum (combined before
the shuffle) over digests that occur twice or more; they reach the pages in a join of narrow rows, so a payload with very
many copies moves no text to one task.

Edge cases: null html is an empty payload and null url an empty one; whole payloads of any length; of repeated rows (same id
and payload) one is the response and the rest revisit it; a null page_id counts as smaller than all others; an empty table
has no archive; other columns are left out."""

import hashlib
import io
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import gathered, opened, settled, shared_dir, table, tasks_for, tidy, write_file

LEAST = 1000
MAGIC = 0x184D2A5D
ARCHIVE = 16_000_000
TASK_BYTES = 8_000_000
#: A dictionary's size, and the bytes of records that it is built from, spread over the archive.
DICTIONARY, SAMPLED = 64_000, 4_000_000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def roles(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(_pid, _digest, _last) of the pages whose payload of at least `least` bytes occurs more than once."""
    ids = pages.select("page_id", "_pid", "_digest").where(F.octet_length(F.coalesce("html", F.lit(""))) >= least)
    twice = ids.groupBy("_digest").agg(F.max("page_id").alias("_last"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return ids.select("_pid", "_digest").distinct().join(twice, "_digest")


def name_of(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id, url: str, payload: bytes, refers_to) -> bytes:
    """A WARC record; with refers_to, a revisit that has the HTTP head only."""
    digest = hashlib.sha1(payload).hexdigest()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name_of(page_id)}", f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"X-Page-Id: {'' if page_id is None else page_id}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name_of(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """The records as one archive."""
    import zstandard as z

    total, every = sum(map(len, records)), 1
    while total / every > SAMPLED:
        every += 1
    raw = b""
    try:
        raw = z.train_dictionary(min(DICTIONARY, total // 16), records[::every]).as_bytes()
    except (z.ZstdError, ValueError):
        pass  # too little to learn from
    out = io.BytesIO()
    out.write(MAGIC.to_bytes(4, "little") + len(raw).to_bytes(4, "little") + raw)
    c = z.ZstdCompressor(level=6, dict_data=z.ZstdCompressionDict(raw) if raw else None)
    for r in records:
        out.write(c.compress(r))
    return out.getvalue()


def records_in(data: bytes):
    """The records of an archive, one after the other."""
    import zstandard as z

    if int.from_bytes(data[:4], "little") != MAGIC:
        raise ValueError("no leading dictionary frame")
    n = int.from_bytes(data[4:8], "little")
    d = z.ZstdDecompressor(dict_data=z.ZstdCompressionDict(data[8 : 8 + n]) if n else None)
    at, view = 8 + n, memoryview(data)
    while at < len(data):
        frame, parts = d.decompressobj(), []
        while not frame.eof:
            fed = view[at : at + 65536]
            if not len(fed):
                raise ValueError("cut short")
            parts.append(frame.decompress(fed))
            at += len(fed) - len(frame.unused_data)
        yield b"".join(parts)


def parsed(data: bytes) -> dict:
    """Header fields of a record in lower case, with type, http (its fields) and payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in head.decode().split("\r\n")[1:])}
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    fields["http"] = {k.lower(): v for k, _, v in (x.partition(": ") for x in http.decode().split("\r\n")[1:])}
    return fields | {"type": fields["warc-type"], "payload": payload}


def write_warc(pages: DataFrame, folder: str | None = None, least: int = LEAST, archive_bytes: int = ARCHIVE) -> DataFrame:
    """Writes the archives below folder. Returns the manifest: path, n_records."""
    folder = folder or shared_dir(pages.sparkSession)
    # _pid: as null ids meet in no join, the least number stands for them
    rows = pages.select("page_id", "url", "html").withColumn("_pid", F.coalesce("page_id", F.lit(-(2**63)))).withColumn("_digest", F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8")))
    n = tasks_for(rows, TASK_BYTES)
    # dealt by the join's keys, so the join needs no second exchange and equal rows meet in one task
    rows = rows.repartition(n, "_pid", "_digest").join(roles(rows, least), ["_pid", "_digest"], "left").select("page_id", "url", "html", "_last")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, met = TaskContext.get().partitionId(), set()  # met: responses to which later equal rows of this task refer
        for seq, held in enumerate(gathered(batches, archive_bytes)):
            records = []
            for b in held:
                for page_id, url, html, last in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                    payload = (html or "").encode("utf-8", "surrogatepass")
                    refers = None
                    if last is not None and (page_id != last or (key := (page_id, hashlib.sha1(payload).digest())) in met):
                        refers = last
                    elif last is not None:
                        met.add(key)
                    records.append(record(page_id, url, payload, refers))
            uri = f"{folder}/pages-{task:06d}-{seq:04d}.warc.zst"
            write_file(uri, archive(records))
            yield pa.RecordBatch.from_pydict({"path": [uri], "n_records": pa.array([len(records)], pa.int64())})

    return settled(rows.mapInArrow(tidy(run), "path string, n_records long"))


def read_warc(manifest: DataFrame, html: bool = True) -> DataFrame:
    """One row per stored record: page_id, payload_bytes, payload_digest, record_type, refers_to, url and (with html) html, which revisits lack."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + (", html string" if html else "")
    n = max(1, manifest.count())

    def run(batches):
        import pyarrow as pa

        number = lambda x: int(x) if x else None
        for b in batches:
            for uri in b.column(0).to_pylist():
                fs, path = opened(uri)
                with fs.open_input_stream(path, compression=None) as f:
                    data = f.read()
                out = {k: [] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url") + (("html",) if html else ())}
                for r in map(parsed, records_in(data)):
                    full = r["type"] == "response"
                    found = hashlib.sha1(r["payload"]).hexdigest() if full else r["warc-payload-digest"].removeprefix("sha1:")
                    for k, v in (("page_id", number(r["x-page-id"])), ("payload_bytes", len(r["payload"]) if full else int(r["http"]["content-length"])), ("payload_digest", found), ("record_type", r["type"]), ("refers_to", number(r.get("x-refers-to-page"))), ("url", r["warc-target-uri"]), *([("html", r["payload"].decode("utf-8", "replace") if full else None)] if html else [])):
                        out[k].append(v)
                kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64()}
                yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.string())) for k, v in out.items()})

    return manifest.select("path").repartition(min(n, 100_000)).mapInArrow(tidy(run), schema)


def op5_warc(spark, sf_dir):
    return read_warc(write_warc(table(spark, sf_dir, "pages")), html=False).drop("url")


QUERIES = {"op5_warc": op5_warc}
ORACLES = {
    "op5_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to
FROM p LEFT JOIN m ON p.d = m.d
"""
}

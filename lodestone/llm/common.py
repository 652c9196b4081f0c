"""What the operators share: word pattern, table access, shared folder, files in it."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space and the five ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"


def lean(spark: SparkSession) -> None:
    """Batches for Python of 1,000 rows instead of Spark's default of 10,000: texts are long, and a batch is held several times over. A value that the session has set itself stays."""
    for name, usual, lean_ in (("maxRecordsPerBatch", "10000", "1000"), ("maxBytesPerBatch", "67108864b", "16777216b")):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}") == usual:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", lean_)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value, body):
    """body(value) with value computed once a row: a lambda's variable is bound, not copied into its uses."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text):
    """Array of the words of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def shared_dir(spark: SparkSession) -> str:
    """URI of a new folder below spark.checkpoint.dir, which driver and executors share.

    Where that setting is missing (tests, a single machine), a folder beside the warehouse is set for the session."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = sc._jsc.sc().getCheckpointDir()
        if found.isEmpty():
            sc.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-shared")
            found = sc._jsc.sc().getCheckpointDir()
        root = found.get()
    if "://" not in root and not root.startswith("file:"):
        root = f"file://{root}"
    if root.startswith("file:/") and not root.startswith("file://"):
        root = "file://" + root[len("file:") :]
    return f"{root.rstrip('/')}/lodestone-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there, and a lost executor costs nothing of it."""
    spark = df.sparkSession
    lean(spark)
    at = f"{shared_dir(spark)}/table"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def opened(uri: str):
    """(file system, path) for a folder or file that every executor reaches."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def tidy(run):
    """run, a function of an iterator that yields, with the memory it leaves free given back at its end: a worker serves many stages, and what each has held at most adds up."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
            if trim:
                trim(0)

    return tidied


def one_thread() -> None:
    """Matrix products of this process on one thread, where numpy comes with OpenBLAS: the tasks share the cores already, and on small products further threads only wait for each other."""
    import ctypes
    import glob
    import os

    import numpy as np

    for path in glob.glob(os.path.join(os.path.dirname(np.__file__), os.pardir, "numpy.libs", "*openblas*")):
        lib = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(lib, name):
                getattr(lib, name)(1)
                break


def spread_join(left: DataFrame, right: DataFrame, keys: list, by: list, how: str = "inner", counts: DataFrame | None = None, parts: int = 256) -> DataFrame:
    """left.join(right, keys, how) in which no key of left lies in one task: a key that comes in 1/parts of left's rows or more (there are at most `parts` such keys) is dealt by the columns `by` over as many tasks as its share asks, and its rows of right go to all of these.

    counts (keys, n) are the rows of left by key, if they are known; otherwise left is read once more for them, so it should be stored."""
    counts = settled(left.groupBy(*keys).agg(F.count("*").alias("n"))) if counts is None else counts
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") * parts >= total).select(*keys, F.ceil(F.col("n") * parts / max(1, total)).cast("int").alias("_parts")) if total >= 8 * parts else None
    rows = hot.collect() if hot is not None else []  # at most `parts` rows
    if not rows:
        return left.join(right, keys, how)
    hot = F.broadcast(left.sparkSession.createDataFrame(rows, hot.schema))
    dealt = left.join(hot, keys, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*by), F.col("_parts")), F.lit(0)).cast("int")).drop("_parts")
    copied = right.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(copied, [*keys, "_part"], how).drop("_part")


class NewFile:
    """A file that appears under its name when it is whole and not empty: written under another name and renamed, so that a second attempt of a task can't spoil it."""

    def __init__(self, uri: str):
        self.fs, self.path = opened(uri)
        self.part, self.size = f"{self.path}.{uuid.uuid4().hex}", 0

    def __enter__(self):
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.out = self.fs.open_output_stream(self.part, compression=None)
        return self

    def write(self, data: bytes) -> int:
        """Where data begins."""
        at = self.size
        self.out.write(data)
        self.size += len(data)
        return at

    def __exit__(self, failed, *_):
        self.out.close()
        if failed or not self.size:
            self.fs.delete_file(self.part)
        else:
            self.fs.move(self.part, self.path)


def write_file(uri: str, data: bytes) -> None:
    with NewFile(uri) as f:
        f.write(data)


def stored_bytes(df: DataFrame) -> int | None:
    """Bytes of the files that df comes from; None if a part of it comes from elsewhere, whose size the optimizer doesn't know."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return sum(sizes) if max(sizes, default=0) < 2**60 else None


def tasks_for(df: DataFrame, each: int) -> int:
    """Number of tasks that get about `each` stored bytes; the session's number of shuffle partitions if the size isn't known."""
    size = stored_bytes(df)
    if size is None:
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(1_000_000, -(-size // each)))


def pieces_of(batches, most: int):
    """Record batches of at most about `most` bytes, unless a single row is larger."""
    for batch in batches:
        step = max(1, int(batch.num_rows * most // max(1, batch.nbytes)))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def gathered(batches, most: int):
    """Lists of record batches that hold about `most` bytes together."""
    held, size = [], 0
    for part in pieces_of(batches, most):
        held.append(part)
        size += part.nbytes
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held

"""Schemas of the model's tables, cutting lineage, and arrays in the shared folder.

files: one row per source file; symbols: one per declared name of a file; edges: a multigraph, one row per imported name."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FILES = "id long, path string, hash string, rank double, updated_at long, mtime long, summary string, when_to_use string, enriched_at long"
SYMBOLS = "file_id long, name string, kind string, is_exported boolean, line int, ref_count long"
EDGES = "source_id long, target_id long, edge_type string, specifier string"
RUNS = "id long, git_commit string, git_dirty boolean, timestamp string, layer string, dataset string, language string, metrics string, config string"
CASES = "repo string, repo_url string, language string, index_db string, cases array<struct<id:string,query:string,expected_files:array<struct<path:string,relevance:int>>>>"


def with_missing(df: DataFrame, schema: str) -> DataFrame:
    """df in the order of schema, columns that an older table lacks as nulls."""
    from pyspark.sql import functions as F

    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schema)])


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the folder of spark.checkpoint.dir; only where none is set, one beside the warehouse."""
    spark: SparkSession = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-shared")
    return df.checkpoint()


def shared_dir(spark: SparkSession) -> str:
    """URI of a new folder in the shared folder of `cut`."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-shared")
    root = spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().get()
    if "://" not in root:
        root = "file://" + root.removeprefix("file:")
    return f"{root.rstrip('/')}/lodestone-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder as a table of columns and read again; it takes less room there than a checkpoint."""
    at = f"{shared_dir(df.sparkSession)}/table"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def opened(uri: str):
    """(file system, path) for a folder or file that every executor reaches."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_array(uri: str, values) -> None:
    """A numpy array's bytes under a name of their own first, then renamed: a second attempt of a task leaves whole files only."""
    at, path = opened(uri)
    at.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with at.open_output_stream(part, compression=None) as out:
        out.write(memoryview(values).cast("B") if values.size and values.flags.c_contiguous else values.tobytes())
    at.move(part, path)


def read_array(uri: str, kind: str, first: int = 0, count: int | None = None):
    """The array at uri, or `count` values of it from `first`."""
    import numpy as np

    at, path = opened(uri)
    size = np.dtype(kind).itemsize
    with at.open_input_file(path) as f:
        if first:
            f.seek(first * size)
        return np.frombuffer(f.read(None if count is None else count * size), kind)

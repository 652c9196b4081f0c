"""Bounded samples of labelled documents, for fitting classifiers."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, unless=None) -> DataFrame:
    """(doc_id, text, label) of at most `bound` labelled ids, those of the least hash of the id; unless: ids to leave out.

    An id with several labels has the least of them; null ids and labels are left out. The sampled ids are sent to every
    executor, at most `bound` pairs of a number each."""
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    if unless is not None:
        ids = ids.where(~unless)
    ids = ids.groupBy("doc_id").agg(F.min(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")


def scored(docs: DataFrame, schema: str, score, text: str = "text", keep=None) -> DataFrame:
    """docs (its columns in keep, all by default) with the columns of schema, which score(list of texts) gives as a dict of lists. Columns of docs with the same names are replaced."""
    from pyspark.sql import types as T

    from lodestone.llm.common import pieces_of, tidy

    new = T.StructType.fromDDL(schema)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new.names]
    kept = docs.select(*keep).schema.fields
    full = T.StructType([*kept, *new.fields])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(full)
        for b in pieces_of(batches, 8_000_000):
            out = score(b.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *[pa.array(out[f.name], arrow.field(f.name).type) for f in new.fields]], schema=arrow)

    return docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text")).mapInArrow(tidy(run), full)

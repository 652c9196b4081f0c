"""Corpus pipeline: toxic and poor documents go, one document of each near-duplicate class stays, sources are mixed to their
target weights, and what is left is encoded.

Every stage takes (spark, docs, sf_dir) and works on all of docs; the first four return the columns of documents (the mix may
repeat a document, up to three times), the last one row per mixed document with its ids.

Edge cases, by stage:
- All: an empty table gives an empty result; whole texts of any length; columns beside doc_id, text and source pass through as
  they are, whatever their names; a stage adds none of its own but the last.
- toxicity, quality classifier: null and empty texts are classified like any other (no words speak for toxicity, so the first
  keeps them; the second judges a text of no characters); equal texts have equal fates; null ids are never learnt from; with
  labels of one kind or none, toxicity rejects nothing, and the classifier rejects nothing unless all labels are 0, and then all.
- near duplicates: null and empty texts are equal to each other; of a class the row with the least id stays (a null id only if
  all are null); of repeated rows one stays.
- mixing: rows without words are never taken; null is a source of its own; repeated rows are taken together.
- byte-level BPE: null and empty texts have no ids; each row of the mix has its row. Columns named as the added ones are replaced."""

from pyspark.sql import functions as F

from lodestone.llm import bpe, mixing, near_dedup, quality_ranking, toxicity
from lodestone.llm.common import settled, table

USED = ("doc_id", "text", "source")


def packed(docs):
    """docs with the columns that no operator uses in one, so that none of their names clashes with an operator's."""
    return docs.select(*USED, F.struct(F.lit(0).alias("_"), *[F.col(c) for c in docs.columns if c not in USED]).alias("_rest"))


def unpacked(found, docs):
    return found.select(*[F.col(c) if c in USED else F.col("_rest").getField(c).alias(c) for c in docs.columns])


def drop_toxic(spark, docs, sf_dir):
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return unpacked(toxicity.grade(packed(docs), model).where("not toxic"), docs)


def drop_poor(spark, docs, sf_dir):
    model = quality_ranking.fit(docs, table(spark, sf_dir, "labels"))
    return unpacked(quality_ranking.rank(packed(docs), model).where("predicted = 1"), docs)


def drop_near_copies(spark, docs, sf_dir):
    return near_dedup.dedup(docs).select(*docs.columns)


def mix_sources(spark, docs, sf_dir):
    return unpacked(mixing.mix(packed(docs)), docs)


def encode_texts(spark, docs, sf_dir):
    return bpe.encode(docs, ("n_tokens", "ids", "ids_sha256", "decoded_sha256"), keep=[c for c in docs.columns if c != "text"])


STAGES = [("toxicity", drop_toxic), ("quality classifier", drop_poor), ("near duplicates", drop_near_copies), ("mixing", mix_sources), ("byte-level BPE", encode_texts)]

#: The stages learn from labels and compare sketches, which SQL can't express; tests/llm compare each with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = settled(docs)  # each stage reads what its predecessor has written
    return docs

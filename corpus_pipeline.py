"""A corpus pipeline: toxic documents and copies go, sources are mixed, and the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import bounded, table, without_ids, word_count, written
from barloom.llm.exact_dedup import drop_exact_copies
from barloom.llm.minhash_dedup import minhash_dedup
from barloom.llm.packing import pack_documents
from barloom.llm.queries import tokenizer_file
from barloom.llm.source_mix import mix_sources
from barloom.llm.toxicity import drop_toxic


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that score as toxic.

    Null and empty texts score 0 and stay; very long ones are scored window by window, whole. Null ids are not learned
    from; repeated rows are judged alike. Without labels of both kinds all stay. An empty table gives no rows. All columns are kept.
    """
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document of the smallest id stays.

    Null and empty texts are equal, and one of them stays. Of rows with the same id and text one stays; null ids come
    last. Texts of any length are compared in full. An empty table gives no rows. All columns are kept.
    """
    return drop_exact_copies(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, similarity 0.8), the document of the smallest id stays.

    Null and empty texts, and rows with a null id, stay. Rows that share an id are one document: they go or stay
    together. An empty table gives no rows. All columns are kept.
    """
    return without_ids(docs, minhash_dedup(docs).where(~F.col("kept")).select("doc_id"), "doc_id")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it.

    Texts without words, null and empty ones too, have no size and are not taken. Rows that share an id (null is one)
    are taken alike. A null source is a source. An empty table gives no rows. All columns are kept, whatever they are called.
    """
    copies = mix_sources(docs, word_count(F.col("text"))).groupBy(F.col("doc_id").alias("mix_id"))
    copies = written(copies.agg(F.max("copies").alias("mix_copies")), "copies")
    # the document's columns stand in one, so that none can clash with the mix's
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    joined = rows.join(bounded(copies), F.col("doc.doc_id").eqNullSafe(F.col("mix_id"))).where("mix_copies > 0")
    taken = joined.select("doc", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))).alias("mix_copy"))
    return taken.select("doc.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents' pieces in windows of 2048 tokens.

    Null and empty texts are the end id alone; very long ones are cut. Null ids and sources are values like others, and
    repeated rows are packed each. Further columns are left out. An empty table gives no rows.
    """
    return pack_documents(docs, tokenizer_file(), added_tokens=True)


STAGES = [("toxicity", clean), ("exact_dedup", unique), ("near_dedup", distinct), ("mix", mixed), ("pack", packed)]

#: SQL can't express these stages; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each reading what the one before it wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

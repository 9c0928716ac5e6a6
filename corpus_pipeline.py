"""From raw documents to packed training sequences: five stages, each over all that its predecessor kept.

1. ``language``: documents in a language the models know; those they reject go.
2. ``near_duplicates``: of documents linked by five-word shingles (similarity 0.8) the one with the smallest doc_id.
3. ``decontamination``: documents that hold no benchmark item.
4. ``private_data``: personal data and identifiers masked in the texts.
5. ``packing``: sequences of at most 1024 tokens, as pieces of documents and where they lie.

``run`` applies the stages to the documents table. A stage's result is written to the shared folder and read again
as the next one's input. Null ids or texts, ties, repeated rows and empty tables are handled as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm import decontaminate, language, near, packing, pii
from tidegate.llm.queries import tokenizer
from tidegate.llm.sift import possibly
from tidegate.llm.store import importable, saved, table


def in_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labels of the input itself, and keeps what its models accept."""
    importable(spark)
    found = language.identified(docs, language.trained(docs), docs.columns)
    return found.filter("accepted").select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest doc_id; of repeated rows (doc_id and text), one.

    Different texts under one doc_id are different documents: each gets a number of its own here.
    """
    importable(spark)
    text = F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull())
    clashing = docs.groupBy("doc_id").agg(F.min(text).alias("lo"), F.max(text).alias("hi")).filter("lo <> hi")
    clashing = saved(clashing.select("doc_id", F.lit(True).alias("__clash")), "clashing")
    if clashing.isEmpty():  # an id is a number of its own
        keyed = docs.withColumn("__key", F.col("doc_id").cast("long"))
    else:
        key = F.when(F.col("__clash"), F.xxhash64(F.col("doc_id"), text)).otherwise(F.col("doc_id").cast("long"))
        keyed = saved(docs.join(clashing, "doc_id", "left").withColumn("__key", key), "numbered")
    found = near.linked(keyed.select(F.col("__key").alias("doc_id"), "text"), size=5, percent=80)
    found = found.select(F.col("doc_id").alias("__key"), "component_id").filter("__key is not null").distinct()
    first = F.min(F.struct("doc_id", "__key"))["__key"].alias("__key")
    keys = keyed.groupBy("__key", "doc_id").agg(F.count("*").alias("__rows"))
    keys = saved(keys.join(found, "__key"), "keys")
    kept = saved(keys.groupBy("component_id").agg(first).select("__key"), "kept")
    # rows that stay and have no other row of their key need no join; the others are shuffled with their texts
    doubtful = keys.join(kept.withColumn("__kept", F.lit(True)), "__key", "left").filter("__kept is null or __rows > 1")
    doubtful = possibly("__key", saved(doubtful.select("__key"), "doubtful"))
    given = keyed.filter("__key is not null")
    settled = given.filter(doubtful).join(kept, "__key", "left_semi").dropDuplicates(["__key"])
    alone = docs.filter("doc_id is null")
    return given.filter(~doubtful).select(*docs.columns).union(settled.select(*docs.columns)).union(alone)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def without_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks spans; ``n_chars`` follows the text where it told its length."""
    masked = pii.masked(docs)
    if "n_chars" in masked.columns:
        masked = masked.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return masked


def in_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return packing.packed(docs, tokenizer("byte_bpe_50k.json"), capacity=1024, end=2)


STAGES = [
    ("language", in_known_language),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("private_data", without_private_data),
    ("packing", in_sequences),
]

#: Tokenized sequences and trained models are not for SQL; the tests compare the near-duplicate and decontamination stages
#: with brute force, and check of the others that rows and texts are kept or changed as they should.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

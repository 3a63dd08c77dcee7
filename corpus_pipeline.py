"""A corpus from raw documents: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import decontamination, mixing, near_duplicates, queries, tokens, toxicity
from corvane.llm._scratch import Scratch

#: Near-duplicates here: five-word shingles with a Jaccard of 0.8 or more.
SIMILAR = 80


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose score is 0.3 or more; the weights come from labelled rows outside the held-out fold.

    All columns stay; null and empty texts are scored like others; without labels nothing is rejected.
    """
    weights = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.accepted(docs, weights)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group; rows without doc_id stay, equal rows become one.

    Only rows whose doc_id is null or repeats are compared as whole rows: no other text is shuffled for that.
    """
    found = near_duplicates.near_duplicates(docs, SIMILAR)
    odd = found.groupBy(F.col("doc_id").alias("_id")).agg(F.bool_or("kept").alias("_kept"), F.count("*").alias("_n")).where("_id is null or _n > 1 or not _kept")
    odd = Scratch(spark, "groups").table(odd)
    doc, same = docs["doc_id"].cast("long"), odd["_id"]
    alone = docs.where("doc_id is not null").join(odd, doc == same, "left_anti")
    again = odd.where("_kept and (_id is null or _n > 1)")
    again = docs.join(again, doc.eqNullSafe(again["_id"]), "left_semi")
    return alone.unionByName(again.dropDuplicates())


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of which a passage holds a benchmark item, question and answer; null and empty texts stay."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents, or leaves them out, so that each source's words come to what the mix takes of it."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 read back from the written segments."""
    return tokens.token_table(docs, queries.TOKENIZER)


STAGES = [
    ("toxicity", not_toxic),
    ("near_duplicates", one_of_each_group),
    ("decontamination", no_benchmark),
    ("mixing", to_target_weights),
    ("tokens", token_ids),
]

#: The learned weights, the shingle links and the token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again; an empty table gives an empty one."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for _, stage in STAGES:
        done = scratch.table(stage(spark, docs, sf_dir))
        scratch.drop(docs)
        docs = done
    return docs

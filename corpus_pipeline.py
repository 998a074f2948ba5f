"""From raw documents to packed training sequences, in five stages.

Each stage is a function of the session, the documents so far and the folder of the tables, and works on
all that the stage before kept. The first four return the columns of the documents; the last one returns
the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm.common import few, shared_path, tables
from evalloom.llm.exact_dedup import exact_dedup
from evalloom.llm.jaccard_join import jaccard_join
from evalloom.llm.mixing import mix, quality_domains
from evalloom.llm.packing import pack
from evalloom.llm.token_ids import public_vocabulary
from evalloom.llm.toxicity import keep_clean


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have, in any case of its letters."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows of these ids; rows with no id stay."""
    key = fresh(docs, "gone_id")
    gone = ids.select(F.col("doc_id").alias(key)).distinct()
    return docs.join(few(gone), docs["doc_id"] == F.col(key), "left_anti")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return keep_clean(docs, tables(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays."""
    return without(docs, exact_dedup(docs).filter("NOT kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by similar word shingles, one stays: five words, 0.8."""
    return without(docs, jaccard_join(docs, k=5, percent=80).filter("doc_id <> component_id"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Domains that are rarer than their target come more than once; no document goes.

    The classifier learns from the labelled documents among those that are left.
    """
    rates = mix(docs, quality_domains(docs, tables(spark, sf_dir, "labels")), power=0.8, floor=1.0, grow=True)
    key, copies, copy = (fresh(docs, c) for c in ("again_id", "again_copies", "again_copy"))
    again = rates.groupBy(F.col("doc_id").alias(key)).agg(F.max("copies").alias(copies)).filter(F.col(copies) > 1)
    joined = docs.join(again, docs["doc_id"] == F.col(key), "left")
    more = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.coalesce(copies, F.lit(1))).cast("int")))
    return joined.select(*[docs[c] for c in docs.columns], more.alias(copy)).drop(copy)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2,048 tokens."""
    return pack(docs, public_vocabulary())


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("n-gram jaccard join", near), ("mixing", mixing), ("packing", packing)]

#: Learned scores and tokenizers are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = shared_path(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs

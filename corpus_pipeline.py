"""A corpus pipeline of the llm operators.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame;
all but the last return the columns of documents. Decisions fall on rows: rows that share a doc_id, or have none,
are judged each by its own text. Without a labels or benchmark row nothing is learned or found, and all rows stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.decontamination import benchmark_hits
from folioforge.llm.jaccard import jaccard_components
from folioforge.llm.packing import pack_documents
from folioforge.llm.pii import mask_pii, train_pii
from folioforge.llm.queries import may_learn
from folioforge.llm.scratch import drop_spent_shuffles, materialise
from folioforge.llm.toxicity import add_toxicity, train_toxicity

#: The stages score, join and count; SQL cannot express training, the tagger or the packing.
ORACLE_SQL = None


def _free(docs: DataFrame, name: str) -> str:
    """A name that no column of docs has, in any case."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score is at least 0.3 go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = _free(docs, "toxicity")
    scored = add_toxicity(docs, train_toxicity(docs, labels.filter(may_learn(4))), score)
    return scored.filter(F.col(score) < 0.3).drop(score)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: that with the smallest doc_id, a null id last; of rows
    alike in doc_id and text, any one. Rows without words are in no group and stay.
    """
    key, name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("text")), _free(docs, "key")
    found = materialise(jaccard_components(docs.select(key.alias("doc_id"), "text")).filter("class is not null").select("doc_id", "component_id"), "components")
    drop_spent_shuffles(spark)
    rejected = found.filter("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    repeated = found.filter("doc_id = component_id").groupBy(F.col("doc_id").alias(name)).agg(F.count("*").alias("n")).filter("n > 1").select(name)
    left = docs.withColumn(name, key).join(rejected, name, "left_anti")
    once = left.join(repeated, name, "left_semi").dropDuplicates([name])
    return left.join(repeated, name, "left_anti").unionByName(once).drop(name)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of whose words at least a twentieth stand in benchmark windows go."""
    found = benchmark_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), record=True)
    return found.filter("n_hit = 0 or n_hit * 20 < n_words").select("record.*")


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; n_chars follows the new text."""
    masked = mask_pii(docs, train_pii(docs))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents left, packed into sequences of 2048."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii", pii),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialise(docs, name)
    return docs

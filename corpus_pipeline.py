"""From raw documents to packed training sequences, in five stages that each call one operator of the ``llm`` subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.llm.common import ready, written
from riskloom.llm.mixing import mixed
from riskloom.llm.neardup import one_of_each
from riskloom.llm.packing import pack
from riskloom.llm.pii import pseudonymised
from riskloom.llm.toxicity import fit_field, in_training, toxicity, training_sample

#: Documents with this score or more are rejected.
TOXIC = 0.5

#: The key of the pseudonyms; a deployment passes a secret one to ``pseudonymised``.
KEY = "example key"


#: Documents whose sets of five-word shingles have this similarity or more, in percent, are near duplicates here. (Query ``op10`` has its own.)
NEAR = 80


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field, fitted on the labels' training rows, does not find toxic."""
    ready(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    field = fit_field(training_sample(docs, labels, in_training(F.col("label_id"))))
    return toxicity(docs, field).where(F.col("score") < TOXIC).select("doc.*")


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    ready(spark)
    return one_of_each(docs, percent=NEAR)


def with_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced; ``n_chars`` follows where a text changed."""
    ready(spark)
    changed = pseudonymised(docs, KEY)
    doc = F.col("doc").withField("text", F.col("new_text"))
    if "n_chars" in docs.columns:
        length = F.char_length("new_text").cast(docs.schema["n_chars"].dataType)
        doc = doc.withField("n_chars", F.when(F.col("n_replaced") > 0, length).otherwise(F.col("doc.n_chars")))
    return changed.select(doc.alias("doc")).select("doc.*")


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or thinned until sources come near their target weights."""
    ready(spark)
    return mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, placed in sequences."""
    import public_tokenizers

    ready(spark)
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("pii", with_pseudonyms),
    ("mixing", mixed_sources),
    ("packing", packed),
]

#: The field, the signatures and the tokeniser cannot be stated in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; every stage reads what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

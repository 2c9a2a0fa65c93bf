"""A corpus pipeline: each stage works on all rows its predecessor kept, written as Parquet in between.

All stages but the last return the columns of ``documents``, and any others, with their names. An empty
table gives an empty one. What a stage does with null and empty texts and repeated rows is said at each.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablevitals.llm.bpe_backtrack import encode_and_decode
from tablevitals.llm.chosen_path import one_of_each_class
from tablevitals.llm.common import documents, shared_folder
from tablevitals.llm.mixing import temperature_mix
from tablevitals.llm.pii_weak import redact
from tablevitals.llm.queries import MIX, tokenizer_path
from tablevitals.llm.toxicity import score_toxicity, train_toxicity


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the trees, learned from this input's labelled rows, don't call toxic.

    Null and empty texts are scored like any other and stay, as far as seen; repeated rows go or stay together.
    """
    model = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).filter("predicted = 0").select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each class of near copies.

    Rows with null texts all stay; of equal texts, empty ones too, and of repeated rows one stays.
    """
    return one_of_each_class(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data replaced by its kind; ``n_chars`` follows the text and is null for a null one.

    Null and empty texts stay as they are, repeated rows are rewritten alike.
    """
    return redact(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: every row at least once, rows of small sources again, in no case over twice.

    Null and empty texts count as one token, a null source is a source; repeated rows are drawn each on its own.
    """
    return temperature_mix(docs, **MIX).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of identifiers and decoded text of every row; null and empty texts have no tokens."""
    return encode_and_decode(docs.select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_copies),
    ("personal_data", without_personal_data),
    ("source_mixing", mixed_sources),
    ("bpe", tokens),
]

# Trees, joins of similar texts, learned spans and merges can't be said in SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage returns is written to the shared folder and read by the next."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

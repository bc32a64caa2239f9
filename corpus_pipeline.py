"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next.

Stages decide by row, not by ``doc_id`` (:mod:`strideline.llm.stages`). What a stage stores for itself is dropped when
the next one begins, so a stage's result has to be written, or read to its end, before that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideline.llm import packing, pii, quality_rules, stages
from strideline.operators.staging import staging_path
from strideline.session import configure, importable

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
CAPACITY = 2048


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose perplexity their language's threshold allows. Null and empty texts go; rows without an id, rows that
    share one and repeated rows are judged each by their text; columns besides those of documents are dropped."""
    stages.release()
    labels = importable(configure(spark)).read.parquet(f"{sf_dir}/labels.parquet")
    return stages.readable(docs, labels, COLUMNS)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the quality rules. Null and empty texts have no words and go; every row is judged by its own
    text, whatever its id; an empty table stays empty."""
    stages.release()
    configure(spark)
    return quality_rules.kept_rows(quality_rules.apply_rules(quality_rules.measure(docs, keep=COLUMNS))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, of the smallest id; ties and rows without one as in
    :func:`strideline.llm.stages.one_of_each`."""
    stages.release()
    importable(configure(spark))
    return stages.one_of_each(docs, COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data replaced by its kind and ``n_chars`` counted anew. A null text stays null, with a
    null ``n_chars``; an empty one stays empty; overlapping finds become one, of the first kind."""
    stages.release()
    importable(configure(spark))
    masked = pii.find(docs, redact=True, keep=("lang", "source"))
    return masked.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.length("redacted").cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each row's text lies in the packed sequences. A null or empty text is one piece of the end
    id; repeated rows and rows without an id are packed like any other; an empty table gives no pieces."""
    import public_tokenizers

    stages.release()
    importable(configure(spark))
    _, placed = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 0, CAPACITY)
    return placed.select("doc_id", "piece", "start", "length", F.col("crc32").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: Language model, MinHash, transducers and tokenizer are beyond SQL; the tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of the last one, as written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, function in STAGES:
        path = staging_path(spark)
        function(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    stages.release()
    return docs

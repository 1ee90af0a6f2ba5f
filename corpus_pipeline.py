"""The corpus pipeline: five operators in a row, each working on all that its predecessor kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a frame.
All stages but the last return the columns of ``documents``; what they decide takes effect.

Defined results: null and empty texts pass every filter (they hold nothing to reject) and end
without ids; null ids and repeated rows are handled row by row, and of repeated rows one stays;
empty tables give empty results; columns besides doc_id, text and n_chars are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import decontamination, ngram_join, pieces, secret_scan, toxicity
from tidewatch.llm.common import keyed_rows, prepare, same_document
from tidewatch.llm.queries import piece_model
from tidewatch.session import materialise


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold; the model learns from the labelled ones among them."""
    prepare(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(toxicity.bucket() != 2)
    model = toxicity.fit(docs, labels)
    return docs.where(toxicity.toxicity(model, docs) < toxicity.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id."""
    prepare(spark)
    return ngram_join.one_of_each_group(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty stands in a benchmark window."""
    prepare(spark)
    hits = decontamination.phrase_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = hits.where(decontamination.contaminated()).select("doc_id", "text_key").distinct()
    return same_document(keyed_rows(docs), bad, "left_anti").select("row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by a mark; ``n_chars`` follows the new text."""
    cut = secret_scan.cuts(docs)
    spans = secret_scan.secrets(F.col("text"), cut)
    redacted = docs.withColumn("text", secret_scan.with_spans(F.col("text"), spans, secret_scan.redacted))
    return redacted.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_ids, ids, round_trip): the texts as piece ids, and whether decoding gives them back."""
    prepare(spark)
    return pieces.encoded(docs, piece_model())


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("sentencepiece", encode_pieces),
]

#: A learned model, MinHash groups and a piece model are beyond SQL; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

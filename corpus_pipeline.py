"""The corpus pipeline: toxic documents go, repeated lines go, one document of each
near-duplicate group stays, secrets are redacted, and what is left is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All stages but the last return the
columns of documents; n_chars follows the text where a stage changes it.

Null texts pass every stage but packing, where they are an end id, as empty ones are.
Repeated rows are toxic or not together; of repeated lines and of near or exact copies the
first by id stays (rows with equal id and text are one text). Very long texts go through
whole. An empty table gives an empty table at every stage. Further columns of documents are
left out at the first stage, so none can clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.llm import bin_packing, jaccard_join, line_dedup, secret_scan, toxicity
from tracewarden.llm.common import discard, fold, materialise_alone

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold go; the model learns from the stage's own documents with a label of the folds that may be learned from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").filter(fold("doc_id", 3) != 1)
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    return toxicity.score(docs.select(*COLUMNS), model).filter("predicted = 0").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one, or nearly, go; so do documents that had words and lost all lines that have any."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    left = (F.col("n_lines") == 0) | (F.col("n_lines") > F.col("n_exact") + F.col("n_near"))
    changed = (F.col("n_exact") + F.col("n_near")) > 0
    return out.filter(left).withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the one with the least id stays, as do documents without words."""
    marked = jaccard_join.near_duplicates(docs.select("doc_id", "text"))
    gone = marked.filter((F.col("n_shingles") > 0) & (F.col("doc_id") != F.col("component_id"))).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of a secret becomes a mark; all documents stay."""
    out = secret_scan.redact(docs.select(*COLUMNS).withColumn("_before", F.length("text")))
    changed = F.length("text") != F.col("_before")
    return out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document with its place in a sequence."""
    import public_tokenizers

    out = bin_packing.pack_documents(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack_sequences),
]

#: Learned scores, tokenisation and a genetic algorithm are beyond SQL; tests/llm/test_pipeline.py holds every stage's rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. What a stage stored is deleted when its successor's rows are."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = materialise_alone(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        if last is not None:
            discard(spark, last)
        last = docs
    return docs

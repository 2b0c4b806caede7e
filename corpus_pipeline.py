"""The training-data pipeline: toxic documents and near copies go, leaked benchmark items go, sources are mixed, and token ids are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimspark.llm import decontaminate, mixing, similar, tokens, toxicity
from claimspark.llm.common import new_table, prepare, read
from claimspark.llm.queries import TOKENIZER
from claimspark.session import Folder, shared_folder


def toxic_documents_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fitted on the whole labelled corpus of the folder's documents that are still there."""
    return toxicity.without_toxic(docs, read(spark, sf_dir, "labels"))


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share four in five of their runs of five words, the one with the smallest doc_id stays."""
    return similar.without_similar(docs, similarity=0.8, shingle=5)


def benchmark_leaks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_matches(docs, read(spark, sf_dir, "benchmark"))


def sources_mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes; whole documents."""
    return mixing.mixed_documents(docs)


def token_ids_written(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places and checksums of the documents' ids, read back from the files."""
    return tokens.write_and_read(docs, TOKENIZER)


STAGES = [
    ("toxicity", toxic_documents_out),
    ("near_copies", near_copies_out),
    ("decontamination", benchmark_leaks_out),
    ("mixing", sources_mixed),
    ("token_ids", token_ids_written),
]

#: Hashes, a fitted model and a tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again: (doc_id, start, n_tokens, ids_crc32) of what is written.

    Null texts count as empty; of documents without words one stays, and the mix takes none of them. Rows without a doc_id are scored, kept as no one's copies, held
    against the benchmark and mixed like others. Of rows that repeat a doc_id one stays. A document that the mix takes twice is written twice. Columns of any
    name pass through all stages but the last. A stage's table is removed when the next one's is written; the token files stay. No documents give no rows; without labels of both kinds nothing is toxic; without items nothing is a leak.
    """
    prepare(spark)
    docs, files, before = read(spark, sf_dir, "documents"), Folder(spark, shared_folder(spark)), None
    for name, stage in STAGES:
        path = new_table(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            files.remove(before)
        before = path.rpartition("/")[2]
    return docs

"""A training corpus from raw documents: five stages, each reading what the one before has written.

Language ID drops documents that it can give no language: those without text or a letter, and those whose best language
explains them no better than bytes drawn evenly would (encoded data, scripts of no language learned); the n-gram Jaccard
join leaves one document of each group of near copies (five-word shingles, similarity 0.8); benchmark decontamination
drops documents that hold benchmark passages; PII puts surrogates for personal data; packing cuts the rest into
sequences, as pieces with their token ids. All but the last return the columns of documents.

Which document of a group stays: that with the smallest doc_id; of rows that share it, one.

Defined results: a null, empty or blank text goes at the first stage, and so does every row of a table without a labelled
row to learn from; a null doc_id, lang or source is kept as it is, null sources being one queue of the last stage; of repeated rows one stays; very long texts are read
whole; further columns, whatever their names, come through all stages but the last; an empty table gives no pieces.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.llm import common, decontaminate, jaccard, langid, packing, pii

SHINGLE, PERCENT = 5, 80
#: The mean log-probability of a byte if all are drawn evenly.
EVEN = -math.log(256)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what has no language: texts that are null or have no letter, and those that no learned language explains."""
    pred, mark, fit = (common.fresh(docs, c) for c in ("lang_pred", "score", "fit"))
    out = langid.language_id(common.wide(docs), docs.select("doc_id", "text", "lang"), pred=pred, mark=mark, fit=fit)
    return out.where((F.col(pred) != "und") & (F.col(fit) > EVEN)).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves the document with the smallest doc_id of each group of linked documents; n_chars follows the text that stays."""
    return jaccard.keep_first(docs, SHINGLE, PERCENT)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data; n_chars follows the new text."""
    return pii.pseudonymise(docs, pii.key_of(spark)).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the documents into pieces of sequences of 2048 tokens, with their ids, every sequence in the corpus's proportions of sources."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [("language_id", language), ("ngram_jaccard", near_copies), ("decontamination", leaks), ("pii", personal_data), ("packing", pack)]

#: SQL has no byte-pair encoder and no EM-trained model; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again. What a stage no longer needs is dropped once the next one's result is there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top, last = f"{common.scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        path, before = f"{top}/{k}-{name}", common.tables(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        own = common.tables(spark) - before
        common.drop_path(spark, *(p for p in own if "/pipeline-" not in p), *([last] if last else []))
        docs, last = spark.read.parquet(path), path
    return docs

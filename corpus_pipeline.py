"""The corpus pipeline: five stages, each written as Parquet and reread as the next one's input.

Every stage but the last returns the columns of documents. Null texts count as empty: toxicity
scores them low, nothing links or repeats in them, and they are encoded as no ids. Null and
repeated ids stay distinct rows; of rows that are copies one goes on. Columns beside text may
hold nulls; further columns go through up to the last stage. An empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import decontaminate, jaccard_join, spm_codec, substring_dedup, toxicity
from quadrille.llm.columns import fold_of
from quadrille.llm.components import checkpointed, shared_folder
from quadrille.llm.queries import table, tokenizer

#: Documents with at least this toxicity go.
TOXIC = 0.7
#: Near copies share at least this part of their shingles of so many words; op9's own values bind its query only.
NEAR_SIZE, NEAR_PERCENT = 5, 80


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", fold_of("doc_id", 3) != 1)
    return toxicity.score(docs, model).where(F.col("toxic_score") < TOXIC).select(docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs, size=NEAR_SIZE, percent=NEAR_PERCENT).select(docs.columns)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that lose words are joined by single spaces; n_chars follows the text."""
    out = substring_dedup.remove_repeats(docs)
    return out.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = spm_codec.encode_decode(docs.select("doc_id", "lang", "source", "text"), tokenizer())
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", remove_toxic),
    ("near_copies", keep_one_of_near_copies),
    ("repeated_passages", remove_repeated_passages),
    ("decontamination", remove_contaminated),
    ("sentencepiece", encode),
]
#: Learned scores and the tokenizer cannot be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents. Each stage's rows are deleted once the next one's are written; the last ones read stay for the lazy result."""
    docs, before = table(spark, sf_dir, "documents"), None
    folder = shared_folder(spark)
    at = f"{folder.rstrip('/')}/pipeline-{uuid.uuid4().hex}" if folder else None
    for name, stage in STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        if at:
            docs.write.parquet(f"{at}/{name}")
            docs = spark.read.parquet(f"{at}/{name}")
            if before:
                _delete(spark, before)
            before = f"{at}/{name}"
        else:
            docs = checkpointed(docs)
    return STAGES[-1][1](spark, docs, sf_dir)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

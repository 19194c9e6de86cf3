"""A training-corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns what it keeps of docs.

The last stage returns the sampled segmentations; the others return the columns of ``documents``. Null texts count as empty; of
equal and of near-equal texts the smallest doc_id stays. SQL can express neither the first nor the last stage, so ``ORACLE_SQL``
is None and the whole is tested against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.llm import decontaminate, exact_dedup, minhash, registry, sentencepiece_sampling, toxicity
from barweave.llm.common import materialise

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that score under 0.7; empty and null texts score low and stay."""
    machine = registry.toxicity_machine(docs, registry.table(spark, sf_dir, "labels"))
    return toxicity.clean(docs, machine, registry.TOXIC_FROM)


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ids are in ``dropped``; the plan is a merge join at every size. Rows without an id stay."""
    dropped = materialise(dropped.select("doc_id"), "pipeline-dropped")
    return docs.join(dropped.hint("merge"), "doc_id", "left_anti").select(docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest id of equal texts; null counts as empty, so one row without text stays."""
    return _without(docs, exact_dedup.exact_duplicates(docs).where(~F.col("kept")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near copies (five-word shingles, 0.8); rows without words are in no group."""
    return _without(docs, minhash.near_duplicates(docs, shingle_words=5, percent=80).where(~F.col("kept")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents without a passage of the benchmark; an empty benchmark drops nothing."""
    found = decontaminate.contamination(docs, registry.table(spark, sf_dir, "benchmark"), n=10, spans=False)
    return _without(docs, found.where("n_hit > 0"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled pieces of every document, and whether they decode to its text; rows without text have none."""
    return sentencepiece_sampling.sample_encode(docs, registry.MODEL).select("doc_id", "pieces", "lossless")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents``; what a stage keeps is written to the shared folder and read again."""
    docs = registry.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: toxic documents go, fuzzy repeated lines go, one document of each group
of near duplicates stays, documents with benchmark items go, and sources are mixed to their
target weights.  Each stage reads what the stage before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigil.llm import decontaminate, lines, minhash, mixing, toxicity
from vigil.llm.common import table, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go; null and empty texts are scored as stated in ``toxicity``."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fuzzy repeats of lines go, documents stay; see ``lines.removed_lines`` for awkward rows."""
    return lines.dedup_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, by the rule of ``minhash.one_of_each``."""
    return minhash.one_of_each(docs)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null ids and empty texts stay."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of what is left: whole and partial repetitions with the columns of ``docs`` and those
    of ``mixing.sample``; awkward rows as stated there and in ``mixing.mix``."""
    return mixing.sample(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontamination", decontaminate_documents),
    ("mixing", mix_sources),
]
#: SQL cannot express the classifier and the latent search; tests/llm compares each stage with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

"""A corpus pipeline of five stages, each written as Parquet and read again.

Quality rules, near duplicates, benchmark overlaps, secrets, and the mix of sources.
A stage keeps the columns of documents; the last adds topic, n_tokens (words), prob and
weight. Personal data is not one of the stages: run the pseudonyms on the result where
it may not stay.

Defined results: rows with null or empty texts have no words and go in the first stage;
rows with a null id are treated like others; repeated rows and near copies leave the row
with the least id; texts of any length are read whole; other columns of documents are
kept, but for those called like the four that the last stage adds, which it replaces; an
empty table of documents gives an empty result, an empty table of labels no learned
rules, and an empty table of benchmark items no overlaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import decontam, lshforest, mixing, rules, secrets
from tessella.llm.common import materialise, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned list reject go."""
    learned = rules.fit_rules(docs, table(spark, sf_dir, "labels"))
    return rules.passing(docs, learned)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the least id."""
    return lshforest.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are blanked in the text; n_chars follows; every document stays."""
    clean = secrets.redact_secrets(docs)
    return clean.selectExpr(*("CAST(length(text) AS BIGINT) AS n_chars" if c == "n_chars" else c for c in docs.columns))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn by their calibrated probabilities."""
    return mixing.mix_sources(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret scan", secret_scan),
    ("source mix", source_mix),
]

#: Learned rules, spaced seeds and byte-pair tests have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Corpus pipeline: toxic documents go, of near copies one stays, contaminated documents go, secrets are masked, and
sources are mixed to target weights.  Every stage reads what its predecessor kept, written as Parquet in the shared
folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from faultline.llm import mixture, partenum, pu_toxicity, secrets, winnowing
from faultline.llm.shared import materialize, table

STAGES = [
    ("toxicity", pu_toxicity.drop_toxic),
    ("near_duplicates", partenum.near_duplicates),
    ("decontamination", winnowing.decontaminate),
    ("secrets", secrets.redact),
    ("mixture", mixture.mix),
]

#: The first stage is a trained classifier, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs

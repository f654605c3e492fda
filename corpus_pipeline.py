"""A training corpus from raw documents: rules, line and near duplicates, mixing, packing.

Every stage takes (spark, documents, folder of tables) and returns a DataFrame;
``run`` writes each result as Parquet to the shared folder and reads it back, so
a lost executor costs part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetpulse.llm.line_dedup import line_stage
from fleetpulse.llm.mixing import mixing_stage
from fleetpulse.llm.packing import packing_stage
from fleetpulse.llm.quality import quality_stage
from fleetpulse.llm.simhash import near_dedup_stage
from fleetpulse.session import materialize

STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Fingerprints and the packing order cannot be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

"""A training corpus from ``documents`` in five stages, each of one operator; written to Parquet and read again in between.

A document that loses all its lines to earlier documents goes with them, and ``n_chars`` is made true where lines went; every
other stage's decision is its operator's own. All stages but the last return the columns that they got, whatever they are.

Defined cases, as composed: a null or empty text passes every stage (it has no lines, fingerprint or shingles to be judged by, and
its words tell nothing unless training says so) and ends with no tokens; a very long one passes whole, alone in its batch if longer
than the budget. Of repeated rows, as of all near copies, one stays, the least id, then the least hash of the text, deciding; a
null id is the greatest. Without labels or benchmark items nothing goes for them, and an empty table stays empty. Extra columns
pass through and may have any names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refgraph.llm import decontaminate, lines, packing, quality, simhash
from refgraph.llm.queries import table
from refgraph.llm.shared import rewritten


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept(docs, table(spark, sf_dir, "labels")).select("row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = lines.deduplicated(docs).where((F.col("removed") == 0) | (F.length(F.trim("text")) > 0))
    changed = {"text": F.col("text"), "n_chars": F.when(F.col("removed") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))}
    return done.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.without_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The first stage trains a model, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = rewritten(docs)
    return docs

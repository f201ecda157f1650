"""The ten operators of this subpackage as queries over the tables of a folder, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from refgraph.llm import codes, decontaminate, lines, packing, pii, quality, simhash, substrings, urls, winnow
from refgraph.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.duplicates(table(spark, sf_dir, "documents"))


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.fingerprints(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeats(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.deduplicated(table(spark, sf_dir, "documents")).select("row.doc_id", "text", "removed")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filtered(table(spark, sf_dir, "pages"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps, with both probabilities."""
    return quality.kept(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("row.doc_id", "p_quality", "p_toxic")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(table(spark, sf_dir, "documents"), pii.train())


def op9_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.coded(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_simhash_dedup, op2_winnowing, op3_substring_dedup, op4_line_dedup, op5_packing, op6_url_filter, op7_quality, op8_pii, op9_token_codes, op10_decontaminate)}

SQL: dict[str, str] = {"op2_winnowing": winnow.SQL, "op3_substring_dedup": substrings.SQL, "op4_line_dedup": lines.SQL, "op5_packing": packing.SQL, "op10_decontaminate": decontaminate.SQL}

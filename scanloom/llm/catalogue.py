"""Queries of this subpackage over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm.canonical import look_same_forms, pairs_of_forms
from scanloom.llm.mixing import mix_sources, reached_shares
from scanloom.llm.names import same_person_pairs
from scanloom.llm.near_duplicates import find_near_duplicates, record_groups, record_pairs
from scanloom.llm.personal_data import find_personal_data, mask_personal_data
from scanloom.llm.pieces import split_oversized
from scanloom.llm.reference_match import map_to_reference
from scanloom.llm.scan_repair import find_noise, repair_texts
from scanloom.llm.tokens import encode_column
from scanloom.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_person_pairs(table(spark, sf_dir, "extracted_fields"), ["patient_name", "doctor_name"], table(spark, sf_dir, "name_forms"))


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recognised texts of both tables: tbl, region_no, page_group, text."""
    records = table(spark, sf_dir, "region_records").where("kind = 'text'").select(F.lit("region_records").alias("tbl"), "region_no", F.col("scan_id").alias("page_group"), "text")
    regions = table(spark, sf_dir, "medical_regions").select(F.lit("medical_regions").alias("tbl"), "region_no", F.col("document_id").alias("page_group"), F.col("text_verbatim").alias("text"))
    return records.unionByName(regions)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_noise(page_texts(spark, sf_dir))


def p2_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_texts(page_texts(spark, sf_dir))


SIDES = [("left_id", "rtl_fixed_left"), ("right_id", "rtl_fixed_right")]
P3 = {"threshold": 0.6, "words": 3}


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_pairs(find_near_duplicates(table(spark, sf_dir, "dedup_results"), SIDES, **P3))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_groups(find_near_duplicates(table(spark, sf_dir, "dedup_results"), SIDES, **P3))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(page_texts(spark, sf_dir))


def p4_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask_personal_data(page_texts(spark, sf_dir)).distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions, matches = table(spark, sf_dir, "medical_regions"), table(spark, sf_dir, "matching_results")
    forms = look_same_forms(regions, "region_no", ["text_verbatim", "normalized_view"]).unionByName(look_same_forms(matches, "result_id", ["original_text"]))
    return pairs_of_forms(forms)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "medical_terms")
    spellings = reduce(DataFrame.unionByName, (terms.select("term_id", F.col(c).alias("spelling")) for c in ("written", "canonical", "latin_name")))
    return map_to_reference(table(spark, sf_dir, "medication_items"), "item_id", "medication", spellings, "term_id", "spelling")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_column(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares reached by temperature, at the entropy of the weights or the repetition limit."""
    targets = table(spark, sf_dir, "mix_targets")
    return reached_shares(mix_sources(table(spark, sf_dir, "documents"), targets, by_temperature=True), targets)


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reached_shares(p9_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(table(spark, sf_dir, "documents"), table(spark, sf_dir, "split_limits"))


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_texts": p2_texts,
    "p3_found": p3_found,
    "p3_groups": p3_groups,
    "p4_found": p4_found,
    "p4_texts": p4_texts,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p8_ids": p8_ids,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p9_temperature": p9_temperature,
    "p10_pieces": p10_pieces,
}
SQL: dict[str, str] = {}

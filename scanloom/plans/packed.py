"""Queries for values packed in one field."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from scanloom.operators.packed_values import split_values
from scanloom.session import table

PACKED_FIELDS = ("diagnosis", "medications")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of the fields that hold at least two; redelivered rows count once."""
    source = table(spark, sf_dir, "extracted_fields")
    parts = [split_values(source.select("record_id", f).distinct(), "record_id", f, only_packed=True) for f in PACKED_FIELDS]
    return reduce(DataFrame.unionByName, parts)


QUERIES = {"p7_found": p7_found}
SQL: dict[str, str] = {}

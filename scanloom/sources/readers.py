"""Readers as DataFrames with fixed schemas. Errors are values or rejected rows, never silent loss."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# File name endings of images.
IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp")

_REGION = "region_id:string,type:string,bbox:struct<x:double,y:double,w:double,h:double>,source:string,is_manually_edited:boolean,text_verbatim:string,normalized_view:string"
LAYOUT_SCHEMA = f"document_id string, image_dimensions struct<w:int,h:int>, dpi int, layout_version string, regions array<struct<{_REGION}>>"
CASE_SCHEMA = "id string, language string, specialty string, difficulty string, noise_level string, image_path string, source string, description string, ground_truth string"
GOLDEN_SCHEMA = "name string, language string, test_cases array<struct<id:string,reference:string,hypothesis:string,medical_terms:array<string>,ocr_confidence:double,category:string>>"
RESULT_SCHEMA = "model_name string, test_type string, cer double, wer double, timestamp string, dataset_size int"


def image_files(spark: SparkSession, path: str, content: bool = True) -> DataFrame:
    """path, length, modification time and, if asked for, content of the images under a folder, in order of path when collected by ``listing``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(IMAGE_SUFFIXES) + "}").option("recursiveFileLookup", "true").load(path)
    return files if content else files.drop("content")


def listing(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Sorted paths of the images under a folder; ``most`` is for reports."""
    out = image_files(spark, path, content=False).select("path", "length").orderBy("path")
    return out if most is None else out.limit(most)


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one row a file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


class PairError(ValueError):
    """A line of a pair file lacks its reference or hypothesis, or there is no line."""


def text_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(id, reference, hypothesis) of a JSON-lines file, strict: a bad line or an empty file raises PairError."""
    raw = spark.read.text(path).where("trim(value) != ''")
    rows = raw.select(F.from_json("value", "id string, reference string, hypothesis string", {"mode": "PERMISSIVE"}).alias("r"), "value").select("r.*", "value")
    bad = rows.where("reference is null or hypothesis is null").select("value").first()
    if bad:
        raise PairError(f"no reference or hypothesis: {bad['value'][:200]}")
    if rows.isEmpty():
        raise PairError("no pairs")
    return rows.drop("value")


def correction_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(wrong, right) of a JSON-lines file with either naming; bad lines are skipped, the last of equal keys counts by line order within a file."""
    raw = spark.read.text(path).withColumn("n", F.monotonically_increasing_id())
    r = F.from_json("value", "incorrect_ocr_output string, wrong string, correct_text string, `right` string")
    rows = raw.select("n", r.alias("r")).select("n", F.coalesce("r.incorrect_ocr_output", "r.wrong").alias("wrong"), F.coalesce("r.correct_text", "r.right").alias("right"))
    return rows.where("wrong is not null and wrong != '' and right is not null").groupBy("wrong").agg(F.max_by("right", "n").alias("right"))


def golden_cases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cases, rejected) of golden data sets; a case needs id, reference and hypothesis and a confidence from 0 to 1 if any."""
    cases = spark.read.schema(GOLDEN_SCHEMA).json(path, multiLine=True).select("name", "language", F.explode("test_cases").alias("c")).select("name", "language", "c.*")
    ok = "id is not null and reference is not null and hypothesis is not null and (ocr_confidence is null or ocr_confidence between 0 and 1)"
    return cases.where(ok), cases.where(f"not coalesce({ok}, false)")


def ci_cases(spark: SparkSession, path: str) -> DataFrame:
    """Test cases of the folders english, arabic and mixed; missing language, specialty, difficulty and noise get defaults."""
    out = None
    for language in ("english", "arabic", "mixed"):
        one = spark.read.schema(CASE_SCHEMA).option("pathGlobFilter", "*.json").json(f"{path}/{language}", multiLine=True).withColumn("language", F.coalesce("language", F.lit(language)))
        out = one if out is None else out.unionByName(one)
    defaults = {"specialty": "general", "difficulty": "medium", "noise_level": "clean", "ground_truth": ""}
    return out.fillna(defaults)


def benchmark_results(spark: SparkSession, path: str, form: str = "json") -> DataFrame:
    """Gate inputs from JSON or CSV; missing rates are 0 and sizes 0."""
    reader = spark.read.schema(RESULT_SCHEMA)
    rows = reader.csv(path, header=True) if form == "csv" else reader.json(path, multiLine=True)
    return rows.fillna({"cer": 0.0, "wer": 0.0, "dataset_size": 0, "test_type": "printed"})


def layouts(spark: SparkSession, path: str) -> DataFrame:
    """Layout documents with their regions."""
    return spark.read.schema(LAYOUT_SCHEMA).json(path, multiLine=True)


def holdout(spark: SparkSession, path: str) -> DataFrame:
    """Samples of a held-out set."""
    schema = "samples array<struct<image_path:string,ground_truth:string,ocr_engine:string>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode("samples").alias("s")).select("s.*")


def golden_pairs(spark: SparkSession, texts: list[tuple[str, str]]) -> DataFrame:
    """Numbered reference texts (language, text) with a condition and seed each, in turn."""
    conditions = ("clean", "low_contrast", "noisy", "shadow")
    count: dict[str, int] = {}
    rows = []
    for i, (lang, text) in enumerate(texts):
        count[lang] = count.get(lang, 0) + 1
        rows.append((f"{lang}-{count[lang]:03d}", lang, conditions[i % 4], 1000 + i, text))
    return spark.createDataFrame(rows, "id string, lang string, condition string, seed int, text string")

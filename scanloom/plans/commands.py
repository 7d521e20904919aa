"""Commands over DataFrames by name, plans of them as JSON, and a command line."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.functions import extraction, metrics, normalizers, text_rules
from scanloom.operators.packed_values import split_values
from scanloom.sources import readers, writers

TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}


class CommandError(ValueError):
    """A command is unknown or its parameters don't fit."""


@dataclass(frozen=True)
class Command:
    """A step: (DataFrame or None, session, params) to a DataFrame, with a schema of its parameters."""

    id: str
    category: str
    run: Callable[[DataFrame | None, SparkSession, dict], DataFrame]
    params: dict[str, str] = field(default_factory=dict)
    required: tuple[str, ...] = ()

    def check(self, params: dict) -> None:
        for name in self.required:
            if name not in params:
                raise CommandError(f"{self.id}: {name} is missing")
        for name, value in params.items():
            kind = self.params.get(name)
            if kind and (not isinstance(value, TYPES[kind]) or (kind in ("integer", "number") and isinstance(value, bool))):
                raise CommandError(f"{self.id}: {name} is no {kind}")


REGISTRY: dict[str, Command] = {}


def command(id: str, category: str, required: tuple[str, ...] = (), **params: str):
    """Registers a function as a command; a later one of the same id takes its place."""

    def register(f):
        REGISTRY[id] = Command(id, category, f, params, required)
        return f

    return register


def categories() -> list[str]:
    return sorted({c.category for c in REGISTRY.values()})


def _column(name: str, function) -> None:
    @command(f"postprocess.{name}", "postprocess", ("text",), text="string", out="string")
    def run(df, spark, p):
        return df.withColumn(p.get("out", p["text"]), function(F.col(p["text"])))


for _name, _function in {
    "strip_control": text_rules.strip_control, "nfkc": text_rules.unify_forms, "collapse_spaces": text_rules.collapse_spaces, "join_hyphenated": text_rules.join_hyphenated,
    "merge_paragraphs": text_rules.merge_paragraphs, "drop_page_numbers": text_rules.drop_page_numbers, "drop_headers": text_rules.drop_headers, "normalize_ar": normalizers.for_matching,
    "normalize_strong": normalizers.strong, "fix_direction": normalizers.repair_direction, "correct_words": normalizers.corrected_words, "mask": extraction.masked,
}.items():
    _column(_name, _function)


@command("io.read_parquet", "io", ("path",), path="string")
def _read_parquet(df, spark, p):
    return spark.read.parquet(p["path"])


@command("io.read_text", "io", ("path",), path="string")
def _read_text(df, spark, p):
    return readers.text_files(spark, p["path"])


@command("io.list_images", "io", ("path",), path="string")
def _list_images(df, spark, p):
    return readers.listing(spark, p["path"], 50)


@command("io.save_text", "io", ("text", "path"), text="string", path="string")
def _save_text(df, spark, p):
    writers.write_text(df, p["text"], p["path"])
    return df


@command("postprocess.process_text", "postprocess", ("text",), text="string", confidence="string")
def _process(df, spark, p):
    return text_rules.process_text(df, p["text"], p.get("confidence"))


@command("postprocess.extract_fields", "postprocess", ("text",), text="string")
def _fields(df, spark, p):
    return extraction.with_fields(df, p["text"])


@command("postprocess.split_values", "postprocess", ("key", "field"), key="string", field="string")
def _split(df, spark, p):
    return split_values(df, p["key"], p["field"])


@command("postprocess.guard_numbers", "postprocess", ("before", "after"), before="string", after="string")
def _guard(df, spark, p):
    return df.withColumn("guarded", metrics.guarded(F.col(p["before"]), F.col(p["after"])))


@command("benchmark.cer", "benchmark", ("reference", "hypothesis"), reference="string", hypothesis="string")
def _cer(df, spark, p):
    return df.withColumn("cer", F.round(metrics.cer(F.col(p["reference"]), F.col(p["hypothesis"]))["cer"], 4))


@command("benchmark.wer", "benchmark", ("reference", "hypothesis"), reference="string", hypothesis="string")
def _wer(df, spark, p):
    return df.withColumn("wer", F.round(metrics.wer(F.col(p["reference"]), F.col(p["hypothesis"]))["wer"], 4))


@command("export.markdown", "export", ("text", "path"), text="string", title="string", path="string")
def _markdown(df, spark, p):
    title = F.lit(p["title"]) if p.get("title") else None
    writers.write_text(df.withColumn("_m", writers.markdown(F.col(p["text"]), title)), "_m", p["path"])
    return df


@command("export.json", "export", ("path",), path="string", keys="array")
def _json(df, spark, p):
    (df.select(*p["keys"]) if p.get("keys") else df).write.json(p["path"])
    return df


def run_plan(spark: SparkSession, plan: dict, df: DataFrame | None = None, dry: bool = False) -> tuple[DataFrame | None, list[dict]]:
    """(result, trace) of a plan {name, steps: [{command, params}]}; stops at the first step that fails, whose error is a value of the trace.

    Steps are lazy but for those that write; a dry run checks the parameters only.
    """
    trace: list[dict] = []
    for step in plan.get("steps", []):
        name, params = step.get("command"), step.get("params") or {}
        entry = {"command": name, "ok": True}
        trace.append(entry)
        try:
            if name not in REGISTRY:
                raise CommandError(f"unknown command {name}")
            REGISTRY[name].check(params)
            if not dry:
                df = REGISTRY[name].run(df, spark, params)
        except Exception as error:  # a failed step is a result
            entry |= {"ok": False, "error": f"{type(error).__name__}: {str(error)[:500]}"}
            break
    return df, trace


def main(args: list[str] | None = None) -> int:
    """list | describe ID | pipeline FILE [--dry-run]; the exit code tells whether all went well."""
    parser = argparse.ArgumentParser(prog="scanloom")
    sub = parser.add_subparsers(dest="what", required=True)
    sub.add_parser("list")
    sub.add_parser("describe").add_argument("id")
    pipe = sub.add_parser("pipeline")
    pipe.add_argument("file")
    pipe.add_argument("--dry-run", action="store_true")
    a = parser.parse_args(args)
    if a.what == "list":
        print("\n".join(sorted(REGISTRY)))
        return 0
    if a.what == "describe":
        c = REGISTRY.get(a.id)
        print(json.dumps({"id": c.id, "category": c.category, "params": c.params, "required": c.required}) if c else "unknown", file=sys.stdout if c else sys.stderr)
        return 0 if c else 1
    with open(a.file, encoding="utf-8") as f:
        plan = json.load(f)
    spark = None if a.dry_run else SparkSession.builder.getOrCreate()
    _, trace = run_plan(spark, plan, dry=a.dry_run)
    print(json.dumps(trace, ensure_ascii=False))
    return 0 if all(t["ok"] for t in trace) else 1


if __name__ == "__main__":
    sys.exit(main())

"""Writers: texts, Markdown, JSON, CSV and reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def markdown(text: Column, title: Column | None = None) -> Column:
    """A document: the title as a heading, if any, a blank line, the text, a line feed."""
    body = F.concat(text, F.lit("\n"))
    return body if title is None else F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("# "), title, F.lit("\n\n"), body)).otherwise(body)


def write_text(df: DataFrame, text: str, path: str, mode: str = "errorifexists") -> None:
    df.select(F.col(text).alias("value")).write.mode(mode).text(path)


def write_documents(df: DataFrame, path: str, form: str = "json", mode: str = "errorifexists") -> None:
    """Rows (source, text) as JSON, Markdown or plain text; other forms raise ValueError."""
    if form == "json":
        df.write.mode(mode).json(path)
    elif form in ("markdown", "txt"):
        write_text(df.withColumn("_out", markdown(F.col("text"), F.col("source")) if form == "markdown" else F.col("text")), "_out", path, mode)
    else:
        raise ValueError(f"unknown form {form}")


def write_by_class(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Results of the text pipeline in one folder for each classification."""
    df.write.mode(mode).partitionBy("classification").json(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_training_set(df: DataFrame, path: str, mode: str = "errorifexists") -> dict:
    """Rows with text and image, as JSON lines, and the returned description of the set."""
    some = df.where("trim(text) != '' and image is not null")
    some.write.mode(mode).json(f"{path}/train")
    return {"rows": some.count(), "columns": some.columns}


def report(rows: list[dict], form: str = "markdown", title: str = "Results", limits: dict[str, float] | None = None) -> str:
    """A small result table as Markdown, HTML or JSON; values above a limit are marked. For aggregates, not for data."""
    limits = limits or {"cer": 0.15, "wer": 0.25}
    if form == "json":
        return json.dumps({"title": title, "rows": rows}, ensure_ascii=False, sort_keys=True, default=str)
    names = list(rows[0]) if rows else []

    def cell(name: str, value) -> str:
        text = f"{value:.4f}" if isinstance(value, float) else "" if value is None else str(value)
        over = name in limits and isinstance(value, (int, float)) and value > limits[name]
        return text + (" ⚠" if over else "")

    if form == "html":
        from html import escape

        head = "".join(f"<th>{escape(n)}</th>" for n in names)
        body = "".join("<tr>" + "".join(f"<td>{escape(cell(n, r[n]))}</td>" for n in names) + "</tr>" for r in rows)
        return f"<h1>{escape(title)}</h1><table><tr>{head}</tr>{body}</table>"
    if form != "markdown":
        raise ValueError(f"unknown form {form}")
    lines = [f"# {title}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    lines += ["| " + " | ".join(cell(n, r[n]) for n in names) + " |" for r in rows]
    return "\n".join(lines) + "\n"

"""Bounded reading of delimited files: strict quoting, exact cells, and typed failures for each file.

Spark's own CSV reader drops blank lines and pads short rows, so files are read as bytes (one row for each file, at
most ``most_bytes``) and parsed inside tasks. Spark lists no row for a file of no bytes at all.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DELIMITERS = (",", ";", "\t")
SCHEMA = "path string, sha256 string, failure string, row_number int, header array<string>, cells array<string>"


@dataclass(frozen=True)
class Limits:
    """What a file may hold."""

    most_bytes: int = 25 * 1024 * 1024
    most_rows: int = 10_000
    most_columns: int = 100
    most_characters: int = 4096


def parse(raw: bytes, delimiter: str, limits: Limits) -> tuple[str | None, list[str], list[list[str]]]:
    """Failure (or None), header, rows."""
    try:
        text = raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        return "INVALID_ENCODING", [], []
    before = csv.field_size_limit(max(limits.most_bytes, 1 << 17))
    try:
        rows = list(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter, strict=True))
    except csv.Error:
        return "MALFORMED_CSV", [], []
    finally:
        csv.field_size_limit(before)
    if not rows or not rows[0]:
        return "EMPTY_FILE", [], []
    if len(rows) - 1 > limits.most_rows:
        return "TOO_MANY_ROWS", [], []
    if any(len(r) > limits.most_columns for r in rows):
        return "TOO_MANY_COLUMNS", [], []
    if any(len(c) > limits.most_characters for r in rows for c in r):
        return "FIELD_TOO_LONG", [], []
    return None, rows[0], rows[1:]


def read(spark: SparkSession, path: str, delimiter: str = ",", limits: Limits = Limits()) -> DataFrame:
    """A row for each data row (row_number from 2), or one with ``failure`` for a file that can't be read."""
    if delimiter not in DELIMITERS:
        raise ValueError("fields are separated by a comma, a semicolon or a tab")
    files = spark.read.format("binaryFile").load(path)
    large = F.col("length") > limits.most_bytes
    files = files.select("path", F.when(~large, F.sha2("content", 256)).alias("sha256"), F.when(~large, F.col("content")).alias("content"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, sha, raw in part.itertuples(index=False):
                failure, header, rows = ("TOO_LARGE", [], []) if raw is None else parse(raw, delimiter, limits)
                out = [(path, sha, failure, None, [], [])] if failure else [(path, sha, None, i + 2, header, r) for i, r in enumerate(rows)]
                yield pd.DataFrame(out, columns=["path", "sha256", "failure", "row_number", "header", "cells"]).astype({"row_number": "Int32"})

    return files.mapInPandas(run, SCHEMA)


def header_issues(header: list[str], wanted: list[str]) -> list[str]:
    """DUPLICATE_HEADER and MISSING_COLUMN issues; any of them keeps rows from being read."""
    twice = sorted({h for h in header if header.count(h) > 1})
    return [f"{h}:DUPLICATE_HEADER" for h in twice] + [f"{w}:MISSING_COLUMN" for w in wanted if w not in header]


def columns(rows: DataFrame, header: list[str]) -> DataFrame:
    """The cells by name; cells that a row lacks are null. ``extra`` has those beyond the header."""
    named = [F.get("cells", F.lit(i)).alias(h) for i, h in enumerate(header)]
    extra = F.when(F.size("cells") > len(header), F.slice("cells", len(header) + 1, F.size("cells") - len(header))).otherwise(F.array().cast("array<string>"))
    return rows.where("failure is null").select("path", "row_number", *named, extra.alias("extra"))

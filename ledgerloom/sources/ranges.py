"""Delimited files of any size, read by ranges of bytes: a record may cross the borders of ranges, and no task holds a file.

Spark's text source cuts files into ranges at line ends. A line end inside quotes ends no record, so each range is read
twice. The first pass finds what a range does to the state "inside quotes": it sets it, keeps it or turns it over. Such effects
combine in any number, so one window over the ranges of a file (few rows) gives the state in which each begins. The second pass parses
ranges from there; what is left of records at their borders is put together by the range in which the record began.

Caps hold in every pass. A line longer than any record may be is passed over by the reader, which the count of bytes shows. A file
fails as a whole, with the first of these that is found in it: TOO_LARGE (not scanned), INVALID_ENCODING, MALFORMED_CSV, EMPTY_FILE, TOO_MANY_ROWS,
TOO_MANY_COLUMNS, FIELD_TOO_LONG. Where a record is longer than all caps together allow, it is FIELD_TOO_LONG, whatever else is in it.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.components import cut
from .delimited import DELIMITERS, Limits

#: Failures of a file, gravest first.
FAILURES = ("TOO_LARGE", "INVALID_ENCODING", "MALFORMED_CSV", "EMPTY_FILE", "TOO_MANY_ROWS", "TOO_MANY_COLUMNS", "FIELD_TOO_LONG")
#: Larger files get no hash of their bytes: it can't be made by ranges, and Spark reads a file's bytes as one value.
MOST_HASHED = 64 * 1024 * 1024
#: Ranges that begin inside quotes are rare; this many of them (some 100 bytes each) are sent to all tasks, more are joined by a shuffle.
MOST_SENT = 100_000
_PIECES = "path string, block long, kind string, n long, cells array<string>, text binary, failure string"


@dataclass(frozen=True)
class Scan:
    """files: path, n_bytes, sha256, header, n_rows, n_columns (of the widest row), failure (with one, header and counts are null). rows: path, row_number (from 2), cells, of files without a failure."""

    files: DataFrame
    rows: DataFrame


def longest(limits: Limits) -> int:
    """Bytes of a record that keeps all caps: characters take four bytes at most, and all may be doubled quotes."""
    return limits.most_columns * (8 * limits.most_characters + 3)


def leaves_open(text: bytes, inside: bool, delimiter: str) -> bool:
    """Whether the state after a line is inside quotes, from that before it. Quotes count where a field begins only."""
    opening, at = _openings(delimiter), 0
    while True:
        if inside:
            at = text.find(b'"', at)
            if at < 0:
                return True
            if text.startswith(b'""', at):
                at += 2
                continue
            at += 1
        found = opening.search(text, at)
        if not found:
            return False
        at, inside = found.end(), True


def _openings(delimiter: str) -> re.Pattern[bytes]:
    return re.compile(rb'(?:^|[' + delimiter.encode() + rb'\r\n])"')


def parsed(text: bytes, delimiter: str) -> tuple[str | None, list[list[str]]]:
    """Failure (or None) and the rows of whole records without the last line end."""
    try:
        decoded = text.decode()
    except UnicodeDecodeError:
        return "INVALID_ENCODING", []
    before = csv.field_size_limit(2**31 - 1)
    try:
        return None, list(csv.reader(io.StringIO(decoded + "\n", newline=""), delimiter=delimiter, strict=True))
    except csv.Error:
        return "MALFORMED_CSV", []
    finally:
        csv.field_size_limit(before)


def _lines(spark: SparkSession, path: str, limits: Limits) -> DataFrame:
    """path, block (where the range begins), value: lines in order within each range. The reader drops a mark of byte order."""
    reader = spark.read.option("lineSep", "\n").option("mapreduce.input.linerecordreader.line.maxlength", str(longest(limits) + 1))
    held = reader.text(path).where(F.col("_metadata.file_size") <= limits.most_bytes)
    return held.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _effects(lines: DataFrame, delimiter: str) -> DataFrame:
    """path, block, n_bytes (line ends included), from_out, from_in: whether a range ends inside quotes, from either state."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, [0, False, True]
        names = ["path", "block", "n_bytes", "from_out", "from_in"]
        for part in parts:
            out = []
            for path, block, value in part.itertuples(index=False):
                if (path, block) != now:
                    if now:
                        out.append((*now, *held))
                    now, held = (path, block), [0, False, True]
                held[0] += len(value) + 1
                if b'"' in value:
                    held[1:] = [leaves_open(value, inside, delimiter) for inside in held[1:]]
            if out:
                yield pd.DataFrame(out, columns=names)
        if now:
            yield pd.DataFrame([(*now, *held)], columns=names)

    found = lines.mapInPandas(run, "path string, block long, n_bytes long, from_out boolean, from_in boolean")
    # a task reads a range from end to end, so these are sums of one
    return found.groupBy("path", "block").agg(F.sum("n_bytes").alias("n_bytes"), F.first("from_out").alias("from_out"), F.first("from_in").alias("from_in"))


def _states(effects: DataFrame) -> DataFrame:
    """Adds ``inside``: the state in which a range begins."""
    upto = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sets = F.col("from_out") == F.col("from_in")
    turns = (F.col("from_out") & ~F.col("from_in")).cast("int")
    held = effects.withColumn("turned", F.sum(turns).over(upto))
    held = held.withColumn("last", F.last(F.when(sets, F.struct(F.col("from_out").cast("int").alias("to"), F.col("turned").alias("at"))), ignorenulls=True).over(upto))
    after = F.coalesce(F.col("last.to"), F.lit(0)) + F.col("turned") - F.coalesce(F.col("last.at"), F.lit(0))
    held = held.withColumn("after", after % 2 == 1)
    return held.withColumn("inside", F.coalesce(F.lag("after").over(Window.partitionBy("path").orderBy("block")), F.lit(False))).drop("turned", "last", "after")


def _pieces(lines: DataFrame, delimiter: str, limits: Limits) -> DataFrame:
    """Rows (kind ``row``) and what is left of records at borders: ``a`` ends in this range, ``b`` fills it, ``c`` begins in it.

    ``n`` counts a range's records from 0; a record belongs to the range in which it begins."""
    most = longest(limits)
    names = ["path", "block", "kind", "n", "cells", "text", "failure"]

    class Range:
        def __init__(self, path, block, inside):
            self.name, self.inside, self.starts, self.n = (path, block), inside, not inside, 0
            self.open: list[bytes] = []
            self.size, self.out = 0, []

        def rows(self, whole: list[bytes]):
            if whole:
                failure, rows = parsed(b"\n".join(whole), delimiter)
                if failure:
                    self.out.append((*self.name, "row", self.n, [], None, failure))
                self.out += [(*self.name, "row", self.n + i, cells, None, None) for i, cells in enumerate(rows)]
                self.n += len(rows)
                whole.clear()

        def left(self, kind: str):
            long = self.size > most
            self.out.append((*self.name, kind, self.n, [], None if long else b"\n".join(self.open), "FIELD_TOO_LONG" if long else None))
            self.open, self.size = [], 0

        def take(self, value: bytes, whole: list[bytes]):
            after = leaves_open(value, self.inside, delimiter) if b'"' in value else self.inside
            if not (self.inside or after or self.open):
                whole.append(value)
                return
            self.size += len(value) + 1
            if self.size <= most:
                self.open.append(value)
            self.inside = after
            if after:
                return
            if not self.starts:
                self.left("a")
            elif self.size > most:
                self.rows(whole)
                self.out.append((*self.name, "row", self.n, [], None, "FIELD_TOO_LONG"))
                self.n += 1
                self.open, self.size = [], 0
            else:
                whole += self.open
                self.open, self.size = [], 0
            self.starts = True

        def end(self):
            if self.inside:
                self.left("c" if self.starts else "b")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: Range | None = None
        for part in parts:
            whole: list[bytes] = []
            out = []
            for path, block, value, inside in part.itertuples(index=False):
                if now is None or now.name != (path, block):
                    if now:
                        now.rows(whole)
                        now.end()
                        out += now.out
                    now = Range(path, block, bool(inside))
                now.take(value, whole)
            if now:
                now.rows(whole)
                out += now.out
                now.out = []
            yield pd.DataFrame(out, columns=names)
        if now:
            now.end()
            yield pd.DataFrame(now.out, columns=names)

    return lines.mapInPandas(run, _PIECES)


def _stitched(pieces: DataFrame, delimiter: str) -> DataFrame:
    """Rows of records that cross borders, under the range in which they begin."""
    upto = Window.partitionBy("path").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = pieces.where("kind <> 'row'").withColumn("begin", F.last(F.when(F.col("kind") == "c", F.struct("block", "n")), ignorenulls=True).over(upto))
    held = F.array_sort(F.collect_list(F.struct("block", "kind", "text")))
    joined = left.groupBy("path", F.col("begin.block").alias("block"), F.col("begin.n").alias("n")).agg(held.alias("held"), F.max("failure").alias("failure"), F.bool_or(F.col("kind") == "a").alias("ends"))
    joined = joined.withColumn("failure", F.when(~F.col("ends"), "MALFORMED_CSV").otherwise(F.col("failure")))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for path, block, n, texts, failure in part.itertuples(index=False):
                failure, rows = (failure, []) if failure else parsed(b"\n".join(texts), delimiter)
                out += [(path, block, "row", n, [], None, failure)] if failure else [(path, block, "row", n + i, cells, None, None) for i, cells in enumerate(rows)]
            yield pd.DataFrame(out, columns=["path", "block", "kind", "n", "cells", "text", "failure"])

    return joined.select("path", "block", "n", F.col("held.text").alias("texts"), "failure").mapInPandas(run, _PIECES)


def scan(spark: SparkSession, path: str, delimiter: str = ",", limits: Limits = Limits()) -> Scan:
    """Files under ``path``, and their rows.

    Two reads of the bytes and no shuffle of them; records are written once to the checkpoint folder, and the rows of files that fail are then left out. Blank
    lines are rows without cells; a first row without cells makes an EMPTY_FILE. Files of no bytes at all aren't listed by Spark. Files of one content have rows each.
    """
    if delimiter not in DELIMITERS:
        raise ValueError("fields are separated by a comma, a semicolon or a tab")
    listed = spark.read.format("binaryFile").load(path)
    hashed = listed.where(F.col("length") <= min(MOST_HASHED, limits.most_bytes)).select(F.col("_metadata.file_path").alias("path"), F.sha2("content", 256).alias("sha256"))
    listed = listed.select(F.col("_metadata.file_path").alias("path"), F.col("length").alias("n_bytes")).join(hashed, "path", "left")
    lines = _lines(spark, path, limits)
    ranges = cut(_states(_effects(lines, delimiter)))
    starts = ranges.where("inside").select("path", "block", "inside")
    if starts.count() <= MOST_SENT:
        lines = lines.join(F.broadcast(starts), ["path", "block"], "left")
    else:
        lines = lines.withColumn("at", F.monotonically_increasing_id()).join(starts, ["path", "block"], "left").repartition("path", "block").sortWithinPartitions("path", "block", "at")
    pieces = cut(_pieces(lines.select("path", "block", "value", F.coalesce("inside", F.lit(False)).alias("inside")), delimiter, limits))
    records = pieces.where("kind = 'row'").unionByName(_stitched(pieces, delimiter)).select("path", "block", "n", "cells", "failure")

    width, long = F.size("cells"), F.exists("cells", lambda c: F.char_length(c) > limits.most_characters)
    first = (F.col("block") == 0) & (F.col("n") == 0)
    found = F.when(F.col("failure").isNotNull(), F.col("failure")).when(first & (width == 0), "EMPTY_FILE").when(width > limits.most_columns, "TOO_MANY_COLUMNS").when(long, "FIELD_TOO_LONG")
    rank = F.array_position(F.lit(list(FAILURES)), found)
    per = records.groupBy("path", "block").agg(F.max("n").alias("n"), F.min(F.when(rank > 0, rank)).alias("rank"), F.max(F.when(first, F.col("cells"))).alias("header"), F.max(width).alias("n_columns"))
    per = cut(per.withColumn("n", F.col("n") + 1))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    seen = ranges.groupBy("path").agg(F.sum("n_bytes").alias("seen"))
    counts = per.groupBy("path").agg(F.sum("n").alias("n"), F.min("rank").alias("rank"), F.max("header").alias("header"), F.max("n_columns").alias("n_columns"))
    files = listed.join(counts, "path", "left").join(seen, "path", "left")
    n_rows = F.greatest(F.coalesce("n", F.lit(0)) - 1, F.lit(0))
    at = lambda code: F.lit(FAILURES.index(code) + 1)
    passed_over = F.col("n_bytes") - F.coalesce("seen", F.lit(0)) > longest(limits)
    least = F.least(
        F.when(F.col("n_bytes") > limits.most_bytes, at("TOO_LARGE")), F.col("rank"), F.when(n_rows > limits.most_rows, at("TOO_MANY_ROWS")),
        F.when(passed_over, at("FIELD_TOO_LONG")), F.when(F.col("n").isNull() & ~passed_over, at("EMPTY_FILE")),
    )
    failure = F.get(F.lit(list(FAILURES)), least.cast("int") - 1)
    files = files.select("path", "n_bytes", "sha256", "header", n_rows.alias("n_rows"), "n_columns", failure.alias("failure"))
    # what could be read of a file that fails depends on how its ranges fall
    files = cut(files.select("path", "n_bytes", "sha256", *[F.when(F.col("failure").isNull(), F.col(c)).alias(c) for c in ("header", "n_rows", "n_columns")], "failure"))
    numbered = records.join(offsets, ["path", "block"]).select("path", (F.col("offset") + F.col("n") + 1).alias("row_number"), "cells").where("row_number > 1")
    return Scan(files, numbered.join(files.where("failure is null").select("path"), "path", "left_semi"))

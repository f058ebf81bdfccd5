"""Queries over delimited files that Spark writes from the test tables: some of the files are broken, and so are some of the cells."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exact
from ..operators.components import cut
from ..sources import contract, delimited, imports
from . import testbed

#: A file holds the records of so many keys: few of the first ten files, more of the others.
FEW, MANY = 300, 20_000
LIMITS = delimited.Limits(most_bytes=1 << 30, most_rows=1_000_000, most_columns=20, most_characters=64)
HEAD = "trade_id,traded_at,instrument,side,quantity,price,gross_amount,state"


def _folder(spark, name: str) -> str:
    """A new folder beside the checkpoints, which driver and executors share."""
    cut(spark.range(0))
    return os.path.join(spark.sparkContext._jsc.sc().getCheckpointDir().get(), f"{name}-{uuid.uuid4().hex}")


def written(spark, sf_dir: str) -> str:
    """A folder of files with the records of the left side, in order of keys, each behind a header.

    Of five files in turn one is sound, one lacks a column, one has text after a closing quote, one is sound, and one has a field that is too long, each of
    the latter two where a key leaves 100 by 300. Instruments are quoted and hold a line end for every 11th key; every 59th row has a cell too many."""
    recs = testbed.records(spark, sf_dir).where("rec_side = 'L'")
    k = F.col("k")
    turn = F.pmod(F.col("file"), F.lit(5))
    odd = k % FEW == 100
    quoted = F.concat(F.lit('"'), F.when(k % 11 == 0, F.lit("\n")).otherwise(F.lit(" ")), F.col("instrument"), F.when((turn == 4) & odd, F.lit("y" * 65)).otherwise(F.lit("")), F.lit('"'), F.when((turn == 2) & odd, F.lit("x")).otherwise(F.lit("")))
    cells = [
        F.when(k % 29 == 0, F.lit("K")).otherwise(F.col("id")), F.when(k % 31 == 0, F.lit("soon")).otherwise(exact.instant_of(F.col("executed_at"))), quoted, F.when(k % 37 == 0, F.lit("HOLD")).otherwise(F.col("side")),
        F.when(k % 41 == 0, F.lit("NaN")).otherwise(exact.text_of(F.col("quantity"))), F.when(k % 47 == 0, F.lit("")).otherwise(F.lit("1.5")), exact.text_of(F.col("gross_amount")), F.concat("state", F.when(k % 59 == 0, F.lit(",more")).otherwise(F.lit(""))),
    ]
    lines = recs.withColumn("file", F.when(k < 10 * FEW, F.floor(k / FEW)).otherwise(10 + F.floor(k / MANY))).select("file", "k", F.concat_ws(",", *cells).alias("value"))
    head = F.when(turn == 1, F.lit(HEAD.replace("price", "cost"))).otherwise(F.lit(HEAD))
    heads = lines.select("file").distinct().select("file", F.lit(-1).cast("bigint").alias("k"), head.alias("value"))
    path = _folder(spark, "imports")
    lines.unionByName(heads).repartition("file").sortWithinPartitions("file", "k").select("file", "value").write.partitionBy("file").text(path)
    return path


def _name(path):
    return F.regexp_extract(path, r"/file=([0-9]+)/", 1).cast("bigint")


def _read(spark, sf_dir) -> imports.Import:
    return imports.read(spark, written(spark, sf_dir), contract.ledger(), limits=LIMITS)


def import_files(spark, sf_dir) -> DataFrame:
    """What becomes of each file, with its counts."""
    files = _read(spark, sf_dir).files
    return files.select(_name("path").alias("file"), "state", "failure", F.array_join("header_issues", ",").alias("header_issues"), "n_rows", "n_columns", "n_issues", "n_bad", "n_eligible")


def import_rows(spark, sf_dir) -> DataFrame:
    """The rows of all files that are read or blocked, with their places and issues."""
    rows = _read(spark, sf_dir).rows
    seen = F.array_join(F.transform(F.filter("raw", lambda c: c["kind"] != "VALUE"), lambda c: F.concat_ws(":", c["column"], c["kind"])), ",")
    return rows.select(
        _name("path").alias("file"), "row_number", "source_record_key", "instrument", F.unix_micros("executed_at").alias("at"), F.array_join("issues", ",").alias("issues"), "eligible", F.size("raw").alias("n_cells"), seen.alias("not_values")
    )


QUERIES = {"import_files": import_files, "import_rows": import_rows}

_CTE = f"""WITH {testbed.SQL}, named AS (SELECT *, file % 5 AS turn, CASE WHEN k % 29 = 0 THEN 'K' ELSE id END AS key FROM (SELECT *, CASE WHEN k < {10 * FEW} THEN k // {FEW} ELSE 10 + k // {MANY} END AS file FROM l)),
placed AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY k) + 1 AS row_number, count(*) OVER (PARTITION BY file, key) > 1 AS again FROM named),
failed AS (SELECT file, CASE WHEN bool_or(turn = 2 AND k % {FEW} = 100) THEN 'MALFORMED_CSV' WHEN bool_or(turn = 4 AND k % {FEW} = 100) THEN 'FIELD_TOO_LONG' END AS failure, any_value(turn) AS turn, count(*) AS n_rows,
 CASE WHEN bool_or(k % 59 = 0) THEN 9 ELSE 8 END AS n_columns FROM placed GROUP BY file),
codes AS (SELECT p.*, CASE WHEN p.turn = 1 THEN [] ELSE [x FOR x IN [CASE WHEN k % 59 = 0 THEN '_row:UNEXPECTED_COLUMN' END, CASE WHEN k % 31 = 0 THEN 'executed_at:INVALID_DATETIME' END, CASE WHEN k % 41 = 0 THEN 'quantity:NON_FINITE_DECIMAL' END,
 CASE WHEN k % 37 = 0 THEN 'side:UNKNOWN_ENUM' END, CASE WHEN again THEN 'source_record_key:DUPLICATE_SOURCE_KEY' END, CASE WHEN k % 47 = 0 THEN 'unit_price:EMPTY_VALUE' END] IF x IS NOT NULL] END AS issues
 FROM placed p JOIN failed f USING (file) WHERE f.failure IS NULL),
found AS (SELECT *, turn <> 1 AND len(issues) = 0 AND state <> 'CANCELLED' AS eligible FROM codes)"""
ORACLE_SQL = {
    "import_files": f"""{_CTE}, per AS (SELECT file, sum(len(issues)) AS n_issues, count(*) FILTER (len(issues) > 0) AS n_bad, count(*) FILTER (eligible) AS n_eligible FROM found GROUP BY file)
 SELECT file, CASE WHEN failure IS NOT NULL THEN 'QUARANTINED' WHEN turn = 1 THEN 'BLOCKED' ELSE 'READ' END AS state, failure, CASE WHEN failure IS NULL AND turn = 1 THEN 'price:MISSING_COLUMN' ELSE '' END AS header_issues,
 CASE WHEN failure IS NULL THEN n_rows END AS n_rows, CASE WHEN failure IS NULL THEN n_columns END AS n_columns, CAST(coalesce(n_issues, 0) + CASE WHEN failure IS NULL AND turn = 1 THEN 1 ELSE 0 END AS BIGINT) AS n_issues,
 coalesce(n_bad, 0) AS n_bad, coalesce(n_eligible, 0) AS n_eligible FROM failed LEFT JOIN per USING (file)""",
    "import_rows": f"""{_CTE} SELECT file, row_number, CASE WHEN turn <> 1 THEN key END AS source_record_key, CASE WHEN turn <> 1 THEN instrument END AS instrument, CASE WHEN turn <> 1 AND k % 31 <> 0 THEN epoch_us(executed_at) END AS at,
 array_to_string(issues, ',') AS issues, eligible, CASE WHEN k % 59 = 0 THEN 9 ELSE 8 END AS n_cells, CASE WHEN k % 47 = 0 THEN CASE WHEN turn = 1 THEN 'cost' ELSE 'price' END || ':EMPTY' ELSE '' END AS not_values FROM found""",
}

"""Files under a contract, as one path: scanned within caps, checked by their headers, read as typed rows with issues, or set apart.

A file that fails is quarantined: it has no rows. One whose header has issues is blocked: its rows keep their cells and nothing else. All
others are read; each file is an import of its own, so a key may occur once in each. Nothing here depends on how many files or rows there are: headers are
joined to rows by file, and issues are counted by file in one aggregation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ranges
from .contract import FIELDS, Contract, interpreted
from .delimited import Limits

#: What becomes of a file.
STATES = ("QUARANTINED", "BLOCKED", "READ")
_CELL = "struct<column:string,kind:string,original:string>"


@dataclass(frozen=True)
class Import:
    """files: those of a scan with header_issues, state, n_issues, n_bad (rows with issues) and n_eligible. rows: path, row_number, raw, the canonical columns, issues, eligible."""

    files: DataFrame
    rows: DataFrame


def header_issues(header: Column, contract: Contract) -> Column:
    """Array of column:CODE: names that occur twice (``_header`` for a name without letters), and bound columns that no name is."""
    twice = F.array_distinct(F.filter(header, lambda h: F.size(F.filter(header, lambda x: x == h)) > 1))
    named = F.transform(twice, lambda h: F.concat(F.when(h == "", "_header").otherwise(h), F.lit(":DUPLICATE_HEADER")))
    wanted = F.lit(sorted(set(contract.bindings.values())))
    lacking = F.transform(F.filter(wanted, lambda w: ~F.array_contains(header, w)), lambda w: F.concat(w, F.lit(":MISSING_COLUMN")))
    return F.concat(F.array_sort(named), lacking)


def raw_cells(header: Column, cells: Column, null_tokens: tuple[str, ...]) -> Column:
    """A struct (column, kind, original) for each name of the header and each cell beyond it (``__extra_1`` and so on).

    Kinds: MISSING (no cell, original null), NULL (a token for null, as written), EMPTY (nothing but white space), VALUE."""

    def cell(i: Column) -> Column:
        found = F.get(cells, i)
        name = F.coalesce(F.get(header, i), F.concat(F.lit("__extra_"), (i - F.size(header) + 1).cast("string")))
        null = found.isin(*null_tokens) if null_tokens else F.lit(False)
        blank = found.rlike(r"(?U)^\s*$")
        return F.struct(name.alias("column"), F.when(found.isNull(), "MISSING").when(null, "NULL").when(blank, "EMPTY").otherwise("VALUE").alias("kind"), found.alias("original"))

    n = F.greatest(F.size(header), F.size(cells))
    return F.when(n == 0, F.array().cast(f"array<{_CELL}>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), cell))


def original(raw: Column) -> Column:
    """The cells of ``raw_cells`` as the file has them: missing ones stand at the end only, so nothing is lost."""
    return F.transform(F.filter(raw, lambda c: c["kind"] != "MISSING"), lambda c: c["original"])


def read(spark: SparkSession, path: str, contract: Contract, delimiter: str = ",", limits: Limits = Limits()) -> Import:
    """Files of any size and number; columns are found by each file's own header, in any order.

    Cells beyond the header are an issue of their row (``_row:UNEXPECTED_COLUMN``), cells that lack are missing. A column that no binding names isn't read, but stays in ``raw``."""
    found = ranges.scan(spark, path, delimiter, limits)
    issues = F.when(F.col("failure").isNull(), header_issues(F.col("header"), contract)).otherwise(F.array().cast("array<string>"))
    files = found.files.withColumn("header_issues", issues)
    state = F.when(F.col("failure").isNotNull(), "QUARANTINED").when(F.size("header_issues") > 0, "BLOCKED").otherwise("READ")
    files = files.withColumn("state", state)
    heads = files.where("failure is null").select("path", "header", "state")
    held = found.rows.join(heads, "path")
    held = held.withColumn("raw", raw_cells(F.col("header"), F.col("cells"), contract.null_tokens)).withColumn("extra", F.size("cells") > F.size("header"))
    bound = sorted(set(contract.bindings.values()))
    cells = [F.get("cells", F.array_position("header", F.lit(b)).cast("int") - 1).alias(f"cell_{b}") for b in bound]
    good = held.where("state = 'READ'").select("path", "row_number", "raw", "extra", *cells)
    own = {f: f"cell_{b}" for f, b in contract.bindings.items()}
    rows = interpreted(good, _bound(contract, own), ("path", "row_number", "raw", "extra"), ("path",))
    more = F.when(F.col("extra"), F.array(F.lit("_row:UNEXPECTED_COLUMN"))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("issues", F.array_sort(F.concat("issues", more))).withColumn("eligible", F.col("eligible") & ~F.col("extra")).drop("extra")
    kinds = {f.name: f.dataType for f in rows.schema}
    blocked = held.where("state = 'BLOCKED'").select("path", "row_number", "raw", *[F.lit(None).cast(kinds[f]).alias(f) for f in FIELDS], F.array().cast("array<string>").alias("issues"), F.lit(False).alias("eligible"))
    per = rows.groupBy("path").agg(F.sum(F.size("issues")).alias("n_issues"), F.count(F.when(F.size("issues") > 0, 1)).alias("n_bad"), F.count(F.when(F.col("eligible"), 1)).alias("n_eligible"))
    files = files.join(per, "path", "left").fillna(0, ["n_issues", "n_bad", "n_eligible"]).withColumn("n_issues", F.col("n_issues") + F.size("header_issues"))
    return Import(files, rows.unionByName(blocked))


def _bound(contract: Contract, bindings: dict[str, str]) -> Contract:
    return Contract(**{**contract.__dict__, "bindings": bindings})

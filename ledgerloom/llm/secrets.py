"""Operator 8: secret scans (DataFrame functions only).

Base patterns are matched leftmost and without overlap; their places are the running lengths of the pieces
between matches (``split``) and of the matches (``regexp_extract_all``), in code points.

The method adds spans: over every candidate string (a run of a character class) a window slides, and the
Shannon entropy of its characters is kept by incremental counts: one character enters, one leaves, and the
sum of c*log2(c) is corrected by the two counts that changed. A candidate is reported, from the first to the
end of the last window whose entropy reaches its class's threshold. Allow-listed forms (identifiers such as
UUIDs, documentation keys, runs of a few characters, ordered alphabets) are suppressed; base spans stay.

Everything is one pass over a row: no shuffle, and no Python. Rows of long texts cost in proportion to them.

Defined results: a null text counts as empty; a text without matches has the SHA-256 of no bytes and empty
``spans``; repeated rows give repeated results; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: The base patterns, in the order in which they are listed, and how long a match must be.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # the same as runs of one character or more of which those under 18 in all are dropped
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "entropy")


@dataclass(frozen=True)
class CharClass:
    """A class of candidate strings: their pattern, alphabet, and the entropy (bits) a window must reach."""

    pattern: str
    alphabet: str
    bits: float


@dataclass(frozen=True)
class Scan:
    """Parameters. Candidates of the wide class hold a digit and a letter."""

    window: int = 20
    classes: tuple[CharClass, ...] = (
        CharClass(r"(?<![A-Za-z0-9])(?=[a-fA-F]*[0-9])(?=[0-9]*[a-fA-F])[0-9a-fA-F]{20,}(?![A-Za-z0-9])", "0123456789abcdefABCDEF", 3.0),
        CharClass(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.8),
    )
    allow: tuple[str, ...] = (
        r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
        r".*EXAMPLE.*",
        r"(?i).*(0123456789|abcdefghijkl).*",
        r"[A-Za-z_/-]+[0-9]{0,4}",
    )


_PLACES = "array<struct<s:int,e:int,m:string>>"
_SPANS = "array<struct<s:int,k:int,e:int>>"


def _places(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of (start, end, group) of the matches of ``pattern``: code points, end exclusive."""
    between = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.zip_with(F.slice(between, 1, F.size(found)), F.zip_with(found, held, lambda f, h: F.struct(F.char_length(f).alias("n"), h.alias("m"))), lambda gap, f: F.struct(gap.alias("gap"), f["n"].alias("n"), f["m"].alias("m")))

    def add(acc: Column, x: Column) -> Column:
        begin = F.when(F.size(acc) > 0, F.element_at(acc, -1)["e"]).otherwise(F.lit(0)) + x["gap"]
        return F.concat(acc, F.array(F.struct(begin.alias("s"), (begin + x["n"]).alias("e"), x["m"].alias("m"))))

    # texts without a match are spared the split
    return F.when(text.rlike(pattern), F.aggregate(parts, F.array().cast(_PLACES), add)).otherwise(F.array().cast(_PLACES))


def entropy_span(found: Column, alphabet: str, scan: Scan, bits: float) -> Column:
    """struct(first, last): from the first character of the first window of ``found["m"]`` whose entropy reaches
    ``bits`` to the end of the last; first is -1 if there is none.

    The run is cut into symbols once; counts are a line with one character for each symbol of the alphabet, of which a step
    writes two. So the cost is in proportion to the run's length."""
    w = scan.window
    table = F.array(*[F.lit(k * math.log2(k) if k else 0.0) for k in range(w + 2)])
    # entropy = log2(w) - sum / w: a window passes where its sum of c*log2(c) is at most this
    most = F.lit(w * (math.log2(w) - bits) + 1e-9)
    start = F.struct(F.lit("0" * len(alphabet)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
    log = lambda count: F.get(table, count)
    count = lambda counts, symbol: F.ascii(F.substring(counts, symbol, F.lit(1))) - ord("0")
    put = lambda counts, symbol, n: F.overlay(counts, F.char(n + ord("0")), symbol, F.lit(1))

    def step(acc: Column, x: Column) -> Column:
        came = count(acc["counts"], x["enters"])
        with_it = put(acc["counts"], x["enters"], came + 1)
        gone = count(with_it, x["leaves"])
        left = x["leaves"] > 0
        now = acc["sum"] + log(came + 1) - log(came) + F.when(left, log(gone - 1) - log(gone)).otherwise(F.lit(0.0))
        counts = F.when(left, put(with_it, x["leaves"], gone - 1)).otherwise(with_it)
        passes = (x["i"] >= w) & (now <= most)
        first = F.when((acc["first"] < 0) & passes, x["i"] - w).otherwise(acc["first"])
        return F.struct(counts.alias("counts"), now.alias("sum"), first.alias("first"), F.when(passes, x["i"]).otherwise(acc["last"]).alias("last"))

    def scanned(symbols: Column) -> Column:
        left = F.slice(F.concat(F.array_repeat(F.lit(0), w), symbols), F.lit(1), F.size(symbols))
        pairs = F.zip_with(symbols, left, lambda enters, leaves: F.struct(enters.alias("enters"), leaves.alias("leaves")))
        steps = F.transform(pairs, lambda x, i: F.struct((i + 1).alias("i"), x["enters"].alias("enters"), x["leaves"].alias("leaves")))
        return F.aggregate(steps, start, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))

    symbols = F.transform(F.regexp_extract_all(found["m"], F.lit("."), F.lit(0)), lambda x: F.instr(F.lit(alphabet), x))
    return F.get(F.transform(F.array(symbols), scanned), F.lit(0))  # an array of one, so that the symbols are made once


def _added(text: Column, scan: Scan) -> Column:
    """Spans of high entropy, of all classes."""
    allowed = "|".join(f"(?:{x})" for x in scan.allow)
    out = []
    for c in scan.classes:
        held = F.filter(_places(text, c.pattern), lambda x: ~x["m"].rlike(f"^(?:{allowed})$"))
        alphabet, bits = c.alphabet, c.bits
        spans = F.transform(held, lambda x: F.struct(x["s"].alias("s"), entropy_span(x, alphabet, scan, bits).alias("w")))  # noqa: B023
        spans = F.filter(spans, lambda x: x["w"]["first"] >= 0)
        out.append(F.transform(spans, lambda x: F.struct((x["s"] + x["w"]["first"]).alias("s"), F.lit(3).alias("k"), (x["s"] + x["w"]["last"]).alias("e"))))
    return F.array_distinct(F.concat(*out)).cast(_SPANS)


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def apply(df: DataFrame, scan: Scan = Scan(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy for each row."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(id_col).alias("doc_id"), body.alias("text"))
    kind = lambda places, k: F.transform(places, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))
    assign = F.filter(_places(F.col("text"), ASSIGN, 2), lambda x: F.char_length(x["m"]) >= 12)
    rows = rows.select("doc_id", assign.alias("a"), _places(F.col("text"), ACCESS).alias("b"), _places(F.col("text"), HEX).alias("c"), _added(F.col("text"), scan).alias("added"))
    rows = rows.withColumn("base", F.concat(kind(F.col("a"), 0), kind(F.col("b"), 1), kind(F.col("c"), 2)).cast(_SPANS))
    size = lambda c: F.size(c).cast("bigint")
    return rows.select(
        "doc_id", size("a").alias("n_assign"), size("b").alias("n_access"), size("c").alias("n_hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", "added")).alias("spans"), size("added").alias("n_entropy"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return apply(common.table(spark, sf_dir, "documents"))

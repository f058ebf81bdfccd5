"""Operator 13: fill-in-middle transformation, as an Arrow-batched pandas UDF.

A text is cut into units (matches of a pattern, by default code points). The ends of the units are collected in one
compact array by ``finditer``; two numbers drawn from the id choose a first and a second cut among them, and two
look-ups in the array give the places where the text is sliced into prefix, middle and suffix. A third number decides
whether the text stays plain, a fourth the order of the parts:

* ``plain``: the text as it is (also if it is empty or already holds one of the marks, so that every output can be read back);
* ``psm``: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle;
* ``spm``: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle.

The numbers are the first four 32-bit groups of SHA-256 of ``salt:id``: they depend on the row alone, so reruns, retries and other
partitionings give the same output. ``restored`` reads a text back from an output and its form alone: a part holds no
mark, and none can begin in a part and end in a mark, since marks begin with their only ``<``; so the first mark found is the one written.

Scale: one pass, no shuffle; a batch holds the texts of one Arrow batch, their outputs and the ends of one text's units
(4 bytes each). Nothing is kept between rows, so a lost executor repeats its tasks and no more.

Defined results: a null text counts as empty; an empty text is plain, with 0 units; characters between units stay with the unit that
follows, those after the last unit with the suffix; a null id draws from ``salt:`` alone; rows that repeat an id and text repeat their result;
other columns, of any name, stay as they are unless they have the name of a new one, which then takes their place; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from array import array
from dataclasses import dataclass
from operator import methodcaller

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FIELDS = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string, output_sha256 string, restored_sha256 string"
_END = methodcaller("end")


@dataclass(frozen=True)
class FillInMiddle:
    """Parameters. ``unit``: pattern of a unit; ``salt``: what precedes the id in the seed; ``plain_from``: of 100 texts, those numbered from
    here on stay plain; ``spm_below``: of 100 others, those numbered below have their suffix first."""

    unit: str = r"(?s)."
    salt: str = "1"
    plain_from: int = 90
    spm_below: int = 20


def ends(text: str, unit: regex.Pattern) -> array:
    """Where each unit of ``text`` ends, in code points."""
    return array("I" if len(text) < 1 << 32 else "Q", map(_END, unit.finditer(text)))


def seeds(salt: str, key: int | str | None) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits for a row."""
    drawn = hashlib.sha256(f"{salt}:{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(drawn[i : i + 4], "big") for i in (0, 4, 8, 12))


def cut(text: str, key: int | str | None, fim: FillInMiddle, unit: regex.Pattern) -> tuple[int, str, int | None, int | None, str]:
    """Number of units, form, code points of prefix and middle, and the output."""
    at = ends(text, unit)
    n = len(at)
    first, second, plain, order = seeds(fim.salt, key)
    if not text or plain % 100 >= fim.plain_from or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    low, high = sorted((first % (n + 1), second % (n + 1)))
    a, b = (at[k - 1] if k else 0 for k in (low, high))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if order % 100 < fim.spm_below:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The text that ``output`` was made of."""
    if form == "plain":
        return output
    one, two = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    if not output.startswith(one):
        raise ValueError(f"an output of form {form} begins with {one}")
    former, _, rest = output[len(one) :].partition(two)
    latter, found, middle = rest.partition(MIDDLE)
    if not found:
        raise ValueError(f"an output of form {form} holds {two} and {MIDDLE}")
    return former + middle + latter if form == "psm" else latter + middle + former


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def transformed(key: Column, text: Column, fim: FillInMiddle = FillInMiddle()) -> Column:
    """A struct of ``FIELDS`` for each row."""

    @F.pandas_udf(FIELDS)
    def run(keys: pd.Series, texts: pd.Series) -> pd.DataFrame:
        unit = regex.compile(fim.unit)
        rows = []
        for key, text in zip(keys, texts):
            n, form, prefix, middle, output = cut(text or "", key, fim, unit)
            rows.append((n, form, prefix, middle, output, _digest(output), _digest(restored(output, form))))
        out = pd.DataFrame(rows, columns=[f.split()[0] for f in FIELDS.split(", ")])
        return out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    return run(key.cast("string"), text)


def texts_back(output: Column, form: Column) -> Column:
    """The text of each output."""

    @F.pandas_udf("string")
    def run(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([None if o is None or f is None else restored(o, f) for o, f in zip(outputs, forms)], dtype=object)

    return run(output, form)


def apply(df: DataFrame, fim: FillInMiddle = FillInMiddle(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with the columns of ``FIELDS``: the output itself, how it was cut, and digests of the output and of the text read back from it."""
    made = "made"
    while made in df.columns:
        made += "_"
    fields = [f.split()[0] for f in FIELDS.split(", ")]
    kept = [F.col(c) for c in df.columns if c not in fields]
    return df.withColumn(made, transformed(F.col(id_col), F.col(text), fim)).select(*kept, *(F.col(made)[f].alias(f) for f in fields))


def query(spark, sf_dir: str) -> DataFrame:
    out = apply(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


ORACLE_SQL = """
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents
), s AS (
  SELECT doc_id, t, length(t) AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM h
), c AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM s
), o AS (
  SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substring(t, 1, a) || '<S>' || substring(t, b + 1) || '<M>' || substring(t, a + 1, b - a)
    ELSE '<S>' || substring(t, b + 1) || '<P>' || substring(t, 1, a) || '<M>' || substring(t, a + 1, b - a) END AS output FROM c
), p AS (
  SELECT *, CASE form WHEN 'psm' THEN strpos(output, '<S>') ELSE strpos(output, '<P>') END AS two, strpos(output, '<M>') AS three FROM o
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars, sha256(output) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN output
    WHEN 'psm' THEN substring(output, 4, two - 4) || substring(output, three + 3) || substring(output, two + 3, three - two - 3)
    ELSE substring(output, two + 3, three - two - 3) || substring(output, three + 3) || substring(output, 4, two - 4) END) AS restored_sha256
FROM p
"""

import hashlib
import random

import duckdb
import pytest
import regex
from pyspark.sql import functions as F

from ledgerloom.llm import fill_in_middle as fim

SF = "/root/testdata/sf0.001"


def plain_version(doc_id, text):
    """The contract, character by character."""
    text = text or ""
    n = len(text)
    x = hashlib.sha256(("1:" + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[i : i + 8], 16) for i in (0, 8, 16, 24))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if text == "" or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h4 % 100 < 20 else "psm"
    out = "<S>" + s + "<P>" + p + "<M>" + m if form == "spm" else "<P>" + p + "<S>" + s + "<M>" + m
    return (doc_id, n, form, len(p), len(m), sha(out), sha(text))


COLUMNS = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]


def test_query_is_the_plain_version_and_its_sql(spark, documents):
    got = sorted(tuple(r) for r in fim.query(spark, SF).select(*COLUMNS).collect())
    assert got == sorted(plain_version(r["doc_id"], r["text"]) for r in documents.collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert got == sorted(con.execute(fim.ORACLE_SQL).fetchall())


def test_odd_rows(odd, none):
    out = fim.apply(odd)
    key = lambda r: tuple((x is not None, x) for x in r)
    got = sorted((tuple(r) for r in out.select(*COLUMNS).collect()), key=key)
    assert got == sorted((plain_version(r["doc_id"], r["text"]) for r in odd.collect()), key=key)
    assert out.where(~F.col("text").eqNullSafe(fim.texts_back(F.col("output"), F.col("form")))).where("text is not null").count() == 0
    assert "shard" in out.columns and out.columns.count("n") == 1
    assert fim.apply(none).count() == 0


def test_marks_in_texts_and_at_borders(spark):
    alphabet = ["<", ">", "P", "S", "M", "a", "é", "\U0001f600", "\n", "<P", "S>"]
    draw = random.Random(3)
    rows = [(i, "".join(draw.choices(alphabet, k=draw.randrange(12)))) for i in range(4000)]
    got = {tuple(r) for r in fim.apply(spark.createDataFrame(rows, "doc_id bigint, text string")).select(*COLUMNS).collect()}
    assert got == {plain_version(*r) for r in rows}
    assert {g[2] for g in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("unit", [r"\X", r"\S+\s*", r"[^\n]*\n|[^\n]+", r"\d+"])
def test_other_units_round_trip(unit):
    pattern, rule = regex.compile(unit), fim.FillInMiddle(unit=unit, plain_from=100)
    for key, text in enumerate(["éá two  words\nline\n", "7 and 8 ", "no digits", "\r\n\r\n", "x" * 5000]):
        n, form, prefix, middle, output = fim.cut(text, key, rule, pattern)
        assert n == len(pattern.findall(text)) and form != "plain"
        assert fim.restored(output, form) == text
        assert prefix in {0, *fim.ends(text, pattern)} and prefix + middle in {0, *fim.ends(text, pattern)}


def test_a_very_long_text():
    text = "漢x" * 700_000
    n, form, prefix, middle, output = fim.cut(text, 2, fim.FillInMiddle(plain_from=100), regex.compile(r"(?s)."))
    assert n == len(text) and fim.ends(text, regex.compile("(?s).")).itemsize == 4 and fim.restored(output, form) == text


def test_broken_outputs_are_refused():
    for output, form in (("<S>a", "psm"), ("<P>a<S>b", "psm"), ("<S>a<M>b", "spm")):
        with pytest.raises(ValueError):
            fim.restored(output, form)
